"""Strings at any depth of JSON texts, a level at a time, and payloads that were encoded twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect import schema as S
from recollect.functions import text as X
from recollect.sources.scratch import written


def decoded(payload: str | Column, schema: str) -> Column:
    """The payload as a struct of ``schema``: JSON, or a JSON string that holds JSON. Null where it can't be read."""
    text = F.trim(F.col(payload) if isinstance(payload, str) else payload)
    inner = F.when(text.startswith('"'), F.try_variant_get(F.try_parse_json(text), "$", "string")).otherwise(text)
    kind = T._parse_datatype_string(schema)
    return F.when(F.try_parse_json(inner).isNotNull(), F.from_json(inner, kind))


def strings(rows: DataFrame, json_col: str) -> DataFrame:
    """``rows`` without ``json_col``, with key, value and depth: one row for each string in it, whatever its depth.

    The key is that of the nearest object around the string, lower-cased and without white space at its ends; depth counts
    objects and arrays around it. JSON is parsed once; each round opens one level of what is still nested, so there are as many
    rounds as the deepest text has levels. A text that isn't JSON has no strings.
    """
    spark, own = rows.sparkSession, [c for c in rows.columns if c != json_col]
    level = rows.select(*own, F.lit("").alias("key"), F.try_parse_json(F.col(json_col)).alias("v"), F.lit(0).alias("depth")).filter("v IS NOT NULL")
    kind, done = F.schema_of_variant("v"), []
    while True:
        level = written(level.withColumn("kind", kind), "json")
        done.append(level.filter("kind = 'STRING'").select(*own, "key", F.variant_get("v", "$", "string").alias("value"), "depth"))
        level = level.filter("kind LIKE 'OBJECT%' OR kind LIKE 'ARRAY%'").drop("kind")
        if level.isEmpty():
            break
        opened = level.alias("l").lateralJoin(spark.tvf.variant_explode(F.col("l.v").outer()).alias("e"))
        key = F.when(F.col("e.key").isNull(), F.col("l.key")).otherwise(F.lower(F.trim("e.key")))
        level = opened.select(*[F.col(f"l.{c}") for c in own], key.alias("key"), F.col("e.value").alias("v"), (F.col("l.depth") + 1).alias("depth")).filter("v IS NOT NULL")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def path_hints(rows: DataFrame, json_col: str) -> DataFrame:
    """Of ``strings`` those that name a path: under a key for paths, or with the look of one; blank ones aren't any."""
    return strings(rows, json_col).filter((F.col("key").isin(S.PATH_KEYS) | X.path_like("value")) & (F.trim("value") != ""))
