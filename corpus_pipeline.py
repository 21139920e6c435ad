"""From raw documents to packed training sequences, in five stages of the training-data operators.

Each stage reads what its predecessor kept as a written table, takes its decisions on that alone, and returns the columns
of ``documents``; the last one returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import exact_dedup, language_id, packing, simhash, substring_dedup
from recollect.llm.common import Scratch, cleared


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is recognised stay; null, empty and other texts without a letter go."""
    return language_id.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the length of white space the one with the smallest id stays; rows that repeat it go."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share four fifths of their five-word shingles, which SimHash comparison prepares and exact sets decide.

    Of a group the document with the smallest id stays; documents without an id stay.
    """
    return simhash.drop_near_copies(docs, words_each=5, confirmed=True)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose words are rewritten with single spaces, those that lose all go; the others stay as they were."""
    own = ["doc_id", "text"]
    places = [c if c in own else f"c{i}" for i, c in enumerate(docs.columns)]  # whatever other columns are called
    out = substring_dedup.strip_repeats(docs.toDF(*places))
    cut = F.col("__n_removed") > 0
    kept = F.when(cut, F.col("__kept_text")).otherwise(F.col("text"))
    out = out.filter(~cut | (F.col("__kept_text") != "")).withColumn("text", kept)
    if "n_chars" in docs.columns:
        n = places[docs.columns.index("n_chars")]
        out = out.withColumn(n, F.when(cut, F.char_length("text").cast("long")).otherwise(F.col(n)))
    return out.select(*places).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null or empty text is its end token alone."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("exact copies", exact),
    ("near copies", near),
    ("repeated passages", passages),
    ("packing", packed),
]

#: SQL can't express the language model, the tokenizer or the links; a test holds the rows that run() keeps against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        with cleared():  # of what the stage wrote on its way
            docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
