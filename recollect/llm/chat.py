"""Preference formatting: a prompt rendered once, and the two completions with their loss masks.

Chosen and rejected conversations come as tables of turns. Their longest common prefix of turns is the prompt; what
follows is the chosen and the rejected completion, in which the replies of the trained role count for the loss.

Equal messages of both sides are counted against each other; each range of turns of a pair finds its first difference by
itself, and ranges tell each other theirs in a table of one row a range. So neither the number of turns of a conversation
nor that of conversations or of repeated rows is bounded by what a task can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import Scratch, join_spread

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of a pair that are looked at together.
RANGE = 1_000
#: Stands for a missing number of a turn, before all others.
_NO_TURN = -(1 << 63)


def _turns(df: DataFrame, pair_col: str, turn_col: str, role_col: str, text_col: str, chosen: bool) -> DataFrame:
    turn = F.coalesce(F.col(turn_col).cast("long"), F.lit(_NO_TURN))
    return df.select(
        F.struct(F.col(pair_col).alias("id")).alias("pair"),  # a struct, as equality of structs holds for nulls in them
        F.floor(turn / RANGE).alias("range"), turn.alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.lit(int(chosen)).cast("long").alias("c"), F.lit(int(not chosen)).cast("long").alias("r"),
    )


def _plain(text: Column) -> Column:
    """Text that can't be read as a mark of the template."""
    return F.replace(F.replace(text, F.lit("<|im_start|>"), F.lit("<| im_start |>")), F.lit("<|im_end|>"), F.lit("<| im_end |>"))


def format_preferences(
    chosen: DataFrame, rejected: DataFrame, pair_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant"
) -> DataFrame:
    """One row for each rendered message: pair, part (prompt, chosen or rejected), turn, role, rendered, loss_from, loss_chars.

    In a completion, the ``loss_chars`` characters from ``loss_from`` on of a message of the trained role count for the loss:
    its text and the mark of its end, not the heading; elsewhere loss_chars is 0. A turn is common when both sides have
    the same messages (role and text) under its number, as many times each; the first turn that isn't ends the prompt, so
    of equal conversations there is only a prompt, and of a pair with one side missing only a completion. Rows with the
    same turn are messages of one turn, in order of role and text, repeated ones too. Rows without a turn come before
    the others as one turn, rows without a pair make one of their own. A null role is a user, a null text empty. Marks of
    the template within texts are spaced out. Other columns don't matter.
    """
    columns = (pair_col, turn_col, role_col, text_col)
    sides = _turns(chosen, *columns, True).unionByName(_turns(rejected, *columns, False))
    both = sides.groupBy("pair", "range", "turn", "role", "text").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    firsts = both.groupBy("pair", "range").agg(F.min(F.when(F.col("c") != F.col("r"), F.col("turn"))).alias("first"))
    # a row a range: the number of rows of a pair here is that of its turns over RANGE
    firsts = firsts.withColumn("first", F.min("first").over(Window.partitionBy("pair")))
    both = both.join(firsts, ["pair", "range"])
    common = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    each = lambda part, n: F.struct(F.lit(part).alias("part"), F.col(n).alias("n"))
    parts = F.when(common, F.array(each("prompt", "c"))).otherwise(F.array(each("chosen", "c"), each("rejected", "r")))
    rows = both.withColumn("p", F.explode(F.filter(parts, lambda x: x["n"] > 0))).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("p.n"))))
    rows = rows.select("pair", "p.part", "turn", _plain(F.col("role")).alias("role"), F.col("role").alias("as_given"), _plain(F.col("text")).alias("text"))
    head = F.concat(F.lit(START), "role", F.lit("\n"))
    counts = (F.col("part") != "prompt") & (F.col("as_given") == trained)
    return rows.select(
        F.col("pair.id").alias(pair_col), "part", F.when(F.col("turn") != _NO_TURN, F.col("turn")).alias(turn_col), F.col("role").alias(role_col),
        F.concat(head, "text", F.lit(END + "\n")).alias("rendered"), F.char_length(head).alias("loss_from"),
        F.when(counts, F.char_length("text") + len(END)).otherwise(0).alias("loss_chars"),
    )


def assemble(rows: DataFrame, pair_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """One row a pair: prompt, chosen, rejected, and each completion's loss spans as (from, length) in characters.

    A pair's texts are put together in one row, so this is for conversations of a bounded length.
    """

    def text(part: str) -> Column:
        return F.array_join(F.transform(F.filter("all", lambda x: x["part"] == part), lambda x: x["rendered"]), "")

    def spans(part: str) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,length:int>>").alias("out"))
        step = lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["rendered"])).alias("at"),
            F.when(x["loss_chars"] > 0, F.concat(acc["out"], F.array(F.struct((acc["at"] + x["loss_from"]).alias("from"), x["loss_chars"].alias("length"))))).otherwise(acc["out"]).alias("out"),
        )
        return F.aggregate(F.filter("all", lambda x: x["part"] == part), start, step, lambda acc: acc["out"])

    grouped = rows.groupBy(pair_col).agg(F.array_sort(F.collect_list(F.struct(turn_col, "part", "rendered", "loss_from", "loss_chars"))).alias("all"))
    return grouped.select(
        pair_col, text("prompt").alias("prompt"), text("chosen").alias("chosen"), text("rejected").alias("rejected"), spans("chosen").alias("chosen_loss"), spans("rejected").alias("rejected_loss")
    )


def broken_replies(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """Rejected conversations for a table that has none: each ends at one of its replies, after half of that's characters.

    It is the reply with the smallest MD5 of ``conversation:turn``, so it lies anywhere. A conversation without a reply of
    the trained role is left as it is, and so are rows without a turn.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    place = F.struct(F.md5(F.concat_ws(":", F.col("__pair.id").cast("string"), F.col(turn_col).cast("string"))), F.col(turn_col).alias("turn"))
    reply = F.when((F.col(role_col) == trained) & F.col(turn_col).isNotNull(), place)
    keyed = turns.select(F.struct(F.col(conv_col).alias("id")).alias("__pair"), F.hash(conv_col).alias("__key"), turn_col, role_col, text_col)
    ends = scratch.save(keyed.groupBy("__key", "__pair").agg(F.min(reply)["turn"].alias("__end"), F.count("*").alias("__n")))
    total = ends.agg(F.sum("__n")).first()[0] or 0
    out = join_spread(keyed, ends, ["__key", "__pair"], ["__end"], F.col("__n"), total, F.struct(turn_col, F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    half = text.substr(F.lit(1), F.floor(F.char_length(text) / 2).cast("int"))
    at_end = (F.col(turn_col) == F.col("__end")) & (F.col(role_col) == trained)
    out = out.filter(F.col("__end").isNull() | F.col(turn_col).isNull() | (F.col(turn_col) <= F.col("__end")))
    return out.select(F.col("__pair.id").alias(conv_col), turn_col, role_col, F.when(at_end, half).otherwise(text).alias(text_col))


def digests(turns: DataFrame) -> DataFrame:
    """Every conversation against its broken form, rendered, in numbers."""
    rows = format_preferences(turns, broken_replies(turns))
    return rows.select("conv_id", "part", "turn", "role", F.char_length("rendered").alias("n_chars"), "loss_chars", F.sha2("rendered", 256).alias("rendered_sha256"))


DIGESTS_SQL = r"""
    WITH given AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
    ends AS (SELECT conv_id, arg_min(turn, md5(conv_id || ':' || turn)) AS e FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
    broken AS (SELECT conv_id, turn, role, CASE WHEN turn = e AND role = 'assistant' THEN left(text, length(text) // 2) ELSE text END AS text
          FROM given LEFT JOIN ends USING (conv_id) WHERE e IS NULL OR turn <= e),
    merged AS (SELECT conv_id, turn, role, text, sum(c) AS c, sum(r) AS r
          FROM (SELECT *, 1 AS c, 0 AS r FROM given UNION ALL SELECT *, 0, 1 FROM broken) GROUP BY conv_id, turn, role, text),
    split AS (SELECT *, min(CASE WHEN c <> r THEN turn END) OVER (PARTITION BY conv_id) AS first FROM merged),
    parts AS (
        SELECT conv_id, 'prompt' AS part, turn, role, text, c AS n FROM split WHERE first IS NULL OR turn < first
        UNION ALL SELECT conv_id, 'chosen', turn, role, text, c FROM split WHERE turn >= first
        UNION ALL SELECT conv_id, 'rejected', turn, role, text, r FROM split WHERE turn >= first),
    shown AS (SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered, unnest(range(CAST(n AS BIGINT))) AS copy FROM parts)
    SELECT conv_id, part, turn, role, CAST(length(rendered) AS INTEGER) AS n_chars,
           CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(text) + 10 ELSE 0 END AS INTEGER) AS loss_chars,
           sha256(rendered) AS rendered_sha256
    FROM shown
"""
