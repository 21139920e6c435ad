"""Exact deduplication by tree-merge of sorted digest runs.

Every input partition sorts the digests of its own texts into a run: a file of entries in digest order, one for each text with
the smallest identifier seen. Runs then meet in binomial rounds: in a round the runs whose numbers agree but for their lowest
bits are merged by several tasks, each of which takes one range of digests, finds its beginning in every run by bisection,
and reads the runs on from there side by side, a batch of each at a time. Equal digests meet at the head of the merge, where
only the smallest identifier goes on. What comes out is a run again, in as many files as ranges, so nothing is sorted
after the first step, and no task ever holds more than a batch of each run. After ``log(partitions)`` rounds one run is left.
A text that fills a third of the table is one entry a run.

Entries are *verified*: they only merge when SHA-256, a second, independent 64-bit hash and the length all agree.

Run files go to the shared folder. One counts only once its task has ended and its name stands in the written manifest; what a
lost attempt left is never read.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import SPACE, Scratch, join_spread
from recollect.llm.warc import _system

#: A round merges 2**ROUND_BITS runs into one.
ROUND_BITS = 4
#: Entries of a batch in a run file; entries of a range of digests, about.
_BATCH, _RANGE = 1 << 12, 1 << 20
_ENTRY = pa.schema([("sha", pa.binary(32)), ("proof", pa.int64()), ("size", pa.int64()), ("nameless", pa.bool_()), ("id", pa.int64()), ("row", pa.int64()), ("n", pa.int64())])
_MANIFEST = "run long, part long, path string, entries long"


def normalised(text_col: str = "text"):
    """The text with every run of white space made one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")


def _thinned(entries: Iterator[tuple]) -> Iterator[tuple]:
    """Of sorted entries the first of each text, standing for all rows of the others."""
    held = None
    for e in entries:
        if held is not None and e[:3] == held[:3]:
            held = (*held[:6], held[6] + e[6])
        else:
            if held is not None:
                yield held
            held = e
    if held is not None:
        yield held


def _written(entries: Iterator[tuple], folder: str) -> tuple[str, int]:
    """A new run file of sorted entries: its path, and how many there are."""
    system, root = _system(folder)
    system.create_dir(root)
    name, n = f"{uuid.uuid4().hex}.run", 0
    with system.open_output_stream(f"{root}/{name}", compression=None) as out, pa.ipc.new_file(out, _ENTRY) as file:
        rows: list[tuple] = []

        def flush() -> None:
            file.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ENTRY, strict=True)], schema=_ENTRY))
            rows.clear()

        for e in entries:
            rows.append(e)
            n += 1
            if len(rows) == _BATCH:
                flush()
        if rows:
            flush()
    return f"{folder}/{name}", n


def _read_from(path: str, low: bytes, high: bytes | None) -> Iterator[tuple]:
    """The entries of a run file from digest ``low`` to before ``high``, a batch in memory at a time."""
    system, place = _system(path)
    with system.open_input_file(place) as source, pa.ipc.open_file(source) as file:
        first, last = 0, file.num_record_batches - 1  # the last batch that begins below low, or the first one
        while first < last:
            middle = (first + last + 1) // 2
            if file.get_batch(middle).column(0)[0].as_py() < low:
                first = middle
            else:
                last = middle - 1
        for i in range(first, file.num_record_batches):
            for e in zip(*(c.to_pylist() for c in file.get_batch(i).columns), strict=True):
                if high is not None and e[0] >= high:
                    return
                if e[0] >= low:
                    yield e


def _first_runs(digests: DataFrame, folder: str) -> DataFrame:
    """One run file of each partition of ``digests``, which Spark sorts (and spills) where it lies; gives the manifest."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from ((*row, 1) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path, n = _written(_thinned(entries(batches)), folder)
        yield _manifest([(TaskContext.get().partitionId(), 0, path, n)] if n else [])

    keyed = digests.select(F.unhex("sha").alias("sha"), "proof", "size", F.col("id").isNull().alias("nameless"), F.coalesce("id", F.lit(0)).alias("id"), "row")
    return keyed.sortWithinPartitions("sha", "proof", "size", "nameless", "id", "row").mapInArrow(each, _MANIFEST)


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], ["run", "part", "path", "entries"])


def _edge(part: int, parts: int) -> bytes:
    """Where a range of digests begins; digests are uniform."""
    return (part * (1 << 64) // parts).to_bytes(8, "big")


def _merged(runs: list[list[str]], parts: int, part: int) -> Iterator[tuple]:
    """The multiway merge of one range of digests over runs, each a list of files in order of digests."""
    low, high = _edge(part, parts), _edge(part + 1, parts) if part + 1 < parts else None

    def stream(files: list[str]) -> Iterator[tuple]:
        for path in files:
            yield from _read_from(path, low, high)

    return _thinned(heapq.merge(*map(stream, runs)))


def _task(parts: int, folder: str):
    def merge(files: pa.Table) -> pa.Table:
        by_run: dict[int, list[str]] = {}
        for f in sorted(files.select(["run", "from", "path"]).to_pylist(), key=lambda f: (f["run"], f["from"])):
            by_run.setdefault(f["run"], []).append(f["path"])
        into, part = files.column("into")[0].as_py(), files.column("part")[0].as_py()
        path, n = _written(_merged(list(by_run.values()), parts, part), folder)
        return pa.Table.from_batches([_manifest([(into, part, path, n)] if n else [])])

    return merge


def merge_runs(manifest: DataFrame, folder: str, scratch: Scratch, bits: int = ROUND_BITS) -> DataFrame:
    """The manifest of one run in ranges of digests, merged from the runs of a saved manifest in binomial rounds."""
    runs, entries = manifest.agg(F.max("run") + 1, F.sum("entries")).first()
    if not entries:
        return manifest
    spare, old = manifest.sparkSession.sparkContext.defaultParallelism, 1
    for _ in range(max(1, math.ceil(math.log2(runs) / bits))):
        groups = math.ceil(runs / (1 << bits))
        parts = max(1, math.ceil(entries / groups / _RANGE), math.ceil(spare / groups))

        # a file goes to each task whose range of digests meets its own
        meets = F.sequence(F.floor(F.col("part") * parts / old), F.ceil((F.col("part") + 1) * parts / old) - 1)
        listed = manifest.select("run", F.col("part").alias("from"), "path", F.shiftright("run", bits).alias("into"), F.explode(meets).alias("part"))
        manifest = scratch.save(listed.repartition(groups * parts, "into", "part").groupBy("into", "part").applyInArrow(_task(parts, folder), _MANIFEST))
        runs, old = groups, parts
    return manifest


def entries_of(manifest: DataFrame) -> DataFrame:
    """(sha, proof, size, keep_id, keep_row, n) of every entry of the files of a saved manifest."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = _system(path)
                with system.open_input_file(place) as source, pa.ipc.open_file(source) as file:
                    for i in range(file.num_record_batches):
                        b = file.get_batch(i)
                        sha = pa.array([x.hex() for x in b.column(0).to_pylist()], pa.string())
                        id_ = pc.if_else(b.column(3), pa.scalar(None, pa.int64()), b.column(4))
                        yield pa.RecordBatch.from_arrays([sha, b.column(1), b.column(2), id_, b.column(5), b.column(6)], ["sha", "proof", "size", "keep_id", "keep_row", "n"])

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(each, "sha string, proof long, size long, keep_id long, keep_row long, n long")


def mark_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of white space by one space; a null text counts as empty
    and so equals an empty one. The row with the smallest id stays. Null ids come after all others; of rows that
    repeat both id and text exactly one stays. An empty table gives an empty result; other columns don't matter.
    """
    spark, text = docs.sparkSession, F.col("__text")
    scratch = Scratch(spark, "exact")
    digests = scratch.save(
        docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("__text")).select(
            "id", F.sha2(text, 256).alias("sha"), F.xxhash64(text).alias("proof"), F.octet_length(text).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch.base}/runs")
    folder = re.sub(r"^file:/+", "file:///", path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString())
    # written, so that its size is known: else Spark takes it for as small as the manifest, and broadcasts it
    classes = scratch.save(entries_of(merge_runs(scratch.save(_first_runs(digests, folder)), folder, scratch)))
    joined = join_spread(
        digests, classes.withColumn("group_size", F.col("n")), ["sha", "proof", "size"], ["keep_id", "keep_row", "group_size"],
        F.col("n"), digests.count(), F.col("row"),
    )
    return joined.select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns, whatever these are called.

    Null and empty texts are copies of one another. Rows are told apart by id and text: of those that repeat both one stays.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.select(own.alias("docs"), F.col(id_col).cast("long").alias("id"), F.sha2(normalised(text_col), 256).alias("sha"))
    marks = Scratch(docs.sparkSession, "exact-marks").save(mark_exact_copies(docs, id_col, text_col))
    stay = marks.filter("kept").select(F.col(id_col).alias("stays"), F.col("text_sha256").alias("same"))
    out = held.join(stay, F.col("id").eqNullSafe(F.col("stays")) & (F.col("sha") == F.col("same")), "left_semi")
    if not marks.filter(F.col(id_col).eqNullSafe(F.col("keep_id")) & ~F.col("kept")).isEmpty():
        out = out.dropDuplicates(["id", "sha"])
    return out.select(*[F.col(f"docs.`{c}`").alias(c) for c in docs.columns])
