"""Near copies by the likeness of their word shingles: SimHash finds candidates, exact Jaccard decides.

Texts are near copies if the Jaccard likeness of their sets of five-word shingles is at least ``LIKENESS``. At 0.8 some 20 of 128
bits differ, too many for keys by pigeonhole, so texts meet on keys of further SimHash bits (``simhash.close_files``; a pair at 0.8
has none in common about once in a hundred million). Texts that meet are compared bit-sliced by their fingerprints, what is near by
them by all of those bits, and what is left exactly, so no other texts are linked. Sets of few shingles, whose bits say little, also meet on the
shingles themselves: alike sets share one of the first m - ceil(0.8 m) + 1 of their m hashes in order, without exception.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import simhash
from recollect.llm.common import Scratch, join_spread
from recollect.llm.components import components
from recollect.llm.set_links import RADIUS, SMALL, Likeness, fingerprints, links

WORDS = 5
#: Likeness from which texts are near copies, as a ratio of whole numbers.
LIKENESS = (4, 5)
SEED = 42


def shingles(text: bytes | None, words_each: int = WORDS) -> np.ndarray:
    """Distinct hashes of the word shingles of UTF-8 text, sorted; fewer words make one shingle, and so do none."""
    words = (text or b"").lower().split()
    if len(words) <= words_each:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(words_each)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - words_each + 1))


def first_keys(hashes: np.ndarray) -> list[int]:
    """Of a sorted set, the hashes of which an alike set must share one, as signed longs."""
    p, q = LIKENESS
    return hashes[: len(hashes) - -(-p * len(hashes) // q) + 1].view(np.int64).tolist()


def _sketched(docs: DataFrame, id_col: str, text_col: str, words_each: int) -> DataFrame:
    """(id, size, fp, fp2, bits, keys) of the documents with an id. size is the number of distinct shingles; few have keys, many have bits."""
    p, q = LIKENESS

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, fps, bits, keys = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                hashes = shingles(text.as_py(), words_each)
                sizes.append(len(hashes))
                fps.append(fingerprints(np.zeros(len(hashes), int), hashes, 1)[0])
                bits.append(simhash.key_bits(hashes) if len(hashes) >= SMALL else None)
                keys.append(first_keys(hashes) if p * len(hashes) < q * SMALL else [])
            columns = [pa.array(sizes, pa.int64()), *(pa.array([x[k] for x in fps], pa.int64()) for k in (0, 1)), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "size", "fp", "fp2", "bits", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).filter("id IS NOT NULL")
    return rows.mapInArrow(each, "id long, size long, fp long, fp2 long, bits binary, keys array<long>")


def _filed(docs: DataFrame, id_col: str, text_col: str, words_each: int, sketches: DataFrame | None = None) -> DataFrame:
    """(id, size, fp, fp2, keys) of the documents with an id that may have near copies, a row for each kind of key.

    Texts of equal bits meet in a file of their own, and one of them goes on to the comparison of fingerprints. ``sketches``: what
    ``_sketched`` gives, if it is written already.
    """
    scratch = Scratch(docs.sparkSession, "near_files")
    member = ["id", "size", "fp", "fp2"]
    if sketches is None:
        sketches = scratch.save(_sketched(docs, id_col, text_col, words_each))
    out = sketches.filter(F.size("keys") > 0).select(*member, "keys")
    large = sketches.filter("bits IS NOT NULL").select(*member, "bits", F.xxhash64("bits").alias("h"))
    n = large.count()
    same = ["size", "fp", "fp2", "h"]
    equal = scratch.save(large.groupBy(*same).agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    if equal.count():
        large = scratch.save(join_spread(large, equal, same, ["first"], F.col("n"), n, F.col("id")))
        out = out.union(large.filter("first IS NOT NULL").select(*member, F.array(F.xxhash64(*same)).alias("keys")))
        large = large.filter("first IS NULL OR first = id")
        n = large.count()
    files = simhash.close_files(large, n, RADIUS, LIKENESS, scratch)
    return out.union(files.select(*member, F.array("key").alias("keys")))


def near_links(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", words_each: int = WORDS) -> DataFrame:
    """Links (u, v) between ids whose components are those of all near copies."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    sketches = scratch.save(_sketched(docs, id_col, text_col, words_each))
    filed = scratch.save(_filed(docs, id_col, text_col, words_each, sketches)).select("id", "size", "fp", "fp2", F.explode("keys").alias("key"))
    return links(filed, texts, Likeness(lambda text: shingles(text, words_each), LIKENESS), scratch, sketches)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = WORDS) -> DataFrame:
    """The documents of ``docs`` with the smallest id of their component of near copies, with their own columns.

    Documents without an id can't name a component; they stay. Null and empty texts, and those of white space alone, are copies
    of one another; of rows that repeat an id all stay or all go. An empty table stays empty; columns may have any name.
    """
    scratch = Scratch(docs.sparkSession, "near_texts")
    roots = components(near_links(docs, scratch, id_col, text_col, words_each), scratch)
    gone = roots.filter("node <> root").select("node")
    return docs.join(gone, docs[id_col] == gone["node"], "left_anti")
