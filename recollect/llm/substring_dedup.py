"""Repeated passages, found by sampling and removed with sharded Aho-Corasick automata.

A window is ``span`` consecutive words. A word goes if a window that covers it has a twin: the same words starting
anywhere else, in the same document too. Counting every window would shuffle the corpus many times over, so windows are
represented by *anchors*: the ``gram``-word phrase with the smallest hash in the window. Twins have the same anchor at the
same place, and neighbouring windows mostly share theirs, so there is one anchor for some 15 windows.

Confirming. Each stretch of windows with one anchor is summarised as (anchor, digest of all its windows). A stretch seen
twice has only twins. Anchors seen twice with differing stretches (where a copied passage begins, ends or was edited) have
their distinct stretches looked at window by window. All other windows are unique, without ever being shuffled.

Locating. Rows are numbered and dealt to shards by number, and every shard gets one example of each confirmed passage that
occurs in it. It compiles its passages' anchor phrases into one Aho-Corasick automaton, streams its documents through, and
at each hit looks the words around it up among the passages, whole. A shard's automaton is thus never larger than the
shard, however large the corpus is, and a passage shared by a third of all documents is one pattern a shard.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.common import Scratch, join_spread

SPAN = 35
GRAM = 6
#: UTF-8 bytes of text in a shard, on average.
SHARD_BYTES = 3_000_000
#: Words hashed at once.
_WORDS = 1 << 18
_PLACE_BITS = 22
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


_hashes = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[k]
    return x ^ (x >> np.uint64(29))


def rolled(h: np.ndarray, width: int, k: int = 0) -> np.ndarray:
    """A hash of each ``width`` consecutive elements, by doubling: 2 * log2(width) passes over the array."""
    n = len(h) - width + 1
    out, done, power, unit, step = None, 0, h, 1, _MULT[k]
    while True:
        if width & unit:
            if out is None:
                out = power[: len(power)]
            else:
                # what is done covers the first `done` elements, this power the next `unit`
                m = min(len(out), len(power) - done)
                out = _mixed(out[:m] * _MULT[k] + power[done : done + m], k)
            done += unit
        if done == width:
            return out[:n]
        m = len(power) - unit
        if m <= 0:
            return np.zeros(0, np.uint64)
        power = _mixed(power[:m] * step + power[unit : unit + m], k)
        unit *= 2
        step = np.uint64(int(step) * int(_MULT[k]) % (1 << 64) | 1)


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive elements."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def stretches(h: np.ndarray, doc: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of concatenated documents: (anchor, digest, first window, number of windows, place of the anchor) by stretch."""
    if len(h) < span:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = rolled(h, gram)
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    at = (least((grams & ~low) | place, span - gram + 1) & low).astype(np.int64)
    inside = doc[: len(at)] == doc[span - 1 :]
    new = np.r_[True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]) | (doc[1 : len(at)] != doc[: len(at) - 1])]
    starts = np.flatnonzero(new)
    counts = np.diff(np.r_[starts, len(at)])
    good = inside[starts]
    starts, counts = starts[good], counts[good]
    anchor = at[starts]
    # a digest of all words that the stretch covers, and of where its anchor stands
    sums = np.r_[np.uint64(0), np.cumsum(_mixed(rolled(h, span), 1) * _MULT[1])]
    digest = _mixed((sums[starts + counts] - sums[starts]) ^ rolled(h, span)[starts] + (anchor - starts).astype(np.uint64) * _MULT[0], 0)
    return grams[anchor], digest, starts, counts, anchor


def _chunks(ids: list, texts: pa.Array, span: int) -> Iterator[tuple[list, list[bytes], np.ndarray, np.ndarray]]:
    """Documents in groups of some _WORDS words: (rows, words, document of each word, word number where it begins).

    A text of more than 2**22 words goes in pieces that overlap by span - 1 words, so each window lies in one piece.
    """
    rows, words, lengths, begins = [], [], [], []
    held = 0
    for row, text in zip(ids, texts, strict=True):
        mine = (text.as_py() or b"").split()
        if len(mine) < span:
            continue
        step = (1 << (_PLACE_BITS - 1)) - span
        for begin in range(0, len(mine) - span + 1, step):
            part = mine[begin : begin + step + span - 1]
            rows.append(row)
            words += part
            lengths.append(len(part))
            begins.append(begin)
            held += len(part)
            if held >= _WORDS:
                yield rows, words, np.repeat(np.arange(len(rows)), lengths), np.array(begins)
                rows, words, lengths, begins, held = [], [], [], [], 0
    if rows:
        yield rows, words, np.repeat(np.arange(len(rows)), lengths), np.array(begins)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _anchors(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rids = batch.column(0).to_pylist()
        for rows, words, doc, begins in _chunks(rids, batch.column(1), span):
            anchor, digest, first, count, place = stretches(word_hashes(words), doc, span, gram)
            owner = doc[first]
            base = np.searchsorted(doc, np.arange(len(rows)))[owner]
            start = first - base + begins[owner]
            packed = (start << 12) | (count << 6) | (place - first)
            yield pa.RecordBatch.from_arrays(
                [_signed(anchor), _signed(digest), pa.array(np.array(rows, np.int64)[owner]), pa.array(packed)], ["anchor", "digest", "rid", "at"]
            )


def _windows(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Window hashes of the stretches listed with each text: rows (rid, text, list of (at, n))."""
    for batch in batches:
        out: list[tuple[np.ndarray, ...]] = []
        for rid, text, listed in zip(*(batch.column(i) for i in range(3)), strict=True):
            h = word_hashes(text.as_py().split())
            one, two = rolled(h, span, 0), rolled(h, span, 1)
            ats = np.array([x["at"] for x in listed.as_py()])
            n = np.array([x["n"] for x in listed.as_py()])
            count = (ats >> 6) & 63
            pos = np.repeat(ats >> 12, count) + np.concatenate([np.arange(c) for c in count])
            place = np.repeat((ats >> 12) + (ats & 63), count)
            out.append((one[pos], two[pos], np.full(len(pos), rid.as_py()), pos, place, np.repeat(n, count)))
        if out:
            a, b, rid, pos, place, n = map(np.concatenate, zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([_signed(a), _signed(b), *map(pa.array, (rid, pos, place, n))], ["w1", "w2", "rid", "pos", "place", "n"])


def _runs(mask: int) -> Iterator[tuple[int, int]]:
    """The runs of set bits, as (first, last)."""
    bit = 0
    while mask >> bit:
        if mask >> bit & 1:
            first = bit
            while mask >> (bit + 1) & 1:
                bit += 1
            yield first, bit
        bit += 1


def _strip(docs: pa.Table, passages: pa.Table, span: int, gram: int, text_col: str) -> pa.Table:
    """One shard: locate every occurrence of its passages and cut the words they cover."""
    import ahocorasick

    texts = docs.column(text_col).cast(pa.binary()).to_pylist()
    at_row = {r: i for i, r in enumerate(docs.column("__rid").to_pylist())}
    joined = [b" ".join((t or b"").split()).decode() for t in texts]
    # of each anchor phrase: (words before it, words in all) -> the passages of that shape
    wanted: dict[str, dict[tuple[int, int], set[str]]] = defaultdict(lambda: defaultdict(set))
    by_row: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for rid, place, mask in zip(*(passages.column(c).to_pylist() for c in ("rid", "place", "mask")), strict=True):
        by_row[at_row[rid]].append((place, mask))
    for row, listed in by_row.items():
        words = joined[row].split(" ")
        for place, mask in listed:
            phrase = f" {' '.join(words[place : place + gram])} "
            for nearest, farthest in _runs(mask):
                start, end = place - farthest, place - nearest + span
                wanted[phrase][farthest, end - start].add(" ".join(words[start:end]))
    automaton = ahocorasick.Automaton()
    for phrase, shapes in wanted.items():
        automaton.add_word(phrase, (len(phrase), list(shapes.items())))
    if wanted:
        automaton.make_automaton()
    n_words, n_removed, kept = [], [], []
    for text in joined:
        shown, spaces = f" {text} ", None
        covered: list[tuple[int, int]] = []  # from word to word
        for end, (size, shapes) in automaton.iter(shown) if wanted else ():
            if spaces is None:
                spaces = [m.start() for m in re.finditer(" ", shown)]
            hit = bisect_left(spaces, end - size + 1)
            # a look-up for each shape, of which there are at most span * span, however many passages have the phrase
            for (before, n), known in shapes:
                first = hit - before
                if first >= 0 and first + n < len(spaces) and shown[spaces[first] + 1 : spaces[first + n]] in known:
                    covered.append((first, first + n))
        total = text.count(" ") + 1 if text else 0
        gone, at, left = 0, 0, []
        for a, b in sorted(covered):
            if a > at:
                left.append(shown[spaces[at] + 1 : spaces[a]])
            gone += max(0, b - max(a, at))
            at = max(at, b)
        if covered and at < total:
            left.append(shown[spaces[at] + 1 : spaces[total]])
        kept.append(" ".join(left) if covered else text)
        n_words.append(total)
        n_removed.append(gone)
    out = docs.drop_columns(["__rid", "__shard"])
    for name, values, kind in (("n_words", n_words, pa.int64()), ("n_removed", n_removed, pa.int64()), ("kept_text", kept, pa.string())):
        out = out.append_column(f"__{name}", pa.array(values, kind))
    return out


def strip_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """The rows of ``docs`` with __n_words, __n_removed and __kept_text (kept words joined by one space).

    Words are what ASCII white space separates, unchanged. A null text has no words, a text shorter than ``span`` words
    loses none. Rows that repeat id and text are twins of each other and lose what they share. An empty table gives an
    empty result; other columns are carried along. Names that begin with two underscores are this operator's own.
    """
    if not 2 <= gram <= span <= 64:
        raise ValueError("needs 2 <= gram <= span <= 64")
    scratch = Scratch(docs.sparkSession, "repeats")
    # rows are numbered, and the numbers written, so that they are the same wherever they are read again
    numbered = scratch.save(docs.withColumn("__rid", F.monotonically_increasing_id()))
    text = F.col(text_col).cast("string")
    plain = numbered.select(F.col("__rid").alias("rid"), F.coalesce(text.cast("binary"), F.lit(b"")).alias("t"))
    seen = scratch.save(plain.mapInArrow(lambda it: _anchors(it, span, gram), "anchor long, digest long, rid long, at long"))
    total = seen.count()
    # confirm: which anchors come again, and with which stretches
    twice = scratch.save(seen.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").withColumn("again", F.lit(True)))
    rows = scratch.save(join_spread(seen, twice, ["anchor"], ["again"], F.col("n"), total, F.col("rid")).filter("again").drop("again"))
    scratch.drop(seen, twice)
    kinds = scratch.save(rows.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("one")))
    sure = kinds.filter("n > 1").select("anchor", "digest", "n", F.lit(True).alias("sure"))
    several = scratch.save(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").withColumn("mixed", F.lit(True)))
    mixed = join_spread(kinds, several, ["anchor"], ["mixed"], F.col("kinds"), kinds.count(), F.col("digest")).filter("mixed")
    listed = mixed.groupBy(F.col("one.rid").alias("rid")).agg(
        F.collect_list(F.struct(F.col("one.at").alias("at"), "n")).alias("listed")  # at most one a stretch of one text
    )
    windows = scratch.save(
        plain.join(listed, "rid").select("rid", "t", "listed").mapInArrow(lambda it: _windows(it, span), "w1 long, w2 long, rid long, pos long, place long, n long")
    )
    met = windows.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).filter("n > 1 AND rows > 1")
    met = scratch.save(met.select("w1", "w2", "rows", F.lit(True).alias("met")))
    single = join_spread(windows, met, ["w1", "w2"], ["met"], F.col("rows"), windows.count(), F.col("rid")).filter("met AND n = 1")
    single = single.groupBy("rid", "place").agg(F.expr("bit_or(shiftleft(1L, int(place - pos)))").alias("mask"))
    known = join_spread(rows, sure, ["anchor", "digest"], ["sure"], F.col("n"), total, F.col("rid")).filter("sure")
    size = plain.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, round(size / shard_bytes))
    shard = F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("long").alias("shard")
    # of each stretch one example a shard is enough; bit o of its mask is the window that begins o words before the anchor
    known = known.groupBy("anchor", "digest", shard).agg(F.min(F.struct("rid", "at")).alias("one")).selectExpr(
        "shard", "one.rid", "shiftright(one.at, 12) + one.at % 64 AS place",
        "shiftleft(shiftleft(1L, int(shiftright(one.at, 6) % 64)) - 1, int(one.at % 64 - shiftright(one.at, 6) % 64 + 1)) AS mask",
    )
    passages = scratch.save(known.unionByName(single.select(shard, "rid", "place", "mask")))
    scratch.drop(rows, kinds, several, windows, met)
    dealt = numbered.withColumn("__shard", F.pmod(F.xxhash64("__rid"), F.lit(shards)).cast("long"))
    out = T.StructType([f for f in docs.schema] + [T.StructField("__n_words", T.LongType()), T.StructField("__n_removed", T.LongType()), T.StructField("__kept_text", T.StringType())])
    return dealt.groupBy("__shard").cogroup(passages.groupBy("shard")).applyInArrow(lambda d, p: _strip(d, p, span, gram, text_col), out)


def strip_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``strip_repeats`` does, in numbers: id, n_words, n_removed, kept_sha256."""
    out = strip_repeats(docs.select(id_col, text_col), id_col, text_col)
    return out.select(
        id_col, F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2("__kept_text", 256).alias("kept_sha256")
    )


def brute_force(texts: list[bytes | None], span: int = SPAN) -> list[tuple[int, int, str]]:
    """The contract read literally, for tests."""
    words = [(t or b"").split() for t in texts]
    seen: dict[tuple, int] = defaultdict(int)
    for w in words:
        for i in range(len(w) - span + 1):
            seen[tuple(w[i : i + span])] += 1
    out = []
    for w in words:
        gone: set[int] = set()
        for i in range(len(w) - span + 1):
            if seen[tuple(w[i : i + span])] > 1:
                gone.update(range(i, i + span))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
