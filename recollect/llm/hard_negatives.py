"""Hard negatives of anchors by exact inner products, behind one-bit codes.

Vectors are whole numbers. They are rotated by sign flips and a Hadamard transform, which stays in whole numbers and
multiplies inner products by the padded length D. A vector keeps the signs of its rotated entries as its code b (+1, -1) and its
alignment with it, <z, b>. So z = (<z, b> / D) b + r, where r is at right angles to b and its length is known. An anchor's
rotated entries are cut to PLANES bits, so that their product t with a code is a sum of popcounts of bit planes. The product of
anchor and vector is then estimated as <z, b> t / D, and by Cauchy and Schwarz it lies no further from that than

    sqrt(|a|^2 - t^2 / D) |r|  +  |what was cut off the anchor| |z|.

That interval is certain, not likely. A vector is only passed over if its whole interval lies outside the scores asked for, or
below as many scores as are wanted; all others are scored in whole numbers.

Anchors are a stated query set against all rows, in blocks: blocks of anchors meet blocks of vectors, each pair one group of
bounded size, from which only the best few of each anchor leave. Of vectors that are equal with the same label only those with
the smallest identifiers can be among the best, so only as many as can be asked for go on; a vector that fills a third
of the table costs nothing after that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import Scratch
from recollect.llm.vectors import common_length, in_whole_numbers, is_whole

POSITIVES, NEGATIVES = 5, 3
#: Least and largest share of a positive's score that a hard negative has, in hundredths.
FROM, TO = 50, 95
#: Bits of an anchor's entries.
PLANES = 6
SEED = 42
#: Rows of a block of anchors and of vectors, and the fewest that make a block of vectors.
ANCHOR_BLOCK, VECTOR_BLOCK, LEAST_BLOCK = 1 << 14, 1 << 16, 1 << 11
#: Anchors and vectors compared at once.
_TILE_A, _TILE_V = 128, 4_096
#: Share of a tile from which it is scored as a whole.
_DENSE = 0.05
_EXACT = float(1 << 53)
_NONE = pa.table({c: pa.array([], pa.int64()) for c in ("anchor", "place", "score", "id", "other")})


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows after seeded sign flips and a Hadamard transform, padded to a power of two; whole numbers."""
    wide = 1 << max(0, (x.shape[1] - 1).bit_length())
    z = np.zeros((len(x), wide), np.int64)
    z[:, : x.shape[1]] = x
    z *= np.random.default_rng(SEED).choice(np.array([-1, 1]), wide)
    step = 1
    while step < wide:
        pairs = z.reshape(len(x), -1, 2, step)
        z = np.concatenate((pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]), axis=2).reshape(len(x), wide)
        step *= 2
    return z


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits of rows as 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    short = -packed.shape[-1] % 8
    if short:
        packed = np.concatenate((packed, np.zeros((*packed.shape[:-1], short), np.uint8)), axis=-1)
    return np.ascontiguousarray(packed).view("<u8")


def codes_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code as words, alignment) of each row."""
    z = rotated(x)
    return _words(z >= 0), np.abs(z).sum(1)


class _Anchors:
    """Anchors cut to bit planes, ready to meet codes."""

    def __init__(self, x: np.ndarray) -> None:
        z = rotated(x)
        self.wide = z.shape[1]
        low = z.min(1)
        shift = np.array([max(0, int(r).bit_length() - PLANES) for r in z.max(1) - low], np.int64)
        w = (z - low[:, None]) >> shift[:, None]
        middle = low + ((1 << shift) >> 1)
        cut = (w << shift[:, None]) + middle[:, None]
        self.unit, self.middle, self.total = (1 << shift).astype(float), middle.astype(float), w.sum(1).astype(float)
        self.planes = [_words((w >> k & 1).astype(np.uint8)) for k in range(PLANES)]
        self.square = (cut.astype(float) ** 2).sum(1)
        self.lost = np.sqrt(((z - cut).astype(float) ** 2).sum(1))

    def between(self, some: slice, v: _Vectors, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest inner product that each anchor of ``some`` and each vector of ``part`` can have."""
        codes = v.codes[part]
        ones = np.zeros((some.stop - some.start, len(codes)), np.int32)
        for k, plane in enumerate(self.planes):
            for j in range(codes.shape[1]):
                ones += np.bitwise_count(plane[some, j, None] & codes[None, :, j]).astype(np.int32) << k
        t = self.unit[some, None] * (2.0 * ones - self.total[some, None]) + self.middle[some, None] * v.balance[None, part]
        half = np.sqrt(np.maximum(self.square[some, None] - t * t / self.wide, 0.0)) * v.rest[None, part] + self.lost[some, None] * v.length[None, part]
        half = half / self.wide
        middle = t * (v.align[None, part] / (self.wide * self.wide))
        half += 1e-9 * (np.abs(middle) + half) + 1e-3  # more than the rounding of all of this
        return middle - half, middle + half


class _Vectors:
    """A block of vectors: what of it the intervals need, and the vectors themselves."""

    def __init__(self, t: pa.Table, dims: int) -> None:
        order = np.argsort(t.column("label").to_numpy(), kind="stable")
        self.label, self.id, self.row = (t.column(c).to_numpy()[order] for c in ("label", "id", "row"))
        self.x = _rows(t.column("x"), "<i4", dims)[order].astype(np.int64)
        self.codes = _rows(t.column("code"), "<u8", -1)[order]
        self.align = t.column("align").to_numpy()[order].astype(float)
        wide = 1 << max(0, (dims - 1).bit_length())
        square = wide * (self.x.astype(float) ** 2).sum(1)
        self.length = np.sqrt(square)
        self.rest = np.sqrt(np.maximum(square - self.align**2 / wide, 0.0)) * (1 + 1e-9) + 1e-3
        self.balance = 2.0 * np.bitwise_count(self.codes).sum(1) - wide
        self.most = float(np.abs(self.x).max(initial=0))


def _rows(binaries: pa.ChunkedArray, kind: str, dims: int) -> np.ndarray:
    data = b"".join(x.as_py() for x in binaries)
    return np.frombuffer(data, kind).reshape(len(binaries), dims if dims >= 0 else -1)


def scores_of(a: np.ndarray, x: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, vector, exact inner product) where ``alive``."""
    i, j = np.nonzero(alive)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    if len(i) > _DENSE * alive.size and most < _EXACT:  # sums of whole numbers under 2**53 are exact in doubles too
        return i, j, (a.astype(float) @ x.astype(float).T)[i, j].astype(np.int64)
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 14):
        out[k : k + (1 << 14)] = np.einsum("ij,ij->i", a[i[k : k + (1 << 14)]], x[j[k : k + (1 << 14)]])
    return i, j, out


class _Best:
    """The first k by falling score, then id, then row, for each of n anchors."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.floor = k, np.full(n, -np.inf)
        self.held = tuple(np.zeros(0, np.int64) for _ in range(4))  # anchor, score, id, row

    def add(self, anchor: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        if not len(anchor):
            return
        both = [np.concatenate(x) for x in zip(self.held, (anchor, score, id_, row), strict=True)]
        order = np.lexsort((both[3], both[2], -both[1], both[0]))
        both = [x[order] for x in both]
        starts = np.flatnonzero(np.r_[True, both[0][1:] != both[0][:-1]])
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        self.held = tuple(x[place < self.k] for x in both)
        last = place == self.k - 1
        self.floor[both[0][last]] = np.nextafter(both[1][last].astype(float), -np.inf)  # scores may have more digits than a double


def _tiles(n: int, size: int, first: int = 0) -> Iterator[slice]:
    for i in range(first, n, size):
        yield slice(i, min(n, i + size))


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, as far as there are as many."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k]


def _positives_of_unit(anchors: pa.Table, vectors: pa.Table, dims: int, k: int) -> pa.Table:
    if not anchors.num_rows or not vectors.num_rows:
        return _NONE.select(["anchor", "score", "id", "other"])
    anchors = anchors.take(np.argsort(anchors.column("label").to_numpy(), kind="stable"))
    v, xa = _Vectors(vectors, dims), _rows(anchors.column("x"), "<i4", dims).astype(np.int64)
    label, row = anchors.column("label").to_numpy(), anchors.column("row").to_numpy()
    best, q = _Best(len(xa), k), _Anchors(xa)
    for a_label in np.unique(label):  # both sides are sorted by label
        lo, hi = np.searchsorted(label, (a_label, a_label + 1))
        first, last = np.searchsorted(v.label, (a_label, a_label + 1))
        for some in _tiles(hi, _TILE_A, lo):
            for part in _tiles(last, _TILE_V, first):
                low, high = q.between(some, v, part)
                own = row[some, None] == v.row[None, part]
                floor = np.maximum(best.floor[some], _kth(np.where(own, -np.inf, low), k))
                i, j, s = scores_of(xa[some], v.x[part], (high >= floor[:, None]) & ~own)
                best.add(i + some.start, s, v.id[part][j], v.row[part][j])
    a, s, id_, other = best.held
    return pa.table({"anchor": row[a], "score": s, "id": id_, "other": other})


def _window(positive: np.ndarray, share_from: int, share_to: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest whole score between the two shares, in hundredths, of a positive's score; none where it is negative."""
    part = lambda share: positive // 100 * share + positive % 100 * share // 100  # noqa: E731  floor, without overflow
    return -(-positive // 100 * share_from + -positive % 100 * share_from // 100), part(share_to)


def _negatives_of_unit(anchors: pa.Table, vectors: pa.Table, dims: int, k: int, share_from: int, share_to: int) -> pa.Table:
    """anchors has for each anchor and place of a positive one row: row, label, x, place, positive_score."""
    if not anchors.num_rows or not vectors.num_rows:
        return _NONE
    order = np.lexsort((anchors.column("place").to_numpy(), anchors.column("row").to_numpy()))
    anchors = anchors.take(order)
    v = _Vectors(vectors, dims)
    row, place = anchors.column("row").to_numpy(), anchors.column("place").to_numpy()
    firsts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    one = anchors.take(firsts)
    xa, label = _rows(one.column("x"), "<i4", dims).astype(np.int64), one.column("label").to_numpy()
    lo, hi = _window(anchors.column("positive_score").to_numpy(), share_from, share_to)
    pairs = np.diff(np.r_[firsts, len(row)])
    best, q = _Best(len(row), k), _Anchors(xa)
    for some in _tiles(len(xa), _TILE_A):
        own = slice(firsts[some.start], firsts[some.stop - 1] + pairs[some.stop - 1])  # rows of these anchors' positives
        starts = firsts[some] - firsts[some.start]
        most = np.maximum.reduceat(np.where(lo[own] <= hi[own], hi[own], np.iinfo(np.int64).min), starts)
        for part in _tiles(len(v.id), _TILE_V):
            need = np.minimum.reduceat(np.where(lo[own] <= hi[own], np.maximum(lo[own], best.floor[own]), np.inf), starts)
            low, high = q.between(some, v, part)
            alive = (high >= need[:, None]) & (low <= most[:, None]) & (label[some, None] != v.label[None, part])
            i, j, s = scores_of(xa[some], v.x[part], alive)
            # each score goes to those of its anchor's positives in whose window it lies
            n = pairs[some][i]
            at = np.repeat(firsts[some][i], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            s, j = np.repeat(s, n), np.repeat(j, n)
            fit = (lo[at] <= s) & (s <= hi[at]) & (s >= best.floor[at])
            best.add(at[fit], s[fit], v.id[part][j[fit]], v.row[part][j[fit]])
    a, s, id_, other = best.held
    return pa.table({"anchor": row[a], "place": place[a], "score": s, "id": id_, "other": other})


def _coded(rows: DataFrame, dims: int) -> DataFrame:
    """(row, id, label, x, code, align) of rows (row, id, label, x as an array)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _tiles(batch.num_rows, 1 << 14):
                own = batch.slice(part.start, part.stop - part.start)
                x = own.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                codes, align = codes_of(x)
                columns = [pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(align)]
                yield pa.RecordBatch.from_arrays([own.column(c) for c in ("row", "id", "label")] + columns, ["row", "id", "label", "x", "code", "align"])

    return rows.select("row", "id", "label", "x").mapInArrow(each, "row long, id long, label long, x binary, code binary, align long")


def _grid(anchors: DataFrame, vectors: DataFrame, n_anchors: int, n_vectors: int, unit, schema: str) -> DataFrame:
    """``unit`` of every block of anchors with every block of vectors."""
    spare = 3 * vectors.sparkSession.sparkContext.defaultParallelism
    across = max(1, math.ceil(n_anchors / ANCHOR_BLOCK))
    down = max(1, math.ceil(n_vectors / min(VECTOR_BLOCK, max(LEAST_BLOCK, math.ceil(n_vectors / spare)))))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    units = min(across * down, 20_000)
    a = anchors.withColumn("i", block(across)).withColumn("j", all_of(down)).repartition(units, "i", "j")
    v = vectors.withColumn("i", all_of(across)).withColumn("j", block(down)).repartition(units, "i", "j")
    return a.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInArrow(unit, schema)


def _first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "other")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    share_from: int = FROM,
    share_to: int = TO,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows of ``vectors`` where ``is_anchor``.

    A vector is taken as floor(256 * component). Rows take no part whose label, id or vector is null, whose vector has null or
    non-finite entries, or has another length than most. An anchor's positives are its ``positives`` best other rows of the
    same label; its negatives for a positive are the ``negatives`` best rows of another label whose score is from ``share_from`` to
    ``share_to`` hundredths of the positive's (none for a negative score). Higher inner products come first, ties by smaller id;
    rows that repeat an id are rows of their own, each an anchor if its id is one, in the order of the table. Anchors without
    positives or negatives give no rows, as does an empty table. Other columns don't matter.
    """
    scratch = Scratch(vectors.sparkSession, "hard_negatives")
    named = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), is_anchor.alias("is_anchor")
    ).filter("id IS NOT NULL AND label IS NOT NULL")
    dims = common_length(named.filter(is_whole("v")), "v")
    whole = in_whole_numbers(named, "v", dims).withColumn("x", F.transform("x", lambda c: F.least(F.greatest(c, F.lit(1 - (1 << 31))), F.lit((1 << 31) - 1))))
    rows = scratch.save(whole.select("id", "label", "x", F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"), F.monotonically_increasing_id().alias("row")))
    if not dims or rows.isEmpty():
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = scratch.save(_coded(rows.filter("is_anchor"), dims).drop("code", "align"))
    same = Window.partitionBy("label", "x").orderBy("id", "row")
    fewer = rows.withColumn("k", F.row_number().over(same)).filter(F.col("k") <= max(positives + 1, negatives))  # each task keeps as few before rows are moved
    pool = scratch.save(_coded(fewer, dims))
    n_anchors, n_pool = anchors.count(), pool.count()

    at = _grid(
        anchors.select("row", "label", "x"), pool, n_anchors, n_pool,
        lambda a, v: _positives_of_unit(a, v, dims, positives), "anchor long, score long, id long, other long",
    )
    near = scratch.save(_first(at, ["anchor"], positives).select(F.col("anchor").alias("row"), F.col("rank").alias("place"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")))
    asked = scratch.save(near.join(anchors.select("row", F.col("id").alias("anchor_id"), "label", "x"), "row"))
    at = _grid(
        asked.select("row", "label", "x", F.col("place").cast("long").alias("place"), "positive_score"), pool, n_anchors * positives, n_pool,
        lambda a, v: _negatives_of_unit(a, v, dims, negatives, share_from, share_to), "anchor long, place long, score long, id long, other long",
    )
    found = _first(at, ["anchor", "place"], negatives).select(F.col("anchor").alias("row"), F.col("place").cast("int").alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return asked.drop("label", "x").join(found, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
