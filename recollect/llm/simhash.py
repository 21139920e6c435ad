"""SimHash near-duplicates, compared bit-sliced.

Fingerprints that differ in at most ``radius`` bits agree on some of any ``blocks`` equal parts of the 64 bits, so
each fingerprint is filed once under every choice of ``blocks - radius`` parts and only fingerprints filed together
are compared. More fingerprints need longer keys; ``layout`` picks them so that a file stays short, and every choice
finds every link. Files that are long all the same (thousands of near copies of one text) are cut into blocks and the
pairs of blocks dealt over the cluster.

A comparison is bit-sliced: the fingerprints of a task are stored as 64 vertical bit planes. Shifting the planes by d
lines up every fingerprint with the d-th one after it, so one word operation advances 64 distances. Carry-save planes count
the differing bits up to the radius and one more remembers overflow; words in which all pairs have overflowed are
abandoned.

Wide radii (near copies, see near_texts) leave no part of a fingerprint equal, so there the keys are more bits of the same
kind: ``KEY_BITS`` further SimHash bits a text, ``width`` of them a key, and as many keys as ``tables_for`` finds necessary.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import Scratch, join_spread
from recollect.llm.components import components, local_roots

SEED = 42
BITS = 64
#: Shingles whose bits are counted at once.
_STEP = 1 << 16
#: Fingerprints in a block of a long file.
BLOCK = 2_048
#: Fingerprints compared in one pass of the planes.
_PASS = 1 << 16
#: Links held by a task before they are contracted.
_LINKS = 1 << 19

#: Bits of a text that make the keys of a wide radius.
KEY_BITS = 2_048
#: Chance at most that a bit differs between sets of 16 or more elements of Jaccard 0.8 (22 and 23 with 20 in common: 0.1582).
DIFFER = 0.159
#: Chance at most that such a pair has no key in common.
MISS = 1e-8
#: Texts up to which all meet in one file, and how many share a key by chance above that.
TOGETHER, FILE = 2_048, 64
#: Keys by which texts are dealt at once.
ROUND = 64
#: Texts of one key above which its file is cut into block pairs, and those of a block.
HOT, HOT_BLOCK = 8_192, 4_096
#: Texts of a file from which 64 of them are set against all at once.
DENSE = 256
#: Rows of files whose fingerprints are compared in one pass.
_FILED = 1 << 18

_RANDOM = np.random.default_rng(SEED)
_XOR = _RANDOM.integers(0, 1 << 64, KEY_BITS // 64, np.uint64, endpoint=False)
_TIMES = _RANDOM.integers(0, 1 << 64, KEY_BITS // 64, np.uint64, endpoint=False) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprints_of(texts: list[bytes | None], words_each: int = 3) -> np.ndarray:
    """Fingerprints as uint64. texts: UTF-8; white space is that of ``bytes.split``, case that of A-Z."""
    hashes, ends, total = [], [], 0
    out = np.zeros(len(texts), np.uint64)

    def settle(upto: int) -> None:
        if not hashes:
            return
        flat = np.concatenate(hashes)
        first = len(out_at) - len(ends)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        over = 2 * counts > np.diff(np.concatenate((starts, [len(flat)])))[:, None]
        out[out_at[first:]] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()

    out_at: list[int] = []
    for at, text in enumerate(texts):
        words = (text or b"").lower().split()
        if not words:
            continue
        if len(words) < words_each:
            h = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        else:
            grams = map(b" ".join, zip(*(words[i:] for i in range(words_each)), strict=False))
            h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - words_each + 1)
        if len(h) > _STEP:  # a very long text: count it by itself, a step at a time
            counts = np.zeros(BITS, np.int64)
            for i in range(0, len(h), _STEP):
                part = h[i : i + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
                counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[at] = np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0]
            continue
        out_at.append(at)
        hashes.append(h)
        total += len(h)
        ends.append(total)
        if total >= _STEP:
            settle(at)
            hashes, ends, total = [], [], 0
    settle(len(texts))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3) -> DataFrame:
    """(id, fp): fp is the 64-bit fingerprint as a signed long. A null text counts as empty; no words give 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fingerprints_of(batch.column(1).cast(pa.binary()).to_pylist(), words_each)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(each, "id long, fp long")


def layout(n: int, radius: int) -> list[list[int]]:
    """The bit positions of each key. Keys have about log2(n) bits, so that chance agreement is rare at any n."""
    for blocks in range(radius + 1, radius + 6):
        width = BITS * (blocks - radius) // blocks
        if n <= 1 << (width + 6):
            break
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [list(range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [[b for p in chosen for b in parts[p]] for chosen in combinations(range(blocks), blocks - radius)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit b of fingerprint i is bit i % 64 of word [b, i // 64]; one spare word at the end of each plane.

    A fingerprint is a number of 64 bits or a row of several.
    """
    words = (len(fps) + 63) // 64
    each = 8 * fps[:1].size if len(fps) else 8
    bits = np.unpackbits(np.ascontiguousarray(fps.astype("<u8")).view(np.uint8).reshape(-1, each), axis=1, bitorder="little")
    packed = np.zeros((8 * each, (words + 1) * 8), np.uint8)
    rows = np.packbits(bits.T, axis=1, bitorder="little")
    packed[:, : rows.shape[1]] = rows
    return packed.view("<u8")


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int, first_bits: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one group (groups are contiguous) that differ in at most ``radius`` bits.

    first_bits: the planes in the order to count them; those of the key agree anyway and come last. Counters start so
    that they overflow at radius + 1.
    """
    n = len(fps)
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    left = np.repeat(edges[1:], np.diff(edges)) - np.arange(n) - 1
    planes = planes_of(fps)
    last = planes.shape[1] - 1
    places = max(1, radius.bit_length())
    start = (1 << places) - 1 - radius
    order = np.argsort(-left, kind="stable")
    for d in range(1, int(left.max(initial=0)) + 1):
        lanes = np.zeros((last + 1) * 64, np.uint8)
        order = order[: np.searchsorted(-left[order], -d, side="right")]
        lanes[order] = 1
        valid = np.packbits(lanes, bitorder="little").view("<u8")
        at = np.flatnonzero(valid)
        skip, by = divmod(d, 64)
        by_ = np.uint64(by)
        count = [np.full(len(at), 0xFFFFFFFFFFFFFFFF if start >> p & 1 else 0, np.uint64) for p in range(places)]
        over = np.zeros(len(at), np.uint64)
        for k, b in enumerate(first_bits):
            row = planes[b]
            lo = row[np.minimum(at + skip, last)]
            if by:
                lo = (lo >> by_) | (row[np.minimum(at + skip + 1, last)] << np.uint64(64 - by))
            carry = row[at] ^ lo
            for p in range(places):
                count[p], carry = count[p] ^ carry, count[p] & carry
            over = over | carry
            if k % 8 == 7:
                alive = (valid[at] & ~over) != 0
                if not alive.all():
                    at, over = at[alive], over[alive]
                    count = [c[alive] for c in count]
                    if not len(at):
                        break
        if not len(at):
            continue
        hits = valid[at] & ~over
        some = hits != 0
        if some.any():
            bits = np.unpackbits(hits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, lane = np.nonzero(bits)
            i = at[some][word] * 64 + lane
            yield i, i + d


def _links(batches: Iterator[pa.RecordBatch], radius: int, keys: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows (t, unit, fp), as stars: every fingerprint to the smallest one that its group joins it to."""

    def run(t: np.ndarray, unit: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for table in np.unique(t):
            mine = t == table
            key = set(keys[table])
            fps = fp[mine]
            planes = [b for b in range(BITS) if b not in key] + sorted(key)
            a, b, held = [], [], 0
            for i, j in close_pairs(fps.view(np.uint64), unit[mine], radius, planes):
                a.append(i)
                b.append(j)
                held += len(i)
                if held > _LINKS:
                    root = local_roots(len(fps), np.concatenate(a), np.concatenate(b))
                    moved = np.flatnonzero(root != np.arange(len(fps)))
                    a, b, held = [moved], [root[moved]], 0
            if a:
                root = local_roots(len(fps), np.concatenate(a), np.concatenate(b))
                moved = np.flatnonzero(root != np.arange(len(fps)))
                yield pa.RecordBatch.from_arrays([pa.array(fps[moved]), pa.array(fps[root[moved]])], ["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        if sum(len(x[0]) for x in held) >= _PASS:
            t, unit, fp = map(np.concatenate, zip(*held, strict=True))
            change = np.flatnonzero((t[1:] != t[:-1]) | (unit[1:] != unit[:-1]))
            cut = int(change[-1]) + 1 if len(change) else 0  # the last group may go on in the next batch
            if cut:
                yield from run(t[:cut], unit[:cut], fp[:cut])
            held = [(t[cut:], unit[cut:], fp[cut:])]
    if held:
        yield from run(*map(np.concatenate, zip(*held, strict=True)))


def near_links(distinct: DataFrame, n: int, radius: int, scratch: Scratch, block: int = BLOCK, keys: list[list[int]] | None = None) -> DataFrame:
    """Links (u, v) between the fingerprints ``distinct`` (fp) whose components are those of all links within radius."""
    keys = keys or layout(n, radius)
    filed = distinct.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_mask(k))).alias("key")) for t, k in enumerate(keys)])).alias("f")
    ).select("f.t", "f.key", "fp")
    sizes = filed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    filed = filed.join(sizes, ["t", "key"])  # a file with one fingerprint has no pairs
    cuts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), cuts).cast("int")
    units = filed.withColumn("cuts", cuts).withColumn("own", own).select(
        "t", "key", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))).alias("b")
    )
    units = units.select("t", F.xxhash64("t", "key", "b.i", "b.j").alias("unit"), "fp")
    dealt = units.repartition("t", "unit").sortWithinPartitions("t", "unit", "fp")
    return scratch.save(dealt.mapInArrow(lambda it: _links(it, radius, keys), "u long, v long"))


def key_bits(hashes: np.ndarray) -> bytes:
    """The KEY_BITS SimHash bits of a set of well mixed 64-bit hashes."""
    over = np.zeros(KEY_BITS, np.int64)
    for i in range(0, len(hashes), 128):  # counts of 128 fit a byte
        x = (hashes[i : i + 128, None] ^ _XOR) * _TIMES
        x = (x ^ (x >> np.uint64(29))) * _MIX
        x ^= x >> np.uint64(32)
        over += np.add.reduce(np.unpackbits(x.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * over > len(hashes), bitorder="little").tobytes()


@cache
def tables_for(width: int, miss: float = MISS) -> int:
    """How many keys of ``width`` of the KEY_BITS bits leave a pair, whose bits differ with chance DIFFER, apart with chance ``miss``."""
    if not width:
        return 1
    d = np.arange(KEY_BITS - width + 1)
    ways = np.array([math.lgamma(KEY_BITS + 1) - math.lgamma(x + 1) - math.lgamma(KEY_BITS - x + 1) for x in d])
    chance = np.exp(ways + d * math.log(DIFFER) + (KEY_BITS - d) * math.log1p(-DIFFER))
    agree = np.exp(sum(np.log((KEY_BITS - d - i) / (KEY_BITS - i)) for i in range(width)))
    apart = lambda n: float((chance * np.exp(n * np.log1p(-np.minimum(agree, 1 - 1e-12)))).sum())
    high = 1
    while apart(high) > miss:
        high *= 2
    low = high // 2
    while high - low > 1:
        half = (low + high) // 2
        low, high = (low, half) if apart(half) <= miss else (half, high)
    return high


def wide_layout(n: int) -> list[np.ndarray]:
    """The positions of each key among the KEY_BITS bits: longer keys for more texts, so that about FILE of them share one by chance."""
    width = 0 if n <= TOGETHER else int(math.log2(n / FILE))
    rng, keys = np.random.default_rng(SEED), []
    while len(keys) < tables_for(width):
        order = rng.permutation(KEY_BITS)
        keys += [order[i : i + width] for i in range(0, KEY_BITS - width + 1, max(1, width))] if width else [order[:0]]
    return keys[: tables_for(width)]


def close_to(planes: np.ndarray, at: np.ndarray, n: int, radius: int) -> np.ndarray:
    """For each place in ``at`` whether each of the n fingerprints of the planes differs from that one in at most ``radius`` bits."""
    places = max(1, radius.bit_length())
    start = (1 << places) - 1 - radius
    shape = len(at), planes.shape[1]
    count = [np.full(shape, 0xFFFFFFFFFFFFFFFF if start >> p & 1 else 0, np.uint64) for p in range(places)]
    over = np.zeros(shape, np.uint64)
    mine = -(planes[:, at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1))  # all ones where the bit is set
    for row, bit in zip(planes, mine, strict=True):
        carry = row[None, :] ^ bit[:, None]
        for p in range(places):
            count[p], carry = count[p] ^ carry, count[p] & carry
        over |= carry
    return np.unpackbits((~over).astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def close_roots(fps: np.ndarray, group: np.ndarray, radius: int, fit: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The smallest index that each row reaches over pairs of its group (groups are contiguous) that differ in at most ``radius`` bits and ``fit``.

    Rows of long groups are set against all, 64 at a time; where most are close to the first they are one already, and only the others are.
    """
    n, a, b, held = len(fps), [], [], 0
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    plain = np.ones(n, bool)

    def add(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal a, b, held
        some = fit(i, j)
        a.append(i[some])
        b.append(j[some])
        held += len(a[-1])
        if held > _LINKS:
            root = local_roots(n, np.concatenate(a), np.concatenate(b))
            moved = np.flatnonzero(root != np.arange(n))
            a, b, held = [moved], [root[moved]], 0

    for k in np.flatnonzero(np.diff(edges) >= DENSE):
        first, size = int(edges[k]), int(edges[k + 1] - edges[k])
        planes, every = planes_of(fps[first : first + size]), np.arange(size)
        near = close_to(planes, every[:1], size, radius)[0] & fit(np.full(size, first), first + every)
        plain[first : first + size] = False
        add(np.full(int(near.sum()), first), first + every[near])
        others = every[~near] if 2 * near.sum() >= size else every
        for i in range(0, len(others), 64):
            x, y = np.nonzero(close_to(planes, others[i : i + 64], size, radius))
            add(first + others[i + x], first + y)
    rest = np.flatnonzero(plain)
    if len(rest):
        for i, j in close_pairs(fps[rest], group[rest], radius, list(range(8 * fps[:1].nbytes))):
            add(rest[i], rest[j])
    return local_roots(n, np.concatenate(a), np.concatenate(b)) if a else np.arange(n)


_DEALT = "unit long, id long, size long, fp long, fp2 long"
_NAMES = ["unit", "id", "size", "fp", "fp2"]


def _dealt(rows: DataFrame, keys: list[np.ndarray], first: int) -> DataFrame:
    """Rows (id, size, fp, fp2, bits) once for each key; unit is the number of the key, counted from ``first``, and its bits."""
    width = len(keys[0])
    places = np.concatenate(keys).astype(int)
    weights = np.left_shift(np.int64(1), np.arange(width, dtype=np.int64))
    tables = np.arange(first, first + len(keys), dtype=np.int64) << 40

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n = batch.num_rows
                packed = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(n, KEY_BITS // 8)
                bits = np.unpackbits(packed, axis=1, bitorder="little")[:, places].reshape(n, len(keys), width)
                unit = (bits.astype(np.int64) @ weights + tables).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(unit), *(pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), len(keys))) for i in range(4))], _NAMES)

    return rows.select("id", "size", "fp", "fp2", "bits").mapInArrow(each, _DEALT)


def _close(batches: Iterator[pa.RecordBatch], radius: int, ratio: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Of rows (unit, id, size, fp, fp2), sorted by unit, those close to others of their unit; key names what they are joined to."""
    p, q = ratio

    def run(rows: np.ndarray) -> pa.RecordBatch:
        unit, ids, size, fp, fp2 = rows
        fit = lambda i, j: q * np.minimum(size[i], size[j]) >= p * np.maximum(size[i], size[j])
        root = close_roots(np.stack((fp, fp2), axis=1).view(np.uint64), unit, radius, fit)
        some = np.bincount(root, minlength=len(root))[root] > 1
        key = (unit.view(np.uint64) * _MIX) ^ (ids[root].view(np.uint64) * _TIMES[0])
        key = (key ^ (key >> np.uint64(31))) * _MIX
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (key.view(np.int64), ids, size, fp, fp2)], ["key", *_NAMES[1:]])

    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]))
        if sum(x.shape[1] for x in held) >= _FILED:
            rows = np.concatenate(held, axis=1)
            change = np.flatnonzero(rows[0, 1:] != rows[0, :-1])
            cut = int(change[-1]) + 1 if len(change) else 0  # the last unit may go on in the next batch
            if cut:
                yield run(np.ascontiguousarray(rows[:, :cut]))
            held = [rows[:, cut:]]
    if held:
        yield run(np.ascontiguousarray(np.concatenate(held, axis=1)))


def close_files(rows: DataFrame, n: int, radius: int, ratio: tuple[int, int], scratch: Scratch, keys: list[np.ndarray] | None = None) -> DataFrame:
    """Files (key, id, size, fp, fp2) of texts whose 128-bit fingerprints are within ``radius`` bits, sizes within ``ratio``, directly or by way of others.

    ``rows``: id, size, fp, fp2 and the KEY_BITS bits of n texts. Texts with a key in common are compared bit-sliced; which keys are
    so frequent that their texts are cut into block pairs is estimated from some texts, and decides only how work is dealt.
    """
    keys = keys or wide_layout(n)
    hot = None
    if n > HOT:
        least = max(HOT, n // 500)
        step = least // 256
        some = _dealt(rows.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0), keys, 0).groupBy("unit").agg((F.count("*") * step).alias("n"))
        hot = scratch.save(some.filter(F.col("n") >= least).select("unit", F.ceil(F.col("n") / HOT_BLOCK).cast("int").alias("cuts")))
        hot = hot if hot.count() else None  # n / least keys of a number at most
    out = None
    for first in range(0, len(keys), ROUND):
        dealt = _dealt(rows, keys[first : first + ROUND], first)
        if hot is not None:
            cut = dealt.join(F.broadcast(hot), "unit", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
            own = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
            pair = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
            cut = cut.select("*", F.explode(pair).alias("b"))
            dealt = cut.select(F.when(F.col("cuts") == 1, F.col("unit")).otherwise(F.xxhash64("unit", "b.i", "b.j")).alias("unit"), *_NAMES[1:])
        dealt = dealt.repartition("unit").sortWithinPartitions("unit", "id")
        found = scratch.save(dealt.mapInArrow(lambda it: _close(it, radius, ratio), "key long, id long, size long, fp long, fp2 long"))
        out = found if out is None else out.union(found)
    return out


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, radius: int = 3) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Texts without words (null and empty ones too) have fingerprint zero and are linked like any other. Texts with
    fewer than ``words_each`` words count as one shingle. A null id is kept, but names a component only if it has no
    other. An empty table gives an empty result; other columns don't matter.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, id_col, text_col, words_each))
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    links = near_links(distinct.select("fp"), distinct.count(), radius, scratch)
    roots = components(links, scratch)
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = scratch.save(linked)
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints"))
    classes = join_spread(linked, least, ["root"], ["component_id"], F.col("prints"), linked.count(), F.col("fp"))
    classes = scratch.save(classes.select("fp", "component_id", "n"))
    joined = join_spread(prints, classes, ["fp"], ["component_id"], F.col("n"), prints.count(), F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, radius: int = 3, confirmed: bool = False) -> DataFrame:
    """One document of each near-copy group of ``docs``, that with the smallest id, with their own columns.

    Linked are fingerprints within ``radius`` bits. With ``confirmed``, linked are texts whose shingle sets have an exact
    Jaccard likeness of 0.8 or more; their fingerprints are compared within a wider radius first (see near_texts). Documents without an id
    can't name a component; they stay.
    """
    if confirmed:
        from recollect.llm import near_texts

        return near_texts.drop_near_copies(docs, id_col, text_col, words_each)
    marks = near_components(docs, id_col, text_col, words_each, radius)
    gone = marks.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__id"))
    return docs.join(gone, F.col(id_col) == F.col("__id"), "left_anti")
