"""Links between sets that are alike, from files of candidates: stars first, then what is still apart.

Each set is first compared with one other, of the smallest ids of its files that with the nearest fingerprint, so there are at most
as many pairs as sets, in however many files they meet. Only files whose sets are still in several components after that compare
the sets of different components, all in one task, which passes on only the links that it confirms. Sets of a large group meet in
a hundred files, each with other members of it; such files are merged into one (``_merged``), in which each set stands once. Long files
are cut into blocks and the pairs of blocks dealt over the cluster. Sets that several files bring together in the same way are compared once.

Sets are large, so before any is moved pairs are dropped on their lengths and on their SimHash fingerprints of 128 bits,
compared bit-sliced. Two large sets of Jaccard 0.8 differ in 19.4 of those bits on average, with a deviation of 4.1; RADIUS is six
deviations above. Small sets vary more: by the same model 7e-8 of pairs of 22 and 23 elements with 20 in common would be lost,
the worst case; a test measures none in 400,000 pairs of 16 to 40 elements at 0.80 to 0.82. 2e-4 of unrelated pairs (64 bits,
deviation 5.7) stay. Sets of fewer than SMALL elements are looked at whatever their fingerprints. ``Likeness(radius=None)`` drops no pair
on fingerprints, at the price of looking at every pair of a file whose lengths fit.

Sets of a likeness of 0.4 or so pass those 128 bits and meet in many files. Where ``links`` is given longer fingerprints (``fine``) it
compares these before it moves any set of such files: of 2,048 bits a pair at 0.8 differs in 326 at most on average, with a deviation of
16.6, and FINE is six deviations above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import Scratch, free_worker, join_spread
from recollect.llm.components import components, local_roots
from recollect.llm.simhash import KEY_BITS, close_roots

#: Bits of a fingerprint; differing ones up to which two sets are compared; elements from which fingerprints count.
BITS, RADIUS, SMALL = 128, 44, 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Differing bits of the 2,048 of a longer fingerprint up to which two sets are compared.
FINE = 430
#: Elements whose bits are counted at once.
_STEP = 1 << 17
#: Rows of units whose fingerprints are compared in one pass.
_PASS = 1 << 16
#: Sets that a task remembers.
_KEPT = 64
#: Sets in a block of a long file, and elements of all of them together, about.
BLOCK, ELEMENTS = 1_024, 1 << 20
#: Sets that are set against all others of their unit at once, and those that are read to be compared with one.
_STRIPE, _AT_ONCE = 256, 64


@dataclass(frozen=True)
class Likeness:
    """How sets are read and compared: linked are pairs of Jaccard ``ratio`` (of whole numbers) or more."""

    sets_of: Callable[[bytes | None], np.ndarray]
    ratio: tuple[int, int]
    #: Differing bits of fingerprints up to which pairs are compared; None compares all.
    radius: int | None = RADIUS

    @property
    def bits(self) -> int:
        return BITS if self.radius is None else self.radius

    def sizes_fit(self, a, b):
        p, q = self.ratio
        return q * F.least(a, b) >= p * F.greatest(a, b)

    def alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether two sorted sets are alike, given up as soon as what is left of the smaller can't make it so."""
        p, q = self.ratio
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        if not len(small) or q * len(small) < p * len(large):
            return False
        need = -(-p * (len(a) + len(b)) // (p + q))
        both, step = 0, max(64, len(small) // 4)
        for i in range(0, len(small), step):
            if both + len(small) - i < need:
                return False
            part = small[i : i + step]
            both += int((large[np.minimum(np.searchsorted(large, part), len(large) - 1)] == part).sum())
        return both >= need


def _confirmed(pairs: DataFrame, sets: DataFrame, like: Likeness, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) whose sets are alike. ``sets`` has id and t."""
    n, told = pairs.count(), pairs
    for side, other, to in (("u", "v", "a"), ("v", "u", "b")):
        counts = told.groupBy(side).agg(F.count("*").alias("n"))  # of the written pairs, whose size is known: few of them don't move all texts
        right = scratch.save(sets.join(counts, F.col("id") == F.col(side)).select(side, F.col("t").alias(to), "n"))
        pairs = join_spread(pairs, right, [side], [to], F.col("n"), n, F.col(other))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes | None, np.ndarray] = {}

        def of(text: bytes | None) -> np.ndarray:
            if text not in known:
                if len(known) >= _KEPT:
                    known.pop(next(iter(known)))
                known[text] = like.sets_of(text)
            return known[text]

        for batch in batches:
            a, b = (batch.column(i).cast(pa.binary()) for i in (2, 3))  # texts leave Arrow one at a time
            hits = pa.array([like.alike(of(x.as_py()), of(y.as_py())) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["u", "v"]).filter(hits)

    return scratch.save(pairs.select("u", "v", "a", "b").mapInArrow(each, "u long, v long"))


def fingerprints(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """128-bit SimHashes of n sets, two numbers a row. ``owner``: the set of each of the well mixed 64-bit hashes, in order."""
    over = np.zeros((n, BITS), np.int64)
    for i in range(0, len(hashes), _STEP):
        part, own = hashes[i : i + _STEP], owner[i : i + _STEP]
        two = np.stack((part, (part ^ (part >> np.uint64(31))) * _MIX), axis=1)
        two[:, 1] ^= two[:, 1] >> np.uint64(29)
        bits = np.unpackbits(two.astype("<u8").view(np.uint8).reshape(len(part), BITS // 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        over[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * over > np.bincount(owner, minlength=n)[:, None], axis=1, bitorder="little").view("<i8")


def _candidates(roots: np.ndarray, size: np.ndarray, fps: np.ndarray, like: Likeness) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs a > b of one unit of different roots whose lengths and fingerprints allow for a link, in the order of a, some a at a time."""
    p, q = like.ratio
    bits = fps.view(np.uint64)
    for first in range(0, len(roots), _STRIPE):
        mine = slice(first, first + _STRIPE)
        upto = min(len(roots), first + _STRIPE)
        differ = sum(np.bitwise_count(x[mine, None] ^ x[None, :upto]) for x in bits.T)  # 128 at most, which fits a byte
        least, most = np.minimum(size[mine, None], size[:upto]), np.maximum(size[mine, None], size[:upto])
        fit = ((differ <= like.bits) | (least < SMALL)) & (q * least >= p * most) & (roots[mine, None] != roots[:upto])
        a, b = np.nonzero(fit & np.tri(*fit.shape, k=first - 1, dtype=bool))
        if len(a):
            yield first + a, b


def _neighbours(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of each group (groups are contiguous), by distance."""
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    left = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(group)) - 1
    d, at = 1, np.flatnonzero(left >= 1)
    while len(at):
        yield at, at + d
        d += 1
        at = at[left[at] >= d]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.view(np.uint64) + np.uint64(1)) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _unit_names(first: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A name for each row's component, which is that of its index in ``first``, made of the ids in it."""
    name = np.zeros(len(ids), np.uint64)
    np.add.at(name, first, _mixed(np.ascontiguousarray(ids)))
    return _mixed(name.view(np.int64)).view(np.int64)[first]


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """The rows of each unit, without unit, and what stands in the last column. Rows are sorted by unit."""
    unit, rows, last = None, [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(batch.num_columns - 1)]
        for k, *row, x in zip(*columns, batch.column(batch.num_columns - 1), strict=True):
            if k != unit:
                if rows:
                    yield rows, last, unit
                unit, rows, last = k, [], []
            rows.append(tuple(row))
            last.append(x)
    if rows:
        yield rows, last, unit


def _thinned(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """Of rows (unit, id, root, size, fp, fp2), sorted by unit, those that have a candidate in their unit; many units at once.

    A unit comes out as the sets that candidates connect, each named by its ids: what two units would compare alike has one name.
    """
    p, q = like.ratio
    names = ["unit", "id", "root", "size", "fp", "fp2"]

    def run(rows: np.ndarray) -> pa.RecordBatch:
        # a unit whose sets are in one component already has nothing to find
        starts = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
        apart = np.minimum.reduceat(rows[2], starts) != np.maximum.reduceat(rows[2], starts)
        rows = np.ascontiguousarray(rows[:, np.repeat(apart, np.diff(np.r_[starts, rows.shape[1]]))])
        unit, ids, root, size, fp, fp2 = rows
        fit = lambda a, b: (root[a] != root[b]) & (q * np.minimum(size[a], size[b]) >= p * np.maximum(size[a], size[b]))
        first = close_roots(np.stack((fp, fp2), axis=1).view(np.uint64), unit, like.bits, fit)
        held, linked = 0, [(np.arange(len(unit)), first)]
        # a set of fewer than SMALL elements can only be alike to one of few more
        small = np.flatnonzero(p * size < q * SMALL)
        for a, b in _neighbours(unit[small]):
            a, b = small[a], small[b]
            some = (np.minimum(size[a], size[b]) < SMALL) & fit(a, b)
            linked.append((a[some], b[some]))
            held += int(some.sum())
            if held > _PASS:
                held, linked = 0, [(np.arange(len(unit)), local_roots(len(unit), *map(np.concatenate, zip(*linked, strict=True))))]
        first = local_roots(len(unit), *map(np.concatenate, zip(*linked, strict=True)))
        some = np.bincount(first, minlength=len(unit))[first] > 1
        rows[0] = _unit_names(first, ids)
        return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in rows], names)

    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)]))
        if sum(x.shape[1] for x in held) >= _PASS:
            rows = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last unit may go on in the next batch
            if cut:
                yield run(rows[:, :cut])
            held = [rows[:, cut:]]
    if held:
        yield run(np.concatenate(held, axis=1))


def _finer(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """Of rows (unit, id, root, size, fp, fp2, bits), sorted by unit, those with a candidate within FINE bits; units as in ``_thinned``. Null bits are near all."""
    names = ["unit", "id", "root", "size", "fp", "fp2"]
    for rows, longer, _ in _by_unit(batches):
        rows = np.array(rows, np.int64)
        known = np.array([x.is_valid for x in longer])
        bits = np.frombuffer(b"".join(x.as_py() for x in longer if x.is_valid), np.uint64).reshape(-1, KEY_BITS // 64)
        at = np.cumsum(known) - 1
        first = np.arange(len(rows))
        for a, b in _candidates(rows[:, 1], rows[:, 2], rows[:, 3:], like):
            for i in range(0, len(a), _PASS):
                u, v = a[i : i + _PASS], b[i : i + _PASS]
                apart = first[u] != first[v]
                u, v = u[apart], v[apart]
                near = ~(known[u] & known[v])
                both = np.flatnonzero(~near)
                near[both] = np.bitwise_count(bits[at[u[both]]] ^ bits[at[v[both]]]).sum(1, dtype=np.int64) <= FINE
                first = local_roots(len(rows), np.concatenate((np.arange(len(rows)), u[near])), np.concatenate((first, v[near])))
        some = np.bincount(first, minlength=len(rows))[first] > 1
        if some.any():
            unit = _unit_names(first, rows[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (unit, *rows.T)], names)


def _alike_to(one: np.ndarray, others: list[np.ndarray], like: Likeness) -> np.ndarray:
    """Which of the sets are alike to the one; all are sorted and none is empty."""
    p, q = like.ratio
    flat, n = np.concatenate(others), np.array([len(x) for x in others])
    same = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.add.reduceat(same, np.cumsum(n) - n, dtype=np.int64)
    return q * both >= p * (len(one) + n - both)


def _unit_links(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """Links that join sets of different roots in one unit: fewer than there are roots. Rows (unit, id, root, size, fp, fp2, t) are sorted by unit."""
    free_worker()
    for rows, texts, _ in _by_unit(batches):
        ids, roots, size, *fps = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        top = np.unique(roots, return_inverse=True)[1]
        sets: dict[int, np.ndarray] = {}
        joining = []

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = like.sets_of(texts[i].cast(pa.binary()).as_py())  # noqa: B023
            return sets[i]

        for a, b in _candidates(roots, size, np.stack(fps, axis=1), like):
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            for i, left in zip(a[starts].tolist(), np.split(b, starts[1:]), strict=True):
                left = left[(size[left] > 0) & (size[i] > 0)]
                while len(left := left[top[left] != top[i]]):  # what links have joined meanwhile needs no others
                    some, left = left[:_AT_ONCE], left[_AT_ONCE:]
                    for j in some[_alike_to(of(i), [of(j) for j in some.tolist()], like)].tolist():
                        if top[j] != top[i]:
                            top[top == top[j]] = top[i]
                            joining.append((i, j))
        if joining:
            i, j = np.array(joining).T
            u, v = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _cuts(n: Column, elements: Column) -> Column:
    """Into how many blocks n sets with so many elements are cut."""
    return F.least(n, F.greatest(F.ceil(n / BLOCK), F.ceil(elements / ELEMENTS))).cast("int")


def _merged(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (key, id, size, fp, fp2, root, cuts) in which all sets that share one of the files in ``rows``, which has home too, share one still.

    Files of one home become one wherever that makes half the rows at most, blocks counted; the others stay as they are, so there
    are never more rows than before.
    """
    member = ["id", "size", "fp", "fp2", "root"]
    files = F.collect_list(F.struct("key", "cuts")).alias("files")  # a set is in no more files than there are keys
    sets = scratch.save(rows.groupBy("home", *member).agg(F.sum("cuts").alias("rows"), files))
    dense = sets.groupBy("home").agg(F.count("*").alias("n"), F.sum("size").alias("elements"), F.sum("rows").alias("rows"))
    dense = dense.withColumn("into", _cuts(F.col("n"), F.col("elements"))).filter(2 * F.col("n") * F.col("into") <= F.col("rows"))
    dense = scratch.save(dense.select("home", "n", "into"))
    placed = join_spread(sets, dense, ["home"], ["into"], F.col("n"), sets.count(), F.col("id"))
    one = F.array(F.struct(F.col("home").alias("key"), F.col("into").alias("cuts")))
    placed = placed.select(*member, F.explode(F.when(F.col("into").isNotNull(), one).otherwise(F.col("files"))).alias("f"))
    out = scratch.save(placed.select("f.key", *member, "f.cuts"))
    scratch.drop(sets, dense)
    return out


def links(filed: DataFrame, sets: DataFrame, like: Likeness, scratch: Scratch, fine: DataFrame | None = None) -> DataFrame:
    """Links (u, v), u < v, between ids whose components are those of all alike pairs that are filed together.

    ``filed`` has key, id, size (elements of the set), fp and fp2 (its fingerprint); ``sets`` has id and t, what ``like``
    reads a set from; ``fine``, if there is one, id and bits, a fingerprint of 2,048 bits or null.
    """
    member = ["id", "size", "fp", "fp2"]
    often = filed.groupBy("id").agg(F.count("*").alias("often"))
    top = F.max(F.struct("often", "id")).alias("top")
    files = filed.join(often, "id").groupBy("key").agg(F.min(F.struct(*member)).alias("lead"), F.max("id").alias("last"), F.count("*").alias("n"), top)
    files = scratch.save(files.filter("lead.id < last").select("key", "lead", "n", "top"))  # a file with one set has no pairs
    total = files.agg(F.sum("n")).first()[0] or 0
    shared = scratch.save(join_spread(filed.select("key", *member), files, ["key"], ["lead", "top"], F.col("n"), total, F.col("id")).filter("lead IS NOT NULL"))
    near = (F.col("id") > F.col("lead.id")) & like.sizes_fit(F.col("size"), F.col("lead.size"))
    differs = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"lead.{c}"))) for c in ("fp", "fp2")), F.lit(0))
    near &= (differs <= like.bits) | (F.least("size", "lead.size") < SMALL)
    nearest = F.min(F.struct(differs.alias("differs"), F.col("lead.id").alias("u")))  # one a set, whatever the number of its files
    stars = scratch.save(shared.filter(near).groupBy(F.col("id").alias("v")).agg(nearest.alias("to")).select("to.u", "v"))
    found = _confirmed(stars, sets, like, scratch)

    roots = components(found, scratch)
    # files go to the set that is in the most files, of their members and those that these share a file with
    tops = shared.groupBy("id").agg(F.max("top").alias("top")).join(roots.withColumnRenamed("node", "id"), "id", "left")
    rooted = shared.select("key", *member).join(tops, "id").withColumn("root", F.coalesce("root", "id"))
    rooted = scratch.save(rooted)
    scratch.drop(shared, stars, files)
    members = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("all"), F.min("id").alias("first"), F.max("id").alias("last")]
    split = rooted.groupBy("key").agg(*members, F.min("root").alias("a"), F.max("root").alias("b"), F.max("top").alias("top"), F.sum("size").alias("elements"))
    split = split.filter("a < b").withColumn("cuts", _cuts(F.col("n"), F.col("elements"))).withColumn("home", F.xxhash64("top.id", F.lit("home")))
    # of files with the same sets, one
    one = F.min(F.struct("key", "home", "cuts")).alias("one")
    split = scratch.save(split.groupBy("n", "all", "first", "last").agg(one).select("one.*", F.col("n").alias("rows")))
    total = split.agg(F.sum("rows")).first()[0] or 0
    apart = join_spread(rooted, split, ["key"], ["home", "cuts"], F.col("rows"), total, F.col("id")).filter("home IS NOT NULL")
    merged = _merged(apart, scratch)
    scratch.drop(rooted, split)
    apart = merged.withColumn("own", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    units = apart.select("key", *member, "root", F.explode(pair).alias("b"))
    units = units.select(F.xxhash64("key", "b.i", "b.j").alias("unit"), "id", "root", "size", "fp", "fp2")
    dealt = lambda df: df.repartition("unit").sortWithinPartitions("unit", "id")
    units = scratch.save(dealt(units).mapInArrow(lambda it: _thinned(it, like), "unit long, id long, root long, size long, fp long, fp2 long").distinct())
    scratch.drop(merged)
    if fine is not None and like.radius is not None:
        finer = dealt(units.join(fine.select("id", "bits"), "id").select(*units.columns, "bits"))
        before, units = units, scratch.save(finer.mapInArrow(lambda it: _finer(it, like), units.schema).distinct())
        scratch.drop(before)
    whole = dealt(units.join(sets, "id").select(*units.columns, "t"))
    out = found.union(scratch.save(whole.mapInArrow(lambda it: _unit_links(it, like), "u long, v long")))
    scratch.drop(units)
    return out
