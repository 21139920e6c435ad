import random

import numpy as np
import pyarrow as pa
import pytest

from recollect.llm import set_links, simhash
from recollect.llm.common import Scratch
from recollect.llm.components import components


def sets_alike(rng, n, differ):
    """n sets of 100 hashes, each with ``differ`` of its own in place of those that all share."""
    base = rng.integers(0, 1 << 63, 100, np.uint64)
    return [np.sort(np.r_[np.delete(base, rng.choice(100, differ, replace=False)), rng.integers(0, 1 << 63, differ, np.uint64)]) for _ in range(n)]


def prints(sets):
    return set_links.fingerprints(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets), len(sets)).tolist()


def test_however_many_files_a_set_is_in_it_is_first_compared_with_one_other(spark, monkeypatch):
    seen, real = [], set_links._confirmed
    monkeypatch.setattr(set_links, "_confirmed", lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest))
    rng = random.Random(1)
    sets = sets_alike(np.random.default_rng(1), 60, 4)
    filed = [(k, i, 100, *fp) for i, fp in enumerate(prints(sets)) for k in range(30) if rng.random() < 0.2]
    scratch = Scratch(spark, "stars")
    found = set_links.links(
        spark.createDataFrame(filed, "key long, id long, size long, fp long, fp2 long"),
        spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "id long, t binary"),
        set_links.Likeness(lambda x: np.frombuffer(x, np.uint64), (4, 5)), scratch,
    )
    assert {r.root for r in components(found, scratch).collect()} == {0}
    assert seen and max(seen) < 60


def test_longer_fingerprints_leave_pairs_at_the_edge_and_name_units_by_their_sets():
    like = set_links.Likeness(lambda x: x, (4, 5))
    rng = np.random.default_rng(2)
    near, far = sets_alike(rng, 2, 5), sets_alike(rng, 2, 30)
    sets = [*near, *far]
    kinds = [("unit", pa.int64()), ("id", pa.int64()), ("root", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64())]
    rows = [(unit, i, i, 100, *prints(sets)[i]) for unit in (1, 2) for i in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(kinds))
    thin = pa.Table.from_batches(set_links._thinned(iter([batch]), like)).to_pylist()
    assert len({r["unit"] for r in thin if r["id"] < 2}) == 1 and {r["id"] for r in thin} == {0, 1, 2, 3}
    for bits, left in ([simhash.key_bits(x) for x in sets], {0, 1}), ([None] * 4, {0, 1, 2, 3}):
        whole = batch.append_column("bits", pa.array(bits * 2, pa.binary()))
        fine = pa.Table.from_batches(set_links._finer(iter([whole]), like)).to_pylist()
        assert {r["id"] for r in fine} == left and len({r["unit"] for r in fine if r["id"] < 2}) == 1
    edge = [rng.integers(0, 1 << 63, 200, np.uint64) for _ in range(300)]
    most = [np.bitwise_count(np.frombuffer(simhash.key_bits(x[:22]), np.uint64) ^ np.frombuffer(simhash.key_bits(x[2:25]), np.uint64)).sum() for x in edge]
    assert max(most) < set_links.FINE  # 20 in common of 25


@pytest.mark.parametrize(("block", "most"), [(2_048, 180), (40, 5 * 180)])
def test_a_group_in_many_files_stands_in_one_and_loses_no_link(spark, monkeypatch, block, most):
    made, real = [], Scratch.save

    def save(self, df):
        out = real(self, df)
        if "unit" in df.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "save", save)
    monkeypatch.setattr(set_links, "BLOCK", block)
    rng = random.Random(7)
    sets = [x for k in (4, 9, 11) for x in sets_alike(np.random.default_rng(7), 60, k)]  # likenesses of 0.65 to 0.9
    filed = [(k, i, 100, *fp) for i, fp in enumerate(prints(sets)) for k in range(60) if rng.random() < 0.5]
    share = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    alike = {(a, b) for b in range(len(sets)) for a in range(b) if 5 * share(a, b) >= 4 * (len(sets[a]) + len(sets[b]) - share(a, b))}
    scratch = Scratch(spark, "group")
    found = set_links.links(
        spark.createDataFrame(filed, "key long, id long, size long, fp long, fp2 long"),
        spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "id long, t binary"),
        set_links.Likeness(lambda x: np.frombuffer(x, np.uint64), (4, 5)), scratch,
        spark.createDataFrame([(i, simhash.key_bits(x)) for i, x in enumerate(sets)], "id long, bits binary"),
    )
    assert {(r.u, r.v) for r in found.collect()} <= alike
    want = components(spark.createDataFrame(sorted(alike), "u long, v long"), scratch)
    root = lambda df: {r.node: r.root for r in df.collect()}
    assert root(components(found, scratch)) == root(want) and 60 <= len(root(want)) < len(sets)
    assert made and max(made) <= most
