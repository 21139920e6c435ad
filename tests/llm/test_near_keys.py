import random

import numpy as np
import pytest

from recollect.llm import near_texts, set_links, simhash
from recollect.llm.common import Scratch


def pairs_at_the_edge(rng, a, b, c, n):
    """n pairs of sets of a and b hashes, c of them in common."""
    both = rng.integers(0, 1 << 64, (n, c), np.uint64, endpoint=False)
    return [np.concatenate((both, rng.integers(0, 1 << 64, (n, k - c), np.uint64)), axis=1) for k in (a, b)]


@pytest.mark.parametrize("width", [6, 11, 18])
def test_keys_of_simhash_bits_bring_pairs_at_the_edge_together(width):
    """Measured: pairs of likeness 0.8 share a key, and chance does too as seldom as the width says."""
    rng = np.random.default_rng(width)
    keys = simhash.wide_layout(simhash.FILE << width)
    assert len(keys) == simhash.tables_for(width) and {len(k) for k in keys} == {width}
    apart, met = 0, 0
    for a, b, c in [(22, 23, 20), (31, 32, 28), (80, 73, 68), (240, 237, 212)]:
        bits = [np.stack([np.unpackbits(np.frombuffer(simhash.key_bits(x), np.uint8), bitorder="little") for x in side]) for side in pairs_at_the_edge(rng, a, b, c, 250)]
        same = np.stack([(bits[0][:, k] == bits[1][:, k]).all(1) for k in keys])
        other = np.stack([(bits[0][:, k] == np.roll(bits[1], 1, 0)[:, k]).all(1) for k in keys])
        apart += int((~same.any(0)).sum())
        met += other.mean()
        assert (bits[0] != bits[1]).mean() < simhash.DIFFER + 0.002
    assert apart == 0 and met / 4 < 3 / 2**width


def test_close_roots_of_dense_and_other_groups():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (3, 2), np.int64)
    fps, group = [], []
    for g, (n, of) in enumerate([(700, [0] * 9 + [1]), (300, [0, 1, 2]), (90, [0, 1]), (1, [0]), (400, [2])]):
        for _ in range(n):
            x = np.unpackbits(base[rng.choice(of)].view(np.uint8)).copy()
            x[rng.choice(128, rng.integers(0, 30), replace=False)] ^= 1
            fps.append(np.packbits(x).view(np.uint64))
            group.append(g)
    fps, group, size = np.array(fps), np.array(group), rng.integers(80, 110, len(group))
    fit = lambda i, j: 5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j])
    for radius in (10, 44):
        got = simhash.close_roots(fps, group, radius, fit)
        differ = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2)
        i, j = np.nonzero((differ <= radius) & (group[:, None] == group) & fit(*np.indices(differ.shape)))
        assert np.array_equal(got, simhash.local_roots(len(fps), i, j)) and 0 < (got != np.arange(len(got))).sum()


def test_files_hold_the_pairs_at_the_edge(spark, monkeypatch):
    """Long keys, several rounds and cut files: each pair of likeness 0.8 comes together, small sets by their own shingles."""
    monkeypatch.setattr(simhash, "TOGETHER", 100)
    monkeypatch.setattr(simhash, "FILE", 4)
    monkeypatch.setattr(simhash, "HOT", 256)
    monkeypatch.setattr(simhash, "HOT_BLOCK", 100)
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(124)]
    rows = [(10_000 + i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i, k in enumerate(rng.choices(range(124), k=300))]  # a group of one key
    for i in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range((12, 24, 124)[i % 3])]
        other = words[: (11, 20, 100)[i % 3]]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    rows += [(20_000, rows[0][1]), (20_001, rows[0][1]), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {i: set(near_texts.shingles(t.encode()).tolist()) for i, t in rows if i is not None}
    ids = sorted(sets)
    alike = {(a, b) for k, b in enumerate(ids) for a in ids[:k] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(simhash.wide_layout(600)) > simhash.ROUND // 2 and len(alike) > 10_000
    scratch = Scratch(spark, "edge")
    filed = near_texts._filed(docs, "doc_id", "text", 5).collect()
    files = {}
    for r in filed:
        for k in r["keys"]:
            files.setdefault(k, set()).add(r.id)
    share = {}
    for k, members in files.items():
        for i in members:
            share.setdefault(i, set()).add(k)
    apart = [(a, b) for a, b in alike if not share.get(a, set()) & share.get(b, set()) and a < 10_000]
    assert not apart
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in alike:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    kept = [r.doc_id for r in near_texts.drop_near_copies(docs).collect()]
    assert sorted(i for i in kept if i is not None) == [i for i in ids if top(i) == i] and kept.count(None) == 1
    found = near_texts.near_links(docs, scratch).collect()
    assert {(r.u, r.v) for r in found} <= alike and set_links.RADIUS == 44
