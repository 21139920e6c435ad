import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from recollect.llm import exact_dedup, simhash
from recollect.llm.common import Scratch
from recollect.llm.components import components

SCHEMA = "doc_id long, text string, sha string, n long"
ODD = [(1, "a  b"), (2, "a\tb"), (3, None), (4, ""), (5, " "), (6, "a b "), (7, "x " * 50_000), (8, "x  " * 50_000), (9, "a b"), (9, "a b"), (None, "a b"), (None, "lone")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], SCHEMA).repartition(5)


def test_exact_marks(spark):
    got = exact_dedup.mark_exact_copies(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    norm = {}
    for i, t in ODD:
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
        norm.setdefault(key, []).append(i)
    for r in got:
        ids = norm[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (min(known) if known else None)
    assert sum(r.kept for r in got) == len(norm)


def test_exact_drop_keeps_columns(spark):
    docs = frame(spark, ODD)
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert out.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ODD})


def test_empty_tables(spark):
    none = frame(spark, ODD).limit(0)
    assert exact_dedup.mark_exact_copies(none).count() == 0
    assert simhash.near_components(none).count() == 0


def test_many_runs(spark):
    rows = [(i, f"t{i % 37}") for i in range(2_000)]
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA).repartition(40)
    got = exact_dedup.mark_exact_copies(docs).collect()
    assert all(r.keep_id == r.doc_id % 37 and r.group_size in (54, 55) for r in got)
    assert sum(r.kept for r in got) == 37


def brute_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if (prints[ids[x]] ^ prints[ids[y]]).bit_count() <= 3:
                a, b = find(ids[x]), find(ids[y])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}É" for i in range(300)]
    rows = [(0, None), (1, ""), (2, "One"), (3, "one two"), (4, "ONE\x0btwo")]
    for i in range(5, 160):
        base = rng.choice(rows)[1] if i > 20 and rng.random() < 0.6 else None
        own = base.split() if base else rng.choices(words, k=rng.randint(1, 400))
        if base and len(own) > 3:
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    rows.append((500, "long " * 70_000 + "tail"))
    rows.append((501, " ".join(words[i % 299] for i in range(70_001))))
    want = {i: brute_print(t) for i, t in rows}
    parts = brute_components(want)
    got = simhash.near_components(frame(spark, rows)).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == want
    assert {r.doc_id: r.component_id for r in got} == parts
    kept = simhash.drop_near_copies(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "sha", "n"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(parts.values()))


@pytest.mark.parametrize(("n", "block"), [(10, 16), (1 << 32, 2_048)])
def test_links_at_every_layout(spark, n, block):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64)
    fps = set(base.tolist())
    for x in base:
        for _ in range(20):
            y = int(x)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                y ^= 1 << int(b)
                y = y - (1 << 64) if y >> 63 == 1 else y
            fps.add(int(np.uint64(y & (1 << 64) - 1).astype(np.int64)))
    scratch = Scratch(spark, "links")
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in components(simhash.near_links(df, n, 3, scratch, block), scratch).collect()}
    at = {i: x & (1 << 64) - 1 for i, x in enumerate(sorted(fps))}
    want = brute_components(at)
    signed = dict(enumerate(sorted(fps)))
    assert all(got.get(signed[i], signed[i]) == signed[r] for i, r in want.items())


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    fps = np.repeat(rng.integers(0, 1 << 63, 40, dtype=np.uint64), 8)
    fps ^= np.left_shift(np.uint64(1), rng.integers(0, 64, len(fps)).astype(np.uint64)) * rng.integers(0, 2, len(fps)).astype(np.uint64)
    fps ^= np.left_shift(np.uint64(1), rng.integers(0, 64, len(fps)).astype(np.uint64)) * rng.integers(0, 2, len(fps)).astype(np.uint64)
    group = np.sort(rng.integers(0, 3, len(fps)))
    got = {(int(i), int(j)) for a, b in simhash.close_pairs(fps, group, radius, list(range(64))) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
    assert got == want


def test_components_of_a_long_chain(spark):
    links = spark.range(100).selectExpr("id * 7 as u", "(id + 1) * 7 as v")
    got = components(links, Scratch(spark, "chain")).collect()
    assert len(got) == 101 and all(r.root == 0 for r in got)


def test_runs_merge_without_another_sort(spark, monkeypatch):
    """Ninety runs in rounds of four into several ranges each; only the first step sorts."""
    monkeypatch.setattr(exact_dedup, "_BATCH", 8)
    monkeypatch.setattr(exact_dedup, "_RANGE", 16)
    rng = random.Random(4)
    rows = [(None if rng.random() < 0.05 else rng.randint(0, 500), rng.choice(["hot", f"t{rng.randint(0, 300)}", f" t{rng.randint(0, 300)} "])) for _ in range(3_000)]
    docs = spark.createDataFrame(rows, "id long, t string").repartition(90)
    scratch = Scratch(spark, "runs")
    t = exact_dedup.normalised("t")
    digests = scratch.save(docs.select("id", exact_dedup.F.sha2(t, 256).alias("sha"), exact_dedup.F.xxhash64(t).alias("proof"), exact_dedup.F.octet_length(t).cast("long").alias("size"), exact_dedup.F.monotonically_increasing_id().alias("row")))
    runs = scratch.save(exact_dedup._first_runs(digests.repartition(90), scratch.base + "/runs"))
    assert runs.count() > 60
    out = exact_dedup.merge_runs(runs, scratch.base + "/runs", scratch, bits=2)
    assert out.agg(exact_dedup.F.max("run")).first()[0] == 0 and out.count() > 4
    got = {r.sha: (r.keep_id, r.n) for r in exact_dedup.entries_of(out).collect()}
    want = {}
    for i, text in rows:
        want.setdefault(hashlib.sha256(re.sub(r"\s+", " ", text).encode()).hexdigest(), []).append(i)
    assert got == {k: (min((i for i in v if i is not None), default=None), len(v)) for k, v in want.items()}
    for path in [r.path for r in out.collect()]:
        entries = list(exact_dedup._read_from(path, b"", None))
        assert entries == sorted(entries) and len({e[:3] for e in entries}) == len(entries)
    merge = exact_dedup.entries_of(out)._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in merge


def test_copies_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "__own", "docs", "id", "sha"]
    docs = spark.createDataFrame([(1, "a", "x", "y", 5, "s"), (1, "a", "x", "y", 5, "s"), (2, "a", "z", "y", 5, "s"), (3, "", "x", "y", 6, "s"), (4, None, "w", "y", 6, "s"), (5, " ", "w", "y", 6, "s")], "doc_id long, text string, __own string, docs string, id int, sha string")
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == names
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", "x", "y", 5, "s"), (3, "", "x", "y", 6, "s"), (5, " ", "w", "y", 6, "s")]


def test_one_component_of_a_third_of_all_nodes(spark, monkeypatch):
    from recollect.llm import common

    monkeypatch.setattr(common, "HEAVY_ROWS", 20)
    rng = random.Random(6)
    star, chain = [(0, i) for i in range(1, 400)], [(1_000 + i, 1_001 + i) for i in range(300)]
    rest = [(2_000 + rng.randint(0, 400), 2_000 + rng.randint(0, 400)) for _ in range(200)]
    links = star + chain + rest
    up = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            x = y
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "c")).collect()}
    assert got == {x: top(x) for a, b in links if a != b for x in (a, b)}
    left = spark.createDataFrame([(0, i) for i in range(900)] + [(i, i) for i in range(1, 100)], "k int, i int").repartition(4)
    right = spark.createDataFrame([(i, f"v{i}") for i in range(100)], "k int, v string")
    dealt = common.join_hot(left, right, "k", exact_dedup.F.col("i"), 999)
    assert sorted(map(tuple, dealt.select("k", "i", "v").collect())) == sorted((k, i, f"v{k}") for k, i in [(0, i) for i in range(900)] + [(i, i) for i in range(1, 100)])
    weighed = common.join_spread(left, right.withColumn("n", exact_dedup.F.when(exact_dedup.F.col("k") == 0, 900).otherwise(1)), ["k"], ["v"], exact_dedup.F.col("n"), 999, exact_dedup.F.col("i"))
    assert sorted(map(tuple, weighed.select("k", "i", "v").collect())) == sorted(map(tuple, dealt.select("k", "i", "v").collect()))
    shares = [r["count"] for r in dealt.groupBy(exact_dedup.F.spark_partition_id()).count().collect()]
    assert len(shares) == 1 or max(shares) < 500


def test_sketches_lose_no_alike_pair_of_small_sets():
    """Measured recall: pairs of 16 to 40 elements whose likeness is 0.80 to 0.82, the hardest ones for a sketch."""
    from recollect.llm import set_links

    rng = np.random.default_rng(9)
    sizes = [(a, b, c) for a in range(16, 41) for b in range(a, 41) for c in range(16, a + 1) if 0.8 <= c / (a + b - c) <= 0.82]
    lost = tried = 0
    for a, b, c in sizes:
        n = max(1, 400_000 // len(sizes))
        both = rng.integers(0, 1 << 64, (n, c), np.uint64, endpoint=False)
        ends = [np.concatenate((both, rng.integers(0, 1 << 64, (n, k - c), np.uint64)), axis=1) for k in (a, b)]
        prints = [set_links.fingerprints(np.repeat(np.arange(n), x.shape[1]), x.reshape(-1), n).view(np.uint64) for x in ends]
        lost += int((np.bitwise_count(prints[0] ^ prints[1]).sum(1) > set_links.RADIUS).sum())
        tried += n
    assert tried > 390_000 and lost == 0
