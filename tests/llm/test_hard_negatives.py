import numpy as np
from pyspark.sql import functions as F

from recollect.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, row string, x int, code int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, "a", 1, 2) for i, v, c in rows], SCHEMA)


def brute(rows, every=5):
    """Rows in the order of the table; plain Python, exact."""
    rows = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v], c_) for i, v, c_ in rows]
    out = []
    for n, (i, x, label) in enumerate(rows):
        if i % every:
            continue
        score = [(-sum(a * b for a, b in zip(x, y)), j, m, c) for m, (j, y, c) in enumerate(rows) if m != n]
        near = sorted(s for s in score if s[3] == label)[: H.POSITIVES]
        far = sorted(s for s in score if s[3] != label)
        for p, pid, _, _ in near:
            fit = [s for s in far if 50 * -p <= 100 * -s[0] <= 95 * -p][: H.NEGATIVES]
            out += [(i, pid, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fit)]
    return sorted(out)


def run(spark, rows, **how):
    df = H.mine(table(spark, rows).coalesce(1), F.col("vec_id") % 5 == 0, **how)
    return sorted(tuple(r) for r in df.collect())


def clouds(n, dims, seed, labels=4, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.15, (6, dims))
    return [(int(i), (centres[k := int(rng.integers(6))] + rng.normal(0, spread * 0.15, dims)).astype(np.float32).tolist(), int((k + rng.integers(2)) % labels)) for i in rng.permutation(n)]


def test_equals_brute_force(spark, monkeypatch):
    for dims, seed in ((64, 1), (100, 2), (5, 3), (1, 4)):
        rows = clouds(300, dims, seed)
        got = run(spark, rows)
        assert got == brute(rows) and (dims == 1 or len(got) > 50)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 16)
    monkeypatch.setattr(H, "LEAST_BLOCK", 40)
    monkeypatch.setattr(H, "_TILE_A", 3)
    monkeypatch.setattr(H, "_TILE_V", 7)
    rows = clouds(400, 64, 5)
    assert run(spark, rows) == brute(rows)


def test_a_third_equal_rows_ties_and_repeats(spark):
    rows = clouds(120, 16, 7)
    hot = rows[3][1]
    rows += [(1_000 + i, hot, i % 2) for i in range(90)] + [(5, rows[9][1], 2), (5, rows[9][1], 2), (10, hot, 0)]
    assert run(spark, rows) == brute(rows)


def test_rows_that_take_no_part(spark):
    rows = clouds(100, 8, 9)
    v = rows[0][1]
    odd = [(None, v, 1), (200, None, 1), (205, v, None), (210, [None, *v[1:]], 1), (215, [float("nan"), *v[1:]], 1), (220, [float("-inf"), *v[1:]], 1), (225, v[:3], 1), (230, [], 1)]
    assert run(spark, rows + odd) == brute(rows)
    assert run(spark, []) == [] and run(spark, odd) == [] and run(spark, [(5, v, 1)]) == []
    assert run(spark, [(1, v, 1), (2, v, 2)]) == []  # no anchor
    zero = [(5, [0.0, 0.0], 1), (6, [1.0, 0.0], 1), (7, [0.0, 1.0], 2), (10, [-1.0, 0.0], 1)]
    assert run(spark, zero) == brute(zero) and len(run(spark, zero)) > 0  # scores of nothing, and negative ones
    assert run(spark, [(5, [3e38, 1.0], 1), (6, [3e38, 1.0], 1), (7, [-3e38, 1.0], 2)]) == []


def test_intervals_hold_and_pass_over_some():
    rng = np.random.default_rng(0)
    import pyarrow as pa

    for dims in (64, 33, 256):
        x = np.floor(256 * rng.normal(0, 0.125, (500, dims))).astype(np.int64)
        codes, align = H.codes_of(x)
        t = pa.table({"label": np.zeros(500, np.int64), "id": np.arange(500), "row": np.arange(500), "x": [r.tobytes() for r in x.astype("<i4")], "code": [r.tobytes() for r in codes], "align": align})
        low, high = H._Anchors(x[:60]).between(slice(0, 60), H._Vectors(t, dims), slice(0, 500))
        exact = x[:60] @ x.T
        assert (low <= exact).all() and (exact <= high).all()
        own = exact.diagonal()
        assert (high[np.eye(60, 500) == 0] < 0.9 * np.repeat(own, 499)).mean() > 0.9  # far vectors are told from near ones
    assert (np.einsum("ij,ij->i", H.rotated(x), H.rotated(x)) == 256 * (x * x).sum(1)).all()
