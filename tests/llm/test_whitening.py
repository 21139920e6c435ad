import numpy as np
import pytest

from recollect.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, x string, h string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA)


def brute(rows, weights):
    """{row number: (deviation, [whitened])}, n, explained, by plain numpy."""
    x = np.array([np.floor(256 * np.float32(v).astype(float)) for _, v in rows], np.int64)
    u, counts = np.unique(x, axis=0, return_counts=True)
    w = counts if weights == "count" else np.ones(len(u), np.int64)
    n, s = int(w.sum()), w @ u
    c = u - s / n
    e, a = np.linalg.eigh((c * w[:, None]).T @ c / n)
    e, a = e[::-1][:4], a[:, ::-1][:, :4]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ a / np.sqrt(e), e / np.trace((c * w[:, None]).T @ c / n)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_equals_brute_force_with_a_hot_vector(spark, weights):
    rng = np.random.default_rng(1)
    hot = rng.normal(0, 0.2, 12).astype(np.float32).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(0, 0.1 + 0.05 * (np.arange(12) % 5)).astype(np.float32).tolist()) for i in range(2_000)]
    rows += [(5, rows[5][1]), (None, rows[7][1])]  # a repeated row, a row without an id
    odd = [(9_000, None), (9_001, [None, *hot[1:]]), (9_002, [float("nan"), *hot[1:]]), (9_003, [float("inf"), *hot[1:]]), (9_004, hot[:5]), (9_005, [])]
    got = whitening.whiten(table(spark, rows + odd).repartition(7), weights=weights).toPandas()
    assert len(got) == 4 * len(rows) and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    n, deviation, whitened, explained = brute(rows, weights)
    assert set(got.n) == {n}
    assert got.vec_id.isna().sum() == 4 and (got.vec_id == 5).sum() == 8
    for k in range(4):
        mine = got[(got.component == k + 1) & got.vec_id.notna()].drop_duplicates("vec_id").set_index("vec_id").loc[range(2_000)]
        assert mine.deviation.tolist() == deviation[:2_000].tolist()
        y = whitened[:2_000, k] * np.sign(whitened[:2_000, k] @ mine.whitened)
        assert np.abs(y - mine.whitened).max() < 1e-9
        assert abs(mine.explained.iloc[0] - explained[k]) < 1e-12


def test_flat_and_empty_tables(spark):
    none = table(spark, [(1, [1.0, 2.0])])
    assert whitening.whiten(none.limit(0)).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [None])])).count() == 0
    assert whitening.whiten(table(spark, [(1, []), (2, [])])).count() == 0
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.n_rows) for r in one) == [(i, k, 1, 0, None, None, 2) for i in (1, 2) for k in (1, 2)]
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])).collect()
    by = {(r.vec_id, r.component): r for r in line}
    assert len(by) == 15 and by[0, 2].whitened is None and by[0, 3].whitened is None and abs(by[0, 1].explained - 1) < 1e-9
    assert abs(abs(by[4, 1].whitened) - np.sqrt(2)) < 1e-9 and by[0, 1].identity_error < 1e-9


def test_sums_are_exact_beyond_64_bits(spark):
    rows = [(0, [1e9, -3e9]), (1, [3e38, 5.0]), (2, [-2e9, 7.0]), (3, [0.0, 1.0])]
    got = {r.vec_id: r for r in whitening.whiten(table(spark, rows), components=1).collect()}
    from recollect.llm.vectors import largest

    most = largest(2)
    x = [[int(max(-most, min(most, np.floor(256 * float(np.float32(c)))))) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    for i in range(4):
        exact = sum((4 * a - b) ** 2 for a, b in zip(x[i], s))
        assert int(got[i].wide_deviation) == exact and got[i].deviation == (exact if exact < 1 << 63 else None)
