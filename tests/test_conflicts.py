from recollect.operators import similarity


def test_bodies_without_terms_conflict_with_nothing(spark):
    texts = ["", "a b c", None, "?? !!", "alpha beta gamma delta", "alpha beta gamma delta zeta"]
    rows = [(i, "p", "decision", "active", 0, None if t is None else t[:60], t) for i, t in enumerate(texts)]
    items = spark.createDataFrame(rows, "id long, project_id string, kind string, status string, updated_at int, title string, body string")
    got = {r.id: (r.rival, r.overlap) for r in similarity.body_conflicts(items, items).collect()}
    assert {i: r for i, (r, _) in got.items()} == {4: 5, 5: 4}
    assert 0.3 < got[5][1] < got[4][1] < 1.0
