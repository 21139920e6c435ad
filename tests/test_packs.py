import random

from recollect.operators import graph
from recollect.plans import packs


def test_weights_of_asked_records_are_those_of_all(spark):
    rng = random.Random(4)
    links = spark.createDataFrame([(rng.randint(0, 60), rng.choice("abcdefgh") * rng.randint(1, 4)) for _ in range(300)], "obs_id long, name string")
    items = spark.createDataFrame([(i, "active" if i % 3 else "archived") for i in range(60)], "id long, status string")
    relations = spark.createDataFrame([(rng.randint(0, 60), rng.randint(0, 60), rng.choice(["caused", "implements"])) for _ in range(200)], "from_id long, to_id long, relation string")
    some = spark.createDataFrame([(i,) for i in range(0, 60, 7)], "id long")
    for every, asked in (
        (graph.comentions(links, items), graph.comentions(links, items, of=some)),
        (graph.relation_weight(relations), graph.relation_weight(relations, of=some)),
    ):
        want = {r.id: round(r.weight, 9) for r in every.collect() if r.id % 7 == 0 and r.id < 60}
        assert want and {r.id: round(r.weight, 9) for r in asked.collect()} == want


def test_no_text_goes_on_to_the_requests(spark):
    rows = packs._rows(spark, "/root/testdata/sf0.001")
    assert not {"title", "body"} & set(rows.columns) and "tokens" in rows.columns
    assert rows.count() == packs.p1_d2_candidates(spark, "/root/testdata/sf0.001").count() > 0
