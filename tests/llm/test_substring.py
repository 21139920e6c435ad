import random

import numpy as np
import pytest

from recollect.llm import substring_dedup as sd


def test_rolled_is_a_function_of_the_window():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for width in (1, 2, 3, 6, 30, 35, 64):
        got = sd.rolled(np.r_[h, h], width)
        assert len(got) == 401 - width
        assert (got[: 201 - width] == got[200 : 401 - width]).all()
        assert len(set(got[:200].tolist())) == 200
        assert np.array_equal(sd.least(h, width), np.lib.stride_tricks.sliding_window_view(h, width).min(1))


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "ß."]
    passages = [rng.choices(words, k=rng.randint(30, 90)) for _ in range(6)]
    texts = [None, "", " ", "a " * 34, "a " * 36, "b c " * 40, "long " + "x y z " * 2_000]
    for _ in range(n):
        w = rng.choices(words, k=rng.randint(1, 250))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            at = rng.randint(0, len(w))
            w[at:at] = p[a : a + rng.randint(20, 90)]
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    for i in range(20):
        w = texts[8 + i].split()
        w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    return texts + texts[8:14]


@pytest.mark.parametrize("shard_bytes", [20_000, 10_000_000])
def test_against_brute_force(spark, shard_bytes):
    texts = corpus(shard_bytes)
    want = sd.brute_force([t.encode() if t is not None else None for t in texts])
    assert sum(w[1] for w in want) > 1_000
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(6)
    from pyspark.sql import functions as F

    out = sd.strip_repeats(docs, shard_bytes=shard_bytes)
    assert out.columns[:3] == docs.columns
    got = out.select("doc_id", "__n_words", "__n_removed", F.sha2("__kept_text", 256)).collect()
    assert len(got) == len(texts)
    assert {r[0]: tuple(r[1:]) for r in got} == dict(enumerate(want))


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(40)))), (1, " ".join(map(str, range(40)))), (None, "x"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in sd.strip_digests(docs).collect())
    assert got == [(0, 1, 0), (1, 40, 40), (1, 40, 40), (3, 0, 0)]
    assert sd.strip_digests(docs.limit(0)).count() == 0


def test_many_equal_rows_and_edited_copies_spread_over_shards(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(90)]
    texts = ["same " + " ".join(base)] * 200
    for i in range(150):  # one anchor phrase, edited differently around it
        w = base.copy()
        for at in rng.sample(range(90), 2):
            w[at] = f"e{i}"
        texts.append(" ".join(w))
    want = sd.brute_force([t.encode() for t in texts])
    docs = spark.createDataFrame([(7 if i < 200 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = [tuple(r[1:]) for r in sd.strip_digests(docs).collect()]
    assert sorted(got) == sorted(want)
    from pyspark.sql import functions as F

    small = sd.strip_repeats(docs, shard_bytes=5_000).select("__n_words", "__n_removed", F.sha2("__kept_text", 256))
    assert sorted(map(tuple, small.collect())) == sorted(want)
