import random

import numpy as np
import xxhash

from recollect.llm import cotraining as ct
from recollect.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality int"


def corpus(n=500):
    rng = random.Random(0)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randint(3, 60))
        text = " ".join(words) if good else " ".join(w.upper() + rng.choice(["!!", "###"]) for w in words)
        source = f"s{rng.randrange(3) if rng.random() < 0.8 else int(good) + 5}"
        docs.append((i, text, "en", source, len(text), 9))
        labels.append((i, int(good), None))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(None, "alpha beta", None, None, None, 1), (9001, None, None, None, None, 1), (9002, "", "en", "s", 0, 1), (9003, "BETA!! " * 60_000, "en", "s", 1, 1)]
    odd += [(9004, "twice BETA!!", "en", "s", 1, 1)] * 3_000  # an id that is repeated very often, and labelled
    df = spark.createDataFrame(docs + odd, SCHEMA).repartition(4)
    seen = spark.createDataFrame([x for x in labels if x[0] % 2] + [(9004, 0, None), (None, 1, None), (1, None, None)], "doc_id long, quality int, toxic int")
    got = ct.classify(df, seen).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 9004}) == 1
    truth = {i: q for i, q, _ in labels if i % 2 == 0}
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].quality_pred == q for i, q in truth.items()]) > 0.95
    assert np.mean([by[i].score for i, q in truth.items() if q]) - np.mean([by[i].score for i, q in truth.items() if not q]) > 0.6


def test_no_labels_and_no_rows(spark):
    docs, labels = corpus(20)
    df = spark.createDataFrame(docs, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in ct.classify(df, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i, _, _ in labels], "doc_id long, quality int")
    assert all(r.quality_pred == 1 for r in ct.classify(df, ones).collect())
    assert ct.classify(df.limit(0), none).count() == 0


def dense(x, n, columns):
    out = np.zeros((n, columns))
    np.add.at(out, (x[0], x[1]), np.float32(x[2]).astype(float))
    return out


def brute(docs, labels, rounds):
    """Co-training by lists, with every document that a view is sure enough of."""
    n = len(docs)
    views = [
        dense(ct.content_features([d[1].encode() for d in docs]), n, ct.CONTENT),
        dense(ct.meta_features([d[3] for d in docs], [d[2] for d in docs], [len(d[1]) for d in docs]), n, ct.META),
    ]

    def fit(x, y, weight):
        at = np.nonzero(x)
        return ct.fit_logistic((at[0], at[1], x[at]), np.array(y, float), np.array(weight), x.shape[1])

    y = dict(labels)
    place = {d[0]: k for k, d in enumerate(docs)}
    held = [i for i in sorted(y) if xxhash.xxh32_intdigest(str(i)) % 4 == 0]
    own = [i for i in sorted(y) if i not in held]
    share = np.mean([y[i] for i in own])
    pool = [k for k, d in enumerate(docs) if d[0] not in y]
    taught = [{}, {}]
    for turn in range(rounds + 1):
        w = []
        for v, x in enumerate(views):
            rows = [place[i] for i in own] + sorted(taught[v])
            w.append(fit(x[rows], [y[i] for i in own] + [taught[v][k] for k in sorted(taught[v])], [1.0] * len(own) + [0.5] * len(taught[v])))
        if turn == rounds:
            break
        for v, x in enumerate(views):
            z = x @ w[v][:-1] + w[v][-1]
            low, high = (np.quantile(z[pool], q, method="inverted_cdf") for q in (ct.MARKED * (1 - share), 1 - ct.MARKED * share))
            for k in pool:
                if z[k] >= max(high, np.log(9)):
                    taught[1 - v][k] = 1
                elif z[k] <= min(low, -np.log(9)):
                    taught[1 - v][k] = 0
    z = [x @ u[:-1] + u[-1] for x, u in zip(views, w, strict=True)]
    rows = [place[i] for i in held]
    cal = [ct.fit_logistic(ct._dense([a[rows]]), np.array([y[i] for i in held], float), np.ones(len(held)), 1, 1e-3) for a in z]
    ready = [c[0] * a + c[1] for c, a in zip(cal, z, strict=True)]
    mix = ct.fit_logistic(ct._dense([r[rows] for r in ready]), np.array([y[i] for i in held], float), np.ones(len(held)), 2, 1e-3)
    return 1 / (1 + np.exp(-(mix[0] * ready[0] + mix[1] * ready[1] + mix[2]))), [len(t) for t in taught]


def test_against_brute_force(spark):
    docs, labels = corpus(240)
    docs = [(i, f"{t} n{i}", *rest) for i, t, *rest in docs]  # no two rows alike
    some = [(i, q) for i, q, _ in labels if i % 3 == 0]
    want, taught = brute(docs, some, 2)
    assert min(taught) > 5
    scratch = Scratch(spark, "test")
    features = ct.featurise(spark.createDataFrame(docs, SCHEMA).repartition(3), scratch)
    model = ct.train(features, spark.createDataFrame(some, "doc_id long, quality int"), scratch, marks=10**6, rounds=2)
    got = {r.doc_id: r.score for r in ct.score(features, model).collect()}
    assert np.allclose([got[d[0]] for d in docs], want, atol=1e-6)
