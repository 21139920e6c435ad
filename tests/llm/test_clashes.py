"""Columns with the names that operators use themselves, null and repeated ids, ties, sketches turned off."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from recollect.llm import cotraining, language_id, near_texts, packing, set_links
from recollect.llm.common import Scratch, unused
from recollect.llm.components import components

NAMES = ["__lang_pred", "__score", "__rid", "__shard", "__n_words", "__n_removed", "__kept_text", "node", "root", "__id", "__t", "id", "t"]
REPEATED = " ".join(f"word{i}" for i in range(60))


def documents(spark):
    rng = random.Random(8)
    words = "the of and with this in for about".split()
    rows = [(i, " ".join(f"{rng.choice(words)} w{rng.randrange(4_000)}" for _ in range(60)), "en") for i in range(40)]
    rows += [(100, rows[0][1], "en"), (101, rows[1][1] + " more", "en"), (102, None, "en"), (103, "12 34", "en"), (None, " ".join(f"the n{i} of" for i in range(40)), "en")]
    rows += [(110 + i, f"{rows[5 + i][1]} {REPEATED} and {i}", "en") for i in range(2)]
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in NAMES])


def test_stages_keep_columns_of_any_name(spark):
    docs = scratch = Scratch(spark, "clash").save(documents(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Scratch(spark, "clash").save(stage(spark, docs, ""))
        assert docs.columns == scratch.columns, name
        for r in docs.collect():
            assert all(r[n] == f"{n} {'none' if r.doc_id is None else r.doc_id}" for n in NAMES), name
    left = {r.doc_id: r for r in docs.collect()}
    assert not {100, 101, 102, 103} & set(left) and set(range(40)) <= set(left) | {5, 6}
    assert all(left[i].n_chars == len(left[i].text) and "word30" not in left[i].text for i in left if i in (110, 111))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.agg(F.sum(F.when(F.col("start") == 0, F.col("doc_tokens")))).first()[0] == packed.agg(F.sum("length")).first()[0]
    assert unused(["A", "b_"], "a") == "a_" and unused(["b", "b_"], "b") == "b__"


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    rows = [(i, "the and of with" if i % 3 else "der und nicht ein", f"dirty{i}" if i % 5 == 0 else "en" if i % 3 else "de") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.train(docs, F.lit(True)).languages == ["de", "en"]


def test_packing_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "x " * 3_000), (7, "x " * 3_000), (7, ""), (8, None)], "doc_id long, text string")
    got = packing.pack(docs).collect()
    whole = {}
    for r in got:
        whole.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert sorted(whole[None]) == [(0, 3, 3)] * 2 and whole[8] == [(0, 1, 1)]
    firsts = [p for p in whole[7] if p[0] == 0]
    assert len(firsts) == 3 and sum(n for _, n, _ in whole[7]) == sum(t for *_, t in firsts)


def test_cotraining_with_clashing_columns_and_ties(spark):
    rows = [(i, "good text here" if i % 2 else "bad junk there", "en", "a" if i % 2 else "b", 14, i, "p", 0.5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int, prob string, score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 100)], "doc_id long, quality int, toxic int")
    plain = cotraining.classify(docs.select("doc_id", "text", "lang", "source", "n_chars"), labels)
    more = cotraining.classify(docs, labels.withColumn("text", F.lit("x")))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(more) == key(plain) and plain.count() == 400  # equal texts are ties everywhere


def test_sketches_can_be_turned_off(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([8, 24, 60]))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "x"]))]
    rows += [(500 + i, rows[0][1] + (" y" if i % 2 else "")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    roots = []
    for radius in (set_links.RADIUS, None):
        scratch = Scratch(spark, "sketch")
        filed = scratch.save(near_texts._filed(docs, "doc_id", "text", 5)).select("id", "size", "fp", "fp2", F.explode("keys").alias("key"))
        like = set_links.Likeness(lambda text: near_texts.shingles(text, 5), near_texts.LIKENESS, radius)
        links = set_links.links(filed, docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")), like, scratch)
        roots.append(sorted(map(tuple, components(links, scratch).collect())))
    assert roots[0] == roots[1] and len(roots[0]) > 100
