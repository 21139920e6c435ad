import random

import corpus_pipeline
from recollect.llm import near_texts
from recollect.llm.common import Scratch

WORDS = {"en": "the of and with this tion", "de": "der und nicht über schön ein"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def likeness(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def planted(n=60):
    """Texts of 120 words with copies of 5-word likeness from under 0.8 to 0.95, and one chain of copies of copies."""
    rng = random.Random(3)
    word = lambda lang: rng.choice(WORDS[lang].split()) + str(rng.randrange(5_000))
    out = []

    def copied(words, lang, changes):
        words = list(words)
        for at in rng.sample(range(len(words)), changes):
            words[at] = word(lang)
        return words

    for i in range(n):
        lang = "en" if i % 3 else "de"
        words = [word(lang) for _ in range(120)]
        out += [(words, lang), (copied(words, lang, 1 + i % 5), lang)]
    for _ in range(6):
        words = copied(words, lang, 2)
        out.append((words, lang))
    texts = [(" ".join(w), lang) for w, lang in out]
    rng.shuffle(texts)
    return [(i, text, lang, "s", len(text)) for i, (text, lang) in enumerate(texts)]


def smallest_of_component(rows):
    root = {r[0]: r[0] for r in rows}
    links = [(a[0], b[0]) for k, a in enumerate(rows) for b in rows[:k] if likeness(a[1], b[1]) >= 0.8]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            least = min(root[a], root[b])
            moved |= root[a] != root[b]
            root[a] = root[b] = least
    return {i for i, r in root.items() if i == r}, links


def test_run_drops_what_brute_force_drops(spark, tmp_path):
    rows = planted()
    kept, links = smallest_of_component(rows)
    close = [likeness(rows[a][1], rows[b][1]) for a, b in links]
    assert min(close) < 0.85 and max(close) > 0.9 and len(rows) - len(kept) > 30 and len(kept) > 70
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert got == kept


def test_odd_rows_and_a_large_group(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base[:k], "x" + str(i), *base[k + 1 :]])) for i, k in enumerate(rng.choices(range(60), k=300))]
    odd = [(1000, None), (1001, ""), (1002, " \t"), (1003, "Two Words"), (1004, "two  words"), (None, rows[0][1]), (None, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(5)
    kept, links = smallest_of_component(rows)
    assert len(links) > 1_000
    got = [r.doc_id for r in near_texts.drop_near_copies(docs).collect()]
    assert sorted(i for i in got if i is not None) == sorted(kept | {1000, 1003})
    assert got.count(None) == 2
    found = near_texts.near_links(docs.filter("doc_id < 1000"), Scratch(spark, "test"))
    allowed = {(min(x), max(x)) for x in links}
    assert {(r.u, r.v) for r in found.collect()} <= allowed


def test_run_on_odd_rows_repeats_and_nothing(spark, tmp_path):
    rng = random.Random(8)
    word = lambda lang: rng.choice(WORDS[lang].split()) + str(rng.randrange(5_000))
    rows = [(i, " ".join(word("de" if i % 2 else "en") for _ in range(60)), "de" if i % 2 else "en", "s", 400) for i in range(40)]
    shared = " ".join(f"the{k} of{k}" for k in range(30))
    rows += [(100 + i, f"{' '.join(word('en') for _ in range(400))} {shared}", "en", None, None) for i in range(3)]  # a passage of 60 words in three texts
    rows += [(200, None, "en", "s", 0), (201, "", "de", "s", 0), (202, "12 !?", None, None, None), (None, rows[0][1], "en", "s", 1), (5, rows[5][1], "de", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id: r.doc_tokens for r in pieces}
    assert set(kept) == {*range(40), 100, 101, 102}  # no letters, no id, no second copy
    passage = len(shared.split())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    cut = {r.doc_id: r for r in corpus_pipeline.passages(spark, docs, str(tmp_path)).collect()}
    before = {r[0]: r[1] for r in rows if r[0] is not None and r[1]}
    for i in kept:
        gone = passage if i >= 100 else 0
        assert cut[i].text.split() == before[i].split()[: len(before[i].split()) - gone]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
