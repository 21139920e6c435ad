import random
import re
import zlib

import numpy as np

from recollect.llm import language_id as li

WORDS = {"en": "the of and with this tion", "de": "der und nicht über schön ein", "fr": "les une être où déjà dans"}


def rows(n=400):
    rng = random.Random(1)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(1, 40))), lang, "x"))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    odd = [(1000, None, "en", "x"), (1001, "", "en", "x"), (1002, "123 !?", "fr", "x"), (1003, "The AND of", None, "x"), (None, "der und nicht", "de", "x"), (1004, "les une \0 dans " * 90_000, "fr", "x")]
    docs = spark.createDataFrame(rows() + odd, "doc_id long, text string, lang string, score string").repartition(4)
    got = {r.doc_id: r for r in li.identify(docs).collect()}
    assert len(got) == 406
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[1003].lang_pred == "en" and got[None].lang_pred == "de" and got[None].held_out and got[1004].lang_pred == "fr"
    true = {i: lang for i, _, lang, _ in rows()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in true)
    held = [i for i in true if got[i].held_out]
    assert sum(got[i].lang_pred == true[i] for i in held) > 0.97 * len(held) and len(held) > 50
    kept = li.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() >= 400


def test_only_training_labels_count(spark):
    swapped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else g, s) for i, t, g, s in rows()]
    schema = "doc_id long, text string, lang string, score string"
    a = li.identify(spark.createDataFrame(rows(), schema)).collect()
    b = li.identify(spark.createDataFrame(swapped, schema)).collect()
    assert sorted(a) == sorted(b)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None, "")], "doc_id long, text string, lang string, score string")
    assert [tuple(r) for r in li.identify(docs).collect()] == [(1, False, "und", 0.0)] or li.identify(docs).first().lang_pred == "und"
    assert li.identify(docs.limit(0)).count() == 0


def test_long_texts_come_in_whole_pieces(monkeypatch):
    text = " ".join(random.Random(4).choices("abcdé 1", k=3_000))
    one = sorted(b for _, bs, _ in li.ngrams([text]) for b in bs)
    monkeypatch.setattr(li, "_CHARS", 97)
    assert sorted(b for _, bs, _ in li.ngrams([text]) for b in bs) == one


def spelled(text):
    """The n-grams of one text, read literally."""
    kept = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    kept = re.sub(" +", " ", kept)
    return [kept[i : i + n] for n in (1, 2, 3) for i in range(len(kept) - n + 1)]


def bucket_of(gram):
    h = 0
    for c in gram:
        h = (h * int(li._P) + ord(c)) & (1 << 64) - 1
    h = ((h + len(gram)) * int(li._P)) & (1 << 64) - 1
    return ((h ^ (h >> 29)) * int(li._P) & (1 << 64) - 1) >> (64 - li.BUCKET_BITS)


def test_scores_are_a_function_of_the_text(monkeypatch):
    rng = random.Random(7)
    texts = ["xyz", "", None, "a", "\0", "Ünder the tree"] + ["".join(rng.choices("abc é1", k=rng.randint(0, 400))) for _ in range(60)]
    model = li.Model(["p", "q"], np.log(np.random.default_rng(0).random((1 << li.BUCKET_BITS, 2))), np.log([0.3, 0.7]))
    for size in (1, 50, 97, 1 << 19):
        monkeypatch.setattr(li, "_CHARS", size)
        alone = np.concatenate([model.scores([t]) for t in texts])
        assert (model.scores(texts) == alone).all() and (model.scores(texts[::-1])[::-1] == alone).all()
        for t, p in zip(texts, alone, strict=True):
            logs = model.log_prior + sum((model.log_prob[bucket_of(g)] for g in spelled((t or "").replace("\0", " "))), np.zeros(2))
            assert np.allclose(p, np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum())


def test_against_brute_force_naive_bayes(spark):
    data = rows(150) + [(900, "equal", "aa", "x"), (901, "equal", "bb", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    usable = [(t, g) for i, t, g, _ in data if zlib.crc32(str(i).encode()) % 4 != 2]
    langs = sorted({g for _, g in usable})
    counts = {g: np.ones(1 << li.BUCKET_BITS) for g in langs}
    for t, g in usable:
        for gram in spelled(t):
            counts[g][bucket_of(gram)] += 1
    want = {}
    for i, t, _, _ in data:
        at = [bucket_of(g) for g in spelled(t)]
        logs = np.array([np.log(sum(g == x for _, x in usable) / len(usable)) + np.log(counts[g][at] / counts[g].sum()).sum() for g in langs])
        p = np.exp(logs - logs.max())
        want[i] = (langs[int(p.argmax())], (p / p.sum()).max())
    for parts in (1, 7):
        for r in li.identify(docs.repartition(parts)).collect():
            assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-9


def test_equal_probabilities_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "same words", "b", ""), (4, "same words", "a", "")], "doc_id long, text string, lang string, score string")
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 4)] == [False, False]
    assert {(r.lang_pred, round(r.score, 12)) for r in li.identify(docs).collect()} == {("a", 0.5)}
