import random
import time
import zlib

import numpy as np
import pytest

from recollect.llm import sentence_pieces as sp


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Pieces(sp.model_path(), 4)


def brute(v, text):
    """All segmentations of a short text, cheapest first."""
    text = "▁" + text.replace(" ", "▁")
    done = {0: [(0, ())]}
    for j in range(1, len(text) + 1):
        done[j] = []
        for i in range(j):
            if found := v.cost_of.get(text[i:j]):
                done[j] += [(c + found[0], (*x, found[1])) for c, x in done[i]]
            elif j == i + 1:
                spelled = [v.byte[b] for b in text[i].encode()]
                done[j] += [(c + sum(s[0] for s in spelled), (*x, *(s[1] for s in spelled))) for c, x in done[i]]
    return sorted(done[len(text)])


def test_n_best_against_all_segmentations(vocabulary):
    rng = random.Random(0)
    texts = ["a", " ", "the end", "é\nx", "a  b,c", "日x", "hello,"] + ["".join(rng.choices("tehan ,.\n", k=rng.randint(1, 11))) for _ in range(150)]
    for t in texts:
        everything = brute(vocabulary, t)
        got = vocabulary.encode(t)
        assert [c for c, _ in got] == [c for c, _ in everything[:4]]
        known = set(everything)
        ids = [(c, tuple(np.frombuffer(x, "<u4").tolist())) for c, x in got]
        assert len(set(ids)) == len(ids) and set(ids) <= known


def test_decoding_gives_texts_back(vocabulary):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sp.model_path())
    for t in ("", "Hello  world\n x é ａ ﬁ ", " lead", "日本 \t語", "x" * 3_000):
        for _, ids in vocabulary.encode(t):
            assert vocabulary.decode(ids) == t
        assert vocabulary.decode(library.encode(t)) == t


def test_operators(spark, vocabulary):
    rows = [(1, "Hello world of words"), (2, None), (3, ""), (None, "a\nb"), (1, "word " * 9_000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, ids int")
    out = sp.decode(sp.encode(df, best=4)).collect()
    texts = {(i, t or "") for i, t in rows}
    assert {(r.doc_id, r.decoded) for r in out} == texts
    for r in out:
        cost, ids = vocabulary.encode(r.decoded)[r.rank]
        assert np.frombuffer(ids, "<u4").tolist() == r.ids and r.log_prob == -cost / sp.SCALE
    digests = sp.encode_digests(df, best=4).collect()
    assert len(digests) == 5 and all(r.decodes for r in digests)
    first = {(r.doc_id, r.decoded): r.ids for r in out if r.rank == 0}
    assert sorted(r.ids_crc32[0] for r in digests) == sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in first.values())
    assert sp.encode(df.limit(0)).count() == 0


def test_long_words_are_searched_like_others(vocabulary, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abtehn日é", k=rng.randint(180, 260))) for _ in range(12)] + ["ab " * 50 + "q" * 300 + " the end"]
    got = vocabulary.encode_all(texts)
    monkeypatch.setattr(sp, "_LONG", 100_000)
    other = sp.Pieces(sp.model_path(), 4).encode_all(texts)
    assert [[c for c, _ in x] for x in got] == [[c for c, _ in x] for x in other]
    for found, t in zip(got, texts, strict=True):
        assert len({x for _, x in found}) == 4 and all(vocabulary.decode(x) == t for _, x in found)
        cost = {i: c for c, i in vocabulary.cost_of.values()} | {i: c for c, i in vocabulary.byte.values()}
        assert all(c == sum(cost[i] for i in np.frombuffer(x, "<u4").tolist()) for c, x in found)


def test_a_word_without_end_takes_time_in_proportion(vocabulary):
    rng = random.Random(6)
    took = {}
    for n in (20_000, 200_000):
        text = "".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=n))
        began = time.process_time()
        found = vocabulary.encode(text)
        took[n] = time.process_time() - began
        assert len(found) == 4 and vocabulary.decode(found[3][1]) == text
    assert took[200_000] < 20 * max(took[20_000], 0.05)


def test_ties_depend_on_the_text_alone(vocabulary):
    texts = ["x" * 40, "aaaa bbbb", "xx xx xx xx", "日日日日", "x" * 40]
    alone = [sp.Pieces(sp.model_path(), 4).encode(t) for t in texts]
    assert any(a[0][0] == a[1][0] or a[1][0] == a[2][0] for a in alone)
    for order in (texts, texts[::-1], ["y " * 30, *texts]):
        got = dict(zip(order, sp.Pieces(sp.model_path(), 4).encode_all(order), strict=True))
        assert [got[t] for t in texts] == alone
    vocabulary.encode("x" * 39)
    assert [vocabulary.encode(t) for t in texts] == alone
