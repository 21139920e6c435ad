import bisect
import hashlib
import random

import numpy as np
import pytest

from recollect.llm import spotsigs as ss


def docs_of():
    rng = random.Random(3)
    words = "the of and to house tree runs blue le der una ciel Baum naïve x1".split()
    rows = [(10, None), (9, ""), (40, "!!!"), (41, "lone"), (42, "the"), (43, "x " * 30_000), (44, "the cat of house " * 20_000)]
    rows += [(100 + 3 * i, " ".join(rng.choices(words, k=rng.randint(1, 300)))) for i in range(80)]
    return rows + [(1000, rows[20][1]), (1001, rows[20][1])]


@pytest.mark.parametrize("blocks", [1, 20])
def test_pairs_and_likeness(spark, blocks):
    rows = docs_of()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_chars int").repartition(5)
    got = {r.doc_id: r for r in ss.compare_with_edits(df, blocks=blocks).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        a, b, c = (set(x.tolist()) for x in ss.signature_sets([t, new, nxt]))
        jac = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert r.fingerprint == "".join(f"{x:08x}" for x in sorted(a)) and r.edited_fingerprint == "".join(f"{x:08x}" for x in sorted(b))
        assert (r.near_edited, r.near_next) == (jac(a, b), jac(a, c))
    assert got[1001].near_next == 1.0 and got[1000].fingerprint == got[1001].fingerprint


def brute_set(text):
    words = [w for w in ss._WORD.findall(text.lower())]
    anchors = [i for i, w in enumerate(words) if w in ss.ANCHORS]
    content = [i for i, w in enumerate(words) if w not in ss.ANCHORS]
    after = lambda i: content[(at := bisect.bisect_right(content, i)) : at + 2]
    return {(words[i], *[words[j] for j in after(i)]) for i in anchors}


def test_chains_are_those_of_the_definition():
    texts = [t for _, t in docs_of() if t and brute_set(t)][:40]
    sets = ss.signature_sets(texts)
    assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts]
    alone = [ss.signature_sets([t])[0] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(sets, alone, strict=True))


def test_pruned_likeness_is_exact_or_zero():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint32)) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert ss.likeness(a, b) == true
        for t in (0.1, 0.3, 0.8):
            assert ss.likeness(a, b, t) == (true if true >= t else 0.0)


def test_odd_tables(spark):
    one = spark.createDataFrame([(5, "the cat sat")], "doc_id long, text string")
    r = ss.compare_with_edits(one).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert ss.compare_with_edits(one.limit(0)).count() == 0
    ties = spark.createDataFrame([(5, "b"), (5, "a"), (None, "c"), (None, None)], "doc_id long, text string")
    assert ss.compare_with_edits(ties, blocks=3).count() == 4


def smallest_of_component(ids, sets):
    """Of each id the smallest that Jaccard links of 0.8 or more reach, by comparing all pairs."""
    root = dict(enumerate(range(len(ids))))
    moved = True
    links = [(i, j) for i in range(len(ids)) for j in range(i) if (sets[i] or sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) or sets[i] == sets[j]]
    while moved:
        moved = False
        for i, j in links:
            least = min(root[i], root[j])
            moved |= root[i] != root[j]
            root[i] = root[j] = least
    known = {}
    for k, r in root.items():
        if ids[k] is not None:
            known[r] = min(known.get(r, ids[k]), ids[k])
    return [known.get(root[k]) for k in range(len(ids))], len(links)


def near_corpus():
    rng = random.Random(11)
    anchors, words = sorted(ss.ANCHORS)[:20], [f"w{i}" for i in range(300)]
    out = [None, "", "the", "of house", "!!!"]
    for n in (8, 12, 40, 100, 300):
        for _ in range(8):
            text = [rng.choice(anchors) if k % 3 == 0 else rng.choice(words) for k in range(n)]
            out.append(" ".join(text))
            for part in (0.02, 0.03, 0.05, 0.1):  # copies from well above to well below the threshold, and copies of them
                text = [rng.choice(words) if k % 3 and rng.random() < part else w for k, w in enumerate(text)]
                out.append(" ".join(text))
    base = [rng.choice(anchors) if k % 3 == 0 else rng.choice(words) for k in range(90)]
    out += [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(90) if k % 3] * 3  # a long file of near copies
    rng.shuffle(out)
    return out


def test_classes_against_all_pairs(spark):
    texts = near_corpus()
    ids = [k if k % 50 else None for k in range(len(texts))]
    sets = [set(x.tolist()) for x in ss.signature_sets([t or "" for t in texts])]
    want, n = smallest_of_component(ids, sets)
    assert n > 5_000 and len(set(want)) > 40
    df = spark.createDataFrame([(i, t, 5) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, class_id int").repartition(6)
    got = ss.compare_with_edits(df).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == {i: w for i, w in zip(ids, want, strict=True) if i is not None}
    assert sorted(str(r.class_id) for r in got if r.doc_id is None) == sorted(str(w) for i, w in zip(ids, want, strict=True) if i is None)


def test_alike_sets_share_a_file():
    rng = np.random.default_rng(1)
    load = rng.integers(0, 9, 1 << 16)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 32, rng.integers(1, 400), dtype=np.uint64).astype(np.uint32))
        b = a.copy()[rng.random(len(a)) < 0.92]
        b = np.unique(np.r_[b, rng.integers(0, 1 << 32, rng.integers(0, 9), dtype=np.uint64).astype(np.uint32)])
        if ss.likeness(a, b) >= 0.8:
            owner, keys = ss.file_keys(ss.pa.array([a.tobytes(), b.tobytes()]), load)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_place():
    rng = np.random.default_rng(2)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 6, (12, 2))})
    for k in range(7):
        for h in range(7):
            got = ss._place(tuple(np.array(x) for x in zip(*edges, strict=True)), np.array([k, 3]), np.array([h, 3]))
            assert got[0] == sum(e <= (k, h) for e in edges) and got[1] == sum(e <= (3, 3) for e in edges)


@pytest.mark.parametrize("blocks", [1, 9])
def test_rows_without_ids_and_repeated_ids_follow_each_other(spark, blocks):
    rows = [(None, f"the word {i % 7} of x{i % 5}") for i in range(60)] + [(5, f"an other {i}") for i in range(60)] + [(9, "the end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ss.compare_with_edits(df, blocks=blocks).collect()
    shas = {r.edited_sha256 for r in got}
    assert len(got) == len(rows) and sum(r.doc_id == 5 for r in got) == 60
    texts = {t for _, t in rows}
    assert shas <= {hashlib.sha256(ss.edited(a, b).encode()).hexdigest() for a in texts for b in texts}


def test_plain_texts_are_split_as_others():
    every = "".join(chr(i) for i in range(0x300)) + " a_b ñ² ¼x"
    for text in (every, " ".join(every), "naïve e\u0301 ｆ"):
        assert ss.words_of(text) == ss._WORD.findall(text.lower())


def test_words_of_many_texts_are_hashed_at_once():
    rng = random.Random(5)
    pool = ["the", "The", "der", "naïve", "x1", "Straße", "ÿ²", "日本", "é", "İ", "a\x00b", "\ud800z", "w" * 3_000, "Ωμέγα", "a_b", "--", " ", "of"]
    texts = ["", "!!!", "the", "the the"] + [rng.choice(" \n.,").join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(400)]
    words = [ss.words_of(t) for t in texts]
    h, doc = ss.word_hashes(texts)
    assert doc.tolist() == [i for i, x in enumerate(words) for _ in x]
    flat, known = [w for x in words for w in x], {}
    for w, x in zip(flat, h.tolist(), strict=True):
        assert known.setdefault(w, x) == x and (x & 1) == (w in ss.ANCHORS)
    assert len(set(known.values())) == len(known) > 10
    assert np.array_equal(ss.word_hashes(["x " * (2 * ss._CHARS) + texts[-1]])[0][2 * ss._CHARS :], ss.word_hashes([texts[-1]])[0])
    assert [len(x) for x in ss.word_hashes(["", " "])] == [0, 0]
