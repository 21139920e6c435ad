import random

from recollect.operators import evaluate


def pairs(spark, texts, leads):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    phrases = spark.createDataFrame(list(enumerate(leads)), "query_id long, lead string")
    got = [(r.query_id, r.id) for r in evaluate.containing(docs, phrases).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_phrases_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["La", "la", "Of", "Office", "x", "", "ΟΔΟΣ", "İz", "a-b", "tab\tbed", "(La", "Lala", "é"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    texts = [text(rng.randint(0, 12)) for _ in range(150)] + ["", " ", None, "Σ", "xΟΔΟΣΑ"]
    leads = [text(rng.randint(1, 4)) for _ in range(80)] + ["L", "f", "ffi", "fic", "a L", "e O", "", " ", "  ", None, "ΟΔΟΣ", "Σ", "--", "b\tb"]
    want = {(q, i) for q, lead in enumerate(leads) for i, t in enumerate(texts) if lead is not None and t is not None and lead in t}
    assert pairs(spark, texts, leads) == want


def test_short_phrases_cut_each_distinct_piece_once(spark, monkeypatch):
    """A thousand documents of the same five words: what is cut into parts is five rows, not five thousand."""
    seen, cut = [], evaluate._short_phrases
    monkeypatch.setattr(evaluate, "_short_phrases", lambda words, phrases: seen.append(words.count()) or cut(words, phrases))
    found = pairs(spark, ["one two three four five"] * 1000, ["hre", "two th", "nothing"])
    assert seen == [5] and len(found) == 2000
