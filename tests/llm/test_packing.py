import random
import zlib
from collections import defaultdict

import numpy as np

from recollect.llm import packing

ODD = ["", None, "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \n b", "\n", "\t a\tb ", "don't  stop\r\nnow", "x y   z", "é ñ ß 12a3 !!?", "<|endoftext|> x", "word " * 9_000, "\x1c a\x1c b", "a\x85 b"]


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_tokenizers(monkeypatch):
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choices("ab'st 1!\n\té ", k=rng.randint(1, 60))) for _ in range(3_000)]
    for limit in (400_000, 50):
        monkeypatch.setattr(packing, "_WORDS", limit)
        model = packing.Ids(packing.tokenizer_path())
        got = [x for i in range(0, len(texts), 100) for x in model.of(texts[i : i + 100])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == whole(texts)


def check(rows, texts, capacity=1_024):
    ids = dict(zip(texts, [x + [0] for x in whole([t or "" for t in texts.values()])], strict=True))
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seqs[r.sequence_id].append((r.offset, r.length, r.padded_length))
        docs[r.doc_id].append((r.start, r.length))
    for k in (seqs, docs):
        for parts in k.values():
            at = 0
            for p in sorted(parts):
                assert p[0] == at
                at += p[1]
    assert {d: sum(n for _, n in p) for d, p in docs.items()} == {d: len(x) for d, x in ids.items()}
    padding = 0
    for parts in seqs.values():
        total = sum(p[1] for p in parts)
        assert total <= capacity and parts[0][2] == (total if total & (total - 1) == 0 else capacity)
        padding += parts[0][2] - total
    return padding / sum(map(len, ids.values()))


def test_pieces_tile_documents_and_sequences(spark):
    rng = random.Random(2)
    words = ["the", "Of", "zebra,", "naïve", "x.\n", "12"]
    texts = dict(enumerate(ODD)) | {100 + i: " ".join(rng.choices(words, k=rng.randint(1, 3_000))) for i in range(300)}
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, start int")
    assert check(packing.pack(docs.repartition(3)).collect(), texts) < 0.01
    assert packing.pack(docs.limit(0)).count() == 0


def test_cuts():
    for n in range(1, 5_000):
        assert sum(packing.cuts(n)) == n and max(packing.cuts(n)) <= 1_024


def test_kept_spellings_are_not_asked_for_again(monkeypatch):
    asked, real = [], packing._Spelled._of
    monkeypatch.setattr(packing._Spelled, "_of", lambda self, core, spell: asked.append(core) or real(self, core, spell))
    texts = ["a word word, word. naïve naïve, wörd, " + "word? " * 9 + "x"]
    model = packing.Ids(packing.tokenizer_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in model.of(texts)] == whole(texts)
    assert len(asked) == len(set(asked)) and " word" in asked
