import random
import zlib

import numpy as np
import pytest

from recollect.llm import rans, token_streams

ODD = ["", None, "a", " a  b\n", "Hello, World's x_y 12a", "naïve Straße ΟΔΟΣ İI", "don't we'll", "<|endoftext|> x", "\x1c a\x1cb", "a\x85b c d　e", "e ́x ́", "word " * 9_000, "x" * 30_000, "(a) ...b, c.,", "日本語。12"]


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_streams.tokenizer_path())
    t.encode_special_tokens = True
    return [x.ids + [2] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 3) for i, t in rows], "doc_id long, text string, start int, row string, n int")


def test_words_are_spelled_as_the_tokenizer_does(monkeypatch):
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choices("abST'st 1!,._²\n\té́ İΣǅ\x1cß中", k=rng.randint(1, 60))) for _ in range(2_000)]
    for limit in (80_000, 40):
        monkeypatch.setattr(token_streams, "_WORDS", limit)
        model = token_streams.Speller(token_streams.tokenizer_path())
        got = [x for i in range(0, len(texts), 50) for x in model.of(texts[i : i + 50])]
        assert [np.frombuffer(x, model.kind).tolist() + [2] for x in got] == whole(texts)


def test_coding_is_exact():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 1_000, 70_001):
        ids = np.minimum(rng.zipf(1.3, n), 9_999).astype(np.uint32)
        t = rans.Table.from_bytes(rans.Table.from_counts(np.bincount(ids, minlength=10_000)).to_bytes())
        state, words = t.encode(ids)
        assert (t.decode(state, words, n) == ids).all()
        if n > 50_000:
            p = np.bincount(ids)[np.unique(ids)] / n
            assert 8 * len(state) + 4 * len(words) < 1.12 * -(p * np.log2(p)).sum() * n / 8
            words[100] ^= 1
            with pytest.raises(ValueError):
                bad = t.decode(state, words, n)
                raise ValueError if (bad != ids).any() else AssertionError
    for a, b in ((b"", b""), (b"abc", b""), (b"", b"abc"), (b"abc" * 99, bytes(1_000))):
        assert rans.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def check(docs, rows, **how):
    got = token_streams.digests(docs, **how).collect()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    expected, at = [], 0
    for i, ids in zip(order, whole([rows[i][1] for i in order]), strict=True):
        expected.append((rows[i][0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r.start) == expected


@pytest.mark.parametrize(("block", "files"), [(1 << 18, None), (500, 5), (7, 3)])
def test_files_give_back_every_document(spark, block, files):
    rng = random.Random(2)
    words = ["the", "Of", "zebra,", "naïve", "x.\n", "12"]
    texts = ODD if block > 7 else ODD[:10]
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts)] + [(1_000 - i, " ".join(rng.choices(words, k=rng.randint(0, 300)))) for i in range(200)]
    rows += [(4, "again"), (4, "again"), (4, "and again"), (None, "no name"), (None, None), (1 << 60, "far")]
    check(table(spark, rows).coalesce(1), rows, block_tokens=block, files=files)


def test_ids_come_back_and_empty_tables(spark):
    docs = table(spark, [(2, "two words"), (1, "one " * 400)])
    pieces = token_streams.write_and_read(docs, block_tokens=64, with_ids=True).collect()
    ids = b"".join(p.ids for p in sorted(pieces, key=lambda p: p.start))
    assert np.frombuffer(ids, "<u4").tolist() == [x for t in whole(["one " * 400, "two words"]) for x in t]
    assert token_streams.digests(docs.limit(0)).count() == 0


def test_damaged_blocks_are_told(spark):
    model = token_streams.speller(token_streams.tokenizer_path())
    ids = np.frombuffer(model.of(["some words of a text " * 50])[0], model.kind)

    class Out(list):
        def write(self, x):
            self.append(bytes(x))

        def tell(self):
            return sum(map(len, self))

    t, out = rans.Table.from_counts(np.bincount(ids)), Out()
    w = token_streams._Writer(out, t, 1, 1_000)
    w.add(7, ids)
    w.flush()
    at, size, _, _, crc, _ = w.checkpoints[0]
    data = b"".join(out)[at : at + size]
    assert (token_streams.read_block(data, t, crc)[0] == ids).all()
    for i in (0, 8, len(data) - 3):
        with pytest.raises(ValueError):
            token_streams.read_block(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :], t, crc)
