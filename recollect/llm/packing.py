"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds what fits a sequence k times, and a bin of class k takes
exactly k pieces, so a worker fills bins class by class without looking at any other worker or at other bins.
Plain harmonic bins waste up to half a sequence on lengths just above a reciprocal. As documents may be cut, a
remainder first gives off its halves of the capacity (512, 256, ... of 1024), which fill the bins of their class without
padding; only what is shorter than ``min_cut`` goes into a class by its own length, where a bin wastes less than one
such piece. Bins that a worker has left over at its end are filled up together, longest pieces first.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import kept_on_worker

CAPACITY = 1_024
MIN_CUT = 64
#: Spellings that a worker keeps of words as they stand, and of words without the marks after them.
_WORDS, _CORES = 80_000, 350_000
#: Marks that may follow a word; the vocabulary never merges them with letters.
_MARKS = ".,;:!?*#$%&|)"
#: Texts and characters taken at once.
_CHARS = 4_000_000
_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
)


class _Spelled(dict):
    """Ids of words with ``space`` before them; None for a word that can't be spelled by itself."""

    def __init__(self, space: str, cores: dict[str, bytes], merge, encode) -> None:
        self.space, self.cores, self.merge, self.encode = space, cores, merge, encode

    def __missing__(self, word: str) -> bytes | None:
        if len(self) >= _WORDS:
            self.clear()
        core = word.rstrip(_MARKS)
        if core.isalpha():
            value = self.cores.get(self.space + core) or self._of(self.space + core, self.merge)
            if len(core) < len(word):
                marks = word[len(core) :]
                value += self.cores.get(marks) or self._of(marks, self.encode)
        elif not word or word[-1].isspace() or not self.space and word[0].isspace():
            value = None
        else:
            value = self.encode(self.space + word)
        self[word] = value
        return value

    def _of(self, core: str, spell) -> bytes:
        if len(self.cores) >= _CORES:
            self.cores.clear()
        found = self.cores[core] = spell(core)
        return found


class Ids:
    """Token ids of whole texts, spelled word by word.

    The vocabulary splits text before merging: a word with the one space before it, or a line break between words, is
    never merged with what stands around it. So a text's ids are those of its words in turn, and each distinct word is
    given to the tokenizer once. Texts where white space doesn't separate words singly are given to it whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.merges = self.model.model
        # how the vocabulary writes bytes: printable ones as themselves, the others from U+0100 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self._shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self._space, self._tokenize = self._shown[32], self.merges.tokenize
        self._packed = [array("I", [i]).tobytes() for i in range(max(self.model.get_vocab().values()) + 1)]
        if any(self._merge(x) != self._whole(x) for x in (" word", "naïve", " Straße", "日本語")):
            raise ValueError("this tokenizer doesn't merge the bytes of words")
        cores: dict[str, bytes] = {}
        self.first, self.later = (_Spelled(space, cores, self._merge, self._whole) for space in ("", " "))
        self.line = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def _merge(self, word: str) -> bytes:
        """Ids of letters, with or without a space before them: the merges alone, as there is nothing to split."""
        shown = word.replace(" ", self._space) if word.isascii() else word.encode().decode("latin-1").translate(self._shown)
        packed = self._packed
        return b"".join([packed[x.id] for x in self._tokenize(shown)])

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        first, later = self.first.__getitem__, self.later.__getitem__
        out = []
        for t in texts:
            try:
                lines = (line.split(" ") for line in t.split("\n"))
                out.append(self.line.join([b"".join([first(x[0]), *map(later, x[1:])]) for x in lines]))
            except TypeError:  # a word that can't be spelled by itself
                out.append(self._whole(t))
        return out


_kept: dict[str, Ids] = {}
kept_on_worker.append(_kept.clear)


def ids_for(path: str) -> Ids:
    """The worker's speller, kept from task to task."""
    if path not in _kept:
        _kept[path] = Ids(path)
    return _kept[path]


def cuts(tokens: int, capacity: int = CAPACITY, min_cut: int = MIN_CUT) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    out = [capacity] * (tokens // capacity)
    rest, half = tokens % capacity, capacity // 2
    while half >= min_cut:
        if rest >= half:
            out.append(half)
            rest -= half
        half //= 2
    return out + [rest] * (rest > 0)


class Bins:
    """The open bins of one worker. ``place`` gives (sequence, offset) of a piece as soon as its bin is full."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[tuple[int, int]]] = {}  # class -> (piece, length)

    def _close(self, pieces: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
        filled = sum(n for _, n in pieces)
        padded = filled if filled & (filled - 1) == 0 else self.capacity
        at = 0
        for piece, n in pieces:
            yield piece, self.next, at, padded
            at += n
        self.next += 1

    def place(self, piece: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        k = self.capacity // n
        bin_ = self.open.setdefault(k, [])
        bin_.append((piece, n))
        if len(bin_) == k:
            yield from self._close(self.open.pop(k))

    def rest(self) -> Iterator[tuple[int, int, int, int]]:
        left = sorted(chain.from_iterable(self.open.values()), key=lambda x: -x[1])
        while left:
            taken, over, room = [], [], self.capacity
            for x in left:
                if x[1] <= room:
                    taken.append(x)
                    room -= x[1]
                else:
                    over.append(x)
            yield from self._close(taken)
            left = over


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    min_cut: int = MIN_CUT,
    end_id: int = 0,
) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence.

    A document's tokens are those of its whole text, then ``end_id``; a null or empty text has that one token.
    Sequences hold at most ``capacity`` tokens; ``padded_length`` is what the sequence is padded to. A worker packs
    its own documents, so repeated rows and ties need no rule, null ids are carried along, and an empty table gives
    no pieces. Other columns don't matter.
    """
    path = tokenizer or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = ids_for(path)
        bins = Bins(capacity, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33)
        waiting: dict[int, tuple] = {}  # piece -> its row so far
        pieces = 0

        def ready(found: Iterator[tuple[int, int, int, int]]) -> list[tuple]:
            return [(*waiting.pop(p), s, at, padded) for p, s, at, padded in found]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = [x.split()[0] for x in _PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            start = 0
            while start < len(ids):
                some, size = [], 0
                while start + len(some) < len(ids) and size < _CHARS:
                    some.append(texts[start + len(some)].as_py() or "")
                    size += len(some[-1])
                rows: list[tuple] = []
                for doc, spelled in zip(ids[start : start + len(some)], model.of(some), strict=True):
                    data = spelled + end
                    total, at = len(data) // 4, 0
                    for n in cuts(total, capacity, min_cut):
                        waiting[pieces] = (doc, at, n, zlib.crc32(data[4 * at : 4 * (at + n)]), total)
                        rows += ready(bins.place(pieces, n))
                        pieces += 1
                        at += n
                start += len(some)
                if rows:
                    yield batch_of(rows)
        if rows := ready(bins.rest()):
            yield batch_of(rows)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").alias("__text")).mapInArrow(each, _PIECES)
