"""SentencePiece encoding with the N best segmentations, and decoding.

The pieces of a text form a lattice. A forward Viterbi pass gives the cheapest way to reach each position; read
backward from the end, those are exact remaining costs, so an A* search over partial segmentations from the end
back to the start completes them strictly in order of cost: the first N to arrive are the N best (``search_back``).

The lattice of a text is contracted first. It falls apart between words, and within them wherever no piece of the
vocabulary holds the two characters around a position. Viterbi runs over all new words of a batch at once, forward and
backward, which gives each word's best segmentation and how much its second best costs more. A solution with a dear
deviation in it has N cheaper ones before it, so only the N - 1 words of a text with the cheapest deviations keep more than
one arc, and what is left is searched: A* over the characters of those words, then over the chain of them.

A piece costs its negative log probability under Zipf's law over the vocabulary's ranks (the file ranks its pieces; it
holds no probabilities), in whole millionths, so that sums are exact and ties are ties. Characters without a piece
are spelled in byte pieces.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEST = 3
SCALE = 1_000_000
#: More than any cost.
_FAR = 1 << 60
_P = np.uint64(0x9E3779B97F4A7C15)
#: Parts and words that a worker remembers, and characters from which a word isn't.
_KEPT = 500_000
_LONG = 200
#: Bits of a hash by which most strings that aren't pieces are told at once.
_SIEVE = 20
_SPACE = "▁"
_DIGESTS = "doc_id long, n_best int, log_probs array<double>, n_pieces array<int>, ids_crc32 array<long>, decodes boolean"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


Solution = tuple[int, bytes]  # cost in millionths of a nat, ids as little-endian 32-bit numbers


class _Numbers(dict):
    """Words by number; words that are asked for the first time get the next one and are noted."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.made = 0

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = self.made
        self.made += 1
        return self.made - 1


def search_back(n: int, arcs: Callable[[int], list[tuple[int, int, object]]], best: int) -> list[tuple[int, list]]:
    """The ``best`` cheapest paths from 0 to n, cheapest first, as (cost, labels). ``arcs(j)``: (start, cost, label) of those to j.

    Of partial paths with the same bound that nearest to the start goes on, so equal costs don't widen the search.
    """
    reach = [0] * (n + 1)
    for j in range(1, n + 1):
        reach[j] = min(reach[i] + c for i, c, _ in arcs(j))
    found: list[tuple[int, list]] = []
    heap: list[tuple] = [(reach[n], n, 0, 0, None)]
    made = 0
    while heap and len(found) < best:
        _, at, _, done, path = heapq.heappop(heap)
        if not at:
            labels = []
            while path is not None:
                labels.append(path[0])
                path = path[1]
            found.append((done, labels))
            continue
        for i, c, label in arcs(at):
            made += 1
            heapq.heappush(heap, (done + c + reach[i], i, made, done + c, (label, path)))
    return found


def chain_back(lists: list[list[Solution]], best: int) -> list[tuple[int, list[int]]]:
    """The ``best`` cheapest choices of one solution from each list."""
    return search_back(len(lists), lambda j: [(j - 1, s[0], k) for k, s in enumerate(lists[j - 1])], best)


class Pieces:
    """The vocabulary, and the N best segmentations of texts."""

    def __init__(self, path: str, best: int = BEST) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        ranks = [max(0.0, -model.get_score(i)) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        total = math.log(sum(1 / (ranks[i] + 2) for i in plain))
        cost = lambda rank: round(SCALE * (math.log(rank + 2) + total))
        self.best = best
        self.cost_of = {model.id_to_piece(i): (cost(ranks[i]), i) for i in plain}
        byte_cost = cost(max(ranks[i] for i in plain))
        self.byte = {int(model.id_to_piece(i)[3:5], 16): (byte_cost, i) for i in range(size) if model.is_byte(i)}
        self.longest = max(map(len, self.cost_of))
        self.joined = {p[k : k + 2] for p in self.cost_of for k in range(len(p) - 1)}
        # marks that no piece joins to what stands before them, but for a space or another such mark
        marks = set(".,;:!?*#$%&|)\"")
        while bad := {y for x, y in self.joined if y in marks and x != _SPACE and x not in marks}:
            marks -= bad
        own = "".join(map(re.escape, sorted(marks)))
        # no piece holds a mark of space after anything else, nor a line break
        self.between = re.compile(rf"\n|{_SPACE}*[^{_SPACE}\n{own}]+" + (rf"|{_SPACE}*[{own}][^{_SPACE}\n]*" if own else "") + rf"|{_SPACE}+")
        self.spelling = {i: p.encode() for p, (_, i) in self.cost_of.items()} | {i: bytes([b]) for b, (_, i) in self.byte.items()}
        self.parts: dict[str, list[Solution]] = {}
        self.searched: dict[str, list[Solution]] = {}
        self.forget()
        self.byte_cost = byte_cost
        self.table = []  # of each length the hashes of its pieces, in order, with costs, ids and characters, and a sieve of the hashes
        for n in range(1, self.longest + 1):
            own = [(p, c, i) for p, (c, i) in self.cost_of.items() if len(p) == n]
            codes = np.array([[ord(x) for x in p] for p, _, _ in own], np.uint64).reshape(len(own), n)
            h = np.zeros(len(own), np.uint64)
            for k in range(n):
                h = h * _P + codes[:, k]
            order = np.argsort(h)
            sieve = np.zeros(1 << _SIEVE, bool)
            sieve[h >> np.uint64(64 - _SIEVE) if n > 1 else h & np.uint64((1 << _SIEVE) - 1)] = True
            self.table.append((h[order], np.array([c for _, c, _ in own], np.int64)[order], np.array([i for _, _, i in own], np.int64)[order], codes[order], sieve))

    def _arcs(self, text: str) -> Callable[[int], list[tuple[int, int, bytes]]]:
        """The arcs of a text's characters, looked up where they are asked for."""
        cost_of, longest = self.cost_of, self.longest

        def arcs(j: int) -> list[tuple[int, int, bytes]]:
            out = [(i, x[0], x[1].to_bytes(4, "little")) for i in range(max(0, j - longest), j) if (x := cost_of.get(text[i:j]))]
            if not out or out[-1][0] != j - 1:
                spelled = [self.byte[b] for b in text[j - 1].encode("utf-8", "surrogatepass")]
                out.append((j - 1, sum(c for c, _ in spelled), b"".join(x.to_bytes(4, "little") for _, x in spelled)))
            return out

        return arcs

    def search(self, text: str) -> list[Solution]:
        """The N best of one part."""
        return [(cost, b"".join(ids)) for cost, ids in search_back(len(text), self._arcs(text), self.best)]

    def learn(self) -> list[str]:
        """Best segmentation and second best cost of the new words, those of one length together; gives the long ones."""
        new, first = self.number.new, len(self.ids)
        self.number.new = []
        upto = first + len(new)
        if upto > len(self.costs):
            self.costs, self.gaps = (np.r_[x, np.zeros(max(len(x), upto), np.int64)] for x in (self.costs, self.gaps))
        self.ids += [b""] * len(new)
        by_length: dict[int, list[int]] = {}
        long = []
        for k, w in enumerate(new):
            if len(w) < _LONG:
                by_length.setdefault(len(w), []).append(k)
                continue
            own = self.searched[w] = self._word(w)
            self.costs[first + k], self.gaps[first + k] = own[0][0], own[1][0] - own[0][0] if len(own) > 1 else _FAR
            self.ids[first + k] = own[0][1]
            long.append(w)
        for n, own in by_length.items():
            step = max(64, 200_000 // n)
            for i in range(0, len(own), step):
                part = own[i : i + step]
                cost, gap, ids = self._viterbi([new[k] for k in part], n)
                at = first + np.array(part)
                self.costs[at], self.gaps[at] = cost, gap
                for k, x in zip(part, ids, strict=True):
                    self.ids[first + k] = x
        return long

    def _viterbi(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Words of n characters, side by side: arrays are of (position, word)."""
        m = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).T.astype(np.uint64)
        spans = min(n, self.longest)
        arcs: list[tuple[np.ndarray, np.ndarray]] = []  # of each size, cost and id of the piece that begins at a position
        h = np.zeros((n + 1, m), np.uint64)
        for size in range(1, spans + 1):
            h = h[: n - size + 1] * _P + codes[size - 1 :]
            known, cost, piece, spelled, sieve = self.table[size - 1]
            flat = h.ravel()
            at_h = np.flatnonzero(sieve[flat >> np.uint64(64 - _SIEVE) if size > 1 else flat & np.uint64((1 << _SIEVE) - 1)])
            mine = flat[at_h]
            at = np.searchsorted(known, mine)
            at[at == len(known)] = 0
            same = known[at] == mine if len(known) else np.zeros(0, bool)
            at_h, at = at_h[same], at[same]
            # not by their hash alone
            same = (codes.ravel()[at_h[:, None] + m * np.arange(size)] == spelled[at]).all(1)
            at_h, at = at_h[same], at[same]
            costs, ids = np.full(len(flat), _FAR), np.zeros(len(flat), np.int64)
            costs[at_h], ids[at_h] = cost[at], piece[at]
            arcs.append((costs.reshape(h.shape), ids.reshape(h.shape)))
        # characters without a piece are spelled in bytes; they are marked by their negative code
        width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        none = arcs[0][0] == _FAR
        arcs[0][0][none], arcs[0][1][none] = width[none].astype(np.int64) * self.byte_cost, -1 - codes[none].astype(np.int64)
        reach, back, via = (np.zeros((n + 1, m), np.int64) for _ in range(3))
        for j in range(1, n + 1):
            best, step = reach[j - 1] + arcs[0][0][j - 1], via[j]
            for s in range(2, min(j, spans) + 1):
                other = reach[j - s] + arcs[s - 1][0][j - s]
                step[other < best] = s - 1
                np.minimum(best, other, out=best)
            reach[j] = best
        for i in range(n - 1, -1, -1):
            best = arcs[0][0][i] + back[i + 1]
            for s in range(2, min(n - i, spans) + 1):
                np.minimum(best, arcs[s - 1][0][i] + back[i + s], out=best)
            back[i] = best
        through = [reach[: n - s + 1] + arcs[s - 1][0] + back[s:] for s in range(1, spans + 1)]
        pos, rows, steps = np.full(m, n), np.arange(m), []
        while len(rows):
            size = via[pos[rows], rows]
            start = pos[rows] - size - 1
            took = np.full(m, _FAR)
            for s in np.unique(size):
                mine = size == s
                took[rows[mine]] = arcs[s][1][start[mine], rows[mine]]
                through[s][start[mine], rows[mine]] = _FAR
            steps.append(took)
            pos[rows] = start
            rows = rows[start > 0]
        gap = through[0].min(0)
        for t in through[1:]:
            np.minimum(gap, t.min(0), out=gap)
        gap = np.minimum(gap - reach[n], _FAR)
        found = np.stack(steps[::-1], 1)
        used = found != _FAR
        flat = found[used]
        spelled = flat.astype("<u4").tobytes()
        ends = (4 * np.cumsum(used.sum(1))).tolist()
        ids = [spelled[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        for k in np.flatnonzero(((found < 0) & used).any(1)).tolist():  # characters without a piece
            ids[k] = b"".join(
                x.to_bytes(4, "little") if x >= 0 else b"".join(self.byte[b][1].to_bytes(4, "little") for b in chr(-1 - x).encode("utf-8", "surrogatepass")) for x in found[k][used[k]].tolist()
            )
        return reach[n], gap, ids

    def forget(self) -> None:
        """Words by number: their best cost and ids, and what the second best costs more."""
        self.number = _Numbers()
        self.ids: list[bytes] = []
        self.costs, self.gaps = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)

    def _word(self, word: str) -> list[Solution]:
        cut = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.joined), len(word)]
        lists = []
        for a, b in zip(cut, cut[1:], strict=False):
            part = word[a:b]
            found = self.parts.get(part)
            if found is None:
                found = self.search(part)
                if len(part) < _LONG:
                    if len(self.parts) >= _KEPT:
                        self.parts.clear()
                    self.parts[part] = found
            lists.append(found)
        if len(lists) == 1:
            return lists[0]
        return [(cost, b"".join(own[k][1] for own, k in zip(lists, choice, strict=True))) for cost, choice in chain_back(lists, self.best)]

    def encode(self, text: str) -> list[Solution]:
        """The N best segmentations of a text, cheapest first; fewer where there are fewer. An empty text has one, of nothing."""
        if not text:
            return [(0, b"")]
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[Solution]]:
        """``encode`` of each text; their new words are learned together."""
        split = [self.between.findall(f"{_SPACE}{t.replace(' ', _SPACE)}") if t else [] for t in texts]
        if len(self.number) > _KEPT:
            self.forget()
        numbers = [np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)) for words in split]
        long = self.learn()
        out = []
        for words, at in zip(split, numbers, strict=True):
            if not words:
                out.append([(0, b"")])
                continue
            gaps = self.gaps[at]
            # the words with the cheapest deviations, in their order; no other can be part of the N best
            near = np.sort(np.argsort(gaps, kind="stable")[: self.best - 1])
            near = near[gaps[near] < _FAR].tolist()
            rest = int(self.costs[at].sum() - self.costs[at[near]].sum())
            ids = list(map(self.ids.__getitem__, at.tolist()))
            between = [b"".join(ids[i + 1 : j]) for i, j in zip([-1, *near], [*near, len(ids)], strict=True)]
            lists = [self._searched(words[k]) for k in near]
            out.append(
                [
                    (rest + cost, between[0] + b"".join(own[k][1] + after for k, own, after in zip(choice, lists, between[1:], strict=True)))
                    for cost, choice in chain_back(lists, self.best)
                ]
            )
        for w in long:  # known for these texts only
            self.ids[self.number.pop(w)] = b""
            self.searched.pop(w, None)
        return out

    def _searched(self, word: str) -> list[Solution]:
        found = self.searched.get(word)
        if found is None:
            if len(self.searched) >= _KEPT:
                self.searched.clear()
            found = self.searched[word] = self._word(word)
        return found

    def decode(self, ids: bytes | list[int]) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids
        text = b"".join(map(self.spelling.__getitem__, numbers)).decode("utf-8", "surrogatepass").replace(_SPACE, " ")
        return text.removeprefix(" ")


_models: dict[tuple[str, int], Pieces] = {}


def pieces_for(path: str, best: int) -> Pieces:
    """The worker's vocabulary, kept from task to task."""
    key = (path, best)
    if key not in _models:
        _models[key] = Pieces(path, best)
        if not all(_SPACE not in p.lstrip(_SPACE) and "\n" not in p for p in _models[key].cost_of):
            raise ValueError("this vocabulary has pieces that go on over a space")
    return _models[key]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", best: int = BEST, model: str | None = None) -> DataFrame:
    """(id, rank, log_prob, ids): the ``best`` cheapest segmentations of each text, rank 0 first.

    A null text counts as empty, and an empty text has one segmentation, of no pieces. Which of equal costs come, and in
    what order, depends on the text alone; rows that repeat an id are rows of their own; an empty table
    gives none. The mark of space itself (U+2581) in a text is read as a space, as the library does.
    """
    path = model or model_path()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces_for(path, best)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = vocabulary.encode_all(part.column(1).to_pylist())
                rows = [(i, r, -c / SCALE, np.frombuffer(x, "<i4")) for i, own in zip(part.column(0).to_pylist(), found, strict=True) for r, (c, x) in enumerate(own)]
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "rank", "log_prob", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(each, "id long, rank int, log_prob double, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """``rows`` with the text of each list of ids as ``decoded`` (null for null); must have no such column yet."""
    path = model or model_path()

    def texts(ids):
        import pandas as pd

        vocabulary = pieces_for(path, BEST)
        return pd.Series([None if x is None else vocabulary.decode([int(i) for i in x]) for x in ids])

    return rows.withColumn("decoded", F.pandas_udf(texts, "string")(ids_col))


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", best: int = BEST, model: str | None = None) -> DataFrame:
    """One row a text: what ``encode`` gives, in numbers, and whether ``decode`` of the best gives the text back."""
    path = model or model_path()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces_for(path, best)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column(1).to_pylist()
                every = vocabulary.encode_all(texts)
                probs = [[-c / SCALE for c, _ in found] for found in every]
                sizes = [[len(x) // 4 for _, x in found] for found in every]
                sums = [[zlib.crc32(x) for _, x in found] for found in every]
                back = [vocabulary.decode(found[0][1]) == t.replace(_SPACE, " ") for found, t in zip(every, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(p) for p in probs], pa.int32()), pa.array(probs, pa.list_(pa.float64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(sums, pa.list_(pa.int64())), pa.array(back, pa.bool_())],
                    [x.split()[0] for x in _DIGESTS.split(", ")],
                )

    return _texts(docs, id_col, text_col).mapInArrow(each, _DIGESTS).withColumnRenamed("doc_id", id_col)
