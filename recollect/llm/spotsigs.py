"""Document fingerprints by SpotSigs, and near copies by them.

A *spot* is a common word (an anchor such as an article or a preposition); its signature is the chain of the next content
words after it. Navigation, headings and lists have few anchors, prose has many, so the set of a text's signatures
tells what its prose says. Texts are compared by the Jaccard likeness of their sets.

Near copies are found corpus-wide. Two sets can't be more alike than their lengths are, so sets are filed in partitions of
set length, and in the partition below too if that holds a length within reach. In a partition a set is filed under
the rarest of its signatures, so many that alike sets must share one (how common signatures are is counted over all
sets, by bucket). Files are compared by ``set_links``: pairs are dropped on their lengths and on a sketch of both sets, then
on the part of the smaller set still to come, before any set is walked to its end.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import Scratch, join_spread
from recollect.llm.components import components
from recollect.llm.set_links import Likeness, fingerprints, links

#: Anchors: function words of English, German, French and Spanish.
ANCHORS = frozenset(
    """
    the a an of and to in is it that was for on with as by this be at from or are not but
    der die das und ein eine zu den mit ist im auf von sich für dem nicht des
    le la les un une et de du en dans que qui est au par pour sur elle avec
    el los las una y es se del lo con por para no su al
    """.split()
)
CHAIN = 2
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: The same for texts below U+0300, where there are no combining marks.
_PLAIN, _MARKED = re.compile(r"[^\W_]+"), re.compile(r"[^\x00-\u02ff]")
#: Whether a character belongs to a word, up to U+0300; those above do, as only words are left of texts that have any.
_IN_WORD = np.array([*(_WORD.match(chr(c)) is not None for c in range(0x300)), True])
_MULT, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Characters taken at once.
_CHARS = 1 << 20
_FIELDS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "set_length long, class_id long"
)
#: Jaccard likeness from which sets are near copies, as a ratio of whole numbers.
LIKENESS = (4, 5)
#: Least lengths of the partitions of set length.
_EDGES = 2 ** np.arange(32)
#: Signatures are counted by their first bits.
_LOAD_BITS = 16
#: Bytes of text in a block of ids, about; blocks at most; rows drawn a block to set their edges.
BLOCK_BYTES, _BLOCKS, _SAMPLE = 1 << 27, 20_000, 64


def _powers(base: int, n: int) -> np.ndarray:
    return np.r_[np.uint64(1), np.cumprod(np.full(n - 1, base, np.uint64))]


def _odd_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number, and of its inverse, modulo 2**64."""
    return _powers(int(_BASE), n), _powers(pow(int(_BASE), -1, 1 << 64), n)


def words_of(text: str) -> list[str]:
    low = text.lower()
    return (_WORD if _MARKED.search(low) else _PLAIN).findall(low)


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of each word of ``words_of``.

    A hash is a polynomial of the word's characters, so those of all words come from one running sum over the texts.
    """
    lows = [t.lower() for t in texts]
    lows = [x if x.isascii() or not _MARKED.search(x) else " ".join(_WORD.findall(x)) for x in lows]
    codes = np.frombuffer(f" {' '.join(lows)} ".encode("utf-32-le", "surrogatepass"), "<u4")
    inside = _IN_WORD[np.minimum(codes, len(_IN_WORD) - 1)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    up, down = (x[: len(codes)] for x in (_KEPT if len(codes) <= len(_KEPT[0]) else _odd_powers(len(codes))))
    sums = (codes + np.uint64(1)) * _MULT
    sums ^= sums >> np.uint64(32)
    sums *= up
    np.cumsum(sums, out=sums)
    h = (sums[ends - 1] - sums[starts - 1]) * down[starts]
    h = (h ^ (h >> np.uint64(31))) * _MULT
    h ^= h >> np.uint64(29)
    first = np.cumsum([1, *(len(x) + 1 for x in lows)])
    doc = np.repeat(np.arange(len(lows)), np.diff(np.searchsorted(starts, first)))
    return h, doc


_KEPT = _odd_powers(_CHARS + (_CHARS >> 2))
_ANCHOR_HASHES = np.sort(_word_hashes([" ".join(ANCHORS)])[0])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same; the lowest bit of a hash says whether the word is an anchor."""
    h, doc = _word_hashes(texts)
    anchor = _ANCHOR_HASHES[np.minimum(np.searchsorted(_ANCHOR_HASHES, h), len(_ANCHOR_HASHES) - 1)] == h
    return h & ~np.uint64(1) | anchor, doc


def _chains(h: np.ndarray, doc: np.ndarray, at: np.ndarray, links: np.ndarray, chain: int) -> np.ndarray:
    """Hashes of the words at ``at`` with the next ``chain`` of the positions ``links``, as far as their text goes."""
    sig = h[at] * _MULT
    to = np.searchsorted(links, at, side="right")
    padded = np.r_[links, np.full(chain, len(h))]
    ends, owner = np.r_[h, np.uint64(0)], np.r_[doc, -1]
    for k in range(chain):
        nxt = padded[np.minimum(to + k, len(padded) - 1)]
        word = np.where(owner[nxt] == doc[at], ends[nxt], np.uint64(0))
        sig = (sig ^ (sig >> np.uint64(31))) * _MULT + word
    sig = (sig ^ (sig >> np.uint64(29))) * _MULT
    return (sig >> np.uint64(32)).astype(np.uint32)


def signature_sets(texts: list[str], chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted distinct 32-bit signatures of each text.

    A text without an anchor is chained at every word; one without words, but not empty, has one signature of its
    own; an empty text has none.
    """
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    start = 0
    while start < len(texts):
        n, chars = 0, 0
        while start + n < len(texts) and chars < _CHARS:
            chars += len(texts[start + n])
            n += 1
        h, doc = word_hashes(texts[start : start + n])
        anchor = (h & np.uint64(1)) == 1
        none = np.bincount(doc, anchor, n) == 0
        at = np.flatnonzero(anchor)
        sets = [(doc[at], _chains(h, doc, at, np.flatnonzero(~anchor), chain))]
        if none.any():
            at = np.flatnonzero(none[doc])
            sets.append((doc[at], _chains(h, doc, at, np.arange(len(h)), chain)))
        owner, sig = (np.concatenate(x) for x in zip(*sets, strict=True))
        both = np.unique((owner.astype(np.uint64) << np.uint64(32)) | sig)
        edges = np.searchsorted(both, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
        sig = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for i in range(n):
            own = sig[edges[i] : edges[i + 1]]
            if not len(own) and texts[start + i]:
                own = np.array([xxhash.xxh32_intdigest(texts[start + i].encode("utf-8", "surrogatepass"), 11)], np.uint32)
            out[start + i] = own
        start += n
    return out


def as_text(signatures: np.ndarray) -> str:
    """A fingerprint as text: eight hex digits a signature, in order."""
    return signatures.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard of two sorted sets, or 0 where it can't reach ``at_least``; two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < at_least * len(large):
        return 0.0
    need = math.ceil(at_least * (len(a) + len(b)) / (1 + at_least) - 1e-9)
    common, step = 0, max(64, len(small) // 4)
    for i in range(0, len(small), step):
        if common + len(small) - i < need:
            return 0.0
        part = small[i : i + step]
        at = np.searchsorted(large, part)
        common += int((large[np.minimum(at, len(large) - 1)] == part).sum())
    return common / (len(a) + len(b) - common) if common >= need else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following`` as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _sets(batches: Iterator[pa.RecordBatch], chain: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, key, h, bytes, text) with their sets in place of texts; a set is named by two halves of a digest."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            sigs = [x.astype("<u4").tobytes() for x in signature_sets(part.column(4).to_pylist(), chain)]
            names = np.frombuffer(b"".join(map(xxhash.xxh128_digest, sigs)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:4], pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([len(x) // 4 for x in sigs], pa.int64()), pa.array(sigs, pa.binary())],
                ["id", "key", "h", "bytes", "d1", "d2", "size", "sig"],
            )


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of all signatures of a column of sets."""
    sets = [np.frombuffer(x, "<u4") for x in column.to_pylist()]
    return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets) if sets else np.zeros(0, np.uint32)


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many signatures fall into each bucket."""
    total = np.zeros(1 << _LOAD_BITS, np.int64)
    for batch in batches:
        total += np.bincount(_flat(batch.column(0))[1] >> np.uint32(32 - _LOAD_BITS), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["b", "n"])


def file_keys(sets: list[np.ndarray] | pa.Array, load: np.ndarray, ratio: tuple[int, int] = LIKENESS) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of the files that each set goes to. Alike sets share one: its length partition and a signature."""
    p, q = ratio
    owner, sig = _flat(sets)
    size = np.bincount(owner, minlength=len(sets))
    order = np.lexsort((sig * np.uint32(0x9E3779B1), load[sig >> np.uint32(32 - _LOAD_BITS)], owner))
    place = np.arange(len(sig)) - np.repeat(np.cumsum(size) - size, size)
    # a set alike to one of n signatures shares at least ratio * n of them
    order = order[place < np.repeat(size - -(-p * size // q) + 1, size)]
    owner, sig, n = owner[order], sig[order].astype(np.int64), size[owner[order]]
    part = np.searchsorted(_EDGES, n, side="right") - 1
    lower = (part > 0) & (p * n <= q * (_EDGES[part] - 1))  # a set of the partition below may be alike
    keys = np.concatenate(((sig << 8) | part, (sig[lower] << 8) | (part[lower] - 1)))
    return np.concatenate((owner, owner[lower])), keys


def _filed(batches: Iterator[pa.RecordBatch], load: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (id, size, sig) under the keys of their files, with fingerprints."""
    for batch in batches:
        owner, sig = _flat(batch.column(2))
        mixed = (sig.astype(np.uint64) + np.uint64(1)) * _MULT
        fps = fingerprints(owner, (mixed ^ (mixed >> np.uint64(32))) * _MULT, batch.num_rows)
        at, keys = file_keys(batch.column(2), load)
        taken = pa.array(at)
        columns = [pa.array(keys), batch.column(0).take(taken), batch.column(1).take(taken), *(pa.array(np.ascontiguousarray(fps[at, k])) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "id", "size", "fp", "fp2"])


def near_classes(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(d1, d2, n, class_id) of the distinct sets of a saved table (id, d1, d2, size, sig): n rows have the set.

    class_id is the smallest id of the component under Jaccard links of LIKENESS or more; null if no row of it has an id.
    """
    spark = sets.sparkSession
    one = sets.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = scratch.save(one.withColumn("node", F.monotonically_increasing_id()))
    counted = classes.select("sig").mapInArrow(_loads, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket
    load = np.zeros(1 << _LOAD_BITS, np.int64)
    load[counted.column("b").to_numpy()] = counted.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(load)
    filed = classes.select("node", "size", "sig").mapInArrow(lambda it: _filed(it, shared.value), "key long, id long, size long, fp long, fp2 long")
    like = Likeness(lambda x: np.frombuffer(x, "<u4"), LIKENESS)
    roots = components(links(filed, classes.select(F.col("node").alias("id"), F.col("sig").alias("t")), like, scratch), scratch)
    linked = scratch.save(classes.drop("sig", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = scratch.save(linked.groupBy("root").agg(F.min("first").alias("class_id"), F.count("*").alias("rows")))
    out = scratch.save(join_spread(linked, least, ["root"], ["class_id"], F.col("rows"), linked.count(), F.col("node")).select("d1", "d2", "n", "class_id"))
    scratch.drop(classes, linked, least)
    return out


def _place(edges: tuple[np.ndarray, np.ndarray], keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How many of the sorted edges (key, h) are not above each (key, h)."""
    out, upto = (np.searchsorted(edges[0], keys, side=side) for side in ("left", "right"))
    for k in np.unique(keys[upto > out]):
        mine = keys == k
        a, b = np.searchsorted(edges[0], (k, k), side="left")[0], np.searchsorted(edges[0], k, side="right")
        out[mine] = a + np.searchsorted(edges[1][a:b], h[mine], side="right")
    return out


def _compare(batches: Iterator[pa.RecordBatch], chain: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, tail, id, key, h, text, class), sorted: each text against the next of its block; tails only lend theirs.

    A row without text tells the class of the texts with its key and h, which follow it; other texts are in their own.
    """
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, _FIELDS.split(", "), strict=True)])
    rows: list[tuple] = []
    told: tuple = ()
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            for block, tail, i, key, h, text, class_id in zip(*(part.column(c).to_pylist() for c in range(7)), strict=True):
                if text is None:
                    told = (key, h, class_id)
                else:
                    rows.append((block, tail, i, text, told[2] if told[:2] == (key, h) else i))
            # pairs whose second row stands in the next batch wait for it
            pairs = [(i, i + 1) for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
            if pairs:
                texts = [r[3] for r in rows]
                new = [edited(texts[i], texts[j]) for i, j in pairs]
                own, other = signature_sets(texts, chain), signature_sets(new, chain)
                out = [
                    (
                        rows[i][2], len(texts[i]), hashlib.sha256(new[k].encode()).hexdigest(), as_text(own[i]), as_text(other[k]),
                        likeness(own[i], other[k]), likeness(own[i], own[j]), len(own[i]), rows[i][4],
                    )
                    for k, (i, j) in enumerate(pairs)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            rows = rows[-1:]


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN, blocks: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: its fingerprint, that of its edited text, how alike they are, and its class.

    The next document is that of the next smaller id, after the last the first; rows with the same id follow each
    other by hash of their text, rows without one come last. A null text counts as empty. A lone row is its own next.
    near_edited and near_next are whole Jaccard likenesses, not pruned ones, as most edited texts are below any
    threshold; class_id is the smallest id among the near copies (LIKENESS) of near copies, its own id without any; a
    row without an id is in the class of a row with one, if there is such a near copy, else in none.

    Ranges of (id, hash) of some BLOCK_BYTES of text are dealt over the cluster; each gets the first text of the range that
    follows it, and nothing else moves between them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "spotsigs")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    key = F.coalesce("id", F.lit(-(1 << 63)))
    rows = rows.select("id", key.alias("key"), F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("bytes"), "text")
    sets = scratch.save(rows.mapInArrow(lambda it: _sets(it, chain), "id long, key long, h long, bytes long, d1 long, d2 long, size long, sig binary"))
    total, size = sets.agg(F.count("*"), F.sum("bytes")).first()
    classes = near_classes(sets, scratch)
    marks = join_spread(sets.select("id", "key", "h", "d1", "d2"), classes, ["d1", "d2"], ["class_id"], F.col("n"), total, F.struct("key", "h"))
    marks = scratch.save(marks.filter("class_id IS NOT NULL AND NOT (class_id <=> id)").select("key", "h", "class_id").distinct())

    blocks = blocks or min(_BLOCKS, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // BLOCK_BYTES))
    # edges between blocks from about _SAMPLE rows a block, drawn by hash
    drawn = F.pmod(F.xxhash64("key", "h", F.lit("edges")), F.lit(1 << 30)) < min(1.0, _SAMPLE * blocks / max(1, total)) * (1 << 30)
    some = sets.filter(drawn).select("key", "h").distinct().toArrow().sort_by([("key", "ascending"), ("h", "ascending")])
    at = np.unique(np.arange(1, blocks) * some.num_rows // blocks) if some.num_rows else np.zeros(0, int)
    edges = tuple(some.column(c).to_numpy()[at] for c in ("key", "h"))

    def numbered(of: tuple[np.ndarray, np.ndarray]):
        def number(keys, h):
            import pandas as pd

            return pd.Series(_place(of, keys.to_numpy(), h.to_numpy()))

        return F.pandas_udf(number, "long")("key", "h")

    tops = sets.select("key", "h", numbered(edges).alias("b")).groupBy("b").agg(F.max(F.struct("key", "h")).alias("top")).select("b", "top.*")
    tops = tops.toArrow().sort_by("b")
    filled, *top = (tops.column(c).to_numpy() for c in ("b", "key", "h"))

    def lent_to(keys, h):  # the first row of a block goes to the block after it too, where it ends the order
        import pandas as pd

        keys, h = keys.to_numpy(), h.to_numpy()
        n = _place(tuple(top), keys, h)
        hit = (n > 0) & (top[0][n - 1] == keys) & (top[1][n - 1] == h)
        return pd.Series(np.where(hit, filled[n % len(filled)], -1))

    dealt = rows.drop("bytes").withColumn("class_id", F.lit(None).cast("long"))
    goes = F.array(F.struct(numbered(edges).alias("block"), F.lit(0).alias("tail")), F.struct(F.pandas_udf(lent_to, "long")("key", "h").alias("block"), F.lit(1).alias("tail")))
    dealt = dealt.withColumn("to", F.explode(F.filter(goes, lambda x: x["block"] >= 0))).select("to.block", "to.tail", "id", "key", "h", "text", "class_id")
    told = marks.select(numbered(edges).alias("block"), F.lit(0).alias("tail"), F.lit(None).cast("long").alias("id"), "key", "h", F.lit(None).cast("string").alias("text"), "class_id")
    dealt = dealt.unionByName(told).repartition(max(blocks // 4, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block")
    dealt = dealt.sortWithinPartitions("block", "tail", F.desc("key"), F.desc("h"), F.col("text").isNotNull(), "text")
    scratch.drop(sets, classes)
    return dealt.mapInArrow(lambda it: _compare(it, chain), _FIELDS).withColumnRenamed("doc_id", id_col)
