"""Token ids in compressed files: rANS blocks under one shared frequency table, with checkpoints and checksums.

A first pass spells every text and writes the ids; their counts, one a vocabulary entry, make the frequency table, which is
stored once. Documents are then dealt by range of id to as many files as their tokens ask for, so that files in their order
are the corpus in ascending order of ids. A file is a row of independent blocks, each with the pieces of documents in it, and
ends in a list of checkpoints (where a block lies, its first token, its checksum). Readers start from checkpoints, so a
block is the unit of parallel decoding and of memory, however long a document or a file is; documents that go over
several blocks are put together from the checksums of their pieces.

File (little-endian): ``RTOK1``, CRC-32 of the table; blocks; checkpoints, their CRC-32, their number (u32), ``RTOKEND``.
Block: tokens, lanes, pieces, words (u32 each), CRC-32 of the ids; ids of documents (i64), lengths (u32) and marks (u8: 1 begins here, 2 ends
here, 4 has no id) of the pieces; states (u64), words (u32).

Files go to the shared folder. One counts only once its task has ended and its name stands in the written manifest; what a
lost attempt left is never read.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import Scratch, kept_on_worker
from recollect.llm.rans import Table, joined_crc
from recollect.llm.warc import _system

END_ID = 2
BLOCK_TOKENS = 1 << 18
#: Tokens of a file that is large enough, about.
FILE_TOKENS = 1 << 26
#: Spellings of words that a worker keeps, twice; new words spelled together; characters of text spelled at once.
_WORDS, _TOGETHER, _CHARS = 400_000, 1_000, 4_000_000
_MARKS = ".,;:!?*#$%&|)"
#: White space outside ASCII, and what some take for white space.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_MAGIC, _END = b"RTOK1", b"RTOKEND"
_BEGINS, _ENDS, _NAMELESS = 1, 2, 4
#: offset, bytes, tokens, first token of a block in its file, CRC-32 of its ids, number of the first document
_CHECKPOINT = np.dtype([("at", "<i8"), ("bytes", "<i8"), ("tokens", "<i8"), ("first", "<i8"), ("crc", "<u4"), ("doc", "<i8")])
_PIECES = "file long, doc long, doc_id long, start long, n_tokens long, ids_crc32 long, whole boolean"
#: Pieces of one document that are joined in one go.
_FAN = 1 << 12


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Speller:
    """Token ids of whole texts, spelled word by word: this vocabulary drops white space and merges nothing across it.

    Texts are put in lower case first where that is what the tokenizer makes of them, so there are fewer words to know. Marks
    that end a new word are spelled by themselves, as they are never merged with letters. New words of letters alone are given to
    the tokenizer many at once, and told apart by the tokens that end one; other words one by one. A batch is split and numbered by
    Arrow, so Python sees each of its distinct words once. Texts with white space other than that of ASCII are given to the tokenizer whole.

    Ids are numbers of 16 bits if the vocabulary has no more, else of 32.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.ids = self.model.get_vocab_size()
        self.kind = np.dtype("<u2" if self.ids <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.ids, bool)
        for token, i in self.model.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        tried = ["Hello, World", "don't x's", "naïve 12a", "a b.", "x_, (y)"]
        if self.of(tried) != [self.whole(x) for x in tried]:
            raise ValueError("this tokenizer doesn't spell word by word")

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, words: set[str]) -> None:
        """Spell words that aren't known."""
        known, before, letters, marked = self.known, self.before, [], []
        for w in words:
            if (again := before.get(w)) is not None:
                known[w] = again
            elif w.isalpha():
                letters.append(w)
            elif (core := w.rstrip(_MARKS)).isalpha() and core[-1] != "İ":  # which in lower case ends in a mark itself
                marked.append((w, core))
            else:
                known[w] = self.whole(w)
        asked = words.union(letters)
        letters += {core for _, core in marked if core not in asked and core not in known}
        for i in range(0, len(letters), _TOGETHER):
            some = letters[i : i + _TOGETHER]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                data, at = ids.tobytes(), 0
                for w, cut in zip(some, (ids.itemsize * cuts).tolist(), strict=True):
                    known[w] = data[at:cut]
                    at = cut
            else:  # a letter becomes more than letters in lower case
                known.update((w, self.whole(w)) for w in some)
        for w, core in marked:
            tail = w[len(core) :]
            if tail not in known:
                known[tail] = self.whole(tail)
            known[w] = known[core] + known[tail]

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of little-endian numbers."""
        plain = [not _ODD_SPACE.search(t) for t in texts]
        words = pc.ascii_split_whitespace(pa.array([_lower(t) if x else "" for t, x in zip(texts, plain, strict=True)], pa.string()))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > _WORDS:  # of words known long ago what is still asked for is kept
            self.before, self.known = self.known, {"": b""}
        self._learn(set(distinct).difference(self.known))
        spelled = [self.known[w] for w in distinct]
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled)) // self.kind.itemsize
        ids, firsts = np.frombuffer(b"".join(spelled), self.kind), np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        ids = ids[np.repeat(firsts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.r_[0, ends][words.offsets.to_numpy()].tolist()
        return [ids[i:j].tobytes() if x else self.whole(t) for t, x, i, j in zip(texts, plain, cuts[:-1], cuts[1:], strict=True)]


def _lower(text: str) -> str:
    """Lower case, if letter by letter after composition gives the same; else the text."""
    if text.isascii():
        return text.lower()
    small = text.lower()
    plain = "Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", small)
    return small if plain else text


_kept: dict[str, Speller] = {}
kept_on_worker.append(_kept.clear)


def speller(path: str) -> Speller:
    """The worker's speller, kept from task to task."""
    if path not in _kept:
        _kept[path] = Speller(path)
    return _kept[path]


def spell(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, row, ids, n) of every row: the ids of its whole text and ``end_id``, as the speller's kind of numbers.

    The last row of a task has no document: under row -1 it has, as numbers of 64 bits, how often each id occurs in the others.
    """
    path = tokenizer or tokenizer_path()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = speller(path)
        end = np.array([end_id], model.kind).tobytes()
        counts = np.zeros(max(model.ids, end_id + 1), np.int64)
        names = ["doc_id", "row", "ids", "n"]
        for batch in batches:
            texts, start = batch.column(2), 0
            while start < batch.num_rows:
                some, size = [], 0
                while start + len(some) < batch.num_rows and size < _CHARS:
                    text = texts[start + len(some)].as_py() or ""
                    size += len(text)
                    some.append(text)
                some = [x + end for x in model.of(some)]
                counts += np.bincount(np.frombuffer(b"".join(some), model.kind), minlength=len(counts))
                own = batch.slice(start, len(some))
                n = pa.array([len(x) // model.kind.itemsize for x in some], pa.int64())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(some, pa.binary()), n], names)
                start += len(some)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([counts.tobytes()], pa.binary()), pa.array([0], pa.int64())], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(each, "doc_id long, row long, ids binary, n long")


def frequencies(spelled: DataFrame) -> Table:
    """The shared table; what comes to the driver is one count for each id that occurs, so no more than the vocabulary has."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                more = np.frombuffer(x.as_buffer(), "<i8")
                counts = more + (counts if len(counts) else 0)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["id", "n"])

    found = spelled.filter("row = -1").select("ids").mapInArrow(each, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = found.column("id").to_numpy(), found.column("n").to_numpy()
    counts = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    counts[ids] = n
    return Table.from_counts(counts)


class _Writer:
    """One open file: tokens come in by pieces of documents and leave in blocks."""

    def __init__(self, out, table: Table, table_crc: int, block_tokens: int) -> None:
        self.out, self.table, self.block = out, table, block_tokens
        out.write(_MAGIC + table_crc.to_bytes(4, "little"))
        self.checkpoints: list[tuple] = []
        self.tokens = self.docs = 0
        self._clear()

    def _clear(self) -> None:
        self.ids, self.held, self.pieces = [], 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            part = ids[at : at + self.block - self.held]
            marks = (_BEGINS if at == 0 else 0) | (_ENDS if at + len(part) == len(ids) else 0) | (_NAMELESS if doc_id is None else 0)
            self.pieces.append((doc_id or 0, len(part), marks))
            self.ids.append(part)
            self.held += len(part)
            at += len(part)
            if self.held == self.block:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        ids = np.concatenate(self.ids)
        state, words = self.table.encode(ids)
        names, lengths, marks = zip(*self.pieces, strict=True)
        crc = zlib.crc32(ids.astype("<u4").tobytes())
        head = np.array([len(ids), len(state), len(names), len(words), crc], "<u4").tobytes()
        parts = [head, np.array(names, "<i8").tobytes(), np.array(lengths, "<u4").tobytes(), np.array(marks, "u1").tobytes(), state.astype("<u8").tobytes(), words.astype("<u4").tobytes()]
        at, size = self.out.tell(), sum(map(len, parts))
        for p in parts:
            self.out.write(p)
        first_doc = self.docs - (not marks[0] & _BEGINS)  # a piece that goes on belongs to the last document begun
        self.checkpoints.append((at, size, len(ids), self.tokens, crc, first_doc))
        self.tokens += len(ids)
        self.docs += sum(m & _BEGINS for m in marks)
        self._clear()

    def close(self) -> None:
        self.flush()
        body = np.array(self.checkpoints, _CHECKPOINT).tobytes()
        self.out.write(body + zlib.crc32(body).to_bytes(4, "little") + len(self.checkpoints).to_bytes(4, "little") + _END)


def write_files(spelled: DataFrame, table: Table, folder: str, files: int, kind: np.dtype, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write spelled documents in ascending order of ids, null ones last, rows that repeat one in the order of the table.

    ``kind``: that of the ids' numbers. Gives the manifest (file, path, tokens, blocks, bytes), which must be saved before it is read: files counts ranges, and
    those in ascending order follow each other. The shared table is written by the driver, as ``frequencies``.
    """
    data = table.to_bytes()
    system, root = _system(folder)
    system.create_dir(root)
    with system.open_output_stream(f"{root}/frequencies", compression=None) as out:
        out.write(data)
    crc = zlib.crc32(data)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shared, writer, name = Table.from_bytes(data), None, f"{uuid.uuid4().hex}.rtok"
        system, root = _system(folder)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    writer = _Writer(system.open_output_stream(f"{root}/{name}", compression=None), shared, crc, block_tokens)
                writer.add(doc_id, np.frombuffer(ids.as_buffer(), kind))
        rows: list[tuple] = []
        if writer is not None:
            writer.close()
            rows.append((TaskContext.get().partitionId(), f"{folder}/{name}", writer.tokens, len(writer.checkpoints), writer.out.tell()))
            writer.out.close()
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        names = ["file", "path", "tokens", "blocks", "bytes"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names)

    order = [F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    dealt = spelled.filter("row >= 0").select("doc_id", "ids", "row").repartitionByRange(files, *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids").mapInArrow(write, "file long, path string, tokens long, blocks long, bytes long")


def checkpoints(manifest: DataFrame) -> DataFrame:
    """(file, path, base, at, bytes, tokens, first, crc, doc) of every block, from the ends of the files themselves.

    ``base`` is the number of tokens in all files before: the driver adds up one number a file.
    """
    spark = manifest.sparkSession
    rows, base = [], 0
    for r in manifest.orderBy("file").collect():  # a row a file of FILE_TOKENS
        rows.append((r.file, r.path, base, r.bytes))
        base += r.tokens
    listed = spark.createDataFrame(rows, "file long, path string, base long, size long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path, base, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                system, place = _system(path)
                with system.open_input_file(place) as source:
                    tail = 8 + len(_END)
                    source.seek(size - tail)
                    end = source.read(tail)
                    n = int.from_bytes(end[4:8], "little")
                    source.seek(size - tail - n * _CHECKPOINT.itemsize)
                    body = source.read(n * _CHECKPOINT.itemsize)
                if end[8:] != _END or zlib.crc32(body) != int.from_bytes(end[:4], "little"):
                    raise ValueError(f"{path}: its checkpoints are damaged")
                found = np.frombuffer(body, _CHECKPOINT)
                fixed = [pa.array([x] * n, kind) for x, kind in ((file, pa.int64()), (path, pa.string()), (base, pa.int64()))]
                columns = [pa.array(found[c].astype(np.int64)) for c in _CHECKPOINT.names]
                yield pa.RecordBatch.from_arrays([*fixed, *columns], ["file", "path", "base", *_CHECKPOINT.names])

    kinds = "file long, path string, base long, at long, bytes long, tokens long, first long, crc long, doc long"
    tasks = max(1, min(len(rows), 3 * spark.sparkContext.defaultParallelism))
    return listed.repartition(tasks).mapInArrow(each, kinds)


_tables: dict[str, Table] = {}


def _table_of(folder: str) -> tuple[Table, int]:
    if folder not in _tables:
        _tables.clear()
        system, root = _system(folder)
        with system.open_input_stream(f"{root}/frequencies", compression=None) as source:
            data = source.read()
        _tables[folder] = (Table.from_bytes(data), zlib.crc32(data))
    return _tables[folder]


def read_block(data: bytes, table: Table, stated_crc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, names, lengths, marks) of one block, whose checksums must hold."""
    tokens, lanes, pieces, words, crc = np.frombuffer(data, "<u4", 5).tolist()
    at, out = 20, []
    for kind, n in (("<i8", pieces), ("<u4", pieces), ("u1", pieces), ("<u8", lanes), ("<u4", words)):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    ids = table.decode(out[3], out[4], tokens)
    if at != len(data) or crc != stated_crc or zlib.crc32(ids.astype("<u4").tobytes()) != crc or int(out[1].sum(dtype=np.int64)) != tokens:
        raise ValueError("a block doesn't have the checksum it states")
    return ids, *out[:3]


def read_pieces(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """Decode the blocks of saved checkpoints, each by itself: a row for each piece of a document, with its ids if asked for."""
    schema = _PIECES + (", ids binary" if with_ids else "")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path, base, at, size, _, first, crc, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = path.rpartition("/")[0]
                table, table_crc = _table_of(folder)
                system, place = _system(path)
                with system.open_input_file(place) as source:
                    head = source.read(len(_MAGIC) + 4)
                    source.seek(at)
                    data = source.read(size)
                if head != _MAGIC + table_crc.to_bytes(4, "little"):
                    raise ValueError(f"{path} wasn't written under this table")
                ids, names, lengths, marks = read_block(data, table, crc)
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths, dtype=np.int64)
                cuts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                nameless = marks & _NAMELESS != 0
                columns = [
                    pa.array(np.full(len(names), file)), pa.array(doc + np.r_[0, np.cumsum(marks[1:] & _BEGINS, dtype=np.int64)]), pa.array(names, pa.int64(), mask=nameless),
                    pa.array(base + first + ends - lengths), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                    pa.array(marks & (_BEGINS | _ENDS) == (_BEGINS | _ENDS)),
                ]
                if with_ids:
                    columns.append(pa.array([bytes(c) for c in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    n, held = blocks.agg(F.count("*"), F.sum("tokens")).first()
    spark = blocks.sparkSession
    tasks = min(n, max(3 * spark.sparkContext.defaultParallelism, math.ceil((held or 0) / FILE_TOKENS)))
    return blocks.repartition(max(1, tasks)).mapInArrow(each, schema)


def documents_of(pieces: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from saved pieces.

    Only documents that go over several blocks are grouped, and their pieces in two steps, so that no task has more than
    some thousands of one document.
    """
    fields = [x.split()[0] for x in _PIECES.split(", ")]

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["start"])
        out = rows[0]
        for r in rows[1:]:
            if r["start"] != out["start"] + out["n_tokens"]:
                raise ValueError("a document lacks a piece")
            out["ids_crc32"] = joined_crc(out["ids_crc32"], r["ids_crc32"], 4 * r["n_tokens"])
            out["n_tokens"] += r["n_tokens"]
        return pa.table({f: pa.array([out[f]], table.schema.field(f).type) for f in fields})

    pieces = pieces.select(*fields)
    cut = pieces.filter(~F.col("whole"))
    part = F.floor(F.col("start") / (BLOCK_TOKENS * _FAN))
    some = cut.groupBy("file", "doc", part.alias("part")).applyInArrow(join, _PIECES)
    long = some.groupBy("file", "doc").applyInArrow(join, _PIECES)
    return pieces.filter("whole").unionByName(long).select("doc_id", "start", "n_tokens", "ids_crc32")


def _shared(spark: SparkSession, folder: str) -> str:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", whole)


def write_and_read(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    files: int | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Write ``docs`` to token files and give their pieces read back (see ``documents_of``), ``with_ids`` their ids as well.

    A document's tokens are those of its whole text, then ``end_id``; a null or empty text has that one token. Documents stand
    in ascending order of ids; rows that repeat an id keep the order of the table, null ids come last and stay null. An empty
    table gives no files and no rows. Other columns don't matter.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token_streams")
    spelled = scratch.save(spell(docs, id_col, text_col, tokenizer, end_id))
    tokens = spelled.agg(F.sum("n")).first()[0] or 0
    wanted = files or max(1, math.ceil(tokens / FILE_TOKENS), min(2 * spark.sparkContext.defaultParallelism, tokens // block_tokens))
    manifest = scratch.save(write_files(spelled, frequencies(spelled), _shared(spark, f"{scratch.base}/files"), wanted, speller(tokenizer or tokenizer_path()).kind, block_tokens))
    scratch.drop(spelled)
    return scratch.save(read_pieces(scratch.save(checkpoints(manifest)), with_ids))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row a document, from the files: id, start, n_tokens, ids_crc32; ``how`` as in ``write_and_read``."""
    return documents_of(write_and_read(docs, id_col, text_col, **how)).withColumnRenamed("doc_id", id_col)
