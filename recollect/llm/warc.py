"""WARC archives as a chunked record table.

Writing: each payload is cut into chunks of bounded size where it is read, and only chunks travel from there: to a worker
that sends them out through one open gzip member a record, while a SHA-1 runs along. Which record is the response is
settled beforehand on digests alone. Reading: archives are decompressed in blocks, and each payload comes out as rows of
record identifier and chunk number, every row with the size and digest of the payload so far. Neither writer nor reader
ever holds a whole record, so a payload may be larger than a worker's memory.

Archives go to the shared folder (any file system that Arrow opens by its address; s3a and abfss are read as s3 and
abfs). A writer's file counts only once its task has ended and its name stands in the written manifest; what a lost
attempt left is never read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import HEAVY_ROWS, HEAVY_SHARE, Scratch

#: Bytes of a payload in a chunk row, on its way to the writer and read back.
CHUNK = 1 << 16
#: Bytes of an archive after which the next record starts another; bytes of archives that one task reads, about.
ARCHIVE_BYTES = 1 << 28
TASK_BYTES = 1 << 30
_BLOCK = 1 << 18
#: Addresses that Spark and Arrow spell differently.
_ARROW = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNKS = (
    "archive string, record_id string, record_type string, page_id long, refers_to long, target string, stated_bytes long, "
    "stated_digest string, chunk_no long, data binary, payload_bytes long, payload_digest string, last boolean"
)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def plan_chunks(
    pages: DataFrame, scratch: Scratch, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK
) -> DataFrame:
    """The payloads in chunk rows, those of a record together and in order, and before them what is to be known of each.

    Columns: sha1, size, proof (a second hash), first, id, url, row, k, data. Payloads are equal when SHA-1, XXH64 and size
    agree. Of equal payloads of at least ``min_bytes`` bytes that with the largest id is the response; its id is ``first``,
    told in a row without data that comes before the chunks, or on the chunks themselves where a payload is so common that
    its records are spread over the tasks.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload")
    )
    key = ["sha1", "size", "proof"]
    named = [F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"), F.xxhash64("payload").alias("proof")]
    n_chunks = F.greatest(F.ceil(F.col("size") / chunk), F.lit(1)).cast("int")
    groups = rows.select("id", *named).groupBy(*key).agg(F.max("id").alias("first"), F.count("*").alias("n"))
    groups = scratch.save(groups.filter((F.col("size") >= min_bytes) & (F.col("n") > 1) & F.col("first").isNotNull()).withColumn("rows", F.col("n") * n_chunks))
    total = groups.agg(F.sum("rows")).first()[0] or 0
    common = F.col("rows") >= max(HEAVY_ROWS, total // HEAVY_SHARE)  # at most HEAVY_SHARE payloads
    cut = rows.select("id", "url", *named, F.monotonically_increasing_id().alias("row"), "payload")
    cut = cut.join(F.broadcast(groups.filter(common).select(*key, "first")), key, "left")
    # of what is known to be a revisit here one row without data is enough
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.when(again, 0).otherwise(n_chunks - 1))).alias("k"))
    # bytes of a binary column are sliced where they lie: each chunk costs its own length
    data = F.when(again, F.lit(b"")).otherwise(F.substring("payload", F.col("k") * chunk + 1, F.lit(chunk)))
    cut = cut.select(F.when(F.col("first").isNotNull(), F.xxhash64("id", "url").cast("string")).otherwise(F.col("sha1")).alias("to"), *key, "first", "id", "url", "row", "k", data.alias("data"))
    none = lambda kind: F.lit(None).cast(kind)
    told = groups.filter(~common).select(
        F.col("sha1").alias("to"), *key, "first", none("long").alias("id"), none("string").alias("url"), none("long").alias("row"), F.lit(-1).alias("k"), none("binary").alias("data")
    )
    dealt = cut.unionByName(told).repartition("to")
    return dealt.sortWithinPartitions(*key, F.col("k") >= 0, "id", "url", "row", "k").drop("to")


def _address(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _header(record: str, kind: str, page: int | None, url: str | None, refers: int | None, size: int, sha1: str, length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_address(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(bytes.fromhex(sha1))}", f"X-Payload-Length: {size}"]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To-Date: {_DATE}", f"X-Refers-To-Page-ID: {refers}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def _system(address: str):
    """The Arrow file system of an address, and the path in it."""
    from pyarrow import fs

    scheme, mark, rest = address.partition("://")
    return fs.FileSystem.from_uri(f"{_ARROW.get(scheme, scheme)}://{rest}" if mark else address)


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write planned chunks; gives the manifest (archive, records, bytes), which must be saved before it is read.

    A record whose payload has a ``first`` other than its id revisits that; others are responses, so rows that repeat id
    and payload of a response are responses too. A null id is below any other; where no record of a payload has an id, all
    are responses.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(folder)
        system.create_dir(root)
        out = pack = None
        done: list[tuple[str, int, int]] = []
        name, records, left = "", 0, 0
        sha, stated, row, next_k = hashlib.sha1(), "", None, 0

        def end_record() -> None:
            nonlocal pack
            if pack is not None:
                if left or (stated and sha.hexdigest() != stated):
                    raise ValueError("a payload changed on its way to the archive")
                out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                pack = None

        def end_archive() -> None:
            nonlocal out
            end_record()
            if out is not None:
                done.append((f"{folder}/{name}", records, out.tell()))
                out.close()
                out = None

        told: tuple = ()
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for sha1, size, proof, first, page, url, own, k, data in zip(*columns, batch.column(8), strict=True):
                if k < 0:
                    told = (sha1, size, proof, first)
                    continue
                if k == 0:
                    end_record()
                    if out is not None and out.tell() >= archive_bytes:
                        end_archive()
                    if out is None:
                        name, records = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    if first is None and told[:3] == (sha1, size, proof):
                        first = told[3]
                    kind = "response" if first is None or first == page else "revisit"
                    left = size if kind == "response" else 0
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
                    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                    record = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{records}')}>"
                    out.write(pack.compress(_header(record, kind, page, url, first, size, sha1, len(http) + left) + http))
                    records += 1
                    sha, stated, row, next_k = hashlib.sha1(), sha1 if kind == "response" else "", own, 0
                if (own, k) != (row, next_k):
                    raise ValueError("the chunks of a payload came apart on their way to the archive")
                next_k += 1
                if not stated:
                    continue
                piece = data.as_py()
                sha.update(piece)
                left -= len(piece)
                out.write(pack.compress(piece))
        end_archive()
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kinds[i]) for i in range(3)], ["archive", "records", "bytes"])

    return chunks.mapInArrow(write, "archive string, records long, bytes long")


class _Stream:
    """Decompressed bytes of an archive, read in blocks."""

    def __init__(self, source) -> None:
        self.source, self.held, self.member = source, b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if self.member.eof:
                raw = self.member.unused_data or self.source.read(_BLOCK)
                self.member = zlib.decompressobj(31)
            else:
                raw = self.member.unconsumed_tail or self.source.read(_BLOCK)
            if not raw:
                return False
            if new := self.member.decompress(raw, _BLOCK):
                self.held += new
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end of the archive."""
        while mark not in self.held:
            if not self._more():
                return None
        head, _, self.held = self.held.partition(mark)
        return head + mark

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        got, self.held = self.held[:n], self.held[n:]
        return got


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines if line)}


def _number(field: str | None) -> int | None:
    return None if field is None else int(field)


def read_records(source, archive: str, with_data: bool, chunk: int = CHUNK) -> Iterator[tuple]:
    """Chunk rows of one open archive, in order; a record without payload has one row, with an empty chunk."""
    stream = _Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        f = _fields(head)
        length = int(f["content-length"])
        http = stream.until(b"\r\n\r\n") if length else b""
        left = length - len(http)
        sha, size, no = hashlib.sha1(), 0, 0
        stated = f.get("warc-payload-digest", "").removeprefix("sha1:")
        fixed = (archive, f["warc-record-id"], f["warc-type"], _number(f.get("x-page-id")), _number(f.get("x-refers-to-page-id")), f.get("warc-target-uri"), int(f["x-payload-length"]), stated)
        while True:
            data = stream.take(min(left, chunk))
            if left and not data:
                raise ValueError(f"{archive} ends within a record")
            left -= len(data)
            size += len(data)
            sha.update(data)
            digest = base32_sha1(sha.digest())
            if not left and f["warc-type"] == "response" and (digest != stated or size != fixed[6]):
                raise ValueError(f"{archive}: a payload doesn't have the digest it states")
            yield (*fixed, no, data if with_data else None, size, digest, not left)
            no += 1
            if not left:
                break
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"{archive}: a record doesn't end where it should")


def read_chunks(manifest: DataFrame, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives in a saved manifest. Without data the chunks' bytes stay on the workers."""
    names = [x.split()[0] for x in _CHUNKS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, _CHUNKS.split(", "), strict=True)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        rows: list[tuple] = []
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = _system(archive)
                with system.open_input_stream(path, compression=None) as source:
                    held = 0
                    for row in read_records(source, archive, with_data, chunk):
                        rows.append(row)
                        held += len(row[9] or b"")
                        if len(rows) >= 4_096 or held >= 8 * CHUNK:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    # left to itself Spark would read this short list of names, and so all archives, in one task
    archives, held = manifest.agg(F.count("*"), F.sum("bytes")).first()
    tasks = min(archives, max(3 * manifest.sparkSession.sparkContext.defaultParallelism, math.ceil((held or 0) / TASK_BYTES)))
    return manifest.select("archive").repartition(max(1, tasks)).mapInArrow(read, _CHUNKS)


def round_trip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", with_data: bool = False) -> DataFrame:
    """Write ``pages`` to archives and give the chunk table read back from them. Other columns don't matter."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch.base}/archives")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    folder = re.sub(r"^file:/+", "file:///", folder)
    planned = plan_chunks(pages, scratch, min_bytes, id_col, url_col, payload_col)
    return read_chunks(scratch.save(write_archives(planned, folder)), with_data)


def records_of(chunks: DataFrame) -> DataFrame:
    """One row a record, from its last chunk: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest are those that ran along with a response's chunks; a revisit has no payload of its own and states
    those of the record that it refers to.
    """
    whole = F.col("record_type") == "response"
    return chunks.filter("last").select(
        "page_id", F.when(whole, F.col("payload_bytes")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(whole, F.col("payload_digest")).otherwise(F.col("stated_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
