"""Chunks of records with manifests, as a data source of Spark: ``df.write.format("chunks")``, ``spark.read.format("chunks")``.

A chunk is one or more files of gzipped JSON lines. A writer's files have names of their own and are in no manifest; only when all
tasks have ended does the driver write one manifest that names them, to a file of another name first and then by moving it. So
chunks and manifest appear together or not at all: what a task that was lost or a write that was broken off has left is never
read. A reader takes what the manifests list, cut into partitions by bytes.

    register(spark)
    rows.repartition("chunk_id").write.format("chunks").option("by", "chunk_id").mode("append").save(folder)
    spark.read.format("chunks").schema("id long, content string").option("known", "ab12,cd34").load(folder)

Options: ``by``, the column that names a row's chunk (it isn't written again into the rows' own fields when the schema read lacks it);
``createdBy``; ``maxBytes`` of JSON after which a chunk goes on in another file; ``known``, chunks not to be read or written;
``partitionBytes`` of a partition that is read.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from recollect.sources.files import system

MAX_BYTES, PARTITION_BYTES = 64 << 20, 64 << 20
_ROWS = 4_096
_MANIFEST = "manifest-"


@dataclass
class Entry:
    """A file of a chunk, as a manifest lists it."""

    id: str
    file: str
    rows: int
    bytes: int
    created_by: str = ""


@dataclass
class Written(WriterCommitMessage):
    entries: list[Entry] = field(default_factory=list)


@dataclass
class Files(InputPartition):
    entries: list[Entry]


def manifests(folder: str) -> list[Entry]:
    """All entries of the manifests of a folder, in the order of the manifests' names; none where there is no folder."""
    from pyarrow import fs

    store, root = system(folder)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    out: list[Entry] = []
    for info in sorted(found, key=lambda f: f.path):
        if info.base_name.startswith(_MANIFEST) and info.base_name.endswith(".json"):
            with store.open_input_stream(info.path, compression=None) as source:
                out += [Entry(**e) for e in json.loads(source.read())["chunks"]]
    return out


class ChunkWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.folder, self.by = options["path"].rstrip("/"), options.get("by", "chunk_id")
        self.most, self.author = int(options.get("maxbytes", MAX_BYTES)), options.get("createdby", "")
        self.known = {x for x in options.get("known", "").split(",") if x}
        if overwrite:
            raise ValueError("chunks are only ever added; use mode append")
        if self.by not in schema.names:
            raise ValueError(f"there is no column {self.by} to name chunks by")

    def write(self, iterator: Iterator) -> Written:
        store, root = system(f"{self.folder}/chunks")
        store.create_dir(root)
        done, open_ = Written(), {}

        def close(chunk: str) -> None:
            raw, packed, entry = open_.pop(chunk)
            packed.close()
            raw.close()
            done.entries.append(entry)

        for row in iterator:
            values = row.asDict(recursive=True)
            chunk = str(values[self.by])
            if chunk in self.known:
                continue
            if chunk not in open_:
                if len(open_) >= 64:  # rows should come by chunk; if they don't, a chunk has more files
                    close(next(iter(open_)))
                name = f"{chunk}-{uuid.uuid4().hex}.jsonl.gz"
                raw = store.open_output_stream(f"{root}/{name}", compression=None)
                open_[chunk] = (raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0), Entry(chunk, name, 0, 0, self.author))
            line = json.dumps(values, ensure_ascii=False, default=str).encode() + b"\n"
            _, packed, entry = open_[chunk]
            packed.write(line)
            entry.rows += 1
            entry.bytes += len(line)
            if entry.bytes >= self.most:
                close(chunk)
        for chunk in list(open_):
            close(chunk)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        entries = [vars(e) for m in messages if m for e in m.entries]
        if not entries:
            return
        store, root = system(self.folder)
        name = f"{_MANIFEST}{len([e for e in manifests(self.folder)]):012d}-{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{root}/_{name}", compression=None) as out:
            out.write(json.dumps({"version": 1, "chunks": entries}).encode())
        store.move(f"{root}/_{name}", f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = system(f"{self.folder}/chunks")
        for m in messages:
            for e in m.entries if m else ():
                store.delete_file(f"{root}/{e.file}")


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.folder, self.schema = options["path"].rstrip("/"), schema
        self.known = {x for x in options.get("known", "").split(",") if x}
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        out, size = [], 0
        for e in manifests(self.folder):
            if e.id in self.known:
                continue
            if not out or size + e.bytes > self.most:
                out.append(Files([]))
                size = 0
            out[-1].entries.append(e)
            size += e.bytes
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        store, root = system(f"{self.folder}/chunks")
        for e in partition.entries:
            rows: list[dict] = []
            with store.open_input_stream(f"{root}/{e.file}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as lines:
                for line in lines:
                    rows.append({"chunk_id": e.id} | json.loads(line))
                    if len(rows) == _ROWS:
                        yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in kinds.names} for r in rows], schema=kinds)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in kinds.names} for r in rows], schema=kinds)


class Chunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        return "chunk_id string"

    def reader(self, schema: StructType) -> ChunkReader:
        return ChunkReader(_lower(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(_lower(self.options), schema, overwrite)


def _lower(options) -> dict[str, str]:
    return {k.lower(): v for k, v in options.items()}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Chunks)
