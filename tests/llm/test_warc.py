import base64
import gzip
import hashlib
import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from recollect.llm import warc
from recollect.llm.common import Scratch

LONG = "páge\r\n\r\nWARC/1.1 " * 30_000
ROWS = [(1, "http://a\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", LONG), (6, "u", LONG), (7, "u", "alone"), (None, "u", "alone"), (None, "u", "none"), (8, "u", "twice"), (8, "u", "twice")]
SCHEMA = "page_id long, url string, html string"


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).withColumn("size", F.lit("clash")).repartition(3)
    for least in (0, 100):
        got = sorted(map(tuple, warc.records_of(warc.round_trip(pages, least)).collect()), key=str)
        best = defaultdict(list)
        for i, _, t in ROWS:
            best[t or ""].append(i)
        want = []
        for i, _, t in ROWS:
            top = max((x for x in best[t or ""] if x is not None), default=None)
            again = top is not None and i != top and len((t or "").encode()) >= least
            want.append((i, len((t or "").encode()), digest(t), "revisit" if again else "response", top if again else None))
        assert got == sorted(want, key=str)


def test_chunks_rebuild_payloads_and_carry_digests(spark):
    chunks = warc.round_trip(spark.createDataFrame(ROWS[:7], SCHEMA), with_data=True).collect()
    long = sorted((r for r in chunks if r.page_id == 6), key=lambda r: r.chunk_no)
    assert len(long) > 5 and b"".join(r.data for r in long).decode() == LONG
    sha = hashlib.sha1()
    for r in long:
        sha.update(r.data)
        assert r.payload_digest == base64.b32encode(sha.digest()).decode() and len(r.data) <= warc.CHUNK
    assert [r.last for r in long] == [False] * (len(long) - 1) + [True]


def test_archives_are_plain_warc_and_roll_over(spark, tmp_path):
    scratch = Scratch(spark, "t")
    planned = warc.plan_chunks(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), scratch)
    manifest = scratch.save(warc.write_archives(planned.coalesce(1), f"file://{tmp_path}/w", archive_bytes=100))
    rows = manifest.collect()
    assert sum(r.records for r in rows) == len(ROWS) and len(rows) > 3
    text = b"".join(gzip.open(r.archive.removeprefix("file://")).read() for r in rows)
    ids = re.findall(rb"WARC-Record-ID: (\S+)", text)
    assert len(set(ids)) == len(ROWS)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"WARC-Target-URI: http://a%0D%0Ax\r\n" in text


def test_a_very_common_payload_is_spread(spark, monkeypatch):
    monkeypatch.setattr(warc, "HEAVY_ROWS", 10)
    rows = [(i, "u", LONG if i % 3 else f"own {i}") for i in range(90)]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.records_of(warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(4))).collect()}
    assert got == {i: ("response", None) if not i % 3 or i == 89 else ("revisit", 89) for i in range(90)}


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_time_grows_in_proportion_to_the_payload(spark):
    took = {}
    for mb in (1, 8, 128):
        pages = spark.range(1).select(F.lit(mb).alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("<p>é and so on</p>"), F.lit((mb << 20) // 19)).alias("html"))
        began = time.time()
        last = warc.records_of(warc.round_trip(pages)).collect()
        took[mb] = time.time() - began
        assert len(last) == 1 and last[0].payload_bytes == (mb << 20) // 19 * 19
    assert took[128] < 16 * max(took[8], 1.5)
