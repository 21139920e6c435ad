import pytest
from pyspark.sql import functions as F

from recollect.sources import chunks


def rows(spark, n=300):
    return spark.range(n).select("id", F.concat(F.lit("text é "), "id").alias("content"), F.concat(F.lit("c"), F.col("id") % 3).alias("chunk_id"), F.array("id", "id").alias("pair"))


def write(df, folder, **options):
    df.write.format("chunks").options(by="chunk_id", **options).mode("append").save(folder)


def test_chunks_come_back_split_by_bytes(spark, tmp_path):
    chunks.register(spark)
    folder = f"file://{tmp_path}/out"
    write(rows(spark).repartition(4, "chunk_id"), folder, maxBytes=1_000, createdBy="me")
    entries = chunks.manifests(folder)
    assert {e.id for e in entries} == {"c0", "c1", "c2"} and sum(e.rows for e in entries) == 300
    assert len(entries) > 9 and max(e.bytes for e in entries) < 1_200 and {e.created_by for e in entries} == {"me"}
    back = spark.read.format("chunks").schema("id long, content string, chunk_id string, pair array<long>, absent int").option("partitionBytes", 2_000).load(folder)
    assert back.rdd.getNumPartitions() > 4
    assert sorted(tuple(r) for r in back.collect()) == sorted((i, f"text é {i}", f"c{i % 3}", [i, i], None) for i in range(300))
    some = spark.read.format("chunks").schema("id long").option("known", "c0,c2").load(folder)
    assert sorted(r.id for r in some.collect()) == list(range(1, 300, 3))
    write(rows(spark, 600), folder, known="c0,c1")
    assert spark.read.format("chunks").schema("id long").load(folder).count() == 500
    write(rows(spark, 0), folder)
    assert len({e.file for e in chunks.manifests(folder)}) == len(chunks.manifests(folder))


def test_a_write_that_is_broken_off_leaves_nothing(spark, tmp_path):
    chunks.register(spark)
    folder = f"file://{tmp_path}/out"
    write(rows(spark), folder)
    files = set((tmp_path / "out" / "chunks").iterdir())
    fails = rows(spark, 1_000).repartition(8).withColumn("content", F.when(F.col("id") == 777, F.raise_error(F.lit("broken off"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken off"):
        write(fails, folder)
    assert spark.read.format("chunks").schema("id long").load(folder).count() == 300
    assert len(list((tmp_path / "out").glob("*manifest-*"))) == 1
    writer = chunks.ChunkWriter({"path": folder}, rows(spark).schema, False)
    told = writer.write(iter(rows(spark, 5).collect()))
    assert spark.read.format("chunks").schema("id long").load(folder).count() == 300  # nothing is there before the commit
    writer.abort([told, None])
    assert not any(e.file in {f.name for f in (tmp_path / "out" / "chunks").iterdir()} for e in told.entries) and files
    with pytest.raises(ValueError, match="no column"):
        chunks.ChunkWriter({"path": folder, "by": "x"}, rows(spark).schema, False)
    assert spark.read.format("chunks").schema("id long").load(f"file://{tmp_path}/none").count() == 0
