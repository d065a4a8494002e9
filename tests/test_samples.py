"""The sample store as a data source: whole writes or none, one bucket for one id, and a stream over its log."""

import pytest
from pyspark.sql import functions as F

from callgrain.sources import samples as sm


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(sm.Samples)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def rows(spark, first, last):
    ids = F.concat(F.lit("s"), F.col("id").cast("string"))
    content = F.when(F.col("id") % 5 > 0, F.encode(ids, "utf-8"))
    return spark.range(first, last, 1, 3).select(ids.alias("id"), F.when(F.col("id") % 2 == 0, "relay").otherwise("normal").alias("label"), content.alias("content"), F.lit(2.0).alias("duration_s"), F.lit(1.0).alias("net_speech_s"), F.lit("{}").alias("qc_json"), F.lit(None).cast("string").alias("notes"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))


def read(spark, path):
    return spark.read.format("callgrain_samples").option("path", path).load()


def write(df, path, mode="append"):
    df.write.format("callgrain_samples").option("path", path).mode(mode).save()


def test_round_trip_and_pushed_ids(source, tmp_path):
    path = str(tmp_path)
    write(rows(source, 0, 300), path)
    write(rows(source, 300, 400), path)
    every = rows(source, 0, 400)
    assert read(source, path).exceptAll(every).isEmpty() and every.exceptAll(read(source, path)).isEmpty()
    one = read(source, path).filter("id = 's7'")
    assert [r.label for r in one.collect()] == ["normal"] and one.rdd.getNumPartitions() == 1
    assert read(source, path).rdd.getNumPartitions() == sm.BUCKETS
    few = read(source, path).filter("id in ('s1', 's2', 's399', 'none') and label = 'relay'")
    assert sorted(r.id for r in few.collect()) == ["s2"] and few.rdd.getNumPartitions() <= 4
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert " Filter " not in plan  # none is left above the scan
    assert read(source, path).filter("label = 'relay'").count() == 200


def test_an_aborted_write_leaves_nothing(source, tmp_path):
    path = str(tmp_path)
    write(rows(source, 0, 50), path)
    before = sorted(p.name for p in tmp_path.rglob("*") if p.is_file())
    stop = F.when(F.col("id") == "s150", F.raise_error(F.lit("stop"))).otherwise(F.col("label"))
    with pytest.raises(Exception, match="stop"):
        write(rows(source, 50, 200).withColumn("label", stop), path)
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == before
    assert read(source, path).count() == 50


def test_overwriting_and_empty_stores(source, tmp_path):
    path = str(tmp_path / "new")
    assert read(source, path).count() == 0
    write(rows(source, 0, 60), path)
    write(rows(source, 10, 20), path, "overwrite")
    assert sorted(r.id for r in read(source, path).collect()) == [f"s{i}" for i in range(10, 20)]
    assert {p.name for p in (tmp_path / "new" / "data").glob("*.parquet")} == {f["file"] for f in sm._entry(*sm._log(path)[:2], sm._log(path)[2][0])}
    write(rows(source, 0, 0), path)
    assert read(source, path).count() == 10


def test_a_stream_goes_from_entry_to_entry(source, tmp_path):
    path, out = str(tmp_path / "store"), str(tmp_path / "out")

    def run():
        stream = source.readStream.format("callgrain_samples").option("path", path).load()
        stream.select("id").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.id for r in source.read.parquet(out).collect())

    write(rows(source, 0, 5), path)
    assert run() == [f"s{i}" for i in range(5)]
    write(rows(source, 5, 8), path)
    write(rows(source, 8, 9), path)
    assert run() == [f"s{i}" for i in range(9)]
