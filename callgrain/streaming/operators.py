"""Streaming forms: sliding windows, speech-gap sessions, scores by the active version, and runs to the end of an input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.sources.records import exists
from callgrain.sources.stores import scratch


def events_stream(spark: SparkSession, sf_dir: str, files: int = 1, ended: bool = False) -> DataFrame:
    """The events as a stream: one file a trigger. Times without a zone can't carry a watermark, so they are cast.

    ``ended`` adds one row of no user, long after all others: it takes the watermark past every window, so that a
    run over what is there closes them all. Its own window stays open.
    """
    shape = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(shape).option("maxFilesPerTrigger", files).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    if ended:
        path = f"{scratch(spark)}/end"
        spark.range(1).select(*[F.lit("2200-01-01" if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in shape]).write.parquet(path)
        rows = rows.unionByName(spark.readStream.schema(shape).parquet(path))
    return rows.withColumn("t", F.col("ts").cast("timestamp"))


def sliding(stream: DataFrame, length: str, hop: str, late: str) -> DataFrame:
    return stream.withWatermark("t", late).groupBy("user_id", F.window("t", length, hop)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    return stream.withWatermark("t", late).groupBy("user_id", F.session_window("t", gap)).agg(F.count("*").alias("n"))


def swapped(stream: DataFrame, folder: str, active: Callable[[], int], load: Callable[[int], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Scores a stream by the version that ``active`` names when a batch starts, to the end of what is there; returns all rows so far, with ``version``.

    Below ``folder`` are the rows of each batch, the version it had, and the stream's checkpoint. A batch's version is written
    before its rows, and read again if the batch runs again: so it has one version, whatever happens between, and its
    rows replace those of an attempt that was cut off. A version is loaded once each time it changes.
    """
    spark, held = stream.sparkSession, {}
    folder = folder.rstrip("/")

    def score(batch: DataFrame, number: int) -> None:
        session, commit = batch.sparkSession, f"{folder}/commits/batch={number}"
        if not exists(session, f"{commit}/_SUCCESS"):
            session.createDataFrame([(active(),)], "version int").coalesce(1).write.mode("overwrite").parquet(commit)
        n = session.read.schema("version int").parquet(commit).first()[0]
        if n not in held:
            held.clear()
            held[n] = load(n)
        held[n](batch).withColumn("version", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    run = stream.writeStream.foreachBatch(score).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("batch")


#: Fixed value: the state store that keyed states with timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def collected(stream: DataFrame, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Runs a stream over all that is there, each batch written to the shared folder, and returns these tables, which go when the interpreter ends.

    In append mode a window leaves the state once the watermark is past its end; what is left then is closed by
    a last, empty batch of a stream that is told its input has ended. A batch that runs twice overwrites itself.
    The session's state store is put back after the start, since a query keeps the one it began with. ``progress`` gets the query's reports.
    """
    spark = stream.sparkSession
    top, key = scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    shape = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/out/batch={number}")

    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        run = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
    run.awaitTermination()
    if progress is not None:
        progress.extend(run.recentProgress)
    if not exists(spark, f"{top}/out"):  # no batch
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(f"{top}/out")
