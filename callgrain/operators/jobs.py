"""Jobs with stages: a small table of what a job is doing, written as it goes, from which its status is read."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgrain.sources.records import exists

STAGES = "job string, seq long, stage string, state string, at double, note string"


class Busy(RuntimeError):
    """Another job is running."""


class Jobs:
    """The jobs below ``folder``. One runs at a time; one that has not been heard of for ``stale_s`` counts as dead."""

    def __init__(self, spark: SparkSession, folder: str, stale_s: float = 3600.0) -> None:
        self.spark, self.path, self.stale = spark, f"{folder.rstrip('/')}/stages", stale_s

    def table(self) -> DataFrame:
        return self.spark.read.schema(STAGES).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], STAGES)

    def latest(self) -> DataFrame:
        """(job, seq, stage, state, at, note): the last row of each job."""
        order = Window.partitionBy("job").orderBy(F.desc("seq"))
        return self.table().withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")

    def status(self, job: str | None = None, now: float | None = None) -> dict:
        """What a job, or the last one begun, is doing: job, stage, state (running, done, failed, dead, or idle without any), at and note."""
        rows = self.latest().filter(F.col("job") == job) if job else self.latest().orderBy(F.desc("at"), "job").limit(1)
        row = rows.first()
        if row is None:
            return {"job": job, "stage": None, "state": "idle", "at": None, "note": None}
        found = row.asDict()
        found.pop("seq")
        if found["state"] == "running" and (time.time() if now is None else now) - found["at"] > self.stale:
            found["state"] = "dead"
        return found

    def stages(self, job: str) -> DataFrame:
        """(stage, state, at, seconds): a job's stages in their order, with the time each took."""
        order = Window.partitionBy("job").orderBy("seq")
        rows = self.table().filter(F.col("job") == job).withColumn("seconds", F.lead("at").over(order) - F.col("at"))
        return rows.orderBy("seq").select("stage", "state", "at", "seconds", "note")

    @contextmanager
    def run(self, kind: str, now: float | None = None) -> Iterator[Job]:
        """A job that is begun here; raises Busy while another one runs. It is done or failed at the end of the block."""
        running = [r for r in self.latest().filter("state = 'running'").collect() if (time.time() if now is None else now) - r.at <= self.stale]
        if running:  # one at most, but for jobs begun within the same moment
            raise Busy(f"job {running[0].job} is in stage {running[0].stage}")
        job = Job(self, f"{kind}-{uuid.uuid4().hex[:12]}")
        job.say("begin")
        try:
            yield job
        except BaseException as error:
            job.say(job.stage_name, "failed", f"{type(error).__name__}: {error}"[:500])
            raise
        job.say("end", "done")


class Job:
    def __init__(self, jobs: Jobs, name: str) -> None:
        self.jobs, self.name, self.seq, self.stage_name = jobs, name, 0, "begin"

    def say(self, stage: str, state: str = "running", note: str | None = None) -> None:
        self.seq, self.stage_name = self.seq + 1, stage
        row = [(self.name, self.seq, stage, state, time.time(), note)]
        self.jobs.spark.createDataFrame(row, STAGES).coalesce(1).write.mode("append").parquet(self.jobs.path)
