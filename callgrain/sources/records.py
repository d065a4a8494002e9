"""Tables of samples, voiceprints, versions and settings: readers that check, and writers that can run twice."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Schema of a dataset's metadata lines.
METADATA = "file string, label string, split string, speaker_id string, codec1 string, codec2 string, rt60 double, distance_m double, device string, snr_db double, details string"
#: Schema of uploaded samples.
SAMPLES = "id string, file_path string, label string, duration_s double, net_speech_s double, qc_json string, notes string, created_at timestamp"
LABELS = ("normal", "relay")
VOICEPRINT = "id string, embedding array<float>, meta map<string,string>"
#: Numbers in a voiceprint.
DIMENSIONS = 192


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).schema  # noqa: B018  resolving the path is the test
        return True
    except AnalysisException:
        return False


def read_lines(spark: SparkSession, path: str, schema: str, must_exist: bool = False) -> DataFrame:
    """JSON lines under a schema. Malformed lines are left out; a missing file is empty, or an error if it must exist."""
    if exists(spark, path):
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if must_exist:
        raise FileNotFoundError(path)
    return spark.createDataFrame([], schema)


def metadata(spark: SparkSession, folder: str, name: str = "metadata.jsonl") -> DataFrame:
    return read_lines(spark, f"{folder.rstrip('/')}/{name}", METADATA, must_exist=True)


def present(rows: DataFrame, files: DataFrame, key: str = "file") -> DataFrame:
    """Rows whose file is among ``files``: a semi-join with a listing, not a look at each path."""
    return rows.join(files.select(F.col(key)), key, "left_semi")


def done(written: DataFrame, files: DataFrame) -> DataFrame:
    """(file) of what has both a metadata line and its file: what a build that goes on may leave out."""
    return present(written.select("file").filter("file is not null").distinct(), files)


def append_new(planned: DataFrame, path: str, key: str = "file") -> int:
    """Appends the rows of ``planned`` whose key is not yet at ``path`` (Parquet), and counts them: running twice adds nothing."""
    spark = planned.sparkSession
    if exists(spark, path):
        planned = planned.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh = planned.dropDuplicates([key]).withColumn("_batch", F.lit(batch := uuid.uuid4().hex))
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).filter(F.col("_batch") == batch).count()


def check_samples(rows: DataFrame, shortest: float = 2.0, longest: float = 120.0) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): the label must be one of LABELS, the duration in its limits, the id there and once."""
    copies = F.count("*").over(_by("id"))
    reason: Column = (
        F.when(F.col("id").isNull(), "no id")
        .when(F.coalesce(~F.col("label").isin(*LABELS), F.lit(True)), "label")
        .when(F.coalesce(F.col("duration_s") < shortest, F.lit(True)), "too short")
        .when(F.col("duration_s") > longest, "too long")
        .when(copies > 1, "id is not unique")
    )
    told = rows.withColumn("reason", reason)
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null")


def _by(*names: str):
    from pyspark.sql import Window

    return Window.partitionBy(*names)


class SampleStore:
    """Labelled uploads as one Parquet table below ``folder``: rows are appended, and a deleted id is a row in a second table.

    A listing leaves out deleted ids by an anti-join, so nothing is rewritten, and ``compact`` writes what is left to a new
    folder. Audio is kept next to the rows, as a column of its own table.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def save(self, rows: DataFrame) -> DataFrame:
        """Stores (label, content, duration_s, net_speech_s, qc_json, notes) and returns the stored rows; raises on a bad label."""
        if not rows.filter(F.coalesce(~F.col("label").isin(*LABELS), F.lit(True))).isEmpty():
            raise ValueError(f"label must be one of {LABELS}")
        batch = uuid.uuid4().hex
        own = F.sha2(F.concat_ws(":", F.lit(batch), F.col("label"), F.sha2("content", 256), F.monotonically_increasing_id().cast("string")), 256)
        named = rows.withColumn("id", F.substring(own, 1, 32)).withColumn("file_path", F.concat("id", F.lit(".wav"))).withColumn("created_at", F.current_timestamp())
        kinds = {c.split()[0]: c.split()[1] for c in SAMPLES.split(", ")}
        full = named.select(*[(F.col(c) if c in named.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()], "content")
        full.write.parquet(f"{self.folder}/batches/{batch}")  # ids are drawn once, here
        stored = self.spark.read.parquet(f"{self.folder}/batches/{batch}")
        stored.select("id", "content").write.mode("append").parquet(f"{self.folder}/audio")
        stored.drop("content").write.mode("append").parquet(f"{self.folder}/samples")
        return stored.drop("content")

    def list(self) -> DataFrame:
        """Newest first."""
        gone = self._table("deleted", "id string")
        return self._table("samples", SAMPLES).join(gone, "id", "left_anti").orderBy(F.desc("created_at"), "id")

    def counts(self) -> DataFrame:
        return self.list().groupBy("label").agg(F.count("*").alias("n"))

    def delete(self, sample_id: str) -> bool:
        """False if there is no such sample."""
        if self.list().filter(F.col("id") == sample_id).isEmpty():
            return False
        self.spark.createDataFrame([(sample_id,)], "id string").write.mode("append").parquet(f"{self.folder}/deleted")
        return True

    def audio(self, rows: DataFrame) -> DataFrame:
        """(id, content) of these rows."""
        return self._table("audio", "id string, content binary").join(rows.select("id"), "id", "left_semi")


def save_voiceprints(rows: DataFrame, path: str) -> None:
    """Writes (id, embedding, meta); an embedding of another length than DIMENSIONS stops the job."""
    wrong = F.raise_error(F.concat(F.lit(f"a voiceprint has {DIMENSIONS} numbers, that of "), F.col("id"), F.lit(" does not")))
    checked = F.when(F.size("embedding") == DIMENSIONS, F.col("embedding")).otherwise(wrong)
    rows.select("id", checked.cast("array<float>").alias("embedding"), "meta").write.mode("append").parquet(path)


def load_voiceprints(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    rows = spark.read.schema(VOICEPRINT).parquet(path)
    return rows.filter(F.col("id").isin(*ids)) if ids is not None else rows


class Versions:
    """Trained versions below ``folder``: one row each, and one for each time a version was made the active one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def list(self) -> DataFrame:
        path, schema = f"{self.folder}/versions", "version long, path string, created_at timestamp, user_samples long"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def next(self) -> int:
        return self.list().agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]

    def add(self, user_samples: int) -> tuple[int, str]:
        n = self.next()
        row = [(n, f"{self.folder}/v{n}", datetime.now(UTC), user_samples)]
        self.spark.createDataFrame(row, self.list().schema).write.mode("append").parquet(f"{self.folder}/versions")
        return n, row[0][1]

    def activate(self, version: int) -> None:
        if version and self.list().filter(F.col("version") == version).isEmpty():
            raise KeyError(version)
        self.spark.createDataFrame([(version, datetime.now(UTC))], "version long, at timestamp").write.mode("append").parquet(f"{self.folder}/active")

    def current(self) -> int:
        """The version made active last; 0, what the library came with, if none was."""
        path = f"{self.folder}/active"
        if not exists(self.spark, path):
            return 0
        return self.spark.read.parquet(path).agg(F.max_by("version", "at")).first()[0]


def settings(spark: SparkSession, path: str, defaults: dict | None = None) -> dict:
    """A small JSON file of settings over ``defaults``, nested ones merged."""

    def merged(a: dict, b: dict) -> dict:
        return a | {k: merged(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    text = spark.read.text(path, wholetext=True).first()
    return merged(defaults or {}, json.loads(text[0]) if text else {})


def write_report(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def boosts(text: str) -> dict[str, float]:
    """``label:factor`` pairs with commas between, as numbers by label."""
    parts = [p.partition(":") for p in text.split(",") if p.strip()]
    return {label.strip(): float(factor) for label, _, factor in parts}


def boost_column(text: Column, label: Column) -> Column:
    """The same for a column of such texts: the label's factor, 1 without one."""
    return F.coalesce(F.try_element_at(F.str_to_map(text, F.lit(","), F.lit(":")), label).cast("double"), F.lit(1.0))
