"""Audio files as calls, and calls as audio files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.functions import audio, pcm
from callgrain.sources import stores

RATE = 16000
SCHEMA = "array<double>"


def decoded(rows: DataFrame, content: str = "content", rate: int = RATE) -> DataFrame:
    """Adds ``samples`` (mono, 16 kHz) to rows with bytes: WAV or AIFF of any coding that functions/pcm.py knows, or bare
    little-endian samples of 16 bits at ``rate``. Null where the bytes can't be read, so that one bad file costs one row."""

    @F.pandas_udf(SCHEMA)
    def decode(parts: pd.Series) -> pd.Series:
        return parts.map(lambda data: None if data is None else audio.try_decode(bytes(data), RATE, rate))

    return rows.withColumn("samples", decode(content))


def read_audio(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """(call_id, file, samples) of every file below ``folder``; call_id is the file's place below it.

    Spark reads each file whole, as a row; see read_parts() for long ones.
    """
    rows = decoded(_listed(spark, folder, pattern).select("call_id", "file", "content"))
    return rows.select("call_id", "file", "samples")


def _listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(call_id, file, length, content) of the files below ``folder``; the content is read only if it is asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    place = F.substring_index("path", folder.rstrip("/").partition("://")[2] + "/" if "://" in folder else folder.rstrip("/").removeprefix("file:") + "/", -1)
    return files.select(place.alias("call_id"), F.col("path").alias("file"), "length", "content")


HEADER = "call_id string, file string, rate int, channels int, coding string, width int, big boolean, offset long, frames long"


def headers(spark: SparkSession, folder: str, pattern: str = "*.{wav,aif,aiff,aifc}") -> DataFrame:
    """(call_id, file, rate, channels, coding, width, big, offset, frames) of every sound file below ``folder``.

    Tasks read some hundred bytes of each file, in the places where its chunks begin. A file that can't be read, or
    whose coding is not known, has nulls.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_form(f) for f in batch.file]
            yield batch[["call_id", "file"]].reset_index(drop=True).join(pd.DataFrame(found, columns=pcm.Form._fields, dtype=object))

    return _listed(spark, folder, pattern).select("call_id", "file").mapInPandas(look, HEADER)


def _form(file: str) -> pcm.Form | tuple:
    try:
        source = stores.Ranges(file)
    except OSError:
        return (None,) * len(pcm.Form._fields)
    try:
        return pcm.header(source.read, source.size)
    except (ValueError, struct.error, OSError):
        return (None,) * len(pcm.Form._fields)
    finally:
        source.close()


def read_parts(spark: SparkSession, folder: str, pattern: str = "*.{wav,aif,aiff,aifc}", seconds: float = 60.0) -> DataFrame:
    """(call_id, file, part, start, samples): mono signals of 16 kHz in parts of ``seconds``; ``start`` is the first sample's place.

    A file is split by its header alone: each part is read by a task of its own, which takes the bytes under its
    samples and, where the rate is another, those that the filter reaches on either side. So the parts of a file are those
    of the whole, and a task holds one part, whatever the file's length. Files of floats may go beyond 1; their
    highest value is found by a pass of its own over their parts, and the file is scaled by it, as decode() does.
    A file that can't be read has one part without samples; one without frames has an empty one.
    """
    heads = headers(spark, folder, pattern)
    size = max(1, int(seconds * RATE))
    n_out = F.ceil(F.col("frames") * RATE / F.col("rate"))
    parts = heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(F.ceil(n_out / size) - 1, F.lit(0)), F.lit(0)).cast("int"))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(tasks, "file", "part")
    peaks = parts.filter("coding = 'float'").mapInPandas(lambda b: _read(b, size, True), "file string, peak double")
    peaks = peaks.groupBy("file").agg(F.max("peak").alias("peak"))
    return parts.join(peaks, "file", "left").repartition(tasks, "file", "part").mapInPandas(lambda b: _read(b, size, False), "call_id string, file string, part int, start long, samples array<float>")


def _read(batches: Iterator[pd.DataFrame], size: int, peak: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.to_dict("records"):
            own = {k: [r[k]] for k in ("call_id", "file", "part")} | {"start": [int(r["part"]) * size]}
            if pd.isna(r["frames"]):
                yield pd.DataFrame({"file": [r["file"]], "peak": [None]} if peak else own | {"samples": [None]})
                continue
            form = pcm.Form(*[r[k] if k in ("coding", "big") else int(r[k]) for k in pcm.Form._fields])
            resampler = pcm.resampler(form.rate, RATE)
            first = own["start"][0]
            last = min(first + size, resampler.outputs(form.frames))
            if peak:  # of the inputs that begin in this part
                a, b = first * form.rate // RATE, min(form.frames, last * form.rate // RATE + 1)
                yield pd.DataFrame({"file": [r["file"]], "peak": [float(np.abs(_mono(r["file"], form, a, b)).max(initial=0.0))]})
                continue
            a, b = resampler.needs(first, last) if last > first else (0, 0)
            x = _mono(r["file"], form, max(0, a), min(form.frames, b))
            x = np.pad(x, (max(0, -a), max(0, b - form.frames)))
            if not pd.isna(r["peak"]) and r["peak"] > 1:
                x = x / r["peak"]
            yield pd.DataFrame(own | {"samples": [resampler.run(x, a, first, last).astype(np.float32) if last > first else np.zeros(0, np.float32)]})


def _mono(file: str, form: pcm.Form, first: int, last: int) -> np.ndarray:
    """Frames [first, last) of a file, the mean over channels."""
    source, frame = stores.Ranges(file), form.width * form.channels
    try:
        x = pcm.values(source.read(form.offset + first * frame, max(0, last - first) * frame), form)
    finally:
        source.close()
    x = np.nan_to_num(x).mean(axis=1)
    return np.pad(x, (0, max(0, last - first - len(x))))


def whole(parts: DataFrame) -> DataFrame:
    """(call_id, file, samples array<float>) of parts, put together: for calls that fit into a row, of 2 GB at most."""
    each = parts.groupBy("call_id", "file").agg(F.array_sort(F.collect_list(F.struct("part", "samples"))).alias("parts"))
    return each.select("call_id", "file", F.flatten(F.transform("parts", lambda p: p.samples)).alias("samples"))


def encoded(calls: DataFrame) -> DataFrame:
    """Adds ``content``, a PCM WAV of 16 bits at 16 kHz, clipped to full scale."""

    @F.pandas_udf("binary")
    def encode(parts: pd.Series) -> pd.Series:
        return parts.map(lambda x: None if x is None else audio.encode(np.asarray(x, float), RATE))

    return calls.withColumn("content", encode("samples"))


def pcm16(calls: DataFrame) -> DataFrame:
    """Adds ``pcm``: bare little-endian samples of 16 bits."""

    @F.pandas_udf("binary")
    def bare(parts: pd.Series) -> pd.Series:
        return parts.map(lambda x: None if x is None else audio.pcm16(np.asarray(x, float)))

    return calls.withColumn("pcm", bare("samples"))


def write_audio(calls: DataFrame, folder: str) -> DataFrame:
    """Writes (file, samples) as WAV below ``folder``, which all executors see; the other columns and ``bytes`` of what was written.

    A file is written under a name of its own and then moved into place, so a task that runs twice leaves whole files.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        place, top = stores.place(folder)
        for batch in batches:
            sizes = []
            for file, samples in zip(batch.file, batch.samples, strict=True):
                data, path = audio.encode(np.zeros(0) if samples is None else np.asarray(samples, float), RATE), f"{top}/{file}"
                place.create_dir(path.rpartition("/")[0], recursive=True)
                with place.open_output_stream(draft := f"{path}.{uuid.uuid4().hex}.part", compression=None) as out:
                    out.write(data)
                place.move(draft, path)
                sizes.append(len(data))
            yield batch.drop(columns="samples").assign(bytes=sizes)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in calls.schema if f.name != "samples")
    return calls.select(*[f.name for f in calls.schema if f.name != "samples"], "samples").mapInPandas(write, f"{kinds}, bytes long")


def speakers(files: DataFrame) -> DataFrame:
    """(split, speaker, files) of (file) named .../speaker/chapter/name: the speaker is the folder above the file's."""
    from callgrain.operators.splits import speaker_split

    who = F.try_element_at(F.split("file", "/"), F.lit(-3))
    rows = files.select("file", who.alias("speaker")).filter("speaker is not null").withColumn("split", speaker_split(F.col("speaker")))
    return rows.groupBy("split", "speaker").agg(F.array_sort(F.collect_list("file")).alias("files"))
