"""Datasets of labelled samples: plans as tables, made by tasks, written so that a build can go on where it ended.

What a sample's channel does to its clip is the caller's own function of the planned rows; nothing here simulates one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.functions import calls as kernels
from callgrain.operators import calls as ca
from callgrain.operators import segments as seg
from callgrain.operators.scenes import channel_class
from callgrain.operators.splits import hash_limit, sample_seed, stratified

RATE = 16000
#: The labels of samples.
LABELS = ["relay", "direct", "hardneg_tv", "hardneg_reverb", "hardneg_ns", "hardneg_headset", "hardneg_car"]
#: Schema of a sample.
MADE = "file string, label string, split string, speaker_id string, codec1 string, codec2 string, rt60 double, distance_m double, device string, snr_db double, details string, samples array<double>"


def pick(key: Column, n: Column | int) -> Column:
    """A number from 0 to n - 1 that the key fixes."""
    return F.pmod(sample_seed(key), n if isinstance(n, Column) else F.lit(n)).cast("int")


def held_out(values: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The n rows of ``values`` that only the test split has: the first ones in a hashed order."""
    return hash_limit(values, F.concat_ws(":", F.lit(str(seed)), *values.columns), n)


def _from(values: list, key: Column) -> Column:
    return F.array(*[F.lit(v) if not isinstance(v, tuple) else F.struct(F.lit(v[0]).alias("codec1"), F.lit(v[1]).alias("codec2")) for v in values])[pick(key, len(values))]


def profiles(plan: DataFrame, devices: list[str], pairs: list[tuple[str, str]], held_devices: list[str], held_pairs: list[tuple[str, str]]) -> DataFrame:
    """Adds device, codec1 and codec2 to relays: what is held out is drawn by half of the test split and by no one else."""
    free = [d for d in devices if d not in held_devices]
    key = lambda what: F.concat_ws(":", F.col("seed").cast("string"), F.lit(what))
    half = lambda what: (F.col("split") == "test") & (pick(key(what), 2) == 0)
    device = F.when(half("held device"), _from(held_devices, key("device"))).otherwise(_from(free, key("device")))
    pair = F.when(half("held pair"), _from(held_pairs, key("pair"))).otherwise(_from([p for p in pairs if p not in held_pairs], key("pair")))
    relay = F.col("label") == "relay"
    return plan.withColumn("device", F.when(relay, device)).withColumn("_pair", F.when(relay, pair)).select("*", "_pair.codec1", "_pair.codec2").drop("_pair")


def plan(speakers: DataFrame, per_label: int, seed: int = 0, labels: list[str] = LABELS, shard: int = 0, shards: int = 1) -> DataFrame:
    """(file, label, i, split, seed, speaker, clip, other_clip) for each sample of a shard.

    speakers: (split, speaker, files). Splits follow each other eight, one, one; where a split has no speaker, one that
    has is drawn. A sample's clip, and for television that of another speaker, are drawn by its seed.
    """
    spark = speakers.sparkSession
    rows = spark.range(per_label).select(F.col("id").alias("i"), F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")).filter((F.col("i") % shards) == shard)
    key = F.concat_ws(":", F.lit(str(seed)), "label", F.col("i").cast("string"))
    rows = stratified(rows.withColumn("seed", sample_seed(key)), F.col("i")).withColumn("file", F.format_string("%s/%06d.wav", "label", "i"))
    sizes = {r.split: r["count"] for r in speakers.groupBy("split").count().collect()}  # three splits
    if not sizes:
        raise ValueError("no speakers")
    full = [s for s in ("train", "dev", "test") if sizes.get(s)]
    rows = rows.withColumn("split", F.when(F.col("want").isin(*full), F.col("want")).otherwise(_from(full, F.concat(key, F.lit(":split")))))
    count = F.create_map(*[F.lit(x) for s in full for x in (s, sizes[s])])
    from pyspark.sql import Window

    ordered = speakers.withColumn("at", F.row_number().over(Window.partitionBy("split").orderBy("speaker")) - 1)
    rows = rows.withColumn("at", pick(F.concat(key, F.lit(":speaker")), count[F.col("split")]))
    chosen = rows.join(ordered, ["split", "at"]).withColumn("clip", F.col("files")[pick(F.concat(key, F.lit(":clip")), F.size("files"))])
    other = ordered.select("split", F.col("at").alias("other_at"), F.col("speaker").alias("other"), F.col("files").alias("other_files"))
    chosen = chosen.withColumn("other_at", F.pmod(F.col("at") + 1 + pick(F.concat(key, F.lit(":other")), F.greatest(count[F.col("split")] - 1, F.lit(1))), count[F.col("split")]).cast("int"))
    both = chosen.join(other, ["split", "other_at"], "left")
    tv = (F.col("label") == "hardneg_tv") & (F.col("other") != F.col("speaker"))
    return both.select("file", "label", "i", "split", "seed", F.col("speaker").alias("speaker_id"), "clip", F.when(tv, F.col("other_files")[0]).alias("other_clip"))


def sliced(samples: Column, n: int, key: Column) -> Column:
    """n samples from a place that the key fixes; zeros after a shorter signal."""
    room = F.greatest(F.size(samples) - n + 1, F.lit(1))
    cut = F.slice(samples, pick(key, room) + 1, F.lit(n))
    return F.concat(cut, F.array_repeat(F.lit(0.0), F.lit(n) - F.size(cut)))


def clipped(planned: DataFrame, clips: DataFrame, seconds: float = 4.0) -> DataFrame:
    """Rows of MADE of a plan with device, codec1 and codec2: the clean part of the clip (file, samples) that the seed fixes."""
    own = clips.select(F.col("file").alias("clip"), F.col("samples").alias("clean"))
    part = sliced(F.col("clean").cast("array<double>"), int(seconds * RATE), F.col("seed").cast("string"))
    known = {"samples": part, "details": F.lit("{}"), "codec1": F.coalesce("codec1", F.lit("none")), "codec2": F.coalesce("codec2", F.lit("none")), "device": F.coalesce("device", F.lit("none"))}
    known |= {"rt60": F.lit(0.0), "distance_m": F.lit(0.0), "snr_db": F.lit(-1.0)}
    names = [c.split()[0] for c in MADE.split(", ")]
    return planned.join(own, "clip").select(*[known.get(c, F.col(c)).alias(c) for c in names])


def real_segments(calls: DataFrame, shortest: float = 3.0, longest: float = 8.0, seconds: float = 4.0, floor_db: float = -40.0, peak: float = 0.7) -> DataFrame:
    """(call_id, segment_idx, start_s, duration_s, channel, samples): stretches of speech as samples of a fixed length.

    Pauses under the gap of turns are bridged, long stretches are cut, quiet ones left out; the rest is brought to one
    peak and the middle is taken. Stretches travel to the calls, as arrays by call.
    """
    parts = seg.cut_runs(ca.turns(ca.tracks(calls)).drop("turn_ix"), shortest, longest)
    each = parts.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("from_s", "to_s"))).alias("parts"))
    rows = calls.select("call_id", "samples").join(each, "call_id")
    kind = calls.schema["call_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for call, samples, parts in zip(batch.call_id, batch.samples, batch.parts, strict=True):
                x, n = np.asarray(samples, float), 0
                for part in parts:
                    own = x[int(part["from_s"] * RATE) : int(part["to_s"] * RATE)]
                    if len(own) >= int(shortest * RATE) and 20 * np.log10(np.sqrt((own**2).mean()) + 1e-12) >= floor_db:
                        own, room = own * (peak / np.abs(own).max()), int(seconds * RATE)
                        middle = own[max(0, (len(own) - room) // 2) :][:room]
                        out.append((call, n, part["from_s"], round(len(own) / RATE, 3), kernels.share_above(own), np.pad(middle, (0, room - len(middle)))))
                        n += 1
            yield pd.DataFrame(out, columns=["call_id", "segment_idx", "start_s", "duration_s", "high", "samples"])

    found = rows.mapInPandas(cut, f"call_id {kind}, segment_idx int, start_s double, duration_s double, high double, samples array<double>")
    return found.select("call_id", "segment_idx", "start_s", "duration_s", channel_class(F.col("high")).alias("channel"), "samples")


def protocol(segments: DataFrame, target: int) -> DataFrame:
    """Adds ``role`` rows direct or relay: with twice the target of narrow segments, the first half in a hashed order of
    calls is direct and the rest relay; with fewer, narrow ones are both and the others relay."""
    narrow = F.col("channel") == "narrowband"
    n = segments.agg(F.count_if(narrow).alias("_n"))  # one row
    rows = segments.crossJoin(F.broadcast(n))
    side = F.when(pick(F.concat(F.lit("half:"), F.col("call_id").cast("string")), 2) == 0, "direct").otherwise("relay")
    roles = F.when(F.col("_n") >= 2 * target, F.when(narrow, F.array(side))).otherwise(F.when(narrow, F.array(F.lit("direct"), F.lit("relay"))).otherwise(F.array(F.lit("relay"))))
    return rows.select(*segments.columns, F.explode(roles).alias("role"))


def build(speakers: DataFrame, clips: DataFrame, folder: str, per_label: int, seed: int = 0, labels: list[str] = LABELS, shard: int = 0, shards: int = 1, seconds: float = 4.0, devices: DataFrame | None = None, pairs: DataFrame | None = None, render: Callable[[DataFrame, DataFrame, float], DataFrame] = clipped) -> dict[str, int]:
    """Makes what a plan lacks below ``folder``: WAV files, and their lines in the table ``metadata``. Counts by label.

    ``render`` makes rows of MADE of planned rows and clips; by itself a sample is a part of its clip. ``devices`` (device) and
    ``pairs`` (codec1, codec2) are small tables of what relays draw from, of which two rows and one are held out.
    What has both its line and its file is left out, so a build that was stopped goes on where it ended.
    """
    from callgrain.sources import audio, records

    spark, path = speakers.sparkSession, f"{folder.rstrip('/')}/metadata"
    planned = plan(speakers, per_label, seed, labels, shard, shards)
    if devices is None or pairs is None:
        planned = planned.withColumns({c: F.lit(None).cast("string") for c in ("device", "codec1", "codec2")})
    else:
        every, both = [d for (d,) in devices.collect()], [tuple(r) for r in pairs.collect()]
        held = [d for (d,) in held_out(devices, 2, seed).collect()], [tuple(r) for r in held_out(pairs, 1, seed).collect()]
        planned = profiles(planned, every, both, *held)
    if records.exists(spark, path):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(folder)
        there = files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"))
        planned = planned.join(records.done(spark.read.parquet(path), there), "file", "left_anti")
    records.append_new(audio.write_audio(render(planned, clips, seconds), folder).drop("bytes"), path)
    rows = spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n")).collect()
    return {r.label: r.n for r in rows}
