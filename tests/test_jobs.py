"""Jobs and their stages; speech where the mask finds none; details that come as VARIANT."""

import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgrain import service
from callgrain.operators import guardrails as gr
from callgrain.operators import jobs as jb
from callgrain.sources import records as rec
from signals import voice


def test_a_job_tells_its_stages(spark, tmp_path):
    jobs = jb.Jobs(spark, str(tmp_path), stale_s=60)
    assert jobs.status()["state"] == "idle"
    with jobs.run("train") as job:
        job.say("fit")
        found = jobs.status()
        assert (found["job"], found["stage"], found["state"]) == (job.name, "fit", "running")
        with pytest.raises(jb.Busy, match="in stage fit"), jobs.run("train"):
            pass
    assert jobs.status(job.name)["state"] == "done"
    assert [(r.stage, r.state) for r in jobs.stages(job.name).collect()] == [("begin", "running"), ("fit", "running"), ("end", "done")]
    with pytest.raises(ZeroDivisionError), jobs.run("train") as bad:
        bad.say("judge")
        1 / 0
    found = jobs.status()
    assert (found["job"], found["stage"], found["state"]) == (bad.name, "judge", "failed") and found["note"].startswith("ZeroDivisionError")


def test_a_killed_job_shows_its_stage(spark, tmp_path):
    jobs = jb.Jobs(spark, str(tmp_path), stale_s=60)
    killed = jb.Job(jobs, "train-killed")  # it never gets to its end
    killed.say("begin")
    killed.say("anchor")
    assert jobs.status()["stage"] == "anchor" and jobs.status()["state"] == "running"
    with pytest.raises(jb.Busy), jobs.run("train"):
        pass
    later = time.time() + 61
    assert jobs.status(now=later)["state"] == "dead" and jobs.status(now=later)["stage"] == "anchor"
    with jobs.run("train", now=later) as job:
        pass
    assert jobs.status()["job"] == job.name


def test_training_says_where_it_is(spark, tmp_path):
    rng, rows = np.random.default_rng(2), []
    for i in range(8):
        for label in ("relay", "direct"):
            x = voice(rng, 2.0) if label == "direct" else np.clip(8 * voice(rng, 2.0), -0.3, 0.3)
            rows.append((f"{label}/{i}", label, "dev" if i > 5 else "train", [float(v) for v in x]))
    anchor = spark.createDataFrame(rows, "file string, label string, split string, samples array<double>").cache()
    store, versions = rec.SampleStore(spark, str(tmp_path / "store")), rec.Versions(spark, str(tmp_path / "versions"))
    from callgrain.operators import learning as le

    said = []
    uploads = anchor.filter("split = 'dev'").select(F.concat(F.lit("u/"), "file").alias("file"), "label", "samples")
    with service.training(versions).run("train") as job:
        report = le.training_job(anchor, uploads, versions, keep=lambda df: df.cache(), rounds=3, say=lambda s: (said.append(s), job.say(s)), network={"epochs": 2, "tasks": 2, "channels": (2, 4), "dense": 4})
    assert said == ["uploads", "anchor", "fit", "judge", "network", "store"] and service.training(versions).status()["state"] == "done"
    assert report["windows"] == 12 + 4 and report["dev"]["n"] == 4 and 1 <= report["rounds"] <= 3  # dev files are not trained on
    assert report["best"] in ("gbm", "cnn") and 0 <= report["dev_network"] <= 1
    assert service.active_network(spark, versions).dev_auc == report["dev_network"] and service.active_detector(spark, versions)
    with service.training(versions).run("train"), pytest.raises(jb.Busy):
        service.train(store, anchor, versions)


def test_early_stop_by_dev_rows(spark):
    from callgrain.operators import learning as le

    rng = np.random.default_rng(8)
    rows = [(f"f{i}", "relay" if y else "direct", int(y), float(rng.normal(y)), float(rng.normal())) for i, y in enumerate(rng.random(1300) < 0.5)]
    table = spark.createDataFrame(rows, "file string, label string, y int, a double, b double")
    dev = le.dev_part(F.col("file"))
    share = table.filter(dev).count() / 1300
    assert 0.12 < share < 0.22
    _, _, model = le.boosted(table.filter(~dev), table.filter(dev), ["a", "b"], rounds=60)
    assert model.getNumTrees < 60


def test_speech_where_the_mask_finds_none(spark):
    """A steady tone never rises over its own floor, so the mask is empty; by its level it is speech all through."""
    t = np.arange(32000) / 16000
    tone, hush = 0.3 * np.sin(2 * np.pi * 250 * t), 1e-5 * np.sin(2 * np.pi * 250 * t)
    step = np.concatenate([0.001 * tone, tone, 0.001 * tone, 0.001 * tone])
    speech = voice(np.random.default_rng(1), 4.0)
    table = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in {"tone": tone, "hush": hush, "speech": speech, "step": step}.items()] + [("none", [])], "call_id string, samples array<double>")
    with_fallback = {r.call_id: r.net_speech_s for r in service.net_speech(table).collect()}
    from callgrain.operators import calls as ca

    mask = {r.call_id: r.net_speech_s for r in ca.net_speech(ca.frame_track(ca.tracks(table))).collect()}
    assert mask["tone"] == mask["hush"] == 0 and with_fallback["tone"] == pytest.approx(66 * 0.03) and with_fallback["hush"] == 0
    assert with_fallback["step"] > 1.5 and (mask["step"] == 0 or mask["step"] == with_fallback["step"])
    assert mask["speech"] in (0, with_fallback["speech"]) and "none" not in with_fallback


DETAILS = [
    {"a": 1, "b": True, "c": False, "d": None, "e": "0.5", "f": " 2 ", "g": "x", "h": "1d", "i": "3f", "j": "inf", "k": "1e3", "l": [1], "m": -2.5e-3},
    {"quantization_noise": {"noise_flatness": 0.7, "flag": True, "s": "4", "deep": {"x": 1}, "l": []}, "rt60": "none", "rt60_s": 0.2},
    {"a.b": 1, "a": {"b": 2, "c": 3}},
    {},
]


def number(v):
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


@pytest.mark.parametrize("as_variant", [True, False])
def test_details_as_variant(spark, as_variant):
    texts = [json.dumps(d) for d in DETAILS] + ["[1, 2]", "3", "no json", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, details string")
    if as_variant:
        rows = rows.withColumn("details", F.try_parse_json("details"))
    found = {r.i: r.details for r in gr.as_numbers(rows).collect()}
    for i, d in enumerate(DETAILS):
        expect = {f"{k}.{n}": number(x) for k, v in d.items() if isinstance(v, dict) for n, x in v.items()} | {k: number(v) for k, v in d.items()}
        expect = {k: v for k, v in expect.items() if v is not None}
        assert found[i].keys() == expect.keys() and all(math.isclose(found[i][k], v) for k, v in expect.items()), i
    assert all(found[i] == {} for i in range(len(DETAILS), len(texts)))
    one = gr.as_numbers(rows.filter("i = 1")).select(gr.detail(gr.RT60).alias("rt60"), gr.detail(gr.FLAT).alias("flat")).first()
    assert (one.rt60, one.flat) == (0.2, 0.7)
