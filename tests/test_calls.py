"""Kernels and call operators against plain loops over the same signals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgrain.functions import audio, calls
from callgrain.operators import calls as ca
from callgrain.operators import changepoint as cp
from callgrain.operators import conversation as talk
from callgrain.operators import datagen as dg
from callgrain.operators import evaluation as ev
from callgrain.operators import guardrails as gr
from callgrain.operators import learning as le
from callgrain.operators import scenes as sc
from callgrain.operators import verdict as vd
from callgrain.sources import audio as files
from callgrain.sources import records as rec
from signals import voice


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(11)
    long = np.concatenate([voice(rng, 3.0), np.zeros(16000), voice(rng, 2.5), 0.002 * rng.standard_normal(20000), voice(rng, 2.0)])
    return {"long": long, "talk": voice(rng, 4.0), "hush": 0.001 * rng.standard_normal(16000), "bit": voice(rng, 0.2), "none": np.zeros(0)}


@pytest.fixture(scope="module")
def table(spark, signals):
    rows = [(k, [float(v) for v in x]) for k, x in signals.items()] + [("null", None)]
    return spark.createDataFrame(rows, "call_id string, samples array<double>").cache()


def mask_by_loop(x):
    frames = [x[i : i + 480] for i in range(0, len(x) - 479, 480)] or ([np.pad(x, (0, 480 - len(x)))] if len(x) else [])
    level, keep = [], []
    for f in frames:
        level.append(20 * math.log10(math.sqrt(np.mean(f**2) + 1e-12) + 1e-12))
    for f, db in zip(frames, level, strict=True):
        p = np.abs(np.fft.rfft(f * np.hanning(480))) ** 2
        flat = math.exp(np.mean(np.log(p + 1e-12))) / (np.mean(p) + 1e-12)
        zcr = np.mean([(a < 0 or math.copysign(1, a) < 0) != (b < 0 or math.copysign(1, b) < 0) for a, b in zip(f, f[1:], strict=False)])
        keep.append(db > np.percentile(level, 20) + 10 and flat < 0.5 and 0.005 <= zcr <= 0.45)
    out = list(keep)
    for i, on in enumerate(keep):  # short gaps between speech are filled
        if not on:
            a = max((j for j in range(i) if keep[j]), default=None)
            b = min((j for j in range(i, len(keep)) if keep[j]), default=None)
            out[i] = a is not None and b is not None and b - a - 1 <= 5
    done, i = list(out), 0
    while i < len(out):
        j = i
        while j < len(out) and out[j] == out[i]:
            j += 1
        if out[i] and j - i < 5:
            done[i:j] = [False] * (j - i)
        i = j
    return done


def test_speech_by_numpy_and_by_spark(spark, table, signals):
    for x in signals.values():
        assert calls.speech_frames(x).tolist() == mask_by_loop(x)
    found = {(r.call_id, i) for r in ca.speech(ca.frame_track(ca.tracks(table))).collect() for i in range(r.first_i, r.last_i + 1)}
    assert found == {(k, i) for k, x in signals.items() for i in np.flatnonzero(calls.speech_frames(x)).tolist()}
    assert any(k == "long" for k, _ in found)


def test_turns_are_those_of_the_mask(table, signals):
    track = ca.tracks(table).cache()
    found = ca.described(track, ca.turns(track)).orderBy("call_id", "turn_ix").collect()
    expect = []
    for k, x in sorted(signals.items()):
        mask, parts = calls.speech_frames(x), []
        for i in np.flatnonzero(mask):
            if parts and i * 0.03 - parts[-1][1] < 0.35 - 1e-9:
                parts[-1][1] = (i + 1) * 0.03
            else:
                parts.append([i * 0.03, (i + 1) * 0.03])
        expect += [(k, n, a, b) for n, (a, b) in enumerate(parts)]
    assert [(r.call_id, r.turn_ix, pytest.approx(r.start_s), pytest.approx(r.end_s)) for r in found] == expect
    for r in found:
        own = signals[r.call_id][round(r.start_s * 16000) : round(r.end_s * 16000)]
        assert r.rms_db == pytest.approx(20 * math.log10(math.sqrt(np.mean(own**2) + 1e-12)), abs=1e-6)
        mel = audio.log_mel(own, 32, 400, 160, points=512).mean(0)
        assert np.allclose(r.frame, mel / np.linalg.norm(mel), atol=1e-9)
        pitch = calls.pitches(audio.frames(own, 640, 320))
        assert (r.mean_f0 is None and np.isnan(pitch).all()) or r.mean_f0 == pytest.approx(np.nanmedian(pitch))
        level = calls.level_db(audio.frames(own, 320, 160))
        judged = r.end_s - r.start_s >= 0.25 and len(level) >= 8
        assert r.rate == (pytest.approx(len(calls.prominent_peaks(level)) / (r.end_s - r.start_s)) if judged else None)


def test_peaks_stand_out():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = rng.integers(0, 8, int(rng.integers(1, 40))).astype(float)
        tops, i = [], 1
        while i < len(x) - 1:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
                tops.append((i + j) // 2)
            i = j + 1
        kept = set(tops)
        for p in sorted(tops, key=lambda p: (x[p], p), reverse=True):
            if p in kept:
                kept -= {q for q in kept if q != p and abs(q - p) < 6}
        expect = []
        for p in sorted(kept):
            sides = []
            for step in (-1, 1):
                low, q = x[p], p
                while 0 <= q < len(x) and x[q] <= x[p]:
                    low, q = min(low, x[q]), q + step
                sides.append(low)
            if x[p] - max(sides) >= 1.5:
                expect.append(p)
        assert calls.prominent_peaks(x).tolist() == expect


def test_tails():
    level = np.array([0.0, 0, -4, -10, -20, -26, -30, -1, -5, -27, -60, -60])
    assert calls.tail_frames(level) == [4, 5]
    assert calls.tail_frames(np.zeros(0)) == [] and calls.tail_frames(np.zeros(3)) == []


def test_coupling_is_the_best_lagged_product(spark):
    rng = np.random.default_rng(3)
    n = 400
    turns = [(1.0, 2.2), (4.0, 5.1), (7.5, 9.0), (12.0, 13.3), (16.0, 17.0)]
    db = -60 + 3 * rng.standard_normal(n)
    for a, _ in turns[1:]:
        db[int(a / 0.05) + 12 : int(a / 0.05) + 20] += 4
    t = (np.arange(n) + 0.5) * 0.05
    gap = np.ones(n, bool)
    for a, b in turns:
        gap &= ~((t >= a) & (t <= b))
    p20, p50 = np.percentile(db[gap], [20, 50])
    known = gap & (db >= p20 - 3) & (db <= p50 + 6)
    env = np.interp(np.arange(n), np.flatnonzero(known), db[known])
    on = np.zeros(n)
    for a, _ in turns[1:]:
        on[int(a * 1000 / 50)] = 1
    x, y = on - on.mean(), env - env.mean()
    best = max((x[: n - k] * y[k:]).sum() for k in range(31)) / (np.sqrt((x**2).sum() * (y**2).sum()) + 1e-12)
    grid = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(db)], "call_id string, k long, db double")
    told = spark.createDataFrame([("a", i, a, b) for i, (a, b) in enumerate(turns)], "call_id string, turn_ix long, start_s double, end_s double")
    ids = spark.createDataFrame([("a",), ("b",)], "call_id string")
    found = {r.call_id: r.coupling for r in talk.coupling(grid, told, ids).collect()}
    assert found["a"] == pytest.approx(min(max(best, 0), 1), abs=1e-9) and found["b"] == 0
    assert found["a"] > 0.05


def test_conversations_scenes_replays_and_quality(table):
    scored = {r.call_id: r for r in talk.analyze(table).collect()}
    assert scored["bit"].score == 0.1 and scored["none"].score == 0.1 and scored["null"].n_turns == 0
    assert scored["long"].n_turns >= 3 and 0.1 <= scored["long"].score <= 1
    found = {r.call_id: r for r in sc.scenes(table).collect()}
    assert found["bit"].score == 0.45 and found["bit"].tv == 0 and all(0 <= found["long"][k] <= 1 for k in ("tv", "music", "crowd", "noise", "score"))
    assert {r.call_id: r.score is None for r in sc.replays(table).collect()}["none"]
    good = {r.call_id: r for r in sc.quality(table).collect()}
    assert good["long"].accepted and not good["bit"].accepted and good["bit"].warnings[0].startswith("too short")
    assert good["none"].bandwidth == "unknown" and any(w.startswith("very low") for w in good["hush"].warnings)


def test_switches_and_their_scores(spark):
    rng = np.random.default_rng(1)
    rows = []
    for call, shape in (("steady", [1] * 240), ("one", [1] * 120 + [40] * 120), ("short", [1] * 20)):
        rows += [(call, i, d, float(rng.standard_normal() * s)) for i, s in enumerate(shape) for d in range(3)]
    found = {r.call_id: r for r in cp.channel_switches(spark.createDataFrame(rows, "call_id string, i long, dim int, x double")).collect()}
    assert (found["steady"].n, found["steady"].score) == (0, 0.1) and (found["short"].n, found["short"].score, found["short"].stability) == (0, 0.1, 1.0)
    assert found["one"].n == 1 and 0.85 <= found["one"].score <= 0.95


def test_suppression_takes_the_strongest_first(spark):
    rng = np.random.default_rng(2)
    rows = [(c, int(i), float(rng.integers(0, 9))) for c in range(5) for i in np.unique(rng.integers(0, 90, 30))]
    found = cp.suppress(spark.createDataFrame(rows, "call_id int, i int, bic double"), 8).collect()
    for c in range(5):
        taken = []
        for b, i in sorted(((b, i) for k, i, b in rows if k == c), reverse=True):
            if all(abs(i - t) >= 8 for t in taken):
                taken.append(i)
        assert sorted(r.i for r in found if r.call_id == c) == sorted(taken)


SCORES = "call_id string, win_ix long, ord long, name string, score double, details map<string,double>"


def test_guardrails_by_hand(spark):
    talk_of = lambda **d: (None, 1, "conversation_context", 0.1, {k: float(v) for k, v in d.items()})
    window = lambda name, score, **d: (0, 5, name, score, d)
    channel, scene = (None, 0, "channel_switch", 0.1, {}), lambda **d: (None, 2, "scene", 0.4, d)
    cases = {
        "car": ([channel, talk_of(n_clusters=1), window("reverb", 0.3)], (True, False, False)),
        "two voices": ([channel, talk_of(n_clusters=2), window("reverb", 0.3)], (False, False, False)),
        "unsteady": ([channel, talk_of(n_clusters=1, cluster_stability=0.6), window("reverb", 0.3)], (False, False, False)),
        "long room": ([channel, talk_of(n_clusters=1), window("reverb", 0.3, rt60=0.5)], (False, False, False)),
        "tv": ([talk_of(coupling=0.1), scene(tv=0.7), window("gbm", 0.5)], (False, True, False)),
        "coupling unknown": ([talk_of(), scene(tv=0.7), window("gbm", 0.5)], (False, False, False)),
        "dead floor": ([window("gbm", 0.5, dead_floor=1.0)], (False, False, True)),
        "noise": ([scene(noise=0.8), window("gbm", 0.5)], (False, False, True)),
        "flat floor": ([(None, 3, "antispoof_replay_cues", 0.2, {"quantization_noise.noise_flatness": 0.6, "quantization_noise.noise_stationarity": 0.8}), window("gbm", 0.5)], (False, False, True)),
    }
    rows = [(k, *r) for k, (own, _) in cases.items() for r in own]
    found = {r.call_id: (r.benign, r.background, r.suppressed) for r in gr.flags(spark.createDataFrame(rows, SCORES)).collect()}
    assert found == {k: v for k, (_, v) in cases.items()}


def test_verdict_by_hand(spark):
    rows = [("a", w, w, "gbm", s, {}) for w, s in enumerate([0.9, 1.0, 1.0])] + [("a", None, 9, "conversation_context", 0.5, {"n_clusters": 1.0}), ("a", None, 8, "channel_switch", 0.1, {}), ("a", 0, 7, "reverb", 0.2, {})]
    bank, weights = spark.createDataFrame([], "name string, a double, b double"), spark.createDataFrame([("gbm", 0.5), ("reverb", 0.1)], "name string, w double")
    found = vd.fuse(spark.createDataFrame(rows, SCORES), bank, weights).first()
    windows = [(0.5 * 0.9 + 0.1 * 0.2) / 0.6, 1.0, 1.0]
    e = windows[0]
    for s in windows[1:]:
        e = 0.4 * s + 0.6 * e
    assert found.score == pytest.approx(e) and found.state == "CHALLENGE"  # RED but for the constant channel
    assert found.confidence == pytest.approx(max(0, 0.5 + (0.8 - e) / 0.45))
    assert found.reason.startswith("top detectors: gbm=0.97, reverb=0.20, ") and found.reason.endswith("guardrails: " + gr.R1)
    trace = [r.smoothed for r in vd.timeline(spark.createDataFrame(rows, SCORES), bank, weights).orderBy("step").collect()]
    assert len(trace) == 3 and trace[-1] == pytest.approx(e)


def test_wav_files_and_uploads(spark, tmp_path, table, signals):
    folder = str(tmp_path / "wav")
    done = files.write_audio(table.filter("samples is not null").select(F.concat("call_id", F.lit(".wav")).alias("file"), "samples"), folder).collect()
    assert {r.file: r.bytes for r in done} == {f"{k}.wav": 44 + 2 * len(x) for k, x in signals.items()}
    back = {r.call_id: r.samples for r in files.read_audio(spark, folder).collect()}
    assert back.keys() == {f"{k}.wav" for k in signals}
    assert all(np.abs(np.array(back[f"{k}.wav"]) - x).max(initial=0) < 2 / 32767 for k, x in signals.items())
    (tmp_path / "wav" / "bad.wav").write_bytes(b"RIFFxx")
    assert files.read_audio(spark, folder).filter("samples is null").count() == 1
    raw = spark.createDataFrame([(bytearray(b"\x00\x40\xff\x7f\x01"),)], "content binary")
    assert [round(v, 4) for v in files.decoded(raw).first().samples] == [0.5, 1.0]
    assert [len(r.pcm) for r in files.pcm16(table.filter("call_id = 'bit'")).collect()] == [2 * len(signals["bit"])]

    from callgrain import service

    store = rec.SampleStore(spark, str(tmp_path / "store"))
    assert store.list().count() == 0 and not store.delete("x")
    rows = files.encoded(table.filter("call_id in ('long', 'talk', 'bit')")).select(F.col("call_id").alias("name"), F.when(F.col("call_id") == "talk", "relay").otherwise("normal").alias("label"), "content")
    stored, rejected = service.upload(store, rows)
    assert stored.count() == 2 and [r.name for r in rejected.collect()] == ["bit"]
    assert {r.label: r.n for r in store.counts().collect()} == {"normal": 1, "relay": 1}
    own = store.list().first()
    assert own.qc_json and store.audio(stored).count() == 2
    assert store.delete(own.id) and store.list().count() == 1 and not store.delete(own.id)
    with pytest.raises(ValueError, match="label"):
        store.save(rows.withColumn("label", F.lit("odd")))


def test_records(spark, tmp_path):
    (tmp_path / "metadata.jsonl").write_text('{"file": "a.wav", "label": "relay"}\nnot json\n{"file": "b.wav", "label": "direct"}\n')
    rows = rec.metadata(spark, str(tmp_path))
    assert sorted(r.file for r in rows.collect()) == ["a.wav", "b.wav"]
    with pytest.raises(FileNotFoundError):
        rec.metadata(spark, str(tmp_path / "no"))
    assert rec.read_lines(spark, str(tmp_path / "no.jsonl"), rec.METADATA).count() == 0
    there = spark.createDataFrame([("b.wav",)], "file string")
    assert [r.file for r in rec.done(rows, there).collect()] == ["b.wav"]
    path = str(tmp_path / "out")
    assert rec.append_new(rows, path) == 2 and rec.append_new(rows, path) == 0
    prints = spark.createDataFrame([("u", [0.5] * 192, {"k": "v"})], rec.VOICEPRINT)
    rec.save_voiceprints(prints, str(tmp_path / "prints"))
    assert rec.load_voiceprints(spark, str(tmp_path / "prints"), ["u"]).first().meta == {"k": "v"}
    with pytest.raises(Exception, match="192"):
        rec.save_voiceprints(prints.withColumn("embedding", F.slice("embedding", 1, 5)), str(tmp_path / "prints"))
    (tmp_path / "s.json").write_text('{"a": {"b": 2}}')
    assert rec.settings(spark, str(tmp_path / "s.json"), {"a": {"b": 1, "c": 3}, "d": 4}) == {"a": {"b": 2, "c": 3}, "d": 4}
    assert rec.boosts("x:2, y:1.5") == {"x": 2.0, "y": 1.5}
    versions = rec.Versions(spark, str(tmp_path / "v"))
    assert (versions.current(), versions.next()) == (0, 1)
    versions.add(3)
    versions.activate(1)
    assert (versions.current(), versions.next()) == (1, 2)
    with pytest.raises(KeyError):
        versions.activate(9)


def test_datasets_are_made_by_plan(spark):
    clips = spark.createDataFrame([(f"r/{s}/c/{i}.flac", [float(v) for v in voice(np.random.default_rng(10 * s + i), 1.0)]) for s in range(6) for i in range(2)], "file string, samples array<double>")
    who = files.speakers(clips)
    assert who.agg(F.count("*")).first()[0] == 6
    planned = dg.plan(who, 10, labels=["relay", "direct", "hardneg_tv"])
    assert planned.count() == 30 and planned.filter("clip is null").count() == 0
    devices, pairs = ["tablet", "phone", "car"], [(a, b) for a in ("gsm", "opus") for b in ("gsm", "opus")]
    full = dg.profiles(planned, devices, pairs, ["tablet"], [("gsm", "opus")]).cache()
    relays = full.filter("label = 'relay'").collect()
    assert all(r.device != "tablet" and (r.codec1, r.codec2) != ("gsm", "opus") for r in relays if r.split != "test")
    made = dg.clipped(full, clips, 0.5).collect()
    whole = {r.file: np.array(r.samples) for r in clips.collect()}
    clip = {r.file: r.clip for r in full.collect()}
    assert len(made) == 30 and made[0].asDict().keys() == {c.split()[0] for c in dg.MADE.split(", ")}
    for r in made:
        assert any(np.array_equal(whole[clip[r.file]][i : i + 8000], r.samples) for i in range(8001))
    again = {r.file: r.samples for r in dg.clipped(full, clips, 0.5).collect()}
    assert all(again[r.file] == r.samples for r in made)
    assert all(r.codec2 == "none" for r in made if r.label != "relay")


def test_real_segments(table):
    found = dg.real_segments(table, 0.3, 0.8, 1.5).collect()
    assert found and all(len(r.samples) == 24000 and r.channel in ("narrowband", "wideband") and 0.3 <= r.duration_s <= 0.801 for r in found)
    assert all(np.abs(r.samples).max() <= 0.7 + 1e-9 for r in found)


def test_learning(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(f"f{i}", "relay" if i % 3 == 0 else "direct", int(i % 3 == 0), float(rng.normal(i % 3 == 0)), float(rng.normal()), 5.0) for i in range(200)]
    table = spark.createDataFrame(rows, "file string, label string, y int, a double, b double, c double")
    scaler = le.Scaler.fit(table, ["a", "c"])
    assert scaler.size[1] == 1.0 and scaler.size[0] == pytest.approx(np.std([r[3] for r in rows]))
    score, *_ = le.boosted(table, None, ["a", "b", "c"], boost={"direct": 2.0}, rounds=5)
    assert score(table).filter("score between 0 and 1").count() == 200
    assert le.positive_weight(table) == pytest.approx(133 / 67)
    long = table.selectExpr("file as call_id", "y", "stack(2, 'a', a, 'b', b) as (name, score)").filter("name = 'a' or y = 1")
    fuser = le.Fuser.fit(long)
    fuser.save(spark, str(tmp_path / "fuser"))
    again = le.Fuser.load(spark, str(tmp_path / "fuser"))
    assert again == fuser and fuser.apply(long, ["call_id"]).filter("fused between 0 and 1").count() == 200
    bank = le.calibrator_bank(long)
    le.save_calibrators(bank, str(tmp_path / "bank"))
    held = {r["name"]: r for r in le.load_calibrators(spark, str(tmp_path / "bank")).collect()}
    assert held["a"].a > 0 and held["b"].constant == pytest.approx(1 - 1e-4)


def test_training_job(spark, tmp_path):
    labels, splits = ["relay", "direct", "hardneg_tv", "hardneg_reverb"], ["train", "dev", "test"]
    rows = [(f"{x}/{i}.wav", x, split, [float(v) for v in np.clip(voice(np.random.default_rng(10 * k + i)) * (6 if x == "relay" else 1), -0.4, 0.4)]) for k, x in enumerate(labels) for i, split in enumerate(splits)]
    made = spark.createDataFrame(rows, "file string, label string, split string, samples array<double>").cache()
    anchor = made.select("file", "label", "samples")
    uploads = made.filter("split <> 'train'").select(F.concat(F.lit("u/"), "file").alias("file"), "label", "samples")
    versions = rec.Versions(spark, str(tmp_path))
    report = le.training_job(anchor, uploads, versions, keep=lambda df: df.cache(), rounds=2)
    assert (report["version"], report["user_samples"], report["in_sample"], report["before"]) == (1, 8, True, None)
    assert set(report["accuracy"]) == {"relay", "direct", "hardneg_tv", "hardneg_reverb", "overall"} and report["after"]["n"] == 8
    assert versions.current() == 1
    assert le.training_job(anchor, uploads, versions, keep=lambda df: df.cache(), rounds=2)["before"]["n"] == 8


def test_report(spark):
    rng = np.random.default_rng(9)
    samples = [(f"f{i}", ["relay", "direct", "hardneg_tv"][i % 3], "test" if i % 2 else "train", "gsm", None, "d") for i in range(90)]
    table = spark.createDataFrame(samples, "file string, label string, split string, codec1 string, codec2 string, device string")
    scores = spark.createDataFrame([(f, n, float(rng.random() * 0.6 + 0.4 * (lab == "relay"))) for f, lab, *_ in samples for n in ("gbm", "cnn")], "file string, name string, score double")
    overall, slices = ev.report(ev.sample_scores(scores), table)
    found = {r["name"]: r for r in overall.collect()}
    assert found.keys() == {"gbm", "cnn", "cnn_gbm_avg"} and all(r.n == 45 and 0.5 < r.auc <= 1 for r in found.values())
    own = {(r["name"], r.dim, r.slice): r for r in slices.collect()}
    assert own["gbm", "codec_pair", "gsm->?"].n == 45 and own["gbm", "label", "relay"].fpr is None
    assert ev.markdown(overall).count("\n") == 5 and ev.markdown(overall.limit(0)) == "(no rows)\n"
    with pytest.raises(ValueError, match="no scores"):
        ev.report(scores.limit(0), table)
    one = spark.createDataFrame([(1, 0.5)], "y int, score double")
    from callgrain.operators import metrics as me

    assert me.compute(one).first().asDict() == {"n": 1, "auc": None, "eer": None, "hit_at_fpr_1": None, "hit_at_fpr_2": None, "hit_at_fpr_5": None}


def test_builds_go_on_and_are_evaluated(spark, tmp_path):
    from callgrain import cli, service

    clips = spark.createDataFrame([(f"r/{s}/c/0.wav", [float(v) for v in voice(np.random.default_rng(s), 1.0)]) for s in range(4)], "file string, samples array<double>")
    folder, who = str(tmp_path / "set"), files.speakers(clips)
    assert dg.build(who, clips, folder, 2, labels=["relay", "direct"], seconds=1.0) == {"relay": 2, "direct": 2}
    first = (tmp_path / "set" / "relay" / "000000.wav").stat().st_mtime_ns
    (tmp_path / "set" / "direct" / "000001.wav").unlink()
    assert dg.build(who, clips, folder, 3, labels=["relay", "direct"], seconds=1.0) == {"relay": 3, "direct": 3}
    assert (tmp_path / "set" / "relay" / "000000.wav").stat().st_mtime_ns == first and (tmp_path / "set" / "direct" / "000001.wav").exists()
    overall, _ = service.evaluate(spark, folder)
    assert {r["name"]: r.n for r in overall.collect()} == dict.fromkeys(("bandwidth_forensics", "reverb", "distortion"), 6)
    assert cli.parser().parse_args(["build", "--source-dir", "a", "--out-dir", "b"]).n_per_class == 100


def test_a_fitted_fuser_combines(spark):
    rows = [("a", 0, 0, "gbm", 0.9, {}), ("a", 0, 1, "cnn", 0.8, {}), ("b", 0, 0, "gbm", 0.1, {})]
    fuser = le.Fuser(["cnn", "gbm"], [2.0, 3.0], -2.5)
    none = spark.createDataFrame([], "name string, a double, b double")
    found = {r.call_id: r.score for r in vd.fuse(spark.createDataFrame(rows, SCORES), none, spark.createDataFrame([("gbm", 1.0)], "name string, w double"), fuser=fuser).collect()}
    logistic = lambda z: 1 / (1 + math.exp(-z))
    assert found == {"a": pytest.approx(logistic(2 * 0.8 + 3 * 0.9 - 2.5)), "b": pytest.approx(logistic(2 * 0.5 + 3 * 0.1 - 2.5))}
