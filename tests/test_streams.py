"""Streams against plain simulations: order, late and repeated rows, expiry, and what is left in the state."""

import hashlib
import random
from datetime import UTC, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from callgrain import service
from callgrain.operators import biometrics as bio
from callgrain.plans import catalog
from callgrain.sources.records import Versions
from callgrain.streaming import operators as op
from callgrain.streaming import ordered

START = datetime(2024, 1, 1)
FAR = 10**7


def at(seconds):
    return START + timedelta(seconds=seconds)


def stream_of(spark, folder, batches, shape):
    """A file for each batch, read one a trigger in their order; the last row is far ahead and closes all."""
    import os
    import time

    for i, rows in enumerate(batches):
        path = f"{folder}/{i:03d}"
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(path)
        for name in os.listdir(path):  # files are taken by the time of their last change
            os.utime(f"{path}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    time.sleep(0.1)
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def state_rows(progress):
    return [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]], sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress if p["stateOperators"])


def test_smoothing_of_shuffled_files(spark, tmp_path):
    shape = "call_id long, event_id long, t timestamp, score double"
    rng = random.Random(1)
    rows = [(rng.randrange(5), i, at(10 * i + rng.randrange(10)), rng.random() if i % 9 else None) for i in range(120)]
    pieces = [rows[k : k + 20] for k in range(0, 120, 20)]
    batches = []
    for piece in pieces:  # within a file, and between neighbours, in any order
        batches.append(rng.sample(piece, len(piece)))
    batches[1][:8], batches[2][:8] = batches[2][:8], batches[1][:8]
    batches.append([(None, None, at(1_000_000), 0.5), *batches.pop()])  # nulls beside other rows
    batches.append([(3, 901, at(5), 0.9), (7, 902, at(2_000_000), 0.9)])  # the first one is too late
    batches.append([(None, 903, at(FAR), 0.5)])
    progress = []
    found = op.collected(ordered.smoothed(stream_of(spark, str(tmp_path / "in"), batches, shape), "400 seconds", idle_s=3600), progress=progress)
    expect, last = {}, {}
    for call, event, t, score in sorted([*rows, (7, 902, at(2_000_000), 0.9)], key=lambda r: (r[2], r[1])):
        if score is not None:
            n, e = last.get(call, (0, None))
            last[call] = n + 1, score if e is None else 0.4 * score + 0.6 * e
            expect[event] = (call, last[call][0], pytest.approx(last[call][1]))
    assert {r.event_id: (r.call_id, r.n, r.smoothed) for r in found.collect()} == expect
    held, dropped = state_rows(progress)
    assert dropped == 1 and max(held) > 0 and held[-1] == 0


def test_a_call_ends_when_nothing_comes(spark, tmp_path):
    shape = "call_id long, event_id long, t timestamp, score double"
    batches = [[(1, 1, at(0), 1.0), (1, 2, at(50), 0.0), (1, 3, at(200), 0.5)], [(1, 4, at(900), 0.25)], [(None, 9, at(FAR), 0.0)]]
    rows = op.collected(ordered.smoothed(stream_of(spark, str(tmp_path / "in"), batches, shape), "10 seconds", idle_s=100)).collect()
    assert {r.event_id: (r.n, r.smoothed) for r in rows} == {1: (1, 1.0), 2: (2, 0.6), 3: (1, 0.5), 4: (1, 0.25)}


def plain_sessions(rows, opened, ttl, retries, keep):
    """What sessions answer, by a loop over all rows in order; times in seconds."""
    out, sessions = [], {i: dict(digits=d, channel=c, expires=e, left=n, done="", seen=set()) for i, d, c, e, n in opened}
    lost = {}

    def sweep(i, now):
        s = sessions.get(i)
        if s and s["expires"] < now and not s["done"]:
            s["done"] = "EXPIRED"
            out.append((i, None, "EXPIRED", None, s["left"]))
        if s and s["expires"] + keep < now:
            del sessions[i]

    for i, response, t, kind, channel, said, speech, identity in sorted(rows, key=lambda r: (r[2], r[1])):
        sweep(i, t)
        if kind == "start":
            drawn = hashlib.sha256(f"{i}:{int(START.replace(tzinfo=UTC).timestamp() + t) * 1_000_000}".encode()).hexdigest()
            sessions[i] = dict(digits=f"{int(drawn[:12], 16) % 100_000:05d}", channel=channel, expires=t + ttl, left=retries, done="", seen=set())
            lost.pop(i, None)
            continue
        s = sessions.get(i)
        seen = s["seen"] if s else lost.setdefault(i, set())
        if response in seen:
            continue
        seen.add(response)
        if s is None or s["done"] in ("PASS", "FAIL"):
            out.append((i, response, "UNKNOWN", None, 0))
        elif s["done"] == "EXPIRED":
            out.append((i, response, "EXPIRED", None, s["left"]))
        elif speech < 3.0:
            if s["left"]:
                s["left"] -= 1
                out.append((i, response, "RETRY", None, s["left"]))
            else:
                s["done"] = "FAIL"
                out.append((i, response, "FAIL", None, 0))
        else:
            match = None if said is None else said == s["digits"]
            low = identity is not None and identity < {"handset": 0.3}.get(s["channel"], 0.2)
            s["done"] = "FAIL" if low or match is False else "PASS"
            out.append((i, response, s["done"], match, s["left"]))
    for i in list(sessions):
        sweep(i, FAR)
    return out


SESSION = "session_id long, response_id long, t timestamp, kind string, channel string, said string, speech_s double, identity double"


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_are_those_of_a_plain_simulation(spark, tmp_path, seed):
    rng = random.Random(seed)
    opened = [(50, "12345", "handset", START.replace(tzinfo=UTC).timestamp() + 40.0, 1), (51, "00000", "relay", START.replace(tzinfo=UTC).timestamp() + 20.0, 2)]
    rows = [(50, 1, 10, "response", None, "12345", 2.0, None), (50, 2, 20, "response", None, "12345", 4.0, 0.25), (51, 3, 25, "response", None, "00000", 4.0, 0.25)]
    for i in range(25):
        t = rng.randrange(200)
        rows.append((i, 1000 + 10 * i, t, "start", rng.choice(["handset", "relay", None]), None, None, None))
        for k in range(rng.randrange(6)):
            t2 = t + rng.choice([2, 5, 9, 20, 31, 50, 200]) + k
            rows.append((i, 1000 + 10 * i + 1 + k, t2, "response", None, rng.choice([None, None, "wrong"]), rng.choice([1.0, 2.9, 3.0, 6.0]), rng.choice([None, 0.1, 0.22, 0.29, 0.3, 0.9])))
    rows.append((77, 9000, 30, "response", None, None, 5.0, None))
    again = rng.sample([r for r in rows if r[3] == "response"], 12)  # delivered twice
    timed = [(*r[:2], at(r[2]), *r[3:]) for r in [*rows, *again]]
    timed.sort(key=lambda r: (r[2] - START).total_seconds() + rng.uniform(0, 15))  # out of order within the delay
    batches = [timed[k : k + 30] for k in range(0, len(timed), 30)]
    batches.append([(None, 0, at(3000), "response", None, None, None, None)])
    batches.append([(50, 9999, at(1), "response", None, None, 5.0, 0.9)])  # later than the watermark
    batches.append([(None, 0, at(FAR), "response", None, None, None, None)])
    sessions = spark.createDataFrame(opened, "session_id long, digits string, channel string, expires_at double, retries int")
    progress = []
    stream = stream_of(spark, str(tmp_path / "in"), batches, SESSION)
    found = op.collected(ordered.challenges(stream, "30 seconds", 30.0, 2, 60.0, open_sessions=sessions), progress=progress).collect()
    base = START.replace(tzinfo=UTC).timestamp()
    expect = plain_sessions(rows, [(i, d, c, e - base, n) for i, d, c, e, n in opened], 30, 2, 60)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r.session_id, r.response_id, r.verdict, r.content_match, r.retries) for r in found), key=key) == sorted(expect, key=key)
    assert {r[2] for r in expect} == {"PASS", "FAIL", "RETRY", "EXPIRED", "UNKNOWN"}
    held, dropped = state_rows(progress)
    assert dropped == 1 and held[-1] == 0
    assert all("reaches 0.30" not in r.reason or r.verdict == "PASS" or r.content_match is False for r in found)


def test_sessions_in_a_table(spark):
    started = service.start_challenges(spark.createDataFrame([(i, c) for i, c in enumerate(["handset", "relay", "relay", "handset", "relay"])], "session_id long, channel string"), 1000.0)
    digits = {r.session_id: r.digits for r in started.collect()}
    assert all(len(d) == 5 and d.isdigit() for d in digits.values())
    heard = [(0, 5.0, digits[0], 0.25), (1, 5.0, digits[1], 0.25), (2, 1.0, None, None), (3, 5.0, "x", 0.9), (4, 4.0, None, None)]
    responses = spark.createDataFrame(heard, "session_id long, speech_s double, said string, identity double")
    results = service.respond(started, responses, 1010.0)
    found = {r.session_id: (r.verdict, r.content_match, r.retries) for r in results.collect()}
    assert found == {0: ("FAIL", True, 2), 1: ("PASS", True, 2), 2: ("RETRY", None, 1), 3: ("FAIL", False, 2), 4: ("PASS", None, 2)}
    still = service.written(started, results)
    assert [(r.session_id, r.retries) for r in still.collect()] == [(2, 1)] and still.columns == started.columns
    twice = service.written(still, service.respond(still, responses, 1010.0))
    last = service.respond(twice, responses, 1010.0).collect()
    assert [(r.verdict, r.retries) for r in last] == [("FAIL", 0)]
    assert {r.verdict for r in service.respond(started, responses, 1031.0).collect()} == {"EXPIRED"}
    assert [r.n for r in spark.range(1).select(bio.least_identity(F.lit("handset")).alias("n")).collect()] == [0.3]
    # the same reasons in a column and in a task
    for r in results.join(responses.withColumnRenamed("identity", "own").drop("speech_s"), "session_id").join(started.select("session_id", "digits", "channel"), "session_id").collect():
        assert (r.verdict, r.content_match, r.reason) == bio.judged(False, r.speech_s, r.said, r.digits, r.own, r.channel, 2)


def test_a_batch_keeps_its_version(spark, tmp_path):
    """v2 is made active between two batches; a batch that is run again after v3 is active has the version it had."""
    import shutil

    shape = "event_id long, value double"
    versions = Versions(spark, str(tmp_path / "models"))
    loaded = []

    def load(n):
        loaded.append(n)
        return lambda batch: batch.withColumn("score", F.col("value") * n)

    def run():
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in" / "*"))
        return {r.event_id: (r.version, r.score) for r in op.swapped(stream, f"file://{tmp_path}/out", versions.current, load).collect()}

    for n in (1, 2, 3):
        versions.add(0)
        versions.activate(n)
        if n < 3:
            spark.createDataFrame([(n, float(n)), (10 + n, 1.0)], shape).write.parquet(str(tmp_path / "in" / str(n)))
            found = run()
    assert found == {1: (1, 1.0), 11: (1, 1.0), 2: (2, 4.0), 12: (2, 2.0)} and loaded == [1, 2]
    # the second batch's rows are lost before it is committed
    (tmp_path / "out" / "state" / "commits" / "1").unlink()
    for crc in (tmp_path / "out" / "state" / "commits").glob(".*"):
        crc.unlink()
    shutil.rmtree(tmp_path / "out" / "rows" / "batch=1")
    assert run() == found and loaded == [1, 2, 2]


def test_challenge_query(spark):
    rows = catalog.queries()["q_stream_challenges"](spark, "/root/testdata/sf0.001").collect()
    assert rows and {"EXPIRED", "FAIL"} <= {r.verdict for r in rows}
    assert len({(r.session_id, r.response_id) for r in rows if r.response_id is not None}) == sum(r.response_id is not None for r in rows)


def test_rows_of_a_batch_are_one_element_of_the_state():
    class Handle:
        def __init__(self):
            self.elements, self.timers = [], []

        def getListState(self, *_):
            return self

        def getValueState(self, *_):
            return self

        def appendValue(self, value):
            self.elements.append(value)

        def appendList(self, values):
            self.elements.extend(values)

        def registerTimer(self, at):
            self.timers.append(at)

    handle, processor = Handle(), ordered.Smoothing(0.4, 60)
    processor.init(handle)
    rows = pd.DataFrame({"call_id": 1, "at": range(5000, 5050), "tie": range(50), "score": [None, *[0.5] * 49]})
    list(processor.handleInputRows((1,), iter([rows]), None))
    assert len(handle.elements) == 1 and handle.timers == [5]
