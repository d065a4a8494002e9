"""Queries without SQL: a row for each call where there is one, values in their ranges."""

import pytest

from callgrain.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def users(spark):
    return spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()


@pytest.mark.parametrize("name", ["q_conversation", "q_scenes", "q_replays", "q_quality", "q_analyze", "q_wav_round_trip", "q_channel_switches"])
def test_a_row_for_each_call(spark, users, name):
    rows = catalog.queries()[name](spark, SF).collect()
    assert len(rows) == users == len({r.call_id for r in rows})
    for r in rows:
        own = r.asDict()
        assert own.get("score") is None or 0 <= own["score"] <= 1
        assert own.get("far") is None or own["far"] < 2 / 32767
        assert own.get("state") in (None, "RED", "CHALLENGE", "GREEN")


def test_tracks_of_the_stand_in_calls(spark):
    pitch = [r.f0 for r in catalog.queries()["q_f0"](spark, SF).collect()]
    assert pitch and all(abs(f - 220) < 8 for f in pitch)
    row = catalog.queries()["q_mel"](spark, SF).first()
    assert len(row.mel) == 32
    assert all(r.end_s > r.start_s for r in catalog.queries()["q_turns"](spark, SF).collect())
