"""Queries on tables with silent frames, short calls, nulls and values right at a limit give what their SQL gives, to the last bit."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from callgrain.plans import catalog


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top, rng, calls = tmp_path_factory.mktemp("limits"), np.random.default_rng(4), []
    calls += [[0.0] * 60, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 0.0], [0.0] * 5 + [1.5 * i for i in range(55)], [0.0] * 3, [None] * 60, [*rng.exponential(50, 30), *[None] * 20]]
    for _ in range(150):  # the last two values lie at the limit of the speech masks and next to it, and change no quantile below them
        low = np.sort(np.round(rng.exponential(50, int(rng.integers(40, 60))), 2) + 20)
        at = (len(low) + 1) * 0.2
        d = at - math.floor(at)
        floor = math.fma(low[math.floor(at)], 1 - d, low[math.ceil(at)] * d)
        calls += [[*low, floor + above, np.nextafter(floor + above, 1e9)] for above in (6, 10)]
    rows = [(call, x) for call, values in enumerate(calls) for x in values]
    n = len(rows)
    events = {"event_id": np.arange(n), "ts": pa.array(np.arange(n) * 1_000_000, pa.timestamp("us")), "user_id": pa.array([c for c, _ in rows], pa.int64()), "event_type": ["view"] * n, "value": pa.array([None if x is None else float(x) for _, x in rows]), "props": ["{}"] * n}
    pq.write_table(pa.table(events), f"{top}/events.parquet")
    pq.write_table(pa.table({"doc_id": np.arange(70), "quality": pa.array([int(i < 45) for i in range(70)], pa.int32()), "toxic": pa.array([0] * 70, pa.int32())}), f"{top}/labels.parquet")
    return str(top)


@pytest.mark.parametrize("name", ["q_crest", "q_dynamics", "q_dyn_range", "q_plateau", "q_switch_score", "q_user_split", "q_vad_mask", "q_vad_net_speech", "q_vad_fallback", "q_speech_mask"])
def test_the_rows_of_the_sql(spark, folder, name, tmp_path):
    con = duckdb.connect()
    for t in ("events", "labels"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = catalog.queries()[name](spark, folder)
    found.write.parquet(f"{tmp_path}/rows")
    columns = ", ".join(found.columns)
    con.execute(f"create table theirs as select {columns} from ({catalog.oracle_sql()[name]})")
    con.execute(f"create table mine as select {columns} from '{tmp_path}/rows/*.parquet'")
    assert con.sql("select * from theirs except all select * from mine").fetchall() == con.sql("select * from mine except all select * from theirs").fetchall() == []
