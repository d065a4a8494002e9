"""The stand-in calls: their samples, and that numbers are gathered, of which samples are made later."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from callgrain.sources import tables as src


def test_values_are_gathered_before_they_become_samples(spark, tmp_path):
    values = {1: [30.0, 0.0, 250.0], 2: [None, 99.5]}
    rows = [(u, x) for u, xs in values.items() for x in xs]
    pq.write_table(pa.table({"event_id": range(len(rows)), "user_id": [u for u, _ in rows], "value": pa.array([x for _, x in rows], pa.float64())}), f"{tmp_path}/events.parquet")
    calls = src.calls(spark, str(tmp_path))
    t = np.arange(512)
    tone = np.sin(t * 0.0864) * 0.6 + np.sin(t * 0.1728) * 0.3 + np.sin(t * 0.9) * 0.1
    for r in calls.collect():
        loud = [(min(100.0 if x is None else x, 100.0) / 100) ** 2 for x in values[r.call_id]]
        assert np.allclose(r.samples, np.concatenate([tone * a for a in loud]), rtol=0, atol=1e-12)
    gathered = [line for line in str(calls._jdf.queryExecution().optimizedPlan().toString()).splitlines() if "collect_list" in line]
    assert gathered and all("loud" in line and "part" not in line for line in gathered)
