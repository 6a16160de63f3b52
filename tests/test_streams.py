"""Job states over time: a silent job that runs stays, finished ones go."""

import json

import pytest

from quarry.streaming import jobs


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def test_only_finished_jobs_expire(rocks, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [
        [("a", "00:00", 0, "running"), ("b", "00:00", 3, "running"), ("c", "00:01", 14, "done")],
        [("b", "00:30", 14, "failed"), ("b", "00:20", 5, "running")],
        [("d", "03:00", 1, "running")],
        [("d", "03:05", 2, "running")],
        [("a", "03:10", 7, "running")],
    ]
    seen = []
    for k, rows in enumerate(batches):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps({"job_id": j, "ts": f"2026-01-01T{t}:00", "stage": s, "state": w}) for j, t, s, w in rows))
        out = jobs.states(jobs.read_events(rocks, str(tmp_path / "in")))
        q = out.writeStream.foreachBatch(lambda df, n: seen.extend(map(tuple, df.select("job_id", "percent", "state", "gone").collect()))).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    news = [r[:3] for r in seen if not r[3]]
    assert news.count(("a", 0, "running")) == 1 and ("a", 50, "running") in news
    assert ("b", 100, "failed") in news and ("c", 100, "done") in news
    assert sorted(r[:3] for r in seen if r[3]) == [("b", 100, "failed"), ("c", 100, "done")]
