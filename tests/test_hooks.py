"""Calls at a time over all tasks, retries and order."""

import time
import uuid
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import hooks


def test_calls_at_a_time(spark, tmp_path):
    folder = str(tmp_path)

    def describe(b: pd.DataFrame) -> pd.Series:
        mine = Path(folder) / uuid.uuid4().hex
        mine.write_text("")
        n = len(list(Path(folder).iterdir()))
        time.sleep(0.02)
        mine.unlink()
        return pd.Series([str(n)] * len(b))

    df = spark.range(400).repartition(40)
    sizes = df.withColumn("p", F.spark_partition_id()).groupBy("p").count().count()
    got = hooks.describe_rows(df, describe, "n", "", workers=3, rows=2).withColumn("p", F.spark_partition_id()).collect()
    assert len(got) == 400 and len({r.p for r in got}) == sizes
    assert max(int(r.n) for r in got) <= 3
    many = hooks.describe_rows(df.limit(40).coalesce(1), describe, "n", "", rows=2).collect()
    assert max(int(r.n) for r in many) > 1


def test_order_retries_and_fallback(spark):
    def describe(b: pd.DataFrame) -> pd.Series:
        if 7 in set(b["id"]):
            raise ValueError
        time.sleep(0.03 if b["id"].iloc[0] % 4 == 0 else 0)
        return b["id"].astype(str).where(b["id"] % 3 != 0, "")

    got = hooks.describe_rows(spark.range(40).coalesce(1), describe, "t", "none", delays=(0.0,), rows=2).collect()
    assert [r.id for r in got] == list(range(40))
    assert [r.t for r in got] == ["none" if i % 3 == 0 or i in (6, 7) else str(i) for i in range(40)]

    def stop(b: pd.DataFrame) -> pd.Series:
        raise hooks.Stop("not let in")

    with pytest.raises(Exception, match="not let in"):
        hooks.describe_rows(spark.range(3), stop, "t", "").collect()
