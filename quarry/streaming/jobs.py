"""Progress of analyses as a stream of events: states, percentages, windows and expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "job_id string, ts timestamp, stage int, state string"
#: States in which a job goes on, and stages of a run.
RUNNING, STAGES = ("queued", "running"), 15
#: Minutes for which a finished job is kept.
KEPT = 60


def read_events(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """JSON files of events as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).json(path)


def progress(stage: Column, stages: int = STAGES) -> Column:
    return F.round(stage / F.lit(stages - 1) * 100).cast("int")


class JobStates(StatefulProcessor):
    """The state of each job: its greatest stage and its last word; a finished job goes ``minutes`` after its last event, one that runs never."""

    def __init__(self, minutes: int, stages: int):
        self.kept, self.stages = minutes * 60_000, stages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "stage int, state string, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stage, state, at = self.job.get() if self.job.exists() else (-1, None, -1)
        for f in rows:
            for s, word, ts in zip(f["stage"], f["state"], f["ts"].astype("int64") // 1000 if f["ts"].dtype == "datetime64[us]" else f["ts"].astype("datetime64[ms]").astype("int64")):
                stage = max(stage, int(s) if s == s and s is not None else -1)
                if ts >= at:
                    at, state = int(ts), word
        self.job.update((stage, state, at))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state not in RUNNING:
            self.handle.registerTimer(at + self.kept)
        yield self._row(key, stage, state, at, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stage, state, at = self.job.get() if self.job.exists() else (-1, RUNNING[0], -1)
        if state not in RUNNING:
            self.job.clear()
            yield self._row(key, stage, state, at, True)

    def _row(self, key: tuple, stage: int, state: str | None, at: int, gone: bool) -> pd.DataFrame:
        percent = round(max(stage, 0) / (self.stages - 1) * 100)
        return pd.DataFrame({"job_id": [key[0]], "percent": [percent], "state": [state], "at": pd.to_datetime([at], unit="ms"), "gone": [gone]})

    def close(self) -> None:
        pass


def states(events: DataFrame, minutes: int = KEPT, stages: int = STAGES, late: str = "10 minutes") -> DataFrame:
    """(job_id, percent, state, at, gone): a row for each job that has news in a batch, and one with ``gone`` when a finished job is dropped.

    Each job's state is kept by its key with a timer in event time: only finished jobs get one, so a job that runs stays, however long it is silent. No list of jobs is kept.
    Needs the RocksDB state store.
    """
    return events.withWatermark("ts", late).groupBy("job_id").transformWithStateInPandas(statefulProcessor=JobStates(minutes, stages), outputStructType="job_id string, percent int, state string, at timestamp, gone boolean", outputMode="Update", timeMode="EventTime")


def snapshots(events: DataFrame, late: str = "10 minutes", gap: str = "1 hour") -> DataFrame:
    """(job_id, window, percent, state): a job's session ends ``gap`` after its last event; for jobs that report often. ``states`` keeps silent ones."""
    w = F.session_window("ts", gap)
    last = F.max(F.struct("ts", "state"))
    return events.withWatermark("ts", late).groupBy("job_id", w.alias("window")).agg(F.max(progress(F.col("stage"))).alias("percent"), last["state"].alias("state"))


def counts(events: DataFrame, by: str, at: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, by, n): events by tumbling window; those later than the watermark are left out."""
    w = F.window(at, width)
    return events.withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
