"""A caller's own function over batches of rows, with retries, a fallback where it gives nothing, and a limit on calls at a time."""

from __future__ import annotations

import socket
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Seconds before the second and third try, calls at a time within a task, rows of a call.
DELAYS, WITHIN, ROWS = (0.3, 0.8), 4, 64


class Stop(Exception):
    """Raised by a caller's function to end the job at once, as when it isn't let in."""


class Permits:
    """So many calls at a time over all tasks of all stages: a caller connects to the driver, waits for a byte, and holds the permit until it hangs up.

    A lost executor hangs up too, so no permit is lost with it. The driver passes no rows, only one byte a call.
    """

    def __init__(self, spark: SparkSession, most: int):
        if most < 1:
            raise ValueError("at least one call at a time")
        self.host, self.free = spark.sparkContext.getConf().get("spark.driver.host", "127.0.0.1"), threading.Semaphore(most)
        self.server = socket.create_server(("", 0), backlog=4096)
        self.port = self.server.getsockname()[1]
        threading.Thread(target=self._serve, daemon=True).start()

    def _serve(self) -> None:
        while True:
            self.free.acquire()
            try:
                caller, _ = self.server.accept()
            except OSError:  # closed
                return
            threading.Thread(target=self._hold, args=(caller,), daemon=True).start()

    def _hold(self, caller: socket.socket) -> None:
        try:
            with caller:
                caller.sendall(b"+")
                caller.recv(1)
        except OSError:
            pass
        finally:
            self.free.release()

    def close(self) -> None:
        self.server.close()


def _permit(at: tuple[str, int] | None) -> socket.socket | None:
    """Wait for a permit; closing what is returned gives it back."""
    if at is None:
        return None
    caller = socket.create_connection(at)
    if caller.recv(1) != b"+":
        caller.close()
        raise ConnectionError("the driver gives no permits any more")
    return caller


def _tried(describe: Callable[[pd.DataFrame], pd.Series], b: pd.DataFrame, delays: tuple[float, ...], at: tuple[str, int] | None) -> pd.Series:
    for wait in (*delays, None):
        held = _permit(at)
        try:
            return describe(b)
        except Stop:
            raise
        except Exception:  # noqa: BLE001: whatever the caller's function raises
            pass
        finally:
            if held is not None:
                held.close()
        if wait is not None:
            time.sleep(wait)
    return pd.Series([None] * len(b), dtype="object", index=b.index)


def describe_rows(df: DataFrame, describe: Callable[[pd.DataFrame], pd.Series], name: str, default: str, workers: int | None = None, delays: tuple[float, ...] = DELAYS, within: int = WITHIN, rows: int = ROWS) -> DataFrame:
    """Adds ``name``: what ``describe`` returns for some ``rows`` at a time; ``default`` where that is empty or the last try fails.

    Any error but Stop is tried again after ``delays``. Each task makes up to ``within`` calls at a time and keeps its rows' order; rows stay in the
    partitions they are in. For a service that bears fewer calls, ``workers`` is how many run at a time over all tasks, by ``Permits`` of the driver.
    """
    at = None
    if workers:
        permits = Permits(df.sparkSession, workers)
        at = (permits.host, permits.port)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: deque[tuple[pd.DataFrame, Future]] = deque()

        def told() -> pd.DataFrame:
            b, future = waiting.popleft()
            got = future.result()
            return b.assign(**{name: got.where(got.notna() & (got != ""), default)})

        with ThreadPoolExecutor(within) as pool:
            try:
                for batch in batches:
                    for k in range(0, len(batch), rows):
                        b = batch.iloc[k : k + rows].reset_index(drop=True)
                        waiting.append((b, pool.submit(_tried, describe, b, delays, at)))
                        if len(waiting) > within:
                            yield told()
                while waiting:
                    yield told()
            finally:
                for _, future in waiting:
                    future.cancel()

    kind = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInPandas(run, f"{kind}, `{name}` string")
