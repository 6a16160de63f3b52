"""Bounds on what crosses to Python at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch: texts can be long, so batches hold few of them.
BYTES_PER_BATCH = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches, whatever the texts' lengths.

    All operators ask for the same bound, so a frame that runs after another operator was called runs alike. A tighter
    bound that the session has already stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = str(spark.conf.get(key)).lower().removesuffix("b")
    if not known.isdigit() or not 0 < int(known) <= BYTES_PER_BATCH:
        spark.conf.set(key, str(BYTES_PER_BATCH))
