"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.batches import BYTES_PER_BATCH, bounded_batches  # noqa: F401: alike for all operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session; only where it is unset and the master is local (tests) a
    temporary folder is taken and registered. On a cluster an unset folder is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quarry-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: computed once, safe against lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name as Spark reads it whole, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def placed_rows(df: DataFrame) -> DataFrame:
    """(own, place): each row of ``df`` whole as the struct own, and a hash of its file and its place there, so that rows alike in all columns differ, the same at every read.

    What isn't read from files as it is, is written to the shared folder first.
    """
    try:
        about = df.metadataColumn("_metadata")
        return df.select(F.struct(*[df[quoted(c)] for c in df.columns]).alias("own"), F.xxhash64(about["file_path"], about["row_index"]).alias("place"))
    except AnalysisException:
        return placed_rows(staged(df, "rows"))


def numbered_rows(df: DataFrame) -> DataFrame:
    """(row, own): each row of ``df`` whole as the struct own, and a long, another number for each row and the same at every read: its file's rank and its place there.

    What isn't read from files as it is, is written to the shared folder first. The names of the files are ranked and written, so that
    Spark knows their size and broadcasts them only if that is small.
    """
    try:
        about = df.metadataColumn("_metadata")
        placed = df.select(F.struct(*[df[quoted(c)] for c in df.columns]).alias("own"), about["file_path"].alias("path"), about["row_index"].alias("at"))
    except AnalysisException:
        return numbered_rows(staged(df, "rows"))
    names = sorted(r[0] for r in placed.select("path").distinct().collect())
    ranks = staged(df.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "name string, rank long").coalesce(1), "files")
    return placed.join(ranks, F.col("path") == F.col("name")).select((F.shiftleft("rank", 40) + F.col("at")).alias("row"), "own")


_stores: dict[str, dict] = {}


def worker_store(owner: str) -> dict:
    """What ``owner`` keeps in a worker process from task to task.

    Spark hands a worker on from one operator's tasks to the next one's, so what other operators left there goes first, and memory that
    Arrow holds unused goes back: else a worker's memory adds up over the stages of a pipeline. To be called where tasks begin.
    """
    left = [k for k in _stores if k != owner]
    for k in left:
        del _stores[k]
    if left:
        gc.collect()
    pa.default_memory_pool().release_unused()
    return _stores.setdefault(owner, {})


class Kept:
    """What was found for keys seen before, in two stores of ``most`` entries: when the younger is full, the older is dropped."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        self.young[key] = value


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession, "cut")  # registers a folder where none is set
    return df.checkpoint()


def input_splits(spark: SparkSession, df: DataFrame) -> int:
    """How many partitions the scan of ``df`` has: a measure of the input that needs no job."""
    return max(1, df.rdd.getNumPartitions())


def words_in_slices(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The ASCII-whitespace separated words of ``text``, some at a time, so memory stays bounded by the longest word."""
    if len(text) <= size:
        yield text.split()
        return
    rest: list[bytes] = []  # pieces of a word that isn't over
    for at in range(0, len(text), size):
        piece = text[at : at + size]
        cut_at = max(piece.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut_at < 0:
            rest.append(piece)
            continue
        yield b"".join([*rest, piece[:cut_at]]).split()
        rest = [piece[cut_at:]]
    yield b"".join(rest).split()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Components of an undirected graph by alternating large and small stars.

    ``edges`` has two long columns; nulls and loops are ignored. Returns (node, component): the smallest
    node reachable, for every node that has an edge, but for the smallest itself. No adjacency list is
    ever gathered: each star is a map-side combined minimum joined back, so a node with many
    neighbours is split like any other skewed join.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, seen = cut(e), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        inner = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(inner.unionByName(low.withColumnRenamed("m", "v")).distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
