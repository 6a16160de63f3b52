"""Graphs as edge tables (src, dst): reachability, distances, trimming, paths, levels."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rounds after which lineage is cut.
CUT = 4


def _cut(df: DataFrame) -> DataFrame:
    """Written to the cluster's shared folder and read again: one job, no lineage. A folder of our own only where none is named and all runs here."""
    sc = df.sparkSession.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quarry-graphs-")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def edges_of(df: DataFrame, src: str, dst: str, *kinds: str) -> DataFrame:
    """Distinct edges without nulls."""
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *kinds).where("src is not null and dst is not null").distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def hops(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(node, hops) of all nodes reachable from ``starts`` (node), with the least number of edges.

    Frontier by frontier: each round joins only the newest nodes with the edges and drops those seen, so a cycle
    ends by itself. The edges are written once for all rounds. The driver learns only whether a frontier is empty.
    """
    return _hops(_cut(edges), starts, most)


#: Steps of a walk between two cuts where the graph has at most so many edges: more would walk much of a large graph again.
STEPS, SMALL = 4, 2_000_000


def _walked(edges: DataFrame, new: DataFrame, steps: int) -> DataFrame:
    """(node, hops) of what ``steps`` edges or fewer lead to from (node, hops), with the least hops; one plan, in which each step's exchange is read twice."""
    for _ in range(steps):
        on = edges.join(new.select(F.col("node").alias("src"), "hops"), "src").select(F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops"))
        new = new.unionByName(on).groupBy("node").agg(F.min("hops").alias("hops"))
    return new


def _hops(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """Each round goes one step beyond what was seen, in a small graph STEPS at once; only nodes at the round's last step go on."""
    seen = starts.select("node").where("node is not null").distinct().withColumn("hops", F.lit(0))
    steps = STEPS if edges.limit(SMALL + 1).count() <= SMALL else 1
    new, k, rounds = seen, 0, 0
    while most is None or k < most:
        n = steps if most is None else min(steps, most - k)
        found = _cut(_walked(edges, new, n).join(seen.select("node"), "node", "left_anti"))
        k, rounds = k + n, rounds + 1
        seen = seen.unionByName(found)
        new = found.where(F.col("hops") == k)
        if new.isEmpty():
            break
        if rounds % CUT == 0:
            seen = _cut(seen)
    return seen


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return hops(edges, starts).select("node")


def trim(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) on some way from a source to a sink. Both directions are walked in one loop, told apart by a mark."""
    edges = _cut(edges)
    both = edges.select(F.struct(F.lit(True).alias("ahead"), F.col("src").alias("n")).alias("src"), F.struct(F.lit(True).alias("ahead"), F.col("dst").alias("n")).alias("dst"))
    both = both.unionByName(edges.select(F.struct(F.lit(False).alias("ahead"), F.col("dst").alias("n")).alias("src"), F.struct(F.lit(False).alias("ahead"), F.col("src").alias("n")).alias("dst")))
    starts = [df.where("node is not null").select(F.struct(F.lit(ahead).alias("ahead"), F.col("node").alias("n")).alias("node")) for df, ahead in ((sources, True), (sinks, False))]
    seen = _hops(both, starts[0].unionByName(starts[1])).select("node.ahead", F.col("node.n").alias("node"))
    nodes = seen.groupBy("node").agg(F.count(F.lit(1)).alias("ways")).where("ways = 2").select("node")
    kept = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes, kept.select(*edges.columns)


def ranked(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``name``: each row's number, from 1, in the order of ``key`` over the whole table, no task holding more than a range.

    Ranges of the key are numbered within; the rows of all ranges before a range are added, a sum over one row a range.
    """
    parts = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id())
    dealt = _cut(parts)
    before = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = before.select("_part", (F.sum("_rows").over(W.orderBy("_part")) - F.col("_rows")).alias("_before"))
    within = dealt.withColumn("_in", F.row_number().over(W.partitionBy("_part").orderBy(key)))
    return within.join(before, "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def _grown(paths: DataFrame, step: DataFrame) -> DataFrame:
    """Paths (path, key, last, ended) one edge on: those that have ended stay as they are, those that can't go on leave."""
    on = paths.join(step, (F.col("last") == F.col("src")) & ~F.col("ended") & ~F.array_contains("path", F.col("dst")), "left").where("ended or dst is not null")
    longer = lambda name, x: F.when(F.col("ended"), F.col(name)).otherwise(F.concat(name, F.array(x)))
    key = F.struct(F.col("hops").alias("h"), F.col("dst").alias("n"))
    return on.select(longer("path", F.col("dst")).alias("path"), longer("key", key).alias("key"), F.coalesce("dst", "last").alias("last"), (F.col("ended") | F.coalesce("goal", F.lit(False))).alias("ended"))


def simple_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, longest: int = 60, most: int | None = None) -> DataFrame:
    """(path_id, path, source, sink): ways without repeated nodes from each source to the first sink on them.

    Edges off every way to a sink are trimmed first. Paths grow by one edge a round, all at once; finished ones leave.
    They are numbered depth first: sources by name, at each node the children nearest to a sink first, then by name.
    ``most`` keeps the first ones: once so many are finished, open paths behind them in that order end, and what is finished behind them
    goes. A source that is a sink is a path of one node.
    """
    edges = _cut(edges.select("src", "dst").distinct())
    to_sink = _cut(_hops(reversed_edges(edges), sinks))
    step = _cut(edges.join(to_sink.select(F.col("node").alias("dst"), "hops"), "dst"))
    goals = sinks.select(F.col("node").alias("last")).distinct().withColumn("_goal", F.lit(True))
    begin = sources.select("node").distinct().join(to_sink, "node", "left_semi")
    step = _cut(step.join(goals.withColumnRenamed("last", "dst"), "dst", "left").select("src", "dst", "hops", F.coalesce("_goal", F.lit(False)).alias("goal")))
    start = begin.join(goals.withColumnRenamed("last", "node"), "node", "left").select(F.array("node").alias("path"), F.array(F.struct(F.lit(0).alias("h"), F.col("node").alias("n"))).alias("key"), F.col("node").alias("last"), F.coalesce("_goal", F.lit(False)).alias("ended"))
    most = None if most is None else max(1, most)
    done, told, k = None, _cut(start), 1
    while True:
        ended = told.where("ended").select("path", "key")
        done = ended if done is None else done.unionByName(ended)
        going = told.where("not ended")
        if most is not None:
            done = _cut(done.orderBy("key").limit(most))
            full = done.agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("_worst")).where(F.col("n") >= most).select("_worst")
            # one row at most: without it, nothing is dropped
            going = going.join(full, F.lit(True), "left").where("_worst is null or key < _worst").drop("_worst")
        if k >= longest or going.isEmpty():
            break
        n = min(STEPS if most is None else 1, longest - k)
        for _ in range(n):
            going = _grown(going, step)
        told = _cut(going)
        k += n
    out = ranked(done, "key", "_n")
    return out.select(F.concat(F.lit("p"), F.col("_n").cast("string")).alias("path_id"), "path", F.col("path")[0].alias("source"), F.element_at("path", -1).alias("sink"))


def shortest_paths(edges: DataFrame, sources: DataFrame, most: int = 120) -> DataFrame:
    """(source, node, hops, path): a shortest way from each source to every node, edges of the lowest ``priority`` first.

    Ties go to the lower priorities along the way, then to the smaller names. ``edges`` may lack priority.
    """
    e = edges if "priority" in edges.columns else edges.withColumn("priority", F.lit(0))
    e = _cut(e.select("src", "dst", "priority"))
    new = sources.select(F.col("node").alias("source"), "node", F.array("node").alias("path"), F.array(F.lit(0)).alias("by")).distinct()
    seen, k = new, 0
    while k < most:
        k += 1
        found = new.join(e, new["node"] == e["src"]).select("source", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("by", F.array("priority")).alias("by"))
        best = found.groupBy("source", "node").agg(F.min(F.struct("by", "path")).alias("b")).select("source", "node", "b.path", "b.by")
        new = _cut(best.join(seen.select("source", "node"), ["source", "node"], "left_anti"))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen.select("source", "node", (F.size("path") - 1).alias("hops"), "path")


def levels(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, level, row, indegree) for drawing: least hops from the starts; unreachable nodes one level below all."""
    edges = _cut(edges.select("src", "dst").distinct())
    h = _hops(edges, starts)
    top = h.agg(F.coalesce(F.max("hops"), F.lit(0)).alias("_top"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("indegree"))
    out = nodes.select("node").distinct().join(h, "node", "left").join(into, "node", "left").crossJoin(F.broadcast(top))  # one row
    out = out.select("node", F.coalesce("hops", F.col("_top") + 1).alias("level"), F.coalesce("indegree", F.lit(0)).alias("indegree"))
    # numbered over the whole table, then from each level's first: no level is gathered in one task
    numbered = ranked(out.withColumn("_key", F.struct("level", "node")), "_key", "_n")
    firsts = numbered.groupBy("level").agg(F.min("_n").alias("_first"))
    return numbered.join(firsts, "level").select("node", "level", "indegree", (F.col("_n") - F.col("_first")).cast("int").alias("row"))


#: Of a drawing, its margin, a node's size, the distances between nodes, the least sizes.
PAD, NODE_W, NODE_H, X_GAP, Y_GAP, LEAST_W, LEAST_H = 16, 260, 64, 320, 86, {True: 320, False: 640}, 320


def layout(levelled: DataFrame, vertical: bool = False) -> DataFrame:
    """Adds x and y to nodes with (level, row): levels from left to right, or downwards."""
    across, along = (F.col("row"), F.col("level")) if vertical else (F.col("level"), F.col("row"))
    return levelled.withColumns({"x": F.lit(PAD) + across * X_GAP, "y": F.lit(PAD) + along * Y_GAP})


def canvas(levelled: DataFrame, vertical: bool = False) -> DataFrame:
    """(width, height) of the drawing of nodes with (level, row): one row, also without nodes."""
    most = levelled.agg(F.coalesce(F.max("level"), F.lit(0)).alias("deep"), F.coalesce(F.max("row") + 1, F.lit(0)).alias("rows"))
    wide = F.greatest(F.lit(0), F.col("rows") - 1) if vertical else F.col("deep") + 1
    high = F.col("deep") if vertical else F.col("rows")
    return most.select(F.greatest(F.lit(LEAST_W[vertical]), wide * X_GAP + 2 * PAD + NODE_W).alias("width"), F.greatest(F.lit(LEAST_H), high * Y_GAP + 2 * PAD + NODE_H).alias("height"))
