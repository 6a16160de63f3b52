"""Paths from sources to sinks in a code property graph: anchors, local calls, shortest ways, projection to a call graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import graphs, lookups

#: Rank of a node's kind, by the first label that it has; others 5.
KINDS = (("Function", 0), ("Block", 1), ("Call", 2), ("Reference", 3), ("Lambda", 4), ("TranslationUnit", 9))
#: Penalty of another name, anchors and call targets that are kept, lines around an anchor, lines of a source's own window, nodes of a file that are looked at, hops at most.
OTHER_NAME, MOST, NEAR, BEFORE, BEHIND, FIRST, HOPS = 100, 6, 3, 2, 40, 200, 120
#: Order in which edges are followed.
PRIORITIES = {"DFG": 0, "PDG": 1, "EOG": 2, "INVOKES": 3, "LOCAL_INVOKES": 3, "AST": 4}


def kind_rank(labels: Column) -> Column:
    rank = F.lit(5)
    for label, n in reversed(KINDS):
        rank = F.when(F.array_contains(labels, label), n).otherwise(rank)
    return rank


def by_line(nodes: DataFrame) -> DataFrame:
    """Adds ``place``: a node's number in its file by line, end and id."""
    return nodes.withColumn("place", F.row_number().over(W.partitionBy("path").orderBy("line", "end_line", "id")))


def first_nodes(nodes: DataFrame, most: int = FIRST) -> DataFrame:
    """The first ``most`` nodes of each file by line, end and id."""
    return lookups.top_k(nodes, ["path"], most, F.col("line"), F.col("end_line"), F.col("id")).drop("rank")


def _near(spots: DataFrame, nodes: DataFrame, at: str, below: int, above: int) -> DataFrame:
    """Pairs of a spot and a node of its file from ``below`` lines before it to ``above`` behind: an equi join on the line, a spot going to each line of its window."""
    lines = spots.withColumn("line", F.explode(F.sequence(F.col(at) - below, F.col(at) + above)))
    return lines.join(nodes, ["path", "line"])


def _score(target: Column, name: Column | None) -> Column:
    other = F.lit(OTHER_NAME) if name is None else F.when(F.col("name") == name, 0).otherwise(OTHER_NAME)
    return other + 2 * F.abs(F.col("line") - target) + kind_rank(F.col("labels"))


def _best(candidates: list[DataFrame], keys: list[str]) -> DataFrame:
    """The first MOST distinct nodes of each key over lists in order, each by score and id; ``rank`` from 1."""
    both = None
    for tier, c in enumerate(candidates):
        c = c.select(*keys, "id", "score", F.lit(tier).alias("tier"))
        both = c if both is None else both.unionByName(c)
    one = both.groupBy(*keys, "id").agg(F.min(F.struct("tier", "score")).alias("m")).select(*keys, "id", "m.*")
    return lookups.top_k(one, keys, MOST, F.col("tier"), F.col("score"), F.col("id")).select(*keys, "id", "rank")


def source_anchors(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, line, function, id, rank): nodes at which a source may begin: functions of its name on its line, then within NEAR
    lines, then any node of its window, then the file's first nodes.

    Nodes are met line by line within the window; only sources that found too few there look at the file's first ones.
    """
    keys = ["path", "src_line", "function"]
    s = sources.select("path", F.col("line").alias("src_line"), "function").distinct()
    scored = lambda df: df.withColumn("score", _score(F.col("src_line"), F.col("function")))
    met = scored(_near(s, nodes, "src_line", max(BEFORE, NEAR), BEHIND))
    named = met.where(F.array_contains("labels", "Function") & (F.col("name") == F.col("function")))
    off = F.col("line") - F.col("src_line")
    tiers = [named.where(off == 0), named.where(F.abs(off) <= NEAR), met.where(off.between(-BEFORE, BEHIND))]
    enough = graphs._cut(_best(tiers, keys))
    short = s.join(enough.where(F.col("rank") == MOST).select(*keys), keys, "left_anti")
    rest = scored(short.join(first_nodes(nodes), "path"))
    some = enough.join(short, keys, "left_semi").join(nodes.select("id", "path", "line", "end_line", "labels", "name"), ["id", "path"])
    filled = _best([some.withColumn("score", F.col("rank")), rest], keys)
    got = enough.join(short, keys, "left_anti").unionByName(filled)
    return got.withColumnRenamed("src_line", "line")


def sink_anchors(nodes: DataFrame, sinks: DataFrame) -> DataFrame:
    """(path, line, id, rank): nodes at which a sink may be: calls on its line, then within NEAR lines, then functions around it, then any node near."""
    keys = ["path", "sink_line"]
    s = sinks.select("path", F.col("line").alias("sink_line")).distinct()
    scored = lambda df: df.withColumn("score", _score(F.col("sink_line"), None))
    met = scored(_near(s, nodes, "sink_line", NEAR, NEAR))
    off = F.abs(F.col("line") - F.col("sink_line"))
    calls = met.where(F.array_contains("labels", "Call"))
    around = scored(lookups.containing(s, nodes.where(F.array_contains("labels", "Function")), ["path"], "sink_line", "line", "end_line"))
    return _best([calls.where(off == 0), calls, around, met], keys).withColumnRenamed("sink_line", "line")


def _answered(asks: DataFrame, answers: DataFrame, on: list[str], most: int) -> DataFrame:
    """Each asking row (id, path, line) with the nearest functions of equal keys but itself: to, to_path, apart."""
    near = lookups.nearest_few(asks, answers, on, "line", "to_line", most, "to", ident="to")
    others = F.filter("near", lambda x: x["to"] != F.col("id"))
    met = lookups.with_near(asks, near, on, "line").withColumn("_n", F.explode(F.slice(others, 1, most)))
    return met.select("id", "path", "_n.to", "_n.to_path", "_n.apart")


def local_calls(nodes: DataFrame) -> DataFrame:
    """(src, dst): from each call to the functions that it may mean: by name in its file for bare names and ``this``, by qualified name
    anywhere, and those that its code names through ``this``; the MOST nearest, its own file first."""
    call = nodes.where(F.array_contains("labels", "Call") & (F.coalesce("name", F.lit("")) != "")).select("id", "path", "line", "name", F.coalesce("code", F.lit("")).alias("code"))
    fn = nodes.where(F.array_contains("labels", "Function") & (F.coalesce("name", F.lit("")) != "")).select(F.col("id").alias("to"), F.col("path").alias("to_path"), F.col("line").alias("to_line"), F.col("name").alias("to_name"), F.concat_ws(" ", "name", "full_name").alias("text"))
    quoted = F.concat(F.lit(r"\Q"), F.col("name"), F.lit(r"\E"))
    this = F.regexp_like("code", F.concat(F.lit(r"\bthis\."), quoted, F.lit(r"\s*\(")))
    qualifier = F.call_function("regexp_extract", F.col("code"), F.concat(F.lit(r"\b([A-Za-z_$][\w$]*)\."), quoted, F.lit(r"\s*\(")), F.lit(1))
    bare = F.regexp_like("code", F.concat(F.lit(r"(?:^|[^.\w$])"), quoted, F.lit(r"\s*\(")))
    kind = F.when(this, "own").when(qualifier != "", "qualified").when(bare, "own")
    told = call.withColumns({"kind": kind, "qualifier": qualifier})
    own = told.where("kind = 'own'").select("id", "path", "line", F.col("name").alias("wanted"))
    referred = call.select("id", "path", "line", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"\bthis\.([A-Za-z_$][\w$]*)\b"), F.lit(1)))).alias("wanted"))
    same = own.unionByName(referred).distinct()
    named = fn.select(F.col("to_name").alias("wanted"), F.col("to_path").alias("path"), "to", "to_path", "to_line")
    here = _answered(same, named, ["wanted", "path"], MOST)
    # a function answers to every end of a name that stands before its own with a dot
    before = F.call_function("regexp_extract_all", F.col("text"), F.concat(F.lit(r"([\w$]+)\.(?=\Q"), F.col("to_name"), F.lit(r"\E)")), F.lit(1))
    ends = F.flatten(F.transform(before, lambda q: F.transform(F.sequence(F.lit(1), F.length(q)), lambda i: F.substring(q, i, F.length(q)))))
    answers = fn.withColumn("qualifier", F.explode(F.array_distinct(ends))).withColumnRenamed("to_name", "name")
    # those of its own file, then those of files, then those without one; twice MOST hold MOST of other files, where its own has fewer
    files = lambda own: F.explode(F.when(F.col(own).isNotNull(), F.array(F.concat(F.lit("own:"), own), F.lit("any"))).otherwise(F.array(F.lit("none"))))
    asks = lambda own: F.explode(F.when(F.col(own).isNotNull(), F.array(F.concat(F.lit("own:"), own), F.lit("any"), F.lit("none"))).otherwise(F.array(F.lit("any"), F.lit("none"))))
    qualified = told.where("kind = 'qualified'").select("id", "path", "line", "name", "qualifier", asks("path").alias("files"))
    there = _answered(qualified, answers.select("name", "qualifier", files("to_path").alias("files"), "to", "to_path", "to_line"), ["name", "qualifier", "files"], 2 * MOST)
    cols = ["id", "path", "to", "to_path", "apart"]
    met = here.select(*cols).unionByName(there.select(*cols)).distinct()
    foreign = F.coalesce((F.col("path") != F.col("to_path")).cast("int"), F.lit(2))
    kept = lookups.top_k(met, ["id"], MOST, foreign, F.col("apart").asc_nulls_last(), F.col("to"))
    return kept.select(F.col("id").alias("src"), F.col("to").alias("dst"))


def search_edges(edges: DataFrame, local: DataFrame) -> DataFrame:
    """(src, dst, priority) of the graph's edges and the local calls, one for each pair: the first followed."""
    both = edges.select("src", "dst", "type").unionByName(local.select("src", "dst", F.lit("LOCAL_INVOKES").alias("type")))
    rank = F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv])
    return both.withColumn("priority", F.element_at(rank, F.col("type"))).groupBy("src", "dst").agg(F.min("priority").alias("priority"))


def path_matches(nodes: DataFrame, edges: DataFrame, sources: DataFrame, sinks: DataFrame, most: int | None = None, hops: int = HOPS) -> DataFrame:
    """(source_path, source_line, function, sink_path, sink_line, ids): for each source and sink the shortest of the ways between their anchors.

    All source anchors are searched at once, frontier by frontier; of ways as short, the first anchors' count. ``most`` keeps the first matches by source and sink.
    """
    froms = source_anchors(nodes, sources).select(F.col("path").alias("source_path"), F.col("line").alias("source_line"), "function", F.col("id").alias("source"), F.col("rank").alias("a"))
    tos = sink_anchors(nodes, sinks).select(F.col("path").alias("sink_path"), F.col("line").alias("sink_line"), F.col("id").alias("node"), F.col("rank").alias("b"))
    ways = graphs.shortest_paths(search_edges(edges, local_calls(nodes)), froms.select(F.col("source").alias("node")).distinct(), hops)
    met = ways.join(tos, "node").join(froms, "source")
    keys = ["source_path", "source_line", "function", "sink_path", "sink_line"]
    best = lookups.pick_one(met, keys, F.col("hops"), F.col("a"), F.col("b")).select(*keys, F.col("path").alias("ids"))
    return best if most is None else best.orderBy(*keys).limit(max(1, most))


def call_graph_of(matches: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, paths) of a call graph from matches: inner nodes as functions, ends as source and sink; repeated paths left out."""
    source = F.concat_ws(":", F.lit("source"), "source_path", "source_line", "function")
    sink = F.concat_ws(":", F.lit("sink"), "sink_path", "sink_line")
    inner = F.transform(F.slice("ids", 2, F.greatest(F.size("ids") - 2, F.lit(0))), lambda i: F.concat(F.lit("cpg:"), i.cast("string")))
    told = matches.withColumn("path", F.concat(F.array(source), inner, F.array(sink)))
    paths = lookups.pick_one(told, ["path"], F.col("source_path"), F.col("source_line"), F.col("function"), F.col("sink_path"), F.col("sink_line"))
    paths = graphs.ranked(paths.withColumn("_key", F.struct("source_path", "source_line", "function", "sink_path", "sink_line")), "_key", "_n")
    paths = paths.select(F.concat(F.lit("p"), F.col("_n").cast("string")).alias("path_id"), "path", F.col("path")[0].alias("source"), F.element_at("path", -1).alias("sink"))
    pairs = paths.select("sink", F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("src"), F.slice("path", 2, F.size("path") - 1).alias("dst"))).alias("e"))
    edges = pairs.select("e.src", "e.dst", F.when(F.col("e.dst") == F.col("sink"), "containsSink").otherwise("calls").alias("kind")).distinct()
    used = paths.select(F.explode("path").alias("node")).distinct()
    ends = matches.select(source.alias("node"), F.lit("source").alias("type"), F.col("source_path").alias("path"), F.col("source_line").alias("line"), F.col("function").alias("name"))
    ends = ends.unionByName(matches.select(sink.alias("node"), F.lit("sinkCall").alias("type"), F.col("sink_path").alias("path"), F.col("sink_line").alias("line"), F.lit(None).cast("string").alias("name"))).distinct()
    mid = nodes.select(F.concat(F.lit("cpg:"), F.col("id").cast("string")).alias("node"), F.lit("function").alias("type"), "path", "line", F.nullif("name", F.lit("")).alias("name"))
    return ends.unionByName(mid).join(used, "node", "left_semi"), edges, paths
