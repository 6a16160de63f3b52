"""Flows: what a caller's model says about a path, checked against the path's anchors, or the anchors themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import frames

#: What a node of a fallback flow is called by its type, and what marks it.
FALLBACK = {"source": "数据流起点：", "sinkCall": "潜在敏感调用："}
FALLBACK_OTHER, FALLBACK_MARK = "中间调用节点：", "（LLM 失败，使用锚点回退）"
#: Lines of context on either side of a node.
RADIUS = 5
#: Items of each kind that go to a model at most.
LIMITS = {"flows": 12, "nodes": 80, "ui_nodes": 120}
_ANSWER = "nodes array<struct<filePath:string,line:string,description:string,code:string>>, edges array<struct<`from`:string,`to`:string>>, summary struct<dataItems:array<string>,collectionFrequency:array<string>,cloudUpload:array<string>,storageAndEncryption:array<string>,permissions:array<string>>"


def anchors_of(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path_id, ord, node, type, path, line, name, code, description): a path's nodes in order; unknown ones and repeated places left out."""
    met = paths.select("path_id", F.posexplode("path").alias("at", "node")).join(nodes, "node")
    first = F.row_number().over(W.partitionBy("path_id", "path", "line").orderBy("at"))
    kept = met.withColumn("_first", first).where("_first = 1").drop("_first")
    return kept.withColumn("ord", F.row_number().over(W.partitionBy("path_id").orderBy("at")) - 1).drop("at")


def with_code(nodes: DataFrame, lines: DataFrame, radius: int = RADIUS, code: str = "code") -> DataFrame:
    """Nodes (path, line) with the trimmed line they name and its context; where a file lacks the line, ``code`` stays and is the context."""
    told = frames.context(lines, ["path"], radius).select("path", F.col("line_no").alias("line"), F.trim("line").alias("_said"), F.col("context").alias("_context"), F.greatest(F.lit(1), F.col("line_no") - radius).alias("_start"))
    got = nodes.join(told, ["path", "line"], "left")
    own = F.coalesce("_said", code, F.lit(""))
    return got.withColumns({code: own, "context_start": F.coalesce("_start", "line").cast("int"), "context": F.coalesce("_context", code, F.lit(""))}).drop("_said", "_context", "_start")


def fallback_flows(anchors: DataFrame, lines: DataFrame, warning: str | Column = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of flows made of a path's anchors in a chain: what each is, by its description, name, code or place."""
    detail = F.nullif(F.trim(F.coalesce("description", F.lit(""))), F.lit(""))
    label = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.nullif(F.trim("code"), F.lit("")), F.concat_ws(":", "path", "line"))
    head = F.lit(FALLBACK_OTHER)
    for kind, said in FALLBACK.items():
        head = F.when(F.col("type") == kind, said).otherwise(head)
    n = F.row_number().over(W.partitionBy("path_id").orderBy("ord"))
    named = anchors.withColumn("description", F.concat(F.coalesce(detail, F.concat(head, label)), F.lit(FALLBACK_MARK))).withColumn("ord", n - 1)
    nodes = with_code(named, lines).withColumns({"flow_id": F.concat(F.lit("flow:"), F.col("path_id")), "node_id": F.concat(F.col("path_id"), F.lit(":n"), (F.col("ord") + 1).cast("string")), "fallback": F.lit(True), "warning": F.lit(warning) if isinstance(warning, str) else warning})
    return nodes, frames.chained(nodes, "flow_id", "ord", "node_id")


def answers(said: DataFrame) -> DataFrame:
    """(path_id, nodes, edges, summary, valid) of a model's answers (path_id, answer): JSON, if need be from its first to its last brace.

    Nodes without a file, a number as line or a description are dropped, lines are floored; so are edges without two numbers.
    """
    raw = F.coalesce(F.from_json("answer", _ANSWER), F.from_json(F.regexp_extract("answer", r"(?s)\{.*\}", 0), _ANSWER))
    raw = F.when(raw.nodes.isNotNull(), raw).otherwise(F.from_json(F.regexp_extract("answer", r"(?s)\{.*\}", 0), _ANSWER))
    number = lambda c: F.floor(c.try_cast("double")).cast("int")
    nodes = F.filter(F.transform(F.col("a.nodes"), lambda x: F.struct(x.filePath.alias("path"), number(x.line).alias("line"), x.description.alias("description"), x.code.alias("code"))), lambda x: (F.coalesce(x.path, F.lit("")) != "") & x.line.isNotNull() & (F.coalesce(x.description, F.lit("")) != ""))
    edges = F.filter(F.transform(F.col("a.edges"), lambda x: F.struct(number(x["from"]).alias("src"), number(x["to"]).alias("dst"))), lambda x: x.src.isNotNull() & x.dst.isNotNull())
    return said.select("path_id", raw.alias("a")).select("path_id", nodes.alias("nodes"), edges.alias("edges"), F.col("a.summary").alias("summary"), F.col("a.nodes").isNotNull().alias("valid"))


def accepted(got: DataFrame, anchors: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``error`` to answers: null if they pass a path's anchors in their order, touch no source of other paths and end at the sink."""
    spot = lambda p, l: F.concat_ws(":", p, l.cast("string"))
    own = anchors.groupBy("path_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", spot(F.col("path"), F.col("line")).alias("k")))).alias("keys"),
        F.collect_set(F.when(F.col("type") == "source", spot(F.col("path"), F.col("line")))).alias("mine"),
        F.max(F.when(F.col("type") == "sinkCall", F.struct("ord", spot(F.col("path"), F.col("line")).alias("k"))))["k"].alias("sink"),
    )
    keys = F.transform("nodes", lambda x: spot(x.path, F.greatest(x.line, F.lit(1))))
    told = got.join(own, "path_id", "left").withColumn("_keys", keys).withColumn("_anchors", F.coalesce(F.col("keys.k"), F.array().cast("array<string>")))
    met = F.aggregate("_keys", F.lit(0), lambda i, x: F.when(F.coalesce(x == F.get("_anchors", i), F.lit(False)), i + 1).otherwise(i))
    visited = told.select("path_id", F.explode("_keys").alias("k"), "mine").join(sources.select(spot(F.col("path"), F.col("line")).alias("k")).distinct(), "k", "left_semi")
    foreign = visited.where(~F.array_contains("mine", F.col("k"))).groupBy("path_id").agg(F.min("k").alias("_foreign"))
    first_sink = F.array_position("_keys", F.col("sink"))
    error = F.when(~F.col("valid"), "no nodes").when(met < F.size("_anchors"), "anchors missing or out of order").when(F.col("_foreign").isNotNull(), "foreign source").when(F.col("sink").isNotNull() & (first_sink > 0) & (first_sink < F.size("_keys")), "goes on behind the sink")
    return told.join(foreign, "path_id", "left").withColumn("error", error).drop("keys", "mine", "sink", "_keys", "_anchors", "_foreign")


def model_flows(got: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of flows from accepted answers: code and context of each node; edges by number, a chain where there are none."""
    nodes = got.select("path_id", F.posexplode("nodes").alias("ord", "n")).select("path_id", "ord", "n.path", F.greatest("n.line", F.lit(1)).alias("line"), "n.description", "n.code")
    named = {"flow_id": F.concat(F.lit("flow:"), F.col("path_id")), "node_id": F.concat(F.col("path_id"), F.lit(":n"), (F.col("ord") + 1).cast("string")), "fallback": F.lit(False), "warning": F.lit(None).cast("string")}
    nodes = with_code(nodes, lines).withColumns(named)
    ids = nodes.select("path_id", "flow_id", "ord", "node_id")
    given = got.select("path_id", F.explode("edges").alias("e")).select("path_id", "e.src", "e.dst")
    given = given.join(ids.select("path_id", "flow_id", F.col("ord").alias("src"), F.col("node_id").alias("s")), ["path_id", "src"]).join(ids.select("path_id", F.col("ord").alias("dst"), F.col("node_id").alias("d")), ["path_id", "dst"])
    given = given.select("flow_id", F.col("s").alias("src"), F.col("d").alias("dst"))
    chain = frames.chained(nodes.join(given.select("flow_id").distinct(), "flow_id", "left_anti"), "flow_id", "ord", "node_id")
    return nodes, given.unionByName(chain)


def build_flows(paths: DataFrame, graph_nodes: DataFrame, lines: DataFrame, sources: DataFrame, said: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every path's flow: the model's answer (path_id, answer) where it holds, else the fallback with the reason as warning."""
    anchors = anchors_of(paths, graph_nodes)
    cols = ["flow_id", "path_id", "ord", "node_id", "path", "line", "code", "description", "context_start", "context", "fallback", "warning"]
    if said is None:
        nodes, edges = fallback_flows(anchors, lines, "no model")
        return nodes.select(*cols), edges
    judged = accepted(answers(said), anchors, sources)
    good = judged.where("error is null")
    bad = anchors.join(good.select("path_id"), "path_id", "left_anti").join(judged.select("path_id", "error"), "path_id", "left")
    (a, ae), (b, be) = model_flows(good, lines), fallback_flows(bad, lines, F.coalesce("error", F.lit("no answer")))
    return a.select(*cols).unionByName(b.select(*cols)), ae.unionByName(be)


def flow_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(flow_id, n_nodes, n_edges, fallback, warnings) of each flow."""
    n = nodes.groupBy("flow_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.bool_or("fallback").alias("fallback"), F.array_distinct(F.collect_list("warning")).alias("warnings"))
    e = edges.groupBy("flow_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, "flow_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def practice_flows(refs: DataFrame, flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(feature_id, practice, flow_id): flows that a practice's references (feature_id, practice, flow_id, node_id) name, those with unknown nodes not counting; without any, the
    feature's flow if it has one only. ``flows`` has (feature_id, flow_id), ``nodes`` (flow_id, node_id); a practice without references has a row of nulls."""
    known = nodes.select("flow_id", "node_id").withColumn("_ok", F.lit(True))
    named = refs.where("trim(flow_id) <> ''").join(known, ["flow_id", "node_id"], "left").where("_ok or node_id is null or node_id = ''").select("feature_id", "practice", "flow_id").distinct()
    named = named.join(flows, ["feature_id", "flow_id"], "left_semi")
    single = flows.groupBy("feature_id").agg(F.count(F.lit(1)).alias("_n"), F.min("flow_id").alias("flow_id")).where("_n = 1").drop("_n")
    rest = refs.select("feature_id", "practice").distinct().join(named.select("feature_id", "practice"), ["feature_id", "practice"], "left_anti").join(single, "feature_id")
    return named.select("feature_id", "practice", "flow_id").unionByName(rest.select("feature_id", "practice", "flow_id"))


def evidence_nodes(nodes: DataFrame, most: int = 10) -> DataFrame:
    """Of each flow's first ``most`` nodes those with a place and something to show."""
    first = nodes.where(F.col("ord") < most).where("path <> '' and line > 0")
    return first.select("flow_id", "ord", "path", "line", T.clean_text(F.col("code")).alias("code"), T.clean_text(F.col("description")).alias("description")).where("code <> '' or description <> ''")
