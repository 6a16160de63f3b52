"""Permissions of features and what a report says where there is nothing to say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import lookups

#: The feature and sentences of a report without evidence; {reason} is the caller's.
STATUS = "__analysis_status"
NOTHING = {"collectionAndUse": "当前未识别到可用于生成“我们如何收集和使用您的个人信息”章节的页面功能或数据流证据（原因：{reason}）。", "permissions": "当前未识别到可用于生成“设备权限调用”章节的权限证据（原因：{reason}）。"}
SKIPPED = ("在【", "】功能点中：隐私声明报告未生成（原因：{reason}）。")


def display_names(df: DataFrame, names: DataFrame, permission: str = "permission", name: str = "display_name") -> DataFrame:
    """Adds ``name``: what people read for a permission, from a table (key, label) by upper-cased key, the first row of a key counting; the permission itself without one."""
    table = names.where("label is not null").groupBy(F.upper(F.trim("key")).alias("_key")).agg(F.min("label").alias(name))
    keyed = df.withColumn("_key", F.upper(F.trim(permission)))
    return lookups.lookup(keyed, table, ["_key"], name, F.col(permission)).drop("_key")


def feature_permissions(flow_nodes: DataFrame, features: DataFrame, sinks: DataFrame, knowledge: DataFrame, page_titles: DataFrame) -> DataFrame:
    """(feature_id, permission, scenario, refs): permissions of the calls on a feature's nodes, the call's own and those that a table (key, permissions) has for its API.

    ``flow_nodes`` has (flow_id, node_id, ord, path, line), ``features`` (flow_id, page_id, feature_id, title), ``sinks`` (path, line, api_key, description, permissions).
    The scenario is that of the first call; refs are distinct pairs of flow and node.
    """
    k = knowledge.select(F.col("key").alias("api_key"), F.col("permissions").alias("_more"))
    none = F.array().cast("array<string>")
    said = sinks.where("api_key <> ''").join(k, "api_key", "left").withColumn("permission", F.explode(F.array_distinct(F.concat(F.coalesce("permissions", none), F.coalesce("_more", none)))))
    said = said.withColumn("permission", T.trim_all(F.regexp_replace("permission", "（[^）]*）", ""))).where("permission <> ''")
    met = flow_nodes.select("flow_id", "node_id", "ord", "path", "line").join(said.select("path", "line", "api_key", "description", "permission"), ["path", "line"])
    titled = features.select("flow_id", "page_id", "feature_id", "title").join(page_titles.select("page_id", F.col("description").alias("page_title")), "page_id", "left")
    met = met.join(titled, "flow_id").withColumn("scenario", T.scenario_of(F.col("title"), F.coalesce("page_title", F.lit("")), F.col("api_key"), F.coalesce("description", F.lit(""))))
    return met.groupBy("feature_id", "permission").agg(F.min_by("scenario", F.struct("flow_id", "ord", "api_key")).alias("scenario"), F.sort_array(F.collect_set(F.struct("flow_id", "node_id"))).alias("refs"))


def placeholder_report(features: DataFrame, reason: str) -> DataFrame:
    """(section, feature_id, ord, text): what stands in each section for each feature (feature_id), or once where there are no features."""
    spark = features.sparkSession
    made = spark.createDataFrame([(STATUS,)], "feature_id string").join(features.select(F.lit(True).alias("_some")).limit(1), F.lit(True), "left").where("_some is null").drop("_some")  # one row
    every = features.select("feature_id").distinct().unionByName(made)
    sections = spark.createDataFrame([(s, t.format(reason=reason)) for s, t in NOTHING.items()], "section string, _none string")
    text = F.when(F.col("feature_id") == STATUS, F.col("_none")).otherwise(F.concat(F.lit(SKIPPED[0]), F.col("feature_id"), F.lit(SKIPPED[1].format(reason=reason))))
    return every.crossJoin(F.broadcast(sections)).select("section", "feature_id", F.lit(0).alias("ord"), text.alias("text"))  # two rows


def valid_refs(refs: DataFrame, nodes: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(references whose node exists, (warning) for those whose doesn't)."""
    kept, missed = lookups.split_known(refs, nodes, on)
    return kept, missed.select(F.concat(F.lit("invalid ref: "), F.concat_ws("/", *on)).alias("warning")).distinct()


def cut_for_model(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key in order; ``cut`` says whether there were more."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_n", n).withColumn("cut", F.count(F.lit(1)).over(W.partitionBy(*by)) > most).where(F.col("_n") <= most).drop("_n")


def evaluation_table(evaluated: DataFrame, by: str = "app") -> DataFrame:
    """(ord, line) of a text table: headings, a row for each app by name, the total row (null ``by``) last; ratios as number and percent, / where there are none."""
    share = lambda c: F.when(F.col(c).isNull(), "/").otherwise(F.format_string("%.4f (%.2f%%)", c, F.col(c) * 100))
    cells = [("App", F.coalesce(F.col(by), F.lit("TOTAL"))), *((h, F.col(c).cast("string")) for h, c in (("GT", "gt"), ("Pred", "pred"), ("TP", "tp"), ("FP", "fp"), ("FN", "fn"))), ("Recall", share("recall")), ("FPR", share("fpr"))]
    rows = evaluated.select(F.col(by).isNull().alias("last"), *[c.alias(f"c{i}") for i, (_, c) in enumerate(cells)])
    widths = rows.agg(*[F.greatest(F.max(F.length(f"c{i}")), F.lit(len(h))).alias(f"w{i}") for i, (h, _) in enumerate(cells)])  # one row
    padded = lambda c, i: F.rpad(c, F.col(f"w{i}"), F.lit(" "))
    text = lambda cs: F.rtrim(F.concat_ws("  ", *[padded(c, i) for i, c in enumerate(cs)]))
    body = rows.crossJoin(F.broadcast(widths)).select(F.when(F.col("last"), 3).otherwise(2).alias("part"), F.col("c0").alias("key"), text([F.col(f"c{i}") for i in range(len(cells))]).alias("line"))
    head = widths.select(F.lit(0).alias("part"), F.lit("").alias("key"), text([F.lit(h) for h, _ in cells]).alias("line")).unionByName(widths.select(F.lit(1).alias("part"), F.lit("").alias("key"), text([F.repeat(F.lit("-"), F.col(f"w{i}")) for i in range(len(cells))]).alias("line")))
    return head.unionByName(body).orderBy("part", "key").select("line")


def known_or(value: Column, default: str = T.UNKNOWN) -> Column:
    return F.coalesce(F.nullif(T.clean_text(value), F.lit("")), F.lit(default))
