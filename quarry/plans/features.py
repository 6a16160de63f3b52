"""From flows and the element tree to pages and features: who owns a flow, under what title, with which counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import graphs, lookups

#: Lines from an element to its evidence at most, and for the last strategy.
STRICT, LOOSE = 80, 160
#: Penalties by category, for an element that is no clear cause.
PENALTIES = {"Button": 0, "Input": 2, "Component": 4, "Display": 6}
#: Scores of pages: evidence from other nodes than the source, farthest distance, distance without a line, and what roots, build and range take off.
NODE_BASE, FARTHEST, NO_LINE, ROOT, IN_BUILD, IN_RANGE = 50, 300, 200, 5, 20, 10
#: Pages that stand for files without a page: (page_id, description).
APP_PAGE, COMPONENT_PAGE, INFERRED_PAGE = ("AppLifecycle", "应用生命周期"), ("ComponentLogic", "通用组件"), ("inferred", "推断页面")

PAGE = "page_id string, root_id string, is_root boolean, path string, name string, line int, description string, start int, stop int, build_start int, build_stop int"


def digest(n: int, *parts: Column) -> Column:
    """The first n hex digits of the SHA-1 of the parts, joined by colons."""
    return F.substring(F.sha1(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, n)


def page_ids(pages: DataFrame) -> DataFrame:
    """Adds page_id: the struct's name, else the file's, as a slug; of equal ones, all but the first take eight digits of their path."""
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    named = F.coalesce(F.nullif(F.trim(F.coalesce("name", F.lit(""))), F.lit("")), F.nullif(base, F.lit("")), F.lit("page"))
    got = pages.withColumn("_base", F.coalesce(F.nullif(T.slug(named), F.lit("")), F.lit("page")))
    n = F.row_number().over(W.partitionBy("_base").orderBy("path", "line", "id"))
    return got.withColumn("page_id", F.when(n == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", digest(8, F.col("path"))))).drop("_base")


def build_pages(ui_nodes: DataFrame, roots: DataFrame, blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Pages of the tree's nodes (id, category, name, description, path, line) with their ranges; one inferred page where the tree has none.

    A page's range ends before the next page of its file, the last one's with its file (path, n_lines). Its build range is that of the first block
    ``build`` that begins in it, else null.
    """
    raw = ui_nodes.where("category = 'Page'").select("id", "name", "description", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("line", F.lit(1)).alias("line"))
    raw = page_ids(raw).join(roots.select("id").distinct().withColumn("is_root", F.lit(True)), "id", "left").withColumn("is_root", F.coalesce("is_root", F.lit(False)))
    nxt = F.lead("line").over(W.partitionBy("path").orderBy("line", "page_id")) - 1
    ranged = raw.withColumn("_next", nxt).join(files.select("path", "n_lines"), "path", "left").withColumns({"start": F.col("line"), "stop": F.coalesce("_next", "n_lines").cast("int")}).drop("_next", "n_lines")
    builds = blocks.where("name = 'build'").select("path", F.col("start_line").alias("at"), F.col("end_line").alias("_end"))
    held = lookups.containing(builds, ranged.select("page_id", "path", "start", F.coalesce("stop", F.lit(2**31 - 1)).alias("_stop")), ["path"], "at", "start", "_stop")
    first = held.groupBy("page_id").agg(F.min(F.struct("at", "_end")).alias("b")).select("page_id", F.col("b.at").alias("build_start"), F.greatest("b.at", "b._end").alias("build_stop"))
    pages = ranged.join(first, "page_id", "left").withColumn("description", T.page_description(F.col("description"), F.col("path"))).withColumnRenamed("id", "root_id")
    spark = ui_nodes.sparkSession
    made = spark.createDataFrame([(INFERRED_PAGE[0], "", True, "", INFERRED_PAGE[0], 0, INFERRED_PAGE[1], 0, 0, None, None)], PAGE)
    kept = made.join(raw.select(F.lit(True).alias("_some")).limit(1), F.lit(True), "left").where("_some is null").drop("_some")  # one row
    return pages.select(*made.columns).unionByName(kept)


def page_elements(ui_nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, id, category, name, description, path, line): elements by the page whose range holds them."""
    starts = pages.where("path <> ''").select("path", F.col("start").alias("line"), F.struct("start", "page_id", "stop").alias("page"))
    own = ui_nodes.where("category <> 'Page' and path is not null and line is not null")
    seen = lookups.asof(own, starts, ["path"], "line", "page").where("page is not null and (page.stop is null or line <= page.stop)")
    return seen.select(F.col("page.page_id").alias("page_id"), "id", "category", "name", "description", "path", "line")


def flow_sources(flow_nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """(flow_id, path, line, function): what the system calls first in each flow: of the first node that has any, ``build`` before others."""
    met = flow_nodes.select("flow_id", "ord", "path", "line").join(sources.select("path", "line", "function"), ["path", "line"])
    return lookups.pick_one(met, ["flow_id"], F.col("ord"), F.col("function") != "build", F.col("function")).select("flow_id", "path", "line", "function")


def page_scores(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """(flow_id, page_id, score) of each piece of evidence (flow_id, path, line, base) and page of its file."""
    met = evidence.join(pages.where("path <> ''").withColumnRenamed("line", "page_line"), "path")
    line = F.greatest(F.lit(1), F.col("line"))
    far = F.when(F.col("page_line") > 0, F.least(F.lit(FARTHEST), F.abs(line - F.col("page_line")))).otherwise(NO_LINE)
    off = F.when(line.between(F.col("build_start"), F.col("build_stop")), IN_BUILD).when((line >= F.col("start")) & (F.col("stop").isNull() | (line <= F.col("stop"))), IN_RANGE).otherwise(0)
    return met.select("flow_id", "page_id", (F.col("base") + far - F.when(F.col("is_root"), ROOT).otherwise(0) - off).alias("score"))


def flow_pages(flow_nodes: DataFrame, sources_of: DataFrame, pages: DataFrame) -> DataFrame:
    """(flow_id, page_id): the page with the least score for each flow, its source telling more than its other nodes.

    Flows in files without a page go by their source's file: to the app's or the components' own page, else to the first root page, else the first page.
    """
    first = sources_of.select("flow_id", "path", "line", F.lit(0).alias("base"))
    rest = flow_nodes.where("path <> '' and line > 0").select("flow_id", "path", "line", F.lit(NODE_BASE).alias("base"))
    best = page_scores(first.unionByName(rest), pages).groupBy("flow_id").agg(F.min(F.struct("score", "page_id")).alias("m")).select("flow_id", "m.page_id")
    default = pages.agg(F.min(F.struct((~F.col("is_root")).alias("late"), "page_id")).alias("m")).select(F.col("m.page_id").alias("_default"))  # one row
    kind = T.path_file(F.col("path"))
    special = F.when(kind.rlike("(?:^|/)entryability/"), APP_PAGE[0]).when(kind.rlike("(?:^|/)component/"), COMPONENT_PAGE[0])
    all_ = flow_nodes.select("flow_id").distinct().join(best, "flow_id", "left").join(sources_of.select("flow_id", "path"), "flow_id", "left")
    return all_.crossJoin(F.broadcast(default)).select("flow_id", F.coalesce("page_id", special, "_default").alias("page_id"))


def with_special_pages(pages: DataFrame, used: DataFrame) -> DataFrame:
    """The pages and those made for files without one, as far as flows (page_id) use them."""
    spark = pages.sparkSession
    made = spark.createDataFrame([(p, "", False, "", p, 0, d, 0, 0, None, None) for p, d in (APP_PAGE, COMPONENT_PAGE)], PAGE)
    return pages.unionByName(made.join(used.select("page_id").distinct(), "page_id", "left_semi").join(pages.select("page_id"), "page_id", "left_anti").select(*pages.columns))


def _nearest(evidence: DataFrame, elements: DataFrame) -> DataFrame:
    """(flow_id, strategy, score, distance, penalty, element) of evidence (flow_id, page_id, line, strategy, most): the last elements at or before it."""
    rank = F.lit(8)
    for category, cost in PENALTIES.items():
        rank = F.when(F.col("category") == category, cost).otherwise(rank)
    at = elements.withColumn("penalty", rank).groupBy("page_id", "line").agg(F.min(F.struct("penalty", "id", "category", "name", "description", "path")).alias("e")).select("page_id", "line", F.struct("line", "e").alias("seen"))
    near = lookups.asof(evidence, at, ["page_id"], "line", "seen").where("seen is not null").withColumn("distance", F.col("line") - F.col("seen.line")).where("distance <= most")
    return near.select("flow_id", "strategy", (F.col("distance") + F.col("seen.e.penalty")).alias("score"), "distance", F.col("seen.e.penalty").alias("penalty"), F.struct("seen.e.id", "seen.e.category", "seen.e.name", "seen.e.description", "seen.e.path", F.col("seen.line").alias("line")).alias("element"))


def flow_elements(flow_nodes: DataFrame, owned: DataFrame, pages: DataFrame, elements: DataFrame, blocks: DataFrame, lines: DataFrame, permissions: DataFrame | None = None, strict: int = STRICT, loose: int = LOOSE) -> DataFrame:
    """(flow_id, element): the element that a flow begins at, by the first strategy that shows one.

    1. Its nodes inside the page's build. 2. Lines of build that name the handlers in which its other nodes lie. 3. Lines of build that name its
    permissions (flow_id, permission). 4. Its node nearest to build, moved there, with a wider reach. Within a strategy, the least distance and penalty.
    """
    page = pages.where("build_start is not null and path <> ''").select("page_id", "path", "start", "stop", "build_start", "build_stop").join(elements.select("page_id").distinct(), "page_id", "left_semi")
    own = flow_nodes.select("flow_id", "ord", "path", "line").join(owned, "flow_id").join(page, ["page_id", "path"]).where("line > 0")
    inside = F.col("line").between(F.col("build_start"), F.col("build_stop"))
    told = lambda df, k, most: df.select("flow_id", "page_id", F.col("line").cast("int").alias("line"), F.lit(k).alias("strategy"), F.lit(most).alias("most")).distinct()
    s1 = told(own.where(inside), 1, strict)
    others = own.where(~inside & (F.col("line") >= F.col("start")) & (F.col("stop").isNull() | (F.col("line") <= F.col("stop"))))
    handlers = lookups.innermost(others.select("flow_id", "page_id", "path", "line").distinct(), blocks.select("path", "name", "start_line", "end_line"), ["path"], ["flow_id", "page_id", "line"], "line", "start_line", "end_line")
    handlers = handlers.where("name not in ('', 'build', 'constructor')").select("flow_id", "page_id", "name").distinct()
    build_lines = lookups.containing(lines.select("path", F.col("line_no").alias("at"), F.col("line").alias("said")), page.select("path", "page_id", "build_start", "build_stop"), ["path"], "at", "build_start", "build_stop").select("page_id", F.col("at").alias("line"), "said")
    s2 = told(lookups.named_in(build_lines, handlers.select("page_id", "name").distinct(), ["page_id"], "said", "name").join(handlers, ["page_id", "name"]), 2, strict)
    near = F.when(F.col("line") < F.col("build_start"), F.col("build_start") - F.col("line")).when(F.col("line") > F.col("build_stop"), F.col("line") - F.col("build_stop")).otherwise(0)
    moved = lookups.pick_one(own.withColumn("_far", near), ["flow_id"], F.col("_far"), F.col("ord")).withColumn("line", F.greatest("build_start", F.least("build_stop", "line")))
    evidence = s1.unionByName(s2).unionByName(told(moved, 4, loose))
    if permissions is not None:
        asked = permissions.select("flow_id", "permission").where("trim(permission) <> ''").join(owned, "flow_id")
        named = lookups.text_matches(build_lines, asked.select("permission").distinct(), "said", "permission")
        evidence = evidence.unionByName(told(named.join(asked, ["page_id", "permission"]), 3, strict))
    hits = _nearest(evidence, elements)
    return lookups.pick_one(hits, ["flow_id"], F.col("strategy"), F.col("score"), F.col("distance"), F.col("penalty"), F.col("element")).select("flow_id", "element")


def flow_features(flow_nodes: DataFrame, owned: DataFrame, sources_of: DataFrame, hits: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(flow_id, page_id, feature_id, kind, title, anchor): the feature of each flow: of its element, else its source, else its first node."""
    first = flow_nodes.groupBy("flow_id").agg(F.min(F.struct("ord", "path", "line")).alias("n")).select("flow_id", F.col("n.path").alias("path"), F.col("n.line").alias("line"))
    inner = lookups.innermost(first, blocks.select("path", "name", "start_line", "end_line"), ["path"], ["flow_id"], "line", "start_line", "end_line").select("flow_id", F.col("name").alias("in_function"))
    p = pages.select("page_id", F.col("description").alias("page_title"), F.col("path").alias("page_path"))
    s = sources_of.select("flow_id", F.struct("path", "line", "function").alias("source"))
    f = owned.join(p, "page_id").join(hits, "flow_id", "left").join(s, "flow_id", "left").join(first, "flow_id").join(inner, "flow_id", "left")
    raw = F.coalesce(F.nullif(F.trim("element.description"), F.lit("")), F.nullif(F.trim("element.name"), F.lit("")), F.col("element.category"))
    shown = F.coalesce(F.nullif(T.feature_title(raw), F.lit("")), raw, F.lit("功能"))
    by_ui = F.concat_ws("_", F.lit("ui"), "page_id", digest(10, F.col("page_id"), shown))
    fn = F.coalesce("source.function", F.lit("source"))
    by_source = T.slug(F.concat_ws("_", F.lit("src"), "page_id", F.coalesce(F.nullif(T.slug(F.concat_ws("_", fn, F.col("source.line").cast("string"))), F.lit("")), F.lit("source")), digest(8, F.col("source.path"), F.col("source.line"), fn)))
    by_node = T.slug(F.concat_ws("_", F.lit("unknown"), "page_id", digest(10, F.col("page_id"), F.col("flow_id"), F.regexp_replace("flow_id", "^flow:", ""))))
    kind = F.when(F.col("element").isNotNull(), "ui").otherwise("source")
    pick = lambda a, b, c: F.when(F.col("element").isNotNull(), a).when(F.col("source").isNotNull(), b).otherwise(c)
    title = pick(shown, T.source_title(F.col("source.function"), F.col("source.path"), F.col("page_title")), F.when(F.coalesce("in_function", F.lit("")) != "", F.concat(F.lit("处理逻辑："), F.col("in_function"))).otherwise("处理逻辑"))
    anchor = F.struct(pick(F.col("element.line"), F.col("source.line"), F.col("line")).cast("int").alias("line"), pick(F.coalesce("element.path", "page_path"), F.col("source.path"), F.col("path")).alias("path"), F.col("element.id").alias("ui_node"), pick(F.lit(None).cast("string"), F.col("source.function"), F.col("in_function")).alias("function"))
    return f.select("flow_id", "page_id", pick(by_ui, by_source, by_node).alias("feature_id"), kind.alias("kind"), title.alias("title"), anchor.alias("anchor"))


def feature_index(per_flow: DataFrame, counts: DataFrame) -> DataFrame:
    """(page_id, feature_id, kind, title, anchor, flows, n_flows, n_nodes, n_edges, n_fallback, warnings, place) of all features.

    Elements' features merge by title and keep the anchor with the smallest line, others that of their first flow. ``counts`` has (flow_id, n_nodes, n_edges, fallback,
    warnings). place is the feature's order in its page: by kind, line and title as a text, as Chinese readers sort.
    """
    order = F.when(F.col("kind") == "ui", F.struct(F.col("anchor.line").alias("a"), F.col("flow_id").alias("b"))).otherwise(F.struct(F.lit(0).alias("a"), F.col("flow_id").alias("b")))
    joined = per_flow.join(counts, "flow_id", "left").withColumn("_order", order)
    got = joined.groupBy("page_id", "feature_id").agg(
        F.min_by("kind", "flow_id").alias("kind"), F.min_by("title", "flow_id").alias("title"), F.min_by("anchor", "_order").alias("anchor"),
        F.sort_array(F.collect_list("flow_id")).alias("flows"), F.count(F.lit(1)).alias("n_flows"), F.coalesce(F.sum("n_nodes"), F.lit(0)).alias("n_nodes"), F.coalesce(F.sum("n_edges"), F.lit(0)).alias("n_edges"),
        F.count_if("fallback").alias("n_fallback"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("warnings", F.array().cast("array<string>")))))).alias("warnings"),
    )
    key = F.collate(F.concat_ws(":", "kind", F.col("anchor.line").cast("string"), "title"), "zh")
    return got.withColumn("place", F.row_number().over(W.partitionBy("page_id").orderBy(key, "feature_id")))


def page_index(pages: DataFrame, features: DataFrame) -> DataFrame:
    """(page_id, n_features, n_flows) of every page, and the totals in a row without page."""
    every = pages.select("page_id").join(features.select("page_id", "feature_id", "n_flows"), "page_id", "left")
    got = every.rollup("page_id").agg(F.count("feature_id").alias("n_features"), F.coalesce(F.sum("n_flows"), F.lit(0)).alias("n_flows"), F.grouping("page_id").alias("_total"))
    return got.where("page_id is not null or _total = 1").drop("_total")


def page_tree(pages: DataFrame, elements: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((page_id, id), (page_id, src, dst, kind)): each page's own part of the tree: its root, its elements, and edges with both ends among them."""
    nodes = pages.where("coalesce(cast(root_id as string), '') <> ''").select("page_id", F.col("root_id").alias("id")).unionByName(elements.select("page_id", "id")).distinct()
    kept = edges.join(nodes.select("page_id", F.col("id").alias("src")), "src").join(nodes.select("page_id", F.col("id").alias("dst")), ["page_id", "dst"], "left_semi")
    return nodes, kept.select("page_id", "src", "dst", "kind")


@dataclass
class Features:
    pages: DataFrame
    features: DataFrame
    per_flow: DataFrame
    index: DataFrame
    nodes: DataFrame
    edges: DataFrame


def group(flow_nodes: DataFrame, ui_nodes: DataFrame, ui_edges: DataFrame, roots: DataFrame, sources: DataFrame, blocks: DataFrame, lines: DataFrame, flow_counts: DataFrame, permissions: DataFrame | None = None, strict: int = STRICT) -> Features:
    """Every flow to a page and a feature; pages with their counts and their parts of the tree."""
    files = lines.groupBy("path").agg(F.max("line_no").alias("n_lines"))
    # what several steps read is written once, so that no plan repeats another
    pages = graphs._cut(build_pages(ui_nodes, roots, blocks, files))
    elements = graphs._cut(page_elements(ui_nodes, pages))
    sources_of = graphs._cut(flow_sources(flow_nodes, sources))
    owned = graphs._cut(flow_pages(flow_nodes, sources_of, pages))
    pages = graphs._cut(with_special_pages(pages, owned))
    hits = graphs._cut(flow_elements(flow_nodes, owned, pages, elements, blocks, lines, permissions, strict, max(strict, LOOSE)))
    per_flow = graphs._cut(flow_features(flow_nodes, owned, sources_of, hits, pages, blocks))
    features = graphs._cut(feature_index(per_flow, flow_counts))
    nodes, edges = page_tree(pages, elements, ui_edges)
    return Features(pages, features, per_flow, page_index(pages, features), nodes, edges)
