"""The element tree of pages: elements of each build, what they open, and the pages that a walk over routes reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import frames, graphs, lookups
from quarry.plans import analysis


def primary_structs(structs: DataFrame) -> DataFrame:
    """(path, name, start_line): the struct that a file stands for: its default export, else its first."""
    return lookups.pick_one(structs, ["path"], F.desc("is_default"), F.col("start_line")).select("path", "name", "start_line")


def route_targets(navigations: DataFrame, files: DataFrame) -> DataFrame:
    """Navigations (path, line_no, kind, url) with ``target``, the file that their route names: the last of files with the same route."""
    known = files.select("path", T.file_route(F.col("path")).alias("_route")).where("_route <> ''")
    last = known.groupBy("_route").agg(F.max("path").alias("target"))
    return navigations.withColumn("_route", T.route_key(F.col("url"))).join(last, "_route").drop("_route")


def page_nodes(pages: DataFrame) -> DataFrame:
    """(id, category, name, path, line) of pages (path, name, start_line)."""
    return pages.select(T.stable_id("page", F.col("path"), F.col("name")).alias("id"), F.lit("Page").alias("category"), "name", "path", F.col("start_line").alias("line"))


#: Lines around an element that tell its title.
RADIUS = 5


def element_titles(elements: DataFrame, lines: DataFrame, opening: DataFrame, strings: DataFrame | None = None) -> DataFrame:
    """``elements`` (path, line, component, category) with ``description``: titles from their own line, then the lines around, the string resources (name, value) that these name, and whether they open a page (opening: path, line)."""
    near = elements.select("path", "line").distinct()
    around = near.withColumn("line_no", F.explode(F.sequence(F.col("line") - RADIUS, F.col("line") + RADIUS))).join(lines.withColumnRenamed("line", "text"), ["path", "line_no"])
    both = around.unionByName(around.where("line_no = line").withColumn("line_no", F.lit(0)))
    said = both.groupBy("path", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("said"))
    said = said.withColumn("resources", T.resource_ids(F.col("said")))
    if strings is not None:
        ids = said.select("path", "line", F.posexplode("resources").alias("at", "id")).withColumn("name", F.regexp_extract("id", r"^app\.string\.([A-Za-z0-9_]+)$", 1)).where("name <> ''")
        texts = ids.join(strings, "name").groupBy("path", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("strings"))
        said = said.join(texts, ["path", "line"], "left")
    else:
        said = said.withColumn("strings", F.lit(None).cast("array<string>"))
    acts = opening.select("path", "line").distinct().withColumn("_opens", F.lit(True))
    told = elements.join(said, ["path", "line"], "left").join(acts, ["path", "line"], "left")
    none = F.array().cast("array<string>")
    title = T.inferred_title(F.col("category"), F.col("component"), F.coalesce("said", F.lit("")), F.coalesce("resources", none), F.coalesce("strings", none), F.coalesce("_opens", F.lit(False)))
    return told.withColumn("description", title).drop("said", "resources", "strings", "_opens")


def build_tree(files: DataFrame, structs: DataFrame, blocks: DataFrame, strings: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, roots) of the element tree: pages entered by the system or reached by routes, and the elements of their builds.

    Nodes have (id, category, name, path, line, description), edges (src, dst, kind): contains, navigatesTo. Which pages are reached is a
    walk over files, frontier by frontier; elements, routes and what triggers them are found for all files at once. ``strings`` (name, value) are the app's string resources.
    """
    lines = frames.lines_of(files, ["path"]).transform(graphs._cut)
    entries = analysis.entry_structs(lines, structs).select("path", "name", "start_line")
    own = blocks.where("name = 'build'").select("path", F.col("start_line").alias("build_start"), F.col("end_line").alias("build_stop"))
    firsts = primary_structs(structs)
    every = entries.unionByName(firsts).distinct()
    held = lookups.nearest_in_band(every, own.withColumn("_at", F.col("build_start")), ["path"], ["path", "name", "start_line"], "start_line", "_at", 0, 100_000).drop("_at").transform(graphs._cut)
    starts = lookups.containing(analysis.element_starts(lines).withColumnRenamed("line", "at"), held.select("path", "name", F.col("start_line").alias("page_line"), "build_start", "build_stop"), ["path"], "at", "build_start", "build_stop")
    elements = starts.where("at > build_start").select("path", F.col("at").alias("line"), "component", "category", F.col("name").alias("page"), "page_line").transform(graphs._cut)
    navs = frames.navigation(lines, ["path"]).where("kind <> 'back' and url <> ''")
    navs = lookups.containing(route_targets(navs, files).withColumnRenamed("line_no", "at"), held.select("path", F.col("start_line").alias("page_line"), "build_start", "build_stop"), ["path"], "at", "build_start", "build_stop")
    trigger = lookups.asof(navs.withColumn("line", F.col("at")), elements.select("path", "line", F.struct("line", "component").alias("trigger")).distinct(), ["path"], "line", "trigger", strict=True).where("trigger is not null")
    opened = trigger.join(firsts.select(F.col("path").alias("target"), F.col("name").alias("to_name"), F.col("start_line").alias("to_line")), "target").transform(graphs._cut)
    reached = graphs.reachable(opened.select(F.col("path").alias("src"), F.col("target").alias("dst")).distinct(), entries.select(F.col("path").alias("node")))
    pages = entries.unionByName(firsts.join(reached.withColumnRenamed("node", "path"), "path", "left_semi").join(entries.select("path").distinct(), "path", "left_anti"))
    roots = page_nodes(entries).select("id").distinct()
    element = elements.join(pages.select("path", F.col("name").alias("page")), ["path", "page"], "left_semi")
    element_id = lambda p, l, c: T.stable_id("el", p, l, c)
    opening = opened.select("path", F.col("trigger.line").alias("line"))
    titled = element_titles(element, lines, opening, strings)
    shown = titled.select(element_id(F.col("path"), F.col("line"), F.col("component")).alias("id"), "category", F.col("component").alias("name"), "path", "line", "description")
    opens = opened.join(pages.select("path").distinct(), "path", "left_semi").select(element_id(F.col("path"), F.col("trigger.line"), F.col("trigger.component")).alias("src"), T.stable_id("page", F.col("target"), F.col("to_name")).alias("dst"), F.lit("navigatesTo").alias("kind"))
    holds = element.select(T.stable_id("page", F.col("path"), F.col("page")).alias("src"), element_id(F.col("path"), F.col("line"), F.col("component")).alias("dst"), F.lit("contains").alias("kind"))
    # an element that opens a page acts as a button
    acting = opens.select(F.col("src").alias("id")).distinct().withColumn("_acts", F.lit(True))
    shown = shown.join(acting, "id", "left").withColumn("category", F.when(F.col("_acts"), "Button").otherwise(F.col("category"))).drop("_acts")
    paged = page_nodes(pages).withColumn("description", T.page_title(F.col("path")))
    nodes = paged.select("id", "category", "name", "path", "line", "description").unionByName(shown.select("id", "category", "name", "path", "line", "description"))
    return nodes.dropDuplicates(["id"]), holds.unionByName(opens).distinct(), roots
