"""From program files to paths between entry points and API calls, permissions and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import scanners
from quarry.functions import text as T
from quarry.operators import frames, graphs, lookups
from quarry.sources import files as sources

#: Names of functions that the system calls.
ENTRY_NAMES = (
    "build", "aboutToAppear", "aboutToDisappear", "onPageShow", "onPageHide", "onBackPress", "onCreate", "onDestroy", "onForeground",
    "onBackground", "onWindowStageCreate", "onWindowStageDestroy", "onWindowStageActive", "onWindowStageInactive", "onNewWant",
    "onConfigurationUpdate", "onBackup", "onRestore",
)
#: Layout elements that are no nodes of the element tree.
LAYOUTS = ("Column", "Row", "Stack", "Flex", "Grid", "GridRow", "GridCol", "List", "ListItem", "ListItemGroup", "Scroll", "Swiper", "Navigation", "Tabs", "TabContent", "Badge", "Divider", "Blank")
#: Lines between an entry point and the block that it is, at most.
NEAR = 3


def entry_points(lines: DataFrame, names: tuple[str, ...] = ENTRY_NAMES) -> DataFrame:
    """(path, line, function): lines that define one of ``names`` and open its body."""
    pattern = rf"^\s*(?:public|private|protected)?\s*(?:async\s+)?({'|'.join(names)})\s*\([^)]*\)\s*(?::\s*[^{{}}=]+)?\s*\{{"
    f = F.regexp_extract("line", pattern, 1)
    return lines.select("path", F.col("line_no").alias("line"), f.alias("function")).where("function <> ''")


def element_starts(lines: DataFrame) -> DataFrame:
    """(path, line, component, category) of lines that begin an element; control words, comments and layouts left out."""
    c = F.regexp_extract("line", r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*(?:\(|\{)", 1)
    rows = lines.select("path", F.col("line_no").alias("line"), c.alias("component")).where("component <> ''")
    return rows.where(~F.col("component").isin("if", "for", "while", "switch", "return", *LAYOUTS)).withColumn("category", T.category_of(F.col("component")))


def entry_structs(lines: DataFrame, structs: DataFrame) -> DataFrame:
    """The first struct that begins 1 to 30 lines below an ``@Entry`` line."""
    marks = lines.where(F.col("line").rlike(r"^\s*@Entry(?![A-Za-z0-9_])")).select("path", F.col("line_no").alias("mark"))
    return lookups.nearest_in_band(marks, structs, ["path"], ["path", "mark"], "mark", "start_line", 1, 30).dropDuplicates(["path", "start_line"])


def resolve_kits(imports: DataFrame, kits: DataFrame) -> DataFrame:
    """Named imports of ``@kit.`` modules led to where the name comes from: kits (kit, exported, module, kind, imported). Others stay as they are."""
    k = kits.select(F.col("kit").alias("module"), F.col("exported").alias("imported"), F.lit("named").alias("kind"), F.struct("module", "kind", "imported").alias("_to"))
    led = imports.join(k, ["module", "kind", "imported"], "left")
    return led.withColumns({c: F.coalesce(F.col(f"_to.{c}"), F.col(c)) for c in ("module", "kind", "imported")}).select(*imports.columns)


def api_segments(kind: Column, imported: Column, local: Column, method: Column, namespace: Column) -> Column:
    """Segments of an API key after its module."""
    named = F.when(method.isNull(), F.array(imported)).otherwise(F.array(imported, method))
    default = F.when(method.isNull(), F.array(local)).when(namespace, F.array(method)).otherwise(F.array(local, method))
    return F.when(kind == "named", named).when(kind == "default", default).when(method.isNotNull(), F.array(method)).otherwise(F.array().cast("array<string>"))


def api_calls(calls: DataFrame, imports: DataFrame, namespaces: DataFrame, returns: DataFrame) -> DataFrame:
    """(path, import_line, import_code, line, code, api_key, module, pos): calls of imported names and of what they return.

    The last import of a local name counts. ``namespaces`` (module) have a namespace as default export; ``returns`` (module, member,
    type) give what a call returns: a variable has the type of its last such assignment, assignments going after declarations.
    """
    own = lookups.last_wins(imports.where(F.col("module").rlike(r"^@(ohos|kit)\.")), ["path", "local"], "import_line")
    spaces = namespaces.select("module").distinct().withColumn("_ns", F.lit(True))
    method = F.when(F.contains(F.col("chain"), F.lit(".")), F.col("callee"))
    # ``new`` makes what its name says; a dotted name after it isn't an import's
    hit = calls.where(~F.col("is_new") | ~F.contains("chain", F.lit("."))).withColumn("local", F.col("base")).join(own, ["path", "local"]).join(spaces, "module", "left").where(F.size(F.split("chain", r"\.")) <= 2)
    hit = hit.withColumn("segments", api_segments(F.col("kind"), F.col("imported"), F.col("local"), method, F.coalesce("_ns", F.lit(False)))).where("size(segments) > 0")
    hit = hit.withColumn("api_key", F.concat_ws(".", F.col("module"), F.concat_ws(".", "segments")))
    direct = hit.select("path", "import_line", "import_code", "line", "code", "api_key", "module", "pos")
    typed = hit.join(returns.select("module", F.col("member").alias("callee"), F.col("type")), ["module", "callee"])
    vars_ = lookups.pick_one(typed.where("assigned is not null"), ["path", "assigned"], F.asc("declared"), F.desc("pos"))
    vars_ = vars_.select("path", F.col("assigned").alias("base"), "module", "type", "import_line", "import_code")
    chained = typed.select("path", F.concat("chain", F.lit("()")).alias("base"), "module", "type", "import_line", "import_code").distinct()
    later = calls.where(F.contains(F.col("chain"), F.lit("."))).join(vars_.unionByName(chained), ["path", "base"])
    later = later.join(own.select("path", F.col("local").alias("base")), ["path", "base"], "left_anti")
    return direct.unionByName(later.select("path", "import_line", "import_code", "line", "code", F.concat_ws(".", "module", "type", "callee").alias("api_key"), "module", "pos")).distinct()


def describe(sinks: DataFrame, sdk: DataFrame, knowledge: DataFrame, override: DataFrame, permissions: DataFrame, default: str = "暂无描述") -> DataFrame:
    """Adds description (declaration, table, override, in this order) and the sorted union of permissions, by api_key."""
    key = lambda df, c: df.select(F.col("key").alias("api_key"), F.col(c).alias(c))
    out = lookups.priority_coalesce(sinks, ["api_key"], [key(sdk.where("description <> ''"), "description"), key(knowledge, "description"), key(override, "description")], "description", default)
    both = sdk.select("key", F.explode("permissions").alias("p")).unionByName(permissions.select("key", F.explode("permissions").alias("p"))).groupBy(F.col("key").alias("api_key")).agg(F.sort_array(F.collect_set("p")).alias("permissions"))
    return out.join(both, "api_key", "left").withColumn("permissions", F.coalesce("permissions", F.array().cast("array<string>")))


@dataclass
class CallGraph:
    nodes: DataFrame
    edges: DataFrame
    sources: DataFrame
    sinks: DataFrame


def call_graph(blocks: DataFrame, calls: DataFrame, sources: DataFrame, sinks: DataFrame) -> CallGraph:
    """Nodes (node, type, path, line, name, api_keys) and edges (src, dst, kind), before trimming.

    A call belongs to every block around it; its target is the nearest block of that name in the file, else the only one anywhere. A
    sink line belongs to its innermost block. A source is the block at its line, else the nearest of its name within
    NEAR lines, else a node of its own.
    """
    fn = blocks.drop("pos").withColumn("node", F.concat_ws(":", F.lit("fn"), "path", "start_line", "name"))
    around = lookups.containing(calls.withColumn("last", F.col("end") - 1), fn, ["path"], "pos", "body_start", "body_end").where("last <= body_end")
    site = around.select(F.col("callee").alias("name"), "pos", "node", F.col("path").alias("at_path"), F.col("start_line").alias("at_line"))
    defs = fn.select("name", F.col("node").alias("to"), F.col("path").alias("to_path"), F.col("start_line").alias("to_line"))
    met = lookups.resolve_by_name(site, defs, "name", ["node", "pos", "name"], ("at_path", "to_path"), ("at_line", "to_line"), "to_line")
    edges = met.where("node <> to").select(F.col("node").alias("src"), F.col("to").alias("dst"), F.lit("calls").alias("kind"))
    spots = sinks.groupBy("path", "line").agg(F.array_join(F.sort_array(F.collect_set("api_key")), ",").alias("api_keys")).withColumn("sink", F.concat_ws(":", F.lit("sink"), "path", "line"))
    inner = lookups.innermost(spots, fn, ["path"], ["path", "line"], "line", "start_line", "end_line")
    edges = edges.unionByName(inner.select(F.col("node").alias("src"), F.col("sink").alias("dst"), F.lit("containsSink").alias("kind"))).distinct()
    s = sources.select("path", "line", F.col("function").alias("name"))
    near = lookups.pick_one(s.join(fn, ["path", "name"]).where(F.abs(F.col("start_line") - F.col("line")) <= NEAR), ["path", "line", "name"], F.abs(F.col("start_line") - F.col("line")), F.col("start_line"))
    s = s.join(near.select("path", "line", "name", "node"), ["path", "line", "name"], "left").withColumn("node", F.coalesce("node", F.concat_ws(":", F.lit("source"), "path", "line", "name")))
    none = F.lit(None).cast("string")
    nodes = fn.select("node", F.lit("function").alias("type"), "path", F.col("start_line").alias("line"), "name", none.alias("api_keys"))
    nodes = nodes.join(s.select("node").distinct().withColumn("_s", F.lit(True)), "node", "left").withColumn("type", F.when(F.col("_s"), "source").otherwise("function")).drop("_s")
    own = s.join(fn.select("node"), "node", "left_anti").select("node", F.lit("source").alias("type"), "path", "line", "name", none.alias("api_keys"))
    nodes = nodes.unionByName(own).unionByName(spots.select(F.col("sink").alias("node"), F.lit("sinkCall").alias("type"), "path", "line", none.alias("name"), "api_keys"))
    return CallGraph(nodes, edges, s.select("node").distinct(), spots.select(F.col("sink").alias("node")))


def trimmed(graph: CallGraph) -> CallGraph:
    nodes, edges = graphs.trim(graph.edges, graph.sources, graph.sinks)
    return CallGraph(graph.nodes.join(nodes, "node", "left_semi"), edges, graph.sources, graph.sinks)


def flows(graph: CallGraph, longest: int = 60, most: int | None = None) -> DataFrame:
    """(flow_id, ord, node, type, path, line, name, api_keys): the nodes of every way from a source to a sink, in order."""
    found = graphs.simple_paths(graph.edges, graph.sources, graph.sinks, longest, most)
    steps = found.select(F.concat(F.lit("flow:"), "path_id").alias("flow_id"), F.posexplode("path").alias("ord", "node"))
    return steps.join(graph.nodes, "node").select("flow_id", "ord", "node", "type", "path", "line", "name", "api_keys")


def flow_permissions(flow_nodes: DataFrame, sinks: DataFrame) -> DataFrame:
    """(flow_id, permission, refs): permissions of the sinks that a flow's nodes lie on."""
    s = sinks.select("path", "line", F.explode("permissions").alias("permission")).distinct()
    return flow_nodes.where("type = 'sinkCall'").join(s, ["path", "line"]).groupBy("flow_id", "permission").agg(F.sort_array(F.collect_set("node")).alias("refs"))


def nearest_element(evidence: DataFrame, elements: DataFrame, most: int = 80) -> DataFrame:
    """(path, line, element, score): the last element at or before each evidence line, with a penalty by category."""
    rank = F.when(F.col("category") == "Button", 0).when(F.col("category") == "Input", 2).when(F.col("category") == "Component", 4).when(F.col("category") == "Display", 6).otherwise(8)
    best = elements.withColumn("penalty", rank).groupBy("path", "line").agg(F.min_by(F.struct("component", "category", "penalty"), "penalty").alias("e"))
    seen = lookups.asof(evidence.select("path", "line").distinct(), best.select("path", "line", F.struct("line", "e").alias("seen")), ["path"], "line", "seen")
    got = seen.where(F.col("seen").isNotNull() & (F.col("line") - F.col("seen.line") <= most))
    return got.select("path", "line", F.col("seen.e.component").alias("element"), (F.col("line") - F.col("seen.line") + F.col("seen.e.penalty")).alias("score"))


def reconcile(declared: DataFrame, inferred: DataFrame, practices: DataFrame, runtime: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept with authorization mode, dropped, missing): permissions of practices against those known; an empty known set keeps all."""
    known = declared.select("permission").union(inferred.select("permission")).distinct()
    if known.isEmpty():
        known = practices.select("permission").distinct()
    kept, dropped = lookups.split_known(practices, known, ["permission"])
    kept = lookups.flag_member(kept, runtime, ["permission"], "mode", "dynamic", "preauthorized")
    return kept, dropped, known.join(practices.select("permission"), "permission", "left_anti")


def sink_titles(sinks: DataFrame) -> DataFrame:
    """(path, line, description): what a call site does: a single record's description, of several each API with its own."""
    named = F.when(F.coalesce("description", F.lit("")) != "", F.concat_ws("：", F.coalesce(F.nullif("api_key", F.lit("")), F.lit("(unknown api)")), "description")).otherwise(F.coalesce(F.nullif("api_key", F.lit("")), F.lit("(unknown api)")))
    got = sinks.groupBy("path", "line").agg(F.count(F.lit(1)).alias("n"), F.max("description").alias("one"), F.array_join(F.sort_array(F.collect_set(named)), "；").alias("all"))
    return got.select("path", "line", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("all")).alias("description"))


def scan(files: DataFrame) -> dict[str, DataFrame]:
    """Lines, blocks, calls, imports and structs of program files (path, text): each text is read once, the facts written for all further uses."""
    kinds = ("block", "call", "import", "struct")
    facts = graphs._cut(scanners.scan_facts(files, *kinds))
    return {"lines": graphs._cut(frames.lines_of(files, ["path"]))} | {f"{k}s": scanners.facts_of(facts, k) for k in kinds}


def declared(sdk_files: DataFrame) -> DataFrame:
    """Declarations with their module by the file's name."""
    return scan_sdk(sdk_files)["declarations"]


def scan_sdk(sdk_files: DataFrame) -> dict[str, DataFrame]:
    """Of declaration files (path, text), one for each module: declarations, default exports (module, name, kind) and kit_exports. Each text is read once."""
    modules = graphs._cut(sources.sdk_modules(sdk_files))
    own = sdk_files.join(modules.select("path"), "path", "left_semi")
    facts = graphs._cut(scanners.scan_facts(own, "declaration", "default", "import", "export"))
    decl = scanners.facts_of(facts, "declaration").join(modules, "path")
    named = scanners.facts_of(facts, "default").join(modules, "path").select("module", "name")
    top = decl.where("container = '' and kind in ('namespace', 'class', 'function')").groupBy("module", F.col("member").alias("name")).agg(F.min_by("kind", "line").alias("kind"))
    defaults = named.join(top, ["module", "name"], "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    return {"declarations": decl, "defaults": defaults, "kit_exports": sources.kit_exports(modules, scanners.facts_of(facts, "import"), scanners.facts_of(facts, "export"))}


def find_sinks(facts: dict[str, DataFrame], sdk: dict[str, DataFrame] | None = None) -> DataFrame:
    """Calls of imported APIs, from scanned files and what declaration files say, if there are any: names that kits pass on are those of their modules."""
    spark = facts["calls"].sparkSession
    spaces, returns = spark.createDataFrame([], "module string"), spark.createDataFrame([], "module string, member string, type string")
    imports = facts["imports"]
    if sdk is not None:
        spaces = sdk["defaults"].where("kind = 'namespace'").select("module")
        returns = sdk["declarations"].where("size(returns) > 0").groupBy("module", "member").agg(F.min(F.struct("line", F.col("returns")[0].alias("t"))).alias("x")).select("module", "member", F.col("x.t").alias("type"))
        imports = resolve_kits(imports, sdk["kit_exports"])
    return graphs._cut(api_calls(facts["calls"], imports, spaces, returns))


def analyse(files: DataFrame, sdk_files: DataFrame | None = None, facts: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sinks, trimmed edges, flow nodes) of program files (path, text), with declaration files if there are any."""
    facts = facts or scan(files)
    sinks = find_sinks(facts, scan_sdk(sdk_files) if sdk_files is not None else None)
    graph = trimmed(call_graph(facts["blocks"], facts["calls"], entry_points(facts["lines"]), sinks))
    return sinks, graph.edges, flows(graph)


def page_ranges(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Each page from its line to the one before the next page's in its file (path, n_lines)."""
    nxt = F.lead("line").over(W.partitionBy("path").orderBy("line", "page_id"))
    return pages.withColumn("_n", nxt).join(files, "path").withColumn("stop", F.coalesce(F.col("_n") - 1, F.col("n_lines"))).drop("_n", "n_lines").withColumn("start", F.col("line"))
