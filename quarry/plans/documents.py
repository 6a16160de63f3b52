"""The documents of a run: JSON and CSV files by page and feature, as ordered pieces that the run store writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources import store, writers

#: What is said of permissions that no feature's flow shows, and of a practice where nothing else is known.
UNPLACED = ("应用源码/配置声明或 SDK API 使用推断的权限", "当前已在应用源码/配置扫描或 SDK API→权限映射中识别到该权限，但尚未定位到具体功能点数据流。", "当前未从已识别的数据流中定位到具体拒绝授权影响。")
WARNING = "以下权限来自应用源码/配置扫描或 SDK API 权限映射，当前未定位到具体功能点数据流："
SINKS, SOURCES = ("App源码文件路径", "导入行号", "导入代码", "调用行号", "调用代码", "API功能描述"), ("App源码文件路径", "行号", "函数名称", "描述")


def _json(**fields: Column) -> Column:
    """A JSON object; null fields are left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def pieces(df: DataFrame, file: Column, part: int, text: Column, ord_: Column | None = None, glue: str | None = None) -> DataFrame:
    """(file, part, ord, glue, text): one piece a row; pieces of a part go by ``ord`` and are joined by ``glue``."""
    return df.select(file.alias("file"), F.lit(part).alias("part"), (ord_ if ord_ is not None else F.lit("")).cast("string").alias("ord"), F.lit(glue).cast("string").alias("glue"), text.alias("text"))


def place(*columns: Column) -> Column:
    """A key that sorts as the columns do, numbers by size."""
    return F.concat_ws("\x01", *[F.coalesce(c, F.lit("")) for c in columns])


def number(c: Column) -> Column:
    return F.lpad(c.cast("string"), 12, "0")


def document(head: DataFrame, lists: dict[str, DataFrame], nested: bool = True) -> list[DataFrame]:
    """Pieces of files that begin with an object's fields and go on with lists.

    ``head`` has (file, fields): JSON of the object without its closing brace's lists; ``lists`` gives by name the items (file, ord, item).
    """
    out = [pieces(head, F.col("file"), 0, F.expr("left(fields, length(fields) - 1)"))]
    for n, (name, items) in enumerate(lists.items()):
        out.append(pieces(head, F.col("file"), 2 * n + 1, F.concat(F.when(F.col("fields") == "{}", "" if n == 0 else "],\n").otherwise(",\n" if n == 0 else "],\n"), F.lit(f'"{name}": [\n'))))
        out.append(pieces(items.join(head.select("file"), "file", "left_semi"), F.col("file"), 2 * n + 2, F.col("item"), F.col("ord"), ",\n"))
    out.append(pieces(head, F.col("file"), 2 * len(lists) + 1, F.lit("\n]}\n" if lists else "}\n")))
    return out


def array(items: DataFrame, file: str) -> list[DataFrame]:
    """Pieces of a file that is a list of items (ord, item)."""
    one = items.sparkSession.range(1)
    name = F.lit(file)
    return [pieces(one, name, 0, F.lit("[\n")), pieces(items, name, 1, F.col("item"), F.col("ord"), ",\n"), pieces(one, name, 2, F.lit("\n]\n"))]


def csv(rows: DataFrame, headers: tuple[str, ...], file: str, order: Column) -> list[DataFrame]:
    """Pieces of a CSV file with a byte order mark and a heading."""
    said = writers.csv_lines(rows.withColumn("_ord", order), list(headers), keep=["_ord"])
    return [pieces(rows.sparkSession.range(1), F.lit(file), 0, F.lit("﻿" + ",".join(headers) + "\n")), pieces(said, F.lit(file), 1, F.concat("line", F.lit("\n")), F.col("_ord"))]


def practice(permission: Column, mode: Column, scenario: Column, purpose: Column, denied: Column, refs: Column) -> Column:
    return _json(permissionName=permission, authorizationMode=mode, businessScenario=scenario, permissionPurpose=purpose, denyImpact=denied, refs=refs)


def run_documents(run, run_id: str, generated: str, given: dict[str, str], purpose: str, denied: str) -> DataFrame:
    """(file, part, ord, glue, text) of all documents of a run's tables: meta, sinks, sources, graph, flows, tree, report, and by page and feature their index, tree, flows and facts.

    Every table stays a table: its rows become items, and what belongs to a page or feature gets that file's name by a join. ``given`` are the run's inputs.
    """
    spark = run.sinks.sparkSession
    one = spark.range(1)
    known = {"runId": F.lit(run_id), "generatedAt": F.lit(generated)}
    count = lambda df, name, cond="true": df.agg(F.count_if(F.expr(cond)).alias(name))

    def meta(counts: list[DataFrame], key: list[str] | None = None, **more: Column) -> tuple[DataFrame, Column]:
        """Rows with the counts, and the JSON of ``meta``; a row for each key, or one."""
        table = reduce((lambda a, b: a.join(b, key, "left")) if key else (lambda a, b: a.crossJoin(b)), counts)  # one row each, or a page's
        names = [c for c in table.columns if c not in (key or [])]
        return table, F.struct(*[c.alias(k) for k, c in known.items()], *[c.alias(k) for k, c in more.items()], F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names]).alias("counts"))

    docs: list[DataFrame] = []
    s = run.sinks
    row = dict(zip(SINKS, (F.col("path"), F.col("import_line"), F.col("import_code"), F.col("line"), F.col("code"), F.col("description"))))
    order = place(F.col("path"), number(F.col("line")), number(F.col("pos")), F.col("api_key"))
    named = s.select(*[c.alias(k) for k, c in row.items()], order.alias("ord"), F.col("api_key").alias("__apiKey"), F.col("module").alias("__module"), F.when(F.size("permissions") > 0, F.col("permissions")).alias("__permissions"))
    docs += array(named.select("ord", F.to_json(F.struct(*SINKS, "__apiKey", "__module", "__permissions")).alias("item")), "sinks.json")
    docs += csv(named, SINKS, "sinks.csv", F.col("ord"))
    entries = run.sources.select(F.col("path").alias(SOURCES[0]), F.col("line").alias(SOURCES[1]), F.col("function").alias(SOURCES[2]), F.concat(F.lit("系统调用入口函数："), F.col("function")).alias(SOURCES[3]), place(F.col("path"), number(F.col("line")), F.col("function")).alias("ord"))
    docs += array(entries.select("ord", F.to_json(F.struct(*SOURCES)).alias("item")), "sources.json")
    docs += csv(entries, SOURCES, "sources.csv", F.col("ord"))

    node = _json(id=F.col("node"), type=F.col("type"), filePath=F.col("path"), line=F.col("line"), name=F.col("name"), description=F.col("description"))
    edge = _json(**{"from": F.col("src"), "to": F.col("dst"), "kind": F.col("kind")})
    table, fields = meta([count(run.nodes, "nodes"), count(run.edges, "edges"), *(count(run.nodes, n, f"type = '{t}'") for n, t in (("sources", "source"), ("sinkCalls", "sinkCall"), ("functions", "function")))])
    head = table.select(F.lit("callgraph.json").alias("file"), _json(meta=fields).alias("fields"))
    docs += document(head, {"nodes": run.nodes.select(F.lit("callgraph.json").alias("file"), F.col("node").alias("ord"), node.alias("item")), "edges": run.edges.select(F.lit("callgraph.json").alias("file"), place(F.col("src"), F.col("dst"), F.col("kind")).alias("ord"), edge.alias("item"))})

    # flows: each is an item of the run's list and of its feature's
    spot = F.struct(F.col("node_id").alias("id"), F.col("path").alias("filePath"), "line", "code", "description", F.struct(F.col("context_start").alias("startLine"), F.col("context").alias("lines")).alias("context"))
    placed = run.flow_nodes.select("flow_id", "path_id", "ord", "fallback", "warning", spot.alias("n"))
    steps = placed.groupBy("flow_id", "path_id").agg(F.array_sort(F.collect_list(F.struct("ord", "n"))).alias("s"), F.bool_or("fallback").alias("fallback"), F.array_sort(F.array_distinct(F.collect_list("warning"))).alias("warnings"))
    ways = run.flow_edges.groupBy("flow_id").agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("from"), F.col("dst").alias("to")))).alias("edges"))
    none = F.array().cast("array<struct<from:string,to:string>>")
    flow = steps.join(ways, "flow_id", "left").select("flow_id", _json(flowId=F.col("flow_id"), pathId=F.col("path_id"), nodes=F.col("s.n"), edges=F.coalesce("edges", none), meta=F.struct("fallback", "warnings")).alias("item"))
    table, fields = meta([count(steps, "flows"), count(run.flow_nodes, "nodes"), count(run.flow_edges, "edges"), count(steps, "fallbackFlows", "fallback")])
    docs += document(table.select(F.lit("dataflows.json").alias("file"), _json(meta=fields).alias("fields")), {"flows": flow.select(F.lit("dataflows.json").alias("file"), F.col("flow_id").alias("ord"), "item")})

    # the element tree, whole and by page
    ui_edge = place(F.col("src"), F.col("dst"), F.col("kind"))
    ui_node = _json(id=F.col("id"), category=F.col("category"), description=F.col("description"), name=F.col("name"), filePath=F.col("path"), line=F.col("line"))
    table, fields = meta([count(run.ui_nodes, "nodes"), count(run.ui_edges, "edges"), count(run.ui_nodes, "pages", "category = 'Page'"), count(run.ui_nodes, "elements", "category <> 'Page'")])
    whole = F.lit("ui_tree.json").alias("file")
    roots = run.pages.where("is_root and root_id <> ''").select(F.col("root_id").alias("id"))
    docs += document(table.select(whole, _json(meta=fields).alias("fields")), {"roots": roots.select(whole, F.col("id").alias("ord"), F.to_json(F.array("id")).alias("item")).withColumn("item", F.expr("substring(item, 2, length(item) - 2)")), "nodes": run.ui_nodes.select(whole, F.col("id").alias("ord"), ui_node.alias("item")), "edges": run.ui_edges.select(whole, ui_edge.alias("ord"), edge.alias("item"))})
    tree = F.concat(F.lit("pages/"), F.col("page_id"), F.lit("/ui_tree.json")).alias("file")
    n_nodes, n_edges = run.page_nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("nodes")), run.page_edges.groupBy("page_id").agg(F.count(F.lit(1)).alias("edges"))
    table, fields = meta([n_nodes, n_edges], ["page_id"])
    docs += document(table.select(tree, _json(meta=fields).alias("fields")), {"nodes": run.page_nodes.join(run.ui_nodes, "id").select(tree, F.col("id").alias("ord"), ui_node.alias("item")), "edges": run.page_edges.select(tree, ui_edge.alias("ord"), edge.alias("item"))})

    # pages and features
    pages = run.pages.select("page_id", F.struct(F.col("path").alias("filePath"), F.col("name").alias("structName"), "line", "description").alias("entry")).join(run.page_index.where("page_id is not null"), "page_id")
    totals = run.page_index.where("page_id is null").select("n_features", "n_flows")
    table, fields = meta([count(run.pages, "pages"), totals.select(F.col("n_features").alias("features"), F.col("n_flows").alias("flows")), count(steps.join(run.per_flow, "flow_id", "left_anti"), "unassignedFlows")])
    index = F.lit("pages/index.json").alias("file")
    docs += document(table.select(index, _json(meta=fields).alias("fields")), {"pages": pages.select(index, F.col("page_id").alias("ord"), _json(pageId=F.col("page_id"), entry=F.col("entry"), counts=F.struct(F.col("n_features").alias("features"), F.col("n_flows").alias("flows"))).alias("item"))})
    of_page = F.concat(F.lit("pages/"), F.col("page_id"), F.lit("/features/index.json")).alias("file")
    page_meta = F.struct(*[c.alias(k) for k, c in known.items()], F.col("page_id").alias("pageId"), F.struct(F.col("n_features").alias("features"), F.col("n_flows").alias("flows")).alias("counts"))
    anchor = F.struct(F.col("anchor.path").alias("filePath"), F.col("anchor.line"), F.col("anchor.ui_node").alias("uiNodeId"), F.col("anchor.function").alias("functionName"))
    feature = _json(featureId=F.col("feature_id"), title=F.col("title"), kind=F.col("kind"), anchor=anchor, counts=F.struct(F.col("n_flows").alias("flows"), F.col("n_nodes").alias("nodes"), F.col("n_edges").alias("edges")))
    docs += document(pages.select(of_page, _json(meta=page_meta, page=F.struct(F.col("page_id").alias("pageId"), "entry")).alias("fields")), {"features": run.features.select(of_page, number(F.col("place")).alias("ord"), feature.alias("item"))})

    folder = lambda name: F.concat(F.lit("pages/"), F.col("page_id"), F.lit("/features/"), F.col("feature_id"), F.lit(f"/{name}")).alias("file")
    own = F.struct(*[c.alias(k) for k, c in known.items()], F.struct(F.col("n_flows").alias("flows"), F.col("n_nodes").alias("nodes"), F.col("n_edges").alias("edges"), F.col("n_fallback").alias("fallbackFlows")).alias("counts"))
    docs += document(run.features.select(folder("dataflows.json"), _json(meta=own).alias("fields")), {"flows": flow.join(run.per_flow.select("flow_id", "page_id", "feature_id"), "flow_id").select(folder("dataflows.json"), F.col("flow_id").alias("ord"), "item")})
    refs = F.transform("refs", lambda r: F.struct(r["flow_id"].alias("flowId"), r["node_id"].alias("nodeId")))
    asked = run.permissions.join(run.features.select("page_id", "feature_id"), "feature_id")
    told = practice(F.col("permission"), F.col("mode"), F.col("scenario"), F.lit(purpose), F.lit(denied), refs)
    about = F.struct(*[c.alias(k) for k, c in known.items()], F.col("feature_id").alias("featureId"))
    docs += facts(run.features.select(folder("privacy_facts.json"), _json(meta=about).alias("fields")), asked.select(folder("privacy_facts.json"), F.col("permission").alias("ord"), told.alias("item")))
    rest = run.unmatched
    app = F.lit("app_permissions/privacy_facts.json").alias("file")
    left = rest.groupBy().agg(F.array_sort(F.collect_set("permission")).alias("p")).where("size(p) > 0")
    about = F.struct(*[c.alias(k) for k, c in known.items()], F.lit("__app_permissions").alias("featureId"), F.array(F.concat(F.lit(WARNING), F.array_join("p", ", "))).alias("warnings"))
    told = practice(F.col("permission"), F.col("mode"), *[F.lit(x) for x in UNPLACED], F.array().cast("array<string>"))
    docs += facts(left.select(app, _json(meta=about).alias("fields")), rest.select(app, F.col("permission").alias("ord"), told.alias("item")))

    said = run.report.select("section", "feature_id", number(F.col("ord")).alias("ord"), "text")
    section = said.groupBy("section", "feature_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct("text").alias("t")))).alias("tokens"))
    item = section.select("section", F.col("feature_id").alias("ord"), _json(featureId=F.col("feature_id"), tokens=F.col("tokens.t")).alias("item"))
    table, fields = meta([count(run.features, "features")])
    name = F.lit("privacy_report.json").alias("file")
    docs += document(table.select(name, _json(meta=fields).alias("fields")), {s: item.where(F.col("section") == s).select(name, "ord", "item") for s in ("collectionAndUse", "permissions")})
    paragraphs = said.groupBy("section", "feature_id").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(ord, text))), x -> x.text)"), "").alias("p")).where("trim(p) <> ''")
    docs.append(pieces(paragraphs, F.lit("privacy_report.txt"), 0, F.col("p"), place(F.col("section"), F.col("feature_id")), "\n\n"))

    counts, _ = meta([count(s, "sinks"), count(run.sources, "sources"), count(run.nodes, "callGraphNodes"), count(run.edges, "callGraphEdges"), count(steps, "dataflows"), count(run.flow_nodes, "dataflowNodes"), count(run.flow_edges, "dataflowEdges"), count(steps, "dataflowFallbackFlows", "fallback"), count(run.ui_nodes, "uiTreeNodes"), count(run.ui_edges, "uiTreeEdges"), totals.select(F.col("n_features").alias("pageFeatureCount")), count(run.pages, "pageCount"), count(steps.join(run.per_flow, "flow_id", "left_anti"), "pageFeatureUnassignedFlows"), count(run.files, "appFiles")])
    numbers = [c for c in counts.columns if c != "appFiles"]
    about = _json(runId=F.lit(run_id), generatedAt=F.lit(generated), input=F.struct(*[F.lit(v).alias(k) for k, v in given.items()]), scan=F.struct("appFiles"), counts=F.struct(*numbers))
    docs.append(pieces(counts, F.lit("meta.json"), 0, about))
    return reduce(DataFrame.unionByName, docs)


def facts(head: DataFrame, practices: DataFrame) -> list[DataFrame]:
    """Pieces of files of facts: head (file, fields), practices (file, ord, item)."""
    opened = head.select("file", F.concat(F.expr("left(fields, length(fields) - 1)"), F.lit(',\n"facts": {"dataPractices": [], "permissionPractices": [\n')).alias("text"))
    return [pieces(opened, F.col("file"), 0, F.col("text")), pieces(practices, F.col("file"), 1, F.col("item"), F.col("ord"), ",\n"), pieces(head, F.col("file"), 2, F.lit("\n]}}\n"))]


def write_run(run, path: str, registry: str, run_id: str, generated: str, given: dict[str, str], purpose: str, denied: str) -> None:
    """All documents of a run in ``path``, and its entries in the registry, in one step."""
    store.write_pieces(run_documents(run, run_id, generated, given, purpose, denied), path, registry, run_id)
