"""A whole run: from an app's files to sinks, flows, the element tree, pages, features, permissions and a report; and its command line."""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import frames, graphs, lookups
from quarry.plans import analysis, cpg, documents, features, report, symbols, ui
from quarry.plans import flows as flow_plans
from quarry.sources import files as sources
from quarry.sources import writers

#: What a permission is for and what refusing it means, where nothing else is known.
PURPOSE, DENIED = "实现相关功能", "相关功能可能无法正常使用"


@dataclass
class Run:
    """Tables of a run."""

    sinks: DataFrame
    sources: DataFrame
    nodes: DataFrame
    edges: DataFrame
    flow_nodes: DataFrame
    flow_edges: DataFrame
    ui_nodes: DataFrame
    ui_edges: DataFrame
    pages: DataFrame
    features: DataFrame
    page_index: DataFrame
    permissions: DataFrame
    report: DataFrame
    files: DataFrame
    per_flow: DataFrame
    page_nodes: DataFrame
    page_edges: DataFrame
    unmatched: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def described(sinks: DataFrame, declared: dict[str, DataFrame] | None, knowledge: DataFrame, override: DataFrame) -> DataFrame:
    """Sinks with description and permissions: from declarations by the hierarchical lookup, from the tables, from the override."""
    spark = sinks.sparkSession
    kind = "key string, description string, permissions array<string>"
    sdk = spark.createDataFrame([], kind)
    if declared is not None:
        decl, names = declared["declarations"], declared["defaults"].select("module", "name")
        wanted = sinks.select("module", "api_key").distinct().withColumn("symbol", F.expr("substring(api_key, length(module) + 2)"))
        found = symbols.resolve(wanted, symbols.rooted(decl, names)).where("found is not null")
        sdk = found.select(F.col("api_key").alias("key"), F.coalesce("summary", F.lit("")).alias("description"), F.coalesce("permissions", F.array().cast("array<string>")).alias("permissions"))
    return analysis.describe(sinks, sdk, sources.api_descriptions(knowledge), override, sources.api_permissions(knowledge))


def run(app_files: DataFrame, sdk_files: DataFrame | None = None, knowledge: DataFrame | None = None, override: DataFrame | None = None, said: DataFrame | None = None, most_paths: int | None = None, graph: tuple[DataFrame, DataFrame] | None = None, strings: DataFrame | None = None) -> Run:
    """The tables of a run over program files (path, text). ``said`` are a model's answers by path, if there is one; without, flows are made of their anchors.

    With the (nodes, edges) of a code property graph as ``graph``, the call graph and its paths are the shortest ways in it, else those of the scanned calls. ``strings`` (name, value) are the app's string resources.
    """
    spark = app_files.sparkSession
    facts = analysis.scan(app_files)
    knowledge = knowledge if knowledge is not None else spark.createDataFrame([], "file string, row long, key string, action string, detail string, permissions string, data string, data_detail string")
    override = override if override is not None else spark.createDataFrame([], "key string, description string")
    declared = analysis.scan_sdk(sdk_files) if sdk_files is not None else None
    raw = analysis.find_sinks(facts, declared)
    sinks = graphs._cut(described(raw, declared, knowledge, override))
    entries = analysis.entry_points(facts["lines"])
    if graph is None:
        calls = analysis.trimmed(analysis.call_graph(facts["blocks"], facts["calls"], entries, sinks))
        found, edges, paths = calls.nodes, calls.edges, graphs.simple_paths(calls.edges, calls.sources, calls.sinks, most=most_paths)
    else:
        found, edges, paths = cpg.call_graph_of(graphs._cut(cpg.path_matches(*graph, entries, sinks, most_paths)), graph[0])
        spots = sinks.groupBy("path", "line").agg(F.array_join(F.sort_array(F.collect_set("api_key")), ",").alias("api_keys"), F.lit("sinkCall").alias("type"))
        found = found.join(spots, ["path", "line", "type"], "left")
    edges, paths = graphs._cut(edges), graphs._cut(paths)
    nodes = graphs._cut(found.join(analysis.sink_titles(sinks), ["path", "line"], "left"))
    code = facts["lines"].select("path", F.col("line_no").alias("line"), F.trim("line").alias("code"))
    anchors = nodes.join(code, ["path", "line"], "left").withColumn("name", F.coalesce("name", "api_keys"))
    flow_nodes, flow_edges = flow_plans.build_flows(paths, anchors, facts["lines"], entries, said)
    flow_nodes, flow_edges = graphs._cut(flow_nodes), graphs._cut(flow_edges)
    ui_nodes, ui_edges, roots = ui.build_tree(app_files, facts["structs"], facts["blocks"], strings)
    ui_nodes = graphs._cut(ui_nodes)
    ui_edges = graphs._cut(ui_edges)
    counts = flow_plans.flow_counts(flow_nodes, flow_edges)
    asked = flow_nodes.select("flow_id", "path", "line").join(sinks.select("path", "line", F.explode("permissions").alias("permission")), ["path", "line"]).select("flow_id", "permission").distinct()
    grouped = features.group(flow_nodes, ui_nodes, ui_edges, roots, entries, facts["blocks"], facts["lines"], counts, asked)
    per_flow = grouped.per_flow
    allowed = report.feature_permissions(flow_nodes, per_flow, sinks, sources.api_permissions(knowledge), grouped.pages)
    runtime = graphs._cut(sources.runtime_permissions(app_files))
    inferred = allowed.select("permission").union(sinks.select(F.explode("permissions").alias("permission"))).distinct()
    kept, _, missing = analysis.reconcile(sources.app_permissions(app_files), inferred, allowed.withColumn("_p", F.col("permission")), runtime)
    kept = graphs._cut(kept.drop("_p"))
    unmatched = graphs._cut(lookups.flag_member(missing, runtime, ["permission"], "mode", "dynamic", "preauthorized"))
    sentence = T.permission_sentence(F.col("scenario"), F.col("permission"), F.lit(PURPOSE), F.lit(DENIED))
    tokens = kept.select(F.lit("permissions").alias("section"), "feature_id", F.row_number().over(features.W.partitionBy("feature_id").orderBy("permission")).alias("ord"), sentence.alias("text"))
    silent = grouped.features.select("feature_id").join(kept.select("feature_id"), "feature_id", "left_anti")
    tokens = tokens.unionByName(report.placeholder_report(silent, "无权限证据").where("section = 'permissions'").join(kept.select(F.lit(True).alias("_any")).limit(1), F.lit(True), "left").where(F.col("_any").isNull() | (F.col("feature_id") != report.STATUS)).drop("_any"))
    return Run(sinks, entries, nodes, edges, flow_nodes, flow_edges, ui_nodes, ui_edges, grouped.pages, grouped.features, grouped.index, kept, tokens, app_files.select("path"), grouped.per_flow, graphs._cut(grouped.nodes), graphs._cut(grouped.edges), unmatched)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    """The command line: ``--name value`` or ``--name=value``; an unknown option is an error."""
    p = argparse.ArgumentParser(prog="quarry", description="Analyse an app's files, or evaluate a run's permissions against known ones.", allow_abbrev=False)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyse", allow_abbrev=False)
    a.add_argument("--app", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--sdk")
    a.add_argument("--csv")
    a.add_argument("--max-paths", type=int)
    a.add_argument("--backend", choices=("calls", "cpg"), default="calls", help="where paths come from: the scanned calls, or a code property graph")
    a.add_argument("--graph", help="JSON document of the code property graph, with --backend cpg")
    a.add_argument("--stamp", help="the run's name below its app; the present time without it")
    a.add_argument("--tables", help="also write the run's tables to this folder")
    e = sub.add_parser("evaluate", allow_abbrev=False)
    e.add_argument("--groundtruth", required=True)
    e.add_argument("--runs", required=True)
    e.add_argument("--what", choices=("permissions", "sinks"), default="permissions")
    e.add_argument("--app", help="this app only")
    e.add_argument("--run-id", help="with --app: the run of this id instead of the latest")
    e.add_argument("--run-dir", help="with --app: the run in this folder")
    e.add_argument("--details", action="store_true", help="of sinks: also those that are missing, extra or invalid")
    e.add_argument("--format", choices=("table", "json"), default="table")
    args = p.parse_args(argv)
    if args.command == "analyse" and (args.backend == "cpg") != bool(args.graph):
        p.error("--backend cpg goes with --graph")
    if args.command == "evaluate" and (args.run_id or args.run_dir) and not args.app:
        p.error("--run-id and --run-dir go with --app")
    if args.command == "evaluate" and args.details and args.what != "sinks":
        p.error("--details goes with --what sinks")
    return args


def chosen(found: DataFrame, runs: str, app: str | None = None, folder: str | None = None) -> DataFrame:
    """Of predictions (path, ...) those of each app's latest run, with ``app``; of one app and a run's folder, if they are named."""
    if folder:
        return found.where(F.contains("path", F.lit(f"{folder.rstrip('/')}/"))).withColumn("app", F.lit(app))
    named = sources.by_app_and_run(found, runs)
    named = named.where(F.col("app") == app) if app else named
    return named.join(sources.latest_runs(named.select("app", "run_ts").distinct()), ["app", "run_ts"]).drop("run_ts")


def evaluate(spark: SparkSession, truth: str, runs: str, app: str | None = None, folder: str | None = None) -> DataFrame:
    """(app, gt, pred, tp, fp, fn, recall, precision, fpr) of permissions by app, and in total where app is null; runs are folders app/run below ``runs``."""
    known = sources.groundtruth(spark, truth)
    found = chosen(sources.predictions(spark, folder or runs), runs, app, folder).select("app", "permission").distinct()
    return frames.evaluate(known.where(F.col("app") == app) if app else known, found, ["app"], ["permission"], total=True)


#: What makes a sink the same one.
SINK = ["file_path", "call_line", "api_key"]


def sink_sets(spark: SparkSession, truth: str, runs: str, app: str | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((app, and SINK, valid) that are true, and those predicted by the apps' runs): of apps that have a file app.json in ``truth``."""
    known = sources.sink_records(spark, truth).withColumn("app", F.regexp_extract("path", r"([^/]*)\.json$", 1))
    known = known.where(F.col("app") == app) if app else known
    found = chosen(sources.sink_records(spark, folder or runs, "sinks.json"), runs, app, folder).join(known.select("app").distinct(), "app", "left_semi")
    return known.select("app", *SINK, "valid").distinct(), found.select("app", *SINK, "valid").distinct()


def evaluate_sinks(spark: SparkSession, truth: str, runs: str, app: str | None = None, folder: str | None = None) -> DataFrame:
    """As ``evaluate``, of sinks: equal by file, line and key; records without one of these don't count."""
    known, found = sink_sets(spark, truth, runs, app, folder)
    return frames.evaluate(known.where("valid").drop("valid"), found.where("valid").drop("valid"), ["app"], SINK, total=True)


def sink_differences(spark: SparkSession, truth: str, runs: str, app: str | None = None, folder: str | None = None) -> DataFrame:
    """(app, side, and SINK): true sinks that no run has as ``missing``, predicted ones that aren't true as ``extra``, and records that don't count as ``invalid``."""
    known, found = sink_sets(spark, truth, runs, app, folder)
    a, b = (x.where("valid").drop("valid") for x in (known, found))
    side = lambda df, name: df.select("app", F.lit(name).alias("side"), *SINK)
    return side(a.exceptAll(b), "missing").unionByName(side(b.exceptAll(a), "extra")).unionByName(side(known.unionByName(found).where("not valid"), "invalid"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    if args.command == "evaluate":
        folder = args.run_dir or (sources.resolve_run(sources.run_registry(spark, f"{args.runs.rstrip('/')}/_runs"), run_id=args.run_id) if args.run_id else None)
        if args.run_id and folder is None:
            raise SystemExit(f"no run {args.run_id}")
        where = (spark, args.groundtruth, args.runs, args.app, folder)
        got = (evaluate_sinks if args.what == "sinks" else evaluate)(*where)
        rows = report.evaluation_table(got) if args.format == "table" else got.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
        print("\n".join(r.line for r in rows.collect()))  # a row for each app
        if args.details:
            told = sink_differences(*where).orderBy("app", "side", *SINK).select(F.to_json(F.struct("*")).alias("line"))
            for r in told.toLocalIterator():
                print(r.line)
        return
    app = sources.app_sources(spark, args.app).withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))
    sdk = sources.read_texts(spark, args.sdk, (".d.ts", ".d.ets")) if args.sdk else None
    knowledge, override = (sources.read_knowledge(spark, args.csv), sources.override_descriptions(spark, f"{args.csv}/sdk_api_description_override.csv")) if args.csv else (None, None)
    graph = sources.read_cpg(spark, args.graph, app) if args.backend == "cpg" else None
    got = run(app, sdk, knowledge, override, most_paths=args.max_paths, graph=graph, strings=sources.app_strings(spark, args.app))
    run_id, folder = save(got, args.out, args.app, args.stamp, {"appPath": args.app, "sdkPath": args.sdk or "", "csvDir": args.csv or "", "graphBackend": args.backend})
    if args.tables:
        writers.write_run(got.tables(), args.tables)
    print(json.dumps({"runId": run_id, "out": folder}))


def save(got: Run, root: str, app: str, stamp: str | None = None, given: dict[str, str] | None = None) -> tuple[str, str]:
    """Write a run's documents to ``root``/app/stamp and register it in ``root``/_runs: (run id, folder)."""
    now = got.sinks.sparkSession.range(1).select(T.run_stamp(F.current_timestamp()).alias("stamp"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"), T.app_name(F.lit(app)).alias("app")).first()
    run_id, folder = f"{now.app}_{stamp or now.stamp}", f"{root.rstrip('/')}/{now.app}/{stamp or now.stamp}"
    documents.write_run(got, folder, f"{root.rstrip('/')}/_runs", run_id, now.at, given or {}, PURPOSE, DENIED)
    return run_id, folder


if __name__ == "__main__":
    main()
