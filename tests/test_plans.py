"""Plans on small program files: pages and features, flows, graph anchors, symbols, the tree, and a whole run."""

import json

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import frames, graphs, lookups
from quarry.plans import analysis, cpg, features, flows, report, run, symbols, ui
from quarry.sources import files, writers
from tests.test_operators import shuffled_rows

HOME = """import router from '@ohos.router';
import geo from '@ohos.geoLocationManager';

@Entry
@Component
struct Home {
  build() {
    Column() {
      Button('登录')
        .onClick(() => this.open())
      Text('你好')
        .onClick(() => {
          router.pushUrl({ url: 'pages/Login' });
        })
    }
  }
  open() {
    geo.getCurrentLocation();
  }
}
"""
LOGIN = """@Component
export default struct Login {
  build() {
    TextInput()
  }
}
"""
SDK = """/**
 * Places.
 */
declare namespace geo {
  /**
   * Gets the location.
   * @permission ohos.permission.LOCATION
   */
  function getCurrentLocation(): Promise<Location>;
}
export default geo;
"""


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def app(spark):
    return spark.createDataFrame([("app/src/main/ets/pages/Home.ets", HOME), ("app/src/main/ets/pages/Login.ets", LOGIN)], "path string, text string")


def test_grouping_by_page_and_feature(spark):
    """Four flows on one page with one element: two at the element, by their lines and by a handler, two by their sources."""
    code = [""] * 60
    code[1], code[11], code[19], code[20], code[29] = "struct Home {", "  build() {", "    Button('搜索')", "      .onClick(() => this.onSearch())", "  onSearch() {"
    lines = spark.createDataFrame([("pages/Home.ets", i + 1, t) for i, t in enumerate(code)], "path string, line_no int, line string")
    blocks = spark.createDataFrame([("pages/Home.ets", "build", 12, 23), ("pages/Home.ets", "onSearch", 30, 34), ("pages/Home.ets", "aboutToAppear", 40, 44)], "path string, name string, start_line int, end_line int")
    ui_nodes = spark.createDataFrame([("page1", "Page", "Home", None, "pages/Home.ets", 2), ("el1", "Button", "Button", "搜 索", "pages/Home.ets", 20)], "id string, category string, name string, description string, path string, line int")
    edges = spark.createDataFrame([("page1", "el1", "contains"), ("page1", "other", "contains")], "src string, dst string, kind string")
    sources = spark.createDataFrame([("pages/Home.ets", 12, "build"), ("pages/Home.ets", 40, "aboutToAppear"), ("x/entryability/E.ets", 3, "onCreate"), ("util/U.ets", 5, "build")], "path string, line int, function string")
    steps = [("flow:a", 0, "pages/Home.ets", 12), ("flow:a", 1, "pages/Home.ets", 20), ("flow:b", 0, "pages/Home.ets", 31), ("flow:c", 0, "x/entryability/E.ets", 3), ("flow:d", 0, "util/U.ets", 5), ("flow:e", 0, "util/V.ets", 9)]
    nodes = spark.createDataFrame(steps, "flow_id string, ord int, path string, line int")
    counts = spark.createDataFrame([(f"flow:{k}", 2, 1, k == "e", ["w"]) for k in "abcde"], "flow_id string, n_nodes int, n_edges int, fallback boolean, warnings array<string>")
    roots = spark.createDataFrame([("page1",)], "id string")
    got = features.group(nodes, ui_nodes, edges, roots, sources, blocks, lines, counts, strict=30)
    assert rows(got.pages, "page_id", "start", "stop", "build_start", "build_stop")[:1] == [("AppLifecycle", 0, 0, None, None)]
    assert rows(got.pages.where("page_id = 'Home'"), "start", "stop", "build_start", "build_stop", "description") == [(2, 60, 12, 23, "首页")]
    per = {r.flow_id: r for r in got.per_flow.collect()}
    assert per["flow:a"].feature_id == per["flow:b"].feature_id
    assert (per["flow:a"].kind, per["flow:a"].title, per["flow:a"].anchor.line) == ("ui", "搜索", 20)
    assert (per["flow:c"].page_id, per["flow:c"].title) == ("AppLifecycle", "应用创建时")
    assert (per["flow:d"].page_id, per["flow:d"].title) == ("Home", "首页展示与交互")
    assert (per["flow:e"].page_id, per["flow:e"].title) == ("Home", "处理逻辑")
    assert [(r.n_flows, r.n_nodes, r.n_fallback, r.warnings) for r in got.features.where("kind = 'ui'").collect()] == [(2, 4, 0, ["w"])]
    assert {(r.page_id, r.n_features, r.n_flows) for r in got.index.collect()} == {("Home", 3, 4), ("AppLifecycle", 1, 1), (None, 4, 5)}
    assert rows(got.edges, "page_id", "src", "dst") == [("Home", "page1", "el1")]
    bare = features.build_pages(ui_nodes.limit(0), roots, blocks, lines.groupBy("path").agg(F.max("line_no").alias("n_lines")))
    assert rows(bare, "page_id", "description") == [("inferred", "推断页面")]
    twice = features.page_ids(spark.createDataFrame([("1", "A b", "p/x.ets", 1), ("2", "A b", "p/y.ets", 1), ("3", None, "p/z.ets", 1)], "id string, name string, path string, line int"))
    assert [r.page_id for r in twice.orderBy("id").collect()] == ["A_b", "A_b_" + spark.sql("select left(sha1('p/y.ets'), 8)").first()[0], "z"]


def test_flows_from_answers_and_fallback(spark):
    nodes = spark.createDataFrame([("s", "source", "f", 1, "start", None), ("m", "function", "f", 3, "mid", None), ("k", "sinkCall", "f", 5, None, "calls it")], "node string, type string, path string, line int, name string, description string").withColumn("code", F.lit("?"))
    paths = spark.createDataFrame([(p, ["s", "m", "gone", "k"]) for p in ("p1", "p2", "p3", "p4", "p5")], "path_id string, path array<string>")
    lines = frames.lines_of(spark.createDataFrame([("f", "a\n b\nc\nd\ne")], "path string, text string"), ["path"])
    sources = spark.createDataFrame([("f", 1, "build"), ("f", 2, "build")], "path string, line int, function string")
    step = lambda n: {"filePath": "f", "line": n, "description": f"at {n}"}
    said = [
        ("p1", "sure: " + json.dumps({"nodes": [step(1), step(3), step(4), step(5)], "edges": [{"from": 0, "to": 3}]}) + " done"),
        ("p2", json.dumps({"nodes": [step(3), step(1), step(5)]})),
        ("p3", json.dumps({"nodes": [step(1), step(2), step(3), step(5)]})),
        ("p4", json.dumps({"nodes": [step(1), step(3), step(5), step(4)]})),
    ]
    got, edges = flows.build_flows(paths, nodes, lines, sources, spark.createDataFrame(said, "path_id string, answer string"))
    by = {p: sorted((r.ord, r.line, r.code, r.fallback, r.warning) for r in got.where(F.col("path_id") == p).collect()) for p in ("p1", "p2", "p3", "p4", "p5")}
    assert by["p1"] == [(0, 1, "a", False, None), (1, 3, "c", False, None), (2, 4, "d", False, None), (3, 5, "e", False, None)]
    assert [{r[4] for r in by[p]} for p in ("p2", "p3", "p4", "p5")] == [{"anchors missing or out of order"}, {"foreign source"}, {"goes on behind the sink"}, {"no answer"}]
    assert [r[:3] for r in by["p5"]] == [(0, 1, "a"), (1, 3, "c"), (2, 5, "e")]
    assert rows(edges.where("flow_id in ('flow:p1', 'flow:p5')"), "flow_id", "src", "dst") == [("flow:p1", "p1:n1", "p1:n4"), ("flow:p5", "p5:n1", "p5:n2"), ("flow:p5", "p5:n2", "p5:n3")]
    assert got.where("path_id = 'p5' and ord = 2").first().description == "calls it" + flows.FALLBACK_MARK
    assert {(r.n_nodes, r.n_edges, r.fallback) for r in flows.flow_counts(got, edges).where("flow_id in ('flow:p1', 'flow:p5')").collect()} == {(4, 1, False), (3, 2, True)}
    alone, _ = flows.build_flows(paths.limit(1), nodes, lines, sources)
    assert alone.where("fallback").count() == 3
    assert flows.evidence_nodes(got.where("path_id = 'p1'"), 2).count() == 2


def test_graph_paths_between_anchors(spark):
    nodes = [(1, ["Function"], 1, 9, "build", ""), (2, ["Call"], 3, 3, "go", "this.go()"), (3, ["Function"], 20, 29, "go", ""), (4, ["Call"], 22, 22, "send", "net.send(x)"), (5, ["Block"], 21, 25, "", ""), (6, ["Function"], 40, 44, "send", "")]
    n = spark.createDataFrame([(i, labels, "f", a, b, name, code, name) for i, labels, a, b, name, code in nodes], "id long, labels array<string>, path string, line int, end_line int, name string, code string, full_name string")
    e = spark.createDataFrame([(1, 2, "AST"), (3, 5, "AST"), (5, 4, "AST"), (3, 4, "DFG")], "src long, dst long, type string")
    sources = spark.createDataFrame([("f", 1, "build")], "path string, line int, function string")
    sinks = spark.createDataFrame([("f", 22)], "path string, line int")
    assert rows(cpg.local_calls(n), "src", "dst") == [(2, 3)]
    assert cpg.source_anchors(n, sources).where("rank = 1").first().id == 1
    assert cpg.sink_anchors(n, sinks).where("rank = 1").first().id == 4
    assert [r.place for r in cpg.by_line(n).orderBy("line").collect()] == [1, 2, 3, 4, 5, 6]
    found = cpg.path_matches(n, e, sources, sinks)
    # the shortest way ends at another anchor of the sink, the function around it
    assert found.first().ids == [3] or found.first().ids[0] == 1
    strict = cpg.path_matches(n.where("id not in (5, 6)"), e, sources, sinks.where("line = 22"))
    g_nodes, g_edges, g_paths = cpg.call_graph_of(spark.createDataFrame([("f", 1, "build", "f", 22, [1, 2, 3, 4]), ("f", 1, "build", "f", 22, [1, 2, 3, 4])], "source_path string, source_line int, function string, sink_path string, sink_line int, ids array<long>"), n)
    assert strict.count() == 1
    assert [r.path for r in g_paths.collect()] == [["source:f:1:build", "cpg:2", "cpg:3", "sink:f:22"]]
    assert rows(g_edges, "src", "kind") == [("cpg:2", "calls"), ("cpg:3", "containsSink"), ("source:f:1:build", "calls")]
    assert rows(g_nodes, "node", "type") == [("cpg:2", "function"), ("cpg:3", "function"), ("sink:f:22", "sinkCall"), ("source:f:1:build", "source")]


def test_local_calls_of_a_common_name(spark):
    """Nearest of the own file, of other files, of none, against brute force; calls and functions of one name aren't paired out."""
    n = 600
    made = [(i, ["Call"] if i % 2 else ["Function"], [None, "f", "g", "h"][i * 7 % 16 % 4], i * 5 % 11, "go", f"{'q' if i % 3 else 'this'}.go()", "q.go") for i in range(n)]
    df = spark.createDataFrame([(*r[:4], r[3], *r[4:]) for r in made], "id long, labels array<string>, path string, line int, end_line int, name string, code string, full_name string")
    got = cpg.local_calls(df)
    want = set()
    for i, label, path, line, *_ in made:
        if label == ["Call"]:
            fn = [(2 if path is None or p is None else int(p != path), abs(l - line), j) for j, k, p, l, *_ in made if k == ["Function"] and (i % 3 or path is not None and p == path)]
            want |= {(i, j) for _, _, j in sorted(fn)[:6]}
    assert {tuple(r) for r in got.collect()} == want
    assert shuffled_rows(got) <= 30 * n


def test_symbols(spark):
    decl = analysis.declared(spark.createDataFrame([("sdk/@ohos.geo.d.ts", SDK)], "path string, text string"))
    seen = symbols.rooted(decl, spark.createDataFrame([("@ohos.geo", "geo")], "module string, name string"))
    wanted = spark.createDataFrame([("@ohos.geo", x) for x in ("getCurrentLocation", "getCurrentLocation.more", "nothing")], "module string, symbol string")
    got = {r.symbol: (r.found, r.summary, r.permissions) for r in symbols.resolve(wanted, seen).collect()}
    assert got["getCurrentLocation"] == got["getCurrentLocation.more"] == ("getCurrentLocation", "Gets the location.", ["ohos.permission.LOCATION"])
    assert got["nothing"] == (None, None, None)
    inner = {r.symbol: r.found for r in symbols.resolve(wanted, decl).collect()}
    assert inner["getCurrentLocation"] == "geo.getCurrentLocation"


def test_whole_run(spark, tmp_path):
    sdk = spark.createDataFrame([("sdk/@ohos.geoLocationManager.d.ts", SDK)], "path string, text string")
    got = run.run(app(spark), sdk)
    assert rows(got.sinks, "line", "description", "permissions") == [(13, "暂无描述", []), (18, "Gets the location.", ["ohos.permission.LOCATION"])]
    assert rows(got.ui_nodes, "category", "name") == [("Button", "Button"), ("Button", "Text"), ("Input", "TextInput"), ("Page", "Home"), ("Page", "Login")]
    assert [k for k, in rows(got.ui_edges, "kind")] == ["contains", "contains", "contains", "navigatesTo"]
    assert rows(got.pages, "page_id", "is_root") == [("Home", True), ("Login", False)]
    assert {r.fallback for r in got.flow_nodes.collect()} == {True}
    assert got.flow_nodes.select("flow_id").distinct().count() == 3
    assert rows(got.features, "page_id", "kind", "title", "n_flows") == [("Home", "ui", "你好", 1), ("Home", "ui", "登录", 2)]
    assert {tuple(r) for r in got.page_index.collect()} == {("Home", 2, 3), ("Login", 0, 0), (None, 2, 3)}
    assert rows(got.permissions, "permission", "mode", "scenario") == [("ohos.permission.LOCATION", "preauthorized", "登录")]
    assert "在“登录”场景中，我们会调用ohos.permission.LOCATION" in " ".join(r.text for r in got.report.collect())
    writers.write_run(got.tables(), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/pages")).count() == 2


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt/A.txt").write_text("ohos.permission.X\nohos.permission.Y\n")
    for when, name in (("2024", "ohos.permission.OLD"), ("2025", "ohos.permission.X")):
        d = tmp_path / f"runs/A/{when}/pages/p/features/q"
        d.mkdir(parents=True)
        (d / "privacy_facts.json").write_text(json.dumps({"facts": {"permissionPractices": [{"permissionName": name}]}}))
    run.main(["evaluate", "--groundtruth", str(tmp_path / "gt"), "--runs", str(tmp_path / "runs")], spark)
    said = capsys.readouterr().out.splitlines()
    assert said[0].split() == ["App", "GT", "Pred", "TP", "FP", "FN", "Recall", "FPR"]
    assert said[2].split()[:6] == ["A", "2", "1", "1", "0", "1"]
    assert said[3].split()[0] == "TOTAL"
    assert rows(files.run_predictions(spark, str(tmp_path / "runs/A/2025")), "permission") == [("ohos.permission.X",)]
    try:
        run.arguments(["analyse", "--app", "a", "--out=b", "--nope", "1"])
    except SystemExit as e:
        assert e.code == 2
    else:
        raise AssertionError
    assert run.arguments(["analyse", "--app", "a", "--out=b"]).out == "b"


def test_runs_and_documents(spark, tmp_path):
    writers.register_run(spark.createDataFrame([("r1", "/o/1")], "run_id string, output_dir string").coalesce(1), str(tmp_path / "reg"))
    known = spark.createDataFrame([("r1", "/o/1", 1), ("r2", "/o/2", 2)], "run_id string, output_dir string, mtime int")
    assert [files.resolve_run(known), files.resolve_run(known, run_id="r1"), files.resolve_run(known, " /x ", "r1"), files.resolve_run(known, run_id="r9")] == ["/o/2", "/o/1", "/x", None]
    assert files.run_registry(spark, str(tmp_path / "reg")).first().output_dir == "/o/1"
    writers.write_document(known.where("run_id = 'r1'"), str(tmp_path / "doc"))
    text = next((tmp_path / "doc").glob("part-*.txt")).read_text()
    assert json.loads(text) == [{"run_id": "r1", "output_dir": "/o/1", "mtime": 1}]
    assert "\n" in text
    writers.write_csv(spark.createDataFrame([("a,b", None), ("c", "d")], "x string, y string").coalesce(1), str(tmp_path / "csv"), ["x", "y"])
    assert next((tmp_path / "csv").glob("part-*.txt")).read_text(encoding="utf-8") == '﻿x,y\n"a,b",\nc,d\n'
    bad = files.checked(spark.createDataFrame([(" ", 1), ("a", 0), ("b", 2)], "n string, k int"), ["n"], ["k"])
    assert (rows(bad[0], "n"), bad[1].count()) == ([("b",)], 2)


def test_permission_constants(spark):
    a = "const ASK = ['ohos.permission.MIC'];\nctx.requestPermissionsFromUser(c, ASK)\nmgr.request(Other.CAM)"
    b = "export class Other { static CAM = 'ohos.permission.CAMERA' }\n" + "//" * 220 + "\nconst ASK = 'ohos.permission.WRONG'"
    got = files.runtime_permissions(spark.createDataFrame([("x/a.ets", a), ("x/b.ets", b), ("x/src/ohosTest/t.ets", "m.request('ohos.permission.TEST')")], "path string, text string"))
    assert rows(got, "permission") == [("ohos.permission.CAMERA",), ("ohos.permission.MIC",)]


def test_needles_of_any_kind(spark):
    lines = spark.createDataFrame([(1, "上传头像 xfoobar"), (2, "foo")], "k int, t string")
    needles = spark.createDataFrame([("头像",), ("foo",), ("foobar",), ("像 xfo",), ("",), ("none",)], "n string")
    assert rows(lookups.text_matches(lines, needles, "t", "n"), "k", "n") == [(1, "foo"), (1, "foobar"), (1, "像 xfo"), (1, "头像"), (2, "foo")]
    named = spark.createDataFrame([("f", 1, "x this . go y"), ("f", 2, "gone (1)"), ("f", 3, "ago(1)")], "p string, k int, t string")
    assert rows(lookups.named_in(named, spark.createDataFrame([("f", "go"), ("f", "gone")], "p string, n string"), ["p"], "t", "n"), "k", "n") == [(1, "go"), (2, "gone")]


def test_wide_and_open_intervals(spark):
    blocks = spark.createDataFrame([("f", k, k * k) for k in range(1, 40)] + [("f", 0, 2**40)], "file string, start long, end long")
    points = spark.createDataFrame([("f", x / 2) for x in range(-3, 3200, 7)], "file string, at double")
    got = rows(lookups.containing(points, blocks, ["file"], "at", "start", "end"), "at", "start")
    assert got == sorted((x / 2, a) for x in range(-3, 3200, 7) for a, b in [*((k, k * k) for k in range(1, 40)), (0, 2**40)] if a <= x / 2 <= b)


def test_titles_and_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    titles = {"ets/pages/Index.ets": "首页", "ets/pages/Home.ets": "首页", "ets/pages/ChatPage.ets": "聊天页面", "ets/pages/my/Index.ets": "首页", "ets/pages/my/Foo.ets": "我的页面", "ets/pages/ChatMessageView.ets": "聊天聊天页面", "ets/pages/": "页面"}
    assert {p: one(T.page_title(F.lit(p))) for p in titles} == titles
    assert one(T.is_low_quality(F.lit("功能，入口；")))
    assert one(T.absolute_path(F.lit("/a/./b/../c"))) == "/a/c"
    assert one(T.cut_list(F.array(*[F.lit(x) for x in (1, 2, 3)]), 2)).asDict() == {"items": [1, 2], "cut": True}
    assert [one(T.limit_number(F.lit(x))) for x in ("3.9", "-1", "x")] == [3, 1, None]
    long = spark.createDataFrame([("f", i, f"l{i}") for i in range(1, 101)], "path string, line_no int, line string")
    told = frames.head_tail(long, ["path"], line="line").orderBy("line_no").collect()
    assert len(told) == 77
    assert told[56].line == "...（中间省略 24 行）..."


def test_paths_stop_at_the_limit(spark):
    """A ladder with 2**12 ways: with a limit, those behind the first are never followed to the end."""
    steps = [(f"{k}{a}", f"{k + 1}{b}") for k in range(12) for a in "ab" for b in "ab"]
    e = spark.createDataFrame([("s", "0a"), ("s", "0b"), *steps, ("12a", "z"), ("12b", "z")], "src string, dst string")
    node = lambda x: spark.createDataFrame([(x,)], "node string")
    got = graphs.simple_paths(e, node("s"), node("z"), most=2).orderBy("path_id").collect()
    assert [r.path_id for r in got] == ["p1", "p2"]
    assert "".join(got[0].path) == "s" + "".join(f"{k}a" for k in range(13)) + "z"


def test_reports(spark):
    none = spark.createDataFrame([], "feature_id string")
    assert rows(report.placeholder_report(none, "x"), "section", "feature_id") == [("collectionAndUse", report.STATUS), ("permissions", report.STATUS)]
    refs = spark.createDataFrame([("f", "n"), ("f", "gone")], "flow_id string, node_id string")
    kept, warnings = report.valid_refs(refs, refs.limit(1), ["flow_id", "node_id"])
    assert (kept.count(), [r[0] for r in warnings.collect()]) == (1, ["invalid ref: f/gone"])
    tree = ui.primary_structs(spark.createDataFrame([("f", "A", 1, 3, False), ("f", "B", 5, 9, True)], "path string, name string, start_line int, end_line int, is_default boolean"))
    assert tree.first().name == "B"
