from pyspark.sql import functions as F

from quarry.functions import scanners
from quarry.operators import frames
from quarry.plans import analysis, features
from quarry.sources import files, writers

CODE = """import router from '@ohos.router';

@Entry
@Component
struct Home {
  build() {
    this.first();
  }
  first() {
    second();
  }
}
function second() {
  router.pushUrl({ url: 'pages/a' });
}
"""
SDK = """/**
 * Pages of an app.
 * @permission ohos.permission.INTERNET
 */
declare namespace router {
  function pushUrl(options: Options): Promise<Result | Other[]>;
}
export default router;
"""


def app(spark):
    return spark.createDataFrame([("app/pages/Home.ets", CODE)], "path string, text string")


def test_call_chain(spark):
    sdk = spark.createDataFrame([("sdk/@ohos.router.d.ts", SDK)], "path string, text string")
    sinks, edges, flow = analysis.analyse(app(spark), sdk)
    assert [(r.line, r.api_key, r.import_line) for r in sinks.collect()] == [(14, "@ohos.router.pushUrl", 1)]
    assert sorted(r.kind for r in edges.collect()) == ["calls", "calls", "containsSink"]
    assert [r.type for r in flow.orderBy("ord").collect()] == ["source", "function", "function", "sinkCall"]
    assert analysis.analyse(app(spark))[0].first().api_key == "@ohos.router.router.pushUrl"


def test_entry_points_and_structs(spark):
    lines = frames.lines_of(app(spark), ["path"])
    assert [(r.line, r.function) for r in analysis.entry_points(lines).collect()] == [(6, "build")]
    assert [r["name"] for r in analysis.entry_structs(lines, scanners.scan_structs(app(spark))).collect()] == ["Home"]


def test_scanners():
    assert scanners.return_types("Promise<A | B[]>") == ["A", "B"]
    assert scanners.return_types("Map<string, (x.Y)>") == ["string", "Y"]
    assert [b[0] for b in scanners.blocks("const f = (a) => {\n g('}')\n}\nif (x) {\n}\n// h() {\n")] == ["f"]
    assert scanners.matching("(a ')' /* ) */ b)", 0) == 16
    assert list(scanners.imports("import { a as b, type C } from 'm';\nimport type D from 'n';\nimport * as x from 'k'")) == [("m", "named", "a", "b", 1, "import { a as b, type C } from 'm';"), ("k", "namespace", "*", "x", 3, "import * as x from 'k'")]
    made = list(scanners.calls("const t = mk.create();\nt.go();\nnew Q(1)"))
    assert [(c[5], c[7], c[8]) for c in made] == [("mk.create", False, "t"), ("t.go", False, None), ("Q", True, None)]
    [decl] = [d for d in scanners.declarations(SDK) if d[1] == "pushUrl"]
    assert (decl[0], decl[5]) == ("router", ["Result", "Other"])


def test_sources_and_writers(spark, tmp_path):
    (tmp_path / "a/src/main/ets").mkdir(parents=True)
    (tmp_path / "a/node_modules/src/main/ets").mkdir(parents=True)
    (tmp_path / "a/src/main/ets/x.ets").write_text("ohos.permission.CAMERA requestPermissionsFromUser(c, ['ohos.permission.MIC'])")
    (tmp_path / "a/node_modules/src/main/ets/y.ets").write_text("no")
    got = files.app_sources(spark, str(tmp_path / "a"))
    assert got.count() == 1
    assert sorted(r[0] for r in files.app_permissions(got).collect()) == ["ohos.permission.CAMERA", "ohos.permission.MIC"]
    assert [r[0] for r in files.runtime_permissions(got).collect()] == ["ohos.permission.MIC"]
    (tmp_path / "k").mkdir()
    (tmp_path / "k/a.csv").write_text('﻿敏感行为,行为子项,相关API,相关权限,敏感数据项,敏感数据子项\n看,细,"@ohos.a->b(x, y)",ohos.permission.P ohos.permission.O,数,据\n再,,@ohos.a.b,ohos.permission.Q,,\n')
    (tmp_path / "k/b.csv").write_text("x,y\n1,2\n")
    know = files.read_knowledge(spark, str(tmp_path / "k"))
    assert [tuple(r) for r in files.api_descriptions(know).collect()] == [("@ohos.a.b", "看 / 细; 权限: ohos.permission.P ohos.permission.O; 数据: 数 / 据")]
    assert files.api_permissions(know).first().permissions == ["ohos.permission.O", "ohos.permission.P", "ohos.permission.Q"]
    assert files.override_descriptions(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt/App.txt").write_text("ohos.permission.INTERNET（可选）\n未识别\n")
    assert [tuple(r) for r in files.groundtruth(spark, str(tmp_path / "gt")).collect()] == [("App", "ohos.permission.INTERNET")]
    (tmp_path / "s.json").write_text('{"string":[{"name":"a","value":"1"},{"name":"a","value":"2"},{"name":"b","value":" "}]}')
    assert [tuple(r) for r in files.string_table(spark, str(tmp_path / "none.json"), str(tmp_path / "s.json")).collect()] == [("a", "2")]
    df = spark.createDataFrame([("a,b", None), ('q"q', "x")], "c string, d string")
    assert sorted(r[0] for r in writers.csv_lines(df, ["c", "d"]).collect()) == ['"a,b",', '"q""q",x']
    tokens = spark.createDataFrame([("s", "f2", 1, "b"), ("s", "f1", 2, "y"), ("s", "f1", 1, "x"), ("s", "f3", 1, " ")], "section string, feature_id string, ord int, text string")
    assert writers.report_text(tokens).first().text == "xy\n\nb"


def test_page_choice_and_nearest_element(spark):
    nodes = spark.createDataFrame([("f1", 0, "p.ets", 20), ("f2", 0, "p.ets", 45)], "flow_id string, ord int, path string, line int")
    pages = spark.createDataFrame([("a", "p.ets", 3, 3, 39, 12, 30, False), ("b", "p.ets", 40, 40, 60, 42, 50, False)], "page_id string, path string, line int, start int, stop int, build_start int, build_stop int, is_root boolean")
    scores = features.page_scores(nodes.withColumn("base", F.lit(0)), pages)
    assert sorted((r.flow_id, r.page_id, r.score) for r in scores.collect()) == [("f1", "a", -3), ("f1", "b", 20), ("f2", "a", 42), ("f2", "b", -15)]
    ui = spark.createDataFrame([("f", 10, "Button", "Button"), ("f", 14, "TextInput", "Input"), ("f", 14, "Text", "Display"), ("f", 30, "X", "Component")], "path string, line int, component string, category string")
    at = spark.createDataFrame([("f", 16), ("f", 35), ("f", 9), ("f", 300)], "path string, line int")
    assert sorted((r.line, r.element, r.score) for r in analysis.nearest_element(at, ui).collect()) == [(16, "TextInput", 4), (35, "X", 9)]
    kept, dropped, missing = analysis.reconcile(*[spark.createDataFrame([(x,) for x in v], "permission string") for v in (["I", "C"], ["I"], ["I", "R"], ["I"])])
    assert [tuple(r) for r in kept.select("permission", "mode").collect()] == [("I", "dynamic")]
    assert [r[0] for r in dropped.collect()] == ["R"]
    assert [r[0] for r in missing.collect()] == ["C"]


def test_stream_of_job_events(spark, tmp_path):
    from quarry.streaming import jobs

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"job_id":"j","ts":"2026-01-01T00:00:00","stage":0,"state":"running"}\n{"job_id":"j","ts":"2026-01-01T00:10:00","stage":14,"state":"done"}\n{"job_id":"k","ts":"2026-01-02T00:00:00","stage":7,"state":"running"}\n')
    q = jobs.snapshots(jobs.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("snaps").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.job_id, r.percent, r.state) for r in spark.table("snaps").collect()] == [("j", 100, "done")]
    batch = spark.createDataFrame([("a", "2026-01-01 00:10:00"), ("a", "2026-01-01 00:20:00")], "k string, t string").withColumn("ts", F.to_timestamp("t"))
    assert jobs.counts(batch, "k").first().n == 2
