"""Kit imports, the lexer and the run store: a whole run is written, found again and evaluated."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.functions import scanners
from quarry.functions.lexer import Tokens
from quarry.plans import analysis, run
from quarry.sources import files, store

APP = """import { router, audio as sound } from '@kit.ArkUI';
/* import { lost } from '@kit.ArkUI'; */
import lost from '@ohos.lost';

@Entry
@Component
struct Index {
  build() {
    Button('go').onClick(() => {
      this.open();
    })
  }
  open() {
    router.pushUrl({ url: 'pages/Next' });
    const player = (await sound.create()) as Player;
    player.start();
    lost.find();
  }
}
"""
KIT = """import router from '@ohos.router';
import { audio } from '@ohos.multimedia.audio';
// export { lost } from '@ohos.nowhere';
/* export { audio as router } */
export { router, audio };
export { default as sensor, thing as other } from '@ohos.sensor';
"""
ROUTER = "/**\n * Opens pages.\n * @permission ohos.permission.INTERNET\n */\ndeclare namespace router {\n  /** Navigates to a specified page. */\n  function pushUrl(o: Options): void;\n}\nexport default router;\n"
AUDIO = "declare namespace audio {\n  function create(): Promise<Player>;\n  interface Player {\n    /**\n     * Plays.\n     * @permission ohos.permission.MICROPHONE\n     */\n    start(): void;\n  }\n}\nexport { audio };\n"
SDK = [("sdk/@kit.ArkUI.d.ts", KIT), ("sdk/old/@kit.ArkUI.d.ets", "export { x as router } from '@ohos.wrong';"), ("sdk/@ohos.router.d.ts", ROUTER), ("sdk/@ohos.multimedia.audio.d.ts", AUDIO)]


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_kit_imports_in_a_whole_run(spark):
    sdk = analysis.scan_sdk(table(spark, SDK))
    kits = {r.exported: (r.module, r.kind, r.imported) for r in sdk["kit_exports"].collect()}
    assert kits == {"router": ("@ohos.router", "default", "default"), "audio": ("@ohos.multimedia.audio", "named", "audio"), "sensor": ("@ohos.sensor", "default", "default"), "other": ("@ohos.sensor", "named", "thing")}
    got = run.run(table(spark, [("app/src/main/ets/pages/Index.ets", APP)]), table(spark, SDK))
    sinks = {r.api_key: r for r in got.sinks.collect()}
    assert set(sinks) == {"@ohos.router.pushUrl", "@ohos.multimedia.audio.audio.create", "@ohos.multimedia.audio.Player.start", "@ohos.lost.lost.find"}
    first = sinks["@ohos.router.pushUrl"]
    assert (first.import_line, first.import_code, first.description) == (1, "import { router, audio as sound } from '@kit.ArkUI';", "Navigates to a specified page.")


def test_a_run_is_written_registered_and_evaluated(spark, tmp_path, capsys):
    app = tmp_path / "in/Demo/src/main/ets/pages"
    app.mkdir(parents=True)
    (app / "Index.ets").write_text(APP + "// ohos.permission.CAMERA\n")
    for name, text in SDK:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "k").mkdir()
    (tmp_path / "k/a.csv").write_text("敏感行为,行为子项,相关API,相关权限,敏感数据项,敏感数据子项\n播放,,@ohos.multimedia.audio.Player.start,ohos.permission.MICROPHONE,,\n")
    out = tmp_path / "out"
    common = ["analyse", "--app", str(tmp_path / "in/Demo"), "--sdk", str(tmp_path / "sdk"), "--csv", str(tmp_path / "k"), "--out", str(out), "--stamp"]
    run.main([*common, "20260101-000000"], spark)
    said = json.loads(capsys.readouterr().out)
    assert said == {"runId": "Demo_20260101-000000", "out": f"{out}/Demo/20260101-000000"}
    folder = Path(said["out"])
    made = {str(p.relative_to(folder)): p for p in folder.rglob("*") if p.is_file()}
    read = {k: json.loads(p.read_text(encoding="utf-8")) for k, p in made.items() if k.endswith(".json")}
    assert {"meta.json", "sinks.json", "sources.json", "callgraph.json", "dataflows.json", "ui_tree.json", "privacy_report.json", "pages/index.json", "pages/Index/ui_tree.json", "pages/Index/features/index.json", "app_permissions/privacy_facts.json"} <= set(read)
    assert read["meta.json"]["counts"]["sinks"] == len(read["sinks.json"]) == 4
    assert read["meta.json"]["scan"] == {"appFiles": 1}
    assert read["callgraph.json"]["meta"]["counts"]["edges"] == len(read["callgraph.json"]["edges"]) > 0
    [feature] = read["pages/Index/features/index.json"]["features"]
    own = read[f"pages/Index/features/{feature['featureId']}/privacy_facts.json"]["facts"]
    assert [p["permissionName"] for p in own["permissionPractices"]] == ["ohos.permission.MICROPHONE"]
    assert own["permissionPractices"][0]["refs"][0].keys() == {"flowId", "nodeId"}
    assert [p["permissionName"] for p in read["app_permissions/privacy_facts.json"]["facts"]["permissionPractices"]] == ["ohos.permission.CAMERA"]
    assert {f["flowId"] for f in read["dataflows.json"]["flows"]} == {f["flowId"] for f in read[f"pages/Index/features/{feature['featureId']}/dataflows.json"]["flows"]}
    assert read["ui_tree.json"]["roots"] and made["sinks.csv"].read_text(encoding="utf-8").startswith("﻿App源码文件路径,导入行号")
    assert {r.api_key for r in files.sink_records(spark, str(made["sinks.json"])).where("valid").collect()} == {s["__apiKey"] for s in read["sinks.json"]}

    # the registry knows it, and what is evaluated is the latest run of each app
    assert json.loads((out / "_runs/latest.json").read_text())["runId"] == said["runId"]
    assert files.resolve_run(files.run_registry(spark, str(out / "_runs"))) == said["out"]
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt/Demo.txt").write_text("ohos.permission.CAMERA\nohos.permission.MICROPHONE\nohos.permission.GONE\n")
    run.main(["evaluate", "--groundtruth", str(tmp_path / "gt"), "--runs", str(out), "--format", "json"], spark)
    got = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(r["app"], r["gt"], r["pred"], r["tp"], r["fp"], r["fn"]) for r in got if r["app"]] == [("Demo", 3, 2, 2, 0, 1)]

    # a run of the same name is an error and changes nothing
    before = {p: p.read_bytes() for p in out.rglob("*") if p.is_file()}
    with pytest.raises(Exception, match="20260101-000000"):
        run.main([*common, "20260101-000000"], spark)
    assert {p: p.read_bytes() for p in out.rglob("*") if p.is_file()} == before


def test_a_failing_run_leaves_nothing(spark, tmp_path):
    whole = [("a.json", 0, "", None, "["), ("a.json", 1, "2", ",", "2"), ("a.json", 1, "1", ",", "1"), ("a.json", 2, "", None, "]"), ("b/c.txt", 0, "", None, "é")]
    good = spark.createDataFrame(whole, store.PIECES).repartition(5)
    bad = good.withColumn("text", F.when(F.col("file") == "b/c.txt", F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    path, registry = str(tmp_path / "app/r1"), str(tmp_path / "_runs")
    with pytest.raises(Exception, match="broken"):
        store.write_pieces(bad, path, registry, "app_r1")
    with pytest.raises(Exception, match="no name"):
        store.write_pieces(good.withColumn("file", F.lit("../x")), path, registry, "app_r1")
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    store.write_pieces(good, path, registry, "app_r1")
    assert (tmp_path / "app/r1/a.json").read_text() == "[1,2]"
    assert (tmp_path / "app/r1/b/c.txt").read_text(encoding="utf-8") == "é"
    store.write_pieces(good, str(tmp_path / "app/r2"), registry, "app_r2")
    assert sorted(p.name for p in (tmp_path / "_runs").iterdir()) == ["app_r1.json", "app_r2.json", "latest.json"]
    assert json.loads((tmp_path / "_runs/latest.json").read_text())["runId"] == "app_r2"
    assert sorted(p.name for p in (tmp_path / "app").iterdir()) == ["r1", "r2"]


def test_lexer_modes():
    t = Tokens("a = `x ${ f(`y ${g(1)} }`) } // z` + /re\\/[/]/.test('}') / 2; /* '( */ b('(') // ${\nc")
    assert [v for k, v in zip(t.kind, t.value) if k in "rst"] == ["`y ${g(1)} }`", "`x ${ f(`y ${g(1)} }`) } // z`", "/re\\/[/]/", "'}'", "'('"]
    assert [t.text[a:b] for a, b in t.comments] == ["/* '( */", "// ${"]
    assert sorted((t.value[o], t.value[c]) for o, c in t.close.items()) == [("${", "}"), ("${", "}"), ("(", ")"), ("(", ")"), ("(", ")"), ("(", ")")]
    assert [len(Tokens(x)) for x in ("", "`", "'", "/*", "`${", "}", "a'b\nc")] == [0, 1, 1, 0, 1, 1, 3]


def test_commented_code_is_no_fact():
    text = "/*\nimport a from '@ohos.a';\nexport { a };\n*/\n// export { b }\nimport c from '@ohos.c'; import { d as e } from '@ohos.d'\nexport { c };\nconst s = `import x from 'y'\nexport { s }`;\nf(/'/, \"h()\");\n"
    assert [(x[0], x[3], x[5]) for x in scanners.imports(text)] == [("@ohos.c", "c", "import c from '@ohos.c';"), ("@ohos.d", "e", "import { d as e } from '@ohos.d'")]
    assert [x[:3] for x in scanners.exports(text)] == [("c", "c", None)]
    assert [x[6] for x in scanners.calls(text)] == ["f"]


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("const x: Foo<Bar> = (await mk.create()) as T;", [("mk.create", "x", True)]),
        ("z = <T>mk.make();", [("mk.make", "z", False)]),
        ("this.z = mk.make();", [("mk.make", None, False)]),
        ("const y = mk.create().go();", [("mk.create", None, False), ("mk.create().go", "y", True)]),
        ("(await mk.create()).m(); (q as W).n(); w!.go?.(3)", [("mk.create", None, False), ("mk.create().m", None, False), ("q.n", None, False), ("w.go", None, False)]),
        ("k = mk.n() + 1", [("mk.n", None, False)]),
        ("let a = mk.b()\nlet c = mk.d()", [("mk.b", "a", True), ("mk.d", "c", True)]),
        ("x.on(async (e) => { e.f() })", [("x.on", None, False), ("e.f", None, False)]),
    ],
)
def test_calls_and_what_they_are_set_to(code, want):
    assert sorted(((c[5], c[8], c[9]) for c in scanners.calls(code)), key=str) == sorted(want, key=str)


def test_many_calls_take_time_in_proportion():
    text = "function f() {\n" + "".join(f"  const v{i} = m.go({i}).then(() => {{ x{i}(); }}).done();\n" for i in range(6000)) + "}\n"
    start = time.process_time()
    assert sum(1 for _ in scanners.calls(text)) == 24_000
    assert time.process_time() - start < 6


def test_a_run_over_a_property_graph(spark, tmp_path):
    app = tmp_path / "in/Demo/src/main/ets/pages"
    app.mkdir(parents=True)
    (app / "Index.ets").write_text(APP)
    place = {"artifact": f"file://{app}/Index.ets"}
    node = lambda i, label, line, end, name: {"id": i, "labels": [label], "properties": {**place, "startLine": line, "endLine": end, "name": name, "code": name}}
    nodes = [node(1, "Function", 8, 12, "build"), node(2, "Call", 10, 10, "open"), node(3, "Function", 13, 18, "open"), node(4, "Call", 14, 14, "pushUrl"), node(5, "Block", 40, 50, "far"), *(node(k, "Block", 8, 8, "near") for k in range(11, 17))]
    edges = [{"type": t, "startNode": a, "endNode": b} for t, a, b in (("EOG", 1, 2), ("INVOKES", 2, 3), ("EOG", 3, 4), ("AST", 4, 5))]
    (tmp_path / "g.json").write_text(json.dumps({"nodes": nodes, "edges": edges}))
    got = run.run(table(spark, [(f"{app}/Index.ets", APP)]), table(spark, SDK), graph=files.read_cpg(spark, str(tmp_path / "g.json"), table(spark, [(f"{app}/Index.ets", APP)]), size=200))
    first = [r for r in got.flow_nodes.orderBy("flow_id", "ord").collect() if r.flow_id == "flow:p1"]
    # the shortest way ends at the function around the sink, which is one of the sink's anchors
    assert [(r.line, r.code.strip()[:20]) for r in first] == [(8, "build() {"), (10, "this.open();"), (14, "router.pushUrl({ url")]
    assert {(r.type, r.line) for r in got.nodes.where("type <> 'sinkCall'").collect()} >= {("source", 8), ("function", 10)}
    assert "@ohos.router.pushUrl" in {r.api_keys for r in got.nodes.collect()}
    with pytest.raises(SystemExit):
        run.arguments(["analyse", "--app", "a", "--out", "b", "--backend", "cpg"])


def test_sinks_are_evaluated(spark, tmp_path, capsys):
    sink = lambda path, line, key: {"App源码文件路径": path, "调用行号": line, "__apiKey": key}
    put = lambda name, rows: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(json.dumps(rows)))
    put("gt/A.json", [sink("a.ets", 1, "@ohos.x"), sink("a.ets", 2, "@ohos.y"), sink("a.ets", 2, "@ohos.y"), sink("", 3, "@ohos.z"), {"调用行号": 4}])
    put("gt/B.json", [sink("b.ets", 1, "@ohos.x")])
    put("out/A/2025/sinks.json", [sink("a.ets", 1, "@ohos.x"), sink("a.ets", 9, "@ohos.y"), sink("a.ets", 7, " ")])
    put("out/A/2024/sinks.json", [sink("a.ets", 2, "@ohos.y")])
    put("out/C/2025/sinks.json", [sink("c.ets", 1, "@ohos.x")])
    put("out/_runs/A_2024.json", {"runId": "A_2024", "outputDir": f"{tmp_path}/out/A/2024"})
    args = ["evaluate", "--what", "sinks", "--groundtruth", str(tmp_path / "gt"), "--runs", str(tmp_path / "out")]
    run.main([*args, "--format", "json", "--details"], spark)
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert sorted((str(r["app"]), r["gt"], r["pred"], r["tp"], r["fp"], r["fn"]) for r in said if "gt" in r) == [("A", 2, 2, 1, 1, 1), ("B", 1, 0, 0, 0, 1), ("None", 3, 2, 1, 1, 2)]
    assert sorted((r["app"], r["side"], r.get("call_line")) for r in said if "side" in r) == [("A", "extra", 9), ("A", "invalid", 3), ("A", "invalid", 4), ("A", "invalid", 7), ("A", "missing", 2), ("B", "missing", 1)]
    for more in (["--run-id", "A_2024"], ["--run-dir", f"{tmp_path}/out/A/2024"]):
        run.main([*args, "--app", "A", "--format", "json", *more], spark)
        [one] = [r for r in map(json.loads, capsys.readouterr().out.splitlines()) if r["app"] == "A"]
        assert (one["gt"], one["pred"], one["tp"]) == (2, 1, 1)
    for bad in (["--run-id", "x"], ["--details", "--what", "permissions"]):
        with pytest.raises(SystemExit):
            run.arguments([*args, *bad])
