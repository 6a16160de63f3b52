"""A JSON document read by many tasks equals the whole read, wherever its ranges begin."""

import json
import random

import pytest

from quarry.sources import files, splits


def document(rng, n):
    odd = ['"', "\\", "\\\\", "{", "}", "[", "]", "é像", "\n", '\\"', "x", "a{b", '"nodes": [']
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 9)))
    node = lambda i: {"id": i, "labels": ["Function", "X" + text()], "properties": {"artifact": "file:///app/a.ets", "startLine": i + 1, "endLine": i + 3, "code": text() * rng.choice([1, 1, 30]), "name": f"f{i}"}}
    edge = lambda i: {"type": rng.choice(["AST", "DFG", "ODD"]), "startNode": i, "endNode": rng.randrange(n)}
    return {"info": {"a": [1, {"b": 2}], "nodes": [{"id": -1}]}, "nodes": [node(i) for i in range(n)], "other": [[1], "x", {"q": [{}]}], "edges": [edge(i) for i in range(n)]}


@pytest.mark.parametrize("size", [7, 61, 4096, 1 << 20])
def test_records_of_any_split(spark, tmp_path, size):
    made = document(random.Random(size), 6 if size == 7 else 40)
    path = tmp_path / "g.json"
    path.write_text(json.dumps(made, ensure_ascii=size > 61, indent=None if size == 61 else 1), encoding="utf-8")
    got = splits.json_records(spark, str(path), size)
    want = sorted((k, json.dumps(x, sort_keys=True)) for k, v in made.items() if isinstance(v, list) for x in v if isinstance(x, dict))
    if size == 7:  # some hundred tasks are enough: the states alone, then one range after another here
        got = got.coalesce(4)
    assert sorted((r.list, json.dumps(json.loads(r.record), sort_keys=True)) for r in got.collect()) == want


def test_a_graph_is_read_alike_in_parts(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(document(random.Random(1), 60)), encoding="utf-8")
    own = spark.createDataFrame([("/app/a.ets",)], "path string")
    (n, e), (n2, e2) = files.read_cpg(spark, str(tmp_path / "g.json"), own), files.read_cpg(spark, str(tmp_path / "g.json"), own, size=900)
    assert n.count() == 60 and e.count() > 20
    assert sorted(map(str, n.collect())) == sorted(map(str, n2.collect()))
    assert sorted(map(str, e.collect())) == sorted(map(str, e2.collect()))
    (tmp_path / "cut.json").write_text('{"nodes": [{"id": 1}, {"id": 2', encoding="utf-8")
    assert [r.record for r in splits.json_records(spark, str(tmp_path / "cut.json"), 5).collect()] == ['{"id": 1}']
    (tmp_path / "empty.json").write_text("", encoding="utf-8")
    assert splits.json_records(spark, str(tmp_path / "empty.json")).count() == 0
