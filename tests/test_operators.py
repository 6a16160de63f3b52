import random

from pyspark.sql import functions as F

from quarry.operators import frames, graphs, hooks, lookups


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def cyclic(spark):
    return spark.createDataFrame([tuple(x) for x in ("sa", "sb", "ac", "bc", "ck", "ca", "bd", "xk")], "src string, dst string")


def names(spark, *n):
    return spark.createDataFrame([(x,) for x in n], "node string")


def test_cyclic_graph(spark):
    e, s, k = cyclic(spark), names(spark, "s"), names(spark, "k")
    assert rows(graphs.reachable(e, s)) == [(x,) for x in "abcdks"]
    assert rows(graphs.reachable(graphs.reversed_edges(e), k)) == [(x,) for x in "abcksx"]
    kept, edges = graphs.trim(e, s, k)
    assert rows(kept) == [(x,) for x in "abcks"]
    assert edges.count() == 6
    assert rows(graphs.hops(graphs.reversed_edges(e), k)) == [("a", 2), ("b", 2), ("c", 1), ("k", 0), ("s", 3), ("x", 1)]
    assert [(r.path_id, "".join(r.path)) for r in graphs.simple_paths(e, s, k).orderBy("path_id").collect()] == [("p1", "sack"), ("p2", "sbck")]
    assert [r.path_id for r in graphs.simple_paths(e, s, k, most=1).collect()] == ["p1"]
    got = {r.node: r.level for r in graphs.levels(names(spark, *"sabcdkx"), e, s).collect()}
    assert got == {"s": 0, "a": 1, "b": 1, "c": 2, "d": 2, "k": 3, "x": 4}
    assert {r.node: "".join(r.path) for r in graphs.shortest_paths(e, s).collect()}["k"] == "sack"


def test_empty_graph(spark):
    e, s = cyclic(spark).limit(0), names(spark, "s")
    assert rows(graphs.reachable(e, s)) == [("s",)]
    assert graphs.simple_paths(e, s, names(spark, "k")).count() == 0


def test_containment(spark):
    blocks = spark.createDataFrame([("f", "outer", 1, 20), ("f", "mid", 5, 15), ("f", "inner", 7, 9)], "file string, name string, start int, end int")
    points = spark.createDataFrame([("f", 8), ("f", 12), ("f", 25)], "file string, line int")
    assert rows(lookups.containing(points, blocks, ["file"], "line", "start", "end").select("line", "name")) == [(8, "inner"), (8, "mid"), (8, "outer"), (12, "mid"), (12, "outer")]
    assert rows(lookups.innermost(points, blocks, ["file"], ["line"], "line", "start", "end").select("line", "name")) == [(8, "inner"), (12, "mid")]


def test_asof_inclusive_and_strict(spark):
    ui = spark.createDataFrame([("f", 10, "Button"), ("f", 14, "Input"), ("f", 30, "Component")], "file string, line int, element string")
    at = spark.createDataFrame([("f", x) for x in (9, 12, 14, 16, 35)], "file string, line int")
    assert rows(lookups.asof(at, ui, ["file"], "line", "element").select("line", F.coalesce("element", F.lit("-")))) == [(9, "-"), (12, "Button"), (14, "Input"), (16, "Input"), (35, "Component")]
    assert dict(rows(lookups.asof(at, ui, ["file"], "line", "element", strict=True).select("line", F.coalesce("element", F.lit("-")))))[14] == "Button"


def test_page_ranges(spark):
    pages = spark.createDataFrame([("f", 3), ("f", 40)], "file string, line int")
    assert rows(lookups.ranges_to_next(pages, ["file"], "line", 60).select("line", "range_end")) == [(3, 39), (40, 60)]


def test_evaluation(spark):
    gt, pred = spark.createDataFrame([("x", c) for c in "ABC"], "app string, p string"), spark.createDataFrame([("x", c) for c in "ACD"], "app string, p string")
    r = frames.evaluate(gt, pred, ["app"], ["p"]).first()
    assert (r.tp, r.fp, r.fn, round(r.recall, 3), round(r.fpr, 3)) == (2, 1, 1, 0.667, 0.333)
    r = frames.evaluate(gt, pred.limit(0), ["app"], ["p"]).first()
    assert (r.recall, r.fpr) == (0.0, None)
    assert frames.evaluate(gt, pred.limit(0), ["app"], ["p"], empty_is_none=False).first().fpr == 0.0
    assert frames.evaluate(gt, pred, ["app"], ["p"], total=True).count() == 2


def test_sets_and_flags(spark):
    practices = spark.createDataFrame([("INTERNET",), ("READ_CONTACTS",)], "permission string")
    known = spark.createDataFrame([("INTERNET",), ("CAMERA",)], "permission string")
    kept, dropped = lookups.split_known(practices, known, ["permission"])
    assert (rows(kept), rows(dropped)) == ([("INTERNET",)], [("READ_CONTACTS",)])
    assert rows(lookups.flag_member(practices, known, ["permission"], "mode", "y", "n")) == [("INTERNET", "y"), ("READ_CONTACTS", "n")]


def test_frames(spark):
    lines = frames.lines_of(spark.createDataFrame([("f", "a\r\nrouter.\npushUrl({ url: 'pages/a' })\nd")], "path string, text string"), ["path"])
    assert rows(frames.context(lines, ["path"], 1).select("line_no", "context"))[0] == (1, "a\nrouter.")
    assert rows(frames.navigation(lines, ["path"])) == [("f", 2, "pushUrl", "pages/a")]
    assert [r.line_no for r in frames.head_tail(lines, ["path"], 3, 1, 1).orderBy("line_no").collect()] == [1, 4]
    assert frames.snippets(lines, spark.createDataFrame([("f", 2)], "path string, anchor int"), ["path"], 1).first().snippet.split("\n")[1] == ">    2: router."
    seq = spark.createDataFrame([(["a", "b"], ["a", "x", "b"]), (["a", "b"], ["b", "a"]), (["a", "b"], ["a", "b", "x"])], "a array<string>, v array<string>")
    assert [r[0] for r in seq.select(frames.ordered_subsequence(F.col("a"), F.col("v"))).collect()] == [True, False, False]


def test_upsert_and_priority(spark):
    base = spark.createDataFrame([(1, "bad"), (2, "x"), (3, None)], "k int, v string")
    extra = spark.createDataFrame([(1, "good"), (3, "c"), (4, "d")], "k int, v string")
    assert rows(lookups.upsert(base, extra, ["k"], "v", F.col("v") == "bad")) == [(1, "good"), (2, "x"), (3, "c"), (4, "d")]
    assert rows(lookups.priority_coalesce(base.select("k"), ["k"], [base, extra], "v", "-")) == [(1, "bad"), (2, "x"), (3, "c")]


def test_hook_falls_back(spark):
    def describe(b):
        raise OSError("no network")

    assert rows(hooks.describe_rows(spark.createDataFrame([(1,)], "k int"), describe, "said", "none", delays=())) == [(1, "none")]


def shuffled_rows(df):
    """The most rows that a join or a generator of the executed plan gave."""
    df.collect()
    seen, most = [df._jdf.queryExecution().executedPlan()], 0
    while seen:
        p = seen.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            seen.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            seen.append(p.plan())
        else:
            if kind.endswith(("JoinExec", "GenerateExec")):
                most = max(most, p.longMetric("numOutputRows").value())
            seen += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_nearest_few_against_brute_force(spark):
    rng = random.Random(5)
    place = lambda: None if rng.random() < 0.1 else rng.randint(0, 15)
    spots = [(k, rng.choice("xy"), place()) for k in range(60)]
    known = [(rng.choice("xyz"), place(), rng.randint(0, 40), rng.randint(0, 2)) for _ in range(90)]
    left = spark.createDataFrame(spots, "k int, name string, at int")
    right = spark.createDataFrame(known, "name string, to int, id int, extra int")
    for most in (1, 4):
        got = lookups.with_near(left, lookups.nearest_few(left, right, ["name"], "at", "to", most, "id", ident="id"), ["name"], "at")
        found = {r.k: [(d.apart, d.id, d.to, d.extra) for d in r.near if d.id != r.k][:most] for r in got.collect()}
        for k, name, at in spots:
            near = [(None if at is None or to is None else abs(at - to), i, to, x) for n, to, i, x in set(known) if n == name and i != k]
            near.sort(key=lambda d: (d[0] is None, d[0] or 0, d[1], d[3] if d[2] is None else -1))
            assert [d[:2] for d in found[k]] == [d[:2] for d in near[:most]]
    assert lookups.nearest_few(left, right.limit(0), ["name"], "at", "to", 2, "id").count() == 0


def test_a_common_name_is_not_paired_out(spark):
    n = 1500
    df = spark.range(n).select("id", F.lit("x").alias("name"), F.lit("p").alias("place"), (F.col("id") % 7).cast("int").alias("at"))
    defs = df.select("name", F.col("id").alias("def_id"), F.col("place").alias("to_place"), F.col("at").alias("to_at"))
    got = lookups.resolve_by_name(df.withColumnRenamed("id", "call_id"), defs, "name", ["call_id"], ("place", "to_place"), ("at", "to_at"), "def_id", itself=("call_id", "def_id"))
    assert shuffled_rows(got) <= 4 * n
    assert {(r.call_id, r.def_id) for r in got.collect()} == {(k, k % 7 if k >= 7 else k + 7) for k in range(n)}
