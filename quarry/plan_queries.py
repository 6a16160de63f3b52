"""Queries that apply the plans (pages, features, flows, anchors, symbols, reports) to the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import frames, graphs
from quarry.plans import cpg, features, flows, report, symbols, ui
from quarry.queries import _BLANK, SPARSE, _sql, big, micros, nodes, query, sparse_graph, tab

# --- pages and features ---

_FLOW_NODES = "(select user_id::varchar as flow_id, row_number() over (partition by user_id order by ts, event_id)::int as ord, event_type as path, (event_id % 50)::int as line from events)"
_SOURCES = "(select distinct case p_size % 4 when 0 then 'click' when 1 then 'view' when 2 then 'purchase' else 'error' end as path, (p_partkey % 50)::int as line, case when p_partkey % 3 = 0 then 'build' else p_brand end as function from part)"


def flow_steps(spark, sf_dir):
    e = tab(spark, sf_dir, "events", "user_id", "event_id", "event_type", "ts")
    n = F.row_number().over(features.W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").cast("string").alias("flow_id"), n.alias("ord"), F.col("event_type").alias("path"), (F.col("event_id") % 50).cast("int").alias("line"))


@query(f"select flow_id, s.path, s.line::bigint as line, function from {_FLOW_NODES} n join {_SOURCES} s on n.path = s.path and n.line = s.line qualify row_number() over (partition by flow_id order by ord, function <> 'build', function) = 1")
def flow_source_first(spark, sf_dir):
    p = tab(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand")
    k = F.col("p_size") % 4
    s = p.select(F.when(k == 0, "click").when(k == 1, "view").when(k == 2, "purchase").otherwise("error").alias("path"), (F.col("p_partkey") % 50).cast("int").alias("line"), F.when(F.col("p_partkey") % 3 == 0, "build").otherwise(F.col("p_brand")).alias("function")).distinct()
    got = features.flow_sources(flow_steps(spark, sf_dir), s)
    return got.select("flow_id", "path", big("line").alias("line"), "function")


_PAGES = "(select 'p' || lpad(n_nationkey::varchar, 2, '0') as page_id, n_nationkey % 5 = 0 as is_root, 'f' || n_regionkey as path, n_nationkey * 4 as line, n_nationkey * 4 as start, lead(n_nationkey * 4) over (partition by n_regionkey order by n_nationkey) - 1 as stop, n_nationkey * 4 + 1 as build_start, n_nationkey * 4 + 2 as build_stop from nation)"


def nation_pages(spark, sf_dir):
    n = tab(spark, sf_dir, "nation", F.col("n_nationkey").cast("int").alias("k"), "n_regionkey")
    at = F.col("k") * 4
    stop = F.lead(at).over(features.W.partitionBy("n_regionkey").orderBy("k")) - 1
    return n.select(F.concat(F.lit("p"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("page_id"), (F.col("k") % 5 == 0).alias("is_root"), F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("path"), at.alias("line"), at.alias("start"), stop.alias("stop"), (at + 1).alias("build_start"), (at + 2).alias("build_stop"))


_OWNED = f"""(with n as (select o_custkey::varchar as flow_id, o_orderkey as ord, case o_custkey % 9 when 7 then 'a/EntryAbility/x' when 8 then 'component/y' else 'f' || (o_orderkey % 7) end as path, (o_orderkey % 110)::int as line from orders),
s as (select flow_id, path, line from n qualify row_number() over (partition by flow_id order by ord) = 1),
e as (select flow_id, path, line, 0 as base from s union all select flow_id, path, line, 50 from n where line > 0),
c as (select e.flow_id, p.page_id, base + case when p.line > 0 then least(300, abs(greatest(1, e.line) - p.line)) else 200 end - case when is_root then 5 else 0 end - case when greatest(1, e.line) between build_start and build_stop then 20 when greatest(1, e.line) >= start and (stop is null or greatest(1, e.line) <= stop) then 10 else 0 end as score from e join {_PAGES} p on e.path = p.path)
select s.flow_id, coalesce(b.page_id, case when lower(s.path) like '%entryability/%' then 'AppLifecycle' when s.path like 'component/%' then 'ComponentLogic' end, 'p00') as page_id from s left join (select flow_id, page_id from c qualify row_number() over (partition by flow_id order by score, page_id) = 1) b using (flow_id))"""


def owned_flows(spark, sf_dir):
    o = tab(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    k = F.col("o_custkey") % 9
    path = F.when(k == 7, "a/EntryAbility/x").when(k == 8, "component/y").otherwise(F.concat(F.lit("f"), (F.col("o_orderkey") % 7).cast("string")))
    n = o.select(F.col("o_custkey").cast("string").alias("flow_id"), F.col("o_orderkey").alias("ord"), path.alias("path"), (F.col("o_orderkey") % 110).cast("int").alias("line"))
    first = n.groupBy("flow_id").agg(F.min(F.struct("ord", "path", "line")).alias("s")).select("flow_id", "s.path", "s.line")
    return features.flow_pages(n, first, nation_pages(spark, sf_dir))


@query(f"select * from {_OWNED}")
def flow_page_scores(spark, sf_dir):
    return owned_flows(spark, sf_dir)


@query("select user_id::varchar as page_id, event_type as feature_id, min(case when event_type in ('click', 'view') then 'ui' else 'source' end) as kind, case when min(event_type) in ('click', 'view') then arg_min(event_id % 97, (event_id % 97) * 10000000 + event_id) else arg_min(event_id % 97, event_id) end::bigint as anchor_line, arg_min('t' || event_id % 3, event_id) as title, count(*)::bigint as n_flows, sum(event_id % 5)::bigint as n_nodes, sum(event_id % 4)::bigint as n_edges, count(case when event_id % 10 = 0 then 1 end)::bigint as n_fallback, string_agg(distinct 'w' || event_id % 2, ',' order by 'w' || event_id % 2) as warnings from events group by user_id, event_type")
def feature_merge(spark, sf_dir):
    e = tab(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    i = F.col("event_id")
    flow = F.lpad(i.cast("string"), 12, "0")
    per = e.select(flow.alias("flow_id"), F.col("user_id").cast("string").alias("page_id"), F.col("event_type").alias("feature_id"), F.when(F.col("event_type").isin("click", "view"), "ui").otherwise("source").alias("kind"), F.concat(F.lit("t"), (i % 3).cast("string")).alias("title"), F.struct((i % 97).cast("int").alias("line"), F.lit("f").alias("path")).alias("anchor"))
    counts = e.select(flow.alias("flow_id"), (i % 5).alias("n_nodes"), (i % 4).alias("n_edges"), (i % 10 == 0).alias("fallback"), F.array(F.concat(F.lit("w"), (i % 2).cast("string"))).alias("warnings"))
    got = features.feature_index(per, counts)
    return got.select("page_id", "feature_id", "kind", big("anchor.line").alias("anchor_line"), "title", "n_flows", "n_nodes", "n_edges", "n_fallback", F.array_join("warnings", ",").alias("warnings"))


@query("with f as (select c_nationkey as p, c_mktsegment as f, count(*) as n from customer where c_nationkey % 3 > 0 group by all) select case when grouping(n_nationkey) = 0 then n_nationkey::varchar end as page_id, count(f)::bigint as n_features, coalesce(sum(n), 0)::bigint as n_flows from nation left join f on p = n_nationkey group by grouping sets ((n_nationkey), ())")
def page_totals(spark, sf_dir):
    pages = tab(spark, sf_dir, "nation", F.col("n_nationkey").cast("string").alias("page_id"))
    c = tab(spark, sf_dir, "customer", F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("feature_id")).where("k % 3 > 0")
    per = c.groupBy(F.col("k").cast("string").alias("page_id"), "feature_id").agg(F.count(F.lit(1)).alias("n_flows"))
    return features.page_index(pages, per)


@query(f"with recursive {SPARSE}, n as (select n_regionkey::varchar as page_id, n_nationkey::bigint as id from nation union select 'all', n_nationkey from nation where n_nationkey < 12) select a.page_id, e.src, e.dst from edges e join n a on a.id = e.src join n b on b.id = e.dst and b.page_id = a.page_id")
def page_subtree(spark, sf_dir):
    n = tab(spark, sf_dir, "nation", F.col("n_regionkey").cast("string").alias("page_id"), F.col("n_nationkey").cast("long").alias("id"))
    elements = n.unionByName(n.where("id < 12").select(F.lit("all").alias("page_id"), "id"))
    pages = n.select("page_id", F.lit(None).cast("long").alias("root_id")).distinct()
    return features.page_tree(pages, elements, sparse_graph(spark, sf_dir).withColumn("kind", F.lit("contains")))[1].select("page_id", "src", "dst")


# --- flows ---

_LINE = f"regexp_replace(regexp_replace(string_split(text, chr(10))[n * 2 + 1], '^{_BLANK}', ''), '{_BLANK}$', '')"


@query(f"select 'flow:d' || doc_id as flow_id, 'd' || doc_id || ':n' || (n + 1) as node_id, coalesce({_LINE}, '') as code, case n when 0 then '数据流起点：start' when 1 then '中间调用节点：' || 'x' || doc_id || ':3' else 'call ' || doc_id end || '（LLM 失败，使用锚点回退）' as description from (select distinct doc_id, text from documents where doc_id is not null and text is not null), (select unnest([0, 1, 2]) as n)")
def fallback_flow(spark, sf_dir):
    d = tab(spark, sf_dir, "documents", "doc_id", "text").where("doc_id is not null and text is not null").distinct()
    lines = frames.lines_of(d.select(F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("path"), "text"), ["path"])
    n = F.col("n")
    made = d.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n"))
    anchors = made.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path_id"), n.alias("ord"), F.when(n == 0, "source").when(n == 1, "function").otherwise("sinkCall").alias("type"), F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("path"), (n * 2 + 1).alias("line"), F.when(n == 0, "start").alias("name"), F.lit(None).cast("string").alias("code"), F.when(n == 2, F.concat(F.lit("call "), F.col("doc_id").cast("string"))).alias("description"))
    return flows.fallback_flows(anchors, lines)[0].select("flow_id", "node_id", "code", "description")


@query("select 'flow:d' || doc_id as flow_id, 'd' || doc_id || ':n' || n as src, 'd' || doc_id || ':n' || (n + 1) as dst from (select distinct doc_id from documents where doc_id is not null), (select unnest([1, 2]) as n)")
def fallback_edges(spark, sf_dir):
    d = tab(spark, sf_dir, "documents", "doc_id").where("doc_id is not null").distinct()
    nodes_ = d.select(F.concat(F.lit("flow:d"), F.col("doc_id").cast("string")).alias("flow_id"), F.explode(F.array(*[F.lit(x) for x in (1, 2, 3)])).alias("n")).select("flow_id", "n", F.concat(F.expr("substring(flow_id, 6)"), F.lit(":n"), F.col("n").cast("string")).alias("node"))
    return frames.chained(nodes_, "flow_id", "n", "node")


_REFS = "(select (l_suppkey % 50)::bigint as feature_id, (l_partkey % 10)::bigint as practice, (l_orderkey % 300)::varchar as flow_id, case when l_linenumber = 1 then '' else l_linenumber::varchar end as node_id from lineitem)"
_FEATURE_FLOWS = "(select distinct (o_orderkey % 50)::bigint as feature_id, (case when o_orderkey % 50 < 40 then o_orderkey % 300 else o_orderkey % 50 end)::varchar as flow_id from orders)"


@query(f"with r as {_REFS}, f as {_FEATURE_FLOWS}, n as (select distinct (o_orderkey % 300)::varchar as flow_id, (o_custkey % 4)::varchar as node_id from orders), k as (select distinct r.feature_id, practice, flow_id from r join f using (feature_id, flow_id) where node_id = '' or exists (select 1 from n where n.flow_id = r.flow_id and n.node_id = r.node_id)), s as (select feature_id, min(flow_id) as flow_id from f group by feature_id having count(*) = 1) select * from k union all select d.feature_id, d.practice, s.flow_id from (select distinct feature_id, practice from r) d join s using (feature_id) where not exists (select 1 from k where k.feature_id = d.feature_id and k.practice = d.practice)")
def practice_flow_choice(spark, sf_dir):
    li = tab(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    refs = li.select(big(F.col("l_suppkey") % 50).alias("feature_id"), big(F.col("l_partkey") % 10).alias("practice"), (F.col("l_orderkey") % 300).cast("string").alias("flow_id"), F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_linenumber").cast("string")).alias("node_id"))
    o = tab(spark, sf_dir, "orders", big("o_orderkey").alias("k"), "o_custkey")
    own = o.select((F.col("k") % 50).alias("feature_id"), F.when(F.col("k") % 50 < 40, F.col("k") % 300).otherwise(F.col("k") % 50).cast("string").alias("flow_id")).distinct()
    known = o.select((F.col("k") % 300).cast("string").alias("flow_id"), (F.col("o_custkey") % 4).cast("string").alias("node_id")).distinct()
    return flows.practice_flows(refs, own, known)


_JSON = """case page_id % 3 when 0 then 'noise ' else '' end || '{"nodes":[{"filePath":"a","line":' || page_id || '.7,"description":"d"},{"filePath":"","line":1,"description":"d"},{"filePath":"b","line":"' || case page_id % 2 when 0 then 'x' else '12' end || '","description":"' || case page_id % 5 when 0 then '' else 'e' end || '"}],"edges":[{"from":0,"to":"1"},{"from":"q","to":1}]}' || case page_id % 3 when 0 then ' tail' else '' end"""


@query(f"with j as (select page_id, regexp_extract({_JSON}, '(?s)\\{{.*\\}}')::json as j from pages where page_id is not null), n as (select page_id, unnest(from_json(j->'nodes', '[\"JSON\"]')) as x from j), e as (select page_id, unnest(from_json(j->'edges', '[\"JSON\"]')) as x from j) select page_id, (select count(*) from n where n.page_id = j.page_id and x->>'filePath' <> '' and try_cast(x->>'line' as double) is not null and x->>'description' <> '')::bigint as n_nodes, (select coalesce(sum(floor(try_cast(x->>'line' as double))), 0) from n where n.page_id = j.page_id and x->>'filePath' <> '' and x->>'description' <> '')::bigint as lines, (select count(*) from e where e.page_id = j.page_id and try_cast(x->>'from' as double) is not null and try_cast(x->>'to' as double) is not null)::bigint as n_edges from j")
def json_shape(spark, sf_dir):
    p = tab(spark, sf_dir, "pages", "page_id").where("page_id is not null")
    k = F.col("page_id")
    text = F.concat(F.when(k % 3 == 0, "noise ").otherwise(""), F.lit('{"nodes":[{"filePath":"a","line":'), k.cast("string"), F.lit('.7,"description":"d"},{"filePath":"","line":1,"description":"d"},{"filePath":"b","line":"'), F.when(k % 2 == 0, "x").otherwise("12"), F.lit('","description":"'), F.when(k % 5 == 0, "").otherwise("e"), F.lit('"}],"edges":[{"from":0,"to":"1"},{"from":"q","to":1}]}'), F.when(k % 3 == 0, " tail").otherwise(""))
    got = flows.answers(p.select(k.alias("path_id"), text.alias("answer")))
    return got.select(F.col("path_id").alias("page_id"), big(F.size("nodes")).alias("n_nodes"), big(F.aggregate("nodes", F.lit(0), lambda s, x: s + x.line)).alias("lines"), big(F.size("edges")).alias("n_edges"))


# --- anchors and paths ---

_CPG = "(select p_partkey::bigint as id, case p_size % 4 when 0 then ['Function'] when 1 then ['Call'] when 2 then ['Block'] else ['Other'] end as labels, p_brand as path, (p_size * 3)::int as line, (p_size * 3 + 4)::int as end_line, split_part(p_name, ' ', 1) as name from part)"


def part_nodes(spark, sf_dir):
    p = tab(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand", "p_name")
    k = F.col("p_size") % 4
    label = F.when(k == 0, "Function").when(k == 1, "Call").when(k == 2, "Block").otherwise("Other")
    return p.select(big("p_partkey").alias("id"), F.array(label).alias("labels"), F.col("p_brand").alias("path"), (F.col("p_size") * 3).cast("int").alias("line"), (F.col("p_size") * 3 + 4).cast("int").alias("end_line"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"))


_RANK = "case labels[1] when 'Function' then 0 when 'Block' then 1 when 'Call' then 2 else 5 end"
_SCORED = f"(select s.path, s.line as spot, s.function, n.id, n.line - s.line as d, labels[1] as label, n.name, case when n.name = s.function then 0 else 100 end + 2 * abs(n.line - s.line) + {_RANK} as score, row_number() over (partition by s.path, s.line, s.function order by n.line, n.end_line, n.id) as place from (select distinct 'Brand#' || (11 + s_suppkey % 5 + 10 * (s_suppkey % 4)) as path, (s_suppkey % 150)::int as line, case s_suppkey % 3 when 0 then 'green' when 1 then 'red' else 'small' end as function from supplier) s join {_CPG} n on n.path = s.path)"


def supplier_spots(spark, sf_dir):
    s, k = tab(spark, sf_dir, "supplier", "s_suppkey"), F.col("s_suppkey")
    return s.select(F.concat(F.lit("Brand#"), (11 + k % 5 + 10 * (k % 4)).cast("string")).alias("path"), (k % 150).cast("int").alias("line"), F.when(k % 3 == 0, "green").when(k % 3 == 1, "red").otherwise("small").alias("function")).distinct()


@query(f"with c as {_SCORED}, t as (select *, 0 as tier from c where label = 'Function' and name = function and d = 0 union all select *, 1 from c where label = 'Function' and name = function and abs(d) <= 3 union all select *, 2 from c where d between -2 and 40 union all select *, 3 from c where place <= 200), o as (select path, spot, function, id, min(tier * 100000 + score) as k from t group by all) select path, spot::bigint as line, function, id, row_number() over (partition by path, spot, function order by k, id)::bigint as rank from o qualify rank <= 6")
def source_anchor_ranks(spark, sf_dir):
    got = cpg.source_anchors(part_nodes(spark, sf_dir), supplier_spots(spark, sf_dir))
    return got.select("path", big("line").alias("line"), "function", "id", big("rank").alias("rank"))


@query(f"with c as (select distinct s.path, s.line as spot, n.id, n.line - s.line as d, n.line as l, n.end_line as e, labels[1] as label, 100 + 2 * abs(n.line - s.line) + {_RANK} as score from (select distinct 'Brand#' || (11 + s_suppkey % 5 + 10 * (s_suppkey % 4)) as path, (s_suppkey % 150)::int as line from supplier) s join {_CPG} n on n.path = s.path), t as (select *, 0 as tier from c where label = 'Call' and d = 0 union all select *, 1 from c where label = 'Call' and abs(d) <= 3 union all select *, 2 from c where label = 'Function' and spot between l and e union all select *, 3 from c where abs(d) <= 3), o as (select path, spot, id, min(tier * 100000 + score) as k from t group by all) select path, spot::bigint as line, id, row_number() over (partition by path, spot order by k, id)::bigint as rank from o qualify rank <= 6")
def sink_anchor_ranks(spark, sf_dir):
    got = cpg.sink_anchors(part_nodes(spark, sf_dir), supplier_spots(spark, sf_dir))
    return got.select("path", big("line").alias("line"), "id", big("rank").alias("rank"))


_CODE = "case id % 4 when 0 then 'this.' || name || '()' when 1 then 'q.' || name || ' (x)' when 2 then 'y = ' || name || '(1)' else 'z(this.' || name || ')' end"


@query(f"with n as (select *, {_CODE} as code, case when id % 2 = 0 then 'q.' || name else 'r.' || name end as full_name from {_CPG}), c as (select * from n where labels[1] = 'Call'), f as (select * from n where labels[1] = 'Function'), m as (select c.id as src, f.id as dst, c.path <> f.path as far, abs(f.line - c.line) as d from c join f on f.name = c.name and (case when c.id % 4 = 1 then contains(f.name || ' ' || f.full_name, 'q.' || c.name) else c.path = f.path end)) select src, dst from m qualify row_number() over (partition by src order by far, d, dst) <= 6")
def local_call_targets(spark, sf_dir):
    i, name = F.col("id"), F.col("name")
    code = F.when(i % 4 == 0, F.concat(F.lit("this."), name, F.lit("()"))).when(i % 4 == 1, F.concat(F.lit("q."), name, F.lit(" (x)"))).when(i % 4 == 2, F.concat(F.lit("y = "), name, F.lit("(1)"))).otherwise(F.concat(F.lit("z(this."), name, F.lit(")")))
    n = part_nodes(spark, sf_dir).withColumns({"code": code, "full_name": F.concat(F.when(i % 2 == 0, "q.").otherwise("r."), name)})
    return cpg.local_calls(n)


@query(f"with recursive {SPARSE}, w as (select src, dst, ((src * 3 + dst) % 5)::bigint as priority from edges), d as (select 0::bigint as node, [0]::bigint[] as path, [0]::bigint[] as by_ union all select w.dst, list_append(d.path, w.dst), list_append(d.by_, w.priority) from d join w on w.src = d.node where not list_contains(d.path, w.dst) and len(d.path) < 9) select node, array_to_string(path, '>') as path from d qualify row_number() over (partition by node order by len(path), by_, path) = 1")
def shortest_path_priorities(spark, sf_dir):
    e = sparse_graph(spark, sf_dir).withColumn("priority", (F.col("src") * 3 + F.col("dst")) % 5)
    got = graphs.shortest_paths(e, nodes(spark, 0))
    return got.select("node", F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))


_STEPS = "(select p_partkey as src, (p_partkey * 7 + 3) % (select max(p_partkey) from part) + 1 as dst, ['AST', 'DFG', 'EOG', 'PDG'][1 + p_partkey % 4] as type from part union all select p_partkey, (p_partkey * 5 + 11) % (select max(p_partkey) from part) + 1, 'EOG' from part)"


@query(f"""with recursive a as (select path, line, function, id, rank from ({_sql['source_anchor_ranks']})), b as (select path, line, id, rank from ({_sql['sink_anchor_ranks']})),
  w as (select distinct id as source, id as node, 0 as hops from a union select w.source, e.dst, w.hops + 1 from w join {_STEPS} e on e.src = w.node where w.hops < 5),
  d as (select source, node, min(hops) as hops from w group by all)
  select a.path as source_path, a.line as source_line, a.function, b.path as sink_path, b.line as sink_line, d.hops::bigint as hops, a.id as first_id, b.id as last_id from d join a on a.id = d.source join b on b.id = d.node
  qualify row_number() over (partition by a.path, a.line, a.function, b.path, b.line order by d.hops, a.rank, b.rank) = 1""")
def path_matches(spark, sf_dir):
    n = graphs._cut(part_nodes(spark, sf_dir).withColumns({"code": F.lit(""), "full_name": F.lit("")}))
    p = tab(spark, sf_dir, "part", big("p_partkey").alias("src"))
    top = p.agg(F.max("src").alias("top"))
    p = p.crossJoin(F.broadcast(top))  # one row
    kinds = F.array(*map(F.lit, ("AST", "DFG", "EOG", "PDG")))
    e = p.select("src", ((F.col("src") * 7 + 3) % F.col("top") + 1).alias("dst"), F.element_at(kinds, (F.col("src") % 4 + 1).cast("int")).alias("type"))
    e = e.unionByName(p.select("src", ((F.col("src") * 5 + 11) % F.col("top") + 1).alias("dst"), F.lit("EOG").alias("type")))
    spots = supplier_spots(spark, sf_dir)
    got = cpg.path_matches(n, e, spots, spots.select("path", "line").distinct(), hops=5)
    first, last = F.col("ids")[0], F.element_at("ids", -1)
    return got.select("source_path", big("source_line").alias("source_line"), "function", "sink_path", big("sink_line").alias("sink_line"), (F.size("ids") - 1).cast("long").alias("hops"), first.alias("first_id"), last.alias("last_id"))


# --- symbols, routes, reports ---

_DECLS = "(select 'm' as module, '' as container, r_name as member, 'namespace' as kind, 'about ' || r_name as summary, r_regionkey as line from region union all select 'm', r_name, n_name, 'function', case when n_nationkey % 3 = 0 then '' else 'nation ' || n_name end, 100 + n_nationkey from nation join region on n_regionkey = r_regionkey union all select 'm', '', n_name, 'function', 'top ' || n_name, 200 + n_nationkey from nation where n_nationkey % 6 = 0)"
_WANTED = "(select 'm' as module, case c_custkey % 5 when 0 then r_name || '.' || n_name when 1 then n_name when 2 then r_name || '.NOPE' when 3 then r_name || '.' || n_name || '.x' else 'NOPE' end as symbol from (select distinct c_custkey % 5 as c_custkey, c_nationkey from customer) join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"


@query(f"with d as (select *, case when container = '' then member else container || '.' || member end as full_ from {_DECLS}), w as (select distinct * from {_WANTED}), c as (select symbol, 2 * u as rank, d.full_ as found, d.summary from w, (select unnest([0, 1, 2]) as u) join d on d.full_ = array_to_string(string_split(symbol, '.')[1:len(string_split(symbol, '.')) - u], '.') where u < len(string_split(symbol, '.')) union all select symbol, 1, full_, summary from (select w.symbol, d.full_, d.summary, row_number() over (partition by symbol order by s.line, d.line) as k from w join d on d.member = w.symbol and d.container <> '' join d s on s.member = d.container where not contains(symbol, '.')) where k = 1) select symbol, found, (select arg_min(summary, rank) from c x where x.symbol = c.symbol and summary <> '') as summary from c qualify row_number() over (partition by symbol order by rank) = 1")
def symbol_lookup(spark, sf_dir):
    n, r = tab(spark, sf_dir, "nation", "n_name", "n_nationkey", "n_regionkey"), tab(spark, sf_dir, "region", "r_name", "r_regionkey")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    cells = [F.array().cast("array<string>").alias("permissions"), F.array().cast("array<string>").alias("returns")]
    decl = r.select(F.lit("m").alias("module"), F.lit("").alias("container"), F.col("r_name").alias("member"), F.lit("namespace").alias("kind"), F.concat(F.lit("about "), "r_name").alias("summary"), F.col("r_regionkey").cast("long").alias("line"), *cells)
    decl = decl.unionByName(both.select(F.lit("m").alias("module"), F.col("r_name").alias("container"), F.col("n_name").alias("member"), F.lit("function").alias("kind"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("nation "), "n_name")).alias("summary"), (100 + F.col("n_nationkey")).cast("long").alias("line"), *cells))
    decl = decl.unionByName(n.where("n_nationkey % 6 = 0").select(F.lit("m").alias("module"), F.lit("").alias("container"), F.col("n_name").alias("member"), F.lit("function").alias("kind"), F.concat(F.lit("top "), "n_name").alias("summary"), (200 + F.col("n_nationkey")).cast("long").alias("line"), *cells))
    c = tab(spark, sf_dir, "customer", (F.col("c_custkey") % 5).alias("c"), "c_nationkey").distinct().join(both, F.col("c_nationkey") == F.col("n_nationkey"))
    dot = F.lit(".")
    symbol = F.when(F.col("c") == 0, F.concat("r_name", dot, "n_name")).when(F.col("c") == 1, F.col("n_name")).when(F.col("c") == 2, F.concat("r_name", F.lit(".NOPE"))).when(F.col("c") == 3, F.concat("r_name", dot, "n_name", F.lit(".x"))).otherwise("NOPE")
    got = symbols.resolve(c.select(F.lit("m").alias("module"), symbol.alias("symbol")).distinct(), decl)
    return got.where("found is not null").select("symbol", "found", "summary")


@query("with f as (select page_id, 'app/src/main/ets/pages/p' || page_id % 40 || case when page_id % 2 = 0 then '.ets' else '.ts' end as path from pages), r as (select regexp_replace(regexp_replace(path, '^.*/src/main/ets/', ''), '\\.(ets|ts)$', '') as route, max(path) as target from f group by 1) select page_id, target from (select page_id, 'pages/p' || page_id % 55 as route from pages) join r using (route)")
def route_files(spark, sf_dir):
    p = tab(spark, sf_dir, "pages", "page_id")
    i = F.col("page_id")
    files = p.select(F.concat(F.lit("app/src/main/ets/pages/p"), (i % 40).cast("string"), F.when(i % 2 == 0, ".ets").otherwise(".ts")).alias("path")).distinct()
    navs = p.select("page_id", F.concat(F.lit(" /pages/p"), (i % 55).cast("string"), F.when(i % 3 == 0, ".ets").otherwise("")).alias("url"))
    return ui.route_targets(navs, files).select("page_id", "target")


@query("select p_partkey, coalesce(n_name, p_brand || p_size % 30) as display_name from part left join (select upper('Brand#' || (11 + n_nationkey)) || n_nationkey as key, n_name from nation) on upper(p_brand || p_size % 30) = key")
def display_name_lookup(spark, sf_dir):
    p = tab(spark, sf_dir, "part", "p_partkey", F.concat(F.col("p_brand"), (F.col("p_size") % 30).cast("string")).alias("permission"))
    k = F.col("n_nationkey").cast("string")
    names = tab(spark, sf_dir, "nation", F.concat(F.lit("brand#"), (11 + F.col("n_nationkey")).cast("string"), k).alias("key"), F.col("n_name").alias("label"))
    return report.display_names(p, names).select("p_partkey", "display_name")


@query("select s as section, r_name as feature_id, '在【' || r_name || '】功能点中：隐私声明报告未生成（原因：x）。' as text from region, (select unnest(['collectionAndUse', 'permissions']) as s)")
def placeholder_documents(spark, sf_dir):
    return report.placeholder_report(tab(spark, sf_dir, "region", F.col("r_name").alias("feature_id")), "x").select("section", "feature_id", "text")


@query("select user_id, event_id, count(*) over (partition by user_id) > 12 as cut from events qualify row_number() over (partition by user_id order by ts, event_id) <= 12")
def truncated_lists(spark, sf_dir):
    e = tab(spark, sf_dir, "events", "user_id", "event_id", "ts")
    return report.cut_for_model(e, ["user_id"], ["ts", "event_id"], flows.LIMITS["flows"]).select("user_id", "event_id", "cut")


@query("select c_custkey, name is not null as fit from (select c_custkey, case when c_acctbal >= 1 and c_mktsegment in ('BUILDING', 'MACHINERY') and trim(c_name) <> '' then c_name end as name from customer)")
def row_validation(spark, sf_dir):
    from quarry.sources import files

    c = tab(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    good, bad = files.checked(c, ["c_name"], ["c_acctbal"], {"c_mktsegment": ("BUILDING", "MACHINERY")})
    return good.select("c_custkey", F.lit(True).alias("fit")).unionByName(bad.select("c_custkey", F.lit(False).alias("fit")))


@query("select f.k as feature_id, p.permission, min_by(p.d, (f.flow_id, f.ord)) as first_description, string_agg(distinct f.flow_id || '/' || f.node_id, ',' order by f.flow_id || '/' || f.node_id) as refs from (select l_orderkey::varchar as flow_id, 'n' || l_linenumber as node_id, l_linenumber as ord, l_partkey as line, (l_orderkey % 20)::varchar as k from lineitem) f join (select p_partkey as line, unnest(['P' || p_size % 5, 'Q' || p_size % 3]) as permission, '查看' || p_partkey as d from part) p on p.line = f.line group by 1, 2".replace("min_by(p.d, (f.flow_id, f.ord)) as first_description, ", ""))
def permission_rollup(spark, sf_dir):
    li = tab(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    steps = li.select(F.col("l_orderkey").cast("string").alias("flow_id"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("node_id"), F.col("l_linenumber").alias("ord"), F.lit("f").alias("path"), F.col("l_partkey").alias("line"))
    p = tab(spark, sf_dir, "part", "p_partkey", "p_size")
    sinks = p.select(F.lit("f").alias("path"), F.col("p_partkey").alias("line"), F.col("p_partkey").cast("string").alias("api_key"), F.concat(F.lit("查看"), F.col("p_partkey").cast("string")).alias("description"), F.array(F.concat(F.lit("P"), (F.col("p_size") % 5).cast("string"))).alias("permissions"))
    knowledge = p.select(F.col("p_partkey").cast("string").alias("key"), F.array(F.concat(F.lit("Q"), (F.col("p_size") % 3).cast("string"), F.lit("（可选）"))).alias("permissions"))
    owned = li.select(F.col("l_orderkey").cast("string").alias("flow_id"), F.lit("p").alias("page_id"), (F.col("l_orderkey") % 20).cast("string").alias("feature_id"), F.lit("").alias("title")).distinct()
    got = report.feature_permissions(steps, owned, sinks, knowledge, spark.createDataFrame([("p", "登录页面")], "page_id string, description string"))
    return got.select("feature_id", "permission", F.array_join(F.array_sort(F.transform("refs", lambda r: F.concat_ws("/", r.flow_id, r.node_id))), ",").alias("refs"))


@query("select user_id, epoch_us(ts) // 3600000000 as hour, string_agg(distinct event_type, ',' order by event_type) as kinds, count(*)::bigint as n from events group by user_id, hour")
def hourly_kinds(spark, sf_dir):
    e = tab(spark, sf_dir, "events", "user_id", "event_type", micros().alias("t")).withColumn("hour", F.expr("t div 3600000000"))
    kinds = frames.rolled_sets(e, ["user_id", "hour"], "event_type", "kinds").withColumn("kinds", F.array_join("kinds", ","))
    return kinds.join(e.groupBy("user_id", "hour").agg(F.count(F.lit(1)).alias("n")), ["user_id", "hour"])


@query("select page_id, length(title) as n from (select page_id, case when page_id % 2 = 0 then ' “去 (登录)。” ' else '功 能' end as t, case when page_id % 2 = 0 then '去（登录）' else '功能' end as title from pages)".replace("length(title) as n", "title"))
def short_titles(spark, sf_dir):
    p = tab(spark, sf_dir, "pages", "page_id")
    return p.select("page_id", T.short_title(F.when(F.col("page_id") % 2 == 0, " “去 (登录)。” ").otherwise("功 能")).alias("title"))


@query("select page_id, case page_id % 6 when 0 then '步数目标' when 1 then '当前 位置' when 2 then '位置 信息' when 3 then 'plain (text)' when 4 then '页面构建入口' else '未识别' end as said, case when page_id % 2 = 0 then 'b' else 'app' end as name from pages where page_id is not null")
def user_texts(spark, sf_dir):
    k = F.col("page_id") % 6
    told = F.when(k == 0, "this.stepGoal").when(k == 1, "x.y（当前 位置）").when(k == 2, "位置 (GPS data) 信息").when(k == 3, "plain (text)").when(k == 4, " Build ").otherwise("未识别")
    return tab(spark, sf_dir, "pages", "page_id").where("page_id is not null").select("page_id", T.user_text(told).alias("said"), T.app_name(F.when(F.col("page_id") % 2 == 0, "/a/b//").otherwise("/")).alias("name"))
