"""Queries that apply the operators to the driver's tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import frames, graphs, lookups, needles
from quarry.plans import analysis
from quarry.sources import files

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is any."""

    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    from quarry import plan_queries  # noqa: F401: registers its queries here

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)


def tab(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def micros() -> Column:
    """Microseconds since 1970 of ``ts``, whatever the session's time zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")


def sparse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph over nations: n to (7n+3) mod 25 and to (3n+1) mod 25."""
    n = tab(spark, sf_dir, "nation", F.col("n_nationkey").cast("long").alias("src"))
    to = F.explode(F.array((7 * F.col("src") + 3) % 25, (3 * F.col("src") + 1) % 25))
    return n.select("src", to.alias("dst")).where("src <> dst").distinct()


def nodes(spark: SparkSession, *keys: int) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "node long")


SPARSE = """edges as (select distinct src, dst from (select n_nationkey::bigint as src, unnest([(7*n_nationkey+3)%25, (3*n_nationkey+1)%25])::bigint as dst from nation) where src <> dst)"""
_FORWARD = "fwd as (select 0::bigint as node union select e.dst from fwd join edges e on e.src = fwd.node)"
_BACKWARD = "bwd as (select unnest([20,24])::bigint as node union select e.src from bwd join edges e on e.dst = bwd.node)"


# --- graphs ---


@query(f"with recursive {SPARSE}, {_FORWARD} select node from fwd")
def reach_forward(spark, sf_dir):
    return graphs.reachable(sparse_graph(spark, sf_dir), nodes(spark, 0))


@query(f"with recursive {SPARSE}, {_BACKWARD} select node from bwd")
def reach_backward(spark, sf_dir):
    return graphs.reachable(graphs.reversed_edges(sparse_graph(spark, sf_dir)), nodes(spark, 20, 24))


@query(f"with recursive {SPARSE}, {_FORWARD}, {_BACKWARD}, kept as (select node from fwd intersect select node from bwd) select src, dst from edges where src in (select node from kept) and dst in (select node from kept)")
def graph_trim(spark, sf_dir):
    return graphs.trim(sparse_graph(spark, sf_dir), nodes(spark, 0), nodes(spark, 20, 24))[1]


@query(f"with recursive {SPARSE}, d as (select unnest([20,24])::bigint as node, 0 as hops union select e.src, d.hops + 1 from d join edges e on e.dst = d.node where d.hops < 30) select node, min(hops)::bigint as hops from d group by node")
def bfs_distance(spark, sf_dir):
    return graphs.hops(graphs.reversed_edges(sparse_graph(spark, sf_dir)), nodes(spark, 20, 24)).select("node", big("hops").alias("hops"))


_PATHS = f"{SPARSE}, p as (select [0]::bigint[] as path, 0::bigint as last union all select list_append(p.path, e.dst), e.dst from p join edges e on e.src = p.last where not list_contains(p.path, e.dst) and p.last not in (20, 24))"


@query(f"with recursive {_PATHS} select array_to_string(path, '>') as path, len(path)::bigint as n_nodes, last as sink from p where last in (20, 24)")
def simple_paths(spark, sf_dir):
    got = graphs.simple_paths(sparse_graph(spark, sf_dir), nodes(spark, 0), nodes(spark, 20, 24))
    return got.select(F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"), big(F.size("path")).alias("n_nodes"), "sink")


@query(f"with recursive {SPARSE}, d as (select unnest([20,24])::bigint as node, 0 as h union select e.src, d.h + 1 from d join edges e on e.dst = d.node where d.h < 30), dist as (select node, min(h) as h from d group by node), p as (select [0]::bigint[] as path, [[0,0]]::bigint[][] as k, 0::bigint as last union all select list_append(p.path, e.dst), list_append(p.k, [t.h, e.dst]::bigint[]), e.dst from p join edges e on e.src = p.last join dist t on t.node = e.dst where not list_contains(p.path, e.dst) and p.last not in (20, 24)) select 'p' || row_number() over (order by k) as path_id, array_to_string(path, '>') as path from p where last in (20, 24) qualify row_number() over (order by k) <= 10")
def simple_paths_limited(spark, sf_dir):
    got = graphs.simple_paths(sparse_graph(spark, sf_dir), nodes(spark, 0), nodes(spark, 20, 24), most=10)
    return got.select("path_id", F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))


@query(f"with recursive {SPARSE}, d as (select unnest([0, 5])::bigint as source, unnest([0, 5])::bigint as node, 0 as hops union select d.source, e.dst, d.hops + 1 from d join edges e on e.src = d.node where d.hops < 30) select source, node, min(hops)::bigint as hops from d group by source, node")
def shortest_path(spark, sf_dir):
    got = graphs.shortest_paths(sparse_graph(spark, sf_dir), nodes(spark, 0, 5))
    return got.select("source", "node", big("hops").alias("hops"))


@query(f"with recursive {SPARSE}, d as (select 0::bigint as node, 0 as h union select e.dst, d.h + 1 from d join edges e on e.src = d.node where d.h < 30), l as (select node, min(h) as h from d group by node), n as (select n_nationkey::bigint as node from nation), o as (select n.node, coalesce(l.h, (select max(h) from l) + 1)::bigint as level, (select count(*) from edges e where e.dst = n.node)::bigint as indegree from n left join l using (node)) select *, (row_number() over (partition by level order by node) - 1)::bigint as row from o")
def levels_indegree(spark, sf_dir):
    all_nodes = tab(spark, sf_dir, "nation", F.col("n_nationkey").cast("long").alias("node"))
    got = graphs.levels(all_nodes, sparse_graph(spark, sf_dir), nodes(spark, 0))
    return got.select("node", big("level").alias("level"), "indegree", big("row").alias("row"))


@query(f"with l as ({_sql['levels_indegree']}), c as (select greatest(640, (max(level) + 1) * 320 + 292)::bigint as width, greatest(320, (max(row) + 1) * 86 + 96)::bigint as height from l) select node, (16 + level * 320)::bigint as x, (16 + row * 86)::bigint as y, (16 + row * 320)::bigint as x_down, (16 + level * 86)::bigint as y_down, width, height from l, c")
def graph_layout(spark, sf_dir):
    all_nodes = tab(spark, sf_dir, "nation", F.col("n_nationkey").cast("long").alias("node"))
    levelled = graphs._cut(graphs.levels(all_nodes, sparse_graph(spark, sf_dir), nodes(spark, 0)))
    down = graphs.layout(levelled, vertical=True).select("node", big("x").alias("x_down"), big("y").alias("y_down"))
    size = graphs.canvas(levelled).select(big("width").alias("width"), big("height").alias("height"))
    return graphs.layout(levelled).select("node", big("x").alias("x"), big("y").alias("y")).join(down, "node").crossJoin(F.broadcast(size))  # one row


@query("select c_nationkey::bigint as src, s_nationkey::bigint as dst, count(*)::bigint as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2")
def edge_weights(spark, sf_dir):
    li = tab(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey")
    o, c, s = tab(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), tab(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), tab(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    pre = li.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("k"))
    got = pre.join(o, pre.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey)
    return got.groupBy(big("c_nationkey").alias("src"), big("s_nationkey").alias("dst")).agg(F.sum("k").alias("n"))


@query("select distinct c_nationkey::bigint as src, s_nationkey::bigint as dst from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey")
def edge_dedupe(spark, sf_dir):
    return edge_weights(spark, sf_dir).transform(lambda e: graphs.edges_of(e, "src", "dst"))


@query("select distinct event_type as src, nxt as dst from (select event_type, lead(event_type) over (partition by user_id order by ts) as nxt from events) where nxt is not null")
def event_transitions(spark, sf_dir):
    e = tab(spark, sf_dir, "events", "user_id", "ts", "event_type")
    return graphs.edges_of(frames.chained(e, "user_id", "ts", "event_type"), "src", "dst")


# --- scans and text ---


@query(r"""select doc_id, line_no::bigint as line_no, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents) where regexp_matches(line, '^\s*[A-Z][a-z]+ (the|of|and|la|de|und|der) ')""")
def line_entry_scan(spark, sf_dir):
    lines = frames.lines_of(tab(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])
    return lines.where(F.col("line").rlike(r"^\s*[A-Z][a-z]+ (the|of|and|la|de|und|der) ")).select("doc_id", big("line_no").alias("line_no"), "line")


@query(r"""select distinct token from (select unnest(regexp_extract_all(html, 'href="(/[A-Za-z0-9_]+)"', 1)) as token from pages) where token <> ''""")
def token_extract_distinct(spark, sf_dir):
    p = tab(spark, sf_dir, "pages", "html")
    return p.select(F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[A-Za-z0-9_]+)"'), F.lit(1)))).alias("token")).where("token <> ''").distinct()


@query(r"""select doc_id, count(distinct m)::bigint as n_emails from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) as m from documents) group by doc_id""")
def email_tokens(spark, sf_dir):
    d = tab(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", big(F.size(T.extract_tokens(F.col("text"), r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"))).alias("n_emails")).where("n_emails > 0").groupBy("doc_id").agg(F.max("n_emails").alias("n_emails"))


@query(r"""select page_id, regexp_replace(regexp_replace(regexp_replace(split_part(replace(replace(replace(replace(split_part(k, '(', 1), '-->', '.'), '->', '.'), '#', '.'), '"', ''), '://', 1), '\s+', '', 'g'), '\.{2,}', '.', 'g'), '^\.+|\.+$', '', 'g') as api_key from (select page_id, replace(replace(split_part(url, '://', 2), '/', '->'), '?', '(') as k from pages)""")
def api_key_normalize(spark, sf_dir):
    p = tab(spark, sf_dir, "pages", "page_id", "url")
    raw = F.replace(F.replace(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit("->")), F.lit("?"), F.lit("("))
    return p.select("page_id", T.normalize_api_key(raw).alias("api_key"))


@query("select p_partkey, concat_ws('; ', p_brand || ' / ' || p_type, '权限: ' || p_name, '数据: ' || p_size) as description from part")
def csv_style_description(spark, sf_dir):
    p = tab(spark, sf_dir, "part")
    return p.select("p_partkey", T.compose_description(F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.col("p_size").cast("string"), F.lit(None).cast("string")).alias("description"))


@query(r"""select doc_id, length(text) > 2000 as long_text, regexp_matches(text, '[一-鿿]') as cjk, left(text, 60) || case when length(text) > 60 then '…' else '' end as head from documents""")
def quality_predicates(spark, sf_dir):
    d = tab(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", (F.length("text") > 2000).alias("long_text"), F.when(F.col("text").isNotNull(), T.has_cjk(F.col("text"))).alias("cjk"), T.clamp_text(F.col("text"), 60).alias("head"))


@query(r"""select conv_id, turn, (t = '' or length(t) > 40 or regexp_matches(t, '[/\\]|@ohos|ohos\.permission|\.ets|\.ts')) as noise from (select conv_id, turn, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as t from conversations)""")
def noise_titles(spark, sf_dir):
    c = tab(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return c.select("conv_id", "turn", T.is_noise(F.col("text")).alias("noise"))


def sql_page_title(path: str) -> str:
    """DuckDB SQL for a page's title by its path, step by step as lists; ``path`` is a query with page_id and path."""
    known = "case lower({x}) " + " ".join(f"when '{k}' then '{v}'" for k, v in T.PAGE_TITLES.items()) + " end"
    words = "list_filter(string_split(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' '), lambda w: w <> '')"
    named = f"case when regexp_matches(x, '[一-鿿]') then x else coalesce({known.format(x='x')}, case when len({words.format(x='x')}) > 1 then nullif(list_aggregate(list_filter(list_transform({words.format(x='x')}, lambda w: {known.format(x='w')}), lambda y: y is not null), 'string_agg', ''), '') end) end"
    short = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({x}, '“”\"’''', ''), '[（(]\\s*', '（', 'g'), '\\s*[）)]', '）', 'g'), '\\s+', '', 'g'), '^[：:，,。.!！？?]+|[：:，,。.!！？?]+$', '', 'g')"
    return f"""with p as ({path}), s as (select page_id, list_transform(list_filter(string_split(coalesce(path, ''), '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '\\.(ets|ts|tsx|js|jsx)$', '')) as bare from p),
    a as (select page_id, bare, list_position(list_reverse(list_transform(bare, lambda x: lower(x))), 'pages') as spot from s),
    n as (select page_id, list_reverse(list_transform(case when spot > 0 then bare[len(bare) - spot + 2 :] else bare end, lambda x: regexp_replace(x, '(Page|View|Screen|Ability)$', ''))) as names from a),
    f as (select page_id, names, list_filter(list_transform(names[1:2], lambda x: {named}), lambda y: y is not null) as first, list_filter(list_transform(names, lambda x: {known.format(x="x")}), lambda y: y is not null) as rest from n),
    b as (select page_id, coalesce(nullif({short.format(x="coalesce(first[1], rest[1], nullif(names[1], ''), '页面')")}, ''), '页面') as base from f)
    select page_id, case when base = '首页' or regexp_matches(base, '(页|页面|界面|主页)$') then base else base || '页面' end as title from b"""


_URL_PATH = "select page_id, case when page_id % 3 = 0 then '/ets/pages/' || split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) || case page_id % 4 when 0 then '/ChatMessagePage.ets' when 1 then '/Index.ets' when 2 then '/my/SettingView.ts' else '/首页.ets' end else split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) end as path from pages"


@query(sql_page_title(_URL_PATH))
def title_from_path(spark, sf_dir):
    p = tab(spark, sf_dir, "pages", "page_id", "url")
    part = F.split_part(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    k = F.col("page_id") % 4
    ending = F.when(k == 0, "/ChatMessagePage.ets").when(k == 1, "/Index.ets").when(k == 2, "/my/SettingView.ts").otherwise("/首页.ets")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/ets/pages/"), part, ending)).otherwise(part)
    return p.select("page_id", T.page_title(path).alias("title"))


@query("select page_id, 'page:' || left(sha1(page_id::varchar || '|' || url), 12) as id from pages where url is not null")
def stable_sha1_id(spark, sf_dir):
    p = tab(spark, sf_dir, "pages", "page_id", "url").where("url is not null")
    return p.select("page_id", T.stable_id("page", F.col("page_id"), F.col("url")).alias("id"))


@query("select event_id, json_extract(props, '$.k')::bigint as k from events")
def json_lenient(spark, sf_dir):
    e = tab(spark, sf_dir, "events", "event_id", "props")
    noisy = F.concat(F.lit("noise "), F.col("props"), F.lit(" tail"))
    return e.select("event_id", F.try_variant_get(T.lenient_json(noisy), "$.k", "long").alias("k"))


#: White space as ``clean_text`` knows it, spelt out for DuckDB's expressions, whose \\s is ASCII only.
_BLANK = r"[\x09-\x0d\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '{_BLANK}', ' ', 'g'), '^ | $', '', 'g') as text from documents")
def clean_texts(spark, sf_dir):
    return tab(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.clean_text(F.col("text")).alias("text"))


_LOW = r"t = '' or bare = '' or bare in ({generic}) or regexp_matches(t, 'ArkUI|UIAbility|WindowStage|生命周期函数|\b(build|onDestroy|onForeground|onBackground)\b|\bonWindowStage') or (not regexp_matches(t, '[一-鿿]') and regexp_matches(t, '[A-Za-z]')) or (len(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9-]*')) >= 4 and len(regexp_extract_all(t, '[一-鿿]')) <= 2)".replace("{generic}", ", ".join(f"'{g}'" for g in T.GENERIC_SCENARIOS))
_SAID = "case page_id % 6 when 0 then '功能，入口；' when 1 then '查询' || page_id || '的天气时' when 2 then url when 3 then 'build 页面 ' || page_id when 4 then ' 相关 操作-时。' else left(html, 60) end"


@query(f"select page_id, {_LOW} as low from (select page_id, t, lower(regexp_replace(t, '[“”\"''`、，,。.!！？?；;：:\\-_\\x09-\\x0d\\x1c-\\x1f \\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', '', 'g')) as bare from (select page_id, regexp_replace(regexp_replace(coalesce({_SAID}, ''), '{_BLANK}', ' ', 'g'), '^ | $', '', 'g') as t from pages))")
def low_quality_texts(spark, sf_dir):
    p = tab(spark, sf_dir, "pages", "page_id", "url", "html")
    k = F.col("page_id") % 6
    said = F.when(k == 0, "功能，入口；").when(k == 1, F.concat(F.lit("查询"), F.col("page_id").cast("string"), F.lit("的天气时"))).when(k == 2, F.col("url")).when(k == 3, F.concat(F.lit("build 页面 "), F.col("page_id").cast("string"))).when(k == 4, " 相关 操作-时。").otherwise(F.left("html", F.lit(60)))
    return p.select("page_id", T.is_low_quality(said).alias("low"))


@query("select page_id, case when page_id % 3 = 0 then case fn when 'onCreate' then '应用创建时' when '' then '应用生命周期' else '应用生命周期：' || fn end when page_id % 3 = 1 then case fn when 'build' then '组件展示与交互' when '' then '组件逻辑' else '组件逻辑：' || fn end else case fn when 'build' then '登录页面展示与交互' when '' then '登录页面逻辑' else '登录页面逻辑：' || fn end end as title from (select page_id, case page_id % 5 when 0 then 'build' when 1 then 'onCreate' when 2 then '' when 3 then 'go' || page_id else 'x' end as fn from pages)")
def source_titles(spark, sf_dir):
    k = F.col("page_id") % 5
    fn = F.when(k == 0, "build").when(k == 1, "onCreate").when(k == 2, "").when(k == 3, F.concat(F.lit("go"), F.col("page_id").cast("string"))).otherwise("x")
    path = F.when(F.col("page_id") % 3 == 0, "a/EntryAbility/E.ets").when(F.col("page_id") % 3 == 1, "a\\component\\C.ets").otherwise("ets/pages/LoginPage.ets")
    page = T.page_description(F.lit("Login"), F.lit("ets/pages/LoginPage.ets"))
    return tab(spark, sf_dir, "pages", "page_id").select("page_id", T.source_title(fn, path, page).alias("title"))


@query("select page_id, regexp_replace(regexp_replace(ltrim(r, '/'), '\\.ets$', ''), '\\.ts$', '') as route, '/' || r as absolute, (case when floor(try_cast(x as double)) < 1 then 1 else floor(try_cast(x as double)) end)::bigint as most from (select page_id, 'p' || page_id || '/q' || case when page_id % 2 = 0 then '.ets' else '.ts' end as r, case when page_id % 3 = 0 then 'none' else (page_id - 5)::varchar || '.7' end as x from pages)")
def path_helpers(spark, sf_dir):
    p = tab(spark, sf_dir, "pages", "page_id")
    r = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("/q"), F.when(F.col("page_id") % 2 == 0, ".ets").otherwise(".ts"))
    typed = F.when(F.col("page_id") % 3 == 0, "none").otherwise(F.concat((F.col("page_id") - 5).cast("string"), F.lit(".7")))
    return p.select("page_id", T.route_key(F.concat(F.lit(" /"), r)).alias("route"), T.absolute_path(F.concat(F.lit("/x/../y/.././"), r)).alias("absolute"), T.limit_number(typed).alias("most"))


def _cut_sql(pattern: str) -> str:
    """Texts cut by a pattern's matches, parts numbered from 0; empty parts between matches don't count."""
    split = f"select doc_id, string_split(regexp_replace(text, {pattern}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) as parts from documents where regexp_matches(text, {pattern})"
    each = f"select doc_id, unnest(parts) as text, generate_subscripts(parts, 1) as i from ({split})"
    return f"select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as integer) as ord, text, i % 2 = 0 as anchor from ({each}) where text <> ''"


@query(_cut_sql("'(the and|the|und|que)'"))
def tokenise_anchors(spark, sf_dir):
    d = tab(spark, sf_dir, "documents", "doc_id", "text")
    told = d.select("doc_id", F.posexplode(T.tokenise(F.col("text"), ["the", "the and", "und", "que"])).alias("ord", "token"))
    return told.select("doc_id", "ord", "token.text", "token.anchor")


@query("""select lang, string_agg('在“' || source || '”场景中，我们会调用' || coalesce(lang, '') || '，用于' || n || '。', chr(10) || chr(10) order by source) as report from (select lang, source, count(*) as n from documents where lang is not null and source is not null group by lang, source) group by lang""")
def report_text(spark, sf_dir):
    d = tab(spark, sf_dir, "documents", "lang", "source").where("lang is not null and source is not null").groupBy("lang", "source").count()
    line = T.permission_sentence(F.col("source"), F.col("lang"), F.col("count").cast("string"), F.lit(""))
    got = d.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", line.alias("t")))).alias("s"))
    return got.select("lang", F.array_join("s.t", "\n\n").alias("report"))


# --- lookups ---


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1")
def first_wins(spark, sf_dir):
    o = tab(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return lookups.first_wins(o, ["o_custkey"], "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def last_wins(spark, sf_dir):
    o = tab(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return lookups.last_wins(o, ["o_custkey"], "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("select p_brand, string_agg(distinct p_type, ',' order by p_type) as types from part group by p_brand")
def union_sets_per_key(spark, sf_dir):
    p = tab(spark, sf_dir, "part", "p_brand", "p_type")
    return frames.rolled_sets(p, ["p_brand"], "p_type", "types").withColumn("types", F.array_join("types", ","))


@query("select d.doc_id, coalesce('quality ' || l.quality, 'lang ' || d.lang, 'none') as description from (select distinct doc_id, lang from documents) d left join (select doc_id, max(quality) as quality from labels group by doc_id) l using (doc_id)")
def priority_coalesce(spark, sf_dir):
    d = tab(spark, sf_dir, "documents", "doc_id", "lang").distinct()
    first = tab(spark, sf_dir, "labels", "doc_id", "quality").groupBy("doc_id").agg(F.max("quality").alias("q")).select("doc_id", F.concat(F.lit("quality "), F.col("q").cast("string")).alias("description"))
    second = d.select("doc_id", F.concat(F.lit("lang "), F.col("lang")).alias("description"))
    return lookups.priority_coalesce(d.select("doc_id"), ["doc_id"], [first, second], "description", "none")


@query("select doc_id, source from (select doc_id, source, case when source like '%zz' then 1 when source like '%1%' then 2 when source is not null then 3 end as tier from documents) where tier is not null qualify tier = min(tier) over ()")
def tier_fallback(spark, sf_dir):
    d = tab(spark, sf_dir, "documents", "doc_id", "source")
    s = F.col("source")
    return lookups.first_tier(d, F.when(s.like("%zz"), 1).when(s.like("%1%"), 2).when(s.isNotNull(), 3))


@query("select c_custkey, coalesce(n_name, 'unresolved') as n_name from customer left join (select n_nationkey, n_name from nation where n_regionkey < 3) on c_nationkey = n_nationkey")
def kit_resolve_left(spark, sf_dir):
    c = tab(spark, sf_dir, "customer", "c_custkey", F.col("c_nationkey").alias("k"))
    n = tab(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), "n_name")
    return lookups.lookup(c, n, ["k"], "n_name", F.lit("unresolved")).select("c_custkey", "n_name")


_KITS = """(select '@kit.' || r_name as kit, n_name as exported, case when n_nationkey % 4 = 0 then '@ohos.direct' || n_nationkey else '@ohos.m' || n_nationkey end as module,
  case when n_nationkey % 8 = 0 or n_nationkey % 4 <> 0 and n_nationkey % 3 = 0 then 'default' when n_nationkey % 4 <> 0 and n_nationkey % 3 = 1 then 'namespace' else 'named' end as kind,
  case when n_nationkey % 8 = 0 or n_nationkey % 4 <> 0 and n_nationkey % 3 = 0 then 'default' when n_nationkey % 4 = 0 then 'thing' when n_nationkey % 3 = 1 then '*' else lower(n_name) end as imported
  from nation join region on n_regionkey = r_regionkey)"""
_KIT_IMPORTS = "(select c_custkey, '@kit.' || r_name as module, n_name as imported, case when c_custkey % 7 = 0 then 'default' else 'named' end as kind from customer join nation on c_nationkey = n_nationkey join region on r_regionkey = case when c_custkey % 5 = 0 then (n_regionkey + 1) % 5 else n_regionkey end)"


@query(f"select i.c_custkey, coalesce(k.module, i.module) as module, coalesce(k.kind, i.kind) as kind, coalesce(k.imported, i.imported) as imported from {_KIT_IMPORTS} i left join {_KITS} k on i.module = k.kit and i.imported = k.exported and i.kind = 'named'")
def kit_imports_resolved(spark, sf_dir):
    n = tab(spark, sf_dir, "nation").join(tab(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    number, path = F.col("n_nationkey"), F.concat(F.lit("sdk/@kit."), F.col("r_name"), F.lit(".d.ts"))
    modules = files.sdk_modules(n.select(path.alias("path")).distinct())
    kind = F.when(number % 3 == 0, "default").when(number % 3 == 1, "namespace").otherwise("named")
    imported = F.when(number % 3 == 0, "default").when(number % 3 == 1, "*").otherwise(F.lower("n_name"))
    imports = n.where(number % 4 != 0).select(path.alias("path"), F.col("n_name").alias("local"), F.concat(F.lit("@ohos.m"), number).alias("module"), kind.alias("kind"), imported.alias("imported"), number.alias("import_line"))
    direct = number % 4 == 0
    exports = n.select(path.alias("path"), F.col("n_name").alias("exported"), F.when(number % 8 == 0, "default").when(direct, "thing").otherwise(F.col("n_name")).alias("local"), F.when(direct, F.concat(F.lit("@ohos.direct"), number)).alias("module"), number.alias("pos"))
    c = tab(spark, sf_dir, "customer").join(n.select("n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == number)
    home = F.when(F.col("c_custkey") % 5 == 0, (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey"))
    own = c.join(tab(spark, sf_dir, "region", F.col("r_regionkey").alias("home"), F.col("r_name").alias("home_name")), home == F.col("home"))
    app = own.select("c_custkey", F.concat(F.lit("@kit."), "home_name").alias("module"), F.when(F.col("c_custkey") % 7 == 0, "default").otherwise("named").alias("kind"), F.col("n_name").alias("imported"))
    return analysis.resolve_kits(app, files.kit_exports(modules, imports, exports))


_BANDS = "(select p_size::bigint as start, (p_size + 5 + p_size % 7)::bigint as stop, count(*)::bigint as n from part group by p_size)"


def _bands(spark, sf_dir):
    p = tab(spark, sf_dir, "part", big("p_size").alias("start")).groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    return p.select(F.lit(0).alias("file"), "start", (F.col("start") + 5 + F.col("start") % 7).alias("stop"), "n")


@query(f"select q::bigint as q, start, stop from (select distinct l_quantity as q from lineitem) join {_BANDS} on q between start and stop")
def range_join_all(spark, sf_dir):
    q = tab(spark, sf_dir, "lineitem", F.lit(0).alias("file"), F.col("l_quantity").alias("q")).distinct()
    return lookups.containing(q, _bands(spark, sf_dir), ["file"], "q", "start", "stop").select(big("q").alias("q"), "start", "stop")


@query(f"select q::bigint as q, start, stop from (select distinct l_quantity as q from lineitem) join {_BANDS} on q between start and stop qualify row_number() over (partition by q order by stop - start, start) = 1")
def range_join_innermost(spark, sf_dir):
    q = tab(spark, sf_dir, "lineitem", F.lit(0).alias("file"), F.col("l_quantity").alias("q")).distinct()
    return lookups.innermost(q, _bands(spark, sf_dir), ["file"], ["q"], "q", "start", "stop").select(big("q").alias("q"), "start", "stop")


@query("select a.event_id, b.event_id as near_id from events a join events b on a.user_id = b.user_id and b.event_type = 'click' and epoch(b.ts) - epoch(a.ts) between 1 and 86400 where a.event_type = 'purchase' qualify row_number() over (partition by a.event_id order by abs(epoch(b.ts) - epoch(a.ts)), epoch(b.ts), b.event_id) = 1")
def band_nearest(spark, sf_dir):
    e = tab(spark, sf_dir, "events", "event_id", "user_id", "event_type", (micros() / 1e6).alias("t"))
    a = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("t").alias("a"))
    b = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("near_id"), F.col("t").alias("b"))
    return lookups.nearest_in_band(a, b, ["user_id"], ["event_id"], "a", "b", 1, 86400, "near_id").select("event_id", "near_id")


@query("with e as (select user_id, epoch_us(ts) as t from events where event_type = 'error'), p as (select user_id, t as start, coalesce(lead(t) over (partition by user_id order by t) - 1, 9000000000000000000) as stop from e) select v.event_id, p.start::bigint as page_start from events v join p on v.user_id = p.user_id and epoch_us(v.ts) between p.start and p.stop")
def page_range_lead(spark, sf_dir):
    e = tab(spark, sf_dir, "events", "user_id", "event_id", "event_type", micros().alias("t"))
    starts = e.where("event_type = 'error'").select("user_id", "t", F.col("t").alias("page_start"))
    # ranges that end where the next begins hold what comes at or after their start: an as-of look
    return lookups.asof(e, starts, ["user_id"], "t", "page_start").where("page_start is not null").select("event_id", "page_start")


@query("select doc_id, spot, start, stop from (select doc_id, (doc_id * 37) % 1000 as spot from documents where doc_id is not null) join (select conv_id, (conv_id * 53) % 900 as start, (conv_id * 53) % 900 + (conv_id % 4) * 40 + conv_id % 3 as stop, conv_id % 7 as f from (select distinct conv_id from conversations)) on doc_id % 7 = f and spot between start and stop")
def range_join_files(spark, sf_dir):
    d = tab(spark, sf_dir, "documents", "doc_id", (F.col("doc_id") % 7).alias("f"), (F.col("doc_id") * 37 % 1000).alias("spot")).where("doc_id is not null")
    c = tab(spark, sf_dir, "conversations", "conv_id").distinct()
    blocks = c.select((F.col("conv_id") % 7).alias("f"), (F.col("conv_id") * 53 % 900).alias("start"), (F.col("conv_id") * 53 % 900 + F.col("conv_id") % 4 * 40 + F.col("conv_id") % 3).alias("stop"))
    return lookups.containing(d, blocks, ["f"], "spot", "start", "stop").select("doc_id", "spot", "start", "stop")


@query("select a.event_id, b.event_id as near_id from events a join events b on a.user_id = b.user_id and b.event_type = 'view' and epoch_us(b.ts) - epoch_us(a.ts) between -40000000000 and 90000000000 where a.event_type = 'purchase' qualify row_number() over (partition by a.event_id order by abs(epoch_us(b.ts) - epoch_us(a.ts)), epoch_us(b.ts), b.event_id) = 1")
def band_nearest_both_sides(spark, sf_dir):
    e = tab(spark, sf_dir, "events", "event_id", "user_id", "event_type", micros().alias("t"))
    a = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("t").alias("a"))
    b = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("near_id"), F.col("t").alias("b"))
    return lookups.nearest_in_band(a, b, ["user_id"], ["event_id"], "a", "b", -40_000_000_000, 90_000_000_000, "near_id").select("event_id", "near_id")


@query("select a.event_id, b.event_id as seen_id, least((epoch(a.ts) - epoch(b.ts))::bigint, 999999) as score from (select * from events where event_type = 'purchase') a asof join (select * from events where event_type in ('click', 'view')) b on a.user_id = b.user_id and a.ts >= b.ts where epoch(a.ts) - epoch(b.ts) <= 259200")
def asof_backward_score(spark, sf_dir):
    e = tab(spark, sf_dir, "events", "event_id", "user_id", "event_type", micros().alias("t"))
    a = e.where("event_type = 'purchase'").select("user_id", "t", "event_id")
    b = e.where("event_type in ('click', 'view')").select("user_id", "t", F.struct("t", "event_id").alias("seen"))
    got = lookups.asof(a, b, ["user_id"], "t", "seen").where("t - seen.t <= 259200000000")
    return got.select("event_id", F.col("seen.event_id").alias("seen_id"), F.least(F.round(F.col("t") / 1e6 - F.col("seen.t") / 1e6).cast("long"), F.lit(999999).cast("long")).alias("score"))


_PENALTY = "case event_type when 'click' then 0 when 'view' then 2 when 'error' then 4 else 8 end"


@query(f"with e as (select user_id, epoch_us(ts) // 3600000000 as line, event_type, {_PENALTY} as penalty from events), p as (select distinct user_id, line from e where event_type = 'purchase'), u as (select user_id, line, min(penalty) as penalty from e where event_type <> 'purchase' group by user_id, line) select p.user_id, p.line::bigint as line, (p.line - u.line + u.penalty)::bigint as score from p asof join u on p.user_id = u.user_id and p.line >= u.line where p.line - u.line <= 80")
def asof_category_penalty(spark, sf_dir):
    e = tab(spark, sf_dir, "events", "user_id", "event_type", micros().alias("t")).withColumn("line", F.expr("t div 3600000000")).withColumn("path", F.col("user_id").cast("string"))
    kind = F.when(F.col("event_type") == "click", "Button").when(F.col("event_type") == "view", "Input").when(F.col("event_type") == "error", "Component").otherwise("Other")
    elements = e.where("event_type <> 'purchase'").select("path", "line", F.col("event_type").alias("component"), kind.alias("category"))
    got = analysis.nearest_element(e.where("event_type = 'purchase'").select("path", "line"), elements)
    return got.select(F.col("path").cast(e.schema["user_id"].dataType).alias("user_id"), "line", big("score").alias("score"))


@query("select a.event_id, b.event_id as seen_id from (select * from events where event_type = 'purchase') a asof join (select * from events) b on a.user_id = b.user_id and a.ts > b.ts")
def asof_strict(spark, sf_dir):
    e = tab(spark, sf_dir, "events", "event_id", "user_id", "event_type", micros().alias("t"))
    a = e.where("event_type = 'purchase'").select("user_id", "t", "event_id")
    b = e.select("user_id", "t", F.struct("t", "event_id").alias("seen"))
    return lookups.asof(a, b, ["user_id"], "t", "seen", strict=True).where("seen is not null").select("event_id", F.col("seen.event_id").alias("seen_id"))


@query("with n as (select p_name, count(*) over (partition by p_name) as n, p_partkey, p_brand, p_size from part) select a.p_partkey as call_id, b.p_partkey as def_id from part a join n b on a.p_name = b.p_name and a.p_partkey <> b.p_partkey where a.p_brand = b.p_brand or b.n = 1 qualify row_number() over (partition by a.p_partkey order by (a.p_brand = b.p_brand) desc, abs(a.p_size - b.p_size), b.p_partkey) = 1")
def nearest_name_resolution(spark, sf_dir):
    p = tab(spark, sf_dir, "part", "p_name", "p_partkey", "p_brand", "p_size")
    calls = p.select("p_name", F.col("p_partkey").alias("call_id"), F.col("p_brand").alias("a_brand"), F.col("p_size").alias("a_size"))
    defs = p.select("p_name", F.col("p_partkey").alias("def_id"), "p_brand", "p_size")
    met = lookups.resolve_by_name(calls, defs, "p_name", ["call_id"], ("a_brand", "p_brand"), ("a_size", "p_size"), "def_id", itself=("call_id", "def_id"))
    return met.where("call_id <> def_id").select("call_id", "def_id")


@query("with c as (select o_custkey, o_orderkey, 1 as strategy, abs(o_totalprice - 100000) as score from orders where o_orderpriority like '1%' union all select o_custkey, o_orderkey, 2, abs(o_totalprice - 100000) from orders where o_orderstatus = 'O' union all select o_custkey, o_orderkey, 3, abs(o_totalprice - 100000) from orders) select o_custkey, o_orderkey, strategy::bigint as strategy from c qualify row_number() over (partition by o_custkey order by strategy, score, o_orderkey) = 1")
def cascade_argmin(spark, sf_dir):
    o = tab(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", F.abs(F.col("o_totalprice") - 100000).alias("score"))
    tiers = [o.where("o_orderpriority like '1%'"), o.where("o_orderstatus = 'O'"), o]
    got = lookups.argmin([t.select("o_custkey", "o_orderkey", "score") for t in tiers], ["o_custkey"], "score", "o_orderkey")
    return got.select("o_custkey", "o_orderkey", big("strategy").alias("strategy"))


@query(_cut_sql("(select '(' || string_agg(a, '|' order by length(a) desc, a) || ')' from (select distinct lang || case when k = 0 then '' else 'te' end as a from documents cross join range(2) r(k) where lang is not null))"))
def tokenise_by_table(spark, sf_dir):
    d = tab(spark, sf_dir, "documents", "doc_id", "text", "lang")
    anchors = d.select(F.explode(F.array("lang", F.concat("lang", F.lit("te")))).alias("a"))
    told = needles.tokenise(d.select("doc_id", "text"), anchors, "text", "a").select("doc_id", F.posexplode("tokens").alias("ord", "t"))
    return told.select("doc_id", "ord", "t.text", "t.anchor")


_NEEDLES = "(select item_id, case item_id % 4 when 0 then left(text, 24) when 1 then substring(text, 3, 21) when 2 then substring(text, 6, 3) else substring(text, 9, 12) end as needle from benchmark)"


@query(f"select doc_id, item_id, count(*)::bigint as n from documents join {_NEEDLES} on needle <> '' and contains(text, needle) group by doc_id, item_id")
def text_theta_join(spark, sf_dir):
    d = tab(spark, sf_dir, "documents", "doc_id", "text")
    k = F.col("item_id") % 4
    needle = F.when(k == 0, F.left("text", F.lit(24))).when(k == 1, F.substring("text", 3, 21)).when(k == 2, F.substring("text", 6, 3)).otherwise(F.substring("text", 9, 12))
    b = tab(spark, sf_dir, "benchmark", "item_id", needle.alias("needle"))
    return lookups.text_matches(d, b, "text", "needle").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


_HANDLERS = "(select 'href' as name union all select 'div' union all select 'class' union all select 'nav')"


@query(rf"select page_id, name, count(*)::bigint as n from (select page_id, replace(replace(html, '<', 'this . '), '=', ' (') as line from pages where page_id is not null) join {_HANDLERS} on regexp_matches(line, '\bthis\s*\.\s*' || name || '\b') or regexp_matches(line, '\b' || name || '\s*\(') group by page_id, name")
def handler_theta_join(spark, sf_dir):
    p = tab(spark, sf_dir, "pages", "page_id", F.lit(0).alias("file"), F.replace(F.replace(F.col("html"), F.lit("<"), F.lit("this . ")), F.lit("="), F.lit(" (")).alias("line")).where("page_id is not null")
    names = spark.createDataFrame([(0, n) for n in ("href", "div", "class", "nav")], "file int, name string")
    return lookups.named_in(p, names, ["file"], "line", "name").groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*)::bigint as n, sum(c_acctbal) as total from customer where exists (select 1 from orders where o_custkey = c_custkey)".replace("sum(c_acctbal)", "round(sum(c_acctbal), 2)"))
def known_semi(spark, sf_dir):
    c, o = tab(spark, sf_dir, "customer", F.col("c_custkey").alias("k"), "c_acctbal"), tab(spark, sf_dir, "orders", F.col("o_custkey").alias("k"))
    return lookups.split_known(c, o, ["k"])[0].agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("select c_custkey as k from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def dropped_anti(spark, sf_dir):
    c, o = tab(spark, sf_dir, "customer", F.col("c_custkey").alias("k")), tab(spark, sf_dir, "orders", F.col("o_custkey").alias("k"))
    return lookups.split_known(c, o, ["k"])[1]


@query("select l_partkey as k, case when p_partkey is null then 'unknown' else 'known' end as mode from (select distinct l_partkey from lineitem) left join (select p_partkey from part where p_size < 25) on l_partkey = p_partkey")
def member_flag(spark, sf_dir):
    items = tab(spark, sf_dir, "lineitem", F.col("l_partkey").alias("k")).distinct()
    return lookups.flag_member(items, tab(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("k")), ["k"], "mode", "known", "unknown")


@query("with b as (select doc_id, max(quality) as v from labels group by doc_id), e as (select doc_id, max(length(text) % 2)::int as v from documents group by doc_id) select coalesce(b.doc_id, e.doc_id) as doc_id, coalesce(case when b.v <> 0 then b.v end, e.v, b.v)::bigint as v from b full join e on b.doc_id = e.doc_id")
def upsert_merge(spark, sf_dir):
    b = tab(spark, sf_dir, "labels", "doc_id", "quality").groupBy("doc_id").agg(F.max("quality").alias("v"))
    e = tab(spark, sf_dir, "documents", "doc_id", "text").groupBy("doc_id").agg(F.max(F.length("text") % 2).alias("v"))
    return lookups.upsert(b, e, ["doc_id"], "v", F.col("v") == 0).select("doc_id", big("v").alias("v"))


# --- frames, sets and roll-ups ---


@query("select doc_id, line_no::bigint as line_no, string_agg(line, chr(10)) over (partition by doc_id order by line_no rows between 2 preceding and 2 following) as context from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents where doc_id is not null)")
def context_frame(spark, sf_dir):
    lines = frames.lines_of(tab(spark, sf_dir, "documents", "doc_id", "text").where("doc_id is not null"), ["doc_id"])
    return frames.context(lines, ["doc_id"], 2).select("doc_id", big("line_no").alias("line_no"), "context")


@query("select event_id, max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts rows between current row and 12 following) = 1 as error_ahead from events")
def lookahead_flag(spark, sf_dir):
    e = tab(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    return frames.ahead_any(e, ["user_id"], "ts", F.col("event_type") == "error", 12, "error_ahead").select("event_id", "error_ahead")


@query("select o_orderkey, count(l_orderkey)::bigint as n_lines, string_agg(distinct l_returnflag, ',' order by l_returnflag) as flags, count(case when l_linestatus = 'O' then 1 end)::bigint as n_open from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey")
def callsite_rollup(spark, sf_dir):
    li = tab(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linestatus")
    sums = li.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"))
    got = tab(spark, sf_dir, "orders", "o_orderkey").join(sums, "o_orderkey", "left")
    return got.select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "flags", F.coalesce("n_open", F.lit(0)).alias("n_open"))


@query("select user_id, event_type, count(*)::bigint as n_flows, min(epoch_us(ts))::bigint as anchor_line, arg_min(event_id, ts) as title from events group by user_id, event_type")
def feature_group_anchor(spark, sf_dir):
    e = tab(spark, sf_dir, "events", "event_id", "user_id", "event_type", micros().alias("t"))
    return frames.features(e, ["user_id", "event_type"], "event_id", "t", "event_id")


_EVAL = "with t as (select distinct lang, doc_id from documents join labels using (doc_id) where quality = 0 and lang is not null), p as (select distinct lang, doc_id from documents where length(text) < 300 and lang is not null), b as (select coalesce(t.lang, p.lang) as lang, t.doc_id as t, p.doc_id as p from t full join p on t.lang = p.lang and t.doc_id = p.doc_id) select lang, count(t)::bigint as gt, count(p)::bigint as pred, count(case when t is not null and p is not null then 1 end)::bigint as tp, count(case when t is null then 1 end)::bigint as fp, count(case when p is null then 1 end)::bigint as fn, round(count(case when t is not null and p is not null then 1 end) / nullif(count(t), 0), 6) as recall, round(count(case when t is not null and p is not null then 1 end) / nullif(count(p), 0), 6) as precision, round(count(case when t is null then 1 end) / nullif(count(p), 0), 6) as fpr from b group by {by}"


def _evaluation(spark, sf_dir, total):
    d = tab(spark, sf_dir, "documents", "doc_id", "lang", F.length("text").alias("n")).where("lang is not null and doc_id is not null")
    t = d.join(tab(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    got = frames.evaluate(t, d.where("n < 300"), ["lang"], ["doc_id"], total=total)
    return got.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "fpr")})


@query(_EVAL.format(by="lang"))
def eval_prf(spark, sf_dir):
    return _evaluation(spark, sf_dir, False)


@query(_EVAL.format(by="grouping sets ((lang), ())"))
def eval_total(spark, sf_dir):
    return _evaluation(spark, sf_dir, True)


def _keys(spark, sf_dir):
    return tab(spark, sf_dir, "customer", F.col("c_custkey").alias("k")), tab(spark, sf_dir, "orders", F.col("o_custkey").alias("k"))


@query("select c_custkey as k from customer union select o_custkey from orders")
def set_union(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.union(b).distinct()


@query("select c_custkey as k from customer except select o_custkey from orders")
def set_except(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.subtract(b)


@query("select c_custkey as k from customer intersect select o_custkey from orders")
def set_intersect(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.intersect(b)


@query("select p_brand, p_partkey, rank::bigint as rank from (select p_brand, p_partkey, row_number() over (partition by p_brand order by 2 * abs(p_size - 20) + case when p_type like 'S%' then 0 else 100 end, p_partkey) as rank from part) where rank <= 6")
def topk_per_group(spark, sf_dir):
    p = tab(spark, sf_dir, "part", "p_brand", "p_partkey", "p_size", "p_type")
    score = 2 * F.abs(F.col("p_size") - 20) + F.when(F.col("p_type").startswith("S"), 0).otherwise(100)
    return lookups.top_k(p, ["p_brand"], 6, score, F.col("p_partkey")).select("p_brand", "p_partkey", big("rank").alias("rank"))


@query("select user_id, event_id, ((row_number() over (partition by user_id order by ts) - 1) // 15)::bigint as chunk from events")
def chunk_batches(spark, sf_dir):
    e = tab(spark, sf_dir, "events", "user_id", "event_id", "ts")
    return frames.chunked(e, ["user_id"], 15, "ts").select("user_id", "event_id", "chunk")


@query("select doc_id, line_no::bigint as line_no, n_lines::bigint as n_lines from (select doc_id, line_no, count(*) over (partition by doc_id) as n_lines from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as line_no from (select distinct doc_id, text from documents where doc_id is not null))) where n_lines <= 8 or line_no <= 3 or line_no > n_lines - 2")
def head_tail_sample(spark, sf_dir):
    d = tab(spark, sf_dir, "documents", "doc_id", "text").where("doc_id is not null").distinct()
    return frames.head_tail(frames.lines_of(d, ["doc_id"]), ["doc_id"], 8, 3, 2).select("doc_id", big("line_no").alias("line_no"), "n_lines")


@query("select user_id, arg_max(event_id, ts) as event_id, max(epoch_us(ts))::bigint as t from events group by user_id")
def latest_per_app(spark, sf_dir):
    e = tab(spark, sf_dir, "events", "user_id", "event_id", micros().alias("t"))
    return e.groupBy("user_id").agg(F.max_by("event_id", "t").alias("event_id"), F.max("t").alias("t"))


@query("select user_id, event_id, 'p' || row_number() over (partition by user_id order by ts) as seq from events")
def sequence_numbers(spark, sf_dir):
    e = tab(spark, sf_dir, "events", "user_id", "event_id", "ts")
    return frames.numbered(e, "ts", keys=["user_id"]).select("user_id", "event_id", "seq")


@query("select doc_id, line_no::bigint as line_no, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from (select distinct doc_id, text from documents where doc_id is not null))")
def line_offsets(spark, sf_dir):
    d = tab(spark, sf_dir, "documents", "doc_id", "text").where("doc_id is not null").distinct()
    return frames.line_of_offset(frames.lines_of(d, ["doc_id"]), ["doc_id"]).select("doc_id", big("line_no").alias("line_no"), "offset")


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from (select distinct doc_id, text from documents where doc_id is not null)) select a.doc_id, string_agg(case when l.n = 2 then '>' else ' ' end || lpad(l.n::varchar, 5, ' ') || ': ' || l.line, chr(10) order by l.n) as snippet from (select distinct doc_id from documents where doc_id is not null) a join l on l.doc_id = a.doc_id and l.n between 1 and 4 group by a.doc_id")
def anchor_snippets(spark, sf_dir):
    d = tab(spark, sf_dir, "documents", "doc_id", "text").where("doc_id is not null").distinct()
    spots = d.select("doc_id").distinct().withColumn("anchor", F.lit(2))
    return frames.snippets(frames.lines_of(d, ["doc_id"]), spots, ["doc_id"], 2).select("doc_id", "snippet")


@query("select conv_id, count(*)::bigint as n_turns, bool_and(turn_ok) as ordered from (select conv_id, role in ('user', 'assistant', 'system') as turn_ok from conversations) group by conv_id")
def conversation_shape(spark, sf_dir):
    c = tab(spark, sf_dir, "conversations", "conv_id", "role")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.bool_and(F.col("role").isin("user", "assistant", "system")).alias("ordered"))
