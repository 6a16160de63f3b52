"""Frames over lines: context, look-ahead, numbering, sampling; sets and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import graphs


def lines_of(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no, line): texts cut at line ends, numbered from 1."""
    return texts.select(*keys, F.posexplode(F.split(F.col(text), "\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def context(lines: DataFrame, keys: list[str], radius: int = 5, line: str = "line", at: str = "line_no") -> DataFrame:
    """Adds ``context``: the lines from ``radius`` before to ``radius`` after, within the text."""
    w = W.partitionBy(*keys).orderBy(at).rowsBetween(-radius, radius)
    return lines.withColumn("context", F.array_join(F.collect_list(line).over(w), "\n"))


def snippets(lines: DataFrame, anchors: DataFrame, keys: list[str], radius: int = 8, at: str = "line_no", anchor: str = "anchor") -> DataFrame:
    """(keys, anchor, snippet): numbered lines around an anchor, the anchor's own marked by >."""
    spots = anchors.select(*keys, anchor, F.explode(F.sequence(F.greatest(F.lit(1), F.col(anchor) - radius), F.col(anchor) + radius)).alias(at))
    mark = F.when(F.col(at) == F.col(anchor), ">").otherwise(" ")
    told = F.concat(mark, F.lpad(F.col(at).cast("string"), 5, " "), F.lit(": "), F.col("line"))
    got = spots.join(lines, [*keys, at]).groupBy(*keys, anchor).agg(F.sort_array(F.collect_list(F.struct(at, told.alias("t")))).alias("s"))
    return got.select(*keys, anchor, F.array_join("s.t", "\n").alias("snippet"))


def ahead_any(df: DataFrame, keys: list[str], at: str, flag: Column, rows: int, name: str) -> DataFrame:
    """Whether ``flag`` holds in this row or one of the next ``rows``."""
    w = W.partitionBy(*keys).orderBy(at).rowsBetween(0, rows)
    return df.withColumn(name, F.max(flag.cast("int")).over(w) == 1)


def navigation(lines: DataFrame, keys: list[str], rows: int = 10, line: str = "line", at: str = "line_no") -> DataFrame:
    """(keys, line_no, kind, url) for lines that name a router: the first call and the first url from there to ``rows`` on."""
    w = W.partitionBy(*keys).orderBy(at).rowsBetween(0, rows)
    text = F.array_join(F.collect_list(line).over(w), "\n")
    got = lines.withColumn("_text", text).where(F.contains(F.col(line), F.lit("router")))
    kind = F.regexp_extract("_text", r"router\s*\.\s*(pushUrl|replaceUrl|back)\s*\(", 1)
    url = F.nullif(F.regexp_extract("_text", r"""(?<![A-Za-z0-9_])url\s*:\s*['"]([^'"]+)['"]""", 1), F.lit(""))
    return got.select(*keys, at, kind.alias("kind"), url.alias("url")).where("kind <> ''")


def head_tail(lines: DataFrame, keys: list[str], most: int = 80, head: int = 56, tail: int = 20, at: str = "line_no", line: str | None = None) -> DataFrame:
    """All lines of texts of ``most`` lines or fewer; else the first ``head`` and the last ``tail``. Adds n_lines.

    With ``line``, a row that says how many lines were left out stands in between, at place head + 1.
    """
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    told = lines.withColumn("n_lines", n)
    kept = (F.col("n_lines") <= most) | (F.col(at) <= head) | (F.col(at) > F.col("n_lines") - tail)
    if line is None:
        return told.where(kept)
    mark = (F.col("n_lines") > most) & (F.col(at) == head + 1)
    left_out = F.concat(F.lit("...（中间省略 "), (F.col("n_lines") - head - tail).cast("string"), F.lit(" 行）..."))
    return told.where(kept | mark).withColumn(line, F.when(mark, left_out).otherwise(F.col(line)))


def numbered(df: DataFrame, *order: Column | str, prefix: str = "p", name: str = "seq", keys: list[str] | None = None) -> DataFrame:
    """Adds ``name``: prefix and the row's number in ``order``, within ``keys`` if given; without, by ranges of the order, so no task holds all rows."""
    if keys:
        return df.withColumn(name, F.concat(F.lit(prefix), F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("string")))
    got = graphs.ranked(df.withColumn("_order", F.struct(*order)), "_order", "_number")
    return got.withColumn(name, F.concat(F.lit(prefix), F.col("_number").cast("string"))).drop("_order", "_number")


def chunked(df: DataFrame, keys: list[str], size: int, *order: str) -> DataFrame:
    """Adds ``chunk``: rows of a key in batches of ``size``, numbered from 0."""
    return df.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1) / size))


def line_of_offset(lines: DataFrame, keys: list[str], line: str = "line", at: str = "line_no") -> DataFrame:
    """Adds ``offset``: where the line begins in its text, line ends counting one."""
    w = W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length(line) + 1).over(w), F.lit(0)))


def evaluate(truth: DataFrame, found: DataFrame, by: list[str], item: list[str], empty_is_none: bool = True, total: bool = False) -> DataFrame:
    """(by, gt, pred, tp, fp, fn, recall, precision, fpr) of sets; ratios of empty sets are null, or 1 and 0.

    With ``total``, one more row has nulls in ``by`` and the sums, its ratios formed from these.
    """
    t = truth.select(*by, *item).distinct().withColumn("_t", F.lit(1))
    p = found.select(*by, *item).distinct().withColumn("_p", F.lit(1))
    both = t.join(p, [*by, *item], "full")
    sums = [F.count("_t").alias("gt"), F.count("_p").alias("pred"), F.count(F.col("_t") + F.col("_p")).alias("tp"), F.count(F.when(F.col("_t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("_p").isNull(), 1)).alias("fn")]
    got = both.rollup(*by).agg(*sums, F.grouping_id().alias("_g")) if total else both.groupBy(*by).agg(*sums)
    if total:
        got = got.where(F.col("_g").isin(0, 2 ** len(by) - 1)).drop("_g")
    ratio = lambda a, b, other: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(None if empty_is_none else other).cast("double"))
    return got.withColumns({"recall": ratio("tp", "gt", 1.0), "precision": ratio("tp", "pred", 1.0), "fpr": ratio("fp", "pred", 0.0)})


def rolled_sets(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the sorted set of a key's values."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias(name))


def features(flows: DataFrame, by: list[str], flow: str, line: str, title: str) -> DataFrame:
    """(by, n_flows, anchor_line, title): flows grouped; the anchor is the smallest line, the title that of its first flow."""
    return flows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_flows"), F.min(line).alias("anchor_line"), F.min_by(title, F.struct(line, flow)).alias("title"))


def chained(nodes: DataFrame, flow: str, order: str, node: str) -> DataFrame:
    """(flow, src, dst): edges from each node to the next one of its flow."""
    nxt = F.lead(node).over(W.partitionBy(flow).orderBy(order))
    return nodes.select(flow, F.col(node).alias("src"), nxt.alias("dst")).where("dst is not null")


def ordered_subsequence(anchors: Column, visited: Column) -> Column:
    """Whether all anchors occur in ``visited`` in their order, the last visited being the last anchor."""
    matched = F.aggregate(visited, F.lit(0), lambda i, x: F.when(F.coalesce(x == F.get(anchors, i), F.lit(False)), i + 1).otherwise(i))
    return (matched == F.size(anchors)) & (F.try_element_at(visited, F.lit(-1)) == F.try_element_at(anchors, F.lit(-1)))
