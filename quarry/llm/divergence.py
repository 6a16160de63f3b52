"""How far the sources of a language diverge in their terms: joint count histograms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, staged, table, words_in_slices

#: Documents of a language that a term needs, what is added to each count, the scale of p, ranks of part ``term``.
LEAST_DOCS, ADDED, SCALE, RANKS = 30, 5, 1_000_000_000, 50
#: Entries and documents of a task's tally before it is handed on.
ENTRIES, DOCS = 600_000, 1_000_000
#: A document in an entry of the tally, whose lower bits count occurrences.
_DOC = 1 << 40
#: Bytes of UTF-8 that make terms: letters of ASCII, lower-cased, and all bytes of other characters. The rest parts them.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed within a bounded tally."""
    tally: dict[tuple[str, str], dict[bytes, int]] = {}
    size = docs = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), known in tally.items():
            sums = np.fromiter(known.values(), np.int64, len(known))
            columns = [pa.repeat(pa.scalar(lang), len(known)), pa.repeat(pa.scalar(source), len(known)), pa.array(list(known), pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums & (_DOC - 1)), pa.array(sums // _DOC)], names=["lang", "source", "term", "n", "docs"])
        tally.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            own: Counter = Counter()
            for words in words_in_slices(text.as_buffer().to_pybytes().translate(_FOLD)):
                own.update(words)
            known = tally.setdefault((lang, source), {})
            size, docs, get = size - len(known), docs + 1, known.get
            for term, n in own.items():
                known[term] = get(term, 0) + n + _DOC
            size += len(known)
            if size >= ENTRIES or docs >= DOCS:
                yield from rows()
                size = docs = 0
    yield from rows()


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tallies, terms as strings: bytes that make terms are parted at ASCII only, so each is whole UTF-8."""
    for b in _tallies(batches):
        yield b.set_column(2, "term", b.column(2).cast(pa.string()))


def _p(n: str | Column, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * terms)), exactly, for counts of any size."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (F.col(n) if isinstance(n, str) else n).cast("decimal(19,0)") + F.lit(SCALE * ADDED).cast("decimal(19,0)")
    by = F.greatest(F.col(total) + F.lit(ADDED) * F.col(terms), F.lit(1)).cast("decimal(20,0)")
    return F.call_function("div", whole, by) + F.lit(1)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, and its telling terms.

    Null text, lang and source are read as ''. Every (lang, source) that occurs is a group, also without terms. A language
    keeps the terms of ``least_docs`` of its documents or more (each row is a document, repeated ids included). Part ``pair``
    has a row for each other source of the language, whose value is the sum over kept terms of how far p lies apart (0 without terms); part ``term`` has the
    group's terms that are likelier than in the language, to ``ranks``. Equal values are ranked by item in UTF-8 order. Other
    columns are ignored; an empty table gives no rows.

    For each pair of sources the combinations of two counts are tallied: those of terms that both have by a join on the term,
    those with a zero as what remains of each source's own histogram of counts, and both zero as what remains of the
    language's terms. p is formed once for each combination. The tallies leave tasks summed; a term's rows are as many
    as its sources.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    told = src.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_told, "lang string, source string, term string, n long, docs long")
    each = told.repartition("term", "lang").groupBy("term", "lang", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("term", "lang")  # sorts compare what differs first
    kept = each.withColumns({"lang_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term)}).where(F.col("lang_docs") >= least_docs)
    kept = staged(kept.select("lang", "source", "term", "n", "lang_n"), "divergence-counts")

    terms = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own_terms"))
    groups = src.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = staged(groups.na.fill(0), "divergence-groups")

    a = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), F.col("own_terms").alias("terms_a"), "terms")
    b = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"), F.col("own_terms").alias("terms_b"))
    pairs = a.join(b, "lang").where("a < b")
    levels = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    left = kept.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("ca"))
    right = kept.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("cb"))
    both = left.join(right, ["term", "lang"]).where("a < b").groupBy("lang", "a", "b", "ca", "cb").agg(F.count(F.lit(1)).alias("m"))
    shares = F.explode(F.array(*(F.struct(ca.alias("ca"), cb.alias("cb"), m.alias("m")) for ca, cb, m in (
        (F.col("ca"), F.col("cb"), F.col("m")), (F.col("ca"), F.lit(0), -F.col("m")), (F.lit(0), F.col("cb"), -F.col("m")), (F.lit(0), F.lit(0), F.col("m"))))))
    names, zero = ["lang", "a", "b"], F.lit(0).cast("long")
    tallies = both.select(*names, shares.alias("s")).select(*names, "s.*")
    tallies = tallies.unionByName(pairs.join(levels.withColumnRenamed("source", "a"), ["lang", "a"]).select(*names, F.col("n").alias("ca"), zero.alias("cb"), "m"))
    tallies = tallies.unionByName(pairs.join(levels.withColumnRenamed("source", "b"), ["lang", "b"]).select(*names, zero.alias("ca"), F.col("n").alias("cb"), "m"))
    tallies = tallies.unionByName(pairs.select(*names, zero.alias("ca"), zero.alias("cb"), F.expr("terms - terms_a - terms_b").alias("m")))
    cells = tallies.groupBy(*names, "ca", "cb").agg(F.sum("m").alias("m")).join(pairs, names)
    apart = F.abs(_p("ca", "total_a", "terms") - _p("cb", "total_b", "terms"))
    between = cells.groupBy(*names).agg(F.sum(F.when(F.col("m") > 0, apart * F.col("m")).otherwise(0)).alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    between = between.select("lang", "value", ways.alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    own = kept.join(groups, ["lang", "source"]).withColumns({"p": _p("n", "total", "terms"), "q": _p("lang_n", "lang_total", "terms")}).where("p > q")
    telling = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return between.withColumn("rank", F.row_number().over(order)).unionByName(telling).select("lang", "source", "part", "item", F.col("value").cast("long"), "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


SOURCE_DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce("text", '') AS body FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source),
p AS (SELECT lang, source, term, n, CAST(1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // CAST(total + 5 * v AS HUGEINT) AS BIGINT) AS p,
  CAST(1 + (1000000000 * CAST(lang_n + 5 AS HUGEINT)) // CAST(lang_total + 5 * v AS HUGEINT) AS BIGINT) AS q
  FROM cells JOIN totals USING (lang, source) JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
