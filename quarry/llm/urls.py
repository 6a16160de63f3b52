"""URL filters: rules first, then naive Bayes over the words that hosts and paths are made of."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, staged, table

#: (verdict, host, path) of the rules that the query applies.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Counts that smooth the classifier's words.
SMOOTH = 0.1
#: Words of the unigram model and of the classifier have this share of all words at least, at every size.
LEAST_SHARE = 2e-6
#: Cost in nats of a piece that is no word, besides that of the rarest word, and of each of its letters.
UNKNOWN, LETTER = 6.0, 4.0
_LETTERS = re.compile(r"[^\W\d_]+")
_TAG = re.compile(r"<[^>]*>")
_ADDRESS = re.compile(r"\w[\w+.-]*://\S*|\w[\w-]*(?:\.\w[\w-]*)+(?:/\S*)?")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as the rules see them; both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits ``host`` and ``path``, as a struct (rule, verdict); null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    known = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(v).alias("verdict")) for v, h, p in ordered])
    fits = F.filter(known, lambda r: ((F.col("host") == r.h) | F.col("host").endswith(F.concat(F.lit("."), r.h))) & F.startswith(F.col("path"), r.p))
    first = F.try_element_at(fits, F.lit(1))
    return F.when(first.isNotNull(), F.struct(F.concat(first.h, first.p).alias("rule"), first.verdict.alias("verdict")))


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): words of letters in whole pages without tags and addresses; counted in tasks, then summed.

    Names in urls are what is to be split, so they aren't counted, nor are a page's words that its own host has whole.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for b in batches:
            for text, host in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {w for w in _LETTERS.findall(host or "") if len(w) >= 4}
                counts.update(w for w in _LETTERS.findall(_ADDRESS.sub(" ", _TAG.sub(" ", text or "")).lower()) if w not in own)
            if len(counts) > 100_000:
                yield out(counts)
                counts = Counter()
        if counts:
            yield out(counts)

    src = pages.select(F.col("html").cast("string"), F.col("url").cast("string"))
    return src.select("html", F.lower(split_url(F.col("url"))[0])).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Words(dict):
    """-log p of each word of the unigram model, the length of the longest and the cost of the rarest."""

    def __init__(self, counts: dict[str, int], total: int):
        super().__init__((w, math.log(max(total, 1) / n)) for w, n in counts.items())
        self.longest, self.rarest = max(map(len, self), default=0), max(self.values(), default=10.0)


def costs(pages: DataFrame) -> Words:
    """The words of two letters or more with LEAST_SHARE of all, found twice or more: 1 / LEAST_SHARE words at most."""
    words = staged(word_counts(pages).where("length(word) > 1"), "url-words")
    whole = words.agg(F.sum("n")).first()[0] or 0
    rows = words.where((F.col("n") > 1) & (F.col("n") >= LEAST_SHARE * whole)).collect()
    return Words({r.word: r.n for r in rows}, whole)


def segment(name: str, cost: Words) -> list[str]:
    """The likeliest split of a name into words, by Viterbi. A piece that is no word may have any length, at UNKNOWN more than the rarest word and LETTER a letter."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    # the likeliest way to be inside an unknown piece: what it costs without its letters, and where it began
    open_ = (cost.rarest + UNKNOWN, 0)
    for end in range(1, len(name) + 1):
        options = [(open_[0] + LETTER * end, open_[1])]
        for start in range(max(0, end - cost.longest), end):
            if (c := cost.get(name[start:end])) is not None:
                options.append((best[start][0] + c, start))
        best.append(min(options))
        open_ = min(open_, (best[end][0] + cost.rarest + UNKNOWN - LETTER * end, end))
    out, end = [], len(name)
    while end:
        out.append(name[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


class Tokens:
    """Words of hosts (h:) and paths (p:); splits seen before are kept, emptied when they fill ``room`` letters."""

    def __init__(self, cost: Words, room: int = 1 << 21):
        self.cost, self.seen, self.size, self.room = cost, {}, 0, room

    def split(self, name: str) -> list[str]:
        got = self.seen.get(name)
        if got is None:
            got = segment(name, self.cost)
            self.size += len(name) + 50
            if self.size > self.room:
                self.seen, self.size = {}, len(name) + 50
            self.seen[name] = got
        return got

    def __call__(self, host: str, path: str) -> list[str]:
        return [kind + w for kind, text in (("h:", host), ("p:", path)) for name in _LETTERS.findall(text.lower()) for w in self.split(name)]


class Bayes:
    """Multinomial naive Bayes: log-odds for block of each word of (word -> (blocked, allowed)), classes by their numbers of urls."""

    def __init__(self, words: dict[str, tuple[float, float]], urls: tuple[float, float], totals: tuple[float, float], kinds: int):
        self.prior = math.log((urls[0] + 1) / (urls[1] + 1))
        low = [math.log(t + SMOOTH * max(1, kinds)) for t in totals]
        self.odds = {w: math.log(b + SMOOTH) - low[0] - math.log(a + SMOOTH) + low[1] for w, (b, a) in words.items()}

    def __call__(self, words: list[str]) -> float:
        return self.prior + sum(self.odds.get(w, 0.0) for w in words)


def learn(urls: DataFrame, cost: Words) -> Bayes:
    """The classifier from all urls (host, path, label): label is block, allow, or null for urls that don't teach.

    Words have LEAST_SHARE of all words of these urls at least; rarer ones count in the totals only.
    """
    bounded_batches(urls.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(cost)
        for b in batches:
            counts: Counter = Counter()
            for host, path, label in zip(*(b.column(k).to_pylist() for k in range(3))):
                counts.update((w, label == "block") for w in [*tokens(host, path), ""])
            words = list({w for w, _ in counts})
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([counts[w, k] for w in words], pa.int64()) for k in (True, False))], names=["word", "blocked", "allowed"])

    counted = urls.where("label is not null").select("host", "path", "label").mapInArrow(run, "word string, blocked long, allowed long")
    sums = staged(counted.groupBy("word").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a")), "url-features")
    whole = sums.where("word <> ''").agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count(F.lit(1))).first()
    rows = sums.where((F.col("word") == "") | (F.col("b") + F.col("a") >= LEAST_SHARE * (whole[0] + whole[1]))).collect()
    words = {r.word: (float(r.b), float(r.a)) for r in rows}
    return Bayes(words, words.pop("", (0.0, 0.0)), (float(whole[0]), float(whole[1])), whole[2])


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    The longest rule that fits a url decides. Others are blocked if the naive Bayes log-odds of their words, score, are
    over 0. Names are split into words by a unigram model of the texts of all pages. The classifier learns from all urls that
    a rule decides, with the rule's verdict as label, or from ``labels`` (url, label: block or allow) where given. So a url
    without a rule goes by the company that its words keep; without any label, or without known words and with as many urls of either label, it is allowed. Null
    urls and urls without ``://`` have empty host and path and no words. Null and
    repeated ids keep their rows; other columns are ignored, an empty table gives no rows. What reaches the driver is bounded by LEAST_SHARE.
    """
    def cut(df: DataFrame, *more: str) -> DataFrame:
        host, path = split_url(F.col("url"))
        return df.select(*more, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))

    src = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    urls = cut(src, "page_id").withColumn("found", rule_for(rules)).select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("given"))
    cost = costs(pages)
    taught = urls.select("host", "path", F.col("given").alias("label")) if labels is None else cut(labels.select(F.col("url").cast("string"), "label"), "label")
    bayes = learn(taught, cost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(cost)
        for b in batches:
            score = [bayes(tokens(h, p)) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*b.schema.names, "score"])

    got = urls.mapInArrow(run, "page_id long, host string, path string, rule string, given string, score double")
    verdict = F.coalesce("given", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return got.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
