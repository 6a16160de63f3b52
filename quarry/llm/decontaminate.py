"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, table, worker_store

#: Tokens of a seed, which is the shortest tile too; share of an item's tokens under tiles that counts as a leak.
SEED_TOKENS, COVERAGE = 5, 0.5
#: Seeds that are sent to every task at most; with more, seeds are joined by a shuffle.
BROADCAST_SEEDS = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = re.compile(r"\w+")
_RESULT = "doc_id long, item_id long, item_tokens int, covered int, tiles int"


class Codes(dict):
    """Token to 64-bit code; emptied when full, so a task holds so many tokens at most."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[token] = code = xxhash.xxh64_intdigest(token.encode("utf-8", "replace"))
        return code


def tokens(text: str | None, codes: Codes | None = None) -> np.ndarray:
    """The codes of a text's words, lower-cased: runs of letters, digits and underscores."""
    codes = Codes() if codes is None else codes
    text = (text or "").lower()
    return np.fromiter((codes[m[0]] for m in _WORD.finditer(text)), dtype=np.uint64)


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """The Karp-Rabin hash of every run of n codes, modulo 2**64."""
    if len(codes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = codes[: len(codes) - n + 1].copy()
    for k in range(1, n):
        out *= _BASE
        out += codes[k : len(codes) - n + 1 + k]
    return out


class _Side:
    """One side of a tiling: Karp-Rabin hashes of any run, from sums over beginnings, and which tokens are still free."""

    def __init__(self, codes: np.ndarray, free: np.ndarray):
        down = np.full(len(codes) + 1, _INVERSE, dtype=np.uint64)
        down[0] = 1
        self.up = np.full(len(codes) + 1, _BASE, dtype=np.uint64)
        self.up[0] = 1
        self.up = np.multiply.accumulate(self.up)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(codes * np.multiply.accumulate(down)[:-1], dtype=np.uint64)))
        self.free = free

    def starts(self, n: int) -> np.ndarray:
        """Where runs of n free tokens start."""
        taken = np.concatenate(([0], np.cumsum(~self.free)))
        return np.flatnonzero(taken[n:] == taken[:-n]) if n < len(taken) else np.zeros(0, dtype=np.int64)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * self.up[at]


def tile(doc: np.ndarray, item: np.ndarray, shortest: int = SEED_TOKENS, seeds: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length) of tiles, longest first.

    The longest run of free tokens on both sides with equal Karp-Rabin hashes, checked token by token, is marked, ties to the earlier
    start in the item and then in the document, and so on while one has ``shortest`` tokens. Each token is used once
    on either side, so passages in another order still count and repeats don't. Lengths are searched by halving, as a run
    of n holds runs of n - 1. Only the document's tokens under common seeds (``seeds``: its rolling hashes) are held; time is
    in proportion to them and the tiles, memory to them, however repetitive the texts are.
    """
    seeds, known = rolling(doc, shortest) if seeds is None else seeds, np.unique(rolling(item, shortest))
    if not len(seeds) or not len(known):
        return []
    at = np.flatnonzero(known[np.minimum(np.searchsorted(known, seeds), len(known) - 1)] == seeds)
    if not len(at):
        return []
    under = np.zeros(len(doc) + 1, dtype=np.int64)
    np.add.at(under, at, 1)
    np.add.at(under, at + shortest, -1)
    held = np.flatnonzero(np.cumsum(under[:-1]) > 0)
    # a token that isn't held parts those that don't follow each other
    gaps = np.flatnonzero(np.diff(held) > 1) + 1
    place = np.insert(held, gaps, -1)
    d = _Side(np.where(place >= 0, doc[place], 0).astype(np.uint64), place >= 0)
    i = _Side(item, np.ones(len(item), dtype=bool))

    def met(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, starts in the item, starts in the document) of common runs of n, the item's first starts only."""
        ours, first = np.unique(i.hashes(own := i.starts(n), n), return_index=True)
        theirs = d.hashes(at := d.starts(n), n)
        if not len(ours) or not len(theirs):
            return ours[:0], own[:0], at[:0]
        spot = np.minimum(np.searchsorted(ours, theirs), len(ours) - 1)
        same = ours[spot] == theirs
        return theirs[same], own[first[spot[same]]], at[same]

    tiles: list[tuple[int, int, int]] = []
    most = len(item)
    while True:
        low, high, best = shortest, min(most, len(item)), None
        n = high if tiles else (low + high + 1) // 2  # after a tile another one as long is likely
        while low <= high:
            found = met(n)
            if len(found[0]):
                low, best = n + 1, (n, found)
            else:
                high = n - 1
            n = (low + high + 1) // 2
        if best is None:
            return tiles
        most, (_, si, sd) = best
        s, t = min(zip(si.tolist(), sd.tolist()))
        if (item[s : s + most] == doc[place[t] : place[t] + most]).all():
            tiles.append((s, int(place[t]), most))
            i.free[s : s + most] = False
        d.free[t : t + most] = False


def _scored(doc_id: int | None, doc: np.ndarray, items: list[tuple[int, np.ndarray]], shortest: int) -> list[tuple]:
    out, seeds = [], {}
    for item_id, item in items:
        n = min(shortest, len(item))
        if n not in seeds:
            seeds[n] = rolling(doc, n)
        if tiles := tile(doc, item, n, seeds[n]):
            out.append((doc_id, item_id, len(item), sum(t[2] for t in tiles), len(tiles)))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "item_id", "item_tokens", "covered", "tiles"])


def overlaps(docs: DataFrame, items: DataFrame, shortest: int = SEED_TOKENS, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, item_tokens, covered, tiles) of every pair that shares a seed.

    Items shorter than a seed have their whole length as seed; items without tokens, null texts and
    pairs without a common seed give no row. Rows with null ids take part and keep the null. Repeated rows
    each count. While the benchmark has ``broadcast_seeds`` seeds or fewer, its tokens go to every task and documents
    are read once; beyond that, seeds and documents meet in a shuffle join on distinct seeds of each document.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bench = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    # every word but the last of an item can start a seed, and white space or signs separate words
    most = bench.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    if most <= 8 * broadcast_seeds:
        known = [(r.item_id, tokens(r.text)) for r in bench.collect()]
        if sum(len(t) for _, t in known) <= broadcast_seeds:
            return _by_broadcast(src, [x for x in known if len(x[1])], shortest)
    return _by_shuffle(src, bench, shortest)


def _by_broadcast(src: DataFrame, known: list[tuple[int, np.ndarray]], shortest: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("decontaminate")
        lengths = sorted({min(shortest, len(t)) for _, t in known})
        owners: dict[int, list[set]] = {n: defaultdict(set) for n in lengths}
        for k, (_, t) in enumerate(known):
            n = min(shortest, len(t))
            for h in rolling(t, n).tolist():
                owners[n][h].add(k)
        sieve = {}
        for n in lengths:
            sieve[n] = np.zeros(1 << 22, dtype=bool)
            sieve[n][np.fromiter(owners[n], dtype=np.uint64) >> np.uint64(42)] = True
        codes = Codes()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc, met = tokens(text, codes), set()
                for n in lengths:
                    h = rolling(doc, n)
                    for x in np.unique(h[sieve[n][h >> np.uint64(42)]]).tolist():
                        met |= owners[n].get(x, set())
                rows += _scored(doc_id, doc, [known[k] for k in sorted(met)], shortest)
            if rows:
                yield _batch(rows)

    return src.mapInArrow(run, _RESULT)


def _by_shuffle(src: DataFrame, bench: DataFrame, shortest: int) -> DataFrame:
    def lengths_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({min(shortest, len(tokens(t))) for t in b.column(0).to_pylist()}), pa.int32())], names=["n"])

    # one of shortest values at most
    lengths = sorted(r.n for r in bench.select("text").mapInArrow(lengths_of, "n int").where("n > 0").distinct().collect())

    def seeds(own: list[int]):
        """A map that gives the distinct seeds of each text: of the lengths ``own``, or of the one that an item has."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = Codes()
            for b in batches:
                lists = []
                for text in b.column(1).to_pylist():
                    t = tokens(text, codes)
                    found = [rolling(t, n) for n in own or [max(1, min(shortest, len(t)))]]
                    lists.append(np.unique(np.concatenate(found)).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["id", "text", "seeds"])

        return run

    kind = "id long, text string, seeds array<long>"
    bench_seeds = bench.mapInArrow(seeds([]), kind).select(F.col("id").alias("item_id"), F.explode("seeds").alias("seed"))
    doc_seeds = src.mapInArrow(seeds(lengths or [shortest]), kind).select(F.col("id").alias("doc_id"), F.xxhash64("text").alias("key"), F.explode("seeds").alias("seed"))
    pairs = doc_seeds.join(bench_seeds, "seed").select(F.col("doc_id").alias("p_doc"), F.col("key").alias("p_key"), F.col("item_id").alias("p_item")).distinct()
    texts = src.select(F.col("doc_id").alias("t_doc"), "text", F.xxhash64("text").alias("t_key"))
    both = pairs.join(texts, F.col("p_doc").eqNullSafe(F.col("t_doc")) & (F.col("p_key") == F.col("t_key"))).select("p_doc", "text", "p_item")
    known = bench.select(F.col("item_id").alias("b_item"), F.col("text").alias("item"))
    both = both.join(known, F.col("p_item").eqNullSafe(F.col("b_item"))).select("p_doc", "text", "p_item", "item")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, item_id, item in zip(*(b.column(k).to_pylist() for k in range(4))):
                rows += _scored(doc_id, tokens(text), [(item_id, tokens(item))], shortest)
            if rows:
                yield _batch(rows)

    return both.mapInArrow(score, _RESULT)


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, **how) -> DataFrame:
    """The pairs of ``overlaps`` whose tiles cover ``coverage`` of the item's tokens or more."""
    share = F.col("covered") / F.col("item_tokens")
    return overlaps(docs, items, **how).withColumn("coverage", share).where(F.col("coverage") >= coverage)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
