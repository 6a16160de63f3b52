"""Exact repeats by suffix sorting: sampled suffixes are sorted by their contexts, the others placed through them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, input_splits, shared_dir, staged, table

#: Bytes of a repeat, of a sample's core, and positions of which one at least is sampled: LENGTH = CORE + REACH - 1.
LENGTH, CORE, REACH = 200, 50, 151
#: Windows of a text handled at once.
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MOD = 1 << 64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Polynomial hashes modulo 2**64 of any piece of a text, from sums over its beginnings."""

    def __init__(self, size: int):
        rng = np.random.default_rng(7)
        self.bytes = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = _powers(_BASE, size + 1), _powers(pow(_BASE, -1, _MOD), size + 1)

    def sums(self, t: np.ndarray) -> np.ndarray:
        return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(self.bytes[t] * self.down[: len(t)], dtype=np.uint64)))

    def pieces(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (sums[end] - sums[start]) * self.up[start]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


_hashers: dict[int, Hasher] = {}


def hasher(size: int) -> Hasher:
    size = 1 << max(16, (size + 1).bit_length())
    if size not in _hashers:
        _hashers.clear()
        _hashers[size] = Hasher(size)
    return _hashers[size]


def samples(t: np.ndarray) -> tuple[np.ndarray, ...]:
    """(core hash, hash of the span, place, first, last) of the sampled positions of a text.

    Every window of LENGTH bytes chooses the position in it whose core has the smallest hash, the first of equal
    ones. It depends on the window's bytes only, so equal windows choose alike: the sample does what residues of a
    difference cover do, with fewer positions. A sampled position's windows start at first..last; its span is all their bytes.
    """
    n = len(t)
    if n < LENGTH:
        return (np.zeros(0, dtype=np.uint64),) * 2 + (np.zeros(0, dtype=np.int64),) * 3
    h = hasher(n)
    sums = h.sums(t)
    at = np.arange(n - CORE + 1)
    core = h.pieces(sums, at, at + CORE)
    value, place, width = core, at, 1
    while 2 * width <= REACH:
        left, right = value[:-width], value[width:]
        later = right < left
        value, place = np.where(later, right, left), np.where(later, place[width:], place[:-width])
        width *= 2
    rest = REACH - width
    left, right = value[: len(value) - rest], value[rest:]
    chosen = np.where(right < left, place[rest:], place[: len(place) - rest])
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    last = np.concatenate((first[1:], [len(chosen)])) - 1
    spot = chosen[first]
    span = h.pieces(sums, first, last + LENGTH) + ((spot - first) * 256 + (last - first)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return core[spot], span, spot, first, last


def _sliced(t: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What ``samples`` gives for a whole text, ``step`` windows at a time, places counted from the text's beginning.

    A sampled position belongs to the slice with its first window. Each slice sees one window before it and REACH behind it, so it
    knows whether a position was chosen before, and up to its last window.
    """
    windows = len(t) - LENGTH + 1
    for at in range(0, max(0, windows), step):
        left = max(0, at - 1)
        core, span, s, lo, hi = samples(t[left : min(windows, at + step + REACH) + LENGTH - 1])
        own = (lo + left >= at) & (lo + left < at + step)
        yield core[own], span[own], s[own] + left, lo[own] + left, hi[own] + left


def _bytes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint8) for x in pc.cast(column, pa.large_binary()).to_pylist()]


def _anchors(texts: DataFrame, step: int) -> DataFrame:
    """(core, span, tid, s, lo, hi) of all sampled positions, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for tid, t in zip(b.column(0).to_pylist(), _bytes(b.column(1))):
                for core, span, s, lo, hi in _sliced(t, step):
                    if len(s):
                        for o, x in zip(out, (core.view(np.int64), span.view(np.int64), np.full(len(s), tid), s.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32))):
                            o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["core", "span", "tid", "s", "lo", "hi"])

    return texts.select("tid", "text").where(F.octet_length("text") >= LENGTH).mapInArrow(run, "core long, span long, tid long, s int, lo int, hi int")


_CONTEXT = "core long, tid long, s int, lo int, hi int, before binary, after binary"


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes before each wanted position, the nearest first, and from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for tid, text, spots in zip(b.column(0).to_pylist(), pc.cast(b.column(1), pa.large_binary()).to_pylist(), b.column(2).to_pylist()):
                for x in spots:
                    s = x["s"]
                    rows.append((x["core"], tid, s, x["lo"], x["hi"], text[max(0, s - REACH + 1) : s][::-1], text[s : s + LENGTH]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["core", "tid", "s", "lo", "hi", "before", "after"])

    lists = wanted.groupBy("tid").agg(F.collect_list(F.struct("core", "s", "lo", "hi")).alias("spots"))
    return texts.select("tid", "text").join(lists, "tid").mapInArrow(run, _CONTEXT)


def _matrix(column: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, column), dtype=np.int64, count=len(column))
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in column), dtype=np.uint8).reshape(len(column), width), size


def _common(m: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row and the next."""
    differ = m[1:] != m[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return np.minimum(first, np.minimum(size[1:], size[:-1]))


_FOUND = "tid long, s int, core long, lo int, hi int, l int, r int, pairs array<struct<l:int,r:int>>, edge boolean, before binary, after binary"


def _adjacent(contexts: DataFrame, by: str) -> DataFrame:
    """Compares each sampled suffix with the one before and behind it in the order of core and ``by``.

    Rows: how far the contexts agree with either neighbour (pairs), and at most (l bytes before, r from the position on). The
    first and last row of a partition carry their contexts, for a second round among these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row, whose next one isn't known yet
        before_held: tuple[int, int] | None = None
        start = True

        def out(rows: list[tuple], pairs: list[list[tuple[int, int]]], edges: list[bool]) -> pa.RecordBatch:
            core, tid, s, lo, hi, before, after = zip(*rows)
            said = [[{"l": l, "r": r} for l, r in p] for p in pairs]
            cols = [pa.array(tid, pa.int64()), pa.array(s, pa.int32()), pa.array(core, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array([max((x[0] for x in p), default=0) for p in pairs], pa.int32()), pa.array([max((x[1] for x in p), default=0) for p in pairs], pa.int32())]
            cols += [pa.array(said, pa.list_(pa.struct([("l", pa.int32()), ("r", pa.int32())]))), pa.array(edges, pa.bool_()), pa.array([x if e else None for x, e in zip(before, edges)], pa.binary()), pa.array([x if e else None for x, e in zip(after, edges)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["tid", "s", "core", "lo", "hi", "l", "r", "pairs", "edge", "before", "after"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = held + list(zip(*(c.to_pylist() for c in b.columns)))
            mb, nb = _matrix([x[5] for x in rows], REACH - 1)
            ma, na = _matrix([x[6] for x in rows], LENGTH)
            core = np.array([x[0] for x in rows])
            same = core[1:] == core[:-1]
            l, r = np.where(same, _common(mb, nb), 0).tolist(), np.where(same, _common(ma, na), 0).tolist()
            links: list[tuple[int, int] | None] = [before_held, *zip(l, r)]
            pairs = [[x for x in links[i : i + 2] if x and x[1]] for i in range(len(rows) - 1)]
            edges = [start and i == 0 for i in range(len(rows) - 1)]
            if pairs:
                yield out(rows[:-1], pairs, edges)
                start = False
            held, before_held = rows[-1:], links[-1]
        if held:
            yield out(held, [[before_held] if before_held and before_held[1] else []], [True])

    order = ["core", by, "tid", "s"]
    spark = contexts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_splits(spark, contexts))
    found = staged(contexts.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, _FOUND), "repeats-adjacent")
    # two rows of each partition at most
    ends = found.where("edge").select("core", "tid", "s", "lo", "hi", "before", "after").repartition(1).sortWithinPartitions(*order)
    return found.select("tid", "s", "core", "lo", "hi", "l", "r", "pairs").unionByName(ends.mapInArrow(run, _FOUND).select("tid", "s", "core", "lo", "hi", "l", "r", "pairs"))


def covers(texts: DataFrame, step: int = SLICE) -> DataFrame:
    """(tid, start, stop): bytes under windows of LENGTH that occur elsewhere; ``texts`` has tid (unique) and text (binary).

    1. Sampled positions whose core occurs once are dropped. 2. Those whose whole span occurs twice or more are covered
    with it; one of them goes on, as a partner for others. 3. The rest are sorted by core and what follows, and by core
    and what precedes; neighbours are compared. A window that starts ``a`` bytes before a sampled position is repeated if some
    other has the same ``a`` bytes before and LENGTH - a from there on. 4. Windows that the longest agreements on either side
    allow but no neighbour shows are compared in full within their core.
    """
    anchors = _anchors(texts, step)
    # counts are written before they are joined, so the joins stand alone and Spark can split a hot core or span
    again = staged(anchors.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"), "repeats-again")
    kept = staged(anchors.join(again, "core", "left_semi"), "repeats-anchors")
    kinds = staged(kept.groupBy("core", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tid", "s", "lo", "hi")).alias("rep")), "repeats-kinds")
    many = kinds.where("n > 1").select("core", "span")
    by_span = kept.join(many, ["core", "span"], "left_semi").select("tid", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("stop"))
    # a core all of whose spans occur again needs no more; of the others, one position of each span goes on
    open_cores = staged(kinds.where("n = 1").select("core").distinct(), "repeats-open")
    reps = kinds.join(open_cores, "core", "left_semi").select("core", "rep.tid", "rep.s", "rep.lo", "rep.hi")
    contexts = staged(_contexts(texts, reps), "repeats-contexts")
    both = _adjacent(contexts, "after").unionByName(_adjacent(contexts, "before"))
    one = both.groupBy("tid", "s").agg(F.first("core").alias("core"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.max("l").alias("l"), F.max("r").alias("r"), F.flatten(F.collect_list("pairs")).alias("pairs"))
    least, most = F.greatest(F.col("s") - F.col("hi"), F.lit(LENGTH) - F.col("r")), F.least(F.col("s") - F.col("lo"), F.col("l"))
    one = one.withColumns({"least": least, "most": most}).where("least <= most")
    shown = F.expr(f"filter(transform(pairs, x -> struct(greatest(least, {LENGTH} - x.r) as low, least(most, x.l) as high)), x -> x.low <= x.high)")
    one = staged(one.select("tid", "s", "core", "least", "most", F.array_distinct(shown).alias("shown")), "repeats-shown")
    by_neighbour = one.select("tid", "s", F.explode("shown").alias("x")).select("tid", (F.col("s") - F.col("x.high")).alias("start"), (F.col("s") - F.col("x.low") + LENGTH).alias("stop"))
    doubtful = one.select("core", F.explode(F.expr("filter(sequence(least, most), a -> not exists(shown, x -> a between x.low and x.high))")).alias("a")).distinct()
    windows = contexts.join(doubtful, "core").where("a <= length(before) and 200 - a <= length(after) and a between s - hi and s - lo".replace("200", str(LENGTH)))
    windows = windows.select("tid", "s", "core", "a", F.md5(F.concat(F.expr("substring(before, 1, a)"), F.expr(f"substring(after, 1, {LENGTH} - a)"))).alias("key"))
    twice = windows.groupBy("core", "a", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    in_full = windows.join(twice, ["core", "a", "key"]).select("tid", (F.col("s") - F.col("a")).alias("start"), (F.col("s") - F.col("a") + LENGTH).alias("stop"))
    return by_span.unionByName(by_neighbour).unionByName(in_full)


_DIGEST = "tid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", step: int = SLICE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A byte is removed if a string of LENGTH bytes over it also starts anywhere else, in any row or the same one; matches stay within
    a text. Null texts are empty; texts shorter than LENGTH keep all. Null and repeated ids keep their rows, and repeated rows
    remove each other. Texts are scanned ``step`` windows at a time. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = shared_dir(spark, "repeats-texts")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    docs.select(F.monotonically_increasing_id().alias("tid"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).write.option("compression", "zstd").parquet(path)
    texts = spark.read.schema("tid long, doc_id long, text binary").parquet(path)
    lists = staged(covers(texts, step).groupBy("tid").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "repeats-covers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for tid, doc_id, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pc.cast(b.column(2), pa.large_binary()).to_pylist(), b.column(3).to_pylist()):
                digest, at, removed, n = hashlib.sha256(), 0, 0, 0
                for start, stop in sorted((x["start"], x["stop"]) for x in spans or ()):
                    if start > at or not n:
                        digest.update(text[at:start])
                        n, removed, at = n + 1, removed + stop - start, stop
                    elif stop > at:
                        removed, at = removed + stop - at, stop
                digest.update(text[at:])
                rows.append((tid, doc_id, len(text), removed, n, digest.hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (*[pa.int64()] * 5, pa.string()))], names=["tid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    touched = texts.join(lists, "tid").select("tid", "doc_id", "text", "spans").mapInArrow(run, _DIGEST)
    whole = texts.select("tid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256")).join(lists.select("tid"), "tid", "left_anti")
    whole = whole.select("tid", "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256")
    return touched.unionByName(whole).drop("tid")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
