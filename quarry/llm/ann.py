"""Approximate nearest neighbours: an inverted file of product-quantised residuals, reranked exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, staged, table

#: Vectors that the index is fitted on at most: those whose ids hash lowest. Centroids at most.
SAMPLE, MOST_LISTS = 20_000, 1024
#: Components of a subspace, codewords of a subspace, vectors in a block, queries in a pile, parts that the blocks a pile meets are dealt into.
SUB, CODES, BLOCK, PILE, PARTS = 4, 256, 4096, 64, 8
#: Share of a sample's true neighbours that the lists probed must hold, and candidates of a query that are reranked.
HELD, RERANKED = 0.97, 400


class Index(NamedTuple):
    """Coarse centroids [lists, dim] and codewords [subspaces, codes, SUB] of the residuals; dim padded to whole subspaces."""

    centroids: np.ndarray
    words: np.ndarray
    dim: int


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from k distinct rows; an empty cluster takes the row farthest from its centre."""
    start = np.unique(x, axis=0)
    centres = start[np.random.default_rng(seed).permutation(len(start))[:k]].copy()
    for _ in range(rounds):
        d = _squares(x, centres)
        own = d.argmin(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        far = iter(np.argsort(-d.min(axis=1), kind="stable"))
        for c in range(len(centres)):
            centres[c] = sums[c] / counts[c] if counts[c] else x[next(far)]
    return centres


def _padded(x: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def fit(sample: np.ndarray, total: int) -> Index:
    """Fit on sampled vectors; the number of lists follows the square root of ``total``, MOST_LISTS at most."""
    dim = math.ceil(sample.shape[1] / SUB) * SUB
    x = _padded(sample.astype(np.float64), dim)
    centroids = kmeans(x, max(1, min(MOST_LISTS, int(math.sqrt(total)), len(x) // 8 or 1)), seed=1)
    rest = x - centroids[_squares(x, centroids).argmin(axis=1)]
    words = [kmeans(rest[:, s : s + SUB], CODES, seed=2 + s) for s in range(0, dim, SUB)]
    most = max(len(w) for w in words)
    return Index(centroids, np.stack([np.concatenate([w, np.repeat(w[:1], most - len(w), axis=0)]) for w in words]), dim)


def probed_lists(sample: np.ndarray, index: Index, k: int, held: float = HELD, asked: int = 200) -> int:
    """How many lists, nearest first, hold the share ``held`` of the true neighbours of sampled vectors in the sample.

    Few where vectors form clusters, most of them where they don't. Neighbours within a sample are farther off than
    those within all vectors, so the number errs on the large side.
    """
    x = _padded(sample.astype(np.float64), index.dim)
    q = x[:: max(1, len(x) // asked)][:asked]
    d = _squares(q, x)
    near = np.argsort(d, axis=1, kind="stable")[:, 1 : k + 1]
    if not near.size:
        return len(index.centroids)
    own = _squares(x, index.centroids).argmin(axis=1)
    place = np.argsort(np.argsort(_squares(q, index.centroids), axis=1, kind="stable"), axis=1)
    return int(np.quantile(np.take_along_axis(place, own[near], axis=1), held, method="higher")) + 1


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows with an id and a vector that isn't null, empty, zero, or with null or non-finite components."""
    v = F.col(vec_col).cast("array<double>")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where("id is not null and vec is not null")
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    return src.where(F.coalesce(sound, F.lit(False)))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def assigned(vectors: DataFrame, index: Index, width: int) -> DataFrame:
    """(id, list, code) of every vector: its nearest centroid, and the codewords of its residual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _padded(_matrix(b.column(1), width), index.dim)
            own = _squares(x, index.centroids).argmin(axis=1)
            rest = x - index.centroids[own]
            codes = np.stack([_squares(rest[:, SUB * s : SUB * s + SUB], w).argmin(axis=1) for s, w in enumerate(index.words)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "list", "code"])

    return vectors.mapInArrow(run, "id long, list int, code binary")


def _piles(waiting: dict[int, int], centroids: np.ndarray) -> dict[int, tuple[int, int]]:
    """First pile and number of piles of the queries nearest to each list, from how many there are.

    Lists are walked from each to its nearest one left, so queries of a pile ask for much the same lists. A list with more
    than PILE queries has piles of its own; others fill a pile together.
    """
    left, out, pile, size = sorted(waiting), {}, 0, 0
    at = left[0] if left else None
    while left:
        left.remove(at)
        n = waiting[at]
        if size and size + n > PILE:
            pile, size = pile + 1, 0
        out[at] = (pile, max(1, math.ceil(n / PILE)))
        if n >= PILE:
            pile, size = pile + out[at][1], 0
        else:
            size += n
        if left:
            at = left[int(_squares(centroids[[at]], centroids[left])[0].argmin())]
    return out


class Nearest:
    """The nearest ``most`` candidates of each query of a pile over all blocks met, ties to the smaller id."""

    def __init__(self, index: Index, asking: np.ndarray, vecs: np.ndarray, lists: list[np.ndarray], most: int):
        self.index, self.asking, self.vecs, self.most = index, asking, vecs, most
        self.by_list: dict[int, list[int]] = {}
        for q, own in enumerate(lists):
            for c in own.tolist():
                self.by_list.setdefault(c, []).append(q)
        self.ids = [np.zeros(0, dtype=np.int64) for _ in asking]
        self.far = [np.zeros(0) for _ in asking]
        self.tables: tuple[int, np.ndarray] | None = None

    def meet(self, c: int, ids: np.ndarray, codes: np.ndarray) -> None:
        asked = self.by_list.get(c, [])
        if not asked:
            return
        if self.tables is None or self.tables[0] != c:
            rest = (self.vecs[asked] - self.index.centroids[c]).reshape(len(asked), len(self.index.words), 1, SUB)
            self.tables = c, ((self.index.words[None] - rest) ** 2).sum(axis=3)
        for q, table in zip(asked, self.tables[1]):
            d = np.zeros(len(ids))
            for s in range(table.shape[0]):
                d += table[s, codes[:, s]]
            near = ids != self.asking[q]
            if len(self.far[q]) == self.most:
                near &= d <= self.far[q][-1]
            if near.any():
                both, far = np.concatenate((self.ids[q], ids[near])), np.concatenate((self.far[q], d[near]))
                best = np.lexsort((both, far))[: self.most]
                self.ids[q], self.far[q] = both[best], far[best]

    def batch(self) -> pa.RecordBatch:
        again = np.repeat(self.asking, [len(x) for x in self.ids])
        return pa.RecordBatch.from_arrays([pa.array(again), pa.array(np.concatenate(self.ids)), pa.array(np.concatenate(self.far))], names=["query_id", "vec_id", "near"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", reranked: int = RERANKED, held: float = HELD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for each query, by Euclidean distance.

    ``queries`` are rows of the same columns. A vector whose id is the query's is no candidate. Nulls, zero vectors and vectors with null
    or non-finite components take no part, nor do vectors whose length isn't the commonest, as no distance is defined between lengths. Of repeated ids the nearest
    vector counts. Ties go to the smaller id. An empty table gives no rows. Other columns are ignored.

    Every vector is in the index: in the list of its centroid, coded by its residual. Lists are stored in blocks of about BLOCK
    vectors, so a list that holds a third of all is many blocks. A query probes as many lists, nearest first, as hold the share ``held`` of a sample's
    true neighbours, and on until they have four times the reranked candidates. Queries that are near each other form a pile of about
    PILE, and a pile meets the blocks of all lists that it probes in PARTS streams. There, distance tables give approximate
    distances and each query keeps its nearest ``reranked``, so rows are in proportion to the queries, whatever the lists
    hold. A query's candidates of all streams are cut to ``reranked`` again and measured on the original vectors.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    base, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    kind = "query_id long, rank int, vec_id long, score double"
    widths = base.groupBy(F.size("vec").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    if widths is None:
        return spark.createDataFrame([], kind)
    width, total = widths.w, widths.n
    base, asked = base.where(F.size("vec") == width), asked.where(F.size("vec") == width)
    share = min(1.0, 4 * SAMPLE / total)
    h = F.xxhash64("id")
    drawn = base.where(h <= min(2**63 - 1, int(share * 2**64) - 2**63)).orderBy(h, "id").limit(SAMPLE).select("vec").toArrow()
    sample = _matrix(drawn.column(0).combine_chunks(), width) if drawn.num_rows else np.ones((1, width))
    index = fit(sample, total)
    least = probed_lists(sample, index, k, held)
    coded = staged(assigned(base, index, width), "ann-index")
    sizes = dict(coded.groupBy("list").count().collect())  # one row a list: MOST_LISTS at most
    n_lists = len(index.centroids)
    rows = np.array([sizes.get(c, 0) for c in range(n_lists)])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            order = np.argsort(_squares(_padded(_matrix(b.column(1), width), index.dim), index.centroids), axis=1, kind="stable")
            enough = (np.cumsum(rows[order], axis=1) < 4 * reranked).sum(axis=1) + 1
            n = np.minimum(n_lists, np.maximum(enough, least))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([o[:m].tolist() for o, m in zip(order, n)], pa.list_(pa.int32()))], names=["id", "vec", "lists"])

    near = staged(asked.mapInArrow(probes, "id long, vec array<double>, lists array<int>"), "ann-queries")
    waiting = dict(near.groupBy(F.col("lists")[0].alias("list")).count().collect())  # one row a list
    if not waiting:
        return spark.createDataFrame([], kind)
    piles = _piles(waiting, index.centroids)
    firsts, counts = (F.create_map(*[F.lit(x) for c, p in piles.items() for x in (c, p[i])]) for i in (0, 1))
    first_list = F.col("lists")[0]
    pile = (F.element_at(firsts, first_list) + F.pmod(F.xxhash64("id"), F.element_at(counts, first_list))).cast("int")
    asking = near.withColumn("pile", pile).groupBy("pile").agg(F.collect_list(F.struct("id", "vec", "lists")).alias("asking"))
    salts = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, math.ceil(n / BLOCK))])
    blocks = coded.withColumn("salt", F.pmod(F.xxhash64("id"), F.element_at(salts, F.col("list")))).groupBy("list", "salt").agg(F.collect_list(F.struct("id", "code")).alias("rows"))
    wanted = asking.select("pile", F.explode(F.array_distinct(F.flatten("asking.lists"))).alias("list"))
    met = wanted.join(blocks, "list").select("pile", F.pmod(F.xxhash64("list", "salt"), F.lit(PARTS)).cast("int").alias("part"), "list", "salt", F.col("rows.id").alias("ids"), F.col("rows.code").alias("codes"))
    heads = asking.select("pile", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.lit(-1).alias("list"), F.lit(-1).cast("long").alias("salt"), "asking")
    streams = heads.unionByName(met, allowMissingColumns=True).repartition("pile", "part").sortWithinPartitions("pile", "part", "list", "salt")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Nearest | None = None
        for b in batches:
            lists, heads, ids, codes = (b.column(n) for n in ("list", "asking", "ids", "codes"))
            for row in range(b.num_rows):
                c = lists[row].as_py()
                if c < 0:  # the head of a stream: its queries
                    if held:
                        yield held.batch()
                    own = heads[row].values
                    vecs = own.field("vec").flatten().to_numpy().reshape(-1, width)
                    held = Nearest(index, own.field("id").to_numpy(), _padded(vecs, index.dim), [np.array(x) for x in own.field("lists").to_pylist()], reranked)
                    continue
                block = ids[row].values.to_numpy()
                coding = np.frombuffer(b"".join(codes[row].as_py()), dtype=np.uint8).reshape(len(block), -1)
                held.meet(c, block, coding)
        if held:
            yield held.batch()

    found = streams.select("list", "asking", "ids", "codes").mapInArrow(tables, "query_id long, vec_id long, near double")
    kept = found.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("near", "vec_id"))).where(F.col("r") <= reranked).select("query_id", "vec_id").distinct()
    right = base.select(F.col("id").alias("vec_id"), F.col("vec").alias("v"))
    left = asked.select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    pairs = kept.join(right, "vec_id").join(left, "query_id")
    score = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    exact = pairs.select("query_id", "vec_id", score.alias("score")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = exact.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
