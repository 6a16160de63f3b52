"""Mixing sources to target weights: Pfair windows per block, interleaved by earliest deadline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import placed_rows, quoted, staged, table

#: Documents of a block, and rows in a bucket of the numbering at the average.
BLOCK_DOCS, BUCKET_ROWS = 64, 512
#: Blocks in a cycle of the source with the largest weight, for weights taken from the data.
UNITS = 10


def _tempered(counts: DataFrame) -> DataFrame:
    """Weights in whole blocks a cycle: the square root of a source's rows, the largest being UNITS."""
    share = F.sqrt(F.col("n") / F.max("n").over(W.partitionBy(F.lit(0))))
    return counts.select("key", "n", F.greatest(F.lit(1), F.round(share * UNITS)).cast("int").alias("k"))


def schedule(counts: DataFrame) -> DataFrame:
    """The slots of all cycles alike: (key, first, last, base, size, slots).

    ``counts`` has one row for each source: key, blocks, k (its blocks in a full cycle). In every cycle a source that still has
    blocks gives k of them, or what it has left. Cycles first..last are alike, have ``size`` slots each and begin at slot
    ``base``; slots[j] is the slot of the source's block j of such a cycle. Within a cycle of D slots, block
    i of n of a source is released at floor((i-1) D / n) and due at ceil(i D / n); slot by slot the
    released block with the earliest deadline goes, ties to the larger weight, then by name. At every slot a source is
    less than one block from its weight's share. One row per source is all that is scheduled at once.
    """
    cycles = counts.select("key", "blocks", "k", F.expr("cast(blocks div k as bigint)").alias("full"), F.expr("cast(blocks % k as int)").alias("rest"))
    points = cycles.select(F.explode(F.array(F.lit(0).cast("long"), "full", F.col("full") + 1)).alias("first")).distinct()
    spans = points.withColumn("last", F.lead("first").over(W.partitionBy(F.lit(0)).orderBy("first")) - 1).where("last is not null")
    part = F.when(F.col("first") < F.col("full"), F.col("k")).when(F.col("first") == F.col("full"), F.col("rest")).otherwise(0)
    # a span meets the sources that go on to its first cycle: one row for each, sources and spans being few
    per = spans.join(cycles, F.col("first") <= F.col("full")).select("first", "last", "key", part.alias("n")).where("n > 0")
    row = per.groupBy("first", "last").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "key", "n"))).alias("s"), F.sum("n").cast("int").alias("size"))
    ready = "filter(transform(s, (x, j) -> named_struct('due', cast(ceil((acc.done[j] + 1) * size / x.n) as int), 'j', j)), y -> acc.done[y.j] < s[y.j].n and floor(acc.done[y.j] * size / s[y.j].n) <= t)"
    step = f"transform(array(array_min({ready}).j), p -> named_struct('done', transform(acc.done, (c, j) -> if(j = p, c + 1, c)), 'slots', concat(acc.slots, array(p))))[0]"
    plan = F.expr(f"aggregate(sequence(0, size - 1), named_struct('done', array_repeat(0, size(s)), 'slots', cast(array() as array<int>)), (acc, t) -> {step}).slots")
    length = F.col("size").cast("long") * (F.col("last") - F.col("first") + 1)
    base = F.sum(length).over(W.partitionBy(F.lit(0)).orderBy("first")) - length
    flat = row.select("first", "last", "size", "s", plan.alias("plan"), base.alias("base")).select("first", "last", "size", "base", "plan", F.posexplode("s").alias("j", "x"))
    slots = F.expr("filter(sequence(0, size - 1), t -> plan[t] = j)")
    return flat.select(F.col("x.key").alias("key"), "first", "last", "base", "size", slots.alias("slots"))


def _hashable(docs: DataFrame, own: Callable[[str], Column]) -> Column:
    """A hash of a whole row, its columns by ``own``; those that Spark can't hash (maps, variants) go in as JSON."""
    odd = [f.name for f in docs.schema if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString()]
    plain = [own(c) for c in docs.columns if c not in odd]
    return F.xxhash64(*plain, *([F.to_json(F.struct(*[own(c) for c in odd]))] if odd else []), F.lit(0))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_docs: int = BLOCK_DOCS, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """All rows of ``docs`` with mix_block (its number in its source), mix_slot (its place in the interleaving) and mix_rank (within the block).

    ``weights`` gives whole blocks a cycle for each source; sources that it leaves out, and all without it, are weighted by the square
    root of their rows. No row is dropped: when a source ends, the others keep their proportions. A null source is
    a source of its own. Within a source, rows go by a hash of id, row and place in the files, so that rows alike in every column are spread too.
    An empty table gives an empty result. Columns of ``docs`` called mix_block, mix_slot and mix_rank are replaced; all others are kept, whatever their names and types.

    Rows are numbered within a source by buckets of that hash, so that no task gets a source whole, nor all rows of a null or
    repeated id, alike or not: counts of (source, bucket) give each bucket's first number. The schedule has a row for each source and
    each cycle span in which it has blocks, so at most the sources times the different ends of sources; it is written to the shared folder, so
    Spark knows its size and broadcasts it only if that is small, and joins it by source otherwise.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_rank")
    placed = placed_rows(docs)
    own = lambda c: F.col(f"own.{quoted(c)}")
    source, one = own(source_col), _hashable(docs, own)
    key: Column = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))
    h = F.xxhash64(own(id_col).cast("string"))
    buckets = max(1, docs.count() // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64(h, one, "place"), F.lit(buckets))
    rows = placed.select("own", "place", key.alias("key"), h.alias("h"), one.alias("one"), bucket.alias("bucket"))
    narrow = rows.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n"))
    firsts = narrow.select("key", "bucket", (F.sum("n").over(W.partitionBy("key").orderBy("bucket")) - F.col("n")).alias("first_row"))
    totals = _tempered(narrow.groupBy("key").agg(F.sum("n").alias("n")))
    if weights:
        given = F.create_map(*[F.lit(x) for s, k in sorted(weights.items()) for x in ("s" + s, int(k))])
        totals = totals.withColumn("k", F.coalesce(F.element_at(given, F.col("key")), "k"))
    blocks = F.ceil(F.col("n") / block_docs).cast("long").alias("blocks")
    counts = staged(totals.select("key", "k", blocks), "mix-counts")
    plan = staged(schedule(counts).join(counts.select("key", "k"), "key"), "mix-plan")
    order = W.partitionBy("key", "bucket").orderBy("h", "one", "place")
    numbered = rows.withColumn("at", F.row_number().over(order) - 1).join(firsts, ["key", "bucket"]).withColumn("at", F.col("at") + F.col("first_row"))
    numbered = numbered.select("own", "key", F.expr(f"cast(at div {block_docs} as bigint)").alias("block"), F.expr(f"cast(at % {block_docs} as int)").alias("rank"))
    placed = numbered.join(plan, "key").where("block div k between first and last")
    slot = F.expr("base + (block div k - first) * size + slots[int(block % k)]")
    return placed.select("own.*", F.col("block").alias("mix_block"), slot.alias("mix_slot"), F.col("rank").alias("mix_rank"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs)
