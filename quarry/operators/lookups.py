"""Joins: lookups with an order of preference, intervals, bands, as-of, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.needles import text_matches  # noqa: F401: one of the lookups


def pick_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    r = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", r).where("_rank = 1").drop("_rank")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key, numbered as ``rank``."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def first_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return pick_one(df, keys, *[F.asc(c) for c in order])


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return pick_one(df, keys, *[F.desc(c) for c in order])


def first_tier(df: DataFrame, tier: Column, keys: list[str] | None = None) -> DataFrame:
    """Rows of the lowest tier that has any, overall or by key; rows of a null tier never count."""
    tiered = df.withColumn("_tier", tier).where("_tier is not null")
    if keys:
        least = tiered.groupBy(*keys).agg(F.min("_tier").alias("_least"))
        return tiered.join(least, keys).where("_tier = _least").drop("_tier", "_least")
    return tiered.crossJoin(tiered.agg(F.min("_tier").alias("_least"))).where("_tier = _least").drop("_tier", "_least")  # one row


def lookup(df: DataFrame, table: DataFrame, on: list[str], value: str, default: Column) -> DataFrame:
    """Left join with a fallback: ``value`` of the table's row, else ``default``."""
    t = table.select(*on, F.col(value).alias("_value"))
    return df.join(t, on, "left").withColumn(value, F.coalesce("_value", default)).drop("_value")


def priority_coalesce(df: DataFrame, on: list[str], tiers: list[DataFrame], value: str, default: str) -> DataFrame:
    """Left joins with tables (on, value) in order of preference; the first value that isn't null counts."""
    for i, t in enumerate(tiers):
        df = df.join(t.select(*on, F.col(value).alias(f"_{i}")), on, "left")
    got = F.coalesce(*[F.col(f"_{i}") for i in range(len(tiers))], F.lit(default))
    return df.withColumn(value, got).drop(*[f"_{i}" for i in range(len(tiers))])


def containing(points: DataFrame, blocks: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """Every block that holds a point: inclusive at both ends, within equal keys.

    An equi join on (keys, level, bin): a block goes by its length to a level whose bins are as wide or up to twice so, and lies in
    two of them at most; a point looks into one bin of every level that has blocks. So candidates are in
    proportion to the results, and a hot key is split by its bins.
    """
    level = F.ceil(F.log2(F.greatest(F.col(end).cast("double") - F.col(start).cast("double"), F.lit(0.0)) + 1)).cast("int")
    cell = lambda c, k: F.expr(f"shiftright(cast(floor(`{c}`) as bigint), {k})")
    sized = blocks.where(F.col(start) <= F.col(end)).withColumn("_level", F.least(level, F.lit(62)))
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())  # 63 at most
    binned = sized.withColumn("_bin", F.explode(F.array_distinct(F.array(cell(start, "_level"), cell(end, "_level")))))
    looks = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_bin", cell(at, "_level"))
    return looks.join(binned, [*on, "_level", "_bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_level", "_bin")


def innermost(points: DataFrame, blocks: DataFrame, on: list[str], point_id: list[str], at: str, start: str, end: str) -> DataFrame:
    """The smallest block that holds a point, ties to the earlier start; points outside all blocks give no row."""
    return pick_one(containing(points, blocks, on, at, start, end), point_id, F.col(end) - F.col(start), F.col(start))


def nearest_in_band(left: DataFrame, right: DataFrame, on: list[str], left_id: list[str], a: str, b: str, low: float, high: float, *ties: str) -> DataFrame:
    """The right row nearest to each left row with b - a from low to high, ties to the smaller b, then by ``ties``.

    The nearest is the first at or after the band's near end, or the last at or before it; so two as-of looks find it, and no pairs
    are formed. Left rows are told apart by ``left_id``.
    """
    names = [c for c in right.columns if c not in on]
    one = right.where(F.col(b).isNotNull()).groupBy(*on, b).agg(F.min(F.struct(*[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(names)])).alias("_row"))
    near = min(max(0, low), high)
    sides = []
    for forward, wanted in ((True, near <= high and high >= 0), (False, low <= 0)):
        if wanted:
            from_ = near if forward else min(0, high)
            spots = left.withColumn("_at", F.col(a) + from_)
            found = asof(spots, one.select(*on, F.col(b).alias("_at"), F.struct(F.col(b).alias("b"), "_row").alias("_seen")), on, "_at", "_seen", forward=forward)
            sides.append(found.where((F.col("_seen.b") - F.col(a)).between(low, high)).drop("_at"))
    both = sides[0] if len(sides) == 1 else pick_one(sides[0].unionByName(sides[1]), left_id, F.abs(F.col("_seen.b") - F.col(a)), F.col("_seen.b"))
    return both.select(*left.columns, *[F.col(f"_seen._row._v{i}").alias(c) for i, c in enumerate(names)])


def ranges_to_next(df: DataFrame, on: list[str], start: str, last: int | None = None, name: str = "range_end") -> DataFrame:
    """Each row's range ends before the next row's start within its key; the last one's is ``last`` or open (null)."""
    nxt = F.lead(start).over(W.partitionBy(*on).orderBy(start))
    return df.withColumn(name, F.coalesce(nxt - 1, F.lit(last)))


def asof(left: DataFrame, right: DataFrame, on: list[str], at: str, value: str, strict: bool = False, forward: bool = False) -> DataFrame:
    """Each left row with ``value`` of the last right row at or before it (before it, if strict); null if there's none.

    With ``forward``, of the first right row at or after it. One union sorted once by key and place, so its cost doesn't depend on
    how many pairs there would be. Right rows at the same place go by value, the largest nearest. ``value`` may be a struct.
    """
    kind = right.schema[value].dataType
    l = left.select(*on, F.col(at).alias("_at"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"), F.lit(None).cast(kind).alias("_v"), F.lit(0 if strict else 1).alias("_k"))
    r = right.select(*on, F.col(at).alias("_at"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.col(value).alias("_v"), F.lit(1 if strict else 0).alias("_k"))
    place = F.col("_at").desc() if forward else F.col("_at").asc()
    w = W.partitionBy(*on).orderBy(place, F.col("_k"), F.col("_v")).rowsBetween(W.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_seen", F.last("_v", ignorenulls=True).over(w))
    return both.where("_l is not null").select("_l.*", F.col("_seen").alias(value))


def nearest_few(spots: DataFrame, rows: DataFrame, on: list[str], at: str, to: str, most: int, *ties: str, ident: str | None = None) -> DataFrame:
    """(on, ``at``, near): for each distinct (on, ``at``) of the spots the ``most`` nearest rows of equal keys by |to - at|, then ties, then all other columns.

    ``near`` is an array of structs (apart, then the rows' columns but ``on``), nearest first; with ``ident`` it has so many more that ``most`` are left
    without the rows of any one ident, so each caller may leave its own out. Where a place is null, apart is null and comes last.

    No pairs are formed: of rows alike in key and place only the first few can count, which tasks cut before they shuffle. Those are numbered
    along their key, and a spot takes the numbers next to its own; so the cost doesn't depend on how many share a key.
    """
    cells = [*ties, *[c for c in rows.columns if c not in (*on, *ties)]]
    r = rows.select(*on, F.col(to).alias("_to"), F.struct(*cells).alias("_row")).distinct()
    if ident is not None:
        alike = r.groupBy(*on, F.col(f"_row.{ident}").alias("_ident")).agg(F.count(F.lit(1)).alias("n"))
        most += alike.agg(F.max("n")).first()[0] or 0
    # zone 0 holds rows with a place, 1 rows without, 2 all rows, for spots without
    keys = [*on, "_zone"]
    zone = lambda c, known, unknown: F.explode(F.when(F.col(c).isNotNull(), F.array(*map(F.lit, known))).otherwise(F.array(*map(F.lit, unknown))))
    place = lambda c: F.when(F.col("_zone") == 0, F.col(c)).otherwise(F.lit(0))
    kept = top_k(r.withColumn("_zone", zone("_to", (0, 2), (1, 2))).withColumn("_place", place("_to")), [*keys, "_place"], most, F.col("_row")).drop("rank")
    asked = spots.select(*on, F.col(at).alias("_at")).distinct().withColumn("_zone", zone("_at", (0, 1), (2,))).withColumn("_place", place("_at"))
    counts = kept.groupBy(*keys, "_place").agg(F.count(F.lit(1)).alias("_n")).withColumns({"_at": F.lit(None).cast(asked.schema["_at"].dataType), "_asks": F.lit(False)})
    both = counts.unionByName(asked.withColumns({"_n": F.lit(0).cast("long"), "_asks": F.lit(True)}))
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_place"))
    looks = both.withColumn("_upto", upto).where("_asks").select(*keys, "_at", F.explode(F.array(F.lit(0), F.lit(1))).alias("_side"), "_upto")
    first = F.when(F.col("_side") == 0, F.greatest(F.col("_upto") - (most - 1), F.lit(1))).otherwise(F.col("_upto") + 1)
    last = F.when(F.col("_side") == 0, F.col("_upto")).otherwise(F.col("_upto") + most)
    looks = looks.where((F.col("_side") == 1) | (F.col("_upto") > 0)).withColumn("_number", F.explode(F.sequence(first, last)))
    # at or before a spot its nearest rows have the last numbers, behind it the first; in either order the first in ties is nearer
    down, up = [F.row_number().over(W.partitionBy(*keys).orderBy("_place", o)).cast("long") for o in (F.col("_row").desc(), F.col("_row").asc())]
    numbered = kept.withColumns({"_down": down, "_up": up}).withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
    numbered = numbered.select(*keys, "_side", F.when(F.col("_side") == 0, F.col("_down")).otherwise(F.col("_up")).alias("_number"), "_to", "_row")
    apart = F.abs(F.col("_to") - F.col("_at"))
    met = looks.join(numbered, [*keys, "_side", "_number"]).groupBy(*on, "_at").agg(F.collect_list(F.struct(apart.isNull().alias("far"), apart.alias("apart"), F.col("_row").alias("row"))).alias("_met"))
    near = F.transform(F.slice(F.sort_array("_met"), 1, most), lambda x: F.struct(x["apart"].alias("apart"), *[x["row"][c].alias(c) for c in cells]))
    return met.select(*on, F.col("_at").alias(at), near.alias("near"))


def with_near(spots: DataFrame, near: DataFrame, on: list[str], at: str) -> DataFrame:
    """Each row of the spots with its ``near`` of ``nearest_few``; those without any give no row."""
    n = near.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], F.col(at).alias("_at"), "near")
    same = F.col(at).eqNullSafe(F.col("_at"))
    for i, c in enumerate(on):
        same = same & (F.col(c) == F.col(f"_on{i}"))
    return spots.join(n, same).drop("_at", *[f"_on{i}" for i in range(len(on))])


def resolve_by_name(calls: DataFrame, defs: DataFrame, name: str, call_id: list[str], place: tuple[str, str], at: tuple[str, str], *ties: str, itself: tuple[str, str] | None = None) -> DataFrame:
    """A definition for each call: the nearest of the same place, else the only one of that name anywhere.

    ``place`` names the column of the calls and that of the definitions which are equal at the same place, ``at`` those whose difference is the
    distance, ``itself`` those that must differ at the same place. Calls meet their nearest definitions by name and place, and by name
    only those names that have one definition: so a common name isn't paired out.
    """
    own, theirs = place
    spots = calls.withColumn("_beside", F.col(own))
    near = nearest_few(spots, defs.withColumn("_beside", F.col(theirs)), [name, "_beside"], *at, 1, *ties, ident=itself and itself[1])
    met = with_near(spots, near, [name, "_beside"], at[0])
    left = F.col("near") if itself is None else F.filter("near", lambda d: d[itself[1]] != F.col(itself[0]))
    local = met.withColumn("_d", F.get(left, F.lit(0))).where("_d is not null").drop("near", "_beside")
    local = pick_one(local, call_id, F.col("_d.apart").asc_nulls_last(), *[F.col(f"_d.{t}") for t in ties])
    cells = [c for c in defs.columns if c != name]
    only = defs.groupBy(name).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*cells)).alias("_only")).where("_n = 1").select(name, "_only.*")
    rest = calls.join(local.select(*call_id), call_id, "left_anti").join(only, name)
    return local.select(*calls.columns, *[F.col(f"_d.{c}").alias(c) for c in cells]).select(*rest.columns).unionByName(rest)


def argmin(candidates: list[DataFrame], keys: list[str], *order: str) -> DataFrame:
    """Candidates of several strategies, numbered as ``strategy`` from 1; the first of each key by strategy, then ``order``."""
    both = None
    for i, c in enumerate(candidates, 1):
        c = c.withColumn("strategy", F.lit(i))
        both = c if both is None else both.unionByName(c)
    return pick_one(both, keys, F.col("strategy"), *[F.col(o) for o in order])


def named_in(lines: DataFrame, names: DataFrame, on: list[str], text: str, name: str) -> DataFrame:
    """Pairs of a line and a name, within equal keys, that the line takes from ``this`` or calls: an equi join on the names in it."""
    own = F.regexp_extract_all(F.col(text), F.lit(r"\bthis\s*\.\s*(\w+)"), F.lit(1))
    called = F.regexp_extract_all(F.col(text), F.lit(r"\b(\w+)\s*\("), F.lit(1))
    told = lines.withColumn(name, F.explode(F.array_distinct(F.concat(own, called))))
    return told.join(names.select(*on, name).distinct(), [*on, name])


def split_known(df: DataFrame, known: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is known, rows whose key isn't)."""
    keys = known.select(*on).distinct()
    return df.join(keys, on, "left_semi"), df.join(keys, on, "left_anti")


def flag_member(df: DataFrame, members: DataFrame, on: list[str], name: str, yes: str, no: str) -> DataFrame:
    m = members.select(*on).distinct().withColumn("_in", F.lit(True))
    return df.join(m, on, "left").withColumn(name, F.when(F.col("_in"), yes).otherwise(no)).drop("_in")


def upsert(base: DataFrame, extra: DataFrame, on: list[str], value: str, bad: Column) -> DataFrame:
    """Full join of (on, value): the base's value unless it is null or ``bad`` (over column ``value``), then the other's."""
    b = base.select(*on, F.when(F.col(value).isNotNull() & ~bad, F.col(value)).alias("_good"), F.col(value).alias("_b"))
    e = extra.select(*on, F.col(value).alias("_e"))
    return b.join(e, on, "full").select(*on, F.coalesce("_good", "_e", "_b").alias(value))
