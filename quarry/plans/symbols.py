"""Symbols of declaration files: what a dotted name means, by the nearest thing that is declared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import lookups

#: Kinds that hold members, and those of them that names are looked up in when nothing else fits.
CONTAINERS, SPACES = ("class", "interface", "namespace", "enum", "function"), ("namespace",)


def rooted(declarations: DataFrame, defaults: DataFrame) -> DataFrame:
    """Declarations as seen from a module's default export (module, name): where that is a namespace, its members are the module's own.

    ``declarations`` has (module, container, member, kind, summary, permissions, returns, line); containers are dotted.
    """
    spaces = declarations.where(F.col("kind").isin(*SPACES) & (F.col("container") == "")).select("module", F.col("member").alias("name")).distinct()
    root = defaults.join(spaces, ["module", "name"], "left_semi").groupBy("module").agg(F.min("name").alias("_root"))
    told = declarations.join(root, "module", "left")
    inside = F.when(F.col("container") == F.col("_root"), "").when(F.startswith("container", F.concat("_root", F.lit("."))), F.expr("substring(container, length(_root) + 2)"))
    own = told.where("_root is null").drop("_root")
    return own.unionByName(told.where("_root is not null").withColumn("container", inside).where("container is not null").drop("_root"))


def resolve(wanted: DataFrame, declarations: DataFrame) -> DataFrame:
    """Wanted names (module, symbol) with what they mean: (kind, summary, permissions, returns, found): the first that is declared of

    1. the name itself, 2. for a name without dots, the same name in any namespace at the module's top, 3. its container, 4. the
    container's container, and so on. A summary that is missing is the container's. Names and declarations meet in equi joins on (module, name).
    """
    full = F.concat_ws(".", F.nullif("container", F.lit("")), "member")
    d = declarations.withColumn("_full", full)
    cells = F.struct("kind", "summary", "permissions", "returns", F.col("_full").alias("found"))
    by_name = lookups.first_wins(d.withColumn("_late", ~F.col("kind").isin(*CONTAINERS)), ["module", "_full"], "_late", "line").select("module", F.col("_full").alias("_key"), cells.alias("_d"))
    spaces = d.where(F.col("kind").isin(*SPACES) & (F.col("container") == "")).select("module", F.col("member").alias("container"), F.col("line").alias("_space"))
    nested = d.where(F.col("kind").isin(*CONTAINERS)).join(spaces, ["module", "container"])
    nested = lookups.first_wins(nested, ["module", "member"], "_space", "line").select("module", F.col("member").alias("_key"), cells.alias("_d"))
    parts = F.split("symbol", r"\.")
    ways = wanted.select("module", "symbol").distinct().where("symbol <> ''").withColumn("_n", F.size(parts))
    ways = ways.withColumn("_up", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_key", F.array_join(F.slice(parts, 1, F.col("_n") - F.col("_up")), "."))
    met = ways.join(by_name, ["module", "_key"]).select("module", "symbol", (2 * F.col("_up")).alias("_rank"), "_d")
    met = met.unionByName(ways.where("_n = 1").join(nested, ["module", "_key"]).select("module", "symbol", F.lit(1).alias("_rank"), "_d"))
    best = met.groupBy("module", "symbol").agg(F.min_by("_d", "_rank").alias("_d"), F.sort_array(F.collect_list(F.struct("_rank", F.col("_d.summary").alias("s")))).alias("_all"))
    said = F.try_element_at(F.filter("_all", lambda x: F.coalesce(x.s, F.lit("")) != ""), F.lit(1))["s"]
    found = best.select("module", "symbol", "_d.kind", said.alias("summary"), "_d.permissions", "_d.returns", "_d.found")
    return wanted.join(found, ["module", "symbol"], "left")
