"""Many needles in many texts: one automaton for all needles while they are few, a join on their seeds beyond."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.batches import bounded_batches

#: Characters of all needles together that one automaton may hold, some hundred bytes each; checked before it is built.
HELD = 1_000_000
#: Characters of the seeds by which more needles meet texts.
GRAM = 4


def _automaton(needles: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for n in needles:
        a.add_word(n, n)
    a.make_automaton()
    return a


def few(needles: DataFrame, needle: str, held: int = HELD) -> list[str] | None:
    """The distinct needles that aren't empty, or None if they are more than ``held`` characters."""
    own = needles.select(F.col(needle).alias("n")).where("n <> ''").distinct()
    if (own.agg(F.sum(F.length("n"))).first()[0] or 0) > held:
        return None
    return [r.n for r in own.collect()]  # at most ``held`` characters


def _held_in(needles: list[str]):
    """Which of a few needles a text holds."""

    @F.pandas_udf("array<string>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = _automaton(needles)
        for t in texts:
            yield t.map(lambda x: sorted({n for _, n in a.iter(x)}) if x else [])

    return found


def seeded(lines: DataFrame, needles: DataFrame, text: str, needle: str, gram: int = GRAM) -> DataFrame:
    """``text_matches`` for any number of needles: each goes by its first ``gram`` characters (all, if it is shorter) to the texts that hold these anywhere.

    An equi join on narrow rows (hash of the text, seed); pairs that met are joined with the texts and compared in full.
    """
    n = needles.where(F.length(needle) > 0)
    seed = F.substring(F.col(needle), 1, gram)
    sizes = sorted(r[0] for r in n.select(F.length(seed)).distinct().collect())  # gram at most
    key = F.xxhash64(F.col(text))
    pieces = [F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)) for k in sizes] or [F.array().cast("array<string>")]
    seeds = lines.select(key.alias("_key"), F.explode(F.array_distinct(F.concat(*pieces))).alias("_seed"))
    asked = n.select(F.col(needle).alias("_needle"), seed.alias("_seed")).distinct()
    met = seeds.join(asked, "_seed").select("_key", "_needle").distinct()
    found = lines.withColumn("_key", key).join(met, "_key").where(F.contains(F.col(text), F.col("_needle")))
    return found.join(n.withColumn("_needle", F.col(needle)), "_needle").drop("_key", "_needle")


def text_matches(lines: DataFrame, needles: DataFrame, text: str, needle: str, held: int = HELD) -> DataFrame:
    """Pairs of a text and a needle that occurs in it, whatever its signs and wherever it starts; empty needles match nothing, null texts hold nothing.

    Needles of ``held`` characters at most make one automaton, which each task builds once: only the texts cross to Python, each is read once, and
    rows leave for real matches alone. More needles go by ``seeded``.
    """
    bounded_batches(lines.sparkSession)
    own = few(needles, needle, held)
    if own is None:
        return seeded(lines, needles, text, needle)
    n = needles.where(F.length(needle) > 0)
    told = lines.withColumn("_found", _held_in(own)(F.col(text))).where(F.size("_found") > 0)
    return told.withColumn("_needle", F.explode("_found")).drop("_found").join(n.withColumn("_needle", F.col(needle)), "_needle").drop("_needle")


_PARTS = "array<struct<text:string,anchor:boolean>>"
#: Parts that stand as Python objects at a time, before they go to an Arrow array.
HELD_PARTS = 1 << 15


def cut(text: str | None, automaton) -> Iterator[tuple[str, bool]]:
    """(part, whether it is a needle) of the text cut at the needles, from the left, the longest first; nothing without any.

    Needles come by their ends. A start counts once no longer needle can begin there or before it, so only those of a stretch are held.
    """
    longest: dict[int, int] = {}
    at = 0
    reach = 0

    def settled(below: int) -> Iterator[tuple[str, bool]]:
        nonlocal at
        for start in sorted(s for s in longest if s < below):
            size = longest.pop(start)
            if start >= at:
                if start > at:
                    yield text[at:start], False
                at = start + size
                yield text[start:at], True

    for end, n in automaton.iter(text or ""):
        if len(longest) >= HELD_PARTS:
            reach = reach or max(map(len, automaton))
            yield from settled(end - reach + 1)
        start = end - len(n) + 1
        if start >= at and len(n) > longest.get(start, 0):
            longest[start] = len(n)
    yield from settled(len(text or ""))
    if at and at < len(text):
        yield text[at:], False


def _cut_all(texts: Iterator[tuple[str | None, object]]) -> pa.Array:
    """The parts of each text under its automaton (none: no parts), as an Arrow array of lists."""
    names, flags, done, ends = [], [], [], [0]
    kind = pa.struct([("text", pa.string()), ("anchor", pa.bool_())])

    def flush() -> None:
        done.append(pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(flags, pa.bool_())], fields=list(kind)))
        names.clear(), flags.clear()

    for text, automaton in texts:
        n = 0
        for part, anchor in cut(text, automaton) if automaton else ():
            names.append(part), flags.append(anchor)
            n += 1
            if len(names) >= HELD_PARTS:
                flush()
        ends.append(ends[-1] + n)
    flush()
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(done))


def tokenise(df: DataFrame, anchors: DataFrame, text: str, anchor: str, name: str = "tokens", held: int = HELD) -> DataFrame:
    """``df`` with ``name``: parts (text, anchor) of each text, cut at the anchors of a table, the longest first; empty without any anchor in it.

    Few anchors make one automaton for all texts; of many, each text first meets those that it holds, and makes one of its own.
    """
    bounded_batches(df.sparkSession)
    own = few(anchors, anchor, held)
    if own is not None:

        @F.arrow_udf(_PARTS)
        def parts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            a = _automaton(own) if own else None
            for t in texts:
                yield _cut_all((x.as_py(), a) for x in t)

        return df.withColumn(name, parts(F.col(text)))

    @F.arrow_udf(_PARTS)
    def own_parts(texts: pa.Array, held_anchors: pa.Array) -> pa.Array:
        return _cut_all((t.as_py(), _automaton(a.as_py()) if a.is_valid and len(a) else None) for t, a in zip(texts, held_anchors))

    texts = df.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    met = seeded(texts, anchors.select(F.col(anchor).alias("_anchor")).distinct(), "_text", "_anchor").groupBy(F.xxhash64("_text").alias("_key"), "_text").agg(F.collect_set("_anchor").alias("_own")).drop("_key")
    joined = df.join(met, F.col(text) == F.col("_text"), "left").drop("_text")
    return joined.withColumn(name, own_parts(F.col(text), F.col("_own"))).drop("_own")
