"""Spelling variants: words one edit apart, found by Levenshtein automata over compact tries."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, staged, table, words_in_slices

#: Code points and occurrences that a word needs, how many times more frequent its form is, and one run in how many loses a code point.
LEAST_LENGTH, LEAST_COUNT, TIMES, ONE_IN = 6, 5, 5, 199
#: Entries of a task's tally before it is handed on; words of a trie and of a pile of queries.
ENTRIES, BLOCK = 400_000, 50_000
#: Latin-1 bytes of the characters that make runs: letters of ASCII, lower-cased, and U+00C0 to U+00FF. The rest parts them.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))

Node = dict | str


def insert(root: dict, word: str) -> None:
    """Add ``word`` to a trie whose single branches are kept as one string; '' marks the end of a word."""
    node, rest = root, word
    while rest:
        first, rest = rest[0], rest[1:]
        below = node.get(first)
        if below is None:
            node[first] = rest
            return
        if isinstance(below, str):
            if below == rest:
                return
            node[first] = fork = {}
            insert(fork, below)
            below = fork
        node = below
    node[""] = ""


def holds(node: Node, rest: str) -> bool:
    """Whether ``rest`` leads from ``node`` to the end of a word."""
    for at, c in enumerate(rest):
        if isinstance(node, str):
            return node == rest[at:]
        node = node.get(c)
        if node is None:
            return False
    return node == "" if isinstance(node, str) else "" in node


def _one_apart(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[at + (len(a) >= len(b)) :] == b[at + (len(b) >= len(a)) :]


def neighbours(root: Node, word: str) -> set[str]:
    """The words of the trie that the distance-one automaton of ``word`` accepts, ``word`` itself not: depth-first, dead branches left at once."""
    found, node = set(), root
    for at in range(len(word) + 1):
        before, rest = word[:at], word[at:]
        if isinstance(node, str):
            if _one_apart(node, rest):
                found.add(before + node)
            break
        if rest and holds(node, rest[1:]):
            found.add(before + rest[1:])
        for c, below in node.items():
            if not c:
                continue
            if rest and c != rest[0] and holds(below, rest[1:]):
                found.add(before + c + rest[1:])
            if holds(below, rest):
                found.add(before + c + rest)
        if not rest or (node := node.get(rest[0])) is None:
            break
    found.discard(word)
    return found


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n), summed within a bounded tally."""
    tally: Counter = Counter()

    def rows() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in tally], pa.string())
        out = pa.RecordBatch.from_arrays([words, pa.array(tally.values(), pa.int64())], names=["word", "n"])
        tally.clear()
        return out

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            start, own = zlib.crc32(f"{doc}:".encode()), Counter()
            for words in words_in_slices(text.encode("latin-1", "replace").translate(_FOLD)):
                own.update(words)
            for run, n in own.items():
                if len(run) >= LEAST_LENGTH:
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % ONE_IN == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LENGTH:
                            continue
                    tally[run] += n
            if len(tally) >= ENTRIES:
                yield rows()
    if tally:
        yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the runs of letters of whole texts, one code point deleted where the hash of id and run says so."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text")).where("text is not null")
    return src.mapInArrow(_tallies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _met(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: (word, n_near, best_n, best), each query against the trie of its key."""
    out = []
    for (backward, least, key, *_), group in rows.groupby(["backward", "least", "key", "trie", "pile"], sort=False):
        words, counts = group["word"].tolist(), group["n"].tolist()
        if backward:
            words = [w[::-1] for w in words]
        skip, half = len(key), least // 2
        held = {w[skip:]: n for w, n, is_held in zip(words, counts, group["held"]) if is_held}
        if len(held) < 2 and len(words) < 2:
            continue
        root: dict = {}
        for rest in held:
            insert(root, rest)
        for word, asks in zip(words, group["asks"]):
            if asks:
                near = []
                for rest in neighbours(root, word[skip:]):
                    other = key + rest if not backward else word[:skip] + rest
                    if len(word) > least and len(other) > least:
                        continue  # both of the greater length meet under their own length
                    if backward:
                        own, other = word[::-1], other[::-1]
                        if own[:half] == other[:half]:
                            continue  # they meet by their beginnings
                    near.append((-held[rest], other))
                if near:
                    n, best = min(near)
                    out.append((word[::-1] if backward else word, len(near), -n, best))
    return pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have others one edit away: how many, and the most frequent, ties to the smallest.

    ``words`` has distinct (word, n). Two words one edit apart, the shorter of length m, agree in their first m // 2 code points or in
    their last m - m // 2. So each word goes to the keys of its beginnings and ends, under its own length and the one below, and
    the words of a key make a trie. Keys are dealt to shards of about ``block`` words; a key with more has several tries and
    several piles of queries, and each pile meets each trie, so a task's memory is bounded and no pair is lost. A pair meets by
    its ends only if it doesn't by its beginnings: it is found once.
    """
    m = F.char_length("word")
    routes = F.explode(F.array(*(F.struct(F.lit(back).alias("backward"), (m - less).alias("least")) for back in (False, True) for less in (0, 1))))
    half = F.floor(F.col("r.least") / 2).cast("int")
    key = F.when(F.col("r.backward"), F.expr("reverse(right(word, r.least - int(floor(r.least / 2))))")).otherwise(F.col("word").substr(F.lit(1), half))
    routed = words.select("word", "n", routes.alias("r")).where(F.col("r.least") >= LEAST_LENGTH).select("word", "n", "r.*", key.alias("key"))
    keys = ["backward", "least", "key"]
    crowded = routed.groupBy(*keys).count().where(F.col("count") > block).select(*keys, F.ceil(F.col("count") / block).cast("int").alias("parts"))
    dealt = routed.join(staged(crowded, "variants-keys"), keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    alone = F.array(F.struct(F.lit(0).alias("trie"), F.lit(0).alias("pile"), F.lit(True).alias("held"), F.lit(True).alias("asks")))
    each = F.sequence(F.lit(0), F.col("parts") - 1)
    as_held = F.transform(each, lambda k: F.struct(F.col("own").alias("trie"), k.alias("pile"), F.lit(True).alias("held"), F.lit(False).alias("asks")))
    asking = F.transform(each, lambda k: F.struct(k.alias("trie"), F.col("own").alias("pile"), F.lit(False).alias("held"), F.lit(True).alias("asks")))
    placed = dealt.withColumn("own", own).select("word", "n", *keys, F.explode(F.when(F.col("parts") == 1, alone).otherwise(F.concat(as_held, asking))).alias("p")).select("word", "n", *keys, "p.*")
    shards = max(1, 4 * words.count() // block)
    shard = F.pmod(F.xxhash64(*keys, "trie", "pile"), F.lit(shards))
    met = placed.withColumn("shard", shard).groupBy("shard").applyInPandas(_met, "word string, n_near long, best_n long, best string")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each row of ``forms`` (word, form), by doubling the steps until none gets further.

    A form is at least ``TIMES`` times more frequent than its word, so ways have no circle and are short.
    """
    now = staged(forms.select("word", F.col("form").alias("root")), "variants-ways")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = staged(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variants-ways")
        now = further.select("word", "root")
        if further.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each frequent word, the likelier spelling of it, and where such steps end.

    Words come from ``word_counts``; a null text has none, a null id is hashed as '', rows of repeated ids count each. Words of
    at least six code points and five occurrences stay. The form is the most frequent word one edit away (ties: the smallest), if it
    occurs five times as often or more. Other columns are ignored; an empty table gives no rows.
    """
    words = staged(word_counts(docs).where((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_LENGTH)), "variants-words")
    near = near_words(words, block)
    is_form = F.col("best_n") >= TIMES * F.col("n")
    full = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    full = staged(full, "variants-forms")
    ends = roots(full.where("form is not null").select("word", "form"))
    return full.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
