"""Source divergence and spelling variants, held against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import divergence, variants

KIND = "doc_id long, text string, lang string, source string, n int, term string"


def made(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeÀéß") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    stems += [s[:k] + rng.choice("abé") + s[k + 1 :] for s in stems for k in (0, 2, 5)] + [s[1:] for s in stems] + [s + "x" for s in stems] + ["Straße", "STRASSE", "日本語のことば", "x1y2", "𐐀𐐁word"]
    weights = [1 / (k + 1) for k in range(len(stems))]
    rows = [(i, " ".join(rng.choices(stems, weights, k=rng.randint(0, 120))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "b", "é", None]), i, "t") for i in range(n)]
    return rows + [(None, None, None, None, 0, None), (None, "word " * 9, "xx", "only", 0, None), (n, "", "en", "silent", 0, None), (7, rows[7][1], "en", "a", 0, None), (7, rows[7][1], "en", "a", 0, None), (n + 1, "\x00  [x] `y` {Z} É-é " + "Wörter÷×, " * 30000, "de", "b", 0, None)]


@pytest.fixture(scope="module")
def rows():
    return made(5, 400)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(5).cache()


def lowered(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def divergence_by_hand(rows, least=30, ranks=50):
    docs = [(r[2] or "", r[3] or "", Counter(lowered(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or ""))) for r in rows]
    groups, out = sorted({d[:2] for d in docs}), []
    for lang in {g[0] for g in groups}:
        seen = Counter(t for d in docs if d[0] == lang for t in d[2])
        kept = [t for t, n in seen.items() if n >= least]
        count = defaultdict(Counter)
        for d in docs:
            if d[0] == lang:
                for t in kept:
                    count[d[1]][t] += d[2][t]
                    count[None][t] += d[2][t]
        p = {g: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for g, c in count.items()}
        sources = [g[1] for g in groups if g[0] == lang]
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((p[None][t] - p[s][t], t.encode(), t) for t in kept if count[s][t] and p[s][t] > p[None][t])
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:ranks], 1)]
    return sorted(out)


def test_source_divergence(spark, docs, rows):
    got = sorted(tuple(r) for r in divergence.source_divergence(docs).collect())
    assert got == divergence_by_hand(rows)
    assert sum(r[2] == "term" for r in got) > 50 and any(r[1] == "silent" for r in got)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_source_divergence_sql(docs, rows):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(con.sql(divergence.SOURCE_DIVERGENCE_SQL).fetchall()) == divergence_by_hand(rows)


def test_source_divergence_hands_on_full_tallies(docs, rows, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text"))).withColumn("text", F.col("text").cast("binary"))
    [batches] = [texts.toArrow().to_batches(max_chunksize=40)]
    told = [r for b in divergence._tallies(iter(batches)) for r in b.to_pylist()]
    whole = Counter()
    for r in told:
        whole[r["lang"], r["source"], r["term"].decode()] += r["n"]
    want = Counter()
    for r in rows:
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or ""):
            want[r[2] or "", r[3] or "", lowered(t)] += 1
    assert whole == want and len(told) > len(whole)


def words_by_hand(rows):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def edits(w, letters):
    return {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}


def variants_by_hand(words):
    letters, form, out = {c for w in words for c in w}, {}, []
    near = {w: (edits(w, letters) - {w}) & words.keys() for w in words}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=lambda r: r[0])


@pytest.mark.parametrize("block", [50_000, 9])
def test_spelling_variants(docs, rows, block):
    got = sorted((tuple(r) for r in variants.spelling_variants(docs, block).collect()), key=lambda r: r[0])
    want = variants_by_hand(words_by_hand(rows))
    assert got == want
    assert sum(r[1] is not None for r in want) > 5 and sum(r[4] > 1 for r in want) > 20
    assert variants.spelling_variants(docs.limit(0)).count() == 0


def test_long_ways_to_the_root(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(21)] + [("a", "b")]
    got = dict(variants.roots(spark.createDataFrame(forms, "word string, form string")).collect())
    assert got == {f"w{k}": "w21" for k in range(21)} | {"a": "b"}


def test_automaton_against_all_edits():
    rng = random.Random(1)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(300)}
    root = {}
    for w in words:
        variants.insert(root, w)
    assert all(variants.holds(root, w) for w in words) and not variants.holds(root, "abcabcabc")
    for w in [*words, "", "abcabc", "zzz"]:
        assert variants.neighbours(root, w) == (edits(w, "abcz") - {w}) & words


@pytest.mark.parametrize(("entries", "documents", "least_rows"), [(600_000, 1_000_000, 5), (600_000, 3, 8), (4, 1_000_000, 8)])
def test_tallies_sum_terms_by_group(monkeypatch, entries, documents, least_rows):
    """Terms leave as strings, summed by group, when entries or documents are many; the sums are whole whatever the bounds."""
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "DOCS", documents)
    rows = [("en", "a", "One two, two"), ("en", "b", "two é"), ("en", "a", "TWO"), ("", "", ""), ("en", "a", "one"), ("fr", "a", "two Éé"), ("en", "a", "one é")]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part]), pa.array([r[2].encode() for r in part])], names=["lang", "source", "text"]) for part in (rows[:3], rows[3:])]
    got, out = Counter(), [r for b in divergence._told(iter(batches)) for r in b.to_pylist()]
    for r in out:
        got.update({(r["lang"], r["source"], r["term"], "n"): r["n"], (r["lang"], r["source"], r["term"], "docs"): r["docs"]})
    want = Counter()
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        want.update((lang, source, t, "n") for t in terms)
        want.update((lang, source, t, "docs") for t in set(terms))
    assert got == want and len(out) >= least_rows
