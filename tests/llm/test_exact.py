"""Operators with exact results, held against brute force on small fixtures."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import ann, common, counts, decontaminate, mixing, repeats, simhash, tokens, urls

WORDS = ["alpha", "beta", "gamma", "delta", "x", "yy", "été", "ß", "Don't", "!!"]
KIND = "doc_id long, text string, source string, extra int"


def made(seed, n):
    rng = random.Random(seed)
    pieces = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 80))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(pieces)[rng.randint(0, 30) : rng.randint(100, 500)] if rng.random() < 0.6 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 5))]
        rows.append((i, " ".join(parts), rng.choice(["a", "a", "a", "b", None]), i))
    return rows + [(None, None, None, None), (n, "", "b", 0), (n + 1, "   ", "c", 0), (7, rows[7][1], "a", 1), (7, rows[7][1], "a", 1), (n + 2, "ab" * 400, "b", 0), (n + 3, "a" * 200, "b", 0), (n + 4, "a" * 201, "b", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(3, 80), KIND).repartition(3).cache()


def key(row):
    return tuple((x is None, x) for x in row)


def same(got, want):
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_token_output_round_trip(spark, docs):
    t = tokens.encoder(public_tokenizers.path("word_bpe_49k.json")).whole
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for i, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    path = common.shared_dir(spark, "tokens-test")
    got = tokens.token_output(docs, public_tokenizers.path("word_bpe_49k.json"), path=path)
    same(got.select("doc_id", "start", "n_tokens", "ids_crc32"), want)
    text = dict(rows)[3] + " " + "x" * 200_000 + " word " * 70_000  # longer than what is encoded at once
    [bytes_] = tokens.encoder(public_tokenizers.path("word_bpe_49k.json")).batch([text], step=1000)
    assert np.frombuffer(bytes_, dtype="<u2").tolist() == t.encode(text, add_special_tokens=False).ids
    few = tokens.read_documents(spark, path, [3, 5])
    assert few[3].tolist()[:-1] == t.encode(dict(rows)[3], add_special_tokens=False).ids
    assert tokens.token_output(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_repeats(docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(b[p : p + 200] for _, b in rows for p in range(len(b) - 199))
    want = []
    for i, b in rows:
        m = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                m[p : p + 200] = True
        m = m[: len(b)]
        spans = int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum())
        want.append((i, len(b), int(m.sum()), spans, hashlib.sha256(bytes(c for c, x in zip(b, m) if not x)).hexdigest()))
    same(repeats.remove_repeats(docs), want)
    same(repeats.remove_repeats(docs.withColumn("tid", F.lit(1)).withColumn("core", F.lit(1)), step=97), want)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_token_counts_and_splicing(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = counts.tokenizer(path)
    n = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    want = [(r.doc_id, len((r.text or "").encode()), n(r.text or ""), n(r.text or "") > 512) for r in docs.collect()]
    same(counts.count_tokens(docs, path), want)
    same(counts.count_tokens(docs, path, chunk=100, overlap=8), want)
    encode = lambda s: t.encode(s, add_special_tokens=False)
    for text in ("x" * 3000, " " * 3000, "word's " * 500, "日本" * 900, "a1!\n" * 700, "", "<|endoftext|>" * 90):
        assert counts.spliced_count(encode, text, 150, 4, 64) == n(text)


def brute_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_links(spark, docs):
    rows = [(r.doc_id, brute_print(r.text)) for r in docs.collect() if r.doc_id is not None]
    component = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, x in rows:
            for j, y in rows:
                if (x ^ y).bit_count() <= 3 and component[i] > component[j]:
                    component[i], changed = component[j], True
    got = [r for r in simhash.simhash_groups(docs).collect() if r.id is not None]
    assert sorted((r.id, r.fp % 2**64, r.component) for r in got) == sorted((i, x, component[i]) for i, x in rows)
    base = random.Random(5).getrandbits(64)
    near = [base ^ sum(1 << b for b in random.Random(s).sample(range(64), s % 6)) for s in range(60)]
    prints = spark.createDataFrame([(k, [x - 2**64 if x >> 63 else x]) for k, x in enumerate(dict.fromkeys(near))], "rep long, fps array<long>")
    want = {(a, b) for a, x in enumerate(dict.fromkeys(near)) for b, y in enumerate(dict.fromkeys(near)) if a < b and (x ^ y).bit_count() <= 3}
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(prints).collect()} == want


def edf(blocks, k):
    """Slot by slot: the released block with the earliest deadline, over cycles in which sources give k blocks or what they have left."""
    left, done, out = dict(blocks), dict.fromkeys(blocks, 0), []
    while any(left.values()):
        n = {s: min(k[s], left[s]) for s in left if left[s]}
        size, given = sum(n.values()), dict.fromkeys(n, 0)
        for t in range(size):
            ready = [(-(-(given[s] + 1) * size // n[s]), -n[s], s) for s in n if given[s] < n[s] and given[s] * size // n[s] <= t]
            s = min(ready)[2]
            out.append((s, done[s] + given[s]))
            given[s] += 1
            assert all(abs(given[x] - (t + 1) * n[x] / size) < 1 for x in n)
        for s, m in n.items():
            left[s], done[s] = left[s] - m, done[s] + m
    return out


@pytest.mark.parametrize("weights", [{"a": 3, "b": 1}, {"a": 7, "b": 5, "c": 2}, None])
def test_mixing_is_earliest_deadline_first(docs, weights):
    got = mixing.mix(docs, weights, block_docs=4).collect()
    assert len(got) == docs.count()
    rows = Counter(r.source for r in docs.collect())
    blocks = {"n" if s is None else f"s{s}": -(-n // 4) for s, n in rows.items()}
    top = max(rows.values())
    k = {"n" if s is None else f"s{s}": (weights or {}).get(s) or max(1, round((n / top) ** 0.5 * mixing.UNITS)) for s, n in rows.items()}
    slots = {}
    for r in got:
        key = ("n" if r.source is None else f"s{r.source}", r.mix_block)
        assert slots.setdefault(r.mix_slot, key) == key
        assert 0 <= r.mix_rank < 4
    assert [slots[t] for t in range(len(slots))] == edf(blocks, k)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_simhash_links_between_parts(spark, monkeypatch):
    """Pairs of different parts by brute force, with and without anchors that count as crowded."""
    rng = random.Random(9)
    base = rng.getrandbits(64)
    near = list(dict.fromkeys(base ^ sum(1 << b for b in rng.sample(range(64), s % 5)) for s in range(90)))
    comps = [min(k % 7, 3) for k in range(len(near))]
    prints = spark.createDataFrame([(k, [x - 2**64 if x >> 63 else x], comps[k]) for k, x in enumerate(near)], "rep long, fps array<long>, comp int")
    want = {(a, b) for a, x in enumerate(near) for b, y in enumerate(near) if a < b and comps[a] != comps[b] and (x ^ y).bit_count() <= 3}
    for crowd in (0, 10_000):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        got = simhash.links(prints).collect()
        assert {(min(r.a, r.b), max(r.a, r.b)) for r in got} == want
        assert all({r.ca, r.cb} == {comps[r.a], comps[r.b]} for r in got)


def test_mixing_keeps_any_column(spark):
    names = "first last size slots base mix_key o_key p_key key own bucket h one k block rank at".split()
    df = spark.range(300).select((F.col("id") % 40).alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), *[F.col("id").alias(n) for n in names], F.create_map(F.lit("x"), F.col("id")).alias("m"), F.lit(1).alias("mix_slot"))
    df = df.withColumn("doc_id", F.when(F.col("doc_id") < 30, F.col("doc_id")))
    got = mixing.mix(df.unionByName(df), block_docs=8)
    assert got.columns == [*df.columns[:-1], "mix_block", "mix_slot", "mix_rank"]
    assert got.count() == 600
    assert got.select("source", "mix_block", "mix_rank").distinct().count() == 600
    assert all(r["count"] == 2 for r in got.groupBy("first").count().collect())


def brute_tiles(doc, item, shortest):
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                if n >= shortest and (best is None or n > best[2]):
                    best = (i, d, n)
        if best is None:
            return out
        out.append(best)
        for k in range(best[2]):
            free_i[best[0] + k] = free_d[best[1] + k] = False


def test_tiling_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        kinds = rng.choice([1, 2, 3, 6])
        doc, item = (np.array([rng.randrange(kinds) for _ in range(rng.randrange(1, n))], dtype=np.uint64) * np.uint64(0x1234567890ABCDEF) for n in (50, 25))
        shortest = min(rng.choice([1, 2, 3, 5]), len(item))
        assert decontaminate.tile(doc, item, shortest) == brute_tiles(doc.tolist(), item.tolist(), shortest)
    same = np.full(200_000, 7, dtype=np.uint64)
    assert decontaminate.tile(same, same[:100]) == [(0, 0, 100)]


def test_decontamination_catches_reordered_passages(spark, docs):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    moved = "noise here eight nine ten eleven twelve thirteen fourteen and then one two three four five six seven end"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short one")], "item_id long, text string")
    more = docs.unionByName(spark.createDataFrame([(900, moved, "a", 1), (901, "one two three four", "a", 1)], KIND))
    for seeds in (500_000, 0):
        got = decontaminate.leaks(more, bench, broadcast_seeds=seeds).collect()
        assert [(r.doc_id, r.item_id, r.covered, r.tiles) for r in got] == [(900, 1, 14, 2)]
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_decontamination_of_odd_rows(spark):
    words = [f"w{k}" for k in range(12)]
    rng = random.Random(4)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) for _ in range(60)] + [None, "", "w1 " * 30_000, "w1 w2", "w1 w2"]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (30, 7, 5, 3, 1)] + ["w1 " * 40, None, ""]
    ids = [k % 50 if k % 9 else None for k in range(len(texts))]  # null and repeated ids
    names = "doc_id long, text string, seed long, item_id long, tiles long"
    docs = spark.createDataFrame([(i, t, k, k, k) for k, (i, t) in enumerate(zip(ids, texts))], names)
    bench = spark.createDataFrame([(k, t, k, k) for k, t in enumerate(items)], "item_id long, text string, doc_id long, seed long")
    want = []
    for i, t in zip(ids, texts):
        doc = (t or "").split()
        for k, item in enumerate(items):
            item = (item or "").split()
            if len(doc) < 1000 and item and (tiles := brute_tiles(doc, item, min(5, len(item)))):
                want.append((i, k, len(item), sum(x[2] for x in tiles), len(tiles)))
    long = {(k, len(t.split())) for k, t in enumerate(items) if t and set(t.split()) == {"w1"}}
    for seeds in (500_000, 0):
        got = [tuple(r) for r in decontaminate.overlaps(docs, bench, broadcast_seeds=seeds).select("doc_id", "item_id", "item_tokens", "covered", "tiles").collect()]
        rest = Counter(got) - Counter(want)
        assert not Counter(want) - Counter(got)
        assert {(r[1], r[3]) for r in rest} >= long and {r[0] for r in rest} == {ids[62]}


def nearest(x, ids, q, own, k=10):
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    d[ids == own] = np.inf
    best = np.lexsort((ids, d))[:k]
    return ids[best].tolist(), d[best].tolist()


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 10))
    x[200:400] = x[0]
    rows = [(i, v.tolist(), 1, 1) for i, v in enumerate(x)] + [(1000, None, 1, 1), (1001, [0.0] * 10, 1, 1), (1002, [None] * 10, 1, 1), (1003, [float("nan")] * 10, 1, 1), (1004, [1.0], 1, 1), (None, [1.0] * 10, 1, 1), (7, x[7].tolist(), 2, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int, near int")
    got = {}
    for r in ann.search(df, df.where("vec_id % 50 = 0"), reranked=300).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in range(0, 600, 50):
        best, d = nearest(x, np.arange(600), x[q], q)
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(abs(f[2] - np.sqrt(((x[f[1]] - x[q]) ** 2).sum())) < 1e-12 for f in found)
        hit, total = hit + len({f[1] for f in found} & set(best)), total + 10
    assert hit / total >= 0.9
    assert [f[1] for f in sorted(got[0])] == list(range(200, 210))
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_nearest_neighbours_recall_of_the_query(spark):
    data = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    sound = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([i for i, _ in sound]), np.stack([v for _, v in sound])
    got = {}
    for r in ann.op2_nearest_neighbours(spark, data).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = [(i, v) for i, v in sound if i % 100 == 0]
    assert {i for i, _ in asked} == set(got)
    assert sum(len(got[i] & set(nearest(x, ids, v, i)[0])) for i, v in asked) >= 0.9 * 10 * len(asked)


def test_piles_hold_all_lists():
    rng = np.random.default_rng(3)
    piles = ann._piles({c: n for c, n in enumerate([1, 5, 200, 64, 3, 63, 2])}, rng.normal(size=(7, 4)))
    assert sorted(piles) == list(range(7))
    assert piles[2][1] == 4
    held = Counter()
    for c, (first, n) in piles.items():
        for p in range(first, first + n):
            held[p] += 1
    assert all(held[p] == 1 for p in range(piles[2][0], piles[2][0] + 4))


def test_url_rules(spark):
    cases = [
        ("http://Sub.Example.ORG/en/12?x=1", "sub.example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("https://notexample.org/es/a", "notexample.org", "/es/a", "org/", "allow"),
        ("https://a.com/de/", "a.com", "/de/", "com/de/", "block"),
        ("ftp://a.net?q=/x", "a.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://\u0130stanbul.net/ABC", "\u0130stanbul.net", "/ABC", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "<p>words and more words and more words</p>", 1, "x") for i, c in enumerate(cases)], "page_id long, url string, html string, host int, verdict string")
    got = {r.page_id: r for r in urls.judge_urls(pages, labels=pages.select("url", F.lit(None).cast("string").alias("label"))).collect()}
    for i, c in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == c[1:]
    assert urls.judge_urls(pages.limit(0)).count() == 0
    assert urls.judge_urls(pages.unionByName(pages)).count() == 2 * len(cases)


def test_segmentation_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        counted = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(6)}
        cost = urls.Words(counted, sum(counted.values()))
        name = "".join(rng.choice("abcx") for _ in range(rng.randint(1, 9)))
        price = lambda parts: sum(min(cost.get(p, float("inf")), cost.rarest + urls.UNKNOWN + urls.LETTER * len(p)) for p in parts)  # noqa: B023, E731
        ways = [[name[i:j] for i, j in zip((0, *cuts), (*cuts, len(name)))] for n in range(len(name)) for cuts in combinations(range(1, len(name)), n)]
        got = urls.segment(name, cost)
        assert "".join(got) == name
        assert abs(price(got) - min(map(price, ways))) < 1e-9
    long = "cheappills" * 500
    assert urls.segment(long, urls.Words({"cheap": 3, "pills": 2}, 5)) == ["cheap", "pills"] * 500


def test_hosts_are_split_and_judged_by_their_words(spark):
    text = "<p>cheap casino bets and fine garden tools for a quiet town, see quietgardentools.net or https://cheapcasinobets.net/x</p>"
    rows = [(i, f"http://cheapcasinobets.com/de/page{i}", text + "cheapcasinobets") for i in range(30)]
    rows += [(100 + i, f"http://quietgardentools.org/uploads/page{i}", text) for i in range(70)]
    rows += [(900, "http://casinobets.net/x", text), (901, "http://gardentools.net/x", text), (902, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    cost = urls.costs(pages)
    assert urls.segment("cheapcasinobets", cost) == ["cheap", "casino", "bets"]
    assert urls.segment("quietgardentools", cost) == ["quiet", "garden", "tools"]
    got = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert [got[i].verdict for i in (900, 901, 902, 0, 100)] == ["block", "allow", "allow", "block", "allow"]
    # the same by hand: counts of words by label, smoothed
    tokens = urls.Tokens(cost)
    said = {True: Counter(), False: Counter()}
    for i, url, _ in rows[:100]:
        host, path = url.split("://")[1].split("/", 1)
        said[i < 100].update(tokens(host, "/" + path))
    kinds = len(said[True] | said[False])
    odds = lambda w: np.log((said[True][w] + urls.SMOOTH) / (said[True].total() + urls.SMOOTH * kinds)) - np.log((said[False][w] + urls.SMOOTH) / (said[False].total() + urls.SMOOTH * kinds)) if w in said[True] | said[False] else 0.0
    for page, host in ((900, "casinobets.net"), (901, "gardentools.net")):
        assert abs(got[page].score - (np.log(31 / 71) + sum(map(odds, tokens(host, "/x"))))) < 1e-9


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (None, 5), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(e, "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 31)} | {101: 100}
    assert common.connected_components(e.where(F.col("a") > 1000), "a", "b").count() == 0


def test_pieces_count_as_the_library_does():
    """Texts are counted by pieces seen once, exactly; what pieces can't tell has no count. Before, each text went through the library whole."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = counts.tokenizer(path)
    pieces, rng = counts.PieceCounter(path, room=20_000), random.Random(6)
    easy = ["a", "B", "é", "1", "²", "_", ".", " ", " ", "\n", "'s", "'", "...", ", ", ". ", "中", "́", "😀", "word", ";", "!\n"]
    odd = ["\n\n", "\t", "\xa0", "　", "\x85", "<|endoftext|>", "<|", "\x01", "\x02", "\r\n", "​", "\x00"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 14))) for marks in (easy, easy + odd) for _ in range(5000)]
    got = [n for at in range(0, len(texts), 500) for n in pieces.counts(texts[at : at + 500], step=700)]
    want = [len(e.ids) for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert all(n in (None, m) for n, m in zip(got, want)) and sum(n is not None for n in got) > len(texts) / 4
    met = []
    pieces._each = pieces._together = lambda texts: met.extend(texts) or [1] * len(texts)
    prose = "Plain words, and more of them.\nPlain words again; and\n\nmore. " * 50 + "end"
    assert None not in pieces.counts([prose] * 20) and len("".join(met)) < len(prose)
    assert not counts.PieceCounter.fits(public_tokenizers.path("word_bpe_49k.json"))
