"""Needles in texts and texts cut at anchors, against brute force, by one automaton and by seeds."""

import random
import tracemalloc

import pytest

from quarry.operators import needles


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab é像") for _ in range(n))
    texts = [(i, word(rng.randint(0, 60))) for i in range(80)] + [(80, None), (81, ""), (7, "ab"), (7, "ab"), (82, "ab" * 20_000)]
    terms = [word(rng.randint(1, 7)) for _ in range(60)] + ["", "ab", "abab", "b", "nowhere"]
    return texts, terms, spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(list(enumerate(terms)), "m int, n string")


@pytest.mark.parametrize("held", [needles.HELD, 0])
def test_text_matches(tables, held):
    texts, terms, t, n = tables
    want = sorted((k, m) for k, x in texts for m, y in enumerate(terms) if x and y and y in x)
    assert sorted((r.k, r.m) for r in needles.text_matches(t, n, "t", "n", held).collect()) == want
    assert needles.text_matches(t.limit(0), n, "t", "n", held).count() == needles.text_matches(t, n.limit(0), "t", "n", held).count() == 0


def cut_by_hand(text, anchors):
    out, plain, at = [], "", 0
    while at < len(text or ""):
        best = max((a for a in anchors if a and text.startswith(a, at)), key=len, default=None)
        if best is None:
            plain, at = plain + text[at], at + 1
            continue
        if plain:
            out.append((plain, False))
        out.append((best, True))
        plain, at = "", at + len(best)
    return [*out, (plain, False)] if out and plain else out


@pytest.mark.parametrize("held", [needles.HELD, 0])
@pytest.mark.parametrize("few", [3, 60])
def test_tokenise(tables, held, few):
    texts, terms, t, n = tables
    some = [x for x in terms if x][:few]
    got = needles.tokenise(t, n.where(n.n.isin(some)), "t", "n", held=held)
    want = sorted((k, [*map(tuple, cut_by_hand(x, some))]) for k, x in texts)
    assert sorted((r.k, [tuple(p) for p in r.tokens]) for r in got.collect()) == want
    assert all(r.tokens == [] for r in needles.tokenise(t, n.limit(0), "t", "n", held=held).collect())


def test_python_holds_few_parts_at_a_time(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20)
    df = spark.createDataFrame([(1, "ab")], "k int, t string")
    needles.tokenise(df, df.selectExpr("'a' as n"), "t", "n").collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    rng, some = random.Random(6), ["a", "ab", "abab", "bb"]
    texts = ["".join(rng.choice("ab ") for _ in range(200_000)), "b" * 99_999, " ", None]
    automaton = needles._automaton(some)
    assert [list(needles.cut(t, automaton)) for t in texts] == [cut_by_hand(t, some) for t in texts]
    tracemalloc.start()
    got = needles._cut_all((t, automaton) for t in texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) for x in got] == [len(cut_by_hand(t, some)) for t in texts]
    assert most < 12 << 20
