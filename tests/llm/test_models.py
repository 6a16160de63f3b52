"""Operators with fitted models: held-out accuracy on the given tables, and defined results for odd rows."""

import itertools
import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import language, queries, toxicity

DATA = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = queries.queries()["op9_language_id"](spark, DATA)
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text")
    both = got.join(truth, "doc_id").where("held_out and lang is not null and length(text) > 40")
    right, n = both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert n > 100
    assert right > 0.95


def test_toxicity_held_out(spark):
    # the next larger tables: the smaller ones hold back six toxic texts only
    larger = "/root/testdata/sf0.1"
    got = queries.queries()["op10_toxicity"](spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    toxic = [r.score for r in got if r.toxic]
    clean = [r.score for r in got if not r.toxic]
    auc = sum((t > c) + 0.5 * (t == c) for t in toxic for c in clean) / (len(toxic) * len(clean))
    assert len(toxic) > 30
    assert auc > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", 1), (2, "der hund und die katze", "de", 1), (None, None, None, 1), (3, "", "en", 1), (3, "123 !!", "en", 1)], "doc_id long, text string, lang string, score int")
    got = {(r.doc_id, r.lang_pred) for r in language.predict_language(docs, docs).collect()}
    assert got == {(1, "en"), (2, "de"), (None, "und"), (3, "und")}
    assert {r.lang_pred for r in language.predict_language(docs, docs.limit(0)).collect()} == {"und"}
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(docs, labels, F.lit(True)).collect()
    assert len(scored) == 5
    assert {r.predicted for r in scored} == {0}
    assert toxicity.score_toxicity(docs.limit(0), labels, F.lit(True)).count() == 0


def test_decoding(spark):
    docs = spark.createDataFrame([(1, "stupid people say stupid things " * 40)], "doc_id long, text string")
    model = toxicity.language_model(toxicity.letter_counts(docs))
    assert toxicity.decode("stup1d", model) == "stupid"
    assert toxicity.decode("pe0ple", model) == "people"
    assert toxicity.decode("s t u p i d", model).replace(" ", "") == "stupid"
    assert toxicity.decode("stup1d" * 3000, model) == "stupid" * 3000


def options(c, last):
    if c.isalpha():
        return [(c, 0.0)] + ([("", toxicity.REPEAT)] if c == last else [])
    if c == " ":
        return [(" ", 0.0), ("", toxicity.DROP)]
    out = [(x, toxicity.STAND_IN) for x in toxicity.LEET.get(c, "")]
    if c in toxicity.FILLERS or not out:
        return [*out, ("", toxicity.DROP)]
    return out + ([("", toxicity.REPEAT)] if c == last else [])


def way(model, chosen):
    a = b = 0
    total, out = 0.0, []
    for o, extra in chosen:
        total += extra
        if o and not (o == " " and b == 0):
            k = toxicity.symbol(o)
            total, a, b = total + model[a][b][k], b, k
            out.append(o)
    return total + model[a][b][0], "".join(out)


def test_decoding_against_all_ways():
    rng = random.Random(3)
    model = toxicity.language_model(np.random.default_rng(1).integers(0, 40, (28, 28, 28)).astype(float))
    for _ in range(100):
        text = "".join(rng.choice("ab1!$0. @l") for _ in range(rng.randint(1, 7)))
        ways = [way(model, p) for p in itertools.product(*[options(c, text[i - 1] if i else "") for i, c in enumerate(text)])]
        assert toxicity.decode(text, model, look=3) in {said for cost, said in ways if cost < min(ways)[0] + 1e-9}
        word = "".join(rng.choice("aab") for _ in range(rng.randint(1, 12)))
        assert toxicity.undoubled(word, model) in (None, toxicity.decode(word, model))
        text = "".join(rng.choice("abst1!$0. @l") for _ in range(300))
        assert toxicity.decode(text, model, look=7) == toxicity.decode(text, model)


def test_slices_count_alike(monkeypatch, spark):
    text = "Ein Süßer Hund und die Katze, 12 mal. " * 300
    whole = np.concatenate(list(language.grams(text)))
    assert np.array_equal(np.concatenate(list(language.grams(text, 97))), whole)
    docs = spark.createDataFrame([(text,)], "text string")
    counts = toxicity.letter_counts(docs)
    monkeypatch.setattr(toxicity, "SLICE", 101)
    assert np.array_equal(toxicity.letter_counts(docs), counts)


def test_codes_against_loss_by_hand(spark):
    rng = random.Random(6)
    langs = [f"l{k}" for k in range(9)]
    rows = [(k, " ".join("".join(rng.choice("abcdefgh"[j % 5 : j % 5 + 4]) for _ in range(5)) for _ in range(rng.randint(1, 12))), langs[j]) for k, j in ((k, k % 9) for k in range(90))]
    docs = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, lang string, score string, ambiguous boolean")
    counts = {x: np.zeros(language.BUCKETS) for x in langs}
    for _, text, x in rows:
        np.add.at(counts[x], np.concatenate(list(language.grams(text))), 1)
    code = language.codewords(9)
    assert len({c.tobytes() for c in code}) == 9
    p = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * language.BUCKETS) for x in langs])
    got = {r.doc_id: r for r in language.predict_language(docs, docs).collect()}
    for i, text, _ in rows:
        g = np.concatenate(list(language.grams(text)))
        loss = np.zeros(9)
        for bit in range(code.shape[1]):
            odds = np.log(p[code[:, bit] == 1].mean(axis=0) / p[code[:, bit] == -1].mean(axis=0))[g].mean()
            loss += np.log1p(np.exp(-code[:, bit] * odds * language.SLOPE))
        order = np.argsort(loss)
        assert loss[order[1]] - loss[order[0]] < 1e-4 or got[i].lang_pred == langs[order[0]]
        assert abs(got[i].score - np.exp(-loss[order[0]]) / np.exp(-loss).sum()) < 1e-3
        assert got[i].ambiguous == (loss[order[1]] <= loss[order[0]] * (1 + language.GAP)) or abs(loss[order[1]] / loss[order[0]] - 1 - language.GAP) < 1e-3


def test_stand_ins_everywhere(spark):
    docs = spark.createDataFrame([(1, "stupid people say stupid things and an ass is an ass as stupid people say " * 40)], "doc_id long, text string")
    restore = toxicity.Restorer(toxicity.language_model(toxicity.letter_counts(docs)))
    for word, shown in [("stupid", ["$tupid", "$tupid!", "($tupid)", "stuupid", "stuupid,", "s t u p i d!", "is it s t u p i d.", '"$tup!d"']), ("ass", ["@ss", "a$$", "as$", "as$!", "455", "@$$", "@$$!", "a s $"])]:
        for text in shown:
            assert word in restore.words(text), text
    assert set(restore.words("say people, things.")) == {"say", "people", "things"}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES[:-1]:
        path = corpus_pipeline.shared_dir(spark, f"test-{name}")
        f(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_pipeline_stages(spark, stages):
    for before, after in zip(stages, stages[1:]):
        assert after.columns == before.columns
        assert after.exceptAll(before).count() == 0
    assert stages[3].count() == stages[4].count()
    assert stages[4].count() > 0.5 * stages[0].count()
    last = corpus_pipeline.STAGES[-1][1](spark, stages[4], DATA)
    assert last.count() == stages[4].count()
    assert last.where("n_tokens < 1").count() == 0
