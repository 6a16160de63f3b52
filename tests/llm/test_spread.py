"""Rows alike are spread over the tasks; samples are bounded by rows; odd names, empty tables and long texts pass."""

import random
import weakref

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import common, counts, language, mixing, simhash, tokens, toxicity

ALIKE = 10_000


@pytest.fixture(scope="module")
def alike(spark):
    """One row, many times."""
    return spark.range(ALIKE).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same words here").alias("text"), F.lit("s").alias("source"), F.lit(1).alias("a.b"))


def test_mixing_spreads_rows_alike(spark, alike):
    path = common.shared_dir(spark, "alike")
    alike.repartition(8).write.parquet(path)
    read = spark.read.parquet(path)
    rows = common.placed_rows(read).select(F.pmod(F.xxhash64("own", "place"), F.lit(ALIKE // mixing.BUCKET_ROWS)).alias("bucket")).groupBy("bucket").count().collect()
    assert len(rows) == ALIKE // mixing.BUCKET_ROWS
    assert max(r["count"] for r in rows) < 2 * mixing.BUCKET_ROWS
    for df in (read, alike):
        got = mixing.mix(df)
        assert got.columns == [*alike.columns, "mix_block", "mix_slot", "mix_rank"]
        assert got.select("mix_block", "mix_rank").distinct().count() == ALIKE == got.count()
        assert got.agg(F.max("mix_slot")).first()[0] == -(-ALIKE // mixing.BLOCK_DOCS) - 1


def test_token_shards_spread_rows_alike(spark, alike):
    path = common.shared_dir(spark, "tokens-alike")
    got = tokens.token_output(alike.repartition(3), public_tokenizers.path("word_bpe_49k.json"), path=path)
    parts = spark.read.parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_docs").alias("n")).collect()
    assert len(parts) >= int(spark.conf.get("spark.sql.shuffle.partitions")) // 2 and max(r.n for r in parts) <= ALIKE // 2
    starts = sorted(r.start for r in got.collect())
    [n] = {r.n_tokens for r in got.collect()}
    assert starts == list(range(0, ALIKE * n, n))


def test_documents_that_share_an_id_are_all_read(spark):
    docs = spark.createDataFrame([(1, "one"), (1, "two words"), (2, "three")], "doc_id long, text string")
    path, file = common.shared_dir(spark, "tokens-shared"), public_tokenizers.path("word_bpe_49k.json")
    tokens.token_output(docs, file, path=path).count()
    t = tokens.encoder(file).whole
    want = sorted((i, [*t.encode(x, add_special_tokens=False).ids, 1]) for i, x in docs.collect())
    assert sorted((i, a.tolist()) for i, a in tokens.read_rows(spark, path, [1, 2])) == want
    assert tokens.read_documents(spark, path, [2])[2].tolist() == want[2][1]
    with pytest.raises(ValueError, match="share an id"):
        tokens.read_documents(spark, path, [1])


def test_toxicity_fits_one_row_an_id(spark, monkeypatch):
    docs = spark.range(500).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("words "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(7, "you vile thing"), (8, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(5, 0), (7, 1), (7, 0), (8, 0), (None, 1)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fitted
    monkeypatch.setattr(toxicity, "fitted", lambda sample, model: (seen.append(sorted((r.doc_id, r.toxic) for r in sample.collect())), fit(sample, model))[1])
    got = toxicity.score_toxicity(docs, labels, F.lit(True))
    assert seen == [[(5, 0), (7, 1), (8, 0)]]
    assert got.count() == 502


def test_pipeline_keeps_columns_of_any_name(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").select("*", F.col("doc_id").alias("a.b"), F.lit("x").alias("row"), F.lit(2).alias("own"), F.lit(3).alias("we`ird"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = common.shared_dir(spark, name)
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns, name
        docs = kept
    assert docs.where("`a.b` = doc_id and row = 'x' and own = 2").count() == docs.count() > 30
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_empty_tables_and_clashing_columns(spark):
    odd = spark.createDataFrame([(1, "Some text here", "en", "s", 9, "x"), (1, "Some text here", "en", "s", 9, "x"), (None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_tokens int, fingerprint string")
    file = public_tokenizers.path("byte_bpe_50k.json")
    assert sorted((r.n_tokens for r in counts.count_tokens(odd, file).collect())) == [0, 3, 3]
    assert counts.count_tokens(odd.limit(0), file).count() == 0
    groups = simhash.simhash_groups(odd)
    assert sorted((r.id is None, r.id) for r in groups.collect()) == [(False, 1), (False, 1), (True, None)]
    assert simhash.simhash_groups(odd.limit(0)).count() == 0
    labelled = odd.where("lang is not null")
    assert {(r.doc_id, r.lang_pred) for r in language.predict_language(odd, labelled).collect()} == {(1, "en"), (None, "und")}
    assert language.predict_language(odd.limit(0), labelled).count() == 0
    assert language.predict_language(odd, labelled.limit(0)).count() == 3


def test_words_spelt_in_pieces_are_restored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    model = toxicity.language_model(toxicity.letter_counts(docs))
    weights = {"stupid": 4.0, "clown": 3.0, "idio*": 2.0}
    score = toxicity.Scorer(model, weights, [-4.0, 1.0, 0.0, 0.0, 0.0])
    for piece in ("stupid", "stu pid", "st up id", "s t u p id", "s-t u-p i-d", "s t u p i d", "stuupid", "$tup1d", "s.t.u.p.i.d", "cl own", "c l o w n"):
        assert score(f"you are {piece} said he") > 0.25, piece
    clean = "you are st and up in the id of a s t"
    assert score(clean) < 0.05
    assert all(score(r.text) < 0.05 for r in docs.where("not text rlike '(?i)st?upid|clown|idio'").limit(100).collect())


def test_the_encoder_learns_each_word_once():
    code = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    asked, together, each = [], code._together, code._each
    code._together = lambda words: asked.extend(words) or together(words)
    code._each = lambda words: asked.extend(words) or each(words)
    texts = ["word other", "Word, other.\nWord", "a\n\nb \n a\r\nx", "\n", "don'\nt it's\n's", "e\ńx 1\n2..\n..", "<|endoftext|>\n<|endoftext|>", ""]
    got = [[int.from_bytes(x[i : i + 2], "little") for i in range(0, len(x), 2)] for x in (code(t) for t in texts)]
    assert got == [code.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(asked.count(w) == 1 for w in ("word", "other", ",", "."))
    assert not any("\n" in w for w in asked)


def test_the_encoder_folds_texts_and_sets_signs_off():
    """Case and signs behind words make no new pieces; ids stay the library's, also where folding alone would be wrong."""
    code, rng = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), room=20_000), random.Random(2)
    code.batch(["Wort wort, WORT. wort;\nWort! wort"])
    assert set(code.young) == {"wort", ",", ".", ";", "!"}
    marks = ["a", "B", "é", "É", "ß", "1", "²", "_", ".", " ", " ", " ", "\n", "\t", "\xa0", "'s", "'S", "'", "...", ", ", ". ", "µ", "ª", "word", "The", ";", "!\n"]
    odd = ["<|endoftext|>", "<|ENDOFTEXT|>", "İ", "Σ", "ς", "中", "́", "😀", "\x85", "\x00"]
    texts = ["".join(rng.choices(kinds, k=rng.randint(0, 14))) for kinds in (marks, marks + odd) for _ in range(3000)]
    want = [np.array(e.ids, "<u2").tobytes() for e in code.whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x for at in range(0, len(texts), 500) for x in code.batch(texts[at : at + 500], step=900)] == want


def test_the_encoder_meets_a_word_once_whatever_signs_follow():
    """Runs of signs and a text's last sign make no new pieces, a known piece isn't met again, and ids stay the library's."""
    code, rng = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), room=9_000), random.Random(3)
    code.batch(["Wort&&& wort*** wort.\nwort.### wort_ wort"])
    assert set(code.young) == {"wort", "&&&", "***", ".", ".###", "_"}
    met, learn = [], code._learn
    code._learn = lambda new: met.extend(new) or learn(new)
    code.batch(["wort&&& Wort. neu."])
    assert met == ["neu"]
    marks = ["a", "B", "É", "1", "²", "_", "&&", ".", "'", "'s", "<", "|", ">", "(", "-", " ", " ", "\n", "word", "x" * 70, "İ", "’"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 12))) for _ in range(4000)]
    want = [np.array(e.ids, "<u2").tobytes() for e in code.whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x for at in range(0, len(texts), 500) for x in code.batch(texts[at : at + 500], step=900)] == want
    assert len(code.young) < 9_000 // code.ENTRY and max(map(len, code.young)) <= code.longest


def test_workers_keep_one_operators_store():
    """The encoder outlasts a task, but not the start of another operator's tasks in the same worker process."""
    path = public_tokenizers.path("word_bpe_49k.json")
    kept = weakref.ref(tokens.encoder(path))
    assert kept() is not None and tokens.encoder(path) is kept()
    common.worker_store("simhash")
    assert kept() is None
    assert common.worker_store("simhash") is common.worker_store("simhash")


def test_near_duplicates_sort_no_texts(spark):
    """Rows meet those to keep by a hash of their numbers, so no task sorts whole rows."""
    path, key = common.shared_dir(spark, "unsorted"), "spark.sql.autoBroadcastJoinThreshold"
    spark.createDataFrame([(i, f"word{i} and some more {i * 7}") for i in range(50)], "doc_id long, text string").write.parquet(path)
    known = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = corpus_pipeline.near_duplicates(spark, spark.read.parquet(path), None)
        top = got._jdf.queryExecution().sparkPlan().toString().splitlines()[:3]
        assert any("ShuffledHashJoin" in line and "LeftSemi" in line for line in top), top
        assert got.count() == 50
    finally:
        spark.conf.set(key, known)
