"""Stages of the pipeline on planted rows, held against brute force."""

import random

import corpus_pipeline

from quarry.llm import common

KIND = "doc_id long, text string"


def written(spark, rows, kind=KIND):
    path = common.shared_dir(spark, "pipeline-test")
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def at_similarity(rng, n, target, tag):
    """Two texts of n shingles, the second with a changed end so that their sets have the Jaccard ``target`` or next above."""
    words = [f"{tag}w{rng.randrange(10**9)}" for _ in range(n + 4)]
    changed = int(n * (1 - target) / (1 + target) + 1e-9)
    return " ".join(words), " ".join([*words[: len(words) - changed], *(f"{tag}z{k}" for k in range(changed))])


def test_near_duplicates_by_similarity(spark):
    rng = random.Random(8)
    texts = []
    for target in (0.75, 0.8, 0.85, 0.9):
        for k in range(40):
            texts += at_similarity(rng, (28, 90, 180, 360)[k % 4], target, f"t{int(target * 100)}k{k}")
    texts += [" ".join(["again"] * 60 + [f"tail{k}w{j}" for j in range(30)]) for k in range(6)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    sets = {i: shingles(t) for i, t in zip(ids, texts)}
    group = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if i < j and group[i] != group[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    got = corpus_pipeline.near_duplicates(spark, written(spark, list(zip(ids, texts))), None)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(group.values()))
    assert got.count() == len(texts) - 120


def test_stages_decide_by_row(spark):
    item = " ".join(f"item{k}" for k in range(30))
    clean = [" ".join(f"c{n}w{k}" for k in range(20)) for n in range(300)]
    toxic = [f"{t} wretched wretched vilefool" for t in clean[:100]]
    d = common.shared_dir(spark, "stages-test")
    labels = [(i, int(i < 100)) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    train = [(i, toxic[i] if i < 100 else clean[i]) for i in range(300)]
    odd = [(None, "some wretched vilefool here"), (None, "a kind word here"), (270, "the wretched vilefool again"), (270, "a good word again")]
    got = corpus_pipeline.toxicity(spark, written(spark, train + odd), d)
    texts = {r.text for r in got.collect()}
    assert got.columns == ["doc_id", "text"]
    assert texts.isdisjoint({odd[0][1], odd[2][1], *toxic})
    assert texts >= {odd[1][1], odd[3][1], clean[270]}
    rows = [(None, "before " + item), (5, item + " after"), (5, clean[1]), (None, clean[2]), (6, clean[3])]
    got = corpus_pipeline.decontamination(spark, written(spark, rows), d)
    assert {(r.doc_id, r.text) for r in got.collect()} == set(rows[2:])
    rows = [(None, clean[4]), (None, clean[4]), (7, clean[5]), (7, clean[5]), (7, clean[6]), (None, clean[5]), (None, clean[7])]
    got = corpus_pipeline.near_duplicates(spark, written(spark, rows), d)
    assert sorted((r.text, r.doc_id) for r in got.collect()) == [(clean[4], None), (clean[5], 7), (clean[6], 7), (clean[7], None)]


def test_stages_keep_clashing_columns(spark):
    """Columns named like what the stages add inside, of types that can't be compared, pass through all filters and the mixing."""
    d = common.shared_dir(spark, "clash-test")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    names = "row own place path name rank component node score predicted _own0 item_id mix_key first k".split()
    rows = [(i % 5 if i % 4 else None, f"word{i} and some more of it {i * 7}" if i % 3 else None, "s", {"x": i}, *[i] * len(names)) for i in range(30)]
    docs = written(spark, rows, "doc_id long, text string, source string, m map<string,int>, " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, d)
        assert got.columns == docs.columns, name
        path = common.shared_dir(spark, f"clash-{name}")
        got.write.parquet(path)
        docs = spark.read.parquet(path)
    # rows without text are one group of near copies
    assert sorted(r.row for r in docs.select("row").collect()) == sorted([min((i for i in range(0, 30, 3) if i % 4), key=lambda i: i % 5), *(i for i in range(30) if i % 3)])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert last.count() == docs.count()
    empty = written(spark, [], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0, name


def test_large_group_of_near_copies(spark):
    """Copies at all distances from one text: groups as by brute force, and far fewer pairs than all."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(150):
        words = list(base)
        for _ in range(k % 7):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if group[i] != group[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    got = corpus_pipeline.near_duplicates(spark, written(spark, list(enumerate(texts))), None)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(group))
