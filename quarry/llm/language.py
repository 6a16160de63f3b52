"""Language identification with error-correcting output codes over character trigrams."""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, table

#: Buckets of trigrams, and how steeply a bit's mean log-odds counts.
BUCKETS, SLOPE = 1 << 14, 5.0
#: A prediction whose loss is within this share of the next one's is ambiguous.
GAP = 0.1
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _letters[0]


def grams(text: str | None, step: int = 1 << 20) -> Iterator[np.ndarray]:
    """Buckets of a text's trigrams that hold a letter; case is folded, all but letters are blanks. In slices."""
    known = _is_letter()
    text = f" {(text or '').lower()} "
    for at in range(0, len(text) - 2, step):  # a slice's last trigram ends two characters into the next
        codes = np.frombuffer(text[at : at + step + 2].encode("utf-32-le", "replace"), dtype=np.uint32)
        letter = known[codes]
        if not letter.any():
            continue
        c = np.where(letter, codes, 32).astype(np.uint32)
        h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
        yield ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))[letter[:-2] | letter[1:-1] | letter[2:]]


def codewords(n: int, seed: int = 1) -> np.ndarray:
    """n rows of +-1: up to 7 classes all two-way splits, beyond that random ones, rows and columns distinct."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 7:
        return np.array([[1 if (b >> r) & 1 else -1 for b in range(1, 1 << (n - 1))] for r in range(n)], dtype=np.int8)
    rng, width = np.random.default_rng(seed), 10 * math.ceil(math.log2(n))
    while True:
        code = rng.choice(np.array([-1, 1], dtype=np.int8), (n, width))
        if len({r.tobytes() for r in code}) == n and (abs(code.sum(axis=0)) < n).all():
            return code


def gram_counts(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Trigram counts of every language over all rows of (text, lang); summed by Spark, one array a language comes back."""
    bounded_batches(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).extend(grams(text))
            for lang, parts in by.items():
                counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                if parts:
                    counts[lang] += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        for lang, c in counts.items():
            seen = np.flatnonzero(c)
            if not len(seen):
                seen = np.zeros(1, dtype=np.int64)  # a language of texts without letters is known too
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(c[seen], pa.int64())], names=["lang", "gram", "n"])

    parts = labelled.select("text", "lang").mapInArrow(run, "lang string, gram int, n long")
    sums = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = sums.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("c")).select("lang", F.col("c.gram").alias("gram"), F.col("c.n").alias("n")).collect()
    out = {r.lang: np.zeros(BUCKETS) for r in rows}
    for r in rows:
        out[r.lang][r.gram] = r.n
    return dict(sorted(out.items()))


def bit_weights(counts: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, codewords, log-odds of every trigram for every bit)."""
    langs = sorted(counts)
    code = codewords(len(langs))
    if not langs:
        return langs, code, np.zeros((BUCKETS, 1), dtype=np.float32)
    p = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS) for x in langs])
    side = lambda sign: np.array([p[code[:, b] == sign].mean(axis=0) if (code[:, b] == sign).any() else p.mean(axis=0) for b in range(code.shape[1])])
    return langs, code, np.log(side(1) / side(-1)).T.astype(np.float32)


def predict_language(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row of ``docs``, learned from (text, lang) of ``labelled``.

    Every bit of the languages' codewords has a binary classifier, the mean log-odds of a text's trigrams. The
    language whose codeword has the least logistic loss over all bits is predicted; score is its share of
    exp(-loss), and ``ambiguous`` marks a runner-up within a tenth of its loss. Null texts and texts without
    a letter are ``und`` with score 0, as is everything when nothing is labelled. Null and repeated ids keep
    their rows; other columns are ignored.
    """
    langs, code, weights = bit_weights(gram_counts(labelled.where("text is not null and lang is not null")))
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                total, n = np.zeros(weights.shape[1]), 0
                for g in grams(text):
                    total += weights[g].sum(axis=0, dtype=np.float64)
                    n += len(g)
                if not n or not langs:
                    out.append(("und", 0.0, False))
                    continue
                loss = np.logaddexp(0, -code * (total / n) * SLOPE).sum(axis=1)
                best = int(loss.argmin())
                share = np.exp(-(loss - loss[best]))
                rest = np.delete(loss, best)
                out.append((langs[best], float(share[best] / share.sum()), bool(len(rest) and rest.min() <= loss[best] * (1 + GAP))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.float64(), pa.bool_())))], names=["doc_id", "lang_pred", "score", "ambiguous"])

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = predict_language(docs, docs.where(~held))
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
