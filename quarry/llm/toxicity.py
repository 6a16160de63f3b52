"""Toxicity of texts restored through a noisy channel."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quarry.llm.common import Kept, bounded_batches, table, worker_store

#: Labelled documents that the classifier is fitted on at most: those whose ids hash lowest.
TRAIN_DOCS = 20_000
#: A word counts if, two standard errors below its log-odds, it is still this much likelier in toxic texts.
LEAST_ODDS = 4.0
#: Lengths of beginnings that are features.
STEMS = (4, 5, 6, 7)
#: Letters of a word that is looked for in pieces with blanks between.
LEAST_CHUNKED = 5
#: Symbols of the language model: 0 a word's edge, 1-26 a-z, 27 any other letter.
SYMBOLS = 28
#: What a sign can stand for in disguised words.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "§": "s"}
#: Signs put between letters.
FILLERS = frozenset(".-_*'`~,^:;/\\#&%=\"​‌‍­·•")
#: Characters of a text counted at once, and of a disguised token after which its ways are looked through for what they share.
SLICE, LOOK = 1 << 20, 1024
#: Costs in nats: a stand-in, a filler or blank dropped, a repeated letter dropped.
STAND_IN, DROP, REPEAT = 1.0, 0.5, 0.7

_ENDS = re.compile(r"^\W+|[^\w@$!|+]+$")
_CLEAN = re.compile(r"[^\W\d_]+")
_TWICE = re.compile(r"(.)\1")
_SIGN = re.compile("[" + re.escape("".join(LEET)) + "]")
#: Marks around a word that may also be stand-ins: those of sentences, and bars too.
_MARKS = re.compile(r"""^[(<\["'“‘]+|[!?.,;:)>\]"'”’]+$""")
_BARS = re.compile(r"""^[(<\["'“‘|]+|[!?.,;:)>\]"'”’|+]+$""")
_PLAIN_END = re.compile(r"[!|+$@]+$")
#: Rows of three or more tokens that may be single characters, and of two or more pieces that may make a word.
_SHORT = re.compile(r"(?<!\S)\S{1,4}(?:\s+\S{1,4}(?!\S)){2,}(?!\S)")
_PIECES = re.compile(r"(?<!\S)\S{1,3}(?:\s+\S{1,3}(?!\S))+")


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


_TABLE = np.zeros(256, dtype=np.int32)
for _c in range(256):
    _TABLE[_c] = symbol(chr(_c).lower()) if chr(_c).isalpha() else 0


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all whole texts, [before last, last, next]."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("toxicity")
        counts = np.zeros(SYMBOLS**3, dtype=np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                text = f"  {(text or '').lower()}  "  # two blanks at either end of the whole text, none at a slice's
                for at in range(0, len(text) - 2, SLICE):
                    s = _TABLE[np.frombuffer(text[at : at + SLICE + 2].encode("latin-1", "replace"), dtype=np.uint8)]
                    counts += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3) if len(s) > 4096 else 0
                    if len(s) <= 4096:
                        np.add.at(counts, s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], 1)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], names=["k", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # SYMBOLS**3 at most
    out = np.zeros(SYMBOLS**3)
    for r in rows:
        out[r.k] = r.n
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def language_model(counts: np.ndarray) -> list:
    """Costs -log p(next | two before), backing off to one before; nested lists for quick reading."""
    counts = counts.copy()
    counts[:, 0, 0] = 0  # runs of blanks say nothing
    pair = counts.sum(axis=0)
    low = (pair + 0.5) / (pair.sum(axis=1, keepdims=True) + 0.5 * SYMBOLS)
    p = (counts + 5 * low[None]) / (counts.sum(axis=2, keepdims=True) + 5)
    return (-np.log(p)).tolist()


def _shared(ends: list[tuple | None]) -> tuple[list[str], dict[int, tuple | None]]:
    """What all ways begin with, and what is left of each, by the way's identity. Ways are chains (symbol, way before)."""
    chains = {}
    for end in ends:
        chain, way = [], end
        while way:
            chain.append(way)
            way = way[1]
        chains[id(end)] = chain[::-1]
    n = 0
    for column in zip(*chains.values()):
        if any(x is not column[0] for x in column):
            break
        n += 1
    common = next(iter(chains.values()))[:n]
    left = {}
    for key, chain in chains.items():
        way = None
        for x in chain[n:]:
            way = (x[0], way)
        left[key] = way
    return [x[0] for x in common], left


def decode(text: Iterable[str], model: list, look: int = LOOK) -> str:
    """The likeliest text behind a disguise: Viterbi over the lattice of what each character can stand for.

    A letter stands for itself or, repeated, for nothing; signs and digits for the letters of LEET; fillers for nothing;
    a blank for a word's end or nothing. States are the last two symbols. The whole text is one lattice, whatever its length: every
    ``look`` characters what all ways share is put away, so memory stays small and nothing is cut.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    last, done = "", []
    for at, c in enumerate(text, 1):
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, 0.0))
            if c == last:
                options.append(("", REPEAT))
        elif c == " ":
            options += [(" ", 0.0), ("", DROP)]
        else:
            options += [(x, STAND_IN) for x in LEET.get(c, "")]
            if c in FILLERS or not options:
                options.append(("", DROP))
            elif c == last:
                options.append(("", REPEAT))
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, back) in states.items():
            for out, extra in options:
                if not out:
                    key, total, path = (a, b), cost + extra, back
                elif out == " " and b == 0:
                    key, total, path = (a, b), cost + extra, back
                else:
                    k = symbol(out)
                    key, total, path = (b, k), cost + extra + model[a][b][k], (out, back)
                if key not in new or total < new[key][0]:
                    new[key] = (total, path)
        states, last = new, c
        if at % look == 0:
            common, left = _shared([way for _, way in states.values()])
            done += common
            states = {k: (cost, left[id(way)]) for k, (cost, way) in states.items()}
    cost, path = min(((cost + model[a][b][0], back) for (a, b), (cost, back) in states.items()), key=lambda x: x[0])
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join([*done, *reversed(out)])


def undoubled(word: str, model: list) -> str | None:
    """What ``decode`` gives for a word of letters whose only disguise are letters written twice; None for others.

    Such a lattice falls apart: dropping one of two equal letters changes the costs of that letter and of the one behind only, so each pair is decided alone.
    """
    out, done = [], 0
    for m in _TWICE.finditer(word):
        i, j = m.span()
        if j < len(word) and word[j] == m[1]:
            return None
        k = symbol(m[1])
        y, behind = symbol(word[i - 1]) if i else 0, symbol(word[j]) if j < len(word) else 0
        keep, drop = model[y][k][k] + model[k][k][behind], REPEAT + model[y][k][behind]
        out.append(word[done : j - 1 if drop < keep else j])
        done = j
    return "".join([*out, word[done:]])


class Restorer:
    """Restored words of a text, keeping what tokens seen before, and disguises within them, stand for."""

    def __init__(self, model: list, keep: int = 50_000):
        self.model, self.seen, self.decoded, self.bares = model, Kept(keep), Kept(keep), Kept(keep)

    def decode(self, x: str) -> list[str]:
        if x.isalpha() and (plain := undoubled(x, self.model)) is not None:
            return [plain]
        got = self.decoded.get(x)
        if got is None:
            got = decode(x, self.model).split()
            if len(x) <= 64:
                self.decoded.put(x, got)
        return got

    def token(self, raw: str) -> tuple[str, ...]:
        """The word as it stands, without the signs around it, and what it decodes to if signs, digits or doubled letters may disguise it.

        Signs at an end can be stand-ins or marks, so the token is decoded with them and without.
        """
        if raw.isalpha() and not _TWICE.search(raw):
            return (raw,)
        core = _ENDS.sub("", raw)
        if not _SIGN.search(raw):  # no stand-in anywhere: all readings are the word without the signs around it
            if core.isalpha():
                return tuple(dict.fromkeys([core, *self.decode(core)])) if _TWICE.search(core) else (core,)
            return tuple(dict.fromkeys([*_CLEAN.findall(core), *(self.decode(core) if core else ())]))
        plain = _PLAIN_END.sub("", core)
        known = [plain] if plain.isalpha() else _CLEAN.findall(core)
        shown = dict.fromkeys(x if _SIGN.search(x) else _ENDS.sub("", x) for x in (raw, _MARKS.sub("", raw), _BARS.sub("", raw), core))
        parts: list[str] = []
        for x in shown:
            if x and not (x.isalpha() and not _TWICE.search(x)):
                parts += self.decode(x)
        return tuple(dict.fromkeys([*known, *parts]))

    def spaced(self, run: list[str]) -> list[str]:
        """Words of a run of single characters."""
        return decode(" ".join(run), self.model).split()

    def words(self, text: str | None) -> dict[str, int]:
        """How often each restored word occurs, a text's distinct tokens being restored once."""
        low = (text or "").lower()
        tokens = Counter(low.split())
        found: dict[str, int] = {}
        for t, n in tokens.items():
            if len(t) > 64:
                got = self.token(t)
            elif (got := self.seen.young.get(t)) is None and (got := self.seen.get(t)) is None:
                self.seen.put(t, got := self.token(t))
            for w in got:
                found[w] = found.get(w, 0) + n
        for w in self.single(low, tokens):
            found[w] = found.get(w, 0) + 1
        return found

    def bare(self, t: str) -> str:
        """The one character that a short token is without marks around it, else nothing."""
        got = self.bares.get(t)
        if got is None:
            left = t if len(t) == 1 else _MARKS.sub("", t)
            self.bares.put(t, got := left if len(left) == 1 else "")
        return got

    def single(self, low: str, tokens: Iterable[str]) -> list[str]:
        """Words spelt in single characters, three or more in a row; a mark behind one ends the row."""
        if sum(len(t) <= 4 and bool(self.bare(t)) for t in tokens) < 2:
            return []
        out: list[str] = []
        for m in _SHORT.finditer(low):
            run: list[str] = []
            for t in [*m[0].split(), ""]:
                bare = self.bare(t) if t else ""
                if bare:
                    run.append(bare)
                if not bare or (len(t) > 1 and t[-1] != bare):
                    if len(run) >= 3:
                        out += self.spaced(run)
                    run = []
        return out

    def chunked(self, low: str, known: frozenset[str], longest: int) -> list[str]:
        """Words among ``known`` that are spelt in short pieces with blanks between, where the letter model too reads the pieces as that word.

        The lattice lets every blank, and the signs within pieces, stand for nothing; it is asked only where the letters of pieces in a row are a known word.
        """
        out: list[str] = []
        for m in _PIECES.finditer(low):
            pieces = m[0].split()
            letters = [t if t.isalpha() else "".join(c for c in t if c.isalpha()) for t in pieces]
            for i, joined in enumerate(letters[:-1]):
                if joined:
                    for j in range(i + 1, len(letters)):
                        if not letters[j]:
                            break
                        joined += letters[j]
                        if joined in known and joined in self.decode(" ".join(pieces[i : j + 1])):
                            out.append(joined)
                        if len(joined) >= longest:
                            break
        return out


def features(word: str) -> list[str]:
    """A word and its beginnings, which tell of words that are built alike."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


class Scorer:
    """Log-odds that a text is toxic: a logistic regression on what its telling features weigh."""

    def __init__(self, model: list, weights: dict[str, float], beta: np.ndarray | None = None):
        self.restore, self.weights, self.beta, self.known = Restorer(model, 20_000), weights, beta, Kept(150_000)
        whole = frozenset(w for w in weights if not w.endswith("*") and len(w) >= LEAST_CHUNKED)
        self.whole, self.longest = whole, max(map(len, whole), default=0)

    def weight(self, word: str) -> float:
        return max((self.weights[f] for f in features(word) if f in self.weights), default=0.0)

    def token(self, t: str) -> int | tuple[int, dict[str, float]]:
        """What a token adds: how many words, and the weights of those that have one."""
        known = self.known.get(t)
        if known is None:
            words = self.restore.token(t)
            heavy = {w: x for w in words if (x := self.weight(w))}
            known = (len(words), heavy) if heavy else len(words)
            if len(t) <= 64:
                self.known.put(t, known)
        return known

    def row(self, text: str | None) -> list[float]:
        """[1, weight of the strongest word, weights of all words a hundred, their sum with diminishing returns, size]."""
        low = (text or "").lower()
        tokens, young, n = Counter(low.split()), self.known.young, 0
        hits: dict[str, float] = {}
        for t, k in tokens.items():
            told = young.get(t)
            if told is None:
                told = self.token(t)
                young = self.known.young
            if told.__class__ is int:
                n += k * told
            else:
                n += k * told[0]
                hits |= told[1]
        spelt = self.restore.single(low, tokens)
        if self.whole:
            spelt += self.restore.chunked(low, self.whole, self.longest)
        n += len(spelt)
        for w in spelt:
            if w not in hits and (x := self.weight(w)):
                hits[w] = x
        total = sum(hits.values())
        return [1.0, max(hits.values(), default=0.0), 20 * total / (n + 20), math.log1p(total), math.log1p(n) / 5]

    def __call__(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, float(np.dot(self.beta, self.row(text)))))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - ridge * beta
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        beta += step
        if abs(step).max() < 1e-8:
            break
    return beta


def telling(sample: DataFrame, model: list) -> dict[str, float]:
    """Log-odds of the features that tell, from (text, toxic) rows, by which features a text has."""
    bounded_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("toxicity")
        restore = Restorer(model)
        for b in batches:
            seen = (Counter(), Counter())
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[label].update({f for w in restore.words(text) for f in features(w)})
            words = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([seen[k][w] for w in words], pa.int64()) for k in (1, 0))], names=["word", "t", "c"])

    texts = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    df = sample.select("text", "toxic").mapInArrow(run, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (texts.get(1, 0) + 1)) - F.log((F.col("c") + 0.5) / (texts.get(0, 0) + 1))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    told = df.withColumn("w", odds).where(F.col("w") - 2 * error > math.log(LEAST_ODDS))
    # of a bounded sample of documents, those features that it shows to tell
    return {r.word: r.w for r in told.select("word", "w").collect()}


def fitted(sample: DataFrame, model: list) -> Scorer:
    """Features from two thirds of (doc_id, text, toxic), the regression from the rest, which the features haven't seen."""
    third = F.pmod(F.xxhash64(F.lit("third"), "doc_id"), F.lit(3)) == 0
    weights = telling(sample.where(~third), model)
    scorer = Scorer(model, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scorer.row(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    rows = sample.where(third).select("text", "toxic").mapInArrow(run, "x array<double>, y int").collect()
    beta = np.array([-3.0, 0.0, 0.0, 0.0, 0.0])
    if len({r.y for r in rows}) == 2 and weights:
        beta = logistic(np.array([r.x for r in rows]), np.array([r.y for r in rows], dtype=float))
    return Scorer(model, weights, beta)


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, train_docs: int = TRAIN_DOCS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``, with its columns ``carry`` between.

    The letter model counts all whole texts. The classifier is fitted on at most ``train_docs`` documents that have a label and
    satisfy ``learn`` (a condition on doc_id); of several labels of a document the larger counts, of several rows of an id one text; null labels and
    ids don't. Null and empty texts have no words and get the score of a text without telling words. Null and repeated
    ids keep their rows; columns of ``docs`` that aren't carried are ignored. Without labels, nothing is toxic.
    """
    model = language_model(letter_counts(docs))
    known = labels.where("doc_id is not null and toxic is not null").where(learn).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # a threshold on the hash leaves some four times as many to sort
    h, share = F.xxhash64("doc_id"), min(1.0, 4 * train_docs / max(1, labels.count()))
    drawn = known.where(h <= min(2**63 - 1, int(share * 2**64) - 2**63)).orderBy(h, "doc_id").limit(train_docs)
    met = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(drawn), "doc_id")  # train_docs ids at most
    # of several rows of an id, one: the text with the least hash
    sample = met.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("doc_id", "one.text", "toxic")
    scorer = fitted(sample, model)
    bounded_batches(docs.sparkSession)

    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), *carry)
    kind = StructType([StructField("doc_id", LongType()), *(StructField(f.name, f.dataType) for f in own.schema[2:]), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("toxicity")
        for b in batches:
            score = pa.array([scorer(t) for t in b.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], score], names=["doc_id", *b.schema.names[2:], "score"])

    got = own.mapInArrow(run, kind)
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return got.select("doc_id", held.alias("held_out"), "score", "predicted")
