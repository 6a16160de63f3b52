"""Token counts of whole texts: piece by piece where blanks part pre-tokens, else whole; huge texts in overlapping chunks that are spliced."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, table

#: Characters of a chunk, and of the overlap tried first.
CHUNK, OVERLAP = 65536, 512
#: Characters before a chunk's cut where its tokens may differ from the whole text's: longer than any
#: contraction or special token.
GUARD = 64
LIMIT = 512
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """One tokenizer for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


#: Before a piece: nothing stands there (a text's first word, a sign behind a word), or a line feed. Any other piece has a blank before it.
BARE, FEED = "\x01", "\x02"
#: A sign behind a letter or digit and before a blank or line feed: pre-tokens end on both sides of it.
LONE_SIGN = re.compile(r"([!,.:;?])(?<=[^\W_].)(?=[ \n])")
#: What pieces can't tell: special tokens, their own marks, and white space that a pre-token may hold several of.
_WHOLE = re.compile(r"<\||[\x01\x02]|\n\n(?:[\n ]|\Z)")


class PieceCounter:
    """Counts the tokens of texts by pieces between blanks and line feeds, keeping the counts of pieces seen before.

    Exact for byte-level tokenizers whose pre-tokens take one blank at most, before them, as in ``byte_bpe_50k.json``: a blank before
    anything but white space begins a pre-token, and a line feed between two such characters is one. Texts with other white space, several
    blanks, or what may be a special token have no count here (None). Of two stores of ``room`` bytes the older
    one is dropped when the younger is full.
    """

    #: What stands for no count, and the bytes of an entry besides its characters.
    _NONE, ENTRY = 1 << 40, 160

    def __init__(self, path: str, room: int = 24 << 20):
        self.library, self.room, self.held, self.young, self.old = tokenizer(path), room, 0, {}, {}
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t[0] == "\u0120"]] = True  # how a blank is written in the vocabulary

    @staticmethod
    def fits(path: str) -> bool:
        spec = json.loads(Path(path).read_text())
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        affixed = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        return plain and model["type"] == "BPE" and not affixed and not spec["normalizer"] and all("<|" in t["content"] for t in spec["added_tokens"])

    def _each(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for at in range(0, len(texts), 1024) for e in self.library.encode_batch_fast(texts[at : at + 1024], add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[int]:
        if not words:
            return []
        ids = np.array(self.library.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids)
        begins = np.flatnonzero(self.begins[ids])
        return np.diff(begins, append=len(ids)).tolist() if len(begins) == len(words) else self._each([f" {w}" for w in words])

    def _learn(self, pieces: set[str]) -> None:
        if self.held > self.room:
            self.young, self.old, self.held = {}, self.young, 0
        fresh = pieces.difference(self.young)
        kept = {p: self.old[p] for p in fresh.intersection(self.old)}
        behind, marked = [], []
        for p in fresh.difference(kept):
            mark = p[:1]
            if mark == BARE or mark == FEED:
                rest = p[1:]
                if rest and not rest.isprintable():
                    kept[p] = self._NONE
                else:
                    marked.append((p, rest if mark == BARE else f"\n{rest}"))
            elif p and p.isprintable():
                behind.append(p)
            else:
                kept[p] = self._NONE
        kept.update(zip(behind, self._together(behind)))
        kept.update(zip([p for p, _ in marked], self._each([t for _, t in marked])))
        self.young.update(kept)
        self.held += self.ENTRY * len(kept) + 2 * sum(map(len, kept))

    def counts(self, texts: list[str], step: int = 1 << 20) -> list[int | None]:
        """The number of tokens of each text, or None where pieces can't tell; some megabytes of text at a time."""
        out: list[int | None] = []
        rows: list[list[str] | None] = []
        size = 0

        def flush() -> None:
            self._learn(set(chain.from_iterable(r for r in rows if r)))
            get = self.young.__getitem__
            for r in rows:
                n = self._NONE if r is None else sum(map(get, r))
                out.append(n if n < self._NONE else None)
            rows.clear()

        for text in texts:
            told = not _WHOLE.search(text)
            rows.append((BARE + LONE_SIGN.sub(rf" {BARE}\1", text).replace("\n", f" {FEED}")).split(" ") if told else None)
            size += len(text)
            if size >= step:
                flush()
                size = 0
        flush()
        return out


_counters: dict[str, PieceCounter | None] = {}


def counter(path: str) -> PieceCounter | None:
    """One counter for each worker process, if the tokenizer is of the kind."""
    if path not in _counters:
        _counters[path] = PieceCounter(path) if PieceCounter.fits(path) else None
    return _counters[path]


def _starts(encoding, base: int) -> dict[int, int]:
    """Place in the text of each pre-token's first character -> tokens before it in this chunk."""
    out, last = {}, None
    for k, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word != last or word is None:
            out.setdefault(base + start, k)
            last = word
    return out


def spliced_count(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, guard: int = GUARD) -> int:
    """The number of tokens of ``text``, from chunks of ``chunk`` characters that overlap.

    Each chunk reaches ``overlap`` characters into the next. A place in that overlap where a pre-token starts
    in both encodings is a boundary of the whole text's encoding if it is ``guard`` characters before
    the first chunk's cut: what the first chunk has before it can't change any more, and from there on both
    see the same text, since merges stay within pre-tokens and the pre-tokenizer looks ahead only. Tokens
    are counted between such places. Where an overlap has none, the first chunk is encoded again, reaching twice as far, in
    the end to the end of the text. Holds one chunk's encoding and the starts in one overlap.
    """
    total, at, before, first = 0, 0, 0, None
    while True:
        reach, end = overlap, at + chunk
        if first is None:
            first = encode(text[at : end + reach])
        if end + reach >= len(text):
            return total + len(first.ids) - before
        while True:
            mine = {p: k for p, k in _starts(first, at).items() if end <= p <= end + reach - guard}
            following = encode(text[end : end + chunk + overlap] if reach <= chunk else text[end : end + 2 * reach])
            both = mine.keys() & _starts(following, end).keys()
            if both:
                break
            reach *= 2
            first = encode(text[at : end + reach])
            if end + reach >= len(text):
                return total + len(first.ids) - before
        place = min(both)
        total += mine[place] - before
        before, longer = _starts(following, end)[place], reach > chunk
        at, first = end, encode(text[end : end + chunk + overlap]) if longer else following
        if longer and place not in _starts(first, at):
            # the meeting place lies beyond the next chunk: go on from there
            at, before, first = place, 0, None


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    A null text is empty and has no tokens. Null and repeated ids keep their rows. No text is cut; texts of more than
    ``chunk`` characters go through ``spliced_count``, others through ``PieceCounter``, or whole through the library where pieces can't tell. Other columns are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, pieces = tokenizer(path), counter(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            short = [x for x in texts if len(x) <= chunk]
            told = pieces.counts(short) if pieces else [None] * len(short)
            whole = iter([len(e.ids) for e in t.encode_batch_fast([x for x, n in zip(short, told) if n is None], add_special_tokens=False)])
            counts = iter([next(whole) if n is None else n for n in told])
            got = [next(counts) if len(x) <= chunk else spliced_count(lambda s: t.encode(s, add_special_tokens=False), x, chunk, overlap) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
