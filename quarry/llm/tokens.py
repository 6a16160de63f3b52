"""Token ids as compressed shards: one frame per document under a shared dictionary."""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, input_splits, shared_dir, table, worker_store

MAGIC = b"QTOK1"
#: Documents whose id arrays train the dictionary, bytes of a piece of them, pieces of a document that count, and bytes of the dictionary.
SAMPLE_DOCS, PIECE_BYTES, PIECES, DICT_BYTES = 1000, 2048, 4, 65536
#: A shard row is closed when its frames reach this size.
SHARD_BYTES = 2 << 20
SHARDS = "part int, seq int, n_docs int, n_tokens long, dict_sha256 string, width int, low_id long, high_id long, doc_ids array<long>, counts array<int>, offsets array<long>, data binary"


#: Pieces of Latin-1 letters with ASCII signs behind: lower-casing is per letter, composition changes nothing,
#: and the letters form one pre-token, as do the signs. No apostrophe: it may start a contraction; no <|>: special tokens.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\[-`{}~]*)").fullmatch
#: Of these, the ones that are letters alone, lower-cased.
_LOWER = re.compile(r"[a-zß-öø-ÿ]+").fullmatch
#: The same signs behind a letter or digit, up to a blank, a line feed or the end: a pre-token of their own.
_SIGNS = re.compile(r"([!-&(-/:;=?@\[-`{}~](?<=[^\W_].)[!-&(-/:;=?@\[-`{}~]*)(?=[ \n]|\Z)")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Encodes whole texts piece by piece between blanks and line feeds, keeping the ids of pieces seen before.

    Exact for tokenizers whose pre-tokenizer never lets a token cross white space and drops it, and
    whose normalizer works within a piece, as in ``word_bpe_49k.json``. Arrow tells the different pieces of some megabytes of text
    and sets their ids in all their places, so that Python meets each once. Pieces not kept go through the
    library together: plain ones as one text, told apart by the word-end mark of their last tokens, all
    others one by one. Where plain ones are told, texts of Latin-1 are lower-cased first, as the normalizer would, and
    signs behind a word become a piece of their own, so that fewer pieces are new. Memory is bounded: long pieces aren't kept, and when those
    kept take ``room`` bytes, the half learned first goes. Ids are ``width`` bytes each: two, or four where the tokenizer has more than 65,536.
    """

    #: Bytes of an entry besides its characters and ids, as Python objects.
    ENTRY = 200

    def __init__(self, path: str, room: int = 96 << 20, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text())
        self.whole = Tokenizer.from_file(path)
        steps, normal = ([s["type"] for s in (spec[k] or {}).get(many, [])] for k, many in (("pre_tokenizer", "pretokenizers"), ("normalizer", "normalizers")))
        self.plain, self.room, self.longest = None, room, longest
        self.width = width_of(self.whole)
        self.kind = f"<u{self.width}"
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, dtype=bool)
        special = all("<|" in t["content"] for t in spec["added_tokens"])
        if steps == ["Split", "ByteLevel"] and normal == ["NFC", "Replace", "Lowercase"] and special and (mark := spec["model"].get("end_of_word_suffix")):
            self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spec["pre_tokenizer"]["pretokenizers"][1]]}}))
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(mark)]] = True
        self.forget()

    def forget(self) -> None:
        self.young, self.held = {}, 0

    def _each(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(pieces), 1024):
            out += [np.array(e.ids, dtype=self.kind).tobytes() for e in self.whole.encode_batch_fast(pieces[at : at + 1024], add_special_tokens=False)]
        return out

    def _together(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=self.kind)
        cut = (np.flatnonzero(self.ends[ids]) + 1) * self.width
        if len(cut) != len(words):
            return self._each(words)
        raw, cut = ids.tobytes(), cut.tolist()
        return [raw[i:j] for i, j in zip([0, *cut], cut)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't kept, and of what they are put together from."""
        got, lower, plain, hard = {}, {}, [], {}
        for p in new:
            if self.plain is None or len(p) > self.longest:
                hard[p] = None
            elif _LOWER(p):
                lower[p] = None
            elif m := _PLAIN(p):
                plain.append((p, m[1].lower(), m[2]))
            else:
                hard[p] = None
        if plain:
            lower.update((c, None) for _, c, _ in plain if c not in self.young)
            hard.update((t, None) for _, _, t in plain if t and t not in self.young)
        if lower:
            got.update(zip(lower, self._together(list(lower))))
        got.update(zip(hard, self._each(list(hard))))
        if plain:
            part = lambda p: got[p] if p in got else self.young[p] if p else b""
            got.update([(p, part(c) + part(t)) for p, c, t in plain])
        return got

    def _parted(self, text: str) -> str:
        """The text with a blank, and nothing else, between its pieces."""
        if self.plain is not None and "<|" not in text and _latin(text):
            text = _SIGNS.sub(r" \1", text.lower())
        return text.replace("\n", " ")

    def _encode(self, texts: list[str]) -> list[bytes]:
        """The ids of parted texts."""
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        told = pieces.flatten().dictionary_encode()
        names = told.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = self._learn([p for p in names if p not in self.young])
        self.young.update(got)
        laid = pa.array(map(self.young.__getitem__, names), pa.large_binary(), size=len(names)).take(told.indices)
        _, starts, raw = laid.buffers()
        cuts = np.frombuffer(starts, np.int64, len(laid) + 1)[pieces.offsets.to_numpy()].tolist()
        for p in [p for p in got if len(p) > self.longest]:
            del self.young[p], got[p]
        self.held += self._size(got)
        if self.held > self.room:
            self.young = dict(islice(self.young.items(), len(self.young) // 2, None))
            self.held = self._size(self.young)
        return [raw[i:j].to_pybytes() if i < j else b"" for i, j in zip(cuts, cuts[1:])]

    def _size(self, kept: dict[str, bytes]) -> int:
        return self.ENTRY * len(kept) + 2 * sum(map(len, kept)) + sum(map(len, kept.values()))

    def batch(self, texts: list[str], step: int = 4 << 20) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of ``width`` bytes, some megabytes of text at a time."""
        out: list[list[bytes]] = []
        rows: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            for (i, _), ids in zip(rows, self._encode([t for _, t in rows])):
                out[i].append(ids)
            rows.clear()

        for i, text in enumerate(texts):
            out.append([])
            at = 0
            while at < len(text):
                end = at + step if at + step < len(text) else len(text)
                if end < len(text):
                    end = text.find(" ", end)
                    end = len(text) if end < 0 else end
                rows.append((i, self._parted(text[at:end])))
                size, at = size + end - at, end
                if size >= step:
                    flush()
                    size = 0
        if rows:
            flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0]


def width_of(tokenizer) -> int:
    """Bytes that an id of the tokenizer needs: two or four."""
    return 2 if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, until it goes on to another operator's tasks."""
    kept = worker_store("tokens")
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def train_dictionary(docs: DataFrame, path: str, end_id: int, sample: int = SAMPLE_DOCS) -> bytes:
    """A zstandard dictionary of at most DICT_BYTES, trained on the id arrays of ``sample`` documents.

    The sample is the ``sample`` rows whose keys hash lowest, so it doesn't depend on the input's order; a
    threshold on the hash leaves some four times as many to sort. Whole documents of the sample are encoded; of each, up to PIECES
    pieces of PIECE_BYTES, evenly spread over it, train. Only these bounded pieces reach the driver. Empty bytes if there is too little to train on.
    """
    share = min(1.0, 4 * sample / max(1, docs.count()))
    drawn = docs.select(F.xxhash64("k").alias("h"), "text").where(F.col("h") <= min(2**63 - 1, int(share * 2**64) - 2**63))
    drawn = drawn.orderBy("h", "text").limit(sample).select("h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        step = PIECE_BYTES // code.width * code.width
        for b in batches:
            rows = []
            for h, ids in zip(b.column(0).to_pylist(), code.batch([t or "" for t in b.column(1).to_pylist()])):
                ids += end_id.to_bytes(code.width, "little")
                n = min(PIECES, -(-len(ids) // step))
                room = (len(ids) - n * step) // max(1, n - 1) // code.width * code.width if n > 1 else 0
                rows += [(h, k, ids[k * (step + max(0, room)) : k * (step + max(0, room)) + step]) for k in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], names=["h", "k", "ids"])

    pieces = [bytes(r.ids) for r in drawn.mapInArrow(run, "h long, k int, ids binary").orderBy("h", "k", "ids").collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_shards(docs: DataFrame, order: Column, id_col: str, text_col: str, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode every document and write shards in the order given, with the dictionary beside them.

    A shard is a row of the Parquet table ``path/shards``: the frames of some documents one after another (data), each
    compressed on its own under the shared dictionary, with the index (doc_ids, counts, offsets)
    and the dictionary's hash. Rows are ordered by (part, seq). ``path/dictionary`` has the dictionary.
    The order is made by a range partitioning, so no task or driver holds more than a part.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(order.alias("k"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("place"))
    raw = train_dictionary(src, tokenizer, end_id)
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, MAGIC.decode(), bytearray(raw))], "dict_sha256 string, magic string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    parts = max(input_splits(spark, docs), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, press = encoder(tokenizer), zstandard.ZstdCompressor(level=3, dict_data=_dictionary(raw), write_checksum=True)
        part, seq, width, end = TaskContext.get().partitionId(), 0, code.width, end_id.to_bytes(code.width, "little")
        ids, counts, offsets, frames, size, total = [], [], [], [], 0, 0

        def shard() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = {"part": part, "seq": seq, "n_docs": len(ids), "n_tokens": total, "dict_sha256": digest, "width": width, "low_id": min(known, default=None), "high_id": max(known, default=None), "doc_ids": ids, "counts": counts, "offsets": offsets, "data": b"".join(frames)}
            return pa.RecordBatch.from_pylist([row], schema=_schema())

        gc.disable()  # many strings live here, none of them in cycles
        try:
            for b in batches:
                for i, array in zip(b.column("id").to_pylist(), code.batch(b.column("text").to_pylist())):
                    array += end
                    frame = press.compress(array)
                    ids.append(i), counts.append(len(array) // width), offsets.append(size), frames.append(frame)
                    size, total = size + len(frame), total + len(array) // width
                    if size >= SHARD_BYTES or len(ids) >= 1 << 16:
                        yield shard()
                        seq, ids, counts, offsets, frames, size, total = seq + 1, [], [], [], [], 0, 0
            if ids:
                yield shard()
        finally:
            gc.enable()

    # rows of a null or repeated id go by their places, so that they are ranges too; no key needs the text, so ranges are found without it
    keys = ["k", "id", "place"]
    dealt = src.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt.select("id", "text").mapInArrow(run, SHARDS).write.option("compression", "uncompressed").parquet(f"{path}/shards")


def _schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("dict_sha256", pa.string()), ("width", pa.int32()), ("low_id", pa.int64()), ("high_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("data", pa.binary())])


def load_dictionary(spark: SparkSession, path: str) -> tuple[bytes, str]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return bytes(row.dictionary), row.dict_sha256


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> dict[int, np.ndarray]:
    """The token ids of a few documents by id, as ``read_rows`` finds them; an id that several documents have is an error, as they would hide each other."""
    rows = read_rows(spark, path, ids)
    out = dict(rows)
    if len(out) < len(rows):
        raise ValueError("some documents share an id: take read_rows")
    return out


def read_rows(spark: SparkSession, path: str, ids: list[int]) -> list[tuple[int, np.ndarray]]:
    """(id, token ids) of all documents with a few ids: shards by their least and greatest ids, which Parquet's statistics skip; of these, only the
    frames that the index names are taken and decompressed."""
    raw, digest = load_dictionary(spark, path)
    within = F.lit(False)
    for i in ids:
        within = within | ((F.col("low_id") <= i) & (F.col("high_id") >= i))
    found = spark.read.parquet(f"{path}/shards").where(within).where(F.arrays_overlap("doc_ids", F.array(*[F.lit(i).cast("long") for i in ids])))
    one = found.select("dict_sha256", "width", F.explode(F.arrays_zip("doc_ids", "offsets", F.slice("offsets", F.lit(2), F.size("offsets")).alias("ends"))).alias("z"), "data").where(F.col("z.doc_ids").isin(ids))
    frame = F.expr("substring(data, int(z.offsets) + 1, int(coalesce(z.ends, length(data)) - z.offsets))")
    press, out = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)), []
    for r in one.select("dict_sha256", "width", F.col("z.doc_ids").alias("id"), frame.alias("frame")).collect():
        if r.dict_sha256 != digest:
            raise ValueError("shard and dictionary differ")
        out.append((r.id, np.frombuffer(press.decompress(bytes(r.frame)), dtype=f"<u{r.width}")))
    return out


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, part, seq.

    ``start`` counts the ids of all documents before it: sums over parts (one row each), then within a part.
    """
    raw, digest = load_dictionary(spark, path)
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    inner = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    index = shards.select("part", "seq", "n_tokens").withColumn("within", inner).join(before, "part").select("part", "seq", (F.col("base") + F.col("within")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for b in batches:
            for row in b.to_pylist():
                if row["dict_sha256"] != digest:
                    raise ValueError("shard and dictionary differ")
                ends, crcs = [*row["offsets"][1:], len(row["data"])], []
                for s, e in zip(row["offsets"], ends):
                    crcs.append(zlib.crc32(np.frombuffer(press.decompress(row["data"][s:e]), dtype=f"<u{row['width']}").astype("<u4").tobytes()))
                n = len(crcs)
                run_up = np.cumsum([0, *row["counts"][:-1]])
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(run_up, pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(crcs, pa.int64())], names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"])

    read = shards.mapInArrow(run, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return read.join(index, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def token_output(docs: DataFrame, tokenizer: str, order: Column | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write every document's ids as shards, read them back and return a digest of each document.

    A null text is empty: its only id is the end id. Null ids come first and keep their rows, rows of null and repeated
    ids go by their places in the table. An empty table writes no shard and gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark, "tokens")
    write_shards(docs, F.col(id_col).cast("long") if order is None else order, id_col, text_col, path, tokenizer, end_id)
    return read_digests(spark, path)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
