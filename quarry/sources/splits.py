"""One large JSON document read by many tasks: its lists' records, found by a depth scan over byte ranges.

A range can't know by itself whether it begins within a string, nor how deep. So each range first says what it does to either state
(quotes, and how the depth changes if it begins outside or inside a string); one small row a range makes every range's own state. With it, each
range finds the list that it begins in, and cuts out the records that begin in it, reading on behind its end where the last one isn't over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range, and of what is read at once behind its end.
RANGE, MORE = 32 << 20, 1 << 20
#: Bytes of records in an Arrow batch.
BATCH = 4 << 20
_RANGES = "part int, file string, start long, stop long, inside boolean, depth long, list string"
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\[')


class _File:
    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.removeprefix("file:"))
        self.place, self.size = place, self.fs.get_file_info(place).size

    def read(self, start: int, stop: int) -> bytes:
        with self.fs.open_input_file(self.place) as f:
            f.seek(start)
            return f.read(max(0, min(stop, self.size) - start))

    def escaped(self, at: int) -> bool:
        """Whether the byte at ``at`` stands behind an odd number of backslashes."""
        n, step = 0, 64
        while at > n:
            before = self.read(max(0, at - n - step), at - n)
            run = len(before) - len(before.rstrip(b"\\"))
            n += run
            if run < len(before):
                break
        return n % 2 == 1


def _quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Where quotes stand that no backslash takes away. ``escaped``: an odd number of backslashes stands before."""
    place, back = np.arange(len(data)), data == 0x5C
    # a run of backslashes that reaches the beginning goes on from before it
    since = np.maximum.accumulate(np.where(back, -1 - escaped, place)) if len(data) else place
    run = np.concatenate([[int(escaped)], (place - since)[:-1]]) if len(data) else place
    return (data == 0x22) & (run % 2 == 0)


def _scan(raw: bytes, escaped: bool, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """(within a string before each byte, change of depth at each byte outside of strings)."""
    data = np.frombuffer(raw, np.uint8)
    quote = _quotes(data, escaped)
    within = (np.cumsum(quote) - quote + inside) % 2 == 1
    step = np.isin(data, (0x7B, 0x5B)).astype(np.int64) - np.isin(data, (0x7D, 0x5D))
    return within, np.where(within, 0, step)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, odd, out, in_): of a range, whether its quotes are odd, and how the depth changes from outside and from inside a string."""
    for b in batches:
        rows = []
        for part, file, start, stop in zip(*(b.column(i).to_pylist() for i in range(4))):
            f = _File(file)
            raw, escaped = f.read(start, stop), f.escaped(start)
            within, outside = _scan(raw, escaped, False)
            ends = bool(len(raw)) and bool(_quotes(np.frombuffer(raw, np.uint8), escaped).sum() % 2)
            rows.append({"part": part, "odd": ends, "out": int(outside.sum()), "in_": int(_scan(raw, escaped, True)[1].sum())})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("odd", pa.bool_()), ("out", pa.int64()), ("in_", pa.int64())]))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, list): the last list of the document's object that begins in a range, which may go on into the next ones."""
    for b in batches:
        rows = []
        for part, file, start, stop, inside, depth in zip(*(b.column(i).to_pylist() for i in range(6))):
            f = _File(file)
            rows += [{"part": part, "list": name} for _, name in _begun(f, start, f.read(start, stop), inside, depth)[-1:]]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("list", pa.string())]))


def _begun(f: _File, start: int, raw: bytes, inside: bool, depth: int) -> list[tuple[int, str]]:
    """(place, name) of the lists that open in a range directly in the document's object; the name may stand before the range."""
    _, step = _scan(raw, f.escaped(start), inside)
    deep = depth + np.cumsum(step)
    opened = np.flatnonzero((step == 1) & (deep == 2) & (np.frombuffer(raw, np.uint8) == 0x5B))
    out = []
    for at in opened.tolist():
        size = 256
        while True:
            head = f.read(max(0, start + at - size), start + at + 1)
            names = list(_KEY.finditer(head))
            if (names and names[-1].end() == len(head)) or size >= start + at:
                break
            size *= 4
        out.append((at, names[-1][1].decode("utf-8", "replace") if names and names[-1].end() == len(head) else ""))
    return out


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, record) of the objects that begin in each range, as text."""
    names: list[str] = []
    records: list[str] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.string())], names=["list", "record"])

    for b in batches:
        for _, file, start, stop, inside, depth, now in zip(*(b.column(i).to_pylist() for i in range(7))):
            f = _File(file)
            raw = f.read(start, stop)
            begun = _begun(f, start, raw, inside, depth)
            own = len(raw)
            while True:
                within, step = _scan(raw, f.escaped(start), inside)
                deep = depth + np.cumsum(step)
                data = np.frombuffer(raw, np.uint8)
                opens = np.flatnonzero((data == 0x7B) & (step == 1) & (deep == 3))
                opens = opens[opens < own]
                closes = np.flatnonzero((data == 0x7D) & (step == -1) & (deep == 2))
                if len(opens) == 0 or (len(closes) and closes[-1] > opens[-1]) or start + len(raw) >= f.size:
                    break
                raw += f.read(start + len(raw), start + len(raw) + max(MORE, len(raw)))
            ends = np.searchsorted(closes, opens)
            for a, e in zip(opens.tolist(), ends.tolist()):
                while begun and begun[0][0] < a:
                    now = begun.pop(0)[1]
                if e < len(closes):
                    text = raw[a : closes[e] + 1].decode("utf-8", "replace")
                    names.append(now or "")
                    records.append(text)
                    size += len(text)
                    if size >= BATCH:
                        yield batch()
                        names, records, size = [], [], 0
    if records:
        yield batch()


def json_records(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(list, record): the objects in the lists of a JSON document's object, each as text with the list's name, read by a task for every ``size`` bytes.

    ``path`` is a file that all tasks can open, by name or URI, not compressed. What isn't an object in such a list is left out; a document cut off
    gives its whole records. The driver holds one small row for each range.
    """
    whole = _File(path)
    parts = max(1, -(-whole.size // size))
    rows = [(k, path, k * size, min(whole.size, (k + 1) * size)) for k in range(parts)]
    dealt = lambda known, kind: spark.createDataFrame(known, kind).repartitionByRange(parts, "part")
    ranges = dealt(rows, "part int, file string, start long, stop long")
    effects = {r.part: r for r in ranges.mapInArrow(_effects, "part int, odd boolean, out long, in_ long").collect()}  # a row a range
    states, inside, depth = [], False, 0
    for r in rows:
        states.append((*r, inside, depth))
        e = effects[r[0]]
        inside, depth = inside != e.odd, depth + (e.in_ if inside else e.out)
    last = {r.part: r.list for r in dealt(states, _RANGES.rpartition(",")[0]).mapInArrow(_lists, "part int, list string").collect()}
    known, now = [], None
    for s in states:
        known.append((*s, now))
        now = last.get(s[0], now)
    return dealt(known, _RANGES).mapInArrow(_records, "list string, record string")
