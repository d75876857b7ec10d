"""Benchmark decontamination: normalised test n-grams held in a broadcast hash set."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, StructType

from .common import cut, drop_table, in_arrow

#: Bytes that aren't part of a word become blanks, A-Z lower case. All of UTF-8's lead and
#: continuation bytes are part of words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Benchmark windows that one broadcast holds (some 200 bytes each); more are taken in blocks.
WINDOWS_A_BLOCK = 200_000
_P = np.uint64(0x9E3779B97F4A7C15)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


class NgramSet:
    """Windows of test items by length: hashes, sorted, and for each its words and its items."""

    def __init__(self, windows: Iterable[tuple[bytes, list]]):
        self.ids: dict[bytes, int] = {}
        numbers: dict[int, array] = {}
        owners: dict[int, list[tuple]] = {}
        same: dict[tuple, tuple] = {}
        for text, items in windows:
            words = text.split(b" ")
            numbers.setdefault(len(words), array("q")).extend(self.ids.setdefault(w, len(self.ids) + 1) for w in words)
            items = tuple(items)
            owners.setdefault(len(words), []).append(same.setdefault(items, items))
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, list[tuple]]] = {}
        for n in sorted(numbers):
            table = np.frombuffer(numbers[n], np.int64).reshape(-1, n)
            hashes = self._hash(table.reshape(-1), n)[::n]
            order = np.argsort(hashes, kind="stable")
            self.lengths[n] = hashes[order], table[order], [owners[n][k] for k in order]

    @staticmethod
    def _hash(ids: np.ndarray, n: int) -> np.ndarray:
        x = ids.astype(np.uint64)
        out = x[: len(x) - n + 1].copy()
        for j in range(1, n):
            out *= _P
            out += x[j : len(x) - n + 1 + j]
        return out * _P

    def hits(self, words: list[bytes]) -> list[tuple[int, int, tuple[int, ...]]]:
        """(first word, how many, items) of each verified window."""
        ids = np.fromiter(map(self.ids.get, words, _zeros), np.int64, len(words))
        out = []
        for n, (hashes, table, items) in self.lengths.items():
            if len(ids) < n:
                continue
            known = np.cumsum(np.concatenate(([0], ids > 0)))
            maybe = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(maybe):
                continue
            h = self._hash(ids, n)[maybe]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for at, a, b in zip(maybe[hi > lo], lo[hi > lo], hi[hi > lo]):
                out += [(int(at), n, items[k]) for k in range(a, b) if np.array_equal(table[k], ids[at : at + n])]
        return out


class _Zeros:
    def __iter__(self):
        return self

    def __next__(self):
        return 0


_zeros = _Zeros()


class TestWindows:
    """The items' distinct windows, written and counted once, in blocks that hash alike. A block
    at a time is on the driver and in the broadcast that ``each`` hands out and takes back."""

    def __init__(self, items: DataFrame, n: int, key: str, text: str, blocks: int):
        self.spark = items.sparkSession

        def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = normal_words(t)
                    size = min(n, len(words))
                    rows += [(b" ".join(words[i : i + size]), k) for i in range(len(words) - size + 1) if size]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], batch.schema.field(0).type)], ["words", "item"])

        kind = items.schema[key].dataType.simpleString()
        made = in_arrow(items.select(items[key].alias("item"), items[text].alias("text")), cut_up, f"words binary, item {kind}")
        self.table = cut(made.groupBy("words").agg(F.collect_set("item").alias("items")), "test-windows")
        self.blocks = max(1, blocks, -(-self.table.count() // WINDOWS_A_BLOCK))

    def block(self, k: int) -> NgramSet:
        part = self.table.where(F.pmod(F.xxhash64("words"), F.lit(self.blocks)) == k) if self.blocks > 1 else self.table
        return NgramSet((bytes(r["words"]), r["items"]) for r in part.toLocalIterator())

    def each(self) -> Iterator[tuple[int, Broadcast]]:
        for k in range(self.blocks):
            held = self.spark.sparkContext.broadcast(self.block(k))
            yield k, held
            if self.blocks > 1:  # what was found is in a table by now
                held.destroy()

    def drop(self) -> None:
        drop_table(self.table)


def _found_in(rows: DataFrame, held: Broadcast, kept: str, item_type, hits_only: bool = False) -> DataFrame:
    """(kept, n_words, n_hit, items, spans) of rows (kept, text), in one scan."""
    arrow = to_arrow_type(item_type)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _scanned(batch, held.value, arrow)
            yield out.filter(pc.greater(out.column("n_hit"), 0)) if hits_only else out

    schema = StructType([rows.schema[kept]]).add("n_words", "long").add("n_hit", "long").add("items", ArrayType(item_type)).add("spans", DataType.fromDDL("array<struct<start:int,stop:int>>"))
    return in_arrow(rows.select(kept, "text"), scan, schema)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as (row_id, row), written, so that a row keeps its number from scan to scan."""
    return cut(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*docs.columns).alias("row")), "numbered")


def _merged(rows: DataFrame, windows: TestWindows, item_type) -> DataFrame:
    """(row_id, n_words, n_hit, items, spans) of rows (row_id, text), which each block of windows is
    held against; the first block says something of every row, others of those that they hit."""
    parts = [cut(_found_in(rows, held, "row_id", item_type, hits_only=k > 0), "found") for k, held in windows.each()]
    every = reduce(DataFrame.unionByName, parts)
    out = every.groupBy("row_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_joined(s) for s in batch.column(3).to_pylist()]
            n_hit = pa.array([sum(x["stop"] - x["start"] for x in s) for s in spans], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), n_hit, batch.column(2), pa.array(spans, SPANS)], ["row_id", "n_words", "n_hit", "items", "spans"])

    return in_arrow(out, join, StructType([out.schema["row_id"], out.schema["n_words"]]).add("n_hit", "long").add(out.schema["items"]).add(out.schema["spans"]))


def _joined(spans: list[dict]) -> list[dict]:
    """Spans that touch or overlap as one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["stop"])):
        if out and s["start"] <= out[-1]["stop"]:
            out[-1] = {"start": out[-1]["start"], "stop": max(out[-1]["stop"], s["stop"])}
        else:
            out.append(s)
    return out


def find_contamination(docs: DataFrame, items: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", blocks: int = 1) -> DataFrame:
    """Per row of ``docs``: (key, n_words, n_hit, items, spans).

    Words are runs of ASCII letters and digits and all characters beyond ASCII, A-Z in lower case.
    A window is ``n`` consecutive words of an item, or a shorter item's words as a whole. Windows
    are held as a hash set, each hit is verified word by word. ``spans`` are the hit words, as
    (first word, one past the last), merged; ``items`` the distinct ids of items that occur.

    The set's size is counted first: up to WINDOWS_A_BLOCK windows go out in one broadcast, and
    documents need one scan without a shuffle. More are cut by hash into as many blocks as needed;
    rows then get a number, each block is held against all of them and what is found is merged by
    that number. Both give the same rows, one for each row of ``docs``, whatever its key.

    Null texts have no words; null item ids mark words but aren't listed; null keys and keys that
    repeat are rows like others; without items, or without words in them, nothing is hit; an empty
    table gives no rows. Whole texts are scanned, whatever their length. Extra columns are left out.
    """
    windows = TestWindows(items, n, item_key, item_text, blocks)
    item_type = items.schema[item_key].dataType
    if windows.blocks == 1:
        _, held = next(windows.each())
        windows.drop()
        return _found_in(docs.select(docs[key].alias("k"), docs[text].alias("text")), held, "k", item_type).withColumnRenamed("k", key)
    rows = _numbered(docs.select(docs[key].alias("k"), docs[text].alias("t")))
    found = _merged(rows.select("row_id", F.col("row.t").alias("text")), windows, item_type)
    windows.drop()
    return found.join(rows.select("row_id", F.col("row.k").alias(key)), "row_id").select(key, "n_words", "n_hit", "items", "spans")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _scanned(batch: pa.RecordBatch, found: NgramSet, item_type: pa.DataType) -> pa.RecordBatch:
    total, hit, items, spans = [], [], [], []
    for t in batch.column(1):
        words = normal_words(t.as_py())
        hits = found.hits(words)
        total.append(len(words))
        if not hits:
            hit.append(0), items.append([]), spans.append([])
            continue
        edge = np.zeros(len(words) + 1, np.int64)
        for at, n, _ in hits:
            edge[at] += 1
            edge[at + n] -= 1
        on = np.concatenate(([0], np.cumsum(edge[:-1]) > 0, [0])).astype(np.int8)
        turn = np.diff(on)
        starts, stops = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        hit.append(int(on.sum()))
        items.append(sorted({i for _, _, own in hits for i in own}))
        spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(starts, stops)])
    columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(item_type)), pa.array(spans, SPANS)]
    return pa.record_batch(columns, [batch.schema.field(0).name, "n_words", "n_hit", "items", "spans"])


def items_digest(items) -> str:
    """The contract's digest: ids sorted as strings, joined by commas, SHA-256 in lower-case hex."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, remove: str = "documents", key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", blocks: int = 1) -> DataFrame:
    """``docs`` without contamination: ``remove`` "documents" drops each row with a hit, "spans"
    cuts the hit words, with what stands between them, out of the text. All columns stay as they
    are; keys aren't read, so rows with null or repeated keys are rows like others.

    Rows go one by one in one scan, without a shuffle. Where the windows need several blocks (see
    ``find_contamination``), each block's scan ends in a written table; spans of several blocks are
    merged by the row's number first. Null texts stay null; an empty table gives no rows.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    own, at = docs.columns, docs.columns.index(text)
    windows = TestWindows(items, n, item_key, item_text, blocks)
    if remove == "spans" and windows.blocks > 1:
        rows = _numbered(docs)
        found = _merged(rows.select("row_id", F.col("row").getField(text).alias("text")), windows, items.schema[item_key].dataType)
        windows.drop()
        hit = found.where("n_hit > 0").select("row_id", "spans")
        joined = rows.join(hit, "row_id", "left").select(*[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(own)], "spans")

        def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _with_texts(batch, at, own, [s if s else [] for s in batch.column(len(own)).to_pylist()])

        return in_arrow(joined, strip, docs.schema)
    for _, held in windows.each():

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [held.value.hits(normal_words(t.as_py())) for t in batch.column(at)]
                if remove == "documents":
                    yield batch.filter(pa.array([not h for h in hits], pa.bool_()))
                else:
                    yield _with_texts(batch, at, own, [_joined([{"start": a, "stop": a + k} for a, k, _ in h]) for h in hits])

        docs = in_arrow(docs, keep, docs.schema)
        if windows.blocks > 1:
            docs = cut(docs, "less-hits")
    windows.drop()
    return docs


def _with_texts(batch: pa.RecordBatch, at: int, names: list[str], spans: list[list[dict]]) -> pa.RecordBatch:
    texts = [t if not s else without_spans(t or "", s) for t, s in zip(batch.column(at).to_pylist(), spans)]
    return pa.record_batch([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names)


def without_spans(text: str, spans: list[dict]) -> str:
    """The text less the words of each span; spans count normalised words."""
    raw = text.encode("utf-8", "surrogatepass")
    flat = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    turn = np.diff(np.concatenate(([0], flat, [0])).astype(np.int8))
    starts, stops = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    out, at = [], 0
    for s in spans:
        out.append(raw[at : starts[s["start"]]])
        at = int(stops[s["stop"] - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
