"""Best-fit packing of token sequences, solved on the histogram of lengths."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_arrow

_SPACES = re.compile(r"\s\s")
_loaded: dict[str, Ids] = {}


def _byte_of() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte, turned round:
    printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Ids:
    """A text's ids, as little-endian unsigned 32-bit.

    A byte-level BPE file whose ids are in merge order is a rank file; the same merges then run in
    tiktoken, several times faster a core. The published split pattern looks ahead only to keep
    the last of several white-space characters for what follows; texts without two in a row are
    split alike by the pattern without that, which is faster again. Files of another kind, and
    texts that spell a special token, go to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        model, byte = spec["model"], _byte_of()
        vocab = {w: i for w, i in model.get("vocab", {}).items() if w not in self.special} if model.get("type") == "BPE" else {}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.fast = self.fastest = None
        if not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and sorted(vocab.values()) == list(range(len(vocab))) and [vocab[m] for m in merged] == list(range(256, len(vocab))):
            import tiktoken

            ranks = {bytes(byte[c] for c in w): i for w, i in vocab.items()}
            make = lambda pattern: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.fast, self.fastest = make(public_tokenizers.PATTERN), make(public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", ""))

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = (self.fast if _SPACES.search(text) else self.fastest)(text)
        return array("I", ids).tobytes()


def _tokenizer(path: str) -> Ids:
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


def tokenized(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str, text: str, with_ids: bool) -> DataFrame:
    """A row for each piece: (key, piece, start, length, ids_crc32[, ids])."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        end = array("I", [end_id]).tobytes()
        names = [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            rows = []
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(t(s.as_py() or "") + end)
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                at = 0
                for piece in range(-(-n // capacity)):
                    length = capacity if piece else first
                    part = ids[4 * at : 4 * (at + length)]
                    rows.append((k, piece, at, length, zlib.crc32(part)) + ((part.tobytes(),) if with_ids else ()))
                    at += length
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return in_arrow(docs.select(key, text), pieces, schema)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins for ``counts`` items by length, as (how many bins, items by length in each).

    Items above a third of the capacity: at most two share a bin. The largest left is matched
    with the largest left that still fits beside it. Then the smaller ones, by falling length,
    each go where they leave the least room, or open a bin. Bins that are alike are handled
    together: each step uses up either a length or a kind of bin, so the number of kinds depends
    on the capacity alone, not on the number of items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    bins: dict[int, list[list]] = {}  # by room left: [how many, items]

    def put(many: int, room: int, items: dict[int, int]) -> None:
        if many:
            bins.setdefault(room, []).append([many, items])

    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= n and left[m] > (m == n) and n + m <= capacity), None)
            if mate is None:
                put(left[n], capacity - n, {n: 1})
                left[n] = 0
            elif mate == n:
                put(left[n] // 2, capacity - 2 * n, {n: 2})
                left[n] %= 2
            else:
                many = min(left[n], left[mate])
                put(many, capacity - n - mate, {n: 1, mate: 1})
                left[n] -= many
                left[mate] -= many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            room = min((r for r in bins if r >= n), default=None)
            many, items = bins[room].pop() if room is not None else (left[n], {})
            if room is not None and not bins[room]:
                del bins[room]
            room = capacity if room is None else room
            each = room // n
            full = min(many, left[n] // each)
            over = left[n] - full * each if full < many else 0
            put(full, room - each * n, items | {n: each})
            if over:
                put(1, room - over * n, items | {n: over})
            # A bin that nothing was opened for doesn't exist; the others stay as they are.
            if items:
                put(many - full - bool(over), room, items)
            left[n] -= full * each + over
    return [(many, items) for room in sorted(bins) for many, items in bins[room]]


def slots(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, one past the last, first bin, items a bin, offset in the bin): which
    of a length's items, in order of rank, go to which bins."""
    out, used, first_bin = [], dict[int, int](), 0
    for many, items in plan:
        at = 0
        for n, each in sorted(items.items(), reverse=True):
            rank = used.get(n, 0)
            used[n] = rank + many * each
            out.append((n, rank, used[n], first_bin, each, at))
            at += n * each
        first_bin += many
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all ``docs`` and their places: (key, piece, start, length, ids_crc32, sequence_id,
    offset[, ids]).

    A document's ids end with ``end_id``; a document longer than ``capacity`` is cut into pieces
    of that many ids, of which the first may be shorter. Null and empty texts have the end id
    alone. Repeated rows are packed as often as they stand there; null keys are keys like others;
    other columns are left out. An empty table gives no rows.

    Lengths are whole numbers up to ``capacity``, so the plan needs only their histogram (that
    many rows at most on the driver) and its slots are bounded by the capacity too; they are
    broadcast. An item's rank within its length comes from counts by (length, block of the
    written pieces) and its place in the block, so a length that most documents have is spread
    over all blocks.
    """
    spark = docs.sparkSession
    made = cut(tokenized(docs, tokenizer, capacity, end_id, key, text, with_ids).withColumn("block", F.spark_partition_id()), "pack-pieces")
    counts = cut(made.groupBy("length", "block").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    # From Arrow: rows of a list would go through Python workers of a kind of their own, which then
    # stay on the executors.
    places = zip(*(slots(plan_bins(histogram, capacity)) or [(0, 0, 0, 0, 1, 0)]))
    plan = spark.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in places], ["length", "lo", "hi", "first_bin", "each", "at"]))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "block").orderBy(F.col(key), "piece", "start", "ids_crc32")
    ranked = made.withColumn("in_block", F.row_number().over(inside) - 1).join(starts, ["length", "block"]).withColumn("rank", F.col("before") + F.col("in_block"))
    slot = F.broadcast(plan.withColumnRenamed("length", "slot_length"))
    placed = ranked.join(slot, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        key, "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).alias("offset"),
        *["ids"] * with_ids,
    )
