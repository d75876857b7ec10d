"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, one_step
from .hashing import P, Q, hashed_words, joined, parts, text_bytes

_AGAIN = np.uint64(0x2545F4914F6CDD1D)

def _buckets(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def hashed_features(texts: list[bytes], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of every feature of ``texts``: each word, each pair of words that follow
    one another, each three and four bytes in a row. A pair that the document had before counts as
    the one feature "again", and so does a word that follows itself."""
    raw, of = joined(texts)
    for n in (3, 4):
        if len(raw) < n:
            continue
        h = raw[: len(raw) - n + 1].astype(np.uint64)
        for j in range(1, n):
            h = (h << np.uint64(8)) | raw[j : len(raw) - n + 1 + j]
        inside = of[: len(h)] == of[n - 1 :]
        yield of[: len(h)][inside], _buckets((h[inside] + np.uint64(n)) * np.uint64(P), bits)
    whose, words = hashed_words(raw, of)
    if not len(words):
        return
    yield whose, _buckets(words * np.uint64(Q), bits)
    follows = whose[1:] == whose[:-1]
    a, b, d = words[:-1][follows], words[1:][follows], whose[:-1][follows]
    pair = a * np.uint64(P) + b * np.uint64(Q) + np.uint64(7)
    _, first = np.unique(pair + d.astype(np.uint64) * np.uint64(_AGAIN), return_index=True)
    new = np.zeros(len(pair), bool)
    new[first] = True
    yield d, _buckets(np.where(new & (a != b), pair, _AGAIN), bits)


@dataclass
class Model:
    """What scoring needs: for each bucket its vector's product with the difference of the two
    classes' weights, and the difference of their biases."""

    bits: int
    gain: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, part in parts(texts):
            total, count = np.zeros(len(part)), np.zeros(len(part))
            for of, bucket in hashed_features(part, self.bits):
                total += np.bincount(of, self.gain[bucket], len(part))
                count += np.bincount(of, minlength=len(part))
            out[first : first + len(part)] = total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def _train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, width: int, epochs: int, rate: float, seed: int) -> Model:
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / width, 1 / width, (1 << bits, width)).astype(np.float32)
    weights, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    weights[:, 1] = random.uniform(-1, 1, width)
    weights[:, 0] = -weights[:, 1]
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for r in random.permutation(len(rows)):
            ids, share = rows[r]
            step = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[ids]
            out = hidden @ weights + bias
            out = np.exp(out - out.max())
            out /= out.sum()
            out[labels[r]] -= 1  # softmax's gradient
            back = weights @ out
            weights -= step * np.outer(hidden, out)
            bias -= step * out
            # A vector's share of a document is small: its step is larger by that, as a constant.
            vectors[ids] -= np.outer(share * np.float32(20 * step), back)
    return Model(bits, (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _weighed(texts: list[bytes], bits: int) -> Iterator[tuple[bytes, bytes]]:
    """Each text's distinct buckets and their shares of its features, as bytes."""
    for t in texts:
        found = [b for _, b in hashed_features([t], bits)]
        ids, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
        yield ids.astype(_bucket_type(bits)).tobytes(), (counts / max(1, counts.sum())).astype("<f4").tobytes()


def _bucket_type(bits: int) -> str:
    return "<u2" if bits <= 16 else "<u4"


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 4000, bits: int = 15, width: int = 16, epochs: int = 3, rate: float = 0.25, seed: int = 7) -> Model:
    """Learn from at most ``max_rows`` labelled keys, those first in order of their hash.

    The tasks turn each of their texts, whole, into shares by bucket; one task runs the descent over
    these, in order of the key's hash, and the driver gets the finished gains, 4 bytes a bucket. The
    descent's input is bounded by the parameters, at 6 bytes for each of 2 ** ``bits`` buckets of
    ``max_rows`` texts at most, and doesn't grow with the tables.

    Labels that are null or not 0 or 1, and those of null keys, are left out; of a key with several
    labels the smallest counts, of one with several texts that whose hash is smallest. Null texts
    are empty. Without any labelled row every score is 0.5, with one class only that class's.
    Only the named columns are read, whatever else the tables have.
    """
    known = labels.select(labels[key].alias("id"), labels[label].alias("class")).where(F.col("class").isin(0, 1) & F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.min("class").cast("int").alias("class")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    bodies = docs.select(docs[key].alias("key"), docs[text].alias("body"))
    sample = bodies.join(F.broadcast(known), F.col("key") == F.col("id")).select(F.xxhash64("key").alias("place"), F.xxhash64("body").alias("tie"), "class", "body")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = list(_weighed(text_bytes(rows.column(3)), bits))
            yield pa.record_batch([*rows.columns[:3], pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], ["place", "tie", "class", "buckets", "shares"])

    weighed = in_arrow(sample, weigh, "place long, tie long, class int, buckets binary, shares binary", 64)
    one = weighed.groupBy("place").agg(F.min(F.struct("tie", "class", "buckets", "shares")).alias("row")).select("place", "row.class", "row.buckets", "row.shares")

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, rows = [], []
        for batch in batches:
            y += batch.column(1).to_pylist()
            rows += [(np.frombuffer(b.as_buffer(), _bucket_type(bits)), np.frombuffer(w.as_buffer(), "<f4")) for b, w in zip(batch.column(2), batch.column(3))]
        model = _learnt(rows, np.array(y, np.int64), bits, width, epochs, rate, seed)
        yield pa.record_batch([pa.array([model.gain.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["gain", "bias"])

    with one_step(docs.sparkSession):
        made = in_arrow(one.coalesce(1).sortWithinPartitions("place"), descend, "gain binary, bias double").collect()
    return Model(bits, np.frombuffer(bytes(made[0]["gain"]), np.float32), made[0]["bias"]) if made else _learnt([], np.zeros(0, np.int64), bits, width, epochs, rate, seed)


def _learnt(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, width: int, epochs: int, rate: float, seed: int) -> Model:
    if len(set(labels.tolist())) < 2:
        return Model(bits, np.zeros(1 << bits, np.float32), 0.0 if not len(labels) else 30.0 if labels[0] else -30.0)
    return _train(rows, labels, bits, width, epochs, rate, seed)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "quality_score", keep_from: float | None = None) -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text as column ``into``, which replaces one of
    that name; with ``keep_from`` instead ``docs``, all columns as they are, less the rows that
    score less. Null and empty texts have no features but blanks and get the model's score for
    those; equal texts score alike, repeated rows stay; an empty table gives no rows. Columns go
    through Python beside the texts; nothing is shuffled."""
    own = docs.columns if keep_from is not None else [c for c in docs.columns if c != into]
    at = own.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = held.value.scores(text_bytes(batch.column(at)))
            if keep_from is not None:
                yield batch.filter(pa.array(scores >= keep_from))
            else:
                yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], [*own, into])

    schema = docs.select(own).schema
    return in_arrow(docs.select(own), rate, schema if keep_from is not None else schema.add(into, "double"))
