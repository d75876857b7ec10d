"""LM scoring by a probabilistic suffix tree whose counts stay spread over the cluster."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bucketed, cut, in_arrow
from .hashing import Q, hashed_words, joined, mix, parts, text_bytes

#: Text of one block of documents, in bytes, and tokens for one bucket of counts, roughly.
BLOCK, BUCKET = 16_000_000, 3_000_000
#: Bytes that a word of a block counts for at least, so that short words don't make larger blocks.
WORD = 4
#: Positions of a block that are worked on at once, and bytes of its texts.
SLICE, PART = 1 << 18, 1_000_000
#: Training occurrences a context needs to be tested, and one of its symbols to be counted in it.
CONTEXT, SYMBOL = 8, 2
#: What a counted symbol gives up for the shorter context, in occurrences.
DISCOUNT = 0.5
#: The end of a text. It also stands before the first word, as the context that a text begins in.
END = np.uint64(0x656E64)
RESULT = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
BLOCKS = "block string, train long, n_tokens long, docs binary, tokens binary, words binary, often binary"
#: Bits of a word's key, and of one of several words. A key is taken for another one of n with a
#: chance of n / 2 ** bits: of 100 million words none, of 10 billion n-grams one in 1,760.
WORD_BITS, KEY_BITS = 56, 44
MESSAGE = "kind int, block string, bucket int, keys binary, body binary"
ANSWER = "kind int, block string, bucket int, body binary"
#: What parts words.
BLANKS = [bytes([b]) for b in (32, *range(9, 14))]
#: Kinds of messages: counts of level k, evidence for contexts of level k, and the vocabulary.
DISTINCT = -1


def counts_of(level: int) -> int:
    return 2 * level


def contexts_of(level: int) -> int:
    return 2 * level + 1


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers or floats, their bytes by significance, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    flat = np.frombuffer(zstandard.decompress(bytes(b)), np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def _bits(kind: int) -> int:
    """Contexts of level 1 are words, like what is counted at level 0."""
    return WORD_BITS if kind in (counts_of(0), contexts_of(1)) else KEY_BITS


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.add.accumulate(_unpack(b, np.uint64), dtype=np.uint64)


def _pack_evidence(floats: np.ndarray, numbers: np.ndarray) -> bytes:
    a = _pack(floats.astype(np.float32).T.reshape(-1))
    return struct.pack("<q", len(a)) + a + _pack(numbers.astype(np.int64).T.reshape(-1))


def _unpack_evidence(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<q", b)
    return _unpack(b[8 : 8 + n], np.float32).reshape(2, -1).T, _unpack(b[8 + n :], np.int64).reshape(3, -1).T


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and each key's number among them, as np.unique has them, in less
    room. ``keys`` is the caller's last use of them: they are sorted in place."""
    order = np.argsort(keys)
    keys[:] = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], number


class Block:
    """A block of documents: its tokens as numbers of its own words, and what it has been told.

    ``told`` maps a kind of message to the answers, in order of the block's distinct keys of that
    kind; those keys follow from the tokens and the answers before, so they are never stored.

    Level k has the n-grams of k words and a symbol: ``keys[k]`` sorted, ``at[k]`` the number of each
    position's among them, or -1 where it isn't counted, ``n[k]`` their counts, once told, and a 0
    for -1. A position's context of level k is what stands before it at level k - 1. All that is held
    for each position is its document and its numbers, of 4 bytes each; whatever else is asked of
    positions is worked out for a SLICE of them.
    """

    def __init__(self, name: str, docs: pd.DataFrame, tokens: np.ndarray, words: np.ndarray, told: dict[int, np.ndarray]):
        self.name, self.docs, self.told = name, docs, told
        lengths = docs["n_tokens"].to_numpy()
        self.doc = np.repeat(np.arange(len(docs), dtype=np.int32), lengths)
        self.begins = np.zeros(len(tokens), bool)
        self.begins[np.cumsum(lengths)[:-1]] = True
        self.begins[:1] = True
        self.held = docs["held_out"].to_numpy(bool)
        self.end = int(np.searchsorted(words, END))
        self.keys, self.at, self.n = [words], [tokens], []
        self._told(0)

    def _told(self, k: int) -> None:
        answers = self.told.get(counts_of(k), np.zeros(0, np.int64))
        if len(answers) == len(self.keys[k]):  # all were told
            self.n.append(np.append(answers >> 1, 0))

    def slices(self) -> Iterator[np.ndarray]:
        for x in range(0, len(self.doc), SLICE):
            yield np.arange(x, min(x + SLICE, len(self.doc)))

    def before(self, k: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of positions: the number of their context of level ``k``, or -1, and its count."""
        place = np.where(self.begins[i], self.end if k == 1 else -1, self.at[k - 1][i - 1])
        n = self.n[k - 1][place]
        return np.where(n >= CONTEXT, place, -1), n

    def levels(self, upto: int) -> None:
        """Levels 1 to ``upto``; all but the last have been told their counts, the last may be."""
        for k in range(1, upto + 1):
            keys, here, m = np.empty(len(self.doc), np.uint64), np.empty(len(self.doc), bool), 0
            for i in self.slices():
                place, _ = self.before(k, i)
                here[i] = on = (place >= 0) & (self.n[k - 1][self.at[k - 1][i]] >= SYMBOL)
                words = self.keys[0][self.at[0][i[on]]]
                keys[m : m + len(words)] = mix(self.keys[k - 1][place[on]] * np.uint64(Q) + words + np.uint64(k)) >> np.uint64(64 - KEY_BITS)
                m += len(words)
            found, number = numbered(keys[:m])
            del keys
            at = np.full(len(here), -1, np.int32)
            at[here] = number
            self.keys.append(found)
            self.at.append(at)
            self._told(k)

    def base(self, i: np.ndarray, n: int, v: int) -> np.ndarray:
        return (self.n[0][self.at[0][i]] + 0.1) / (n + 0.1 * (v + 1))

    def stand(self, k: int) -> np.ndarray:
        """Which of the keys of level ``k`` - 1 stand here as contexts; one place more, for -1."""
        on = np.zeros(len(self.keys[k - 1]) + 1, bool)
        for i in self.slices():
            on[self.before(k, i)[0]] = True
        on[-1] = False
        return on

    def shares(self, upto: int) -> list[np.ndarray]:
        """For levels 1 to ``upto`` what contexts leave to shorter ones, by number; -1 if not kept."""
        out = []
        for k in range(1, upto + 1):
            on = self.stand(k)
            out.append(np.full(len(on), -1, np.float32))
            out[-1][on] = self.told.get(contexts_of(k), np.zeros(0, np.float32))
        return out

    def probability(self, i: np.ndarray, shares: list[np.ndarray], n: int, v: int) -> np.ndarray:
        """Of the tokens at positions, in their longest kept context of those that have ``shares``."""
        p = self.base(i, n, v)
        for k, share in enumerate(shares, 1):
            place, seen = self.before(k, i)
            left, c = share[place].astype(float), self.n[k][self.at[k][i]]
            own = np.where(c >= SYMBOL, c - DISCOUNT, 0) / np.maximum(seen, 1)
            p = np.where(left >= 0, own + left * p, p)
        return p

    def counts(self, k: int, buckets: int) -> list[tuple]:
        """Messages: how often this block's texts to learn from have each key of level ``k``."""
        n = np.zeros(len(self.keys[k]), np.int64)
        for i in self.slices():
            at = self.at[k][i]
            n += np.bincount(at[~self.held[self.doc[i]] & (at >= 0)], minlength=len(n))
        n = n.astype(np.uint32)
        return self._split(counts_of(k), self.keys[k], buckets, lambda x, y: _pack(n[x:y]))

    def evidence(self, k: int, total: int, v: int, buckets: int) -> list[tuple]:
        """Messages: contexts of level ``k``, and for each the sums over those of its counted symbols
        that this block answers for: c ln(P(symbol | context) / P(symbol | shorter)), P(symbol |
        shorter); c, 1; and the context's count."""
        on = self.stand(k)
        contexts = self.keys[k - 1][on[:-1]]
        number = np.where(on, np.cumsum(on, dtype=np.int32) - 1, -1)
        floats, numbers = np.zeros((len(contexts), 2)), np.zeros((len(contexts), 3), np.int64)
        numbers[:, 2] = self.n[k - 1][on]
        answer = self.told.get(counts_of(k), np.zeros(0, np.int64))
        first = np.full(len(self.keys[k]), -1, np.int64)
        for i in reversed(list(self.slices())):
            i = i[self.at[k][i] >= 0][::-1]
            first[self.at[k][i]] = i
        mine = ((answer & 1) == 1) & ((answer >> 1) >= SYMBOL)
        p, c, shares = first[mine], answer[mine] >> 1, self.shares(k - 1)
        lower = np.concatenate([np.zeros(0), *(self.probability(p[x : x + SLICE], shares, total, v) for x in range(0, len(p), SLICE))])
        place, n = self.before(k, p)
        for into, column, value in ((floats, 0, c * np.log(c / n / lower)), (floats, 1, lower), (numbers, 0, c), (numbers, 1, np.ones(len(c)))):
            into[:, column] = np.bincount(number[place], value, len(contexts))
        return self._split(contexts_of(k), contexts, buckets, lambda x, y: _pack_evidence(floats[x:y], numbers[x:y]))

    def _split(self, kind: int, keys: np.ndarray, buckets: int, body: Callable[[int, int], bytes]) -> list[tuple]:
        """Messages by bucket: runs of sorted keys, so that answers put together in order of the
        bucket are in order of the keys."""
        of = ((keys >> np.uint64(_bits(kind) - 32)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64)).tolist()
        return [(kind, self.name, b, _pack_keys(keys[x:y]), body(x, y)) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]


def _restored(row: dict, told: dict[int, np.ndarray]) -> Block:
    table = pa.ipc.open_stream(bytes(row["docs"])).read_all()
    docs = table.select(["held_out", "n_tokens"]).to_pandas()
    docs.insert(0, "id", pd.array(table["id"].to_pylist(), "Int64"))
    words_by_use = np.argsort(-_unpack(row["often"], np.int32), kind="stable").astype(np.int32)
    return Block(row["block"], docs, words_by_use[_unpack(row["tokens"], np.int32)], _unpack_keys(row["words"]), told)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "block", "bucket", "keys", "body"])


def _reduced(group: pd.DataFrame) -> pd.DataFrame:
    """All messages of a bucket to their answers: counts get the sum over all blocks and, in the
    lowest bit, whether this block answers for the key; contexts what they leave to shorter ones."""
    out = []
    for kind, rows in group.groupby("kind"):
        rows = rows.sort_values("block")
        keys = [_unpack_keys(k) for k in rows["keys"]]
        ends = np.cumsum([len(k) for k in keys]).tolist()
        every, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        if kind % 2:
            body = [_unpack_evidence(b) for b in rows["body"]]
            floats, numbers = (np.concatenate([b[k] for b in body]) for k in (0, 1))
            sums = [np.bincount(at, x, len(every)) for x in (*floats.astype(float).T, *numbers[:, :2].T)]
            n = np.zeros(len(every), np.int64)
            n[at] = numbers[:, 2]  # the same in every block
            answer = _shares(*sums, n)[at].astype(np.float32)
        else:
            total = np.bincount(at, np.concatenate([_unpack(b, np.uint32) for b in rows["body"]]), len(every)).astype(np.int64)
            answer = total[at] * 2
            answer[first] += 1
            if kind != counts_of(0):
                answer[total[at] < SYMBOL] = 0  # isn't counted
            else:
                out.append((DISTINCT, "", int(rows["bucket"].iloc[0]), _pack(np.array([int((total > 0).sum())]))))
        for name, bucket, x, y in zip(rows["block"], rows["bucket"], [0, *ends[:-1]], ends):
            out.append((int(kind), name, int(bucket), _pack(answer[x:y])))
    return pd.DataFrame(out, columns=["kind", "block", "bucket", "body"])


def _shares(gain: np.ndarray, lower: np.ndarray, mass: np.ndarray, symbols: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The divergence test. Of contexts that are kept the share left to the shorter context, of
    others -1. Kept are those whose next symbols fit their own distribution better than the
    shorter context's by more than its parameters cost: n KL > (symbols + 1) / 2 ln n, in nats."""
    rest = np.maximum(n - mass, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gain + np.where(rest > 0, rest * np.log(np.where(rest > 0, rest, 1) / n / np.maximum(1 - lower, 1e-12)), 0)
        share = 1 - (mass - DISCOUNT * symbols) / n
    return np.where((symbols > 0) & (gain > (symbols + 1) / 2 * np.log(n)), np.clip(share, 1e-9, 1), -1.0)


def _blocks(docs: DataFrame, key: str, text: str, folds: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bodies, size, made = [], [], 0, 0

        def block() -> pa.RecordBatch:
            hashes, lengths = [], []
            for _, part in parts(bodies, PART):
                whose, words = hashed_words(*joined(part))
                n = np.bincount(whose, minlength=len(part))
                hashes.append(np.insert(words >> np.uint64(64 - WORD_BITS), np.cumsum(n), END))
                lengths.append(n + 1)
            words, tokens = numbered(np.concatenate(hashes))
            del hashes
            often = np.bincount(tokens)
            by_use = np.empty(len(words), np.int32)  # tokens as small numbers take less room
            by_use[np.argsort(-often, kind="stable")] = np.arange(len(words))
            held = np.array([i is not None and zlib.crc32(str(i).encode()) % folds == 0 for i in ids])
            lengths = np.concatenate(lengths)
            table = pa.table({"id": pa.array(ids, pa.int64()), "held_out": held, "n_tokens": lengths})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            name = f"{TaskContext.get().partitionId():08d}-{made:08d}"
            row = (name, int(lengths[~held].sum()), len(tokens), sink.getvalue().to_pybytes(), _pack(by_use[tokens]), _pack_keys(words), _pack(often.astype(np.int32)))
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4])], [f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1), lower=True)):
                ids.append(i), bodies.append(body)
                size += max(len(body), WORD * (1 + sum(map(body.count, BLANKS))))
                if size >= BLOCK:
                    yield block()
                    ids, bodies, size, made = [], [], 0, made + 1
        if ids:
            yield block()

    return in_arrow(docs.select(docs[key].cast("long"), docs[text]), read, BLOCKS)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, depth: int = 2) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Words are what white space of ASCII leaves, A-Z in lower case; each text ends in one more
    token. Held out are the keys whose CRC-32 as text leaves 0 by ``folds``; all other texts, whole,
    are learnt from, and so are those with a null key. ``base_score`` is the smoothed unigram score,
    ``score`` that of the tree, both log10 of the text's probability.

    The tree's contexts are up to ``depth`` words, the beginning of a text being one. A context seen
    CONTEXT times is kept if its next words diverge enough from those of the context without its
    first word (``_shares``); a word is scored in the longest context kept, whose counts, less
    DISCOUNT, are filled up from the next shorter one kept, down to the smoothed unigrams. All
    thresholds are numbers of occurrences and hold at every size.

    Nothing of the model is on the driver but two totals. Documents become blocks; a block sends
    its distinct keys, packed, to buckets by hash of the whole n-gram, so frequent words are
    spread, and gets global answers back in the same order. Buckets are as many as shuffle
    partitions, or as the counted tokens need. Level by level only n-grams are sent whose shorter
    forms are frequent enough. Every step ends in a written table; blocks never move.

    Null texts are empty: one token. Repeated rows count as often as they stand there. An empty
    table gives no rows. Extra columns are left out.
    """
    spark = docs.sparkSession
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # What is in these tables is packed already.
    blocks = Bucketed(_blocks(docs, key, text, folds), "block", places, "none")
    n, tokens = blocks.table.agg(F.sum("train"), F.sum("n_tokens")).first()
    if n is None:
        blocks.drop()
        return spark.createDataFrame([], RESULT).withColumnRenamed("id", key)
    buckets = max(places, -(-tokens // BUCKET))
    answers: list[Bucketed] = []

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("block", pa.string()), ("bucket", pa.int32()), ("keys", pa.binary()), ("body", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pandas(_frame(_restored(row, {}).counts(0, buckets)), schema=schema, preserve_index=False)

    def answered(messages: DataFrame) -> None:
        found = messages.groupBy("bucket").applyInPandas(_reduced, ANSWER)
        answers.append(Bucketed(found.repartition(places, "block"), "block", places, "none"))

    def told(tell: Callable[[Block], pd.DataFrame], schema: str = MESSAGE) -> DataFrame:
        """What each block makes of all answers so far."""
        empty = [f.split()[0] for f in schema.split(", ")]

        def merge(block: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
            if not len(block):
                return pd.DataFrame([], columns=empty)
            known = {int(kind): np.concatenate([_unpack(b, np.float32 if kind % 2 else np.int64) for b in rows.sort_values("bucket")["body"]]) for kind, rows in said.groupby("kind")}
            return tell(_restored(block.iloc[0], known))

        said = reduce(DataFrame.unionByName, [a.table for a in answers]).where(F.col("kind") != DISTINCT)
        return blocks.table.select("block", "docs", "tokens", "words", "often").groupBy("block").cogroup(said.groupBy("block")).applyInPandas(merge, schema)

    answered(in_arrow(blocks.table.select("block", "docs", "tokens", "words", "often"), words, MESSAGE, 1))
    v = sum(int(_unpack(r["body"], np.int64)[0]) for r in answers[0].table.where(F.col("kind") == DISTINCT).select("body").toLocalIterator())

    def counts(k: int) -> Callable[[Block], pd.DataFrame]:
        def tell(block: Block) -> pd.DataFrame:
            block.levels(k)
            return _frame(block.counts(k, buckets))

        return tell

    def evidence(k: int) -> Callable[[Block], pd.DataFrame]:
        def tell(block: Block) -> pd.DataFrame:
            block.levels(k)
            return _frame(block.evidence(k, n, v, buckets))

        return tell

    for k in range(1, depth + 1):  # one exchange at a time is on disk
        answered(told(counts(k)))
        answered(told(evidence(k)))

    def scores(block: Block) -> pd.DataFrame:
        return _scores(block, depth, n, v)

    out = cut(told(scores, RESULT), "lm-scores")
    for table in (blocks, *answers):
        table.drop()
    return out.withColumnRenamed("id", key)


def _scores(block: Block, depth: int, n: int, v: int) -> pd.DataFrame:
    block.levels(depth)
    shares, known, base, score = block.shares(depth), *(np.zeros(len(block.docs), t) for t in (np.int64, float, float))
    for i in block.slices():
        doc = block.doc[i]
        np.add.at(known, doc, block.n[0][block.at[0][i]] > 0)
        np.add.at(base, doc, np.log10(block.base(i, n, v)))
        np.add.at(score, doc, np.log10(block.probability(i, shares, n, v)))
    out = block.docs[["id", "held_out", "n_tokens"]].copy()
    return out.assign(n_known=known, train_tokens=n, base_score=base, score=score)
