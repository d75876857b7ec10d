"""Near duplicates by MinHash: an LSH forest over sorted signature orders, links confirmed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bucketed, cut, drop_table, in_arrow
from .hashing import Q, hashed_words, joined, mix, parts, text_bytes

#: Orders of the forest, and signature values in each; documents meet in an order that share the
#: first BASE of them. At a similarity of 0.8 a pair misses all orders once in 100,000 times.
TREES, DEPTH, BASE = 16, 9, 3
VALUES = TREES * DEPTH
#: Rows of an order that are compared with each other at once. The first round compares a row of a
#: larger region with this many neighbours, which are those with the longest common prefix; the last
#: one takes such a region as blocks of half as many rows, each two of them together.
REGION = 1024
#: Rows of small parts beyond which the last round takes a region deeper first: by so many orders of
#: further values each (BASE a step), so that a pair at a similarity of 0.8 that met before still
#: meets in all but one of 10,000 cases, while rows that are less alike part.
WIDE, DEEPER = 4096, 3
#: Nodes with at least so many confirmed links are hubs, and so many of a large region, those with
#: most links, are held against all of its rows before its blocks are.
HUB_LINKS, HUBS = 4, 16
#: Estimated similarity, below the wanted one, from which a pair is confirmed: over four standard
#: deviations of an estimate from VALUES values.
SLACK = 0.15
#: Values of full sets, of 8 bytes, that a task keeps for further pairs.
KEPT = 4_000_000
_SEEDS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(Q)) | np.uint64(1)


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Each text's distinct ``n``-word shingles as sorted hashes; fewer words, but not none, are
    one shingle; no words, none."""
    for _, part in parts(texts):
        whose, words = hashed_words(*joined(part))
        ends = np.searchsorted(whose, np.arange(len(part) + 1))
        for a, b in zip(ends[:-1], ends[1:]):
            w = words[a:b]
            size = min(n, len(w))
            if not size:
                yield np.zeros(0, np.uint64)
                continue
            h = w[: len(w) - size + 1].copy()
            for j in range(1, size):
                h = h * np.uint64(Q) + w[j : len(w) - size + 1 + j]
            yield np.unique(mix(h + np.uint64(size)))


def _signature(s: np.ndarray) -> np.ndarray:
    low = np.full(VALUES, 2**64 - 1, np.uint64)
    for k in range(0, len(s), 4096):
        low = np.minimum(low, (s[None, k : k + 4096] * _SEEDS[:, None]).min(1))
    return (mix(low) >> np.uint64(32)).astype("<u4")


def _marks(docs: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """(key, tie, n_shingles, print, signature): a row's key and its text's hash, the size of its
    set, the set's digest, MinHash."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, signatures = [], [], []
            for s in shingle_sets(text_bytes(batch.column(1), lower=True), n):
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                signatures.append(_signature(s).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary())], ["key", "tie", "n_shingles", "print", "signature"])

    return in_arrow(docs.select(docs[key].cast("long").alias("key"), docs[text].alias("body"), F.xxhash64(docs[text]).alias("tie")), mark, "key long, tie long, n_shingles long, print binary, signature binary")


def _cells(sets: DataFrame) -> DataFrame:
    """(cell, node), a row for each order: the cell is the order and the first BASE values."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, TREES, DEPTH).astype(np.uint64)
            h = np.broadcast_to(np.arange(TREES, dtype=np.uint64), values.shape[:2]).copy()
            for j in range(BASE):
                h = mix(h * np.uint64(Q) + values[:, :, j])
            yield pa.record_batch([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(batch.column(0)), TREES)), pa.array(np.tile(np.arange(TREES, dtype=np.int8), len(values)))], ["cell", "node", "tree"])

    return in_arrow(sets.select("node", "signature"), split, "cell long, node long, tree tinyint", 4096)


def _deeper(rows: DataFrame, cells: DataFrame, signatures: DataFrame, step: int) -> DataFrame:
    """``rows`` of the regions in ``cells``, each in DEEPER new ones: those that share its region and
    the ``step``-th BASE values of another order as well. The orders follow from the region."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, TREES, DEPTH).astype(np.uint64)
            cell, at = np.asarray(batch.column(0)).view(np.uint64), np.arange(batch.num_rows)
            first = mix(cell + np.uint64(step)) % np.uint64(TREES)
            for k in range(DEEPER):
                tree = ((first + np.uint64(k)) % np.uint64(TREES)).astype(int)
                h = mix(cell * np.uint64(Q) + np.uint64(k + 1))
                for j in range(step * BASE, (step + 1) * BASE):
                    h = mix(h * np.uint64(Q) + values[at, tree, j])
                yield pa.record_batch([pa.array(h.view(np.int64)), *batch.columns[2:]], ["cell", "node", "n_shingles", "low", "part"])

    own = rows.join(F.broadcast(cells) if cells.count() < REGION else cells, "cell", "left_semi").join(signatures, "node")
    return in_arrow(own.select("cell", "signature", "node", "n_shingles", "low", "part"), split, "cell long, node long, n_shingles long, low binary, part long", 4096)


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shares of equal low bytes of signatures, row by row: one in 256 is equal by chance."""
    if len(a) * len(b) <= 4096:
        return (a[:, None, :] == b[None, :, :]).mean(2, dtype=np.float32)
    same = np.zeros((len(a), len(b)), np.uint8)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        same += x[:, None] == y[None, :]
    return same / np.float32(VALUES)


def _stars(like: np.ndarray, low: float) -> list[tuple[int, int]]:
    """Few pairs that hold together what is alike: round by round the row most others are like
    becomes a hub for all of them; each row is also paired with the row most like it."""
    near = like >= low
    np.fill_diagonal(near, False)
    left, out = near.any(1), set()
    best = np.where(near, like, -1).argmax(1)
    out |= {(int(min(i, best[i])), int(max(i, best[i]))) for i in np.flatnonzero(left)}
    degrees = near[:, left].sum(1) if left.any() else np.zeros(len(like))
    while left.any():
        hub = int(np.argmax(degrees))
        spokes = np.flatnonzero(near[hub] & left)
        left[hub] = False
        left[spokes] = False
        out |= {(min(hub, int(j)), max(hub, int(j))) for j in spokes if j != hub}
        degrees = near[:, left].sum(1)
        if not degrees.any():
            break
    return sorted(out)


def _unlike_sizes(a: np.ndarray, b: np.ndarray, low: float) -> np.ndarray:
    """Where set sizes alone rule the wanted similarity out."""
    return np.minimum(a[:, None], b[None, :]) < (low + SLACK) * 0.999 * np.maximum(a[:, None], b[None, :])


def _candidates(rows: DataFrame, low: float) -> DataFrame:
    """Pairs (a, b) of nodes from rows (cell, node, n_shingles, low bytes) in order: few, that hold
    together what is alike among neighbours, and are yet to be confirmed."""

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, sizes, bytes_ = None, [], [], []
        columns = (nodes, sizes, bytes_)

        def compare(fresh: int) -> pa.RecordBatch:
            # The first rows are a large region's first ones, kept as hubs, and half a block of
            # neighbours; pairs among those were compared before.
            b = np.frombuffer(b"".join(bytes_), np.uint8).reshape(-1, VALUES)
            x, size = np.array(nodes), np.array(sizes, float)
            like = _likeness(b, b)
            like[_unlike_sizes(size, size, low)] = 0
            like[x[:, None] == x[None, :]] = 0
            found = [p for p in _stars(like, low) if p[1] >= fresh]
            i, j = np.array([p[0] for p in found], int), np.array([p[1] for p in found], int)
            return pa.record_batch([pa.array(np.minimum(x[i], x[j]), pa.int64()), pa.array(np.maximum(x[i], x[j]), pa.int64())], ["a", "b"])

        def clear(keep: int = 0) -> None:
            for column in columns:
                column[:] = column[: min(keep, 16)] + column[-keep:] if keep else []

        fresh = 0
        for batch in batches:
            cells, *values = (batch.column(k).to_pylist() for k in range(4))
            for c, *row in zip(cells, *values):
                if c != cell:
                    if len(nodes) > max(1, fresh):
                        yield compare(fresh)
                    clear()
                    cell, fresh = c, 0
                elif len(nodes) >= REGION:
                    yield compare(fresh)
                    clear(REGION // 2)
                    fresh = len(nodes)
                for column, value in zip(columns, row):
                    column.append(value)
        if len(nodes) > max(1, fresh):
            yield compare(fresh)

    return in_arrow(rows, pairs_of, "a long, b long", 4096).distinct()


def _apart(rows: DataFrame) -> DataFrame:
    """(cell, part, large, owner, deal, total, others) of each part in the regions that hold several:
    the blocks its rows are dealt to. A region up to REGION rows is one block. In a larger one, parts
    that fill a block have blocks of their own, as ``owner``, and all others are dealt together."""
    half, n, total = max(REGION // 2, 1), F.col("n"), F.col("total")
    of_part = cut(rows.groupBy("cell", "part").agg(F.count("*").alias("n")), "near-parts")
    of_cell = of_part.groupBy("cell").agg(F.sum("n").alias("total"), F.count("*").alias("parts"), F.sum(F.when(n < half, n).otherwise(0)).alias("others")).where("parts > 1").drop("parts")
    large = total > REGION
    deal = F.when(~large, 1).when(n >= half, F.ceil(n / half)).otherwise(F.ceil(F.col("others") / half))
    out = of_part.join(of_cell, "cell").select("cell", "part", large.alias("large"), F.when(large & (n >= half), F.col("part")).alias("owner"), deal.cast("long").alias("deal"), "total", "others")
    out = cut(out, "near-apart")
    drop_table(of_part)
    return out


def _dealt(rows: DataFrame, apart: DataFrame) -> DataFrame:
    """Rows (cell, node, n_shingles, part, low, side) of the regions in ``apart`` (see ``_apart``),
    such that any two rows of one region and two parts meet in a cell: a small region is a cell, of a
    large one each two blocks, but those of one part. ``side`` is 0 where all rows of a cell are
    compared, else 1 or 2, to be compared with each other."""
    block = F.xxhash64("owner", F.col("owner").isNull(), "slot")
    placed = rows.select("cell", "node", "n_shingles", "part", "low").join(apart, ["cell", "part"]).withColumn("slot", F.pmod(F.xxhash64("node"), F.col("deal")))
    small = placed.where("not large").select("cell", "node", "n_shingles", "part", "low", F.lit(0).alias("side"))
    blocks = apart.where("large").select("cell", "owner", "deal").distinct().select("cell", "owner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deal") - 1)).alias("slot")).select("cell", "owner", block.alias("block"))
    both = blocks.join(blocks.select("cell", F.col("owner").alias("owner_2"), F.col("block").alias("block_2")), "cell").where("block <= block_2 and not coalesce(owner = owner_2, false)")
    side = lambda of, k: F.struct(F.col(of).alias("block"), F.lit(k).alias("side"))
    sides = F.when(F.col("block") == F.col("block_2"), F.array(side("block", 0))).otherwise(F.array(side("block", 1), side("block_2", 2)))
    sides = both.select("cell", F.xxhash64("cell", "block", "block_2").alias("met"), F.explode(sides).alias("s")).select("cell", "met", "s.*")
    large = placed.where("large").withColumn("block", block).join(sides, ["cell", "block"])
    return small.unionByName(large.select(F.col("met").alias("cell"), "node", "n_shingles", "part", "low", "side"))


def _to_hubs(rows: DataFrame, apart: DataFrame, links: DataFrame) -> DataFrame:
    """Rows as of ``_dealt``: in each large region in ``apart`` the hubs (side 1) against all rows
    (side 2), block by block. Work is linear in rows; what it joins, blocks needn't be compared for."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    hubs = ends.groupBy("node").agg(F.count("*").alias("links")).where(F.col("links") >= HUB_LINKS)
    regions = apart.where("large").select("cell", F.ceil(F.col("total") / max(REGION // 2, 1)).alias("deal")).distinct()
    placed = rows.select("cell", "node", "n_shingles", "part", "low").join(regions, "cell")
    order = Window.partitionBy("cell").orderBy(F.desc("links"), "node")
    first = placed.join(hubs, "node").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= HUBS)
    slots = F.sequence(F.lit(0).cast("long"), F.col("deal") - 1)
    first = first.withColumn("slot", F.explode(slots)).withColumn("side", F.lit(1))
    placed = placed.withColumn("slot", F.pmod(F.xxhash64("node"), F.col("deal"))).withColumn("side", F.lit(2))
    columns = (F.xxhash64("cell", "slot").alias("cell"), "node", "n_shingles", "part", "low", "side")
    return placed.select(*columns).unionByName(first.select(*columns))


def _across(rows: DataFrame, low: float, give: str, confirm: tuple[int, float] | None = None) -> DataFrame:
    """From rows (cell, node, n_shingles, part, low, side[, body]), cell by cell and whole: of the
    pairs alike enough, on two sides and of two parts,

    * "best": (a, b), for each row of side 2 the row of side 1 most like it, yet to be confirmed;
    * "marks": (cell, node) of all rows in them, as (a, b);
    * "links": those that full sets confirm (``confirm``: shingle length, similarity), until they
      join the cell's parts.
    """

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, columns = None, tuple([] for _ in range(5 + bool(confirm)))
        sets = _Sets(*confirm) if confirm else None

        def compare() -> pa.RecordBatch:
            x, size, part, side = (np.array(columns[k]) for k in (0, 1, 2, 4))
            b = np.frombuffer(b"".join(columns[3]), np.uint8).reshape(-1, VALUES)
            p, q = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
            like = _likeness(b[p], b[q])
            like[_unlike_sizes(size[p].astype(float), size[q].astype(float), low)] = 0
            like[part[p][:, None] == part[q][None, :]] = 0
            if give == "best":
                i = like.argmax(0) if len(p) else np.zeros(0, int)
                j = np.flatnonzero(like.max(0) >= low) if len(p) else i
                i, j = p[i[j]], q[j]
            else:
                i, j = np.nonzero(like >= low)
                value = like[i, j]
                i, j = p[i], q[j]
                if give == "marks":
                    hit = np.unique(x[np.concatenate((i, j))])
                    return pa.record_batch([pa.array(np.full(len(hit), cell), pa.int64()), pa.array(hit, pa.int64())], ["a", "b"])
                once = (side[i] != side[j]) | (i < j)
                order = np.argsort(-value[once], kind="stable")
                found = sets.links(x, columns[5], part, i[once][order], j[once][order])
                i, j = np.array([f[0] for f in found], int), np.array([f[1] for f in found], int)
            return pa.record_batch([pa.array(np.minimum(x[i], x[j]), pa.int64()), pa.array(np.maximum(x[i], x[j]), pa.int64())], ["a", "b"])

        for batch in batches:
            cells, *values = (batch.column(k).to_pylist() for k in range(6 + bool(confirm)))
            for c, *row in zip(cells, *values):
                if c != cell:
                    if len(columns[0]) > 1:
                        yield compare()
                    cell = c
                    for column in columns:
                        column.clear()
                for column, value in zip(columns, row):
                    column.append(value)
        if len(columns[0]) > 1:
            yield compare()

    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell", "node")
    rows = rows.select("cell", "node", "n_shingles", "part", "low", "side", *["body"] * bool(confirm))
    return in_arrow(rows, pairs_of, "a long, b long", 512 if confirm else 4096).distinct()


class _Sets:
    """Full shingle sets of a task's nodes, worked out when asked for; and what was found of pairs."""

    def __init__(self, n: int, similarity: float):
        self.n, self.percent = n, round(similarity * 100)
        self.kept: dict[int, np.ndarray] = {}
        self.told: dict[tuple[int, int], bool] = {}
        self.held = 0

    def need(self, wanted: dict[int, str]) -> None:
        if self.held > KEPT:
            self.kept.clear()
            self.held = 0
        fresh = {k: t for k, t in wanted.items() if k not in self.kept}
        for k, s in zip(fresh, shingle_sets([(t or "").encode("utf-8", "surrogatepass").lower() for t in fresh.values()], self.n)):
            self.kept[k] = s
            self.held += len(s)

    def linked(self, a: int, b: int) -> bool:
        x, y = self.kept[a], self.kept[b]
        both = np.concatenate((x, y))
        both.sort(kind="stable")  # two sorted runs are merged
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return 100 * common >= self.percent * (len(x) + len(y) - common)

    def links(self, nodes: np.ndarray, bodies: list[str], part: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """Pairs, likeliest first, that are linked and join parts not joined before."""
        used = np.unique(np.concatenate((i, j)))
        self.need({int(nodes[k]): bodies[k] for k in used})
        if len(self.told) > 2_000_000:
            self.told.clear()
        up = {int(p): int(p) for p in part}

        def top(p: int) -> int:
            while up[p] != p:
                up[p] = up[up[p]]
                p = up[p]
            return p

        out = []
        for a, b in zip(i.tolist(), j.tolist()):
            p, q = top(int(part[a])), top(int(part[b]))
            if p == q:
                continue
            pair = (int(nodes[a]), int(nodes[b]))
            if pair not in self.told:
                self.told[pair] = self.linked(*pair)
            if self.told[pair]:
                up[max(p, q)] = min(p, q)
                out.append((a, b))
        return out


def _confirm(pairs: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(n, similarity)
        for batch in batches:
            a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
            sets.need(dict(zip(a, x)) | dict(zip(b, y)))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array([sets.linked(*p) for p in zip(a, b)], pa.bool_()))

    one = texts.select(F.col("node").alias("b"), F.col("body").alias("body_b"))
    both = pairs.join(one, "b").join(texts.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")
    return in_arrow(both.select("a", "b", "body_a", "body_b"), check, "a long, b long", 128)


def components(links: DataFrame) -> DataFrame:
    """(node, part): each linked node and the smallest node that can be reached from it.

    Nodes are hung under the smallest neighbour in turns: larger neighbours under a node's
    smallest one, then smaller ones and the node itself, until all hang under nodes that hang under
    none. Each turn is two grouped minima and joins, and ends in a written table; stars need no
    turn or one, a chain as many as its length's logarithm. The first minima, a row a node, are
    written before they are joined, so that adaptive execution can split a node with very many
    links; after that a node has few smaller ones.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-low")
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "links-large")
        drop_table(low, edges)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(edges, "links")
        drop_table(large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("part")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("part")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs under one other at most, and what others hang under hangs under none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("under"), F.lit(0).alias("over")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("under"), F.lit(1).alias("over")))
    return ends.groupBy("node").agg(F.sum("under").alias("under"), F.max("over").alias("over")).where("under > 1 or under > 0 and over > 0").isEmpty()


def near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Words are what white space of ASCII leaves, A-Z in lower case. Documents are linked whose sets
    of ``n``-word shingles have a Jaccard similarity of ``similarity`` or more (in whole
    hundredths); ``component_id`` is the smallest key that links lead to. Keys are whole numbers.

    Rows with one set are one node, so copies cost a grouped minimum. Nodes are sorted in TREES
    signature orders; those that share the first BASE values of an order with another are a region
    and are compared there by their signatures. A first round confirms, on full sets of whole texts,
    few pairs that hold together what is alike, and joins what is linked; in regions of over REGION
    rows it sees neighbours of longest common prefix only, and hubs are then held against all rows.
    The last round takes the rows of each region that are still apart: regions in which more than
    WIDE rows of small parts are left are cut deeper, by DEEPER orders of BASE further values each,
    and once more if that isn't enough; then all rows are compared, those of large regions as pairs
    of blocks spread over tasks, and every pair that is alike is held against full sets until its
    ends are joined. So no link within a region is lost but for those that deeper orders part, one
    in 10,000 at a similarity of just 0.8, and a group of m costs about m pairs.

    Texts without words are linked with nothing. Rows that repeat a key are rows like others: each
    has the component of its own text. Null keys are linked with nothing and have a null component.
    Whole texts are taken, whatever their length; other columns are left out. An empty table gives
    no rows.
    """
    marks = cut(_marks(docs, n, key, text), "near-marks")
    full = marks.where("n_shingles > 0 and key is not null")
    classes = full.groupBy("print").agg(F.min(F.struct("key", "tie")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    cells = _cells(classes)
    shared = cut(cells.groupBy("cell").agg(F.count("*").alias("rows")).where("rows > 1"), "near-shared")
    met = cut(cells.join(shared.select("cell", (F.col("rows") > REGION).alias("large")), "cell"), "near-met")
    drop_table(shared)
    some = met.select("node").distinct()
    part = F.expr(f"substring(signature, {4 * BASE} + 1 + tree * {4 * DEPTH}, {4 * (DEPTH - BASE)})")

    def low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, VALUES, 4)[:, :, 0]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in raw], pa.binary())], ["node", "n_shingles", "signature", "low"])

    known = in_arrow(classes.join(some, "node", "left_semi").select("node", "n_shingles", "signature"), low_bytes, "node long, n_shingles long, signature binary, low binary", 4096)
    rows = cut(met.join(known, "node").select("cell", "node", "n_shingles", F.when(F.col("large"), part).alias("rest"), "low"), "near-rows")
    wanted = classes.join(some, "node", "left_semi").select("node", F.col("least.key").alias("k"), F.col("least.tie").alias("t"))
    bodies = docs.select(docs[key].cast("long").alias("k"), F.xxhash64(docs[text]).alias("t"), docs[text].alias("body"))
    texts = cut(bodies.join(wanted, ["k", "t"]).select("node", "body").dropDuplicates(["node"]), "near-texts")
    drop_table(met)
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = similarity - SLACK
    # Only large regions have a rest, so that no boundary falls inside another one.
    ordered = rows.repartitionByRange(ranges, "cell", "rest").sortWithinPartitions("cell", "rest", "node")
    first = cut(_candidates(ordered.select("cell", "node", "n_shingles", "low"), low), "near-pairs")
    links = cut(_confirm(first, texts, n, similarity), "near-links")
    drop_table(first)

    def parted() -> tuple[DataFrame, DataFrame, DataFrame]:
        found = components(links)
        again = cut(rows.join(found, "node", "left").select("cell", "node", "n_shingles", "low", F.coalesce("part", "node").alias("part")), "near-again")
        return found, again, _apart(again)

    parts_, again, apart = parted()
    if not apart.where("large").isEmpty():
        more = cut(_confirm(_across(_to_hubs(again, apart, links), low, "best"), texts, n, similarity), "near-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            drop_table(again, apart, parts_)
            parts_, again, apart = parted()
    drop_table(rows)
    for step in range(1, DEPTH // BASE):
        wide = apart.where(F.col("others") > WIDE).select("cell").distinct()
        if wide.isEmpty():
            break
        fine = cut(_deeper(again, wide, classes.select("node", "signature"), step), "near-deeper")
        before = again
        again = cut(again.join(wide, "cell", "left_anti").unionByName(fine), "near-again")
        drop_table(before, fine, apart)
        apart = _apart(again)
    # Texts go along only with rows that are alike to one of another part.
    dealt = cut(_dealt(again, apart), "near-dealt")
    drop_table(again, apart)
    marked = cut(_across(dealt, low, "marks").select(F.col("a").alias("cell"), F.col("b").alias("node")), "near-marked")
    late = cut(_across(dealt.join(marked, ["cell", "node"], "left_semi").join(texts, "node"), low, "links", (n, similarity)), "near-links")
    drop_table(dealt, marked, texts)
    if not late.isEmpty():
        drop_table(parts_)
        parts_ = components(links.unionByName(late))
    drop_table(links, late)
    least = classes.select("print", "node", F.col("least.key").alias("k"))
    linked = cut(parts_.join(least.select("node", "k"), "node"), "near-parts")
    component = cut(linked.groupBy("part").agg(F.min("k").alias("component")), "near-components")
    named = least.join(linked.join(component, "part").select("node", "component"), "node", "left").select("print", F.coalesce("component", "k").alias("component"))
    drop_table(parts_)
    out = marks.join(named, "print", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("key"))
    component = F.when(F.col("key").isNotNull(), component)
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, n: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` less near duplicates (see ``near_duplicates``): of each group the row with the
    smallest key stays, null keys last; of rows that are equal there, any one.

    Rows are numbered first, so keys may be null or repeat: different texts under one key stay, and
    of rows that repeat key and text one does. Texts without words all stay. All columns stay as
    they are, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    number = F.monotonically_increasing_id()
    kept = Bucketed(docs.select(number.alias("row_id"), F.bitmap_bucket_number(number).alias("chunk"), F.struct(*docs.columns).alias("row")), "chunk", int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows, body, own = kept.table, F.col("row").getField(text), F.col("row").getField(key)
    found = near_duplicates(rows.select("row_id", body.alias("text")), n, similarity, "row_id").select("row_id", "component_id")
    named = found.join(rows.select("row_id", own.alias("k")), "row_id")
    stay = named.groupBy("component_id").agg(F.min(F.struct(F.col("k").isNull().alias("last"), "k", "row_id")).alias("one")).select("one.row_id")
    # A bit for each row, in chunks of consecutive numbers: whole rows are read where they lie, and
    # only bits are shuffled to them.
    bits = cut(stay.groupBy(F.bitmap_bucket_number("row_id").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row_id")).alias("bits")), "near-stay")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(row_id) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    on = F.expr("shiftright(byte, cast(bitmap_bit_position(row_id) % 8 as int)) & 1") == 1
    out = rows.join(bits, "chunk").withColumn("byte", byte).where(on).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    kept.forget()
    return out
