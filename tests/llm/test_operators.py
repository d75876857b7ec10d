import base64
import collections
import hashlib
import math
import os
import random
import re
import struct
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from domquill.llm import decontamination, langid, line_dedup, lm, media, near_dedup, packing, quality, sharding, warc
from domquill.llm.queries import tokenizer_path


def clashing(df):
    """Extra columns with names that operators use inside or return."""
    for c in ("row", "k", "tie", "block", "size", "shard", "slot", "body", "lines", "chunks", "node", "score", "quality_score", "n_lines", "gone", "label", "words", "items", "spans", "piece", "key", "class", "place", "gone_id", "hit_key", "row_id", "found"):
        df = df.withColumn(c, F.lit("x"))
    return df


def words_of(text):
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]


# 1


def components(rows, n, percent):
    sets = []
    for i, t, *_ in rows:
        w = words_of(t)
        k = min(n, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    up = {i: i for i, *_ in rows if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][0], rows[b][0]
            if x is None or y is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = top(x), top(y)
                up[max(p, q)] = min(p, q)
    return {(i, len(s), None if i is None else top(i)) for (i, *_), s in zip(rows, sets)}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_equal_brute_force(docs, rows, n):
    got = near_dedup.near_duplicates(clashing(docs), n=n).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == components(rows, n, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_large_group_of_near_copies(spark, monkeypatch):
    r = random.Random(1)
    base = ["".join(r.choice("abcdef") for _ in range(5)) for _ in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(0 if not i else r.randint(1, 4)):
            w[r.randrange(80)] = f"x{r.random()}"
        rows.append([i, " ".join(w)])
    monkeypatch.setattr(near_dedup, "REGION", 32)  # regions larger than a block
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect()
    assert {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in got} == components(rows, 2, 80)


def star(seed, size, middle):
    """Variants alike enough (0.82) to the one in the middle, but not (0.66) to each other."""
    r = random.Random(seed)
    base = [f"w{r.random()}" for _ in range(100)]
    rows = [[middle, " ".join(base)]]
    for i in range(size):
        w = list(base)
        for j in r.sample(range(1, 98, 2), 5):
            w[j] = f"x{r.random()}"
        rows.append([i if i < middle else i + 1, " ".join(w)])
    return rows


def test_star_in_a_large_region(spark, monkeypatch):
    rows = star(2, 300, 150)
    monkeypatch.setattr(near_dedup, "REGION", 32)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(rows, 2, 80)
    assert {x[2] for x in want} == {0}
    assert {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(docs, n=2).collect()} == want
    monkeypatch.setattr(near_dedup, "HUB_LINKS", 10**6)  # blocks alone find the same
    assert {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(docs, n=2).collect()} == want


def test_regions_are_not_cut_between_partitions(spark):
    rows = star(3, 40, 20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")  # more than rows of a region
    try:
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in got} == components(rows, 2, 80)


@pytest.mark.parametrize("partitions", ["4", "211"])
def test_template_of_many_times_a_region(spark, monkeypatch, partitions):
    """Documents on one template, alike to it alone or not at all: regions are cut deeper, pairs of
    just over 0.8 within them are found."""
    r = random.Random(8)
    base = [f"w{r.random()}" for _ in range(100)]
    rows = []
    for i in range(700):
        w = list(base)
        for j in r.sample(range(100), 22):
            w[j] = f"x{r.random()}"
        rows.append([2 * i, " ".join(w)])
        if i % 3 == 0:  # a partner with two or three words more changed
            for j in r.sample(range(100), 5):
                w[j] = f"x{r.random()}"
            rows.append([2 * i + 1, " ".join(w)])
    monkeypatch.setattr(near_dedup, "REGION", 16)
    monkeypatch.setattr(near_dedup, "WIDE", 32)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = components(rows, 2, 80)
    assert sum(c != i for i, _, c in want) > 50
    assert {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in got} == want


def test_rows_that_repeat_a_key(spark):
    r = random.Random(10)
    a, b = (" ".join(str(r.random()) for _ in range(40)) for _ in range(2))
    rows = [(7, a), (7, b), (7, b), (3, b), (9, a), (None, a), (5, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted(((x["doc_id"], x["component_id"]) for x in got), key=str) == sorted([(7, 7), (7, 3), (7, 3), (3, 3), (9, 7), (None, None), (5, 5), (5, 5)], key=str)
    left = near_dedup.one_of_each(clashing(docs))
    assert left.columns == clashing(docs).columns
    assert sorted((x["doc_id"], x["text"]) for x in left.where("text is not null").collect()) == sorted([(7, a), (3, b)])
    assert left.where("text is null").count() == 2


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r["node"]: r["part"] for r in near_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# 2


def hits(texts, items, n):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    grams = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            grams[tuple(w[j : j + k])].add(i)
    out = []
    for i, t, *_ in texts:
        w, mark, ids = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in grams:
                    mark |= set(range(j, j + k))
                    ids |= grams[tuple(w[j : j + k])]
        out.append((i, len(w), len(mark), tuple(sorted(x for x in ids if x is not None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [1, 3])
def test_contamination_equals_brute_force(spark, docs, rows, blocks):
    items = [(1, " ".join(rows[7][1].split()[3:30]).upper()), (2, "one"), (3, None), (4, ""), (None, rows[9][1][:200]), (5, " ".join(rows[7][1].split()[10:22])), (5, "naïve, endoftext!")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(clashing(docs), table, blocks=blocks).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["items"]))) for r in got), key=str)
    want = hits(rows, items, 10)
    assert got == want  # rows that repeat, and those without a key, too
    kept = decontamination.decontaminate(clashing(docs), table, blocks=blocks)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted((i or -1) for i, _, n, _ in want if not n)
    cut = decontamination.decontaminate(docs, table, remove="spans", blocks=blocks).where("doc_id = 7").first()["text"]
    assert cut.split() == rows[7][1].split()[:3]


@pytest.mark.parametrize("blocks", [1, 3])
def test_contamination_of_rows_with_one_key(spark, blocks):
    """Different texts under one key, and rows without one, each get their own spans."""
    passage = " ".join(f"p{i}" for i in range(12))
    texts = [(1, f"a b {passage}"), (1, "short"), (1, f"{passage} c"), (None, f"d {passage}"), (None, "e"), (None, None)]
    docs = clashing(spark.createDataFrame(texts, "doc_id long, text string"))
    items = spark.createDataFrame([(1, passage), (2, passage + " more"), (3, None)], "item_id long, text string")
    got = decontamination.find_contamination(docs, items, blocks=blocks).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == [(0, 0, 0, ()), (0, 1, 0, ()), (0, 13, 12, (1, 2)), (1, 1, 0, ()), (1, 13, 12, (1, 2)), (1, 14, 12, (1, 2))]
    cut = decontamination.decontaminate(docs, items, remove="spans", blocks=blocks)
    assert cut.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "").strip()) for r in cut.collect()) == [(0, ""), (0, "d"), (0, "e"), (1, "a b"), (1, "c"), (1, "short")]
    left = decontamination.decontaminate(docs, items, blocks=blocks).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == [(0, ""), (0, "e"), (1, "short")]


def test_no_items(spark, docs, rows):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(docs, empty).where("n_hit > 0").count() == 0
    assert decontamination.decontaminate(docs, empty).count() == len(rows)


# 3


def test_lm_scores(spark, docs, rows, none):
    got = lm.score(clashing(docs)).collect()
    assert len(got) == len(rows) and lm.score(none).count() == 0
    count, tokens = collections.Counter(), []
    for i, t, *_ in rows:
        w = words_of(t) + [None]
        tokens.append((i, w))
        if i is None or zlib.crc32(str(i).encode()) % 10:
            count.update(w)
    n, v = sum(count.values()), len(count)
    base = sorted((str(i), len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, w in tokens)
    assert base == sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got)
    assert all(r["train_tokens"] == n for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) and all(r["score"] <= 0 for r in got)


def plain_tree(texts, folds, depth):
    """The tree's probability of a word after a list of words, from plain counts of whole n-grams."""
    tokens = {i: words_of(t) + [None] for i, t in texts}
    learn = [[None, *w] for i, w in tokens.items() if zlib.crc32(str(i).encode()) % folds]
    raw = collections.Counter(tuple(w[j : j + k]) for w in learn for k in range(1, depth + 2) for j in range(len(w) - k + 1))
    one = collections.Counter(x for w in learn for x in w[1:])
    n, v = sum(one.values()), len(one)

    def count(gram):  # of a context and a symbol, where the context and the shorter form are frequent
        if len(gram) == 1:
            return one[gram[0]]
        if None in gram[1:-1] or of_context(gram[:-1]) < lm.CONTEXT or count(gram[1:]) < lm.SYMBOL:
            return 0
        return raw[gram]

    def of_context(context):
        return one[context[0]] if len(context) == 1 else 0 if None in context[1:] else count(context)

    following = collections.defaultdict(set)
    for g in raw:
        if len(g) > 1:
            following[g[:-1]].add(g[-1])
    kept = {}

    def share(context):
        if context not in kept:
            total = of_context(context)
            own = {w: count((*context, w)) for w in following[context]} if total >= lm.CONTEXT else {}
            own = {w: c for w, c in own.items() if c >= lm.SYMBOL}
            gain = sum(c * math.log(c / total / p(context[1:], w)) for w, c in own.items())
            rest = total - sum(own.values())
            if rest > 0 and own:
                gain += rest * math.log(rest / total / max(1 - sum(p(context[1:], w) for w in own), 1e-12))
            good = own and gain > (len(own) + 1) / 2 * math.log(total)
            kept[context] = (1 - (sum(own.values()) - lm.DISCOUNT * len(own)) / total, own, total) if good else None
        return kept[context]

    def p(context, word):
        if not context:
            return (one[word] + 0.1) / (n + 0.1 * (v + 1))
        found = share(context)
        if found is None:
            return p(context[1:], word)
        left, own, total = found
        return (own[word] - lm.DISCOUNT if word in own else 0) / total + left * p(context[1:], word)

    def after(words, word):
        context = tuple([None, *words][-depth:])
        while context and None in context[1:]:
            context = context[1:]
        return p(context, word)

    return tokens, after, kept


def sampled_texts(seed):
    r = random.Random(seed)
    line = lambda: " ".join(w for _ in range(60) for w in (["a", "b", "c", "d"] if r.random() < 0.5 else [r.choice("abcdef")]))
    return [(i, line() if i % 7 else f"b c {line()} b c") for i in range(1, 60)] + [(100, None), (101, ""), (102, "new words here")]


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_lm_scores_equal_a_plain_tree(spark, monkeypatch, depth):
    monkeypatch.setattr(lm, "BLOCK", 700)  # many blocks
    texts = sampled_texts(2)
    tokens, after, kept = plain_tree(texts, 10, depth)
    want = {i: sum(math.log10(after(w[:j], w[j])) for j in range(len(w))) for i, w in tokens.items()}
    assert depth == 1 or sum(len(c) > 1 and x is not None for c, x in kept.items()) > 3
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), depth=depth).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-5), i


def test_lm_is_a_distribution(spark):
    """After any context the probabilities of all known words, the end and an unknown word add up
    to 1: as scores of texts say, where P(text + word + end) / P(text + word, then anything)."""
    texts = sampled_texts(3)
    tokens, after, _ = plain_tree(texts, 10, 3)
    known = {w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws}
    for context in ([], [b"a"], [b"a", b"b"], [b"a", b"b", b"c"], [b"f", b"unknown"], [b"b", b"c", b"b"]):
        assert sum(after(context, w) for w in known | {b"unknown to all"}) == pytest.approx(1, rel=1e-9)
    # the operator's own: the next word's share is the quotient of two texts' scores, end tokens apart
    ids = [i for i in range(1000, 20000) if zlib.crc32(str(i).encode()) % 10 == 0]
    probes = [(ids[k], " ".join(["a", "b", w])) for k, w in enumerate(sorted(x.decode() for x in known if x) + ["unknown"])] + [(ids[-1], "a b")]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(texts + probes, "doc_id long, text string"), depth=3).collect()}
    prefix = math.prod(after([b"a", b"b"][:j], w) for j, w in enumerate([b"a", b"b"]))
    total = 10 ** got[ids[-1]] / prefix  # the end
    for i, t in probes[:-1]:
        total += 10 ** got[i] / prefix / after(words_of(t), None)
    assert total == pytest.approx(1, rel=1e-5)


def test_lm_memory_of_a_block():
    """Some tens of bytes a token, of two levels, at any step."""
    n = 2_000_000
    r = np.random.default_rng(5)
    words = np.unique(np.append(r.integers(0, 1 << lm.WORD_BITS, 50_000, np.uint64), lm.END))
    tokens = np.minimum(r.geometric(1 / 200, n), len(words) - 1).astype(np.int32)
    docs = pd.DataFrame({"id": range(1000), "held_out": [k % 10 == 0 for k in range(1000)], "n_tokens": [n // 1000] * 1000})
    told = {lm.counts_of(0): np.bincount(tokens, minlength=len(words)) * 2 + 1}
    first = lm.Block("b", docs, tokens, words, told)
    first.levels(1)
    bodies = [lm._unpack(m[4], np.uint32) for m in first.counts(1, 4)]
    told[lm.counts_of(1)] = np.concatenate(bodies).astype(np.int64) * 2 + 1
    del first, bodies
    tracemalloc.start()
    block = lm.Block("b", docs, tokens, words, told)
    block.levels(2)
    assert block.counts(2, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 * n, peak / n


def test_lm_blocks_are_bounded_in_tokens(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 4000)
    texts = [(i, "a b\tc\nd " * 25) for i in range(100)] + [(i, None) for i in range(100, 3000)]
    made = lm._blocks(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), "doc_id", "text", 10).select("n_tokens").collect()
    assert sum(r["n_tokens"] for r in made) == 100 * 101 + 2900 and max(r["n_tokens"] for r in made) <= 1000 + 101


# 4


@pytest.mark.parametrize("codec", [media.RAW, media.LZW, media.DEFLATE, media.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tiled", [False, True])
def test_tiff_round_trip(codec, predictor, tiled):
    images = [np.frombuffer(os.urandom(w * h), np.uint8).reshape(h, w) for w, h in ((576, 130), (5, 7), (64, 64))] + [np.full((200, 33), 7, np.uint8)]
    pages = list(media.read_pages(media.write_tiff([(i, codec, predictor, tiled) for i in images])))
    assert [(p.page, p.tiled, p.predictor) for p in pages] == [(k, tiled, predictor) for k in range(4)]
    assert all((p.pixels[:, :, 0] == i).all() for p, i in zip(pages, images))


def test_codecs():
    r = random.Random(3)
    for n in (0, 1, 127, 128, 129, 5000, 40_000):
        for d in (r.randbytes(n), b"x" * n, bytes(r.choice(b"aab") for _ in range(n))):
            assert media.unpack_bits(media.pack_bits(d), n) == d and media.lzw_decode(media.lzw_encode(d), n) == d


def test_tiff_column(spark, docs, rows, none):
    files = media.tiff_column(clashing(docs))
    got = {(r["doc_id"], r["payload_sha256"]): r for r in media.tiff_features(files, "doc_id").collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        pad = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[i, hashlib.sha256(pad).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(pad), zlib.crc32(pad[-32:]))
    pages = media.tiff_pages(files.where("doc_id = 85"), "doc_id").collect()
    assert b"".join(bytes(p["pixels"]) for p in pages).rstrip(b"\xff") == rows[85][1].encode()
    bad = spark.createDataFrame([(1, bytearray(b"no")), (2, None), (3, bytearray(media.write_tiff([(np.zeros((3, 3), np.uint8), 8, 1, False)])[:40]))], "k int, media binary")
    assert all(r["error"] for r in media.tiff_pages(bad, "k").collect())
    told = media.tiff_features(bad.withColumn("n_bytes", F.lit(1)), "k").collect()
    assert len(told) == 3 and all(r["error"] and r["payload_sha256"] is None for r in told)
    assert media.tiff_column(none).count() == media.tiff_features(media.tiff_column(none), "doc_id").count() == 0


def tiff_of(fields, data=b"", end="<"):
    """A file of one directory with the given (tag, kind, count, value or place) and data behind."""
    out = (b"II*\0" if end == "<" else b"MM\0*") + struct.pack(f"{end}IH", 8, len(fields))
    for f in fields:
        out += struct.pack(f"{end}HHII", *f)
    return out + struct.pack(f"{end}I", 0) + data


def test_tiff_files_that_are_odd(spark):
    at = 8 + 2 + 12 * 7 + 4
    samples = np.arange(6, dtype="<u2") * 9000
    wide = tiff_of([(256, 4, 1, 3), (257, 4, 1, 2), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, at), (278, 4, 1, 2), (279, 4, 1, 12)], samples.tobytes())
    page = next(media.read_pages(wide))
    assert page.bits == 16 and page.pixels.reshape(-1).tolist() == samples.tolist()
    no_value = tiff_of([(256, 4, 0, 3), (257, 4, 1, 2)])
    huge = tiff_of([(256, 4, 1, 4_000_000_000), (257, 4, 1, 4_000_000_000), (258, 3, 1, 8), (259, 3, 1, 1), (273, 4, 1, at), (278, 4, 1, 4_000_000_000), (279, 4, 1, 12)], b"x" * 12)
    flat = tiff_of([(256, 4, 1, 0), (257, 4, 1, 2), (258, 3, 1, 8), (259, 3, 1, 1), (273, 4, 1, at), (278, 4, 1, 2), (279, 4, 1, 12)], b"x" * 12)
    for blob in (no_value, huge, flat):
        with pytest.raises(media.TiffError):
            list(media.read_pages(blob))
    df = spark.createDataFrame([(1, bytearray(wide), 12), (2, bytearray(no_value), 0), (3, bytearray(huge), 0), (4, None, None)], "k int, media binary, n_bytes long")
    told = {r["k"]: r for r in media.tiff_features(df, "k").collect()}
    assert told[1]["payload_sha256"] == hashlib.sha256(samples.tobytes()).hexdigest() and told[1]["error"] is None
    assert all(told[k]["error"] and told[k]["payload_bytes"] is None for k in (2, 3, 4))
    assert [r["error"] is None for r in media.tiff_pages(df, "k").orderBy("k").collect()] == [True, False, False, False]


def test_every_codec_is_written():
    found = {next(media.read_pages(media.encode_payload(bytes([k]) * 576))).compression for k in range(64)}
    assert found == {media.LZW, media.PACKBITS, media.DEFLATE}


# 5


def test_packing(spark, docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(clashing(docs), tokenizer_path(), with_ids=True).collect()
    own = [(i, tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for i, x, *_ in rows]
    by_doc, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        p = tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())
        assert len(p) == r["length"] <= 1024 and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], p))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    for i, parts in by_doc.items():  # each document's own ids, cut as agreed
        want = []
        for _, ids in (x for x in own if x[0] == i):
            first = (len(ids) - 1) % 1024 + 1
            cuts = [0, *range(first, len(ids) + 1, 1024)]
            want += [(k, a, ids[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
        assert sorted(parts) == sorted(want)
    assert by_doc.keys() == {i for i, *_ in rows} and packing.pack(none, tokenizer_path()).count() == 0
    rooms = plain_bins([r["length"] for r in got], 1024)
    assert sorted(1024 - sum(n for _, n in b) for b in bins.values()) == rooms


def plain_bins(lengths, capacity):
    """Rooms left, item by item: large ones matched by falling length, small ones best-fit."""
    large, rooms = sorted((n for n in lengths if 3 * n > capacity), reverse=True), []
    while large:
        n = large.pop(0)
        mate = next((k for k, m in enumerate(large) if n + m <= capacity), None)
        rooms.append(capacity - n - (0 if mate is None else large.pop(mate)))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_plain_matching(seed):
    r = random.Random(seed)
    lengths = [r.choice([r.randint(1, 60), r.randint(1, 200), r.choice([33, 34, 50, 67, 100])]) for _ in range(r.randint(0, 500))]
    lengths = [min(n, 200) for n in lengths]
    plan = packing.plan_bins(collections.Counter(lengths), 200)
    assert sorted(200 - sum(n * k for n, k in items.items()) for many, items in plan for _ in range(many)) == plain_bins(lengths, 200)


def test_bins_are_few():
    r = random.Random(4)
    for _ in range(20):
        counts = collections.Counter(r.choice([r.randint(1, 100), r.randint(1, 1024), 512, 341, 342]) for _ in range(r.randint(1, 3000)))
        plan = packing.plan_bins(counts, 1024)
        made = collections.Counter()
        for many, items in plan:
            assert many > 0 and sum(n * k for n, k in items.items()) <= 1024
            assert sum(k for n, k in items.items() if 3 * n > 1024) <= 2
            for n, k in items.items():
                made[n] += many * k
        assert made == counts
        large = sum(c for n, c in counts.items() if 2 * n > 1024)
        assert sum(m for m, _ in plan) <= max(large, sum(n * c for n, c in counts.items()) / 1024) * 1.25 + 2


def test_packing_plan_starts_no_workers(spark, docs):
    plan = packing.pack(docs, tokenizer_path())._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan


# 6


def test_language(spark):
    train = spark.createDataFrame([(i, "the cat of the house and then" if i % 2 else "der hund und die katze nicht", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.fit_text(train)
    pages = [(i, "http://a.example.de/x", '<html lang="de"><p>der hund und die nacht') for i in range(20)] + [(i, "http://b.example.com/", '<html lang="en"><p>the house') for i in range(20, 40)]
    pages += [(100, "http://a.example.de/y", "<html>"), (101, None, None), (102, "", "<html lang=en>the cat"), (103, "http://b.example.com/q", "<html lang='en'><script>der der der</script>the")]
    df = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r["page_id"]: r for r in langid.identify(df, model).collect()}
    assert len(got) == len(pages)
    assert all(got[i]["lang"] == "de" for i in range(20)) and all(got[i]["lang"] == "en" for i in range(20, 40))
    assert got[100]["lang"] == "de" and got[102]["lang"] == got[103]["lang"] == "en"
    assert langid.identify(df.where("false"), model).count() == 0
    unknown = langid.identify(df, langid.fit_text(train.where("false"))).collect()
    assert len(unknown) == len(pages) and all(r["lang"] is None and r["confidence"] is None for r in unknown)
    assert {r["page_id"]: r["host"] for r in unknown}[100] == "a.example.de"
    odd = clashing(train.withColumn("label", F.lit("x"))).unionByName(clashing(spark.createDataFrame([(None, None, "en"), (3, "der", None), (5, "der", "de")], "doc_id long, text string, lang string")))
    assert langid.fit_text(odd).languages == ["de", "en"]


def test_visible_text():
    assert langid.visible_text("<p>a<script>x<b>y</script >b<!-- c --><STYLE>d</style>e &lt; f") == " a b  e < f"
    assert langid.visible_text("a<script>b") == "a b" and langid.visible_text("a<!--b") == "a b" and langid.visible_text(None) == ""
    assert langid.visible_text("1 < 2<br>") == "1 < 2 "
    assert len(langid.visible_text("<script <style <!-- " * 200_000)) > 0  # in linear time


def test_language_equals_a_plain_fusion(spark):
    r = random.Random(13)
    words = {"en": "the cat of house and then water".split(), "de": "der hund und die katze nicht wasser".split(), "fr": "le chat de la maison et alors".split()}
    say = lambda x, n: " ".join(r.choice(words[x]) for _ in range(n))
    train = spark.createDataFrame([(i, say(x, 30), x) for i, x in enumerate(["en", "de", "fr"] * 10)], "doc_id long, text string, lang string")
    model = langid.fit_text(train)
    pages = []
    for i in range(90):
        x = r.choice(["en", "de", "fr"])
        host = r.choice(["a.one.com", "b.one.com", "c.two.de", "d.three.fr"])
        pages.append((i, f"http://{host}/{i}", f"<html{r.choice(['', f' lang={x}'])}><p>{say(x, r.choice([0, 1, 2, 5]))}"))
    got = {x["page_id"]: x for x in langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    n, trust = 3, 20.0
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    facts = []
    for i, url, page in pages:
        host = url.split("/")[2]
        declared = re.search("lang=(..)", page)
        logs = model.log_likelihoods(langid.visible_text(page))
        facts.append((i, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], declared[1] if declared else "", logs, soft(logs)))
    total = sum(f[6] for f in facts)
    by = lambda k, v: sum(f[6] for f in facts if f[k] == v)
    for i, host, domain, suffix, declared, logs, own in facts:
        prior = (total + 1) / (total.sum() + n)
        for k, v in ((2, domain), (1, host)):
            rest = np.maximum(by(k, v) - own, 0)
            prior = (rest + trust * prior) / (rest.sum() + trust)
        post = soft(logs + np.log((by(4, declared) + 0.5) / (total + n)) + np.log((by(3, suffix) + 0.5) / (total + n)) + np.log(prior))
        assert got[i]["lang"] == model.languages[int(post.argmax())] and got[i]["confidence"] == pytest.approx(post.max(), rel=1e-6)


# 7


def test_shards(spark, docs, rows, none):
    got = sharding.shard_by_bytes(clashing(docs), 4).collect()
    assert len(got) == len(rows) and sharding.shard_by_bytes(none, 4).count() == 0
    total = sum(r["size"] for r in got)
    small = sharding.shard_by_bytes(docs.where("doc_id <> 85"), 4).collect()
    sizes = collections.Counter()
    for r in small:
        sizes[r["shard"]] += r["size"]
    most = max(r["size"] for r in small)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * most and total > sum(sizes.values())
    order = [(r["shard"], r["slot"]) for r in sorted(small, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["shard"], r["slot"]))]
    assert order == sorted(order)
    for s in range(4):
        assert sorted(r["slot"] for r in small if r["shard"] == s) == list(range(sum(r["shard"] == s for r in small)))


def test_shards_equal_plain_prefix_sums(spark, docs, rows):
    """Every row's place from one running sum over rows in order of key and text hash."""
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(((i is not None, i or 0, hashes[i, t], i, len((t or "").encode()) + 1) for i, t, *_ in rows))
    total, at, want, slots = sum(x[-1] for x in order), 0, collections.Counter(), collections.Counter()
    for _, _, _, i, size in order:
        shard = min(int((at + size / 2) * 5 // total), 4)
        want[i, size, shard, slots[shard]] += 1
        slots[shard] += 1
        at += size
    got = collections.Counter((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in sharding.shard_by_bytes(docs, 5).collect())
    assert got == want


# 8


def test_quality(spark, none):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["the", "house", "stands", "by", "water", "and", "trees", "grow"]) + r.choice(["", "s", "ing"]) for _ in range(60))
    bad = lambda: " ".join(r.choice(["BUY!!", "CLICK!!", "###", "$$$"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame([x[:2] for x in rows] + [(900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows[:150]] + [(1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {x["doc_id"]: x["quality_score"] for x in quality.score(clashing(docs), model).collect()}
    assert len(got) == 303 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.5) == bool(q) for i, _, q in rows[150:])
    assert quality.score(docs, model, keep_from=0.3).count() < 303
    assert quality.score(none, quality.fit(none, labels)).count() == 0
    assert quality.fit(none, labels).bias == 0 and quality.fit(docs, labels.where("quality = 1")).bias == 30
    again = quality.fit(clashing(docs).unionByName(clashing(docs.where("doc_id < 9"))), clashing(labels.select("doc_id", "quality")))
    assert (again.gain == model.gain).all()  # extra columns, and rows that repeat, change nothing
    kept = quality.score(clashing(docs), model, keep_from=0.3)
    assert kept.columns == clashing(docs).columns and set(r["quality_score"] for r in kept.collect()) == {"x"}


def test_scores_equal_a_plain_sum(spark):
    """A score is the softmax of the mean gain of a text's words, word pairs and byte n-grams."""
    model = quality.Model(10, np.random.default_rng(1).normal(size=1 << 10).astype(np.float32), 0.3)
    texts = ["ab cd ab cd  ab", "", None, "x", "naïve text \n of lines " * 40]
    got = [r["quality_score"] for r in quality.score(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), model).collect()]
    for t, s in zip(texts, got):
        buckets = np.concatenate([b for _, b in quality.hashed_features([(t or "").encode()], 10)] or [np.zeros(0, int)])
        mean = model.gain[buckets].astype(float).sum() / max(len(buckets), 1)
        assert s == pytest.approx(1 / (1 + math.exp(-(mean + 0.3))), rel=1e-9)


def test_memory_of_hashing():
    """Texts are hashed in parts: what a worker holds doesn't follow the rows it takes at once."""
    r = random.Random(9)
    texts = [" ".join(str(r.randrange(10**6)) for _ in range(480)).encode() for _ in range(512)]
    model = quality.Model(15, np.random.default_rng(1).normal(size=1 << 15).astype(np.float32), 0.3)
    for work in (lambda: model.scores(texts), lambda: collections.deque(near_dedup.shingle_sets(texts, 5), 0)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 30e6, peak
    assert (model.scores(texts) == np.concatenate([model.scores([t]) for t in texts])).all()


# 9


def test_line_dedup(spark, docs, rows, none):
    got = line_dedup.dedup_lines(clashing(docs)).collect()
    assert len(got) == len(rows) and line_dedup.dedup_lines(none).count() == 0
    text = {r["doc_id"]: r for r in got}
    passage = rows[0][1].split("\n")[-2]
    assert passage in text[0]["text"] and not any(passage in (text[i]["text"] or "") for i in range(6, 60, 6))
    for i in range(6, 60, 6):  # nothing but the passage goes
        assert text[i]["n_removed"] == 1 and text[i]["text"] == rows[i][1].replace(passage + "\n", "")
    assert all(text[i]["text"] == rows[i][1] for i in range(60) if i % 6 and i not in (1, 3, 5))
    assert text[None]["text"] == rows[5][1] and text[5]["n_removed"] > 0  # null keys come first
    assert text[80]["text"] is None and text[81]["text"] == "" and text[80]["n_removed"] == 0
    left = line_dedup.dedup_lines(docs, drop_emptied=True)
    assert left.where("doc_id between 75 and 79").count() <= 5 and left.where("doc_id = 80 or doc_id = 81").count() == 2


def plain_lines(rows):
    """(key, text left, lines removed) by the rule: rows (key, hash of text, text), each one once."""
    blanks, seen, own = " \t\x0b\x0c\r", {}, {}
    for k, tie, t in rows:
        lines = (t or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(blanks)]
        figures = [(len(lines[i].encode()), len(re.split(r"[ \t\x0b\x0c\r]+", lines[i].strip(blanks)))) for i in full]
        windows = set()
        for i in range(len(full)):
            for step, stop in ((1, len(full)), (-1, -1)):
                size = words = 0
                for j in range(i, stop, step):
                    size, words = size + figures[j][0], words + figures[j][1]
                    if size >= 180 or words >= 30:
                        windows.add((min(i, j), abs(i - j) + 1))
                        break
        own[k, tie] = (lines, full, windows)
        for at, n in windows:
            text = "\n".join(lines[i] for i in full[at : at + n])
            place = (k is not None, k or 0, tie, at)
            seen[text] = min(seen.get(text, place), place)
    out = {}
    for (k, tie), (lines, full, windows) in own.items():
        gone = set()
        for at, n in windows:
            place = seen["\n".join(lines[i] for i in full[at : at + n])]
            if place != (k is not None, k or 0, tie, at):
                start = max(at, place[3] + n) if place[:3] == (k is not None, k or 0, tie) else at
                gone |= set(range(start, at + n))
        dropped = {full[j] for j in gone} | {i for j in gone if j + 1 in gone for i in range(full[j], full[j + 1])}
        out[k, tie] = ("\n".join(x for i, x in enumerate(lines) if i not in dropped), len(dropped))
    return out


def test_line_dedup_equals_plain_rule(spark, rows):
    r = random.Random(14)
    pool = [" ".join(r.choice("abcdefgh") * r.randint(1, 12) for _ in range(r.randint(1, 20))) for _ in range(25)] + ["", " ", "x\ty"]
    made = [(i, "\n".join(r.choice(pool) if r.random() < 0.7 else f"own {i} {r.random()}" for _ in range(r.randint(1, 30)))) for i in range(80)]
    made += [(i, t) for i, t, *_ in rows] + [made[3], (made[3][0], made[4][1]), (None, made[5][1])]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = line_dedup.dedup_lines(docs.withColumn("tie", F.xxhash64("text"))).collect()
    want = plain_lines({(i, h): (i, h, t) for i, h, t in docs.select("doc_id", F.xxhash64("text"), "text").collect()}.values())
    assert len(got) == len(made) and sum(n for _, n in want.values()) > 200
    for x in got:
        text, n = want[x["doc_id"], x["tie"]]
        assert ((x["text"] or ""), x["n_removed"]) == (text, n)


def test_line_dedup_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    want = line_dedup.dedup_lines(docs).collect()
    monkeypatch.setattr("domquill.llm.common.BROADCAST_NUMBERS", -1)
    assert sorted(line_dedup.dedup_lines(docs).collect(), key=str) == sorted(want, key=str)


def test_line_dedup_shifts(spark):
    """A passage of many lines is found wherever it stands; hash twins with other bytes would stay."""
    r = random.Random(9)
    line = lambda: " ".join(str(r.random()) for _ in range(4))
    shared = [line() for _ in range(40)]
    rows = [(i, "\n".join([line() for _ in range(i + 1)] + shared + [line() for _ in range(3)])) for i in range(5)]
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_removed"] == 0
    assert all(30 <= got[i]["n_removed"] <= 40 and set(rows[i][1].split("\n")[: i + 1]) <= set(got[i]["text"].split("\n")) for i in range(1, 5))


def passages(r, between="\n"):
    """Passages of 3 to 8 wrapped lines, each in two documents between other lines; what they are."""
    line = lambda: "".join(r.choice("abcdefghij   ") for _ in range(84)).strip() + "."
    shared = {n: [line() for _ in range(n)] for n in range(3, 9)}
    rows = [(10 * n + d, "\n".join([line() for _ in range(d + 1)] + [between.join(shared[n])] + [line(), line()])) for n in shared for d in range(4)]
    return shared, rows


def test_line_dedup_of_wrapped_lines(spark):
    shared, rows = passages(random.Random(11))
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        passage = "\n".join(shared[i // 10]) + "\n"
        assert got[i]["text"] == (t.replace(passage, "") if i % 10 else t) and got[i]["n_removed"] == (i // 10 if i % 10 else 0)


def test_line_dedup_of_paragraphs(spark):
    """Blank lines within a passage don't cut it, and go with it."""
    shared, rows = passages(random.Random(12), "\n\n")
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i]["text"] == (t.replace("\n\n".join(shared[i // 10]) + "\n", "") if i % 10 else t)


def test_line_dedup_of_short_words(spark):
    """Over 50 words, under 180 bytes."""
    passage = "\n".join(" ".join(str((7 * i + j) % 10) for j in range(18)) for i in range(3))
    rows = [(i, f"first {i}\n{passage}\nlast {i}") for i in range(3)]
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(passage) < 180 and got == {0: rows[0][1], 1: "first 1\nlast 1", 2: "first 2\nlast 2"}


# 10


def test_warc(spark, tmp_path):
    pages = [(1, "http://a", "x"), (2, "http://b\r\nEvil: 1", "x"), (3, None, None), (4, "u", ""), (5, "ü", "ß" * 1000), (5, "ü", "ß" * 1000), (None, "n", "x"), (6, "v", "WARC-Refers-To: no"), (7, "http://c/?q=WARC-Refers-To: <urn:page:1>", "seven"), (8, None, "seven too")]
    df = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))
    path = warc.write_archive(df, f"file://{tmp_path}/a")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.record_summary(spark, path).collect()), key=str)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        top = max((k for k, _, x in pages if (x or "") == (h or "") and k is not None))
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in pages})
    records = {r["record_id"]: bytes(r["record"]) for r in warc.read_records(spark, path).collect()}
    assert records[2].endswith(b"\r\n\r\nx\r\n\r\n") and b"WARC-Type: response" in records[2] and b"\nEvil" not in records[2]
    assert b"Content-Length: 0\r\n\r\n\r\n\r\n" in records[1]
    assert warc.record_summary(spark, warc.write_archive(df.where("false"), f"file://{tmp_path}/b")).count() == 0
