"""The registered queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, langid, line_dedup, lm, media, near_dedup, packing, quality, sharding, warc
from .common import read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, group and whether it stays, by two-word shingles at 0.8."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), n=2, similarity=0.8)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, words hit by windows of ten words of benchmark items, and the items."""
    found = decontamination.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(listed, "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under the suffix tree of all texts but a tenth, and the unigram score."""
    return lm.score(read(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a TIFF file, and what is read back from it."""
    return media.tiff_features(media.tiff_column(read(spark, sf_dir, "documents")), "doc_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's language by text, markup, suffix and host; learnt from the documents' labels."""
    return langid.identify(read(spark, sf_dir, "pages"), langid.fit_text(read(spark, sf_dir, "documents")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in eight shards of near equal bytes, contiguous by key."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    out = sharding.shard_by_bytes(docs, n_shards=8, columns=["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def held_out(parts: int):
    """The contracts' test rows: those whose key's CRC-32, as text, leaves 0."""
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(parts)) == 0


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from the labels of all keys but a fifth."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels").where(~held_out(5))))
    return scored.select("doc_id", F.coalesce(held_out(5), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text less repeated passages, its number of lines and of removed ones."""
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as the archives, read back, have it."""
    return warc.record_summary(spark, warc.write_archive(read(spark, sf_dir, "pages")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_lm": op3_lm,
    "op4_media": op4_media,
    "op5_packing": op5_packing,
    "op6_language": op6_language,
    "op7_sharding": op7_sharding,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_warc": op10_warc,
}

#: Base 32 of 40 hex digits: four numbers of 40 bits, eight digits of 5 bits each.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {10 * k + 1}, 10))::bigint >> {5 * i}) & 31)::int + 1, 1)" for k in range(4) for i in range(7, -1, -1))

ORACLES: dict[str, str] = {
    "op1_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + least(2, len(words)) - 1], ' ') AS gram
  FROM w, unnest(range(1, len(words) - least(2, len(words)) + 2)) AS t(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE least(na.n, nb.n) * 100 >= 80 * greatest(na.n, nb.n)
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))),
ends AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN ends b ON b.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = d.doc_id""",
    "op2_decontamination": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (
  SELECT item_id, least(10, len(words)) AS n, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS gram
  FROM b, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS t(i) WHERE len(words) > 0),
dw AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS gram
  FROM w, (SELECT DISTINCT n FROM bw) AS lengths, unnest(range(1, len(words) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
marked AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(n)) AS t(k) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(item_id::varchar, ',' ORDER BY item_id::varchar) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN marked USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op10_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::bigint AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d""",
}
