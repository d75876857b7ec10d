"""Language identification of web pages: text, markup, address and host evidence, fused."""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow

BITS = 15
_OPEN = re.compile(r"<(?:!--|(script|style)\b|[^<>]*>)", re.I)
_TAG = re.compile(r"<[^<>]*>")
_SHUT = {None: re.compile("-->"), "script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}


def visible_text(page: str | None) -> str:
    """A page's text without tags, comments, scripts and styles, a blank for each. What is opened
    and never shut hides its tag alone. Each kind is looked for to the end of the page once at
    most, so the work is linear in a page's length."""
    page, out, at, never = page or "", [], 0, set()
    while m := _OPEN.search(page, at):
        out += page[at : m.start()], " "
        name = (m[1] or "").lower() or None
        at = m.end()
        if m[0] == "<!--" or name:
            shut = None if name in never else _SHUT[name].search(page, m.end())
            if shut:
                at = shut.end()
            else:
                never.add(name)
                tag = _TAG.match(page, m.start())
                at = tag.end() if tag else at
    return markup.unescape("".join([*out, page[at:]]))


def _trigrams(text: str) -> np.ndarray:
    """Hashed buckets of every three bytes in a row, letters in lower case, one blank for many."""
    raw = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    h = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    log_share: np.ndarray  # languages by buckets

    def log_likelihoods(self, text: str) -> np.ndarray:
        """Of each language, a third of the trigrams' sum: three of them share each byte."""
        ids, counts = np.unique(_trigrams(text), return_counts=True)
        return self.log_share[:, ids] @ counts / 3 if len(ids) else np.zeros(len(self.languages))


def fit_text(docs: DataFrame, max_rows: int = 4000, key: str = "doc_id", text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> TextModel:
    """Trigram shares by language from at most ``max_rows`` labelled texts, whole, those first in
    order of the hash of key and language. Rows without a language are left out, null texts are
    empty, null keys are keys like others; of rows that repeat key and language the smallest text
    counts. Without labelled rows the model has no languages. Each task adds its texts up, so the
    driver gets a row of buckets for each of 32 tasks and language. Other columns aren't read,
    whatever their names."""
    own = docs.select(F.xxhash64(docs[key], docs[lang]).alias("place"), docs[lang].alias("label"), docs[text].alias("body")).where("label is not null")
    chosen = own.select(F.col("place").alias("chosen")).orderBy("chosen").limit(max_rows).distinct()
    sample = own.join(F.broadcast(chosen), F.col("place") == F.col("chosen")).groupBy("place").agg(F.min(F.struct("label", "body")).alias("row")).select("row.*")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows in batches:
            for label, body in zip(rows.column(0).to_pylist(), rows.column(1)):
                sums.setdefault(label, np.zeros(1 << BITS)).__iadd__(np.bincount(_trigrams(body.as_py() or ""), minlength=1 << BITS))
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["label", "counts"])

    counts: dict[str, np.ndarray] = {}
    for r in in_arrow(sample.coalesce(32), add, "label string, counts binary").toLocalIterator():
        counts[r["label"]] = counts.get(r["label"], 0) + np.frombuffer(bytes(r["counts"]), np.float64)
    languages = sorted(counts)
    table = np.array([counts[x] for x in languages]).reshape(len(languages), 1 << BITS) + smoothing
    return TextModel(languages, np.log(table / table.sum(1, keepdims=True)))


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def identify(pages: DataFrame, model: TextModel, key: str = "page_id", url: str = "url", html: str = "html", trust: float = 20.0) -> DataFrame:
    """(key, host, declared, suffix, text_lang, lang, confidence) of each page.

    Evidence is added in log space, as if independent given the language: the text's likelihood;
    the language that the markup declares (``lang`` of the html element, its first part); the
    address suffix (the host's last label); and the host's prior. How likely each declaration and
    suffix is in each language, and the priors, come from grouped sums of the texts' posteriors
    over all pages. A host's prior is drawn to its registered domain's, that to the overall one,
    with the weight of ``trust`` pages, and a page's own text is left out of its host's sums.

    Null or empty pages have no text evidence, null addresses the host "" and no suffix, a
    declaration no language uses is a kind of its own. Ties go to the language first in order of
    its name; under a model without languages text_lang, lang and confidence are null. Pages are
    read whole, in time linear in their length; other columns are left out. Sums are partial before
    they move and have a row per host, domain, suffix or declaration and language, so a host with a
    third of all pages is no hot task; joins back to pages are on slim rows that adaptive execution
    can split. Repeated rows are pages like others; an empty table gives no rows.
    """
    host = lambda u: F.lower(F.regexp_extract(F.coalesce(u, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce(pages[html], F.lit("")), r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    if not model.languages:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("text_lang", "string"), ("lang", "string"), ("confidence", "double"))]
        return pages.select(pages[key].alias("id"), host(pages[url]).alias("host"), declared.alias("declared")).select(F.col("id").alias(key), "host", "declared", F.substring_index("host", ".", -1).alias("suffix"), *none)
    held = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            logs = [held.value.log_likelihoods(visible_text(t.as_py())) for t in rows.column(2)]
            yield pa.record_batch([rows.column(0), rows.column(1), rows.column(3), pa.array([x.tolist() for x in logs], pa.list_(pa.float64()))], ["id", "url", "declared", "text_logs"])

    kind = pages.schema[key].dataType.simpleString()
    scored = in_arrow(pages.select(pages[key].alias("id"), pages[url].alias("url"), pages[html].alias("html"), declared.alias("declared")), read, f"id {kind}, url string, declared string, text_logs array<double>", 256)
    scored = scored.withColumn("host", host(F.col("url"))).withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))
    n = len(model.languages)
    scored = cut(scored.withColumn("p", _softmax(F.col("text_logs"))).drop("url"), "langid-text")

    def sums(by: str) -> DataFrame:
        return scored.groupBy(by).agg(F.array(*[F.sum(F.get("p", F.lit(i))) for i in range(n)]).alias(f"{by}_sums"))

    whole = scored.agg(F.array(*[F.coalesce(F.sum(F.get("p", F.lit(i))), F.lit(0.0)) for i in range(n)]).alias("all_sums"))
    out = scored.crossJoin(F.broadcast(whole))  # one row
    for by in ("declared", "suffix", "domain", "host"):
        out = out.join(sums(by), by)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    # P(declaration | language) up to what is the same for all: its share of the language's pages.
    given = lambda by: F.zip_with(f"{by}_sums", "all_sums", lambda x, y: F.log((x + 0.5) / (y + n)))
    prior = F.transform("all_sums", lambda x: (x + 1) / (total(F.col("all_sums")) + n))
    for by in ("domain", "host"):
        rest = F.zip_with(f"{by}_sums", "p", lambda x, y: F.greatest(x - y, F.lit(0.0)))
        weight = total(rest)
        prior = F.zip_with(rest, prior, lambda x, q: (x + trust * q) / (weight + trust))
    logs = F.zip_with(F.zip_with("text_logs", given("declared"), lambda a, b: a + b), F.zip_with(given("suffix"), F.transform(prior, lambda x: F.log(x)), lambda a, b: a + b), lambda a, b: a + b)
    names = F.array(*map(F.lit, model.languages))
    best = lambda a: F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    out = out.withColumn("posterior", _softmax(logs))
    return out.select(F.col("id").alias(key), "host", "declared", "suffix", best(F.col("text_logs")).alias("text_lang"), best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"))
