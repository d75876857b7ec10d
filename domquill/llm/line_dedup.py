"""Line dedup over the smallest passages at every line. Native Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, held, small

BLANKS = " \t\x0b\x0c\r"


def with_lines(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``lines`` and ``full``, the numbers of those that aren't blank."""
    out = docs.withColumn("lines", held(F.split(F.coalesce(docs[text], F.lit("")), "\n", -1)))
    return out.withColumn("full", held(F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.btrim(F.get("lines", i), F.lit(BLANKS)) != "")))


def with_windows(docs: DataFrame, passage_bytes: int, passage_words: int) -> DataFrame:
    """Adds ``windows`` (at, n): of each full line the fewest lines from it on, and the fewest up to
    it, that are a passage. Blank lines don't count. Each run of lines that is a passage is covered
    by the windows within it, whatever stands around it. Arrays are indexed and sliced, never
    grown, so the work stays linear in a long text.
    """
    # A full line has a byte and a word at least, so a window has no more lines than these.
    most = min(passage_bytes, passage_words)

    def figure(i: Column) -> Column:
        line = F.get("lines", i)  # words of a line that is a passage by its bytes needn't be counted
        words = F.size(F.split(F.btrim(line, F.lit(BLANKS)), "[ \\t\\x0b\\x0c\\r]+", -1))
        return F.struct(F.octet_length(line).alias("bytes"), F.when(F.octet_length(line) >= passage_bytes, 1).otherwise(words).alias("words"))

    out = docs.withColumn("figures", held(F.transform("full", figure)))
    whole = lambda x: (x["bytes"] >= passage_bytes) | (x["words"] >= passage_words)
    none = F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("words"), F.lit(0).alias("n"))

    def fewest(figures: Column) -> Column:
        return F.aggregate(figures, none, lambda a, x: F.when(whole(a), a).otherwise(F.struct((a["bytes"] + x["bytes"]).alias("bytes"), (a["words"] + x["words"]).alias("words"), (a["n"] + 1).alias("n"))))

    def ahead(x: Column, i: Column) -> Column:
        found = lambda a: F.when(whole(a), i.cast("long") * (most + 1) + a["n"])
        return F.when(whole(x), i.cast("long") * (most + 1) + 1).otherwise(F.get(F.transform(F.array(fewest(F.slice("figures", i + 1, most))), found), F.lit(0)))

    def behind(x: Column, i: Column) -> Column:
        found = lambda a: F.when(whole(a), (i + 1 - a["n"]).cast("long") * (most + 1) + a["n"])
        at = F.greatest(i + 1 - most, F.lit(0))
        return F.when(~whole(x), F.get(F.transform(F.array(fewest(F.reverse(F.slice("figures", at + 1, i + 1 - at)))), found), F.lit(0)))

    # A window is one number here, as arrays of numbers are made distinct in linear time.
    codes = F.array_distinct(F.concat(F.transform("figures", ahead), F.transform("figures", behind)))
    out = out.withColumn("codes", held(F.filter(codes, lambda c: c.isNotNull())))
    window = lambda c: F.struct(F.floor(c / (most + 1)).cast("int").alias("at"), F.pmod(c, F.lit(most + 1)).cast("int").alias("n"))
    return out.withColumn("windows", held(F.transform("codes", window))).drop("figures", "codes")


def window_text(window: Column) -> Column:
    return F.array_join(F.transform(F.slice("full", window["at"] + 1, window["n"]), lambda i: F.get("lines", i)), "\n")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", passage_bytes: int = 180, passage_words: int = 30, drop_emptied: bool = False, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with repeated passages removed from ``text``, and the numbers of lines and of removed
    ones as columns named ``counts``.

    A passage is a run of lines of ``passage_bytes`` bytes or ``passage_words`` words or more;
    lone short lines that many documents have (headings, license lines) stay. The smallest passages
    (see ``with_windows``) are grouped over the whole input by hash and length; the occurrence
    first in order of (key, text hash, position) stays. The lines of the others go if their bytes
    equal the kept one's, and with them the blank lines between; lines that the kept one shares
    with a later one in the same text stay. Rows with equal key and text count as one document and
    get the same result. A null text has no passage and stays null; an empty one stays empty; null
    keys come first. With ``drop_emptied`` documents go of which nothing is left. An empty table
    gives no rows. Columns of ``docs`` named as ``counts`` are replaced, others stay, whatever their
    names.

    Only (hash, length, position) rows are grouped. Then texts of windows that repeat are put
    against the kept ones, and removals are joined to documents; the sides of these joins that say
    what repeats are counted first and broadcast up to BROADCAST_NUMBERS, so that no text moves
    but those; beyond that texts are shuffled by window, and once by document. Joins on a hot
    window are inner or left joins whose large side adaptive execution splits; the other side has
    one row a window.
    """
    own = [c for c in docs.columns if c not in counts]
    base = docs.select(F.struct(*own).alias("row"), docs[key].alias("k"), F.xxhash64(docs[text]).alias("tie"), docs[text].alias("body"))
    pieces = with_windows(with_lines(base, "body"), passage_bytes, passage_words).select("k", "tie", held(F.transform("windows", lambda w: F.struct(w["at"].alias("at"), w["n"].alias("n"), window_text(w).alias("piece")))).alias("pieces"))

    # Exploded rows carry a window's figures, and its text where needed, never the document's arrays.
    def exploded(with_text: bool) -> DataFrame:
        figures = lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), F.xxhash64(x["piece"]).alias("h"), F.octet_length(x["piece"]).alias("bytes"), *[x["piece"].alias("piece")] * with_text)
        return pieces.select("k", "tie", held(F.transform("pieces", figures)).alias("figures")).select("k", "tie", F.explode("figures").alias("f")).select("k", "tie", "f.*")

    place = F.struct("k", "tie", "at")
    repeated = exploded(False).groupBy("h", "bytes").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    repeated = cut(repeated.select("h", "bytes", "first"), "line-repeated")
    texts = exploded(True).join(small(repeated, 5 * repeated.count()), ["h", "bytes"]).withColumn("kept", place.eqNullSafe(F.col("first")))
    same_text = F.col("k").eqNullSafe(F.col("first.k")) & (F.col("tie") == F.col("first.tie"))
    texts = cut(texts.withColumn("start", F.when(same_text, F.greatest("at", F.col("first.at") + F.col("n"))).otherwise(F.col("at"))).drop("first"), "line-texts")
    first = texts.where("kept").select("h", "bytes", F.col("piece").alias("first_piece")).dropDuplicates(["h", "bytes"])
    flagged = texts.where("not kept and start < at + n").join(first, ["h", "bytes"]).where("piece = first_piece").select("k", "tie", F.explode(F.sequence(F.col("start"), F.col("at") + F.col("n") - 1)).alias("j"))
    gone = cut(flagged.groupBy("k", "tie").agg(F.array_sort(F.collect_set("j")).alias("gone")).withColumnsRenamed({"k": "k2", "tie": "tie2"}), "line-removals")

    same_doc = F.col("k").eqNullSafe(F.col("k2")) & (F.col("tie") == F.col("tie2"))
    numbers = gone.agg(F.sum(F.size("gone") + 2)).first()[0] or 0
    left = with_lines(base.join(small(gone, numbers), same_doc, "left"), "body")
    # Up to the next full line if that goes too, so blank lines between go along.
    upto = lambda j, p: F.when(F.get("gone", p + 1) == j + 1, F.get("full", j + 1) - 1).otherwise(F.get("full", j))
    left = left.withColumn("dropped", held(F.flatten(F.transform("gone", lambda j, p: F.sequence(F.get("full", j), upto(j, p))))))
    left = left.withColumn("kept_lines", held(F.when(F.col("gone").isNotNull(), F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped"), lambda i: F.get("lines", i)))))
    cleaned = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join("kept_lines", "\n"))
    done = left.select("row", cleaned.alias("cleaned"), F.size("lines").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("lines") - F.size("kept_lines")).alias("n_removed"))
    if drop_emptied:
        done = done.where((F.col("n_removed") == 0) | (F.btrim("cleaned", F.lit(BLANKS + "\n")) != ""))
    return done.select(*[F.col("cleaned").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in own], F.col("n_lines").alias(counts[0]), F.col("n_removed").alias(counts[1]))
