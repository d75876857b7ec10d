from pyspark.sql import functions as F

import corpus_pipeline
from domquill.llm.decontamination import find_contamination
from domquill.llm.near_dedup import near_duplicates

from test_operators import clashing, components, hits, plain_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs, rows, none):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    more = clashing(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, SF)
        assert out.columns == more.columns
        got = out.select("row", "quality_score", "n_lines", "node").distinct().collect()
        assert len(got) == 1 and set(got[0]) == {"x"}  # columns of the user's own stay as they are
        assert stage(spark, none, SF).count() == 0
    assert corpus_pipeline.packed(spark, none, SF).count() == 0
    assert corpus_pipeline.packed(spark, more, SF).where("piece = 0").count() == len(rows)


def test_quality_keeps_what_it_scores(spark):
    """The rows that reach the threshold, and clean labelled ones that weren't learnt from."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.good_quality(spark, docs, SF).collect()}
    from domquill.llm.queries import op8_quality

    assert kept == {r["doc_id"] for r in op8_quality(spark, SF).where("score >= 0.3").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good & kept) >= 0.95 * len(good)


def test_line_stage_equals_plain_rule(spark, docs):
    own = docs.select("doc_id", F.xxhash64("text"), "text").collect()
    want = plain_lines({(i, h): (i, h, t) for i, h, t in own}.values())
    left = sorted(str((i, want[i, h][0])) for i, h, t in own if t is None or not want[i, h][1] or want[i, h][0].strip())
    got = corpus_pipeline.without_repeated_lines(spark, docs, SF).collect()
    assert sorted(str((r["doc_id"], r["text"] or "")) for r in got) == left
    assert all(r["n_chars"] in (len(r["text"] or ""), 0, 3, None) or r["text"] in {t for _, _, t in own} for r in got)


def test_near_stage_equals_plain_groups(spark, rows, docs):
    numbered = [(k, t) for k, (_, t, *_) in enumerate(rows)]
    group = {k: c for k, _, c in components(numbered, 5, 80)}
    best = {}
    for k, (i, t, *_) in enumerate(rows):
        best.setdefault(group[k], []).append((i is None, i or 0, t or ""))
    want = sorted(min(x)[1:] for x in best.values())
    got = corpus_pipeline.one_of_each_group(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == want


def test_decontamination_stage_equals_plain_search(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {i for i, _, n, _ in hits([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 10) if not n}
    assert {r["doc_id"] for r in corpus_pipeline.clean_of_benchmarks(spark, docs, SF).collect()} == want


def test_run_keeps_one_of_a_group_and_no_benchmark(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    near = corpus_pipeline.one_of_each_group(spark, docs, SF)
    found = near_duplicates(near, n=5)
    assert found.where("not kept").count() == 0 and near.count() == near_duplicates(docs, n=5).where("kept").count()
    clean = corpus_pipeline.clean_of_benchmarks(spark, docs, SF)
    assert find_contamination(clean, items).where("n_hit > 0").count() == 0
    assert clean.count() == find_contamination(docs, items).where("n_hit = 0").count()
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert len(out) and (out.groupby("sequence_id")["length"].sum() <= 1024).all()
