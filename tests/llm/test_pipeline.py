import random

import corpus_pipeline
from tests.llm.test_operators import prose


def test_pipeline_on_planted_cases(spark, tmp_path):
    good = [prose(k, 80).capitalize() + "." for k in range(120)]
    bad = [" | ".join(prose(1000 + k, 60).split()) for k in range(60)]
    item = prose(5000, 30)
    rows, labels = [], []
    for i, t in enumerate(good + bad):
        rows.append((i, t))
        labels.append((i, int(i < 120), 0))
    w = good[3].split()
    planted = [good[0], good[1].replace(" ", "  "), " ".join([*w[:40], "changed", *w[41:]]), good[9] + " " + item + " " + prose(6000, 60)]
    rows += [(1000 + k, t) for k, t in enumerate(planted)]
    random.Random(1).shuffle(rows)
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, d).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    # of an exact copy with more white space the longer row stays
    assert {r.doc_id for r in out} == set(range(120)) - {1} | {1001}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]


def test_stages_keep_columns_and_bear_odd_rows(spark, tmp_path):
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, label string"
    odd = spark.createDataFrame([(None, None, None, None, None, None), (1, "", "en", "s", 0, "x"), (2, "a b", None, "s", 3, None), (2, "a b", None, "s", 3, None)], schema)
    odd.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns, name
    assert corpus_pipeline.run(spark, d).count() == 2


def test_pipeline_on_empty_and_long_documents_and_clashing_names(spark, tmp_path):
    long = prose(77, 60_000).capitalize() + "."
    rows = [(i, prose(i, 80).capitalize() + ".", "en", "s", 1, "own") for i in range(40)] + [(50, long, "en", "s", 1, "own"), (51, long, None, "s", 1, None)]
    schema = "doc_id long, text string, lang string, source string, quarry_row_no int, class string"
    for name, some in (("none", []), ("some", rows)):
        d = str(tmp_path / name)
        spark.createDataFrame(some, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, prose(5000, 30))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES[:-1]:
            docs = run(spark, docs, d)
            assert docs.columns == schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), stage
        out = corpus_pipeline.run(spark, d).collect()
        assert sorted(r.doc_id for r in out) == sorted({r[0] for r in some} - {51}) and all(r.round_trip for r in out)
