"""Rows are known by numbers that are written once: files may be split otherwise by every job, as when executors are lost."""

import pytest

from quarry.llm import common, exact_dedup, ngram_jaccard, suffix_dedup, warc

SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def shifting(spark, monkeypatch):
    """Another way to split files after every table that is written."""
    plain, turn = common.materialise, [0]

    def materialise(df):
        out = plain(df)
        turn[0] += 1
        spark.conf.set(SPLITS, str([32, 3, 2, 7][turn[0] % 4]))
        return out

    for module in (common, exact_dedup, ngram_jaccard, suffix_dedup, warc):
        monkeypatch.setattr(module, "materialise", materialise)
    spark.conf.set(SPLITS, "4")
    yield turn
    spark.conf.unset(SPLITS)


def words(seed, n):
    return " ".join(f"w{(seed * 7919 + k * k * 31) % 9973}" for k in range(n))


@pytest.fixture
def files(spark, tmp_path):
    rows = [(i, words(i % 130, 40)) for i in range(300)] + [(1000 + i, words(i, 39) + " other end") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(str(tmp_path / "docs"))
    return rows, spark.read.parquet(str(tmp_path / "docs"))


def test_copies_that_go(shifting, files):
    rows, docs = files
    first = {}
    for doc_id, text in rows:
        first.setdefault(text, doc_id)
    assert sorted(r.doc_id for r in exact_dedup.keep_one(docs).collect()) == sorted(first.values()) and shifting[0] >= 3


def test_near_copies_that_go(shifting, files):
    rows, docs = files
    assert sorted(r.doc_id for r in ngram_jaccard.keep_one(docs).collect()) == list(range(130))


def test_spans_and_archives(spark, shifting, files, tmp_path):
    rows, docs = files
    texts = dict(rows)
    copied = {t for t in texts.values() if list(texts.values()).count(t) > 1}
    for r in suffix_dedup.dedup(docs).collect():
        assert texts[r.doc_id] not in copied or r.n_removed == r.n_bytes
    warc.write_archives(docs.selectExpr("doc_id AS page_id", "'http://h/' AS url", "text AS html"), str(tmp_path / "warc"))
    first = {}
    for doc_id, text in rows:
        first.setdefault(text, doc_id)
    for r in warc.captures(warc.assemble(warc.read_archives(spark, str(tmp_path / "warc"), payloads=True))).collect():
        mine = first[texts[r.page_id]]
        assert (r.record_type, r.refers_to) == (("response", None) if mine == r.page_id else ("revisit", mine))
