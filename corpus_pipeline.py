"""A corpus pipeline over ``documents``: quality, exact copies, near copies, benchmark leaks, tokens.

Each stage takes all rows that the one before kept, as Parquet in the folder that the cluster shares, and returns the rows that
stay, with the columns of ``documents``; the last one returns token ids instead of texts.

Cases: a null text counts as an empty one, which the classifier judges like any other; texts without words are near copies of none. Very long texts go through whole. Of rows that repeat, one stays, the
one of the smallest doc_id, null last. Further columns are kept up to the last stage, whatever their names. An empty ``documents`` gives an empty table; without labels nothing is rejected, without test items nothing leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import byte_bpe, decontaminate, exact_dedup, ngram_jaccard, quality
from quarry.llm.common import materialise, read_table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space one stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return ngram_jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item go."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether decoding the ids gives the text again."""
    return byte_bpe.tokenise(docs, byte_bpe.vocabulary_path(), ["doc_id", "lang", "source"])


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level BPE", tokenise),
]

#: the classifier and the tokenizer have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
