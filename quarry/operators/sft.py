"""Rows for supervised fine-tuning: chat messages, canonical targets, masked token features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keyed import keyed_hash
from ..sources.files import scratch

IGNORED = -100
TRAINABLE = ("train", "validation")
SYSTEM = "Extract the record that the document states. Answer with one JSON object of the given schema and nothing else; null or [] where nothing is stated."


def messages(text: Column, system: str = SYSTEM, instruction: str = "Extract the record.", tag: str = "DOCUMENT", contract: str = "") -> Column:
    """array<struct<role, content>>: the system turn, and the user turn with the tagged, stripped text."""
    user = F.concat(F.lit(f"{instruction}\n\n<{tag}>\n"), T.strip(text), F.lit(f"\n</{tag}>"), F.lit(f"\n\n{contract}" if contract else ""))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user))


def canonical_target(record: Column, ddl: str, pretty: bool = False) -> Column:
    """The record as JSON with all keys in schema order, nulls kept."""
    return F.to_json(record.cast(ddl), {"ignoreNullFields": "false", "pretty": str(pretty).lower()})


def word_ids(vocabulary: int = 1 << 20) -> Callable[[Column], Column]:
    """A tokenizer of native expressions: a word's id is a hash below ``vocabulary``."""
    return lambda c: F.transform(F.filter(F.split(T.strip(c), r"(?U)\s+"), lambda w: w != ""), lambda w: (keyed_hash(w) % vocabulary).cast("int"))


def encode_with(rows: DataFrame, text_col: str, out_col: str, load: Callable[[], Callable[[list[str]], list[list[int]]]]) -> DataFrame:
    """Token ids by a library: ``load`` runs once a task and returns a function from texts to lists of ids."""
    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load()
        for texts in batches:
            yield pd.Series(tokenizer(texts.fillna("").tolist()))

    return rows.withColumn(out_col, encode(F.col(text_col)))


def features(rows: DataFrame, prompt: Column, target: Column, eos: int = 0, max_length: int = 2048, n_prompt: Column | None = None) -> DataFrame:
    """Adds input_ids, labels (prompt masked), attention_mask, n_prompt, n_target, truncated from two arrays of ids.

    ``n_prompt``: the prompt's length where ``prompt`` has only its first ``max_length`` ids.
    """
    ends = F.concat(target, F.array(F.lit(eos)))
    wide = rows.withColumns({"_p": prompt, "_n": F.size(prompt) if n_prompt is None else n_prompt, "_t": F.when((F.size(target) > 0) & (F.element_at(target, -1) == eos), target).otherwise(ends)})
    ids, labels = F.concat("_p", "_t"), F.concat(F.array_repeat(F.lit(IGNORED), F.size("_p")), F.col("_t"))
    out = wide.withColumns({
        "input_ids": F.slice(ids, 1, max_length), "labels": F.slice(labels, 1, max_length), "n_prompt": F.col("_n"), "n_target": F.size("_t"),
        "truncated": F.col("_n") + F.size("_t") > max_length,
    })
    return out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))).drop("_p", "_t", "_n")


def length_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("truncated").alias("n_truncated"), F.avg(F.size("input_ids")).alias("mean_length"), F.max(F.size("input_ids")).alias("max_length"))


def trainable(rows: DataFrame, split_col: str = "split") -> DataFrame:
    """Only train and validation rows."""
    return rows.where(F.col(split_col).isin(*TRAINABLE))


def unsupervised(rows: DataFrame) -> DataFrame:
    """Rows without any label to learn from; training must not start while there are some."""
    return rows.where(~F.exists("labels", lambda x: x != IGNORED))


def running_totals(rows: DataFrame, group: list[str], order: list[str], value: str, out: str, ties: list[str] | None = None) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over earlier rows of the group, in ``order`` and, within one task, by ``ties``.

    Rows are sorted by ranges of group and order and written, so a group of any length spreads over tasks. Sums run within a range; each range of a group begins at
    the total of those before it, of which there are as many as tasks.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    ranged = rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    before = lambda c, *by, order: F.sum(c).over(Window.partitionBy(*by).orderBy(*order)) - F.col(c)
    key = F.struct(*group)  # equal where both are null
    totals = ranged.groupBy(key.alias("_key"), "_range").agg(F.sum(value).alias("_total"))
    totals = totals.select("_key", "_range", before("_total", "_key", order=["_range"]).alias("_carry"))
    rows_within = Window.partitionBy("_range", *group).orderBy(*order, *(ties or [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = ranged.withColumn("_within", F.sum(value).over(rows_within) - F.col(value)).withColumn("_key", key)
    return within.join(totals, ["_key", "_range"]).withColumn(out, F.col("_carry") + F.col("_within")).drop("_key", "_range", "_within", "_carry")


def conversation_features(turns: DataFrame, tokens: Callable[[Column], Column], eos: int = 0, max_length: int = 2048) -> DataFrame:
    """``features`` of every assistant turn (conv_id, turn): the turns before it are its prompt, itself is the target. ``tokens`` gives the ids of a text.

    A row is cut to ``max_length`` from its start, so of a conversation only the turns that begin below that place can stand in a prompt. How many tokens come
    before a turn is a running total; those first turns are put
    together once a conversation, as one bounded list, and each answer takes its part of it. The work is linear in turns and in what is returned, and no
    conversation is held in a row.
    """
    spoken = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = turns.select("conv_id", "turn", "role", "text", F.coalesce(tokens(spoken), F.array().cast("array<int>")).alias("ids"))
    rows = running_totals(rows.withColumn("n", F.size("ids")), ["conv_id"], ["turn"], "n", "start", ["role", "text"])
    first = rows.where(F.col("start") < max_length).groupBy(F.struct("conv_id").alias("key")).agg(F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("t"))
    first = first.select("key", F.slice(F.flatten("t.ids"), 1, max_length).alias("head"))
    answers = rows.where("role = 'assistant'").select(F.struct("conv_id").alias("key"), "turn", F.col("start").alias("n_prompt"), "text")
    met = answers.join(first, "key", "left")  # a conversation of very many answers is split by the skew join of adaptive execution
    prompt = F.coalesce(F.slice("head", F.lit(1), F.least("n_prompt", F.lit(max_length)).cast("int")), F.array().cast("array<int>"))
    out = features(met, prompt, tokens(F.coalesce("text", F.lit(""))), eos, max_length, F.col("n_prompt"))
    return out.select(F.col("key.conv_id").alias("conv_id"), "turn", "input_ids", "labels", "attention_mask", "n_prompt", "n_target", "truncated")
