"""Batch inference that can be resumed: chunks of predictions, and a table of commits with the fingerprint of their settings."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.files import scratch
from .compare import keep_last

PREDICTION_DDL = "id string, raw_output string, latency_ms double"


class StaleCache(Exception):
    """Stored predictions were made under other settings."""


def fingerprint(settings: dict[str, str]) -> str:
    """Canonical text of all that decides a prediction, decoding settings included."""
    return "\n".join(f"{k}={settings[k]}" for k in sorted(settings))


def pending(examples: DataFrame, done: DataFrame) -> DataFrame:
    """Examples without a stored prediction."""
    return examples.join(done.select("id"), "id", "left_anti")


def score(examples: DataFrame, load: Callable[[], Callable[[str], str]], warm_up: int = 3) -> DataFrame:
    """id, raw_output, latency_ms: ``load`` runs once a task and returns the extractor; ``warm_up`` calls are not timed.

    A worker holds one Arrow batch and one text of it at a time as a Python string, and hands outputs on every ``OUTPUTS_PER_BATCH`` rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if extract is None:
                extract = load()
                for text in batch.column("text")[:warm_up]:
                    extract(text.as_py())
            for first in range(0, batch.num_rows, OUTPUTS_PER_BATCH):
                part, raw, took = batch.slice(first, OUTPUTS_PER_BATCH), [], []
                for text in part.column("text"):
                    text = text.as_py()
                    began = time.perf_counter()
                    raw.append(extract(text))
                    took.append((time.perf_counter() - began) * 1000)
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.string()), pa.array(raw, pa.string()), pa.array(took, pa.float64())], names=["id", "raw_output", "latency_ms"])

    return examples.select(F.col("id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PREDICTION_DDL)


OUTPUTS_PER_BATCH = 1_000
ROWS_PER_CHUNK = 1_000_000
SECONDS_PER_COMMIT = 10.0
COMMIT_DDL = "attempt string, number long, chunk int, rows long, fingerprint string"
STORED_DDL = "id string, raw_output string, latency_ms double, seq long, attempt string"


def _table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The rows under ``path``, none where nothing was written yet."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], ddl)
        raise


def commits(spark: SparkSession, path: str) -> DataFrame:
    """attempt, number (order of attempts), chunk, rows, fingerprint: a row for each chunk that was stored whole. Chunks stored by one job have one attempt."""
    return _table(spark, f"{path}/commits", COMMIT_DDL)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """id, raw_output, latency_ms, at (later is greater), attempt: rows of committed chunks. What a lost run left of a chunk belongs to no commit."""
    done = commits(spark, path).groupBy("attempt").agg(F.max("number").alias("number"))
    rows = _table(spark, f"{path}/rows", STORED_DDL).join(done, "attempt")
    return rows.select("id", "raw_output", "latency_ms", F.struct("number", "seq").alias("at"), "attempt")


def latest(predictions: DataFrame) -> DataFrame:
    """The last row for each id."""
    return keep_last(predictions, ["id"], "at")


def missing(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Examples without prediction; empty when the pass is complete."""
    return pending(examples, predictions)


def clear(spark: SparkSession, path: str) -> None:
    """Stored predictions go, their commits first."""
    spark.createDataFrame([], COMMIT_DDL).write.mode("overwrite").parquet(f"{path}/commits")
    spark.createDataFrame([], STORED_DDL).write.mode("overwrite").parquet(f"{path}/rows")


def dealt_to_chunks(todo: DataFrame, path: str, rows_per_chunk: int) -> int:
    """Write what is to be scored, a folder a chunk, by a hash of the id, so that a chunk is read without the others; returns the number of chunks."""
    chunks = -(-todo.count() // rows_per_chunk)
    if chunks:
        dealt = todo.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
        dealt.repartitionByRange("chunk", F.xxhash64("id", F.lit(1))).write.partitionBy("chunk").parquet(path)
    return chunks


def chunks_together(width: int, seconds: float) -> int:
    """How many chunks the next job takes after ``width`` took so long: at most twice as many, and one at least."""
    return max(1, min(2 * width, int(width * SECONDS_PER_COMMIT / max(seconds, 1e-3))))


def _commit(spark: SparkSession, path: str, attempt: str, number: int, chunks: range, counts: list[int], mark: str) -> None:
    """A row for each of neighbouring chunks, in one file; ``number`` is that of the last commit before."""
    place = F.col("id") - chunks.start
    commit = {"attempt": F.lit(attempt), "number": place + number + 1, "chunk": F.col("id"), "rows": F.split(F.lit(" ".join(map(str, counts))), " ")[place.cast("int")], "fingerprint": F.lit(mark)}
    types = dict(part.split() for part in COMMIT_DDL.split(", "))
    spark.range(chunks.start, chunks.stop, 1, 1).select(*(v.cast(types[k]).alias(k) for k, v in commit.items())).write.mode("append").parquet(f"{path}/commits")


def run_inference(
    examples: DataFrame, path: str, settings: dict[str, str], load: Callable[[], Callable[[str], str]], mode: str = "resume", warm_up: int = 3, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Score what is missing under ``path`` and return the last prediction for each example, in order of id.

    mode: resume (only missing ids), force (all anew, stored rows go), fresh (all again, appended). Other stored settings are refused unless forced.

    Examples are scored in chunks of some ``rows_per_chunk``. The rows of a chunk are written first, in a folder that no commit names yet; then one row is appended to the
    commits, with the fingerprint, which makes them count. Chunks that take less than ``SECONDS_PER_COMMIT`` go together, as many as that time is expected to hold, and are
    committed together. So a run that is lost has lost its last chunk at most, or, where chunks are short, about that time: the next one finds the ids of all chunks
    before, and the unfinished folder is never read. If a job of several chunks fails they are tried again in smaller ones, so those before the one at fault are kept.
    """
    spark, mark = examples.sparkSession, fingerprint(settings)
    examples = examples.select(F.col("id").cast("string").alias("id"), "text")
    if mode == "force":
        clear(spark, path)
    elif commits(spark, path).where(F.col("fingerprint") != mark).limit(1).count():
        raise StaleCache("stored predictions have another fingerprint; use force")
    number = commits(spark, path).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    work = scratch(spark)
    todo = pending(examples, stored(spark, path)) if mode == "resume" else examples
    chunks = dealt_to_chunks(todo, work, rows_per_chunk)
    dealt = _table(spark, work, "id string, text string, chunk int")  # its files are listed once
    counts = dict(dealt.groupBy("chunk").agg(F.count(F.lit(1))).collect()) if chunks else {}
    first, width = 0, 1
    while first < chunks:
        some, attempt, began = range(first, min(first + width, chunks)), uuid.uuid4().hex, time.monotonic()
        rows = dealt.where(F.col("chunk").between(some.start, some.stop - 1))
        # rows of a job are numbered, so of an id that occurs twice in a chunk one is the last; later jobs and runs have greater numbers
        scored = score(rows, load, warm_up).withColumn("seq", F.monotonically_increasing_id())
        try:
            scored.write.parquet(f"{path}/rows/attempt={attempt}")
        except Exception:
            if len(some) == 1:
                raise
            width = 1
            continue
        _commit(spark, path, attempt, number, some, [counts.get(k, 0) for k in some], mark)
        first, number = some.stop, number + len(some)
        width = chunks_together(len(some), time.monotonic() - began)
    if chunks:  # all are stored, so the texts that were dealt go
        spark.createDataFrame([], "id string").write.mode("overwrite").parquet(work)
    return latest(stored(spark, path)).drop("at", "attempt").join(examples.select("id").distinct(), "id", "left_semi").orderBy("id")


def positions(rows: DataFrame, order: str = "id") -> DataFrame:
    """``rows`` with position, from 1 in the order of a column: sorted by ranges and written, then numbered within each range beyond the counts of the ranges before."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    parts = spark.read.schema(ranged.schema).parquet(path)
    counts = parts.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # as many as there are tasks
    before = counts.select("_range", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return parts.withColumn("_within", within).join(before, "_range").withColumn("position", F.col("_before") + F.col("_within")).drop("_range", "_within", "_before")
