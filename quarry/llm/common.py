"""What the operators of this subpackage share: reading a table, cutting lineage, dropping rows."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
PART_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir).

    Where that setting is absent, a local session, as in tests, gets a temporary folder; on a cluster this is an error, since
    executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later stages then start from files that outlive any executor, and an expensive pass over
    the texts is not repeated for each use.
    """
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written once with a number for each row, and the name of that column.

    Operators that read a table several times know its rows by their numbers. monotonically_increasing_id() depends on how files are split, and that on the cores that are
    there when a job is planned, so numbers are written with the rows, not made anew by each job.
    """
    name = unused("quarry_row_no", docs.columns)
    return materialise(docs.withColumn(name, F.monotonically_increasing_id())), name


def row_number_of(row_col: str | None) -> Column:
    """The column of ``numbered``, or, for a single pass over a table, numbers made by that pass."""
    return F.col(row_col) if row_col else F.monotonically_increasing_id()


def parts(batch: pa.RecordBatch, column: int, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts whose texts in ``column`` take at most ``size`` bytes, or that are one row."""
    first, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if held and held + n > size:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function for mapInArrow or mapInPandas, whose worker gives memory back when a task ends: workers are used again, by later stages as well."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(AttributeError, OSError):  # of the C library, where it has one
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def salted_join(rows: DataFrame, few: DataFrame, key: str, deal: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """``rows`` joined to ``few``, which has a row a key: each goes to ``salts`` tasks, and rows are dealt to them by ``deal``, so a key of very many rows gathers in none."""
    salt = unused("quarry_salt", [*rows.columns, *few.columns])
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(deal), F.lit(salts)).cast("int"))
    return dealt.join(few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, salt], how).drop(salt)


def unused(name: str, columns: list[str]) -> str:
    """``name``, or a longer one that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_rows(docs: DataFrame, row_col: str, dropped: DataFrame) -> DataFrame:
    """``docs``, which is ``numbered`` by ``row_col``, less the rows whose number stands in ``dropped`` (row_no, written), and less that column.

    The numbers are broadcast up to ``BROADCAST_ROWS`` of them, so that the texts stay where they are; beyond that the same join is a shuffle.
    """
    gone = dropped.select(F.col("row_no").alias(row_col))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, row_col, "left_anti").drop(row_col)
