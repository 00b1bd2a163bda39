"""Files: strict JSON lines, splits, small CSV tables, manifests of artifacts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); a local session without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or tempfile.mkdtemp(prefix='quarry-')).rstrip('/')}/quarry-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the shared folder, read back: its plan is done with, and what reads it starts from files."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, ddl: str, strict: bool = True) -> DataFrame:
    """JSON lines by schema. Blank lines are skipped; a bad line fails, or, if not strict, is kept with its file and text."""
    schema = T._parse_datatype_string(ddl)
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = spark.read.schema(schema.add(CORRUPT, T.StringType())).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def write_splits(examples: DataFrame, path: str, split_col: str = "split", fmt: str = "json") -> None:
    """One folder a split, rows in order of id within each file; nulls are kept."""
    rows = examples.repartitionByRange(split_col, "id").sortWithinPartitions(split_col, "id")
    rows.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy(split_col).format(fmt).save(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_report_csv(table: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_report_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("header", True).csv(path)


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path (below ``path``), bytes, sha256 of every file, of all folders; a file is read whole into a row, so 2 GB is the limit of one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    root = re.sub("/+", "/", re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)).rstrip("/") + "/"
    below = F.substr(F.col("path"), F.instr("path", F.lit(root)) + len(root))
    return files.select(below.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """path, problem of every expected file that is missing or differs in size or content."""
    found = listing.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    rows = expected.join(found, "path", "left")
    problem = F.when(F.col("_sha").isNull(), "missing").when(F.col("_bytes") != F.col("bytes"), "size").when(F.col("_sha") != F.col("sha256"), "content")
    return rows.select("path", problem.alias("problem")).where("problem is not null")
