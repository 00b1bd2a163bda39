"""License scans in DataFrame functions only.

Texts and templates are lower-cased words (letters and digits). Shingles of five words are looked up in the set of all template
shingles, because others cannot add to a containment; what is left are the shingles of a few places. Templates
are put into size classes; for each class overlapping windows of two strides are laid over a text, a stride being
as long as the longest template of the class, so every template occurrence lies whole within a window. A window is the
set of its shingles that the class knows. MinHash bands of windows and templates are joined to retrieve templates:
a template of n shingles is of a class of stride s with s / 2 < n <= s, a window has 2 * s shingles or fewer, and one that holds 0.9 * n of them
has a Jaccard similarity of 0.9 * n / (2 * s + 0.1 * n), 0.219 or more; one of ``BANDS`` = 64 bands of one row
then collides with a probability of 1 - 0.781 ** 64 or more, over 0.9999998. Matches are verified by exact containment of
the template's shingles in the window.

Scale: one pass over the texts without a shuffle; only hits are exploded and grouped, by row and window. The templates are a
parameter of bounded size and are the only broadcast.

Cases: null or short texts match nothing; very long texts are scanned whole; a text that holds a license many times is reported once, with the best
containment and the place where the first verified window has the first of the template's shingles; repeated rows are
reported each; a null doc_id is reported as null; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .license_texts import TEMPLATES

SHINGLE = 5
CONTAINMENT = 0.9  # a variant of a notice that should count is a template of its own
BANDS = 64
#: shingles of the longest template of each size class; a template has more than half as many
STRIDES = tuple(2**k for k in range(15))


def _words(text: Column) -> Column:
    # the leading blank makes the first element empty in every case, so that positions agree
    return F.split(F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}\p{N}]+", " "), " ")


def _shingles(words: Column) -> Column:
    """array<struct<pos, h>>: hashes of five consecutive words, with the number of the first one."""
    n = F.size(words) - 2  # without the empty first and last element
    at = F.when(n >= SHINGLE, F.sequence(F.lit(0), n - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(*(F.get(words, i + 1 + k) for k in range(SHINGLE))).alias("h")))


def _text_shingles(text: Column) -> Column:
    """``_shingles`` of a text's words; a lambda over a one-element array binds the words, which are then split once and not for every shingle."""
    return F.flatten(F.transform(F.array(_words(text)), _shingles))


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """license, template, stride and shingle set of every template of five words or more; as small as the parameter."""
    values = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(k).alias("template"), F.lit(text).alias("text")) for k, (name, text) in enumerate(templates)))
    rows = spark.range(1).select(F.inline(values)).select("license", "template", F.array_distinct(F.transform(_text_shingles(F.col("text")), lambda s: s["h"])).alias("shingles")).collect()
    known = [
        F.struct(F.lit(r.license).alias("license"), F.lit(r.template).alias("template"), F.lit(stride).alias("stride"), F.from_json(F.lit(str(r.shingles)), "array<long>").alias("shingles"))
        for r in rows if r.shingles for stride in [next((s for s in STRIDES if len(r.shingles) <= s), len(r.shingles))]
    ]
    none = "array<struct<license:string,template:int,stride:int,shingles:array<bigint>>>"
    return spark.range(1).select(F.inline(F.array(*known) if known else F.array().cast(none)))


def _bands(shingles: Column) -> Column:
    """One key a band: the band's number and the least of its hash over the set."""
    def band(b: int) -> Column:
        return F.xxhash64(F.lit(b), F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(b)))))

    return F.array(*map(band, range(BANDS)))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, row_no, license, containment, first_word: each license found in each row, with its best window."""
    spark = docs.sparkSession
    known = template_table(spark, templates)
    vocabulary = known.select("stride", F.explode("shingles").alias("h")).distinct()
    hashes = sorted({r.h for r in vocabulary.select("h").distinct().collect()})  # as many as the templates have shingles
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.col(text_col).cast("string").alias("text"))
    found = F.filter(_text_shingles(F.col("text")), lambda s: s["h"].isin(hashes))
    hits = rows.where("text is not null").select("doc_id", "row_no", F.explode(found).alias("s"))
    hits = hits.select("doc_id", "row_no", F.col("s.pos").alias("pos"), F.col("s.h").alias("h"))
    last = F.floor(F.col("pos") / F.col("stride"))
    windows = (
        hits.join(F.broadcast(vocabulary), "h")
        .withColumn("window", F.explode(F.array(last - 1, last)))
        .groupBy("doc_id", "row_no", "stride", "window")
        .agg(F.collect_list(F.struct("pos", "h")).alias("places"))  # at most two strides of them
        .withColumn("found", F.array_distinct(F.transform("places", lambda p: p["h"])))
    )
    retrieved = (
        windows.withColumn("band", F.explode(_bands(F.col("found"))))
        .join(F.broadcast(known.withColumn("band", F.explode(_bands(F.col("shingles"))))), ["stride", "band"])
        .dropDuplicates(["row_no", "stride", "window", "template"])
    )
    share = F.size(F.array_intersect("shingles", "found")) / F.size("shingles")
    own = F.filter("places", lambda p: F.array_contains("shingles", p["h"]))
    verified = retrieved.withColumn("containment", share).where(F.col("containment") >= containment).withColumn("first_word", F.array_min(F.transform(own, lambda p: p["pos"])))
    return verified.groupBy("doc_id", "row_no", "license").agg(F.max("containment").alias("containment"), F.min("first_word").cast("long").alias("first_word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).drop("row_no")


_VALUES = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES))
# no bands: every window of two strides meets every template of its class; a stride is the least power of two that holds the template
ORACLE = rf"""
WITH t0 AS (SELECT * FROM (VALUES {_VALUES}) v(template, license, text)
), words AS (
  SELECT 't' AS side, CAST(template AS BIGINT) AS id, NULL AS doc_id, text FROM t0
  UNION ALL SELECT 'd', row_number() OVER (), doc_id, text FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT side, id, doc_id, string_split(regexp_replace(' ' || lower(text) || ' ', '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')[2:-2] AS w FROM words
), s AS (
  SELECT side, id, doc_id, unnest(range(0, len(w) - 4)) AS pos, w FROM w WHERE len(w) >= 5
), g AS (SELECT side, id, doc_id, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS h FROM s
), c AS (
  SELECT id AS template, count(DISTINCT h) AS n, CAST(2 ** ceil(log2(count(DISTINCT h))) AS BIGINT) AS stride FROM g WHERE side = 't' GROUP BY id
), v AS (SELECT DISTINCT template, n, stride, h FROM c JOIN g ON g.id = template AND side = 't'
), hit AS (SELECT g.id, g.doc_id, template, n, stride, pos, g.h FROM g JOIN v USING (h) WHERE side = 'd'
), win AS (SELECT *, pos // stride - unnest([0, 1]) AS win FROM hit
), m AS (
  SELECT id, doc_id, template, win, count(DISTINCT h) / n AS containment, min(pos) AS first_word FROM win GROUP BY id, doc_id, template, n, win
)
SELECT doc_id, license, max(containment) AS containment, CAST(min(first_word) AS BIGINT) AS first_word FROM m JOIN t0 USING (template) WHERE containment >= {CONTAINMENT} GROUP BY id, doc_id, license
"""
