"""How far sources of one language are apart: term distributions, compared by a three-dimensional cube of tasks.

Terms are runs of letters and of all that is not ASCII, with A-Z in lower case. A language keeps the terms of at least ``MIN_DOCS`` of its documents. Every group (language and
source), and each language, gives every kept term a share in integers, smoothed and never zero. Two sources are as far apart as their shares differ, summed over all
kept terms.

The comparison is dense in its result, all pairs of sources, and sparse in its input. Groups of a language fall into blocks of ``GROUPS_PER_BLOCK``, kept terms into blocks of some ``TERMS_PER_BLOCK`` by their
hash. A cell of the cube is (group block, group block, term block): a task lays out the two slices it is sent, fills in the share of terms that a group lacks, and gives
the partial divergence of each pair of groups. Slices are replicated along one group axis only, to as many cells as there are group
blocks; partial results are added along the term axis by a plain aggregate.

Scale: texts are read once and combined by term within each task, with a bound on the terms it holds, before the first shuffle. No later step has a row for each word.
A cell's size depends on neither texts nor groups. All sums are of longs; a share is a division of decimals.

Cases: null text, lang and source count as empty; a group of empty texts has no terms but is compared; rows that repeat are documents of their own; a language without
kept terms has pairs of divergence 0; a language of one source has none. An empty table gives an empty table. Very long texts are cut into words in slices of bounded size. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table, tidy

MIN_DOCS = 30
TOP_TERMS = 50
GROUPS_PER_BLOCK = 64
TERMS_PER_BLOCK = 4096
HELD_TERMS = 600_000  # of a task, before it sends what it has counted
DOC_SHIFT = 40
ONE_DOC = 1 << DOC_SHIFT  # occurrences within a task stay below
SLICE_BYTES = 1 << 22
SMOOTH = 5
UNITS = 1_000_000_000

#: of each byte of a text in UTF-8: letters in lower case, bytes beyond ASCII as they are, a blank for the rest
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in bytes(range(256)).lower())


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size unless a term is longer."""
    text, first = text.translate(_WORD_BYTES), 0
    while first < len(text):
        stop = text.find(b" ", first + SLICE_BYTES)
        stop = len(text) if stop < 0 else stop
        yield text[first:stop].split()
        first = stop


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); for every group a row without a term as well."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], dict[bytes, int]] = {}  # a term's occurrences, and above them its documents
        held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in groups.items():
                both = np.fromiter(counts.values(), np.int64, len(counts))
                terms = pa.array([t.decode() for t in counts] + [None], pa.string())
                n, in_docs = (pa.array(np.append(x, 0), pa.int64()) for x in (both & (ONE_DOC - 1), both >> DOC_SHIFT))
                size = len(terms)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array([source] * size), terms, n, in_docs], names=names)
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own: Counter = Counter()
                for part in words(text.encode()):
                    own.update(part)
                counts = groups.setdefault((lang, source), {})
                known, held = counts.get, held - len(counts)
                for term, n in own.items():
                    counts[term] = known(term, 0) + n + ONE_DOC
                held += len(counts)
                if held > HELD_TERMS:
                    yield from sent()
                    held = 0
        yield from sent()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counted = rows.mapInArrow(tidy(run), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNITS * (count + SMOOTH) / (total + SMOOTH * terms)), exact: the product may exceed a long."""
    wide = lambda c: c.cast("decimal(20,0)")
    product = F.lit(UNITS).cast("decimal(10,0)") * wide(count + SMOOTH)
    return F.lit(1).cast("long") + F.call_function("div", product, wide(total + SMOOTH * terms))


class Audit:
    """The tables of an audit, each written once: ``kept`` terms, ``groups``, and the ``shares`` of terms that occur in a group."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"):
        counts = materialise(term_counts(docs, text_col, lang_col, source_col))
        terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
        terms = terms.where(F.col("docs") >= MIN_DOCS).drop("docs")
        langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
        blocks = F.pmod(F.xxhash64("term"), F.expr(f"(terms + {TERMS_PER_BLOCK - 1}) div {TERMS_PER_BLOCK}")).cast("int")
        at = F.row_number().over(Window.partitionBy("lang", "term_block").orderBy("term")) - 1
        # dealt by block: the join leaves all terms of a language in one task
        terms = terms.join(langs, "lang").withColumn("term_block", blocks).repartition("lang", "term_block")
        self.kept = materialise(terms.withColumn("at", at))
        occurring = materialise(counts.join(self.kept, ["lang", "term"]))
        groups = counts.where("term IS NULL").select("lang", "source")
        groups = groups.join(occurring.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs.select("lang", "terms"), "lang", "left")
        groups = groups.na.fill(0, ["total", "terms"])
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        absent = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))
        self.groups = materialise(groups.select("lang", "source", "total", "terms", number.alias("group"), absent.alias("absent")))
        shares = occurring.join(self.groups.select("lang", "source", "group", "total"), ["lang", "source"])
        p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
        self.shares = shares.select("lang", "source", "group", "term", "term_block", "at", p.alias("p"), q.alias("q"))

    def slices(self) -> DataFrame:
        """lang, term_block, group, absent, width (terms of the block), at and p (arrays): a row for every group and term block, of at most a block's terms."""
        widths = self.kept.groupBy("lang", "term_block").agg(F.count(F.lit(1)).alias("width"))
        last = F.greatest(F.expr(f"(terms + {TERMS_PER_BLOCK - 1}) div {TERMS_PER_BLOCK}") - 1, F.lit(0).cast("long")).cast("int")
        every = self.groups.select("lang", "group", F.coalesce("absent", F.lit(0).cast("long")).alias("absent"), F.explode(F.sequence(F.lit(0), last)).alias("term_block"))
        found = self.shares.groupBy("lang", "group", "term_block").agg(F.collect_list(F.struct("at", "p")).alias("x"))
        rows = every.join(found, ["lang", "group", "term_block"], "left").join(widths, ["lang", "term_block"], "left")
        return rows.select("lang", "term_block", "group", "absent", F.coalesce("width", F.lit(0).cast("long")).alias("width"), F.col("x.at").alias("at"), F.col("x.p").alias("p"))

    def partial_divergences(self) -> DataFrame:
        """lang, a, b (numbers of groups, a < b), part: the divergence of two groups over the terms of one block."""
        blocks = self.groups.groupBy("lang").agg(F.expr(f"max(group) div {GROUPS_PER_BLOCK}").cast("int").alias("last"))
        rows = self.slices().join(blocks, "lang").withColumn("own", F.expr(f"group div {GROUPS_PER_BLOCK}").cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        rows = rows.select("lang", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "term_block", "group", "absent", "width", "at", "p")
        block = GROUPS_PER_BLOCK
        return rows.groupBy("lang", "low", "high", "term_block").applyInPandas(lambda key, cell: _cell(block, key, cell), "lang string, a int, b int, part long")

    def pairs(self) -> DataFrame:
        """lang, source, item (another source), value."""
        sums = self.partial_divergences().groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
        for side in ("a", "b"):
            sums = sums.join(self.groups.select("lang", F.col("group").alias(side), F.col("source").alias(f"{side}_source")), ["lang", side])
        both = F.explode(F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("a_source", "b_source"), ("b_source", "a_source")))))
        return sums.select("lang", "value", both.alias("s")).select("lang", "s.source", "s.item", "value")

    def rising_terms(self) -> DataFrame:
        """lang, source, item (a term that the group has and uses more than its language), value."""
        return self.shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def _cell(block: int, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One cell of the cube: of its groups, two blocks of ``block`` at most, every pair that the cell stands for."""
    lang, low, high, _ = key
    groups, width = rows["group"].to_numpy(), int(rows["width"].max())
    shares = np.repeat(rows["absent"].to_numpy(np.int64)[:, None], width, axis=1)
    for row, at, p in zip(shares, rows["at"], rows["p"], strict=True):
        if at is not None:
            row[at] = p
    left, right = np.flatnonzero(groups // block == low), np.flatnonzero(groups // block == high)
    others = shares[right]
    out = []
    for i in left:
        part = np.abs(others - shares[i]).sum(axis=1)
        after = groups[right] > groups[i]
        out.append((np.full(after.sum(), groups[i]), groups[right][after], part[after]))
    a, b, part = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"lang": lang, "a": a, "b": b, "part": part})


def ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = rows.withColumn("rank", F.row_number().over(order))
    rows = rows.where(F.col("rank") <= top) if top else rows
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))


def report(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: for each group all other sources by divergence, and the terms that set it apart from its language."""
    audit = Audit(docs, text_col, lang_col, source_col)
    return ranked(audit.pairs(), "pair").unionByName(ranked(audit.rising_terms(), "term", TOP_TERMS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"))


_SHARE = lambda n, total: f"CAST(1 + (CAST({UNITS} AS HUGEINT) * ({n} + {SMOOTH})) // ({total} + {SMOOTH} * v) AS BIGINT)"
ORACLE = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
 k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
 l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
 f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 p AS MATERIALIZED (SELECT lang, source, term, n, {_SHARE("n", "total")} AS p, {_SHARE("lang_n", "lang_total")} AS q FROM f JOIN l USING (lang)),
 s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
   UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM x QUALIFY part = 'pair' OR rank <= {TOP_TERMS}"""
