"""N-gram Jaccard self-join with Bayesian candidate pruning.

Two documents are linked when the Jaccard similarity of their sets of five-word shingles is ``THRESHOLD`` or more. Words are
split at white space and lower-cased; a text of one to four words is one shingle; a text without words has none and is linked to nothing.

Steps
1. One pass over the texts gives each row the hash of its shingle set and a MinHash signature. Rows with equal sets form a
   class; from here on only classes are compared, weighted by their size, so copies are never expanded into pairs.
2. LSH bands put classes into buckets. With 25 bands of 4 values a pair at the threshold shares none with a probability of 2e-6. A bucket of more than
   ``CHUNK`` classes, or ``CHUNK_SHINGLES`` shingles in all, is cut into chunks, and each pair of chunks is a cell, so a bucket of any size spreads over tasks. A pair belongs to the
   first bucket that it shares, and is looked at nowhere else.
3. In a cell its pairs are followed through their MinHash values, a few at a time: when the posterior probability of reaching the threshold,
   P(Binomial(k + 1, threshold) <= matches) under a uniform prior, is below ``TOLERANCE``, the pair is dropped. Cells and classes with pairs
   that live on leave this step.
4. Only these get their shingle sets, follow the same pairs again, and verify them exactly. A cell returns, for each class, its number of linked
   documents and the root of its linked group within the cell: rows in proportion to the classes, never pairs.
5. Connected components over these roots give near-duplicate groups. Groups meet their classes, and classes their rows, by salted joins, so
   neither a large group nor a text of very many copies gathers in a task.

Pairs that share a bucket by chance, or for a passage that many texts share, are dropped in step 3 and join nothing: no group is formed of
candidates. Shingles are compared as 64-bit hashes. The classes that need their texts are broadcast only while they
number ``BROADCAST_CLASSES`` or fewer; beyond that the same join is a shuffle.

Cases: null text counts as empty; very long texts are compared whole; rows without shingles are groups of one; repeated rows are copies; a null doc_id is
never the id of a group that has another; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, numbered, read_table, row_number_of, salted_join, tidy, without_rows
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 4
HASHES = BANDS * ROWS
STEP = 10
TOLERANCE = 1e-6
CHUNK, CHUNK_SHINGLES = 512, 1_000_000  # classes of a chunk, and their shingles, on average; a cell has two chunks at most
PAIRS_AT_ONCE = 1 << 16
SHINGLES_AT_ONCE = 4_000_000
BROADCAST_CLASSES = 1_000_000

_seeds = np.random.default_rng(20240101)
_MULTIPLY = _seeds.integers(0, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _seeds.integers(0, 2**63, HASHES, dtype=np.uint64)
_WORD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x) for x in words], dtype=np.uint64)
    if len(w) < SHINGLE:
        return _mix(np.array([(w * _WORD[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))]))
    n = len(w) - SHINGLE + 1
    h = w[:n] * _WORD[0]
    for k in range(1, SHINGLE):
        h += w[k : k + n] * _WORD[k]
    return np.unique(_mix(h))


def signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of a non-empty set."""
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * _MULTIPLY + _ADD
        np.minimum(out, (part >> np.uint64(32)).min(axis=0).astype(np.uint32), out=out)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(k, fewest matches among the first k values with which a pair lives on)."""
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(k + 1):
            total += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if total >= tolerance:
                out.append((k, m))
                break
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_number_of(row_col).alias("row_no"), F.col(text_col).cast("string").alias("text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row_no, set_key (null without shingles), n_shingles and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, signs = [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py())
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())], names=["doc_id", "row_no", "set_key", "n_shingles", "sig"])

    return _rows(docs, id_col, text_col, row_col).mapInArrow(tidy(run), "doc_id long, row_no long, set_key binary, n_shingles long, sig binary")


def buckets_of(sig: np.ndarray) -> np.ndarray:
    """One bucket a band for each signature."""
    bands = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    return _mix((bands * _WORD[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def band_buckets(classes: DataFrame) -> DataFrame:
    """(bucket, class, n_shingles) for every band of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
            node, size = (pa.array(np.repeat(batch.column(k).to_numpy(), BANDS)) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(buckets_of(sig).reshape(-1).view(np.int64)), node, size], names=["bucket", "class", "n_shingles"])

    return classes.select("class", "sig", "n_shingles").mapInArrow(tidy(run), "bucket long, class long, n_shingles long")


def cells(classes: DataFrame) -> DataFrame:
    """(bucket, a, b, chunk, class): the places of every class that shares a bucket with another; a cell is (bucket, a, b) and holds the chunks a and b."""
    buckets = band_buckets(classes)
    many = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("load")).where("n > 1")
    many = many.select("bucket", F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("load") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    placed = buckets.join(many, "bucket").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return placed.select("bucket", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "class")


CELL = ["bucket", "a", "b"]


def by_cell(rows: DataFrame) -> DataFrame:
    """Rows dealt to tasks and sorted by cell, the chunk a before the chunk b."""
    return rows.repartition(*CELL).sortWithinPartitions(*CELL, "chunk")


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + count)."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def whole_cells(batches: Iterator[pa.RecordBatch], weight: int | None = None, most: int = 0) -> Iterator[pa.Table]:
    """The rows again, in tables that hold whole cells: those of a batch, or fewer once the column ``weight`` adds up to ``most``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        first = np.flatnonzero(_new_cell(table))
        if len(first) > 1:
            last = int(first[-1])
            cuts = [0]
            if weight is not None:
                load = np.add.reduceat(table.column(weight).to_numpy(), first)
                total = 0
                for at, own in zip(first[:-1].tolist(), load.tolist(), strict=False):
                    if total and total + own > most:
                        cuts.append(at)
                        total = 0
                    total += own
            for lo, hi in zip(cuts, [*cuts[1:], last]):
                yield table.slice(lo, hi - lo)
            held = table.slice(last).to_batches()
        else:
            held = table.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _new_cell(table: pa.Table) -> np.ndarray:
    new = np.ones(table.num_rows, dtype=bool)
    if table.num_rows:
        new[1:] = False
        for k in range(len(CELL)):
            column = table.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
    return new


def surviving_pairs(table: pa.Table, sig: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right) rows of the pairs of each cell that belong to it and live through the pruning, a part of them at a time.

    The columns of ``table`` are bucket, a, b, chunk, in whole cells that are sorted by chunk.
    """
    n = table.num_rows
    first = np.flatnonzero(_new_cell(table))
    end_of = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    bucket, a, b, chunk = (table.column(k).to_numpy() for k in range(4))
    at = np.arange(n)
    # within one chunk a row meets the rows after it, between two those of the other chunk
    split = a != b
    second = np.repeat(np.add.reduceat((chunk == a).astype(np.int64), first) + first, np.diff(np.append(first, n))) if n else at
    start = np.where(split, second, at + 1)
    counts = np.where(split & (chunk != a), 0, end_of - start)
    own = buckets_of(sig)
    band = (own.view(np.int64) == bucket[:, None]).argmax(axis=1)
    ends = np.cumsum(counts)
    least = least_matches(threshold)
    for lo in range(0, int(ends[-1]) if n else 0, PAIRS_AT_ONCE):
        number = np.arange(lo, min(lo + PAIRS_AT_ONCE, int(ends[-1])))
        left = np.searchsorted(ends, number, side="right")
        right = start[left] + number - (ends[left] - counts[left])
        matches = np.zeros(len(left), dtype=np.int64)
        for k, few in least:
            matches += (sig[left, k - STEP : k] == sig[right, k - STEP : k]).sum(axis=1)
            alive = matches >= few
            left, right, matches = left[alive], right[alive], matches[alive]
        earlier = ((own[left] == own[right]) & (np.arange(BANDS) < band[left][:, None])).any(axis=1)
        yield left[~earlier], right[~earlier]


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


def living_cells(placed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows (bucket, a, b, chunk, class, n_shingles, copies, sig) of ``placed`` with a pair that lives through the pruning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            sig, size = _signatures(table.column(7)), table.column(5).to_numpy()
            alive = np.zeros(table.num_rows, dtype=bool)
            for left, right in surviving_pairs(table, sig, threshold):
                fits = _sizes_fit(size[left], size[right], threshold)
                alive[left[fits]] = alive[right[fits]] = True
            yield from table.filter(pa.array(alive)).to_batches()

    return by_cell(placed).mapInArrow(tidy(run), placed.schema)


def _sizes_fit(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Sets whose sizes differ by more than the threshold allows cannot reach it."""
    return np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9


def _coded(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets with their members numbered, and the number of distinct members."""
    distinct, code = np.unique(np.concatenate(sets), return_inverse=True)
    return np.split(code, np.cumsum([len(s) for s in sets])[:-1]), len(distinct)


def _verify(left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], distinct: int, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, by the exact sizes of the intersections; ``left`` is sorted, ``sets`` are coded."""
    sizes = np.array([len(s) for s in sets])
    common = np.zeros(len(left), dtype=np.int64)
    mark = np.zeros(distinct, dtype=bool)
    first = np.flatnonzero(np.diff(left, prepend=-1))
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(left)]):
        partners = right[lo:hi]
        mark[sets[left[lo]]] = True  # one set is marked at a time, its partners are looked up in it
        common[lo:hi] = np.add.reduceat(mark[np.concatenate([sets[p] for p in partners])], np.cumsum(sizes[partners]) - sizes[partners], dtype=np.int64)
        mark[sets[left[lo]]] = False
    total = sizes[left] + sizes[right]
    return common * (1 + threshold) >= threshold * total - 1e-9


LINKS = "class long, root long, n_links long, n_linked_classes long"


def verified_cells(living: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """LINKS of each cell, from the rows of ``living_cells`` with members, the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches, 5, SHINGLES_AT_ONCE):
            nodes, size, weight = (table.column(k).to_numpy() for k in (4, 5, 6))
            sig = _signatures(table.column(7))
            sets, distinct = _coded([np.frombuffer(s, dtype=np.uint64) for s in table.column(8).to_pylist()])
            links, partners, root = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), np.arange(len(nodes))
            rank = np.argsort(nodes, kind="stable").argsort()  # a root is the row of the smallest class
            for left, right in surviving_pairs(table, sig, threshold):
                fits = _sizes_fit(size[left], size[right], threshold)
                left, right = left[fits], right[fits]
                if not len(left):
                    continue
                linked = _verify(left, right, sets, distinct, threshold)
                left, right = left[linked], right[linked]
                links += np.bincount(left, weight[right], len(nodes)).astype(np.int64) + np.bincount(right, weight[left], len(nodes)).astype(np.int64)
                partners += np.bincount(left, minlength=len(nodes)) + np.bincount(right, minlength=len(nodes))
                root = _joined(root, left, right, rank)
            root = _pointed(root)
            found = partners > 0
            columns = [nodes[found], nodes[root[found]], links[found], partners[found]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["class", "root", "n_links", "n_linked_classes"])

    return by_cell(living).mapInArrow(tidy(run), LINKS)


def _pointed(root: np.ndarray) -> np.ndarray:
    while not np.array_equal(root[root], root):
        root = root[root]
    return root


def _joined(root: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Roots after the pairs are joined: the root of lower rank takes over."""
    by_rank = np.argsort(rank)
    while True:
        root = _pointed(root)
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            return root
        low, high = np.minimum(rank[a[apart]], rank[b[apart]]), np.maximum(rank[a[apart]], rank[b[apart]])
        target = rank[root]
        np.minimum.at(target, by_rank[high], low)
        root = by_rank[target]


def links(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, row_col: str | None = None) -> DataFrame:
    """LINKS of classes: every pair at the threshold is counted in one cell."""
    facts = classes.select("class", "n_shingles", "copies", "sig")
    placed = cells(classes).join(facts, "class").select(*CELL, "chunk", "class", "n_shingles", "copies", "sig")
    living = materialise(living_cells(placed, threshold))
    wanted = living.select(F.col("class").alias("row_no")).distinct()
    if wanted.count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["class", "members"])

    sets = _rows(docs, id_col, text_col, row_col).select("row_no", "text").join(wanted, "row_no").select("row_no", "text").mapInArrow(tidy(members), "class long, members binary")
    return verified_cells(living.join(sets, "class").select(*CELL, "chunk", "class", "n_shingles", "copies", "sig", "members"), threshold)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, row_col: str | None = None) -> DataFrame:
    """For every row: doc_id, row_no, class_id (smallest doc_id of its near-duplicate group), group_size, kept (one row of each
    group), copy_id (smallest doc_id with the same shingles), n_copies, n_links (rows of similarity threshold or more, itself excluded).
    """
    if row_col is None:
        docs, row_col = numbered(docs.select(id_col, text_col))
    signed = materialise(signatures(docs, id_col, text_col, row_col))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")).alias("first")
    classes = materialise(
        signed.where("set_key is not null").groupBy("set_key").agg(first, F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig"))
        .select("set_key", F.col("first.row_no").alias("class"), F.col("first.doc_id").alias("copy_id"), "copies", "n_shingles", "sig")
    )
    found = materialise(links(docs, classes, id_col, text_col, threshold, row_col))
    degree = found.groupBy("class").agg(F.sum("n_links").alias("others"))
    label = components(found.select(F.col("class").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("class"), "label")
    grouped = classes.drop("sig").join(degree, "class", "left").join(label, "class", "left")
    leader = F.min(F.struct(F.col("copy_id").isNull().alias("none"), F.col("copy_id").alias("id"), F.col("class").alias("row"))).alias("leader")
    groups = grouped.where("label is not null").groupBy("label").agg(leader, F.sum("copies").alias("group_size"))
    # a class that is linked to none is its own label, which no group has, so such rows do not gather
    told = salted_join(grouped.withColumn("label", F.coalesce("label", "class")), groups, "label", "class", "left").where("copies > 1 or group_size is not null")
    info = told.select(
        "set_key", "copy_id", "copies", "others", F.when(F.col("group_size").isNull(), F.col("copy_id")).otherwise(F.col("leader.id")).alias("class_id"),
        F.coalesce("leader.row", "class").alias("keeper"), F.coalesce("group_size", "copies").alias("group_size"),
    )
    # likewise rows without shingles: 8 bytes of their number are no digest of 16
    rows = signed.select("doc_id", "row_no", F.coalesce("set_key", F.unhex(F.lpad(F.hex("row_no"), 16, "0"))).alias("set_key"))
    alone = F.col("copies").isNull()
    return salted_join(rows, info, "set_key", "row_no", "left").select(
        "doc_id", "row_no",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keeper") == F.col("row_no"), F.lit(True)).alias("kept"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one of each near-duplicate group."""
    docs, row = numbered(docs)
    return without_rows(docs, row, materialise(near_duplicates(docs, id_col, text_col, row_col=row).where("not kept").select("row_no")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("row_no")


# lower() and white space as Python has them agree with these on the tables' texts; sets of shingles as in the docstring
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w
), c AS (
  SELECT doc_id, md5(array_to_string(s, chr(10))) AS k, s, len(s) AS n FROM s
), k AS (
  SELECT k, min(doc_id) AS copy_id, count(*) AS copies, any_value(s) AS s, any_value(n) AS n FROM c WHERE n > 0 GROUP BY k
), e AS (SELECT copy_id, n, unnest(s) AS g FROM k
), l AS (
  SELECT a.copy_id AS x, b.copy_id AS y FROM e a JOIN e b ON a.g = b.g AND a.copy_id <> b.copy_id
  GROUP BY a.copy_id, b.copy_id, a.n, b.n HAVING count(*) * 1.8 >= 0.8 * (a.n + b.n) - 1e-9
), r AS (
  SELECT copy_id AS x, copy_id AS y FROM k UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), g AS (SELECT x AS copy_id, min(y) AS class_id FROM r GROUP BY x
), t AS (SELECT class_id, sum(copies) AS group_size FROM g JOIN k USING (copy_id) GROUP BY class_id
), o AS (SELECT x AS copy_id, sum(copies) AS others FROM l JOIN k ON l.y = k.copy_id GROUP BY x)
SELECT c.doc_id, coalesce(class_id, c.doc_id) AS class_id, CAST(coalesce(group_size, 1) AS BIGINT) AS group_size,
  c.doc_id = coalesce(class_id, c.doc_id) AS kept, coalesce(k.copy_id, c.doc_id) AS copy_id, CAST(coalesce(copies, 1) AS BIGINT) AS n_copies,
  CAST(coalesce(copies, 1) - 1 + coalesce(others, 0) AS BIGINT) AS n_links
FROM c LEFT JOIN k ON c.k = k.k AND c.n > 0 LEFT JOIN g USING (copy_id) LEFT JOIN t USING (class_id) LEFT JOIN o USING (copy_id)
"""
