"""Benchmark decontamination: a BM25 index of the test items, searched by block-max WAND with every training passage.

Passages are windows of two chunks, a chunk being as long as the least power of two that holds an item (``MIN_STRIDE`` at least), so
every place where the item could stand lies whole in one of them. Items of one chunk length form a class; a class has an index of its own, so
the passages that an item is compared with depend on no other item. Number of items, mean length and document frequencies are those of the whole benchmark.

An index has a posting (item, impact) for every term of every item, in the order of items, in blocks of ``BLOCK`` postings with their
greatest impacts. Impacts are divided by the item's score against itself, so one threshold serves all items: a passage retrieves an item
when its distinct terms reach ``MIN_SCORE`` of that. WAND walks the lists of the passage's terms: the pivot is the first item that the
lists' greatest impacts, added in the order of their current items, could lift to the threshold; lists that stand before it skip to it. If the
maxima of the blocks that hold the pivot cannot reach the threshold, all of them skip beyond the first of these blocks to end;
else the item is scored. No item at the threshold or above is lost. Before, whole batches of passages are cut, by arrays, to those in which
the block maxima of any group of ``BLOCK`` items could reach it: each item's most frequent terms, which cannot lift it to
``REST`` of the threshold together, are added as a constant there, so passages of common words only cost little.

Each retrieved pair is verified: the shares of the item's question 5-grams and of its answer words that occur in the passage must both
reach ``MIN_OVERLAP``. The question of an item is all but its last sentence, the answer is the last one; an item of one sentence is both.

Scale: one pass over the texts, without a shuffle; only the few matches are grouped. Test items go to the tasks by broadcast, in
shards of ``ITEMS_PER_SHARD`` rows and ``CHARS_PER_SHARD`` characters at most (or one item); more items mean more passes, never a larger broadcast.
A worker builds the index of a shard once. Each shard is handed the statistics of the whole benchmark for its own terms,
so the result does not depend on how items are dealt to shards.

Cases: null or empty texts and items match nothing; very long texts are searched whole; equal items are all reported; repeated rows are reported once for
each doc_id; a null doc_id is reported as null; items of under five words compare by their words; other columns are not
looked at; an empty benchmark or documents table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table, tidy

MIN_SCORE = 0.4
MIN_OVERLAP = 0.5
K1, B = 1.2, 0.75
BLOCK = 4
MIN_STRIDE = 16
REST = 0.5  # share of the threshold that the terms left out of the first pass may reach
SHINGLE = 5
ITEMS_PER_SHARD = 20_000
CHARS_PER_SHARD = 32 << 20
BATCH_WORDS = 400_000

#: ASCII bytes that are no letters or digits become blanks
TO_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(TO_WORDS).split()


def grams(words: list[bytes]) -> set:
    if len(words) < SHINGLE:
        return set(words)
    return set(zip(*(words[k:] for k in range(SHINGLE)), strict=False))


def question_and_answer(text: str) -> tuple[str, str]:
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + count)."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


class Statistics(NamedTuple):
    """Of a benchmark's items that have words: their number, all words, and the items of each term."""

    n: int
    words: int
    frequency: dict[bytes, int]

    @classmethod
    def of(cls, items: list[list[bytes]]) -> Statistics:
        return cls(len(items), sum(map(len, items)), Counter(t for w in items for t in set(w)))

    def impacts(self, words: list[bytes]) -> dict[bytes, float]:
        """BM25 of an item for each of its terms, as shares of their sum."""
        out, length = {}, 1 - B + B * len(words) * self.n / self.words
        for t, f in Counter(words).items():
            idf = np.log1p((self.n - self.frequency[t] + 0.5) / (self.frequency[t] + 0.5))
            out[t] = float(idf * f * (K1 + 1) / (f + K1 * length))
        own = sum(out.values())
        return {t: x / own for t, x in out.items()}


class Postings:
    """One term's items in order, with their impacts, in blocks."""

    __slots__ = ("items", "impacts", "last", "greatest", "most")

    def __init__(self, items: list[int], impacts: list[float]):
        self.items, self.impacts = items, impacts
        self.last = [items[min(k + BLOCK, len(items)) - 1] for k in range(0, len(items), BLOCK)]
        self.greatest = [max(impacts[k : k + BLOCK]) for k in range(0, len(items), BLOCK)]
        self.most = max(impacts)


class Cursor:
    """A place in a list of postings."""

    __slots__ = ("list", "at", "item")

    def __init__(self, postings: Postings):
        self.list, self.at, self.item = postings, 0, postings.items[0]

    def seek(self, item: int) -> None:
        """Go on to the first posting at ``item`` or after it; END where there is none."""
        self.at = bisect_left(self.list.items, item, self.at)
        self.item = self.list.items[self.at] if self.at < len(self.list.items) else END

    def block(self, item: int) -> int:
        """The block in which ``item`` would stand, without moving; the number of blocks if beyond all."""
        return bisect_left(self.list.last, item, self.at // BLOCK)


END = 1 << 62


def block_max_wand(lists: list[Postings], threshold: float) -> list[tuple[int, float]]:
    """(item, score) of every item whose impacts add up to ``threshold`` or more."""
    out = []
    cursors = [Cursor(p) for p in lists]
    while True:
        cursors = sorted((c for c in cursors if c.item < END), key=lambda c: c.item)
        bound, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            bound += c.list.most
            if bound >= threshold:
                pivot = k
                break
        if pivot < 0:
            return out
        item = cursors[pivot].item
        while pivot + 1 < len(cursors) and cursors[pivot + 1].item == item:
            pivot += 1
        ahead = cursors[: pivot + 1]
        blocks = [(c, c.block(item)) for c in ahead]
        if sum(c.list.greatest[b] for c, b in blocks if b < len(c.list.last)) < threshold:
            ends = [c.list.last[b] + 1 for c, b in blocks if b < len(c.list.last)]
            ends += [cursors[pivot + 1].item] if pivot + 1 < len(cursors) else []
            beyond = min(ends)  # the pivot's own list has a block that holds it, so there is one
            for c in ahead:
                if c.item < beyond:
                    c.seek(beyond)
        elif cursors[0].item == item:
            score = sum(c.list.impacts[c.at] for c in ahead)
            if score >= threshold:
                out.append((item, score))
            for c in ahead:
                c.seek(item + 1)
        else:
            for c in ahead:
                if c.item < item:
                    c.seek(item)


class ItemClass:
    """The items of one chunk length: postings by term, and what their passages are verified against."""

    def __init__(self, stride: int, items: list[tuple[list[bytes], int | None, str]], term: dict[bytes, int], whole: Statistics):
        self.stride, self.vocabulary = stride, len(term)
        # neighbours in a block share words, which keeps the block maxima tight
        items = sorted(items, key=lambda x: x[0])
        self.items = [i for _, i, _ in items]
        parts = [question_and_answer(t) for _, _, t in items]
        self.question = [grams(words_of(q)) for q, _ in parts]
        self.answer = [set(words_of(a)) for _, a in parts]
        rows = sorted((term[t], k, x) for k, (w, _, _) in enumerate(items) for t, x in whole.impacts(w).items())
        of = np.array([t for t, _, _ in rows], dtype=np.int64)
        self.item, self.impact = np.array([k for _, k, _ in rows], dtype=np.int64), np.array([x for _, _, x in rows])
        self.start = np.searchsorted(of, np.arange(self.vocabulary + 1))
        self.lists: dict[int, Postings] = {}
        self.n_blocks = -(-len(items) // BLOCK)
        self.essential_start: np.ndarray | None = None

    def postings(self, term: int) -> Postings | None:
        if term not in self.lists:
            lo, hi = int(self.start[term]), int(self.start[term + 1])
            self.lists[term] = Postings(self.item[lo:hi].tolist(), self.impact[lo:hi].tolist()) if lo < hi else None
        return self.lists[term]

    def split(self, seen: np.ndarray, threshold: float) -> None:
        """Choose each item's essential terms: the rest, the terms most often ``seen``, reach REST of the threshold at most.

        The choice decides how much the first cut can skip, never what is found.
        """
        term = np.repeat(np.arange(self.vocabulary), np.diff(self.start))
        order = np.lexsort((-seen[term], self.item))
        item, impact = self.item[order], self.impact[order]
        run = np.cumsum(impact)
        first = np.searchsorted(item, item)
        weak = run - run[first] + impact[first] < REST * threshold
        rest = np.bincount(item[weak], weights=impact[weak], minlength=self.n_blocks * BLOCK)
        self.block_rest = rest.reshape(self.n_blocks, BLOCK).max(axis=1)
        key, where = np.unique(term[order][~weak] * self.n_blocks + item[~weak] // BLOCK, return_inverse=True)
        self.block_impact = np.zeros(len(key))
        np.maximum.at(self.block_impact, where, impact[~weak])
        self.block = key % self.n_blocks
        self.essential_start = np.searchsorted(key, np.arange(self.vocabulary + 1) * self.n_blocks)

    def passages(self, terms: np.ndarray, sizes: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """(text number, first word) of the passages in which some group of items could reach the threshold.

        terms: the numbers of all words of all texts, -1 for those of no item; sizes: words of each text.
        """
        if self.essential_start is None:
            self.split(np.bincount(terms + 1, minlength=self.vocabulary + 1)[1:], threshold)
        essential = np.append(np.diff(self.essential_start) > 0, False)
        chunks = -(-sizes // self.stride)
        first_chunk = np.cumsum(chunks) - chunks
        at = np.flatnonzero(essential[terms])
        text_of = np.repeat(np.arange(len(sizes)), sizes)[at]
        local = (at - (np.cumsum(sizes) - sizes)[text_of]) // self.stride
        chunk = first_chunk[text_of] + local
        # a chunk belongs to the passage that begins with it and to the one before, if that is of the same text
        window = np.concatenate([chunk, (chunk - 1)[local > 0]])
        pairs = np.unique(window * self.vocabulary + np.concatenate([terms[at], terms[at][local > 0]]))
        window, term = pairs // self.vocabulary, pairs % self.vocabulary
        counts = self.essential_start[term + 1] - self.essential_start[term]
        posting = _ranges(self.essential_start[term], counts)
        keys, where = np.unique(np.repeat(window, counts) * self.n_blocks + self.block[posting], return_inverse=True)
        bound = np.bincount(where, weights=self.block_impact[posting], minlength=len(keys))
        found = np.unique(keys[bound + self.block_rest[keys % self.n_blocks] >= threshold] // self.n_blocks)
        owner = np.repeat(np.arange(len(sizes)), chunks)[found]
        return list(zip(owner.tolist(), ((found - first_chunk[owner]) * self.stride).tolist(), strict=True))


class Bm25Index:
    """The items by class; ``matches`` retrieves and verifies.

    ``whole`` has the statistics of the benchmark that the items are a shard of; without it they are the whole benchmark.
    """

    def __init__(self, items: list[tuple[int, str]], min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP, whole: Statistics | None = None):
        self.threshold, self.min_overlap = min_score - 1e-9, min_overlap
        split = [(w, i, t) for i, t in items if (w := words_of(t))]
        whole = whole or Statistics.of([w for w, _, _ in split])
        self.term = {t: k for k, t in enumerate(sorted({t for w, _, _ in split for t in w}))}
        groups = defaultdict(list)
        for row in split:
            groups[max(MIN_STRIDE, 1 << (len(row[0]) - 1).bit_length())].append(row)
        self.classes = [ItemClass(stride, rows, self.term, whole) for stride, rows in sorted(groups.items())]

    def matches(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, float, int, float, float]]:
        """(text number, item id, score, first word of the passage, question overlap, answer overlap)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        get = self.term.get
        terms = np.fromiter(map(get, chain.from_iterable(texts), repeat(-1)), np.int64, int(sizes.sum()))
        for group in self.classes if len(terms) else ():
            for number, start in group.passages(terms, sizes, self.threshold):
                passage = texts[number][start : start + 2 * group.stride]
                own = set(map(get, passage, repeat(-1))) - {-1}
                lists = [p for p in map(group.postings, sorted(own)) if p is not None]
                have = None
                for item, score in block_max_wand(lists, self.threshold):
                    have = have or {SHINGLE: grams(passage), 1: set(passage)}
                    q, a = group.question[item], group.answer[item]
                    q_share = sum(g in have[SHINGLE if isinstance(g, tuple) else 1] for g in q) / max(len(q), 1)
                    a_share = len(a & have[1]) / max(len(a), 1)
                    if q_share >= self.min_overlap and a_share >= self.min_overlap:
                        yield number, group.items[item], score, start, q_share, a_share

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, int, float, float]]:
        group, words, base = [], 0, 0
        for k, text in enumerate(texts):
            group.append(words_of(text))
            words += len(group[-1])
            if words >= BATCH_WORDS or k == len(texts) - 1:
                for m in self.matches(group):
                    yield base + m[0], *m[1:]
                base, group, words = k + 1, [], 0


def _merged(pieces: list[tuple[int, int, int, int]], rows: int, chars: int) -> Iterator[list[tuple[int, int]]]:
    """Ranges of numbers (first, last), in lists of at most ``rows`` rows and ``chars`` characters, from (first, last, rows, characters)."""
    held, n, size = [], 0, 0
    for first, last, own, long in sorted(pieces):
        if held and (n + own > rows or size + long > chars):
            yield held
            held, n, size = [], 0, 0
        held.append((first, last))
        n, size = n + own, size + long
    if held:
        yield held


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        split = [words_of(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, split), pa.int64()), pa.array([sorted(set(w)) for w in split], pa.list_(pa.binary()))], names=["number", "n_words", "terms"])


def item_shards(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[list[tuple[int, str]], Statistics | None]]:
    """The test items in lists of bounded size, each with the statistics of all items for its own terms; None where one list has all."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n_rows, n_chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    if n_rows <= ITEMS_PER_SHARD and n_chars <= CHARS_PER_SHARD:
        yield [(r.item_id, r.text) for r in rows.collect()], None
        return
    numbered = materialise(rows.withColumn("number", F.monotonically_increasing_id()))
    words = materialise(numbered.select("number", "text").mapInArrow(tidy(_item_words), "number long, n_words long, terms array<binary>").where("n_words > 0"))
    n, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_words"), F.lit(1))).first()
    terms = words.select("number", F.explode("terms").alias("term"))
    frequency = materialise(terms.groupBy("term").agg(F.count(F.lit(1)).alias("items")))
    part = F.shiftrightunsigned("number", 33).alias("part")  # of monotonically_increasing_id; numbers run on within a part
    own = numbered.select("number", part, F.char_length("text").cast("long").alias("chars"))
    order = Window.partitionBy("part").orderBy("number")
    own = own.withColumns({"piece": F.floor((F.sum("chars").over(order) - F.col("chars")) / CHARS_PER_SHARD), "rank": F.floor((F.row_number().over(order) - 1) / ITEMS_PER_SHARD)})
    pieces = own.groupBy("part", "piece", "rank").agg(F.min("number"), F.max("number"), F.count(F.lit(1)), F.sum("chars")).collect()
    for ranges in _merged([tuple(r[3:]) for r in pieces], ITEMS_PER_SHARD, CHARS_PER_SHARD):
        mine = reduce(or_, (F.col("number").between(a, b) for a, b in ranges))
        found = frequency.join(terms.where(mine).select("term").distinct(), "term").collect()
        items = [(r.item_id, r.text) for r in numbered.where(mine).collect()]
        yield items, Statistics(n, total, {bytes(r.term): r["items"] for r in found})


_INDEXES: dict[str, Bm25Index] = {}


class SharedIndex:
    """An index that travels as the broadcast items of a shard and is built once in each Python worker."""

    def __init__(self, spark: SparkSession, items: list[tuple[int, str]], whole: Statistics | None, min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP):
        self.key, self.shares = uuid.uuid4().hex, (min_score, min_overlap)
        self.shard = spark.sparkContext.broadcast((items, whole))

    def get(self) -> Bm25Index:
        if self.key not in _INDEXES:
            while len(_INDEXES) >= 2:
                del _INDEXES[next(iter(_INDEXES))]
            items, whole = self.shard.value
            _INDEXES[self.key] = Bm25Index(items, *self.shares, whole)
        return _INDEXES[self.key]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """One row for each (document, test item) that is verified: doc_id, item_id, and of the best passage its score, first word and overlaps."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, first_word long, question_overlap double, answer_overlap double"
    found = None
    for items, whole in item_shards(benchmark):
        shared = SharedIndex(docs.sparkSession, items, whole, min_score, min_overlap)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.get()
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out = [(ids[k], *rest) for k, *rest in index.scan(batch.column(1).to_pylist())]
                columns = list(zip(*out, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        part = rows.mapInArrow(tidy(scan), schema)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("question_overlap", "answer_overlap", "score", (-F.col("first_word")).alias("neg"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("best.score").alias("score"), (-F.col("best.neg")).alias("first_word"),
        F.col("best.question_overlap").alias("question_overlap"), F.col("best.answer_overlap").alias("answer_overlap"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no passage of a test item was verified."""
    kept = docs
    at = docs.columns.index(text_col)
    for items, whole in item_shards(benchmark):
        shared = SharedIndex(docs.sparkSession, items, whole)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.get()
            for batch in batches:
                leaks = {m[0] for m in index.scan(batch.column(at).to_pylist())}
                yield batch.filter(pa.array([k not in leaks for k in range(batch.num_rows)], pa.bool_()))

        kept = kept.mapInArrow(tidy(clean), docs.schema)
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
