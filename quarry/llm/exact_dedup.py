"""Exact dedup through a sharded cuckoo-filter index of live digests.

Texts count as equal when they are identical after deleting every character of
``[\\x20\\x09-\\x0D]``. Each shard of the index owns a range of digest hashes and holds live digests in cuckoo
buckets: a fingerprint that is in neither of its two buckets proves a digest new; one that is, is verified against the digest that
the slot stands for. When a fingerprint finds no slot, the buckets are doubled and filled again from the stored digests. A live digest
stands for the row that stays; when a better row of the same text arrives, its entry is deleted and the new one inserted,
which a Bloom filter could not do.

Scale: the texts are read once and only (doc_id, length, digest) leaves that pass. A digest is
combined natively, in salted groups, before it meets the index, so that a group of copies holding
a third of all rows arrives as at most ``SALTS`` rows. The number of shards follows the
number of rows. The join back to the rows is salted in the same way.

Cases: null text counts as empty; all empty texts are one group; of repeated rows exactly one
stays; a null doc_id loses ties against any other; very long texts are hashed whole; an empty table gives an empty table; other columns
of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, numbered, read_table, row_number_of, salted_join, tidy, without_rows

BLANKS = b" \t\n\x0b\x0c\r"
SALTS = 16
ROWS_PER_SHARD = 50_000
SLOTS = 4
MAX_KICKS = 64


class CuckooIndex:
    """A shard of the index: buckets of ``SLOTS`` slots, each with a 16-bit fingerprint and the number of the stored entry it stands for.

    Entries hold the whole digest and a value. A digest may stand in either of two buckets; fingerprints that agree there
    are verified against the digests of their entries, so what is found is exact. All operations take many distinct digests at a time.
    """

    def __init__(self, capacity: int = 64):
        self.digests = np.zeros((max(capacity, 16), 4), dtype=np.uint64)
        self.values: list[object] = []
        self.live = np.zeros(len(self.digests), dtype=bool)
        self._clear(capacity)

    def _clear(self, capacity: int) -> None:
        buckets = 1
        while buckets * SLOTS * 0.9 < max(capacity, SLOTS):
            buckets *= 2
        self.fingerprints = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.entries = np.full((buckets, SLOTS), -1, dtype=np.int64)

    @property
    def size(self) -> int:
        return int(self.live.sum())

    @staticmethod
    def words(keys: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(keys), dtype="<u8").reshape(len(keys), 4)

    def _address(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fingerprint = (words[:, 2] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        return (words[:, 1] & np.uint64(len(self.fingerprints) - 1)).astype(np.int64), fingerprint

    def _other(self, at: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
        mixed = (fingerprint.astype(np.int64) * 0x5BD1E995) >> 7
        return at ^ (mixed & (len(self.fingerprints) - 1))

    def _put(self, at: np.ndarray, fp: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Fill free slots of the buckets ``at``; return the mask of what found none."""
        free = self.fingerprints[at] == 0
        slot = free & (np.cumsum(free, axis=1) == (ranks(at) + 1)[:, None])
        placed = slot.any(axis=1)
        column = slot[placed].argmax(axis=1)
        self.fingerprints[at[placed], column], self.entries[at[placed], column] = fp[placed], entry[placed]
        return ~placed

    def _place(self, entry: np.ndarray) -> bool:
        """Give stored entries their slots; False when some found none (the buckets are then incomplete)."""
        at, fp = self._address(self.digests[entry])
        for _ in range(2):
            left = self._put(at, fp, entry)
            at, fp, entry = self._other(at[left], fp[left]), fp[left], entry[left]
            if not len(at):
                return True
        for kick in range(MAX_KICKS):
            first = ranks(at) == 0  # one eviction a bucket and round
            home, column = at[first], kick % SLOTS
            out_fp, out_entry = self.fingerprints[home, column].copy(), self.entries[home, column].copy()
            self.fingerprints[home, column], self.entries[home, column] = fp[first], entry[first]
            at = np.concatenate([self._other(home, out_fp), at[~first]])
            fp, entry = np.concatenate([out_fp, fp[~first]]), np.concatenate([out_entry, entry[~first]])
            left = self._put(at, fp, entry)
            at, fp, entry = at[left], fp[left], entry[left]
            if not len(at):
                return True
        return False

    def _slots(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and slot of each digest that is live, verified against the stored digests; slot -1 where it is not."""
        at, fp = self._address(words)
        bucket, slot = at.copy(), np.full(len(at), -1, dtype=np.int64)
        for home in (at, self._other(at, fp)):
            rows, columns = np.nonzero(self.fingerprints[home] == fp[:, None])
            same = (self.digests[self.entries[home[rows], columns]] == words[rows]).all(axis=1)
            bucket[rows[same]], slot[rows[same]] = home[rows[same]], columns[same]
        return bucket, slot

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The entry of each digest, -1 where it is not live."""
        bucket, slot = self._slots(self.words(keys))
        return np.where(slot < 0, -1, self.entries[bucket, slot])

    def insert(self, keys: list[bytes], values: list[object]) -> None:
        """Add distinct digests that are not live. On overflow the buckets are doubled and filled again from the stored digests."""
        first, n = len(self.values), len(keys)
        if first + n > len(self.digests):
            more = max(n, len(self.digests))
            self.digests = np.concatenate([self.digests, np.zeros((more, 4), np.uint64)])
            self.live = np.concatenate([self.live, np.zeros(more, bool)])
        self.digests[first : first + n], self.live[first : first + n] = self.words(keys), True
        self.values.extend(values)
        if not self._place(np.arange(first, first + n)):
            capacity = self.fingerprints.size
            while True:
                capacity *= 2
                self._clear(capacity)
                if self._place(np.flatnonzero(self.live)):
                    break

    def delete(self, keys: list[bytes]) -> None:
        """Remove the live ones among distinct digests: their slots become free, their entries are dead."""
        bucket, slot = self._slots(self.words(keys))
        bucket, slot = bucket[slot >= 0], slot[slot >= 0]
        self.live[self.entries[bucket, slot]] = False
        self.fingerprints[bucket, slot], self.entries[bucket, slot] = 0, -1


def ranks(keys: np.ndarray) -> np.ndarray:
    """Position of each row among the rows of the same key."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    starts = np.flatnonzero(new)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return out


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row_no (unique), n_codepoints of the original text, SHA-256 of the normalised text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            raw = text.cast(pa.binary()).to_pylist()
            sha = [hashlib.sha256((t or b"").translate(None, BLANKS)).digest() for t in raw]
            length = pc.fill_null(pc.utf8_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), length, pa.array(sha, pa.binary())],
                names=["doc_id", "row_no", "n_codepoints", "digest"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_number_of(row_col).alias("row_no"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(digest), "doc_id long, row_no long, n_codepoints long, digest binary")


def index_digests(digests: DataFrame, shards: int) -> DataFrame:
    """One row per distinct digest: the row that stays and the number of its copies."""
    # the greatest of (length, -doc_id, -row_no) stays; a null doc_id sorts below any other
    best = F.max(F.struct("n_codepoints", (-F.col("doc_id")).alias("neg_id"), (-F.col("row_no")).alias("neg_row")))
    combined = (
        digests.groupBy("digest", F.pmod(F.col("row_no"), F.lit(SALTS)).alias("salt"))
        .agg(best.alias("best"), F.count(F.lit(1)).alias("copies"))
        .select(
            "digest", "copies", F.col("best.n_codepoints").alias("n_codepoints"), F.col("best.neg_id").alias("neg_id"), F.col("best.neg_row").alias("neg_row"),
            F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard"),
        )
    )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        index = CuckooIndex(1024)
        worst = -float("inf")
        keys = pdf["digest"].tolist()
        rows = [
            (int(copies), (int(n), worst if pd.isna(neg_id) else int(neg_id), int(neg_row)))
            for copies, n, neg_id, neg_row in zip(pdf["copies"], pdf["n_codepoints"], pdf["neg_id"], pdf["neg_row"], strict=True)
        ]
        _, number = np.unique(np.array(keys, dtype="V32"), return_inverse=True)
        turn = ranks(number)  # rows of one digest take turns, so those of a turn are distinct
        for k in range(int(turn.max(initial=-1)) + 1):
            for chunk in np.array_split(own := np.flatnonzero(turn == k), -(-len(own) // 4096)):
                fresh: dict[bytes, tuple] = {}
                beaten = []
                for i, entry in zip(chunk.tolist(), index.find([keys[i] for i in chunk]).tolist(), strict=True):
                    copies, best = rows[i]
                    if entry < 0:
                        fresh[keys[i]] = rows[i]
                        continue
                    known, stays = index.values[entry]
                    if best > stays:  # the row that stood for this text goes, the better one takes its place
                        beaten.append(keys[i])
                        fresh[keys[i]] = (known + copies, best)
                    else:
                        index.values[entry] = (known + copies, stays)
                if beaten:
                    index.delete(beaten)
                if fresh:
                    index.insert(list(fresh), list(fresh.values()))
        live = np.flatnonzero(index.live)
        values = [index.values[i] for i in live]
        return pd.DataFrame({
            "digest": [d.tobytes() for d in index.digests[live]],
            "keep_id": pd.array([None if v[1][1] == worst else -v[1][1] for v in values], dtype="Int64"),
            "keep_row": np.array([-v[1][2] for v in values], dtype=np.int64),
            "group_size": np.array([v[0] for v in values], dtype=np.int64),
        })

    combined = combined.withColumn("neg_id", F.col("neg_id").cast("decimal(20,0)"))  # a nullable long would lose digits as a float
    return combined.groupBy("shard").applyInPandas(merge, "digest binary, keep_id long, keep_row long, group_size long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_shard: int = ROWS_PER_SHARD, row_col: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and row_no for every row of ``docs``."""
    digests = materialise(text_digests(docs, id_col, text_col, row_col))
    shards = max(1, -(-digests.count() // rows_per_shard))
    groups = index_digests(digests, shards).where("group_size > 1")
    return (
        salted_join(digests, groups, "digest", "row_no", "left")
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("keep_row") == F.col("row_no"), F.lit(True)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            "row_no",
        )
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, less copies."""
    docs, row = numbered(docs)
    return without_rows(docs, row, materialise(dedup(docs, id_col, text_col, row_col=row).where("not kept").select("row_no")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents")).drop("row_no")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
