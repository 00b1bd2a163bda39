"""Compression of vectors to a code of one byte for each of four parts, by exact Lloyd rounds over integers.

A part is rescanned against all entries of its codebook only if a bound cannot rule out that its nearest entry has changed. The bound is the distance to the second-nearest entry at
the part's last rescan, kept with the number of that round, its stamp. All codebooks of the history are at hand, so what is
subtracted from the bound is the net displacement between the codebook of the stamp and the present one, the largest over the other entries: the norm of the sum of an entry's
moves, which is at most the sum of their norms that bounds otherwise lose round by round. A part that lies nearer to its entry than half the way
to the next entry needs no rescan either. Bounds have a margin for rounding, squared distances are exact, and what the bounds leave open is scanned, so codes are those of plain rounds.

Scale: a round is two narrow passes: one assigns parts and writes vectors, codes, bounds and stamps to the shared folder, the other adds up the parts of each entry within a
task and sends at most one row for each entry and position. The driver holds the codebooks, 4 x 256 entries for each round whatever the input. Sums over labels are
joined back by salted keys.

Cases: vectors that are null, or hold a null or a component that is not finite, are dropped; null vec_ids come after all others; rows of equal vec_id are taken in the order of
their vectors, for the codebook's start, and coded each. With fewer than 256 vectors, codebooks have so many entries. Empty vectors have parts without components. An empty table, or one of dropped rows
only, gives an empty table. Vectors of different lengths, a length that is no multiple of four, or components whose distances exceed 63 bits are an error. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, salted_join, tidy

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
MARGIN = 1e-9
NO_BOUND = (1 << 63) - 1  # of a codebook of one entry
STATE = "vec_id long, label string, x array<bigint>, codes binary, seconds array<bigint>, stamps binary"
EXACT_BITS = 52


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label (as a string), x: the vectors that count, as integers."""
    v = F.col(vector_col)
    unusable = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(v.isNotNull() & ~unusable)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x"))


def bits_of_distance(x: np.ndarray, entries: np.ndarray) -> int:
    """Bits that hold every squared distance, and every sum on the way to it; a ValueError if the sum over four parts might not fit a long."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)), int(entries.max(initial=0)), -int(entries.min(initial=0)))
    bits = 2 * (most.bit_length() + 1) + max(x.shape[1], 1).bit_length()
    if bits + PARTS.bit_length() > 63:
        raise ValueError("squared distances exceed 63 bits")
    return bits


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Of every row to every entry, exact: by a product of matrices while doubles hold all sums, else by integers."""
    if bits_of_distance(x, entries) <= EXACT_BITS:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for j, entry in enumerate(entries):
        out[:, j] = ((x - entry) ** 2).sum(1)
    return out


class Book:
    """The codebooks of one part, over all rounds, and what the bounds need of them."""

    def __init__(self, history: list[np.ndarray]):
        self.now = history[-1]
        between = np.sqrt(squared_distances(self.now, self.now).astype(np.float64))
        np.fill_diagonal(between, np.inf)
        self.half = between.min(1) / 2
        self.moved = []  # for each stamp: the entry of the largest net displacement, that, and the second largest
        for old in history:
            net = np.sqrt(((self.now - old) ** 2).sum(1).astype(np.float64))
            first = int(net.argmax())
            self.moved.append((first, net[first], np.delete(net, first).max(initial=0.0)))

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry, lower index on ties, its squared distance, and the squared distance of the next one."""
        d = squared_distances(x, self.now)
        nearest = d.argmin(1)
        rows = np.arange(len(x))
        best = d[rows, nearest]
        d[rows, nearest] = NO_BOUND
        return nearest, best, d.min(1)

    def settled(self, codes: np.ndarray, own: np.ndarray, seconds: np.ndarray, stamps: np.ndarray) -> np.ndarray:
        """Which parts surely keep their entry; ``own``: squared distances to it."""
        drift = np.empty(len(codes))
        for stamp in np.unique(stamps):
            first, most, next_most = self.moved[stamp]
            here = stamps == stamp
            drift[here] = np.where(codes[here] == first, next_most, most)
        bound = np.maximum(np.sqrt(seconds.astype(np.float64)) * (1 - MARGIN) - drift * (1 + MARGIN), self.half[codes] * (1 - MARGIN))
        return np.sqrt(own.astype(np.float64)) * (1 + MARGIN) < bound


def assign(x: np.ndarray, books: list[Book], stamp: int, codes: np.ndarray | None = None, seconds: np.ndarray | None = None, stamps: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """codes, seconds, stamps (a row for each vector, a column for each part) by the present codebooks, the squared distances, and how many parts were rescanned."""
    n, width = len(x), x.shape[1] // PARTS
    fresh = codes is None
    codes = np.zeros((n, PARTS), np.int64) if fresh else codes.astype(np.int64)
    seconds = np.zeros((n, PARTS), np.int64) if fresh else seconds.copy()
    stamps = np.zeros((n, PARTS), np.int64) if fresh else stamps.astype(np.int64)
    own, scanned = np.zeros((n, PARTS), np.int64), 0
    for m, book in enumerate(books):
        part = x[:, m * width : (m + 1) * width]
        open_ = np.arange(n)
        if not fresh:
            bits_of_distance(part, book.now)
            own[:, m] = ((part - book.now[codes[:, m]]) ** 2).sum(1)
            open_ = np.flatnonzero(~book.settled(codes[:, m], own[:, m], seconds[:, m], stamps[:, m]))
        codes[open_, m], own[open_, m], seconds[open_, m] = book.scan(part[open_])
        stamps[open_, m] = stamp
        scanned += len(open_)
    return codes, seconds, stamps, own, scanned


def _matrix(column: pa.Array, width: int, kind: str = "int64") -> np.ndarray:
    """A list column, or one of binary values of ``width`` bytes, as rows of a matrix."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if set(np.unique(column.value_lengths().to_numpy(zero_copy_only=False))) - {width}:
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), width)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).reshape(-1), pa.int64()))


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows.astype(np.uint8)], pa.binary())


def assigned(state: DataFrame, history: list[np.ndarray], final: bool = False) -> DataFrame:
    """The next state, or, if ``final``, vec_id, label, codes and error."""
    width, stamp = history[0].shape[0] * history[0].shape[2], len(history) - 1
    begun = "codes" in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Book([h[m] for h in history]) for m in range(PARTS)]
        for batch in batches:
            x = _matrix(batch.column(2), width)
            before = (_matrix(batch.column(3), PARTS), _matrix(batch.column(4), PARTS), _matrix(batch.column(5), PARTS)) if begun else ()
            codes, seconds, stamps, own, _ = assign(x, books, stamp, *before)
            if final:
                columns, names = [_bytes(codes), pa.array(own.sum(1), pa.int64())], ["vec_id", "label", "codes", "error"]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=names)
            else:
                columns, names = [_bytes(codes), _lists(seconds), _bytes(stamps)], ["vec_id", "label", "x", "codes", "seconds", "stamps"]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=names)

    return state.mapInArrow(tidy(run), "vec_id long, label string, codes binary, error long" if final else STATE)


def moved(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebook after its entries went to the means, rounded down, of their parts; entries without parts stay."""
    _, entries, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, entries, width + 1), np.int64)
        for batch in batches:
            x, codes = _matrix(batch.column(0), PARTS * width), _matrix(batch.column(1), PARTS)
            for m in range(PARTS if len(x) else 0):
                order = np.argsort(codes[:, m], kind="stable")
                used, first = np.unique(codes[order, m], return_index=True)
                part = np.concatenate([np.ones((len(x), 1), np.int64), x[order, m * width : (m + 1) * width]], axis=1)
                total[m, used] += np.add.reduceat(part, first, axis=0)
        m, e = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(e, pa.int32()), _lists(total[m, e])], names=["part", "entry", "sums"])

    sums = state.select("x", "codes").mapInArrow(tidy(run), "part int, entry int, sums array<bigint>").select("part", "entry", F.posexplode("sums").alias("at", "value"))
    out, count, means = book.copy(), {}, []
    # at most 4 x 256 x (components + 1) rows, whatever the input
    for part, entry, at, value in sums.groupBy("part", "entry", "at").agg(F.sum("value")).collect():
        if at:
            means.append((part, entry, at - 1, value))
        else:
            count[part, entry] = value
    for part, entry, at, value in means:
        out[part, entry, at] = value // count[part, entry]
    return out


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, codes (four bytes), error; and the codebooks, an array of part, entry and position."""
    rows = kept(vectors, id_col, vector_col, label_col)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    width = len(start[0].x) if start else 0
    if width % PARTS:
        raise ValueError(f"vectors of {width} components cannot be cut into {PARTS} equal parts")
    first = np.array([r.x for r in start], np.int64).reshape(len(start), PARTS, width // PARTS).transpose(1, 0, 2)
    if not start:
        return rows.select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")).limit(0), first
    history, state = [np.ascontiguousarray(first)], rows
    for _ in range(rounds):
        state = materialise(assigned(state, history))
        history.append(moved(state, history[-1]))
    return assigned(state, history, final=True), history[-1]


def codebooks_sha256(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` (written) with label_error: the error of all rows of equal label, null being a label."""
    rows = coded.withColumn("label_key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    return salted_join(rows, rows.groupBy("label_key").agg(F.sum("error").alias("label_error")), "label_key", "vec_id").drop("label_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = compress(read_table(spark, sf_dir, "embeddings"))
    rows = with_label_errors(materialise(coded))
    return rows.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(codebooks_sha256(book)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Plain rounds: every part against every entry."""
    distance = "list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v)"
    steps = [
        """k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, * FROM (
          SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0))""",
        f"p AS MATERIALIZED (SELECT r, m, x[m * len(x) // {PARTS} + 1 : (m + 1) * len(x) // {PARTS}] AS v FROM k, range({PARTS}) q(m))",
        f"c0 AS MATERIALIZED (SELECT m, r - 1 AS e, v FROM p WHERE r <= {ENTRIES})",
    ]
    for t in range(ROUNDS + 1):
        nearest = f"SELECT p.r, p.m, min(ROW({distance}, c.e)) AS n FROM p JOIN c{t} c USING (m) GROUP BY p.r, p.m"
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, m, struct_extract(n, 1) AS d, struct_extract(n, 2) AS e FROM ({nearest}))")
        if t < ROUNDS:
            steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT o.m, o.e, coalesce(n.v, o.v) AS v FROM c{t} o LEFT JOIN (
              SELECT m, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS v FROM (
                SELECT m, e, i, CAST(sum(z) AS BIGINT) AS s, count(*) AS n FROM (SELECT m, e, unnest(v) AS z, generate_subscripts(v, 1) AS i FROM a{t} JOIN p USING (r, m)) GROUP BY m, e, i) GROUP BY m, e) n USING (m, e))""")
    return f"""WITH {", ".join(steps)},
     f AS (SELECT r, string_agg(lpad(format('{{:x}}', e), 2, '0'), '' ORDER BY m) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
     h AS (SELECT sha256(string_agg(CAST(CAST(z AS BIGINT) AS VARCHAR), ',' ORDER BY m, e, i)) AS codebooks_sha256 FROM (SELECT m, e, unnest(v) AS z, generate_subscripts(v, 1) AS i FROM c{ROUNDS}))
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (r) CROSS JOIN h"""


ORACLE = _oracle()
