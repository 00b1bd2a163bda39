"""Packing of documents into token sequences by deficit round-robin over source queues.

Each source is a queue of its documents' tokens, in the order of the table. A round of ``WINDOW`` tokens credits every queue with its share of the window; a
queue is served a quantum once its credit covers it, and what is left of the credit, or was served ahead of it, is carried to the
next round. Rounds laid end to end and cut every ``WINDOW`` tokens are the sequences, so each is full and holds the target proportions
to within a quantum of each source. Quanta are of at least ``MIN_QUANTUM`` tokens, so that rare sources are served in later rounds rather than in
scraps; where in its first rounds a queue starts is a hash of its name, so that many small sources do not meet in one round.

Since credit grows by the same amount each round, the round of the v-th quantum of a queue follows from v alone, and deficits need no state that passes from task to
task: the place of a token in its queue says in which round it is served. Places are prefix sums: of each source within a task as texts are encoded, then over the
totals of tasks. The place of a quantum among all tokens is a prefix sum within blocks of ``ROUNDS_PER_BLOCK`` rounds, then over blocks, in two levels.

A queue that ends before others is passed over from then on, and the others fill the windows by their own proportions. The tokens that are left for the last window are cut into
sequences of powers of two, which need no padding.

Scale: token ids are written once, as bytes, and shuffled once, to meet the pieces of their document. All other shuffles are of a few numbers for each piece. Nothing is
broadcast by hint, and no step gathers a source. A document's ids must fit a row.

Cases: null text counts as empty, so a document is its end token alone; a null source is the queue of the empty name. Null and repeated doc_ids
are rows of their own. An empty table gives an empty table. Other columns are not looked at. Very long texts are encoded whole and cut into pieces like any other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, parts, read_table, tidy

VOCABULARY = "byte_bpe_50k.json"
WINDOW = 2048
MIN_QUANTUM = 256
ROUNDS_PER_BLOCK = 1024
BLOCKS_PER_GROUP = 4096
END = 1  # the id after each document
PART_BYTES = 4 << 20


@lru_cache(maxsize=2)
def encoder(path: str):
    """An encoder over the vocabulary of a byte-level ``tokenizers`` file, whose ids are in the order of its merges."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        known = json.load(file)
    special = {token["content"] for token in known["added_tokens"]}
    # such files write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    ranks = {bytes(map(byte.__getitem__, token)): i for token, i in known["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """row_no, doc_id, source, ids (little-endian, 32 bits each, the end token included), n, task, and before: tokens of this source earlier in the task.

    Written once by ``sequences``: row_no and before depend on how the table was split.
    """
    end = END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, served = TaskContext.get().partitionId(), 0, {}
        encode = encoder(path).encode_to_numpy
        for batch in batches:
            for part in parts(batch, 1, PART_BYTES):
                ids = [encode(text or "", disallowed_special=()).astype("<u4").tobytes() + end for text in part.column(1).to_pylist()]
                sizes, before = [len(x) // 4 for x in ids], []
                for source, n in zip(part.column(2).to_pylist(), sizes, strict=True):
                    before.append(served.get(source, 0))
                    served[source] = before[-1] + n
                numbers = range((task << 33) + row, (task << 33) + row + len(ids))
                columns = [numbers, None, None, ids, sizes, [task] * len(ids), before]
                kinds = [pa.int64(), None, None, pa.binary(), pa.int64(), pa.int32(), pa.int64()]
                arrays = [part.column(0 if k == 1 else 2) if c is None else pa.array(c, t) for k, (c, t) in enumerate(zip(columns, kinds))]
                yield pa.RecordBatch.from_arrays(arrays, names=["row_no", "doc_id", "source", "ids", "n", "task", "before"])
                row += len(ids)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    return rows.toDF("doc_id", "text", "source").mapInArrow(tidy(run), "row_no long, doc_id long, source string, ids binary, n long, task int, before long")


def queues(lengths: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """source, quantum, step (rounds from one quantum to the next), phase.

    ``targets``: token proportions of sources, by default their shares of all tokens, with which all queues end together. Sources that are not
    named divide what the named ones leave, by their tokens; that must then be more than nothing.
    """
    targets = targets or {}
    if any(share <= 0 for share in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("targets must be positive and add up to 1 at most")
    sources = lengths.groupBy("source").agg(F.sum("n").alias("total"))
    rest, others = max(0.0, 1 - sum(targets.values())), ~F.col("source").isin(*targets) if targets else F.lit(True)
    unnamed = sources.where(others).agg(F.sum("total")).first()[0] or 0
    if unnamed and rest <= 1e-9:
        raise ValueError("targets leave nothing for sources that they do not name")
    share = F.lit(rest) * F.col("total") / F.lit(float(unnamed or 1))
    for name, value in targets.items():
        share = F.when(F.col("source") == name, F.lit(float(value))).otherwise(share)
    credit = share * WINDOW
    quantum = F.greatest(F.lit(MIN_QUANTUM), F.floor(credit)).cast("long")
    phase = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return sources.select("source", quantum.alias("quantum"), (quantum / credit).alias("step"), phase.alias("phase"))


def running(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``rows``, a row for each long ``key``, with ``out``: the sum of ``value`` over smaller keys. Sums within groups of keys meet the sums of groups."""
    group = F.expr(f"{key} div {BLOCKS_PER_GROUP}")
    rows = rows.withColumn("_group", group)
    before = lambda c, w: F.sum(c).over(w) - F.col(c)
    totals = rows.groupBy("_group").agg(F.sum(value).alias("_total"))
    totals = totals.select("_group", before("_total", Window.partitionBy(F.lit(0)).orderBy("_group")).alias("_base"))
    within = rows.withColumn("_within", before(value, Window.partitionBy("_group").orderBy(key)))
    return within.join(totals, "_group").withColumn(out, F.col("_base") + F.col("_within")).drop("_group", "_base", "_within")


def placed(lengths: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """row_no, start, length, place: pieces of documents, one for each quantum they have a part in, and where each begins among all tokens."""
    tasks = lengths.groupBy("source", "task").agg(F.sum("n").alias("served"))
    base = F.sum("served").over(Window.partitionBy("source").orderBy("task")) - F.col("served")
    tasks = tasks.withColumn("base", base).drop("served").join(queues(lengths, targets), "source")
    docs = lengths.join(tasks, ["source", "task"]).withColumn("first", F.col("base") + F.col("before"))
    visits = F.sequence(F.expr("first div quantum"), F.expr("(first + n - 1) div quantum"))
    cut = docs.select("row_no", "source", "first", "n", "quantum", "step", "phase", F.explode(visits).alias("visit"))
    begin = F.greatest("first", F.col("visit") * F.col("quantum"))
    stop = F.least(F.col("first") + F.col("n"), (F.col("visit") + 1) * F.col("quantum"))
    turn = F.floor((F.col("visit") + F.col("phase")) * F.col("step")).cast("long")
    pieces = cut.select("row_no", "source", turn.alias("turn"), begin.alias("begin"), (begin - F.col("first")).alias("start"), (stop - begin).alias("length"))
    pieces = pieces.withColumn("block", F.expr(f"turn div {ROUNDS_PER_BLOCK}"))
    blocks = running(pieces.groupBy("block").agg(F.sum("length").alias("size")), "block", "size", "ahead").drop("size")
    order = Window.partitionBy("block").orderBy("turn", "source", "begin")
    within = pieces.withColumn("within", F.sum("length").over(order) - F.col("length"))
    return within.join(blocks, "block").select("row_no", "start", "length", (F.col("ahead") + F.col("within")).alias("place"))


def cut_at_windows(pieces: DataFrame, total: int) -> DataFrame:
    """row_no, start, length, sequence_id, offset: pieces of ``placed`` cut where sequences end; ``total``: tokens of all."""
    full = total // WINDOW
    lo, tail = full * WINDOW, []
    for bit in range(WINDOW.bit_length() - 1, -1, -1):
        if (total - full * WINDOW) >> bit & 1:
            tail.append((full + len(tail), lo, lo + (1 << bit)))
            lo += 1 << bit
    span = lambda i, a, b: F.struct(i.cast("long").alias("id"), a.cast("long").alias("lo"), b.cast("long").alias("hi"))
    stop = F.col("place") + F.col("length")
    last = F.least(F.expr(f"(place + length - 1) div {WINDOW}"), F.lit(full - 1))
    first = F.expr(f"place div {WINDOW}")
    spans = F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>")), lambda w: span(w, w * WINDOW, (w + 1) * WINDOW))
    if tail:
        ends = F.filter(F.array(*(span(*map(F.lit, t)) for t in tail)), lambda s: (s["lo"] < stop) & (s["hi"] > F.col("place")))
        spans = F.when(stop > full * WINDOW, F.concat(spans, ends)).otherwise(spans)
    at = pieces.select("row_no", "start", "length", "place", F.explode(spans).alias("s"))
    begin = F.greatest("place", "s.lo")
    length = F.least(F.col("place") + F.col("length"), F.col("s.hi")) - begin
    return at.select(
        "row_no", (F.col("start") + begin - F.col("place")).alias("start"), length.alias("length"),
        F.col("s.id").alias("sequence_id"), (begin - F.col("s.lo")).alias("offset"),
    )


def joined(pieces: DataFrame) -> DataFrame:
    """row_no and pieces, a document's pieces in order as an array; pieces that follow each other in document and sequence are one."""
    kind = "array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>"
    each = pieces.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("p"))

    def follows(p: Column, i: Column) -> Column:
        q = F.get(F.col("p"), i - 1)
        return F.coalesce((q["sequence_id"] == p["sequence_id"]) & (q["offset"] + q["length"] == p["offset"]), F.lit(False))

    heads = F.filter("p", lambda p, i: ~follows(p, i))
    # a piece reaches to the next that is kept, or to the end of the document
    upto = lambda i: F.coalesce(F.get(F.col("h"), i + 1)["start"], F.col("n"))
    last = F.element_at("p", -1)
    each = each.select("row_no", heads.alias("h"), (last["start"] + last["length"]).alias("n"))
    whole = F.transform("h", lambda p, i: F.struct(p["start"].alias("start"), (upto(i) - p["start"]).alias("length"), p["sequence_id"].alias("sequence_id"), p["offset"].alias("offset")))
    return each.select("row_no", whole.cast(kind).alias("pieces"))


def sequences(docs: DataFrame, path: str, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, start, length, doc_tokens, sequence_id, offset, ids (little-endian, 32 bits each): every piece of every document and its place in a sequence."""
    encoded = materialise(tokens(docs, path, id_col, text_col, source_col))
    lengths = encoded.select("row_no", "source", "n", "task", "before")
    total = lengths.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pieces = joined(cut_at_windows(placed(lengths, targets), total))
    # the lists are the side to keep in memory: a partition of them is numbers only
    met = encoded.select("row_no", "doc_id", "source", "n", "ids").join(pieces.hint("shuffle_hash"), "row_no")
    part = lambda p: F.substring(F.col("ids"), (p["start"] * 4 + 1).cast("int"), (p["length"] * 4).cast("int"))
    parts = F.transform("pieces", lambda p: F.struct(p.alias("p"), part(p).alias("ids")))
    rows = met.select("doc_id", "source", F.col("n").alias("doc_tokens"), F.explode(parts).alias("x"))
    return rows.select("doc_id", "source", "x.p.start", "x.p.length", "doc_tokens", "x.p.sequence_id", "x.p.offset", "x.ids")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = sequences(read_table(spark, sf_dir, "documents"), vocabulary_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
