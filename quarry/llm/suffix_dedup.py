"""Suffix-array dedup: remove every byte covered by a string of 200 bytes that also starts anywhere else.

Suffix order is needed only where texts may repeat, so the corpus is cut, without loss, into small groups of strings:

1. Equal texts. Texts that occur more than once are represented by one of them, which counts as repeated; the others take
   no further part, as every one of their strings starts elsewhere too.
2. Anchors. Of the 40-byte substrings of a 200-byte string the one with the least hash is its anchor (leftmost on ties), so
   equal strings have equal anchors at equal offsets. Anchors whose hash occurs once in the corpus go.
3. Tiles. The starts that share an anchor are cut, by their distance to it, into tiles of ``WIDTH`` = 16. All strings that start
   in a tile contain the same 185 bytes, its core. The hash of the core is the group key. The core counts as one
   symbol; what is left of a tile are up to 15 bytes before and after it, and a 200-byte string is one of 16 symbols.
4. Suffix arrays. The distinct tiles of a group are laid end to end and their suffixes
   sorted by the linear grouping construction: suffixes are grouped by Lyndon prefix, groups are processed in descending order, the
   suffixes that previous-smaller pointers lead to move to new groups, and a second pass emits each group's order. Neighbours in that order
   with a common prefix of 16 symbols or more, and tiles that occur more than once, are repeated.
5. The repeated starts of a document become spans, which are cut out of its text.

Anchors and cores are compared as 64-bit hashes.

Scale: texts are read four times and shuffled only where the lists that join them are no longer small (``BROADCAST_ROWS``,
``BROADCAST_ITEMS``). Anchors and tiles cross one exchange each, in which every task streams sorted groups. What repeats within a
block of texts, or within a task, is known to repeat: it takes a key of its own document and leaves one row a block, and two a task, under the common
key (``Seen``), so a line or passage that a third of all texts hold does not gather in one task. A tile with copies is resolved by that alone and its
rows are not held. Groups of more than ``HOT_TILES`` distinct tiles are not
sorted in a task: their strings are counted natively by (key, start, bytes before, bytes after), with partial aggregation.

Cases: null text is empty; very long texts are blocks of their own, whole; texts under 200 bytes keep all bytes; repeated rows are repeats of each other; an empty table gives an
empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, numbered, read_table, salted_join, tidy

LENGTH = 200
GRAM = 40
WINDOW = LENGTH - GRAM + 1
WIDTH = 16
CORE = LENGTH - WIDTH + 1
HOT_TILES = 4096
BROADCAST_ROWS, BROADCAST_ITEMS = 1_000_000, 16_000_000
BATCH_BYTES = 1 << 20

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def suffix_array(s: list[int]) -> list[int]:
    """Suffixes of ``s`` in order, by grouping; the last symbol must be the unique smallest."""
    n = len(s)
    members: list[dict[int, None]] = []
    group = [0] * n
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        by_symbol.setdefault(c, []).append(i)
    for c in sorted(by_symbol):
        for i in by_symbol[c]:
            group[i] = len(members)
        members.append(dict.fromkeys(by_symbol[c]))
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    done = bytearray(n)
    previous = [-1] * n
    at = len(members) - 1
    while at >= 0:
        # the nearest position to the left whose group is lower, for each member; these never go back
        targets: dict[int, int] = {}
        for i in members[at]:
            done[i] = 1
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                targets[p] = targets.get(p, 0) + 1
        # what is led to leaves its group for a new one just above it; the more members lead to it, the higher
        split: dict[tuple[int, int], int] = {}
        counts = sorted(set(targets.values())) if len(targets) > 1 else targets.values()
        for count in reversed(list(counts)):
            for p, c in targets.items():
                if c == count:
                    old = group[p]
                    key = (old, count)
                    new = split.get(key)
                    if new is None:
                        if len(members[old]) == 1:
                            continue  # it would be alone in both
                        new = split[key] = len(members)
                        members.append({})
                        below.append(old)
                        above.append(above[old])
                        if above[old] >= 0:
                            below[above[old]] = new
                        above[old] = new
                    del members[old][p]
                    members[new][p] = None
                    group[p] = new
                    if not members[old]:  # all have moved: the emptied group takes the place of the lowest new one
                        members[old], members[new] = members[new], members[old]
                        for q in members[old]:
                            group[q] = old
                        del split[key]
                        above[old] = above[new]
                        if above[new] >= 0:
                            below[above[new]] = old
                        below[new] = above[new] = -2
        at = below[at]
    low = group[n - 1]
    fill = [0] * len(members)
    start = 0
    while low >= 0:
        fill[low] = start
        start += len(members[low])
        low = above[low]
    out = [-1] * n
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[fill[g]] = j
            fill[g] += 1
            placed[j] = 1
            j = previous[j]
    return out


def common_prefixes(s: list[int], order: list[int]) -> list[int]:
    """Length of the common prefix of each suffix with the one before it in order."""
    n = len(s)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    out = [0] * n
    h = 0
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return out


def repeated_starts(tiles: list[tuple[bytes, bytes, int]]) -> list[int]:
    """For each distinct tile of one group (bytes before and after the core, number of copies): a bit for each repeated start.

    Bit ``a`` stands for the string that begins ``a`` bytes before the core.
    """
    spans = [(WIDTH - 1 - len(right), len(left)) for left, right, _ in tiles]
    masks = [(1 << (high + 1)) - (1 << low) if copies > 1 else 0 for (low, high), (_, _, copies) in zip(spans, tiles, strict=True)]
    if len(tiles) == 1:
        return masks
    lift, core = len(tiles) + 1, len(tiles) + 257
    s, owner = [], []
    for k, (left, right, _) in enumerate(tiles):
        s += [lift + c for c in left] + [core] + [lift + c for c in right] + [k + 1]
        owner += [k] * (len(left) + len(right) + 2)
    s.append(0)
    order = suffix_array(s)
    starts = np.cumsum([0, *(len(left) + len(right) + 2 for left, right, _ in tiles)]).tolist()
    for k, h in enumerate(common_prefixes(s, order)):
        if h >= WIDTH:
            for i in (order[k], order[k - 1]):
                t = owner[i]
                a = spans[t][1] - (i - starts[t])
                if a >= spans[t][0]:
                    masks[t] |= 1 << a
    return masks


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return powers(BASE), powers(INVERSE)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Block:
    """Several texts laid end to end: for every start of a 200-byte string the position of its anchor."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"".join(texts)
        n = len(self.raw)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.cumsum(sizes) - sizes
        starts = np.maximum(sizes - LENGTH + 1, 0)
        self.text_of = np.repeat(np.arange(len(texts)), starts)
        ends = np.cumsum(starts)
        self.starts = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - starts, starts) + np.repeat(self.offsets, starts)
        up, self.down = _powers(1 << max(20, int(n).bit_length()))
        terms = (np.frombuffer(self.raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        if not len(self.starts):
            self.anchor = self.starts
            return
        grams = n - GRAM + 1
        hashes = _mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[:grams])
        # the same 32 bits of a hash whatever else the block holds, so equal strings have equal anchors; then the leftmost position
        packed = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(grams, dtype=np.uint64)
        # least of every WINDOW neighbours: the least of a block's end and of the next block's beginning
        rows = -(-grams // WINDOW) + 1
        grid = np.full(rows * WINDOW, np.uint64(0xFFFFFFFFFFFFFFFF))
        grid[:grams] = packed
        grid = grid.reshape(rows, WINDOW)
        head = np.minimum.accumulate(grid, axis=1).reshape(-1)
        tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(tail[self.starts], head[self.starts + WINDOW - 1])
        self.anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def hash(self, at: np.ndarray, length: int) -> np.ndarray:
        return _mix((self.sums[at + length] - self.sums[at]) * self.down[at])

    def runs(self) -> np.ndarray:
        """Index of the first start of each (text, anchor)."""
        new = np.ones(len(self.anchor), dtype=bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.text_of[1:] != self.text_of[:-1])
        return np.flatnonzero(new)


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, Block]]:
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > BATCH_BYTES:
            yield first, Block(texts[first:k])
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, Block(texts[first:])


def _raw(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _rows(docs: DataFrame, id_col: str, text_col: str, row_col: str) -> DataFrame:
    return docs.select(F.col(row_col).alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def equal_texts(rows: DataFrame) -> DataFrame:
    """(row_no, representative) of the texts that occur more than once."""
    keys = rows.where("text is not null").select("row_no", F.unhex(F.sha2("text", 256)).alias("k"))
    groups = keys.groupBy("k").agg(F.min("row_no").alias("representative"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return salted_join(keys, groups, "k", "row_no").select("row_no", "representative")


def _spread(key: np.ndarray, known: np.ndarray, row_no: np.ndarray) -> np.ndarray:
    """What is known to repeat and is not needed under its key any more is dealt out by its document."""
    return np.where(known, _mix(row_no.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), key).view(np.int64)


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a value occurs more than once, and whether it is not the first of its kind."""
    _, first, where, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(key), dtype=bool)
    later[first] = False
    return counts[where] > 1, later


class Seen:
    """Which keys a task has met in two blocks before; a table of fixed size that may forget, never invent.

    The first two blocks with a key leave it under the key, where they repeat each other, as does any other task's; further ones need not go there, so
    a task sends two rows a key, however many of its texts hold a line. What is forgotten only costs rows.
    """

    def __init__(self, slots: int = 1 << 20):
        self.key, self.times = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.uint8)

    def twice(self, key: np.ndarray) -> np.ndarray:
        """For distinct keys of a block: whether two earlier blocks had them; the block then counts."""
        at = (key >> np.uint64(20)) & np.uint64(len(self.key) - 1)
        same = self.key[at] == key
        out = same & (self.times[at] >= 2)
        self.times[at] = np.where(same, np.minimum(self.times[at], 254) + 1, 1)
        self.key[at] = key
        return out


def _needless(key: np.ndarray, later: np.ndarray, seen: Seen) -> np.ndarray:
    """What need not go under its key: all but the first in its block, and that one if two earlier blocks of the task had the key."""
    out = later.copy()
    first = np.flatnonzero(~later)
    out[first] = seen.twice(key[first])
    return out


def anchors(rows: DataFrame) -> DataFrame:
    """(key, known, row_no, at) of every anchor of every text; at: its byte position; known: repeated in its block or task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            row_no = batch.column(0).to_numpy()
            for first, block in _blocks(_raw(batch.column(1))):
                at = block.runs()
                text, position = block.text_of[at], block.anchor[at]
                key, owner = block.hash(position, GRAM), row_no[first + text]
                known, later = _repeats(key)
                needless = _needless(key, later, seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_spread(key, needless, owner)), pa.array(known | needless), pa.array(owner), pa.array((position - block.offsets[text]).astype(np.int32))], names=["key", "known", "row_no", "at"]
                )

    return rows.select("row_no", "text").mapInArrow(tidy(run), "key long, known boolean, row_no long, at int")


def repeated_anchors(found: DataFrame) -> DataFrame:
    """(row_no, at) of the anchors that are known to repeat or have a neighbour of the same key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, until its successor is seen
        for batch in batches:
            if not batch.num_rows:
                continue
            key, known, row_no, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if held is not None:
                key, known, row_no, at = (np.concatenate([h, x]) for h, x in zip(held, (key, known, row_no, at), strict=True))
            same = key[1:] == key[:-1]
            known = known.copy()
            known[1:] |= same
            known[:-1] |= same
            held = tuple(x[-1:] for x in (key, known, row_no, at))
            out = np.flatnonzero(known[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(row_no[out]), pa.array(at[out])], names=["row_no", "at"])
        if held is not None and held[1][0]:
            yield pa.RecordBatch.from_arrays([pa.array(held[2]), pa.array(held[3])], names=["row_no", "at"])

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "row_no long, at int")


def tiles(rows: DataFrame) -> DataFrame:
    """(key, before, after, copies, row_no, at) of every tile at one of the row's ``anchors``; at: byte position of the core.

    A tile that occurs again in its block, or in a text that occurs again, has two copies; before is null where a
    tile is dealt out by its document because earlier ones stand for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            row_no, wanted, copied = batch.column(0).to_numpy(), batch.column(2), batch.column(3).to_numpy(zero_copy_only=False)
            for first, block in _blocks(_raw(batch.column(1))):
                own = wanted.slice(first, len(block.offsets))
                lengths = own.value_lengths().to_numpy()
                shared = np.sort(own.flatten().to_numpy().astype(np.int64) + np.repeat(block.offsets, lengths))
                hit = np.searchsorted(shared, block.anchor)
                use = np.flatnonzero(shared[np.minimum(hit, len(shared) - 1)] == block.anchor) if len(shared) else np.zeros(0, np.int64)
                start, anchor, text = block.starts[use], block.anchor[use], block.text_of[use]
                tile, ahead = (anchor - start) // WIDTH, (anchor - start) % WIDTH
                new = np.ones(len(use), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (tile[1:] != tile[:-1]) | (text[1:] != text[:-1])
                head = np.flatnonzero(new)
                last = np.append(head[1:], len(use)) - 1
                core = anchor[head] - WIDTH * tile[head]
                key = _mix(block.hash(core, CORE) + tile[head].astype(np.uint64))
                size = (start[last] + LENGTH - start[head]).astype(np.uint64)
                whole = _mix((block.sums[start[last] + LENGTH] - block.sums[start[head]]) * block.down[start[head]] + size) ^ key
                known, later = _repeats(whole)
                later = _needless(whole, later, seen)
                owner = row_no[first + text[head]]
                raw = block.raw
                low, high, c = ahead[last].tolist(), ahead[head].tolist(), core.tolist()
                before = [raw[x - h : x] for x, h in zip(c, high, strict=True)]
                after = [raw[x + CORE : x + LENGTH - a] for x, a in zip(c, low, strict=True)]
                for k in np.flatnonzero(later).tolist():  # lengths are enough for its mask
                    before[k], after[k] = None, bytes((low[k], high[k]))
                copies = 1 + (known | copied[first + text[head]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_spread(key, later, owner)), pa.array(before, pa.binary()), pa.array(after, pa.binary()), pa.array(copies), pa.array(owner), pa.array((core - block.offsets[text[head]]).astype(np.int32))],
                    names=["key", "before", "after", "copies", "row_no", "at"],
                )

    return rows.select("row_no", "text", "anchors", "copied").mapInArrow(tidy(run), "key long, before binary, after binary, copies int, row_no long, at int")


RESOLVED = "row_no long, place long, key long, before binary, after binary, copies int"


def sort_groups(found: DataFrame, hot_tiles: int = HOT_TILES) -> DataFrame:
    """(row_no, place) of the tiles with repeated starts; place: position of the core and a bit for each start, ``at << 16 | mask``.

    Groups stream through a task in order of their key. Of a tile with copies all starts repeat, so its rows leave at once and only the tile is held;
    what is held of a group is bounded by ``hot_tiles``. Single tiles of hot groups come out unresolved, with their bytes and the mask 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple[bytes, bytes], tuple[int, int] | None] = {}  # the row of a single tile, None for a tile with copies
        state = {"key": None, "hot": False}
        out: list[tuple] = []

        def emit(row_no: int, at: int, mask: int) -> None:
            out.append((row_no, at << 16 | mask, None, None, None, None))

        def unresolved(tile: tuple[bytes, bytes], row: tuple[int, int] | None, copies: int) -> None:
            # a tile with copies is resolved; it only lends its strings to the others, under no row
            out.append((row[0] if row else -1, (row[1] if row else 0) << 16, state["key"], *tile, copies))

        def close() -> None:
            if len(group) > 1 and not state["hot"]:
                found = list(group.items())
                masks = repeated_starts([(*tile, 2 if row is None else 1) for tile, row in found])
                for mask, (_, row) in zip(masks, found, strict=True):
                    if mask and row is not None:
                        emit(*row, mask)
            group.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 6
            out.clear()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RESOLVED.split(", ")])

        for batch in batches:
            for key, before, after, copies, row_no, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if before is None:
                    low, high = after
                    out.append((row_no, at << 16 | (1 << (high + 1)) - (1 << low), None, None, None, None))
                    continue
                if key != state["key"]:
                    close()
                    state["key"], state["hot"] = key, False
                tile, whole = (before, after), (1 << (len(before) + 1)) - (1 << (WIDTH - 1 - len(after)))
                if copies > 1:
                    emit(row_no, at, whole)
                if state["hot"]:
                    unresolved(tile, None if copies > 1 else (row_no, at), copies)
                    continue
                if tile not in group:
                    group[tile] = None if copies > 1 else (row_no, at)
                else:
                    if (row := group[tile]) is not None:
                        emit(*row, whole)
                    if copies == 1:
                        emit(row_no, at, whole)
                    group[tile] = None
                if len(group) > hot_tiles:
                    for own, row in group.items():
                        unresolved(own, row, 2 if row is None else 1)
                    group.clear()
                    state["hot"] = True
            yield flush()
        close()
        yield flush()

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), RESOLVED)


def count_hot(tile: DataFrame) -> DataFrame:
    """(row_no, place) of the unresolved tiles with repeated starts: their strings are counted one by one."""
    a = F.explode(F.sequence(WIDTH - 1 - F.octet_length("after"), F.octet_length("before")))
    one = tile.withColumn("a", a).withColumns({
        "own_before": F.expr("substring(before, octet_length(before) - a + 1, a)"),
        "own_after": F.expr(f"substring(after, 1, {WIDTH - 1} - a)"),
    })
    key = ["key", "a", "own_before", "own_after"]
    twice = one.groupBy(*key).agg(F.sum("copies").alias("n")).where("n > 1").select(*key)
    return one.where("row_no >= 0").join(twice, key, "left_semi").groupBy("row_no", "place").agg(F.expr("bit_or(shiftleft(1, cast(a AS int)))").alias("mask")).select("row_no", (F.col("place") + F.col("mask")).alias("place"))


def merge_starts(places: np.ndarray) -> list[int]:
    """Maximal runs of covered bytes, as starts and ends in turn."""
    core, mask = places >> 16, places & 0xFFFF
    begins = np.unique(np.concatenate([core[(mask >> a & 1) > 0] - a for a in range(WIDTH)]))
    new = np.ones(len(begins), dtype=bool)
    new[1:] = begins[1:] > begins[:-1] + LENGTH
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(begins)) - 1
    return np.stack([begins[head], begins[last] + LENGTH], axis=1).reshape(-1).tolist() if len(begins) else []


def document_spans(starts: DataFrame) -> DataFrame:
    """(row_no, cuts, n_items) from (row_no, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [merge_starts(p.values.to_numpy()) for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cuts, pa.list_(pa.int32())), pa.array(map(len, cuts), pa.int32())], names=["row_no", "cuts", "n_items"])

    return starts.groupBy("row_no").agg(F.collect_list("place").alias("places")).mapInArrow(tidy(run), "row_no long, cuts array<int>, n_items int")


def _to_rows(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Join lists to the texts by row_no; broadcast behind a check of their number and length."""
    n, items = lists.agg(F.count(F.lit(1)), F.sum("n_items")).first()
    lists = lists.drop("n_items")
    return rows.join(F.broadcast(lists) if n <= BROADCAST_ROWS and (items or 0) <= BROADCAST_ITEMS else lists, "row_no", how)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_tiles: int = HOT_TILES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct<start, end>> of every row."""
    docs, row_col = numbered(docs.select(id_col, text_col))
    rows = _rows(docs, id_col, text_col, row_col)
    twins = materialise(equal_texts(rows))
    small = twins.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else lambda x: x
    found = anchors(rows).join(hint(twins.where("row_no <> representative").select("row_no")), "row_no", "left_anti")
    places = repeated_anchors(found.select("key", "known", "row_no", "at")).groupBy("row_no").agg(F.collect_list("at").alias("anchors"))
    places = places.join(hint(twins.where("row_no = representative").select("row_no", F.lit(True).alias("copied"))), "row_no", "left")
    places = places.select("row_no", "anchors", F.coalesce("copied", F.lit(False)).alias("copied"), F.size("anchors").alias("n_items"))
    resolved = materialise(sort_groups(tiles(_to_rows(rows, materialise(places), "inner")), hot_tiles))
    starts = resolved.where("key is null").select("row_no", "place").unionByName(count_hot(resolved.where("key is not null")))
    cuts = document_spans(starts.join(hint(twins.select("row_no")), "row_no", "left_anti"))
    # a text that occurs more than once is covered whole
    cuts = cuts.unionByName(twins.select("row_no", F.array(F.lit(0), F.lit(-1)).alias("cuts"), F.lit(2).alias("n_items")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, own in zip(_raw(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if own and own[-1] == -1:
                    own = [0, len(raw)] if len(raw) >= LENGTH else []
                ends = [0, *(own or []), len(raw)]
                kept = b"".join(raw[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2))
                spans = [{"start": s, "end": e} for s, e in zip(ends[1:-1:2], ends[2:-1:2], strict=True)]
                out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    joined = _to_rows(rows, materialise(cuts), "left").select("doc_id", "text", "cuts")
    return joined.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents")).drop("spans")
