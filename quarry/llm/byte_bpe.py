"""Byte-level BPE encoding and decoding, vectorised over Arrow batches.

Pre-tokenisation works without a regular expression. Each code point gets a class; a class (with two
code points of look-ahead for contractions) stands for a transition function over five scanner states.
Functions compose associatively, so a blocked prefix scan over a composition table gives the state
before every code point of a whole batch at once, and from states and classes follow all token starts.
The slices feed pair merging, whose results are cached per slice. The character offsets of the slices are kept: decoding counts the code points
that begin in each token, checks that every slice begins where its offset says, and so maps tokens back to places in the text.

Scale: one narrow pass, no shuffle, nothing broadcast but the path of the rank file, which must exist on every executor; each Python worker
loads the ranks once. The cache is cleared at a fixed size and when a task ends, so memory is bounded. Very long slices are
merged with a heap in O(n log n).

Cases: null text counts as empty (no ids); other columns are not looked at; repeated rows are encoded
each; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts, read_table, tidy

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_SIZE = 100_000
BATCH_CHARS = 1_000_000

# code point classes
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE1, QUOTE2 = range(7)
# scanner states before a code point
CLOSED, OPEN, ENDED, TAKE1, TAKE2 = range(5)  # OPEN: a run of OTHER goes on here; TAKEn: n letters belong to a contraction
STATES = 5

#: White_Space of Unicode, fixed values
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _class_of_codepoints() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            kinds[cp] = LETTER
        elif major == "N":
            kinds[cp] = NUMBER
    kinds[WHITE_SPACE] = BLANK
    kinds[32] = SPACE
    return kinds


def _step(state: int, kind: int) -> int:
    """The state after a code point of ``kind``. A blank here is one that ends no pending token."""
    if kind in (LETTER, NUMBER):
        return {TAKE2: TAKE1, TAKE1: ENDED}.get(state, CLOSED)
    if kind == OTHER or (kind in (QUOTE1, QUOTE2) and state == OPEN):
        return OPEN
    if kind == SPACE:  # may be the first character of the next token
        return OPEN
    if kind == BLANK:
        return CLOSED
    return TAKE1 if kind == QUOTE1 else TAKE2


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the class functions: their values, composition table, index of each class, of each class after a text start."""
    plain = [tuple(_step(s, k) for s in range(STATES)) for k in range(7)]
    fresh = [(f[CLOSED],) * STATES for f in plain]
    known = {f: i for i, f in enumerate(dict.fromkeys([*plain, *fresh]))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in list(known):
            for h in (tuple(g[f[s]] for s in range(STATES)), tuple(f[g[s]] for s in range(STATES))):
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
    values = np.array(list(known), dtype=np.uint8)
    index = {tuple(v): i for i, v in enumerate(values.tolist())}
    compose = np.array([[index[tuple(g[x] for x in f)] for g in values.tolist()] for f in values.tolist()], dtype=np.int16)
    return values, compose, np.array([known[f] for f in plain], np.int16), np.array([known[f] for f in fresh], np.int16)


def _scan(functions: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions, blocked: within columns of a matrix, then over the columns' totals."""
    n = len(functions)
    if n <= 64:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], out[i]]
        return out
    width = 1 << max(3, (n.bit_length() + 1) // 2 - 2)
    blocks = -(-n // width)
    padded = np.full(blocks * width, functions[-1], dtype=functions.dtype)
    padded[:n] = functions
    grid = np.ascontiguousarray(padded.reshape(blocks, width).T)
    for i in range(1, width):
        grid[i] = compose[grid[i - 1], grid[i]]
    carry = _scan(grid[-1], compose)
    grid[:, 1:] = compose[carry[None, :-1], grid[:, 1:]]
    return grid.T.reshape(-1)[:n]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    return _class_of_codepoints()


def token_starts(codepoints: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions where a slice begins, over several texts laid end to end.

    ``text_starts``: the positions at which non-empty texts begin. Equals the matches of the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    n = len(codepoints)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = _classes()[codepoints]
    first = np.zeros(n + 2, dtype=bool)
    first[text_starts] = True
    first[n:] = True

    quote = np.flatnonzero(codepoints == 39)
    if len(quote):  # look-ahead of a contraction stays within the text
        ahead = np.concatenate([codepoints, np.zeros(2, codepoints.dtype)])
        a, b = ahead[quote + 1], ahead[quote + 2]
        a = np.where(first[quote + 1], 0, a)
        b = np.where(first[quote + 1] | first[quote + 2], 0, b)
        kind[quote[np.isin(a, [ord(c) for c in "stmd"])]] = QUOTE1
        pair = a.astype(np.int64) * 1024 + b
        kind[quote[np.isin(pair, [ord(p[0]) * 1024 + ord(p[1]) for p in ("re", "ve", "ll")])]] = QUOTE2

    values, compose, plain, fresh = _monoid()
    function = plain[kind]
    function[text_starts] = fresh[kind[text_starts]]
    after = values[_scan(function, compose), CLOSED]
    before = np.empty(n, dtype=np.uint8)
    before[0] = CLOSED
    before[1:] = after[:-1]
    before[text_starts] = CLOSED

    blank = (kind == BLANK) | (kind == SPACE)
    previous = np.empty(n, dtype=np.uint8)
    previous[0] = BLANK
    previous[1:] = kind[:-1]
    begins = first[:n]
    after_blank = (previous == BLANK) | (previous == SPACE)
    last_blank = blank & ~first[1 : n + 1]  # followed by a character that is not white space
    last_blank[:-1] &= ~blank[1:]
    starts = np.where(blank, begins | ~after_blank | last_blank, False)
    visible = ~blank
    letter, number = kind == LETTER, kind == NUMBER
    taken = (before == TAKE1) | (before == TAKE2)
    run = (letter & (previous == LETTER)) | (number & (previous == NUMBER))
    starts |= (letter | number) & ~taken & (~run | (before == ENDED)) & (previous != SPACE)
    starts |= visible & ~letter & ~number & (before != OPEN)
    starts |= begins
    return np.flatnonzero(starts)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encoder and decoder over a rank file."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        #: (left id << 20 | right id) -> id of the merged token, for every way to cut a token in two
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[(left << 20) | right] = rank
        self.names = [str(i) for i in range(len(self.tokens))]
        self.cache: dict[str, bytes] = {}  # slice -> its ids as int32; values without pointers keep lookups cheap
        #: code points that begin in each token
        self.leads = np.array([sum(b & 0xC0 != 0x80 for b in t) for t in self.tokens], dtype=np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the adjacent pair of lowest rank is merged first, leftmost on ties."""
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        if len(piece) > 100:
            return self._merge_long(piece)
        get, none = self.pairs.get, 1 << 30
        parts = [self.single[b] for b in piece]
        pair = [get((a << 20) | b, none) for a, b in zip(parts, parts[1:])]
        while pair and (low := min(pair)) != none:
            i = pair.index(low)
            parts[i] = low
            del parts[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get((low << 20) | parts[i + 1], none)
            if i:
                pair[i - 1] = get((parts[i - 1] << 20) | low, none)
        return parts

    def _merge_long(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end of the part that begins here; 0 once merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (b := before[i]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
                heapq.heappush(heap, (r, b, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _entry(self, word: str) -> bytes:
        entry = array("i", self.merge(word.encode())).tobytes()
        if len(self.cache) >= CACHE_SIZE:
            self.cache.clear()
        if len(word) <= 64:
            self.cache[word] = entry
        return entry

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
        """For each text: its slices' starts (characters), the slices' ids as bytes, and its ids."""
        for group in _grouped(texts):
            joined = "".join(group)
            sizes = np.fromiter(map(len, group), dtype=np.int64, count=len(group))
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            codepoints = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
            starts = token_starts(codepoints, offsets[:-1][sizes > 0])
            bounds = starts.tolist()
            bounds.append(len(joined))
            cached, entry = self.cache.get, self._entry
            words = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
            entries = [cached(w) or entry(w) for w in words]
            cut = np.searchsorted(starts, offsets)
            for k in range(len(group)):
                lo, hi = int(cut[k]), int(cut[k + 1])
                own = entries[lo:hi]
                yield starts[lo:hi] - offsets[k], own, np.frombuffer(b"".join(own), dtype=np.int32)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))[2].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def token_offsets(self, ids: np.ndarray) -> np.ndarray:
        """The character at which each token begins, and the number of all; a token that begins within a character counts as after it."""
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(self.leads[ids])])

    def decode_slices(self, ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> bytes:
        """The bytes of slices of ``sizes`` ids each that start at the given characters; they must fit these offsets."""
        ends = np.cumsum(sizes)
        if not np.array_equal(self.token_offsets(ids)[ends - sizes], starts):
            raise ValueError("the slices do not fit their offsets")
        return self.decode(ids.tolist())


def _grouped(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > BATCH_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


@lru_cache(maxsize=4)
def coder(path: str) -> ByteBpe:
    """One coder for each Python worker and rank file."""
    return ByteBpe(path)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _sizes(entries: list[bytes]) -> np.ndarray:
    """Ids of each slice."""
    return np.fromiter(map(len, entries), np.int64, len(entries)) // 4


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, starts array<int> (first character of each slice), slice_ids array<int> (ids in each slice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in (part for whole in batches for part in parts(whole, 1)):
            rows = list(bpe.encode_batch(_texts(batch.column(1))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                    pa.array([_sizes(r[1]).astype(np.int32) for r in rows], pa.list_(pa.int32())),
                ],
                names=["doc_id", "ids", "starts", "slice_ids"],
            )
        bpe.cache.clear()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, ids array<int>, starts array<int>, slice_ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded, the text, from what ``encode`` gives: each slice is decoded at its own offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            texts = []
            for row in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                ids, starts, sizes = (x.values.to_numpy().astype(np.int64) for x in row)
                texts.append(bpe.decode_slices(ids, sizes, starts).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids", "starts", "slice_ids").mapInArrow(tidy(run), "doc_id long, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode, in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, n_slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in (part for whole in batches for part in parts(whole, 1)):
            count, ids_sha, decoded_sha, slices = [], [], [], []
            for starts, entries, packed in bpe.encode_batch(_texts(batch.column(1))):
                ids = packed.tolist()
                count.append(len(ids))
                slices.append(len(starts))
                ids_sha.append(hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode_slices(packed, _sizes(entries), starts)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string()), pa.array(slices, pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_slices"],
            )
        bpe.cache.clear()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_slices long")


def tokenise(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, n_tokens, ids, and round_trip: whether decoding the ids gives the text again."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(text_col))
    schema = T.StructType([*rows.schema.fields[:-1], *T._parse_datatype_string("n_tokens long, ids array<int>, round_trip boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in (part for whole in batches for part in parts(whole, len(keep))):
            texts = _texts(batch.column(len(keep)))
            ids, same = [], []
            for text, (starts, entries, packed) in zip(texts, bpe.encode_batch(texts), strict=True):
                ids.append(packed)
                same.append(bpe.decode_slices(packed, _sizes(entries), starts) == text.encode())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())],
                names=schema.names,
            )
        bpe.cache.clear()

    return rows.mapInArrow(tidy(run), schema)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), vocabulary_path())
