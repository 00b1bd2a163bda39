"""Packing against a round-robin that runs through the queues one round after another."""

import math
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import packing as P

SCHEMA = "doc_id long, text string, source string, row_no string, p string"


@pytest.fixture(scope="module")
def docs(spark):
    words = "the quick brown fox jumps over a lazy dog's 3 naïve cafés".split()
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 400))), "hot" if i % 3 == 0 else f"s{i % 40}", "x", "y") for i in range(150)]
    rows += [(150, None, None, None, None), (151, "", "s1", "", ""), (None, "no id", "s1", "", ""), (7, "same id", "s1", "", ""), (7, "same id", "s1", "", "")]
    rows += [(152, "long " * 30_000 + "y" * 20_000, "s2", "", ""), (153, "<|endoftext|> 日本語。ﷺ\x00", "s3", "", "")]
    return spark.createDataFrame(rows, SCHEMA)


@lru_cache
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.vocabulary_path())
    tokenizer.encode_special_tokens = True
    return tokenizer


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids + [P.END]


def test_encoder_equals_the_library_on_every_code_point():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c} 1{c}'s" for c in points[i : i + 2000]) for i in range(0, len(points), 2000)]
    encode = P.encoder(P.vocabulary_path()).encode_to_numpy
    assert all(e.ids == encode(t, disallowed_special=()).tolist() for t, e in zip(texts, library().encode_batch_fast(texts, add_special_tokens=False)))


def check_whole(docs, pieces):
    """Every id in one piece, pieces in gapless sequences; returns the source of each token, sequence after sequence."""
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(library_ids(r.text))
    got, places = {}, {}
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length
        got.setdefault(p.doc_id, []).append((p.doc_tokens, p.start, ids))
        places.setdefault(p.sequence_id, []).append((p.offset, p.length, p.source))
    assert set(got) == set(texts)
    for doc, parts in got.items():
        wanted = sorted(texts[doc])
        if len(wanted) == 1:
            parts.sort(key=lambda x: x[1])
            assert [x[1] for x in parts] == list(np.cumsum([0] + [len(x[2]) for x in parts[:-1]]))
            assert sum((x[2] for x in parts), []) == wanted[0]
        assert sum(len(x[2]) for x in parts) == sum(map(len, wanted)) and {x[0] for x in parts} == set(map(len, wanted))
    assert set(places) == set(range(len(places)))
    order = []
    for number in sorted(places):
        at = 0
        for offset, length, source in sorted(places[number]):
            assert offset == at
            at += length
            order += [source] * length
        assert at == P.WINDOW or at & (at - 1) == 0
    return order


def round_robin(totals, shares, phases):
    """Sources of all tokens, from rounds that credit each queue and serve what its credit covers."""
    left, out, turn = dict(totals), [], 0
    quantum = {s: max(P.MIN_QUANTUM, math.floor(shares[s] * P.WINDOW)) for s in totals}
    credit = {s: -phases[s] * quantum[s] for s in totals}
    while any(left.values()):
        for s in sorted(totals):
            # a quantum may be served in the round in which its credit begins to arrive
            while left[s] and credit[s] + shares[s] * P.WINDOW > 1e-6:
                n = min(quantum[s], left[s])
                out += [s] * n
                left[s] -= n
                credit[s] -= quantum[s]
            credit[s] += shares[s] * P.WINDOW
        turn += 1
    return out


def test_packing_equals_a_sequential_round_robin(spark, docs):
    pieces = P.sequences(docs, P.vocabulary_path()).collect()
    order = check_whole(docs, pieces)
    totals = {s: order.count(s) for s in set(order)}
    phases = {r[0]: r[1] for r in spark.createDataFrame([(s,) for s in totals], "s string").select("s", F.pmod(F.xxhash64("s"), F.lit(1 << 20)) / 2.0**20).collect()}
    shares = {s: n / len(order) for s, n in totals.items()}
    expected = round_robin(totals, shares, phases)
    differ = sum(a != b for a, b in zip(order, expected))
    assert differ == 0
    # the mixture holds at every window border to within a quantum
    seen = np.cumsum([[x == "hot" for x in order], [x == "s2" for x in order]], axis=1)
    for row, s in zip(seen, ("hot", "s2")):
        at = np.arange(P.WINDOW, len(order), P.WINDOW)
        assert np.abs(row[at - 1] - at * shares[s]).max() <= 2 * max(P.MIN_QUANTUM, shares[s] * P.WINDOW)


def test_targets(spark, docs):
    order = check_whole(docs, P.sequences(docs, P.vocabulary_path(), {"hot": 0.5}).collect())
    hot = np.cumsum([x == "hot" for x in order])
    until = P.WINDOW * (int(np.searchsorted(hot, hot[-1])) // P.WINDOW - 1)  # while the queue lasts, half of every window is its
    at = np.arange(P.WINDOW, until, P.WINDOW)
    assert np.abs(hot[at - 1] - at / 2).max() <= P.WINDOW
    with pytest.raises(ValueError):
        P.sequences(docs, P.vocabulary_path(), {"hot": 1.0}).collect()
    with pytest.raises(ValueError):
        P.sequences(docs, P.vocabulary_path(), {"hot": -0.5})


def test_placing_does_not_depend_on_the_size_of_blocks(spark, monkeypatch):
    lengths = spark.range(500).selectExpr("id AS row_no", "concat('s', id % 7) AS source", "1 + id * 37 % 900 AS n", "CAST(id % 5 AS INT) AS task")
    lengths = lengths.selectExpr("*", "sum(n) OVER (PARTITION BY source, task ORDER BY row_no) - n AS before")
    wide = {tuple(r) for r in P.placed(lengths).collect()}
    monkeypatch.setattr(P, "ROUNDS_PER_BLOCK", 2)
    monkeypatch.setattr(P, "BLOCKS_PER_GROUP", 3)
    assert {tuple(r) for r in P.placed(lengths).collect()} == wide
    at = 0
    for place, length in sorted((r[3], r[2]) for r in wide):
        assert place == at
        at += length


def test_batches_are_cut_by_size(spark, docs, monkeypatch):
    monkeypatch.setattr(P, "PART_BYTES", 3000)
    check_whole(docs, P.sequences(docs, P.vocabulary_path()).collect())


def test_empty(spark):
    out = P.sequences(spark.createDataFrame([], SCHEMA), P.vocabulary_path())
    assert out.count() == 0 and out.columns == ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    one = P.sequences(spark.createDataFrame([(1, None, None, None, None)], SCHEMA), P.vocabulary_path()).collect()
    assert [(r.start, r.length, r.sequence_id, r.offset) for r in one] == [(0, 1, 0, 0)]
