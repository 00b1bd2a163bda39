"""Vector codes against plain rounds that scan every part against every entry."""

import numpy as np
import pytest

from quarry.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, codes string, x string"


def plain(vectors, rounds=V.ROUNDS):
    """Codes, errors and codebooks of integer vectors in the order of their ids."""
    width = vectors.shape[1] // V.PARTS
    codes, errors, books = [], 0, []
    for m in range(V.PARTS):
        part = vectors[:, m * width : (m + 1) * width]
        book = part[: V.ENTRIES].copy()
        for t in range(rounds + 1):
            d = ((part[:, None, :] - book[None, :, :]) ** 2).sum(2)
            nearest = d.argmin(1)
            if t < rounds:
                for e in set(nearest.tolist()):
                    own = part[nearest == e]
                    book[e] = own.sum(0) // len(own)
        codes.append(nearest)
        errors = errors + d.min(1)
        books.append(book)
    return ["".join(f"{c:02x}" for c in row) for row in np.array(codes).T.tolist()], errors.tolist(), np.array(books)


def test_codes_equal_plain_rounds(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    values = (centres[rng.integers(0, 40, 1500)] + rng.normal(scale=0.05, size=(1500, 16))).astype(np.float32)
    values[100:140] = values[7]  # repeated vectors
    values[200:260] = np.round(values[200:260] * 4) / 4  # ties
    rows = [(i, v.tolist(), int(i % 5) if i % 3 else None, "a", "b") for i, v in enumerate(values)]
    odd = [(-1, None, 1, "", ""), (-2, [1.0] * 15 + [None], 1, "", ""), (-3, [1.0] * 15 + [float("nan")], 2, "", ""), (-4, [float("-inf")] * 16, None, "", "")]
    codes, errors, book = plain(np.floor(values.astype(np.float64) * 1024).astype(np.int64))
    coded, found = V.compress(spark.createDataFrame(rows + odd, SCHEMA).repartition(7))
    assert np.array_equal(found, book)
    got = {r.vec_id: r for r in V.with_label_errors(V.materialise(coded)).collect()}
    assert [got[i].codes.hex() for i in range(1500)] == codes and len(got) == 1500
    assert [got[i].error for i in range(1500)] == errors
    by_label = {}
    for i, e in enumerate(errors):
        by_label[rows[i][2]] = by_label.get(rows[i][2], 0) + e
    assert all(got[i].label_error == by_label[rows[i][2]] for i in range(1500))


def test_bounds_spare_scans_and_beat_accumulated_drifts():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16)) * 1024
    x = (centres[rng.integers(0, 30, 4000)] + rng.normal(scale=60, size=(4000, 16))).astype(np.int64)
    history = [np.stack([x[:64, m * 4 : m * 4 + 4] for m in range(V.PARTS)])]
    state, scanned = (), []
    for t in range(5):
        books = [V.Book([h[m] for h in history]) for m in range(V.PARTS)]
        codes, seconds, stamps, own, n = V.assign(x, books, t, *state)
        scanned.append(n)
        if t:
            for m in range(V.PARTS):
                d = ((x[:, None, m * 4 : m * 4 + 4] - history[-1][m][None]) ** 2).sum(2)
                assert np.array_equal(codes[:, m], d.argmin(1)) and np.array_equal(own[:, m], d.min(1))
        state = codes, seconds, stamps
        new = history[-1].copy()
        for m in range(V.PARTS):
            for e in np.unique(codes[:, m]):
                new[m, e] = x[codes[:, m] == e, m * 4 : m * 4 + 4].sum(0) // (codes[:, m] == e).sum()
        history.append(new)
    assert scanned[0] == 4 * 4000 and scanned[4] < scanned[0] / 2
    for m in range(V.PARTS):  # what a bound loses since its stamp is the norm of a sum of moves, never more than the sum of norms
        steps = [np.sqrt(((b[m] - a[m]) ** 2).sum(1)).max() for a, b in zip(history, history[1:])]
        for stamp, (_, most, _) in enumerate(V.Book([h[m] for h in history]).moved):
            assert most <= sum(steps[stamp:]) + 1e-6
    assert any(V.Book([h[m] for h in history]).moved[0][1] < 0.9 * sum(np.sqrt(((b[m] - a[m]) ** 2).sum(1)).max() for a, b in zip(history, history[1:])) for m in range(V.PARTS))


def test_integers_beyond_doubles():
    rng = np.random.default_rng(6)
    x, c = rng.integers(-(1 << 26), 1 << 26, (50, 4)), rng.integers(-(1 << 26), 1 << 26, (9, 4))
    wide = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
    assert np.array_equal(V.squared_distances(x, c), wide.astype(np.int64))
    with pytest.raises(ValueError):
        V.squared_distances(x << 4, c)


def test_small_tables(spark):
    assert V.compress(spark.createDataFrame([], SCHEMA))[0].count() == 0
    assert V.compress(spark.createDataFrame([(1, None, 1, "", "")], SCHEMA))[0].count() == 0
    one, book = V.compress(spark.createDataFrame([(None, [0.5, -0.001, 1.0, 2.0], None, "", "")], SCHEMA))
    assert [(r.vec_id, r.codes.hex(), r.error) for r in one.collect()] == [(None, "00000000", 0)] and book.reshape(-1).tolist() == [512, -2, 1024, 2048]
    ties, book = V.compress(spark.createDataFrame([(1, [float(k)] * 4, 1, "", "") for k in (2, 1, 1)], SCHEMA))
    assert sorted(r.codes.hex() for r in ties.collect()) == ["00000000", "00000000", "02020202"] and book.shape == (4, 3, 1)
    with pytest.raises(ValueError):
        V.compress(spark.createDataFrame([(1, [1.0] * 6, 1, "", "")], SCHEMA))
    empty = V.compress(spark.createDataFrame([(i, [], 1, "", "") for i in range(3)], SCHEMA))[0]
    assert [r.codes.hex() for r in empty.collect()] == ["00000000"] * 3
