"""Quality classifier: a generalised additive model with pairwise interactions.

Every document gets a row of numeric features in one pass over the texts. The model is a sum of lookup tables:
one for each feature and one for each chosen pair of features, over quantile bins. Cyclic boosting fits them:
each round visits every feature in turn and adds, times a small rate, a shallow tree over that feature's
bins, fitted to the current residuals; then the pairs that explain most of what is left are boosted in the
same way over two-dimensional bins. A score is the logistic of a few table look-ups, for whole columns at once.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0. The fit runs on the driver over at most
``MAX_TRAINING_ROWS`` labelled rows, chosen by a hash of doc_id; features, scores and decisions cover all rows.
Labels, lang, source and doc_id are no inputs of a score.

Scale: one pass over the texts; the driver receives the rows that it learns from and few more, whatever the number of labels.

Cases: null text counts as empty and is scored; very long texts are described whole; without usable labels, or with labels of one kind only, the model is a
constant; a document with several labels counts as their mean, rounded; rows with a null label or null doc_id are not learnt
from (a null doc_id is not held out); repeated rows score alike; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, tidy

MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, DEPTH, RIDGE = 60, 30, 0.15, 2, 2.0

FEATURES = [
    "log_words", "mean_word", "distinct_words", "top_word", "repeated_next", "upper_words", "symbol_words", "symbols", "digits",
    "capital_letters", "repeated_lines", "mean_line", "sentence_words", "long_words", "repeated_sentences", "blanks",
]
_LETTER_BYTES = bytes(c for c in range(256) if c >= 128 or chr(c).isalpha())
_DIGITS = b"0123456789"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = b" \t\n\r\x0b\x0c"
_ENDS = re.compile(r"[.!?]+\s+")


def features(text: str) -> list[float]:
    """Shares and means that describe the whole text, in the order of FEATURES."""
    raw = text.encode()
    n = max(len(raw), 1)
    letters = n - len(raw.translate(None, _LETTER_BYTES))
    digits = n - len(raw.translate(None, _DIGITS))
    upper = n - len(raw.translate(None, _UPPER))
    blanks = n - len(raw.translate(None, _BLANKS))
    if not raw:
        letters = digits = upper = blanks = 0
    words = text.split()
    count = Counter(words)
    k = max(len(words), 1)
    lines = [x for x in text.split("\n") if x]
    sentences = _ENDS.split(text)
    return [
        float(np.log1p(len(words))),
        len(text) / k,
        len(count) / k,
        max(count.values(), default=0) / k,
        sum(map(str.__eq__, words, words[1:])) / k,
        sum(map(str.isupper, words)) / k,
        (k - sum(map(str.isalnum, words))) / k,
        (n - letters - digits - blanks) / n,
        digits / n,
        upper / n,
        1 - len(set(lines)) / max(len(lines), 1),
        float(np.log1p(len(text) / max(len(lines), 1))),
        float(np.log1p(k / len(sentences))),
        sum(len(w) > 15 for w in count) / max(len(count), 1),
        1 - len(set(sentences)) / len(sentences),
        blanks / n,
    ]


class AdditiveModel:
    """Intercept, bin edges and tables; ``score`` adds the tables' entries for each row."""

    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]):
        self.base, self.edges, self.tables, self.pairs = base, edges, tables, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, edges_a, edges_b, table in self.pairs:
            total += table[np.searchsorted(edges_a, x[:, a], side="right"), np.searchsorted(edges_b, x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(gradient: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values, by bin, of a shallow tree over ordered bins that fits gradient / weight."""
    out = np.full(len(gradient), gradient.sum() / (weight.sum() + RIDGE))
    if depth == 0 or len(gradient) < 2:
        return out
    g, w = np.cumsum(gradient), np.cumsum(weight)
    gain = g[:-1] ** 2 / (w[:-1] + RIDGE) + (g[-1] - g[:-1]) ** 2 / (w[-1] - w[:-1] + RIDGE) - g[-1] ** 2 / (w[-1] + RIDGE)
    cut = int(gain.argmax()) + 1
    if gain[cut - 1] <= 1e-9:
        return out
    return np.concatenate([_tree(gradient[:cut], weight[:cut], depth - 1), _tree(gradient[cut:], weight[cut:], depth - 1)])


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut along one axis, then one along the other on each side; with its gain."""
    whole = gradient.sum() ** 2 / (weight.sum() + RIDGE)
    best, best_gain = np.zeros_like(gradient), 0.0
    for axis in (0, 1):
        g, w = (gradient, weight) if axis == 0 else (gradient.T, weight.T)
        for cut in range(1, len(g)):
            parts = [_tree(g[s].sum(axis=0), w[s].sum(axis=0), 1) for s in (slice(None, cut), slice(cut, None))]
            value = np.concatenate([np.broadcast_to(parts[0], (cut, g.shape[1])), np.broadcast_to(parts[1], (len(g) - cut, g.shape[1]))])
            gain = float((2 * value * g - value**2 * (w + 0)).sum()) - whole
            if gain > best_gain:
                best, best_gain = (value if axis == 0 else value.T), gain
    return best, best_gain


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of one table a feature, then of PAIRS pair tables."""
    n, k = x.shape if x.ndim == 2 else (0, len(FEATURES))
    mean = (y.sum() + 1) / (n + 2) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    if n == 0 or y.min() == y.max():
        return AdditiveModel(base, [np.zeros(0)] * k, [np.zeros(1)] * k, [])
    edges = [_edges(x[:, j], BINS) for j in range(k)]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(n, base)
    for _ in range(ROUNDS):
        for j in range(k):
            p = 1 / (1 + np.exp(-total))
            size = len(tables[j])
            step = RATE * _tree(np.bincount(binned[j], y - p, size), np.bincount(binned[j], p * (1 - p), size), DEPTH)
            tables[j] += step
            total += step[binned[j]]
    coarse_edges = [_edges(x[:, j], PAIR_BINS) for j in range(k)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse_edges)]

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1
        return np.bincount(coarse[a] * shape[1] + coarse[b], values, shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-total))
    gains = sorted(((_pair_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)))[1], a, b) for a, b in combinations(range(k), 2)), reverse=True)
    chosen = [(a, b, np.zeros((len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1))) for gain, a, b in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in chosen:
            p = 1 / (1 + np.exp(-total))
            step = RATE * _pair_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)))[0]
            table += step
            total += step[coarse[a], coarse[b]]
    return AdditiveModel(base, edges, tables, [(a, b, coarse_edges[a], coarse_edges[b], t) for a, b, t in chosen])


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and an array of the FEATURES for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, x array<double>")


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def usable_labels(labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """doc_id and y, one row for each labelled doc_id that may be learnt from."""
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna().where(~held_out())
    return label.groupBy("doc_id").agg(F.round(F.avg("y")).alias("y"))


def _order() -> F.Column:
    """A hash of doc_id, uniform from 0 to 2 ** 31 - 1, by which rows are chosen to be learnt from."""
    return F.shiftrightunsigned(F.xxhash64("doc_id"), 33)


def chosen(ids: DataFrame, max_rows: int) -> DataFrame:
    """The rows of ``ids`` (doc_id and others) with the least hashes of doc_id, ``max_rows`` of them.

    A bound on the hash, set by the number of rows, lets a few more than that through; only these are sorted, so no partition offers more than its share.
    """
    n = ids.count()
    bound = min(1.0, (max_rows + 6 * max_rows**0.5 + 10) / max(n, 1)) * 2.0**31
    return ids.where(_order() < bound).orderBy(_order(), "doc_id").limit(max_rows)


def train(table: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> AdditiveModel:
    """Fit on at most ``max_rows`` labelled rows of a feature table, held-out rows excluded."""
    sample = chosen(table.join(usable_labels(labels, label_col), "doc_id"), max_rows).select("x", "y").toPandas()
    x = np.array(sample["x"].tolist(), dtype=float).reshape(len(sample), len(FEATURES))
    return fit(x, sample["y"].to_numpy(float))


def train_on_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAINING_ROWS) -> AdditiveModel:
    """``train``, with features only of the rows that it can choose: those of the first ``max_rows`` labelled ids of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = chosen(usable_labels(labels).select("doc_id").join(rows.select("doc_id"), "doc_id", "left_semi"), max_rows)
    # at most max_rows longs, so the texts are not shuffled to meet them
    return train(materialise(text_features(rows.join(F.broadcast(ids), "doc_id", "left_semi"))), labels, max_rows=max_rows)


def score(table: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of a feature table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return table.mapInArrow(tidy(run), "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    table = materialise(text_features(docs))
    return score(table, train(table, labels))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier accepts."""
    model = train_on_texts(docs, labels, text_col=text_col)
    at = docs.columns.index(text_col)

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or "") for t in batch.column(at).to_pylist()]).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(tidy(accept), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
