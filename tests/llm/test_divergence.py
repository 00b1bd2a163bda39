"""The divergence audit against a plain count over all groups and terms."""

import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, value string, rank string"


def plain(rows, min_docs):
    groups, in_docs, out = {}, {}, []
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups.setdefault(lang, {}).setdefault(source, Counter()).update(found)
        in_docs.setdefault(lang, Counter()).update(set(found))
    for lang, sources in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = shares(sum(sources.values(), Counter()))
        own = {s: shares(c) for s, c in sources.items()}
        for s, p in own.items():
            pair = [(sum(abs(p[t] - q[t]) for t in kept), o) for o, q in own.items() if o != s]
            term = [(p[t] - whole[t], t) for t in kept if sources[s][t] and p[t] > whole[t]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(items[: None if part == "pair" else 50], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)] + ["Äther", "ÄTHER", "日本", "don't", "\U0001f600", "a\x00b", "é" * 300]
    out = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else f"s{i % 50}"
        picks = rng.zipf(1.3, rng.integers(0, 60)) + (i % 50 if i % 7 == 0 else 0)
        out.append((" ".join(words[k % len(words)] for k in picks).title() if i % 11 == 0 else ",".join(words[k % len(words)] for k in picks), "en" if i % 4 else "de", source))
    out += [(None, "en", "silent"), ("", "xx", None), ("only one", None, "s1"), (None, None, None), ("zzz " * 20_000, "en", "long")]
    return out + out[:20]


def test_report_equals_a_plain_count(spark, rows, monkeypatch):
    monkeypatch.setattr(D, "MIN_DOCS", 5)
    monkeypatch.setattr(D, "GROUPS_PER_BLOCK", 8)  # seven blocks of groups, several of terms
    monkeypatch.setattr(D, "TERMS_PER_BLOCK", 32)
    monkeypatch.setattr(D, "HELD_TERMS", 500)
    monkeypatch.setattr(D, "SLICE_BYTES", 64)
    docs = spark.createDataFrame([(i, *r, "v", "r") for i, r in enumerate(rows)], SCHEMA).repartition(6)
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in D.report(docs).collect())
    expected = plain(rows, 5)
    assert got == expected and sum(r[2] == "pair" for r in got) > 2000 and any(r[5] == 50 and r[2] == "term" for r in got)


def test_cells_stand_for_each_pair_once(spark, rows, monkeypatch):
    monkeypatch.setattr(D, "MIN_DOCS", 5)
    monkeypatch.setattr(D, "GROUPS_PER_BLOCK", 8)
    monkeypatch.setattr(D, "TERMS_PER_BLOCK", 32)
    audit = D.Audit(spark.createDataFrame([(i, *r, "v", "r") for i, r in enumerate(rows)], SCHEMA))
    parts = audit.partial_divergences().where("lang = 'en'")
    n = audit.groups.where("lang = 'en'").count()
    blocks = audit.kept.where("lang = 'en'").select("term_block").distinct().count()
    assert blocks > 1 and parts.count() == n * (n - 1) // 2 * blocks
    widest = audit.slices().selectExpr("max(size(at))", "max(width)").first()
    assert widest[0] <= widest[1] <= 64


def test_shares_are_exact_beyond_longs(spark):
    from pyspark.sql import functions as F

    rows = [(10**13, 3 * 10**13, 10**6), (0, 1, 1), (7, 10**15, 10**7)]
    got = spark.createDataFrame(rows, "n long, total long, terms long").select(D.share(F.col("n"), F.col("total"), F.col("terms"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 5) // (total + 5 * v) for n, total, v in rows]


def test_words_of_long_texts_are_whole():
    text = ("Äbc dE-f " * 50 + "x" * 500).encode()
    whole = text.translate(D._WORD_BYTES).split()
    for size in (1, 7, 64, 1 << 22):
        D.SLICE_BYTES, before = size, D.SLICE_BYTES
        try:
            assert [w for part in D.words(text) for w in part] == whole
        finally:
            D.SLICE_BYTES = before


def test_empty(spark):
    assert D.report(spark.createDataFrame([], SCHEMA)).collect() == []
    one = D.report(spark.createDataFrame([(1, None, None, None, "", "")], SCHEMA))
    assert one.collect() == [] and one.columns == ["lang", "source", "part", "item", "value", "rank"]
    two = D.report(spark.createDataFrame([(1, "a", "en", "x", "", ""), (2, "b", "en", "y", "", "")], SCHEMA)).collect()
    assert sorted(tuple(r) for r in two) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
