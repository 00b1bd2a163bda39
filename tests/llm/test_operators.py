"""The ten operators against brute force on small tables, with the odd rows that each must bear."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, common, decontaminate, exact_dedup, license_texts, licenses, ngram_jaccard, quality, secrets, suffix_dedup, warc
from quarry.llm.components import components

DOC = "doc_id long, text string, digest string, kept string"  # extra columns whose names clash with the operators' own


def docs(spark, *texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOC).repartition(3)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))


# --- 1 ---------------------------------------------------------------------------------------------------------------------

ALPHABET = ["a", "s", "t", "re", "ve", "ll", "d", "m", "'", "'", "’", " ", " ", "\n", "\t", "　", "1", "²", "!", "é", "́", "字", "😀", "\x00", "\x1c", "\x85", "​"]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.load_ranks(byte_bpe.vocabulary_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(reference):
    r = random.Random(1)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["a" * 5000, "ab'" * 3000, " " * 1000, "", "x" * 150 + "'s", prose(2, 5000)]
    bpe = byte_bpe.ByteBpe(byte_bpe.vocabulary_path())
    for text, (starts, entries, ids) in zip(texts, bpe.encode_batch(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)
        sizes = byte_bpe._sizes(entries)
        assert bpe.decode(ids.tolist()) == text.encode() == bpe.decode_slices(ids, sizes, starts)
        assert list(starts[:1]) == ([0] if text else [])
        if len(starts) > 1:
            with pytest.raises(ValueError):
                bpe.decode_slices(ids, sizes, starts + 1)


def test_bpe_classes_of_all_code_points(reference):
    """Every code point between two letters, as the library cuts it; surrogates do not occur in texts."""
    texts = [f"a{chr(cp)}b" for cp in range(0x110000) if not 0xD800 <= cp < 0xE000]
    bpe = byte_bpe.ByteBpe(byte_bpe.vocabulary_path())
    differ = sum(ids.tolist() != reference.encode_ordinary(text) for text, (_, _, ids) in zip(texts, bpe.encode_batch(texts), strict=True))
    assert differ == 0


def test_bpe_query(spark, reference):
    texts = ["Hello world, it's", None, "", "Straße 字", "Hello world, it's"]
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs(spark, *texts), byte_bpe.vocabulary_path()).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = byte_bpe.encode(docs(spark, *texts), byte_bpe.vocabulary_path())
    assert {r.doc_id: r.decoded for r in byte_bpe.decode(encoded, byte_bpe.vocabulary_path()).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert all(sum(r.slice_ids) == len(r.ids) and len(r.starts) == len(r.slice_ids) for r in encoded.collect())
    assert byte_bpe.round_trip(docs(spark, "a").limit(0), byte_bpe.vocabulary_path()).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------------------

def test_suffix_array_is_sorted():
    r = random.Random(3)
    for _ in range(2000):
        s = [r.randint(1, r.choice([1, 2, 3, 5])) for _ in range(r.randint(1, 40))] + [0]
        order = suffix_dedup.suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        for k, h in enumerate(suffix_dedup.common_prefixes(s, order)):
            a, b = s[order[k] :], s[order[k - 1] :] if k else []
            assert h == next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def removed(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cover[:-1]]) if b else b""
        out.append((len(b), int(cover.sum()), int((np.diff(np.concatenate([[False], cover]).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot, broadcast, block", [(suffix_dedup.HOT_TILES, suffix_dedup.BROADCAST_ROWS, suffix_dedup.BATCH_BYTES), (2, 0, 3000), (suffix_dedup.HOT_TILES, 0, 700)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot, broadcast, block):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", block)
    a, b, line = prose(1, 200), prose(2, 150), prose(3, 60)
    texts = [a, a, a[:500] + "#" + a[501:], b, line + prose(4, 50), prose(5, 50) + line, prose(6, 20) + line + prose(7, 20), "Der " * 300, "xDer " * 100, None, "", "short", "short", line[:199] + "!", line[:200], "é" * 300]
    texts += [prose(100 + i, 3) + line + prose(200 + i, 3) for i in range(40)] + [prose(9, 3000)]
    texts += [prose(300 + i, 2) + line[30:280] + prose(400 + i, 2) for i in range(12)] + [prose(500 + i, 40) for i in range(20)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs(spark, *texts), hot_tiles=hot).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts)
    assert suffix_dedup.dedup(docs(spark, "a").limit(0)).count() == 0


def test_strings_of_a_long_text_repeat_in_short_ones(spark):
    long = prose(11, 260_000)  # beyond a block
    texts = [long, long[700_000:700_900], prose(12, 100), long[1_300_000:1_300_250] + "!"]
    assert len(long) > suffix_dedup.BATCH_BYTES
    rows = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.dedup(docs(spark, *texts)).collect()}
    assert rows == {0: (1150, 2), 1: (900, 1), 2: (0, 0), 3: (250, 1)}


def test_seen_keys_are_counted_by_block():
    seen = suffix_dedup.Seen(16)
    key = np.array([1 << 20, 2 << 20, (1 << 20) + (1 << 24)], dtype=np.uint64)  # the last one shares the slot of the first
    assert [seen.twice(key[:2]).tolist() for _ in range(3)] == [[False, False], [False, False], [True, True]]
    assert seen.twice(key[2:]).tolist() == [False] and seen.twice(key[:2]).tolist() == [False, True]


# --- 3 ---------------------------------------------------------------------------------------------------------------------

def plain_licenses(text):
    """license: (containment, first word) by windows that are compared with every template."""
    words = lambda t: re.sub("[^a-z0-9]+", " ", (t or "").lower()).split()
    cut = lambda t: [tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)]
    own, out = cut(text), {}
    for name, template in license_texts.TEMPLATES:
        wanted = set(cut(template))
        stride = 1 << (len(wanted) - 1).bit_length()
        for start in range(-stride, len(own), stride):
            window = range(max(start, 0), min(start + 2 * stride, len(own)))
            share = len(wanted & {own[i] for i in window}) / len(wanted)
            if share >= licenses.CONTAINMENT:
                old = out.get(name, (0, 1 << 40))
                out[name] = max(old[0], share), min(old[1], *(i for i in window if own[i] in wanted))
    return out


def test_licenses_equal_brute_force(spark):
    r = random.Random(3)
    texts = ["x. Licensed under the Apache License, Version 2.0. y", "Released under the\n MIT LICENSE!", None, "", "Licensed under CC BY-NC 4.0. Licensed under CC BY-SA 4.0.",
             "Licensed under CC BY-NC 4.0. And Released under the MIT License. Released under the MIT License.", "licensed under the", prose(3, 2000) + " " + license_texts.MIT]
    for k, (_, text) in enumerate(license_texts.TEMPLATES):
        w = text.split()
        for _ in range(3):
            drop = set(r.sample(range(len(w)), min(len(w) // 8, r.randint(0, 2))))
            texts.append(prose(k, r.randint(0, 400)) + " " + " ".join(x for i, x in enumerate(w) if i not in drop) + " " + prose(k + 50, r.randint(0, 90)))
    rows = licenses.scan(docs(spark, *texts)).collect()
    got = {(x.doc_id, x.license): (round(x.containment, 9), x.first_word) for x in rows}
    want = {(i, name): (round(c, 9), at) for i, t in enumerate(texts) for name, (c, at) in plain_licenses(t).items()}
    assert got == want and len(rows) == len(got) and len({name for _, name in got}) == len({name for name, _ in license_texts.TEMPLATES})
    assert got[4, "CC-BY-NC-4.0"][1] == 0 and got[4, "CC-BY-SA-4.0"][1] == 7
    assert licenses.scan(docs(spark, "a").limit(0)).count() == 0
    same = licenses.scan(docs(spark, *[texts[0]] * 3, ids=[None, 5, 5])).collect()
    assert sorted(str(x.doc_id) for x in same) == ["5", "5", "None"]


# --- 4 ---------------------------------------------------------------------------------------------------------------------

def test_quality_learns_and_scores_every_row(spark):
    texts, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        texts.append(prose(i, 60).capitalize() + "." if good else " | ".join(prose(i, 40).split()))
        labels.append((i, int(good)))
    texts += [None, "", "word " * 20000]
    table = docs(spark, *texts)
    rows = {r.doc_id: r for r in quality.classify(table, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    import zlib
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(rows[i].predicted, y) for i, y in labels if rows[i].held_out]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    kept = quality.keep_good(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}


def test_scores_equal_sums_of_table_entries():
    r = np.random.default_rng(4)
    x = np.round(r.random((400, len(quality.FEATURES))), 2)  # with ties
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float))
    assert model.pairs

    def bin_of(edges, value):
        return sum(1 for e in edges if e <= value)

    for row, got in zip(x, model.score(x), strict=True):
        total = model.base + sum(t[bin_of(e, v)] for e, t, v in zip(model.edges, model.tables, row, strict=True))
        total += sum(t[bin_of(ea, row[a])][bin_of(eb, row[b])] for a, b, ea, eb, t in model.pairs)
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_learnt_rows_are_those_of_least_hash(spark):
    ids = spark.range(5000).select(F.col("id").alias("doc_id"))
    order = [r.doc_id for r in ids.select("doc_id", quality._order().alias("h")).orderBy("h", "doc_id").collect()]
    for n in (0, 1, 100, 4999, 6000):
        assert [r.doc_id for r in quality.chosen(ids, n).collect()] == order[:n]


def test_quality_bears_nulls(spark):
    table = docs(spark, "good text here.", None, "x", ids=[None, None, 7])
    labels = spark.createDataFrame([(None, 1), (7, None), (7, 1), (8, 0)], "doc_id long, quality int")
    rows = quality.classify(table, labels).collect()
    assert len(rows) == 3 and [r.held_out for r in rows if r.doc_id is None] == [False, False]
    assert quality.keep_good(table, labels).count() == 3


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.predicted for r in quality.classify(docs(spark, "a", None), none).collect()} == {1}
    assert quality.classify(docs(spark, "a").limit(0), none).count() == 0


# --- 5 ---------------------------------------------------------------------------------------------------------------------

def sets(text):
    w = (text or "").lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("chunk, broadcast, at_once", [(ngram_jaccard.CHUNK, ngram_jaccard.BROADCAST_CLASSES, ngram_jaccard.PAIRS_AT_ONCE), (7, 0, 50)])
def test_jaccard_equals_brute_force(spark, monkeypatch, chunk, broadcast, at_once):
    monkeypatch.setattr(ngram_jaccard, "CHUNK", chunk)
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_CLASSES", broadcast)
    monkeypatch.setattr(ngram_jaccard, "PAIRS_AT_ONCE", at_once)
    r = random.Random(5)
    texts = [None, "", "one two", "One  two", "one two three"]
    for k in range(12):
        base = prose(k, 120).split()
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    base = prose(99, 200).split()
    texts += [" ".join([*base[:i], "z%d" % i, *base[i + 1 :]]) for i in range(0, 60)]
    shared = prose(98, 60)  # a passage of many texts puts them into common buckets, but links nothing
    texts += [f"{shared} {prose(3000 + i, 50)}" for i in range(60)]
    own = [sets(t) for t in texts]
    near = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-12
    linked = {i: {j for j in range(len(texts)) if i != j and near(own[i], own[j])} for i in range(len(texts))}
    group = list(range(len(texts)))
    for _ in texts:
        group = [min([group[i], *(group[j] for j in linked[i])]) for i in range(len(texts))]
    rows = {r.doc_id: r for r in ngram_jaccard.near_duplicates(docs(spark, *texts)).collect()}
    assert [rows[i].n_links for i in range(len(texts))] == [len(linked[i]) for i in range(len(texts))]
    assert [rows[i].class_id for i in range(len(texts))] == group
    assert sum(r.kept for r in rows.values()) == len(set(group)) and all(rows[g].kept for g in set(group))
    kept = ngram_jaccard.keep_one(docs(spark, *texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group)) and kept.columns == ["doc_id", "text", "digest", "kept"]
    assert ngram_jaccard.near_duplicates(docs(spark, "a").limit(0)).count() == 0


def test_no_group_is_formed_of_candidates(spark):
    shared = prose(98, 100)
    table = docs(spark, *[f"{shared} {prose(3000 + i, 60)}" for i in range(80)])
    classes = ngram_jaccard.signatures(table).selectExpr("row_no AS class", "n_shingles", "1L AS copies", "sig")
    placed = ngram_jaccard.cells(classes).join(classes, "class").select(*ngram_jaccard.CELL, "chunk", "class", "n_shingles", "copies", "sig")
    assert placed.count() > 100 and ngram_jaccard.living_cells(placed).count() < placed.count() / 4
    assert ngram_jaccard.links(table, classes).count() == 0


def test_jaccard_bears_long_texts_and_null_ids(spark):
    long = prose(1, 150_000)
    table = docs(spark, long, long + " more", "a b c d e f", "a b c d e f", ids=[None, 9, None, None])
    rows = Counter((r.doc_id, r.class_id, r.group_size, r.n_links) for r in ngram_jaccard.near_duplicates(table).collect())
    assert rows == {(9, 9, 2, 1): 1, (None, None, 2, 1): 2, (None, 9, 2, 1): 1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 100), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


# --- 6 ---------------------------------------------------------------------------------------------------------------------

def test_cuckoo_index_inserts_deletes_and_resizes():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    index = exact_dedup.CuckooIndex(8)  # far too small: it must grow
    for at in range(0, 5000, 500):
        index.insert(keys[at : at + 500], list(range(at, at + 500)))
    assert index.fingerprints.size >= 5000 and [index.values[e] for e in index.find(keys)] == list(range(5000))
    index.delete(keys[:2500] + [b"x" * 32])
    assert index.size == 2500 and (index.fingerprints > 0).sum() == 2500
    assert (index.find(keys[:2500]) == -1).all() and [index.values[e] for e in index.find(keys[2500:])] == list(range(2500, 5000))
    index.insert(keys[:100], ["again"] * 100)
    assert [index.values[e] for e in index.find(keys[:100])] == ["again"] * 100
    others = [hashlib.sha256(b"x%d" % i).digest() for i in range(5000)]
    assert (index.find(others) == -1).all()


def test_equal_fingerprints_are_verified_against_digests():
    digest = lambda n: n.to_bytes(8, "little") + (5).to_bytes(8, "little") + (9).to_bytes(8, "little") + bytes(8)  # noqa: E731  one bucket, one fingerprint
    index = exact_dedup.CuckooIndex(64)
    index.insert([digest(n) for n in range(6)], list(range(6)))
    assert index.find([digest(n) for n in range(8)]).tolist() == [0, 1, 2, 3, 4, 5, -1, -1]
    index.delete([digest(2), digest(7)])
    assert index.find([digest(n) for n in range(6)]).tolist() == [0, 1, -1, 3, 4, 5]


def test_exact_dedup_equals_brute_force(spark):
    r = random.Random(6)
    texts = [None if r.random() < 0.05 else "".join(r.choice("ab \n\t") for _ in range(r.randint(0, 7))) for _ in range(900)] + ["long " * 200_000, " long" * 200_000]
    ids = [r.choice([None, *range(700)]) for _ in texts]
    table = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(7)
    groups = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups[re.sub("[\\x20\\x09-\\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    want = Counter((i, min(g)[2], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, _, i in g)
    out = exact_dedup.dedup(table, rows_per_shard=300).collect()
    assert Counter((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in out) == want
    assert Counter(x.text_sha256 for x in out if x.kept) == Counter(hashlib.sha256(k.encode()).hexdigest() for k in groups)
    assert all(x.doc_id == x.keep_id for x in out if x.kept)


def test_exact_dedup(spark):
    texts = ["a b", "ab", "a  b", "c", None, "", " \n", "c", "a b"]
    rows = {r.doc_id: r for r in exact_dedup.dedup(docs(spark, *texts)).collect()}
    assert [rows[i].keep_id for i in range(9)] == [2, 2, 2, 3, 6, 6, 6, 3, 8]
    assert [rows[i].group_size for i in range(9)] == [3, 3, 3, 2, 3, 3, 3, 2, 1]
    assert [i for i in range(9) if rows[i].kept] == [2, 3, 6, 8]
    assert rows[1].text_sha256 == hashlib.sha256(b"ab").hexdigest()
    same = docs(spark, "x", "x", "x", ids=[4, 4, None])
    out = exact_dedup.dedup(same).collect()
    assert sum(r.kept for r in out) == 1 and {r.keep_id for r in out} == {4}
    assert exact_dedup.keep_one(same).collect()[0].doc_id == 4 and exact_dedup.dedup(docs(spark, "a").limit(0)).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------------------------------

def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_round_trip(spark, tmp_path):
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n\r\nWARC/1.1\r\n\r\r\n\n\r"
    pages = [(3, "http://a/x?y#z", "<p>é</p>"), (1, "http://a/x", "<p>é</p>"), (2, None, None), (5, "http://b/\r\nX: y", ""), (4, "https://c", tricky), (6, "http://d", "<p>é</p>"), (7, "http://e", "x\r\n" * 100000 + "x" * 300000)]
    table = spark.createDataFrame([(*p, "v") for p in pages], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "w")
    warc.write_archives(table, path, records_per_file=2)
    records = warc.read_archives(spark, path, payloads=True).cache()
    assert Counter(r.record_type for r in records.collect()) == {"request": 7, "metadata": 7, "response": 4, "revisit": 3}
    rows = {r.page_id: r for r in warc.captures(warc.assemble(records)).collect()}
    for i, _, html in pages:
        data = (html or "").encode()
        assert (rows[i].payload_bytes, rows[i].payload_digest) == (len(data), b32(data))
    assert {i: r.refers_to for i, r in rows.items()} == {1: None, 2: None, 3: 1, 4: None, 5: 2, 6: 1, 7: None}
    nested = warc.assemble(records).where("metadata.page_id = 4").first()
    assert bytes(nested.payload) == tricky.encode() and nested.request.target_uri == "https://c"
    again = warc.captures(warc.assemble(warc.read_archives(spark, path))).count()
    assert again == 7


def test_warc_repeated_rows_small_payloads_and_empty_table(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (2, "u", "longer text")], "page_id long, url string, html string")
    for k, (least, kinds) in enumerate(((0, {"response": 2, "revisit": 2}), (5, {"response": 4}))):
        warc.write_archives(table, str(tmp_path / str(k)), min_bytes=least)
        out = warc.captures(warc.assemble(warc.read_archives(spark, str(tmp_path / str(k))))).collect()
        assert len(out) == 4 and Counter(r.record_type for r in out) == kinds and {r.refers_to for r in out} <= {None, 1}
    warc.write_archives(table.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("broadcast", [warc.BROADCAST_ROWS, 0])
def test_warc_equals_brute_force(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    r = random.Random(7)
    pages = [(k, f"http://h{k % 3}/{k}", None if k % 50 == 0 else "".join(r.choice("ab\r\né") for _ in range(r.randint(0, 4)))) for k in range(400)]
    r.shuffle(pages)
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    warc.write_archives(table, str(tmp_path / "w"), bytes_per_file=20_000)
    assert len(list((tmp_path / "w").glob("*.gz"))) > 10
    first = {}
    for k, _, html in sorted(pages):
        first.setdefault(html or "", k)
    rows = warc.captures(warc.assemble(warc.read_archives(spark, str(tmp_path / "w")))).collect()
    got = {x.page_id: (x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in rows}
    want = {}
    for k, _, html in pages:
        data, at = (html or "").encode(), first[html or ""]
        want[k] = (len(data), b32(data), "response" if at == k else "revisit", None if at == k else at)
    assert got == want and len(rows) == len(pages)


def test_archives_of_many_members(spark, tmp_path):
    record = lambda n: b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <r%d>\r\nContent-Length: %d\r\n\r\n" % (n, n) + b"\xff" * n + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record(3)) + gzip.compress(record(0)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(5)))
    assert sorted(x.record_id for x in warc.read_archives(spark, str(tmp_path)).collect()) == ["<r0>", "<r3>", "<r5>"]
    lines = lambda raw: (("f", line) for line in raw.split(b"\r\n"))
    assert [b for _, b in warc.parse_records(lines(record(3) + record(0)))] == [b"\xff" * 3, b""]
    for bad in (record(9)[:-8], b"no record", record(4)[:30], record(3)[:-4] + b"more"):
        with pytest.raises(ValueError):
            list(warc.parse_records(lines(bad)))


# --- 8 ---------------------------------------------------------------------------------------------------------------------

def test_decontamination(spark):
    items = [(k, prose(500 + k, 15) + ". " + prose(600 + k, 12) + ".") for k in range(30)] + [(30, None), (31, "")]
    texts = [prose(1, 400), prose(2, 100) + " " + items[3][1].upper() + " " + prose(3, 900), items[7][1], " ".join(items[9][1].split()[:6]) + prose(4, 200), None, "", items[7][1] + "\n" + items[8][1]]
    w = items[11][1].split()
    texts.append(prose(5, 80) + " " + " ".join([*w[:6], "other", *w[7:]]) + " " + prose(6, 80))  # one word changed
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, *texts), bench).collect())
    assert got == [(1, 3), (2, 7), (6, 7), (6, 8), (7, 11)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs(spark, *texts), bench).collect()) == [0, 3, 4, 5]
    assert decontaminate.find_leaks(docs(spark, *texts), bench.limit(0)).count() == 0 == decontaminate.find_leaks(docs(spark, "a").limit(0), bench).count()
    assert decontaminate.drop_leaks(docs(spark, *texts), bench.limit(0)).count() == len(texts)


def plain_leaks(texts, items, min_score=decontaminate.MIN_SCORE, min_overlap=decontaminate.MIN_OVERLAP):
    """{(text number, item number): (question overlap, answer overlap, score, first word)} by BM25 as defined, every passage against every item."""
    split = lambda t: re.sub("[^a-z0-9]+", " ", (t or "").lower()).split()
    own = {k: split(t) for k, (_, t) in enumerate(items) if split(t)}
    n, mean = len(own), sum(map(len, own.values())) / max(len(own), 1)
    frequency = Counter(t for w in own.values() for t in set(w))
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {(x,) for x in w}
    best = {}
    for k, words in own.items():
        count = Counter(words)
        weight = {t: np.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / mean)) for t, f in count.items()}
        whole = sum(weight.values())
        parts = [p for p in re.split(r"(?<=[.!?])\s+", items[k][1].strip()) if p]
        question, answer = (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (items[k][1],) * 2
        q, a = cut(split(question)), set(split(answer))
        stride = max(16, 1 << (len(words) - 1).bit_length())
        for d, text in enumerate(texts):
            w = split(text)
            for start in range(0, len(w), stride):
                passage = w[start : start + 2 * stride]
                seen = set(passage)
                score = sum(x for t, x in weight.items() if t in seen) / whole
                if score < min_score - 1e-9:
                    continue
                grams = cut(passage) | {(x,) for x in passage}
                found = (len(q & grams) / max(len(q), 1), len(a & seen) / max(len(a), 1), round(score, 9), -start)
                if found[0] >= min_overlap and found[1] >= min_overlap:
                    best[d, k] = max(best.get((d, k), found), found)
    return {key: (*f[:3], -f[3]) for key, f in best.items()}


def leak_cases():
    r = random.Random(9)
    vocabulary = prose(2, 60).split()
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(2, 90))) + r.choice(["", ". " + prose(k, 4)])) for k in range(60)] + [(k, "the same words again") for k in (7, 7, 70)]
    texts = [" ".join([*r.choices(vocabulary, k=30), *items[k][1].split()[: r.randint(4, 90)], *r.choices(vocabulary, k=20)]) for k in range(60)]
    return items, [*texts, "", None, "the same words again", " ".join(r.choices(vocabulary, k=30_000))]


@pytest.mark.parametrize("min_overlap", [0.0, 0.2, 0.5])
def test_leaks_equal_brute_force(min_overlap):
    items, texts = leak_cases()
    index = decontaminate.Bm25Index(list(enumerate(t for _, t in items)), min_overlap=min_overlap)
    got = {}
    for d, k, score, start, q, a in index.scan(texts):
        found = (q, a, round(score, 9), -start)
        got[d, k] = max(got.get((d, k), found), found)
    want = plain_leaks(texts, items, min_overlap=min_overlap)
    assert {key: (*f[:3], -f[3]) for key, f in got.items()} == want and len(want) > 50


def test_wand_skips_and_loses_nothing():
    r = random.Random(8)
    for _ in range(300):
        lists, total = [], Counter()
        for _ in range(r.randint(1, 12)):
            items = sorted(r.sample(range(200), r.randint(1, 60)))
            impacts = [r.random() ** 3 for _ in items]
            lists.append(decontaminate.Postings(items, impacts))
            for i, x in zip(items, impacts):
                total[i] += x
        threshold = r.uniform(0.05, 2)
        got = dict(decontaminate.block_max_wand(lists, threshold))
        assert got == {i: pytest.approx(x) for i, x in total.items() if x >= threshold}
    steps = Counter()

    class Counted(decontaminate.Cursor):
        def seek(self, item):
            steps["seek"] += 1
            super().seek(item)

    common, rare = decontaminate.Postings(list(range(10_000)), [0.1] * 10_000), decontaminate.Postings([5000], [0.9])
    plain, decontaminate.Cursor = decontaminate.Cursor, Counted
    try:
        assert [i for i, _ in decontaminate.block_max_wand([common, rare], 0.95)] == [5000] and steps["seek"] < 10
    finally:
        decontaminate.Cursor = plain


def test_decontamination_does_not_depend_on_shards(spark, monkeypatch):
    items, texts = leak_cases()
    bench = spark.createDataFrame([*items, (71, None), (72, "")], "item_id long, text string").repartition(3)
    table = docs(spark, *texts)
    found = lambda b: sorted((x.doc_id, x.item_id, round(x.score, 9), x.first_word, x.question_overlap, x.answer_overlap) for x in decontaminate.find_leaks(table, b, min_overlap=0.2).collect())
    left = lambda b: sorted(x.doc_id for x in decontaminate.drop_leaks(table, b).collect())
    want, kept = found(bench), left(bench)
    plain = {(d, items[k][0]) for d, k in plain_leaks(texts, items, min_overlap=0.2)}
    assert {(d, i) for d, i, *_ in want} == plain and kept == sorted(set(range(len(texts))) - {d for d, _ in plain_leaks(texts, items)})
    for rows, chars, at_least in ((9, 1 << 30, 7), (1000, 2000, 5), (1, 1 << 30, 60)):
        monkeypatch.setattr(decontaminate, "ITEMS_PER_SHARD", rows)
        monkeypatch.setattr(decontaminate, "CHARS_PER_SHARD", chars)
        shards = list(decontaminate.item_shards(bench))
        assert len(shards) >= at_least and all(len(i) <= rows and (len(i) == 1 or sum(len(t) for _, t in i) <= chars + 600) for i, _ in shards)
        assert sorted((i, t) for shard, _ in shards for i, t in shard if t) == sorted(items)
        if rows == 9:
            assert found(bench) == want and left(bench) == kept
    monkeypatch.undo()
    # an unrelated item of great length makes no leak of others
    longer = bench.unionByName(spark.createDataFrame([(99, prose(77, 3000))], bench.schema))
    assert {x[:2] for x in found(longer)} == {x[:2] for x in want} and left(longer) == kept


# --- 10 --------------------------------------------------------------------------------------------------------------------

def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


WEAK = "Ab1" + "Cd2" * 12 + "x"  # 40 characters, mixed


def test_secrets(spark):
    access = "AKIA" + "ABCD1234EFGH5678"
    texts = ['é😀 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "PassWord:abc password: abcdef", None, "", access + " " + "z " * 150 + WEAK, access + " " + "z " * 300 + WEAK, WEAK,
             "https://db.example:5432/x api_key=abcdef123", "https://plain.example/", "AKIAABC", "secret==abcde secret=abcde", "0123456789abcdef" * 3 + " a" * 40000, access, access]
    rows = {r.doc_id: r for r in secrets.scan(docs(spark, *texts)).collect()}
    for i, t in enumerate(texts):
        assert rows[i].base_sha256 == hashlib.sha256(base_spans(t).encode()).hexdigest()
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(base_spans(t).count(k) for k in ("assign", "access", "hex"))
        assert set(filter(None, base_spans(t).split(","))) <= set(rows[i].spans.split(","))
    assert rows[4].spans == "access:0:20,secret:321:361" and rows[5].spans == "access:0:20" and rows[6].spans == ""
    assert rows[7].spans.startswith("endpoint:0:") and rows[8].spans == ""
    assert secrets.scan(docs(spark, "a").limit(0)).count() == 0


def test_texts_of_many_findings_take_linear_time(spark):
    import time
    words = [hashlib.md5(str(i).encode()).hexdigest() for i in range(60_000)]
    text = " ".join(words[:1000]) + " https://db.example/x " + " ".join(words[1000:])
    began = time.time()
    row = secrets.scan(docs(spark, text)).first()
    assert time.time() - began < 60 and row.n_hex == 60_000
    assert row.base_sha256 == hashlib.sha256(base_spans(text).encode()).hexdigest()


def test_native_operators_plan_no_python(spark):
    for df in (secrets.find_parts(docs(spark, "a")), licenses.scan(docs(spark, "a"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("broadcast", [common.BROADCAST_ROWS, 0])
def test_columns_are_not_changed_by_clashing_names(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    names = ["row_no", "quarry_row_no", "QUARRY_row_no_", "quarry_id", "key", "class", "label"]
    table = docs(spark, "a b c d e f", "a b c d e f", "other words stand here now").withColumns({n: F.lit(k) for k, n in enumerate(names)})
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    for kept, n in ((exact_dedup.keep_one(table), 2), (ngram_jaccard.keep_one(table), 2), (quality.keep_good(table, labels), 3)):
        rows = kept.collect()
        assert kept.columns == table.columns and len(rows) == n and all(list(r)[4:] == list(range(len(names))) for r in rows)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        common.scratch_dir(Session)
    Session.conf["spark.master"] = "local[2]"
    assert common.scratch_dir(Session).startswith(Session.conf["spark.checkpoint.dir"])
