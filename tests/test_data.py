import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import inference, sft, validate
from quarry.plans import corpus
from quarry.sources import files
from quarry.spec import EXAMPLE_DDL, RECORD_DDL

SIZES = {"train": 16, "validation": 4, "test": 4}


@pytest.fixture(scope="module")
def examples(spark):
    return corpus.examples(corpus.keys(spark, SIZES)).cache()


def test_round_robin_and_ids(spark):
    rows = corpus.keys(spark, {"train": 450, "validation": 75, "test": 75})
    counts = {r.number: r["count"] for r in rows.groupBy("number").count().collect()}
    assert [counts[k] for k in range(1, 13)] == [57, 57, *[56] * 6, 38, 37, 38, 37]
    assert rows.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()[:] == ("resume_000001", "resume_000600", 600)


def test_corpus_is_deterministic_and_independent_of_partitions(spark, examples):
    again = corpus.examples(corpus.keys(spark, SIZES).repartition(7))
    assert sorted(map(str, examples.collect())) == sorted(map(str, again.collect()))


def test_record_rules(spark, examples):
    rows = examples.collect()
    assert len(rows) == 24 and len({r.text for r in rows}) == 24
    for r in rows:
        t = r.target
        for job, newer in zip(t.experience[1:], t.experience):
            assert not job.current and job.end_date < newer.start_date
        for job in t.experience:
            assert job.start_date <= (job.end_date or "9999") and job.current == (job.end_date is None) and 1 <= len(job.responsibilities) <= 4
        assert 4 <= len(t.skills) <= 14 and len(set(t.skills)) == len(t.skills)
        assert t.name.lower() in r.text.lower().replace("  ", " ")
        if r.metadata.template_name == "bare":
            assert t.email is None and t.phone is None and t.summary is None


def test_dates_by_policy(spark):
    rows = spark.createDataFrame([("2020-03", p) for p in ("full", "abbr", "slash", "iso", "year")] + [("2020", "full")], "d string, p string")
    assert [r.o for r in rows.select(corpus.spell_date(F.col("d"), F.col("p"), "k").alias("o")).collect()] == ["March 2020", "Mar 2020", "03/2020", "2020-03", "2020", "2020"]


def table(examples):
    return examples.select(
        "id", F.col("metadata.split").alias("split"), F.col("metadata.split").alias("file_split"), "text", F.col("metadata.template_id").alias("template_id"),
        F.col("metadata.difficulty").alias("difficulty"), F.col("metadata.schema_version").alias("schema_version"), F.to_json("target").alias("record_key"), F.lit(True).alias("schema_valid"),
    )


def test_clean_dataset_has_no_violation(examples):
    found = validate.report(validate.violations(table(examples))).collect()
    assert found[0].ok and found[0].n == 0


def test_poisoned_dataset_is_found(examples):
    rows = table(examples)
    leak = rows.where("split = 'train'").limit(1).withColumns({"split": F.lit("test"), "file_split": F.lit("test")})
    rules = {r.rule for r in validate.violations(rows.unionByName(leak)).collect()}
    assert {"text_in_several_splits", "record_in_several_splits", "id_in_several_splits", "template_outside_split", "template_of_other_split"} <= rules
    assert not validate.report(validate.violations(rows.unionByName(leak))).first().ok


def test_findings_of_one_pass_equal_the_rules_one_by_one(spark, examples):
    rows = table(examples)
    leak = rows.where("split = 'train'").limit(3).withColumns({"split": F.lit("test"), "file_split": F.lit("test")})
    odd = rows.limit(4).withColumns({"split": F.lit("holdout"), "file_split": F.lit("holdout"), "text": F.lit("same"), "template_id": F.lit("template_99")})
    bad = rows.unionByName(leak).unionByName(odd).unionByName(odd.limit(1).withColumn("split", F.lit("spare"))).unionByName(rows.limit(1).withColumn("id", F.lit(None).cast("string"))).cache()
    got = sorted(map(str, validate.violations(bad).collect()))
    across = lambda found, rule: [("error", rule, None, r.key_hash) for r in validate.across_splits(found).collect()]
    want = [tuple(r) for r in validate.row_violations(bad).collect()]
    want += [("error", "id_in_several_splits" if len(r.splits) > 1 else "duplicate_id", None, r.id) for r in validate.duplicate_ids(bad).collect()]
    want += across(validate.text_duplicates(bad), "text_in_several_splits") + across(validate.record_duplicates(bad), "record_in_several_splits")
    want += [("error", f"template_{r.problem}", None, r.template_id) for r in validate.template_leakage(bad).collect()]
    want += [("warning", "repeated_text", r.split, str(r.repeated_keys)) for r in validate.within_splits(bad, text.dedup_key(F.col("text"))).collect() if r.repeated_keys]
    row = spark.createDataFrame(want, "severity string, rule string, split string, id string")
    assert got == sorted(map(str, row.collect())) and len({w[1] for w in want}) >= 9
    assert sorted(map(tuple, validate.report(validate.findings(bad)).collect())) == sorted(map(tuple, validate.report(validate.violations(bad)).collect()))


def test_the_report_reads_its_input_once(spark, examples, tmp_path):
    table(examples).write.parquet(str(tmp_path / "x"))
    plan = validate.report(validate.findings(spark.read.parquet(str(tmp_path / "x"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_row_rules(examples):
    bad = table(examples).limit(1)
    cases = {"blank_text": ("text", " "), "unknown_difficulty": ("difficulty", "odd"), "schema_version": ("schema_version", "0"), "missing_id": ("id", None), "split_differs_from_file": ("split", "test")}
    for rule, (column, value) in cases.items():
        rules = {r.rule for r in validate.row_violations(bad.withColumn(column, F.lit(value).cast("string"))).collect()}
        assert rule in rules
        assert rule != "missing_id" or rules == {"missing_id"}


def test_empty_dataset(examples):
    rules = {r.rule for r in validate.expected_counts(table(examples).limit(0), {"train": 1}).collect()}
    assert rules == {"expected_count", "empty_dataset"}


def test_features(spark):
    rows = spark.createDataFrame([(1, list(range(1, 4)), [7, 8]), (2, list(range(1, 200)), [7]), (3, [], [])], "i int, p array<int>, t array<int>")
    out = {r.i: r for r in sft.features(rows, F.col("p"), F.col("t"), eos=0, max_length=128).collect()}
    assert out[1].input_ids == [1, 2, 3, 7, 8, 0] and out[1].labels == [-100, -100, -100, 7, 8, 0] and out[1].attention_mask == [1] * 6
    assert len(out[2].input_ids) == len(out[2].labels) == 128 and out[2].truncated and out[3].input_ids == [0]
    assert [r.i for r in sft.unsupervised(sft.features(rows, F.col("p"), F.col("t"), max_length=128)).collect()] == [2]


def test_features_at_the_full_length(spark, tmp_path):
    from quarry.plans.queries import QUERIES

    words = lambda n: " ".join(["w"] * n)
    turns = [(c, k, role, words(n)) for c, p, t in ((1, 299, 400), (2, 1999, 100), (3, 2047, 5)) for k, (role, n) in enumerate((("user", p), ("assistant", t)))]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    got = {r.conv_id: (r.n_prompt, r.n_target, r.truncated, r.attended) for r in run("t3_features")}
    assert got == {1: (300, 401, False, 701), 2: (2000, 101, True, 2048), 3: (2048, 6, True, 2048)}
    assert [tuple(r) for r in run("t4_length_stats")] == [("train", 3, 2, (701 + 2048 + 2048) / 3, 2048)]
    assert [r.conv_id for r in run("t5_unsupervised")] == [3]


def test_prompts_of_long_conversations_equal_whole_ones(spark):
    tokens = lambda c: F.transform(F.filter(F.split(c, " "), lambda w: w != ""), lambda w: F.length(w))
    texts = lambda c, k: " ".join("x" * (1 + (c * 7 + k * 3 + i) % 9) for i in range((c + k) % 5))
    turns = [(c, k, "assistant" if k % 2 else "user", texts(c, k)) for c, n in ((1, 400), (2, 3), (3, 1), (4, 30)) for k in range(n)]
    turns += [(None, 0, "user", "no id"), (None, 1, "assistant", "still one"), (5, 0, "assistant", None), (2, 9, None, "no role"), (2, 10, "assistant", "after it"), (6, 1, "user", "b"), (6, 1, "user", "a"), (6, 2, "assistant", "c")]
    rows = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(6)
    for length in (16, 100_000):
        got = {(r.conv_id, r.turn): r for r in sft.conversation_features(rows, tokens, max_length=length).collect()}
        expected = {}
        for conv in {t[0] for t in turns}:
            prompt = []
            for _, turn, role, text in sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1], t[2] or "", t[3] or "")):
                own = [len(w) for w in (text or "").split()]
                if role == "assistant":
                    expected[conv, turn] = (list(prompt), own)
                prompt += [len(role) + 1, *own] if role else []
        assert set(got) == set(expected)
        for at, (prompt, own) in expected.items():
            r, whole = got[at], prompt + own + [0]
            assert (r.input_ids, r.n_prompt, r.n_target, r.truncated) == (whole[:length], len(prompt), len(own) + 1, len(whole) > length)
            assert r.labels == ([-100] * len(prompt) + own + [0])[:length] and r.attention_mask == [1] * len(r.input_ids)


def test_messages_and_target(spark, examples):
    row = spark.createDataFrame([("  hi \n",)], "t string").select(sft.messages(F.col("t"), tag="DOC").alias("m")).first()
    assert [x.role for x in row.m] == ["system", "user"] and "<DOC>\nhi\n</DOC>" in row.m[1].content
    text = examples.select(sft.canonical_target(F.col("target"), RECORD_DDL).alias("j")).first().j
    assert text.startswith('{"name":') and list(__import__("json").loads(text)) == ["name", "email", "phone", "location", "summary", "skills", "education", "experience", "projects", "certifications"]


def test_library_tokenizer_hook(spark):
    rows = spark.createDataFrame([("a bb",), (None,)], "t string")
    assert [r.ids for r in sft.encode_with(rows, "t", "ids", lambda: lambda texts: [[len(w) for w in t.split()] for t in texts]).collect()] == [[1, 2], []]


def test_resume_force_and_stale_cache(spark, tmp_path):
    def _load():  # defined here, so that it travels by value
        return lambda text: '{"name": "%s"}' % text

    path = str(tmp_path / "p")
    rows = spark.createDataFrame([(str(i), f"t{i}") for i in range(4)], "id string, text string")
    stored = lambda: inference.stored(spark, path).count()
    assert inference.run_inference(rows.limit(2), path, {"m": "1"}, _load).count() == 2
    out = inference.run_inference(rows, path, {"m": "1"}, _load)
    assert [r.id for r in out.collect()] == ["0", "1", "2", "3"] and stored() == 4
    assert inference.missing(rows, out).count() == 0
    with pytest.raises(inference.StaleCache):
        inference.run_inference(rows, path, {"m": "2"}, _load)
    inference.run_inference(rows, path, {"m": "1"}, _load, mode="fresh")
    assert stored() == 8
    inference.run_inference(rows, path, {"m": "2"}, _load, mode="force")
    assert stored() == 4


def test_a_run_killed_midway_resumes_at_its_last_chunk(spark, tmp_path):
    calls, fuse = tmp_path / "calls", tmp_path / "fuse"
    calls.mkdir()
    fuse.write_text("")

    def load():
        import os
        import uuid

        def extract(text):
            if text == late and os.path.exists(str(fuse)):
                raise RuntimeError("lost")
            with open(os.path.join(str(calls), uuid.uuid4().hex), "w") as log:
                log.write(text)
            return "{}" + text

        return extract

    rows = spark.createDataFrame([(f"i{k:03}", f"t{k}") for k in range(100)], "id string, text string")
    late = rows.where("pmod(xxhash64(id), 10) = 6").first().text  # of the seventh chunk
    run = lambda **more: inference.run_inference(rows, str(tmp_path / "p"), {"m": "1"}, load, warm_up=0, rows_per_chunk=10, **more)
    with pytest.raises(Exception, match="lost"):
        run()
    done = inference.commits(spark, str(tmp_path / "p")).collect()
    kept = {r.id for r in inference.stored(spark, str(tmp_path / "p")).collect()}
    assert len(done) == 6 and len(kept) == sum(r.rows for r in done) and f"i{late[1:]:>03}" not in kept and {r.fingerprint for r in done} == {"m=1"}
    for file in calls.iterdir():
        file.unlink()
    # a folder that no commit names, as a lost run leaves, is not read
    spark.createDataFrame([("i099", "junk", 0.0, 1)], "id string, raw_output string, latency_ms double, seq long").write.parquet(str(tmp_path / "p/rows/attempt=lost"))
    fuse.unlink()
    out = run().collect()
    assert [(r.id, r.raw_output) for r in out] == [(f"i{k:03}", "{}" + f"t{k}") for k in range(100)]
    called = [f.read_text() for f in calls.iterdir()]
    assert sorted(called) == sorted(f"t{k}" for k in range(100) if f"i{k:03}" not in kept)  # no call is made twice, none is left out
    for file in calls.iterdir():
        file.unlink()
    assert len(run().collect()) == 100 and not list(calls.iterdir())


def test_the_last_of_rows_with_one_id_counts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one"), ("b", "x"), ("a", "two"), (None, "none")], "id string, text string").coalesce(1)
    out = inference.run_inference(rows, str(tmp_path / "p"), {}, lambda: str.upper, rows_per_chunk=1).collect()
    assert len(out) == 2 and {r.id: r.raw_output for r in out}["b"] == "X" and {r.id: r.raw_output for r in out}["a"] in ("ONE", "TWO")
    assert inference.run_inference(rows.limit(0), str(tmp_path / "q"), {}, lambda: str.upper).collect() == []


def test_positions(spark):
    rows = spark.range(1000).selectExpr("concat('k', id * 37 % 1000) AS id", "id AS v").repartition(7)
    assert [r.id for r in inference.positions(rows).orderBy("position").collect()] == sorted(f"k{i}" for i in range(1000))


def test_files(spark, tmp_path, examples):
    path = str(tmp_path / "s")
    files.write_splits(examples.withColumn("split", F.col("metadata.split")), path)
    back = files.read_jsonl(spark, path, EXAMPLE_DDL)
    assert sorted(map(str, back.select("id", "text", "target").collect())) == sorted(map(str, examples.select("id", "text", "target").collect()))
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": "1"}\n\n{"id": \n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(bad), "id string").collect()
    kept = files.read_jsonl(spark, str(bad), "id string", strict=False).cache()
    assert kept.count() == 2 and kept.where("_corrupt_record is not null and file like '%bad.jsonl'").count() == 1
    for k in ("one", "two"):  # two files of one name
        (tmp_path / "a" / k).mkdir(parents=True)
        (tmp_path / "a" / k / "x.bin").write_bytes(k.encode())
    listing = files.manifest(spark, f"file:{tmp_path}//a/")
    assert {(r.path, r.bytes, r.sha256) for r in listing.collect()} == {(f"{k}/x.bin", 3, hashlib.sha256(k.encode()).hexdigest()) for k in ("one", "two")}
    assert files.verify_manifest(listing, listing).count() == 0
    wrong = listing.withColumn("sha256", F.when(F.col("path") == "one/x.bin", "0").otherwise(F.col("sha256"))).unionByName(spark.createDataFrame([("gone", 1, "1")], "path string, bytes long, sha256 string"))
    assert {(r.path, r.problem) for r in files.verify_manifest(wrong, listing).collect()} == {("one/x.bin", "content"), ("gone", "missing")}


def test_difficulty_rule(spark):
    job = lambda n: {"responsibilities": ["x"] * n}
    full = dict(email="e", phone="p", location="l", summary="s", projects=["x"], certifications=["x"], experience=[job(2)], skills=["x"] * 4, hard_style=False, date_policy="iso", base_level=0)
    ddl = "email string, phone string, location string, summary string, projects array<string>, certifications array<string>, experience array<struct<responsibilities:array<string>>>, skills array<string>, hard_style boolean, date_policy string, base_level int"
    three_missing, many = dict(email=None, location=None, projects=[]), dict(skills=["x"] * 10)
    cases = [
        ({}, 0, "easy"), (many, 1, "easy"), (many | dict(date_policy="mixed"), 2, "medium"), (many | three_missing | dict(date_policy="mixed"), 3, "hard"), (dict(hard_style=True), 1, "easy"),
        (dict(base_level=1), 0, "medium"), (dict(base_level=1, hard_style=True), 1, "medium"), (dict(base_level=1, hard_style=True, experience=[job(2)] * 3), 3, "hard"), (dict(base_level=2), 0, "hard"),
        (dict(experience=[job(5)]), 0, "easy"), (dict(experience=[job(6)]), 1, "easy"), (dict(email=None, location=None), 0, "easy"), (three_missing, 1, "easy"),
    ]
    rows = corpus.difficulty(spark.createDataFrame([full | change for change, _, _ in cases], ddl)).collect()
    assert [(r.hardships, r.difficulty) for r in rows] == [(n, d) for _, n, d in cases]


def test_templates_and_their_texts(spark, examples):
    rows = corpus.templates(spark).collect()
    assert len(rows) == 12 and len({r.style for r in rows}) == 12 and {r.layout for r in rows[:8]} == set(corpus.LAYOUTS) and {r.skill_form for r in rows} == set(corpus.SKILL_FORMS) and len({tuple(r.section_order) for r in rows}) >= 6
    many = corpus.examples(corpus.keys(spark, {"train": 160, "validation": 20, "test": 20})).collect()
    for r in many:
        lines = [x.strip() for x in r.text.replace("  ", " ").split("\n")]
        own = set(next(t for t in rows if t.template_id == r.metadata.template_id).section_order)
        for section, words in corpus.HEADINGS.items():
            there = any(x.lower() in {w.lower() for w in words} for x in lines)
            assert there == (section in own and bool(r.target[section]))
        for skill in r.target.skills:
            assert skill in " ".join(lines)
        assert ("=" * 24 in r.text) == (r.metadata.template_name.endswith("ruled"))
    for style, lines in (("ruled", "   \n"), ("loose", "\n\n")):
        assert any(lines in r.text for r in many if style in r.metadata.template_name)


def test_texts_prove_their_records(spark):
    many = corpus.examples(corpus.keys(spark, {"train": 240, "validation": 40, "test": 40})).cache()
    proven = {r.id: r for r in corpus.proofs(many).collect()}
    assert len(proven) == 320 and all(r.proven for r in proven.values()) and sum(r.duties is None for r in proven.values()) > 20
    # a text that says something else is found out
    changes = {"phone": F.regexp_replace("text", r"\+91-(\d)", "+91-0$1"), "dates": F.regexp_replace("text", "(- |to |until )(Present|Now|Current)", "$1Jan 2021"), "duties": F.regexp_replace("text", "tests for", "poems about")}
    for changed in changes.values():
        rows = many.withColumn("was", F.col("text")).withColumn("text", changed).where("text <> was").drop("was")
        assert rows.count() > 5
        assert corpus.proofs(rows).where("proven and duties is not null").count() == 0


def test_whole_manifest(spark, examples, tmp_path):
    files.write_splits(examples.withColumn("split", F.col("metadata.split")), str(tmp_path / "s"))
    rows = {(r.kind, r.name): r.value for r in corpus.whole_manifest(examples, files.manifest(spark, str(tmp_path / "s"), "*.json")).collect()}
    assert rows["count", "train"] == "16" and rows["template", "test/template_11"] == "2" and rows["template_split", "template_09"] == "validation"
    assert sum(int(v) for (k, n), v in rows.items() if k == "difficulty") == 24
    digests = {str(f.relative_to(tmp_path / "s")): hashlib.sha256(f.read_bytes()).hexdigest() for f in (tmp_path / "s").rglob("*.json")}
    assert {n: v for (k, n), v in rows.items() if k == "sha256"} == digests and len(digests) >= 3
