import pytest

from quarry.operators import inference


def test_a_chunk_is_not_read_to_count_it(spark, tmp_path, monkeypatch):
    """Commits name the rows of each chunk, empty ones too, and no chunk's stored rows are read by a path of their own."""
    read, table = [], inference._table
    monkeypatch.setattr(inference, "_table", lambda s, path, ddl: read.append(path) or table(s, path, ddl))
    rows = spark.createDataFrame([("a", "one"), ("b", "x"), ("c", "y")], "id string, text string")
    out = inference.run_inference(rows, str(tmp_path / "p"), {"m": "1"}, lambda: str.upper, rows_per_chunk=1)
    done = inference.commits(spark, str(tmp_path / "p")).orderBy("number").collect()
    assert [r.chunk for r in done] == [0, 1, 2] and sum(r.rows for r in done) == 3 == out.count() and {r.fingerprint for r in done} == {"m=1"}
    assert not any("attempt=" in path for path in read)


def test_short_chunks_are_scored_together(spark, tmp_path):
    """Each was a job of its own, one after another, so time grew with the number of chunks whatever the cluster."""
    rows = spark.range(400).selectExpr("concat('k', id) AS id", "concat('t', id) AS text")
    out = inference.run_inference(rows, str(tmp_path / "p"), {"m": "1"}, lambda: str.upper, rows_per_chunk=10)
    done = inference.commits(spark, str(tmp_path / "p")).orderBy("number").collect()
    assert [(r.number, r.chunk) for r in done] == [(k + 1, k) for k in range(40)] and len({r.attempt for r in done}) < 20
    assert [r.rows for r in done] == [r.n for r in rows.selectExpr("pmod(xxhash64(id), 40) AS c").groupBy("c").agg({"*": "count"}).toDF("c", "n").orderBy("c").collect()]
    assert {(r.id, r.raw_output) for r in out.collect()} == {(f"k{k}", f"T{k}") for k in range(400)} and inference.stored(spark, str(tmp_path / "p")).count() == 400


def test_long_chunks_are_committed_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inference, "SECONDS_PER_COMMIT", 0.0)
    rows = spark.range(50).selectExpr("concat('k', id) AS id", "'t' AS text")
    assert inference.run_inference(rows, str(tmp_path / "p"), {"m": "1"}, lambda: str.upper, rows_per_chunk=10).count() == 50
    assert len({r.attempt for r in inference.commits(spark, str(tmp_path / "p")).collect()}) == 5


def test_how_many_chunks_go_together():
    together = inference.chunks_together
    assert [together(1, 0.0), together(8, 2.5), together(8, 5.0), together(8, 16.0), together(8, 80.0), together(8, 900.0), together(1, 30.0)] == [2, 16, 16, 5, 1, 1, 1]


def test_a_failure_among_chunks_scored_together_keeps_those_before_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inference, "chunks_together", lambda width, seconds: 2 * width)

    def load():
        def extract(text):
            if text == late:
                raise RuntimeError("lost")
            return text

        return extract

    rows = spark.createDataFrame([(f"i{k:03}", f"t{k}") for k in range(200)], "id string, text string")
    late, path = rows.where("pmod(xxhash64(id), 20) = 12").first().text, str(tmp_path / "p")  # 1, 2, 4, 8 chunks: the sixth of the fourth job
    with pytest.raises(Exception, match="lost"):
        inference.run_inference(rows, path, {"m": "1"}, load, warm_up=0, rows_per_chunk=10)
    done = inference.commits(spark, path).collect()
    assert sorted(r.chunk for r in done) == list(range(12)) and inference.stored(spark, path).count() == sum(r.rows for r in done) == rows.where("pmod(xxhash64(id), 20) < 12").count()


def test_texts_dealt_to_chunks_go_when_they_are_scored(spark, tmp_path, monkeypatch):
    """Each run left a copy of its texts."""
    monkeypatch.setattr(inference, "scratch", lambda s: str(tmp_path / "work"))
    rows = spark.createDataFrame([("a", "one"), ("b", "x")], "id string, text string")
    out = inference.run_inference(rows, str(tmp_path / "p"), {"m": "1"}, lambda: str.upper, rows_per_chunk=1)
    assert not list((tmp_path / "work").glob("chunk=*")) and [(r.id, r.raw_output) for r in out.collect()] == [("a", "ONE"), ("b", "X")]
