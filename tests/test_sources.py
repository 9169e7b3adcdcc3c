import json

from petalstream.sources import files
from petalstream.streaming import ingest


def test_json_lines_round_trip(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"url": "https://a /x", "title": " nan ", "price_raw": null}\n\n{broken\n{"url": "b", "title": "e\\u0301  f", "content_hash": "given"}\n')
    rows = files.read_json_lines(spark, str(p), files.PRODUCT)
    good = files.validate(rows.where("_corrupt_record is null").drop("_corrupt_record")).orderBy("url").collect()
    assert [(r.url, r.title, r.price_raw) for r in good] == [("b", "é f", ""), ("https://a/x", "", "")]
    assert good[0].content_hash == "given" and len(good[1].content_hash) == 16
    files.write_json_lines(files.validate(rows.drop("_corrupt_record")), str(tmp_path / "out"))
    assert spark.read.schema(files.PRODUCT).json(str(tmp_path / "out")).where("url <> ''").count() == 2


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"seed": 1, "corrupted": {"u": ["a", "b"], "v": []}}, indent=1))
    got = sorted((r.url, r.label) for r in files.read_manifest(spark, str(p)).collect())
    assert got == [("u", "a"), ("u", "b")]
    truth = files.read_manifest(spark, str(p))
    files.write_manifest(truth, str(tmp_path / "m2"), 1, {"a": 0.5}, 3, 4)
    assert sorted((r.url, r.label) for r in files.read_manifest(spark, str(tmp_path / "m2")).collect()) == got
    doc = json.loads(next((tmp_path / "m2").glob("part-*")).read_text())
    assert doc == {"seed": 1, "rates": {"a": 0.5}, "n_clean_input": 3, "n_corrupt_output": 4, "summary": {"a": 1, "b": 1}, "corrupted": {"u": ["a", "b"]}}
    files.write_manifest(truth.limit(0), str(tmp_path / "m3"), 1)
    assert files.read_manifest(spark, str(tmp_path / "m3")).count() == 0


def test_reports_and_results(spark, tmp_path):
    for c in ("dense", "hybrid"):
        files.write_report(spark.createDataFrame([(c, 0.5)], "config string, recall double"), str(tmp_path / f"retrieval_{c}"))
    got = files.read_results(spark, str(tmp_path / "retrieval_*" / "part-*"), "config string, recall double").collect()
    assert sorted(r.config for r in got) == ["dense", "hybrid"] and all("retrieval_" in r.file for r in got)
    assert files.read_results(spark, str(tmp_path / "none_*"), "config string").count() == 0
    files.write_results(spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "config string, state string, n int"), str(tmp_path / "cells"), "config", "state")
    files.write_results(spark.createDataFrame([("a", "x", 3)], "config string, state string, n int"), str(tmp_path / "cells"), "config", "state")
    assert {r.config: r.n for r in spark.read.parquet(str(tmp_path / "cells")).collect()} == {"a": 3, "b": 2}
    assert [tuple(r) for r in files.values_table(spark, [("q", 1)], "word string, n int").collect()] == [("q", 1, 0)]


def test_settings_fail_at_once(spark, monkeypatch):
    from petalstream.plans.session import require

    monkeypatch.setenv("PETAL_A", "x")
    assert require(spark, "PETAL_A") == {"PETAL_A": "x"}
    try:
        require(spark, "PETAL_C", "PETAL_A", "PETAL_B")
    except RuntimeError as e:
        assert "PETAL_B, PETAL_C" in str(e)
    else:
        raise AssertionError


def test_read_through(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.read_through(spark, str(tmp_path / "t"), make).count() == 3
    assert calls == [1]


def test_upserting_stream(spark, tmp_path):
    schema = "url string, seq long, v string"
    src, out, cp = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "cp")
    batches = ([("a", 1, "x"), ("b", 2, "y")], [("a", 3, "z"), ("c", 4, "w")], [("a", 2, "late")])
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.upsert_into(ingest.stream_parquet(spark, src, schema), out, "url", "seq", cp).awaitTermination(120)
    rows = {r.url: r.v for r in spark.read.parquet(out).collect()}
    assert rows == {"a": "z", "b": "y", "c": "w"}


def test_windowed_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'k' kind union all select timestamp'2024-01-01 00:50:00', 'k' union all select timestamp'2024-01-01 09:00:00', 'k'").write.parquet(src)
    stream = ingest.windowed_counts(ingest.stream_parquet(spark, src, "ts timestamp, kind string"), "ts", "kind")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("windows").collect()) == [1, 2]
