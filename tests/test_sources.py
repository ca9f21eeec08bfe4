"""Files in and out, converters, configuration, streams."""

import json

from pyspark.sql import functions as F

from itemloom import schemas
from itemloom.operators import sampling
from itemloom.sources import files, sinks
from itemloom.streaming import resume


def test_corrupt_documents_are_reported(spark, tmp_path):
    good = {"source_file": "a.pdf", "questions": [{"question_number": "1", "correct_answer": "2"}, {"question_number": "1", "correct_answer": "3"}]}
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "good.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text("{nope")
    rows = files.documents_json(spark, str(tmp_path), schemas.RAW_ANSWERS).cache()
    assert rows.count() == 2 and rows.where("_corrupt_record is not null").count() == 1
    from itemloom.operators.answers import raw_answers

    assert [tuple(r) for r in raw_answers(rows.where("source_file is not null")).collect()] == [("a.pdf", 1, "3")]


def test_jsonl_defaults_and_ordinals(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"paper_id":"p","question_number":1}\n\n{"paper_id":"q","subject":"Physics"}\n')
    rows = {r.paper_id: r for r in files.jsonl(spark, str(path)).collect()}
    assert rows["p"].difficulty == "medium" and rows["p"].options == [] and rows["q"].subject == "Physics"
    assert sorted(r._idx for r in files.jsonl_with_ordinal(spark, str(path)).collect()) == [0, 2]


def test_whole_texts_discovery_and_latest(spark, tmp_path):
    for n in ("b", "a"):
        (tmp_path / f"{n}.mmd").write_text(f"Q1. {n}")
    assert {r.paper_id: r.content for r in files.whole_texts(spark, str(tmp_path)).collect()} == {"a": "Q1. a", "b": "Q1. b"}
    assert [r.path[-5:] for r in files.discovered(spark, str(tmp_path), "*.mmd", 1).collect()] == ["a.mmd"]
    assert sampling.latest_file(spark, str(tmp_path), "*.mmd").count() == 1


def test_converter_errors_are_rows(spark, tmp_path):
    def convert(name, content):
        if b"bad" in content:
            raise ValueError("unreadable")
        return [(i, 1, t) for i, t in enumerate(content.decode().split())]

    (tmp_path / "a.bin").write_bytes(b"Q1. x")
    (tmp_path / "b.bin").write_bytes(b"bad")
    rows = files.converted(spark, str(tmp_path), "*.bin", convert).collect()
    assert sorted((r.text or "", r.error or "") for r in rows) == [("", "unreadable"), ("Q1.", ""), ("x", "")]


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("q", 1, "c")], "paper_id string, question_number int, t string")
    sinks.to_parsed_json(items, str(tmp_path / "parsed"))
    docs = {r.paper_id: r for r in spark.read.json(str(tmp_path / "parsed")).collect()}
    assert docs["p"].total_questions == 2 and [q.t for q in docs["p"].questions] == ["a", "b"] and docs["q"].parsing_method == "markdown"
    sinks.to_paper_folders(items, str(tmp_path / "folders"))
    assert spark.read.json(str(tmp_path / "folders")).count() == 3
    sinks.to_stats_json(items, str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats" / "totals")).first().rows == 3 and spark.read.json(str(tmp_path / "stats" / "per_paper")).count() == 3
    sinks.to_consolidated_json(items, str(tmp_path / "one"))
    sinks.to_vector_store(spark.createDataFrame([(1, [0.5], "m")], schemas.VECTORS), str(tmp_path / "vectors"))
    assert files.cached(spark, str(tmp_path / "made"), lambda: items).count() == 3
    assert files.cached(spark, str(tmp_path / "made"), lambda: 1 / 0).count() == 3


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("ITEMLOOM_WORKERS", "5")
    (tmp_path / "c.json").write_text('{"output_dir": "o", "other": 1}')
    assert files.Config.load(str(tmp_path / "c.json")).output_dir == "o" and files.Config.load().workers == 5
    assert files.Config.load(str(tmp_path / "absent.json")) == files.Config.load()


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    schema = "event_id long, event_type string"
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("event_id"), F.lit("x").alias("event_type"))
    run = lambda: resume.resume(resume.file_stream(spark, str(tmp_path / "in"), schema), lambda b: b, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    n = lambda: spark.read.parquet(str(tmp_path / "out")).count()
    rows(0, 50).write.parquet(str(tmp_path / "in"))
    run()
    assert n() == 50
    run()
    assert n() == 50
    rows(50, 80).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert n() == 80


def test_quota_sample_and_backfill(spark):
    items = spark.range(200).select(F.lit("p").alias("paper_id"), F.col("id").alias("question_number"), F.lit("Physics").alias("subject"), F.lit("mcq").alias("question_type"), F.when(F.col("id") < 5, "hard").otherwise("easy").alias("difficulty"))
    quota = sampling.quotas(spark, "hard")
    assert {(r.question_type, r.difficulty): r.quota for r in quota.collect()} == {("mcq", "easy"): 2, ("mcq", "medium"): 8, ("mcq", "hard"): 10, ("integer", "easy"): 1, ("integer", "medium"): 4, ("integer", "hard"): 5}
    key = ["paper_id", "question_number"]
    short = sampling.quota_sample(items, quota, 3, key)
    assert short.count() == 7 and sampling.quota_sample(items, quota, 3, key, backfill=True).count() == 20
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, sampling.quota_sample(items.repartition(5), quota, 3, key).collect()))
