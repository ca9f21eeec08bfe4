"""Jobs, the command line, providers that answer differently each time, and the shared folder."""

import random
import types

import pytest
from pyspark.sql import functions as F

from itemloom import jobs
from itemloom.__main__ import main
from itemloom.operators import enrich, sampling
from itemloom.shared import shared_folder
from itemloom.sources import sinks


def items_of(spark, n):
    k = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("p"), (k % 5).cast("string")).alias("paper_id"), k.cast("int").alias("question_number"), F.concat(F.lit("Find item "), k.cast("string")).alias("question_text"),
        F.array(*[F.lit(f"choice {i}") for i in range(4)]).alias("options"), F.lit("mcq").alias("question_type"), F.lit("1").alias("answer_raw"), F.lit(1).alias("correct_index"),
        F.lit(None).cast("int").alias("correct_answer"), F.element_at(F.lit(["Physics", "Chemistry", "Mathematics"]), (k % 3 + 1).cast("int")).alias("subject"), F.lit("General").alias("topic"), F.lit("easy").alias("difficulty"), F.lit(2024).alias("year"),
    )


def test_a_fickle_provider_keeps_every_item_once(spark):
    class Fickle:
        """Other actions for the same prompt at every call."""

        def complete(self, prompt: str) -> str:
            import json

            rows = json.loads(prompt.partition("\n")[2])
            if not isinstance(rows, list):
                return "no JSON"
            return json.dumps([{"id": r["id"], "action": random.SystemRandom().choice(enrich.ACTIONS), "reason": ""} for r in rows])

    items = items_of(spark, 200)
    chosen, key = items.where("question_number < 100"), ["paper_id", "question_number"]
    out = enrich.transform_questions(chosen, items, Fickle(), key, ["subject"]).collect()
    assert len(out) == 100 and len({(r.paper_id, r.question_number) for r in out}) == 100


def test_rows_without_an_action_stay(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", "discard"), (3, None, "discard")], "id long, s string, action string")
    pool = spark.createDataFrame([(1, "a"), (2, "a"), (9, "a")], "id long, s string")
    out = {r.id: (r.action, r.replaced) for r in sampling.replaced(rows, pool, 0, ["id"], ["s"]).collect()}
    assert out == {1: (None, False), 9: ("rephrase", True), 3: ("rephrase", False)}


def test_unknown_provider():
    with pytest.raises(ValueError, match="unknown provider"):
        enrich.provider_named("none")


def test_tagging_goes_on_where_a_batch_failed(spark, tmp_path):
    class Broken:
        def complete(self, prompt: str) -> str:
            raise RuntimeError

    items, key, out = items_of(spark, 30).drop("subject", "topic", "difficulty"), ["paper_id", "question_number"], str(tmp_path / "tags")
    assert enrich.tagged_into(items, Broken(), key, out).count() == 0
    assert enrich.tagged_into(items, enrich.OfflineProvider(), key, out).count() == 30
    assert enrich.tagged_into(items, Broken(), key, out).count() == 30


def test_command_line(spark, tmp_path, capsys):
    path, tex = str(tmp_path / "items.parquet"), tmp_path / "paper.tex"
    items_of(spark, 90).write.parquet(path)
    assert main(["paper", "--items", path, "--out", str(tex), "--difficulty", "easy", "--generate-solutions", "--transform"], spark) == 0
    assert tex.read_text().count("\\question\n") == 24 and "\\section*{Solutions}" in tex.read_text()
    assert main(["tag", "--items", path, "--out", str(tmp_path / "tags")], spark) == 0
    assert main(["embed", "--items", path, "--out", str(tmp_path / "store")], spark) == 0
    assert main(["search", "--store", str(tmp_path / "store"), "--text", "Topic: General\nQuestion: Find item 7", "-k", "3"], spark) == 0
    assert main(["preview", "--items", path, "-n", "2"], spark) == 0
    said = capsys.readouterr().out
    assert "90 items tagged" in said and "Find item 7" in said and "Q0. Find item 0" in said
    with pytest.raises(ValueError, match="unknown provider"):
        main(["tag", "--items", path, "--out", "x", "--provider", "nobody"], spark)


def test_batch_isolates_errors(spark):
    def job(name):
        if name == "b":
            raise OSError("gone")

    rows = jobs.run_batch(["a", "b", "c"], job, 2)
    assert [(r["name"], r["status"], r["error"]) for r in rows] == [("a", "success", None), ("b", "error", "gone"), ("c", "success", None)]
    assert jobs.summary(spark, []).first().total == 0


def test_without_a_compiler_there_is_no_pdf(tmp_path, monkeypatch):
    monkeypatch.setattr(sinks.shutil, "which", lambda _: None)
    assert sinks.compile_latex("x", str(tmp_path / "x.pdf")) is False


def test_shared_folder_is_asked_for_on_a_cluster():
    conf = types.SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    session = lambda master: types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master, getConf=lambda: conf))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
    assert shared_folder(session("local[4]")).startswith("file:")
