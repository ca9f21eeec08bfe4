"""External models behind a provider interface, with an offline stand-in (inventory E1-E12).

A provider is called per Arrow batch in ``mapInPandas``; parsing, repair,
validation and fallbacks are Columns around the call.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.latex import fix_latex, item_error
from ..functions.prompts import annotation_prompt, correct_text, model_answer, parse_answers, parse_or_repair, prompt_row
from ..shared import Store, shared_folder
from .calls import Paced
from .sampling import not_done, replaced, sample_n

TAG = "struct<id:int,subject:string,topic:string,difficulty:string>"
ACTION = "struct<id:int,action:string,reason:string>"
ITEM = "struct<question_text:string,options:array<string>,correct_answer:string>"
ANNOTATION = "struct<difficulty:string,concepts:array<string>,computable_solution:string,estimated_time:string,prerequisites:array<string>,topic:string>"
ACTIONS = ("change_numbers", "rephrase", "fix_incomplete", "discard")
BATCH = 10


class Provider(Protocol):
    """Anything that answers a prompt; it travels to the workers, so it must be picklable."""

    def complete(self, prompt: str) -> str: ...


def provider_named(name: str) -> Provider:
    """The provider of a name; an unknown one is an error."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name]()


class OfflineProvider:
    """Answers by rule: tags and actions for JSON batches, the item itself for a rewrite."""

    def complete(self, prompt: str) -> str:
        task, _, body = prompt.partition("\n")
        if task == "TAG":
            return json.dumps([{"id": r["id"], "subject": self.subject(r["text"]), "topic": "General", "difficulty": ("easy", "medium", "hard")[len(r["text"]) % 3]} for r in json.loads(body)])
        if task == "ACTION":
            return json.dumps([{"id": r["id"], "action": ACTIONS[len(r["text"]) % 4], "reason": "by length"} for r in json.loads(body)])
        if task == "ANNOTATE":
            return json.dumps({"difficulty": "medium", "concepts": [], "computable_solution": "", "estimated_time": "2 min", "prerequisites": [], "topic": "General"})
        return body

    @staticmethod
    def subject(text: str) -> str:
        low = text.lower()
        if "bond" in low or "acid" in low:
            return "Chemistry"
        return "Physics" if "force" in low or "energy" in low else "Mathematics"


def completed(rows: DataFrame, provider: Provider, prompt: str = "prompt") -> DataFrame:
    """Adds ``response``; a call that fails gives null, for the fallbacks to see.

    A ``calls.Paced`` provider keeps to its limits and retries.
    """
    if isinstance(provider, Paced):
        return provider.completed(rows, prompt).drop("tries", "call_error")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf[prompt]:
                try:
                    out.append(provider.complete(text))
                except Exception:  # noqa: BLE001  any failure of an outside service is a null response
                    out.append(None)
            yield pdf.assign(response=pd.Series(out, index=pdf.index, dtype=object))

    from ..shipping import ship

    ship(rows.sparkSession)
    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("response", StringType())]))


def prompt_batches(items: DataFrame, key: list[str], task: str, size: int = BATCH) -> DataFrame:
    """One prompt for each ``size`` items of a paper; ids count from 0 inside a batch."""
    order = Window.partitionBy("paper_id").orderBy(*key)
    nth = F.row_number().over(order) - 1
    rows = items.withColumns({"batch": F.floor(nth / size).cast("int"), "id": (nth % size).cast("int"), "p": prompt_row("question_text", "options")})
    listed = F.array_sort(F.collect_list(F.struct("id", F.col("p.text").alias("text"), F.col("p.options").alias("options"))))
    return rows.groupBy("paper_id", "batch").agg(F.concat(F.lit(task + "\n"), F.to_json(listed)).alias("prompt"), F.count("*").cast("int").alias("n"), F.collect_list(F.struct("id", *key)).alias("members"))


def tagged(items: DataFrame, provider: Provider, key: list[str]) -> DataFrame:
    """Subject, topic and difficulty of each item; a failed batch has the defaults and status 'failed' (decision B12)."""
    answers = completed(prompt_batches(items, key, "TAG"), provider)
    parsed = answers.withColumn("tags", parse_answers("response", TAG, F.col("n")))
    rows = parsed.select("tags", F.explode("members").alias("m"))
    tag = F.try_element_at(F.filter("tags", lambda t: t.id == F.col("m.id")), F.lit(1))
    tags = rows.select(*[F.col(f"m.{k}").alias(k) for k in key], tag.alias("tag"))
    out = items.join(tags, key, "left")
    return out.withColumns({
        "subject": F.coalesce("tag.subject", F.lit("Unknown")), "topic": F.coalesce("tag.topic", F.lit("Unknown")),
        "difficulty": F.coalesce("tag.difficulty", F.lit("medium")), "tag_status": F.when(F.col("tag").isNull(), "failed").otherwise("ok"),
    }).drop("tag")


def classified(items: DataFrame, provider: Provider, key: list[str]) -> DataFrame:
    """One of four actions for each item; 'rephrase' where the model fails or answers otherwise."""
    answers = completed(prompt_batches(items, key, "ACTION"), provider)
    rows = answers.withColumn("acts", F.from_json("response", f"array<{ACTION}>")).select("acts", F.explode("members").alias("m"))
    act = F.try_element_at(F.filter("acts", lambda t: t.id == F.col("m.id")), F.lit(1)).action
    acts = rows.select(*[F.col(f"m.{k}").alias(k) for k in key], act.alias("action"))
    return items.join(acts, key, "left").withColumn("action", F.when(F.col("action").isin(*ACTIONS), F.col("action")).otherwise("rephrase"))


def transformed(items: DataFrame, provider: Provider) -> DataFrame:
    """Rewritten items; LaTeX repaired, answer canonical, invalid or failed results fall back to the original."""
    prompt = F.concat(F.upper("action"), F.lit("\n"), F.to_json(F.struct("question_text", "options", F.col("answer_raw").alias("correct_answer"))))
    rows = completed(items.withColumn("prompt", prompt), provider)
    new = parse_or_repair("response", ITEM, "question_text")
    rows = rows.withColumn("new", new)
    rows = rows.withColumn("new_text", fix_latex("new.question_text")).withColumn("new_options", F.transform("new.options", fix_latex))
    rows = rows.withColumn("new_answer", model_answer("new.correct_answer", "new_options", "question_type", "answer_raw"))
    valid = F.col("new").isNotNull() & (item_error("new_text", "new_options", "question_type") == "")
    status = F.when(F.col("response").isNull(), "error_fallback").when(valid, "transformed").otherwise("fallback_original")
    ok = status == "transformed"
    return rows.withColumn("transform_status", status).withColumns({
        "question_text": F.when(ok, F.col("new_text")).otherwise(F.col("question_text")), "options": F.when(ok, F.col("new_options")).otherwise(F.col("options")),
        "answer_raw": F.when(ok, F.col("new_answer")).otherwise(F.col("answer_raw")),
    }).drop("prompt", "response", "new", "new_text", "new_options", "new_answer")


def transform_questions(selected: DataFrame, pool: DataFrame, provider: Provider | None, key: list[str], strata: list[str], seed: int = 0) -> DataFrame:
    """E5: classify, replace what is discarded from the pool, transform; without a provider the input comes back."""
    if provider is None:
        return selected
    judged = staged(classified(selected, provider, key), "actions")
    return transformed(replaced(judged, pool, seed, key, strata), provider)


def staged(rows: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder, so a provider is asked once however often the rows are read."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def tagged_into(items: DataFrame, provider: Provider, key: list[str], out: str) -> DataFrame:
    """Tag what ``out`` does not hold yet and append it; items of failed batches stay open for the next call."""
    spark = items.sparkSession
    if Store(spark).sizes(out):
        items = not_done(items, spark.read.parquet(out), key)
    rows = staged(tagged(items, provider, key), "tags")
    rows.where("tag_status = 'ok'").write.mode("append").parquet(out)
    return spark.read.schema(rows.schema).parquet(out)


def annotated(items: DataFrame, provider: Provider, sample: int | None = None, seed: int = 0, key: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Six-field annotations of items that have none, optionally of a sample; null where the model fails."""
    from .filters import unannotated

    rows = unannotated(items)
    rows = sample_n(rows, sample, seed, *key) if sample else rows
    rows = completed(rows.withColumn("prompt", F.concat(F.lit("ANNOTATE\n"), annotation_prompt("question_text", "options"))), provider)
    return rows.withColumn("annotation", parse_or_repair("response", ANNOTATION, "difficulty")).drop("prompt", "response")


def metadata_of(items: DataFrame, provider: Provider) -> DataFrame:
    """Per item metadata and the correct option's text (block options as structs)."""
    rows = completed(items.withColumn("prompt", F.concat(F.lit("TAG\n"), F.to_json(F.array(F.struct(F.lit(0).alias("id"), F.col("question_prompt").alias("text")))))), provider)
    tag = F.try_element_at(parse_answers("response", TAG, F.lit(1)), F.lit(1))
    details = F.struct(F.col("correct_option_id"), correct_text("options", "correct_option_id").alias("correct_option_text"))
    return rows.withColumns({"metadata": tag, "answer_details": details}).drop("prompt", "response")


def variation(contexts: DataFrame, provider: Provider) -> DataFrame:
    """A new item from retrieved context; ``ok`` is false where no JSON came back even after repair."""
    rows = completed(contexts.withColumn("prompt", F.concat(F.lit("VARY\n"), F.col("context"))), provider)
    return rows.withColumn("item", parse_or_repair("response", ITEM, "question_text")).withColumn("ok", F.col("item").isNotNull()).drop("prompt", "response")


def solutions(items: DataFrame, provider: Provider) -> DataFrame:
    """A worked solution as text; an error is text, too."""
    rows = completed(items.withColumn("prompt", F.concat(F.lit("SOLVE\n"), F.col("question_text"))), provider)
    return rows.withColumn("solution", F.coalesce("response", F.lit("Error: no solution"))).drop("prompt", "response")


#: Providers by name; register one here to use it from the command line.
PROVIDERS: dict[str, type] = {"offline": OfflineProvider}
