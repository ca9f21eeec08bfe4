"""Command line (inventory O9): ``python -m itemloom paper|tag|embed|search|preview ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import enrich, render, retrieval
from .operators.sampling import PRESETS
from .sources import files, sinks

KEY = ["paper_id", "question_number"]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="itemloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    paper = sub.add_parser("paper", help="sample and render one paper")
    paper.add_argument("--items", required=True)
    paper.add_argument("--out", required=True, help="LaTeX file; a PDF is made beside it where a compiler is installed")
    paper.add_argument("--difficulty", choices=sorted(PRESETS), default="medium")
    paper.add_argument("--years", type=int, nargs="*")
    paper.add_argument("--topics", nargs="*")
    paper.add_argument("--title", default="Practice Paper")
    paper.add_argument("--seed", type=int, default=0)
    paper.add_argument("--generate-solutions", action="store_true")
    paper.add_argument("--transform", action="store_true")
    paper.add_argument("--provider", default="offline")
    tag = sub.add_parser("tag", help="tag items that have no tags yet; run again to go on")
    tag.add_argument("--items", required=True)
    tag.add_argument("--out", required=True)
    tag.add_argument("--provider", default="offline")
    embed = sub.add_parser("embed", help="write a vector store of the items")
    embed.add_argument("--items", required=True)
    embed.add_argument("--out", required=True)
    search = sub.add_parser("search", help="the nearest items to a text")
    search.add_argument("--store", required=True)
    search.add_argument("--text", required=True)
    search.add_argument("-k", type=int, default=5)
    show = sub.add_parser("preview", help="the first items, normalised")
    show.add_argument("--items", required=True)
    show.add_argument("-n", type=int, default=5)
    return top


def items_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith("parquet") else files.jsonl(spark, path, schemas.TAGGED)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("itemloom").getOrCreate()
    if args.command == "paper":
        provider = enrich.provider_named(args.provider)
        rows = items_of(spark, args.items).withColumn("answer_raw", F.coalesce(F.col("correct_index").cast("string"), F.col("correct_answer").cast("string")))
        doc = render.generate_paper(rows, args.difficulty, args.seed, args.years, args.topics, args.title, tuple(KEY), provider if args.generate_solutions else None, provider if args.transform else None).first()
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(doc["document"])
        made = sinks.compile_latex(doc["document"], args.out.rsplit(".", 1)[0] + ".pdf")
        print(f"{doc['n_questions']} questions in {args.out}" + (" and a PDF" if made else ""))
    elif args.command == "tag":
        fresh = items_of(spark, args.items).drop("subject", "topic", "difficulty")
        print(f"{enrich.tagged_into(fresh, enrich.provider_named(args.provider), KEY, args.out).count()} items tagged")
    elif args.command == "embed":
        rows = items_of(spark, args.items).withColumn("meta", retrieval.store_text("topic", "question_text"))
        sinks.to_vector_store(retrieval.embedded(rows.select(F.xxhash64(*KEY).alias("vec_id"), "meta"), "meta"), args.out)
    elif args.command == "search":
        for r in retrieval.search_text(spark.read.parquet(args.store), args.text, args.k).collect():
            print(f"{r['d2']:.4f}\t{r['vec_id']}\t{r['meta']}")
    else:
        print("".join(render.preview(items_of(spark, args.items), args.n, *KEY)), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
