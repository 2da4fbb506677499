"""Command line: run a query over a folder of tables, or one of the jobs of the search."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from sieveline.plans import catalog, workflow
from sieveline.plans.config import SearchConfig, from_contract
from sieveline.sources import io


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sieveline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *required: str, **optional: str | None) -> None:
        own = commands.add_parser(name, help=text)
        for arg in required:
            own.add_argument(arg)
        for arg, default in optional.items():
            own.add_argument(f"--{arg.replace('_', '-')}", default=default)

    command("query", "run a registered query and write its result as Parquet", "name", "tables", "output")
    command("prepare-split", "split a training log by query text", "train", "output")
    command("embed", "fill the store of item vectors of a prepared split", "split", "work", config=None, corpus="split")
    command("finetune", "train an encoder on a prepared split and store its item vectors", "split", "work", "name", config=None)
    command("train", "train a ranker on a prepared split", "split", "output", config=None)
    command("compare", "compare two stored runs by query", "run", "reference")
    command("predict", "answer queries with a stored ranker", "model", "queries", "split", "output", work=None, corpus="split", config=None)
    return parser


def main(argv: list[str] | None = None) -> None:
    parser = _parser()
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("sieveline").getOrCreate()
    config = from_contract(io.read_json(spark, args.config)) if getattr(args, "config", None) else None
    if args.command == "query":
        known = catalog.queries()
        if args.name not in known:
            parser.error(f"unknown query {args.name!r}; one of {', '.join(known)}")
        known[args.name](spark, args.tables).write.mode("errorifexists").parquet(args.output)
    elif args.command == "prepare-split":
        print(workflow.prepare_split(spark, args.train, args.output))
    elif args.command == "embed":
        items = workflow.listings(io.load_corpus(spark, args.split, args.corpus))
        print(workflow.embed(items, args.work, (config or SearchConfig()).retrieval.dense).count())
    elif args.command == "finetune":
        _, losses = workflow.finetune_encoder(spark, args.split, args.work, config or SearchConfig(), args.name)
        print(losses[:1], losses[-1:])
    elif args.command == "train":
        done = workflow.train(spark, args.split, args.output, config or SearchConfig())
        print(json.dumps({k: done[k] for k in ("name", "metrics", "timings")}))
    elif args.command == "compare":
        workflow.compare(spark, args.run, args.reference).show(truncate=False)
    else:
        log = spark.read.parquet(f"{args.split}/contexts.parquet")
        corpus = io.load_corpus(spark, args.split, args.corpus)
        print(json.dumps(workflow.predict(spark, args.model, args.queries, corpus, log, args.output, args.work or f"{args.output}.work", config)["timings"]))


if __name__ == "__main__":
    main()
