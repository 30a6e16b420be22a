"""Command line: models, build, run, baseline, compare, sanity, doctor, configure. Exit codes 0 (well), 1 (a check failed), 2 (usage, or a job failed), 130 (interrupted)."""

from __future__ import annotations

import argparse
import getpass
import importlib
import json
import os
import sys
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratawright.operators.metrics import compare_pivot, headline
from stratawright.plans import pipeline
from stratawright.scoring.remote import CommandWorker, HttpScorer
from stratawright.scoring.scorer import FirstOption, WordOverlap
from stratawright.session import build_session
from stratawright.sources import credentials, files, storage


LOCAL = {"first-option": FirstOption, "word-overlap": WordOverlap}
TOKEN_VARIABLE = "SCORER_TOKEN"


def _scorer(args: argparse.Namespace, row: dict[str, Any] | None = None):
    """The scorer of a model: a command, a web service or a local one, by arguments first, then its registry row and saved credentials."""
    row, saved = row or {}, credentials.load(args.model)
    adapter = args.adapter or row.get("adapter")
    limits = {k: row[k] for k in ("probabilities", "max_questions", "max_options", "suffix") if row.get(k) is not None}
    command, endpoint = args.command_worker or row.get("command"), args.endpoint or row.get("endpoint") or saved.get("endpoint")
    if command:
        return CommandWorker(command)
    if adapter == "http" or adapter is None and endpoint:
        if not endpoint:
            raise ValueError(f"no endpoint for {args.model}; pass --endpoint or run configure")
        if saved.get("token"):
            os.environ.setdefault(TOKEN_VARIABLE, saved["token"])  # of this machine; executors elsewhere need the variable themselves
        return HttpScorer(endpoint, row.get("runtime_model") or args.model, row.get("token_variable") or TOKEN_VARIABLE, **limits)
    if args.model not in LOCAL:
        raise ValueError(f"unknown model {args.model}; use --command-worker or --endpoint")
    return LOCAL[args.model]()


def _row(spark: SparkSession, args: argparse.Namespace) -> dict[str, Any] | None:
    found = files.registry(spark, args.registry).filter(files.canonical_model(F.lit(args.model)) == F.col("model")).collect()
    return found[0].asDict() if found else None


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratawright")
    sub = top.add_subparsers(dest="job", required=True)
    models = sub.add_parser("models")
    models.add_argument("--registry")
    made = sub.add_parser("build")
    made.add_argument("--posts", nargs="+", required=True)
    made.add_argument("--communities", required=True)
    made.add_argument("--config", required=True, help="JSON: seed, max_k and the other parameters of the build")
    made.add_argument("--encoder", required=True, help="module:function, from texts to vectors")
    made.add_argument("--out", required=True)
    run = sub.add_parser("run")
    run.add_argument("model")
    run.add_argument("--dataset", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--config", required=True, help="JSON or YAML: counts, representations, text_modes, per_community, seed, samples, instruction")
    run.add_argument("--task-config", help="settings that hold unless --config gives them")
    run.add_argument("--posts-per-community", type=int, help="instead of per_community")
    run.add_argument("--text-modes", nargs="+", choices=["title", "title+selftext"], help="instead of text_modes")
    base = sub.add_parser("baseline")
    base.add_argument("--dataset", required=True)
    base.add_argument("--out", required=True)
    base.add_argument("--config", required=True, help="JSON or YAML: counts, per_community, train_per_community, seed, samples")
    base.add_argument("--encoder", required=True, help="module:function, from texts to vectors")
    known = sub.add_parser("configure")
    known.add_argument("model")
    known.add_argument("--endpoint", required=True)
    known.add_argument("--token-from", help="variable that holds the token; without it, asked for on a terminal")
    check = sub.add_parser("sanity")
    check.add_argument("model")
    check.add_argument("--config", required=True)
    look = sub.add_parser("doctor")
    look.add_argument("model")
    for p in (run, check, look):
        p.add_argument("--registry")
        p.add_argument("--adapter")
        p.add_argument("--command-worker")
        p.add_argument("--endpoint")
    both = sub.add_parser("compare")
    both.add_argument("results", nargs="+")
    both.add_argument("--json")
    return top


def _encoder(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _configure(args: argparse.Namespace) -> int:
    token = os.environ.get(args.token_from) if args.token_from else getpass.getpass("token (empty for none): ") if sys.stdin.isatty() else None
    print(credentials.save(args.model, args.endpoint, token))
    return 0


#: Other names of settings of a run, as model and task configurations have them.
OTHER_NAMES = {"posts_per_community": "per_community", "bootstrap_samples": "samples", "benchmark_seed": "seed", "candidate_counts": "counts", "candidate_representations": "representations"}
SETTINGS = ("counts", "representations", "text_modes", "per_community", "seed", "samples", "instruction", "revision")


def run_settings(*configs: dict[str, Any]) -> dict[str, Any]:
    """The settings of a run from a task's and a model's configuration, of which the last counts; what a run does not know is left out."""
    out: dict[str, Any] = {}
    for config in configs:
        out |= {OTHER_NAMES.get(k, k): v for k, v in config.items() if v is not None}
    return {k: v for k, v in out.items() if k in SETTINGS}


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    row, config = _row(spark, args), run_settings(files.load_config(args.task_config) if args.task_config else {}, files.load_config(args.config))
    if args.posts_per_community:
        config["per_community"] = args.posts_per_community
    if args.text_modes:
        config["text_modes"] = args.text_modes
    revision = config.pop("revision", None) or (row or {}).get("revision")
    table = pipeline.evaluate(spark, args.dataset, args.out, _scorer(args, row), model=args.model, revision=revision, adapter=args.adapter or (row or {}).get("adapter"), registry=row, **config)
    headline(table).show(truncate=False)


def _doctor(spark: SparkSession, args: argparse.Namespace) -> int:
    row = _row(spark, args)
    if row:
        row["endpoint"] = args.endpoint or row["endpoint"] or credentials.load(args.model).get("endpoint")
    checks = pipeline.doctor(row)
    for name, good, detail in checks:
        print(f"{name}: {'ok' if good else 'missing'} ({detail})")
    return int(not all(good for _, good, _ in checks))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.job == "configure":
            return _configure(args)
        spark = build_session()
        if args.job == "sanity":
            rows = pipeline.sanity(_scorer(args, _row(spark, args)), files.load_config(args.config))
            for row in rows:
                print(f"{row['representation']}: {row['correct']}/{row['total']}")
            return int(not all(r["passed"] for r in rows))
        if args.job == "models":
            files.registry(spark, args.registry).show(100, truncate=False)
        elif args.job == "doctor":
            return _doctor(spark, args)
        elif args.job == "build":
            print(json.dumps(pipeline.build_dataset(spark, args.posts, args.communities, args.out, _encoder(args.encoder), **files.load_config(args.config))))
        elif args.job == "baseline":
            print(json.dumps(pipeline.supervised(spark, args.dataset, args.out, _encoder(args.encoder), **files.load_config(args.config)), indent=2))
        elif args.job == "run":
            _run(spark, args)
        else:
            table = pipeline.compare_runs(spark, args.results)
            compare_pivot(headline(table)).show(truncate=False)
            if args.json:
                storage.write_text(args.json, json.dumps([r.asDict() for r in table.collect()], indent=2) + "\n")
        return 0
    except KeyboardInterrupt:
        return 130
    except (ValueError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
