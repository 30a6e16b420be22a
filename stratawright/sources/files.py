"""Sources and sinks: CSV by alias, JSON lines, Parquet, configuration, model table, reports and the run guard."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawright.functions import text
from stratawright.sources import settings, storage

#: Headers that mean the same field, in small letters.
POST_ALIASES = {
    "id": ["post_id", "id", "reddit_id", "name"], "permalink": ["permalink", "perm_link", "url"], "subreddit": ["subreddit", "subreddit_name", "label"], "title": ["title", "title__2"],
    "selftext": ["selftext", "body", "text"], "created": ["created_utc", "create_time", "created_at"],
}
COMMUNITY_ALIASES = {"community_id": ["community_id", "subreddit_name", "subreddit", "name"], "public_description": ["public_description", "description"]}
REGISTRY = "model string, adapter string, runtime_model string, revision string, probabilities string, max_questions int, max_options int, endpoint string, suffix string, token_variable string, command string"


def discover_csvs(paths: Iterable[str]) -> list[str]:
    """Sorted distinct CSV files of files and folders (searched through), on any file system; another file or none at all is an error."""
    paths = [str(p) for p in paths]
    folders = [p for p in paths if storage.is_folder(p)]
    named = [p for p in paths if p not in folders]
    if other := [p for p in named if not p.casefold().endswith(".csv")]:
        raise ValueError(f"no CSV files: {other}")
    found = sorted({*named, *(f for folder in folders for f in storage.files_under(folder) if f.endswith(".csv"))})
    if not found:
        raise ValueError("no CSV file found")
    return found


def column_names(header: list[str]) -> list[str]:
    """Names without regard to case: a spelling in small letters keeps its name, further spellings of it get ``__2``, ``__3`` ..."""
    order = sorted(range(len(header)), key=lambda i: (header[i] != header[i].lower(), i))
    seen: dict[str, int] = {}
    out = [""] * len(header)
    for i in order:
        low = header[i].strip().lower()
        seen[low] = seen.get(low, 0) + 1
        out[i] = low if seen[low] == 1 else f"{low}__{seen[low]}"
    return out


def read_csvs(spark: SparkSession, files: list[str]) -> DataFrame:
    """All columns of all files as text, with ``seq``, the order of reading.

    Every file has its own header, so each file is read by itself, under names that do not differ by case only. Quoted line ends
    need one task per file; split large exports into several files.
    """
    parts = []
    for number, file in enumerate(files):
        head = spark.read.csv(file, multiLine=True, escape='"', encoding="UTF-8").limit(1).collect()
        names = column_names([(n or "").removeprefix("\ufeff") for n in head[0]] if head else [])
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        rows = spark.read.schema(schema).csv(file, header=True, multiLine=True, escape='"', enforceSchema=True, encoding="UTF-8")
        parts.append(rows.withColumn("seq", F.lit(number).cast("bigint") * F.lit(1 << 40) + F.monotonically_increasing_id()))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_posts(spark: SparkSession, paths: Iterable[str], title_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Raw rows, and usable posts (post_id, subreddit, title, selftext, created_utc, seq). Title-only exports may call the title ``text``."""
    raw = read_csvs(spark, discover_csvs(paths))
    first = lambda name, extra=(): text.first_nonblank(raw, [*POST_ALIASES[name], *extra])
    title = first("title", ["text"] if title_only else [])
    cols = raw.select("seq", first("id").alias("id"), first("permalink").alias("permalink"), first("subreddit").alias("subreddit"), text.normalize_title(title).alias("title"), (F.lit("") if title_only else text.clean_body(first("selftext"))).alias("selftext"), text.parse_created(first("created")).alias("created_utc"))
    usable = cols.filter("subreddit <> '' and title <> ''" + ("" if title_only else " and selftext <> ''"))
    post_id = text.extract_post_id(F.col("id"), F.col("permalink"), F.col("subreddit"), F.col("title"), F.col("created_utc"))
    return raw, usable.select(post_id.alias("post_id"), "subreddit", "title", "selftext", "created_utc", "seq")


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """community_id, public_description, seq of one CSV, by alias."""
    raw = read_csvs(spark, discover_csvs([path]))
    return raw.select(*[text.first_nonblank(raw, names).alias(n) for n, names in COMMUNITY_ALIASES.items()], "seq")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, a broken line is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def load_config(path: str) -> dict[str, Any]:
    """A JSON or YAML file on the driver's machine."""
    return settings.parse(path, Path(path).read_text(encoding="utf-8"))


def registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Model table: the local scorers, and the models of a JSON list if given. A few rows."""
    rows = [{"model": "first-option", "adapter": "local", "probabilities": "native"}, {"model": "word-overlap", "adapter": "local", "probabilities": "native"}]
    rows += json.loads(Path(path).read_text()) if path else []
    names = [part.split()[0] for part in REGISTRY.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], REGISTRY).orderBy("model")


def canonical_model(column: Column) -> Column:
    return F.regexp_replace(column, "^hf://", "")


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_report(report: DataFrame, path: str, **more: Any) -> dict[str, Any]:
    """build.json: the one row of counters and what else is given."""
    row = {**report.first().asDict(), **more}
    storage.write_text(path, json.dumps(row, indent=2, sort_keys=True) + "\n")
    return row


def guard_run(folder: str, run: dict[str, Any]) -> None:
    """Write run.json; fail if the folder has another run."""
    path = f"{folder}/run.json"
    now = json.dumps(run, indent=2, sort_keys=True) + "\n"
    loose = {"runtime": None}  # a run may go on elsewhere
    if storage.exists(path) and json.loads(storage.read_text(path)) | loose != json.loads(now) | loose:
        raise ValueError(f"{folder} holds another run")
    storage.write_text(path, now)


def write_metrics(metrics: DataFrame, folder: str) -> list[dict[str, Any]]:
    """metrics.json, and metrics.csv if there are rows. A few hundred rows: slices, not predictions."""
    rows = [r.asDict() for r in metrics.collect()]
    storage.write_text(f"{folder}/metrics.json", json.dumps(rows, indent=2) + "\n")
    if rows:
        content = io.StringIO(newline="")
        out = csv.DictWriter(content, rows[0].keys(), lineterminator="\n")
        out.writeheader()
        out.writerows(rows)
        storage.write_text(f"{folder}/metrics.csv", content.getvalue())
    return rows
