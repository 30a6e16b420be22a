"""Metrics of predictions per slice, with the pooled track ``all``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratawright.session import cut

KEYS = ["text_mode", "representation", "community_track", "difficulty", "k"]
BINS = 15
#: Most rows of a slice that are resampled in one task: about 300 MB there, with ids of twenty characters.
MOST_RESAMPLED = 3_000_000


def pooled(rows: DataFrame) -> DataFrame:
    """Every row also under community_track ``all``; ``file_track`` keeps the track that it came from."""
    return rows.withColumn("file_track", F.col("community_track")).withColumn("community_track", F.explode(F.array("community_track", F.lit("all"))))


def file_order(rows: DataFrame) -> list[str]:
    """Columns of the order in which predictions are filed: own track, target, post."""
    track = "file_track" if "file_track" in rows.columns else "community_track"
    return [c for c in (track, "target", "post_id") if c in rows.columns]


def nll(p: Column) -> Column:
    return F.avg(-F.ln(F.greatest(p, F.lit(1e-12))))


def brier(squared: Column, p: Column) -> Column:
    return F.avg(squared - 2 * p + 1)


def slice_metrics(rows: DataFrame, keys: list[str] = KEYS, pool: bool = False) -> DataFrame:
    """Everything that one aggregation over (slice, target) and one over slices can give.

    Two levels with partial sums: accuracy over rows and the mean over targets come from the same exchange. With ``pool`` the track ``all`` is
    summed from the partial sums of the tracks, so no row is read or sent twice for it.
    """
    by_target = rows.groupBy(*keys, "target").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("right"), F.sum(-F.ln(F.greatest("true_probability", F.lit(1e-12)))).alias("nll"),
        F.sum(F.col("squared_probability_sum") - 2 * F.col("true_probability") + 1).alias("brier"), F.count("true_probability").alias("n_p"),
        F.sum(F.coalesce("input_tokens", F.lit(0.0))).alias("tin"), F.sum(F.coalesce("output_tokens", F.lit(0.0))).alias("tout"),
        F.sum(F.coalesce("forward_count", F.lit(1.0))).alias("fwd"), F.sum(F.coalesce("api_cost_usd", F.lit(0.0))).alias("cost"),
    )
    if pool:
        sums = [c for c in by_target.columns if c not in (*keys, "target")]
        by_target = pooled(by_target).groupBy(*keys, "target").agg(*[F.sum(c).alias(c) for c in sums])
    n = F.sum("n")
    return by_target.groupBy(*keys).agg(
        n.alias("examples"), F.count(F.lit(1)).alias("communities"), (F.sum("right") / n).alias("accuracy"), F.avg(F.col("right") / F.col("n")).alias("macro_community_accuracy"),
        (F.sum("nll") / F.nullif(F.sum("n_p"), F.lit(0))).alias("nll"), (F.sum("brier") / F.nullif(F.sum("n_p"), F.lit(0))).alias("brier"),
        (F.sum("tin") / n).alias("mean_input_tokens"), (F.sum("tout") / n).alias("mean_output_tokens"), (F.sum("fwd") / n).alias("mean_forward_count"), F.sum("cost").alias("api_cost_usd"),
    )


def _bin_sums(rows: DataFrame, keys: list[str], pool: bool) -> DataFrame:
    """n, right and confidence sums of each bin; bin is null for a confidence above 1, which is in none."""
    some = rows.filter("confidence is not null").withColumn("bin", F.when(F.col("confidence") <= 1, F.least(F.floor(F.col("confidence") * BINS), F.lit(BINS - 1))))
    sums = some.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("right"), F.sum("confidence").alias("sure"))
    return pooled(sums).groupBy(*keys, "bin").agg(*[F.sum(c).alias(c) for c in ("n", "right", "sure")]) if pool else sums


def calibration_bins(rows: DataFrame, keys: list[str] = KEYS, pool: bool = False) -> DataFrame:
    """n, accuracy and confidence of each of the equal bins; a confidence above 1 is in none."""
    sums = _bin_sums(rows, keys, pool).filter("bin is not null")
    return sums.select(*keys, "bin", "n", (F.col("right") / F.col("n")).alias("accuracy"), (F.col("sure") / F.col("n")).alias("confidence"))


def ece(rows: DataFrame, keys: list[str] = KEYS, pool: bool = False) -> DataFrame:
    """Expected calibration error in 15 bins. Rows above confidence 1 count in the denominator only."""
    gap = F.sum(F.when(F.col("bin").isNotNull(), F.abs(F.col("right") - F.col("sure"))))
    return _bin_sums(rows, keys, pool).groupBy(*keys).agg((F.coalesce(gap, F.lit(0.0)) / F.sum("n")).alias("ece_15"))


def in_ranges(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``_r``, the number of a range; the ranges of a slice follow each other in ``order``.

    Ranges are cut from a sample over the whole composite order, so neither a slice that is the table nor a value that all its rows share lies
    in one range. The rows are written once, because the sample would be drawn anew for every reader.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return cut(rows.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_r", F.spark_partition_id()))


def aurc(rows: DataFrame, keys: list[str] = KEYS, tie: list[str] | None = None) -> DataFrame:
    """Area under the risk-coverage curve: mean over ranks of the error rate so far, most confident first.

    A slice may be as long as the table, so running sums are taken inside ranges of the order, and offsets come from the few ranges.
    Ties keep file order.
    """
    tie = tie or file_order(rows)
    order = [F.col("confidence").desc(), *map(F.col, tie)]
    narrow = rows.filter("confidence is not null").select(*keys, "confidence", *[t for t in tie if t not in keys], (1 - F.col("correct").cast("int")).alias("_e"))
    some = in_ranges(narrow, keys, order)
    parts = some.groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_c"), F.sum("_e").alias("_w"))
    before = Window.partitionBy(*keys).orderBy("_r")  # over ranges
    parts = parts.select(*keys, "_r", (F.sum("_c").over(before) - F.col("_c")).alias("_c0"), (F.sum("_w").over(before) - F.col("_w")).alias("_w0"))
    inside = Window.partitionBy(*keys, "_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = some.withColumn("_i", F.count(F.lit(1)).over(inside)).withColumn("_w", F.sum("_e").over(inside)).join(parts, [*keys, "_r"])
    return run.groupBy(*keys).agg(F.avg((F.col("_w") + F.col("_w0")) / (F.col("_i") + F.col("_c0"))).alias("aurc"))


def latency_quantiles(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Exact p50 and p95 with linear interpolation.

    Ranks run inside ranges of the values, as in ``aurc``; only the rows at the wanted ranks meet, so no slice's values lie in one buffer.
    """
    value = F.col("amortized_latency_ms").cast("double")
    some = in_ranges(rows.select(*keys, value.alias("_v")).filter("_v is not null"), keys, [F.col("_v")])
    parts = some.groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_c"))
    parts = parts.withColumn("_c0", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_r")) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    wanted = {name: F.lit(q) * (F.col("_n") - 1) for name, q in (("p50", 0.5), ("p95", 0.95))}
    ranked = some.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_r").orderBy("_v")) - 1).join(parts, [*keys, "_r"]).withColumn("_i", F.col("_i") + F.col("_c0"))
    near = ranked.filter(" or ".join(f"_i in (floor({q} * (_n - 1)), ceil({q} * (_n - 1)))" for q in (0.5, 0.95)))
    at = {name: (F.max(F.when(F.col("_i") == F.floor(w), F.col("_v"))), F.max(F.when(F.col("_i") == F.ceil(w), F.col("_v"))), F.max(w - F.floor(w))) for name, w in wanted.items()}
    return near.groupBy(*keys).agg(*[(low + (high - low) * part).alias(f"latency_ms_{name}") for name, (low, high, part) in at.items()])


def group_index(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Ordinal of every slice among all slices in key order; over slices, not rows."""
    return rows.select(*keys).distinct().withColumn("group_index", F.row_number().over(Window.orderBy(*keys)) - 1)


def probability_source(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by("probability_source", F.struct(*file_order(rows))).alias("probability_source"))


def interval(right: int, examples: int, samples: int, seed: int, correct: np.ndarray | None = None) -> tuple[float, float]:
    """Percentile bootstrap of an accuracy, resampling row positions with PCG64."""
    values = correct if correct is not None else np.concatenate([np.ones(right), np.zeros(examples - right)])
    rng = np.random.default_rng(seed)
    means = np.array([values[rng.integers(0, len(values), len(values))].mean() for _ in range(samples)])
    low, high = np.quantile(means, [0.025, 0.975])
    return float(low), float(high)


def bootstrap_intervals(rows: DataFrame, samples: int, seed: int, keys: list[str] = KEYS, tie: list[str] | None = None, most: int = MOST_RESAMPLED) -> DataFrame:
    """accuracy_ci95_low and _high per slice, seed + group_index.

    The draw depends on the order of the rows, so a slice is resampled in one task; of each row its order and one bit travel. Slices are as
    large as one evaluation (selected posts), which ``per_community`` bounds, not as large as the corpus; one of more than ``most`` rows is an error.
    """
    tie = tie or file_order(rows)
    indexed = rows.join(F.broadcast(group_index(rows, keys)), keys)  # one row per slice
    narrow = indexed.select(*keys, "group_index", *[t for t in tie if t not in keys], F.col("correct").cast("boolean").alias("correct"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > most:
            raise ValueError(f"a slice of {len(frame)} rows is too long to be resampled in one task (at most {most})")
        frame = frame.sort_values(tie, kind="stable")
        values = frame["correct"].to_numpy(float)
        low, high = interval(0, 0, samples, seed + int(frame["group_index"].iloc[0]), values)
        return frame[keys].iloc[:1].assign(accuracy_ci95_low=low, accuracy_ci95_high=high)

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return narrow.groupBy(*keys).applyInPandas(run, f"{kinds}, accuracy_ci95_low double, accuracy_ci95_high double")


def all_metrics(predictions: DataFrame, samples: int = 1000, seed: int = 0) -> DataFrame:
    """The metric table: one row per slice, in key order. What sums can give is pooled from sums; what needs an order reads the rows under both tracks."""
    # Read once from what they are stored in (JSON lines), then as the few columns that metrics need.
    needed = [*KEYS, "target", "post_id", "correct", "confidence", "true_probability", "squared_probability_sum", "probability_source", "amortized_latency_ms", "input_tokens", "output_tokens", "forward_count", "api_cost_usd"]
    predictions = cut(predictions.select(*needed))
    rows = pooled(predictions)
    table = slice_metrics(predictions, pool=True)
    for part in (ece(predictions, pool=True), aurc(rows), latency_quantiles(rows), probability_source(rows), bootstrap_intervals(rows, samples, seed)):
        table = table.join(part, KEYS, "left")
    return table.orderBy(*KEYS)


def headline(metrics: DataFrame, counts: tuple[int, ...] = (16, 64)) -> DataFrame:
    return metrics.filter((F.col("community_track") == "all") & (F.col("difficulty") == "hard") & (F.col("representation") == "anonymous-id+description") & F.col("k").isin(*counts))


def compare_pivot(metrics: DataFrame, counts: tuple[int, ...] = (16, 64)) -> DataFrame:
    """system and accuracy per K, "unsupported" where a system has none."""
    wide = metrics.groupBy("system").pivot("k", list(counts)).agg(F.first("accuracy"))
    return wide.select("system", *[F.when(F.col(f"`{k}`").isNull(), "unsupported").otherwise(F.format_string("%.3f", F.col(f"`{k}`"))).alias(f"k{k}") for k in counts])


def accuracy_gate(rows: DataFrame, keys: list[str], least: float) -> DataFrame:
    """accuracy, and whether it is at least ``least``."""
    return rows.groupBy(*keys).agg(F.avg(F.col("correct").cast("int")).alias("accuracy")).withColumn("passed", F.col("accuracy") >= least)


def slice_sets(rows: DataFrame, keys: list[str], ids: str, value: Column) -> DataFrame:
    """How many ids each slice has, and the set of a value in it, sorted."""
    return rows.groupBy(*keys).agg(F.count_distinct(ids).alias("ids"), F.array_sort(F.collect_set(value)).alias("values"))


def representation_gap(metrics: DataFrame) -> DataFrame:
    """Accuracy with names beside accuracy with descriptions, per slice."""
    rest = [k for k in KEYS if k != "representation"]
    wide = metrics.groupBy(*rest).pivot("representation", ["name-only", "anonymous-id+description"]).agg(F.first("accuracy"))
    return wide.select(*rest, F.col("`name-only`").alias("names"), F.col("`anonymous-id+description`").alias("descriptions"), (F.col("`name-only`") - F.col("`anonymous-id+description`")).alias("gap"))
