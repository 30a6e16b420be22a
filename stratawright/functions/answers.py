"""What is derived from one answered question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_probabilities(labels: Column, by_label: Column) -> Column:
    """Probabilities in label order, summing to 1; a sum that is not positive is an error; null stays null."""
    raw = F.transform(labels, lambda x: F.element_at(by_label, x))
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    return F.when(by_label.isNotNull(), F.when(total <= 0, F.raise_error(F.lit("probabilities do not sum to a positive number"))).otherwise(F.transform(raw, lambda x: x / total)))


def label_to_candidate(labels: Column, candidates: Column, choice: Column) -> Column:
    return F.element_at(candidates, F.array_position(labels, choice).cast("int"))


def target_position(candidates: Column, target: Column) -> Column:
    return (F.array_position(candidates, target) - 1).cast("int")


def true_probability(probabilities: Column, candidates: Column, target: Column) -> Column:
    return F.element_at(probabilities, F.array_position(candidates, target).cast("int"))


def confidence(probabilities: Column) -> Column:
    return F.array_max(probabilities)


def squared_sum(probabilities: Column) -> Column:
    return F.aggregate(probabilities, F.lit(0.0), lambda s, x: s + x * x)


def fingerprint(candidates: Column) -> Column:
    return F.sha2(F.array_join(candidates, "\0"), 256)


def argmax_label(labels: Column, by_label: Column) -> Column:
    """Label of the largest probability; of equals the first in label order."""
    scored = F.transform(labels, lambda x, i: F.struct(F.element_at(by_label, x).alias("p"), (-i).alias("i"), x.alias("label")))
    return F.array_max(scored)["label"]


def system_label(model: Column, revision: Column) -> Column:
    return F.concat(model, F.when(revision.isNotNull(), F.concat(F.lit("@"), F.substring(revision, 1, 8))).otherwise(F.lit("")))


def format_metric(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("—")).otherwise(F.format_string("%.3f", value))


def option_labels(size: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.format_string("option_%02d", i))


def random_chance(k: Column) -> Column:
    return F.lit(1.0) / k
