"""Supervised reference: multinomial logistic regression over vectors, then the best of each row's candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratawright.functions.hashing import Hash, blake2b63
from stratawright.operators.metrics import MOST_RESAMPLED, file_order


def _regression(max_iter: int, penalty: float):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol="features", labelCol="y", family="multinomial", maxIter=max_iter, regParam=penalty, standardization=False)


def training_posts(posts: DataFrame, evaluated: DataFrame, communities: DataFrame) -> DataFrame:
    """Train posts without the evaluated ones, of known communities (``subreddit`` is an id of these)."""
    train = posts.filter("split = 'train'").join(evaluated.select("post_id"), "post_id", "left_anti")
    return train.join(communities.select(F.col("community_id").alias("subreddit")), "subreddit", "left_semi")


def sample_per_community(posts: DataFrame, number: int, seed: int | str, hash_fn: Hash = blake2b63) -> DataFrame:
    """At most ``number`` posts of each community, those with the smallest hash. Spark keeps only so many per task, so a large community does not meet."""
    order = Window.partitionBy("subreddit").orderBy(hash_fn(seed, F.col("post_id")), "post_id")
    return posts.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= number).drop("_n")


def train_classifier(train: DataFrame, label: str, c: float = 10.0, max_iter: int = 300):
    """(model, labels in class order) of a multinomial regression over ``vector``. The penalty is 1 / (C n)."""
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    data = train.select(F.col(label).alias("label"), array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(data)
    return _regression(max_iter, 1.0 / (c * max(data.count(), 1))).fit(index.transform(data)), list(index.labels)


def class_scores(rows: DataFrame, model, labels: list[str]) -> DataFrame:
    """Adds scores, a map from label to log-probability, for rows with ``vector``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.withColumn("features", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))
    chances = F.transform(vector_to_array("probability"), lambda p: F.ln(F.greatest(p, F.lit(1e-300))))
    return model.transform(data).withColumn("scores", F.map_from_arrays(F.array(*map(F.lit, labels)), chances)).drop("features", "rawPrediction", "probability", "prediction")


def best_candidate(candidates: Column, scores: Column) -> Column:
    """Candidate with the largest score in a map; of equals the first in display order."""
    return F.array_max(F.transform(candidates, lambda c, i: F.struct(F.element_at(scores, c).alias("s"), (-i).alias("i"), c.alias("c"))))["c"]


def resampled_means(values: np.ndarray, samples: int, seed: int, block: int = 1 << 22) -> np.ndarray:
    """Means of ``samples`` resamples: the draws of one samples x n matrix, made in blocks of rows, so that memory does not grow with it."""
    rng, means = np.random.default_rng(seed), []
    while len(means) < samples:
        rows = min(samples - len(means), max(1, block // len(values)))
        means += list(values[rng.integers(0, len(values), (rows, len(values)))].mean(axis=1))
    return np.array(means)


def baseline_accuracy(rows: DataFrame, keys: list[str], samples: int, seed: int, tie: list[str] | None = None, most: int = MOST_RESAMPLED) -> DataFrame:
    """Accuracy and bootstrap interval per slice in file order, every slice with the same seed; a slice of more than ``most`` rows is an error."""
    tie = tie or file_order(rows)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > most:
            raise ValueError(f"a slice of {len(frame)} rows is too long to be resampled in one task (at most {most})")
        values = frame.sort_values(tie, kind="stable")["correct"].to_numpy(float)
        low, high = np.quantile(resampled_means(values, samples, seed), [0.025, 0.975])
        return frame[keys].iloc[:1].assign(examples=len(values), accuracy=values.mean(), accuracy_ci95_low=low, accuracy_ci95_high=high)

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, *[t for t in tie if t not in keys], "correct").groupBy(*keys).applyInPandas(run, f"{kinds}, examples bigint, accuracy double, accuracy_ci95_low double, accuracy_ci95_high double")
