"""Metrics of predictions while they arrive. An extension: the batch jobs have no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratawright.operators.metrics import KEYS, pooled
from stratawright.scoring.scorer import PREDICTION


def prediction_stream(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of the files that appear in a folder, with the time at which their file was seen."""
    return spark.readStream.schema(PREDICTION).json(path).withColumn("seen_at", F.current_timestamp())


def running_accuracy(predictions: DataFrame, late: str = "1 hour") -> DataFrame:
    """examples, right and accuracy per slice; a prediction that comes twice within ``late`` counts once."""
    once = predictions.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["prediction_id"])
    rows = pooled(once)
    counted = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("examples"), F.sum(F.col("correct").cast("int")).alias("right"))
    return counted.withColumn("accuracy", F.col("right") / F.col("examples"))


def start(spark: SparkSession, path: str, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the table ``name`` up to date with the folder; the state lives in ``checkpoint``, a folder that all executors share."""
    table = running_accuracy(prediction_stream(spark, path))
    return table.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
