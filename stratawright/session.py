"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results if they differ (zone, case) or that every plan here expects.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "stratawright", master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; ``extra`` takes further settings with dots written as ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the one named in spark.checkpoint.dir, else, on a local master only, one of our own (tests).

    A folder of one machine would lose what the executors of a cluster write, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not LOCAL.fullmatch(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stratawright-checkpoint-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


LOCAL = re.compile(r"local(\[.*\])?")
_TABLES: set[tuple[str, str]] = set()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared checkpoint folder and read it again.

    A lost executor then costs no recomputation of Python stages, and the columnar files take a fraction of the room of checkpointed rows. The
    folder of the application is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stratawright-{spark.sparkContext.applicationId}"
    if not _TABLES:
        atexit.register(_remove_tables, spark)
    path = f"{folder}/{uuid.uuid4().hex}"
    _TABLES.add((spark.sparkContext.applicationId, folder))
    df.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_tables(spark: SparkSession) -> None:
    try:
        context = spark.sparkContext
        for application, folder in _TABLES:
            if application == context.applicationId:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended before
        pass


def spread(df: DataFrame) -> DataFrame:
    """Repartition rows of CPU-heavy Python stages, but only where the scan has fewer partitions than there are cores.

    For scans only: behind an exchange, counting the partitions would run its stages.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if have >= cores else df.repartition(max(cores * 3, have))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_stratawright_shipped", False):
        return
    import io
    import zipfile

    here = os.path.dirname(os.path.abspath(__file__))
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("stratawright", os.path.relpath(path, here)))
    # The driver serves the file to the executors; nothing on a worker's disk is relied on.
    folder = tempfile.mkdtemp(prefix="stratawright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "stratawright.zip")
    with open(path, "wb") as file:
        file.write(content.getvalue())
    context.addPyFile(path)
    context._stratawright_shipped = True


def wide(spark: SparkSession) -> int:
    """Partitions for CPU-heavy stages behind an exchange, which adaptive execution would merge by their few bytes."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
