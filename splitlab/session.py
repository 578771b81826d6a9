"""Session settings the jobs are tuned for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "splitlab", **conf) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC times.

    On a cluster leave ``master`` unset and size ``spark.sql.shuffle.partitions``
    for the data; AQE merges what turns out small.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def size_in_bytes(text: str) -> int:
    """Spark size strings such as ``10485760b`` or ``10MB``."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-zA-Z]*)\s*", text).groups()
    power = {"": 0, "b": 0, "k": 1, "m": 2, "g": 3, "t": 4}[unit.lower()[:1]]
    return int(number) * 1024**power


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, from ``spark.checkpoint.dir``.

    A machine-local folder is made only for a local master; on a cluster the
    setting has to be there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="splitlab-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def written(df: DataFrame, label: str, **options) -> DataFrame:
    """``df`` written once as parquet, with the writer's ``options``, and read back.

    Cuts the lineage of iterative jobs in a way that survives lost executors,
    and gives the optimizer true file sizes for its join choice. ``discard``
    removes the stored table.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/splitlab/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that no later job reads; others are left alone."""
    for frame in frames:
        path = frame.__dict__.pop("stored_at", None)
        if path:
            spark = frame.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
