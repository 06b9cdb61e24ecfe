"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_known: set[tuple[str, str]] = set()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``; it goes when the driver's JVM ends.

    Where that is unset, a local session gets a temporary folder, and a cluster, whose executors wouldn't see it, an error."""
    context = spark.sparkContext
    app = context.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="lodeframe-tables-")
        folder = _own[app]
    path = f"{folder.rstrip('/')}/lodeframe-tables-{app}"
    if (app, path) not in _known:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
        _known.add((app, path))
    return path


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that lineage ends there and lost executors cost no more than it."""
    return kept_counting(df)[0]


def kept_counting(df: DataFrame, condition: str = "true", marked: bool = True) -> tuple[DataFrame, int]:
    """``kept``, and how many rows meet the condition, counted while they are written. A task that ran twice may count twice, so the
    number tells whether there are any. Unless ``marked``, no marker of success is written."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count_if(F.expr(condition)).alias("n")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", marked).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._kept_at = path
    # A plan that turns out empty while it runs may leave its counter out.
    counted = seen.get.get("n")
    return found, found.where(condition).limit(1).count() if counted is None else counted


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``kept`` made and that no later plan reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
