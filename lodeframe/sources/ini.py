"""INI files as a source and a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions.texts import ini_rows, ini_text


def read_ini(spark: SparkSession, path: str) -> DataFrame:
    """``(file, section, name, value)`` of all files under a path of any store that Spark reads."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return ini_rows(docs.withColumnRenamed("value", "text"), "file", "text")


def write_ini(rows: DataFrame, path: str, key: str) -> None:
    """``(key, section, name, value)`` as text, a document of several lines a key."""
    ini_text(rows, key).select("text").write.text(path)
