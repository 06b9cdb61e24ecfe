"""Schemas as data, and a timer for plans."""

from __future__ import annotations

import time
from collections.abc import Callable
from statistics import mean, pstdev

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def describe(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``(position, name, kind, nullable, metadata)``, a row a field."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable, str(f.metadata)) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, name string, kind string, nullable boolean, metadata string")


def field_of(value: Column, name: str) -> Column:
    """A struct's field by name."""
    return value.getField(name)


def enum_name(value, names: dict[int, str]) -> Column:
    """The name of an enumeration's value; NULL for an unknown one."""
    value = F.col(value) if isinstance(value, str) else value
    out = F.lit(None).cast("string")
    for number, name in names.items():
        out = F.when(value == number, F.lit(name)).otherwise(out)
    return out


def enum_value(name, names: dict[int, str]) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    out = F.lit(None).cast("long")
    for number, text in names.items():
        out = F.when(name == text, F.lit(number).cast("long")).otherwise(out)
    return out


def measure(run: Callable[[], object], runs: int = 10) -> dict[str, float]:
    """Least, most, mean, population deviation and total milliseconds of a callable's runs."""
    times = []
    for _ in range(runs):
        began = time.perf_counter()
        run()
        times.append((time.perf_counter() - began) * 1000)
    return {"min": min(times), "max": max(times), "avg": mean(times), "stddev": pstdev(times), "total": sum(times), "runs": float(runs)}
