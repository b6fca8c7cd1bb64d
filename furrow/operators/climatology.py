"""Climatologies that grow by years: stored sums that are merged instead of averages that are taken anew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Baseline and the measure that it is the mean of.
BASELINES = {
    "weather_temperature_baseline": "weather_temp_mean",
    "weather_rainfall_baseline": "weather_total_precipitation",
}


def climatology_state(monthly: DataFrame, keys: Sequence[str] = ("month",)) -> DataFrame:
    """Sum and number of each measure per year and key, which add up over years; NULL measures count for nothing."""
    parts = []
    for name, measure in BASELINES.items():
        parts += [F.sum(measure).alias(f"{name}_sum"), F.count(measure).alias(f"{name}_count")]
    return monthly.groupBy("year", *keys).agg(*parts)


def climatology_of_state(state: DataFrame, keys: Sequence[str] = ("month",)) -> DataFrame:
    """Mean temperature and rainfall per key over all years of a state; NULL where there is no measure."""

    def mean(name: str) -> Column:
        return F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_count")).alias(name)

    return state.groupBy(*keys).agg(*map(mean, BASELINES))


def store_years(monthly: DataFrame, path: str, keys: Sequence[str] = ("month",)) -> None:
    """Put the years of ``monthly`` into the state at ``path``; years that are there already are replaced, all others stay.

    Only the given rows are read; a state has a few rows per year.
    """
    state = climatology_state(monthly, keys)
    writer = state.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("year").parquet(path)


def stored_climatology(spark: SparkSession, path: str, keys: Sequence[str] = ("month",)) -> DataFrame:
    """The climatology of all years stored at ``path``, from their sums alone."""
    return climatology_of_state(spark.read.parquet(path), keys)
