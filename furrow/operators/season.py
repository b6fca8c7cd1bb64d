"""Months of one season -> trend, peak, area and variability.

Input tables have one row per county, crop, year and month, so a season has at most twelve rows and
windows over it are small. ``keys`` may leave out the year to summarise several years as one series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEASON_KEYS = ("county_id", "crop_type", "year")


def _complete(y: str, value: Column) -> Column:
    """NULL when any month lacks a value, as a fit over a gap would be undefined."""
    return F.when(F.count(F.col(y)) == F.count(F.lit(1)), value)


def _slope(y: str) -> Column:
    fitted = _complete(y, F.regr_slope(F.col(y), F.col("_x")))
    return F.when(F.count(F.lit(1)) == 1, F.lit(0.0)).otherwise(fitted)


def _area(y: str) -> Column:
    summed = _complete(y, F.sum(F.col(f"{y}_area")))
    return F.when(F.count(F.lit(1)) == 1, F.max(F.col(y))).otherwise(summed)


def _first_peak(result: str, y: str, order: Sequence[str]) -> Column:
    rank = F.when(F.col(y).isNotNull(), F.struct((-F.col(y)).alias("down"), *order))
    return F.min_by(F.col(result), rank)


def _series(monthly: DataFrame, y: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_x`` (month), ``_y``, its change from the row before and its trapezoid area."""
    along = Window.partitionBy(*keys).orderBy(*order)
    rows = monthly.withColumns(
        {"_x": F.col("month").cast("double"), "_y": F.col(y).cast("double")}
    )
    before_x, before_y = F.lag("_x").over(along), F.lag("_y").over(along)
    return rows.withColumns(
        {
            "_y_area": (F.col("_x") - before_x) * (F.col("_y") + before_y) / 2,
            "_change": F.coalesce(F.col("_y") - before_y, F.lit(0.0)),
        }
    )


def _order(keys: Sequence[str], names: Sequence[str]) -> list[str]:
    return [n for n in names if n == "month" or n not in keys]


def vegetation_season(monthly: DataFrame, keys: Sequence[str] = SEASON_KEYS) -> DataFrame:
    """Season summary of the vegetation cover seen in RGB scenes."""
    order = _order(keys, ("month", "year") if "year" in monthly.columns else ("month",))
    series = _series(monthly, "ag_vegetation_area_percent", keys, order)
    spread = F.stddev_samp("_change")
    return series.groupBy(*keys).agg(
        _slope("_y").alias("ag_growth_slope"),
        _first_peak("month", "_y", order).alias("ag_peak_month"),
        F.max("_y").alias("ag_peak_value"),
        (F.max("_y") - F.min("_y")).alias("ag_amplitude"),
        _area("_y").alias("ag_auc"),
        (1.0 / (1.0 + spread)).alias("ag_stability_score"),
        F.avg("_change").alias("ag_month_to_month_vegetation_change_mean"),
        spread.alias("ag_month_to_month_vegetation_change_std"),
    )


def index_season(monthly: DataFrame, keys: Sequence[str] = SEASON_KEYS) -> DataFrame:
    """Season summary of the mean vegetation index."""
    order = _order(keys, ("month", "year") if "year" in monthly.columns else ("month",))
    series = _series(monthly, "ndvi_mean", keys, order)
    spread = F.stddev_samp("_change")
    first_order = F.struct(*order)
    out = series.groupBy(*keys).agg(
        _slope("_y").alias("ndvi_growth_slope"),
        F.max("_y").alias("ndvi_peak_value"),
        _first_peak("month", "_y", order).alias("ndvi_peak_month"),
        (F.max("_y") - F.min("_y")).alias("ndvi_amplitude"),
        _area("_y").alias("ndvi_auc"),
        (1.0 / (1.0 + spread)).alias("ndvi_stability_score"),
        F.avg("_change").alias("ndvi_month_to_month_change_mean"),
        spread.alias("ndvi_month_to_month_change_std"),
        (F.stddev_samp("_y") / (F.avg("_y") + 1e-8)).alias("ndvi_timeseries_cv"),
        F.min_by("_x", first_order).alias("_first_x"),
        F.min_by(F.struct("_y"), first_order).alias("_first"),
        _first_peak("_x", "_y", order).alias("_peak_x"),
    )
    rise = (F.col("ndvi_peak_value") - F.col("_first._y")) / (F.col("_peak_x") - F.col("_first_x"))
    rate = F.when(F.col("_peak_x") > F.col("_first_x"), rise).otherwise(F.lit(0.0))
    return out.withColumn("ndvi_greenup_rate", rate).select(
        *keys,
        *[c for c in out.columns if c.startswith("ndvi_") and c != "ndvi_timeseries_cv"],
        "ndvi_greenup_rate",
        "ndvi_timeseries_cv",
    )


def weather_season(monthly: DataFrame, keys: Sequence[str] = SEASON_KEYS) -> DataFrame:
    """Season summary of monthly weather."""
    order = _order(keys, ("year", "month"))
    series = _series(monthly, "weather_total_precipitation", keys, order).withColumns(
        {
            "_t": F.col("weather_temp_mean").cast("double"),
            "_v": F.coalesce(F.col("weather_vpd").cast("double"), F.lit(0.0)),
        }
    )
    return series.groupBy(*keys).agg(
        _slope("_t").alias("weather_temperature_trend_slope"),
        _slope("_y").alias("weather_rainfall_trend_slope"),
        _slope("_v").alias("weather_vpd_trend_slope"),
        _area("_y").alias("weather_total_precipitation_auc"),
        _first_peak("month", "_y", order).alias("weather_peak_rainfall_month"),
        (F.stddev_samp("_y") / (F.avg("_y") + 1e-6)).alias("weather_rainfall_seasonality_index"),
        F.coalesce(F.sum("weather_heat_stress_degree_days"), F.lit(0.0)).alias(
            "weather_heat_stress_total"
        ),
        F.max("weather_drought_index").alias("weather_drought_severity_max"),
    )
