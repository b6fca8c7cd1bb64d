"""Daily weather -> monthly agronomic measures."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.dates import (
    DEFAULT_FORMATS,
    assembled_timestamp,
    days_in_month,
    lenient_timestamp,
)
from furrow.functions.numeric import (
    flag,
    mean_of_present,
    measure,
    null_safe_max,
    sum_or_zero,
    vapour_pressure_deficit,
)
from furrow.functions.text import strip
from furrow.operators.joins import join_on, with_group_stats
from furrow.operators.streaks import DAYS, day_vector, longest_true_streak, streak_of_days

# --- fixed values: canonical columns and the header names accepted for them, best first ----------
WEATHER_ALIASES = {
    "date": ["date", "datetime", "day"],
    "temperature_mean": [
        "temperature_mean", "temp_mean", "tmean", "mean_temp", "avg_temp", "avg temperature (k)",
    ],
    "temperature_max": [
        "temperature_max", "temp_max", "tmax", "max_temp", "max temperature (k)",
    ],
    "temperature_min": [
        "temperature_min", "temp_min", "tmin", "min_temp", "min temperature (k)",
    ],
    "precipitation": [
        "precipitation", "rainfall", "precip", "prcp", "precipitation (kg m**-2)",
    ],
    "humidity": ["humidity", "relative_humidity", "rh", "relative humidity (%)"],
    "wind_speed": ["wind_speed", "wind", "ws", "wind speed (m s**-1)"],
    "solar_radiation": [
        "solar_radiation", "radiation", "swrad", "shortwave_radiation",
        "downward shortwave radiation flux (w m**-2)",
    ],
}
DAILY_COLUMN = "Daily/Monthly"
KELVIN_ABOVE = 100.0
KELVIN_OFFSET = 273.15

TEMPERATURES = ("temperature_mean", "temperature_max", "temperature_min")
MONTH_KEYS = ("county_id", "crop_type", "year", "month")
SEASON_SCOPE = ("county_id", "crop_type", "year")
SERIES_SCOPE = ("county_id", "crop_type")


@dataclass(frozen=True)
class WeatherThresholds:
    """Degrees Celsius and millimetres; the defaults are fixed values."""

    base_temperature: float = 10.0
    heat: float = 35.0
    frost: float = 0.0
    dry_below: float = 1.0
    rainy_from: float = 1.0


def canonical_weather_columns(df: DataFrame) -> DataFrame:
    """Rename accepted headers to the canonical names.

    Headers are compared stripped and in lower case. The first name of the alias list that is present
    wins; of several columns with the same header the last one does and the others are dropped.
    """
    position = {name.strip().lower(): i for i, name in enumerate(df.columns)}
    names = list(df.columns)
    taken = {}
    for canonical, aliases in WEATHER_ALIASES.items():
        found = next((position[a] for a in aliases if a in position), None)
        if found is not None and found not in taken.values():
            taken[canonical] = found
            names[found] = canonical
    keep = {name.lower(): i for i, name in enumerate(names)} | taken
    repeated = Counter(n.lower() for n in names)
    unique = [
        n if repeated[n.lower()] == 1 or keep[n.lower()] == i else f"_dropped_{i}"
        for i, n in enumerate(names)
    ]
    return df.toDF(*unique).drop(*[n for n in unique if n.startswith("_dropped_")])


def check_weather_columns(columns: Sequence[str]) -> None:
    """Raise when a required column is missing."""
    have = set(columns)
    if "date" not in have and not {"year", "month", "day"} <= have:
        raise ValueError("weather needs a date column, or year, month and day")
    if "temperature_mean" not in have and not {"temperature_max", "temperature_min"} <= have:
        raise ValueError("weather needs temperature_mean, or temperature_max and temperature_min")


def weather_readings(
    df: DataFrame, date_formats: Sequence[str] = DEFAULT_FORMATS
) -> DataFrame:
    """Typed daily rows: canonical columns, readable dates only, gaps in temperature columns filled.

    Adds ``is_daily``, ``year``, ``month`` and, where absent, NULL ``county_id`` and ``crop_type``.
    A frame whose only date is split over ``year``, ``month`` and ``day`` gets it assembled.
    """
    split_date = {"year", "month", "day"} <= {c.lower() for c in df.columns} and not (
        {"date", "datetime"} & {c.strip().lower() for c in df.columns}
    )
    if split_date:
        parts = {c.lower(): F.col(f"`{c}`") for c in df.columns}
        whole = assembled_timestamp(parts["year"], parts["month"], parts["day"])
        df = df.withColumn("date", whole).drop("day")
    df = canonical_weather_columns(df)
    check_weather_columns(df.columns)

    have = set(df.columns)
    value = {c: measure(F.col(c)) if c in have else None for c in WEATHER_ALIASES if c != "date"}
    mean, high, low = (value[c] for c in TEMPERATURES)
    if mean is None:
        mean = mean_of_present(high, low)
    filled = {
        "temperature_mean": mean,
        "temperature_max": mean if high is None else high,
        "temperature_min": mean if low is None else low,
        "precipitation": F.lit(0.0) if value["precipitation"] is None else value["precipitation"],
    }
    for name in ("humidity", "solar_radiation", "wind_speed"):
        filled[name] = F.lit(None).cast("double") if value[name] is None else value[name]

    is_daily = F.lit(False)
    if DAILY_COLUMN in have:
        text = F.lower(strip(F.col(f"`{DAILY_COLUMN}`").cast("string")))
        is_daily = flag(text == "daily")
    for key in SERIES_SCOPE:
        if key not in have:
            filled[key] = F.lit(None).cast("string")

    date = lenient_timestamp(F.col("date"), df.schema["date"].dataType, date_formats)
    return (
        df.withColumns({**filled, "is_daily": is_daily, "date": date})
        .filter(F.col("date").isNotNull())
        .withColumns({"year": F.year("date"), "month": F.month("date")})
    )


def prefer_daily_rows(readings: DataFrame, scope: Sequence[str] = SEASON_SCOPE) -> DataFrame:
    """Keep only daily rows in scopes that have any; keep all rows elsewhere."""
    marked = with_group_stats(readings, scope, _any_daily=F.max("is_daily"))
    return marked.filter(F.col("is_daily") == F.col("_any_daily")).drop("_any_daily")


def _warmest() -> Column:
    return F.greatest(*[F.col(c) for c in TEMPERATURES])


def in_celsius(readings: DataFrame, scope: Sequence[str] = SEASON_SCOPE) -> DataFrame:
    """Convert the temperatures of every scope whose warmest value can only be Kelvin."""
    marked = with_group_stats(readings, scope, _warmest=F.max(_warmest()))
    offset = F.when(F.col("_warmest") > KELVIN_ABOVE, F.lit(KELVIN_OFFSET)).otherwise(F.lit(0.0))
    return marked.withColumns({c: F.col(c) - offset for c in TEMPERATURES}).drop("_warmest")


def _day_measures(limits: WeatherThresholds, offset: float = 0.0) -> dict[str, Column]:
    """Measures of one day; ``offset`` is subtracted from the temperatures."""
    mean, high, low = (F.col(c) - offset if offset else F.col(c) for c in TEMPERATURES)
    return {
        "gdd": null_safe_max(mean - limits.base_temperature),
        "extreme_heat_day": flag(high >= limits.heat),
        "frost_day": flag(low <= limits.frost),
        "dry_day": flag(F.col("precipitation") < limits.dry_below),
        "rainy_day": flag(F.col("precipitation") >= limits.rainy_from),
        "vpd": vapour_pressure_deficit(mean, F.col("humidity")),
        "heat_stress": null_safe_max(mean - limits.heat),
        "cold_stress": null_safe_max(limits.frost - low),
    }


def daily_measures(
    readings: DataFrame, limits: WeatherThresholds = WeatherThresholds()
) -> DataFrame:
    """Degree days, day flags and vapour-pressure deficit of rows that are in Celsius."""
    return readings.withColumns(
        {"days_in_month": days_in_month(F.col("year"), F.col("month")), **_day_measures(limits)}
    )


def monthly_weather(
    df: DataFrame,
    *,
    scope: Sequence[str] = SEASON_SCOPE,
    order_by: Sequence[str] = (),
    limits: WeatherThresholds = WeatherThresholds(),
    date_formats: Sequence[str] = DEFAULT_FORMATS,
) -> DataFrame:
    """Monthly measures per county, crop, year and month.

    ``scope`` (which must start at the county) is the set of rows judged together: daily rows win
    over monthly ones, and temperatures are Kelvin or Celsius, per scope. Both decisions are taken on
    the monthly aggregates instead of the rows: rows are grouped by month *and* row kind, and the few
    measures that do not simply shift with the unit are aggregated for both units. So the daily rows
    are shuffled as partial aggregates only and no group is ever collected.

    For the dry streak, rows of one calendar day are ordered by their precipitation, missing last, and each day is
    a slot of a vector in the same aggregate: one scan, one shuffle. ``order_by`` gives them another order; then
    the table is read twice and the few columns that the streak needs are shuffled row by row.
    """
    if "county_id" not in scope:
        raise ValueError("the scope must contain county_id")
    readings = weather_readings(df, date_formats)
    groups = [*MONTH_KEYS, "is_daily"]
    celsius, kelvin = _day_measures(limits), _day_measures(limits, KELVIN_OFFSET)
    mean, high, low, rain, solar = (
        F.col(c) for c in (*TEMPERATURES, "precipitation", "solar_radiation")
    )

    def per_unit(measures: dict[str, Column], tag: str) -> list[Column]:
        return [
            sum_or_zero(measures["gdd"]).alias(f"gdd_{tag}"),
            F.count_if(measures["extreme_heat_day"]).alias(f"extreme_heat_days_{tag}"),
            sum_or_zero(measures["cold_stress"]).alias(f"cold_stress_degree_days_{tag}"),
            sum_or_zero(measures["heat_stress"]).alias(f"heat_stress_degree_days_{tag}"),
            F.coalesce(F.avg(measures["vpd"]), F.lit(0.0)).alias(f"vpd_{tag}"),
        ]

    by_kind = readings.groupBy(*groups).agg(
        F.avg(mean).alias("mean"),
        F.max(high).alias("high"),
        F.min(low).alias("low"),
        F.max(_warmest()).alias("warmest"),
        *per_unit(celsius, "c"),
        *per_unit(kelvin, "k"),
        sum_or_zero(rain).alias("rain"),
        F.count_if(celsius["rainy_day"]).alias("rainy"),
        F.count_if(celsius["dry_day"]).alias("dry"),
        F.avg("humidity").alias("humidity"),
        F.avg("wind_speed").alias("wind"),
        F.max("wind_speed").alias("wind_max"),
        F.avg(solar).alias("solar"),
        sum_or_zero(solar).alias("solar_sum"),
        (F.stddev_pop(mean) + F.stddev_pop(rain) + F.stddev_pop(solar)).alias("volatility"),
        *([] if order_by else day_vector(celsius["dry_day"], "date")),
    )
    if order_by:
        streaks = longest_true_streak(readings, groups, celsius["dry_day"], ["date", *order_by], alias="dry_streak")
        by_kind = join_on(by_kind, streaks, groups, "left")
    else:
        by_kind = by_kind.withColumn("dry_streak", streak_of_days()).drop(*[f"_day_{k}" for k in DAYS])

    # One row per month and row kind from here on: a scope has a few dozen rows.
    in_scope = Window.partitionBy(*scope)
    kept = by_kind.withColumn("any_daily", F.max("is_daily").over(in_scope)).filter(
        F.col("is_daily") == F.col("any_daily")
    )
    kept = kept.withColumn(
        "is_kelvin", flag(F.max("warmest").over(in_scope) > KELVIN_ABOVE)
    )
    shift = F.when(F.col("is_kelvin"), F.lit(KELVIN_OFFSET)).otherwise(F.lit(0.0))
    unit = {
        name: F.when(F.col("is_kelvin"), F.col(f"{name}_k")).otherwise(F.col(f"{name}_c"))
        for name in (
            "gdd", "extreme_heat_days", "cold_stress_degree_days", "heat_stress_degree_days", "vpd",
        )
    }
    kept = kept.withColumns(
        {
            **unit,
            "mean": F.col("mean") - shift,
            "high": F.col("high") - shift,
            "low": F.col("low") - shift,
            "days": days_in_month(F.col("year"), F.col("month")),
        }
    )
    demand = F.greatest(F.lit(0.0), F.col("vpd")) * F.col("days") * 10.0
    rain = F.col("rain")
    out = {
        "temp_mean": F.col("mean"),
        "temp_max": F.col("high"),
        "temp_min": F.col("low"),
        "temp_range": F.col("high") - F.col("low"),
        "gdd": F.col("gdd"),
        "extreme_heat_days": F.col("extreme_heat_days"),
        "cold_stress_degree_days": F.col("cold_stress_degree_days"),
        "total_precipitation": rain,
        "rainy_days": F.col("rainy"),
        "dry_days": F.col("dry"),
        "max_dry_streak": F.col("dry_streak"),
        "humidity_mean": F.col("humidity"),
        "vpd": F.col("vpd"),
        "wind_speed_mean": F.col("wind"),
        "wind_speed_max": F.col("wind_max"),
        "solar_radiation_mean": F.col("solar"),
        "cumulative_solar_radiation": F.col("solar_sum"),
        "precipitation_intensity": rain / F.greatest(F.col("rainy"), F.lit(1)),
        "weather_volatility_score": F.col("volatility"),
        "heat_stress_degree_days": F.col("heat_stress_degree_days"),
        "drought_index": F.greatest(F.lit(0.0), demand - rain) / (demand + rain + 1e-6),
        "days_in_month": F.col("days"),
    }
    return kept.select(*MONTH_KEYS, *[c.alias(f"weather_{n}") for n, c in out.items()])


def climatology_of(
    monthly: DataFrame, keys: Sequence[str] = ("month",)
) -> DataFrame:
    """Mean temperature and rainfall per month over all years."""
    return monthly.groupBy(*keys).agg(
        F.avg("weather_temp_mean").alias("weather_temperature_baseline"),
        F.avg("weather_total_precipitation").alias("weather_rainfall_baseline"),
    )


def with_anomalies(
    monthly: DataFrame,
    climatology: DataFrame | None = None,
    *,
    scope: Sequence[str] = SERIES_SCOPE,
    climatology_keys: Sequence[str] = ("month",),
) -> DataFrame:
    """Temperature and rainfall minus their month baseline.

    Without ``climatology`` the baseline is the mean of the scope's own years. A given climatology
    holds either baseline columns, used row by row (a repeated month repeats the result rows), or
    monthly measures, which are averaged first.
    """
    temperature, rainfall = "weather_temperature_baseline", "weather_rainfall_baseline"
    if climatology is None:
        years = Window.partitionBy(*scope, "month")
        based = monthly.withColumns(
            {
                temperature: F.avg("weather_temp_mean").over(years),
                rainfall: F.avg("weather_total_precipitation").over(years),
            }
        )
    else:
        have, keys = set(climatology.columns), list(climatology_keys)
        if {*keys, temperature, rainfall} <= have:
            baseline = climatology.select(*keys, temperature, rainfall)
        elif {*keys, "weather_temp_mean", "weather_total_precipitation"} <= have:
            baseline = climatology_of(climatology, keys)
        else:
            raise ValueError(
                "climatology needs its keys and either baseline columns or monthly temperature "
                "and precipitation"
            )
        based = join_on(monthly, baseline, keys, "left")
    return based.withColumns(
        {
            "weather_temperature_anomaly": F.col("weather_temp_mean") - F.col(temperature),
            "weather_rainfall_anomaly": F.col("weather_total_precipitation") - F.col(rainfall),
        }
    ).drop(temperature, rainfall)


def with_lags(monthly: DataFrame, keys: Sequence[str] = SEASON_SCOPE) -> DataFrame:
    """Values of the previous one or two rows of the same year; the first month has none."""
    year = Window.partitionBy(*keys).orderBy("month")
    return monthly.withColumns(
        {
            "weather_rainfall_lag_1": F.lag("weather_total_precipitation", 1).over(year),
            "weather_rainfall_lag_2": F.lag("weather_total_precipitation", 2).over(year),
            "weather_temp_lag_1": F.lag("weather_temp_mean", 1).over(year),
            "weather_vpd_lag_1": F.lag("weather_vpd", 1).over(year),
        }
    )


def weather_features(
    df: DataFrame,
    climatology: DataFrame | None = None,
    *,
    scope: Sequence[str] = SERIES_SCOPE,
    **options,
) -> DataFrame:
    """Monthly measures with anomalies and lags, from daily rows."""
    monthly = monthly_weather(df, scope=scope, **options)
    return with_lags(with_anomalies(monthly, climatology, scope=scope))
