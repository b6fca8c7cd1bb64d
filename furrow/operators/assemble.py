"""Putting modalities together: monthly means, outer join, month maps, records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.numeric import finite_or_null
from furrow.functions.records import is_numeric
from furrow.functions.text import fips_code
from furrow.operators.joins import join_on, same_keys
from furrow.operators.labels import ENVELOPE_FIELDS, GEO_FIELDS, usable_anchors

KEY_TYPES = {"county_id": "string", "crop_type": "string", "year": "int", "month": "int"}
MONTH_KEYS = tuple(KEY_TYPES)

# --- fixed values: compact feature set per modality ---------------------------------------------
CORE_FEATURES = {
    "ag": [
        "ag_green_pixel_ratio", "ag_vegetation_area_percent", "ag_largest_vegetation_chunk_ratio",
        "ag_brown_yellow_pixel_ratio", "ag_soil_exposure_ratio", "ag_texture_entropy",
        "ag_edge_density", "ag_field_uniformity_score",
    ],
    "ndvi": [
        "ndvi_mean", "ndvi_median", "ndvi_std", "ndvi_p25", "ndvi_p75", "ndvi_above_0_3_ratio",
        "ndvi_above_0_5_ratio", "ndvi_low_ratio", "ndvi_peak_value", "ndvi_peak_month",
        "ndvi_growth_slope", "ndvi_auc",
    ],
    "weather": [
        "weather_temp_mean", "weather_temp_max", "weather_temp_min", "weather_temp_range",
        "weather_gdd", "weather_extreme_heat_days", "weather_total_precipitation",
        "weather_rainy_days", "weather_dry_days", "weather_max_dry_streak",
        "weather_humidity_mean", "weather_vpd", "weather_solar_radiation_mean",
        "weather_temperature_anomaly", "weather_rainfall_anomaly",
    ],
}


def _with_keys(df: DataFrame, keys: Sequence[str] = MONTH_KEYS) -> DataFrame:
    """Key columns in fixed types, NULL where absent."""
    have = set(df.columns)
    return df.withColumns(
        {
            k: F.col(k).cast(KEY_TYPES[k]) if k in have else F.lit(None).cast(KEY_TYPES[k])
            for k in keys
        }
    )


def monthly_means(df: DataFrame, keys: Sequence[str] = MONTH_KEYS) -> DataFrame:
    """Mean of every numeric column per key, NULL keys included; other columns are dropped.

    Without a numeric column the distinct keys are left.
    """
    df = _with_keys(df, keys)
    numeric = [f.name for f in df.schema.fields if f.name not in keys and is_numeric(f.dataType)]
    if not numeric:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in numeric])


def combine_modalities(*tables: DataFrame, keys: Sequence[str] = MONTH_KEYS) -> DataFrame:
    """Full outer join of feature tables on their keys; NULL keys match each other."""
    if not tables:
        raise ValueError("at least one table is needed")

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.select(
            *[F.col(k).alias(f"_right_{k}") for k in keys],
            *[F.col(c) for c in right.columns if c not in keys],
        )
        both = left.join(
            other, same_keys(left, other, [(k, f"_right_{k}") for k in keys]), "full_outer"
        )
        return both.select(
            *[F.coalesce(F.col(k), F.col(f"_right_{k}")).alias(k) for k in keys],
            *[c for c in left.columns if c not in keys],
            *[c for c in other.columns if not c.startswith("_right_")],
        )

    return reduce(joined, (_with_keys(t, keys) for t in tables))


def _feature_columns(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema.fields if f.name not in MONTH_KEYS and is_numeric(f.dataType)
    ]


def _number(column: str) -> Column:
    return finite_or_null(F.col(column).cast("double"))


def month_map(
    monthly: DataFrame,
    prefix: str,
    keys: Sequence[str] = ("county_id", "year"),
    order_by: Sequence[str] = (),
) -> DataFrame:
    """One map per season: ``{prefix}_m{MM}_{column}`` -> value, plus the month and row counts.

    A month without rows has no keys; a missing value is a key with NULL. Rows without a month are left out. Of several rows of a month
    the last in ``order_by`` order counts. Rows are folded to one per month first, with map-side
    combine, so that the map is put together from a dozen rows.
    """
    columns = _feature_columns(monthly)
    values = F.struct(*[_number(c).alias(c) for c in columns])
    rank = F.struct(*order_by) if order_by else values
    months = monthly.filter(F.col("month").isNotNull()).groupBy(*keys, "month").agg(
        F.max_by(values, rank).alias("last"), F.count(F.lit(1)).alias("rows")
    )
    name = lambda c: F.concat(F.lit(f"{prefix}_m"), F.lpad(F.col("month").cast("string"), 2, "0"), F.lit(f"_{c}"))
    entries = F.array(*[F.struct(name(c).alias("key"), F.col(f"last.{c}").alias("value")) for c in columns])
    counted = lambda suffix, value: F.struct(
        F.lit(f"{prefix}_{suffix}").alias("key"), value.cast("double").alias("value")
    )
    folded = months.withColumn("entries", entries).groupBy(*keys).agg(
        F.flatten(F.collect_list("entries")).alias("entries"),
        F.count("month").alias("n_months"),
        F.sum("rows").alias("n_rows"),
    )
    counts = F.array(
        counted("month_count", F.col("n_months")), counted("observation_count", F.col("n_rows"))
    )
    return folded.select(
        *keys,
        F.map_from_entries(F.concat("entries", counts)).alias("features"),
        F.col("n_months").alias("available_months"),
        F.col("n_rows").alias("feature_rows"),
    )


def month_columns(
    monthly: DataFrame,
    prefix: str,
    columns: Sequence[str],
    keys: Sequence[str] = ("county_id", "year"),
) -> DataFrame:
    """The same months as wide columns; absent months are NULL."""
    cells = [
        F.max(F.when(F.col("month") == m, _number(c))).alias(f"{prefix}_m{m:02d}_{c}")
        for m in range(1, 13)
        for c in columns
    ]
    seen = F.bit_count(F.bit_or(F.expr("shiftleft(1, CAST(month AS INT))")))
    return monthly.groupBy(*keys).agg(*cells, seen.alias(f"{prefix}_month_count"))


def season_map(summary: DataFrame, keys: Sequence[str] = ("county_id", "year")) -> DataFrame:
    """Season columns as one map per key."""
    pairs = [x for c in _feature_columns(summary) for x in (F.lit(c), _number(c))]
    return summary.select(*keys, F.create_map(*pairs).alias("season"))


def modality_features(
    monthly: DataFrame,
    summary: DataFrame,
    modality: str,
    keys: Sequence[str] = ("county_id", "year"),
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Feature map of each season: months, season summary and row counts."""
    months = month_map(monthly, modality, keys, order_by)
    season = season_map(summary, keys)
    renamed = season.select(*[F.col(k).alias(f"_s_{k}") for k in keys], "season")
    joined = months.join(
        renamed, same_keys(months, renamed, [(k, f"_s_{k}") for k in keys]), "left"
    )
    empty = F.create_map().cast("map<string,double>")
    counts = F.create_map(
        F.lit(f"{modality}_available_months"), F.col("available_months").cast("double"),
        F.lit(f"{modality}_feature_rows"), F.col("feature_rows").cast("double"),
    )
    features = F.map_concat("features", F.coalesce("season", empty), counts)
    return joined.select(*keys, features.alias("features"))


def modality_records(anchor_rows: DataFrame, features: DataFrame) -> DataFrame:
    """Anchors with the features of their county and year; anchors without features are dropped.

    Features do not depend on the crop, so they are computed once per county and year and every anchor
    of that season gets the same map.
    """
    kept = usable_anchors(anchor_rows).withColumn("county_id", fips_code(F.col("county_id")))
    geo = [c for c in GEO_FIELDS if c in kept.columns]
    slim = kept.select(*ENVELOPE_FIELDS, *geo)
    seasons = features.select("county_id", "year", "features")
    joined = join_on(seasons, slim, ["county_id", "year"])
    return joined.select(
        "county_id", "crop_type", "year", "split", "target_kind", "target_value", "target_unit",
        "source_path", *geo, "features",
    )


def core_features(df: DataFrame, modality: str) -> DataFrame:
    """Keys and the compact feature set of a modality, as far as the table has it."""
    if modality not in CORE_FEATURES:
        raise ValueError(f"unknown modality: {modality!r}")
    have = set(df.columns)
    return df.select(
        *[k for k in MONTH_KEYS if k in have], *[c for c in CORE_FEATURES[modality] if c in have]
    )
