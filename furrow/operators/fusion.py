"""Late-fusion inputs: one flat feature row per validated record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.codes import crop_code, health_score


def fusion_features(df: DataFrame, on_blank: str = "null") -> DataFrame:
    """Flatten ``weather``, ``crop`` and ``image_prediction`` and add the encoded labels.

    Optional fields stay NULL when absent; JSON output leaves them out. Other columns are kept.
    """
    nested = ("weather", "crop", "image_prediction")
    return df.select(
        *[c for c in df.columns if c not in nested],
        "weather.temperature_mean",
        "weather.rainfall_total",
        "crop.crop_type",
        crop_code(F.col("crop.crop_type"), on_blank).alias("crop_type_encoded"),
        "crop.year",
        "image_prediction.disease_class",
        "image_prediction.health_score",
        health_score(F.col("image_prediction.disease_class"), on_blank).alias(
            "disease_class_health_score"
        ),
        F.col("image_prediction.confidence").alias("image_confidence"),
        "weather.temperature_min",
        "weather.temperature_max",
        "weather.humidity_mean",
        "weather.solar_radiation_mean",
        "crop.region",
        "crop.planting_age_days",
    )
