"""Row constraints: each rule is a predicate, a row's ``reasons`` are the rules it breaks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A field with an inclusive range or a minimum text length."""

    field: str
    required: bool = True
    low: float | None = None
    high: float | None = None
    min_length: int | None = None

    @property
    def reason(self) -> str:
        return self.field.replace(".", "_")

    def broken(self) -> Column:
        value = F.col(self.field)
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (value < self.low) | F.isnan(value.cast("double"))
        if self.high is not None:
            bad = bad | (value > self.high)
        if self.min_length is not None:
            bad = bad | (F.length(value) < self.min_length)
        return F.when(value.isNull(), F.lit(self.required)).otherwise(bad)


def _under(parent: str, rules: list[Rule]) -> list[Rule]:
    return [
        Rule(f"{parent}.{r.field}", r.required, r.low, r.high, r.min_length) for r in rules
    ]


# --- fixed values: constraints of the record types ----------------------------------------------
IMAGE_RULES = [
    Rule("disease_class", min_length=1),
    Rule("health_score", low=0.0, high=1.0),
    Rule("confidence", low=0.0, high=1.0),
]
WEATHER_RULES = [
    Rule("temperature_mean"),
    Rule("rainfall_total", low=0.0),
    Rule("humidity_mean", required=False, low=0.0, high=100.0),
    Rule("solar_radiation_mean", required=False, low=0.0),
]
CROP_RULES = [
    Rule("crop_type", min_length=1),
    Rule("year", low=1900),
    Rule("planting_age_days", required=False, low=0),
]
INPUT_RULES = [
    *_under("weather", WEATHER_RULES),
    *_under("crop", CROP_RULES),
    *_under("image_prediction", IMAGE_RULES),
]
PREDICTION_RULES = [
    Rule("predicted_yield", low=0.0),
    Rule("unit", min_length=1),
    Rule("model_name", min_length=1),
]


def with_reasons(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``reasons``: the names of broken rules, empty for a valid row."""
    names = F.array(*[F.when(r.broken(), F.lit(r.reason)) for r in rules])
    return df.withColumn("reasons", F.filter(names, lambda n: n.isNotNull()))


def valid_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return with_reasons(df, rules).filter(F.size("reasons") == 0).drop("reasons")


def rejected_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return with_reasons(df, rules).filter(F.size("reasons") > 0)


def predictions(df: DataFrame) -> DataFrame:
    """Prediction rows with their optional warnings as a list, empty when absent."""
    none = F.array().cast("array<string>")
    warnings = F.coalesce("warnings", none) if "warnings" in df.columns else none
    return df.withColumn("warnings", warnings)
