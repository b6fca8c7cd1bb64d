"""Per-scene features of RGB and vegetation-index scenes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.numeric import flag, guarded_divide
from furrow.operators.patches import mask_above, mask_of_pixels, patch_graphs, patch_stats
from furrow.operators.rasters import (
    FULL,
    ColourThresholds,
    brown_mask,
    edge_response,
    green_mask,
    grey_band,
    level_contrast,
    level_entropy,
    murky_mask,
    rgb_pixels,
    settled,
    soil_mask,
    with_hsv,
)

SCENE_KEYS = ("scene_id", "county_id", "crop_type", "year", "month")
GREEN_TO_BROWN_CAP = 100.0


@dataclass(frozen=True)
class IndexThresholds:
    """Vegetation-index limits; the defaults are fixed values."""

    valid_min: float = -0.2
    valid_max: float = 1.0
    vegetation: float = 0.3
    healthy: float = 0.5
    dense: float = 0.7
    low: float = 0.2


HISTOGRAM_BINS = 10


def _keys(scenes: DataFrame) -> list[str]:
    """Scene key columns that the table has; all are functions of ``scene_id``."""
    return [k for k in SCENE_KEYS if k in scenes.columns]


def _with_scene(stats: DataFrame, other: DataFrame) -> DataFrame:
    """Left join of two tables with one row per scene."""
    other = other.withColumnRenamed("scene_id", "_scene")
    return stats.join(other, stats["scene_id"] == other["_scene"], "left").drop("_scene")


# ------------------------------------------------------------------------------------------------
# Vegetation index
# ------------------------------------------------------------------------------------------------
def _quantile(ordered: Column, share: float) -> Column:
    """Linear interpolation between the two order statistics around ``share``."""
    at = (F.size(ordered) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return below + (above - below) * (at - low)


def _valid(value: Column, limits: IndexThresholds) -> Column:
    return (value >= limits.valid_min) & (value <= limits.valid_max)


def index_statistics(
    scenes: DataFrame,
    limits: IndexThresholds = IndexThresholds(),
    on_empty: str = "drop",
) -> DataFrame:
    """Statistics of the valid pixels of each scene, without the patch features.

    Quantiles come from the scene's own sorted array; everything else is one aggregation over the
    exploded pixels. ``on_empty`` tells what to do with scenes that have no valid pixel: ``drop``
    (list them with :func:`scenes_without_valid_pixels`), ``keep`` (their mean and other statistics are NULL) or ``fail``.
    """
    keys = _keys(scenes)
    ordered = settled(
        scenes.select(*keys, "data"),
        _sorted=F.sort_array(F.filter("data", lambda v: flag(_valid(v, limits)))),
    )
    usable = F.size("_sorted") > 0
    if on_empty == "fail":
        message = F.concat(F.lit("no valid pixel in scene "), F.col("scene_id").cast("string"))
        usable = F.when(usable, F.lit(True)).otherwise(F.raise_error(message))
    elif on_empty == "keep":
        usable = F.lit(True)
    elif on_empty != "drop":
        raise ValueError(f"on_empty must be 'drop', 'keep' or 'fail', not {on_empty!r}")
    ranked = ordered.filter(usable).select(
        *keys,
        "data",
        *[_quantile(F.col("_sorted"), q).alias(n) for n, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))],
        F.get("_sorted", F.lit(0)).alias("lowest"),
        F.try_element_at("_sorted", F.lit(-1)).alias("highest"),
    )
    pixels = ranked.select(
        *keys, "q25", "q50", "q75", "lowest", "highest", F.explode("data").alias("v")
    ).withColumn("ok", flag(_valid(F.col("v"), limits)))
    width = F.col("highest") - F.col("lowest")
    step = width / HISTOGRAM_BINS
    guess = F.least(
        F.floor(F.try_divide(F.col("v") - F.col("lowest"), width) * HISTOGRAM_BINS).cast("int"),
        F.lit(HISTOGRAM_BINS - 1),
    )
    pixels = pixels.withColumns({"_guess": guess, "_step": step})
    # The guess may be one off against the bin edges lowest + k * step.
    edge = lambda k: F.col("lowest") + k * F.col("_step")
    bin_ = (
        F.when(F.col("_guess").isNull(), F.lit(0))
        .when(F.col("v") < edge(F.col("_guess")), F.col("_guess") - 1)
        .when(
            (F.col("_guess") < HISTOGRAM_BINS - 1) & (F.col("v") >= edge(F.col("_guess") + 1)),
            F.col("_guess") + 1,
        )
        .otherwise(F.col("_guess"))
    )
    pixels = pixels.withColumn("bin", F.when(F.col("ok"), bin_))

    ok, v = F.col("ok"), F.col("v")
    of_valid = F.when(ok, v)
    share = lambda condition: F.try_divide(F.count_if(ok & condition), F.count_if(ok))
    everywhere = flag((v > limits.vegetation) & ~F.isnan(v))
    per_bin = [F.count_if(F.col("bin") == k) / (F.count_if(ok) + 1e-8) for k in range(HISTOGRAM_BINS)]
    stats = pixels.groupBy(*keys).agg(
        F.avg(of_valid).alias("ndvi_mean"),
        F.max("q50").alias("ndvi_median"),
        F.max("highest").alias("ndvi_max"),
        F.stddev_pop(of_valid).alias("ndvi_std"),
        F.max("q25").alias("ndvi_p25"),
        F.max("q75").alias("ndvi_p75"),
        share(v > limits.vegetation).alias("ndvi_above_0_3_ratio"),
        share(v > limits.healthy).alias("ndvi_above_0_5_ratio"),
        share(v > limits.dense).alias("ndvi_above_0_7_ratio"),
        share(v < limits.low).alias("ndvi_low_ratio"),
        (F.count_if(ok) / F.count(F.lit(1))).alias("ndvi_valid_coverage_ratio"),
        (F.count_if(everywhere) / F.count(F.lit(1))).alias("ndvi_vegetation_coverage_ratio"),
        (-sum((q * F.log(q + 1e-8) for q in per_bin), start=F.lit(0.0))).alias("ndvi_entropy"),
    )
    mean, above3, above5 = (
        F.col(c) for c in ("ndvi_mean", "ndvi_above_0_3_ratio", "ndvi_above_0_5_ratio")
    )
    steady = F.when(F.abs(mean) < 1e-6, F.lit(0.0)).otherwise(
        F.try_divide(F.col("ndvi_std"), F.abs(mean))
    )
    return stats.withColumns(
        {
            "ndvi_cv": steady,
            "ndvi_iqr": F.col("ndvi_p75") - F.col("ndvi_p25"),
            "ndvi_valid_mean_proxy": mean,
            "ndvi_health_index": mean * above5,
            "ndvi_stress_index": F.col("ndvi_std") * F.col("ndvi_low_ratio"),
            "ndvi_greenup_potential": above5 / (above3 + 1e-8),
        }
    )


def scenes_without_valid_pixels(
    scenes: DataFrame, limits: IndexThresholds = IndexThresholds()
) -> DataFrame:
    """Keys of the scenes :func:`index_statistics` cannot describe."""
    any_valid = F.exists("data", lambda v: flag(_valid(v, limits)))
    return scenes.filter(~any_valid).select(*_keys(scenes))


def index_features(
    scenes: DataFrame,
    limits: IndexThresholds = IndexThresholds(),
    on_empty: str = "drop",
) -> DataFrame:
    """All features of vegetation-index scenes, one row per scene."""
    stats = index_statistics(scenes, limits, on_empty)
    graphs = patch_graphs(mask_above(scenes, limits.healthy))
    patches = patch_stats(graphs, ["scene_pixels"]).select("scene_id", "patches", "max_area", "scene_pixels")
    joined = _with_scene(stats, patches)
    largest = F.coalesce(F.col("max_area") / F.col("scene_pixels"), F.lit(0.0))
    return joined.withColumns(
        {
            "ndvi_healthy_patch_count": F.coalesce(F.col("patches"), F.lit(0)),
            "ndvi_largest_high_ndvi_patch_ratio": largest,
        }
    ).drop("patches", "max_area", "scene_pixels")


# ------------------------------------------------------------------------------------------------
# RGB
# ------------------------------------------------------------------------------------------------
def colour_statistics(
    scenes: DataFrame, limits: ColourThresholds = ColourThresholds()
) -> DataFrame:
    """Colour shares and texture of each RGB scene, without the patch features.

    One pass over the pixels counts everything per grey level (at most 256 rows per scene); the
    second step folds the levels and gets the histogram measures from the same counts.
    """
    keys = _keys(scenes)
    with_grey = settled(scenes, grey=grey_band())
    pixels = with_hsv(rgb_pixels(with_grey)).select(
        *keys,
        "r", "g", "b", "hue", "sat", "val",
        F.get("grey", F.col("p")).cast("int").alias("level"),
        edge_response(F.col("grey"), F.col("p"), F.col("width"), F.col("height")).alias("edge"),
    )
    by_level = pixels.groupBy(*keys, "level").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("edge").alias("edge"),
        F.count_if(green_mask(limits)).alias("green"),
        F.count_if(brown_mask(limits)).alias("brown"),
        F.count_if(soil_mask(limits)).alias("soil"),
        F.count_if(murky_mask(limits)).alias("murky"),
        F.sum("val").alias("val"),
        F.sum("sat").alias("sat"),
    )
    ratio = lambda name: F.sum(name) / F.sum("n")
    return by_level.groupBy(*keys).agg(
        F.sum("n").alias("_cells"),
        ratio("green").alias("ag_green_pixel_ratio"),
        (ratio("green") * 100.0).alias("ag_vegetation_area_percent"),
        ratio("brown").alias("ag_brown_yellow_pixel_ratio"),
        F.least(
            guarded_divide(ratio("green"), ratio("brown")), F.lit(GREEN_TO_BROWN_CAP)
        ).alias("ag_green_to_brown_ratio"),
        ratio("soil").alias("ag_soil_exposure_ratio"),
        level_entropy().alias("ag_texture_entropy"),
        ratio("edge").alias("ag_edge_density"),
        level_contrast().alias("ag_local_contrast"),
        (ratio("val") / FULL).alias("ag_mean_brightness"),
        (ratio("sat") / FULL).alias("ag_color_saturation_mean"),
        ratio("murky").alias("ag_shadow_cloud_ratio"),
    )


def green_masks(scenes: DataFrame, limits: ColourThresholds = ColourThresholds()) -> DataFrame:
    """Mask table of the green pixels of RGB scenes."""
    return mask_of_pixels(with_hsv(rgb_pixels(scenes)), green_mask(limits))


def colour_features(
    scenes: DataFrame, limits: ColourThresholds = ColourThresholds()
) -> DataFrame:
    """All features of RGB scenes, one row per scene."""
    graphs = patch_graphs(green_masks(scenes, limits))
    patches = patch_stats(graphs, ["mask_pixels", "boundary_pixels"])
    joined = _with_scene(colour_statistics(scenes, limits), patches)
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    area, edge = zero("mask_pixels").cast("double"), zero("boundary_pixels").cast("double")
    mean, spread = zero("mean_area"), zero("std_area")
    uneven = (
        1.0 + F.col("ag_edge_density") * 6.0 + F.col("ag_local_contrast") * 4.0 + spread / (mean + 1.0)
    )
    return joined.withColumns(
        {
            "ag_number_of_vegetation_chunks": zero("patches"),
            "ag_largest_vegetation_chunk_ratio": zero("max_area") / F.col("_cells"),
            "ag_mean_chunk_area": mean.cast("double"),
            "ag_chunk_area_std": spread.cast("double"),
            "ag_field_uniformity_score": 1.0 / uneven,
            "ag_vegetation_perimeter_to_area_ratio": guarded_divide(edge, area),
            "ag_morphological_compactness": guarded_divide(4.0 * math.pi * area, edge * edge),
        }
    ).drop(
        "_cells", "patches", "mean_area", "std_area", "max_area", "mask_pixels", "boundary_pixels"
    )
