"""One query per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.codes import (
    canonical_crop,
    label_column,
    label_unit,
    split_of_year,
    state_abbr,
)
from furrow.functions.dates import month_of_date_key
from furrow.functions.text import fips_code, key_text, numeric_code
from furrow.operators.assemble import (
    combine_modalities,
    core_features,
    modality_features,
    modality_records,
    month_columns,
    month_map,
    monthly_means,
)
from furrow.operators.checks import INPUT_RULES, PREDICTION_RULES, predictions, with_reasons
from furrow.operators.climatology import climatology_of_state, climatology_state
from furrow.operators.fusion import fusion_features
from furrow.operators.labels import (
    anchors,
    anchors_of_cells,
    choose_label_rows,
    county_ids,
    in_counties,
    rejected_labels,
    split_counts,
    usable_anchors,
)
from furrow.operators.patches import mask_above, patch_graphs, patch_sizes, patch_stats
from furrow.operators.rasters import (
    ColourRange,
    ColourThresholds,
    edge_density,
    grey_scenes,
    index_scenes,
    rgb_pixels,
    rgb_scenes,
    texture,
    with_hsv,
)
from furrow.operators.scenes import (
    IndexThresholds,
    colour_features,
    colour_statistics,
    green_masks,
    index_features,
    index_statistics,
    scenes_without_valid_pixels,
)
from furrow.operators.season import index_season, vegetation_season, weather_season
from furrow.operators.streaks import longest_dated_streak, longest_true_streak
from furrow.operators.tiles import tile_boundaries, tile_edge_density, tile_patch_sizes, tile_quantiles
from furrow.operators.weather import (
    WeatherThresholds,
    climatology_of,
    daily_measures,
    in_celsius,
    monthly_weather,
    prefer_daily_rows,
    weather_readings,
    with_anomalies,
    with_lags,
)
from furrow.plans.export import record_table, scene_season
from furrow.sources.paths import select_label_paths, with_label_path_fields
from furrow.sources.scenes import container_scenes, tensor_scenes
from furrow.sources.sinks import record_json
from furrow.sources.tables import bound_by_name, united_names
from parity.surrogates import (
    TIES,
    climatology,
    fusion_inputs,
    index_scene_table,
    label_file_paths,
    label_rows,
    rgb_scene_table,
    table,
    tiled_scenes,
    weather_daily,
    weather_headers,
)

TARGET = "YIELD, MEASURED IN BU / ACRE"


def rounded(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Doubles to six places, with the boundary off the middle as in the SQL."""

    def value(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.floor(column.cast("double") * 1e6 + 0.4837) / 1e6
        return column.alias(field.name)

    return df.select(*[value(f) for f in df.schema.fields if f.name not in drop])


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    return monthly_weather(weather_daily(spark, sf), order_by=TIES)


# --- weather ------------------------------------------------------------------------------------
def weather_monthly(spark, sf):
    return rounded(_monthly(spark, sf))


def dry_streak(spark, sf):
    rows = weather_readings(weather_daily(spark, sf))
    keys = ["county_id", "year", "month"]
    return longest_true_streak(rows, keys, F.col("precipitation") < 1.0, ["date", *TIES])


def weather_monthly_untied(spark, sf):
    """Without tie keys: rows of one date by precipitation."""
    return rounded(monthly_weather(weather_daily(spark, sf)))


def dry_streak_dated(spark, sf):
    rows = weather_readings(weather_daily(spark, sf))
    return longest_dated_streak(rows, ["county_id", "year", "month"], F.col("precipitation") < 1.0, "date")


def weather_limits(spark, sf):
    """Other thresholds than the defaults."""
    limits = WeatherThresholds(base_temperature=4.5, heat=22.0, frost=3.0, dry_below=12.0, rainy_from=25.0)
    out = monthly_weather(weather_daily(spark, sf), limits=limits)
    return rounded(
        out.select(
            "county_id", "year", "month", "weather_gdd", "weather_extreme_heat_days", "weather_cold_stress_degree_days",
            "weather_heat_stress_degree_days", "weather_rainy_days", "weather_dry_days", "weather_max_dry_streak",
        )
    )


def weather_own_climatology(spark, sf):
    """A climatology of monthly measures, averaged first."""
    monthly = _monthly(spark, sf)
    out = with_anomalies(monthly, monthly.where("year < 1997"))
    return rounded(
        out.select("county_id", "year", "month", "weather_temperature_anomaly", "weather_rainfall_anomaly")
    )


def weather_anomaly(spark, sf):
    out = with_anomalies(_monthly(spark, sf))
    return rounded(
        out.select("county_id", "year", "month", "weather_temperature_anomaly", "weather_rainfall_anomaly")
    )


def weather_given_climatology(spark, sf):
    out = with_anomalies(_monthly(spark, sf), climatology(spark, sf))
    return rounded(
        out.select("county_id", "year", "month", "weather_temperature_anomaly", "weather_rainfall_anomaly")
    )


def weather_climatology(spark, sf):
    return rounded(climatology_of(_monthly(spark, sf)))


def weather_climatology_merged(spark, sf):
    """The climatology from sums per year."""
    return rounded(climatology_of_state(climatology_state(_monthly(spark, sf))))


def weather_lags(spark, sf):
    out = with_lags(_monthly(spark, sf))
    lags = [c for c in out.columns if "_lag_" in c]
    return rounded(out.select("county_id", "year", "month", *lags))


def daily_rows_kept(spark, sf):
    out = prefer_daily_rows(weather_readings(weather_daily(spark, sf)))
    return rounded(out.select("county_id", "date", "is_daily", *TIES))


def celsius_rows(spark, sf):
    out = in_celsius(weather_readings(weather_daily(spark, sf)))
    return rounded(
        out.select("county_id", "temperature_mean", "temperature_max", "temperature_min", *TIES)
    )


def day_measures(spark, sf):
    out = daily_measures(weather_readings(weather_daily(spark, sf)))
    return rounded(
        out.select(
            "county_id", "year", "month", "days_in_month", "gdd", "extreme_heat_day", "frost_day",
            "dry_day", "rainy_day", "vpd", *TIES,
        )
    )


def readings_of_headers(spark, sf):
    out = weather_readings(weather_headers(spark, sf))
    return rounded(
        out.select(
            "county_id", "crop_type", "year", "month", "date", "temperature_mean", "temperature_max",
            "temperature_min", "precipitation", "humidity", "wind_speed", "solar_radiation", *TIES,
        )
    )


def season_weather(spark, sf):
    return rounded(weather_season(_monthly(spark, sf)), drop=("crop_type",))


def season_weather_all_years(spark, sf):
    return rounded(weather_season(_monthly(spark, sf), keys=("county_id",)))


# --- scenes -------------------------------------------------------------------------------------
def ndvi_statistics(spark, sf):
    return rounded(index_statistics(index_scenes(index_scene_table(spark, sf))))


def ndvi_features(spark, sf):
    return rounded(index_features(index_scenes(index_scene_table(spark, sf))))


def ndvi_rejected(spark, sf):
    scenes = index_scenes(index_scene_table(spark, sf))
    high = scenes.withColumn("data", F.transform("data", lambda v: v - 1.0))
    return scenes_without_valid_pixels(high).select("scene_id")


def ndvi_patches(spark, sf):
    graphs = patch_graphs(mask_above(index_scene_table(spark, sf), 0.5))
    return rounded(patch_stats(graphs))


def patch_areas(spark, sf):
    return patch_sizes(patch_graphs(mask_above(index_scene_table(spark, sf), 0.3)))


def patch_boundaries(spark, sf):
    graphs = patch_graphs(mask_above(index_scene_table(spark, sf), -0.5))
    return graphs.select("scene_id", "mask_pixels", "boundary_pixels")


def index_levels_loaded(spark, sf):
    """Whole-number scenes and two-band scenes of the same values."""
    scenes = index_scene_table(spark, sf)
    whole = scenes.withColumn("data", F.transform("data", lambda v: F.floor((v + 4.0) * 30.0).cast("int")))
    bands = scenes.withColumns({"height": F.lit(4), "channels": F.lit(2)})
    one = index_scenes(whole).select("scene_id", F.lit("levels").alias("kind"), F.posexplode("data").alias("p", "v"))
    two = index_scenes(bands).select("scene_id", F.lit("bands").alias("kind"), F.posexplode("data").alias("p", "v"))
    return rounded(one.unionByName(two))


def rgb_loaded(spark, sf):
    """Fractional scenes: stretched where within [0, 1], cut to 0..255 elsewhere."""
    scenes = index_scene_table(spark, sf)
    shift = F.when(F.col("scene_id").cast("int") % 2 == 0, F.lit(0.5)).otherwise(F.lit(40.0))
    scenes = scenes.withColumn("_shift", shift)
    data = F.transform("data", lambda v: F.when(F.col("_shift") < 1, v / 8.0 + 0.5).otherwise(v * F.col("_shift") * 4.0))
    loaded = rgb_scenes(scenes.withColumn("data", data).drop("_shift"))
    return loaded.select("scene_id", F.posexplode("data").alias("i", "level"))


def _rgb(spark, sf):
    return rgb_scenes(rgb_scene_table(spark, sf))


def hsv_pixels(spark, sf):
    return with_hsv(rgb_pixels(_rgb(spark, sf))).select("scene_id", "p", "r", "g", "b", "hue", "sat", "val")


def ag_statistics(spark, sf):
    return rounded(colour_statistics(_rgb(spark, sf)), drop=("_cells",))


def ag_limits(spark, sf):
    """Other pixel classes than the defaults."""
    green = ColourRange(hues=(50, 130), saturation=60, value=50)
    limits = ColourThresholds(green=green, soil_dull=70, shadow_value=80, cloud_value=180, cloud_saturation=90)
    out = colour_statistics(_rgb(spark, sf), limits)
    return rounded(out.select("scene_id", "ag_green_pixel_ratio", "ag_soil_exposure_ratio", "ag_shadow_cloud_ratio"))


def ndvi_limits(spark, sf):
    """Other index limits than the defaults."""
    limits = IndexThresholds(valid_min=-0.5, valid_max=0.9, vegetation=0.2, healthy=0.4, dense=0.6, low=0.1)
    out = index_features(index_scenes(index_scene_table(spark, sf)), limits)
    return rounded(
        out.select(
            "scene_id", "ndvi_mean", "ndvi_above_0_3_ratio", "ndvi_above_0_5_ratio", "ndvi_above_0_7_ratio", "ndvi_low_ratio",
            "ndvi_valid_coverage_ratio", "ndvi_vegetation_coverage_ratio", "ndvi_healthy_patch_count",
        )
    )


def ag_features(spark, sf):
    return rounded(colour_features(_rgb(spark, sf)))


def green_patches(spark, sf):
    return patch_sizes(patch_graphs(green_masks(_rgb(spark, sf))))


def grey_texture(spark, sf):
    return rounded(texture(grey_scenes(_rgb(spark, sf))))


def grey_edges(spark, sf):
    return rounded(edge_density(grey_scenes(_rgb(spark, sf))))


def _index_monthly(spark, sf):
    scenes = index_scenes(index_scene_table(spark, sf))
    return monthly_means(index_statistics(scenes).drop("scene_id"))


def _colour_monthly(spark, sf):
    return monthly_means(colour_statistics(_rgb(spark, sf)).drop("scene_id", "_cells"))


def scene_month_means(spark, sf):
    return rounded(_index_monthly(spark, sf))


def season_ndvi(spark, sf):
    return rounded(index_season(_index_monthly(spark, sf)))


def season_ag(spark, sf):
    return rounded(vegetation_season(_colour_monthly(spark, sf)))


def season_ndvi_patches(spark, sf):
    """Monthly means with the patch features, as the export takes them."""
    monthly, _ = scene_season(index_scenes(index_scene_table(spark, sf)), "ndvi")
    return rounded(
        monthly.select(
            "county_id", "crop_type", "year", "month", "ndvi_mean", "ndvi_healthy_patch_count", "ndvi_largest_high_ndvi_patch_ratio"
        )
    )


def season_ag_patches(spark, sf):
    monthly, summary = scene_season(_rgb(spark, sf), "ag")
    chunks = monthly.select("county_id", "year", "month", "ag_number_of_vegetation_chunks", "ag_largest_vegetation_chunk_ratio")
    return rounded(chunks.join(summary.select("county_id", "year", "ag_peak_value", "ag_amplitude"), ["county_id", "year"]))


def container_months(spark, sf):
    """A stored container with text date keys: scenes, months and mean pixel."""
    scenes = index_scene_table(spark, sf)
    key = F.concat(
        F.col("year").cast("string"), F.lit("-"), F.lpad(F.col("month").cast("string"), 2, "0"), F.lit("-01")
    )
    container = scenes.select(
        F.col("county_id").cast("int").alias("county_id"), key.alias("date"),
        F.col("scene_id").alias("grid_index"), "height", "width", "data",
    )
    loaded = container_scenes(container, "ndvi")
    mean = F.aggregate("data", F.lit(0.0), lambda a, v: a + v) / F.size("data")
    return rounded(loaded.select("scene_id", "county_id", "year", "month", mean.alias("mean")))


def tensor_months(spark, sf):
    """Tensors of two months with two 4x4 grids each."""
    grid = lambda i: F.struct(
        F.lit(4).alias("height"), F.lit(4).alias("width"), F.slice("data", 16 * i + 1, 16).alias("data")
    )
    tensors = index_scene_table(spark, sf).select(
        F.col("scene_id").alias("tensor_id"),
        F.array(F.array(grid(0), grid(1)), F.array(grid(2), grid(3))).alias("tensor"),
    )
    loaded = tensor_scenes(tensors, "ndvi")
    return rounded(
        loaded.select("scene_id", "month", F.array_max("data").alias("highest"), F.array_min("data").alias("lowest"))
    )


# --- scenes in tiles ----------------------------------------------------------------------------
def tiled_patch_areas(spark, sf):
    return tile_patch_sizes(tiled_scenes(spark, sf), 0.3)


def tiled_edges(spark, sf):
    level = lambda x: F.floor(F.abs(x) * 700.0).cast("int") % 256
    tiles = tiled_scenes(spark, sf, 1.0).withColumn("data", F.transform("data", level))
    return rounded(tile_edge_density(tiles))


def tiled_boundaries(spark, sf):
    return tile_boundaries(tiled_scenes(spark, sf), -0.5)


def tiled_quantiles(spark, sf):
    return rounded(tile_quantiles(tiled_scenes(spark, sf)))


# --- labels -------------------------------------------------------------------------------------
def label_choice(spark, sf):
    return choose_label_rows(label_rows(spark, sf), TARGET).select(
        "c_custkey", "source_path", "agg_level_desc", "domain_desc"
    )


def _anchors(spark, sf):
    return anchors(label_rows(spark, sf), crop_type="Corn", target_kind="yield")


def label_anchors(spark, sf):
    out = _anchors(spark, sf)
    flat = out.select(
        *[c for c in out.columns if c != "features"],
        F.col("features.segment").alias("feature_segment"),
        F.col("features.balance").alias("feature_balance"),
        F.col("features.c_custkey").alias("feature_custkey"),
    )
    return rounded(flat)


def label_rejects(spark, sf):
    return rejected_labels(label_rows(spark, sf), TARGET).select("c_custkey", "reason")


def label_usable(spark, sf):
    return rounded(
        usable_anchors(_anchors(spark, sf)).select("county_id", "crop_type", "year", "split", "target_value")
    )


def label_county_ids(spark, sf):
    return county_ids(_anchors(spark, sf))


def label_in_counties(spark, sf):
    out = in_counties(_anchors(spark, sf), ["01003", "2010", " 03017 ", "07500"])
    return rounded(out.select("county_id", "target_value", "source_path"))


def label_split_counts(spark, sf):
    return split_counts(_anchors(spark, sf), by=["crop_type"])


def label_paths_selected(spark, sf):
    return select_label_paths(label_file_paths(spark, sf), [2017, 2018, 2020], ["corn", "Winter Wheat"])


def label_path_fields(spark, sf):
    return with_label_path_fields(label_file_paths(spark, sf).distinct())


def code_lookups(spark, sf):
    crop = F.element_at(
        F.array(*map(F.lit, ("corn", "Cotton ", "SOYBEAN", "winter_wheat", "rye"))),
        (F.col("c_custkey") % 5 + 1).cast("int"),
    )
    customer = table(spark, sf, "customer").withColumn("crop", crop)
    return customer.select(
        "c_custkey",
        state_abbr(F.col("c_nationkey").cast("string")).alias("state"),
        canonical_crop(F.col("crop")).alias("crop"),
        label_column(F.col("crop"), "production").alias("column"),
        label_unit(F.col("crop"), "yield").alias("unit"),
        split_of_year(2015 + F.col("c_custkey") % 9).alias("split"),
        numeric_code(F.col("c_acctbal"), 4).alias("code"),
        fips_code(F.col("c_custkey")).alias("fips"),
    )


def date_key_months(spark, sf):
    key = F.col("o_orderkey")
    text = (
        F.when(key % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(key % 4 == 1, F.date_format("o_orderdate", "yyyyMMdd"))
        .when(key % 4 == 2, F.date_format("o_orderdate", "MM"))
        .otherwise("none")
    )
    return table(spark, sf, "orders").select("o_orderkey", month_of_date_key(text).alias("month"))


def normalised_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", key_text(F.col("text")).alias("key"))


# --- assembly -----------------------------------------------------------------------------------
def joined_modalities(spark, sf):
    weather = _monthly(spark, sf).select(
        "county_id", (F.col("year") + 18).alias("year"), "month", "weather_temp_mean",
        "weather_rainy_days",
    )
    colour = _colour_monthly(spark, sf).select(
        "county_id", "crop_type", "year", "month", "ag_green_pixel_ratio"
    )
    index = _index_monthly(spark, sf).select("county_id", "crop_type", "year", "month", "ndvi_mean")
    # None of them has a crop; weather is moved to the years of the scenes.
    return rounded(combine_modalities(colour, index, weather))


def month_wide(spark, sf):
    columns = ["ndvi_mean", "ndvi_max"]
    return rounded(month_columns(_index_monthly(spark, sf), "ndvi", columns))


def month_keys_values(spark, sf):
    monthly = _index_monthly(spark, sf).select("county_id", "crop_type", "year", "month", "ndvi_mean", "ndvi_max")
    features = month_map(monthly, "ndvi")
    return rounded(features.select("county_id", "year", F.explode("features").alias("key", "value")))


def distinct_month_keys(spark, sf):
    return monthly_means(index_scene_table(spark, sf).select("county_id", "crop_type", "year", "month"))


def anchor_records(spark, sf):
    """Label anchors with the index features of their county and year, one row per feature."""
    monthly = _index_monthly(spark, sf).select("county_id", "crop_type", "year", "month", "ndvi_mean")
    summary = index_season(monthly).select("county_id", "year", "ndvi_peak_month", "ndvi_amplitude")
    features = modality_features(monthly, summary, "ndvi")
    counties = _anchors(spark, sf).withColumn(
        "county_id", F.lpad((F.col("features.c_custkey") % 10).cast("string"), 5, "0")
    )
    out = modality_records(counties, features)
    return rounded(
        out.select(
            "county_id", "crop_type", "year", "split", "target_value", "source_path", "state_ansi",
            "state_name", F.explode("features").alias("key", "value"),
        )
    )


def core_weather(spark, sf):
    return rounded(core_features(with_anomalies(_monthly(spark, sf)), "weather"), drop=("crop_type",))


def weather_records(spark, sf):
    """Daily rows of two crops and label anchors to one record per anchor."""
    crop = F.when(F.col("l_linenumber") % 2 == 0, "corn").otherwise("soybeans")
    raw = weather_daily(spark, sf).withColumn("crop_type", crop)
    key = F.col("features.c_custkey")
    moved = _anchors(spark, sf).withColumns(
        {
            "county_id": F.lpad((key % 20).cast("string"), 5, "0"),
            "year": (1992 + key % 7).cast("int"),
            "split": F.lit("train"),
            "source_path": key.cast("string"),
        }
    )
    value = lambda k: F.col("features")[k]
    out = record_table(moved, raw, "weather")
    return rounded(
        out.select(
            "county_id", "crop_type", "year", "source_path", "target_value",
            value("weather_available_months").alias("months"),
            value("weather_feature_rows").alias("feature_rows"),
            value("weather_m03_weather_total_precipitation").alias("march_rain"),
            value("weather_heat_stress_total").alias("heat_stress"),
        )
    )


def container_features(spark, sf):
    """Two stored files whose grids have the same keys, one of them without a date."""
    scenes = index_scene_table(spark, sf)
    vec = F.col("scene_id").cast("long")
    container = scenes.select(
        F.concat(F.lit("file"), (vec % 2).cast("string")).alias("file"),
        F.lit("1003").alias("county_id"),
        F.when(vec % 10 != 0, F.lit("2019-05-01")).alias("date"),
        F.floor(vec / 2).alias("grid_index"), "height", "width", "data",
    )
    mean = F.aggregate("data", F.lit(0.0), lambda a, v: a + v) / F.size("data")
    loaded = container_scenes(container, "ndvi")
    return rounded(loaded.select("scene_id", "county_id", "month", mean.alias("mean"), F.array_max("data").alias("highest")))


def label_features_mixed(spark, sf):
    """customer as label cells of two crops whose extra column holds numbers and text."""
    key = F.col("c_custkey")
    text = key.cast("string")
    extra = (
        F.when(key % 4 == 0, text)
        .when(key % 4 == 1, F.concat(text, F.lit(".50")))
        .when(key % 4 == 2, F.concat(F.lit(" no. "), text))
        .otherwise("  ")
    )
    crop = F.when(key % 2 == 0, "Corn").otherwise("Cotton")
    target = F.when(key % 2 == 0, TARGET).otherwise("YIELD, MEASURED IN LB / ACRE")
    acres = F.when(key % 11 == 0, "(D)").otherwise(F.col("c_acctbal").cast("string"))
    cells = F.map_from_arrays(
        F.array(F.lit("state_ansi"), F.lit("county_ansi"), target, F.lit("extra")),
        F.array(F.col("c_nationkey").cast("string"), (key % 500).cast("string"), acres, extra),
    )
    rows = table(spark, sf, "customer").select(
        text.alias("source_path"), F.lit(2018).alias("year"), F.lit("train").alias("split"), crop.alias("crop_type"),
        cells.alias("cells"),
    )
    out = anchors_of_cells(rows, "yield")
    value = F.try_element_at("features", F.lit("extra"))
    return rounded(
        out.select(
            "source_path", "crop_type", "county_id", "target_value", "target_unit",
            F.schema_of_variant(value).alias("kind"), value.cast("string").alias("extra"),
        )
    )


def united_by_name(spark, sf):
    """customer as rows of three headers, which name other columns in other orders and cases."""
    key = F.col("c_custkey")
    text = lambda c: F.col(c).cast("string")
    rows = table(spark, sf, "customer").select(
        (key % 3).cast("string").alias("file"),
        F.when(key % 3 == 0, F.array(text("c_custkey"), text("c_name"), text("c_acctbal")))
        .when(key % 3 == 1, F.array(text("c_acctbal"), text("c_custkey")))
        .otherwise(F.array(text("c_mktsegment"), text("c_custkey"), text("c_name"))).alias("cells"),
    )
    headers = [["key", "name", "balance"], ["Balance", "KEY"], ["segment", "Key", "name", "never filled"]]
    layouts = spark.createDataFrame([(str(i), h) for i, h in enumerate(headers)], "file string, header array<string>")
    names = united_names(headers)
    return bound_by_name(rows, F.broadcast(layouts), names).withColumnRenamed("never filled", "never_filled")


def record_lines(spark, sf):
    """JSON text of records: missing fields left out, but for those that are always written."""
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit(' "'), F.col("c_name"), F.lit("\\ "))).alias("name"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).otherwise(float("nan")).alias("balance"),
        F.create_map(F.lit("segment"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))).alias("features"),
    )
    return customer.select(F.col("id").alias("c_custkey"), record_json(customer, keep_nulls=("balance",)).alias("line"))


def core_ndvi(spark, sf):
    return rounded(core_features(_index_monthly(spark, sf), "ndvi"))


def core_ag(spark, sf):
    return rounded(core_features(_colour_monthly(spark, sf), "ag"))


def dates_assembled(spark, sf):
    """lineitem with its date in three columns; every ninth order's day does not exist."""
    day = F.when(F.col("l_orderkey") % 9 == 0, 31).otherwise(F.dayofmonth("l_shipdate"))
    rows = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), day.alias("day"),
        F.col("l_quantity").alias("tmean"), *TIES,
    )
    return rounded(weather_readings(rows).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "year", "month", *TIES))


# --- fusion and checks --------------------------------------------------------------------------
def fusion_flat(spark, sf):
    return rounded(fusion_features(fusion_inputs(spark, sf)))


def input_checks(spark, sf):
    return with_reasons(fusion_inputs(spark, sf), INPUT_RULES).select(
        "o_orderkey", F.array_join("reasons", ",").alias("reasons")
    )


def prediction_checks(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        F.col("c_acctbal").alias("predicted_yield"),
        F.when(F.col("c_custkey") % 3 != 0, F.lit("t")).otherwise("").alias("unit"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("model_name"),
    )
    return with_reasons(predictions(rows), PREDICTION_RULES).select(
        "c_custkey", F.size("warnings").alias("n_warnings"), F.array_join("reasons", ",").alias("reasons")
    )


QUERIES = {
    f.__name__: f
    for f in (
        weather_monthly, weather_monthly_untied, dry_streak, dry_streak_dated, weather_limits,
        weather_own_climatology, weather_anomaly, weather_given_climatology, weather_climatology,
        weather_lags, daily_rows_kept, celsius_rows, day_measures, readings_of_headers,
        season_weather, season_weather_all_years, ndvi_statistics, ndvi_features, ndvi_rejected,
        ndvi_patches, patch_areas, patch_boundaries, index_levels_loaded, rgb_loaded, hsv_pixels,
        ag_statistics, ag_features, green_patches, grey_texture, grey_edges, scene_month_means,
        season_ndvi, season_ag, container_months, tensor_months, label_choice, label_anchors,
        label_rejects, label_usable, label_county_ids, label_in_counties, label_split_counts,
        label_paths_selected, label_path_fields, code_lookups, date_key_months, normalised_keys,
        joined_modalities, month_wide, month_keys_values, distinct_month_keys, anchor_records,
        core_weather, weather_records, container_features, label_features_mixed, record_lines, core_ndvi,
        core_ag, tiled_patch_areas, tiled_edges, tiled_boundaries, tiled_quantiles, dates_assembled,
        weather_climatology_merged, ag_limits, ndvi_limits, season_ndvi_patches, season_ag_patches, united_by_name, fusion_flat, input_checks, prediction_checks,
    )
}
