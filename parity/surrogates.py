"""The given tables seen as weather, labels, scenes and fusion inputs.

Every view keeps all rows of its table. ``parity/oracles.py`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import tuned

TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def weather_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as weather: 20 counties, some in Kelvin, some with monthly next to daily rows."""
    county = F.col("l_suppkey") % 20
    kelvin = F.when(county % 3 == 1, F.lit(273.15)).otherwise(F.lit(0.0))
    mean = F.col("l_quantity") - 10.0 + kelvin
    monthly = (county % 5 != 0) | (F.col("l_linestatus") == "F")
    return table(spark, sf_dir, "lineitem").select(
        F.lpad(county.cast("string"), 5, "0").alias("county_id"),
        F.lit("corn").alias("crop_type"),
        F.col("l_shipdate").alias("date"),
        F.when(monthly, "Monthly").otherwise(" daily ").alias("Daily/Monthly"),
        mean.alias("temp_mean"),
        (mean + 100.0 * F.col("l_discount")).alias("temp_max"),
        (mean - 100.0 * F.col("l_tax")).alias("temp_min"),
        F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") / 1000.0)
        .otherwise(0.0)
        .alias("precipitation"),
        F.when(F.col("l_linenumber") != 7, 40.0 + 7.0 * F.col("l_linenumber")).alias("humidity"),
        F.when(F.col("l_linenumber") != 6, 100.0 + F.col("l_quantity")).alias("solar_radiation"),
        (1.0 + F.col("l_linenumber")).alias("wind_speed"),
        *TIES,
    )


def weather_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a source file: text dates (some unreadable), other headers, no mean temperature."""
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, "n/a")
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
        .alias("Date"),
        F.lpad((F.col("l_suppkey") % 20).cast("string"), 5, "0").alias("county_id"),
        F.when(F.col("l_returnflag") != "A", F.col("l_quantity").cast("string")).alias("TMAX"),
        F.when(F.col("l_linestatus") != "F", F.col("l_quantity") - 5.0).alias(" Min Temperature (K) "),
        F.when(F.col("l_returnflag") == "R", F.lit(float("nan")))
        .otherwise(F.col("l_extendedprice"))
        .alias("rainfall"),
        F.col("l_tax").alias("RH"),
        *TIES,
    )


def climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as month baselines, one per month and priority (months repeat)."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.month("o_orderdate").alias("month"), "o_orderpriority")
        .agg(
            (F.avg("o_totalprice") / 10000.0).alias("weather_temperature_baseline"),
            (F.max("o_totalprice") / 1000.0).alias("weather_rainfall_baseline"),
        )
    )


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer and nation as label rows of one source file per nation."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    usable = F.col("c_acctbal") >= 0
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        (F.col("c_nationkey") % 9).alias("state_ansi"),
        (key % 999).cast("double").alias("county_ansi"),
        F.concat(F.lit(" "), F.col("n_name"), F.lit("  ")).alias("state_name"),
        F.when((F.col("c_mktsegment") != "BUILDING") & (F.col("c_nationkey") % 4 != 0), "County")
        .otherwise("STATE")
        .alias("agg_level_desc"),
        F.when(key % 3 == 0, "TOTAL").otherwise("NOT TOTAL").alias("domain_desc"),
        F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("source_path"),
        (2017 + F.col("c_nationkey") % 7).alias("year"),
        F.when(key % 11 == 0, "(D)")
        .when(usable, F.col("c_acctbal").cast("string"))
        .alias("YIELD, MEASURED IN BU / ACRE"),
        F.when(key % 2 == 0, F.col("c_mktsegment")).otherwise("  ").alias("segment"),
        F.when(key % 5 != 0, F.col("c_acctbal")).alias("balance"),
        "c_custkey",
    )


def _scene_keys(vec: Column) -> list[Column]:
    return [
        vec.cast("string").alias("scene_id"),
        F.lpad(F.col("label").cast("string"), 5, "0").alias("county_id"),
        F.lit(None).cast("string").alias("crop_type"),
        (2017 + vec % 3).cast("int").alias("year"),
        (vec % 12 + 1).cast("int").alias("month"),
        F.lit(SIDE).alias("height"),
        F.lit(SIDE).alias("width"),
    ]


def index_scene_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8x8 vegetation-index scenes: four times the value."""
    values = F.transform("embedding", lambda x: x.cast("double") * 4.0)
    return table(spark, sf_dir, "embeddings").select(
        *_scene_keys(F.col("vec_id")), values.alias("data")
    )


def tile_scene_table(spark: SparkSession, sf_dir: str, vectors: int = 256, width: int = 128) -> DataFrame:
    """embeddings as tiles: the values of 256 neighbours fill 128 rows of 128 pixels; the last tile may be lower."""
    tile = F.floor(F.col("vec_id") / vectors)
    part = F.struct("vec_id", F.transform("embedding", lambda x: x.cast("double") * 1.5).alias("v"))
    rows = table(spark, sf_dir, "embeddings").groupBy(tile.alias("tile")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    data = F.flatten(F.transform("parts", lambda p: p["v"]))
    height = F.floor(F.size(data) / width).cast("int")
    return rows.select(
        F.col("tile").cast("string").alias("scene_id"), F.lit("00001").alias("county_id"), F.lit(None).cast("string").alias("crop_type"),
        F.lit(2020).alias("year"), F.lit(1).alias("month"), height.alias("height"), F.lit(width).alias("width"),
        F.slice(data, F.lit(1), height * width).alias("data"),
    )


def tiled_scenes(spark: SparkSession, sf_dir: str, factor: float = 4.0) -> DataFrame:
    """embeddings as tiles of 8x8 pixels, sixteen to a scene of 32x32; the last scene may lack some."""
    vec = F.col("vec_id")
    values = F.transform("embedding", lambda x: x.cast("double") * factor)
    return table(spark, sf_dir, "embeddings").select(
        F.floor(vec / 16).cast("string").alias("scene_id"),
        (F.floor(vec % 16 / 4) * SIDE).cast("int").alias("top"),
        (vec % 4 * SIDE).cast("int").alias("left"),
        F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), values.alias("data"),
    )


def rgb_scene_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8x8 RGB scenes: three different roundings of each value."""
    level = lambda x, k: (F.floor(F.abs(x.cast("double")) * k).cast("int") % 256).cast("int")
    bands = F.transform(
        "embedding", lambda x: F.array(level(x, 700.0), level(x, 650.0), level(x, 410.0))
    )
    return table(spark, sf_dir, "embeddings").select(
        *_scene_keys(F.col("vec_id")), F.lit(3).alias("channels"), F.flatten(bands).alias("data")
    )


def fusion_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and customer as nested fusion records, some of them invalid."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    gap = lambda n, value: F.when(key % n != 0, value)
    crop = F.element_at(
        F.array(*map(F.lit, ("Rice", "soy-beans", "soybeans", "MAIZE", "", "Tomato ", "oats"))),
        (key % 7 + 1).cast("int"),
    )
    disease = F.concat(
        F.element_at(
            F.array(*map(F.lit, ("Healthy", "leaf_mild", "No-Disease", "severe ", "rust", "unhealthy"))),
            (key % 6 + 1).cast("int"),
        ),
        F.when(F.col("c_mktsegment") == "BUILDING", " moderate").otherwise(""),
    )
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.struct(
            gap(13, price / 10000.0).alias("temperature_mean"),
            gap(3, price / 20000.0).alias("temperature_min"),
            gap(4, price / 5000.0).alias("temperature_max"),
            F.col("c_acctbal").alias("rainfall_total"),
            gap(5, price / 4000.0).alias("humidity_mean"),
            gap(6, F.col("c_acctbal") + 100.0).alias("solar_radiation_mean"),
        ).alias("weather"),
        F.struct(
            crop.alias("crop_type"),
            gap(2, F.col("o_orderpriority")).alias("region"),
            (F.year("o_orderdate") - F.when(key % 17 == 0, 100).otherwise(0)).alias("year"),
            gap(8, (key % 40).cast("int") - 2).alias("planting_age_days"),
        ).alias("crop"),
        F.struct(
            disease.alias("disease_class"),
            (price / 480000.0).alias("health_score"),
            (price / 500000.0).alias("confidence"),
        ).alias("image_prediction"),
    )


def label_file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as label file paths in three layouts, and paths that are none."""
    key = F.col("o_orderkey")
    crop = F.element_at(
        F.array(*map(F.lit, ("Corn", "Soybeans", "WinterWheat", "Cotton", "Rye"))),
        (key % 5 + 1).cast("int"),
    )
    year = (F.year("o_orderdate") + 18).cast("string")
    file = F.concat(F.lit("/USDA_"), crop, F.lit("_County_"), year, F.lit(".csv"))
    return table(spark, sf_dir, "orders").select(
        F.when(key % 4 == 0, F.concat(F.lit("USDA Crop Dataset/"), crop, F.lit("/"), year, file))
        .when(key % 4 == 1, F.concat(F.lit("USDA/data/"), year, F.lit("/"), crop, file))
        .when(key % 4 == 2, F.concat(F.lit("USDA/Crop Dataset/"), crop, F.lit("/"), year, file))
        .otherwise(F.concat(F.lit("USDA/stats"), file))
        .alias("path")
    )
