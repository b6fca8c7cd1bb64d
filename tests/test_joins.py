"""Key filters, small sides, and that raw rows are not shuffled for either."""

import random
import re

import pytest
from pyspark.sql import functions as F

from furrow.operators import joins
from furrow.operators.labels import choose_label_rows
from furrow.operators.weather import in_celsius, prefer_daily_rows, weather_readings
from furrow.plans.export import record_table
from furrow.sources.scenes import container_scenes

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def threshold(spark):
    before = spark.conf.get(THRESHOLD)
    yield lambda value: spark.conf.set(THRESHOLD, str(value))
    spark.conf.set(THRESHOLD, before)


def shuffled_columns(df):
    """Column names that go into each shuffle of the plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = re.findall(r"^\(\d+\) Exchange.*\nInput \[\d+\]: \[(.*)\]", plan, re.M)
    return [re.sub(r"#\d+L?", "", columns).split(", ") for columns in nodes]


def scene_rows(spark, n=60):
    rng = random.Random(2)
    rows = [(str(i), f"{i % 9:05d}", 2018 + i % 3, 1 + i % 12, 2, 2, [rng.random() for _ in range(4)]) for i in range(n)]
    return spark.createDataFrame(rows, "scene_id string, county_id string, year int, month int, height int, width int, data array<double>")


def anchors_of(spark, seasons):
    rows = [(c, "corn", y, "train", "yield", 1.0 + i, "bu", f"p{i}") for i, (c, y) in enumerate(seasons)]
    return spark.createDataFrame(rows, "county_id string, crop_type string, year int, split string, target_kind string, target_value double, target_unit string, source_path string")


@pytest.mark.parametrize("limit", [10 << 20, -1])
def test_records_do_not_shuffle_pixels(spark, threshold, limit):
    threshold(limit)
    scenes, anchors = scene_rows(spark), anchors_of(spark, [("00001", 2019), ("2", 2018), ("00007", 2020), ("00031", 2019)])
    records = record_table(anchors, scenes, "ndvi")
    assert shuffled_columns(records)
    assert not any("data" in columns for columns in shuffled_columns(records))
    got = {(r["county_id"], r["year"]): r["features"]["ndvi_feature_rows"] for r in records.collect()}
    plain = scenes.groupBy("county_id", "year").agg(F.countDistinct("month").alias("n")).collect()
    have = {(r["county_id"], r["year"]) for r in plain}
    assert set(got) == have & {("00001", 2019), ("00002", 2018), ("00007", 2020), ("00031", 2019)} and got


def test_key_filter_keeps_every_key_and_few_others(spark, threshold):
    threshold(-1)
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("county_id"), (F.col("id") % 5).cast("int").alias("year"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1), ("7", None)], "county_id string, year int"))
    keys = spark.range(0, 20_000, 40).select(F.col("id").cast("string").alias("county_id"), (F.col("id") % 5).alias("year"))
    keys = keys.unionByName(spark.createDataFrame([(None, 1)], "county_id string, year long"))
    left = joins.rows_of_keys(rows, keys, {"county_id": "string", "year": "int"})
    got = {r["county_id"] for r in left.collect()}
    assert {str(i) for i in range(0, 20_000, 40)} <= got and len(got) < 500 + 0.02 * 20_000 and None not in got
    assert shuffled_columns(left) == []
    threshold(10 << 20)
    assert joins.rows_of_keys(rows, keys, {"county_id": "string", "year": "int"}).count() == 500
    none = keys.limit(0)
    assert joins.rows_of_keys(rows, none, {"county_id": "string", "year": "int"}).count() == 0
    threshold(-1)
    assert joins.rows_of_keys(rows, none, {"county_id": "string", "year": "int"}).count() == 0


def test_group_decisions_leave_rows_where_they_are(spark, threshold):
    days = [(f"{i % 4:05d}", f"2020-0{1 + i % 9}-11", "Daily" if i % 4 == 1 else "x", 290.0 if i % 4 == 2 else 20.0, 1.0) for i in range(80)]
    readings = weather_readings(spark.createDataFrame(days, "county_id string, date string, `Daily/Monthly` string, tmean double, rain double"))
    labels = spark.createDataFrame([("p", "COUNTY", "TOTAL", "1"), ("p", "STATE", "TOTAL", "2"), ("q", "STATE", "x", "3")], "source_path string, agg_level_desc string, domain_desc string, v string")
    makers = [lambda: prefer_daily_rows(readings), lambda: in_celsius(readings), lambda: choose_label_rows(labels, "v")]
    threshold(10 << 20)
    broadcast = [make() for make in makers]
    assert [shuffled_columns(df) for df in broadcast] == [[], [], []]
    threshold(-1)
    for make, df in zip(makers, broadcast):
        assert sorted(map(str, make().collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("text, size", [("10485760b", 10 << 20), ("10485760", 10 << 20), ("256k", 256 << 10), ("10MB", 10 << 20), ("-1", -1), ("1g", 1 << 30)])
def test_thresholds_may_have_units(spark, threshold, text, size):
    threshold(text)
    assert joins.broadcast_limit(spark.range(1)) == size


def test_container_identities_are_checked_apart_from_pixels(spark):
    rows = [("f", "1", "2019-05-01", i, 1, 2, [0.1 * i, 0.5]) for i in range(4)]
    schema = "file string, county_id string, date string, grid_index int, height int, width int, data array<double>"
    loaded = container_scenes(spark.createDataFrame(rows, schema), "ndvi")
    assert not any("data" in columns for columns in shuffled_columns(loaded))
    assert loaded.count() == 4 and loaded.select("scene_id").distinct().count() == 4
    with pytest.raises(Exception, match="repeated scene: f"):
        container_scenes(spark.createDataFrame([*rows, rows[0]], schema), "ndvi").select("scene_id").collect()
