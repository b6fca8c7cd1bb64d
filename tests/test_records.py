import io
import json
import struct
import zlib
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from furrow.operators.assemble import (
    combine_modalities,
    core_features,
    modality_features,
    modality_records,
    month_columns,
    month_map,
    monthly_means,
)
from furrow.operators.checks import (
    CROP_RULES,
    IMAGE_RULES,
    INPUT_RULES,
    PREDICTION_RULES,
    WEATHER_RULES,
    predictions,
    rejected_rows,
    valid_rows,
    with_reasons,
)
from furrow.operators.climatology import store_years, stored_climatology
from furrow.operators.fusion import fusion_features
from furrow.operators.weather import climatology_of
from furrow.plans import export
from furrow.plans.export import only_needed_partitions, published_records, record_table, run_export
from furrow.sources import tables
from furrow.sources.scenes import (
    container_scenes,
    index_from_images,
    read_container,
    read_images,
    rgb_from_images,
    tensor_scenes,
    unreadable_images,
)
from furrow.sources.sinks import record_json, write_jsonl, write_jsonl_splits
from furrow.sources.tables import read_county_weather, read_csv_by_name, read_weather

ANCHOR = {
    "split": "train", "county_id": "28151", "crop_type": "corn", "year": 2017, "target_kind": "yield",
    "target_value": 88.25, "target_unit": "BU / ACRE", "source_path": "p.csv", "state_ansi": "28",
    "county_ansi": "151", "state_name": "Mississippi", "county_name": "Washington",
}
KEYS = "county_id string, crop_type string, year int, month int"


def anchor_table(spark, *rows):
    schema = (
        "split string, county_id string, crop_type string, year int, target_kind string,"
        " target_value double, target_unit string, source_path string, state_ansi string,"
        " county_ansi string, state_name string, county_name string"
    )
    names = list(ANCHOR)
    return spark.createDataFrame([tuple({**ANCHOR, **r}[n] for n in names) for r in rows or [{}]], schema)


def lines(path):
    return [json.loads(t) for f in sorted(Path(path).glob("part-*")) for t in f.read_text("utf-8").splitlines()]


def test_monthly_means_keep_null_keys(spark):
    df = spark.createDataFrame(
        [("a", None, 2020, 1, 2, 1.0, "x"), ("a", None, 2020, 1, 4, None, "y"), (None, None, 2020, 1, 1, 5.0, "z")],
        KEYS + ", n int, v double, t string",
    )
    got = {r["county_id"]: r.asDict() for r in monthly_means(df).collect()}
    assert got["a"]["n"] == 3.0 and got["a"]["v"] == 1.0 and got[None]["v"] == 5.0
    assert "t" not in got["a"]
    assert monthly_means(df.drop("n", "v")).count() == 2
    assert monthly_means(df.select("n")).first()["county_id"] is None


def test_outer_join_with_null_and_missing_keys(spark):
    a = spark.createDataFrame([("1", None, 2020, 1, 1.0), ("2", "corn", 2020, 2, 2.0)], KEYS + ", a double")
    b = spark.createDataFrame([("1", 2020, 1, 10.0), ("3", 2020, 1, 30.0)], "county_id string, year long, month int, b double")
    c = spark.createDataFrame([("2", "corn", 2020, 2, 5.0), ("3", None, 2020, 1, 6.0)], KEYS + ", c double")
    got = {r["county_id"]: (r["crop_type"], r["a"], r["b"], r["c"]) for r in combine_modalities(a, b, c).collect()}
    assert got == {
        "1": (None, 1.0, 10.0, None), "2": ("corn", 2.0, None, 5.0), "3": (None, None, 30.0, 6.0),
    }


def test_month_map_and_columns(spark):
    df = spark.createDataFrame(
        [("1", None, 2020, 2, 1.0, None, 1), ("1", None, 2020, 2, 3.0, 4.0, 2), ("1", None, 2020, 11, float("nan"), 7.0, 1)],
        KEYS + ", a double, b double, seq int",
    )
    row = month_map(df.drop("seq"), "w").first()
    assert row["features"] == {
        "w_m02_a": 3.0, "w_m02_b": 4.0, "w_m11_a": None, "w_m11_b": 7.0, "w_month_count": 2.0,
        "w_observation_count": 3.0,
    }
    later = month_map(df, "w", order_by=["seq"]).first()["features"]
    assert later["w_m02_a"] == 3.0
    wide = month_columns(df, "w", ["a"]).first()
    assert wide["w_m02_a"] == 3.0 and wide["w_m01_a"] is None and wide["w_month_count"] == 2


def test_records_join_and_envelope(spark, tmp_path):
    rows = [{}, {"crop_type": "cotton", "state_name": None}, {"county_id": "9"}, {"split": "none"}, {"year": None}]
    monthly = spark.createDataFrame([("28151", None, 2017, 2, 0.5), ("00009", None, 2018, 1, 1.0)], KEYS + ", ndvi_x double")
    summary = spark.createDataFrame([("28151", None, 2017, None)], "county_id string, crop_type string, year int, ndvi_slope double")
    features = modality_features(monthly, summary, "ndvi")
    out = modality_records(anchor_table(spark, *rows), features)
    assert sorted(r["crop_type"] for r in out.collect()) == ["corn", "cotton"]
    got = {r["crop_type"]: r for r in (json.loads(x[0]) for x in out.select(record_json(out)).collect())}
    assert got["corn"]["features"] == {
        "ndvi_m02_ndvi_x": 0.5, "ndvi_month_count": 1.0, "ndvi_observation_count": 1.0, "ndvi_slope": None,
        "ndvi_available_months": 1.0, "ndvi_feature_rows": 1.0,
    }
    assert "state_name" not in got["cotton"] and got["corn"]["state_name"] == "Mississippi"


def test_core_features(spark):
    df = spark.createDataFrame([("1", None, 2020, 1, 0.5, 0.1)], KEYS + ", ndvi_mean double, ndvi_cv double")
    assert core_features(df, "ndvi").columns == ["county_id", "crop_type", "year", "month", "ndvi_mean"]
    with pytest.raises(ValueError):
        core_features(df, "x")


def fusion_input(spark, **change):
    row = {
        "tmean": 24.0, "tmin": 20.0, "tmax": None, "rain": 100.0, "hum": 70.0, "sol": None, "crop": "rice",
        "region": None, "year": 2024, "age": 30, "label": "healthy", "score": 0.9, "conf": 0.8, **change,
    }
    df = spark.createDataFrame(
        [tuple(row.values())],
        "tmean double, tmin double, tmax double, rain double, hum double, sol double, crop string,"
        " region string, year int, age int, label string, score double, conf double",
    )
    named = lambda **c: F.struct(*[F.col(v).alias(k) for k, v in c.items()])
    return df.select(
        named(
            temperature_mean="tmean", temperature_min="tmin", temperature_max="tmax", rainfall_total="rain",
            humidity_mean="hum", solar_radiation_mean="sol",
        ).alias("weather"),
        named(crop_type="crop", region="region", year="year", planting_age_days="age").alias("crop"),
        named(disease_class="label", health_score="score", confidence="conf").alias("image_prediction"),
    )


def test_fusion_features_omit_missing(spark):
    df = fusion_features(fusion_input(spark))
    got = json.loads(df.select(record_json(df)).first()[0])
    assert got["crop_type_encoded"] == 1 and got["disease_class_health_score"] == 1.0
    assert got["temperature_min"] == 20.0 and "temperature_max" not in got
    assert "solar_radiation_mean" not in got and "region" not in got


@pytest.mark.parametrize(
    ("change", "reasons"),
    [
        ({}, []),
        ({"score": 1.2}, ["image_prediction_health_score"]),
        ({"rain": -1.0, "age": -5}, ["weather_rainfall_total", "crop_planting_age_days"]),
        ({"tmean": None, "hum": None, "crop": ""}, ["weather_temperature_mean", "crop_crop_type"]),
        ({"year": 1899, "conf": float("nan")}, ["crop_year", "image_prediction_confidence"]),
    ],
)
def test_constraints(spark, change, reasons):
    df = fusion_input(spark, **change)
    assert with_reasons(df, INPUT_RULES).first()["reasons"] == reasons
    assert valid_rows(df, INPUT_RULES).count() == (not reasons)
    assert rejected_rows(df, INPUT_RULES).count() == bool(reasons)
    for part, rules in (("weather", WEATHER_RULES), ("crop", CROP_RULES), ("image_prediction", IMAGE_RULES)):
        mine = [r.removeprefix(f"{part}_") for r in reasons if r.startswith(part)]
        assert with_reasons(df.select(f"{part}.*"), rules).first()["reasons"] == mine


def test_prediction_defaults(spark):
    df = spark.createDataFrame([(1.0, "t", "m"), (-1.0, "", "m")], "predicted_yield double, unit string, model_name string")
    got = with_reasons(predictions(df), PREDICTION_RULES).collect()
    assert got[0]["warnings"] == [] and [r["reasons"] for r in got] == [[], ["predicted_yield", "unit"]]


def test_jsonl_and_empty_splits(spark, tmp_path):
    df = spark.createDataFrame(
        [("train", "Döner", float("inf"), {"a": float("nan"), "b": 1.0}, None)],
        "split string, t string, x double, m map<string,double>, target_kind string",
    )
    assert write_jsonl(df, str(tmp_path / "all")) == 1
    assert lines(tmp_path / "all") == [{"split": "train", "t": "Döner", "m": {"a": None, "b": 1.0}}]
    assert any("Döner" in f.read_text("utf-8") for f in (tmp_path / "all").glob("part-*"))
    counts = write_jsonl_splits(df.unionByName(df.withColumn("split", F.lit("x"))), str(tmp_path / "s"))
    assert counts == {"train": 1, "validation": 0, "test": 0}
    for split in counts:
        assert len(lines(tmp_path / "s" / f"split={split}")) == counts[split]
        assert (tmp_path / "s" / f"split={split}").is_dir()
    assert lines(tmp_path / "s" / "split=train")[0]["target_kind"] is None


def png(rows, bands):
    kind = {1: 0, 3: 2, 4: 6}[bands]
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    height, width = len(rows), len(rows[0]) // bands
    raw = b"".join(b"\0" + bytes(r) for r in rows)
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    )


def test_image_files(spark, tmp_path):
    (tmp_path / "rgb.png").write_bytes(png([[0, 10, 255, 13, 128, 200], [1, 2, 3, 4, 5, 6]], 3))
    (tmp_path / "grey.png").write_bytes(png([[0, 255, 10]], 1))
    (tmp_path / "alpha.png").write_bytes(png([[9, 8, 7, 255]], 4))
    images = read_images(spark, str(tmp_path))
    name = lambda r: r["scene_id"].rsplit("/", 1)[1]
    rgb = {name(r): list(r["data"]) for r in rgb_from_images(images).collect()}
    assert rgb == {
        "rgb.png": [0, 10, 255, 13, 128, 200, 1, 2, 3, 4, 5, 6],
        "grey.png": [0, 0, 0, 255, 255, 255, 10, 10, 10],
        "alpha.png": [9, 8, 7],
    }
    index = {name(r): list(r["data"]) for r in index_from_images(images).collect()}
    assert index["grey.png"] == pytest.approx([-1.0, 1.0, 10 / 255 * 2 - 1])
    assert index["alpha.png"] == pytest.approx([8 / 255 * 2 - 1])


def test_csv_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,FIPS Code,tmean\n2017-01-01,28151,280\n")
    (tmp_path / "b.csv").write_text("tmean,date,FIPS Code\n281,2017-01-02,22007\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv")]
    assert sorted((r["date"], r["tmean"]) for r in read_csv_by_name(spark, paths).collect()) == [
        ("2017-01-01", "280"), ("2017-01-02", "281"),
    ]
    assert read_county_weather(spark, paths, ["28151"]).first()["county_id"] == "28151"
    assert read_county_weather(spark, paths[:1], same_header=True).first()["county_id"] == "28151"
    with pytest.raises(Exception):
        read_weather(spark, *paths).collect()


def write_labels(root, crop="Corn", year=2017, header=None, rows=()):
    folder = root / "USDA Crop Dataset" / crop / str(year)
    folder.mkdir(parents=True)
    stem = {"Soybeans": "Soybean"}.get(crop, crop)
    (folder / f"USDA_{stem}_County_{year}.csv").write_text("\n".join([header, *rows]) + "\n")


WEATHER = (
    "date,FIPS Code,Daily/Monthly,Avg Temperature (K),Max Temperature (K),Min Temperature (K),"
    "Precipitation (kg m**-2),Relative Humidity (%),Wind Speed (m s**-1),"
    "Downward Shortwave Radiation Flux (W m**-2)\n"
    "2017-01-01,28151,Monthly,283.5,289.0,278.25,7.5,61.0,2.0,140.0\n"
    "2017-02-01,28151,Monthly,286.5,292.0,280.0,3.25,64.0,2.5,160.0\n"
    "2016-02-01,28151,Monthly,287.0,293.0,281.0,9.0,66.0,3.5,155.0\n"
)


def containers(spark):
    shape = "county_id string, date string, grid_index int, height int, width int, channels int, "
    ag = spark.createDataFrame(
        [("28151", "2017-02-01", i, 2, 2, 3, [v] * 12) for i, v in enumerate((40, 120))], shape + "data array<int>"
    )
    ndvi = spark.createDataFrame(
        [("28151", d, i, 2, 2, 1, [v] * 4) for i, (d, v) in enumerate((("2017-02-01", 0.1), ("2017-02-01", 0.5)))], shape + "data array<float>"
    )
    return ag, ndvi


def test_three_modalities_export(spark, tmp_path):
    y = '"YIELD, MEASURED IN BU / ACRE"'
    write_labels(
        tmp_path, "Corn", 2017, f"state_ansi,county_ansi,agg_level_desc,domain_desc,{y},note",
        ["28,151,COUNTY,TOTAL,88.25,a+b", "28,151,COUNTY,TOTAL,(D),", "28,5,COUNTY,TOTAL,100,", "28,,STATE,TOTAL,71.5,"],
    )
    write_labels(tmp_path, "Soybeans", 2017, f"county_ansi,state_ansi,{y}", ["151,28,33.75"])
    write_labels(tmp_path, "Cotton", 2017, "state_ansi,county_ansi", ["28,151"])
    (tmp_path / "w.csv").write_text(WEATHER)
    weather = read_county_weather(spark, [str(tmp_path / "w.csv")])
    ag, ndvi = containers(spark)
    odd = ndvi.limit(1).withColumns({"date": F.lit("2017 spring"), "grid_index": F.lit(7)})
    raw = {
        "ag": container_scenes(ag, "ag"), "ndvi": container_scenes(ndvi.unionByName(odd), "ndvi"), "weather": weather,
    }
    counts = run_export(
        spark, str(tmp_path), str(tmp_path / "out"), raw, years=[2017], crops=["corn", "soybeans"],
        fips_codes=["28151"],
    )
    assert counts == {m: {"train": 2, "validation": 0, "test": 0} for m in raw}
    got = {m: {r["crop_type"]: r for r in lines(tmp_path / "out" / m / "split=train")} for m in raw}
    corn = got["ag"]["corn"]
    assert corn["county_id"] == "28151" and corn["target_value"] == 88.25
    assert corn["source_path"] == "USDA Crop Dataset/Corn/2017/USDA_Corn_County_2017.csv"
    assert got["ag"]["soybeans"]["source_path"].endswith("USDA_Soybean_County_2017.csv")
    assert corn["features"]["ag_available_months"] == 1 and corn["features"]["ag_growth_slope"] == 0.0
    assert corn["features"]["ag_m02_ag_mean_brightness"] == pytest.approx(80 / 255)
    index = got["ndvi"]["corn"]["features"]
    assert index["ndvi_m02_ndvi_mean"] == pytest.approx(0.3) and index["ndvi_feature_rows"] == 1
    assert index["ndvi_stability_score"] is None
    rain = got["weather"]["corn"]["features"]
    assert rain["weather_available_months"] == 2 and "weather_m01_weather_gdd" in rain
    assert rain["weather_temperature_trend_slope"] == pytest.approx(3.0)
    assert rain["weather_m02_weather_rainfall_lag_1"] == 7.5
    manifest = lines(tmp_path / "out" / "manifest")[0]
    assert manifest["selected_fips"] == ["28151"]
    assert manifest["rejected"] == {"label: not numeric": 1, "ndvi: no month": 1}
    rejects = lines(tmp_path / "out" / "rejects")
    assert [r["source"] for r in rejects if r["kind"] == "label"] == ["USDA Crop Dataset/Corn/2017/USDA_Corn_County_2017.csv 28151"]
    assert manifest["modality_stats"]["ag"] == {"split_counts": {"test": 0, "train": 2, "validation": 0}, "rows_written": 2}


def test_a_crashed_export_is_not_published_and_starts_over(spark, tmp_path, monkeypatch):
    y = '"YIELD, MEASURED IN BU / ACRE"'
    write_labels(tmp_path, "Corn", 2017, f"state_ansi,county_ansi,{y}", ["28,151,88.25"])
    _, ndvi = containers(spark)
    bare = ndvi.limit(1).withColumns({"grid_index": F.lit(9), "data": F.transform("data", lambda v: v * 0 + F.lit(-0.9))})
    elsewhere = bare.withColumns({"county_id": F.lit("01001").cast(ndvi.schema["county_id"].dataType), "grid_index": F.lit(3)})
    (tmp_path / "w.csv").write_text(WEATHER)
    raw = {
        "ndvi": container_scenes(ndvi.unionByName(bare).unionByName(elsewhere), "ndvi"),
        "weather": read_county_weather(spark, [str(tmp_path / "w.csv")]),
    }
    out = str(tmp_path / "out")
    run = lambda: run_export(spark, str(tmp_path), out, raw, years=[2017], crops=["corn"], fips_codes=["28151"])
    with pytest.raises(ValueError, match="no export"):
        published_records(spark, out, "ndvi")
    first = run()
    whole, kept = published_records(spark, out, "ndvi").collect(), export.write_jsonl_splits

    def killed(df, path, *args):
        if path.endswith("weather"):
            raise KeyboardInterrupt
        return kept(df, path, *args)

    monkeypatch.setattr(export, "write_jsonl_splits", killed)
    with pytest.raises(KeyboardInterrupt):
        run()
    for modality in raw:
        with pytest.raises(ValueError, match="no complete export"):
            published_records(spark, out, modality)
    monkeypatch.setattr(export, "write_jsonl_splits", kept)
    assert run() == first
    assert published_records(spark, out, "ndvi").collect() == whole and published_records(spark, out, "weather").count() == 1
    rejected = [json.loads(line) for p in Path(out, "rejects").glob("part-*") for line in p.read_text().splitlines()]
    assert [(r["kind"], r["reason"], r["source"].rsplit("|", 1)[1]) for r in rejected] == [("ndvi", "no valid pixel", "9")]


def test_export_reads_wanted_partitions_only(spark, tmp_path):
    _, ndvi = containers(spark)
    stored = ndvi.withColumn("year", F.lit(2017)).crossJoin(spark.createDataFrame([("MS",), ("LA",)], "state_abbr string"))
    stored.write.partitionBy("year", "state_abbr").parquet(str(tmp_path / "ndvi"))
    table = only_needed_partitions(read_container(spark, str(tmp_path / "ndvi")), [2017, 2018], ["28151"])
    scenes = container_scenes(table, "ndvi")
    plan = scenes._jdf.queryExecution().executedPlan().toString()
    scans = plan.split("PartitionFilters: ")[1:]
    assert scans and all("year" in s.split("PushedFilters")[0] and "state_abbr" in s.split("PushedFilters")[0] for s in scans)
    assert scenes.count() == 2
    weather = spark.createDataFrame([("28151",)], "county_id string")
    assert only_needed_partitions(weather, [2017], ["28151"]) is weather


def test_one_record_per_anchor_whatever_the_raw_crops(spark):
    rows = [("28151", crop, f"2017-{m:02d}-{d:02d}", 10.0 + d, 1.0 * m) for crop in ("corn", "wheat") for m in (4, 5) for d in (1, 2)]
    raw = spark.createDataFrame(rows, "county_id string, crop_type string, date string, tmean double, prcp double")
    got = record_table(anchor_table(spark, {}, {"crop_type": "cotton"}), raw, "weather").collect()
    assert sorted(r["crop_type"] for r in got) == ["corn", "cotton"]
    assert all(r["features"]["weather_feature_rows"] == 2 and r["features"]["weather_m05_weather_total_precipitation"] == 20.0 for r in got)


def test_repeated_scenes_fail(spark):
    _, ndvi = containers(spark)
    both = ndvi.unionByName(ndvi)
    with pytest.raises(Exception, match="repeated scene"):
        container_scenes(both, "ndvi").collect()
    apart = ndvi.withColumn("file", F.lit("a")).unionByName(ndvi.withColumn("file", F.lit("b")))
    assert container_scenes(apart, "ndvi").select("scene_id").distinct().count() == 4


def test_unreadable_images_fail_and_are_listed(spark, tmp_path):
    (tmp_path / "good.png").write_bytes(png([[0, 255, 10]], 1))
    (tmp_path / "bad.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="not a readable image"):
        read_images(spark, str(tmp_path)).collect()
    assert [r["file"].rsplit("/", 1)[1] for r in unreadable_images(spark, str(tmp_path)).collect()] == ["bad.png"]


def test_tensor_months(spark):
    df = spark.createDataFrame(
        [("t", "28151", None, 2017, [[(1, 2, [0.1, 0.2])], [(1, 2, [0.3, 0.4]), (1, 1, [0.6])]])],
        "tensor_id string, county_id string, crop_type string, year int,"
        " tensor array<array<struct<height int, width int, data array<double>>>>",
    )
    scenes = tensor_scenes(df, "ndvi")
    assert sorted((r["scene_id"], r["month"], tuple(r["data"])) for r in scenes.collect()) == [
        ("t|0|0", 1, (0.1, 0.2)), ("t|1|0", 2, (0.3, 0.4)), ("t|1|1", 2, (0.6,)),
    ]
    out = record_table(anchor_table(spark), scenes, "ndvi").first()
    assert out["features"]["ndvi_m02_ndvi_mean"] == pytest.approx(0.475)
    assert out["features"]["ndvi_available_months"] == 2


def test_headers_read_no_further_than_needed(spark, tmp_path):
    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            self.taken += n
            return super().read(n)

    big = Counted(b"\xef\xbb\xbfdate,tmean\r\n" + b"2017-01-01,1\n" * 1_000_000)
    assert tables.first_line(big) == "date,tmean" and big.taken <= tables.HEADER_BYTES
    wide = Counted(b"x" * 200_000 + b",y\n1\n")
    assert tables.first_line(wide) == "x" * 200_000 + ",y"
    assert tables.first_line(io.BytesIO(b"")) == "" and tables.first_line(io.BytesIO(b"only")) == "only"
    (tmp_path / "a b+%.csv").write_text("date,n\n2017-01-01,1\n")
    (tmp_path / "c.csv").write_text("n,date\n2,2017-01-02\n")
    got = {r["file"].rsplit("/", 1)[1]: r["header"] for r in tables.file_headers(spark, [str(tmp_path)]).collect()}
    assert sorted(got.values()) == ["date,n", "n,date"]
    scanned = {r["file"].rsplit("/", 1)[1]: r["header"] for r in tables._scanned_headers(spark, [str(tmp_path)]).collect()}
    assert scanned == got
    assert sorted(map(tuple, read_csv_by_name(spark, [str(tmp_path)]).select("date", "n").collect())) == [("2017-01-01", "1"), ("2017-01-02", "2")]


def test_one_scan_for_all_headers(spark, tmp_path):
    for i in range(6):
        names = ["date", "tmean", f"extra {i}"][:: 1 if i % 2 else -1]
        cells = {"date": f"2017-01-0{i + 1}", "tmean": str(i), f"extra {i}": '"a, b"'}
        (tmp_path / f"{i}.csv").write_text(",".join(names) + "\n" + ",".join(cells[n] for n in names) + "\n" + cells[names[0]] + "\n")
    out = read_csv_by_name(spark, [str(tmp_path)])
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    rows = out.collect()
    assert len(rows) == 12 and len(out.columns) == 8
    assert {r["date"]: r["tmean"] for r in rows if r["date"] and r["tmean"]} == {f"2017-01-0{i + 1}": str(i) for i in range(6)}
    assert [r["extra 3"] for r in rows if r["date"] == "2017-01-04" and r["tmean"]] == ["a, b"]


def test_images_left_out_are_counted_in_the_same_pass(spark, tmp_path):
    (tmp_path / "good.png").write_bytes(png([[0, 255, 10]], 1))
    (tmp_path / "bad.png").write_bytes(b"no image")
    seen = Observation()
    rows = read_images(spark, str(tmp_path), on_bad="drop", seen=seen).collect()
    assert [r["scene_id"].rsplit("/", 1)[1] for r in rows] == ["good.png"]
    assert seen.get == {"images": 1, "unreadable": 1}
    with pytest.raises(ValueError):
        read_images(spark, str(tmp_path), on_bad="skip")


def test_climatology_grows_by_years(spark, tmp_path):
    rows = [(y, m, 1.5 * y % 7 + m, float(y % 5) if m != 3 or y % 2 else None) for y in range(2000, 2006) for m in (1, 3, 7)]
    monthly = spark.createDataFrame(rows, "year int, month int, weather_temp_mean double, weather_total_precipitation double")
    path = str(tmp_path / "state")
    store_years(monthly.filter("year < 2004"), path)
    store_years(monthly.filter("year = 2004").withColumn("weather_temp_mean", F.lit(99.0)), path)
    for year in (2004, 2005):
        store_years(monthly.filter(F.col("year") == year), path)
    want = {r["month"]: tuple(r)[1:] for r in climatology_of(monthly).collect()}
    got = {r["month"]: tuple(r)[1:] for r in stored_climatology(spark, path).collect()}
    assert got.keys() == want.keys() and all(got[m] == pytest.approx(want[m]) for m in want)
