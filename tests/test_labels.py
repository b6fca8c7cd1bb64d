import pytest
from pyspark.sql import functions as F

from furrow.functions.codes import (
    canonical_crop,
    crop_code,
    crop_named,
    fips_list,
    health_score,
    label_column,
    label_unit,
    split_of_year,
    state_abbr,
    states_of,
)
from furrow.functions.dates import month_of_date_key
from furrow.functions.text import key_text, numeric_code, strip, zero_pad
from furrow.operators.labels import (
    anchors,
    anchors_of_cells,
    choose_label_rows,
    county_id_of,
    county_ids,
    in_counties,
    rejected_cells,
    rejected_labels,
    split_counts,
    usable_anchors,
)
from furrow.sources.paths import (
    label_file_patterns,
    modality_patterns,
    pruned,
    select_label_paths,
    with_label_path_fields,
)

from furrow.sources.tables import read_label_cells

YIELD = "YIELD, MEASURED IN BU / ACRE"
PATH = "USDA/data/2017/Corn/USDA_Corn_County_2017.csv"


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, c {kind}")
    return [r["x"] for r in df.select("i", column(F.col("c")).alias("x")).orderBy("i").collect()]


def label_rows(spark):
    """A county row with a total, the same county by practice, and a state row."""
    return spark.createDataFrame(
        [
            (28, 151, "Mississippi", "Washington", "County", "Total", "Census", 88.25, "\tlate frost ", 41),
            (28, 151, "Mississippi", "Washington", "County", "Irrigated", "Census", 97.0, "other practice", 12),
            (28, None, "Mississippi", None, "State", "Total", "Census", 71.5, "whole state", 5),
        ],
        f"state_ansi int, county_ansi int, state_name string, county_name string, agg_level_desc string,"
        f" domain_desc string, source_desc string, `{YIELD}` double, remark string, reports int",
    )


def test_anchor_of_a_county_row(spark):
    out = anchors(
        label_rows(spark), crop_type="corn", target_kind="yield", year=2019, split="train", source_path=PATH
    ).collect()
    assert len(out) == 1
    row = out[0].asDict(recursive=True)
    assert (row["county_id"], row["state_ansi"], row["county_ansi"]) == ("28151", "28", "151")
    assert row["target_value"] == 88.25 and row["target_unit"] == "BU / ACRE"
    assert (row["split"], row["year"], row["source_path"], row["source_desc"]) == ("train", 2019, PATH, "Census")
    assert row["features"] == {"remark": "late frost", "reports": 41}


def test_features_absent_when_all_missing(spark):
    df = label_rows(spark).withColumns({"remark": F.lit("  "), "reports": F.lit(None).cast("int")})
    row = anchors(df, crop_type="Corn", target_kind="yield", year=2021, source_path="p").first()
    assert row["features"] is None and row["split"] == "validation"


def write_label_file(root, crop, year, header, *rows):
    folder = root / "USDA Crop Dataset" / crop / str(year)
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"USDA_{crop}_County_{year}.csv"
    path.write_text("\n".join([header, *rows]) + "\n")
    return str(path.relative_to(root))


@pytest.mark.parametrize("turn", [1, -1])
def test_label_files_with_mixed_values(spark, tmp_path, turn):
    """Whole numbers in one file, decimals and text in others; two crops share a column with other kinds of values."""
    root = tmp_path / "a b+c"
    root.mkdir()
    paths = [
        write_label_file(root, "Corn", 2017, f'state_ansi,county_ansi,"{YIELD}",extra', "1,3,162,5", "1,5,(D),7"),
        write_label_file(root, "Corn", 2018, f'state_ansi,county_ansi,"{YIELD}",extra', "1,3,170.5,2.5", "1,5,171,"),
        write_label_file(root, "Soybeans", 2018, f'extra,county_ansi,state_ansi,"{YIELD}"', "abc,7,2,40", "007,9,2,41.25"),
    ]
    cells = read_label_cells(spark, str(root), paths[::turn])
    found = anchors_of_cells(cells, "yield").select("crop_type", "year", "county_id", "target_value", F.to_json(F.struct("features")))
    assert sorted(map(tuple, found.collect())) == [
        ("corn", 2017, "01003", 162.0, '{"features":{"extra":5}}'),
        ("corn", 2018, "01003", 170.5, '{"features":{"extra":2.5}}'),
        ("corn", 2018, "01005", 171.0, "{}"),
        ("soybeans", 2018, "02007", 40.0, '{"features":{"extra":"abc"}}'),
        ("soybeans", 2018, "02009", 41.25, '{"features":{"extra":7}}'),
    ]
    rejected = rejected_cells(cells, "yield").collect()
    assert [tuple(r) for r in rejected] == [(paths[0], "01005", "(D)", "not numeric")]
    assert {r["source_path"] for r in cells.collect()} == set(paths)
    bad = write_label_file(root, "Cotton", 2018, "state_ansi,county_ansi", "1,3")
    with pytest.raises(Exception, match="label column is missing"):
        anchors_of_cells(read_label_cells(spark, str(root), [*paths, bad]), "yield").collect()


def test_bad_targets_are_rejected_or_fail(spark):
    df = spark.createDataFrame(
        [("1", "3", "1.5", "a"), ("1", "4", "(D)", "a"), ("1", "5", "inf", "a"), ("1", "6", " ", "a"), ("1", "7", None, "a")],
        f"state_ansi string, county_ansi string, `{YIELD}` string, source_path string",
    ).withColumn("year", F.lit(2017))
    kept = anchors(df, crop_type="corn", target_kind="yield").collect()
    assert [r["county_id"] for r in kept] == ["01003"]
    reasons = {r["county_ansi"]: r["reason"] for r in rejected_labels(df, YIELD).collect()}
    assert reasons == {"4": "not numeric", "5": "not finite", "6": "missing"}
    with pytest.raises(Exception, match="label"):
        anchors(df, crop_type="corn", target_kind="yield", on_bad_target="fail").collect()


def test_label_choice_per_source(spark):
    rows = [
        ("a", 1.0, "County", "TOTAL", 1), ("a", 2.0, "COUNTY", "x", 2), ("a", 3.0, "STATE", "TOTAL", 3),
        ("a", float("nan"), "COUNTY", "TOTAL", 4),
        ("b", 1.0, "COUNTY", "x", 5), ("b", 1.0, "STATE", "TOTAL", 6),
        ("c", 1.0, "STATE", "TOTAL", 7), ("c", None, "COUNTY", "TOTAL", 8), ("c", 1.0, None, "y", 9),
        (None, 1.0, None, None, 10),
    ]
    df = spark.createDataFrame(
        rows, "source_path string, t double, agg_level_desc string, domain_desc string, i int"
    )
    got = choose_label_rows(df, "t")
    assert sorted(r["i"] for r in got.collect()) == [1, 5, 7, 10]
    plain = choose_label_rows(df.drop("agg_level_desc", "domain_desc"), "t")
    assert plain.count() == 8
    with pytest.raises(ValueError):
        choose_label_rows(df, "u")


def test_county_ids(spark):
    df = spark.createDataFrame(
        [(" 1003 ", "1", "3"), (None, "1", "3.0"), ("", "01", ""), (None, None, None), ("123456", "1", "1"), (None, "x", "1e1")],
        "county_id string, state_ansi string, county_ansi string",
    )
    got = [r[0] for r in df.select(county_id_of(df.columns)).collect()]
    assert got == ["01003", "01003", "01", "", "123456", "0x010"]
    assert [r[0] for r in county_ids(df).collect()] == ["01003", "123456"]
    assert in_counties(df, ["1003"]).count() == 1
    with pytest.raises(ValueError):
        in_counties(df, [" "])


def test_split_counts_include_empty_splits(spark):
    df = spark.createDataFrame([("train",), ("train",), ("other",), ("test",)], "split string")
    assert {r["split"]: r["rows"] for r in split_counts(df).collect()} == {
        "train": 2, "validation": 0, "test": 1,
    }
    full = df.withColumns({"county_id": F.lit("1"), "crop_type": F.lit("corn"), "year": F.lit(2017)})
    assert usable_anchors(full).count() == 3


def test_text_functions(spark):
    assert values(spark, strip, ["\t a b\n", " x ", ""]) == ["a b", "x", ""]
    assert values(spark, key_text, [" Winter_Wheat ", "Maïs 2"]) == ["winterwheat", "maïs2"]
    assert values(spark, lambda c: zero_pad(c, 3), ["1", "1234", "-1", "", None]) == ["001", "1234", "-01", "000", None]
    assert values(spark, lambda c: numeric_code(c, 3), ["1", "2.9", " 3 ", "ab", "", None, "nan"]) == [
        "001", "002", "003", "0ab", "", "", "nan",
    ]
    assert values(spark, lambda c: numeric_code(c, 2), [1.0, float("nan")], "double") == ["01", "NaN"]


def test_code_tables(spark):
    assert values(spark, state_abbr, ["22", "1", "03"]) == ["LA", "AL", None]
    assert values(spark, canonical_crop, ["Winter_Wheat", "soybean", "CORN", "rye"]) == [
        "winter wheat", "soybeans", "corn", None,
    ]
    assert values(spark, lambda c: label_unit(c, "production"), ["cotton"]) == ["480 LB BALES"]
    assert values(spark, lambda c: label_column(c, "yield"), ["cotton"]) == ["YIELD, MEASURED IN LB / ACRE"]
    assert values(spark, split_of_year, [2017, 2020, 2021, 2022, 2016], "int") == [
        "train", "train", "validation", "test", None,
    ]
    assert states_of(["22007", "1003", "01005"]) == ["AL", "LA"] and crop_named("Winter_Wheat") == "winter wheat"
    assert fips_list(["1003", " 22007", "", "1003"]) == ["01003", "22007"]
    for wrong in (lambda: states_of(["03001"]), lambda: crop_named("rye")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(Exception, match="unknown crop"):
        values(spark, lambda c: canonical_crop(c, "fail"), ["rye"])


def test_model_codes(spark):
    labels = ["healthy", "No-Disease", "leaf_mild", "moderate", "SEVERE rust", "critical", "rust", "unhealthy", " ", None]
    assert values(spark, health_score, labels) == [1.0, 1.0, 0.75, 0.5, 0.25, 0.1, 0.5, 1.0, None, None]
    crops = ["rice", "Maize", "corn", "wheat", "soybeans", "cassava", "potato", "tomato", "barley", ""]
    assert values(spark, crop_code, crops) == [1, 2, 2, 3, 4, 5, 6, 7, 0, None]
    for function in (health_score, crop_code):
        with pytest.raises(Exception, match="must not be empty"):
            values(spark, lambda c: function(c, "fail"), [" "])


def test_month_of_date_key(spark):
    keys = ["2017-02-01", "2017-11", "03", "03-15", "20170201", "x", None, "2017-xx-01"]
    assert values(spark, month_of_date_key, keys) == [2, 11, 3, 3, 20, None, None, None]


def test_label_paths(spark):
    folder = "USDA Crop Dataset"
    cotton, wheat = f"{folder}/Cotton/2019/USDA_Cotton_County_2019.csv", f"{folder}/WinterWheat/2020/USDA_WinterWheat_County_2020.csv"
    moved, plain = "USDA/Crop Dataset/Cotton/2018/any name.csv", "USDA/data/2020/any/USDA_Cotton.csv"
    others = [f"{folder}/Corn/2019/USDA_Corn_County_2019.csv", "USDA/stats/cotton.csv", "notes.txt"]
    df = spark.createDataFrame([(p,) for p in (wheat, cotton, *others, moved, cotton, plain)], "path string")
    got = [r["path"] for r in select_label_paths(df, [2018, 2019, 2020], ["cotton"]).collect()]
    assert sorted(got) == sorted([cotton, moved, plain])
    fields = {r["path"]: (r["year"], r["crop_type"]) for r in with_label_path_fields(df).collect()}
    assert fields[wheat] == (2020, "winter wheat") and fields[moved] == (2018, "cotton")
    assert fields["notes.txt"] == (None, None)
    with pytest.raises(Exception, match="not a label path"):
        with_label_path_fields(df, "fail").collect()


def test_patterns_and_pruning(spark):
    iowa, ohio = "19", "39"
    got = modality_patterns("ag", [2019, 2020], [f"{ohio}049", f"{iowa}113", f"{ohio}061"])
    assert got == [f"Sentinel-2 Imagery/data/AG/{y}/{s}/*.h5" for y in (2019, 2020) for s in ("IA", "OH")]
    assert modality_patterns("weather", [2020], [f"{iowa}113"]) == ["WRF-HRRR Computed Dataset/data/2020/IA/*.csv"]
    assert modality_patterns("ndvi", [2020], []) == []
    assert label_file_patterns([2018], ["cotton"]) == ["USDA Crop Dataset/Cotton/2018/USDA_Cotton_County_2018.csv"]
    with pytest.raises(ValueError):
        modality_patterns("x", [2019], [f"{iowa}113"])
    df = spark.createDataFrame([(2019, "IA"), (2020, "IA"), (2019, "OH")], "year int, state_abbr string")
    assert pruned(df, [2019], [f"{iowa}113"]).count() == 1
