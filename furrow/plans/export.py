"""The export job: labels and raw modalities in, JSON-lines splits per modality out."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.codes import MODALITIES, fips_list
from furrow.functions.text import fips_code
from furrow.operators.assemble import (
    modality_features,
    modality_records,
    monthly_means,
)
from furrow.operators.joins import rows_of_keys
from furrow.operators.labels import anchors_of_cells, in_counties, rejected_cells, usable_anchors
from furrow.operators.scenes import colour_features, index_features
from furrow.operators.season import index_season, vegetation_season, weather_season
from furrow.operators.weather import SEASON_SCOPE, weather_features, weather_readings
from furrow.session import cut_lineage, tuned
from furrow.sources.paths import LABEL_FILES, pruned, select_label_paths
from furrow.sources.sinks import write_jsonl, write_jsonl_splits, write_manifest
from furrow.sources.tables import read_label_cells

SEASON = ("county_id", "year")
NO_MONTH, NO_PIXEL = "no month", "no valid pixel"


def season_of_scenes(per_scene: DataFrame, modality: str) -> tuple[DataFrame, DataFrame]:
    """Monthly means and season summary of scenes that are described already."""
    monthly = monthly_means(per_scene.drop("scene_id"))
    summary = vegetation_season(monthly) if modality == "ag" else index_season(monthly)
    return monthly, summary


def scene_season(scenes: DataFrame, modality: str) -> tuple[DataFrame, DataFrame]:
    """Monthly means and season summary of loaded scenes."""
    return season_of_scenes(colour_features(scenes) if modality == "ag" else index_features(scenes), modality)


def described_scenes(scenes: DataFrame, modality: str) -> DataFrame:
    """Features of every scene and the ``reason`` why a season can't use it, NULL if it can: both from one reading of its pixels."""
    per_scene = colour_features(scenes) if modality == "ag" else index_features(scenes, on_empty="keep")
    reason = F.when(F.col("month").isNull(), NO_MONTH)
    if modality == "ndvi":
        reason = reason.when(F.col("ndvi_mean").isNull(), NO_PIXEL)
    return per_scene.withColumn("reason", reason)


def weather_season_of(daily: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Monthly measures and season summary of daily rows, each county-year judged on its own."""
    monthly = weather_features(daily, scope=SEASON_SCOPE, **options)
    return monthly, weather_season(monthly)


def season_features(raw: DataFrame, modality: str, **options) -> DataFrame:
    """Feature map per county and year of one raw modality, or of scenes with a ``reason`` that are described already.

    Features describe the county, whatever crop a raw row names, so there is one summary per county and year.
    """
    described = "reason" in raw.columns
    if described:
        raw = raw.filter(F.col("reason").isNull()).drop("reason")
    raw = raw.withColumn("crop_type", F.lit(None).cast("string"))
    if "month" in raw.columns:
        raw = raw.filter(F.col("month").isNotNull())
    if modality == "weather":
        monthly, summary = weather_season_of(raw, **options)
    else:
        monthly, summary = season_of_scenes(raw, modality) if described else scene_season(raw, modality)
    return modality_features(monthly, summary, modality, SEASON)


def only_needed_seasons(raw: DataFrame, anchor_rows: DataFrame) -> DataFrame:
    """Raw rows of the county-years that have an anchor, where they are read and before anything is computed from them.

    With very many county-years a few others may be left; they find no anchor later.
    """
    seasons = anchor_rows.select(fips_code(F.col("county_id")).alias("county_id"), "year")
    return rows_of_keys(raw, seasons, {"county_id": "string", "year": "int"})


def only_needed_partitions(raw: DataFrame, years: Sequence[int], fips_codes: Sequence[str]) -> DataFrame:
    """The years and states of a job, where the raw table is laid out by them; these filters reach the scan."""
    return pruned(raw, years, fips_codes) if {"year", "state_abbr"} <= set(raw.columns) else raw


def record_table(anchor_rows: DataFrame, raw: DataFrame, modality: str, **options) -> DataFrame:
    """Anchor records with the features of one modality.

    Weather rows may hold their year in the date only; it is read before the seasons are chosen.
    """
    if modality not in MODALITIES:
        raise ValueError(f"unknown modality: {modality!r}")
    usable = usable_anchors(anchor_rows)
    if modality == "weather":
        raw = weather_readings(raw)
    needed = only_needed_seasons(raw, usable)
    return modality_records(usable, season_features(needed, modality, **options))


def write_rejects(labels: DataFrame, raw: Mapping[str, DataFrame], described: Mapping[str, DataFrame], path: str) -> dict[str, int]:
    """Write what the export leaves out, as JSON lines, and return the number of rows by kind and reason.

    Of ``raw`` scenes only ids and years are read, for those of no year; the others' reasons are known from describing them.
    """
    parts = [labels.select(F.lit("label").alias("kind"), F.concat_ws(" ", "source_path", "county_id").alias("source"), "reason")]
    for modality, scenes in described.items():
        undated = raw[modality].filter(F.col("year").isNull()).select("scene_id", F.lit(NO_MONTH).alias("reason"))
        left_out = scenes.filter(F.col("reason").isNotNull()).select("scene_id", "reason").unionByName(undated)
        parts.append(left_out.select(F.lit(modality).alias("kind"), F.col("scene_id").alias("source"), "reason"))
    rows = cut_lineage(reduce(DataFrame.unionByName, parts))
    write_jsonl(rows, path)
    counted = rows.groupBy("kind", "reason").count().orderBy("kind", "reason").collect()
    return {f"{r['kind']}: {r['reason']}": r["count"] for r in counted}


def label_paths(spark: SparkSession, root: str) -> DataFrame:
    """Label files below ``root`` as relative paths."""
    listing = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{LABEL_FILES}")
    start = F.lit("USDA Crop Dataset/")
    plain = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    return listing.select(F.concat(start, F.substring_index(plain, "USDA Crop Dataset/", -1)).alias("path"))


def run_export(
    spark: SparkSession,
    root: str,
    output: str,
    raw: Mapping[str, DataFrame],
    *,
    years: Sequence[int],
    crops: Sequence[str],
    fips_codes: Sequence[str],
    target_kind: str = "yield",
) -> dict[str, dict[str, int]]:
    """Export every modality in ``raw`` (loaded scenes, or daily weather rows).

    Label files are found below ``root``. Raw tables with ``year`` and ``state_abbr`` columns are read for the wanted
    years and states only, and pixels of needed scenes once. Writes ``<output>/<modality>/split=<split>``, ``<output>/rejects``
    (labels that are no number, needed scenes without a month, index scenes without a valid pixel, with reasons) and
    ``<output>/manifest``, which counts both, and returns the rows written per modality and split.

    The manifest says that an export is complete and is written last, and that it is not before anything is changed. After
    a crash the same call starts over, and what it writes replaces all that was left; see :func:`published_records`.
    """
    tuned(spark)
    wanted = fips_list(fips_codes)
    if not wanted:
        raise ValueError("at least one county code is needed")
    # The listing of label files: one per crop and year.
    paths = [r["path"] for r in select_label_paths(label_paths(spark, root), years, crops).collect()]
    if not paths:
        raise ValueError(f"no label files of these years and crops below {root}")
    cells = read_label_cells(spark, root, paths)
    # Decided once; the modalities start from these few columns.
    anchor_rows = cut_lineage(in_counties(anchors_of_cells(cells, target_kind), wanted).drop("features"))
    if anchor_rows.isEmpty():
        raise ValueError("no label rows of the requested counties")
    settings = {
        "root": root,
        "years": list(years),
        "crops": list(crops),
        "modalities": list(raw),
        "selected_fips": wanted,
    }
    counts_schema = "modality string, split string, rows long"
    write_manifest(spark.createDataFrame([], counts_schema), f"{output}/manifest", {**settings, "complete": False})
    raw = {modality: only_needed_partitions(df, years, wanted) for modality, df in raw.items()}
    usable = usable_anchors(anchor_rows)
    described = {
        modality: cut_lineage(described_scenes(only_needed_seasons(df, usable), modality))
        for modality, df in raw.items() if modality != "weather"
    }
    in_wanted = {m: in_counties(df, wanted) if "county_id" in df.columns else df for m, df in raw.items()}
    rejects = write_rejects(in_counties(rejected_cells(cells, target_kind), wanted), in_wanted, described, f"{output}/rejects")

    def records(modality: str) -> DataFrame:
        if modality in described:
            return modality_records(usable, season_features(described[modality], modality))
        return record_table(anchor_rows, raw[modality], modality)

    counts = {modality: write_jsonl_splits(records(modality), f"{output}/{modality}") for modality in raw}
    rows = [(m, s, n) for m, by_split in counts.items() for s, n in by_split.items()]
    table = spark.createDataFrame(rows, counts_schema)
    write_manifest(table, f"{output}/manifest", {**settings, "rejected": rejects, "complete": True})
    return counts


def published_records(spark: SparkSession, output: str, modality: str) -> DataFrame:
    """Lines of a complete export: split, value. Raises for an export that is unfinished, or lacks the modality."""
    try:
        held = spark.read.text(f"{output}/manifest", wholetext=True).first()
    except AnalysisException as missing:
        raise ValueError(f"no export at {output}") from missing
    manifest = json.loads(held["value"]) if held else {}
    if not manifest.get("complete") or modality not in manifest["modality_stats"]:
        raise ValueError(f"no complete export of {modality} at {output}")
    return spark.read.text(f"{output}/{modality}").select("split", "value")
