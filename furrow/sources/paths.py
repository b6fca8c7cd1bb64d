"""Label file paths and modality directories.

Three layouts are known: ``USDA/data/<year>/<crop>/<file>``, ``USDA Crop Dataset/<crop>/<year>/<file>``
and ``USDA/Crop Dataset/<crop>/<year>/<file>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.codes import (
    LABEL_FOLDERS,
    MODALITIES,
    canonical_crop,
    crop_aliases,
    crop_named,
    plain_key,
    states_of,
)
from furrow.functions.text import key_text

# --- fixed values: directory names --------------------------------------------------------------
SCENE_DIRECTORY = "Sentinel-2 Imagery/data/{folder}/{year}/{state}/*.{suffix}"
WEATHER_DIRECTORY = "WRF-HRRR Computed Dataset/data/{year}/{state}/*.csv"
LABEL_FILE = "USDA Crop Dataset/{folder}/{year}/USDA_{stem}_County_{year}.csv"
LABEL_FILES = "USDA Crop Dataset/*/*/USDA_*_County_*.csv"


def _path_parts(path: Column) -> tuple[Column, Column, Column]:
    """Year text, crop folder and file name of a label path; NULL year for other paths."""
    part = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    at = lambda i: F.get(part, F.lit(i))
    n = F.size(part)
    by_year = (n >= 4) & (at(0) == "USDA") & (at(1) == "data")
    by_crop = (n >= 4) & (at(0) == "USDA Crop Dataset")
    nested = (n >= 5) & (at(0) == "USDA") & (at(1) == "Crop Dataset")
    year = F.when(by_year, at(2)).when(by_crop, at(2)).when(nested, at(3))
    crop = F.when(by_year, at(3)).when(by_crop, at(1)).when(nested, at(2))
    return year, crop, F.element_at(part, -1)


def select_label_paths(paths: DataFrame, years: Sequence[int], crops: Sequence[str]) -> DataFrame:
    """Distinct label paths of the given years and crops, in order.

    A crop matches when one of its names is contained in the crop folder or the file name. In the
    year-first layout the part after the year counts as the folder, which may be the file itself.
    """
    year, folder, file = _path_parts(F.col("path"))
    names = sorted({plain_key(name) for crop in crops for name in crop_aliases(crop)})
    matches = F.lit(False)
    for name in names:
        matches = matches | key_text(folder).contains(name) | key_text(file).contains(name)
    wanted = year.isin([str(y) for y in years]) & matches
    return paths.filter(wanted).select("path").distinct().orderBy("path")


def with_label_path_fields(paths: DataFrame, on_unknown: str = "null") -> DataFrame:
    """Add ``year`` and canonical ``crop_type`` of a label path; NULL or an error for other paths."""
    year, folder, _ = _path_parts(F.col("path"))
    crop = canonical_crop(folder)
    number = year.try_cast("int")
    if on_unknown == "fail":
        known = number.isNotNull() & crop.isNotNull()
        message = F.concat(F.lit("not a label path: "), F.col("path"))
        number = F.when(known, number).otherwise(F.raise_error(message))
    return paths.withColumns({"year": number, "crop_type": crop})


def label_file_patterns(years: Sequence[int], crops: Sequence[str]) -> list[str]:
    """Label files of the given crops and years."""
    folders = [LABEL_FOLDERS[crop_named(c)] for c in crops]
    return [
        LABEL_FILE.format(folder=folder, stem=stem, year=year)
        for folder, stem in folders
        for year in years
    ]


def modality_patterns(
    modality: str, years: Sequence[int], fips_codes: Sequence[str], suffix: str = "h5"
) -> list[str]:
    """Directory patterns of a modality, one per year and state; none without county codes."""
    if modality not in MODALITIES:
        raise ValueError(f"unknown modality: {modality!r}")
    states = states_of(fips_codes)
    template = WEATHER_DIRECTORY if modality == "weather" else SCENE_DIRECTORY
    return [
        template.format(folder=modality.upper(), year=year, state=state, suffix=suffix)
        for year in years
        for state in states
    ]


def pruned(table: DataFrame, years: Sequence[int], fips_codes: Sequence[str]) -> DataFrame:
    """The same selection on a table partitioned by ``year`` and ``state_abbr``."""
    states = states_of(fips_codes)
    return table.filter(F.col("year").isin(list(years)) & F.col("state_abbr").isin(states))
