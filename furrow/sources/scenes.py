"""Scene tables from image files, stored scene containers and tensors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from furrow.functions.dates import month_of_date_key
from furrow.functions.text import fips_code
from furrow.operators.rasters import index_scenes, luma, rgb_scenes, settled


def read_images(spark: SparkSession, path: str, on_bad: str = "fail", seen: Observation | None = None) -> DataFrame:
    """Image files through Spark's ``image`` source.

    An unreadable file makes the job fail, or is left out with ``on_bad="drop"``. ``seen`` then counts ``images`` and ``unreadable``
    files in the same pass; :func:`unreadable_images` lists them.
    """
    if on_bad not in ("fail", "drop"):
        raise ValueError(f"on_bad must be 'fail' or 'drop', not {on_bad!r}")
    images = spark.read.format("image").load(path)
    readable = F.coalesce(F.col("image.height") > 0, F.lit(False))
    if seen is not None:
        images = images.observe(seen, F.count_if(readable).alias("images"), F.count_if(~readable).alias("unreadable"))
    broken = F.concat(F.lit("not a readable image: "), F.col("image.origin"))
    known = F.col("image.origin")
    if on_bad == "drop":
        images = images.filter(readable)
    else:
        known = F.when(readable, known).otherwise(F.raise_error(broken))
    images = images.select(
        known.alias("scene_id"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("levels"),
    )
    return images.mapInArrow(_unsigned, "scene_id string, height int, width int, channels int, levels array<short>")


def unreadable_images(spark: SparkSession, path: str) -> DataFrame:
    """Files that :func:`read_images` fails on or leaves out."""
    images = spark.read.format("image").load(path)
    return images.filter(F.coalesce(F.col("image.height"), F.lit(-1)) <= 0).select(F.col("image.origin").alias("file"))


def _unsigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turn the last column, binaries, into lists of their bytes."""
    for batch in batches:
        data = [np.frombuffer(v.as_buffer(), np.uint8).astype(np.int16) if v.is_valid else None for v in batch.columns[-1]]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(data, pa.list_(pa.int16()))], batch.schema.names)


def _cell(p: Column, band: int) -> Column:
    """Level of a colour band (0 red .. 2 blue); the stored order is blue, green, red, alpha."""
    offset = F.when(F.col("channels") == 1, F.lit(0)).otherwise(F.lit(2 - band))
    return F.get("levels", (p * F.col("channels") + offset).cast("int"))


def _over_pixels(images: DataFrame, value) -> DataFrame:
    last = (F.col("height") * F.col("width") - 1).cast("int")
    return settled(images, data=value(F.sequence(F.lit(0), last))).drop("levels", "channels")


def rgb_from_images(images: DataFrame) -> DataFrame:
    """RGB scenes of image files; grey images are repeated, alpha is dropped."""
    pixel = lambda p: F.array(*[_cell(p, k) for k in range(3)])
    return _over_pixels(images, lambda ps: F.flatten(F.transform(ps, pixel)))


def index_from_images(images: DataFrame) -> DataFrame:
    """Vegetation-index scenes of image files: grey level 0..255 stands for -1..1."""
    grey = lambda p: F.when(F.col("channels") == 1, _cell(p, 0)).otherwise(
        luma(_cell(p, 0), _cell(p, 1), _cell(p, 2))
    )
    return _over_pixels(
        images, lambda ps: F.transform(ps, lambda p: grey(p).cast("double") / 255.0 * 2.0 - 1.0)
    )


def read_container(spark: SparkSession, path: str) -> DataFrame:
    """A stored container with the ``file`` of every row."""
    return spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))


def container_scenes(container: DataFrame, modality: str, on_bad: str = "fail") -> DataFrame:
    """Scenes of a stored container: ``county_id``, ``date`` key, ``grid_index`` and pixels.

    ``file`` (where present; see :func:`read_container`) keeps grids of different files apart. Two rows of the same
    identity, in which missing parts count too, make the job fail. County filters on the result reach the
    scan. The crop is not known here; features are computed once per county and season.
    """
    identity = [c for c in ("file", "county_id", "date", "grid_index") if c in container.columns]
    scene_id = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in identity])
    # One value, from the identities alone; pixels are neither read for it nor joined with it.
    repeated = container.groupBy(scene_id.alias("id")).count().filter("count > 1").agg(F.min("id").alias("id")).scalar()
    message = F.concat(F.lit("repeated scene: "), repeated)
    year = (
        F.col("year").cast("int")
        if "year" in container.columns
        else F.substring(F.col("date").cast("string"), 1, 4).try_cast("int")
    )
    shape = [c for c in ("height", "width", "channels", "data") if c in container.columns]
    scenes = container.select(
        F.when(repeated.isNull(), scene_id).otherwise(F.raise_error(message)).alias("scene_id"),
        fips_code(F.col("county_id")).alias("county_id"),
        F.lit(None).cast("string").alias("crop_type"),
        year.alias("year"),
        month_of_date_key(F.col("date")).alias("month"),
        *shape,
    )
    return load_scenes(scenes, modality, on_bad)


def load_scenes(scenes: DataFrame, modality: str, on_bad: str = "fail") -> DataFrame:
    """Apply a modality's loading rules."""
    if modality == "ag":
        return rgb_scenes(scenes, on_bad)
    if modality == "ndvi":
        return index_scenes(scenes, on_bad)
    raise ValueError(f"scenes are ag or ndvi, not {modality!r}")


def tensor_scenes(tensors: DataFrame, modality: str, on_bad: str = "fail") -> DataFrame:
    """Scenes of ``tensor``, months of grids of ``struct<height,width[,channels],data>``.

    The first index is the month (from one), the second the grid. All other columns are kept;
    ``tensor_id`` must be unique.
    """
    kept = [c for c in tensors.columns if c != "tensor"]
    months = tensors.select(*kept, F.posexplode("tensor").alias("_month", "_grids"))
    grids = months.select(*kept, "_month", F.posexplode("_grids").alias("_grid", "_scene"))
    scenes = grids.select(
        F.concat_ws("|", F.col("tensor_id"), F.col("_month"), F.col("_grid")).alias("scene_id"),
        *[c for c in kept if c != "month"],
        (F.col("_month") + 1).alias("month"),
        "_scene.*",
    )
    return load_scenes(scenes, modality, on_bad)
