"""Connected patches (8-neighbourhood) and boundaries of pixel masks.

A *mask table* has one row per scene with at least one true pixel: ``scene_id``, ``height``, ``width``
and ``cells``, the sorted positions of the true pixels. Scenes without a true pixel have no row.

True pixels are first merged to horizontal runs and contacts between runs of neighbouring lines, all
inside the scene's row. Patches are then put together from the contacts, a batch of scenes at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.numeric import flag
from furrow.operators.rasters import settled


def mask_of_pixels(pixels: DataFrame, condition: Column) -> DataFrame:
    """Mask table of the exploded pixels (position ``p``) that meet a condition.

    A scene's positions come from its one row, so the list is never longer than that row's data. The
    condition is not a filter: as one it would be pushed below the projections it builds on and
    repeat each of them at every mention.
    """
    cells = F.collect_list(F.when(flag(condition), F.col("p")))
    return (
        pixels.groupBy("scene_id", "height", "width")
        .agg(F.sort_array(cells).alias("cells"))
        .filter(F.size("cells") > 0)
    )


def mask_above(scenes: DataFrame, threshold: float) -> DataFrame:
    """Mask table of the pixels above a threshold, inside each row; NULL and NaN are not above."""
    last = (F.col("height") * F.col("width") - 1).cast("int")
    value = lambda p: F.get("data", p)
    cells = F.filter(
        F.sequence(F.lit(0), last), lambda p: (value(p) > threshold) & ~F.isnan(value(p))
    )
    return settled(scenes.select("scene_id", "height", "width", "data"), cells=cells).filter(
        F.size("cells") > 0
    ).drop("data")


def _with_runs(masks: DataFrame) -> DataFrame:
    """Add ``runs`` and ``owner``: per pixel the start of its run, -1 outside the mask."""
    cells, width = F.col("cells"), F.col("width")
    at = lambda i: F.get("cells", i)
    starts = F.filter(
        cells, lambda p, i: (i == 0) | (at(i - 1) != p - 1) | (p % width == 0)
    )
    ends = F.filter(
        cells, lambda p, i: (i == F.size(cells) - 1) | (at(i + 1) != p + 1) | ((p + 1) % width == 0)
    )
    runs = settled(settled(masks, _first=starts, _last=ends), runs=F.arrays_zip("_first", "_last"))
    before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get("_last", k - 1))
    piece = lambda run, k: F.concat(
        F.array_repeat(F.lit(-1), run["_first"] - before(k) - 1),
        F.array_repeat(run["_first"], run["_last"] - run["_first"] + 1),
    )
    rest = F.col("height") * F.col("width") - F.element_at("_last", -1) - 1
    owner = F.flatten(
        F.concat(
            F.transform("runs", piece), F.array(F.array_repeat(F.lit(-1), rest.cast("int")))
        )
    )
    return settled(runs, owner=owner).drop("_first", "_last")


def _contacts() -> Column:
    """Pairs of touching runs, ``a`` one line below ``b``, each pair once.

    The runs that touch a run from below are the distinct owners under it, one pixel wider on both
    sides as far as the line goes.
    """
    width = F.col("width")

    def of_run(run: Column) -> Column:
        left = F.when(run["_first"] % width > 0, run["_first"] - 1).otherwise(run["_first"])
        right = F.when((run["_last"] + 1) % width > 0, run["_last"] + 1).otherwise(run["_last"])
        under = F.slice("owner", left + width + 1, right - left + 1)
        touching = F.array_except(under, F.array(F.lit(-1)))
        return F.transform(
            touching, lambda t: F.struct(t.alias("a"), run["_first"].alias("b"))
        )

    return F.flatten(F.transform("runs", of_run))


def _boundary() -> Column:
    """Number of true pixels with a false or outside pixel among their eight neighbours."""
    width = F.col("width")
    inside = lambda at: F.coalesce(F.get("owner", at), F.lit(-1)) >= 0

    def on_edge(p: Column) -> Column:
        inner = (p % width > 0) & ((p + 1) % width > 0)
        for line in (-1, 1):
            for side in (-1, 0, 1):
                inner = inner & inside(p + width * line + side)
        return ~(inner & inside(p - 1) & inside(p + 1))

    return F.size(F.filter("cells", on_edge))


PATCHES = "array<struct<patch:int,area:long>>"


def joined_runs(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first run of every run's patch, from pairs of touching runs.

    All patches of all scenes grow at once: labels of touching runs are merged to the smaller one and followed to
    their root until nothing changes.
    """
    label = np.arange(size)
    while True:
        a, b = label[left], label[right]
        if (a == b).all():
            return label
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


def _labelled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Replace the runs and contacts of a batch of scenes by their patches, in the order of first positions."""
    names = batch.schema.names
    runs, contacts = batch.column(names.index("runs")), batch.column(names.index("contacts"))
    run_scene = np.repeat(np.arange(len(runs)), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
    pair_scene = np.repeat(np.arange(len(contacts)), pc.list_value_length(contacts).to_numpy(zero_copy_only=False))
    first, last = (f.to_numpy(zero_copy_only=False).astype(np.int64) for f in runs.flatten().flatten())
    a, b = (f.to_numpy(zero_copy_only=False).astype(np.int64) for f in contacts.flatten().flatten())
    key = (run_scene << 32) | first
    place = lambda cell: np.searchsorted(key, (pair_scene << 32) | cell)
    label = joined_runs(len(key), place(a), place(b))
    area = np.bincount(label, last - first + 1, len(key)).astype(np.int64)
    roots = np.flatnonzero(label == np.arange(len(key)))
    offsets = np.searchsorted(run_scene[roots], np.arange(len(runs) + 1)).astype(np.int32)
    fields = [pa.array(first[roots], pa.int32()), pa.array(area[roots], pa.int64())]
    patches = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["patch", "area"]))
    kept = [i for i, n in enumerate(names) if n not in ("runs", "contacts")]
    return pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], patches], [*[names[i] for i in kept], "patches"])


def runs_and_contacts(masks: DataFrame) -> DataFrame:
    """Add ``runs`` of true pixels and ``contacts`` between runs of neighbouring lines to a mask table."""
    return settled(_with_runs(masks), contacts=_contacts())


def patch_graphs(masks: DataFrame) -> DataFrame:
    """One compact row per mask: ``patches`` (first position and area of each) and the mask's, boundary's and
    scene's pixels.

    All is decided within the scene's row: array functions find runs and contacts, and patches are put together
    for a batch of scenes at a time. Nothing is shuffled, and no scene waits for another.
    """
    graphs = settled(
        _with_runs(masks),
        contacts=_contacts(),
        mask_pixels=F.size("cells").cast("long"),
        boundary_pixels=_boundary().cast("long"),
        scene_pixels=F.col("height").cast("long") * F.col("width"),
    ).select("scene_id", "mask_pixels", "boundary_pixels", "scene_pixels", "runs", "contacts")
    schema = T.StructType([*graphs.schema.fields[:4], T.StructField("patches", T.DataType.fromDDL(PATCHES))])
    return graphs.mapInArrow(lambda batches: map(_labelled, batches), schema)


def patch_sizes(graphs: DataFrame) -> DataFrame:
    """Pixels of every patch: ``scene_id``, ``patch`` (its first position) and ``area``."""
    return graphs.select("scene_id", F.inline("patches"))


def patch_stats(graphs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Number, mean, population deviation and maximum of a scene's patch areas, from its row alone."""
    areas = F.transform("patches", lambda p: p["area"].cast("double"))
    rows = settled(graphs.select("scene_id", *keep, "patches"), _areas=areas)
    total = lambda value: F.aggregate(F.transform("_areas", value), F.lit(0.0), lambda a, v: a + v)
    n = F.size("_areas")
    means = settled(rows, mean_area=total(lambda v: v) / n)
    return means.select(
        "scene_id",
        *keep,
        n.cast("long").alias("patches"),
        "mean_area",
        F.sqrt(total(lambda v: F.pow(v - F.col("mean_area"), 2)) / n).alias("std_area"),
        F.array_max("_areas").alias("max_area"),
    )
