"""Scenes larger than a row: tiles and what they must tell each other.

A *tile table* has one row per tile: ``scene_id``, ``top`` and ``left`` (the place of its first pixel in the scene), ``height``,
``width`` and ``data``. Tiles of a scene do not overlap; they may differ in size, and a scene may have gaps. What lies
inside a tile is computed in its row. Only pixels along tile borders, counts and patches are shuffled, never the tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.numeric import flag
from furrow.operators.components import component_roots
from furrow.operators.joins import join_on, small_side
from furrow.operators.patches import joined_runs, mask_above, runs_and_contacts
from furrow.operators.rasters import EDGE_ABOVE, edge_response, settled

TILE = ("scene_id", "top", "left")
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
DIGITS = (22, 21, 21)


# ------------------------------------------------------------------------------------------------
# Patches across tiles
# ------------------------------------------------------------------------------------------------
def _labelled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The patches of each tile (first cell, area), and for each of its border cells the first cell of its patch."""
    at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    length = lambda lists: pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    whole = lambda column: column.to_numpy(zero_copy_only=False).astype(np.int64)
    n = batch.num_rows
    tile = np.repeat(np.arange(n), length(at["runs"]))
    pair_tile = np.repeat(np.arange(n), length(at["contacts"]))
    first, last = (whole(f) for f in at["runs"].flatten().flatten())
    a, b = (whole(f) for f in at["contacts"].flatten().flatten())
    key = (tile << 32) | first
    label = joined_runs(len(key), *(np.searchsorted(key, (pair_tile << 32) | cell) for cell in (a, b)))
    area = np.bincount(label, last - first + 1, len(key)).astype(np.int64)
    roots = np.flatnonzero(label == np.arange(len(key)))

    width, height = whole(at["width"])[tile], whole(at["height"])[tile]
    along = (first < width) | (first >= width * (height - 1))
    # Along the upper and lower border a whole run, else its ends if they are in the first or last column.
    count = np.where(along, last - first + 1, 0)
    run = np.repeat(np.arange(len(key)), count)
    cell = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    start = np.flatnonzero(~along & (first % width == 0))
    end = np.flatnonzero(~along & ((last + 1) % width == 0) & ((last > first) | (width > 1) & (first % width != 0)))
    run, cell = np.r_[run, start, end], np.r_[cell, first[start], last[end]]
    order = np.argsort(tile[run], kind="stable")
    run, cell = run[order], cell[order]

    def lists(owner: np.ndarray, names: list[str], *columns: pa.Array) -> pa.ListArray:
        offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns), names))

    patches = lists(tile[roots], ["patch", "area"], pa.array(first[roots], pa.int32()), pa.array(area[roots], pa.int64()))
    border = lists(tile[run], ["cell", "patch"], pa.array(cell, pa.int32()), pa.array(first[label[run]], pa.int32()))
    return pa.RecordBatch.from_arrays([at["tile"], at["width"], patches, border], ["tile", "width", "patches", "border"])


def _place(cell: Column) -> Column:
    """Scene, line and column of a tile's cell."""
    line, column = F.floor(cell / F.col("width")), cell % F.col("width")
    return F.struct(
        F.col("tile.scene_id").alias("scene_id"),
        (F.col("tile.top") + line).cast("long").alias("y"),
        (F.col("tile.left") + column).cast("long").alias("x"),
    )


def tile_patch_sizes(tiles: DataFrame, threshold: float) -> DataFrame:
    """Connected patches (8-neighbourhood) of the pixels above a threshold, across tiles: scene_id, y, x, area.

    A patch is named by its first pixel, line by line. Patches are put together inside each tile, border pixels
    of neighbouring tiles that touch make edges between these, and components of the edges are the scene's patches. NULL and NaN
    pixels are not above.
    """
    keyed = tiles.select(F.struct(*TILE).alias("scene_id"), "height", "width", "data")
    graphs = runs_and_contacts(mask_above(keyed, threshold)).select(F.col("scene_id").alias("tile"), "height", "width", "runs", "contacts")
    tile_type = tiles.select(F.struct(*TILE).alias("tile")).schema["tile"].dataType.simpleString()
    schema = f"tile {tile_type}, width int, patches array<struct<patch:int,area:long>>, border array<struct<cell:int,patch:int>>"
    local = graphs.mapInArrow(lambda batches: map(_labelled, batches), schema)

    cells = local.select("tile", "width", F.inline("border")).select(
        _place(F.col("cell")).alias("pixel"), _place(F.col("patch")).alias("node"), "tile"
    )
    # Half of the neighbours, so that a pair is met once.
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    there = F.struct("pixel.scene_id", (F.col("pixel.y") + F.col("step.dy")).alias("y"), (F.col("pixel.x") + F.col("step.dx")).alias("x"))
    reach = cells.select(F.explode(steps).alias("step"), "pixel", F.col("node").alias("a"), F.col("tile").alias("from"))
    reach = reach.select(there.alias("pixel"), "a", "from")
    touching = reach.join(cells.withColumnRenamed("node", "b"), "pixel").filter(F.col("from") != F.col("tile"))
    roots = component_roots(touching.select("a", "b"))

    patches = local.select("tile", "width", F.inline("patches")).select(_place(F.col("patch")).alias("node"), "area")
    whole = patches.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("first")).agg(F.sum("area").alias("area"))
    return whole.select("first.*", "area")


# ------------------------------------------------------------------------------------------------
# Stencils across tiles
# ------------------------------------------------------------------------------------------------
def border_sums(tiles: DataFrame) -> DataFrame:
    """For every pixel on a tile's border: ``own`` value, ``around`` (sum of the 3x3 box) and ``cells`` (how many it has).

    Every pixel near a border gives its value to the border pixels around it, in its own tile and beyond; the values are
    summed before they are shuffled. ``data`` is one band of whole numbers; NULL counts as a cell of value 0. Returns scene_id, y, x
    with them.
    """
    line, column = F.floor(F.col("p") / F.col("width")).cast("int"), (F.col("p") % F.col("width")).cast("int")
    depth = lambda at, size: F.least(at, size - 1 - at)
    last = (F.col("height") * F.col("width") - 1).cast("int")
    positions = F.filter(
        F.sequence(F.lit(0), last),
        lambda p: F.least(
            depth(F.floor(p / F.col("width")), F.col("height")), depth(p % F.col("width"), F.col("width"))
        ) <= 1,
    )
    pixels = tiles.select(*TILE, "height", "width", "data", F.explode(positions).alias("p"))
    pixels = pixels.select(*TILE, "height", "width", line.alias("line"), column.alias("column"), F.coalesce(F.get("data", "p"), F.lit(0)).cast("long").alias("value"))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    given = pixels.withColumn("step", F.explode(steps)).withColumns(
        {"line": F.col("line") + F.col("step.dy"), "column": F.col("column") + F.col("step.dx")}
    )
    # Outside of the tile every place that is touched is on another's border, or outside of the scene.
    on_border = (depth(F.col("line"), F.col("height")) <= 0) | (depth(F.col("column"), F.col("width")) <= 0)
    own = (F.col("step.dy") == 0) & (F.col("step.dx") == 0)
    sums = given.filter(on_border).groupBy(
        "scene_id", (F.col("top") + F.col("line")).cast("long").alias("y"), (F.col("left") + F.col("column")).cast("long").alias("x")
    ).agg(F.sum("value").alias("around"), F.count(F.lit(1)).alias("cells"), F.max(F.when(own, F.col("value"))).alias("own"))
    return sums.filter(F.col("own").isNotNull())


def _inner(p: Column) -> Column:
    column, line = p % F.col("width"), F.floor(p / F.col("width"))
    return (column > 0) & (column < F.col("width") - 1) & (line > 0) & (line < F.col("height") - 1)


def _counted(tiles: DataFrame, inside: Callable[[Column], Column], on_border: Column, alias: str) -> DataFrame:
    """Pixels of a scene that meet a condition, and all: those inside tiles from their rows, the others from border sums."""
    last = (F.col("height") * F.col("width") - 1).cast("int")
    found = F.size(F.filter(F.sequence(F.lit(0), last), lambda p: _inner(p) & inside(p)))
    rows = tiles.select("scene_id", found.cast("long").alias("n"), (F.col("height").cast("long") * F.col("width")).alias("pixels"))
    edges = border_sums(tiles).select("scene_id", on_border.cast("long").alias("n"), F.lit(0).cast("long").alias("pixels"))
    both = rows.unionByName(edges).groupBy("scene_id")
    return both.agg(F.sum("n").alias(alias), F.sum("pixels").alias("pixels"))


def tile_edge_density(tiles: DataFrame) -> DataFrame:
    """Share of edge pixels of grey scenes in tiles: scene_id, edge_density.

    A pixel with eight neighbours in the scene answers to the 3x3 kernel, whatever tiles they are in; others keep their own level.
    """
    response = F.when(F.col("cells") == 9, F.col("own") * 9 - F.col("around") > EDGE_ABOVE).otherwise(F.col("own") > EDGE_ABOVE)
    inside = lambda p: edge_response(F.col("data"), p, F.col("width"), F.col("height"))
    counted = _counted(tiles, inside, response, "edges")
    return counted.select("scene_id", (F.col("edges") / F.col("pixels")).alias("edge_density"))


def tile_boundaries(tiles: DataFrame, threshold: float) -> DataFrame:
    """Pixels above a threshold with a neighbour that is not, or is outside of the scene: scene_id, boundary_pixels."""
    above = F.transform("data", lambda v: flag((v > threshold) & ~F.isnan(v)).cast("int"))
    masks = settled(tiles.select(*TILE, "height", "width", "data"), data=above)
    at = lambda p, dy, dx: F.get("data", (p + F.col("width") * dy + dx).cast("int"))
    box = lambda p: sum((at(p, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)), start=F.lit(0))
    inside = lambda p: (at(p, 0, 0) == 1) & (box(p) < 9)
    return _counted(masks, inside, (F.col("own") == 1) & (F.col("around") < 9), "boundary_pixels").drop("pixels")


# ------------------------------------------------------------------------------------------------
# Quantiles across tiles
# ------------------------------------------------------------------------------------------------
def _ordered_bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers that are ordered as the doubles are."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits | np.int64(-(1 << 63))).view(np.uint64)


def _double_of(bits: int) -> float:
    """The double of an ordered number."""
    raw = bits & ((1 << 63) - 1) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _digit_counts(tiles: DataFrame, known: int, digit: int, limits: tuple[float, float]) -> DataFrame:
    """Pixels by scene, ``prefix`` (the leading ``known`` bits, one of the tile's ``prefixes``) and next ``digit`` bits."""
    low, high = limits
    selected = "prefixes" in tiles.columns
    rows = tiles.select("scene_id", "data", *(["prefixes"] if selected else []))
    scene = rows.schema["scene_id"].dataType.simpleString()
    schema = f"scene_id {scene}, prefix long, digit long, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = batch.column(1)[i].values
                if values is None:
                    continue
                values = values.drop_null().to_numpy(zero_copy_only=False).astype(np.float64)
                key = _ordered_bits(values[(values >= low) & (values <= high)])
                prefix = key >> np.uint64(64 - known) if known else np.zeros(len(key), np.uint64)
                if selected:
                    wanted = np.array(batch.column(2)[i].as_py(), np.int64).view(np.uint64)
                    here = np.isin(prefix, wanted)
                    key, prefix = key[here], prefix[here]
                both = key >> np.uint64(64 - known - digit)
                found, n = np.unique(both, return_counts=True)
                if not len(found):
                    continue
                columns = [
                    batch.column(0).take(pa.array(np.full(len(found), i))),
                    pa.array((found >> np.uint64(digit)).view(np.int64)),
                    pa.array((found & np.uint64((1 << digit) - 1)).view(np.int64)),
                    pa.array(n.astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["scene_id", "prefix", "digit", "n"])

    return rows.mapInArrow(count, schema).groupBy("scene_id", "prefix", "digit").agg(F.sum("n").alias("n"))


def tile_quantiles(
    tiles: DataFrame,
    shares: dict[str, float] = QUARTILES,
    limits: tuple[float, float] = (-0.2, 1.0),
    digits: Sequence[int] = DIGITS,
) -> DataFrame:
    """Exact quantiles of the valid pixels of scenes in tiles: scene_id and one column per share.

    The wanted order statistics are selected by radix: a first histogram counts pixels by their leading bits, the
    next ones only those within the bins that hold a wanted rank, until all 64 bits are known. Nothing is
    sorted but a scene's bins. Quantiles are interpolated between neighbours. Scenes without a valid pixel have no row.
    """
    if sum(digits) != 64:
        raise ValueError("the digits must have 64 bits")
    known, targets = 0, None
    for digit in digits:
        rows = tiles
        if targets is not None:
            wanted = targets.groupBy("scene_id").agg(F.collect_set("prefix").alias("prefixes"))
            rows = join_on(tiles.select("scene_id", "data"), small_side(wanted), ["scene_id"])
        counts = _digit_counts(rows, known, digit, limits)
        along = Window.partitionBy("scene_id", "prefix").orderBy("digit")
        upto = counts.withColumn("upto", F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        if targets is None:
            total = counts.groupBy("scene_id").agg(F.sum("n").alias("pixels"))
            places = [(name, (F.col("pixels") - 1) * F.lit(share)) for name, share in shares.items()]
            ranks = F.array(*[
                F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (at - F.floor(at)).alias("share"),
                         F.least(F.floor(at) + side, F.col("pixels") - 1).cast("long").alias("rank"))
                for name, at in places for side in (0, 1)
            ])
            targets = total.select("scene_id", F.lit(0).cast("long").alias("prefix"), F.inline(ranks))
        bins = upto.select("scene_id", "prefix", "digit", "upto", (F.col("upto") - F.col("n")).alias("below"))
        inside = join_on(targets, bins, ["scene_id", "prefix"]).filter("rank >= below AND rank < upto")
        longer = F.shiftleft("prefix", digit).bitwiseOR(F.col("digit"))
        targets = inside.select("scene_id", longer.alias("prefix"), "name", "side", "share", (F.col("rank") - F.col("below")).alias("rank"))
        known += digit
    value = F.pandas_udf(lambda bits: bits.map(lambda b: _double_of(int(b) & ((1 << 64) - 1))), "double")
    values = targets.withColumn("value", value("prefix"))

    def quantile(name: str) -> Column:
        of = lambda side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("value")))
        share = F.max(F.when(F.col("name") == name, F.col("share")))
        return (of(0) + (of(1) - of(0)) * share).alias(name)

    return values.groupBy("scene_id").agg(*[quantile(name) for name in shares])
