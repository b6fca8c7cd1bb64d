"""CSV sources: weather and labels."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.codes import split_of_year
from furrow.functions.text import fips_code
from furrow.operators.joins import broadcast_limit
from furrow.operators.labels import anchors_of_cells
from furrow.sources.paths import with_label_path_fields

HEADER_BYTES = 64 << 10


def read_csv(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """CSV files with the same header, all columns as text.

    Spark binds columns by position; ``enforceSchema=False`` makes it compare every file's header
    with the schema and fail on a difference instead of mixing columns up.
    """
    reader = spark.read.option("header", True)
    if columns is None:
        columns = reader.csv(paths[0]).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return reader.schema(schema).option("enforceSchema", False).csv(list(paths))


def first_line(stream: BinaryIO) -> str:
    """The first line of an open file, read in pieces of ``HEADER_BYTES``; a byte order mark is left out."""
    held = b""
    while b"\n" not in held and (piece := stream.read(HEADER_BYTES)):
        held += piece
    return held.partition(b"\n")[0].decode("utf-8-sig", "replace").rstrip("\r")


def opened(uri: str) -> BinaryIO:
    """A file of a file system that pyarrow knows; usable on executors."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file" or not rest:
        return arrow_fs.LocalFileSystem().open_input_stream(f"/{rest.lstrip('/')}" if rest else uri)
    system, path = arrow_fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    return system.open_input_stream(path)


def file_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """First lines of files: ``file`` (as Spark names it in ``_metadata.file_path``) and ``header``.

    The files are listed without their content, and tasks open each and read no further than its first line. A file system that
    only Spark can open is scanned instead.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select(F.col("_metadata.file_path").alias("file"))
    scheme = paths[0].partition("://")[0] if "://" in paths[0] else "file"
    try:
        arrow_fs.FileSystem.from_uri(f"{scheme}:///")
    except (pa.ArrowException, ValueError, OSError):
        return _scanned_headers(spark, paths)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers = []
            for name in batch.column(0).to_pylist():
                with opened(unquote(name)) as stream:
                    headers.append(first_line(stream))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(headers, pa.string())], ["file", "header"])

    return files.mapInArrow(task, "file string, header string")


def _scanned_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """First lines by a scan: those of the pieces that start at the files' beginnings."""
    lines = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    heads = lines.withColumn("at", F.monotonically_increasing_id()).filter("start = 0")
    return heads.groupBy("file").agg(F.min_by("value", "at").alias("header"))


def csv_layouts(spark: SparkSession, paths: Sequence[str]) -> list[tuple[list[str], list[str]]]:
    """Headers of CSV files with the files that have them. One row per header, with the names of its files, goes to the driver."""
    headers = file_headers(spark, paths)
    groups = headers.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header")
    return [(next(csv.reader([r["header"]])), r["files"]) for r in groups.collect()]


def csv_cells(spark: SparkSession, layouts: Sequence[tuple[list[str], list[str]]]) -> DataFrame:
    """Rows of CSV files of any headers from one scan: ``file`` and ``cells``, the row's texts in the file's order."""
    names = [f"c{i}" for i in range(max(len(header) for header, _ in layouts))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    files = [unquote(f) for _, held in layouts for f in held]
    rows = spark.read.option("header", True).schema(schema).csv(files)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.array(*names).alias("cells"))


def layout_table(spark: SparkSession, layouts: Sequence[tuple[list[str], list[str]]]) -> DataFrame:
    """``file`` and ``header`` (column names) of every file, broadcast if it is small."""
    rows = [(file, header) for header, files in layouts for file in files]
    size = sum(len(file) + sum(len(c) + 16 for c in header) for file, header in rows)
    table = spark.createDataFrame(rows, "file string, header array<string>")
    return F.broadcast(table) if size <= broadcast_limit(table) else table


def united_names(headers: Sequence[Sequence[str]]) -> list[str]:
    """All names of some headers in order of appearance; names that differ in case are one."""
    names: dict[str, str] = {}
    for header in headers:
        for name in header:
            names.setdefault(name.lower(), name)
    return list(names.values())


def bound_by_name(rows: DataFrame, layouts: DataFrame, names: Sequence[str], key: str = "file") -> DataFrame:
    """``rows(key, cells)`` with one text column per name, each cell by the place of the name in the row's header.

    ``layouts(key, header)`` has the headers. Names that a header lacks are NULL, and so are cells that a row lacks.
    """
    lowered = F.transform("header", F.lower)
    places = layouts.select(F.col(key).alias("_key"), F.array(*[F.array_position(lowered, n.lower()) for n in names]).alias("_places"))
    joined = rows.join(places, rows[key] == places["_key"])
    cell = lambda k: F.get("cells", F.nullif(F.get("_places", F.lit(k)), F.lit(0).cast("long")).cast("int") - 1)
    return joined.select(*[cell(k).alias(n) for k, n in enumerate(names)])


def read_csv_by_name(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """CSV files with different headers, united by column name; all columns are text.

    All files are one scan, however many headers there are.
    """
    layouts = csv_layouts(spark, paths)
    return bound_by_name(csv_cells(spark, layouts), layout_table(spark, layouts), united_names([header for header, _ in layouts]))


def read_weather(spark: SparkSession, *paths: str) -> DataFrame:
    """Weather CSV files of one header layout; columns are typed by the weather operators."""
    return read_csv(spark, paths)


def read_county_weather(
    spark: SparkSession,
    paths: Sequence[str],
    fips_codes: Sequence[str] | None = None,
    same_header: bool = False,
) -> DataFrame:
    """Weather CSV files of several states and years with a padded ``county_id``.

    ``same_header`` reads all files (or directories) at once, without looking at each file's header
    first; a file that differs makes the job fail.
    """
    df = read_csv(spark, paths) if same_header else read_csv_by_name(spark, paths)
    df = df.withColumn("county_id", fips_code(F.col("`FIPS Code`"))).drop("FIPS Code")
    return df if fips_codes is None else df.filter(F.col("county_id").isin(list(fips_codes)))


def read_label_cells(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """Rows of the selected label files below ``root``, of any crops and headers, as one table.

    ``cells`` maps a file's columns to its texts; source_path, year, crop_type and split come from the file's path.
    """
    base = root.rstrip("/")
    plain_base = re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", base)
    # The file's URI is percent-encoded, but a plus sign in it stands for itself.
    uri = F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))
    inside = F.substring_index(F.regexp_replace(uri, r"^[a-z0-9]+:(//[^/]*)?", ""), f"{plain_base}/", -1)
    layouts = csv_layouts(spark, [f"{base}/{p}" for p in paths])
    heads = layout_table(spark, layouts).withColumnRenamed("file", "_file")
    rows = csv_cells(spark, layouts)
    rows = rows.join(heads, F.col("file") == F.col("_file"))
    cells = F.map_from_arrays("header", F.slice("cells", F.lit(1), F.size("header")))
    known = with_label_path_fields(rows.select(inside.alias("path"), cells.alias("cells")), on_unknown="fail")
    return known.withColumn("split", split_of_year(F.col("year"), on_unknown="fail")).withColumnRenamed("path", "source_path")


def read_anchors(spark: SparkSession, root: str, paths: Sequence[str], target_kind: str) -> DataFrame:
    """Anchors of the selected label files below ``root``."""
    return anchors_of_cells(read_label_cells(spark, root, paths), target_kind)
