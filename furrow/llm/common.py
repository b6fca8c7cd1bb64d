"""What the operators share: reading tables, the shared folder, files in it, cutting lineage, running totals."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from furrow.session import tuned

BATCH_BYTES = 8 << 20
BATCH_ROWS = 10_000

# The word of every contract: a run of characters other than space, tab, newline, VT, FF and CR.
SPACES = " \\x09-\\x0D"
WORD_BREAK = f"[{SPACES}]+"
HAS_WORD = f"[^{SPACES}]"


def ready(spark: SparkSession) -> None:
    """Settings for tasks in Python: batches bounded by bytes, and workers that find this package.

    Texts can be long, so what a task hands to Python at once is bounded. Joins with a hot key are split even where
    that takes another shuffle.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    tuned(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only a local session may lack it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='furrow-shared-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder of its own name within the shared one."""
    return f"{shared_base(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` reliably in the shared folder; its files go when the result is no longer used."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder in the shared store; usable on executors."""
    if "://" not in uri and uri.startswith("file:"):
        uri = f"file://{uri.removeprefix('file:')}"
    return arrow_fs.FileSystem.from_uri(uri)


def attempt_file(folder: str, suffix: str) -> str:
    """A file name no other attempt of this task uses: a lost attempt's file is never referred to."""
    return posixpath.join(folder, f"{uuid.uuid4().hex}{suffix}")


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator, so that the optimizer does not compute them again per use."""
    inner = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(inner)))


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.size(words_of(text)).cast("long")


def with_running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over all rows ordered before a row (ties in a fixed but free order).

    Rows are range-partitioned by ``order``, summed per partition, and only the one total of each
    partition goes to the driver; the running sum within a partition continues from it.
    """
    spark = df.sparkSession
    names = df.columns
    part = written(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    totals = part.groupBy("_part").agg(F.sum(value).alias("_sum")).orderBy("_part").collect()
    offsets, total = [], 0
    for row in totals:
        offsets.append((row["_part"], total))
        total += row["_sum"] or 0
    schema = "_part int, _offset " + df.schema[value].dataType.simpleString()
    from pyspark.sql import Window

    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = spark.createDataFrame(offsets, schema)
    return (
        part.join(F.broadcast(start), "_part")
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .select(*names, out)
    )


def joined_beside_hot(left: DataFrame, right: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per key and a row for every key of ``left``.

    Rows of ``right`` that are ``hot`` (a condition few rows can meet by their definition) are broadcast, and what they
    match is not shuffled; the rest is a plain join. ``left`` is read twice and should be a written table.
    """
    values = [c for c in right.columns if c not in keys]
    few = right.where(hot).select(*keys, F.struct(*values).alias("_few"))
    marked = left.join(F.broadcast(few), keys, "left")
    names = [*left.columns, *values]
    beside = marked.where("_few IS NOT NULL").select(*left.columns, *[F.col(f"_few.{c}").alias(c) for c in values])
    rest = marked.where("_few IS NULL").drop("_few").join(right.where(~hot), keys)
    return beside.select(*names).unionByName(rest.select(*names))
