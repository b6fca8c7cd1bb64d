"""Longest run of true rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.numeric import flag


def longest_dated_streak(
    df: DataFrame, keys: Sequence[str], condition: Column, date: str, alias: str = "longest_streak"
) -> DataFrame:
    """Longest run of rows, in ``date`` order, for which ``condition`` is true; true rows come first within a date.

    A date is two counts, so rows leave their task as partial aggregates. A group is then folded along its dates,
    of which a month has a few dozen.
    """
    hit = flag(condition)
    dates = df.groupBy(*keys, date).agg(F.count_if(hit).alias("_hits"), F.count_if(~hit).alias("_others"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(date).alias("date"), F.col("_hits"), F.col("_others"))))
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("best"))

    def step(state: Column, row: Column) -> Column:
        run = state["run"] + row["_hits"]
        after = F.when(row["_others"] > 0, F.lit(0).cast("long")).otherwise(run)
        return F.struct(after.alias("run"), F.greatest(state["best"], run).alias("best"))

    return dates.groupBy(*keys).agg(F.aggregate(rows, start, step)["best"].alias(alias))


DAYS = range(1, 32)
OTHERS = 1 << 32


def day_vector(condition: Column, date: str) -> list[Column]:
    """Aggregates for one month: per day of the month the rows for which ``condition`` holds and the others, in one number.

    The 31 numbers add up, so they leave their task with the other aggregates of the month.
    """
    count = F.when(flag(condition), F.lit(1).cast("long")).otherwise(F.lit(OTHERS))
    day = F.dayofmonth(date)
    return [F.sum(F.when(day == k, count)).alias(f"_day_{k}") for k in DAYS]


def streak_of_days() -> Column:
    """Longest run of true rows along a month's day vector; true rows come first within a day."""
    days = F.array(*[F.coalesce(F.col(f"_day_{k}"), F.lit(0).cast("long")) for k in DAYS])
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("best"))

    def step(state: Column, day: Column) -> Column:
        run = state["run"] + day.bitwiseAND(F.lit(OTHERS - 1))
        after = F.when(day >= OTHERS, F.lit(0).cast("long")).otherwise(run)
        return F.struct(after.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(days, start, step)["best"]


def longest_true_streak(
    df: DataFrame,
    keys: Sequence[str],
    condition: Column,
    order_by: Sequence[str],
    alias: str = "longest_streak",
    partitions: int | None = None,
) -> DataFrame:
    """Longest run of consecutive rows, in ``order_by`` order, for which ``condition`` is true.

    Rows are range-partitioned by group and order, so that a group of any size is spread over as many tasks as its
    rows need. Each piece of a group is reduced to four numbers (run at its head, run at its tail, best run
    inside, breaks); pieces are then chained, at most one per partition and group.
    ``order_by`` should be unique within a group for a reproducible result.
    """
    keys, order_by = list(keys), list(order_by)
    rows = df.select(*keys, *order_by, flag(condition).cast("int").alias("_hit"))
    target = [partitions] if partitions else []
    pieces = rows.repartitionByRange(*target, *keys, *order_by).withColumn("_piece", F.spark_partition_id())

    along = Window.partitionBy(*keys, "_piece").orderBy(*order_by).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    runs = (
        pieces.withColumn("_run", F.sum(1 - F.col("_hit")).over(along))
        .groupBy(*keys, "_piece", "_run")
        .agg(F.sum("_hit").alias("_n"))
    )
    ends = runs.groupBy(*keys, "_piece").agg(
        F.coalesce(F.max(F.when(F.col("_run") == 0, F.col("_n"))), F.lit(0)).alias("_head"),
        F.max_by("_n", "_run").alias("_tail"),
        F.max("_n").alias("_best"),
        (F.max("_run") > 0).alias("_broken"),
    )

    across = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    chain = F.sum(F.col("_broken").cast("int")).over(across)
    shares = ends.withColumn("_chain", chain).select(
        *keys,
        "_best",
        F.explode(
            F.array(
                F.struct(F.col("_chain").alias("id"), F.col("_tail").alias("n")),
                F.struct(
                    F.when(F.col("_broken"), F.col("_chain") - 1).alias("id"),
                    F.when(F.col("_broken"), F.col("_head")).alias("n"),
                ),
            )
        ).alias("_share"),
    )
    return (
        shares.groupBy(*keys, F.col("_share.id").alias("_id"))
        .agg(F.sum("_share.n").alias("_joined"), F.max("_best").alias("_best"))
        .groupBy(*keys)
        .agg(
            F.greatest(
                F.max("_best"), F.max(F.when(F.col("_id").isNotNull(), F.col("_joined")))
            ).alias(alias)
        )
    )
