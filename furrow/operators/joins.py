"""Joins on keys that may be NULL, small sides of measured size, and key filters for scans."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.session import cut_lineage

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"
BITS_PER_KEY, PROBES = 12, 4
FEWEST_BITS, MOST_BITS = 1 << 10, 1 << 27


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality of key pairs; still an equi-join for the planner."""
    return reduce(lambda a, b: a & b, (left[l].eqNullSafe(right[r]) for l, r in keys))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two sides on columns of the same names, matching NULL keys with NULL keys.

    Adaptive execution knows a side's bytes only after both have been shuffled; a side that should spare the other its
    shuffle comes from :func:`small_side`. Else the join is a sort-merge join whose hot partitions are split (see
    :mod:`furrow.session`).
    """
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    joined = left.join(renamed, same_keys(left, renamed, [(k, f"_right_{k}") for k in keys]), how)
    return joined.drop(*[f"_right_{k}" for k in keys])


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows of a table of numbers and texts."""
    size = F.lit(16)
    for field in df.schema.fields:
        text = isinstance(field.dataType, (T.StringType, T.BinaryType))
        size = size + (F.coalesce(F.octet_length(field.name), F.lit(0)) + 8 if text else F.lit(8))
    return df.agg(F.sum(size.cast("long")).alias("bytes")).first()["bytes"] or 0


def broadcast_limit(df: DataFrame) -> int:
    """The session's broadcast threshold in bytes; negative for none. It may be written with a unit, such as 256k or 10MB."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", df.sparkSession.conf.get(THRESHOLD).lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def small_side(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the checkpoint folder, and broadcast if its measured bytes are under the threshold.

    The planner does not know what an aggregation will leave, and would shuffle the other side before it learns.
    """
    held = cut_lineage(df)
    return F.broadcast(held) if measured_bytes(held) <= broadcast_limit(df) else held


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Add per-group aggregates to every row.

    A window over ``keys`` would pull a whole group into one task; this aggregates first, with map-side combine,
    and joins the one-row-per-group result to the rows, which stay where they are while that result is small.
    """
    per_group = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return join_on(df, small_side(per_group), keys)


def _key_bits(columns: Sequence[Column], bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(probe), *columns), F.lit(bits)) for probe in range(PROBES)]


def key_bitmap(keys: DataFrame, n_keys: int) -> bytes:
    """Bloom filter of the rows of ``keys``; only its bits go to the driver, 16 MB at most for any number of keys."""
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (n_keys * BITS_PER_KEY - 1).bit_length()))
    bit = F.explode(F.array(*_key_bits([F.col(c) for c in keys.columns], bits)))
    found = keys.select(bit.alias("bit")).groupBy(F.expr("bit div 8").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1, CAST(bit % 8 AS INT))")).alias("value")
    )
    held = bytearray(bits // 8)
    for row in found.collect():
        held[row["at"]] = row["value"]
    return bytes(held)


def may_hold(bitmap: bytes, columns: Sequence[Column]) -> Column:
    """Whether a key may be in the filter, evaluated where the row is read; a key that is in it always is."""
    held = F.lit(bitmap)

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(held, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) > 0

    return reduce(lambda a, b: a & b, map(is_set, _key_bits(columns, len(bitmap) * 8)))


def rows_of_keys(df: DataFrame, keys: DataFrame, types: dict[str, str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``, without moving them.

    The distinct keys are measured. Under the broadcast threshold they are a broadcast semi-join, and exactly these rows
    are left; beyond it a Bloom filter is evaluated in the scan, which may let rows of other keys through, so the
    caller must join on the keys later on. Rows with a NULL key are left out. ``types`` are the keys' types, by column.
    """
    typed = lambda c: F.col(c).cast(types[c])
    wanted = cut_lineage(keys.select(*[typed(c).alias(f"_wanted_{c}") for c in types]).dropna().distinct())
    if measured_bytes(wanted) <= broadcast_limit(df):
        same = reduce(lambda a, b: a & b, (typed(c) == F.col(f"_wanted_{c}") for c in types))
        return df.join(F.broadcast(wanted), same, "left_semi")
    present = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in types))
    return df.filter(present & may_hold(key_bitmap(wanted, wanted.count()), [typed(c) for c in types]))
