"""JSON-lines output."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from furrow.functions.codes import SPLITS
from furrow.functions.records import json_safe
from furrow.functions.text import bound

# Envelope fields written even when NULL; all other NULL fields are left out.
_ALWAYS = ("split", "target_kind", "target_value", "target_unit", "source_path")


def record_json(df: DataFrame, keep_nulls: Sequence[str] = ()) -> Column:
    """One JSON object per row with cleaned values.

    NULL columns are left out, except those in ``keep_nulls``. Maps keep keys with NULL values.
    """
    clean = {f.name: json_safe(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    written = F.to_json(F.struct(*[c.alias(n) for n, c in clean.items()]))
    kept = [n for n in keep_nulls if n in clean]
    if not kept:
        return written
    nulls = F.concat_ws(",", *[F.when(clean[n].isNull(), F.lit(f'"{n}":null')) for n in kept])

    def extended(both: Column) -> Column:
        fields, missing = both["written"], both["nulls"]
        comma = F.when(F.length(fields) > 2, F.lit(",")).otherwise(F.lit(""))
        longer = F.concat(F.left(fields, F.length(fields) - 1), comma, missing, F.lit("}"))
        return F.when(missing == "", fields).otherwise(longer)

    return bound(F.struct(written.alias("written"), nulls.alias("nulls")), extended)


def write_jsonl(df: DataFrame, path: str, keep_nulls: Sequence[str] = ()) -> int:
    """Write one object per line and return the number of rows, counted while writing."""
    seen = Observation()
    lines = df.select(record_json(df, keep_nulls).alias("value"))
    lines.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").text(path)
    return seen.get["rows"]


def write_jsonl_splits(
    df: DataFrame, path: str, keep_nulls: Sequence[str] = _ALWAYS
) -> dict[str, int]:
    """Write ``split=train``, ``split=validation`` and ``split=test`` below ``path``.

    All three exist afterwards, also without rows. Rows of other splits are not written. The counts
    are taken while writing, in the same pass.
    """
    seen = Observation()
    lines = df.select(record_json(df, keep_nulls).alias("value"), F.col("split"))
    kept = lines.filter(F.col("split").isin(*SPLITS))
    counted = kept.observe(seen, *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    counted.write.mode("overwrite").partitionBy("split").text(path)
    counts = {s: int(seen.get[s] or 0) for s in SPLITS}
    nothing = df.sparkSession.createDataFrame([], "value string").coalesce(1)
    for split, rows in counts.items():
        if not rows:
            nothing.write.mode("overwrite").text(f"{path}/split={split}")
    return counts


def write_manifest(df: DataFrame, path: str, settings: Mapping[str, object]) -> None:
    """Write one JSON object: the job's settings and ``modality_stats`` of a counts table.

    ``df`` has ``modality``, ``split`` and ``rows``: three rows per modality.
    """
    per_modality = df.groupBy("modality").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "rows")))).alias("split_counts"),
        F.sum("rows").alias("rows_written"),
    )
    stats = F.map_from_entries(
        F.collect_list(F.struct("modality", F.struct("split_counts", "rows_written")))
    )
    fixed = F.lit(json.dumps(settings, ensure_ascii=False))
    whole = F.concat(F.left(fixed, F.length(fixed) - 1), F.lit(', "modality_stats": '), F.to_json(stats), F.lit("}"))
    per_modality.agg(whole.alias("value")).coalesce(1).write.mode("overwrite").text(path)
