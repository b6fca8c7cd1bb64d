"""Documents dealt to shards of near equal size: longest groups first, each to the least loaded shard.

Documents of equal text form a group, which one shard takes whole. Groups are ordered by size, and consecutive ones are
bundled up to a ``PARTS``-th of a shard's mean; a group larger than that is a bundle of its own. The bundles, whose number
the shards bound whatever the table's size, are scheduled with a heap. So shards differ by two such parts at most, unless
a single group is larger than a shard's mean: its shard then holds nothing else.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F

from .common import joined_beside_hot, with_running_total, written

SHARDS = 40
PARTS = 1000
ROW_BYTES = 16
LAW = "bytes"


def scheduled(loads: list[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """(bundle, size) -> (bundle, shard): the longest first, ties to the smaller bundle and the smaller shard."""
    heap = [(0, shard) for shard in range(shards)]
    dealt = []
    for bundle, size in sorted(loads, key=lambda b: (-b[1], b[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        dealt.append((bundle, shard))
    return dealt


def keyed_documents(docs: DataFrame) -> DataFrame:
    """Add ``_key`` (SHA-256 of the text) and ``_size`` (its bytes plus 16); null is as an empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + ROW_BYTES).cast("long")
    return docs.withColumns({"_key": F.unhex(F.sha2(text.cast("binary"), 256)), "_size": size})


def group_shards(keyed: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, int]:
    """Shard and number of rows (``_n``) of every ``_key``, and the number of all rows."""
    groups = keyed.groupBy("_key").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_n"))
    ordered = with_running_total(groups.withColumn("_less", -F.col("_bytes")), ["_less", "_key"], "_bytes", "_before")
    ordered = written(ordered.drop("_less"), "groups")
    total, rows = ordered.agg(F.sum("_bytes"), F.sum("_n")).first()
    unit = max(1, -(-(total or 0) // (shards * PARTS)))
    bundled = ordered.withColumn("_bundle", F.expr(f"_before div {unit}L"))
    # At most one row per unit of the total: shards * PARTS.
    loads = bundled.groupBy("_bundle").agg(F.sum("_bytes").alias("_load")).collect()
    dealt = scheduled([(r["_bundle"], r["_load"]) for r in loads], shards)
    table = keyed.sparkSession.createDataFrame(dealt, "_bundle long, shard int")
    return bundled.join(F.broadcast(table), "_bundle").select("_key", "_n", "shard"), rows or 0


def _with_shard(keyed: DataFrame, shards: int) -> DataFrame:
    dealt, rows = group_shards(keyed, shards)
    # At most PARTS groups have a PARTS-th of the rows.
    return joined_beside_hot(keyed, dealt, ["_key"], F.col("_n") * PARTS >= rows).drop("_n")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard of every row of ``docs(doc_id, text)`` and its place in it, in the order of ids, null first.

    Null texts have no bytes and go with empty ones. Repeated rows count each; which of them comes first is
    free, but fixed. An empty table gives no rows; other columns are ignored.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not ``key``).
    """
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    keyed = keyed_documents(docs.select("doc_id", "text"))
    narrow = keyed.select("doc_id", "_key", F.col("_size"), crc, F.monotonically_increasing_id().alias("_row"))
    rows = _with_shard(written(narrow, "sizes"), shards).drop("_key").withColumn("_one", F.lit(1).cast("long"))
    numbered = written(with_running_total(rows, ["shard", "doc_id", "_row"], "_one", "_place"), "places")
    first = numbered.groupBy("shard").agg(F.min("_place").alias("_first"))
    return numbered.join(F.broadcast(first), "shard").select(
        "doc_id",
        F.col("_size").alias("size"),
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("_place") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write whole ``docs`` to ``path/shard=<n>``, each shard in files that follow the ids; all columns but ``shard`` stay."""
    names = [c for c in docs.columns if c != "shard"]
    keyed = written(keyed_documents(docs.select(*[F.col(f"`{c}`") for c in names])), "keyed")
    rows = _with_shard(keyed, shards).select(*[F.col(f"`{c}`") for c in names], "shard")
    rows.repartitionByRange("shard", "doc_id").sortWithinPartitions("shard", "doc_id").write.partitionBy("shard").parquet(path)
