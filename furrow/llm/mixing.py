"""Mixing sources to target weights by entropy balancing.

Each source gets a target number of words. Document rates as near to 1 as the targets allow, in relative entropy and
with 2 as the highest rate, are ``min(2, exp(lambda * size))``, with one multiplier per source: the minimum of the
convex dual. Newton iterations find all multipliers at once from sums over a table of sizes; rates are rounded to
copies along the documents in order of size, and a few documents are changed to meet the targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, with_running_total, word_count

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
STEPS = 200
NEAR = 1e-6
FIXES = 4
PARTS = 64
UNIT = 1 << 30


def source_key(source: Column) -> Column:
    """A text that orders sources by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE) -> DataFrame:
    """Add ``target`` to ``sources(key, source_size)``: the total by weight, at most twice a source's size.

    What capped sources leave is dealt to the others again by weight, until none is above: the level per unit of weight
    rises until it is the same for all that are not capped. Each round is one sum over the sources; only the level
    is on the driver.
    """
    one = sources.withColumn("one", F.lit(1).cast("long"))
    numbered = with_running_total(one, ["key"], "one", "place").drop("one")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = cut(numbered.withColumn("weight", weight))
    total, all_weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    if not all_weight:
        return weighed.withColumn("target", F.lit(0.0)).drop("place", "weight")
    total = share * total
    level, cap = total / all_weight, F.lit(MOST_COPIES) * F.col("source_size")
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        taken, left = weighed.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        after = (total - (taken or 0)) / left if left else level
        if after <= level:
            break
        level = after
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(level))
    return weighed.withColumn("target", target).drop("place", "weight")


def tilts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Multiplier of every source: key, scale, tilt; the rate of a document is min(2, exp(tilt * size / scale)).

    ``sizes(key, size, n)`` counts documents by size, ``targets(key, target, source_size)``. Each iteration joins the
    multipliers to the sizes, sums expected words and their derivative per source, and takes a Newton step on the
    logarithm of the words, kept within a bracket. Only whether any error is left goes to the driver; that the steps do not
    suffice is an error. Sources whose target is
    all the words twice have no finite multiplier; their tilt is infinite and their rate 2.
    """
    used = sizes.where(F.col("size") > 0)
    scale = used.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    infinite = float("inf")
    state = cut(
        targets.where(F.col("source_size") > 0).join(scale, "key").select(
            "key",
            "target",
            "scale",
            F.lit(-infinite).alias("low"),
            F.lit(infinite).alias("high"),
            F.when(F.col("target") >= MOST_COPIES * F.col("source_size"), F.lit(infinite)).otherwise(0.0).alias("tilt"),
            F.lit(infinite).alias("error"),
        )
    )
    for _ in range(STEPS):
        x = F.col("size") / F.col("scale")
        power = F.when(F.col("tilt") == infinite, infinite).otherwise(F.col("tilt") * x)
        top = F.log(F.lit(float(MOST_COPIES)))
        rate = F.exp(F.least(power, top))
        words = F.col("n") * F.col("size") * rate
        sums = used.join(state.select("key", "tilt", "scale"), "key").groupBy("key").agg(
            F.sum(words).alias("words"), F.sum(F.when(power < top, words * x).otherwise(0.0)).alias("slope")
        )
        tilt, ratio = F.col("tilt"), F.col("words") / F.col("target")
        low = F.when(ratio < 1, tilt).otherwise(F.col("low"))
        high = F.when(ratio < 1, F.col("high")).otherwise(tilt)
        step = tilt - F.log(ratio) * F.col("words") / F.col("slope")
        middle = (
            F.when((low == -infinite) & (high == infinite), F.lit(0.0))
            .when(low == -infinite, high * 2 - 1)
            .when(high == infinite, low * 2 + 1)
            .otherwise((low + high) / 2)
        )
        inside = (F.col("slope") > 0) & (step > low) & (step < high)
        done = (F.abs(ratio - 1) <= NEAR) | (tilt == infinite)
        state = cut(
            state.join(sums, "key").select(
                "key",
                "target",
                "scale",
                low.alias("low"),
                high.alias("high"),
                F.when(done, tilt).when(inside, step).otherwise(middle).alias("tilt"),
                F.when(done, 0.0).otherwise(F.abs(ratio - 1)).alias("error"),
            )
        )
        if not state.where(F.col("error") > 0).take(1):
            return state.select("key", "scale", "tilt")
    raise RuntimeError(f"multipliers still off their targets after {STEPS} steps")


def _with_source(docs: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """Join the one row of each document's source to it; ``part`` deals a source's documents out.

    A source may hold a third of all documents, so its row is there once per part, and parts are joined.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    dealt = docs.withColumn("part", F.pmod("row", F.lit(PARTS)).cast("int"))
    return dealt.join(sources.select("*", every), ["key", "part"], how)


def _closer(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Change one document of every source by one copy where that brings its words nearer to the target."""
    taken = docs.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
    short = targets.join(taken, "key").select("key", (F.col("target") - F.col("taken")).alias("short"))
    up = F.when(F.col("short") > 0, 1).otherwise(-1)
    left = F.abs(F.abs(F.col("short")) - F.col("size"))
    free = F.when(F.col("short") > 0, F.col("copies") < MOST_COPIES).otherwise(F.col("copies") > 0)
    better = _with_source(docs, short).where(free & (F.col("size") > 0) & (left < F.abs("short")))
    order = F.struct(left.alias("left"), F.col("mark"), F.col("doc_id"), F.col("row"), up.alias("up"))
    of_parts = better.groupBy("key", "part").agg(F.min(order).alias("best"))
    chosen = of_parts.groupBy("key").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"), F.col("best.up").alias("up"))
    return docs.join(chosen, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("up", F.lit(0))).drop("up")


def mixed_copies(docs: DataFrame) -> DataFrame:
    """Copies of every row of ``docs(doc_id, text, source)``: row, doc_id, mark, size, source_size, target, copies.

    ``row`` numbers the rows of this run; a column ``mark`` of ``docs`` breaks ties, else a hash of the id does. Documents without words have size 0 and one copy, which takes nothing.
    """
    key = source_key(F.col("source"))
    mark = F.col("mark") if "mark" in docs.columns else F.xxhash64("doc_id")
    sized = cut(
        docs.select("doc_id", key.alias("key"), word_count(F.col("text")).alias("size"), mark.alias("mark"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sources))
    sizes = cut(sized.groupBy("key", "size").agg(F.count("*").alias("n")))
    found = tilts(sizes, targets)
    top = F.log(F.lit(float(MOST_COPIES)))
    power = F.when(F.col("tilt") == float("inf"), top).otherwise(F.col("tilt") * F.col("size") / F.col("scale"))
    rate = F.coalesce(F.round(F.exp(F.least(power, top)) * UNIT), F.lit(UNIT)).cast("long")
    rated = _with_source(sized, found, "left").select(
        *sized.columns, F.when(F.col("size") == 0, F.lit(UNIT)).otherwise(rate).alias("rate")
    )
    # Parts of a copy add up along the documents of a source by size, so errors of neighbours cancel out.
    parts = rated.withColumn("part", F.col("rate") % UNIT).withColumn("down", -F.col("size"))
    along = with_running_total(parts, ["key", "down", "mark", "doc_id", "row"], "part", "before")
    more = F.floor((F.col("before") + F.col("part") + UNIT // 2) / UNIT) - F.floor((F.col("before") + UNIT // 2) / UNIT)
    whole = F.floor(F.col("rate") / UNIT)
    rounded = along.select(*sized.columns, F.least(whole + more, F.lit(MOST_COPIES)).cast("long").alias("copies"))
    for _ in range(FIXES):
        rounded = cut(_closer(rounded, targets))
    return _with_source(rounded, targets).select("row", "doc_id", "mark", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """Words the mix takes of every row of ``docs(doc_id, text, source)``.

    Null and empty texts have size 0 and take nothing. A null source is a source of its own, the last. Rows that repeat a
    doc_id are documents each. No document is taken more than twice. An empty table gives no rows; other columns are
    ignored. Equal input gives equal results: ties go by a hash of doc_id, then by doc_id.

    Returns doc_id, size, source_size, target, taken.
    """
    copies = mixed_copies(docs.select("doc_id", "text", "source"))
    return copies.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns.

    Rows without words, which cost nothing, stay once. Rows that are equal in all columns share their copies.
    """
    names = docs.columns
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    marked = docs.select("doc_id", "text", "source", mark.alias("mark"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    copies = mixed_copies(marked.drop("_row")).groupBy("doc_id", "mark").agg(F.sum("copies").alias("copies"))
    taken = copies.where(F.col("copies") > 0).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "copies")
    rows = marked.select("doc_id", "mark", "_row").dropDuplicates(["doc_id", "mark"])
    joined = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    return joined.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")
