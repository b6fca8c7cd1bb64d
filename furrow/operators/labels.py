"""County yield labels: row choice, standard fields, anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.codes import (
    LABEL_COLUMNS,
    LABEL_UNITS,
    SPLITS,
    canonical_crop,
    crop_named,
    fips_list,
    label_column,
    label_unit,
    split_of_year,
)
from furrow.functions.numeric import finite_or_null, flag
from furrow.functions.records import json_safe
from furrow.functions.text import blank_to_null, bound, fips_code, numeric_code, strip
from furrow.operators.joins import with_group_stats

# --- fixed values: record fields ----------------------------------------------------------------
ENVELOPE_FIELDS = (
    "split", "county_id", "crop_type", "year", "target_kind", "target_value", "target_unit",
    "source_path",
)
TEXT_FIELDS = (
    "state_name", "county_name", "commodity_desc", "agg_level_desc", "domain_desc", "source_desc",
)
CODE_FIELDS = (("state_ansi", 2), ("county_ansi", 3))
GEO_FIELDS = ("state_ansi", "county_ansi", "state_name", "county_name")
_NOT_FEATURES = {*ENVELOPE_FIELDS, *TEXT_FIELDS, *(name for name, _ in CODE_FIELDS)}


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _present(value: Column, df: DataFrame, name: str) -> Column:
    """Not NULL and, for fractions, not NaN."""
    if df.schema[name].dataType.typeName() in ("float", "double"):
        return value.isNotNull() & ~F.isnan(value)
    return value.isNotNull()


def choose_label_rows(
    df: DataFrame,
    target_column: str,
    scope: Sequence[str] = ("source_path",),
) -> DataFrame:
    """Labelled rows, narrowed to county rows and then to total rows where a scope has any.

    One pass per scope finds out what exists on each level; the answers (one row per source file) are
    joined back, so a file of any size is never gathered in one task.
    """
    if target_column not in df.columns:
        raise ValueError(f"label column {target_column!r} is missing")
    labelled = df.filter(_present(_quoted(target_column), df, target_column))

    def says(column: str, word: str) -> Column:
        return flag(F.upper(F.col(column).cast("string")) == word)

    has_level, has_domain = "agg_level_desc" in df.columns, "domain_desc" in df.columns
    if not has_level and not has_domain:
        return labelled
    county = says("agg_level_desc", "COUNTY") if has_level else F.lit(True)
    total = says("domain_desc", "TOTAL") if has_domain else F.lit(True)
    marked = with_group_stats(
        labelled,
        scope,
        _any_county=F.max(county),
        _any_total=F.max(total),
        _any_county_total=F.max(county & total),
    )
    any_total = F.when(F.col("_any_county"), F.col("_any_county_total")).otherwise(F.col("_any_total"))
    return marked.filter((county | ~F.col("_any_county")) & (total | ~any_total)).drop(
        "_any_county", "_any_total", "_any_county_total"
    )


def county_id_of(columns: Sequence[str]) -> Column:
    """Five-digit county code from ``county_id``, else from the state and county codes."""
    parts = F.lit(None).cast("string")
    if {"state_ansi", "county_ansi"} <= set(columns):
        parts = F.concat(*[numeric_code(F.col(name), width) for name, width in CODE_FIELDS])
    if "county_id" in columns:
        return F.coalesce(fips_code(F.col("county_id")), parts)
    return parts


def target_number(value: Column) -> Column:
    """Finite label value, NULL when the cell holds no such number."""
    return bound(strip(value.cast("string")).try_cast("double"), finite_or_null)


def target_problem(value: Column) -> Column:
    """Why a label cannot be used, NULL when it can."""

    def problem(text: Column) -> Column:
        number = text.try_cast("double")
        return (
            F.when(text.isNull(), F.lit("missing"))
            .when(number.isNull(), F.lit("not numeric"))
            .when(finite_or_null(number).isNull(), F.lit("not finite"))
        )

    return bound(blank_to_null(value.cast("string")), problem)


def anchors(
    df: DataFrame,
    *,
    crop_type: str,
    target_kind: str,
    year: Column | int | None = None,
    split: Column | str | None = None,
    source_path: Column | str | None = None,
    scope: Sequence[str] = ("source_path",),
    on_bad_target: str = "drop",
) -> DataFrame:
    """Anchor records of one crop: envelope, text and code fields, and ``features``.

    ``year``, ``split`` and ``source_path`` default to the columns of that name (the split to that of
    the year). ``features`` is a struct of every other column with cleaned values; it is NULL when all
    of them are, and JSON output leaves its NULL fields out. Rows whose label is no finite number are
    left out (:func:`rejected_labels` lists them) unless ``on_bad_target='fail'``.
    """
    crop = crop_named(crop_type)
    target_column = LABEL_COLUMNS[crop, target_kind]
    as_column = lambda value, name: (
        F.col(name) if value is None else value if isinstance(value, Column) else F.lit(value)
    )
    df = df.withColumns(
        {
            "source_path": as_column(source_path, "source_path"),
            "year": as_column(year, "year").cast("int"),
        }
    )
    split_value = split_of_year(F.col("year")) if split is None else as_column(split, "split")
    chosen = choose_label_rows(df, target_column, scope)

    value = target_number(_quoted(target_column))
    if on_bad_target == "fail":
        problem = F.concat(F.lit(f"label {target_column!r} is "), target_problem(_quoted(target_column)))
        value = F.when(value.isNotNull(), value).otherwise(F.raise_error(problem))
    elif on_bad_target != "drop":
        raise ValueError(f"on_bad_target must be 'drop' or 'fail', not {on_bad_target!r}")

    have = set(df.columns)
    fields = {f.name: f.dataType for f in df.schema.fields}
    rest = {
        name: json_safe(_quoted(name), dtype)
        for name, dtype in fields.items()
        if name not in _NOT_FEATURES and name != target_column
    }
    features = []
    if rest:
        any_value = F.coalesce(*[c.cast("string") if _flat(fields[n]) else F.to_json(F.struct(c)) for n, c in rest.items()])
        struct = F.struct(*[c.alias(n) for n, c in rest.items()])
        features = [F.when(any_value.isNotNull(), struct).alias("features")]
    out = chosen.select(
        split_value.alias("split"),
        county_id_of(df.columns).alias("county_id"),
        F.lit(crop).alias("crop_type"),
        "year",
        F.lit(target_kind).alias("target_kind"),
        value.alias("target_value"),
        F.lit(LABEL_UNITS[crop, target_kind]).alias("target_unit"),
        "source_path",
        *[json_safe(F.col(n), fields[n]).alias(n) for n in TEXT_FIELDS if n in have],
        *[numeric_code(F.col(n), width).alias(n) for n, width in CODE_FIELDS if n in have],
        *features,
    )
    return out if on_bad_target == "fail" else out.filter(F.col("target_value").isNotNull())


def typed_text(text: Column) -> Column:
    """A cell as a whole number, a finite number or stripped text (VARIANT); NULL when blank."""

    def value(cell: Column) -> Column:
        number = cell.try_cast("double")
        return (
            F.when(cell.rlike(r"^[+-]?\d{1,18}$"), cell.try_cast("bigint").cast("variant"))
            .when(finite_or_null(number).isNotNull(), number.cast("variant"))
            .otherwise(cell.cast("variant"))
        )

    return bound(blank_to_null(text), value)


def _labelled_cells(rows: DataFrame, target_kind: str) -> DataFrame:
    """Envelope columns and the target cell of ``rows(source_path, year, split, crop_type, cells)``."""
    name = label_column(F.col("crop_type"), target_kind, on_unknown="fail")
    cell = lambda key: F.try_element_at("cells", key)
    missing = F.concat(F.lit("label column is missing: "), F.col("source_path"))
    has_target = F.map_contains_key("cells", F.col("_target_name"))
    named = rows.withColumn("_target_name", name)
    fields = {n: cell(F.lit(n)) for n in (*TEXT_FIELDS, "county_id", *[n for n, _ in CODE_FIELDS])}
    target = F.when(has_target, cell(F.col("_target_name"))).otherwise(F.raise_error(missing))
    return named.withColumns({**fields, "_target": target})


def anchors_of_cells(rows: DataFrame, target_kind: str) -> DataFrame:
    """Anchor records of label files of any crops and headers.

    ``rows`` has ``source_path``, ``year``, ``split``, ``crop_type`` and ``cells``, a map from column names to texts,
    so files with different columns are one table. ``features`` maps the remaining columns to numbers or text,
    judged cell by cell; it has no keys for missing values and is NULL when it would be empty.
    """
    chosen = choose_label_rows(_labelled_cells(rows, target_kind), "_target")
    extra = F.map_filter("cells", lambda k, _: ~k.isin(sorted(_NOT_FEATURES)) & (k != F.col("_target_name")))
    typed = F.map_filter(F.transform_values(extra, lambda _, v: typed_text(v)), lambda _, v: v.isNotNull())
    features = bound(typed, lambda m: F.when(F.size(m) > 0, m))
    out = chosen.select(
        "split",
        county_id_of(["county_id", "state_ansi", "county_ansi"]).alias("county_id"),
        canonical_crop(F.col("crop_type")).alias("crop_type"),
        "year",
        F.lit(target_kind).alias("target_kind"),
        target_number(F.col("_target")).alias("target_value"),
        label_unit(F.col("crop_type"), target_kind).alias("target_unit"),
        "source_path",
        *[blank_to_null(F.col(n)).alias(n) for n in TEXT_FIELDS],
        *[numeric_code(F.col(n), width).alias(n) for n, width in CODE_FIELDS],
        features.alias("features"),
    )
    return out.filter(F.col("target_value").isNotNull())


def rejected_cells(rows: DataFrame, target_kind: str) -> DataFrame:
    """Chosen label rows of ``rows`` whose value is no finite number: source_path, county_id, value, reason."""
    chosen = choose_label_rows(_labelled_cells(rows, target_kind), "_target")
    county = county_id_of(["county_id", "state_ansi", "county_ansi"])
    judged = chosen.select(
        "source_path", county.alias("county_id"), F.col("_target").alias("value"), target_problem(F.col("_target")).alias("reason")
    )
    return judged.filter(F.col("reason").isNotNull())


def _flat(dtype) -> bool:
    return dtype.typeName() not in ("array", "map", "struct")


def rejected_labels(
    df: DataFrame, target_column: str, scope: Sequence[str] = ("source_path",)
) -> DataFrame:
    """Chosen label rows whose value is no finite number, with the reason."""
    reason = target_problem(_quoted(target_column))
    return (
        choose_label_rows(df, target_column, scope)
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
    )


def in_counties(df: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Rows of the requested counties (a job parameter, so a short list)."""
    wanted = fips_list(codes)
    if not wanted:
        raise ValueError("at least one county code is needed")
    return df.filter(fips_code(F.col("county_id")).isin(wanted))


def usable_anchors(df: DataFrame) -> DataFrame:
    """Anchors with county, crop and year and a known split."""
    return df.dropna(subset=["county_id", "crop_type", "year"]).filter(F.col("split").isin(*SPLITS))


def county_ids(df: DataFrame) -> DataFrame:
    """Distinct padded county codes in order."""
    codes = df.select(fips_code(F.col("county_id")).alias("county_id"))
    return codes.filter(F.col("county_id").isNotNull()).distinct().orderBy("county_id")


def split_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per known split; splits without rows count zero."""
    counted = [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    wide = df.groupBy(*by).agg(*counted)
    pairs = F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("rows")) for s in SPLITS])
    return wide.select(*by, F.inline(pairs).alias("split", "rows"))
