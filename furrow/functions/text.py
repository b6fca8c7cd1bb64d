"""Text normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators, on either end.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_NOT_ALNUM = r"[^\p{L}\p{N}]"
_PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` written and computed once.

    A column expression that mentions its argument several times grows with every nesting; a lambda
    variable keeps it flat.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends (``trim`` only removes blanks)."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def blank_to_null(text: Column) -> Column:
    """Stripped text, NULL when nothing is left."""
    return bound(strip(text), lambda t: F.when(t != "", t))


def key_text(text: Column) -> Column:
    """Comparison key: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(strip(text)), _NOT_ALNUM, "")


def label_text(text: Column) -> Column:
    """Class label for lookups: stripped, lower case, ``_`` and ``-`` as blanks."""
    return F.translate(F.lower(strip(text)), "_-", "  ")


def zero_pad(text: Column, width: int) -> Column:
    """Left-pad with zeros behind an optional sign; longer text is kept whole.

    ``lpad`` alone would cut text that is longer than ``width``.
    """

    def padded(t: Column) -> Column:
        zeros = F.repeat(F.lit("0"), F.lit(width) - F.length(t))
        return F.regexp_replace(F.concat(zeros, t), r"^(0*)([+-])", "$2$1")

    return bound(text, padded)


def numeric_code(value: Column, width: int) -> Column:
    """Zero-padded code of a number or text; NULL or blank gives an empty string.

    Numbers lose their fraction (``3.0`` -> ``003``); text that is no number is padded as it is.
    """

    def coded(text: Column) -> Column:
        number = F.when(text.rlike(_PLAIN_NUMBER), text).try_cast("double")
        whole = bound(number, lambda x: F.when(F.abs(x) < 1e15, x.cast("long"))).cast("string")
        return zero_pad(F.coalesce(whole, text), width)

    return F.coalesce(bound(blank_to_null(value.cast("string")), coded), F.lit(""))


def fips_code(value: Column, width: int = 5) -> Column:
    """County code as padded text; NULL when blank."""
    return zero_pad(blank_to_null(value.cast("string")), width)
