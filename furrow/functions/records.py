"""Values as they may appear in a JSON record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.numeric import finite_or_null
from furrow.functions.text import blank_to_null

_ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def json_safe(value: Column, dtype: T.DataType) -> Column:
    """Stripped text (blank is NULL), finite numbers, ISO dates; containers are cleaned inside."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return blank_to_null(value)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return finite_or_null(value)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, _ISO_SECONDS)
    if isinstance(dtype, T.DateType):
        return value.cast("string")
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        texts = F.transform_keys(value, lambda k, _: k.cast("string"))
        return F.transform_values(texts, lambda _, v: json_safe(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [json_safe(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)
