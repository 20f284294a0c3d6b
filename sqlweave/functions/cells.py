"""One textual form per result cell, so that 1 equals 1.0 and '1' does not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Every integral double below this magnitude is exact as a long.
_EXACT = float(2**53)


def _double_text(number: Column) -> Column:
    """Whole numbers as digits, so that they equal the same integer or decimal."""
    whole = number == F.floor(number)
    small = F.when(F.abs(number) < F.lit(_EXACT), number.cast("long").cast("string"))
    large = F.when(F.abs(number) < F.lit(1e37), number.try_cast("decimal(38,0)").cast("string"))
    return F.when(whole, F.coalesce(small, large, number.cast("string"))).otherwise(number.cast("string"))


def canonical_cell(value: Column, dtype: T.DataType) -> Column:
    """Tagged text: `n:` numeric, `s:` anything else, NULL stays NULL."""
    if isinstance(dtype, _INTEGRAL):
        return F.concat(F.lit("n:"), value.cast("string"))
    if isinstance(dtype, T.BooleanType):
        return F.concat(F.lit("n:"), value.cast("int").cast("string"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.concat(F.lit("n:"), _double_text(value.cast("double")))
    if isinstance(dtype, T.DecimalType):
        # What a double holds exactly is written like the double, anything else digit by digit.
        near = value.cast("double")
        fits = F.coalesce(near.try_cast(dtype) == value, F.lit(False))
        digits = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return F.concat(F.lit("n:"), F.when(fits, _double_text(near)).otherwise(digits))
    return F.concat(F.lit("s:"), value.cast("string"))


def row_cells(df, columns: list[str] | None = None) -> Column:
    """The canonical cells of a row, in column order, as array<string>."""
    fields = df.schema.fields if columns is None else [df.schema[c] for c in columns]
    return F.array(*[canonical_cell(F.col(f"`{f.name}`"), f.dataType) for f in fields])
