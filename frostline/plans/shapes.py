"""Output columns of the registered queries, the same for both engines.

A shape names the columns in order. Doubles that depend on summation order are
rounded to the given number of places; None leaves a column as it is. SINGLE
cuts a double to single precision: for products of short decimals, which are
often half-way cases in decimal rounding but never in binary.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SINGLE = -1
Shape = dict[str, int | None]


def exact(*names: str) -> Shape:
    return dict.fromkeys(names)


def rounded(names: Iterable[str], places: int = 6) -> Shape:
    return dict.fromkeys(names, places)


def _column(name: str, places: int | None) -> Column:
    if places is None:
        return F.col(name)
    value = F.col(name).cast("double")
    if places == SINGLE:
        return value.cast("float").cast("double").alias(name)
    return F.round(value, places).alias(name)


def _column_sql(name: str, places: int | None) -> str:
    if places is None:
        return f'"{name}"'
    if places == SINGLE:
        return f'CAST(CAST("{name}" AS FLOAT) AS DOUBLE) AS "{name}"'
    # adding 0 turns a negative zero into a plain one
    return f'round(CAST("{name}" AS DOUBLE), {places}) + 0e0 AS "{name}"'


def present(df: DataFrame, shape: Shape) -> DataFrame:
    return df.select(*[_column(name, places) for name, places in shape.items()])


def present_sql(shape: Shape, ctes: str, source: str) -> str:
    columns = ", ".join(_column_sql(name, places) for name, places in shape.items())
    return f"WITH RECURSIVE {ctes.strip()}\nSELECT {columns}\nFROM {source}"
