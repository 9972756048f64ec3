"""Scalar operations as Spark SQL fragments.

Operators hand many expressions at once to ``withColumns``; text keeps them
readable and is parsed inside the JVM in one go. Every fragment is built from
native functions, none needs a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline import settings as S


def real(value: float) -> str:
    """A double literal (a bare SQL 0.5 would be a decimal)."""
    return f"{float(value)!r}D"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(col: str, values: Iterable[str]) -> str:
    return f"{col} IN ({', '.join(text(v) for v in values)})"


def as_flag(predicate: str) -> str:
    """Predicate as 0/1 where unknown counts as 0."""
    return f"CAST(coalesce({predicate}, false) AS INT)"


def zero_if_null(value: str) -> str:
    return f"coalesce({value}, 0D)"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every floating column with NaN turned to NULL, so that comparisons with
    a missing measure are unknown instead of true."""
    floating = {
        f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floating) if floating else df


def clip(value: str, low: float, high: float) -> str:
    """Into [low, high]; a null stays null."""
    return (
        f"IF(({value}) IS NULL, NULL,"
        f" greatest({real(low)}, least({real(high)}, {value})))"
    )


def round_half_even(value: str, places: int) -> str:
    return f"bround({value}, {places})"


def seconds_between(start: str, end: str) -> str:
    return f"(timestampdiff(MICROSECOND, {start}, {end}) / 1e6D)"


def minutes_between(start: str, end: str) -> str:
    return f"(timestampdiff(MICROSECOND, {start}, {end}) / 6e7D)"


def great_circle_m(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Haversine distance in metres."""
    chord = (
        f"pow(sin(radians({lat2} - {lat1}) / 2D), 2D)"
        f" + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2D), 2D)"
    )
    # rounding can push the chord of antipodal points just above 1; a null
    # point must stay unknown, which least() alone would turn into 1
    return (
        f"({real(2 * S.EARTH_RADIUS_M)}"
        f" * asin(sqrt(IF(({chord}) > 1D, 1D, {chord}))))"
    )


def content_key(lat: str, lon: str, temp: str, humidity: str) -> str:
    """The rounded reading as text, missing parts written 'nan'."""
    parts = [
        round_half_even(lat, 5),
        round_half_even(lon, 5),
        round_half_even(temp, 1),
        round_half_even(humidity, 1),
    ]
    return "concat_ws('|', " + ", ".join(
        f"coalesce(CAST({p} AS STRING), 'nan')" for p in parts
    ) + ")"


def operational_class(label: str) -> str:
    """Operational labels stay; everything else, cyber included, is normal."""
    return f"IF({one_of(label, S.OPERATIONAL_LABELS)}, {label}, {text(S.NORMAL)})"


def is_label(label: str, name: str) -> str:
    return as_flag(f"{label} = {text(name)}")


def is_anomaly(label: str) -> str:
    """1 for any label but normal; a missing label is not 'normal' either."""
    return f"CAST(coalesce({label} <> {text(S.NORMAL)}, true) AS INT)"


def unit_flag(value: str) -> str:
    """A prediction column forced into {0, 1}; missing is 0."""
    return f"least(1, greatest(0, coalesce(CAST({value} AS INT), 0)))"


def hour_of(name: str) -> str:
    """The full hour of a time without zone, whatever the session's zone."""
    fields = ", ".join(f"{part}(`{name}`)" for part in ("year", "month", "day", "hour"))
    return f"make_timestamp_ntz({fields}, 0, 0)"
