"""Daily runs into one set of tables.

Three tables lie side by side, each in one folder per day: the predictions, their
cells (`operators/cells.py`) and one row of totals with a sketch of the day's
devices. A run replaces the days it holds and leaves all others alone (dynamic
partition overwrite: new files are staged and swapped in when the job commits, so
a lost executor or run leaves the old day). Everything else is derived from cells
or totals, without reading predictions again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.operators import cells as C
from frostline.operators.storage import materialise
from frostline.sources import results

CELLS = "day_cells"
TOTALS = "day_totals"


def save_days(decided: DataFrame, base: str) -> None:
    """Store decided rows; the days in them replace stored days. Rows without a
    time go to the predictions' folder without a day. ``decided`` is read twice:
    pass a written table."""
    results.write_predictions(decided, base)
    # the cells are written once and feed the totals
    cells = materialise(C.day_cells(decided))
    results.write_by_day(cells, f"{base}/{CELLS}")
    results.write_by_day(C.day_totals(cells), f"{base}/{TOTALS}")


def add_late(rows: DataFrame, base: str, key: tuple[str, ...] = (S.DEVICE, S.ROW_ID)) -> None:
    """Store decided rows that came after their days were stored. Only these days
    are read and rewritten. A row with the key of a stored one of these days
    replaces it, so a repeated call changes nothing."""
    spark = rows.sparkSession
    # repeated keys within the batch keep one row, the same one every time
    late = materialise(rows.withColumn(C.DATE, F.to_date(S.RECEIVED)))
    everything = F.struct(*[F.col(c).cast("string") for c in sorted(late.columns)])
    late = late.groupBy(*key).agg(F.max_by(F.struct(*late.columns), everything).alias("_row")).select("_row.*")
    # one row per calendar day
    days = [r[0] for r in late.select(C.DATE).distinct().collect()]
    touched = F.col(C.DATE).isin([d for d in days if d is not None])
    if None in days:
        touched = touched | F.col(C.DATE).isNull()
    try:
        stored = results.read_predictions(spark, base).where(touched)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = late.limit(0)
    same = [stored[k].eqNullSafe(late[k]) for k in key]
    kept = stored.join(late.select(*key), same, "left_anti")
    # written before the days it was read from are replaced
    merged = materialise(kept.unionByName(late, allowMissingColumns=True))
    save_days(merged, base)


def _between(df: DataFrame, between: tuple[str, str] | None) -> DataFrame:
    if between is None:
        return df
    return df.where(F.col(C.DATE).between(*(F.to_date(F.lit(b)) for b in between)))


def read_cells(spark: SparkSession, base: str, between: tuple[str, str] | None = None) -> DataFrame:
    """Stored cells of all days or of an inclusive range; other days' files are
    not opened."""
    return _between(spark.read.parquet(f"{base}/{CELLS}"), between)


def read_totals(spark: SparkSession, base: str, between: tuple[str, str] | None = None) -> DataFrame:
    return _between(spark.read.parquet(f"{base}/{TOTALS}"), between)


def dashboard(spark: SparkSession, base: str, between: tuple[str, str] | None = None) -> DataFrame:
    return C.dashboard_of(read_cells(spark, base, between))


def overview(spark: SparkSession, base: str, between: tuple[str, str] | None = None) -> DataFrame:
    """Devices (estimated), rows, prevalence and alerts of any date range."""
    return C.overview_of(read_totals(spark, base, between))
