"""Feature vectors, standardisation and stratified folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.functions import expressions as X
from frostline.operators.lookups import attach_per_device
from frostline.operators.series import (
    DEFAULT_SPLIT,
    GroupSizes,
    SplitPolicy,
    lay_out,
)


def assemble(df: DataFrame, features: Sequence[str], output: str) -> DataFrame:
    """A vector column of the features, missing ones as 0."""
    filled = {f"_in_{f}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}
    assembler = VectorAssembler(inputCols=list(filled), outputCol=output)
    return assembler.transform(df.withColumns(filled)).drop(*filled)


@dataclass(frozen=True)
class Scaling:
    """Mean and population deviation per feature; constant ones scale by 1."""

    mean: dict[str, float]
    deviation: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str]) -> Scaling:
        filled = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}
        row = df.agg(
            *[F.avg(c).alias(f"m_{f}") for f, c in filled.items()],
            *[F.stddev_pop(c).alias(f"s_{f}") for f, c in filled.items()],
        ).first()
        return cls(
            {f: row[f"m_{f}"] or 0.0 for f in features},
            {f: row[f"s_{f}"] or 1.0 for f in features},
        )

    def apply(self, df: DataFrame) -> DataFrame:
        """Adds ``z_<feature>`` columns."""
        return df.withColumns(
            {
                f"z_{f}": F.expr(
                    f"(coalesce(CAST({f} AS DOUBLE), 0D) - {X.real(m)})"
                    f" / {X.real(self.deviation[f])}"
                )
                for f, m in self.mean.items()
            }
        )


def stratified_folds(
    df: DataFrame,
    target: str,
    folds: int = 3,
    *,
    order_by: str = S.ROW_ID,
    policy: SplitPolicy = DEFAULT_SPLIT,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Adds ``fold``: per class, equal contiguous stretches of the rows taken
    device after device in time order. A row's place in its class is its place
    within the device plus the rows of the devices before."""
    g = lay_out(
        df, [S.DEVICE, target], (S.RECEIVED, order_by), policy=policy, sizes=sizes
    ).running_totals(place="1")
    counts = (
        df.groupBy(S.DEVICE, target)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("turn", F.xxhash64(S.DEVICE))
    )
    turns = lay_out(counts, [target], ("turn", S.DEVICE), policy=policy)
    offsets = (
        turns.running_totals(upto="n")
        .finish()
        .select(
            S.DEVICE,
            target,
            (F.col("upto") - F.col("n")).alias("earlier"),
            F.col("upto_all").alias("in_class"),
        )
    )
    placed = attach_per_device(
        g.finish(), offsets, [S.DEVICE, target], policy=policy
    )
    fold = f"CAST(floor({folds} * (earlier + place - 1) / in_class) AS INT)"
    return placed.withColumn("fold", F.expr(fold)).drop(
        "place", "place_all", "earlier", "in_class"
    )
