"""Training targets and the chronological train / validation split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.functions import expressions as X
from frostline.operators.series import (
    DEFAULT_SPLIT,
    GroupSizes,
    OrderedGroups,
    SplitPolicy,
    lay_out,
)

TARGETS = {
    "y_temp": S.STORAGE,
    "y_geo": S.GEOFENCE,
    "y_tamper": S.TAMPER,
    "y_attack": S.CYBER,
}
VALIDATION = "is_validation"


def add_targets(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {y: F.expr(X.is_label(S.LABEL, name)) for y, name in TARGETS.items()}
    )


def attack_rows(df: DataFrame) -> DataFrame:
    """Normal and attacked rows only: what the attack detector learns from."""
    return df.where(F.col(S.LABEL).isin(S.NORMAL, S.CYBER))


def without_augmented(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_augmented") == 0)


def mark_validation(
    df: DataFrame,
    fraction: float = 0.2,
    *,
    order_by: str = S.ROW_ID,
    policy: SplitPolicy = DEFAULT_SPLIT,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """``is_validation`` = 1 on the last rows of each device: the first
    floor((1 - fraction) * n), at least one, train."""
    g = lay_out(
        df.where(F.col(S.DEVICE).isNotNull()),
        [S.DEVICE],
        (S.RECEIVED, order_by),
        policy=policy,
        sizes=sizes,
    )
    return add_validation(g, fraction).finish()


def add_validation(g: OrderedGroups, fraction: float = 0.2) -> OrderedGroups:
    """`mark_validation` on reports that are laid out already."""
    g = g.running_totals(_at="1")
    cut = f"greatest(floor({1.0 - fraction!r}D * _at_all), 1)"
    return g.add(**{VALIDATION: f"CAST(_at > {cut} AS INT)"})


SIDE = "side"
TRAIN, CALIBRATE, CHOOSE = 0, 1, 2


def mark_sides(
    df: DataFrame,
    fractions: tuple[float, float] = (0.6, 0.2),
    *,
    order_by: str = S.ROW_ID,
    policy: SplitPolicy = DEFAULT_SPLIT,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """``side`` in time order per device: the first rows (at least one) train,
    the next calibrate, the rest choose thresholds, so that no row both shapes a
    score and is judged by it."""
    g = lay_out(
        df.where(F.col(S.DEVICE).isNotNull()),
        [S.DEVICE],
        (S.RECEIVED, order_by),
        policy=policy,
        sizes=sizes,
    )
    return add_sides(g, fractions).finish()


def add_sides(g: OrderedGroups, fractions: tuple[float, float] = (0.6, 0.2)) -> OrderedGroups:
    """`mark_sides` on reports that are laid out already."""
    g = g.running_totals(_at="1")
    first, second = fractions
    train = f"greatest(floor({first!r}D * _at_all), 1)"
    until = f"greatest(floor({first + second!r}D * _at_all), 1)"
    side = f"IF(_at <= {train}, {TRAIN}, IF(_at <= {until}, {CALIBRATE}, {CHOOSE}))"
    return g.add(**{SIDE: side})


def three_sides(marked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to train on, to calibrate on, and to choose thresholds on."""
    return tuple(
        marked.where(F.col(SIDE) == side).drop(SIDE) for side in (TRAIN, CALIBRATE, CHOOSE)
    )


def train_and_validation(
    marked: DataFrame, *, fallback_fraction: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """The two sides of a marked table. Where every device has a single row and
    nothing is left to validate on, a hash-chosen share of the training rows is
    used for it as well."""
    train = marked.where(F.col(VALIDATION) == 0).drop(VALIDATION)
    held_out = marked.where(F.col(VALIDATION) == 1).drop(VALIDATION)
    if held_out.isEmpty():
        held_out = train.sample(fraction=fallback_fraction, seed=seed)
    return train, held_out
