"""Boosted-tree detectors with calibrated scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.operators.learning.matrix import assemble, stratified_folds
from frostline.operators.split import attack_rows
from frostline.operators.storage import materialise
from frostline.settings import BoostPolicy

OPERATIONAL = {
    "temp": (S.TEMP_FEATURES, "y_temp"),
    "geo": (S.GEO_FEATURES, "y_geo"),
    "tamper": (S.TAMPER_FEATURES, "y_tamper"),
}


# the tree learner holds its points by partition and every task reads one whole
TASK_ROWS = 150_000


def spread(rows: DataFrame, limit: int = TASK_ROWS) -> DataFrame:
    """rows in partitions of about ``limit`` rows. Files of repetitive columns are
    small for the rows they hold, so file splits alone would let a partition grow
    with the table. Tables whose partitions are small enough stay as they are."""
    pieces = ceil(rows.count() / limit)
    return rows.repartition(pieces) if pieces > rows.rdd.getNumPartitions() else rows


def _fit_trees(
    rows: DataFrame, target: str, iterations: int, policy: BoostPolicy, weight: str | None
) -> GBTClassificationModel:
    trainer = GBTClassifier(
        featuresCol="_x",
        labelCol=target,
        maxIter=iterations,
        maxDepth=policy.max_depth,
        stepSize=policy.step_size,
        maxBins=policy.max_bins,
        minInstancesPerNode=policy.min_instances,
        seed=policy.seed,
        checkpointInterval=10,
    )
    if weight:
        trainer = trainer.setWeightCol(weight)
    if policy.held_back:
        share = F.pmod(F.xxhash64(S.ROW_ID, F.lit(policy.seed)), F.lit(10_000))
        rows = rows.withColumn("_held_back", share < int(10_000 * policy.held_back))
        trainer = trainer.setValidationIndicatorCol("_held_back")
    return trainer.fit(spread(rows))


def _raw_score(model: GBTClassificationModel, df: DataFrame, name: str) -> DataFrame:
    """The model's uncalibrated margin as one plain column."""
    scored = (
        model.setPredictionCol("")
        .setProbabilityCol("")
        .setRawPredictionCol("_margins")
        .transform(df)
    )
    return scored.withColumn(name, vector_to_array("_margins")[1]).drop("_margins")


@dataclass(frozen=True)
class CrossFitted:
    """Trees fitted on all folds but one, calibrated on that one, per fold."""

    features: tuple[str, ...]
    members: tuple[tuple[GBTClassificationModel, IsotonicRegressionModel], ...]
    digits: int | None = None

    def score(self, df: DataFrame, output: str) -> DataFrame:
        """Adds the mean calibrated probability of the members."""
        columns = df.columns
        rows = assemble(df, self.features, "_x")
        parts = []
        for n, (trees, calibrator) in enumerate(self.members):
            rows = _raw_score(trees, rows, f"_raw{n}")
            rows = rows.withColumn(f"_p{n}", _squash(f"_raw{n}", self.digits))
            calibrator = calibrator.setFeaturesCol(f"_p{n}").setPredictionCol(f"_c{n}")
            rows = calibrator.transform(rows)
            parts.append(F.col(f"_c{n}"))
        mean = sum(parts[1:], parts[0]) / F.lit(float(len(parts)))
        return rows.select(*[c for c in columns if c != output], mean.alias(output))


def _squash(margin: str, digits: int | None):
    """The trees' own probability, exact or on a grid."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * F.col(margin)))
    return p if digits is None else F.round(p, digits)


def fit_operational(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    policy: BoostPolicy = BoostPolicy(),
) -> CrossFitted:
    """One-against-rest detector with isotonic cross-fitted calibration. Equal
    scores become one weighted point; the isotonic fit then pools range by range
    before it gathers what is left."""
    folded = stratified_folds(train, target, policy.folds)
    rows = materialise(
        assemble(folded, features, "_x").select(S.ROW_ID, "_x", target, "fold")
    )
    members = []
    for fold in range(policy.folds):
        base = rows.where(F.col("fold") != fold)
        trees = _fit_trees(base, target, policy.operational_iterations, policy, None)
        left_out = _raw_score(trees, rows.where(F.col("fold") == fold), "_raw")
        points = (
            left_out.withColumn("_p", _squash("_raw", policy.calibration_digits))
            .groupBy("_p")
            .agg(F.avg(target).alias("_rate"), F.count(F.lit(1)).cast("double").alias("_w"))
        )
        isotonic = IsotonicRegression(
            featuresCol="_p", labelCol="_rate", weightCol="_w", predictionCol="_c"
        )
        members.append((trees, isotonic.fit(points)))
    return CrossFitted(tuple(features), tuple(members), policy.calibration_digits)


@dataclass(frozen=True)
class SigmoidCalibrated:
    """Trees with a logistic curve over their margin."""

    features: tuple[str, ...]
    trees: GBTClassificationModel
    curve: LogisticRegressionModel

    def score(self, df: DataFrame, output: str) -> DataFrame:
        columns = [c for c in df.columns if c != output]
        rows = _raw_score(self.trees, assemble(df, self.features, "_x"), "_raw")
        slope, start = float(self.curve.coefficients[0]), float(self.curve.intercept)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * F.col("_raw") + F.lit(start))))
        return rows.select(*columns, p.alias(output))


def fit_sigmoid(scored: DataFrame, margin: str, target: str) -> LogisticRegressionModel:
    """Platt scaling. His smoothed targets are exact as weights: each row counts
    once as positive with weight t and once as negative with weight 1 - t."""
    row = scored.agg(
        F.sum(target).alias("pos"), F.sum(1 - F.col(target)).alias("neg")
    ).first()
    pos, neg = row["pos"] or 0, row["neg"] or 0
    aim = F.when(F.col(target) == 1, (pos + 1.0) / (pos + 2.0)).otherwise(1.0 / (neg + 2.0))
    both = scored.select(
        F.col(margin),
        F.explode(
            F.array(
                F.struct(F.lit(1.0).alias("y"), aim.alias("w")),
                F.struct(F.lit(0.0).alias("y"), (F.lit(1.0) - aim).alias("w")),
            )
        ).alias("_side"),
    ).select(F.col(margin), "_side.y", "_side.w")
    rows = assemble(both, [margin], "_margin")
    return LogisticRegression(
        featuresCol="_margin",
        labelCol="y",
        weightCol="w",
        regParam=0.0,
        standardization=False,
        maxIter=100,
    ).fit(rows)


def fit_attack(
    train: DataFrame,
    validation: DataFrame,
    policy: BoostPolicy = BoostPolicy(),
    features: Sequence[str] = S.ATTACK_FEATURES,
) -> SigmoidCalibrated:
    """Attack against normal, attacks weighted up, calibrated on the rows held
    out in time."""
    rows = materialise(
        assemble(attack_rows(train), features, "_x").select(
            S.ROW_ID,
            "_x",
            "y_attack",
            F.when(F.col("y_attack") == 1, policy.attack_weight).otherwise(1.0).alias("_w"),
        )
    )
    trees = _fit_trees(rows, "y_attack", policy.attack_iterations, policy, "_w")
    held_out = _raw_score(trees, assemble(attack_rows(validation), features, "_x"), "_raw")
    curve = fit_sigmoid(held_out.select("_raw", "y_attack"), "_raw", "y_attack")
    return SigmoidCalibrated(tuple(features), trees, curve)
