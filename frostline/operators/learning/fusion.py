"""Risk fusion: balanced logistic regression over telemetry and posture."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.functions import expressions as X
from frostline.operators.learning.matrix import Scaling, assemble
from frostline.operators.storage import materialise

DECISION_THRESHOLD = 0.70


@dataclass(frozen=True)
class RiskFusion:
    scaling: Scaling
    model: LogisticRegressionModel

    def score(
        self,
        df: DataFrame,
        threshold: float = DECISION_THRESHOLD,
        output: str = "RF_prob",
        flag: str = "RF_pred",
    ) -> DataFrame:
        """The fitted curve as one native expression. (A fitted model carries its
        training summary, and with that the session, into every task.)"""
        columns = [c for c in df.columns if c not in (output, flag)]
        margin = F.lit(float(self.model.intercept))
        for f, weight in zip(self.scaling.mean, self.model.coefficients, strict=True):
            margin = margin + F.lit(float(weight)) * F.col(f"z_{f}")
        rows = self.scaling.apply(df).withColumn(output, F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)))
        return rows.select(*columns, output).withColumn(
            flag, F.expr(X.as_flag(f"{output} >= {X.real(threshold)}"))
        )


def fit_fusion(
    train: DataFrame,
    features: Sequence[str] = S.FUSION_FEATURES,
    *,
    max_iterations: int = 1000,
) -> RiskFusion:
    """Both classes weigh the same in total; the ridge penalty is that of an
    unaveraged loss with unit strength."""
    # scaling, counts and every step of the optimiser read what is written here
    labelled = materialise(
        train.select(*features, F.expr(X.is_anomaly(S.LABEL)).cast("double").alias("_y"))
    )
    scaling = Scaling.fit(labelled, features)
    row = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos")).first()
    n, pos = row["n"], row["pos"] or 0.0
    weight = F.when(F.col("_y") == 1, n / (2.0 * max(pos, 1.0))).otherwise(
        n / (2.0 * max(n - pos, 1.0))
    )
    names = [f"z_{f}" for f in features]
    rows = assemble(scaling.apply(labelled), names, "_x").select(
        "_x", "_y", weight.alias("_w")
    )
    model = LogisticRegression(
        featuresCol="_x",
        labelCol="_y",
        weightCol="_w",
        maxIter=max_iterations,
        regParam=1.0 / n,
        elasticNetParam=0.0,
        standardization=False,
        rawPredictionCol="_raw",
        predictionCol="_called",
    ).fit(rows)
    return RiskFusion(scaling, model)
