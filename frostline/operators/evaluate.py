"""Classifier evaluation as queries.

Curves start from one row per distinct score, so ties cost nothing and the rows
that need a running total are already aggregated. Several detectors are
evaluated side by side through the ``detector`` column.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.functions import expressions as X
from frostline.operators.series import DEFAULT_SPLIT, SplitPolicy, lay_out, measure

DETECTOR = "detector"


def stack_detectors(
    df: DataFrame, detectors: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """(detector, score, truth) rows from {name: (score column, truth column)}."""
    cells = [
        F.struct(
            F.lit(name).alias(DETECTOR),
            F.col(score).cast("double").alias("score"),
            F.col(truth).cast("int").alias("truth"),
        )
        for name, (score, truth) in detectors.items()
    ]
    return df.select(F.inline(F.array(*cells)))


def checked_score() -> Column:
    """The score; a row without one is an error, as leaving it out would shrink
    the recall unseen."""
    missing = F.raise_error(F.lit("a row has no score; fill or drop such rows first"))
    has_score = F.col("score").isNotNull() & ~F.isnan("score")
    return F.when(has_score, F.col("score")).otherwise(missing.cast("double"))


def score_points(
    scored: DataFrame, *, policy: SplitPolicy = DEFAULT_SPLIT
) -> DataFrame:
    """Per distinct score: own positives and negatives, and how many positives
    (tp) and negatives (fp) score at least as high. A missing score is an error."""
    points = (
        scored.withColumn("score", checked_score())
        .groupBy(DETECTOR, "score")
        .agg(
            F.sum("truth").alias("pos"),
            F.sum(1 - F.col("truth")).alias("neg"),
        )
    )
    sizes = measure(points, [DETECTOR])
    g = lay_out(
        points, [DETECTOR], ("score", "score"), lookback=1, policy=policy, sizes=sizes
    )
    ordered = g.frames.ordered
    g = g.running_totals(up_to_pos="pos", up_to_neg="neg")
    g = g.add(
        tp="up_to_pos_all - up_to_pos + pos",
        fp="up_to_neg_all - up_to_neg + neg",
        pos_all="up_to_pos_all",
        neg_all="up_to_neg_all",
        lower_pos=f"lag(pos) {ordered}",
        lower_neg=f"lag(neg) {ordered}",
    )
    return g.finish().drop("up_to_pos", "up_to_neg", "up_to_pos_all", "up_to_neg_all")


_RECALL = "IF(pos_all = 0, 1D, CAST(tp AS DOUBLE) / pos_all)"
_PRECISION = "CAST(tp AS DOUBLE) / (tp + fp)"
_FIRST = "tp = pos AND fp = neg"


def pr_curve(points: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score, plus the end point
    (recall 0, precision 1) that has no threshold."""
    own = F.struct(
        F.col("score").alias("threshold"),
        F.expr(_PRECISION).alias("precision"),
        F.expr(_RECALL).alias("recall"),
    )
    end = F.struct(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    # the highest score brings the end point along
    rows = F.when(F.expr(_FIRST), F.array(own, end)).otherwise(F.array(own))
    return points.select(DETECTOR, F.inline(rows))


def roc_curve(points: DataFrame, *, drop_collinear: bool = True) -> DataFrame:
    """False and true positive rate at every distinct score, from (0, 0). Points
    on a straight line between their neighbours are left out by default."""
    rows = points
    if drop_collinear:
        bends = (
            f"({_FIRST}) OR lower_pos IS NULL"
            " OR lower_pos <> pos OR lower_neg <> neg"
        )
        rows = rows.where(bends)
    own = F.struct(
        F.col("score").alias("threshold"),
        F.expr("CAST(fp AS DOUBLE) / nullif(neg_all, 0)").alias("fpr"),
        F.expr("CAST(tp AS DOUBLE) / nullif(pos_all, 0)").alias("tpr"),
    )
    start = F.struct(
        F.lit(float("inf")).alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    both = F.when(F.expr(_FIRST), F.array(own, start)).otherwise(F.array(own))
    return rows.select(DETECTOR, F.inline(both))


def areas(points: DataFrame) -> DataFrame:
    """Trapezoid areas under both curves; ROC is null for a single class. The
    preceding point follows from a row's own counts, so no second window."""
    before = f"IF({_FIRST}, 1D, CAST(tp - pos AS DOUBLE) / nullif(tp - pos + fp - neg, 0))"
    step = (
        "IF(pos_all = 0,"
        f" IF({_FIRST}, 1D, 0D), CAST(pos AS DOUBLE) / pos_all)"
    )
    pr_part = f"({step}) * (({_PRECISION}) + ({before})) / 2D"
    roc_part = (
        "(CAST(neg AS DOUBLE) / nullif(neg_all, 0))"
        " * (CAST(tp + tp - pos AS DOUBLE) / nullif(pos_all, 0)) / 2D"
    )
    return points.groupBy(DETECTOR).agg(
        F.expr(f"sum({pr_part})").alias("pr_auc"),
        F.expr(f"sum({roc_part})").alias("roc_auc"),
    )


def best_thresholds(points: DataFrame, betas: Mapping[str, float]) -> DataFrame:
    """Per detector the score with the highest F-beta, the lowest one on ties;
    0.5 for a detector without any score."""
    beta = F.create_map(*[F.lit(x) for pair in betas.items() for x in pair])
    squared = F.pow(F.element_at(beta, F.col(DETECTOR)), F.lit(2.0))
    scored = points.withColumn("_b", squared).withColumn(
        "f",
        F.expr(
            f"(1D + _b) * (({_PRECISION}) * ({_RECALL}))"
            f" / greatest(_b * ({_PRECISION}) + ({_RECALL}), 1e-9D)"
        ),
    )
    best = scored.groupBy(DETECTOR).agg(
        F.min_by("score", F.struct(-F.col("f"), F.col("score"))).alias("threshold"),
        F.max("f").alias("f"),
    )
    names = points.sparkSession.createDataFrame(
        [(name,) for name in betas], f"{DETECTOR} string"
    )
    return names.join(best, DETECTOR, "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(0.5))
    )


# -- class reports ----------------------------------------------------------------
def confusion_matrix(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """The four cells of a binary matrix, zero cells included, with the share
    of the true class in percent (0 for a class that never occurs)."""
    cells = df.agg(
        *[
            F.count_if((F.col(truth) == t) & (F.col(prediction) == p)).alias(f"n{t}{p}")
            for t in (0, 1)
            for p in (0, 1)
        ]
    )
    long = cells.select(
        F.expr(
            "stack(4, 0, 0, n00, n00 + n01, 0, 1, n01, n00 + n01,"
            " 1, 0, n10, n10 + n11, 1, 1, n11, n10 + n11)"
        ).alias("truth", "prediction", "count", "_row")
    )
    share = "coalesce(100D * count / nullif(_row, 0), 0D)"
    return long.select("truth", "prediction", "count", F.expr(share).alias("row_percent"))


def classification_report(
    df: DataFrame, truth: Column, prediction: Column, digits: int = 3
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, and macro and
    weighted averages; undefined ratios are 0."""
    pairs = (
        df.select(truth.cast("string").alias("t"), prediction.cast("string").alias("p"))
        .groupBy("t", "p")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sides = pairs.select(
        F.expr(
            "inline(array("
            "struct(t AS label, IF(t = p, n, 0L) AS hit, n AS actual, 0L AS called),"
            "struct(p AS label, 0L AS hit, 0L AS actual, n AS called)))"
        )
    )
    classes = (
        sides.groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("hit", "actual", "called")])
        .withColumns(
            {
                "precision": F.expr("coalesce(hit / nullif(called, 0), 0D)"),
                "recall": F.expr("coalesce(hit / nullif(actual, 0), 0D)"),
                "f1": F.expr("coalesce(2D * hit / nullif(actual + called, 0), 0D)"),
            }
        )
    )
    measures = ("precision", "recall", "f1")
    # one pass yields each class and, in the rolled-up row, all summaries
    rolled = classes.rollup("label").agg(
        F.grouping_id().alias("total"),
        F.sum("actual").alias("support"),
        F.expr("sum(hit) / nullif(sum(actual), 0)").alias("accuracy"),
        *[F.avg(m).alias(m) for m in measures],
        *[F.expr(f"sum({m} * actual) / nullif(sum(actual), 0)").alias(f"w_{m}") for m in measures],
    )
    rows = rolled.select(
        F.expr(
            "inline(IF(total = 0,"
            " array(struct(label, precision, recall, f1, support)),"
            " array("
            "struct('accuracy' AS label, CAST(NULL AS DOUBLE) AS precision,"
            " CAST(NULL AS DOUBLE) AS recall, accuracy AS f1, support),"
            "struct('macro avg' AS label, precision, recall, f1, support),"
            "struct('weighted avg' AS label, w_precision AS precision,"
            " w_recall AS recall, w_f1 AS f1, support))))"
        )
    )
    return rows.select(
        "label", *[F.round(m, digits).alias(m) for m in measures], "support"
    )


def operational_report(decided: DataFrame) -> DataFrame:
    """Operational classes only: a true cyber attack counts as normal."""
    truth = F.expr(X.operational_class(f"coalesce({S.LABEL}, 'nan')"))
    return classification_report(decided, truth, F.col("operational_label"))


def cyber_report(decided: DataFrame) -> DataFrame:
    return classification_report(
        decided,
        F.expr(X.is_label(S.LABEL, S.CYBER)),
        F.expr(X.unit_flag("pred_attack_bin")),
    )


def prevalence(df: DataFrame, truth: Column) -> DataFrame:
    return df.agg(F.coalesce(F.avg(truth), F.lit(0.0)).alias("prevalence"))
