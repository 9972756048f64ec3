import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.operators import evaluate as E
from frostline.operators.series import SplitPolicy


def _scored(spark, pairs, detector="d"):
    return spark.createDataFrame(
        [(detector, float(s), int(t)) for s, t in pairs], "detector string, score double, truth int"
    )


TIES = [(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)]


def test_pr_curve_has_one_point_per_distinct_score(spark):
    curve = E.pr_curve(E.score_points(_scored(spark, TIES)))
    rows = sorted((r["threshold"], r["precision"], r["recall"]) for r in curve.collect() if r["threshold"] is not None)
    assert rows == [(0.1, 0.5, 1.0), (0.5, 2 / 3, 1.0), (0.9, 0.5, 0.5)]
    end = curve.where("threshold IS NULL").first()
    assert (end["precision"], end["recall"]) == (1.0, 0.0)


def test_equal_f_takes_the_lowest_threshold(spark):
    # recall-heavy: both cuts reach F1 = 2/3
    pairs = [(0.9, 1), (0.4, 0), (0.3, 0), (0.2, 1)]
    row = E.best_thresholds(E.score_points(_scored(spark, pairs)), {"d": 1.0}).first()
    assert row["threshold"] == 0.2 and row["f"] == pytest.approx(2 / 3)


def test_detector_without_scores_gets_one_half(spark):
    empty = E.best_thresholds(E.score_points(_scored(spark, [])), {"d": 1.0}).first()
    assert empty["threshold"] == 0.5


def test_one_class_has_no_roc_area(spark):
    row = E.areas(E.score_points(_scored(spark, [(s, 1) for s in (0.1, 0.2, 0.3, 0.4)]))).first()
    assert row["roc_auc"] is None and row["pr_auc"] == pytest.approx(1.0)
    row = E.areas(E.score_points(_scored(spark, [(s, 0) for s in (0.1, 0.2)]))).first()
    assert row["roc_auc"] is None and row["pr_auc"] == pytest.approx(0.5)


def _brute_force(pairs):
    scores = sorted({s for s, _ in pairs}, reverse=True)
    pos = sum(t for _, t in pairs)
    neg = len(pairs) - pos
    pr, roc = [(0.0, 1.0)], [(0.0, 0.0)]
    for cut in scores:
        tp = sum(t for s, t in pairs if s >= cut)
        fp = sum(1 - t for s, t in pairs if s >= cut)
        pr.append((tp / pos, tp / (tp + fp)))
        roc.append((fp / neg, tp / pos))

    def area(points):
        return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))

    return area(pr), area(roc), roc


@pytest.mark.parametrize("policy", [SplitPolicy(), SplitPolicy(max_rows=20)])
def test_areas_against_brute_force(spark, policy):
    rng = np.random.default_rng(3)
    pairs = [(round(float(s), 2), int(rng.random() < s)) for s in rng.random(300)]
    points = E.score_points(_scored(spark, pairs), policy=policy)
    row = E.areas(points).first()
    pr, roc, curve = _brute_force(pairs)
    assert row["pr_auc"] == pytest.approx(pr) and row["roc_auc"] == pytest.approx(roc)
    full = {(round(r["fpr"], 9), round(r["tpr"], 9)) for r in E.roc_curve(points, drop_collinear=False).collect()}
    assert full == {(round(a, 9), round(b, 9)) for a, b in curve}
    short = E.roc_curve(points).collect()
    trimmed = sorted((r["fpr"], r["tpr"]) for r in short)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(trimmed, trimmed[1:]))
    assert len(short) <= len(full) and area == pytest.approx(roc)


def test_recall_never_falls_with_a_lower_threshold(spark):
    rng = np.random.default_rng(8)
    pairs = [(float(s), int(rng.random() < 0.3)) for s in rng.random(200).round(2)]
    rows = E.pr_curve(E.score_points(_scored(spark, pairs))).where("threshold IS NOT NULL")
    recalls = [r["recall"] for r in rows.orderBy(F.desc("threshold")).collect()]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0


def test_area_agrees_with_the_library_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(4)
    pairs = [(float(s), int(rng.random() < s)) for s in rng.random(400)]
    df = _scored(spark, pairs)
    expected = BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="label", metricName="areaUnderROC", numBins=0
    ).evaluate(df.withColumn("label", F.col("truth").cast("double")))
    assert E.areas(E.score_points(df)).first()["roc_auc"] == pytest.approx(expected)


def test_confusion_matrix_keeps_empty_cells(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (1, 1)], "t int, p int")
    rows = {(r[0], r[1]): (r[2], round(r[3], 3)) for r in E.confusion_matrix(df, "t", "p").collect()}
    assert rows == {(0, 0): (0, 0.0), (0, 1): (0, 0.0), (1, 0): (1, 33.333), (1, 1): (2, 66.667)}


def test_report_covers_classes_of_either_side(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c"), ("b", "b")], "t string, p string")
    rows = {r["label"]: r for r in E.classification_report(df, F.col("t"), F.col("p")).collect()}
    assert set(rows) == {"a", "b", "c", "accuracy", "macro avg", "weighted avg"}
    assert (rows["c"]["precision"], rows["c"]["recall"], rows["c"]["f1"], rows["c"]["support"]) == (0, 0, 0, 0)
    assert rows["a"]["f1"] == pytest.approx(0.667) and rows["accuracy"]["f1"] == 0.5
    assert rows["macro avg"]["precision"] == 0.5 and rows["weighted avg"]["precision"] == 0.75
    assert rows["accuracy"]["support"] == 4


@pytest.mark.parametrize("score", [None, float("nan")])
def test_a_row_without_score_is_an_error(spark, score):
    df = spark.createDataFrame([("d", score, 1), ("d", 0.5, 0)], "detector string, score double, truth int")
    with pytest.raises(Exception, match="a row has no score"):
        E.score_points(df).collect()
