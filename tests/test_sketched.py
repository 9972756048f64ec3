"""Sketched curves and labels against the exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.operators import evaluate, rollups, sketched
from frostline.operators.storage import materialise


def scored(spark, rows, seed=1, share=0.1):
    """Scores that are nearly all different, positives higher."""
    unit = F.rand(seed)
    truth = (F.rand(seed + 1) < share).cast("int")
    df = spark.range(rows).select(F.lit("d").alias("detector"), truth.alias("truth"), unit.alias("u"))
    return materialise(df.select("detector", "truth", F.pow("u", F.when(F.col("truth") == 1, 0.4).otherwise(1.3)).alias("score")))


@pytest.mark.parametrize("share", [0.5, 0.02])
def test_areas_within_the_bounds(spark, share):
    stacked = scored(spark, 100_000, share=share)
    exact = evaluate.areas(evaluate.score_points(stacked)).first()
    points = materialise(sketched.sketched_points(sketched.score_sketches(stacked)))
    near, bounds = evaluate.areas(points).first(), sketched.area_bounds(points).first()
    assert bounds["roc_low"] <= exact["roc_auc"] <= bounds["roc_high"] <= bounds["roc_low"] + 0.02
    assert bounds["pr_low"] <= exact["pr_auc"] <= bounds["pr_high"]
    assert near["roc_auc"] == pytest.approx(exact["roc_auc"], abs=0.002)
    assert near["pr_auc"] == pytest.approx(exact["pr_auc"], abs=0.02)
    assert points.count() <= 2 * (sketched.GRID + 1)
    cuts = [evaluate.best_thresholds(p, {"d": 1.0}).first() for p in (points, evaluate.score_points(stacked))]
    assert cuts[0]["f"] == pytest.approx(cuts[1]["f"], abs=0.02)


def test_sketches_of_parts_merge(spark):
    stacked = scored(spark, 30_000)
    parts = [sketched.score_sketches(stacked.where(F.pmod(F.hash("score"), F.lit(5)) == n)) for n in range(5)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    merged = sketched.merge_sketches(union)
    assert merged.count() == 2 and merged.agg(F.sum("n")).first()[0] == 30_000
    area = evaluate.areas(sketched.sketched_points(merged)).first()["roc_auc"]
    assert area == pytest.approx(evaluate.areas(evaluate.score_points(stacked)).first()["roc_auc"], abs=0.004)


def test_one_shuffle_of_sketches(spark):
    plan = sketched.score_sketches(scored(spark, 1000))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(detector") == 1
    assert "partial_kll_sketch_agg_double" in plan


def test_small_tables_are_exact(spark):
    rows = [("a", 0.1, 0), ("a", 0.1, 1), ("a", 0.4, 0), ("a", 0.4, 0), ("a", 0.9, 1), ("one", 0.5, 1), ("one", 0.7, 1), ("zero", 0.5, 0)]
    df = spark.createDataFrame(rows, "detector string, score double, truth int")
    points = sketched.sketched_points(sketched.score_sketches(df))
    names = ("detector", "score", "tp", "fp", "pos", "neg", "pos_all", "neg_all", "lower_pos", "lower_neg")
    want = sorted(map(str, evaluate.score_points(df).select(*names).collect()))
    assert sorted(map(str, points.select(*names).collect())) == want
    for curve in (evaluate.pr_curve, evaluate.roc_curve):
        assert sorted(map(str, curve(points).collect())) == sorted(map(str, curve(evaluate.score_points(df)).collect()))
    assert sketched.sketched_points(sketched.score_sketches(df.limit(0))).count() == 0


def test_a_missing_score_is_an_error(spark):
    df = spark.createDataFrame([("a", None, 1)], "detector string, score double, truth int")
    with pytest.raises(Exception, match="no score"):
        sketched.score_sketches(df).collect()


def labelled(spark, seed):
    rng, rows = np.random.default_rng(seed), []
    for device, labels, times in (("few", 4, 300), ("open", 900, 3000), ("flat", 700, 700), (None, 3, 20)):
        weights = np.ones(labels) if device == "flat" else 1 / np.arange(1, labels + 1) ** 1.3
        drawn = rng.choice(labels, times, p=weights / weights.sum())
        rows += [(device, None if x == 2 else f"label {x}") for x in drawn]
    return spark.createDataFrame(rows, "Device_ID string, operational_label string").repartition(5)


@pytest.mark.parametrize(("seed", "tracked", "k"), [(1, 64, 3), (2, 256, 5), (3, 8, 1)])
def test_frequent_labels_equal_the_exact_ones(spark, seed, tracked, k):
    df = labelled(spark, seed)
    found = sketched.frequent_labels(df, k, tracked=tracked)
    want = rollups.top_labels(df, k)
    assert found.columns == want.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert sketched.frequent_labels(df.limit(0), k, tracked=tracked).count() == 0
