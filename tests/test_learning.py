import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.operators import evaluate, rollups, series, split
from frostline.operators.learning import boost
from frostline.operators.learning.forest import ForestPolicy, exact_quantile, fit_forest, mean_path
from frostline.operators.learning.fusion import fit_fusion
from frostline.operators.learning.matrix import Scaling, assemble, stratified_folds
from frostline.operators.lookups import replace_posture
from frostline.operators.series import SplitPolicy
from frostline.plans import fixture, runs
from frostline.settings import BoostPolicy
from frostline.sources import results
from helpers import random_telemetry, to_spark

SHORT = BoostPolicy(operational_iterations=4, attack_iterations=4, max_depth=3)


@pytest.fixture(scope="module")
def planted(spark):
    """Telemetry whose labels follow from the readings."""
    frame = random_telemetry(1200, 4, seed=2, skew=0.4)
    rng = np.random.default_rng(0)
    hot = rng.random(len(frame)) < 0.2
    frame["temp_reported"] = np.where(hot, 9.0, 3.0) + rng.normal(0, 0.3, len(frame))
    frame["primary_label_reported"] = np.where(hot, S.STORAGE, S.NORMAL)
    return to_spark(spark, frame)


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    return runs.train_detectors(fixture.telemetry(spark, sf_dir), SHORT)


def test_missing_features_count_as_zero(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0)], "a int, b double")
    rows = assemble(df, ["a", "b"], "x").orderBy("a").collect()
    assert [list(r["x"]) for r in rows] == [[1.0, 0.0], [2.0, 5.0]]


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (None, 3.0)], "a double, b double")
    scaling = Scaling.fit(df, ["a", "b"])
    values = np.array([r["z_a"] for r in scaling.apply(df).collect()])
    assert values.mean() == pytest.approx(0) and values.std() == pytest.approx(1)
    assert {r["z_b"] for r in scaling.apply(df).collect()} == {0.0}


@pytest.mark.parametrize("policy", [SplitPolicy(), SplitPolicy(max_rows=40)])
def test_folds_are_even_per_class_and_contiguous(spark, planted, policy):
    df = split.add_targets(planted)
    pdf = stratified_folds(df, "y_temp", policy=policy).toPandas()
    assert len(pdf) == 1200
    for _, rows in pdf.groupby("y_temp"):
        sizes = rows.groupby("fold").size()
        assert len(sizes) == 3 and sizes.max() - sizes.min() <= 1
    for _, rows in pdf.sort_values(["timestamp", "event_id"]).groupby(["Device_ID", "y_temp"]):
        assert rows["fold"].is_monotonic_increasing


def test_operational_detector_finds_a_planted_signal(spark, planted):
    df = split.add_targets(planted)
    from frostline.operators.features import engineer_features

    df = engineer_features(df)
    model = boost.fit_operational(df, S.TEMP_FEATURES, "y_temp", SHORT)
    scored = model.score(df, "score_temp")
    low, high = scored.agg(F.min("score_temp"), F.max("score_temp")).first()
    assert 0.0 <= low < high <= 1.0
    points = evaluate.score_points(
        evaluate.stack_detectors(scored, {"temp": ("score_temp", "y_temp")})
    )
    assert evaluate.areas(points).first()["roc_auc"] > 0.95


def test_isotonic_calibration_is_monotone(spark, planted):
    df = split.add_targets(planted)
    model = boost.fit_operational(df, ["temp_reported", "humidity_reported"], "y_temp", SHORT)
    trees, calibrator = model.members[0]
    grid = spark.range(101).select((F.col("id") / 100).alias("_p"))
    steps = [r["_c"] for r in calibrator.setFeaturesCol("_p").setPredictionCol("_c").transform(grid).orderBy("_p").collect()]
    assert steps == sorted(steps)


def test_sigmoid_fits_smoothed_targets(spark):
    # three positives and one negative at one margin: the fitted probability is
    # the mean smoothed target
    df = spark.createDataFrame([(1.0, 1)] * 3 + [(1.0, 0)], "raw double, y int")
    model = boost.fit_sigmoid(df, "raw", "y")
    margin = model.coefficients[0] + model.intercept
    expected = (3 * (4 / 5) + 1 / 3) / 4
    assert 1 / (1 + np.exp(-margin)) == pytest.approx(expected, abs=1e-4)


def test_whole_alert_run(spark, sf_dir, trained, tmp_path):
    telemetry = fixture.telemetry(spark, sf_dir)
    run = runs.alert(telemetry, fixture.posture(spark, sf_dir), trained)
    assert run.decided.count() == telemetry.count()
    scores = ["score_temp", "score_geo", "score_tamper", "score_attack_sup"]
    bounds = run.decided.agg(*[F.min(s) for s in scores], *[F.max(s) for s in scores]).first()
    assert all(0.0 <= v <= 1.0 for v in bounds)
    assert run.dashboard.count() == telemetry.selectExpr("Device_ID", "to_date(timestamp)").distinct().count()
    assert run.posture.count() == 10
    cuts = trained.thresholds
    assert all(0.0 <= c <= 1.0 for c in (cuts.temp, cuts.geo, cuts.tamper, cuts.attack_sup_base))


def test_a_run_lays_its_reports_out_once(spark, trained, monkeypatch):
    """Long series are cut once to train and once to alert, with the results of
    whole ones."""
    telemetry = to_spark(spark, random_telemetry(400, 3, seed=8))
    posture = telemetry.groupBy(S.DEVICE).agg(*[F.max(c).alias(c) for c in S.POSTURE_MEASURES])
    cuts, cut = [], series._cut
    monkeypatch.setattr(series, "_cut", lambda df, *rest: cuts.append(1) or cut(df, *rest))
    short = SplitPolicy(max_rows=60)

    def same(whole, pieces):
        assert whole.columns == pieces.columns
        one, two = (df.orderBy("event_id").toPandas() for df in (whole, pieces))
        for c in one:
            if one[c].dtype.kind == "f":
                np.testing.assert_allclose(one[c], two[c], rtol=1e-9, atol=1e-9)
            else:
                assert one[c].equals(two[c]), c

    same(runs.training_rows(telemetry), runs.training_rows(telemetry, series=short))
    assert len(cuts) == 1
    same(runs.training_rows(telemetry, three=True), runs.training_rows(telemetry, three=True, series=short))
    assert len(cuts) == 2
    same(runs.alert(telemetry, posture, trained).decided, runs.alert(telemetry, posture, trained, series=short).decided)
    assert len(cuts) == 3


def test_run_from_files(spark, sf_dir, tmp_path):
    telemetry = str(tmp_path / "telemetry")
    fixture.telemetry(spark, sf_dir).drop("event_id").write.csv(telemetry, header=True)
    posture = str(tmp_path / "posture")
    fixture.posture(spark, sf_dir).selectExpr("*", "0 AS nist_gap_count").write.csv(posture, header=True)
    out = str(tmp_path / "out")
    tiny = BoostPolicy(operational_iterations=1, attack_iterations=1, max_depth=2)
    runs.run_alerts(spark, [str(tmp_path / "absent"), telemetry], telemetry, posture, out, policy=tiny)
    saved = results.read_results(spark, out)
    assert all(df is not None for df in saved.values())
    assert saved["predictions"].count() == 1000


def test_forest_is_repeatable_and_flags_the_given_share(spark, sf_dir):
    df = fixture.telemetry(spark, sf_dir)
    forest = fit_forest(df, policy=ForestPolicy(trees=20, contamination=0.05))
    again = fit_forest(df.repartition(7), policy=ForestPolicy(trees=20, contamination=0.05))
    one, two = (f.nodes.sort_values(["tree", "node"]).to_numpy(dtype=float) for f in (forest, again))
    assert one.shape == two.shape and np.allclose(one, two)
    row = forest.predict(df).agg(F.avg("IF_pred"), F.min("IF_score"), F.max("IF_score")).first()
    assert 0.03 <= row[0] <= 0.05 and 0.0 < row[1] < row[2] < 1.0
    assert forest.nodes.groupby("tree").size().max() <= 2 * 256 - 1


def test_forest_isolates_an_outlier(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(0, 1, 3))) for i in range(600)] + [(600, 9.0, 9.0, 9.0)]
    names = ["event_id", *S.TELEMETRY_FEATURES]
    df = spark.createDataFrame(rows, names)
    scored = fit_forest(df, policy=ForestPolicy(trees=60)).score(df)
    assert scored.orderBy(F.desc("IF_score")).first()["event_id"] == 600


def test_mean_path():
    assert (mean_path(1), mean_path(2)) == (0.0, 1.0)
    assert mean_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_exact_quantile(spark):
    values = np.random.default_rng(6).random(501).round(3)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        assert exact_quantile(df, "v", q) == pytest.approx(np.quantile(values, q))


def test_fusion_learns_and_balances(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(800):
        odd = i % 10 == 0
        rows.append((i, S.GEOFENCE if odd else S.NORMAL, *(float(v) for v in rng.normal(3 if odd else 0, 1, 6))))
    df = spark.createDataFrame(rows, ["event_id", S.LABEL, *S.FUSION_FEATURES])
    scored = fit_fusion(df, max_iterations=100).score(df, threshold=0.5)
    row = scored.groupBy("RF_pred").count().collect()
    assert {r["RF_pred"] for r in row} == {0, 1}
    recall = scored.where(F.col(S.LABEL) == S.GEOFENCE).agg(F.avg("RF_pred")).first()[0]
    assert recall > 0.95


def test_baselines_end_to_end(spark, sf_dir):
    telemetry = fixture.telemetry(spark, sf_dir)
    findings = telemetry.selectExpr("Device_ID", "CAST(event_id AS STRING) AS vuln_id", "cvss", "epss / 100 AS epss")
    out = runs.run_baselines(telemetry, telemetry, findings, forest=ForestPolicy(trees=10))
    assert out.count() == telemetry.count()
    areas = {r["detector"]: r["roc_auc"] for r in evaluate.areas(runs.baseline_points(out)).collect()}
    assert set(areas) == {"isolation", "fusion"} and all(0 <= a <= 1 for a in areas.values())
    without = replace_posture(telemetry, rollups.posture_from_telemetry(telemetry), cvss_column="cvss_mean")
    assert without.where("cvss_used IS NULL OR epss_used IS NULL OR dvd_used IS NULL").count() == 0


def test_training_partitions_stay_small_however_large_the_table(spark, tmp_path):
    """One small file of repetitive rows is not one partition of tree points."""
    spark.range(5000).select((F.col("id") % 2).alias("y"), F.lit(1.5).alias("x")).coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert rows.rdd.getNumPartitions() == 1
    parts = boost.spread(rows, 400).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 13 and max(r["count"] for r in parts) <= 450
    assert sum(r["count"] for r in parts) == 5000
    assert boost.spread(rows, 5000).rdd.getNumPartitions() == 1
