"""Whole runs, from files to saved results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.functions import expressions as X
from frostline.operators import evaluate, rollups, split
from frostline.operators.decisions import decide_laid_out
from frostline.operators.features import add_features, lay_out_reports
from frostline.operators.learning.detectors import Detectors, fit_detectors
from frostline.operators.learning.forest import ForestPolicy, fit_forest
from frostline.operators.learning.fusion import DECISION_THRESHOLD, fit_fusion
from frostline.operators.learning.saved import load_detectors, save_detectors
from frostline.operators.lookups import replace_posture
from frostline.operators.series import DEFAULT_SPLIT, SplitPolicy
from frostline.operators.storage import materialise
from frostline.settings import BoostPolicy, DecisionConfig
from frostline.sources import daily, results
from frostline.sources.telemetry import has_gps, read_telemetry


_TRAINING_KEYS = (S.DEVICE, S.RECEIVED, S.ROW_ID, S.LABEL, "is_augmented")


@dataclass(frozen=True)
class AlertRun:
    detectors: Detectors
    decided: DataFrame
    dashboard: DataFrame
    posture: DataFrame


def training_rows(
    telemetry: DataFrame, *, three: bool = False, series: SplitPolicy = DEFAULT_SPLIT
) -> DataFrame:
    """Written rows with targets, side and what the models read. Features are
    built over the whole series, not per side: frames only look back, so later
    sides may see earlier rows but not the reverse. Sides and features share one
    layout."""
    mark, side = (split.add_sides, split.SIDE) if three else (split.add_validation, split.VALIDATION)
    marked = mark(lay_out_reports(telemetry, policy=series))
    featured = split.add_targets(add_features(marked, has_gps(telemetry))[0].finish())
    inputs = {*S.TEMP_FEATURES, *S.GEO_FEATURES, *S.TAMPER_FEATURES, *S.ATTACK_FEATURES}
    keys = (*_TRAINING_KEYS, side)
    return materialise(
        featured.select(*keys, *split.TARGETS, *sorted(inputs - {*keys}))
    )


def train_detectors(
    telemetry: DataFrame, policy: BoostPolicy = BoostPolicy(), *, separate_thresholds: bool = False
) -> Detectors:
    """Detectors trained on the earlier and calibrated on the later rows of every
    device. ``separate_thresholds`` splits in three: thresholds are then chosen on
    rows that no score was calibrated on."""
    rows = training_rows(telemetry, three=separate_thresholds)
    if separate_thresholds:
        train, held_out, last = split.three_sides(rows)
        return fit_detectors(
            train, split.without_augmented(held_out), policy, choose_on=split.without_augmented(last)
        )
    train, held_out = split.train_and_validation(rows)
    return fit_detectors(train, split.without_augmented(held_out), policy)


def alert(
    telemetry: DataFrame,
    posture: DataFrame,
    detectors: Detectors,
    config: DecisionConfig = DecisionConfig(),
    *,
    series: SplitPolicy = DEFAULT_SPLIT,
) -> AlertRun:
    """Score, decide and roll up new telemetry with trained detectors. Rows are
    laid out once, for features and decisions alike, and the models applied once."""
    g, names = add_features(lay_out_reports(telemetry, policy=series), has_gps(telemetry))
    g = g.own_rows(*telemetry.columns, *names)
    g = g.with_rows(detectors.score(split.add_targets(g.rows)))
    decided = decide_laid_out(g, replace(config, thresholds=detectors.thresholds))
    # read by the prediction sink, the dashboard and the posture; where devices are
    # cut, their scored rows are written already and what follows is a light pass
    decided = decided if g.split else materialise(decided)
    return AlertRun(
        detectors,
        decided,
        rollups.risk_dashboard(decided),
        rollups.update_posture(posture, decided, S.BumpPolicy()),
    )


def train_and_save(
    spark: SparkSession,
    train_paths: str | Sequence[str],
    models: str,
    *,
    format: str = "csv",
    timestamp_pattern: str | None = None,
    policy: BoostPolicy = BoostPolicy(),
    config: DecisionConfig = DecisionConfig(),
    notes: str = "",
) -> int:
    """Train on telemetry from files and save the detectors; their version."""
    telemetry = read_telemetry(
        spark, train_paths, format=format, timestamp_pattern=timestamp_pattern
    )
    return save_detectors(
        spark, train_detectors(telemetry, policy), models, config.persistence, notes
    )


def alert_with_saved(
    spark: SparkSession,
    test_paths: str | Sequence[str],
    posture_path: str,
    models: str,
    output: str,
    *,
    version: int | None = None,
    format: str = "csv",
    timestamp_pattern: str | None = None,
    config: DecisionConfig = DecisionConfig(),
) -> AlertRun:
    """Score, decide, roll up and save new telemetry with saved detectors. Their
    thresholds and persistence hold; nothing is trained."""
    saved = load_detectors(spark, models, version)
    telemetry = read_telemetry(
        spark, test_paths, format=format, timestamp_pattern=timestamp_pattern
    )
    posture = results.read_posture(spark, posture_path)
    config = replace(config, persistence=saved.persistence)
    run = alert(telemetry, posture, saved.detectors, config)
    _save(spark, run, posture, config, output, f"detectors of version {saved.version}")
    return run


def _save(
    spark: SparkSession,
    run: AlertRun,
    posture: DataFrame,
    config: DecisionConfig,
    output: str,
    notes: str = "",
) -> None:
    """The run's days replace stored ones; the dashboard covers every stored day."""
    daily.save_days(run.decided, output)
    results.write_dashboard(daily.dashboard(spark, output), output)
    results.write_posture(posture, run.posture, output)
    meta = results.metadata(spark, config.persistence, run.detectors.thresholds, notes)
    results.write_metadata(meta, output)


def run_alerts(
    spark: SparkSession,
    train_paths: str | Sequence[str],
    test_paths: str | Sequence[str],
    posture_path: str,
    output: str,
    *,
    format: str = "csv",
    timestamp_pattern: str | None = None,
    policy: BoostPolicy = BoostPolicy(),
    config: DecisionConfig = DecisionConfig(),
) -> AlertRun:
    def read(paths):
        return read_telemetry(
            spark, paths, format=format, timestamp_pattern=timestamp_pattern
        )

    posture = results.read_posture(spark, posture_path)
    run = alert(read(test_paths), posture, train_detectors(read(train_paths), policy), config)
    _save(spark, run, posture, config, output)
    return run


def run_baselines(
    train: DataFrame,
    test: DataFrame,
    findings: DataFrame | None = None,
    *,
    cvss_column: str = "cvss_max",
    forest: ForestPolicy = ForestPolicy(),
    threshold: float = DECISION_THRESHOLD,
) -> DataFrame:
    """Test telemetry with both baselines' scores and flags. Posture comes from
    the findings, or from the training telemetry where there are none."""
    source = (
        rollups.posture_from_findings(findings)
        if findings is not None
        else rollups.posture_from_telemetry(train)
    )
    posture = materialise(source)
    train = replace_posture(train, posture, cvss_column=cvss_column)
    test = replace_posture(test, posture, cvss_column=cvss_column)
    isolated = fit_forest(train, policy=forest).predict(test)
    return fit_fusion(train).score(isolated, threshold)


def baseline_points(outputs: DataFrame) -> DataFrame:
    """Score points of both baselines, ready for curves and areas."""
    truthful = outputs.withColumn("_truth", F.expr(X.is_anomaly(S.LABEL)))
    return evaluate.score_points(
        evaluate.stack_detectors(
            truthful,
            {"isolation": ("IF_score", "_truth"), "fusion": ("RF_prob", "_truth")},
        )
    )
