"""Trained detectors on disk, so that new telemetry is scored without training.

A version is a folder of Spark ML models: for each operational detector the trees
and the isotonic curve of every fold, for attacks the trees and the logistic
curve. A row of the manifest (a Parquet table beside the folders) names the
version, its folder, the columns and their order, thresholds and persistence. It
is appended after all models are written, so a version that can be seen is
complete, and a run that was lost half-way leaves a folder that nothing reads.
Versions are never overwritten.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.operators.learning.boost import CrossFitted, SigmoidCalibrated
from frostline.operators.learning.detectors import Detectors
from frostline.settings import Persistence, Thresholds

MANIFEST = "manifest"
MANIFEST_SCHEMA = (
    "version long, folder string, saved_at timestamp, thresholds map<string, double>,"
    " persistence map<string, int>,"
    " operational array<struct<name: string, features: array<string>, digits: int, members: int>>,"
    " attack_features array<string>, notes string"
)


@dataclass(frozen=True)
class SavedDetectors:
    """A version as it was saved: models and the settings to decide with."""

    version: int
    detectors: Detectors
    persistence: Persistence
    notes: str = ""


def saved_versions(spark: SparkSession, base: str) -> DataFrame:
    """The manifest; empty where nothing was saved yet."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{base}/{MANIFEST}")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def save_detectors(
    spark: SparkSession,
    detectors: Detectors,
    base: str,
    persistence: Persistence = Persistence(),
    notes: str = "",
) -> int:
    """Write the detectors as the next version under ``base``; its number."""
    folder = uuid.uuid4().hex
    for name, model in detectors.operational.items():
        for n, (trees, calibrator) in enumerate(model.members):
            trees.write().save(f"{base}/{folder}/{name}-{n}-trees")
            calibrator.write().save(f"{base}/{folder}/{name}-{n}-calibration")
    detectors.attack.trees.write().save(f"{base}/{folder}/attack-trees")
    detectors.attack.curve.write().save(f"{base}/{folder}/attack-calibration")
    last = saved_versions(spark, base).agg(F.max("version")).first()[0]
    version = (last or 0) + 1
    operational = [
        (name, list(model.features), model.digits, len(model.members))
        for name, model in detectors.operational.items()
    ]
    row = (
        version, folder, None, asdict(detectors.thresholds), asdict(persistence),
        operational, list(detectors.attack.features), notes,
    )
    entry = spark.createDataFrame([row], MANIFEST_SCHEMA)
    entry = entry.withColumn("saved_at", F.current_timestamp())
    entry.coalesce(1).write.mode("append").parquet(f"{base}/{MANIFEST}")
    return version


def load_detectors(spark: SparkSession, base: str, version: int | None = None) -> SavedDetectors:
    """A saved version, by default the newest."""
    entries = saved_versions(spark, base)
    if version is not None:
        entries = entries.where(F.col("version") == version)
    # of two runs that saved at once, the same one every time
    entry = entries.orderBy(F.desc("version"), F.desc("saved_at"), "folder").first()
    if entry is None:
        raise FileNotFoundError(f"no saved detectors {'' if version is None else f'of version {version} '}in {base}")
    folder = f"{base}/{entry['folder']}"
    operational = {
        model["name"]: CrossFitted(
            tuple(model["features"]),
            tuple(
                (
                    GBTClassificationModel.load(f"{folder}/{model['name']}-{n}-trees"),
                    IsotonicRegressionModel.load(f"{folder}/{model['name']}-{n}-calibration"),
                )
                for n in range(model["members"])
            ),
            model["digits"],
        )
        for model in entry["operational"]
    }
    attack = SigmoidCalibrated(
        tuple(entry["attack_features"]),
        GBTClassificationModel.load(f"{folder}/attack-trees"),
        LogisticRegressionModel.load(f"{folder}/attack-calibration"),
    )
    detectors = Detectors(operational, attack, Thresholds(**entry["thresholds"]))
    return SavedDetectors(entry["version"], detectors, Persistence(**entry["persistence"]), entry["notes"] or "")
