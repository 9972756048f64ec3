"""The four detectors together: fit, choose thresholds, score."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from frostline.operators.evaluate import best_thresholds, score_points, stack_detectors
from frostline.operators.learning.boost import (
    OPERATIONAL,
    CrossFitted,
    SigmoidCalibrated,
    fit_attack,
    fit_operational,
)
from frostline.operators.split import attack_rows
from frostline.operators.storage import materialise
from frostline.settings import BoostPolicy, SweepBetas, Thresholds


@dataclass(frozen=True)
class Detectors:
    operational: dict[str, CrossFitted]
    attack: SigmoidCalibrated
    thresholds: Thresholds

    def score(self, df: DataFrame) -> DataFrame:
        """Adds score_temp, score_geo, score_tamper and score_attack_sup."""
        for name, model in self.operational.items():
            df = model.score(df, f"score_{name}")
        return self.attack.score(df, "score_attack_sup")


def fit_detectors(
    train: DataFrame,
    validation: DataFrame,
    policy: BoostPolicy = BoostPolicy(),
    betas: SweepBetas = SweepBetas(),
    choose_on: DataFrame | None = None,
) -> Detectors:
    """Train on featured rows with targets; every cut maximises its F-beta on
    the validation rows (for attacks: on normal and attacked ones). The attack
    curve is fitted on the validation rows as well; ``choose_on`` gives other
    rows to choose the cuts on."""
    choose_on = validation if choose_on is None else choose_on
    operational = {
        name: fit_operational(train, features, target, policy)
        for name, (features, target) in OPERATIONAL.items()
    }
    attack = fit_attack(train, validation, policy)

    scored = choose_on
    for name, model in operational.items():
        scored = model.score(scored, f"score_{name}")
    names = {n: (f"score_{n}", target) for n, (_, target) in OPERATIONAL.items()}
    stacked = stack_detectors(scored, names).unionByName(
        stack_detectors(
            attack.score(attack_rows(choose_on), "score_attack"),
            {"attack": ("score_attack", "y_attack")},
        )
    )
    points = score_points(materialise(stacked))
    cuts = {
        row["detector"]: row["threshold"]
        for row in best_thresholds(points, asdict(betas)).collect()
    }
    return Detectors(
        operational,
        attack,
        Thresholds(cuts["temp"], cuts["geo"], cuts["tamper"], cuts["attack"]),
    )
