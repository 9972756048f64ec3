"""From detector scores to alerts, labels and actions."""

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
from frostline.settings import ActionPolicy, DecisionConfig, Persistence, RiskPolicy


# -- thresholds -------------------------------------------------------------
def raw_flag(score: str, threshold: str | float) -> str:
    cut = threshold if isinstance(threshold, str) else X.real(threshold)
    return X.as_flag(f"{score} >= {cut}")


def _weighted_posture(epss: float, cvss: float, dvd: float) -> str:
    return (
        f"{X.real(epss)} * coalesce(epss, 0D)"
        f" + {X.real(cvss)} * (coalesce(cvss, 0D) / 10D)"
        f" + {X.real(dvd)} * coalesce(dvd, 0D)"
    )


def risk_term(policy: RiskPolicy = RiskPolicy()) -> str:
    weighted = _weighted_posture(
        policy.epss_weight, policy.cvss_weight, policy.dvd_weight
    )
    return X.clip(weighted, 0.0, policy.term_max)


def attack_threshold(base: float, policy: RiskPolicy = RiskPolicy()) -> str:
    """The cut for the attack score: lower on riskier devices, or the plain
    base (not clipped) when risk awareness is off."""
    if not policy.risk_aware:
        return X.real(base)
    lowered = f"{X.real(base)} * (1D - {risk_term(policy)})"
    return X.clip(lowered, policy.threshold_min, policy.threshold_max)


def high_risk(policy: RiskPolicy = RiskPolicy()) -> str:
    return (
        f"(coalesce(epss >= {X.real(policy.high_epss)}, false)"
        f" OR coalesce(cvss >= {X.real(policy.high_cvss)}, false))"
    )


# -- persistence ------------------------------------------------------------
def persistent(groups: OrderedGroups, flag: str, n: int) -> str:
    """1 where this row and the n - 1 before it are all flagged."""
    if n <= 1:
        return flag
    return f"CAST(sum({flag}) {groups.frames.last(n)} = {n} AS INT)"


def persistent_by_risk(groups: OrderedGroups, flag: str, n: int) -> str:
    """As ``persistent``, but high-risk rows alert on their own raw flag."""
    return f"IF(high_risk, {flag}, {persistent(groups, flag, n)})"


def device_series(
    df: DataFrame,
    persistence: Persistence = Persistence(),
    *,
    order_by: str = S.ROW_ID,
    policy: SplitPolicy = DEFAULT_SPLIT,
    sizes: GroupSizes | None = None,
) -> OrderedGroups:
    """Rows laid out per device with as much history as persistence needs."""
    longest = max(persistence.temp, persistence.geo, persistence.tamper, persistence.attack)
    return lay_out(
        df.where(F.col(S.DEVICE).isNotNull()),
        [S.DEVICE],
        (S.RECEIVED, order_by),
        lookback=max(1, longest - 1),
        policy=policy,
        sizes=sizes,
    )


# -- labels and actions -----------------------------------------------------
def operational_decision() -> dict[str, str]:
    """Label and score of the flagged detector with the highest score; on equal
    scores the earlier of temperature, geofence, tamper; (normal, 0) if none."""
    bids = [f"IF({flag} = 1, {score}, -1D)" for _, flag, score in S.CANDIDATES]
    best = f"greatest({', '.join(bids)})"
    choices = " ".join(
        f"WHEN {bid} = {best} THEN {X.text(label)}"
        for bid, (label, _, _) in zip(bids, S.CANDIDATES)
    )
    return {
        "operational_label": f"CASE WHEN {best} < 0D THEN {X.text(S.NORMAL)} {choices} END",
        "op_best_score": f"greatest({best}, 0D)",
    }


def recommended_action(policy: ActionPolicy = ActionPolicy()) -> str:
    return (
        "CASE"
        " WHEN pred_attack_bin = 1"
        f" AND op_best_score < {X.real(policy.isolate_below_score)}"
        f" THEN {X.text(S.ISOLATE)}"
        f" WHEN operational_label = {X.text(S.STORAGE)} THEN {X.text(S.RECOVER)}"
        f" WHEN operational_label <> {X.text(S.NORMAL)}"
        f" AND cvss >= {X.real(policy.patch_from_cvss)} THEN {X.text(S.PATCH)}"
        f" ELSE {X.text(S.MONITOR)} END"
    )


def combined_risk(policy: ActionPolicy = ActionPolicy()) -> str:
    """Weighted posture; not clipped, since dvd is not normalised."""
    return _weighted_posture(policy.epss_weight, policy.cvss_weight, policy.dvd_weight)


# -- whole decision layer -----------------------------------------------------
Layer = dict[str, str]
TAMPERED = X.as_flag("tamper_reported > 0")


def layers_before(config: DecisionConfig) -> tuple[Layer, ...]:
    """What a row's own values say: raw flags, attack threshold, high risk."""
    cut = config.thresholds
    return (
        {
            "_raw_temp": raw_flag("score_temp", cut.temp),
            "_raw_geo": raw_flag("score_geo", cut.geo),
            "_raw_tamper": raw_flag("score_tamper", cut.tamper),
            "thr_attack": attack_threshold(cut.attack_sup_base, config.risk),
            "high_risk": high_risk(config.risk),
        },
        {"_raw_attack": raw_flag("score_attack_sup", "thr_attack")},
    )


def layers_after(config: DecisionConfig) -> tuple[Layer, ...]:
    """What follows from the persistent flags: label, action and risk."""
    return (
        operational_decision(),
        {
            "recommended_action": recommended_action(config.actions),
            "risk_score_combined": combined_risk(config.actions),
        },
    )


def decide(
    scored: DataFrame,
    config: DecisionConfig = DecisionConfig(),
    *,
    order_by: str = S.ROW_ID,
    policy: SplitPolicy = DEFAULT_SPLIT,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Scored telemetry with alerts, operational label, action and risk."""
    n = config.persistence
    g = device_series(scored, n, order_by=order_by, policy=policy, sizes=sizes)
    for layer in layers_before(config):
        g = g.add(**layer)
    g = g.add(
        pred_temp_bin=persistent(g, "_raw_temp", n.temp),
        pred_geo_bin=persistent(g, "_raw_geo", n.geo),
        pred_tamper_bin=f"greatest({persistent(g, '_raw_tamper', n.tamper)}, {TAMPERED})",
        pred_attack_bin=persistent_by_risk(g, "_raw_attack", n.attack),
    )
    for layer in layers_after(config):
        g = g.add(**layer)
    return g.finish()


def decide_laid_out(g: OrderedGroups, config: DecisionConfig = DecisionConfig()) -> DataFrame:
    """`decide` on scored own rows that are laid out per device already: the same
    exchange and sort serve features, scores and decisions. Where devices are cut
    the scored rows are written on the way; else nothing is."""
    n = config.persistence
    for layer in layers_before(config):
        g = g.add(**layer)
    raw = {
        "_held_temp": ("_raw_temp", n.temp),
        "_held_geo": ("_raw_geo", n.geo),
        "_held_tamper": ("_raw_tamper", n.tamper),
        "_held_attack": ("_raw_attack", n.attack),
    }
    longer = {name: (flag, rows) for name, (flag, rows) in raw.items() if rows > 1}
    if longer:
        g = g.flagged_runs(**longer)
    held = {name: name if name in longer else flag for name, (flag, _) in raw.items()}
    g = g.add(
        pred_temp_bin=held["_held_temp"],
        pred_geo_bin=held["_held_geo"],
        pred_tamper_bin=f"greatest({held['_held_tamper']}, {TAMPERED})",
        pred_attack_bin=f"IF(high_risk, _raw_attack, {held['_held_attack']})",
    )
    for layer in layers_after(config):
        g = g.add(**layer)
    return g.finish()
