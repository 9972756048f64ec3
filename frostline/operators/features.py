"""Per-device time-series features.

Each family lists its columns by *layer*; layers of one depth are merged across
families into one projection whose window functions all share the device
window. The whole plan so needs one exchange and one sort however many columns
it adds. Frames count rows, never minutes, and look backwards only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

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
from frostline.sources.telemetry import has_gps

# Rows a feature may reach back: the smoothed mean composes 125 steps, its
# weights have then faded below double precision.
LOOKBACK = 128

_RADIX = 5
_STRIDES = (1, 5, 25)

ROLLING_WIDTHS = (3, 5, 7)
SPEED_WIDTHS = (5, 12)
DUPLICATE_WIDTHS = (5, 10)

TIMING = (
    ["delay_min", "delay_big", "rpt_gap_min", "rcv_gap_min", "gap_err_min"]
    + ["rpt_ooo", "delay_med_1h", "delay_std_1h", "delay_z"]
    + ["rpt_gap_cv_5", "rcv_gap_cv_5", "reported_ts_diff_min"]
)
GPS = ["gps_same", "gps_repeat_count", "gps_repeat_cap10"]
SENSOR = (
    [f"{m}_roll_{s}_{w}" for m in ("temp", "hum") for s in ("mean", "std") for w in ROLLING_WIDTHS]
    + [f"dist_roll_max_{w}" for w in ROLLING_WIDTHS]
    + ["delta_temp", "delta_hum", "delta_dist", "temp_var_5", "hum_var_5"]
    + ["zcr_temp_5", "zcr_hum_5"]
)
SMOOTHED = ["temp_resid", "hum_resid", "temp_resid_std_ratio", "hum_resid_std_ratio"]
KINEMATIC = ["speed_mps", "accel_mps2", "jerk_mps3", "teleport_flag"] + [
    f"{m}_{w}" for w in SPEED_WIDTHS for m in ("speed_mean", "speed_std", "accel_std")
]
REPLAY = ["dup_flag"] + [f"dup_ratio_{w}" for w in DUPLICATE_WIDTHS]
FAMILIES: dict[str, list[str]] = {
    "timing": TIMING,
    "gps": GPS,
    "sensor": SENSOR,
    "smoothed": SMOOTHED,
    "kinematic": KINEMATIC,
    "replay": REPLAY,
}
ALL_FEATURES = [name for names in FAMILIES.values() for name in names]

_SENSORS = {
    "temp": "temp_reported",
    "hum": "humidity_reported",
    "dist": "distance_from_route_reported",
}

# Layers, in order. Windowed layers reach back over rows; the layers between
# them only combine columns. Each smoothing round takes two layers. The rolling
# frames add most columns and so come with the last round: every window buffers
# its rows, and the earlier ones then buffer narrow ones.
_LAGS, _FROM_LAGS, _GAPS, _FROM_GAPS, _SMOOTH = range(5)
_FRAMES = _SMOOTH + 2 * (len(_STRIDES) - 1)
_FROM_FRAMES = _FRAMES + 1
_LATE = _FROM_FRAMES + 1
_DEPTH = _LATE + 2

Layers = dict[int, dict[str, str]]


def _timing(g: OrderedGroups) -> Layers:
    ordered, last5, last12 = g.frames.ordered, g.frames.last(5), g.frames.last(12)
    delay = X.minutes_between(S.REPORTED, S.RECEIVED)
    gap_err = "rpt_gap_min - rcv_gap_min"

    def variation(gap: str) -> str:
        """Guarded coefficient of variation; keeps the sign of a negative mean."""
        spread = f"stddev_pop({gap}) {last5} + {S.EPSILON}D"
        centre = f"avg({gap}) {last5} + {S.EPSILON}D"
        cv = f"try_divide({spread}, {centre})"
        return X.zero_if_null(f"IF(count({gap}) {last5} >= 3, {cv}, NULL)")

    ranked, count = "sort_array(_delays)", "size(_delays)"
    median = (
        f"(get({ranked}, CAST(floor(({count} - 1) / 2) AS INT))"
        f" + get({ranked}, CAST(floor({count} / 2) AS INT))) / 2D"
    )
    return {
        _LAGS: {
            "_reported_before": f"lag({S.REPORTED}) {ordered}",
            "_received_before": f"lag({S.RECEIVED}) {ordered}",
        },
        _FROM_LAGS: {
            "delay_min": delay,
            "delay_big": X.as_flag(f"{delay} >= {X.real(S.DELAY_BIG_MIN)}"),
            "rpt_gap_min": X.minutes_between("_reported_before", S.REPORTED),
            "rcv_gap_min": X.minutes_between("_received_before", S.RECEIVED),
            "rpt_ooo": X.as_flag(f"{S.REPORTED} < _reported_before"),
        },
        _FRAMES: {
            "gap_err_min": X.zero_if_null(gap_err),
            "reported_ts_diff_min": X.zero_if_null("rpt_gap_min"),
            "_delays": f"collect_list(delay_min) {last12}",
            "_delay_std": f"stddev_samp(delay_min) {last12}",
            "rpt_gap_cv_5": variation("rpt_gap_min"),
            "rcv_gap_cv_5": variation("rcv_gap_min"),
        },
        _FROM_FRAMES: {
            "delay_med_1h": f"IF({count} >= 3, {median}, NULL)",
            "delay_std_1h": f"IF({count} >= 3, _delay_std, NULL)",
        },
        _LATE: {
            "delay_z": f"(delay_min - delay_med_1h) / (delay_std_1h + {S.EPSILON}D)"
        },
    }


def _gps(g: OrderedGroups) -> Layers:
    """Frozen position; the run length is completed after the last layer."""
    same = " AND ".join(
        f"{here} = lag({here}) {g.frames.ordered}"
        for here in (
            X.round_half_even("lat_reported", 5),
            X.round_half_even("lon_reported", 5),
        )
    )
    place, reset = g.run_layers("gps_same")
    return {_LAGS: {"gps_same": X.as_flag(same), **place}, _FRAMES: reset}


def _sensor(g: OrderedGroups) -> Layers:
    ordered, last5 = g.frames.ordered, g.frames.last(5)
    lags, turns, frames, spread = {}, {}, {}, {}
    for m, c in _SENSORS.items():
        lags[f"delta_{m}"] = X.zero_if_null(f"{c} - lag({c}) {ordered}")
    for m in ("temp", "hum"):
        c = _SENSORS[m]
        lags[f"_delta_{m}_before"] = X.zero_if_null(
            f"lag({c}) {ordered} - lag({c}, 2) {ordered}"
        )
        turns[f"_turn_{m}"] = (
            f"CAST(signum(delta_{m}) <> signum(_delta_{m}_before) AS INT)"
        )
        for n in ROLLING_WIDTHS:
            frame = g.frames.last(n)
            frames[f"{m}_roll_mean_{n}"] = f"avg({c}) {frame}"
            frames[f"{m}_var_{n}"] = X.zero_if_null(f"var_samp({c}) {frame}")
            spread[f"{m}_roll_std_{n}"] = f"sqrt({m}_var_{n})"
        frames[f"zcr_{m}_5"] = f"IF(_row >= 2, avg(_turn_{m}) {last5}, NULL)"
    for n in ROLLING_WIDTHS:
        frames[f"dist_roll_max_{n}"] = f"max({_SENSORS['dist']}) {g.frames.last(n)}"
    return {_LAGS: lags, _FROM_LAGS: turns, _FRAMES: frames, _FROM_FRAMES: spread}


def _smoothed(g: OrderedGroups) -> Layers:
    """Deviation from the exponentially weighted mean.

    With decay d = 1 - alpha, a value g rows after the previous one moves the
    mean to c * mean + (1 - c) * value, c = d^g / (d^g + alpha); a missing value
    keeps it. Such steps compose, so each round joins five stretches of the one
    before (1, 5, 25 rows apart): 125 steps after three rounds, each by lag.
    """
    ordered, before = g.frames.ordered, g.frames.before
    alpha = 2.0 / (S.EWMA_SPAN + 1.0)
    layers: Layers = {depth: {} for depth in range(_DEPTH)}
    for m in ("temp", "hum"):
        value, keep, add = _SENSORS[m], f"_keep_{m}", f"_add_{m}"
        seen_at = f"max(IF({value} IS NULL, NULL, _row)) {before}"
        fade = f"_fade_{m}"
        layers[_GAPS][fade] = f"pow({1.0 - alpha!r}D, _row - {seen_at})"
        # weights of the running mean and of the value; they add up to 1
        layers[_FROM_GAPS][keep] = (
            f"IF({value} IS NULL, 1D, coalesce({fade} / ({fade} + {alpha!r}D), 0D))"
        )
        layers[_FROM_GAPS][add] = X.zero_if_null(
            f"{value} * coalesce({alpha!r}D / ({fade} + {alpha!r}D), 1D)"
        )
        for n, stride in enumerate(_STRIDES):
            reach, join = _SMOOTH + 2 * n, _SMOOTH + 2 * n + 1
            for k in range(1, _RADIX):
                layers[reach][f"{keep}{k}"] = f"lag({keep}, {stride * k}, 1D) {ordered}"
                layers[reach][f"{add}{k}"] = f"lag({add}, {stride * k}, 0D) {ordered}"
            total, mean = f"{keep}{_RADIX - 1}", f"{add}{_RADIX - 1}"
            for k in reversed(range(_RADIX - 1)):
                here = k or ""
                total = f"{keep}{here} * ({total})"
                mean = f"{add}{here} + {keep}{here} * ({mean})"
            layers[join] |= {keep: total, add: mean}
        layers[_LATE][f"{m}_resid"] = X.zero_if_null(f"{value} - {add}")
        layers[_LATE + 1][f"{m}_resid_std_ratio"] = (
            f"{m}_resid / ({m}_roll_std_3 + {S.EPSILON}D)"
        )
    return layers


def _kinematic(g: OrderedGroups) -> Layers:
    ordered = g.frames.ordered
    moved = X.great_circle_m("_lat_before", "_lon_before", "lat_reported", "lon_reported")
    elapsed = X.seconds_between("_reported_before", S.REPORTED)
    # a zero or negative step counts as one second; so does a missing one, but
    # only for the speed
    step = f"IF({elapsed} IS NULL, NULL, greatest({elapsed}, 1D))"
    change = f"speed_mps - lag(speed_mps) {ordered}"
    frames = {
        "jerk_mps3": X.zero_if_null(f"accel_mps2 - lag(accel_mps2) {ordered}"),
        "teleport_flag": f"CAST(speed_mps > {X.real(S.TELEPORT_MPS)} AS INT)",
    }
    for n in SPEED_WIDTHS:
        frame = g.frames.last(n)
        frames[f"speed_mean_{n}"] = f"IF(_row >= 2, avg(speed_mps) {frame}, 0D)"
        frames[f"speed_std_{n}"] = X.zero_if_null(f"stddev_samp(speed_mps) {frame}")
        frames[f"accel_std_{n}"] = X.zero_if_null(f"stddev_samp(accel_mps2) {frame}")
    return {
        _LAGS: {
            "_reported_before": f"lag({S.REPORTED}) {ordered}",
            "_lat_before": f"lag(lat_reported) {ordered}",
            "_lon_before": f"lag(lon_reported) {ordered}",
        },
        _FROM_LAGS: {
            "_elapsed": step,
            "speed_mps": f"{X.zero_if_null(moved)} / coalesce({step}, 1D)",
        },
        _GAPS: {"accel_mps2": X.zero_if_null(f"({change}) / _elapsed")},
        _FRAMES: frames,
    }


def _replay(g: OrderedGroups, gps: bool) -> Layers:
    ordered = g.frames.ordered
    reading = [
        X.round_half_even("temp_reported", 1),
        X.round_half_even("humidity_reported", 1),
    ]
    if gps:
        reading += [
            X.round_half_even("lat_reported", 5),
            X.round_half_even("lon_reported", 5),
        ]
    unchanged = " AND ".join(f"{r} <=> lag({r}) {ordered}" for r in reading)
    ratios = {
        f"dup_ratio_{n}": f"IF(_row >= 2, avg(dup_flag) {g.frames.last(n)}, 0D)"
        for n in DUPLICATE_WIDTHS
    }
    # an all-missing first row must not match the absent row before it
    return {
        _LAGS: {"_unchanged": unchanged},
        _FROM_LAGS: {"dup_flag": X.as_flag("_unchanged AND _row > 1")},
        _FRAMES: ratios,
    }


def _merge(families: Sequence[Layers]) -> list[dict[str, str]]:
    return [
        {name: e for family in families for name, e in family.get(depth, {}).items()}
        for depth in range(_DEPTH)
    ]


def _without_gps(df: DataFrame, names: Sequence[str]) -> DataFrame:
    counts = (*GPS, "teleport_flag")
    return df.withColumns(
        {n: F.lit(0) if n in counts else F.lit(0.0) for n in names}
    )


def lay_out_reports(
    df: DataFrame,
    *,
    order_by: str = S.ROW_ID,
    policy: SplitPolicy = DEFAULT_SPLIT,
    sizes: GroupSizes | None = None,
) -> OrderedGroups:
    """Reports per device with as much history as the features need."""
    return lay_out(
        df.where(F.col(S.DEVICE).isNotNull()),
        [S.DEVICE],
        (S.RECEIVED, order_by),
        lookback=LOOKBACK,
        policy=policy,
        sizes=sizes,
    )


def _named(families: Sequence[str]) -> list[str]:
    # the smoothed ratio divides by the sensors' rolling deviation
    wanted = {*families, "sensor"} if "smoothed" in families else {*families}
    return [name for name in FAMILIES if name in wanted]


def add_features(
    g: OrderedGroups, gps: bool, families: Sequence[str] = tuple(FAMILIES)
) -> tuple[OrderedGroups, list[str]]:
    """Reports of `lay_out_reports` with the features, and the features' names."""
    wanted = _named(families)
    build: dict[str, Callable[[], Layers]] = {
        "timing": lambda: _timing(g),
        "sensor": lambda: _sensor(g),
        "smoothed": lambda: _smoothed(g),
        "replay": lambda: _replay(g, gps),
    }
    if gps:
        build |= {"gps": lambda: _gps(g), "kinematic": lambda: _kinematic(g)}
    layers = _merge([make() for name, make in build.items() if name in wanted])
    layers[_LAGS]["_row"] = f"row_number() {g.frames.ordered}"
    for layer in layers:
        g = g.add(**layer)
    if gps and "gps" in wanted:
        g = g.run_length("gps_repeat_count")
        g = g.add(gps_repeat_cap10=f"least(gps_repeat_count, {S.RUN_CAP})")
    named = [n for name in wanted for n in FAMILIES[name]]
    if not gps:
        g = g.with_rows(_without_gps(g.rows, [n for n in named if n in GPS + KINEMATIC]))
    return g, named


def engineer_features(
    df: DataFrame,
    families: Sequence[str] = tuple(FAMILIES),
    *,
    gps: bool | None = None,
    order_by: str = S.ROW_ID,
    policy: SplitPolicy = DEFAULT_SPLIT,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """The telemetry with the feature columns of the given families added.

    ``gps`` says whether the source carried positions; where it did not, the
    position features are 0. Left out, it follows the columns of df.
    """
    if gps is None:
        gps = has_gps(df)
    g = lay_out_reports(df, order_by=order_by, policy=policy, sizes=sizes)
    g, named = add_features(g, gps, families)
    return g.finish().select(*df.columns, *named)
