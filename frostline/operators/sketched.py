"""Curves and frequent labels from mergeable sketches.

Exact curves shuffle one row per distinct score, exact label counts one row per
distinct label of a device. Where scores or labels are nearly as many as rows,
sketches take their place: they are filled on the map side, and only sketches are
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.operators.evaluate import DETECTOR, checked_score
from frostline.operators.storage import materialise

# -- curves -----------------------------------------------------------------------
SKETCH_K = 4096
GRID = 2000


def rank_error(k: int = SKETCH_K) -> float:
    """How far a rank (as a share of the class) read from a KLL sketch of size k
    is off at most, with 99 % confidence. Sketches of up to k scores are exact."""
    return 2.296 / k**0.9021


def score_sketches(scored: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """(detector, truth, n, sketch): one KLL sketch of the scores per class. From
    rows (detector, score, truth); missing scores are an error."""
    # negated, so that a rank counts the scores at or above a threshold
    return scored.groupBy(DETECTOR, "truth").agg(
        F.count(F.lit(1)).alias("n"),
        F.kll_sketch_agg_double(-checked_score(), F.lit(k)).alias("sketch"),
    )


def merge_sketches(sketches: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """One sketch per class from those of several days, runs or tables."""
    return sketches.groupBy(DETECTOR, "truth").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch")
    )


def sketched_points(sketches: DataFrame, grid: int = GRID) -> DataFrame:
    """Points as `evaluate.score_points` gives them, with estimated counts, at
    ``grid`` quantiles of the scores of each class. Curves, areas and thresholds
    follow from them as from exact ones; classes of up to ``grid`` rows are exact.

    The last of the evenly spaced ranks at which a score is the quantile tells
    how many rows score at least as high, to within one step."""
    places = F.array(*[F.lit(i / grid) for i in range(grid + 1)])
    steps = sketches.select(
        DETECTOR, "truth", "n", F.posexplode(F.kll_sketch_get_quantile_double("sketch", places)).alias("place", "negated")
    )
    upto = F.expr(f"(max(place) * n + {grid - 1}) div {grid}")
    own = steps.groupBy(DETECTOR, "negated", "truth", "n").agg(upto.alias("upto"))
    # at most 2 * (grid + 1) rows a detector from here on
    both = own.groupBy(DETECTOR, "negated").agg(
        *[F.max(F.when(F.col("truth") == t, F.col("upto"))).alias(f"upto{t}") for t in (0, 1)]
    )
    down = Window.partitionBy(DETECTOR).orderBy("negated")
    reached = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(DETECTOR)
    zero = F.lit(0).cast("long")
    points = both.select(
        DETECTOR,
        (-F.col("negated")).alias("score"),
        *[F.coalesce(F.max(f"upto{t}").over(reached), zero).alias(c) for c, t in (("tp", 1), ("fp", 0))],
        *[F.coalesce(F.max(f"upto{t}").over(whole), zero).alias(c) for c, t in (("pos_all", 1), ("neg_all", 0))],
    )
    down, up = (Window.partitionBy(DETECTOR).orderBy(c) for c in (F.desc("score"), F.asc("score")))
    points = points.withColumns(
        {c: F.col(t) - F.coalesce(F.lag(t).over(down), zero) for c, t in (("pos", "tp"), ("neg", "fp"))}
    ).where((F.col("pos") > 0) | (F.col("neg") > 0))
    return points.withColumns({f"lower_{c}": F.lag(c).over(up) for c in ("pos", "neg")})


def area_bounds(points: DataFrame, error: float | None = None) -> DataFrame:
    """Between which values the exact areas lie, if no share of a class is off by
    more than ``error`` (by default that of the sketch and one step): between two thresholds precision and true positive rate can only
    take values that the counts at both allow."""
    e = F.lit(rank_error() + 1 / GRID if error is None else error)
    positives, negatives = F.col("pos_all"), F.col("neg_all")
    tp, fp, tp0, fp0 = F.col("tp"), F.col("fp"), F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    few, many = F.greatest(tp0 - e * positives, F.lit(0.0)), tp + e * positives
    low = F.coalesce(F.try_divide(few, few + fp + e * negatives), F.lit(0.0))
    clear = F.greatest(fp0 - e * negatives, F.lit(0.0))
    high = F.coalesce(F.try_divide(many, many + clear), F.lit(1.0))
    recall, fall_out = F.try_divide("pos", "pos_all"), F.try_divide("neg", "neg_all")

    found = points.groupBy(DETECTOR).agg(
        (F.sum(recall * low) - 2 * e).alias("pr_low"),
        (F.sum(recall * high) + 2 * e).alias("pr_high"),
        (F.sum(fall_out * F.try_divide(tp0, positives)) - 3 * e).alias("roc_low"),
        (F.sum(fall_out * F.try_divide(tp, positives)) + 3 * e).alias("roc_high"),
    )
    clipped = {c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))) for c in found.columns[1:]}
    return found.withColumns(clipped)


# -- frequent labels ----------------------------------------------------------------
def frequent_labels(
    decided: DataFrame,
    k: int = 3,
    *,
    tracked: int = 1024,
    label: str = "operational_label",
    keys: tuple[str, ...] = (S.DEVICE,),
) -> DataFrame:
    """`rollups.top_labels` where labels are an open set: equal to it, but only
    candidates are counted exactly.

    Per group a frequent-items sketch of ``tracked`` labels gives candidates; a
    label that is none of them occurs at most ``3.5 * rows / tracked`` times.
    Candidates are counted in a second pass. If the k-th of them is not above
    that bound, some other label could be, and all labels of the group are
    counted."""
    rows = decided.select(*keys, F.col(label).alias("_label"))
    groups = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.expr(f"approx_top_k(_label, {tracked}, {tracked})").alias("_found"),
        F.approx_count_distinct("_label").alias("_distinct"),
    )
    # one row per group, with at most ``tracked`` labels
    groups = materialise(
        groups.select(
            *keys,
            F.ceil(F.lit(3.5) * F.col("_rows") / tracked).alias("_bound"),
            # so few labels never made the sketch let go of any
            (F.col("_distinct") < tracked // 2).alias("_whole"),
            F.transform("_found", lambda x: x["item"]).alias("_labels"),
        )
    )
    candidates = groups.select(*keys, F.explode("_labels").alias("_label"))
    counted = _counted(rows, candidates, keys, "_label")
    place = Window.partitionBy(*keys).orderBy(F.desc("count"), "_label")
    best = materialise(
        counted.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
    )
    last = best.groupBy(*keys).agg(F.min("count").alias("_least"), F.max("place").alias("_places"))
    sure = (F.col("_places") == k) & (F.col("_least") > F.col("_bound"))
    checked = _same(groups, last, keys, "left").withColumn("_sure", F.coalesce(sure, F.lit(False)) | F.col("_whole"))
    unsure = materialise(checked.where(~F.col("_sure")).select(*keys))
    rest = _same(rows, unsure, keys, "left_semi").groupBy(*keys, "_label").agg(F.count(F.lit(1)).alias("count"))
    rest = rest.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
    found = _same(best, unsure, keys, "left_anti").unionByName(rest)
    return found.select(*keys, F.col("_label").alias(label), "count", "place")


def _same(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """Join on keys where null is a key like others."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]
    joined = left.join(right, same, how)
    return joined.drop(*[f"_r_{c}" for c in keys])


def _counted(rows: DataFrame, candidates: DataFrame, keys: tuple[str, ...], label: str) -> DataFrame:
    """Exact counts of the candidates; others are left out before the shuffle
    where the candidates are few enough to be broadcast."""
    wanted = _same(rows, candidates, (*keys, label), "left_semi")
    return wanted.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("count"))
