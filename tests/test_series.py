import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from frostline.operators.series import (
    PIECE,
    SplitPolicy,
    lay_out,
    measure,
)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "g string, at double, id long, x long, flag int")


def _random_rows(n, seed, ties=5):
    rng = np.random.default_rng(seed)
    return [
        (
            "hot" if rng.random() < 0.6 else f"g{rng.integers(0, 4)}",
            None if rng.random() < 0.1 else float(rng.integers(0, n // ties)),
            int(i),
            int(rng.integers(0, 10)),
            int(rng.random() < 0.8),
        )
        for i in rng.permutation(n)
    ]


def _expected(rows):
    out = {}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for members in groups.values():
        members.sort(key=lambda r: (r[1] is None, r[1] or 0.0, r[2]))
        total = 0
        for place, r in enumerate(members):
            total += r[3]
            flags = [m[4] for m in members[: place + 1]]
            run = flags[::-1].index(0) if 0 in flags else len(flags)
            recent = [m[3] for m in members[max(0, place - 6) : place + 1]]
            out[r[2]] = (total, sum(m[3] for m in members), run, sum(recent))
    return out


POLICIES = [
    SplitPolicy(),
    SplitPolicy(max_rows=50),
    SplitPolicy(max_rows=10),
    SplitPolicy(max_rows=3),
]


def _actual(df, policy):
    g = lay_out(df, ["g"], ("at", "id"), lookback=6, policy=policy)
    place, reset = g.run_layers("flag")
    g = g.add(recent=f"sum(x) {g.frames.last(7)}", **place)
    g = g.add(**reset).run_length("run").running_totals(total="x")
    rows = g.finish().collect()
    return {r["id"]: (r["total"], r["total_all"], r["run"], r["recent"]) for r in rows}, len(rows)


@pytest.mark.parametrize("policy", POLICIES, ids=lambda p: f"max{p.max_rows}")
def test_state_is_carried_across_pieces(spark, policy):
    rows = _random_rows(400, seed=11)
    actual, n = _actual(_frame(spark, rows), policy)
    assert n == len(rows)
    assert actual == _expected(rows)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10_000), ties=st.sampled_from([1, 20, 150]))
def test_any_order_and_ties(spark, seed, ties):
    rows = _random_rows(150, seed=seed, ties=ties)
    actual, n = _actual(_frame(spark, rows), SplitPolicy(max_rows=8))
    assert n == len(rows)
    assert actual == _expected(rows)


def test_a_group_with_one_single_time_is_still_cut(spark):
    rows = [("hot", 1.0, i, 1, 1) for i in range(300)]
    df = _frame(spark, rows)
    g = lay_out(df, ["g"], ("at", "id"), policy=SplitPolicy(max_rows=30))
    sizes = [r["count"] for r in g.rows.groupBy(PIECE).count().collect()]
    assert sum(sizes) == 300
    assert len(sizes) > 5 and max(sizes) < 150


def test_small_groups_stay_whole(spark):
    rows = _random_rows(100, seed=3)
    g = lay_out(_frame(spark, rows), ["g"], ("at", "id"))
    assert not g.split and PIECE not in g.rows.columns


def test_measure(spark):
    sizes = measure(_frame(spark, _random_rows(200, seed=1)), ["g"])
    assert sizes.total == 200 and sizes.largest > 100


def test_empty_table(spark):
    g = lay_out(_frame(spark, []), ["g"], ("at", "id"))
    assert g.running_totals(total="x").finish().count() == 0


def test_piece_number_never_decreases(spark):
    rows = _random_rows(300, seed=9)
    g = lay_out(_frame(spark, rows), ["g"], ("at", "id"), policy=SplitPolicy(max_rows=20))
    pdf = g.rows.where("g = 'hot'").toPandas()
    pdf = pdf.sort_values(["at", "id"], na_position="last")
    assert (np.diff(pdf[PIECE]) >= 0).all()
    assert isinstance(pdf, pd.DataFrame) and pdf[PIECE].nunique() > 3


def test_lead_rows_are_limited_before_the_shuffle(spark):
    df = _frame(spark, _random_rows(200, seed=2))
    g = lay_out(df, ["g"], ("at", "id"), lookback=6, policy=SplitPolicy(max_rows=20))
    plan = g.rows._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
