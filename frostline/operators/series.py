"""Ordered work on groups of any size.

Time-series features need every device's rows in order. One task per device is
fine until a single device holds a large share of the table, so a group above
``SplitPolicy.max_rows`` is cut into consecutive *pieces* of about that many
rows. Windows then run per (group, piece):

* ``lookback`` rows from the end of the preceding pieces are copied in front of
  a piece (flagged ``_lead``) so that bounded frames see their full history;
* unbounded state (running sums, positions, run lengths) is carried over
  through one small row per piece.

When no group is above the limit, the plan is the plain one: one exchange on the
group, one sort, stacked windows. Otherwise the engine's range partitioner cuts
the rows, in the order of group, position and tie-breaker, and they are written
with the number of their partition. Boundaries decide only where a piece ends,
never which rows take part, and even a single repeated time is cut. Every table
that is broadcast here has at most a few rows per piece, and the number of pieces
is bounded by ``SplitPolicy.max_pieces``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from frostline.operators.storage import materialise

PIECE = "_piece"
LEAD = "_lead"
SPLIT = "_split"
_HELPERS = (PIECE, LEAD, SPLIT)


@dataclass(frozen=True)
class SplitPolicy:
    """When to cut a group and how finely.

    A piece is buffered (and spilled, if need be) by every window over it, hence
    ``max_rows``. ``max_pieces`` bounds the number of range partitions, and with
    it the one row per piece that is broadcast; on tables of more than
    ``max_rows * max_pieces`` rows the pieces grow instead.
    """

    max_rows: int = 500_000
    max_pieces: int = 100_000


@dataclass(frozen=True)
class GroupSizes:
    total: int
    largest: int


DEFAULT_SPLIT = SplitPolicy()


def measure(df: DataFrame, group: Sequence[str]) -> GroupSizes:
    """Row count of the table and of its largest group (one scan of the key
    columns, counted on the map side; a single row comes back)."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.sum("n").alias("total"), F.max("n").alias("largest")).first()
    return GroupSizes(row["total"] or 0, row["largest"] or 0)


class Frames:
    """The device window and the row frames cut from it, as OVER clauses."""

    def __init__(self, partition: Sequence[str], order: tuple[str, str]):
        position, tie = order
        self._partition = "PARTITION BY " + ", ".join(partition)
        self._order = f"ORDER BY {position} ASC NULLS LAST, {tie} ASC"

    def _over(self, frame: str = "") -> str:
        return f"OVER ({self._partition} {self._order} {frame})"

    @property
    def whole(self) -> str:
        return f"OVER ({self._partition})"

    @property
    def ordered(self) -> str:
        return self._over()

    def last(self, rows: int) -> str:
        return self._over(f"ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW")

    @property
    def so_far(self) -> str:
        return self._over("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")

    @property
    def before(self) -> str:
        return self._over("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")


@dataclass(frozen=True)
class OrderedGroups:
    """Rows ready for ordered windows, and the frames to use on them."""

    rows: DataFrame
    group: tuple[str, ...]
    order: tuple[str, str]
    split: bool
    frames: Frames

    @property
    def own(self) -> str:
        """True for a row in its own place, false for a copied lead row."""
        return f"NOT {LEAD}" if self.split else "true"

    def with_rows(self, rows: DataFrame) -> OrderedGroups:
        return replace(self, rows=rows)

    def add(self, **columns: str) -> OrderedGroups:
        """One more layer of columns, all computed from the current ones."""
        if not columns:
            return self
        return self.with_rows(
            self.rows.withColumns({n: F.expr(e) for n, e in columns.items()})
        )

    def finish(self) -> DataFrame:
        """Own rows only, without helper columns (any name starting '_')."""
        rows = self.rows.where(~F.col(LEAD)) if self.split else self.rows
        return rows.select(*[c for c in rows.columns if not c.startswith("_")])

    def own_rows(self, *columns: str) -> OrderedGroups:
        """Own rows only, with these columns, still laid out: windows over them
        need no further exchange, but no longer see the rows before a piece."""
        if not self.split:
            return self.with_rows(self.rows.select(*columns))
        return self.with_rows(self.rows.where(~F.col(LEAD)).select(*columns, *_HELPERS))

    # -- unbounded state ----------------------------------------------------
    def _per_piece(self, **aggregates: str) -> DataFrame:
        """One row per piece of the split groups."""
        return (
            self.rows.where(F.col(SPLIT) & ~F.col(LEAD))
            .groupBy(*self.group, PIECE)
            .agg(*[F.expr(e).alias(n) for n, e in aggregates.items()])
        )

    def _pieces_in_order(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(PIECE)

    def _join_pieces(self, per_piece: DataFrame) -> DataFrame:
        return _join_small(self.rows, per_piece, [*self.group, PIECE], "left")

    def running_totals(self, **measures: str) -> OrderedGroups:
        """Per measure ``m``: ``m`` = sum over the group up to this row, and
        ``m_all`` = sum over the whole group."""
        so_far, whole = self.frames.so_far, self.frames.whole
        if not self.split:
            added = {n: f"sum({e}) {so_far}" for n, e in measures.items()}
            added |= {f"{n}_all": f"sum({e}) {whole}" for n, e in measures.items()}
            return self.add(**added)

        in_order = self._pieces_in_order()
        earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
        totals = self._per_piece(**{f"_t_{n}": f"sum({e})" for n, e in measures.items()})
        totals = totals.select(
            *self.group,
            PIECE,
            *[F.sum(f"_t_{n}").over(earlier).alias(f"_before_{n}") for n in measures],
            *[
                F.sum(f"_t_{n}").over(Window.partitionBy(*self.group)).alias(f"_all_{n}")
                for n in measures
            ],
        )
        joined = self.with_rows(self._join_pieces(totals))
        own = {n: f"IF({self.own}, {e}, NULL)" for n, e in measures.items()}
        added = {
            n: f"coalesce(_before_{n}, 0) + sum({e}) {so_far}" for n, e in own.items()
        }
        added |= {
            f"{n}_all": f"coalesce(_all_{n}, sum({e}) {whole})" for n, e in own.items()
        }
        return joined.add(**added)

    def flagged_runs(self, **runs: tuple[str, int]) -> OrderedGroups:
        """Per name (flag, n): 1 where this row and the n - 1 before it are all
        flagged. For own rows: where groups are cut, the rows are written once, and
        a piece gets the flags of the last rows before it in one small row."""
        sums = {f"_sum_{n}": f"sum({flag}) {self.frames.last(w)}" for n, (flag, w) in runs.items()}
        if not self.split:
            full = {n: f"CAST(_sum_{n} = {w} AS INT)" for n, (_, w) in runs.items()}
            return self.add(**sums).add(**full)

        flags = list(dict.fromkeys(flag for flag, _ in runs.values()))
        reach = max(w for _, w in runs.values()) - 1
        places = {"_at": f"row_number() {self.frames.ordered}", "_size": f"count(1) {self.frames.whole}"}
        counted = self.add(**sums, **places)
        written = counted.with_rows(materialise(counted.rows))
        tails = written.rows.where(F.col(SPLIT) & (F.col("_size") - F.col("_at") < reach))
        in_order = Window.partitionBy(*self.group).orderBy(PIECE, "_at").rowsBetween(-reach, -1)
        before = (
            tails.select(*self.group, PIECE, "_at", F.collect_list(F.struct(*flags)).over(in_order).alias("_flags"))
            .groupBy(*self.group, PIECE)
            .agg(F.min_by("_flags", "_at").alias("_before"))
        )
        full = {}
        for n, (flag, w) in runs.items():
            # too few rows before are too few for the run as well
            lacking = f"greatest({w} - _at, 1)"
            reached = f"aggregate(slice(_before, -{lacking}, {lacking}), 0L, (a, r) -> a + r.{flag})"
            full[n] = f"CAST(_sum_{n} + IF(_at < {w}, coalesce({reached}, 0L), 0L) = {w} AS INT)"
        return written.with_rows(written._join_pieces(before)).add(**full)

    def run_layers(self, flag: str) -> tuple[dict[str, str], dict[str, str]]:
        """Two layers that ``run_length`` needs: the place of the row among its
        piece's own rows, then the latest place where the flag was 0."""
        so_far = self.frames.so_far
        reset_here = f"IF({self.own} AND {flag} = 0, _place, NULL)"
        return (
            {"_place": f"count(IF({self.own}, 1, NULL)) {so_far}"},
            {"_reset": f"max({reset_here}) {so_far}"},
        )

    def run_length(self, name: str) -> OrderedGroups:
        """Length of the current run of flag = 1, 0 where the flag is 0."""
        if not self.split:
            return self.add(**{name: "CAST(_place - coalesce(_reset, 0) AS INT)"})

        ends = self._per_piece(_rows="max(_place)", _zero="max(_reset)")
        in_order = self._pieces_in_order()
        ends = ends.withColumn(
            "_stretch",
            F.sum(F.col("_zero").isNotNull().cast("int")).over(
                in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        ).withColumn(
            "_open",
            F.sum(F.col("_rows") - F.coalesce("_zero", F.lit(0))).over(
                Window.partitionBy(*self.group, "_stretch")
                .orderBy(PIECE)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        carried = ends.select(
            *self.group, PIECE, F.lag("_open").over(in_order).alias("_carry")
        )
        run = "CAST(coalesce(_place - _reset, _place + coalesce(_carry, 0)) AS INT)"
        return self.with_rows(self._join_pieces(carried)).add(**{name: run})


def _join_small(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """rows joined with a few rows per piece; a null key is a key like others."""
    small = small.select([F.col(c).alias(f"_s_{c}") if c in keys else F.col(c) for c in small.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in keys]
    return rows.join(F.broadcast(small), same, how).drop(*[f"_s_{c}" for c in keys])


def lay_out(
    df: DataFrame,
    group: Sequence[str],
    order: tuple[str, str],
    *,
    lookback: int = 0,
    policy: SplitPolicy = DEFAULT_SPLIT,
    sizes: GroupSizes | None = None,
) -> OrderedGroups:
    """Prepare df for ordered windows per group.

    ``order`` is (position, tie-breaker): a numeric or timestamp column with
    nulls last, and a column that makes the order total. ``lookback`` is the
    number of earlier rows the bounded frames may reach back to. ``sizes``
    saves the measuring scan when the caller already knows the group sizes.
    """
    group = tuple(group)
    sizes = sizes or measure(df, group)
    plain = OrderedGroups(df, group, order, split=False, frames=Frames(group, order))
    if sizes.largest <= policy.max_rows:
        return plain
    pieces = _cut(df, group, order, min(policy.max_pieces, ceil(sizes.total / policy.max_rows)))
    laid_out = replace(
        plain, rows=pieces, split=True, frames=Frames([*group, PIECE], order)
    )
    if lookback:
        leads = _lead_rows(laid_out, lookback)
        laid_out = laid_out.with_rows(pieces.unionByName(leads))
    return laid_out


def _cut(df: DataFrame, group: tuple[str, ...], order: tuple[str, str], pieces: int) -> DataFrame:
    """Add the piece number. The engine's range partitioner deals the rows by
    (group, position, tie) into consecutive stretches of nearly equal size; a
    row's partition is its piece. Rows are written once, with their piece, and
    everything after reads the written table."""
    position, tie = order
    ranged = df.repartitionByRange(pieces, *group, F.col(position).asc_nulls_last(), F.col(tie).asc())
    rows = materialise(ranged.withColumn(PIECE, F.spark_partition_id()))
    stretches = rows.select(*group, PIECE).distinct()
    # a boundary lies within one group at most, so at most `pieces` groups are cut
    cut = stretches.groupBy(*group).agg(F.count(F.lit(1)).alias("_pieces")).where(F.col("_pieces") > 1)
    cut = materialise(cut.select(*group, F.lit(True).alias("_is_cut")))
    flagged = _join_small(rows, cut, group, "left")
    return flagged.select(
        *df.columns,
        PIECE,
        F.lit(False).alias(LEAD),
        F.coalesce("_is_cut", F.lit(False)).alias(SPLIT),
    )


def _lead_rows(laid_out: OrderedGroups, lookback: int) -> DataFrame:
    """Copies of the ``lookback`` rows before each piece, placed in that piece.

    Usually they all come from the piece before; where pieces are shorter than
    the look-back they come from as many pieces as it takes."""
    position, tie = laid_out.order
    group = laid_out.group
    in_piece = [*group, PIECE]
    from_end = Window.partitionBy(*in_piece).orderBy(
        F.col(position).desc_nulls_first(), F.col(tie).desc()
    )
    tails = (
        laid_out.rows.where(SPLIT)
        .withColumn("_from_end", F.row_number().over(from_end))
        .where(F.col("_from_end") <= lookback)
    )
    lengths = (
        laid_out.rows.where(SPLIT)
        .groupBy(*in_piece)
        .agg(F.least(F.count(F.lit(1)), F.lit(lookback)).alias("_length"))
    )
    in_order = Window.partitionBy(*group).orderBy(PIECE)
    starts = lengths.withColumn(
        "_start",
        F.coalesce(
            F.sum("_length").over(in_order.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    )
    # the pieces that begin within reach of this piece's tail
    ahead = (
        Window.partitionBy(*group).orderBy("_start").rangeBetween(1, 2 * lookback)
    )
    reach = starts.withColumn(
        "_ahead",
        F.collect_list(
            F.struct(F.col(PIECE).alias("piece"), F.col("_start").alias("start"))
        ).over(ahead),
    )
    place = F.col("_start") + F.col("_length") - F.col("_from_end")
    targets = F.filter("_ahead", lambda p: p["start"] <= place + F.lit(lookback))
    columns = [c for c in laid_out.rows.columns if c not in _HELPERS]
    return (
        _join_small(tails, reach, in_piece, "inner")
        .select(*columns, F.explode(targets).alias("_target"))
        .select(
            *columns,
            F.col("_target.piece").alias(PIECE),
            F.lit(True).alias(LEAD),
            F.lit(True).alias(SPLIT),
        )
    )
