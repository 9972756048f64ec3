"""Isolation forest.

A tree needs a few hundred rows, so the sample is bounded however large the
table is: trees grow one group per tree, and scoring sends the node table (at
most ``trees`` * 2 * ``sample`` rows) to every task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.operators.evaluate import DETECTOR
from frostline.operators.learning.matrix import Scaling
from frostline.operators.series import DEFAULT_SPLIT, lay_out
from frostline.operators.storage import materialise

# nodes are numbered as in a heap: the children of i are 2i + 1 and 2i + 2
_NODES = "tree int, node int, depth int, feature int, cut double, length double"

# rows scored at once inside a batch, so that the working arrays stay in cache
_BLOCK = 1024


@dataclass(frozen=True)
class ForestPolicy:
    trees: int = 100
    sample: int = 256
    contamination: float = 0.05
    seed: int = 42


def mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _max_depth(sample: int) -> int:
    return ceil(log2(max(sample, 2)))


def _grow(points: np.ndarray, max_depth: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one random tree: (node, depth, feature, cut, path length); a
    leaf has feature -1."""
    nodes: list[tuple] = []
    waiting = [(0, 0, points)]
    while waiting:
        node, depth, rows = waiting.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= max_depth or len(rows) <= 1 or not len(varying):
            nodes.append((node, depth, -1, 0.0, depth + mean_path(len(rows))))
            continue
        feature = int(rng.choice(varying))
        cut = float(rng.uniform(low[feature], high[feature]))
        left = rows[:, feature] <= cut
        nodes.append((node, depth, feature, cut, 0.0))
        waiting.append((2 * node + 1, depth + 1, rows[left]))
        waiting.append((2 * node + 2, depth + 1, rows[~left]))
    return nodes


def _walk_table(nodes: pd.DataFrame, depth: int) -> tuple[np.ndarray, ...]:
    """Per tree the full heap of cuts, and path lengths by deepest slot. Below a
    leaf every step goes left, so all walks take the same number of steps."""
    trees = int(nodes["tree"].max()) + 1
    feature = np.zeros((trees, 2**depth - 1), dtype=np.int32)
    cut = np.full(feature.shape, np.inf)
    length = np.zeros((trees, 2**depth))
    inner = nodes[nodes["feature"] >= 0]
    feature[inner["tree"], inner["node"]] = inner["feature"]
    cut[inner["tree"], inner["node"]] = inner["cut"]
    leaf = nodes[nodes["feature"] < 0]
    first = leaf["node"] - (2 ** leaf["depth"] - 1)
    length[leaf["tree"], first * 2 ** (depth - leaf["depth"])] = leaf["length"]
    return feature, cut, length


def _mean_depths(x: np.ndarray, table: tuple[np.ndarray, ...], depth: int) -> np.ndarray:
    feature, cut, length = table
    trees = len(feature)
    tree = np.arange(trees)
    out = np.empty(len(x))
    for start in range(0, len(x), _BLOCK):
        block = x[start : start + _BLOCK]
        row = np.arange(len(block))[:, None]
        at = np.zeros((len(block), trees), dtype=np.int64)
        for _ in range(depth):
            value = block[row, feature[tree, at]]
            at = 2 * at + 1 + (value > cut[tree, at])
        slots = at - (2**depth - 1)
        out[start : start + _BLOCK] = length[tree, slots].mean(axis=1)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A scrambling of 64-bit values (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Lowest:
    """Per tree the ``size`` rows with the lowest seeded draws so far. Samples of
    parts of a table merge: the lowest of all are among the lowest of each."""

    def __init__(self, trees: int, size: int, seed: int, features: int):
        self.size = size
        self.salts = _mixed(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.limits = np.full(trees, np.iinfo(np.uint64).max)
        self.tree = np.zeros(0, np.int64)
        self.draw = np.zeros(0, np.uint64)
        self.keys = np.zeros(0, np.int64)
        self.rows = np.zeros((0, features))

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        for start in range(0, len(keys), _BLOCK):
            own = keys[start : start + _BLOCK].view(np.uint64)
            draws = _mixed(own[:, None] ^ self.salts[None, :])
            at, tree = np.nonzero(draws <= self.limits)
            self.tree = np.concatenate([self.tree, tree])
            self.draw = np.concatenate([self.draw, draws[at, tree]])
            self.keys = np.concatenate([self.keys, keys[start + at]])
            self.rows = np.concatenate([self.rows, rows[start + at]])
            if len(self.tree) > 4 * self.size * len(self.salts):
                self.keep()

    def keep(self) -> None:
        order = np.lexsort((self.draw, self.tree))
        tree = self.tree[order]
        place = np.arange(len(tree)) - np.searchsorted(tree, tree)
        self.limits[tree[place == self.size - 1]] = self.draw[order[place == self.size - 1]]
        order = order[place < self.size]
        self.tree, self.draw = self.tree[order], self.draw[order]
        self.keys, self.rows = self.keys[order], self.rows[order]


def _tree_samples(rows: DataFrame, features: Sequence[str], policy: ForestPolicy) -> DataFrame:
    """Per tree its own ``sample`` distinct rows, those with the lowest seeded
    draws, as (tree, draw, key, features): every task hands on its lowest ones,
    at most ``trees * sample`` rows, in one pass."""
    names = list(features)

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Lowest(policy.trees, policy.sample, policy.seed, len(names))
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            found.add(batch.column("_key").to_numpy(zero_copy_only=False), np.column_stack(columns))
        found.keep()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(found.tree.astype(np.int32)),
                pa.array(found.draw.view(np.int64)),
                pa.array(found.keys),
                *[pa.array(found.rows[:, k]) for k in range(len(names))],
            ],
            names=["tree", "_draw", "_key", *names],
        )

    schema = "tree int, _draw long, _key long, " + ", ".join(f"`{c}` double" for c in names)
    return rows.select("_key", *names).mapInArrow(lowest, schema)


@dataclass(frozen=True)
class IsolationForest:
    scaling: Scaling
    nodes: pd.DataFrame
    sample: int
    offset: float

    def score(self, df: DataFrame, output: str = "IF_score") -> DataFrame:
        """Adds the anomaly score: near 1 for rows that are easy to isolate."""
        features = [f"z_{f}" for f in self.scaling.mean]
        scaled = self.scaling.apply(df)
        depth = _max_depth(self.sample)
        table = df.sparkSession.sparkContext.broadcast(_walk_table(self.nodes, depth))
        usual = mean_path(self.sample) or 1.0

        @F.pandas_udf("double")
        def isolate(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.column_stack([c.to_numpy(dtype=float) for c in batch])
                depths = _mean_depths(x, table.value, depth)
                yield pd.Series(np.power(2.0, -depths / usual))

        return scaled.withColumn(output, isolate(*features)).drop(*features)

    def predict(
        self, df: DataFrame, score: str = "IF_score", output: str = "IF_pred"
    ) -> DataFrame:
        return self.score(df, score).withColumn(
            output, (F.col(score) > F.lit(self.offset)).cast("int")
        )


def exact_quantile(df: DataFrame, name: str, q: float) -> float:
    """The q-quantile with linear interpolation, from distinct values and their
    running counts (a plain percentile would gather all values in one task)."""
    counts = materialise(
        df.where(F.col(name).isNotNull())
        .groupBy(F.lit("all").alias(DETECTOR), F.col(name).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = (
        lay_out(counts, [DETECTOR], ("value", "value"), policy=DEFAULT_SPLIT)
        .running_totals(upto="n")
        .finish()
    )
    place = F.lit(q) * (F.col("upto_all") - 1)
    row = ranked.agg(
        F.min(F.when(F.col("upto") > F.floor(place), F.col("value"))).alias("low"),
        F.min(F.when(F.col("upto") > F.ceil(place), F.col("value"))).alias("high"),
        F.max(place - F.floor(place)).alias("part"),
    ).first()
    return row["low"] + (row["high"] - row["low"]) * row["part"]


def fit_forest(
    train: DataFrame,
    features: Sequence[str] = S.TELEMETRY_FEATURES,
    policy: ForestPolicy = ForestPolicy(),
    *,
    order_by: str = S.ROW_ID,
) -> IsolationForest:
    """Trees on bounded samples, the cut on all scores. ``train`` is read once:
    what the forest needs of it is written, and scaling, sampling and scoring
    read that."""
    filled = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    rows = materialise(train.select(F.xxhash64(order_by).alias("_key"), *filled))
    scaling = Scaling.fit(rows, features)
    mean = np.array([scaling.mean[f] for f in features])
    deviation = np.array([scaling.deviation[f] for f in features])
    size = min(policy.sample, rows.count())
    depth = _max_depth(size)
    seed, sample, names = policy.seed, policy.sample, list(features)

    def grow(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        # the order in which a shuffle delivers rows must not change the tree
        pdf = pdf.assign(_draw=pdf["_draw"].to_numpy().view(np.uint64)).sort_values(["_draw", "_key", *names])
        points = (pdf[names].to_numpy(dtype=float)[:sample] - mean) / deviation
        grown = _grow(points, depth, np.random.default_rng([seed, int(key[0])]))
        frame = pd.DataFrame(
            grown, columns=["node", "depth", "feature", "cut", "length"]
        )
        return frame.assign(tree=key[0])[["tree", *frame.columns]]

    drawn = _tree_samples(rows, features, policy)
    nodes = drawn.groupBy("tree").applyInPandas(grow, _NODES).toPandas()
    unplaced = IsolationForest(scaling, nodes, size, 0.0)
    scores = unplaced.score(rows).select("IF_score")
    offset = exact_quantile(scores, "IF_score", 1.0 - policy.contamination)
    return IsolationForest(scaling, nodes, size, offset)
