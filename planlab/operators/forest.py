"""Forest predictions with quantiles: mean, quantile, spread and interval per row.

MLlib grows the trees. Which training rows share a leaf with a test row gives its label
distribution; the operators below read quantiles off that distribution without ever pairing
test rows with training rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlab.operators import ordered
from planlab.session import stored

MAX_DEPTH = 30  # the deepest tree MLlib grows
LEVEL_CELLS = 1 << 20  # block sums of all leaves that a task meets at once
MIN_FANOUT = 8  # for models of more leaves than that
BLOCK_CELLS = 1 << 17  # training weights that are searched to the single row at once
TASK_ROWS = 1 << 17  # test rows that meet them at once
FAR = np.iinfo(np.int64).max
ENDS = ["id", "copies", "path", "q", "cum", "total", "w", "y", "block", "other", "value"]


def with_vector(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol=out).transform(df)


def fit_forest(
    df: DataFrame,
    label: str,
    trees: int = 10,
    depth: int = 10,
    seed: int = 42,
    bootstrap: bool = True,
    features: str = "features",
):
    """Random forest over all features per split; depth is held to what MLlib can grow."""
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(
        featuresCol=features,
        labelCol=label,
        numTrees=trees,
        maxDepth=min(depth, MAX_DEPTH),
        featureSubsetStrategy="all",
        bootstrap=bootstrap,
        seed=seed,
        leafCol="leaf",
    ).fit(df)


def fit_tree(df: DataFrame, label: str, depth: int = 10, seed: int = 42, features: str = "features"):
    from pyspark.ml.regression import DecisionTreeRegressor

    return DecisionTreeRegressor(
        featuresCol=features, labelCol=label, maxDepth=min(depth, MAX_DEPTH), seed=seed, leafCol="leaf"
    ).fit(df)


def with_leaves(model, df: DataFrame) -> DataFrame:
    """Mean prediction and the leaf of every tree as an array: ``prediction, leaves``."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    if dict(out.dtypes)["leaf"] == "double":
        leaves = F.array(F.col("leaf").cast("int"))
    else:
        leaves = vector_to_array("leaf").cast("array<int>")
    return out.withColumn("leaves", leaves).drop("leaf")


def _per_tree(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode("leaves").alias("tree", "leaf"))


def leaf_weights(train: DataFrame, row_id: str, label: str, bags: DataFrame | None = None) -> DataFrame:
    """Training rows per tree and leaf with their share of the leaf: ``tree, leaf, pos, w, y``.

    ``pos`` is the row's place in label order. Without ``bags`` every training row of a leaf
    counts the same; with ``bags`` (``tree``, row id, ``weight``) the in-bag counts do.
    """
    placed = ordered.row_numbers(train.select(row_id, label, "leaves"), [], [label, row_id], "pos")
    long = _per_tree(placed, row_id, "pos", F.col(label).alias("y"))
    long = long.withColumn("weight", F.lit(1.0)) if bags is None else long.join(bags, ["tree", row_id])
    size = long.groupBy("tree", "leaf").agg(F.sum("weight").alias("size"))
    # one row per leaf of the model, which every task holds anyway
    return long.join(F.broadcast(size), ["tree", "leaf"]).select(
        "tree", "leaf", (F.col("pos") - 1).alias("pos"), (F.col("weight") / F.col("size")).alias("w"), "y"
    )


def _node(tree, leaf):
    """One number for a leaf of a tree."""
    return F.shiftleft(leaf.cast("bigint"), 32) + tree.cast("bigint")


def quantile_predictions(
    train: DataFrame,
    test: DataFrame,
    row_id: str,
    label: str,
    qs: list[float],
    bags: DataFrame | None = None,
    fanout: int | None = None,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """Weighted label percentiles of each test row: ``row_id, q, value``.

    ``train`` and ``test`` come from ``with_leaves``. A test row's distribution is the sum over
    trees of its leaf's weights. The wanted percentile is found by descending through label
    order in blocks: per level a task holds the block sums of one block (at most ``fanout`` per leaf, by default as
    many as keep them below ``LEVEL_CELLS``) and looks the leaves of its test rows up in them; blocks of about
    ``block_cells`` weights are searched to the single training row. What is exchanged is a record
    per test row and percentile and level, and the weights once.
    """
    weights = leaf_weights(train, row_id, label, bags)
    weights = stored(weights.select(_node(F.col("tree"), F.col("leaf")).alias("node"), "pos", "w", F.col("y").cast("double")))
    leaves = weights.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.max("pos").alias("last"))
    nodes, cells, last = leaves.agg(F.count(F.lit(1)), F.sum("c"), F.max("last")).first()
    if last is None:
        raise ValueError("no training rows")
    fanout = max(2, fanout or max(MIN_FANOUT, LEVEL_CELLS // nodes))
    sizes = [max(1, block_cells * (last + 1) // cells)]
    while sizes[-1] <= last:
        sizes.append(sizes[-1] * fanout)

    path = F.flatten(F.collect_list(F.transform("leaves", lambda leaf, tree: _node(tree, leaf))))
    paths = test.where(F.col(row_id).isNotNull()).groupBy(row_id).agg(path.alias("path"), F.count(F.lit(1)).alias("copies"))
    probes = paths.select(
        F.col(row_id).alias("id"),
        "copies",
        "path",
        F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"),
        F.lit(0).cast("bigint").alias("block"),
        F.lit(0.0).alias("cum"),
        F.lit(None).cast("double").alias("total"),
        F.lit(-1).cast("bigint").alias("prev"),
        F.lit(-1).cast("bigint").alias("next"),
    )
    kind = dict(paths.dtypes)[row_id]
    state = f"id {kind}, copies bigint, path array<bigint>, q double, block bigint, cum double, total double, prev bigint, next bigint"
    for size, wide in zip(sizes[-2::-1], sizes[:0:-1]):
        digit = F.floor(F.col("pos") % wide / size).cast("bigint")
        blocks = weights.groupBy(F.floor(F.col("pos") / wide).cast("bigint").alias("block"), "node", digit.alias("digit")).agg(
            F.sum("w").alias("w"), F.min("pos").alias("lo"), F.max("pos").alias("hi")
        )
        probes = _beside(probes, blocks, lambda a, b: _descend(a, b, fanout), state)
    size = sizes[0]
    rows = weights.select(F.floor(F.col("pos") / size).cast("bigint").alias("block"), "node", "pos", "w", "y")
    found = f"id {kind}, copies bigint, path array<bigint>, q double, cum double, total double, w double, y double, block bigint, other bigint, value double"
    ends = _beside(probes, rows, lambda a, b: _row_at(a, b, size), found)
    values = ends.where("value IS NOT NULL").select("id", "copies", "q", "value")
    if len(sizes) > 1:  # neighbours may lie in other blocks
        away = _beside(ends.where("value IS NULL"), rows, lambda a, b: _row_beside(a, b, size), found)
        values = values.unionByName(away.select("id", "copies", "q", "value"))
    once = F.col("copies") == 1
    again = F.explode(F.when(once, F.array(F.lit(1))).otherwise(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return values.select(F.col("id").alias(row_id), "q", "value", again.alias("__again")).drop("__again")


def _beside(probes: DataFrame, cells: DataFrame, search, schema: str) -> DataFrame:
    """Test rows beside the cells of their ``block``; a block with many test rows is dealt to several tasks."""
    probes = stored(probes)
    groups = probes.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).cast("int").alias("shares"))
    groups = stored(groups)  # one row per block
    share = F.pmod(F.xxhash64("id", "q"), F.col("shares")).cast("int").alias("share")
    dealt = probes.join(F.broadcast(groups), "block").select(*probes.columns, share)
    copied = cells.join(F.broadcast(groups), "block").select(
        *cells.columns, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    )
    pairs = dealt.groupBy("block", "share").cogroup(copied.groupBy("block", "share"))
    return stored(pairs.applyInArrow(search, schema))


class _Weights:
    """Weights per leaf along ``digit`` and the leaves that each test row adds up."""

    def __init__(self, probes, nodes, digits, w, count):
        order = np.lexsort((digits, nodes))
        nodes, digits, w = nodes[order], digits[order], w[order]
        new = np.ones(len(nodes), dtype=bool)
        new[1:] = (nodes[1:] != nodes[:-1]) | (digits[1:] != digits[:-1])
        self.first = np.flatnonzero(new)  # a row may be there twice
        self.order, self.count, self.n = order, count, len(probes)
        nodes, digits = nodes[self.first], digits[self.first]
        self.w = np.add.reduceat(w, self.first) if len(w) else w
        known, start = np.unique(nodes, return_index=True)
        end = np.append(start[1:], len(nodes))
        place = np.repeat(np.arange(len(known)), end - start)
        self.cum = pd.Series(self.w).groupby(place).cumsum().to_numpy()
        self.key = place * count + digits
        path = probes.column("path").combine_chunks()
        owner = np.repeat(np.arange(self.n), path.value_lengths().to_numpy(zero_copy_only=False))
        wanted = path.flatten().to_numpy(zero_copy_only=False)
        at = np.searchsorted(known, wanted)
        there = np.flatnonzero(at < len(known))
        there = there[known[at[there]] == wanted[there]]
        self.owner, at = owner[there], at[there]
        self.base, self.start, self.end = at * count, start[at], end[at]

    def upto(self, digit):
        """Weight of each test row up to and including its ``digit``."""
        i = np.searchsorted(self.key, self.base + digit[self.owner], "right")
        return np.bincount(self.owner, np.where(i > self.start, self.cum[i - 1], 0.0), self.n)

    def at(self, digit):
        """Weight of each test row at its ``digit``."""
        key = self.base + digit[self.owner]
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.bincount(self.owner, np.where(self.key[i] == key, self.w[i], 0.0), self.n)

    def holding(self, target):
        """First digit with the target mass, the last one with any if rounding leaves it short."""
        low, high = np.zeros(self.n, dtype=np.int64), np.full(self.n, self.count - 1)
        target = np.minimum(target, self.upto(high))
        while (low < high).any():
            middle = (low + high) // 2
            mass = self.upto(middle)
            enough = (mass >= target) & (mass > 0)
            low, high = np.where(enough, low, middle + 1), np.where(enough, middle, high)
        return low

    def around(self, digit, lo, hi, prev, next):
        """Nearest row with a weight on either side of the cell at ``digit``, else the one known before."""
        lo, hi = lo[self.order][self.first], hi[self.order][self.first]
        key = self.base + digit[self.owner]
        i, j = np.searchsorted(self.key, key), np.searchsorted(self.key, key, "right")
        left, right = np.full(self.n, -1), np.full(self.n, FAR)
        before, after = i > self.start, j < self.end
        np.maximum.at(left, self.owner[before], hi[i[before] - 1])
        np.minimum.at(right, self.owner[after], lo[j[after]])
        return np.where(left >= 0, left, prev), np.where(right < FAR, right, next)


def _numbers(table, *names):
    return [table.column(c).to_numpy() for c in names]


def _with(table, **columns):
    for name, values in columns.items():
        table = table.append_column(name, values) if name not in table.column_names else table.set_column(
            table.column_names.index(name), name, values
        )
    return table


def _descend(probes, blocks, count: int):
    """Choose the child block that holds the target mass; note the nearest rows beside it."""
    import pyarrow as pa

    node, digit, w, lo, hi = _numbers(blocks, "node", "digit", "w", "lo", "hi")
    q, block, cum, total, prev, next = _numbers(probes, "q", "block", "cum", "total", "prev", "next")
    found = _Weights(probes, node, digit, w, count)
    whole = found.upto(np.full(found.n, count - 1))
    total = np.where(np.isnan(total), whole, total)
    child = found.holding(q / 100.0 * total - cum)
    prev, next = found.around(child, lo, hi, prev, next)
    cum = cum + found.upto(child - 1)
    out = _with(
        probes, block=pa.array(block * count + child), cum=pa.array(cum), total=pa.array(total), prev=pa.array(prev), next=pa.array(next)
    )
    return out.drop_columns(["share"]).filter(pa.array(whole > 0))


def _row_at(probes, rows, size: int):
    """The row that holds the target mass, and the value where its neighbour lies in the same block."""
    import pyarrow as pa

    node, pos, w, y = _numbers(rows, "node", "pos", "w", "y")
    q, block, cum, total, prev, next = _numbers(probes, "q", "block", "cum", "total", "prev", "next")
    found = _Weights(probes, node, pos % size, w, size)
    whole = found.upto(np.full(found.n, size - 1))
    total = np.where(np.isnan(total), whole, total)
    digit = found.holding(q / 100.0 * total - cum)
    prev, next = found.around(digit, pos, pos, prev, next)
    cum, here = cum + found.upto(digit - 1), found.at(digit)
    with np.errstate(divide="ignore", invalid="ignore"):
        down = 100.0 / total * (cum + here / 2) >= q
    other = np.where(down, prev, next)
    out = _with(
        probes.drop_columns(["share", "prev", "next"]),
        cum=pa.array(cum),
        total=pa.array(total),
        w=pa.array(here),
        y=pa.array(_labels(pos, y, block * size + digit)),
        block=pa.array(np.where(other < 0, block, other // size)),
        other=pa.array(other),
    )
    inside = (other < 0) | (other // size == block)
    value = _interpolated(out, found, pos, y, size)
    out = _with(out, value=pa.array(value, mask=~inside))
    return out.select(ENDS).filter(pa.array(whole > 0))


def _row_beside(probes, rows, size: int):
    """The value of test rows whose neighbouring row lies in this block."""
    import pyarrow as pa

    node, pos, w, y = _numbers(rows, "node", "pos", "w", "y")
    found = _Weights(probes, node, pos % size, w, size)
    return _with(probes, value=pa.array(_interpolated(probes, found, pos, y, size))).select(ENDS)


def _labels(pos, y, wanted):
    """Labels of rows; of any row where the wanted one is not among them."""
    known, first = np.unique(pos, return_index=True)
    return y[first][np.minimum(np.searchsorted(known, wanted), len(known) - 1)]


def _interpolated(ends, found: _Weights, pos, y, size: int):
    """Value between the row that holds the target mass and its neighbour on the other side."""
    q, cum, total, w, mine, other = _numbers(ends, "q", "cum", "total", "w", "y", "other")
    w2, y2 = found.at(np.maximum(other, 0) % size), _labels(pos, y, other)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = 100.0 / total * (cum + w / 2)
        p2 = 100.0 / total * np.where(p >= q, cum - w2 / 2, cum + w + w2 / 2)
        return np.where(other < 0, mine, y2 + (q - p2) / (p - p2) * (mine - y2))


def prediction_std(train: DataFrame, test: DataFrame, row_id: str, label: str, min_variance: float = 0.0) -> DataFrame:
    """Standard deviation of the forest's answer per test row: mean over trees of leaf variance
    (at least ``min_variance``) plus squared leaf mean, less the squared overall mean."""
    stats = _per_tree(train, F.col(label).alias("y")).groupBy("tree", "leaf").agg(
        F.var_pop("y").alias("var"), F.avg("y").alias("mean")
    )
    per_row = (
        _per_tree(test, row_id)
        .join(stats, ["tree", "leaf"])
        .groupBy(row_id)
        .agg(
            F.avg(F.greatest("var", F.lit(min_variance)) + F.col("mean") * F.col("mean")).alias("second"),
            F.avg("mean").alias("mean"),
        )
    )
    gap = F.greatest(F.col("second") - F.col("mean") * F.col("mean"), F.lit(0.0))
    return per_row.select(row_id, "mean", F.sqrt(gap).alias("std"))


def interval(
    train: DataFrame, test: DataFrame, row_id: str, label: str, low: float = 25, high: float = 75, bags: DataFrame | None = None
) -> DataFrame:
    """Mean prediction, two quantiles and the width between them: ``pred, low, high, width``."""
    long = quantile_predictions(train, test, row_id, label, [low, high], bags)
    wide = long.groupBy(row_id).agg(
        F.max(F.when(F.col("q") == float(low), F.col("value"))).alias("low"),
        F.max(F.when(F.col("q") == float(high), F.col("value"))).alias("high"),
    )
    means = test.select(row_id, F.col("prediction").alias("pred"))
    return means.join(wide, row_id).withColumn("width", F.col("high") - F.col("low"))


def centred(df: DataFrame) -> DataFrame:
    """Interval and prediction moved so that the middle of the interval is 0."""
    middle = (F.col("high") + F.col("low")) / 2
    return df.withColumns(
        {
            "low_centred": F.col("low") - middle,
            "high_centred": F.col("high") - middle,
            "pred_centred": F.col("pred") - middle,
        }
    )


def importances(model, columns: list[str], spark) -> DataFrame:
    """Feature names with their importance (one row per feature)."""
    values = [float(v) for v in model.featureImportances.toArray()]
    return spark.createDataFrame(list(zip(columns, values)), "feature string, importance double")

