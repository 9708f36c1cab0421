"""Reproducible samples, threshold walks, representatives and weighted percentiles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlab.functions.scalars import draw, hash_rank
from planlab.operators import ordered
from planlab.session import broadcast_if_small, stored

SUMMARIES = 1000  # cluster features that are merged one by one
CLUSTERS = 1000  # cluster records a row meets at once


def seeded_sample(df: DataFrame, row_id: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows chosen by a seeded hash of their id; the same rows on any cluster."""
    return df.orderBy(hash_rank(F.lit(seed), F.col(row_id)), row_id).limit(k)


def prefix_samples(df: DataFrame, row_id: str, sizes: list[int], seed: int = 42) -> DataFrame:
    """Nested samples of given sizes: the smallest size that holds the row, null for the rest.

    A row trains the prefix of size s when ``prefix <= s`` and validates it otherwise.
    """
    ranked = df.withColumn("__h", hash_rank(F.lit(seed), F.col(row_id)))
    ranked = ordered.row_numbers(ranked, [], ["__h", row_id], "place")
    prefix = F.lit(None).cast("int")
    for size in sorted(sizes, reverse=True):
        prefix = F.when(F.col("place") <= size, F.lit(size)).otherwise(prefix)
    return ranked.drop("__h").withColumn("prefix", prefix)


def hash_split(df: DataFrame, row_id: str, share: float = 0.7, seed: int = 42, out: str = "is_dev") -> DataFrame:
    """Mark a fixed share of rows by a seeded hash threshold."""
    return df.withColumn(out, draw(F.lit(seed), F.col(row_id)) < share)


def value_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per group with their count and the count up to and including them."""
    runs = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(
        F.count(F.lit(1)).alias("c")
    )
    return ordered.running(runs, keys, ["v"], {"upto": ("sum", "c")})


def _threshold(step: Column | float) -> Column:
    """Number of thresholds ``low + j * step`` at or below the value: without end at step 0, one without a step."""
    step = F.lit(step) if not isinstance(step, Column) else step
    met = F.floor(F.try_divide(F.col("v") - F.col("low"), step)) + 1
    return F.when(step == 0, F.lit(1 << 62)).when(step.isNull(), F.lit(1)).otherwise(met)


def _walk(runs: DataFrame, keys: list[str], step: Column | float) -> DataFrame:
    """How many rows of each value the walk takes.

    The walk takes a row when its value has reached the next threshold, so after the i-th row it
    holds ``i + min(0, min over j <= i of (thresholds(j) - j))`` rows. Rows of one value share
    the threshold count, and the least term of a value is at its last row, so it is enough to
    run the minimum over distinct values.
    """
    slack = runs.withColumn("__slack", _threshold(step) - F.col("upto"))
    slack = ordered.running(slack, keys, ["v"], {"__least": ("min", "__slack")}, include_row=False)
    earlier = F.least(F.lit(0), F.coalesce("__least", F.lit(0)))
    before = F.col("upto") - F.col("c") + earlier
    after = F.col("upto") + F.least(earlier, F.col("__slack"))
    return slack.select(*keys, "v", (after - before).alias("take")).where("take > 0")


def _rows_taken(df: DataFrame, keys: list[str], value: str, row_id: str, taken: DataFrame) -> DataFrame:
    """The first ``take`` rows of each value by id, and the last row of each group."""
    marked = ordered.null_safe(
        df.where(F.col(value).isNotNull()),
        broadcast_if_small(taken.withColumnRenamed("v", value)),
        [*keys, value],
        "inner",
    )
    placed = ordered.row_numbers(marked, [*keys, value], [row_id], "__place")
    picked = placed.where(F.col("__place") <= F.col("take")).select(*keys, row_id)
    last = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.max_by(row_id, F.struct(value, row_id)).alias(row_id)
    )
    return picked.unionByName(last.select(*keys, row_id)).distinct()


def uniform_sample(df: DataFrame, row_id: str, value: str, k: int, shrink: float = 0.01) -> DataFrame:
    """Ids of rows spread evenly over the range of ``value``.

    Walks sorted values with thresholds ``(max - min) / k`` apart, shrinking the step by
    ``shrink`` until at least ``k`` rows are taken; the last row always belongs to the sample.
    A step is small enough when every value has met ``upto - (total - k + 2)`` thresholds, so the
    greatest such step is one minimum and the number of shrinks its logarithm; only the chosen step is
    walked. Infinite values and NaN count as missing. Asking for at least as many rows as there
    are gives all rows; so many ties at the least value that no step does raises.
    """
    df = df.withColumn(value, F.when(F.abs(value) < F.lit(math.inf), F.col(value)))
    runs = stored(value_runs(df, [], value))
    total, low, high = runs.agg(F.sum("c"), F.min("v"), F.max("v")).first()
    if total is None or k >= total:
        return df.select(row_id)
    runs = runs.withColumn("low", F.lit(low))
    step = (high - low) / k
    if step == 0:
        return _rows_taken(df, [], value, row_id, runs.select("v", F.lit(1).alias("take")))
    needed = F.col("upto") - F.lit(total - k + 2)
    gap = (F.col("v") - F.col("low")).cast("double")
    fit = runs.agg(F.min(F.when(needed > 0, gap / needed))).first()[0]
    if fit == 0:
        raise ValueError(f"ties at the least value leave fewer than {k} rows at any step")
    shrinks = 0 if fit is None else max(0, math.ceil(math.log(fit / float(step)) / math.log1p(-shrink)) - 1)
    for _ in range(shrinks):
        step = step - shrink * step
    steps = [step]  # rounding moves the answer by one shrink at most
    for _ in range(3):
        steps.append(steps[-1] - shrink * steps[-1])
    least = runs.agg(*[F.min(_threshold(s) - F.col("upto")) for s in steps]).first()
    chosen = next(s for s, m in zip(steps, least) if total + min(0, m) + 1 >= k)
    return _rows_taken(df, [], value, row_id, _walk(runs, [], chosen))


def uniform_sample_grouped(df: DataFrame, row_id: str, value: str, by: str, ratio: float | DataFrame) -> DataFrame:
    """The older walk: values over their greatest, per group, ``ratio`` of the rows, no shrinking.

    ``ratio`` is one number, or a table (``by``, ``ratio``) with one for each group; a group it lacks has no sample. The
    step is the span over the whole number of rows asked for. Without one (fewer than one row asked for) the group gives its first
    and its last row; where all values are equal the step is 0 and every row is taken. A null group is a group. Infinite and
    missing values are left out; a group whose greatest value is not above 0 has no scale and gives its last row.
    """
    df = df.withColumn(value, F.when(F.abs(value) < F.lit(math.inf), F.col(value)))
    if isinstance(ratio, DataFrame):
        df = ordered.null_safe(df, ratio.select(by, F.col("ratio").alias("__ratio")), [by], "inner")
    else:
        df = df.withColumn("__ratio", F.lit(ratio))
    stats = df.groupBy(by).agg(F.max(value).alias("__max"), F.count(value).alias("__n"))
    norm = F.when(F.col("__max") > 0, F.try_divide(value, "__max"))
    scaled = ordered.null_safe(df, stats, [by], "inner").withColumn("__norm", norm)
    span = F.max("__norm") - F.min("__norm")
    asked = F.floor(F.max("__n") * F.max("__ratio"))
    spread = scaled.groupBy(by).agg(F.min("__norm").alias("low"), F.try_divide(span, asked).alias("step"))
    runs = ordered.null_safe(value_runs(scaled, [by], "__norm"), spread, [by], "inner")
    taken = _walk(runs, [by], F.col("step"))
    walked = _rows_taken(scaled.drop("__max", "__n", "__ratio"), [by], "__norm", row_id, taken)
    last = df.where(F.col(value).isNotNull()).groupBy(by).agg(F.max_by(row_id, F.struct(value, row_id)).alias(row_id))
    return walked.unionByName(last).distinct()


def uniform_split_grouped(df: DataFrame, row_id: str, value: str, by: str, ratio: float | DataFrame) -> DataFrame:
    """All rows with ``is_train``: is the row in the older walk's sample of its group, or on the test side."""
    picked = uniform_sample_grouped(df, row_id, value, by, ratio).withColumn("__picked", F.lit(True))
    out = ordered.null_safe(df, picked, [by, row_id], "left")
    return out.withColumn("is_train", F.coalesce("__picked", F.lit(False))).drop("__picked")


def weighted_percentile(
    df: DataFrame, keys: list[str], value: str, weight: str, row_id: str, qs: list[float]
) -> DataFrame:
    """Weighted percentile per group: columns ``q<percent>``. A null key is a group.

    A row of weight w after total weight c sits at ``100 / W * (c - w / 2)``; results are linear
    between neighbouring rows and clamped at the ends; zero weights are ignored. Rows with the
    same value are ordered by id. Only the first and last row of a value can matter, so rows
    collapse to one record per value before anything is ordered.
    """
    runs = df.where((F.col(weight) != 0) & F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(
        F.sum(F.col(weight).cast("double")).alias("w"),
        F.min_by(weight, row_id).cast("double").alias("w_first"),
        F.max_by(weight, row_id).cast("double").alias("w_last"),
    )
    runs = ordered.running(runs, keys, ["v"], {"upto": ("sum", "w")})
    totals = runs.groupBy(*keys).agg(F.max("upto").alias("total"))
    if keys:
        runs = ordered.null_safe(runs, totals, keys, "inner")
    else:
        runs = runs.withColumn("total", totals.select("total").scalar())
    scale = F.lit(100.0) / F.col("total")
    runs = runs.select(
        *keys,
        "v",
        (scale * (F.col("upto") - F.col("w") + F.col("w_first") / 2)).alias("p_first"),
        (scale * (F.col("upto") - F.col("w_last") / 2)).alias("p_last"),
    )
    cells = []
    for i, q in enumerate(qs):
        cells += [
            F.max(F.when(F.col("p_last") < q, F.struct("v", F.col("p_last").alias("p")))).alias(f"below{i}"),
            F.min(F.when(F.col("p_last") >= q, F.struct("v", F.col("p_first").alias("p")))).alias(f"above{i}"),
        ]
    ends = runs.groupBy(*keys).agg(*cells)

    def between(i: int, q: float) -> Column:
        a, b = F.col(f"below{i}"), F.col(f"above{i}")
        share = (F.lit(float(q)) - a["p"]) / (b["p"] - a["p"])
        return (
            F.when(b.isNull(), a["v"])
            .when(a.isNull() | (b["p"] < q), b["v"])
            .otherwise(a["v"] + share * (b["v"] - a["v"]))
        )

    return ends.select(*keys, *[between(i, q).alias(f"q{q:g}".replace(".", "_")) for i, q in enumerate(qs)])


def bootstrap_weights(df: DataFrame, row_id: str, trees: int, seed: int = 42) -> DataFrame:
    """How often each row enters each tree's bag: Poisson(1) counts from hashed draws, by
    inversion, so that no task needs to know the number of rows. Zero counts are left out."""
    steps, total = [], 0.0
    for count in range(12):
        total += math.exp(-1.0) / math.factorial(count)
        steps.append(total)
    long = df.select(row_id, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    u = draw(F.lit(seed), F.col("tree"), F.col(row_id))
    bounds = F.array(*[F.lit(s) for s in steps])
    return long.withColumn("weight", F.size(F.filter(bounds, lambda s: s <= u))).where("weight > 0")


def _vector(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol=out).transform(df)


def representatives(
    df: DataFrame, row_id: str, columns: list[str], k: int, components: int = 6, seed: int = 42
) -> DataFrame:
    """One row per cluster, the nearest to its cluster mean: ``row_id, cluster``."""
    clusters = clustered(df, row_id, columns, k, components, seed)
    return nearest_to_mean(clusters, row_id, "cluster", "x")


def clustered(df: DataFrame, row_id: str, columns: list[str], k: int, components: int = 6, seed: int = 42) -> DataFrame:
    """``row_id, cluster, x`` with ``x`` the principal components as an array: ``ward`` over all rows."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    rows = _vector(df.select(row_id, *columns), columns, "__raw")
    reduced = PCA(k=min(components, len(columns)), inputCol="__raw", outputCol="__pca").fit(rows).transform(rows)
    return ward(reduced.select(row_id, vector_to_array("__pca").alias("x")), row_id, k, seed)


def ward(df: DataFrame, row_id: str, k: int, seed: int = 42, summaries: int = SUMMARIES) -> DataFrame:
    """``row_id, cluster, x`` by agglomeration with Ward's criterion down to ``k`` clusters.

    Rows are first summed up to at most ``summaries`` cluster features (number of rows and their mean), each row in one of them;
    the merges then run over the features, whose weights they respect. While there are no more distinct points than ``summaries``, a
    point is its own feature and the clusters are those of plain agglomeration; beyond that the features are a fine
    k-means clustering. Only the features come to the driver.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = stored(df.select(row_id, "x"))
    points = rows.select("x").distinct()
    if points.limit(summaries + 1).count() <= summaries:
        rows = rows.withColumn("feature", F.to_json(F.struct("x")))
    else:
        vectors = rows.withColumn("__x", array_to_vector("x"))
        model = KMeans(k=summaries, seed=seed, maxIter=10, featuresCol="__x", predictionCol="feature").fit(vectors)
        rows = stored(model.transform(vectors).select(row_id, "x", F.col("feature").cast("string").alias("feature")))
    means = _cluster_means(rows, "feature", "x").groupBy("feature").agg(
        F.array_sort(F.collect_list(F.struct("i", "mean"))).alias("m")  # one entry per coordinate
    )
    sizes = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    features = means.join(sizes, "feature").select("feature", "n", F.transform("m", lambda c: c["mean"]).alias("m"))
    found = sorted(features.collect(), key=lambda r: (r["m"], r["feature"]))  # SUMMARIES at most
    if not found:
        return rows.select(row_id, F.lit(None).cast("int").alias("cluster"), "x")
    labels = ward_labels(np.array([r["n"] for r in found], dtype=float), np.array([r["m"] for r in found], dtype=float), k)
    named = df.sparkSession.createDataFrame([(r["feature"], int(c)) for r, c in zip(found, labels)], "feature string, cluster int")
    return rows.join(F.broadcast(named), "feature").select(row_id, "cluster", "x")


def ward_labels(sizes: np.ndarray, means: np.ndarray, k: int) -> np.ndarray:
    """Clusters of weighted points after Ward merges down to ``k``, numbered by their first point.

    Follows chains of nearest neighbours: two that are each other's nearest can be merged at once, whatever the rest, since merging
    two clusters never brings another closer. All merges are made, and the cheapest ones kept.
    """
    n = len(sizes)
    weight, centre, alive = sizes.astype(float).copy(), means.astype(float).copy(), np.ones(n, dtype=bool)
    merges, chain = [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        cost = weight[a] * weight / (weight[a] + weight) * ((centre - centre[a]) ** 2).sum(axis=1)
        cost[~alive] = np.inf
        cost[a] = np.inf
        b = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
            b = chain[-2]
            merges.append((cost[b], a, b))
            a, b = min(a, b), max(a, b)
            centre[a] = (weight[a] * centre[a] + weight[b] * centre[b]) / (weight[a] + weight[b])
            weight[a] += weight[b]
            alive[b] = False
            chain = chain[:-2]
        else:
            chain.append(b)
    owner = np.arange(n)
    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(0, n - k)]:
        one, two = owner[a], owner[b]
        owner[owner == max(one, two)] = min(one, two)
    return np.unique(owner, return_inverse=True)[1]


def _cluster_means(df: DataFrame, cluster: str, x: str) -> DataFrame:
    """Mean vector of each cluster, one coordinate per aggregated row."""
    cells = df.select(cluster, F.posexplode(x).alias("i", "value"))
    return cells.groupBy(cluster, "i").agg(F.avg("value").alias("mean"))


def nearest_to_mean(df: DataFrame, row_id: str, cluster: str, x: str) -> DataFrame:
    """The row of each cluster closest to the cluster's mean."""
    means = _cluster_means(df, cluster, x).groupBy(cluster).agg(
        F.array_sort(F.collect_list(F.struct("i", "mean"))).alias("__m")  # one entry per coordinate
    )
    gap = F.aggregate(
        F.zip_with(x, "__m", lambda a, m: (a - m["mean"]) * (a - m["mean"])), F.lit(0.0), lambda s, d: s + d
    )
    return (
        df.join(broadcast_if_small(means), cluster)
        .groupBy(cluster)
        .agg(F.min_by(row_id, F.struct(gap, F.col(row_id))).alias(row_id))
    )


def silhouettes(df: DataFrame, row_id: str, cluster: str, x: str, block: int = CLUSTERS) -> DataFrame:
    """Silhouette of every row with squared Euclidean distance.

    The mean squared distance from a row to a cluster follows from the cluster's size, vector
    sum and sum of squared norms, so rows meet one small record per cluster, never each other. Clusters are met in blocks of
    ``block`` records, whatever their number; a row keeps the least distance so far.
    """
    cells = df.select(cluster, F.posexplode(x).alias("i", "value"))
    sums = cells.groupBy(cluster, "i").agg(
        F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count(F.lit(1)).alias("n")
    )
    records = sums.groupBy(cluster).agg(
        F.max("n").alias("n"),
        F.sum("q").alias("q"),
        F.array_sort(F.collect_list(F.struct("i", "s"))).alias("s"),  # one entry per coordinate
    )
    records = records.select(F.col(cluster).alias("k"), "n", "q", F.transform("s", lambda c: c["s"]).alias("s"))
    records = stored(ordered.row_numbers(records, [], ["k"], "__place").withColumn("__block", F.floor((F.col("__place") - 1) / block)))
    blocks = records.agg(F.max("__block")).first()[0]
    norm = F.aggregate(x, F.lit(0.0), lambda s, a: s + a * a)

    def total(c: Column) -> Column:
        """Squared distances from the row to all rows of a cluster."""
        dot = F.aggregate(F.zip_with(x, c["s"], lambda a, b: a * b), F.lit(0.0), lambda t, p: t + p)
        return c["n"] * F.col("__norm") + c["q"] - 2 * dot

    rows = ordered.null_safe(
        df.select(row_id, cluster, x).withColumn("__norm", norm),
        records.select(F.col("k").alias(cluster), F.struct("n", "q", "s").alias("__own")), [cluster], "inner",
    ).withColumn("__b", F.lit(None).cast("double"))
    for i in range(0 if blocks is None else blocks + 1):
        some = records.where(F.col("__block") == i).agg(F.collect_list(F.struct("k", "n", "q", "s")).alias("c"))
        others = F.filter("__c", lambda c: ~c["k"].eqNullSafe(F.col(cluster)))
        least = F.array_min(F.transform(others, lambda c: total(c) / c["n"]))
        rows = rows.withColumn("__c", some.scalar()).withColumn("__b", F.least("__b", least)).drop("__c")
        if i % 8 == 7:
            rows = stored(rows)
    own = F.col("__own")
    a, b = total(own) / F.greatest(own["n"] - 1, F.lit(1)), F.col("__b")
    score = F.when(own["n"] == 1, 0.0).otherwise((b - a) / F.greatest(a, b))
    return rows.select(row_id, cluster, score.alias("silhouette"))


def spread_and_representatives(
    df: DataFrame, row_id: str, columns: list[str], value: str, k: int, seed: int = 42
) -> DataFrame:
    """Union of ``k // 2`` representatives and a threshold walk of ``k // 2`` rows."""
    half = k // 2
    a = representatives(df, row_id, columns, half, seed=seed).select(row_id)
    b = uniform_sample(df, row_id, value, half).select(row_id)
    return a.unionByName(b).distinct()

