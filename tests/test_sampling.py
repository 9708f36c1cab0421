"""Threshold walk by its stated properties, weighted percentile facts, stable samples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlab.operators import sampling


def thresholds_met(data, step):
    """Rows a walk with this step can hold at most: every value allows as many as the thresholds up to it."""
    values = np.sort([v for v, _ in data])
    upto = np.searchsorted(values, values, side="right")
    slack = np.floor((values - values[0]) / step) + 1 - upto
    return len(values) + min(0, slack.min())


def is_walk(data, taken, step):
    """A row is taken exactly when its value has met the threshold of its place among the taken."""
    rows = sorted(data)
    before = np.cumsum([0] + [i in taken for _, i in rows[:-1]])
    met = [v >= rows[0][0] + n * step - 1e-9 for (v, _), n in zip(rows, before)]
    return all(m == (i in taken) for m, (_, i) in zip(met[:-1], rows)) and rows[-1][1] in taken


@pytest.mark.parametrize("seed,spread,k", [(1, 40, 8), (2, 1000, 10), (3, 64, 16)])
def test_walk(spark, seed, spread, k):
    rng = random.Random(seed)
    data = [(float(rng.randint(0, spread)), i) for i in range(120)] + [(0.0, 120), (float(spread), 121)]
    df = spark.createDataFrame(data, "v double, id long")
    got = {r["id"] for r in sampling.uniform_sample(df, "id", "v", k).collect()}
    steps = spread / k * 0.99 ** np.arange(500)
    first = next(j for j, s in enumerate(steps) if thresholds_met(data, s) + 1 >= k)
    assert is_walk(data, got, steps[first])
    assert len(got) >= k - 1


def test_walk_shrinks_as_far_as_ties_ask(spark):
    # 44 rows within a millionth of the range: the step must fall by six orders of magnitude
    data = [(i * 1e-9, i) for i in range(50)] + [(1.0, 50)]
    df = spark.createDataFrame([*data, (float("-inf"), 51), (None, 52)], "v double, id long")
    got = {r["id"] for r in sampling.uniform_sample(df, "id", "v", 45).collect()}
    assert 44 <= len(got) <= 51 and got <= set(range(51)) and {0, 50} <= got
    tied = spark.createDataFrame([(0.0, i) for i in range(50)] + [(1.0, 50)], "v double, id long")
    with pytest.raises(ValueError, match="ties"):
        sampling.uniform_sample(tied, "id", "v", 45)


def test_walk_wants_more_than_there_is(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2)], "v double, id long")
    assert sampling.uniform_sample(df, "id", "v", 5).count() == 2


def percentiles(spark, values, weights, qs):
    rows = [(float(v), float(w), i) for i, (v, w) in enumerate(zip(values, weights))]
    df = spark.createDataFrame(rows, "v double, w double, id long")
    return list(sampling.weighted_percentile(df, [], "v", "w", "id", qs).first())


def test_weighted_percentile_facts(spark):
    assert percentiles(spark, [1, 2, 3], [1, 4, 5], [0, 5, 30, 50, 75, 100]) == [
        1, 1, 2, pytest.approx(2.4444444), 3, 3]
    qs = list(range(0, 110, 10))
    assert percentiles(spark, [1, 2, 3, 4, 5], [0, 0, 0, 0.1, 0.1], qs) == percentiles(spark, [4, 5], [0.1, 0.1], qs)
    x = [0.3, -1.2, 2.5, 0.9, 1.7, -0.4, 3.3, -2.2, 0.1, 4.0]
    s = sorted(x)
    middles = [(a + b) / 2 for a, b in zip(s, s[1:])]
    assert percentiles(spark, x, [0.1] * 10, list(range(10, 100, 10))) == pytest.approx(middles)
    assert percentiles(spark, x, [0.1] * 10, list(range(5, 105, 10))) == pytest.approx(s)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500)
    first = [r["id"] for r in sampling.seeded_sample(df.repartition(1), "id", 20).collect()]
    assert first == [r["id"] for r in sampling.seeded_sample(df.repartition(13), "id", 20).collect()]
    nested = sampling.prefix_samples(df.repartition(7), "id", [20, 100]).collect()
    assert {r["id"] for r in nested if r["prefix"] == 20} == set(first)
    assert sum(r["prefix"] is not None for r in nested) == 100
    share = sampling.hash_split(df, "id", 0.7).where("is_dev").count() / 500
    assert 0.6 < share < 0.8
    bags = sampling.bootstrap_weights(df, "id", 4).groupBy("tree").sum("weight").collect()
    assert all(400 < r["sum(weight)"] < 600 for r in bags)


def older_walk(values, ratio):
    """Places of the rows taken, by the rule as it is told, row after row."""
    top = max(values)
    if not top > 0:
        return {max(range(len(values)), key=lambda i: (values[i], i))}
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    norm = [values[i] / top for i in order]
    asked = int(len(values) * ratio)
    step = (norm[-1] - norm[0]) / asked if asked else float("inf")
    taken, wall = {order[-1]}, norm[0]
    for place, i in enumerate(order):
        if norm[place] >= wall:
            taken.add(i)
            wall += step
    return taken


def test_older_walk_in_every_kind_of_group(spark):
    rng = random.Random(9)
    groups = {
        "one": [3.0], "tied": [4.0] * 30, "tied few": [4.0] * 3, "zero": [0.0] * 9, "below": [-3.0, -1.0, -2.0], "pair": [1.0, 2.0],
        None: [float(rng.randint(1, 64)) for _ in range(80)], "wide": [float(rng.randint(0, 1 << 20)) for _ in range(90)],
    }
    ratios = {"one": 0.1, "tied": 0.2, "tied few": 0.1, "zero": 0.5, "below": 0.5, "pair": 1.0, None: 0.25, "wide": 0.125}
    rows = [(g, v, f"{g}/{i}") for g, values in groups.items() for i, v in enumerate(values)]
    rows += [("wide", None, "none"), ("wide", float("inf"), "inf"), ("left out", 1.0, "x")]
    df = spark.createDataFrame(rows, "g string, v double, id string").repartition(3)
    table = spark.createDataFrame(list(ratios.items()), "g string, ratio double")
    got = sampling.uniform_split_grouped(df, "id", "v", "g", table).collect()
    assert len(got) == len(rows)
    picked = {r.id for r in got if r.is_train}
    for g, values in groups.items():
        names = sorted(range(len(values)), key=lambda i: f"{g}/{i}")  # ties go by id
        want = {f"{g}/{names[i]}" for i in older_walk([values[i] for i in names], ratios[g])}
        assert {i for i in picked if i.rsplit("/")[0] == str(g)} == want, g
    assert not picked & {"none", "inf", "x"}


def test_null_group_has_percentiles(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 3.0, 2), ("a", 5.0, 3)], "g string, v double, id int").withColumn("w", F.lit(1.0))
    got = sampling.weighted_percentile(df, ["g"], "v", "w", "id", [50]).collect()
    assert {r.g: r.q50 for r in got} == {None: 2.0, "a": 5.0}


def agglomerated(points, k):
    """Ward's criterion as it is defined: merge the two clusters whose union raises the sum of squares least, again and again."""
    clusters = [[i] for i in range(len(points))]
    x = np.array(points)
    n, m = np.ones(len(x)), x.copy()
    alive = list(range(len(x)))
    while len(alive) > k:
        a = np.array(alive)
        gap = ((m[a][:, None, :] - m[a][None, :, :]) ** 2).sum(axis=2)
        cost = n[a][:, None] * n[a][None, :] / (n[a][:, None] + n[a][None, :]) * gap
        np.fill_diagonal(cost, np.inf)
        i, j = sorted(divmod(int(cost.argmin()), len(a)))
        i, j = a[i], a[j]
        m[i] = (n[i] * m[i] + n[j] * m[j]) / (n[i] + n[j])
        n[i] += n[j]
        clusters[i] += clusters[j]
        alive.remove(j)
    return {frozenset(clusters[i]) for i in alive}


def groups_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r["cluster"], set()).add(r["id"])
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("k", [1, 7, 40])
def test_ward_equals_plain_agglomeration(spark, k):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, s, (100, 3)) for c, s in ((0, 1), (4, 2), (9, 0.5), (-5, 3), (2, 0.1))])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, x array<double>").repartition(5)
    assert groups_of(sampling.ward(df, "id", k).collect()) == agglomerated(points, k)


def test_ward_over_features_keeps_every_row(spark):
    """More points than features: far groups still come out whole, copies of a point together."""
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(c, 1, (400, 2)) for c in (0, 40, 100)])
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)] + [(2000 + i, [0.5, 0.5]) for i in range(50)]
    got = groups_of(sampling.ward(spark.createDataFrame(rows, "id long, x array<double>"), "id", 3, summaries=60).collect())
    assert got == {frozenset([*range(400), *range(2000, 2050)]), frozenset(range(400, 800)), frozenset(range(800, 1200))}


def test_silhouettes_in_blocks_of_clusters(spark):
    rng = np.random.default_rng(7)
    points, label = rng.normal(0, 1, (90, 3)), [i % 30 if i else 77 for i in range(90)]
    df = spark.createDataFrame([(i, label[i], [float(v) for v in p]) for i, p in enumerate(points)], "id long, c int, x array<double>")
    gap = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    want = {}
    for i in range(90):
        own = [j for j in range(90) if label[j] == label[i] and j != i]
        others = {}
        for j in range(90):
            if label[j] != label[i]:
                others.setdefault(label[j], []).append(gap[i, j])
        a, b = (np.mean(gap[i, own]) if own else 0), min(np.mean(v) for v in others.values())
        want[i] = (b - a) / max(a, b) if own else 0.0
    for block in (1000, 7, 1):
        got = {r.id: r.silhouette for r in sampling.silhouettes(df, "id", "c", "x", block).collect()}
        assert got == {i: pytest.approx(v, abs=1e-9) for i, v in want.items()}
