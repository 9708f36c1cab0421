"""Scores, regression errors and label completion."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlab.operators import active, evaluate, forest


def test_hc3_matches_matrix_form(spark):
    rng = np.random.RandomState(3)
    x = np.c_[np.ones(80), rng.randn(80, 2)]
    y = x @ np.array([1.0, 2.0, -0.5]) + rng.randn(80) * (1 + np.abs(x[:, 1]))
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "c double, a double, b double, y double")
    got = evaluate.least_squares_hc3(df, ["c", "a", "b"], "y").collect()
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    cov = inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv
    assert [r["coefficient"] for r in got] == pytest.approx(beta)
    assert [r["std_error"] for r in got] == pytest.approx(np.sqrt(np.diag(cov)))


def test_ridge_matches_closed_form(spark):
    rng = np.random.RandomState(8)
    x = rng.rand(60) * 3
    y = 5 * x - x**3 + 4 * rng.randn(60)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2.0, None)], "x double, y double")
    got = [r["prediction"] for r in evaluate.polynomial_ridge(df, df.where("x IS NOT NULL AND y IS NOT NULL"), "x", "y", 4).collect()]
    z = np.stack([x**i for i in range(1, 5)], axis=1)
    z -= z.mean(axis=0)
    beta = np.linalg.lstsq(np.r_[z, np.eye(4)], np.r_[y - y.mean(), np.zeros(4)], rcond=None)[0]
    assert got == pytest.approx(list(y.mean() + z @ beta), rel=1e-7)


def test_grid_and_folds(spark):
    assert evaluate.grid([10], [10, 50, 500]) == [(10, 10), (10, 30)]
    sizes = evaluate.with_folds(spark.range(11), "id", 3).groupBy("fold").agg(F.count("*").alias("n"), F.min("id").alias("a")).orderBy("fold")
    assert [(r["n"], r["a"]) for r in sizes.collect()] == [(4, 0), (4, 4), (3, 8)]


def test_stop_rules(spark):
    rows = [(0, 10.0), (1, 9.5), (2, 7.0), (3, 8.0), (4, 7.1)]
    rounds = spark.createDataFrame(rows, "iteration int, uncertainty double")
    assert [r["iteration"] for r in evaluate.early_stops(rounds).where("stop").collect()] == [2, 4]
    assert [r["iteration"] for r in evaluate.stop_points(rounds).collect()] == [2]
    flat = rounds.withColumn("uncertainty", F.lit(1.0))
    assert [r["iteration"] for r in evaluate.stop_points(flat).collect()] == [4]


@pytest.mark.parametrize("random_choice", [False, True])
def test_completion(spark, random_choice):
    rng = np.random.RandomState(1)
    rows = [(i, float(a), float(b), float(np.log(50 + 10 * a * a + 5 * abs(b)))) for i, (a, b) in enumerate(rng.randn(120, 2))]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double")
    truth = df.where("id <> 7").select("id", "label")
    out = active.complete_labels(
        df.drop("label"), "id", ["a", "b"], truth, spark.range(0, 30).select("id"), max_rounds=3, trees=4, depth=3, random_choice=random_choice
    )
    final = out.final.collect()
    assert len(final) == 120 and all(r["label"] is not None for r in final)
    assert [r["id"] for r in out.missing.where("round = 0").collect()] == [7]
    known = {r["id"]: r["label"] for r in out.labels.collect()}
    for r in final:
        if r["id"] in known:
            assert r["label"] == known[r["id"]]
        else:
            assert r["low"] <= r["high"] and r["label"] == r["pred"]
    rounds = out.rounds.orderBy("iteration").collect()
    assert rounds[0]["data_size"] == 29 and [r["data_size"] for r in rounds] == sorted(r["data_size"] for r in rounds)


def test_completion_and_sweep_read_their_rows_once(spark):
    """Rows come from a costly plan: each is worked out once, however many rounds and fits there are."""
    seen = spark.sparkContext.accumulator(0)
    rng = np.random.RandomState(2)
    plain = [(i, float(a), float(np.exp(a))) for i, a in enumerate(rng.randn(60))]

    def watched(it):
        for batch in it:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(plain, "id long, a double, label double").coalesce(1).mapInArrow(watched, "id long, a double, label double")
    out = evaluate.sweep(forest.with_vector(df, ["a"]), "id", {"linear": ["label"], "forest": ["label"]}, [0.5], "label", trees=2).collect()
    assert len(out) == 4 and seen.value == 60
    truth = spark.createDataFrame([r[::2] for r in plain], "id long, label double")
    out = active.complete_labels(df.drop("label"), "id", ["a"], truth, spark.range(20), max_rounds=2, trees=2, depth=2)
    assert out.final.count() == 60 and seen.value == 120
    steps = [tuple(r) for r in out.rounds.select("iteration", "data_size", "open_rows").orderBy("iteration").collect()]
    assert steps[0] == (0, 20, 40) and all(known + left == 60 for _, known, left in steps)
