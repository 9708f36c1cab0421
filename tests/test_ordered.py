"""Ordered operators against plain Python, with one group holding most of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlab.operators import ordered

def rows(n=600, seed=3, ties=8):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
        out.append((key, float(rng.randint(0, ties)), i, rng.randint(-5, 5)))
    rng.shuffle(out)
    return out


def grouped(data):
    groups = {}
    for r in data:
        groups.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (r[1], r[2])) for k, v in groups.items()}


@pytest.mark.parametrize("parts", [3, 64])
def test_row_numbers_running_neighbours(spark, parts):
    data = rows()
    df = spark.createDataFrame(data, "k string, v double, id long, w long").repartition(5)
    want = grouped(data)
    rn = {r["id"]: r["rn"] for r in ordered.row_numbers(df, ["k"], ["v", "id"], parts=parts).collect()}
    run = {
        r["id"]: (r["s"], r["m"])
        for r in ordered.running(
            df, ["k"], ["v", "id"], {"s": ("sum", "w"), "m": ("min", "w")}, parts=parts
        ).collect()
    }
    near = {
        r["id"]: (r["nx"], r["pv"])
        for r in ordered.neighbours(
            df, ["k"], ["v", "id"], {"nx": "id"}, {"pv": "id"}, parts=parts
        ).collect()
    }
    assert len(rn) == len(run) == len(near) == len(data)
    for group in want.values():
        total, least = 0, 99
        for i, r in enumerate(group):
            total, least = total + r[3], min(least, r[3])
            assert rn[r[2]] == i + 1
            assert run[r[2]] == (total, least)
            nx = group[i + 1][2] if i + 1 < len(group) else None
            pv = group[i - 1][2] if i else None
            assert near[r[2]] == (nx, pv)


def test_no_key_is_cut(spark):
    data = rows(400)
    df = spark.createDataFrame(data, "k string, v double, id long, w long")
    got = {r["id"]: r["rn"] for r in ordered.row_numbers(df, [], ["v", "id"], parts=16).collect()}
    for i, r in enumerate(sorted(data, key=lambda r: (r[1], r[2]))):
        assert got[r[2]] == i + 1
    index = ordered.ranked(df, [], ["id"], 16)
    sizes = [r["count"] for r in index.df.groupBy("__range").count().collect()]
    assert max(sizes) < len(data) / 4


@pytest.mark.parametrize(
    "order",
    ["concat('t', lpad(CAST(id AS STRING), 4, 'x'))", "CAST(id AS DECIMAL(30, 2)) / 7", "struct(id % 10, id)", "date_add(DATE'2020-01-01', CAST(id AS INT))"],
)
def test_any_order_in_one_group(spark, order):
    """One group holds every row; text, decimal, struct and date orders."""
    df = spark.range(500).selectExpr("1 AS k", "id", f"{order} AS o")
    want = {r["id"]: i for i, r in enumerate(sorted(df.collect(), key=lambda r: r["o"]), 1)}
    got = ordered.row_numbers(df, ["k"], ["o"], parts=9)
    assert {r["id"]: r["rn"] for r in got.collect()} == want
    near = ordered.neighbours(df, ["k"], ["o"], {"nx": "id"}, {"pv": "id"}, parts=9).collect()
    back = {i: k for k, i in want.items()}
    assert {(r["id"], r["nx"], r["pv"]) for r in near} == {(k, back.get(i + 1), back.get(i - 1)) for k, i in want.items()}


def test_side_table_is_bounded_by_the_ranges(spark):
    """Ten thousand small groups and a large one: only groups cut by a border travel."""
    df = spark.range(30000).selectExpr("IF(id % 3 = 0, -1, id) AS k", "id")
    index = ordered.ranked(df, ["k"], ["id"], 12)
    assert index.border(F.count(F.lit(1)).alias("n")).count() <= 2 * 12


@pytest.mark.parametrize("method", ["linear", "lower", "higher"])
@pytest.mark.parametrize("keyed", [True, False])
def test_quantiles(spark, method, keyed):
    data = rows(500, ties=200)
    df = spark.createDataFrame(data, "k string, v double, id long, w long")
    qs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    keys = ["k"] if keyed else []
    got = ordered.quantiles(df, keys, "v", qs, method, parts=16).collect()
    groups = grouped(data) if keyed else {None: data}
    assert len(got) == len(groups) * len(qs)
    for r in got:
        values = [x[1] for x in groups[r["k"] if keyed else None]]
        assert r["n"] == len(values)
        assert r["v"] == pytest.approx(np.quantile(values, r["q"], method=method))


def test_quantile_scalar(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    assert df.where(df.v > ordered.quantile_scalar(df, "v", 0.95)).count() == 5
