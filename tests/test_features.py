"""Propagation against the sequential rule, feature blocks, trimming and bins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlab.operators import features

CARDS = {"a": 100.0, "b": 40.0, "c": 7.0}


SCHEMA = "plan_id string, pos long, pact string, table_name string, selectivity double, out_cardinality long"


def drawn_plan(rng, sources, reset):
    """A plan as branches (how each opens, the steps inside it) and the output of every operator, worked out by branch.

    A step is ("by", factor), ("to", fixed) or ("open", None), which ends at 1 or is passed on. The k-th join, counted from 1, opens with
    the greater end of branches 2k - 1 and 2k, and there are as many joins as leave one branch.
    """
    ops, outputs, ends = [], [], []
    for branch in range(2 * sources - 1):
        join = branch - sources + 1  # 0 and less: a source
        if join < 1:
            table = rng.choice("abc")
            ops.append(("Data Source", table, 1.0, None))
            start = CARDS[table]
        else:
            ops.append(("Join", "a", None, None))
            start = max(ends[2 * join - 2], ends[2 * join - 1])
        steps = [rng.choice([("by", 0.25), ("by", 1.0), ("to", 6), ("open", None)]) for _ in range(rng.randint(0, 4))]
        ops += [("Filter" if k == "by" else "Group by" if k == "to" else "Partition", "a", x if k == "by" else None, x if k == "to" else None) for k, x in steps]
        values = [start]
        fixed = [i for i, (k, _) in enumerate(steps) if k == "to" or (k == "open" and reset)]
        for i, (kind, x) in enumerate(steps):
            last = max([f for f in fixed if f <= i], default=None)  # the step that set the value last
            base = start if last is None else steps[last][1] if steps[last][0] == "to" else 1.0
            values.append(base * np.prod([y for k, y in steps[(last + 1 if last is not None else 0) : i + 1] if k == "by"]))
        outputs += values
        ends.append(values[-1])
    return ops + [("Data Sink", "a", None, None)], outputs + [ends[-1]]


@pytest.mark.parametrize("unknown", ["one", "carry"])
def test_propagation_by_branches(spark, unknown):
    rng = random.Random(11)
    plans = {f"p{n}": drawn_plan(rng, n, unknown == "one") for n in (1, 2, 3, 5, 8, 21)}  # one holds most rows
    rows = [(p, j, *op) for p, (ops, _) in plans.items() for j, op in enumerate(ops)]
    cards = spark.createDataFrame(
        [(d, t, c * f) for d, f in (("s", 1.0), ("x8", 8.0)) for t, c in CARDS.items()], "data_id string, table_name string, rows double"
    )
    out = features.propagate(spark.createDataFrame(rows, SCHEMA).repartition(4), cards, ["s", "x8"], unknown).collect()
    got = {(r["data_id"], r["plan_id"], r["pos"]): r["out_cardinality"] for r in out}
    assert len(out) == 2 * len(rows)
    for p, (ops, want) in plans.items():
        for j, value in enumerate(want):
            assert got["s", p, j] == pytest.approx(value, rel=1e-9)
        if not any(op[0] in ("Group by", "Partition") for op in ops):  # nothing fixed: sizes scale through
            assert all(got["x8", p, j] == pytest.approx(8 * got["s", p, j]) for j in range(len(ops)))
        assert all(got["x8", p, j] >= got["s", p, j] for j in range(len(ops)))  # and never shrink


HAND_WORKED = [  # operators with (pact, table, selectivity, fixed) and their outputs at table sizes a 100, b 40, c 7
    ([("Data Source", "a", 1.0, None), ("Filter", "a", 0.25, None), ("Map", "a", 1.0, None), ("Data Sink", "a", None, None)], [100, 25, 25, 25]),
    ([("Data Source", "c", 1.0, None), ("Data Source", "b", 1.0, None), ("Group by", "b", None, 12), ("Join", "b", None, None), ("Filter", "b", 0.5, None),
      ("Data Sink", "b", None, None)], [7, 40, 12, 12, 6, 6]),
    ([("Data Source", "a", 1.0, None), ("Data Source", "b", 1.0, None), ("Data Source", "c", 1.0, None), ("Join", "b", None, None),
      ("Filter", "b", 0.01, None), ("Join", "c", None, None), ("Data Sink", "c", None, None)], [100, 40, 7, 100, 1, 7, 7]),
    ([("Data Source", "b", 1.0, None), ("Reduce", "b", None, 1), ("Data Sink", "b", None, None)], [40, 1, 1]),
]


def test_propagation_worked_by_hand(spark):
    rows = [(str(i), j, *op) for i, (ops, _) in enumerate(HAND_WORKED) for j, op in enumerate(ops)]
    cards = spark.createDataFrame([("s", t, c) for t, c in CARDS.items()], "data_id string, table_name string, rows double")
    got = {(r["plan_id"], r["pos"]): r["out_cardinality"] for r in features.propagate(spark.createDataFrame(rows, SCHEMA), cards, ["s"]).collect()}
    assert got == {(str(i), j): pytest.approx(x) for i, (_, want) in enumerate(HAND_WORKED) for j, x in enumerate(want)}


def test_known_plan_and_bad_join(spark):
    schema = "plan_id string, pos long, pact string, table_name string, selectivity double, out_cardinality long"
    cards = spark.createDataFrame([("s", t, c) for t, c in CARDS.items()], "data_id string, table_name string, rows double")
    plan = [("Data Source", "a", 1.0), ("Filter", "a", 0.5), ("Sort-Partition", "a", None), ("Data Source", "b", 1.0),
            ("Map", "b", 1.0), ("Join", "b", None), ("Data Sink", "b", None)]
    ops = spark.createDataFrame([("x", i, p, t, s, None) for i, (p, t, s) in enumerate(plan)], schema)
    rows = features.propagate(ops, cards, ["s"]).orderBy("pos").collect()
    assert [r["out_cardinality"] for r in rows] == [100, 50, 1, 40, 40, 40, 40]
    bad = spark.createDataFrame([("x", 0, "Data Source", "a", 1.0, None), ("x", 1, "Join", "a", None, None)], schema)
    with pytest.raises(Exception, match="two open branches"):
        features.propagate(bad, cards, ["s"]).collect()


def test_blocks(spark):
    schema = "plan_id string, data_id string, pact string, selectivity double, out_cardinality double, complexity int"
    rows = [
        ("full", "s", "Data Source", 1.0, 10.0, None), ("full", "s", "Map", 1.0, 10.0, 2), ("full", "s", "Join", None, 4.0, None),
        ("flat", "s", "Data Source", 1.0, 5.0, None), ("flat", "s", "Map", 1.0, 5.0, 0),
        ("nomap", "s", "Data Source", 1.0, 5.0, None), ("nomap", "s", "Filter", 0.5, 5.0, None),
    ]
    out = {r["plan_id"]: r for r in features.cardinality_features(spark.createDataFrame(rows, schema)).collect()}
    assert set(out) == {"full", "flat"}  # a plan without a Map has no row
    assert out["full"]["complexity_mean"] == 1000.0 and out["full"]["joinOutCard_prod"] == 4.0
    assert out["flat"]["joinOutCard_mean"] == 0.0 and out["flat"]["filterOutCard_max"] == 0.0
    assert out["flat"]["outCardinality_kurtosis"] == 0.0 and out["flat"]["outCardinality_std"] == 0.0
    assert out["full"]["outCardinality_50%"] == 10.0


def test_trimming_and_bins(spark):
    values = list(range(200))
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i)) for i in values], "id long, g string, v double")
    kept = {r["id"] for r in features.trim_outliers(df, "v", "g", 0.1).collect()}
    want = set()
    for parity in (0, 1):
        x = np.array([v for v in values if v % 2 == parity], dtype=float)
        x = x[x > np.quantile(x, 0.1)]
        want |= set(x[x < np.quantile(x, 0.9)].astype(int))
    assert kept == want
    bins = features.label_bins(df, "v", 5, "bin").groupBy("bin").count().collect()
    assert {r["bin"]: r["count"] for r in bins} == {i: 40 for i in range(5)}
    r = features.correlation(df.withColumn("w", -F.col("v")).withColumn("k", F.lit(1.0)), ["v", "w", "k"]).collect()
    table = {(x["a"], x["b"]): x["r"] for x in r}
    assert len(table) == 9 and table[("v", "w")] == pytest.approx(-1) and table[("v", "k")] == 0


def test_two_step_values(spark):
    df = spark.createDataFrame([("p", 2, ["x", "y"]), ("p", 1, ["y"]), ("p", 3, ["x"]), ("q", 1, ["z"])], "plan_id string, pos long, tables array<string>")
    got = features.used_values(df, "plan_id", "tables").orderBy("plan_id", "place").collect()
    assert [(r["plan_id"], r["value"], r["place"]) for r in got] == [("p", "y", 1), ("p", "x", 2), ("q", "z", 1)]
