"""Joins and reducers with a key that holds most rows, forced onto the hot path."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from planlab.operators import ordered
from planlab.operators import relational as R
from planlab.plans.basics import join_hot_key
from planlab.sources.tables import Tables


def frames(spark):
    fact = [(1 if i % 3 else i, i) for i in range(90)] + [(None, 90)]
    side = [(1, "one"), (3, "three"), (500, "none")]
    return (
        spark.createDataFrame(fact, "k long, v long"),
        spark.createDataFrame(side, "k long, name string"),
        fact,
        dict(side),
    )


def test_hot_join(spark):
    fact, side, rows, names = frames(spark)
    inner = ordered.hot_join(fact, side, ["k"], parts=4).collect()
    assert sorted((r["v"], r["name"]) for r in inner) == sorted((v, names[k]) for k, v in rows if k in names)
    left = ordered.hot_join(fact, side, ["k"], "left", parts=4).collect()
    assert {r["v"]: r["name"] for r in left} == {v: names.get(k) for k, v in rows} and len(left) == 91


def test_join_keep_right(spark, monkeypatch):
    monkeypatch.setattr(R, "REPEAT", 7)
    fact, side, rows, names = frames(spark)
    got = Counter(r["name"] for r in R.join_keep_right(fact, side, "k", "k").collect())
    assert got == Counter(names[k] for k, _ in rows if k in names)


def test_copies_of_a_hot_key_are_spread(spark):
    """15,000 right rows of one key, 1,000 matches each: 15 million copies, shared by all tasks."""
    left, right = spark.range(1000).selectExpr("7 AS k"), spark.range(15000).selectExpr("7 AS k", "id")
    sizes = [r["count"] for r in R.join_keep_right(left, right, "k", "k").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 15_000_000 and max(sizes) < 1.3 * sum(sizes) / 8 and len(sizes) == 8


def test_copies_of_one_row_are_spread(spark):
    left, right = spark.range(3_000_000).selectExpr("7 AS k"), spark.createDataFrame([(7, "a"), (8, "b")], "k int, name string")
    sizes = [r["count"] for r in R.join_keep_right(left, right, "k", "k").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3_000_000 and max(sizes) < 1.5 * sum(sizes) / 8


def test_hot_key_copies_are_counted_by_number(spark, tmp_path):
    """Numbers that come twice, are null or below 0, types that are null or nobody's; no text in the key of the copies' count."""
    numbers = [0, 1, 1, 4, 6, -1, None]
    types = ["click"] * 3 + ["error"] * 2 + ["view", "other", None]
    spark.createDataFrame([(n, "s") for n in numbers], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(x,) for x in types], "event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = join_hot_key(Tables(spark, str(tmp_path)))
    assert got.columns == ["s_suppkey", "kind", "copies"]
    assert sorted(tuple(r) for r in got.collect()) == [(0, "click", 3), (1, "error", 4), (4, "view", 1), (6, "error", 2)]
    assert re.search(r"Aggregate \[s_suppkey#\d+L?\],", got._jdf.queryExecution().optimizedPlan().toString())


def test_hot_rows_beside_many_others_stay_whole(spark, tmp_path, monkeypatch):
    """1,500 suppliers of 200 copies, pieces of 10 at least: no supplier comes out in more than one task, tasks get the same."""
    monkeypatch.setattr(R, "REPEAT", 10)
    monkeypatch.setattr(R, "SHARES", 100, raising=False)
    made, real = [], R.repeated
    monkeypatch.setattr(R, "repeated", lambda *args, **named: made.append(real(*args, **named)) or made[-1])
    spark.range(1500).selectExpr("id AS s_suppkey", "'s' AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    kinds = "array('click', 'error', 'purchase', 'signup', 'view')"
    spark.range(1000).selectExpr(f"{kinds}[cast(id % 5 AS int)] AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    got = join_hot_key(Tables(spark, str(tmp_path)))
    assert sorted(tuple(r) for r in got.select("s_suppkey", "copies").collect()) == [(i, 200) for i in range(1500)]
    met = made[0].groupBy("s_suppkey", F.spark_partition_id().alias("task")).count().collect()
    assert len(met) == 1500 and {r["count"] for r in met} == {200}
    sizes = Counter(r["task"] for r in met)
    assert len(sizes) == 8 and max(sizes.values()) < 1.3 * 1500 / 8


def test_one_hot_row_beside_many_others_is_spread(spark, monkeypatch):
    monkeypatch.setattr(R, "REPEAT", 100)
    left = spark.range(2_004_000).selectExpr("if(id < 2000000, -1, id % 4000) AS k")
    right = spark.range(-1, 4000).selectExpr("id AS k", "'x' AS name")
    rows = R.join_keep_right(left, right, "k", "k", hot=True)
    sizes = rows.groupBy("k", F.spark_partition_id().alias("task")).count().collect()
    hot = [r["count"] for r in sizes if r["k"] == -1]
    assert sum(hot) == 2_000_000 and len(hot) == 8 and max(hot) < 1.2 * 250_000
    assert sum(r["count"] for r in sizes) == 2_004_000


def test_copies_at_the_borders_of_pieces_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "REPEAT", 2500)
    weights = [0, 1, 999, 1000, 1001, 2000, 2001, 2499, 2500, 2501, 5000, 7001, 3, 3, -2, None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], f"id int, {R.WEIGHT} long")
    for total in (None, F.lit(None).cast("double"), F.lit(1.0), F.lit(5e6), F.lit(1e12)):
        rows = R.repeated(df, total=total)
        assert rows.columns == ["id"]
        got = {r["id"]: r["count"] for r in rows.groupBy("id").count().collect()}
        assert got == {i: w for i, w in enumerate(weights) if w and w > 0}


def test_weights_pass_through_joins(spark):
    """A chain of joins by weights stands for the rows of the chain that repeats them."""
    a = spark.createDataFrame([(i % 3, i) for i in range(20)], "k int, v int")
    b = spark.createDataFrame([(i % 3, i % 4) for i in range(7)] + [(None, 1)], "k int, j int")
    c = spark.createDataFrame([(i % 5,) for i in range(9)], "j int")
    short = R.matched_right(R.matched_right(a, b, "k", "k"), c, "j", "j")
    long = R.join_keep_right(R.join_keep_right(a, b, "k", "k"), c, "j", "j")
    want = Counter(z.j for x in a.collect() for y in b.collect() for z in c.collect() if x.k == y.k and y.j == z.j)
    assert Counter(r.j for r in long.collect()) == want
    assert Counter(r.j for r in R.repeated(short).collect()) == want
    assert short.count() == sum(1 for z in c.collect() if z.j in {y.j for y in b.collect() if y.k is not None})


def test_lookup_with_a_repeated_key_is_refused(spark):
    fact = spark.createDataFrame([(1, 5), (2, 6), (None, 1)], "k int, v int")
    once = spark.createDataFrame([(1, 3), (2, 9), (None, 0), (None, 0)], "k int, least int")
    assert [tuple(r) for r in R.lookup_filter(fact, once, "k", F.col("v") > F.col("least")).collect()] == [(1, 5)]
    with pytest.raises(Exception, match="holds a key twice"):
        R.lookup_filter(fact, once.union(once), "k", F.col("v") > F.col("least")).collect()


def test_exists_other(spark):
    rows = [(1, 1, "n"), (1, 2, "r"), (2, 5, "r"), (2, 5, "n"), (3, 7, "n"), (3, 8, "n")]
    df = spark.createDataFrame(rows, "k long, s long, f string")
    assert {r["k"] for r in R.exists_other(df, "k", "s").collect()} == {1, 3}
    alone = R.not_exists_other(df, "k", "s", df.f == "r").collect()
    assert sorted((r["k"], r["s"]) for r in alone) == [(1, 2), (2, 5), (2, 5), (3, 7), (3, 8)]


def test_keep_one(spark):
    df = spark.createDataFrame([("a", 2, 9), ("a", 1, 3), ("b", 4, 4)], "g string, x int, y int")
    assert sorted(tuple(r) for r in R.keep_one(df, ["g"]).collect()) == [("a", 1, 3), ("b", 4, 4)]
    assert sorted(tuple(r) for r in R.keep_one(df, ["g"], "last").collect()) == [("a", 2, 9), ("b", 4, 4)]
    assert tuple(R.keep_one(df).first()) == ("a", 1, 3)
    assert R.keep_one(df.where("x > 9")).count() == 0
