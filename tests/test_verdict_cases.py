"""Rows the given tables do not hold: nulls, separators, small groups, text keys."""

from pyspark.sql import functions as F

from planlab.operators import ordered
from planlab.operators.features import describe
from planlab.operators.profile import token_share
from planlab.operators.relational import join_keep_right, not_exists_other
from planlab.operators.sampling import uniform_sample_grouped


def test_not_exists_keeps_null_keys_and_values(spark):
    rows = [(1, "a"), (1, None), (2, "a"), (2, "b"), (None, "a")]
    got = not_exists_other(spark.createDataFrame(rows, "k int, v string"), "k", "v").collect()
    assert sorted((r.k or 0, r.v or "") for r in got) == [(0, "a"), (1, ""), (1, "a")]


def test_describe_keeps_percentiles_of_a_null_group(spark):
    got = describe(spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", 5.0)], "k string, v double"), ["k"], "v")
    assert {r["k"]: r["50%"] for r in got.collect()} == {None: 2.0, "x": 5.0}


def test_token_separator_is_no_pattern(spark):
    got = token_share(spark.createDataFrame([("ab|cd",), ("cd",)], "t string"), "t", "|")
    assert {r.token: r.n for r in got.collect()} == {"ab": 1, "cd": 2}


def test_small_group_gives_first_and_last_row(spark):
    df = spark.createDataFrame([(i, float(v), g) for i, (v, g) in enumerate([(1, "s"), (2, "s"), (3, "s")])], "id int, v double, g string")
    got = uniform_sample_grouped(df, "id", "v", "g", 0.1).collect()
    assert {0, 2} <= {r["id"] for r in got}


def test_row_numbers_of_a_hot_group_in_text_order(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("t"), "id")
    got = ordered.row_numbers(df.repartition(7), [], ["t"], parts=8).collect()
    assert all(r.rn == r.id + 1 for r in got)


def test_chained_joins_read_each_table_once(spark, tmp_path):
    spark.range(20).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    chain = df
    for _ in range(3):
        chain = join_keep_right(chain, spark.read.parquet(str(tmp_path / "t")), "k", "k")
    assert chain._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 4
    assert chain.count() == 20
