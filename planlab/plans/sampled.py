"""Registered queries: samples and weighted percentiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlab.operators import sampling
from planlab.plans.basics import q
from planlab.sources.tables import Tables

COLUMNS = ["quantity", "price", "discount", "tax", "lines", "orders", "returned"]


def part_features(t: Tables) -> DataFrame:
    """One numeric row per part."""
    return t.lineitem.groupBy("l_partkey").agg(
        F.avg("l_quantity").alias("quantity"),
        F.round(F.log(F.sum("l_extendedprice")), 8).alias("price"),
        F.avg("l_discount").alias("discount"),
        F.avg("l_tax").alias("tax"),
        F.count(F.lit(1)).cast("double").alias("lines"),
        F.max("l_quantity").alias("orders"),
        F.count_if(F.col("l_returnflag") == "R").cast("double").alias("returned"),
    )


def sample_uniform(t: Tables) -> DataFrame:
    return sampling.uniform_sample(t.orders, "o_orderkey", "o_totalprice", 100)


def sample_uniform_ties(t: Tables) -> DataFrame:
    """A column with few distinct values."""
    rows = t.customer.withColumn("v", F.col("c_nationkey").cast("double"))
    return sampling.uniform_sample(rows, "c_custkey", "v", 20)


def sample_uniform_grouped(t: Tables) -> DataFrame:
    return sampling.uniform_sample_grouped(t.orders, "o_orderkey", "o_totalprice", "o_orderstatus", 0.01)


def weighted_percentiles(t: Tables) -> DataFrame:
    rows = t.events.withColumn("w", F.col("event_id") % 4)
    out = sampling.weighted_percentile(rows, ["event_type"], "value", "w", "event_id", [0, 5, 25, 50, 75, 100])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "event_type"})


def weighted_percentile_ties(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_quantity",
        F.col("l_linenumber").alias("w"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"),
    )
    out = sampling.weighted_percentile(rows, [], "l_quantity", "w", "id", [1, 33, 50, 66])
    return out.withColumns({c: F.round(c, 6) for c in out.columns})


def grouped_rows(t: Tables) -> DataFrame:
    """Orders by status, with a group of one row, a tied one, one without a scale and a null one."""
    key = F.col("o_orderkey")
    group = (
        F.when(key == 0, "one").when(key % 11 == 1, "tied").when(key % 11 == 2, "zero").when(key % 11 == 3, None).otherwise(F.col("o_orderstatus"))
    )
    value = F.when(key == 0, 7.0).when(key % 11 == 1, 5.0).when(key % 11 == 2, 0.0).otherwise(F.col("o_totalprice"))
    return t.orders.select(key, group.alias("g"), value.alias("v"))


def sample_split_grouped(t: Tables) -> DataFrame:
    """The older walk with a ratio for each group, and its test side."""
    rows = grouped_rows(t)
    ratios = rows.select("g").distinct().withColumn("ratio", 0.005 * (1 + F.length(F.coalesce("g", F.lit("")))))
    return sampling.uniform_split_grouped(rows, "o_orderkey", "v", "g", ratios)


def weighted_percentile_null(t: Tables) -> DataFrame:
    """Events of every seventh id have no type."""
    kind = F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    rows = t.events.select(kind.alias("g"), "value", "event_id", (F.col("event_id") % 4).alias("w"))
    out = sampling.weighted_percentile(rows, ["g"], "value", "w", "event_id", [0, 50, 90])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "g"})


def prefix_samples(t: Tables) -> DataFrame:
    return sampling.prefix_samples(t.orders.select("o_orderkey"), "o_orderkey", [10, 100, 1000])


def silhouettes(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda e: e.cast("double")).alias("x"))
    return sampling.silhouettes(rows, "vec_id", "label", "x").withColumn("silhouette", F.round("silhouette", 8))


def nearest_rows(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda e: e.cast("double")).alias("x"))
    return sampling.nearest_to_mean(rows, "vec_id", "label", "x")


def representatives(t: Tables) -> DataFrame:
    return sampling.representatives(part_features(t), "l_partkey", COLUMNS, 10)


def initial_sample(t: Tables) -> DataFrame:
    return sampling.spread_and_representatives(part_features(t), "l_partkey", COLUMNS, "price", 20)


POISSON = [sum(math.exp(-1.0) / math.factorial(j) for j in range(i + 1)) for i in range(12)]
SPLIT = "('0x' || substr(md5('42|' || {key}), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE"
RANK = "('0x' || substr(md5('42|' || {key}), 1, 15))::UBIGINT"


def _walk_sql(rows: str, k: str, group: str = "g", shrinking: bool = True) -> str:
    """Closed form of the threshold walk per candidate step, first step that fits."""
    steps = "range(200)" if shrinking else "range(1)"
    return f"""WITH rows AS ({rows}),
        n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {group} ORDER BY v, id) AS i, COUNT(*) OVER (PARTITION BY {group}) AS n,
                     MIN(v) OVER (PARTITION BY {group}) AS lo, MAX(v) OVER (PARTITION BY {group}) AS hi FROM rows),
        s AS (SELECT n.*, j, floor((v - lo) / ((hi - lo) / ({k}) * pow(0.99::DOUBLE, j))) + 1 AS b FROM n, {steps} r(j)),
        c AS (SELECT *, i + least(0, MIN(b - i) OVER (PARTITION BY {group}, j ORDER BY i)) AS c FROM s),
        f AS (SELECT {group} AS fg, MIN(j) AS fj FROM c WHERE i = n AND ({'c + 1 >= ' + k if shrinking else 'TRUE'}) GROUP BY 1)
        SELECT {group}, id FROM (
            SELECT *, LAG(c, 1, 0) OVER (PARTITION BY {group}, j ORDER BY i) AS p FROM c) x JOIN f ON fg = {group} AND fj = j
        WHERE c > p OR i = n"""


_WP = lambda q: f"""CASE WHEN MAX(p) < {q} THEN MAX_BY(v, i) WHEN MIN(p) >= {q} THEN MIN_BY(v, i)
    ELSE MAX_BY(v, i) FILTER (WHERE p < {q}) + ({q} - MAX(p) FILTER (WHERE p < {q}))
       / (MIN(p) FILTER (WHERE p >= {q}) - MAX(p) FILTER (WHERE p < {q}))
       * (MIN_BY(v, i) FILTER (WHERE p >= {q}) - MAX_BY(v, i) FILTER (WHERE p < {q})) END"""  # noqa: E731


def _weighted_sql(rows: str, keys: str, qs: list[int]) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""WITH r AS (SELECT * FROM ({rows}) x WHERE w <> 0),
        c AS (SELECT *, ROW_NUMBER() OVER ({part} ORDER BY v, id) AS i,
                     SUM(w) OVER ({part} ORDER BY v, id ROWS UNBOUNDED PRECEDING) AS cum, SUM(w) OVER ({part}) AS total FROM r),
        p AS (SELECT *, 100.0::DOUBLE / total * (cum - w / 2.0::DOUBLE) AS p FROM c)
        SELECT {head}{", ".join(f"ROUND({_WP(q)}, 6) AS q{q}" for q in qs)} FROM p {"GROUP BY " + keys if keys else ""}"""


QUERIES = {
    "sample_seeded": (
        q(lambda t: sampling.seeded_sample(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 50)),
        f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {RANK.format(key='o_orderkey')}, o_orderkey LIMIT 50",
    ),
    "prefix_samples": (
        q(prefix_samples),
        f"""SELECT o_orderkey, place, CASE WHEN place <= 10 THEN 10 WHEN place <= 100 THEN 100 WHEN place <= 1000 THEN 1000 END AS prefix
            FROM (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY {RANK.format(key='o_orderkey')}, o_orderkey) AS place FROM orders) x""",
    ),
    "sample_uniform": (
        q(sample_uniform),
        f"SELECT id AS o_orderkey FROM ({_walk_sql('SELECT 1 AS g, o_orderkey AS id, o_totalprice AS v FROM orders', '100')}) x",
    ),
    "sample_uniform_ties": (
        q(sample_uniform_ties),
        f"SELECT id AS c_custkey FROM ({_walk_sql('SELECT 1 AS g, c_custkey AS id, c_nationkey::DOUBLE AS v FROM customer', '20')}) x",
    ),
    "sample_uniform_grouped": (
        q(sample_uniform_grouped),
        "SELECT g AS o_orderstatus, id AS o_orderkey FROM ("
        + _walk_sql(
            "SELECT o_orderstatus AS g, o_orderkey AS id, o_totalprice / MAX(o_totalprice) OVER (PARTITION BY o_orderstatus) AS v FROM orders",
            "floor(n * 0.01::DOUBLE)",
            shrinking=False,
        )
        + ") x",
    ),
    "sample_split_grouped": (
        q(sample_split_grouped),
        """WITH rows AS (SELECT o_orderkey AS id,
                CASE WHEN o_orderkey = 0 THEN 'one' WHEN o_orderkey % 11 = 1 THEN 'tied' WHEN o_orderkey % 11 = 2 THEN 'zero'
                     WHEN o_orderkey % 11 = 3 THEN NULL ELSE o_orderstatus END AS g,
                CASE WHEN o_orderkey = 0 THEN 7.0::DOUBLE WHEN o_orderkey % 11 = 1 THEN 5.0::DOUBLE WHEN o_orderkey % 11 = 2 THEN 0.0::DOUBLE
                     ELSE o_totalprice END AS v FROM orders),
            m AS (SELECT *, CASE WHEN MAX(v) OVER (PARTITION BY g) > 0 THEN v / MAX(v) OVER (PARTITION BY g) END AS x,
                         floor(COUNT(*) OVER (PARTITION BY g) * (0.005::DOUBLE * (1 + length(coalesce(g, ''))))) AS asked FROM rows),
            n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY g ORDER BY v, id) AS i, COUNT(*) OVER (PARTITION BY g) AS n,
                         MIN(x) OVER (PARTITION BY g) AS lo, MAX(x) OVER (PARTITION BY g) AS hi FROM m),
            b AS (SELECT *, CASE WHEN x IS NULL THEN 0 WHEN asked = 0 THEN 1 WHEN hi = lo THEN 1e18
                                 ELSE floor((x - lo) / ((hi - lo) / asked)) + 1 END - i AS d FROM n),
            c AS (SELECT *, i + least(0, MIN(d) OVER (PARTITION BY g ORDER BY i)) AS c FROM b),
            l AS (SELECT *, LAG(c, 1, 0) OVER (PARTITION BY g ORDER BY i) AS p FROM c)
            SELECT id AS o_orderkey, g, v, (c > p OR i = n) AS is_train FROM l""",
    ),
    "weighted_percentile_null": (
        q(weighted_percentile_null),
        _weighted_sql(
            "SELECT CASE WHEN event_id % 7 <> 0 THEN event_type END AS g, value AS v, event_id % 4 AS w, event_id AS id FROM events", "g", [0, 50, 90]
        ),
    ),
    "weighted_percentile": (
        q(weighted_percentiles),
        _weighted_sql("SELECT event_type, value AS v, event_id % 4 AS w, event_id AS id FROM events", "event_type", [0, 5, 25, 50, 75, 100]),
    ),
    "weighted_percentile_ties": (
        q(weighted_percentile_ties),
        _weighted_sql(
            "SELECT l_quantity AS v, l_linenumber AS w, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id FROM lineitem",
            "",
            [1, 33, 50, 66],
        ),
    ),
    "bootstrap_weights": (
        q(lambda t: sampling.bootstrap_weights(t.supplier, "s_suppkey", 10)),
        "SELECT * FROM (SELECT s_suppkey, tree::INT AS tree, ("
        + " + ".join(f"CASE WHEN u >= {b!r}::DOUBLE THEN 1 ELSE 0 END" for b in POISSON)
        + ") AS weight FROM (SELECT s_suppkey, tree, ('0x' || substr(md5('42|' || tree || '|' || s_suppkey), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u"
        " FROM supplier, range(10) r(tree)) x) y WHERE weight > 0",
    ),
    "hash_split": (
        q(lambda t: sampling.hash_split(t.orders.select("o_orderkey"), "o_orderkey")),
        f"SELECT o_orderkey, {SPLIT.format(key='o_orderkey')} < 0.7 AS is_dev FROM orders",
    ),
    "silhouettes": (
        q(silhouettes),
        """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
            d AS (SELECT a.vec_id, a.label, b.label AS other,
                         SUM(pow(list_distance(a.x, b.x), 2)) AS total, COUNT(*) AS n
                  FROM e a, e b GROUP BY 1, 2, 3),
            s AS (SELECT vec_id, label, SUM(total) FILTER (WHERE other = label) / (MAX(n) FILTER (WHERE other = label) - 1) AS a,
                         MIN(total / n) FILTER (WHERE other <> label) AS b FROM d GROUP BY 1, 2)
            SELECT vec_id, label, ROUND((b - a) / greatest(a, b), 8) AS silhouette FROM s""",
    ),
    "nearest_to_mean": (
        q(nearest_rows),
        """WITH c AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings),
            m AS (SELECT label, i, AVG(v) AS m FROM c GROUP BY 1, 2),
            d AS (SELECT c.label, c.vec_id, SUM((v - m) * (v - m)) AS gap FROM c JOIN m USING (label, i) GROUP BY 1, 2)
            SELECT label, vec_id FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY label ORDER BY gap, vec_id) = 1""",
    ),
    "representatives": (q(representatives), None),
    "initial_sample": (q(initial_sample), None),
}
