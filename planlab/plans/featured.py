"""Registered queries: cardinality propagation and feature engineering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlab import catalog
from planlab.operators import features, ordered
from planlab.plans import joblog
from planlab.plans.basics import q
from planlab.sources.tables import Tables

KEYS = ["plan_id", "data_id"]
TYPES = ["click", "error", "purchase", "signup", "view"]


def propagate(t: Tables, unknown: str = "one") -> DataFrame:
    out = joblog.sized_operators(t, unknown)
    return out.select(*KEYS, "pos", "pact", F.round("out_cardinality", 6).alias("out_cardinality"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles for the comparison; large standard deviations carry fewer digits."""
    return df.withColumns(
        {
            c: F.round(c, 3 if c.endswith("Card_std") or c.endswith(("complexity_std", "inality_std")) else digits)
            for c, kind in df.dtypes
            if kind == "double"
        }
    )


def group_describe(t: Tables) -> DataFrame:
    out = features.describe(t.lineitem, ["l_suppkey"], "l_extendedprice")
    return rounded(out.withColumnsRenamed({"10%": "p10", "50%": "p50", "90%": "p90"}), 4)


def group_moments(t: Tables) -> DataFrame:
    out = t.lineitem.groupBy("l_suppkey").agg(*features.moments("l_quantity", ""))
    return rounded(out, 8)


def group_product(t: Tables) -> DataFrame:
    factor = 1 + F.col("l_tax")
    return t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("total"), F.round(F.product(factor), 8).alias("product")
    )


def category_blocks(t: Tables) -> DataFrame:
    """Per category statistics of a group, all categories that occur in one pass."""
    cells = []
    for c in features.found_categories(t.events, "event_type"):
        value = F.when(F.col("event_type") == c, F.col("value"))
        cells += features.block(value, c, ("mean", "std", "min", "max", "sum"))
    return rounded(t.events.groupBy("user_id").agg(*cells).fillna(0.0))


def used_values(t: Tables) -> DataFrame:
    return features.used_values(joblog.operators(t), "plan_id", "tables")


def pivot_counts(t: Tables) -> DataFrame:
    return features.category_counts(t.events, "user_id", "event_type")


def pivot_open(t: Tables) -> DataFrame:
    """A type that no list knows, and events without one."""
    key = F.col("event_id")
    kind = F.when(key % 17 == 0, "refund").when(key % 13 != 0, F.col("event_type"))
    return features.category_counts(t.events.select("user_id", kind.alias("kind")), "user_id", "kind")


def quantile_grid(t: Tables, method: str) -> DataFrame:
    grid = [0.01 + i * 0.01 for i in range(99)]
    out = ordered.quantiles(t.events, ["event_type"], "value", grid, method)
    return out.select("event_type", F.round(F.col("q") * 100).cast("int").alias("pct"), "v")


def feature_columns(t: Tables) -> DataFrame:
    ops = joblog.operators(t)
    table = features.plan_feature_table(ops, joblog.cardinalities(t), list(joblog.SIZES), catalog.TABLES)
    return table


def plan_features(t: Tables) -> DataFrame:
    out = feature_columns(t).drop("sourceCardinalityProd", "joinOutCard_prod")
    names = {c: c.replace("%", "pct") for c in out.columns if "%" in c}
    return rounded(out.withColumnsRenamed(names))


def plan_products(t: Tables) -> DataFrame:
    """Logarithms of the product columns, whose values pass what rounding can compare."""
    logs = [F.when(F.col(c) > 0, F.round(F.log(c), 6)).alias(c) for c in ("sourceCardinalityProd", "joinOutCard_prod")]
    return feature_columns(t).select("plan_id", "data_id", *logs)


def complexity_block(t: Tables) -> DataFrame:
    ops = joblog.sized_operators(t)
    effort = F.when(F.col("pact") == "Map", F.col("out_cardinality") * F.pow(F.lit(10.0), F.col("complexity")))
    out = ops.where("pact = 'Map'").groupBy(*KEYS).agg(*features.block(effort, "complexity", ("mean", "std", "min", "max")))
    return rounded(out.fillna(0.0))


def onehot_cardinality(t: Tables) -> DataFrame:
    used = features.used_values(joblog.operators(t), "plan_id", "tables")
    return features.table_features(used, joblog.cardinalities(t), catalog.TABLES)


def one_hot(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.split("p_name", " ").alias("words"))
    return features.one_hot(rows, "words", ["blue", "green", "red"]).drop("words")


def measured_features(t: Tables) -> DataFrame:
    """Measured cardinalities: the event value is what the operator wrote."""
    log = joblog.operators(t)
    wrote = t.events.select((F.col("event_id") * 10).alias("pos"), F.round("value", 2).alias("written"))
    measured = log.join(wrote, "pos").select(
        "plan_id", F.lit("x1").alias("data_id"), "pos", "pact", F.col("written").alias("out_cardinality")
    )
    out = features.measured_feature_table(measured, log, joblog.cardinalities(t).where("data_id = 'x1'"), catalog.TABLES)
    keep = ["plan_id", "data_id", "outCardinality_mean", "outCardinality_50%", "sourceCardinalitySum", "complexity_max",
            "selectivity_mean", "filterOutCard_std", "t_0", "t_5"]
    return rounded(out.select(*keep).withColumnRenamed("outCardinality_50%", "outCardinality_median"), 8)


def trim_outliers(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return features.trim_outliers(rows, "o_totalprice", "o_orderstatus", 0.05)


def trim_outliers_null(t: Tables) -> DataFrame:
    """Every fifth order has no status."""
    status = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))
    return features.trim_outliers(t.orders.select("o_orderkey", status.alias("g"), "o_totalprice"), "o_totalprice", "g", 0.03)


def label_bins(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return features.label_bins(features.label_bins(rows, "o_totalprice", 3, "bin3"), "o_totalprice", 5, "bin5")


def correlation(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("one", F.lit(1.0))
    return rounded(features.correlation(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "one"]), 8)


def pca_factors(t: Tables) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    per_part = t.lineitem.groupBy("l_partkey").agg(*[F.avg(c).alias(c) for c in columns])
    return features.pca_factors(per_part, columns, 2)


def group_mean_fill(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey")
    log = t.orders.select("o_custkey", "o_totalprice")
    out = features.group_mean_fill(rows, log, ["o_custkey"], ["o_totalprice"])
    return rounded(out)


def json_props(t: Tables) -> DataFrame:
    parsed = F.from_json("props", "k int")
    return t.events.select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("text"))


_BLOCK_SQL = ", ".join(
    f"COALESCE(ROUND({fn}(CASE WHEN event_type = '{c}' THEN value END), 6), 0) AS {c}_{s}"
    for c in TYPES
    for s, fn in (("mean", "AVG"), ("std", "STDDEV_SAMP"), ("min", "MIN"), ("max", "MAX"), ("sum", "SUM"))
)


def _stats_sql(pact: str, prefix: str, stats=("mean", "std", "min", "max"), value="out_cardinality") -> str:
    fn = {"mean": "AVG", "std": "STDDEV_SAMP", "min": "MIN", "max": "MAX", "sum": "SUM"}
    return ", ".join(
        f"COALESCE(ROUND({fn[s]}(CASE WHEN pact = '{pact}' THEN {value} END), {3 if s == 'std' else 6}), 0) AS {prefix}_{s}"
        for s in stats
    )


_PLAN_SQL = f"""WITH RECURSIVE {joblog.propagated_sql()},
    used AS (SELECT DISTINCT plan_id, unnest(tables) AS table_name FROM ops),
    tabs AS (SELECT plan_id, data_id, {", ".join(f"COALESCE(MAX(CASE WHEN u.table_name = '{n}' THEN rows END), 0) AS t_{i}" for i, n in enumerate(sorted(catalog.TABLES)))}
             FROM used u JOIN cards c ON u.table_name = c.table_name GROUP BY 1, 2),
    centred AS (SELECT *, out_cardinality - AVG(out_cardinality) OVER (PARTITION BY plan_id, data_id) AS d FROM sized),
    agg AS (SELECT plan_id, data_id, COUNT(*) AS outCardinality_count, ROUND(AVG(out_cardinality), 6) AS outCardinality_mean,
        COALESCE(ROUND(STDDEV_SAMP(out_cardinality), 3), 0) AS outCardinality_std, ROUND(MIN(out_cardinality), 6) AS outCardinality_min,
        ROUND(MAX(out_cardinality), 6) AS outCardinality_max,
        ROUND(quantile_cont(out_cardinality, 0.1), 6) AS outCardinality_10pct, ROUND(quantile_cont(out_cardinality, 0.5), 6) AS outCardinality_50pct,
        ROUND(quantile_cont(out_cardinality, 0.9), 6) AS outCardinality_90pct,
        ROUND(AVG(d * d * d * d) / (AVG(d * d) * AVG(d * d)) - 3, 6) AS outCardinality_kurtosis,
        ROUND(AVG(d * d * d) / pow(AVG(d * d), 1.5), 6) AS outCardinality_skew,
        {_stats_sql("Map", "complexity", value="out_cardinality * pow(10.0, complexity)")},
        COALESCE(ROUND(AVG(selectivity), 6), -1) AS selectivity_mean, COALESCE(ROUND(MIN(selectivity), 6), -1) AS selectivity_min,
        COALESCE(ROUND(MAX(selectivity), 6), -1) AS selectivity_max,
        ROUND(SUM(CASE WHEN pact = 'Data Source' THEN out_cardinality END), 6) AS sourceCardinalitySum,
        {_stats_sql("Data Source", "sourceOutCard")}, {_stats_sql("Join", "joinOutCard", ("mean", "std", "min", "max", "sum"))},
        {_stats_sql("Group by", "groupbyOutCard")}, {_stats_sql("Filter", "filterOutCard")}
      FROM centred GROUP BY 1, 2
      HAVING COUNT(*) FILTER (WHERE pact = 'Map') > 0 AND COUNT(*) FILTER (WHERE pact = 'Data Source') > 0)
    SELECT * FROM agg JOIN tabs USING (plan_id, data_id)"""


def _grid_sql(fn: str) -> str:
    return f"""WITH n AS (SELECT event_type, value, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
                   COUNT(*) OVER (PARTITION BY event_type) AS n FROM events),
               g AS (SELECT CAST(i + 1 AS INT) AS pct, 0.01::DOUBLE + i * 0.01::DOUBLE AS p FROM range(99) r(i))
               SELECT event_type, pct, value AS v FROM n JOIN g ON n.i = {fn}(p * (n.n - 1))"""


_BINS = lambda k: " + ".join(
    f"CASE WHEN o_totalprice >= (SELECT quantile_cont(o_totalprice, {i}.0::DOUBLE / {k}) FROM orders) THEN 1 ELSE 0 END"
    for i in range(1, k)
)

QUERIES = {
    "propagate": (
        q(propagate),
        f"WITH RECURSIVE {joblog.propagated_sql()} SELECT plan_id, data_id, pos, pact, ROUND(out_cardinality, 6) AS out_cardinality FROM sized",
    ),
    "propagate_carry": (
        q(lambda t: propagate(t, "carry")),
        f"WITH RECURSIVE {joblog.propagated_sql('carry')} SELECT plan_id, data_id, pos, pact, ROUND(out_cardinality, 6) AS out_cardinality FROM sized",
    ),
    "operator_log": (
        q(lambda t: joblog.operators(t).drop("table_name")),
        f"WITH {joblog.OPERATORS_SQL} SELECT plan_id, pos, pact, tables, selectivity, out_cardinality, complexity FROM ops",
    ),
    "plan_features": (q(plan_features), _PLAN_SQL),
    "plan_products": (
        q(plan_products),
        f"""WITH RECURSIVE {joblog.propagated_sql()} SELECT plan_id, data_id,
            ROUND(SUM(CASE WHEN pact = 'Data Source' THEN ln(out_cardinality) END), 6) AS "sourceCardinalityProd",
            ROUND(SUM(CASE WHEN pact = 'Join' THEN ln(out_cardinality) END), 6) AS "joinOutCard_prod" FROM sized GROUP BY 1, 2
            HAVING COUNT(*) FILTER (WHERE pact = 'Map') > 0 AND COUNT(*) FILTER (WHERE pact = 'Data Source') > 0""",
    ),
    "complexity_block": (
        q(complexity_block),
        f"""WITH RECURSIVE {joblog.propagated_sql()} SELECT plan_id, data_id,
            {_stats_sql("Map", "complexity", value="out_cardinality * pow(10.0, complexity)")}
            FROM sized WHERE pact = 'Map' GROUP BY 1, 2""",
    ),
    "onehot_cardinality": (
        q(onehot_cardinality),
        f"""WITH {joblog.OPERATORS_SQL}, used AS (SELECT DISTINCT plan_id, unnest(tables) AS table_name FROM ops)
            SELECT plan_id, data_id, {", ".join(f"COALESCE(MAX(CASE WHEN u.table_name = '{n}' THEN rows END), 0) AS t_{i}" for i, n in enumerate(sorted(catalog.TABLES)))}
            FROM used u JOIN cards c ON u.table_name = c.table_name GROUP BY 1, 2""",
    ),
    "one_hot": (
        q(one_hot),
        "SELECT p_partkey, " + ", ".join(
            f"list_contains(string_split(p_name, ' '), '{w}')::INT::DOUBLE AS h_{i}" for i, w in enumerate(["blue", "green", "red"])
        ) + " FROM part",
    ),
    "measured_features": (
        q(measured_features),
        f"""WITH {joblog.OPERATORS_SQL},
            log AS (SELECT plan_id, AVG(complexity) AS complexity, AVG(selectivity) AS selectivity FROM ops GROUP BY 1),
            m AS (SELECT o.plan_id, 'x1' AS data_id, o.pact, ROUND(e.value, 2) AS oc, l.complexity, l.selectivity
                  FROM ops o JOIN events e ON o.pos = e.event_id * 10 JOIN log l ON l.plan_id = o.plan_id),
            used AS (SELECT DISTINCT plan_id, unnest(tables) AS table_name FROM ops),
            tabs AS (SELECT plan_id, COALESCE(MAX(CASE WHEN u.table_name = 'customer' THEN rows END), 0) AS t_0,
                            COALESCE(MAX(CASE WHEN u.table_name = 'supplier' THEN rows END), 0) AS t_5
                     FROM used u JOIN cards c ON u.table_name = c.table_name AND data_id = 'x1' GROUP BY 1)
            SELECT plan_id, data_id, ROUND(AVG(oc), 8) AS outCardinality_mean, ROUND(quantile_cont(oc, 0.5), 8) AS outCardinality_median,
                   ROUND(SUM(CASE WHEN pact = 'Data Source' THEN oc END), 8) AS sourceCardinalitySum,
                   ROUND(MAX(CASE WHEN pact = 'Map' THEN oc * pow(10.0, complexity) END), 8) AS complexity_max,
                   ROUND(AVG(selectivity), 8) AS selectivity_mean,
                   COALESCE(ROUND(STDDEV_SAMP(CASE WHEN pact = 'Filter' THEN oc END), 3), 0) AS filterOutCard_std, t_0, t_5
            FROM m JOIN tabs USING (plan_id) GROUP BY plan_id, data_id, t_0, t_5
            HAVING COUNT(*) FILTER (WHERE pact = 'Map') > 0 AND COUNT(*) FILTER (WHERE pact = 'Data Source') > 0""",
    ),
    "group_describe": (
        q(group_describe),
        """SELECT l_suppkey, COUNT(*) AS count, ROUND(AVG(l_extendedprice), 4) AS mean, ROUND(STDDEV_SAMP(l_extendedprice), 4) AS std,
                  MIN(l_extendedprice) AS min, MAX(l_extendedprice) AS max, ROUND(quantile_cont(l_extendedprice, 0.1), 4) AS p10,
                  ROUND(quantile_cont(l_extendedprice, 0.5), 4) AS p50, ROUND(quantile_cont(l_extendedprice, 0.9), 4) AS p90
           FROM lineitem GROUP BY 1""",
    ),
    "group_moments": (
        q(group_moments),
        """SELECT l_suppkey, ROUND(AVG(d * d * d * d) / (AVG(d * d) * AVG(d * d)) - 3, 8) AS kurtosis,
                  ROUND(AVG(d * d * d) / pow(AVG(d * d), 1.5), 8) AS skew
           FROM (SELECT l_suppkey, l_quantity - AVG(l_quantity) OVER (PARTITION BY l_suppkey) AS d FROM lineitem) x GROUP BY 1""",
    ),
    "group_product": (
        q(group_product),
        """SELECT l_orderkey, SUM(l_quantity) AS total, ROUND(product(1 + l_tax), 8) AS product FROM lineitem GROUP BY 1""",
    ),
    "category_blocks": (q(category_blocks), f"SELECT user_id, {_BLOCK_SQL} FROM events GROUP BY 1"),
    "used_values": (
        q(used_values),
        f"""WITH {joblog.OPERATORS_SQL},
            x AS (SELECT plan_id, pos, unnest(tables) AS value, unnest(range(len(tables))) AS i FROM ops),
            f AS (SELECT plan_id, value, MIN(pos * 10 + i) AS first FROM (SELECT plan_id, pos::HUGEINT AS pos, value, i FROM x) y GROUP BY 1, 2)
            SELECT plan_id, value, ROW_NUMBER() OVER (PARTITION BY plan_id ORDER BY first) AS place FROM f""",
    ),
    "pivot_counts": (
        q(pivot_counts),
        "SELECT user_id, " + ", ".join(f"COUNT(*) FILTER (WHERE event_type = '{c}') AS n_{c}" for c in TYPES) + " FROM events GROUP BY 1",
    ),
    "pivot_open": (
        q(pivot_open),
        """WITH e AS (SELECT user_id, CASE WHEN event_id % 17 = 0 THEN 'refund' WHEN event_id % 13 <> 0 THEN event_type END AS kind FROM events)
           SELECT user_id, """
        + ", ".join(f"COUNT(*) FILTER (WHERE kind = '{c}') AS n_{c}" for c in [*TYPES, "refund"])
        + ", COUNT(*) FILTER (WHERE kind IS NULL) AS n_null FROM e GROUP BY 1",
    ),
    "quantile_grid_lower": (q(lambda t: quantile_grid(t, "lower")), _grid_sql("floor")),
    "quantile_grid_higher": (q(lambda t: quantile_grid(t, "higher")), _grid_sql("ceil")),
    "trim_outliers": (
        q(trim_outliers),
        """WITH a AS (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.05) AS lo FROM orders GROUP BY 1),
                b AS (SELECT o.* FROM orders o JOIN a ON o.o_orderstatus = a.o_orderstatus AND o_totalprice > lo),
                c AS (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.95) AS hi FROM b GROUP BY 1)
           SELECT o_orderkey, b.o_orderstatus, o_totalprice FROM b JOIN c ON b.o_orderstatus = c.o_orderstatus AND o_totalprice < hi""",
    ),
    "trim_outliers_null": (
        q(trim_outliers_null),
        """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS g, o_totalprice FROM orders),
                a AS (SELECT g, quantile_cont(o_totalprice, 0.03) AS lo FROM o GROUP BY 1),
                b AS (SELECT o.* FROM o JOIN a ON o.g IS NOT DISTINCT FROM a.g AND o_totalprice > lo),
                c AS (SELECT g, quantile_cont(o_totalprice, 0.97) AS hi FROM b GROUP BY 1)
           SELECT o_orderkey, b.g, o_totalprice FROM b JOIN c ON b.g IS NOT DISTINCT FROM c.g AND o_totalprice < hi""",
    ),
    "trim_upper": (
        q(lambda t: features.trim_upper(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice")),
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)",
    ),
    "label_bins": (
        q(label_bins),
        f"SELECT o_orderkey, o_totalprice, {_BINS(3)} AS bin3, {_BINS(5)} AS bin5 FROM orders",
    ),
    "correlation": (
        q(correlation),
        " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, {'0.0::DOUBLE' if 'one' in (a, b) else f'ROUND(corr({a}, {b}), 8)'} AS r{'' if 'one' in (a, b) else ' FROM lineitem'}"
            for a in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "one")
            for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "one")
        ),
    ),
    "pca_factors": (q(pca_factors), None),
    "group_mean_fill": (
        q(group_mean_fill),
        "SELECT o_orderkey, o_custkey, ROUND(AVG(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS o_totalprice FROM orders",
    ),
    "flatten_json_props": (
        q(json_props),
        """SELECT event_id, CAST(props->>'k' AS INT) AS k, '{"k":' || (props->>'k') || '}' AS text FROM events""",
    ),
}
