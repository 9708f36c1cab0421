"""Operator log, job log and task metrics derived from the given tables.

The tables hold no plan logs, so event streams stand in: a user is a plan, its events in order
are the operators. Everything is computed by Spark from ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlab import catalog
from planlab.operators import features, profile
from planlab.sources.tables import Tables

SIZES = {"x1": 1.0, "x5": 5.0}
LAST = 4_000_000_000_000_000_000


def k_of(column: str = "props"):
    return F.get_json_object(column, "$.k").cast("int")


def operators(t: Tables) -> DataFrame:
    """``plan_id, pos, pact, table_name, tables, selectivity, out_cardinality, complexity``.

    signup opens a source, click filters, view maps, purchase groups; an error is a partition, a
    reduce, or a join preceded by its right-hand source. Every plan starts with a source and ends
    with a sink.
    """
    names = F.array(*[F.lit(n) for n in catalog.TABLES])
    null_d, null_i = F.lit(None).cast("double"), F.lit(None).cast("int")
    k = F.col("k")
    table = F.get(names, k % 6)

    def op(sub, pact, selectivity=null_d, out=null_i, tier=null_i, tables=None):
        return F.struct(
            F.lit(sub).alias("sub"),
            F.lit(pact).alias("pact"),
            selectivity.alias("selectivity"),
            out.alias("out_cardinality"),
            tier.alias("complexity"),
            (F.array(table) if tables is None else tables).alias("tables"),
        )

    one = F.lit(1.0)
    kind = F.col("event_type")
    filtered = F.get(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), k % 3)
    both = F.array(table, F.get(names, (k + 1) % 6))
    steps = (
        F.when(kind == "signup", F.array(op(0, "Data Source", one)))
        .when(kind == "click", F.array(op(0, "Filter", filtered)))
        .when(kind == "view", F.array(op(0, "Map", one, tier=k % 3)))
        .when(kind == "purchase", F.array(op(0, "Group by", out=k + 1)))
        .when(k % 4 == 0, F.array(op(0, "Partition")))
        .when(k % 4 == 1, F.array(op(0, "Reduce", out=F.lit(1))))
        .otherwise(F.array(op(0, "Data Source", one), op(1, "Join", tables=both)))
    )
    events = t.events.select("user_id", "event_id", "event_type", k_of().alias("k"))
    inner = events.select("user_id", "event_id", "k", F.explode(steps).alias("o")).select(
        F.col("user_id").alias("plan_id"),
        (F.col("event_id") * 10 + F.col("o.sub")).alias("pos"),
        F.col("o.pact").alias("pact"),
        F.get(F.col("o.tables"), 0).alias("table_name"),
        F.col("o.tables").alias("tables"),
        F.col("o.selectivity").alias("selectivity"),
        F.col("o.out_cardinality").alias("out_cardinality"),
        F.col("o.complexity").alias("complexity"),
    )
    ends = F.array(
        F.struct(F.lit(-1).cast("bigint").alias("pos"), F.lit("Data Source").alias("pact"), one.alias("s")),
        F.struct(F.lit(LAST).cast("bigint").alias("pos"), F.lit("Data Sink").alias("pact"), null_d.alias("s")),
    )
    outer = events.select("user_id").distinct().select("user_id", F.explode(ends).alias("o")).select(
        F.col("user_id").alias("plan_id"),
        "o.pos",
        "o.pact",
        F.lit("lineitem").alias("table_name"),
        F.array(F.lit("lineitem")).alias("tables"),
        F.col("o.s").alias("selectivity"),
        null_i.alias("out_cardinality"),
        null_i.alias("complexity"),
    )
    return inner.unionByName(outer)


OPERATORS_SQL = """
    k AS (SELECT user_id, event_id, event_type, CAST(props->>'k' AS INT) AS k,
                 ['lineitem', 'orders', 'customer', 'part', 'supplier', 'nation'] AS names FROM events),
    ops AS (
        SELECT user_id AS plan_id, event_id * 10 AS pos,
               CASE WHEN event_type = 'signup' THEN 'Data Source' WHEN event_type = 'click' THEN 'Filter'
                    WHEN event_type = 'view' THEN 'Map' WHEN event_type = 'purchase' THEN 'Group by'
                    WHEN k % 4 = 0 THEN 'Partition' WHEN k % 4 = 1 THEN 'Reduce' ELSE 'Data Source' END AS pact,
               [names[1 + k % 6]] AS tables,
               CASE WHEN event_type IN ('signup', 'view') THEN 1.0::DOUBLE
                    WHEN event_type = 'click' THEN [0.25, 0.5, 0.75][1 + k % 3]::DOUBLE
                    WHEN event_type = 'error' AND k % 4 >= 2 THEN 1.0::DOUBLE END AS selectivity,
               CASE WHEN event_type = 'purchase' THEN k + 1 WHEN event_type = 'error' AND k % 4 = 1 THEN 1 END AS out_cardinality,
               CASE WHEN event_type = 'view' THEN k % 3 END AS complexity
        FROM k
        UNION ALL
        SELECT user_id, event_id * 10 + 1, 'Join', [names[1 + k % 6], names[1 + (k + 1) % 6]], NULL, NULL, NULL
        FROM k WHERE event_type = 'error' AND k % 4 >= 2
        UNION ALL
        SELECT DISTINCT user_id, -1, 'Data Source', ['lineitem'], 1.0::DOUBLE, NULL, NULL FROM events
        UNION ALL
        SELECT DISTINCT user_id, 4000000000000000000, 'Data Sink', ['lineitem'], NULL, NULL, NULL FROM events),
    counts AS (SELECT 'lineitem' AS table_name, COUNT(*) AS n FROM lineitem UNION ALL SELECT 'orders', COUNT(*) FROM orders
        UNION ALL SELECT 'customer', COUNT(*) FROM customer UNION ALL SELECT 'part', COUNT(*) FROM part
        UNION ALL SELECT 'supplier', COUNT(*) FROM supplier UNION ALL SELECT 'nation', COUNT(*) FROM nation),
    cards AS (SELECT 'x1' AS data_id, table_name, n * 1.0::DOUBLE AS rows FROM counts
        UNION ALL SELECT 'x5', table_name, n * CASE WHEN table_name = 'nation' THEN 1.0 ELSE 5.0 END::DOUBLE FROM counts)"""


def propagated_sql(unknown: str = "one") -> str:
    """Sequential fold of each plan, for the checking engine."""
    rest = "1.0" if unknown == "one" else "q[-1]"
    value = f"""CASE WHEN o.pact = 'Data Source' THEN o.rows * o.selectivity
                 WHEN o.pact = 'Data Sink' THEN q[-1]
                 WHEN o.pact = 'Join' THEN greatest(q[1], q[2])
                 WHEN o.out_cardinality IS NOT NULL THEN o.out_cardinality
                 WHEN o.selectivity IS NOT NULL THEN q[-1] * o.selectivity ELSE {rest} END"""
    return f"""
    {OPERATORS_SQL},
    numbered AS (SELECT o.*, d.data_id, c.rows,
                        ROW_NUMBER() OVER (PARTITION BY plan_id, d.data_id ORDER BY pos) AS rn
                 FROM ops o JOIN (SELECT DISTINCT data_id FROM cards) d ON TRUE
                 JOIN cards c ON c.data_id = d.data_id AND c.table_name = o.tables[1]),
    fold AS (
        SELECT plan_id, data_id, rn, rows * selectivity AS oc, [rows * selectivity] AS q FROM numbered WHERE rn = 1
        UNION ALL
        SELECT o.plan_id, o.data_id, o.rn, {value} AS oc,
               CASE WHEN o.pact = 'Data Source' THEN list_append(q, o.rows * o.selectivity)
                    WHEN o.pact = 'Data Sink' THEN q
                    WHEN o.pact = 'Join' THEN list_append(q[3:], greatest(q[1], q[2]))
                    ELSE list_append(q[:-2], {value}) END AS q
        FROM fold f JOIN numbered o ON o.plan_id = f.plan_id AND o.data_id = f.data_id AND o.rn = f.rn + 1),
    sized AS (SELECT n.plan_id, n.data_id, n.pos, n.pact, n.tables, n.selectivity, n.complexity, f.oc AS out_cardinality
              FROM numbered n JOIN fold f USING (plan_id, data_id, rn))"""


def cardinalities(t: Tables) -> DataFrame:
    counts = profile.table_counts({n: getattr(t, n) for n in catalog.TABLES})
    return features.scaled_cardinalities(counts, SIZES)


def sized_operators(t: Tables, unknown: str = "one") -> DataFrame:
    return features.propagate(operators(t), cardinalities(t), list(SIZES), unknown)
