"""Registered queries: templated jobs, plan documents and task metrics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlab import catalog
from planlab.operators import features, graphs, jobs, profile, walks
from planlab.operators import relational as R
from planlab.plans import joblog
from planlab.plans.basics import q
from planlab.plans.featured import rounded
from planlab.plans.sequenced import event_pairs
from planlab.sources import documents
from planlab.sources.tables import Tables

S = "Data Source"
ABSTRACT_PLANS = [
    [S, "Filter", "Map", "Data Sink"],
    [S, "Filter", ("Join", [S, "Filter"]), "Group by", "Map", "Data Sink"],
    [S, "Map", ("Join", [S]), "Filter", ("Join", [S, "Filter", "Map"]), "Partition", "Data Sink"],
    [S, "Group by", "Group by", "Sort-Partition", "Data Sink"],
    [S, "Filter", "Reduce", "Reduce", "Map", "Data Sink"],
    [S, ("Join", [S, "Partition", "Filter"]), "Reduce", "Data Sink"],
]
VERSIONS = 2


def _paths() -> dict[int, list[list[str]]]:
    """Table paths of up to two joins, walked over the catalogue."""
    out, frontier = {0: [[t] for t in catalog.TABLES]}, [([t], frozenset()) for t in catalog.TABLES]
    for hops in (1, 2):
        frontier = [
            (tables + [b], used | {r.name})
            for tables, used in frontier
            for r in catalog.RELATIONS
            for a, b in ((r.left, r.right), (r.right, r.left))
            if tables[-1] == a and r.name not in used
        ]
        out[hops] = sorted(t for t, _ in frontier)
    return out


def fixed_jobs(paths=None) -> list[jobs.Job]:
    """Every abstract plan in each version, seeded by ten times the plan plus the version."""
    paths = paths or _paths()
    return [
        jobs.make_job(f"Job{i}v{j}", plan, paths, 10 * i + j)
        for i, plan in enumerate(ABSTRACT_PLANS)
        for j in range(VERSIONS)
    ]


def templated_jobs(t: Tables) -> DataFrame:
    paths = jobs.table_paths(t.spark, 2)
    return jobs.results(fixed_jobs(paths), lambda name: getattr(t, name))


def _job_sql(job: jobs.Job) -> str:
    parts: list[str] = []

    def name() -> str:
        return f"s{len(parts)}"

    def follow(steps) -> str:
        here = ""
        for s in steps:
            if s.merged or s.pact == "Data Sink":
                continue
            if s.pact == "Data Source":
                body = f"SELECT * FROM {s.table}"
            elif s.pact == "Filter":
                p = s.predicate
                literal = repr(p.literal) if isinstance(p.literal, float) else ("DATE " if isinstance(p.literal, date) else "") + f"'{p.literal}'"
                body = f"SELECT * FROM {here} WHERE {p.column} {'=' if p.op == '==' else p.op} {literal}"
            elif s.pact in ("Group by", "Reduce"):
                way = "DESC" if s.keep == "last" else "ASC"
                by = f"PARTITION BY {s.key} " if s.key else ""
                body = f"SELECT * FROM {here} QUALIFY ROW_NUMBER() OVER ({by}ORDER BY {here} {way}) = 1"
            elif s.pact == "Join":
                right = follow(s.branch)
                body = f"SELECT r.* FROM {here} l JOIN {right} r ON l.{s.relation.left_key} = r.{s.relation.right_key}"
            else:
                body = f"SELECT * FROM {here}"
            here = f"{job.job_id}_{name()}"
            parts.append(f"{here} AS ({body})")
        return here

    last = follow(job.steps)
    key = catalog.FIRST_COLUMN[job.table]
    return (
        f"SELECT * FROM (WITH {', '.join(parts)} SELECT '{job.job_id}' AS job_id, '{job.table}' AS table_name, "
        f"COUNT(*) AS rows_out, COALESCE(SUM({key}), 0)::BIGINT AS key_sum FROM {last}) x"
    )


PACTS = {"click": "Filter", "view": "Map", "purchase": "Group by", "error": "Join", "signup": "Reduce"}


def operator_pairs(t: Tables) -> DataFrame:
    """Users' event order read as operator order between a source and a sink."""
    pact = F.create_map(*[F.lit(x) for pair in PACTS.items() for x in pair])
    rows = event_pairs(t).select(
        pact[F.col("category")].alias("category"),
        F.coalesce(F.try_element_at(pact, F.col("parent")), F.lit("Data Source")).alias("parent"),
        F.coalesce(F.try_element_at(pact, F.col("child")), F.lit("Data Sink")).alias("child"),
        "weight",
    )
    counts = rows.groupBy("category", "parent", "child").agg(F.sum("weight").alias("weight"))
    ends = counts.where("parent = 'Data Source'").select(
        F.lit("Data Source").alias("category"), F.lit("").alias("parent"), F.col("category").alias("child"), "weight"
    )
    return counts.unionByName(ends)


def generated_plans(t: Tables, n: int = 6) -> list:
    """Abstract plans drawn from the event transitions; ``n`` walks of bounded depth."""
    pairs = operator_pairs(t)
    forward = graphs.transitions(pairs.where("child <> ''"), "child")
    backward = graphs.transitions(pairs.where("parent <> ''"), "parent")
    ids = t.spark.range(n).withColumnRenamed("id", "walk_id")
    rows = walks.walks(ids, forward, backward, max_depth=5, max_joins=2).collect()
    return [jobs.plan_of([r for r in rows if r["walk_id"] == i]) for i in range(n)]


def generated_jobs(t: Tables) -> list[jobs.Job]:
    paths = jobs.table_paths(t.spark, 2)
    return [jobs.make_job(f"Job{i}v0", plan, paths, 10 * i) for i, plan in enumerate(generated_plans(t))]


def group_sizes(t: Tables) -> dict[tuple[str, str], int]:
    """Groups per catalogued key, measured."""
    frames = [
        profile.key_cardinality(getattr(t, table), keys).withColumn("table_name", F.lit(table))
        for table, keys in catalog.GROUP_KEYS.items()
    ]
    return {(r["table_name"], r["key"]): r["n_groups"] for r in R.stack(frames).collect()}


def job_log(t: Tables) -> DataFrame:
    log = jobs.operator_log(t.spark, fixed_jobs(), group_sizes(t))
    sizes = joblog.cardinalities(t)
    return features.propagate(log, sizes, list(joblog.SIZES)).select(
        "plan_id", "data_id", "pos", "pact", F.round("out_cardinality", 4).alias("out_cardinality")
    )


def generated_features(t: Tables) -> DataFrame:
    """Walks to jobs to operator log to features."""
    log = jobs.operator_log(t.spark, generated_jobs(t), group_sizes(t))
    return features.plan_feature_table(log, joblog.cardinalities(t), list(joblog.SIZES), catalog.TABLES)


def estimate_error(t: Tables) -> DataFrame:
    """Propagated against measured output of the templated jobs."""
    log = jobs.operator_log(t.spark, fixed_jobs(), group_sizes(t))
    estimated = features.propagate(log, joblog.cardinalities(t), ["x1"]).where("pact = 'Data Sink'")
    measured = templated_jobs(t)
    joined = estimated.join(measured, F.col("plan_id") == F.col("job_id"))
    e, a = F.col("out_cardinality"), F.col("rows_out").cast("double")
    return joined.select(
        "job_id",
        F.round(e, 4).alias("estimated"),
        "rows_out",
        F.when((e > 0) & (a > 0), F.round(F.greatest(e / a, a / e), 4)).alias("qerror"),
    )


# ---- documents written from part rows, then parsed like files ------------------------------------


def plan_texts(t: Tables) -> DataFrame:
    """A three-node plan per part as JSON text, one string left with bare inner quotes."""
    size = F.col("p_size").cast("string")
    text = F.concat(
        F.lit('{"netRunTime": '), size, F.lit(', "executionPlan": {"nodes": [{"id": 3, "type": "source", "pact": "Data Source", "parallelism": "8", "costs": [{"name": "Disk", "value": "'),
        size, F.lit('.5 M"}, {"name": "CPU", "value": "'), size,
        F.lit('.0 K"}]}, {"id": 2, "type": "pact", "pact": "FlatMap", "contents": "CHARACTER SET "UTF-16LE" x", "parallelism": "'),
        size, F.lit('", "predecessors": [{"id": 3, "ship_strategy": "Forward"}], "costs": [{"name": "Disk", "value": "2 G"}, {"name": "CPU", "value": "0.0"}]}, '
                    '{"id": 1, "type": "sink", "pact": "Data Sink", "parallelism": "1", "predecessors": [{"id": 2, "ship_strategy": "'),
        F.when(F.col("p_size") % 2 == 0, "Broadcast").otherwise("Forward"), F.lit('"}, {"id": 3, "ship_strategy": "Forward"}], "costs": []}]}}'),
    )
    return t.part.select(F.col("p_partkey").alias("plan_id"), text.alias("value"))


def plan_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    nodes = documents.plan_nodes(documents.parse_plans(plan_texts(t)))
    return nodes.withColumn("category", graphs.checked_category()), graphs.edges_of(nodes)


def plan_documents(t: Tables) -> DataFrame:
    nodes, edges = plan_tables(t)
    categories = ["Data Source", "Map", "Data Sink"]
    out = graphs.plan_graph_features(nodes, edges, categories)
    out = out.join(graphs.plan_costs(nodes), "plan_id")
    run_time = documents.parse_plans(plan_texts(t)).select("plan_id", "net_run_time")
    return rounded(out.join(run_time, "plan_id"))


def open_costs(t: Tables) -> DataFrame:
    """Plans of which some count a cost that no list knows, and one without a name."""
    texts = plan_texts(t).withColumn("value", F.when(F.col("plan_id") % 3 == 0, F.replace("value", F.lit('"CPU"'), F.lit('"Network"')))
                                     .when(F.col("plan_id") % 7 == 0, F.replace("value", F.lit('"name": "CPU"'), F.lit('"name": null')))
                                     .otherwise(F.col("value")))
    return rounded(graphs.plan_costs(documents.plan_nodes(documents.parse_plans(texts))))


def plan_edges(t: Tables) -> DataFrame:
    return plan_tables(t)[1]


def unknown_operators(t: Tables) -> DataFrame:
    """Event types read as operator names: which belong to no group."""
    names = t.events.select("event_id", F.col("event_type").alias("pact"))
    return graphs.unknown_categories(names, groups={"known": ["click", "view"]}).groupBy("pact").agg(F.count(F.lit(1)).alias("n"))


def metric_documents(t: Tables) -> DataFrame:
    """A task-metric document per event: a chain of a source and an operator, and a sink."""
    k = joblog.k_of()
    line = F.col("k").cast("string")
    op = F.when(F.col("k") % 2 == 0, "GroupReduce").otherwise("Filter")
    metrics = F.struct(
        F.col("k").cast("bigint").alias("read-bytes"),
        (F.col("k") * 2).cast("bigint").alias("write-bytes"),
        (F.col("k") * 3).cast("bigint").alias("read-records"),
        (F.col("k") * 4).cast("bigint").alias("write-records"),
    )
    vertices = F.array(
        F.struct(
            F.lit("a").alias("id"),
            F.concat(F.lit("CHAIN DataSource (at Job.run(Job.scala:"), line, F.lit(") (x)) -> Op (Op at Job.run(Job.scala:7))")).alias("name"),
            metrics.alias("metrics"),
        ),
        F.struct(F.lit("b").alias("id"), F.lit("DataSink (no place)").alias("name"), metrics.alias("metrics")),
    )
    nodes = F.array(
        F.struct(F.lit("a").alias("id"), F.concat(F.lit("Data Source -> "), op).alias("operator")),
        F.struct(F.lit("b").alias("id"), F.lit("Data Sink").alias("operator")),
    )
    rows = t.events.select(F.col("event_id").alias("plan_id"), F.lit("x1").alias("data_id"), k.alias("k"))
    text = F.to_json(F.struct(vertices.alias("vertices"), F.struct(nodes.alias("nodes")).alias("plan")))
    parsed = F.from_json(text, documents.METRICS_SCHEMA)
    return rows.select("plan_id", "data_id", parsed.alias("d")).select("plan_id", "data_id", "d.vertices", "d.plan")


def task_metrics(t: Tables) -> DataFrame:
    return documents.task_operators(metric_documents(t)).drop("data_id")


QUERIES = {
    "templated_jobs": (q(templated_jobs), " UNION ALL ".join(_job_sql(j) for j in fixed_jobs())),
    "job_log": (q(job_log), None),
    "generated_jobs": (q(lambda t: jobs.results(generated_jobs(t), lambda n: getattr(t, n))), None),
    "generated_features": (q(generated_features), None),
    "estimate_error": (q(estimate_error), None),
    "plan_documents": (
        q(plan_documents),
        """SELECT p_partkey AS plan_id, 1 AS n_0, 1 AS n_1, 1 AS n_2, 3 AS n_nodes, ROUND((8 + p_size + 1) / 3.0::DOUBLE, 6) AS avg_parallelism,
                  3 AS n_edges, 2 AS longest_path, (p_size + 0.5 + 2000) / 2.0::DOUBLE AS "Disk", 0.0::DOUBLE AS "CPU", p_size AS net_run_time FROM part""",
    ),
    "open_costs": (
        q(open_costs),
        """SELECT p_partkey AS plan_id, (p_size + 0.5 + 2000) / 2.0::DOUBLE AS "Disk",
                  CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 7 <> 0 THEN 0.0::DOUBLE END AS "CPU",
                  CASE WHEN p_partkey % 3 = 0 THEN 0.0::DOUBLE END AS "Network",
                  CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 7 = 0 THEN 0.0::DOUBLE END AS "null" FROM part""",
    ),
    "plan_edges": (
        q(plan_edges),
        """SELECT p_partkey AS plan_id, 3 AS src, 2 AS dst, 'Forward' AS ship_strategy, FALSE AS broadcast FROM part
           UNION ALL SELECT p_partkey, 2, 1, CASE WHEN p_size % 2 = 0 THEN 'Broadcast' ELSE 'Forward' END, p_size % 2 = 0 FROM part
           UNION ALL SELECT p_partkey, 3, 1, 'Forward', FALSE FROM part""",
    ),
    "unknown_operators": (
        q(unknown_operators),
        "SELECT event_type AS pact, COUNT(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1",
    ),
    "task_metrics": (
        q(task_metrics),
        """WITH k AS (SELECT event_id AS plan_id, CAST(props->>'k' AS BIGINT) AS k FROM events)
           SELECT plan_id, 0 AS vertex_no, 0 AS place_in_chain, 'Data Source' AS pact, k AS read_bytes, k * 3 AS read_records, k * 2 AS write_bytes,
                  k * 4 AS write_records, 'Job.run(Job.scala:' || k || ')' AS code_place, k AS id, least(k, 7) AS chain_id FROM k
           UNION ALL SELECT plan_id, 0, 1, CASE WHEN k % 2 = 0 THEN 'Group by' ELSE 'Filter' END, k, k * 3, k * 2, k * 4, 'Job.run(Job.scala:7)', 7, least(k, 7) FROM k
           UNION ALL SELECT plan_id, 1, 0, 'Data Sink', k, k * 3, k, k * 3, '', 1000000, 1000000 FROM k""",
    ),
}
