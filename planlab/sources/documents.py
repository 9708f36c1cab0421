"""Semi-structured sources: execution plans, job logs and task metrics as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlab.functions.scalars import code_line, code_place

# Field names of the documents.
_PREDECESSORS = "array<struct<id:int,side:string,ship_strategy:string,local_strategy:string,exchange_mode:string>>"
_PAIRS = "array<struct<name:string,value:string>>"
_NODE = (
    f"id:int,type:string,pact:string,contents:string,parallelism:string,predecessors:{_PREDECESSORS},"
    f"driver_strategy:string,estimates:{_PAIRS},costs:{_PAIRS}"
)
PLAN_SCHEMA = (
    "netRunTime bigint, dataPath string, executionPlan struct<nodes:array<struct<"
    f"{_NODE},step_function:array<struct<{_NODE}>>,partial_solution:int,next_partial_solution:int>>>"
)
JOB_LOG_SCHEMA = (
    "JobId string, operatorsInfo array<struct<id:int,varName:string,pact:string,tables:array<string>,"
    "selectivity:double,outCardinality:bigint,complexity:int>>, tableSequence array<string>, "
    "joinRelationsSequence array<string>"
)
METRICS_SCHEMA = (
    "jid string, `end-time` bigint, vertices array<struct<id:string,name:string,parallelism:int,status:string,"
    "`start-time`:bigint,`end-time`:bigint,duration:bigint,metrics:struct<`read-bytes`:bigint,"
    "`write-bytes`:bigint,`read-records`:bigint,`write-records`:bigint>>>, "
    "plan struct<nodes:array<struct<id:string,operator:string>>>"
)


def _file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def _folder_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)


def repaired(text: str | Column) -> Column:
    """Escape the quoted character set some plan writers leave bare inside a string."""
    return F.regexp_replace(text, '(?<!\\\\)"UTF-16LE"', '\\\\"UTF-16LE\\\\"')


def parse_plans(df: DataFrame, text: str = "value") -> DataFrame:
    """Plan documents held as text become columns beside whatever identifies them."""
    parsed = F.from_json(repaired(F.col(text)), PLAN_SCHEMA)
    return df.withColumn("__p", parsed).select(
        *[c for c in df.columns if c != text],
        F.col("__p.netRunTime").alias("net_run_time"),
        F.col("__p.executionPlan.nodes").alias("nodes"),
    )


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """One row per plan file: ``plan_id`` (file), ``data_id`` (folder), run time and nodes."""
    files = spark.read.text(path, wholetext=True)
    named = files.select(
        F.regexp_replace(_file_name(), r"\.json$", "").alias("plan_id"), _folder_name().alias("data_id"), "value"
    )
    return parse_plans(named)


def plan_nodes(plans: DataFrame) -> DataFrame:
    """One row per plan node."""
    keys = [c for c in plans.columns if c not in ("nodes", "net_run_time")]
    return plans.select(*keys, F.inline("nodes")).withColumn("parallelism", F.col("parallelism").cast("double"))


def size_of(data_id: str = "data_id") -> Column:
    """Leading number of a data size name such as ``5GB``."""
    return F.regexp_replace(F.col(data_id), "GB.*", "").try_cast("double")


def explode_jobs(jobs: DataFrame) -> DataFrame:
    """One row per recorded operator, in log order, without empty records."""
    long = jobs.select(F.col("JobId").alias("plan_id"), F.posexplode("operatorsInfo").alias("pos", "o"))
    return long.select(
        "plan_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("o.id").alias("id"),
        F.col("o.varName").alias("var_name"),
        F.col("o.pact").alias("pact"),
        F.get("o.tables", F.lit(0)).alias("table_name"),
        F.col("o.tables").alias("tables"),
        F.col("o.selectivity").alias("selectivity"),
        F.col("o.outCardinality").alias("out_cardinality"),
        F.col("o.complexity").alias("complexity"),
    ).where("id is not null")


def read_job_log(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested job log to one row per operator. ``multi_line`` reads one array per file."""
    return explode_jobs(spark.read.schema(JOB_LOG_SCHEMA).option("multiLine", multi_line).json(path))


def job_log_records(operators: DataFrame) -> DataFrame:
    """Operator rows back to one nested record per job (a job has few operators)."""
    record = F.struct(
        "pos", "id", F.col("var_name").alias("varName"), "pact", "tables", "selectivity",
        F.col("out_cardinality").alias("outCardinality"), "complexity",
    )
    listed = operators.groupBy(F.col("plan_id").alias("JobId")).agg(F.array_sort(F.collect_list(record)).alias("o"))
    return listed.select("JobId", F.transform("o", lambda o: o.dropFields("pos")).alias("operatorsInfo"))


def read_task_metrics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Task metric documents of several size folders: ``plan_id`` is the file name up to ``-``."""
    docs = spark.read.schema(METRICS_SCHEMA).option("multiLine", True).json(paths)
    return docs.select(
        F.substring_index(_file_name(), "-", 1).alias("plan_id"), _folder_name().alias("data_id"), "vertices", "plan"
    )


def task_operators(docs: DataFrame) -> DataFrame:
    """Operator chains to one row per operator with its vertex's metrics.

    The last operator of a chain that is a sink wrote what it read; any grouping operator is
    called ``Group by``; a chain is known by the least source line in it. A vertex without
    exactly one plan node fails the query.
    """
    keys = [c for c in docs.columns if c not in ("vertices", "plan")]
    long = docs.select(*keys, "plan.nodes", F.posexplode("vertices").alias("vertex_no", "v"))
    match = F.filter("nodes", lambda n: n["id"] == F.col("v.id"))
    chain = F.when(F.size(match) == 1, F.get(match, 0)["operator"]).otherwise(
        F.raise_error(F.concat(F.lit("vertex without one plan node: "), F.col("v.id"))).cast("string")
    )
    long = long.withColumn("names", F.split(chain, " -> ")).withColumn("places", F.split("v.name", "->"))
    lines = F.transform(F.slice("places", F.lit(1), F.size("names")), lambda p: code_line(p))
    long = long.withColumn("chain_id", F.array_min(lines))
    rows = long.select(
        *keys, "vertex_no", "chain_id", "v.metrics", F.size("names").alias("n"), "places",
        F.posexplode("names").alias("i", "operator"),
    )
    place = F.get("places", F.col("i"))
    sink = (F.col("i") + 1 == F.col("n")) & (F.col("operator") == "Data Sink")
    m = F.col("metrics")
    return rows.select(
        *keys,
        "vertex_no",
        F.col("i").alias("place_in_chain"),
        F.when(F.col("operator").contains("Group"), "Group by").otherwise(F.col("operator")).alias("pact"),
        m["read-bytes"].alias("read_bytes"),
        m["read-records"].alias("read_records"),
        F.when(sink, m["read-bytes"]).otherwise(m["write-bytes"]).alias("write_bytes"),
        F.when(sink, m["read-records"]).otherwise(m["write-records"]).alias("write_records"),
        code_place(place).alias("code_place"),
        code_line(place).alias("id"),
        "chain_id",
    )


def measured_operators(operators: DataFrame) -> DataFrame:
    """Measured operator rows in the shape the feature operators read; ``pos`` numbers the operators of a document by
    chain, vertex and place."""
    order = W.partitionBy("plan_id", "data_id").orderBy("chain_id", "vertex_no", "place_in_chain")  # one document
    return operators.select(
        "plan_id",
        "data_id",
        (F.row_number().over(order) - 1).cast("bigint").alias("pos"),
        "pact",
        F.col("write_records").cast("double").alias("out_cardinality"),
        "id",
    )
