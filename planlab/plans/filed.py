"""Registered queries: tables written by the sinks and read back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlab.plans import joblog
from planlab.plans.basics import q
from planlab.session import shared_folder
from planlab.sources import documents, sinks, tables
from planlab.sources.tables import Tables


def _place(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/filed-{uuid.uuid4().hex}"


def delimited_file(t: Tables) -> DataFrame:
    """Customers as text without a header, fields apart by a bar, read back by position."""
    path = _place(t)
    t.customer.write.option("sep", "|").csv(path)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return tables.read_delimited(t.spark, path, schema)


def dated_file(t: Tables) -> DataFrame:
    """Orders with semicolons, their days parsed by name."""
    path = _place(t)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    t.orders.select("o_orderkey", day, "o_orderpriority").write.option("sep", ";").csv(path)
    schema = "o_orderkey bigint, day date, o_orderpriority string"
    return tables.read_delimited(t.spark, path, schema, ";", ("day",))


def job_log_file(t: Tables) -> DataFrame:
    """The operator log nested to one record per job, written as JSON, and flattened again."""
    path = _place(t)
    log = joblog.operators(t).withColumns({"id": F.pmod("pos", F.lit(1000000)).cast("int"), "var_name": F.concat(F.lit("v"), "pos")})
    sinks.write_job_log(documents.job_log_records(log), path)
    back = documents.read_job_log(t.spark, path)
    return back.select("plan_id", "id", "var_name", "pact", "table_name", "tables", "selectivity", "out_cardinality", "complexity")


def feature_file(t: Tables) -> DataFrame:
    """A feature table as CSV with a header, reloaded under its schema."""
    path = _place(t)
    rows = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"))
    sinks.discard(rows)
    sinks.write_features(rows, path)
    return sinks.read_features(t.spark, path, "l_partkey bigint, quantity double, lines bigint")


def id_file(t: Tables) -> DataFrame:
    """Ids as lines of text."""
    path = _place(t)
    sinks.write_ids(t.orders.where("o_orderstatus = 'P'"), "o_orderkey", path)
    return t.spark.read.text(path)


QUERIES = {
    "delimited_file": (q(delimited_file), "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "dated_file": (q(dated_file), "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority FROM orders"),
    "job_log_file": (
        q(job_log_file),
        f"""WITH {joblog.OPERATORS_SQL}
            SELECT plan_id, (((pos % 1000000) + 1000000) % 1000000)::INT AS id, 'v' || pos AS var_name, pact, tables[1] AS table_name, tables, selectivity, out_cardinality, complexity FROM ops""",
    ),
    "feature_file": (q(feature_file), "SELECT l_partkey, SUM(l_quantity) AS quantity, COUNT(*) AS lines FROM lineitem GROUP BY 1"),
    "id_file": (q(id_file), "SELECT o_orderkey::VARCHAR AS value FROM orders WHERE o_orderstatus = 'P'"),
}
