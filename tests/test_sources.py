"""Sources and sinks on files written by the test."""

import datetime
import json

from pyspark.sql import functions as F

from planlab.functions import scalars
from planlab.operators import graphs
from planlab.sources import documents, sinks, tables


def test_delimited(spark, tmp_path):
    (tmp_path / "nation.tbl").write_text("0|ALGERIA|0|deep sea\n1|ARGENTINA|1|x\n")
    df = tables.read_tpch(spark, str(tmp_path / "nation.tbl"), "nation")
    assert [r["name"] for r in df.orderBy("nationkey").collect()] == ["ALGERIA", "ARGENTINA"]
    (tmp_path / "ratings.csv").write_text("tt1;5.6;1200\n")
    film = tables.read_film(spark, str(tmp_path / "ratings.csv"), "title.ratings").first()
    assert (film["titleId"], film["averageRating"], film["numVotes"]) == ("tt1", 5.6, 1200)
    (tmp_path / "d.csv").write_text("1,2020-02-03\n")
    day = tables.read_delimited(spark, str(tmp_path / "d.csv"), "id int, d date", ",", ("d",)).first()
    assert day["d"] == datetime.date(2020, 2, 3)
    tables.sql_view(df, "nations")
    assert spark.sql("select count(*) from nations").first()[0] == 2


PLAN = """{"netRunTime": 12, "executionPlan": {"nodes": [
 {"id": 2, "type": "bulk_iteration", "pact": "Bulk Iteration", "contents": "it", "parallelism": "4",
  "predecessors": [{"id": 1, "ship_strategy": "Broadcast"}], "costs": [],
  "step_function": [{"id": 5, "type": "pact", "pact": "Map", "parallelism": "4"},
                    {"id": 6, "type": "pact", "pact": "Reduce", "parallelism": "4", "predecessors": [{"id": 5, "ship_strategy": "Forward"}]}],
  "partial_solution": 5, "next_partial_solution": 6},
 {"id": 1, "type": "source", "pact": "Data Source", "contents": "x CHARACTER SET "UTF-16LE" y", "parallelism": "8",
  "costs": [{"name": "Disk", "value": "753.86 M"}, {"name": "CPU", "value": "9.03 K"}]}]}}"""


def test_plan_documents(spark, tmp_path):
    folder = tmp_path / "5GB"
    folder.mkdir()
    (folder / "Q1.json").write_text(PLAN)
    (folder / "Q2.json").write_text(PLAN.replace('"UTF-16LE"', '\\"UTF-16LE\\"'))
    plans = documents.read_plans(spark, str(folder))
    nodes = documents.plan_nodes(plans).where("plan_id = 'Q1'")
    assert plans.select("plan_id", "data_id", documents.size_of().alias("s")).distinct().count() == 2
    assert {r["contents"] for r in nodes.collect()} == {"it", 'x CHARACTER SET "UTF-16LE" y'}
    assert documents.plan_nodes(plans).count() == 4
    edges = graphs.edges_of(nodes).collect()
    assert [(e["src"], e["dst"], e["broadcast"]) for e in edges] == [(1, 2, True)]
    assert {r["id"] for r in graphs.iteration_nodes(nodes).collect()} == {5, 6}
    loop = {(r["src"], r["dst"]) for r in graphs.iteration_edges(nodes).collect()}
    assert loop == {(5, 6), (6, 5), (6, 2)}
    cost = graphs.plan_costs(nodes, ["Disk", "CPU"]).first()
    assert cost["Disk"] == 753.86 and cost["CPU"] is None


def test_units(spark):
    texts = ["753.86 M", "2 G", "0.0", "9.03 K", "(unknown)", "1e3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["v"] for r in df.select("i", scalars.with_unit("t").alias("v")).orderBy("i").collect()]
    assert got == [753.86, 2000.0, 0.0, None, None, 1000.0]


def test_job_log_round_trip(spark, tmp_path):
    log = [{"JobId": "Job1v0", "operatorsInfo": [
        {"id": 0, "varName": "source0", "pact": "Data Source", "tables": ["a"], "selectivity": 1.0},
        {"id": 1, "varName": "map1", "pact": "Map", "tables": ["a"], "selectivity": 1.0, "complexity": 2}, {}]}]
    (tmp_path / "log.json").write_text(json.dumps(log))
    ops = documents.read_job_log(spark, str(tmp_path / "log.json"), multi_line=True)
    assert [r["pact"] for r in ops.orderBy("pos").collect()] == ["Data Source", "Map"]
    sinks.write_job_log(documents.job_log_records(ops), str(tmp_path / "out"))
    back = documents.read_job_log(spark, str(tmp_path / "out"))
    assert sorted(back.collect()) == sorted(ops.collect())


def vertex(name, place, read, written):
    """A vertex with ten bytes a record."""
    figures = {"read-records": read, "read-bytes": 10 * read, "write-records": written, "write-bytes": 10 * written}
    return {"id": name, "name": place, "metrics": figures}


METRICS = {
    "vertices": [
        vertex("in", "CHAIN DataSource (at demo.Load.main(Load.java:12) (demo.Reader)) -> Map (Map at demo.Load.main(Load.java:15)) -> Map (x)", 0, 40),
        vertex("combine", "GroupCombine (GroupCombine at demo.Load.lambda$1(Sums.java:7))", 40, 9),
        vertex("out", "DataSink (print())", 9, 0),
    ],
    "plan": {"nodes": [
        {"id": "out", "operator": "Data Sink"}, {"id": "combine", "operator": "GroupCombine"}, {"id": "in", "operator": "Data Source -> Map -> Map"},
    ]},
}


def test_task_metrics(spark, tmp_path):
    folder = tmp_path / "1GB"
    folder.mkdir()
    (folder / "Job3v1-20200101.json").write_text(json.dumps(METRICS))
    rows = documents.task_operators(documents.read_task_metrics(spark, [str(folder)])).orderBy("vertex_no", "place_in_chain").collect()
    assert [(r["plan_id"], r["data_id"]) for r in rows] == [("Job3v1", "1GB")] * 5
    assert [r["pact"] for r in rows] == ["Data Source", "Map", "Map", "Group by", "Data Sink"]
    assert [r["code_place"] for r in rows] == [
        "demo.Load.main(Load.java:12)", "demo.Load.main(Load.java:15)", "", "demo.Load.lambda$1(Sums.java:7)", ""]
    assert [r["id"] for r in rows] == [12, 15, 1000000, 7, 1000000]
    assert [r["chain_id"] for r in rows] == [12, 12, 12, 7, 1000000]
    assert [r["write_records"] for r in rows] == [40, 40, 40, 9, 9]  # a sink wrote what it read
    measured = documents.measured_operators(documents.task_operators(documents.read_task_metrics(spark, [str(folder)])))
    assert measured.count() == 5 and measured.where("out_cardinality = 9").count() == 2
    positions = [r["pos"] for r in measured.orderBy("pos").collect()]
    assert len(set(positions)) == 5


def test_long_documents_keep_every_position(spark):
    """Two thousand vertices of one source line: no two operators share a place."""
    names = [f"v{i}" for i in range(2000)]
    doc = {"vertices": [vertex(n, "Map (Map at a.B.c(B.java:3))", 1, 1) for n in names], "plan": {"nodes": [{"id": n, "operator": "Map"} for n in names]}}
    text = spark.createDataFrame([(json.dumps(doc),)], "t string")
    docs = text.select(F.lit("p").alias("plan_id"), F.lit("d").alias("data_id"), F.from_json("t", documents.METRICS_SCHEMA).alias("m")).select("plan_id", "data_id", "m.vertices", "m.plan")
    measured = documents.measured_operators(documents.task_operators(docs))
    assert measured.select("pos").distinct().count() == 2000


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("Job1v0", "1GB", 2.5)], "plan_id string, data_id string, x double")
    sinks.discard(df)
    sinks.write_features(df, str(tmp_path / "f"))
    assert sinks.read_features(spark, str(tmp_path / "f"), "plan_id string, data_id string, x double").collect() == df.collect()
    sinks.write_features(df, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    sinks.write_ids(spark.range(3), "id", str(tmp_path / "ids"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "ids")).collect()) == ["0", "1", "2"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("x (at J.run(Q.scala:12) (y))",), ("nothing",)], "t string")
    assert [r[0] for r in df.select(scalars.code_line("t")).collect()] == [12, 1000000]
    day = df.select(scalars.format_date(scalars.parse_date(F.lit("2020-01-31")))).first()[0]
    assert day == "2020-01-31"
    assert df.select(scalars.category_of(F.lit("CoGroup"))).first()[0] == "Group by"
    assert df.select(scalars.category_of(F.lit("Other"))).first()[0] == "Other"
