"""Graph operators on small plans, walks and join paths."""

import random

import pytest
from pyspark.sql import functions as F

from planlab.operators import graphs, walks

DIAMOND = [("d", 1, 2), ("d", 1, 3), ("d", 2, 4), ("d", 3, 4), ("l", 1, 2)]


@pytest.fixture(scope="module")
def diamond(spark):
    edges = spark.createDataFrame(DIAMOND, "plan_id string, src int, dst int")
    rows = [("d", i, c) for i, c in ((1, "S"), (2, "M"), (3, "M"), (4, "J"))] + [("l", 1, "S"), ("l", 2, "J"), ("x", 1, "S")]
    return spark.createDataFrame(rows, "plan_id string, id int, category string"), edges


def test_paths(spark, diamond):
    nodes, edges = diamond
    assert {r["plan_id"]: r["longest_path"] for r in graphs.longest_path(nodes, edges).collect()} == {"d": 2, "l": 1, "x": 0}
    reach = {(r["plan_id"], r["id"], r["depth"]) for r in graphs.reachable(graphs.sources(nodes, edges), edges).collect()}
    assert reach == {("d", 1, 0), ("d", 2, 1), ("d", 3, 1), ("d", 4, 2), ("l", 1, 0), ("l", 2, 1), ("x", 1, 0)}
    pairs = spark.createDataFrame([("d", 1, 4)], "plan_id string, start int, id int")
    path = [r["id"] for r in graphs.shortest_branch(pairs, edges).orderBy("place").collect()]
    assert path == [1, 2, 4]


def test_cycle_is_refused(spark):
    edges = spark.createDataFrame([("c", 1, 2), ("c", 2, 1)], "plan_id string, src int, dst int")
    nodes = spark.createDataFrame([("c", 1), ("c", 2)], "plan_id string, id int")
    with pytest.raises(ValueError):
        graphs.longest_path(nodes, edges)


def test_relatives_and_transitions(diamond):
    nodes, edges = diamond
    rich = graphs.enriched_nodes(nodes, edges, ["S", "M", "J"])
    four = rich.where("plan_id = 'd' and id = 4").first()
    assert (four["parents_text"], four["children_text"], four["parents_1"]) == ("M, M", "", 2)
    pairs = graphs.relative_pairs(nodes, edges)
    row = pairs.where("plan_id = 'd' and id = 4").collect()
    assert [(r["parent"], r["child"], r["weight"]) for r in row] == [("M", "", 2)]
    matrix = graphs.transitions(pairs)
    sums = matrix.groupBy("from_state").agg(F.sum("p").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in sums)
    assert graphs.transition_faults(matrix).where("fault = 'sum'").count() == 0


def test_unknown_operator(spark):
    df = spark.createDataFrame([("Map",), ("GroupCombine",), ("Teleport",)], "pact string")
    assert [r["pact"] for r in graphs.unknown_categories(df).collect()] == ["Teleport"]
    good = df.where("pact <> 'Teleport'").select(graphs.checked_category().alias("c"))
    assert [r["c"] for r in good.collect()] == ["Map", "Group by"]
    with pytest.raises(Exception, match="unknown operator: Teleport"):
        df.select(graphs.checked_category()).collect()


def test_walks_keep_their_rules(spark):
    rows = [("Data Source", "Map", 3), ("Data Source", "Join", 2), ("Map", "Join", 2), ("Map", "Data Sink", 1), ("Join", "Map", 2),
            ("Join", "Join", 1), ("Join", "Data Sink", 1)]
    back = [("Join", "Data Source", 2), ("Join", "Map", 2), ("Join", "Join", 5), ("Map", "Data Source", 1), ("Map", "Join", 3)]
    schema = "from_state string, to_state string, n long"
    ids = spark.range(200).withColumnRenamed("id", "walk_id")
    out = walks.walks(ids, spark.createDataFrame(rows, schema), spark.createDataFrame(back, schema), max_joins=2)
    table = out.collect()
    again = out.repartition(3).collect()
    key = lambda r: (r["walk_id"], r["step"], r["branch"])
    assert sorted(table, key=key) == sorted(again, key=key)
    for i in range(200):
        main = [r["state"] for r in sorted((r for r in table if r["walk_id"] == i and r["branch"] == 0), key=key)]
        assert main[0] == "Data Source" and main[-1] == "Data Sink" and main.count("Data Sink") == 1
        assert len(main) <= 8 and main.count("Join") <= 2
        for step, state in enumerate(main):
            side = [r["state"] for r in sorted((r for r in table if r["walk_id"] == i and r["step"] == step and r["branch"] > 0), key=key)]
            assert bool(side) == (state == "Join")
            if side:
                assert side[-1] == "Data Source" and "Join" not in side and len(side) <= 4
    docs = walks.node_link_documents(out).collect()
    assert len(docs) == 200 and all(len(d["links"]) == len(d["nodes"]) - 1 for d in docs)


def test_walk_without_a_way_out_fails(spark):
    rows = spark.createDataFrame([("Data Source", "Join", 1), ("Join", "Join", 1)], "from_state string, to_state string, n long")
    back = spark.createDataFrame([("Join", "Data Source", 1)], "from_state string, to_state string, n long")
    ids = spark.range(1).withColumnRenamed("id", "walk_id")
    with pytest.raises(Exception, match="no other state follows"):
        walks.walks(ids, rows, back, max_joins=1).collect()


def test_join_paths(spark):
    rows = [("ab", "a", "b"), ("ab", "b", "a"), ("bc", "b", "c"), ("bc", "c", "b")]
    edges = spark.createDataFrame(rows, "relation string, lhs string, rhs string")
    got = {tuple(r["tables"]) for r in walks.join_paths(edges, 2).collect()}
    assert got == {("a", "b", "c"), ("c", "b", "a")}
    assert walks.join_paths(edges, 3).count() == 0


def random_plans(seed, plans=6, size=24):
    draw = random.Random(seed)
    out = []
    for p in range(plans):
        n = draw.randint(1, size)
        out += [(f"p{p}", u, v) for u in range(n) for v in range(u + 1, n) if draw.random() < 0.15]
        out += [out[-1]] if out else []  # an edge twice
    return out


def distances(edges):
    """Least edges from every node to every node of its plan, by breadth first search."""
    after, out = {}, {}
    for p, u, v in edges:
        after.setdefault((p, u), set()).add(v)
    for p, start in {(p, x) for p, u, v in edges for x in (u, v)}:
        front, depth, seen = {start}, 0, {start: 0}
        while front:
            depth += 1
            front = {v for u in front for v in after.get((p, u), ())} - set(seen)
            seen |= dict.fromkeys(front, depth)
        out |= {(p, start, x): d for x, d in seen.items()}
    return out


def longest(edges):
    out = {}
    for p, u, v in sorted(set(edges), key=lambda e: e[1]):
        out[p, v] = max(out.get((p, v), 0), out.get((p, u), 0) + 1)
    return {p: max(d for (q, _), d in out.items() if q == p) for p, _ in out}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_plans(spark, seed):
    rows = random_plans(seed)
    edges = spark.createDataFrame(rows, "plan_id string, src int, dst int").repartition(3)
    nodes = edges.selectExpr("plan_id", "src AS id").union(edges.selectExpr("plan_id", "dst AS id")).distinct()
    assert {r.plan_id: r.longest_path for r in graphs.longest_path(nodes, edges).collect()} == longest(rows)
    want = distances(rows)
    assert {(r.plan_id, r.start, r.id): r.depth for r in graphs.reachable(nodes, edges).collect()} == want
    pairs = [k for k, d in want.items() if d > 1][::3]
    got = {}
    asked = spark.createDataFrame(pairs + [(p, b, a) for p, a, b in pairs], "plan_id string, start int, id int")
    for r in graphs.shortest_branch(asked, edges).collect():
        got.setdefault((r.plan_id, r.start, r.target), {})[r.place] = r.id
    assert set(got) == set(pairs)
    known = set(rows)
    for (p, start, target), path in got.items():
        assert path[0] == start and path[want[p, start, target]] == target and len(path) == want[p, start, target] + 1
        assert all((p, path[i], path[i + 1]) in known for i in range(len(path) - 1))


def test_long_chain_takes_logarithmic_rounds(spark, monkeypatch):
    rounds = []
    keep = graphs.stored
    monkeypatch.setattr(graphs, "stored", lambda df: rounds.append(1) or keep(df))
    edges = spark.range(5000).selectExpr("'c' AS plan_id", "id AS src", "id + 1 AS dst")
    nodes = spark.range(5001).selectExpr("'c' AS plan_id", "id")
    assert [tuple(r) for r in graphs.longest_path(nodes, edges).collect()] == [("c", 5000)]
    assert len(rounds) <= 14


@pytest.mark.parametrize("size", [1, 2, 5, 64])
def test_every_cycle_is_refused(spark, size):
    edges = spark.range(size).selectExpr("'c' AS plan_id", "id AS src", f"(id + 1) % {size} AS dst")
    nodes = spark.range(size + 3).selectExpr("'c' AS plan_id", "id")
    with pytest.raises(Exception, match="not acyclic"):
        graphs.longest_path(nodes, edges).collect()


def test_closure_packs_starts(spark):
    """300 starts that all reach 40 nodes: a row for 64 of them, not one for each."""
    edges = spark.range(300 * 40).selectExpr("'w' AS plan_id", "id % 300 AS src", "1000 + id DIV 300 AS dst")
    starts = spark.range(300).selectExpr("'w' AS plan_id", "id")
    found = graphs.closure(starts, edges)
    assert found.labels.count() == 300 + 40 * 5
    assert found.pairs().where("id >= 1000").count() == 300 * 40
