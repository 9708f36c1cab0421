"""Registered queries: plan graphs, sequences, walks, join paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlab import catalog
from planlab.operators import graphs, ordered, walks
from planlab.operators import relational as R
from planlab.plans.basics import q
from planlab.sources.tables import Tables, micros

TYPES = ["click", "error", "purchase", "signup", "view"]
ROLES = ["assistant", "system", "user"]


def event_pairs(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "event_type", micros("ts").alias("at"))
    return graphs.sequence_pairs(rows, "user_id", ["at", "event_id"], "event_type")


def dialogue(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Conversation turns as a graph with branches: a turn feeds the next, the second next or
    the third next turn depending on its place."""
    nodes = t.conversations.select(
        F.col("conv_id").alias("plan_id"),
        F.col("turn").alias("id"),
        F.col("role").alias("category"),
        F.length("text").alias("parallelism"),
    )
    turn = F.col("id")
    hops = F.filter(
        F.array(
            F.when(~(turn % 4).isin(1, 3), 1),
            F.when((turn % 3 == 0) & (turn > 0), 2),
            F.when(turn % 2 == 1, 3),
        ),
        lambda h: h.isNotNull(),
    )
    edges = nodes.select("plan_id", F.col("id").alias("src"), F.explode(hops).alias("h")).select(
        "plan_id", "src", (F.col("src") + F.col("h")).alias("dst")
    )
    present = nodes.select("plan_id", F.col("id").alias("dst"))
    return nodes, edges.join(present, ["plan_id", "dst"], "left_semi").select("plan_id", "src", "dst")


DIALOGUE_SQL = """
    nodes AS (SELECT conv_id AS plan_id, turn AS id, role AS category, length(text) AS parallelism FROM conversations),
    edges AS (SELECT n.plan_id, n.id AS src, m.id AS dst FROM nodes n JOIN nodes m ON n.plan_id = m.plan_id AND (
        (n.id % 4 NOT IN (1, 3) AND m.id = n.id + 1) OR (n.id % 3 = 0 AND n.id > 0 AND m.id = n.id + 2)
        OR (n.id % 2 = 1 AND m.id = n.id + 3))),
    src AS (SELECT plan_id, id FROM nodes EXCEPT SELECT plan_id, dst FROM edges),
    snk AS (SELECT plan_id, id FROM nodes EXCEPT SELECT plan_id, src FROM edges)"""

PAIRS_SQL = """
    pairs AS (SELECT event_type AS category,
        COALESCE(LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS parent,
        COALESCE(LEAD(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS child FROM events)"""


def matrix(t: Tables, relationship: str) -> DataFrame:
    out = graphs.transitions(event_pairs(t), relationship)
    return out.select("from_state", "to_state", "n", F.round("p", 10).alias("p"))


def _matrix_sql(relationship: str) -> str:
    return f"""WITH {PAIRS_SQL}, c AS (SELECT category, {relationship} AS to_state, COUNT(*) AS n FROM pairs GROUP BY 1, 2)
        SELECT category AS from_state, to_state, n, ROUND(n / SUM(n) OVER (PARTITION BY category), 10) AS p FROM c"""


def transitions_null(t: Tables) -> DataFrame:
    """Every seventh event has no type: null is a category that follows and is followed."""
    kind = F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    rows = t.events.select("user_id", "event_id", kind.alias("kind"), micros("ts").alias("at"))
    out = graphs.transitions(graphs.sequence_pairs(rows, "user_id", ["at", "event_id"], "kind"))
    return out.select("from_state", "to_state", "n", F.round("p", 10).alias("p"))


def transition_faults(t: Tables) -> DataFrame:
    return graphs.transition_faults(graphs.transitions(event_pairs(t)))


def graph_transitions(t: Tables) -> DataFrame:
    nodes, edges = dialogue(t)
    return graphs.transitions(graphs.relative_pairs(nodes, edges)).select("from_state", "to_state", "n", F.round("p", 10).alias("p"))


def enriched(t: Tables) -> DataFrame:
    nodes, edges = dialogue(t)
    return graphs.enriched_nodes(nodes, edges).drop("parallelism")


def open_roles(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The dialogue with a role that no list knows, and turns without one."""
    nodes, edges = dialogue(t)
    role = F.when(F.col("id") % 5 == 3, "tool").when(F.col("id") % 7 != 4, F.col("category"))
    return nodes.withColumn("category", role), edges


def enriched_open(t: Tables) -> DataFrame:
    nodes, edges = open_roles(t)
    return graphs.enriched_nodes(nodes, edges).drop("parallelism")


def graph_transitions_open(t: Tables) -> DataFrame:
    out = graphs.transitions(graphs.relative_pairs(*open_roles(t)))
    return out.select("from_state", "to_state", "n", F.round("p", 10).alias("p"))


def graph_features_open(t: Tables) -> DataFrame:
    out = graphs.plan_graph_features(*open_roles(t))
    return out.withColumn("avg_parallelism", F.round("avg_parallelism", 6))


def relatives(t: Tables) -> DataFrame:
    nodes, edges = dialogue(t)
    total = graphs.neighbour_rows(nodes, edges, "children").groupBy("plan_id", "id").agg(F.sum("n").alias("n"))
    total = nodes.select("plan_id", "id", "category").join(total, ["plan_id", "id"], "left").fillna(0, ["n"])
    grid = [0.01 + i * 0.01 for i in range(99)]
    out = ordered.quantiles(total, ["category"], "n", grid, "lower")
    return out.select("category", F.round(F.col("q") * 100).cast("int").alias("pct"), "v")


def longest_path(t: Tables) -> DataFrame:
    return graphs.longest_path(*dialogue(t))


def path_quantiles(t: Tables) -> DataFrame:
    """Quantiles of path lengths of linear sequences: events per user less one."""
    lengths = t.events.groupBy("user_id").agg((F.count(F.lit(1)) - 1).alias("length"))
    grid = [0.01 + i * 0.01 for i in range(99)]
    out = ordered.quantiles(lengths, [], "length", grid, "higher")
    return out.select(F.round(F.col("q") * 100).cast("int").alias("pct"), "v")


def reachability(t: Tables) -> DataFrame:
    nodes, edges = dialogue(t)
    return graphs.reachable(graphs.sources(nodes, edges), edges).select("plan_id", "start", "id", "depth")


def feeding_sources(t: Tables) -> DataFrame:
    """Which sources reach each sink."""
    nodes, edges = dialogue(t)
    up = graphs.reachable(graphs.sinks(nodes, edges), edges, direction="parents")
    return up.join(graphs.sources(nodes, edges), ["plan_id", "id"], "left_semi").select(
        "plan_id", F.col("start").alias("sink"), F.col("id").alias("source")
    )


def shortest_branch(t: Tables) -> DataFrame:
    nodes, edges = dialogue(t)
    up = graphs.reachable(graphs.sinks(nodes, edges), edges, direction="parents")
    pairs = up.join(graphs.sources(nodes, edges), ["plan_id", "id"], "left_semi").select(
        "plan_id", F.col("id").alias("start"), F.col("start").alias("id")
    )
    return graphs.shortest_branch(pairs, edges).select("plan_id", "start", "target", "place", "id")


def graph_features(t: Tables) -> DataFrame:
    nodes, edges = dialogue(t)
    out = graphs.plan_graph_features(nodes, edges)
    return out.withColumn("avg_parallelism", F.round("avg_parallelism", 6))


def event_walks(t: Tables) -> DataFrame:
    """One walk per user over the users' own transition counts."""
    pairs = event_pairs(t).select(
        "category",
        F.when(F.col("parent") == "", F.lit("signup")).otherwise(F.col("parent")).alias("parent"),
        F.when(F.col("child") == "", F.lit("end")).otherwise(F.col("child")).alias("child"),
        "weight",
    )
    ids = t.events.select(F.col("user_id").alias("walk_id")).distinct()
    return walks.walks(
        ids,
        graphs.transitions(pairs, "child"),
        graphs.transitions(pairs, "parent"),
        start="signup",
        end="end",
        join="error",
        max_depth=6,
        max_joins=1,
    )


def many_states(t: Tables) -> DataFrame:
    """Parts as states: a part is followed by those of the next line of its supplier. Walks of one step from a part each."""
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.concat(F.lit("p"), "l_partkey").alias("part"))
    pairs = graphs.sequence_pairs(rows, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "part")
    counts = graphs.transitions(pairs.where("child <> ''"))
    ids = t.part.select(F.col("p_partkey").alias("walk_id"), F.concat(F.lit("p"), "p_partkey").alias("state"))
    return walks.following(ids, counts)


def path_depths(t: Tables) -> DataFrame:
    """A depth for every user's walk, drawn from the quantiles of the users' sequence lengths."""
    grid = path_quantiles(t).select((F.col("pct") - 1).alias("place"), F.col("v").alias("length"))
    ids = t.events.select(F.col("user_id").alias("walk_id")).distinct()
    return walks.drawn_depths(ids, grid)


def drawn_walks(t: Tables) -> DataFrame:
    """Walks as deep as drawn: how long they get, how many joins they meet, and in which states they are at their steps."""
    pairs = event_pairs(t).select(
        "category",
        F.when(F.col("parent") == "", F.lit("signup")).otherwise(F.col("parent")).alias("parent"),
        F.when(F.col("child") == "", F.lit("end")).otherwise(F.col("child")).alias("child"),
        "weight",
    )
    depths = path_depths(t)
    rows = walks.walks(
        depths.select("walk_id"), graphs.transitions(pairs, "child"), graphs.transitions(pairs, "parent"),
        start="signup", end="end", join="error", max_depth=depths, max_joins=2,
    )
    return rows.where("branch = 0").select("walk_id", "step", "state")


_CUM = """SELECT category, {to} AS to_state, SUM(n) OVER (PARTITION BY category ORDER BY {to}) AS upto,
                 SUM(n) OVER (PARTITION BY category) AS total
          FROM (SELECT category, {to}, COUNT(*) AS n FROM walkpairs WHERE {cond} GROUP BY 1, 2) x"""

WALKS_SQL = f"""WITH RECURSIVE {PAIRS_SQL},
    walkpairs AS (SELECT category, CASE WHEN parent = '' THEN 'signup' ELSE parent END AS parent,
                         CASE WHEN child = '' THEN 'end' ELSE child END AS child FROM pairs),
    fwd AS ({_CUM.format(to="child", cond="TRUE")}),
    fwd0 AS ({_CUM.format(to="child", cond="child <> 'error'")}),
    back AS ({_CUM.format(to="parent", cond="parent <> 'error'")}),
    w AS (
        SELECT DISTINCT user_id AS walk_id, 0 AS step, 'signup' AS state, 0 AS joins FROM events
        UNION ALL
        SELECT walk_id, step + 1, nxt, joins + CASE WHEN nxt = 'error' THEN 1 ELSE 0 END FROM (
            SELECT walk_id, step, joins, CASE WHEN joins >= 1 AND a = 'error' THEN b ELSE a END AS nxt FROM (
                SELECT w.walk_id, w.step, w.joins,
                    (SELECT min(to_state) FROM fwd f WHERE f.category = w.state AND f.upto >
                        (('0x' || substr(md5('42|' || w.walk_id || '|' || (w.step + 1)), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE) * f.total) AS a,
                    (SELECT min(to_state) FROM fwd0 f WHERE f.category = w.state AND f.upto >
                        (('0x' || substr(md5('42|' || w.walk_id || '|' || (w.step + 1)), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE) * f.total) AS b
                FROM w WHERE w.step < 6 AND w.state <> 'end') y) z),
    main AS (SELECT walk_id, step, state FROM w
             UNION ALL SELECT walk_id, max(step) + 1, 'end' FROM w GROUP BY 1 HAVING NOT bool_or(state = 'end')),
    br AS (
        SELECT walk_id, step, 0 AS b, state FROM main WHERE state = 'error'
        UNION ALL
        SELECT br.walk_id, br.step, br.b + 1,
            (SELECT min(to_state) FROM back f WHERE f.category = br.state AND f.upto >
                (('0x' || substr(md5('42|' || br.walk_id || '|' || br.step || '|b|' || (br.b + 1)), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE) * f.total)
        FROM br WHERE br.b < 3 AND br.state <> 'signup')
    SELECT walk_id, step, 0 AS branch, state FROM main
    UNION ALL SELECT walk_id, step, b AS branch, state FROM br WHERE b > 0
    UNION ALL SELECT walk_id, step, max(b) + 1, 'signup' FROM br GROUP BY 1, 2 HAVING NOT bool_or(state = 'signup')"""


def _drawn_walks_sql() -> str:
    """The main lines of WALKS_SQL, each as deep as its draw, with two joins."""
    u = "('0x' || substr(md5('42|' || w.walk_id || '|' || (w.step + 1)), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE"
    return f"""WITH RECURSIVE {PAIRS_SQL},
    walkpairs AS (SELECT category, CASE WHEN parent = '' THEN 'signup' ELSE parent END AS parent,
                         CASE WHEN child = '' THEN 'end' ELSE child END AS child FROM pairs),
    fwd AS ({_CUM.format(to="child", cond="TRUE")}),
    fwd0 AS ({_CUM.format(to="child", cond="child <> 'error'")}),
    lens AS (SELECT COUNT(*) - 1 AS v FROM events GROUP BY user_id),
    o AS (SELECT v, ROW_NUMBER() OVER (ORDER BY v) - 1 AS i, COUNT(*) OVER () AS n FROM lens),
    g AS (SELECT i AS place, 0.01::DOUBLE + i * 0.01::DOUBLE AS p FROM range(99) r(i)),
    l AS (SELECT place, v AS depth FROM o JOIN g ON o.i = ceil(p * (o.n - 1))),
    ids AS (SELECT DISTINCT user_id AS walk_id,
                   floor(('0x' || substr(md5('42|' || user_id || '|depth'), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE * 99) AS place FROM events),
    w AS (
        SELECT walk_id, depth, 0 AS step, 'signup' AS state, 0 AS joins FROM ids JOIN l USING (place)
        UNION ALL
        SELECT walk_id, depth, step + 1, nxt, joins + CASE WHEN nxt = 'error' THEN 1 ELSE 0 END FROM (
            SELECT walk_id, depth, step, joins, CASE WHEN joins >= 2 AND a = 'error' THEN b ELSE a END AS nxt FROM (
                SELECT w.walk_id, w.depth, w.step, w.joins,
                    (SELECT min(to_state) FROM fwd f WHERE f.category = w.state AND f.upto > ({u}) * f.total) AS a,
                    (SELECT min(to_state) FROM fwd0 f WHERE f.category = w.state AND f.upto > ({u}) * f.total) AS b
                FROM w WHERE w.step < w.depth AND w.state <> 'end') y) z)
    SELECT walk_id, step, state FROM w
    UNION ALL SELECT walk_id, max(step) + 1, 'end' FROM w GROUP BY 1 HAVING NOT bool_or(state = 'end')"""


def walk_documents(t: Tables) -> DataFrame:
    docs = walks.node_link_documents(event_walks(t))
    return docs.select("walk_id", F.size("nodes").alias("n_nodes"), F.coalesce(F.size("links"), F.lit(0)).alias("n_links"))


def measured_relations(t: Tables) -> DataFrame:
    """Relations with the number of row pairs they join, from per-key counts."""
    frames = []
    for r in catalog.RELATIONS:
        left = getattr(t, r.left).groupBy(F.col(r.left_key).alias("k")).agg(F.count(F.lit(1)).alias("a"))
        right = getattr(t, r.right).groupBy(F.col(r.right_key).alias("k")).agg(F.count(F.lit(1)).alias("b"))
        size = left.join(right, "k").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("joined_rows"))
        frames.append(size.select(F.lit(r.name).alias("relation"), F.lit(r.left).alias("lhs"), F.lit(r.right).alias("rhs"), "joined_rows"))
    one_way = R.stack(frames)
    back = one_way.select("relation", F.col("rhs").alias("lhs"), F.col("lhs").alias("rhs"), "joined_rows")
    return one_way.unionByName(back)


def join_paths(t: Tables) -> DataFrame:
    """Three-hop paths with the join size of their last relation."""
    edges = measured_relations(t)
    paths = walks.join_paths(edges, 3)
    sizes = edges.select(F.col("relation").alias("last"), "joined_rows").distinct()
    return paths.withColumn("last", F.element_at("relations", -1)).join(sizes, "last").select(
        "start", F.array_join("tables", ">").alias("tables"), F.array_join("relations", ">").alias("relations"), "joined_rows"
    )


def picked_path(t: Tables) -> DataFrame:
    picked = walks.pick_path(walks.join_paths(measured_relations(t).where("joined_rows > 0"), 2), 7)
    return picked.select("start", F.array_join("tables", ">").alias("tables"), F.array_join("relations", ">").alias("relations"))


RELATIONS_SQL = "one AS (" + " UNION ALL ".join(
    f"SELECT '{r.name}' AS relation, '{r.left}' AS lhs, '{r.right}' AS rhs, "
    f"(SELECT COUNT(*) FROM {r.left} JOIN {r.right} ON {r.left_key} = {r.right_key}) AS joined_rows"
    for r in catalog.RELATIONS
) + "), rel AS (SELECT * FROM one UNION ALL SELECT relation, rhs, lhs, joined_rows FROM one)"

BFS_SQL = """r AS (SELECT plan_id, id AS start, id, 0 AS depth FROM {start}
        UNION SELECT r.plan_id, r.start, e.{to}, r.depth + 1 FROM r JOIN edges e ON r.plan_id = e.plan_id AND r.id = e.{at})"""

OPEN_SQL = DIALOGUE_SQL.replace("role AS category", "CASE WHEN turn % 5 = 3 THEN 'tool' WHEN turn % 7 <> 4 THEN role END AS category")
OPEN_ROLES = [*(f"= '{r}'" for r in (*ROLES[:2], "tool", ROLES[2])), "IS NULL"]

QUERIES = {
    "enriched_open": (
        q(enriched_open),
        f"WITH {OPEN_SQL} SELECT n.plan_id, n.id, n.category, "
        + ", ".join(
            f"(SELECT COUNT(*) FROM edges e JOIN nodes m ON m.plan_id = e.plan_id AND m.id = e.{o} WHERE e.plan_id = n.plan_id AND e.{mine} = n.id AND m.category {r}) AS {d}_{i}"
            for d, mine, o in (("parents", "dst", "src"), ("children", "src", "dst"))
            for i, r in enumerate(OPEN_ROLES)
        )
        + ", "
        + ", ".join(
            f"COALESCE((SELECT string_agg(COALESCE(m.category, 'null'), ', ' ORDER BY COALESCE(m.category, 'null')) FROM edges e JOIN nodes m ON m.plan_id = e.plan_id AND m.id = e.{o} WHERE e.plan_id = n.plan_id AND e.{mine} = n.id), '') AS {d}_text"
            for d, mine, o in (("parents", "dst", "src"), ("children", "src", "dst"))
        )
        + " FROM nodes n",
    ),
    "graph_transitions_open": (
        q(graph_transitions_open),
        f"""WITH {OPEN_SQL},
            p AS (SELECT n.plan_id, n.id, n.category, COALESCE(NULLIF(COUNT(e.src), 0), 1) AS w
                  FROM nodes n LEFT JOIN edges e ON e.plan_id = n.plan_id AND e.dst = n.id GROUP BY 1, 2, 3),
            c AS (SELECT p.category AS from_state, CASE WHEN e.dst IS NULL THEN '' ELSE m.category END AS to_state, SUM(p.w)::BIGINT AS n
                  FROM p LEFT JOIN edges e ON e.plan_id = p.plan_id AND e.src = p.id
                  LEFT JOIN nodes m ON m.plan_id = e.plan_id AND m.id = e.dst GROUP BY 1, 2)
            SELECT from_state, to_state, n, ROUND(n / SUM(n) OVER (PARTITION BY from_state), 10) AS p FROM c""",
    ),
    "graph_features_open": (
        q(graph_features_open),
        f"""WITH RECURSIVE {OPEN_SQL}, {BFS_SQL.format(start="nodes", to="dst", at="src")}
            SELECT n.plan_id, {", ".join(f"COUNT(*) FILTER (WHERE category {c}) AS n_{i}" for i, c in enumerate(OPEN_ROLES))},
                   COUNT(*) AS n_nodes, ROUND(AVG(parallelism), 6) AS avg_parallelism,
                   (SELECT COUNT(*) FROM edges e WHERE e.plan_id = n.plan_id) AS n_edges,
                   (SELECT MAX(depth) FROM r WHERE r.plan_id = n.plan_id) AS longest_path
            FROM nodes n GROUP BY 1""",
    ),
    "transitions": (q(lambda t: matrix(t, "child")), _matrix_sql("child")),
    "transitions_reverse": (q(lambda t: matrix(t, "parent")), _matrix_sql("parent")),
    "transitions_null": (
        q(transitions_null),
        """WITH e AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN event_type END AS kind FROM events),
            p AS (SELECT kind AS from_state, CASE WHEN LEAD(event_id) OVER w IS NULL THEN '' ELSE LEAD(kind) OVER w END AS to_state
                  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
            c AS (SELECT from_state, to_state, COUNT(*) AS n FROM p GROUP BY 1, 2)
            SELECT from_state, to_state, n, ROUND(n / SUM(n) OVER (PARTITION BY from_state), 10) AS p FROM c""",
    ),
    "transition_faults": (
        q(transition_faults),
        f"""WITH {PAIRS_SQL}, s AS (SELECT COUNT(DISTINCT category) AS r, COUNT(DISTINCT child) AS c FROM pairs)
            SELECT 'shape' AS fault, '' AS state FROM s WHERE r <> c""",
    ),
    "graph_transitions": (
        q(graph_transitions),
        f"""WITH {DIALOGUE_SQL},
            p AS (SELECT n.plan_id, n.id, n.category, COALESCE(NULLIF(COUNT(e.src), 0), 1) AS w
                  FROM nodes n LEFT JOIN edges e ON e.plan_id = n.plan_id AND e.dst = n.id GROUP BY 1, 2, 3),
            c AS (SELECT p.category AS from_state, COALESCE(m.category, '') AS to_state, SUM(p.w)::BIGINT AS n
                  FROM p LEFT JOIN edges e ON e.plan_id = p.plan_id AND e.src = p.id
                  LEFT JOIN nodes m ON m.plan_id = e.plan_id AND m.id = e.dst GROUP BY 1, 2)
            SELECT from_state, to_state, n, ROUND(n / SUM(n) OVER (PARTITION BY from_state), 10) AS p FROM c""",
    ),
    "enriched_nodes": (
        q(enriched),
        f"""WITH {DIALOGUE_SQL}
            SELECT n.plan_id, n.id, n.category, """
        + ", ".join(
            f"(SELECT COUNT(*) FROM edges e JOIN nodes m ON m.plan_id = e.plan_id AND m.id = e.{o} WHERE e.plan_id = n.plan_id AND e.{mine} = n.id AND m.category = '{r}') AS {d}_{i}"
            for d, mine, o in (("parents", "dst", "src"), ("children", "src", "dst"))
            for i, r in enumerate(ROLES)
        )
        + ", "
        + ", ".join(
            f"COALESCE((SELECT string_agg(m.category, ', ' ORDER BY m.category) FROM edges e JOIN nodes m ON m.plan_id = e.plan_id AND m.id = e.{o} WHERE e.plan_id = n.plan_id AND e.{mine} = n.id), '') AS {d}_text"
            for d, mine, o in (("parents", "dst", "src"), ("children", "src", "dst"))
        )
        + " FROM nodes n",
    ),
    "relatives": (
        q(relatives),
        f"""WITH {DIALOGUE_SQL},
            d AS (SELECT n.category, COUNT(e.dst) AS v FROM nodes n LEFT JOIN edges e ON e.plan_id = n.plan_id AND e.src = n.id GROUP BY n.plan_id, n.id, n.category),
            o AS (SELECT category, v, ROW_NUMBER() OVER (PARTITION BY category ORDER BY v) - 1 AS i, COUNT(*) OVER (PARTITION BY category) AS n FROM d),
            g AS (SELECT CAST(i + 1 AS INT) AS pct, 0.01::DOUBLE + i * 0.01::DOUBLE AS p FROM range(99) r(i))
            SELECT category, pct, v FROM o JOIN g ON o.i = floor(p * (o.n - 1))""",
    ),
    "longest_path": (
        q(longest_path),
        f"""WITH RECURSIVE {DIALOGUE_SQL}, {BFS_SQL.format(start="nodes", to="dst", at="src")}
            SELECT plan_id, MAX(depth) AS longest_path FROM r GROUP BY 1""",
    ),
    "path_quantiles": (
        q(path_quantiles),
        """WITH d AS (SELECT COUNT(*) - 1 AS v FROM events GROUP BY user_id),
            o AS (SELECT v, ROW_NUMBER() OVER (ORDER BY v) - 1 AS i, COUNT(*) OVER () AS n FROM d),
            g AS (SELECT CAST(i + 1 AS INT) AS pct, 0.01::DOUBLE + i * 0.01::DOUBLE AS p FROM range(99) r(i))
            SELECT pct, v FROM o JOIN g ON o.i = ceil(p * (o.n - 1))""",
    ),
    "reachability": (
        q(reachability),
        f"""WITH RECURSIVE {DIALOGUE_SQL}, {BFS_SQL.format(start="src", to="dst", at="src")}
            SELECT plan_id, start, id, MIN(depth) AS depth FROM r GROUP BY 1, 2, 3""",
    ),
    "feeding_sources": (
        q(feeding_sources),
        f"""WITH RECURSIVE {DIALOGUE_SQL}, {BFS_SQL.format(start="snk", to="src", at="dst")}
            SELECT DISTINCT r.plan_id, r.start AS sink, r.id AS source FROM r JOIN src ON src.plan_id = r.plan_id AND src.id = r.id""",
    ),
    "shortest_branch": (
        q(shortest_branch),
        f"""WITH RECURSIVE {DIALOGUE_SQL}, {BFS_SQL.format(start="src", to="dst", at="src")},
            d AS (SELECT plan_id, start, id, MIN(depth) AS depth FROM r GROUP BY 1, 2, 3),
            back AS (SELECT d.plan_id, d.start, d.id AS target, d.depth AS place, d.id FROM d JOIN snk ON d.plan_id = snk.plan_id AND d.id = snk.id
                     UNION ALL
                     SELECT b.plan_id, b.start, b.target, b.place - 1,
                            (SELECT MIN(e.src) FROM edges e JOIN d ON d.plan_id = e.plan_id AND d.id = e.src
                             WHERE e.plan_id = b.plan_id AND e.dst = b.id AND d.start = b.start AND d.depth = b.place - 1)
                     FROM back b WHERE b.place > 0)
            SELECT plan_id, start, target, place, id FROM back""",
    ),
    "graph_features": (
        q(graph_features),
        f"""WITH RECURSIVE {DIALOGUE_SQL}, {BFS_SQL.format(start="nodes", to="dst", at="src")}
            SELECT n.plan_id, {", ".join(f"COUNT(*) FILTER (WHERE category = '{c}') AS n_{i}" for i, c in enumerate(ROLES))},
                   COUNT(*) AS n_nodes, ROUND(AVG(parallelism), 6) AS avg_parallelism,
                   (SELECT COUNT(*) FROM edges e WHERE e.plan_id = n.plan_id) AS n_edges,
                   (SELECT MAX(depth) FROM r WHERE r.plan_id = n.plan_id) AS longest_path
            FROM nodes n GROUP BY 1""",
    ),
    "walks": (q(event_walks), WALKS_SQL),
    "many_states": (
        q(many_states),
        """WITH s AS (SELECT 'p' || l_partkey AS state, 'p' || LEAD(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS following FROM lineitem),
            c AS (SELECT state, following, COUNT(*) AS n FROM s WHERE following IS NOT NULL GROUP BY 1, 2),
            k AS (SELECT state, following, SUM(n) OVER (PARTITION BY state ORDER BY following) AS high, SUM(n) OVER (PARTITION BY state) AS total, n FROM c),
            w AS (SELECT p_partkey AS walk_id, 'p' || p_partkey AS state,
                         ('0x' || substr(md5('42|' || p_partkey || '|1'), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM part)
            SELECT walk_id, w.state, following FROM w JOIN k ON w.state = k.state AND k.high - k.n <= u * total AND k.high > u * total""",
    ),
    "path_depths": (
        q(path_depths),
        """WITH d AS (SELECT COUNT(*) - 1 AS v FROM events GROUP BY user_id),
            o AS (SELECT v, ROW_NUMBER() OVER (ORDER BY v) - 1 AS i, COUNT(*) OVER () AS n FROM d),
            g AS (SELECT i AS place, 0.01::DOUBLE + i * 0.01::DOUBLE AS p FROM range(99) r(i)),
            l AS (SELECT place, v AS length FROM o JOIN g ON o.i = ceil(p * (o.n - 1))),
            w AS (SELECT DISTINCT user_id AS walk_id,
                         floor(('0x' || substr(md5('42|' || user_id || '|depth'), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE * 99) AS place FROM events)
            SELECT walk_id, length::INT AS depth FROM w JOIN l USING (place)""",
    ),
    "drawn_walks": (q(drawn_walks), _drawn_walks_sql()),
    "walk_documents": (
        q(walk_documents),
        f"SELECT walk_id, COUNT(*) AS n_nodes, COUNT(*) - 1 AS n_links FROM ({WALKS_SQL}) x GROUP BY 1",
    ),
    "join_paths": (
        q(join_paths),
        f"""WITH {RELATIONS_SQL}
            SELECT a.lhs AS start, a.lhs || '>' || a.rhs || '>' || b.rhs || '>' || c.rhs AS tables,
                   a.relation || '>' || b.relation || '>' || c.relation AS relations, c.joined_rows
            FROM rel a JOIN rel b ON a.rhs = b.lhs AND a.relation <> b.relation
            JOIN rel c ON b.rhs = c.lhs AND c.relation NOT IN (a.relation, b.relation)""",
    ),
    "picked_path": (
        q(picked_path),
        f"""WITH {RELATIONS_SQL},
            p AS (SELECT a.lhs AS start, a.lhs || '>' || a.rhs || '>' || b.rhs AS tables, a.relation || '>' || b.relation AS relations
                  FROM rel a JOIN rel b ON a.rhs = b.lhs AND a.relation <> b.relation WHERE a.joined_rows > 0 AND b.joined_rows > 0)
            SELECT * FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY start
                ORDER BY ('0x' || substr(md5('7|' || relations), 1, 15))::UBIGINT, relations) = 1""",
    ),
}
