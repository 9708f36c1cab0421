"""Plan graphs as node and edge tables.

Nodes: ``plan_id, id, pact``; edges: ``plan_id, src, dst``. Traversals advance all plans at once and keep
their state as tables keyed by single nodes: by doubled path lengths where the length alone is asked for, level by level, 64
starts to a row, where it matters what reaches what.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlab.functions.scalars import OPERATOR_GROUPS, category_of, with_unit
from planlab.operators import ordered
from planlab.operators.features import category_rows, found_categories, spread
from planlab.operators.relational import stack
from planlab.session import stored

CATEGORIES = list(OPERATOR_GROUPS)


def edges_of(nodes: DataFrame, key: str = "plan_id") -> DataFrame:
    """Explode predecessor lists to edges with the ship strategy; repeated edges count once."""
    long = nodes.select(key, F.col("id").alias("dst"), F.explode("predecessors").alias("p"))
    once = long.groupBy(key, F.col("p.id").alias("src"), "dst").agg(
        F.max("p.ship_strategy").alias("ship_strategy")
    )
    return once.withColumn("broadcast", F.coalesce(F.col("ship_strategy") == "Broadcast", F.lit(False)))


def iteration_nodes(nodes: DataFrame, key: str = "plan_id") -> DataFrame:
    """Step-function nodes of iterations as further nodes."""
    return nodes.where("type = 'bulk_iteration'").select(key, F.inline("step_function"))


def iteration_edges(nodes: DataFrame, key: str = "plan_id") -> DataFrame:
    """Edges inside step functions plus the two loop edges of each iteration."""
    loops = nodes.where("type = 'bulk_iteration'")
    inner = edges_of(iteration_nodes(nodes, key), key).select(key, "src", "dst")
    pairs = F.array(
        F.struct(F.col("next_partial_solution").alias("src"), F.col("partial_solution").alias("dst")),
        F.struct(F.col("next_partial_solution").alias("src"), F.col("id").alias("dst")),
    )
    return inner.unionByName(loops.select(key, F.inline(pairs)))


def neighbour_rows(nodes: DataFrame, edges: DataFrame, direction: str, key: str = "plan_id") -> DataFrame:
    """Per node and category the number of its parents (``direction="parents"``) or children: ``plan_id, id, category, n``.

    Every category is counted, null among them; nodes without such relatives have no row.
    """
    mine, other = ("dst", "src") if direction == "parents" else ("src", "dst")
    kind = nodes.select(key, F.col("id").alias(other), F.col("category").alias("__c"))
    long = edges.join(kind, [key, other]).select(key, F.col(mine).alias("id"), "__c")
    return category_rows(long, [key, "id"], "__c")


def neighbours_by_category(
    nodes: DataFrame, edges: DataFrame, direction: str, categories: list | None = None, key: str = "plan_id"
) -> DataFrame:
    """The same spread to columns ``<direction>_<place of the category>``, 0 where there is none: the categories the nodes
    have, in order, or the listed ones."""
    found = found_categories(nodes, "category") if categories is None else categories
    names = {c: f"{direction}_{i}" for i, c in enumerate(found)}
    counts = spread(neighbour_rows(nodes, edges, direction, key), [key, "id"], names, F.col("n"))
    return nodes.select(key, "id").join(counts, [key, "id"], "left").fillna(0, list(names.values()))


def category_text(direction: str, categories: list) -> Column:
    """Sorted, comma-joined category list of a node's relatives, written from its counts; null is written ``null``."""
    named = ["null" if c is None else c for c in categories]
    order = sorted(range(len(named)), key=lambda i: named[i])
    runs = [F.array_repeat(F.lit(named[i]), F.col(f"{direction}_{i}").cast("int")) for i in order]
    return F.array_join(F.concat(*runs), ", ")


def enriched_nodes(nodes: DataFrame, edges: DataFrame, categories: list | None = None, key: str = "plan_id") -> DataFrame:
    """Nodes with parent and child counts and texts."""
    found = found_categories(nodes, "category") if categories is None else categories
    out = nodes
    for direction in ("parents", "children"):
        out = out.join(neighbours_by_category(nodes, edges, direction, found, key), [key, "id"])
        out = out.withColumn(f"{direction}_text", category_text(direction, found))
    return out


def unknown_categories(nodes: DataFrame, column: str = "pact", groups=OPERATOR_GROUPS) -> DataFrame:
    """Nodes whose operator name belongs to no group."""
    known = [name for names in groups.values() for name in names]
    return nodes.where(~F.col(column).isin(*known))


def checked_category(column: str = "pact", groups=OPERATOR_GROUPS) -> Column:
    """Group of an operator name; an unknown name fails the query."""
    known = [name for names in groups.values() for name in names]
    bad = F.raise_error(F.concat(F.lit("unknown operator: "), F.col(column))).cast("string")
    return F.when(F.col(column).isin(*known), category_of(column, groups)).otherwise(bad)


def relative_pairs(nodes: DataFrame, edges: DataFrame, key: str = "plan_id") -> DataFrame:
    """One row per node and (parent category, child category), with how many parent/child
    combinations it stands for; the empty text stands for no relative, null for one without a category."""
    out = nodes.select(key, "id", "category")
    for direction, name in (("parents", "p"), ("children", "c")):
        rows = neighbour_rows(nodes, edges, direction, key)
        rows = rows.select(key, "id", F.struct(F.col("category").alias("c"), "n").alias(name))
        out = out.join(rows, [key, "id"], "left")
        none = F.struct(F.lit("").alias("c"), F.lit(1).cast("bigint").alias("n"))
        out = out.withColumn(name, F.coalesce(name, none))
    return out.select(
        key,
        "id",
        "category",
        F.col("p.c").alias("parent"),
        F.col("c.c").alias("child"),
        (F.col("p.n") * F.col("c.n")).alias("weight"),
    )


def sequence_pairs(df: DataFrame, key: str, order: list[str], category: str, parts: int | None = None) -> DataFrame:
    """Consecutive categories of event sequences: ``category, parent, child, weight``.

    The empty text stands for no neighbour, null for a neighbour whose category is null.
    """
    cell = F.struct(F.col(category).alias("c")).alias("__cell")
    rows = df.select(key, *order, category, cell)
    near = ordered.neighbours(rows, [key], order, {"child": "__cell"}, {"parent": "__cell"}, parts)
    beside = [F.when(F.col(x).isNull(), "").otherwise(F.col(f"{x}.c")).alias(x) for x in ("parent", "child")]
    return near.select(F.col(category).alias("category"), *beside, F.lit(1).cast("bigint").alias("weight"))


def transitions(pairs: DataFrame, relationship: str = "child") -> DataFrame:
    """Distribution of the next (``child``) or previous (``parent``) category per category; null is one of them."""
    counts = pairs.groupBy(F.col("category").alias("from_state"), F.col(relationship).alias("to_state")).agg(
        F.sum("weight").alias("n")
    )
    total = F.sum("n").over(W.partitionBy("from_state"))  # a row per category that follows
    return counts.withColumn("total", total).withColumn("p", F.col("n") / F.col("total"))


def transition_faults(matrix: DataFrame) -> DataFrame:
    """Rows that break the matrix: probabilities not summing to 1, or a matrix not square."""
    sums = matrix.groupBy("from_state").agg(F.sum("p").alias("total"))
    broken = sums.where(F.abs(F.col("total") - 1.0) > 1e-9).select(
        F.lit("sum").alias("fault"), F.col("from_state").alias("state")
    )
    shape = matrix.agg(F.count_distinct("from_state").alias("r"), F.count_distinct("to_state").alias("c"))
    return broken.unionByName(
        shape.where("r <> c").select(F.lit("shape").alias("fault"), F.lit("").alias("state"))
    )


def sources(nodes: DataFrame, edges: DataFrame, key: str = "plan_id") -> DataFrame:
    return nodes.select(key, "id").join(edges.select(key, F.col("dst").alias("id")), [key, "id"], "left_anti")


def sinks(nodes: DataFrame, edges: DataFrame, key: str = "plan_id") -> DataFrame:
    return nodes.select(key, "id").join(edges.select(key, F.col("src").alias("id")), [key, "id"], "left_anti")


def longest_path(nodes: DataFrame, edges: DataFrame, key: str = "plan_id") -> DataFrame:
    """Number of edges on the longest path of each acyclic plan.

    Round k finds the pairs of nodes that some path of exactly 2**k edges joins, from those of the round before,
    until there are none: a number of rounds logarithmic in the longest path. A plan's answer is then put together from the
    highest power down: of the nodes that some path of the length so far ends in, those that 2**k edges more lead on from,
    if there are any. A path with as many edges as the plan has nodes is a cycle and refused.
    """
    pairs = stored(edges.select(key, "src", "dst").distinct())
    powers, size = [], nodes.groupBy(key).agg(F.count_distinct("id").alias("__nodes"))
    most = size.agg(F.max("__nodes")).first()[0] or 0
    while not pairs.isEmpty():
        if 1 << len(powers) >= max(most, 1):
            raise ValueError("a plan is not acyclic")
        powers.append(pairs)
        onward = pairs.select(key, F.col("src").alias("dst"), F.col("dst").alias("__to"))
        pairs = stored(pairs.join(onward, [key, "dst"]).select(key, "src", F.col("__to").alias("dst")).distinct())
    state = nodes.select(key, "id").distinct().withColumn("length", F.lit(0))
    of_plan = W.partitionBy(key)  # a plan is one document
    for k in reversed(range(len(powers))):
        step = powers[k].select(key, F.col("src").alias("id"), F.col("dst").alias("__to"))
        here = F.struct("id", "length")
        there = F.struct(F.col("__to").alias("id"), (F.col("length") + (1 << k)).alias("length"))
        both = F.when(F.col("__to").isNull(), F.array(here)).otherwise(F.array(here, there))
        state = state.join(step, [key, "id"], "left").select(key, F.inline(both)).distinct()
        state = state.withColumn("__most", F.max("length").over(of_plan)).where("length = __most").drop("__most")
    out = state.groupBy(key).agg(F.max("length").alias("longest_path")).join(size, key)
    cycle = F.raise_error(F.lit("a plan is not acyclic")).cast("int")
    return out.select(key, F.when(F.col("longest_path") >= F.col("__nodes"), cycle).otherwise(F.col("longest_path")).alias("longest_path"))


@dataclass
class Closure:
    """Which starts reach which nodes, 64 starts of a plan to a row.

    ``labels``: ``plan_id, id, depth, word, bits``, where bit b of ``bits`` says that start number 64 * word + b first
    reaches the node by ``depth`` edges. ``numbers``: ``plan_id, start, word, bit``. Rows grow with the nodes and the depths
    at which they are met, not with starts times nodes.
    """

    labels: DataFrame
    numbers: DataFrame
    edges: DataFrame
    key: str

    def pairs(self) -> DataFrame:
        """``plan_id, start, id, depth`` of every start and node it reaches: the closure written out."""
        both = self.labels.join(self.numbers, [self.key, "word"]).where(_has_bit())
        return both.select(self.key, "start", "id", "depth")


def _has_bit(bits: str = "bits", bit: str = "bit") -> Column:
    return F.expr(f"(shiftrightunsigned({bits}, {bit}) & 1) = 1")


def closure(start: DataFrame, edges: DataFrame, key: str = "plan_id", direction: str = "children") -> Closure:
    """Nodes reachable from the start nodes (``plan_id, id``), level by level of edges.

    Give ``direction="parents"`` to walk upwards, for instance to find which sources feed a node.
    """
    a, b = ("src", "dst") if direction == "children" else ("dst", "src")
    edges = stored(edges.select(key, F.col(a).alias("__a"), F.col(b).alias("__b")).distinct())
    place = F.row_number().over(W.partitionBy(key).orderBy("id")) - 1
    numbers = start.select(key, "id").distinct().withColumn("__n", place)
    numbers = stored(numbers.select(key, F.col("id").alias("start"), F.floor(F.col("__n") / 64).cast("int").alias("word"), (F.col("__n") % 64).alias("bit")))
    own = F.expr("shiftleft(1L, bit)")
    front = stored(numbers.select(key, F.col("start").alias("id"), F.lit(0).alias("depth"), "word", own.alias("bits")))
    seen, levels = front, [front]
    while True:
        onward = front.select(key, F.col("id").alias("__a"), "word", "bits").join(edges, [key, "__a"])
        met = onward.groupBy(key, F.col("__b").alias("id"), "word").agg(F.bit_or("bits").alias("__met"))
        known = seen.groupBy(key, "id", "word").agg(F.bit_or("bits").alias("__known"))
        new = met.join(known, [key, "id", "word"], "left").withColumn("bits", F.expr("__met & ~coalesce(__known, 0L)"))
        front = stored(new.where("bits <> 0").select(key, "id", F.lit(len(levels)).alias("depth"), "word", "bits"))
        if front.isEmpty():
            return Closure(stack(levels) if len(levels) < 16 else stored(stack(levels)), numbers, edges, key)
        levels.append(front)
        seen = stack(levels) if len(levels) % 16 else stored(stack(levels).groupBy(key, "id", "word").agg(F.bit_or("bits").alias("bits")))


def reachable(start: DataFrame, edges: DataFrame, key: str = "plan_id", direction: str = "children") -> DataFrame:
    """Every start node with every node it reaches and the least number of edges: ``plan_id, start, id, depth``."""
    return closure(start, edges, key, direction).pairs()


def shortest_branch(pairs: DataFrame, edges: DataFrame, key: str = "plan_id") -> DataFrame:
    """Nodes on a shortest path for each wanted ``plan_id, start, id`` pair that is joined: one row per node.

    From the target back, each step takes the least node that the start first reaches one edge earlier; whether it does is a bit
    in the closure's labels.
    """
    found = closure(pairs.select(key, F.col("start").alias("id")).distinct(), edges, key)
    labels = stored(found.labels)
    here = pairs.select(key, "start", F.col("id").alias("target")).distinct().join(found.numbers, [key, "start"])
    ends = labels.select(key, F.col("id").alias("target"), "depth", "word", "bits")
    here = here.join(ends, [key, "target", "word"]).where(_has_bit())
    here = stored(here.select(key, "start", "target", "word", "bit", F.col("target").alias("id"), F.col("depth").alias("place")))
    rows = [here]
    while not here.where("place > 0").isEmpty():
        up = here.where("place > 0").withColumn("depth", F.col("place") - 1).withColumnRenamed("id", "__b")
        up = up.join(found.edges, [key, "__b"]).withColumnRenamed("__a", "id")
        up = up.join(labels, [key, "id", "depth", "word"]).where(_has_bit())
        here = stored(up.groupBy(key, "start", "target", "word", "bit", F.col("depth").alias("place")).agg(F.min("id").alias("id")))
        rows.append(here)
        if len(rows) > 16:
            rows = [stored(stack(rows))]
    return stack(rows).select(key, "start", "target", "place", "id")


def plan_graph_features(
    nodes: DataFrame, edges: DataFrame, categories: list | None = None, key: str = "plan_id"
) -> DataFrame:
    """One row per plan: category counts (``n_<place of the category>``), nodes, edges, longest path, mean parallelism."""
    found = found_categories(nodes, "category") if categories is None else categories
    names = {c: f"n_{i}" for i, c in enumerate(found)}
    kinds = spread(category_rows(nodes, key, "category"), key, names, F.col("n"))
    counts = nodes.groupBy(key).agg(F.count_distinct("id").alias("n_nodes"), F.avg("parallelism").alias("avg_parallelism"))
    n_edges = edges.groupBy(key).agg(F.count(F.lit(1)).alias("n_edges"))
    out = kinds.join(counts, key).join(n_edges, key, "left").join(longest_path(nodes, edges, key), key, "left")
    return out.fillna(0, ["n_edges", "longest_path"])


def cost_rows(nodes: DataFrame, key: str = "plan_id") -> DataFrame:
    """Mean of every cost over the nodes of a plan, whatever its name: ``plan_id, category, mean``. Unreadable numbers are left out."""
    long = nodes.select(key, F.explode("costs").alias("c")).select(
        key, F.col("c.name").alias("category"), with_unit(F.col("c.value")).alias("value")
    )
    return long.groupBy(key, "category").agg(F.avg("value").alias("mean"))


def plan_costs(nodes: DataFrame, names: list | None = None, key: str = "plan_id") -> DataFrame:
    """The same with a column per cost: the names that are there, or the listed ones."""
    rows = cost_rows(nodes, key)
    found = found_categories(rows, "category") if names is None else names
    return spread(rows, key, {n: "null" if n is None else n for n in found}, F.col("mean"), F.max, None)
