"""Synthetic operator sequences drawn from transition counts, and join paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlab.functions.scalars import draw, hash_rank
from planlab.operators import ordered
from planlab.operators.relational import stack
from planlab.session import stored

STEPS_PER_PLAN = 8  # steps joined before the walks are written
SPREAD = 1 << 12  # values a walk that has ended takes in place of a slot


def _cells(matrix: DataFrame, without: str | None = None) -> DataFrame:
    """A transition table laid out for one equality join per draw: ``from_state, slot, low, high, to_state, total, fan``.

    The successors of a state stand in order, each with the stretch of counts from ``low`` to ``high`` it is drawn by. A state with m
    successors has m even slots over its total; a successor has a row in every slot its stretch touches, some
    3 m rows in all, so a draw looks only at the successors of its slot, however many the state has. ``fan`` is
    m of the state. ``without`` leaves one state out and rescales, which is what drawing again until another
    state comes up amounts to.
    """
    rows = matrix.select("from_state", "to_state", "n")
    if without is not None:
        rows = rows.where(~F.col("to_state").eqNullSafe(F.lit(without)))
    of_state = W.partitionBy("from_state")  # a row for each other state at most
    upto = of_state.orderBy("to_state").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns(
        {"high": F.sum("n").over(upto), "total": F.sum("n").over(of_state), "fan": F.count(F.lit(1)).over(of_state)}
    ).withColumn("low", F.col("high") - F.col("n"))
    slot = lambda x: F.floor(F.col(x) * F.col("fan") / F.col("total"))
    touched = F.sequence(F.greatest(slot("low") - 1, F.lit(0)), F.least(slot("high") + 1, F.col("fan") - 1))
    return rows.select("from_state", "to_state", "low", "high", "total", "fan", F.explode(touched).alias("slot"))


def _fans(cells: DataFrame, name: str) -> DataFrame:
    return cells.select(F.col("from_state").alias("state"), F.col("fan").alias(name)).distinct()


def _drawn(walks: DataFrame, cells: DataFrame, fan: str, u: Column, active: Column, out: str) -> DataFrame:
    """``walks`` with the cell drawn by ``u`` among those of ``state``, as the struct ``out``, null where the walk is not active.

    A walk that waits meets no slot: it is dealt out by its id instead.
    """
    waits = -1 - F.pmod(F.xxhash64("walk_id"), F.lit(SPREAD))
    slot = F.when(active, F.least(F.floor(u * F.col(fan)), F.col(fan) - 1)).otherwise(waits)
    rows = walks.withColumns({"__slot": F.coalesce(slot, waits), "__u": u})
    led = [c for c in cells.columns if c.startswith("next_")]
    choice = cells.select(
        F.col("from_state").alias("__from"), F.col("slot").alias("__at"), F.col("low").alias("__low"), F.col("high").alias("__high"),
        F.col("total").alias("__total"), F.struct("to_state", *led).alias(out),
    )
    at = F.col("__u") * F.col("__total")
    on = (F.col("__slot") == F.col("__at")) & F.col("state").eqNullSafe(F.col("__from")) & (F.col("__low") <= at) & (F.col("__high") > at)
    return rows.join(choice, on, "left").drop("__slot", "__u", "__from", "__at", "__low", "__high", "__total")


def _stuck(state: Column) -> Column:
    return F.raise_error(F.concat(F.lit("no other state follows "), F.coalesce(state, F.lit("null")))).cast("string")


def drawn_depths(ids: DataFrame, quantiles: DataFrame, seed: int = 42) -> DataFrame:
    """A depth for each walk, drawn evenly from a table of path length quantiles (``place`` from 0, ``length``):
    ``walk_id, depth``."""
    grid = stored(quantiles.select("place", "length"))
    size = grid.count()
    u = draw(F.lit(seed), F.col("walk_id"), F.lit("depth"))
    rows = ids.select("walk_id").withColumn("place", F.floor(u * size))
    return rows.join(grid, "place").select("walk_id", F.col("length").cast("int").alias("depth"))


def following(ids: DataFrame, matrix: DataFrame, seed: int = 42) -> DataFrame:
    """One step for every walk (``walk_id, state``) whose state has successors: ``walk_id, state, following``."""
    cells = stored(_cells(matrix))
    rows = ordered.null_safe(ids.select("walk_id", "state"), _fans(cells, "fan"), ["state"], "inner")
    drawn = _drawn(rows, cells, "fan", draw(F.lit(seed), F.col("walk_id"), F.lit(1)), F.lit(True), "__to")
    return drawn.select("walk_id", "state", F.col("__to.to_state").alias("following"))


def walks(
    ids: DataFrame,
    forward: DataFrame,
    backward: DataFrame,
    start: str = "Data Source",
    end: str = "Data Sink",
    join: str = "Join",
    max_depth: int | DataFrame = 6,
    max_joins: int = 3,
    seed: int = 42,
) -> DataFrame:
    """One walk per row of ``ids`` (column ``walk_id``): ``walk_id, step, branch, state``.

    The main line is ``branch = 0``: from ``start``, up to ``max_depth`` draws, ``end`` closes it
    and is appended when it did not come up. At most ``max_joins`` joins; each join gets a branch
    that runs backwards (``branch`` 1, 2, ...) without joins, at most ``max_depth // 2`` long,
    and ends in ``start``. Draws depend only on seed, walk and place, so any task can redo them. ``max_depth`` is one
    number or a table of one for each walk (``walk_id, depth``). Each step is a join with the transition table, of any number of states.
    """
    if isinstance(max_depth, DataFrame):
        rows = stored(ids.select("walk_id").join(max_depth.select("walk_id", "depth"), "walk_id"))
        deepest = rows.agg(F.max("depth")).first()[0] or 0
    else:
        rows, deepest = ids.select("walk_id").withColumn("depth", F.lit(max_depth)), max_depth
    kinds = {"any": _cells(forward), "plain": _cells(forward, join), "back": _cells(backward, join)}
    cells = stored(stack([c.withColumn("kind", F.lit(k)) for k, c in kinds.items()]))
    fans = cells.select("kind", F.col("from_state").alias("state"), "fan").distinct()
    fans = fans.groupBy("state").agg(*[F.max(F.when(F.col("kind") == k, F.col("fan"))).alias(f"next_{k}") for k in kinds])
    led = ordered.null_safe(cells.withColumnRenamed("to_state", "state"), fans, ["state"], "left").withColumnRenamed("state", "to_state")
    led = stored(led)
    any_cells, plain_cells, back_cells = (led.where(F.col("kind") == k) for k in kinds)
    begin = {r["state"]: r for r in fans.where(F.col("state").isin(start, join)).collect()}  # two states
    fan = lambda state, k: F.lit(begin[state][f"next_{k}"] if state in begin else None).cast("bigint")
    main = rows.withColumns({
        "line": F.array(F.lit(start)), "joins": F.lit(0), "state": F.lit(start),
        "any": fan(start, "any"), "plain": fan(start, "plain"),
    })
    for i in range(1, deepest + 1):
        u = draw(F.lit(seed), F.col("walk_id"), F.lit(i))
        goes = ~F.col("state").eqNullSafe(F.lit(end)) & (F.lit(i) <= F.col("depth"))
        main = _drawn(main.withColumn("__goes", goes), any_cells, "any", u, F.col("__goes"), "__next")
        full = F.col("joins") >= max_joins if max_joins > -1 else F.lit(False)
        main = main.withColumn("__again", F.col("__goes") & full & F.col("__next.to_state").eqNullSafe(F.lit(join)))
        main = _drawn(main, plain_cells, "plain", u, F.col("__again"), "__other")
        chosen = F.when(F.col("__again"), F.col("__other")).otherwise(F.col("__next"))
        main = main.withColumn("__to", F.when(F.col("__goes"), chosen)).withColumn(
            "__state", F.when(F.col("__goes") & F.col("__to").isNull(), _stuck(F.col("state"))).otherwise(F.col("__to.to_state"))
        )
        main = main.select(
            "walk_id", "depth",
            F.when(F.col("__goes"), F.concat("line", F.array("__state"))).otherwise(F.col("line")).alias("line"),
            (F.col("joins") + (F.col("__goes") & F.col("__state").eqNullSafe(F.lit(join))).cast("int")).alias("joins"),
            F.when(F.col("__goes"), F.col("__state")).otherwise(F.col("state")).alias("state"),
            F.col("__to.next_any").alias("any"), F.col("__to.next_plain").alias("plain"),
        )
        if i % STEPS_PER_PLAN == 0:
            main = stored(main)
            if main.where(~F.col("state").eqNullSafe(F.lit(end)) & (F.col("depth") > i)).isEmpty():
                break
    closed = F.when(F.col("state").eqNullSafe(F.lit(end)), F.col("line")).otherwise(F.concat("line", F.array(F.lit(end))))
    main = stored(main.select("walk_id", "depth", F.posexplode(closed).alias("step", "state")))

    side = main.where(F.col("state") == join).select("walk_id", "step", "depth", F.lit(join).alias("state"))
    side = side.withColumns({"grown": F.array().cast("array<string>"), "back": fan(join, "back")})
    for i in range(1, deepest // 2 + 1):
        u = draw(F.lit(seed), F.col("walk_id"), F.col("step"), F.lit("b"), F.lit(i))
        goes = ~F.col("state").eqNullSafe(F.lit(start)) & (F.lit(i) <= F.floor(F.col("depth") / 2))
        side = _drawn(side.withColumn("__goes", goes), back_cells, "back", u, F.col("__goes"), "__to")
        state = F.when(F.col("__goes") & F.col("__to").isNull(), _stuck(F.col("state"))).otherwise(F.col("__to.to_state"))
        side = side.withColumn("__state", state).select(
            "walk_id", "step", "depth", F.when(F.col("__goes"), F.col("__state")).otherwise(F.col("state")).alias("state"),
            F.when(F.col("__goes"), F.concat("grown", F.array("__state"))).otherwise(F.col("grown")).alias("grown"),
            F.col("__to.next_back").alias("back"),
        )
        if i % STEPS_PER_PLAN == 0:
            side = stored(side)
            if side.where(~F.col("state").eqNullSafe(F.lit(start)) & (F.floor(F.col("depth") / 2) > i)).isEmpty():
                break
    ended = F.when(F.try_element_at("grown", F.lit(-1)) == start, F.col("grown")).otherwise(
        F.concat("grown", F.array(F.lit(start)))
    )
    side = side.select("walk_id", "step", F.posexplode(ended).alias("b", "state"))
    return main.select("walk_id", "step", F.lit(0).alias("branch"), "state").unionByName(
        side.select("walk_id", "step", (F.col("b") + 1).alias("branch"), "state")
    )


def walk_nodes_and_links(walk_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and link tables of walks: links run along the main line and down each branch."""
    node = F.concat_ws("_", "state", "step", "branch")
    rows = walk_rows.withColumn("id", node)
    nodes = rows.select("walk_id", "id", F.col("state").alias("pact"))
    ahead = rows.select(
        "walk_id",
        F.col("id").alias("target"),
        F.when(F.col("branch") == 0, F.col("step") - 1).otherwise(F.col("step")).alias("step"),
        F.when(F.col("branch") == 0, 0).otherwise(F.col("branch") - 1).alias("branch"),
        (F.col("branch") > 0).alias("backwards"),
    )
    links = ahead.join(rows.select("walk_id", "step", "branch", F.col("id").alias("source")), ["walk_id", "step", "branch"])
    flip = F.col("backwards")
    return nodes, links.select(
        "walk_id",
        F.when(flip, F.col("target")).otherwise(F.col("source")).alias("source"),
        F.when(flip, F.col("source")).otherwise(F.col("target")).alias("target"),
    )


def node_link_documents(walk_rows: DataFrame) -> DataFrame:
    """One document per walk with ``nodes`` and ``links`` (a walk is bounded by its depth)."""
    nodes, links = walk_nodes_and_links(walk_rows)
    n = nodes.groupBy("walk_id").agg(F.array_sort(F.collect_list(F.struct("id", "pact"))).alias("nodes"))
    e = links.groupBy("walk_id").agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("links"))
    return n.join(e, "walk_id", "left")


def join_paths(edges: DataFrame, hops: int) -> DataFrame:
    """Paths of ``hops`` relations over a relation table, no relation used twice.

    ``edges``: ``relation, lhs, rhs`` plus any measures, both directions present. The result has
    the start table, the tables in order and the relations in order.
    """
    step = edges.select("relation", F.col("lhs").alias("__at"), F.col("rhs").alias("__to"))
    paths = edges.select(
        F.col("lhs").alias("start"),
        F.array("lhs", "rhs").alias("tables"),
        F.array("relation").alias("relations"),
        F.col("rhs").alias("__at"),
    )
    for _ in range(hops - 1):
        paths = (
            paths.join(step, "__at")
            .where(~F.array_contains("relations", F.col("relation")))
            .select(
                "start",
                F.concat("tables", F.array("__to")).alias("tables"),
                F.concat("relations", F.array("relation")).alias("relations"),
                F.col("__to").alias("__at"),
            )
        )
    return paths.drop("__at")


def pick_path(paths: DataFrame, seed: int) -> DataFrame:
    """One path per start table, chosen by a seeded hash."""
    text = F.array_join("relations", ">")
    return paths.groupBy("start").agg(
        F.min_by(F.struct("tables", "relations"), F.struct(hash_rank(F.lit(seed), text), text)).alias("p")
    ).select("start", "p.tables", "p.relations")
