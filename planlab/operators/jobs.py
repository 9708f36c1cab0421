"""Templated jobs: an abstract operator sequence put on tables becomes one DataFrame.

A job is data: a list of steps with their table, predicate, key or cost tier filled in from the
catalogue. ``run`` composes the operators of ``relational`` by name and leaves planning to Spark.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlab import catalog
from planlab.operators import relational as R
from planlab.operators import walks
from planlab.operators.relational import stack


@dataclass
class Step:
    number: int
    pact: str
    table: str
    predicate: catalog.Predicate | None = None
    key: str | None = None
    keep: str | None = None
    tier: int | None = None
    relation: catalog.Relation | None = None
    branch: list[Step] = field(default_factory=list)
    merged: bool = False  # the second of two equal keyed steps, taken over by the first


@dataclass
class Job:
    job_id: str
    steps: list[Step]

    @property
    def table(self) -> str:
        """Table whose rows come out."""
        return self.steps[-1].table


# An abstract plan: operator names; a join carries its branch from the source down.
Plan = list


def plan_of(rows: list) -> Plan:
    """Abstract plan of one walk's ``step, branch, state`` rows."""
    main = sorted((r["step"], r["state"]) for r in rows if r["branch"] == 0)
    out: Plan = []
    for step, state in main:
        side = sorted(((r["branch"], r["state"]) for r in rows if r["step"] == step and r["branch"] > 0), reverse=True)
        out.append((state, [s for _, s in side]) if side else state)
    return out


def relation_table(spark: SparkSession) -> DataFrame:
    """Catalogued relations in both directions."""
    rows = [(r.name, r.left, r.right) for r in catalog.RELATIONS]
    rows += [(r.name, r.right, r.left) for r in catalog.RELATIONS]
    return spark.createDataFrame(rows, "relation string, lhs string, rhs string")


def table_paths(spark: SparkSession, max_joins: int) -> dict[int, list[list[str]]]:
    """All table sequences along the relations per number of joins (the catalogue bounds them)."""
    out = {0: [[t] for t in catalog.TABLES]}
    edges = relation_table(spark)
    for hops in range(1, max_joins + 1):
        rows = walks.join_paths(edges, hops).select("tables").collect()
        out[hops] = sorted(list(r["tables"]) for r in rows)
    return out


def make_job(job_id: str, plan: Plan, paths: dict[int, list[list[str]]], seed: int) -> Job:
    """Put an abstract plan on tables: start table and parameters follow from the seed."""
    rng = random.Random(seed)
    joins = sum(isinstance(p, tuple) for p in plan)
    order = [paths[joins][i] for i in range(len(paths[joins]))]
    tables: list[str] = []
    for attempt in range(len(catalog.TABLES)):  # next start table when one has no such path
        start = catalog.pick(catalog.TABLES, seed + attempt)
        mine = [p for p in order if p[0] == start]
        if mine:
            tables = catalog.pick(mine, seed)
            break
    if not tables:
        raise ValueError(f"no path with {joins} joins")
    queue, counter = list(tables), {"map": 0, "n": 0}

    def fill(names: Plan, table: str) -> tuple[list[Step], str]:
        steps: list[Step] = []
        for name in names:
            pact, side = name if isinstance(name, tuple) else (name, None)
            step = Step(counter["n"], pact, table)
            counter["n"] += 1
            if pact == "Filter":
                step.predicate = catalog.pick(catalog.predicates_of(table), rng.randrange(1 << 30))
            elif pact == "Map":
                step.tier = counter["map"] % 3
                counter["map"] += 1
            elif pact in ("Group by", "Reduce"):
                before = steps[-1] if steps else None
                if before is not None and before.pact == pact and not before.merged:
                    step.merged = True
                    before.key = before.key or catalog.pick(catalog.GROUP_KEYS[table], rng.randrange(1 << 30))
                    before.keep = "last" if pact == "Group by" else "first"
                elif pact == "Group by":
                    step.key = catalog.pick(catalog.GROUP_KEYS[table], rng.randrange(1 << 30))
                    step.keep = "first"
                else:
                    step.keep = "first"
            elif pact == "Join":
                right = queue.pop(0)
                step.relation = catalog.relation_between(table, right)
                step.branch, _ = fill(side, right)
                table = right
                step.table = right
            steps.append(step)
        return steps, table

    first = queue.pop(0)
    steps, _ = fill(plan, first)
    return Job(job_id, steps)


def weighted(job: Job, source: Callable[[str], DataFrame]) -> DataFrame:
    """The job's result as one lazy DataFrame whose rows carry how often they stand in the result (``R.WEIGHT``).

    A join gives each row a weight instead of copies, so a job's plan holds no row twice, however many joins it has.
    """

    def follow(steps: list[Step]) -> DataFrame:
        df = None
        for step in steps:
            if step.merged:
                continue
            if step.pact == "Data Source":
                df = source(step.table)
            elif step.pact == "Filter":
                df = R.apply_predicate(df, step.predicate)
            elif step.pact == "Map":
                df = R.map_rows(df, step.tier)
            elif step.pact in ("Group by", "Reduce"):
                df = R.keep_one(df.drop(R.WEIGHT), [step.key] if step.key else None, step.keep)
            elif step.pact == "Join":
                df = R.matched_right(df, follow(step.branch), step.relation.left_key, step.relation.right_key)
            elif step.pact == "Partition":
                df = R.hash_partition(df, catalog.FIRST_COLUMN[step.table])
            elif step.pact == "Sort-Partition":
                df = R.sort_partitions(df, catalog.FIRST_COLUMN[step.table])
            elif step.pact != "Data Sink":
                raise KeyError(step.pact)
        return df

    return follow(job.steps)


def run(job: Job, source: Callable[[str], DataFrame]) -> DataFrame:
    """The job's result rows."""
    return R.repeated(weighted(job, source))


def results(jobs: list[Job], source: Callable[[str], DataFrame]) -> DataFrame:
    """Rows out and sum of the first column per job, from weights."""

    def result(job: Job) -> DataFrame:
        rows = weighted(job, source)
        weight = R.weight_of(rows)
        return rows.agg(
            F.lit(job.job_id).alias("job_id"),
            F.lit(job.table).alias("table_name"),
            F.coalesce(F.sum(weight), F.lit(0)).alias("rows_out"),
            F.coalesce(F.sum(F.col(catalog.FIRST_COLUMN[job.table]).cast("bigint") * weight), F.lit(0)).alias("key_sum"),
        )

    return stack([result(job) for job in jobs])


def operator_log(spark: SparkSession, jobs: list[Job], groups: dict[tuple[str, str], int]) -> DataFrame:
    """Recorded operators of the jobs, the input of cardinality propagation.

    ``groups`` gives the number of groups per ``(table, key)``. A branch is logged before its
    join; a merged step is not logged.
    """
    rows = []
    for job in jobs:
        place = 0

        def record(steps):
            nonlocal place
            for s in steps:
                if s.merged:
                    continue
                record(s.branch)
                tables = [s.relation.left, s.relation.right] if s.relation else [s.table]
                selectivity = {"Data Source": 1.0, "Map": 1.0}.get(s.pact)
                if s.predicate:
                    selectivity = s.predicate.selectivity
                out = groups.get((s.table, s.key)) if s.pact == "Group by" else 1 if s.pact == "Reduce" else None
                name = f"{s.pact.lower().replace(' ', '_').replace('-', '_')}{s.number}"
                rows.append((job.job_id, place, s.number, name, s.pact, tables[0], tables, selectivity, out, s.tier))
                place += 1

        record(job.steps)
    schema = (
        "plan_id string, pos long, id int, var_name string, pact string, table_name string, tables array<string>, "
        "selectivity double, out_cardinality long, complexity int"
    )
    return spark.createDataFrame(rows, schema)
