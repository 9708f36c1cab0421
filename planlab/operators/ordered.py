"""Ordered computations over groups of any size.

A window function hands a whole group to one task. That is right for many small groups and wrong for a group
that holds a large share of the table, or for no key at all. The functions here work on a rank index instead: rows
are exchanged by ranges of (group, order) and keep the number of their range, windows run per group and range, and what
crosses a border (counts, sums, minima, the next row) travels in a side table.

A range lies between two points of one total order, so it can hold many groups but shares at most its first and
its last one with other ranges. Only those groups have rows in the side table: at most two per range, which is
what makes it safe to broadcast. No group is told apart by its size, and any type that sorts can be an order. The
exchange is written once, since a task that is run again has to see the same ranges.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlab.session import parts_of, stored

MICRO = 1_000_000


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on all ``keys``, nulls equal, keeping the left side's key columns.

    Without keys the right side is one row; its columns join as constants.
    """
    if not keys:
        row = right.first()
        value = {c: F.lit(None if row is None else row[c]) for c in right.columns}
        return left.withColumns({c: v.cast(right.schema[c].dataType) for c, v in value.items()})
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"__{k}"])
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def hot_join(fact: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", parts: int | None = None) -> DataFrame:
    """Join many rows per key with one row per key, whatever share of the rows a key holds.

    ``side`` has at most one row per key, so a hot key is hot in ``fact`` only, and adaptive
    execution splits the fact side's large partitions of a shuffle join. Nothing runs while the plan is built.
    """
    return fact.join(side, keys, how)


@dataclass
class RankIndex:
    """Rows with the number of the range of (keys, order) they lie in, in the column ``__range``."""

    df: DataFrame
    keys: list[str]
    order: list[str]

    @property
    def by(self) -> list[str]:
        return [*self.keys, "__range"]

    def local(self):
        return W.partitionBy(*self.by).orderBy(*self.order)

    def border(self, *aggs: Column) -> DataFrame:
        """One row per range of each group that lies in several ranges: at most two per range."""
        cells = self.df.groupBy(*self.by).agg(*aggs)
        ranges = F.count(F.lit(1)).over(W.partitionBy(*self.keys))
        return cells.withColumn("__ranges", ranges).where("__ranges > 1").drop("__ranges")

    def border_window(self):
        """The ranges of one group in order."""
        return W.partitionBy(*self.keys).orderBy("__range")

    def attach(self, side: DataFrame) -> DataFrame:
        """Carry border values to the rows; null for groups inside one range."""
        return null_safe(self.df, F.broadcast(side), self.by, "left")


def ranked(df: DataFrame, keys, order, parts: int | None = None) -> RankIndex:
    """Exchange rows by ranges of the keys and the order, both ascending with nulls first."""
    keys, order = list(keys), list(order)
    by = [F.col(c).asc_nulls_first() for c in dict.fromkeys([*keys, *order])]
    rows = df.repartitionByRange(parts or parts_of(df.sparkSession), *by)
    return RankIndex(stored(rows.withColumn("__range", F.spark_partition_id())), keys, order)


def row_numbers(df: DataFrame, keys, order, out: str = "rn", parts: int | None = None) -> DataFrame:
    """1-based position of each row in its group along ``order`` (which must be total)."""
    index = ranked(df, keys, order, parts)
    before = F.sum("__c").over(index.border_window().rowsBetween(W.unboundedPreceding, -1))
    side = index.border(F.count(F.lit(1)).alias("__c")).select(*index.by, before.alias("__before"))
    place = F.row_number().over(index.local()).cast("bigint") + F.coalesce("__before", F.lit(0))
    return index.attach(side).withColumn(out, place).drop("__before", "__range")


def running(
    df: DataFrame,
    keys,
    order,
    columns: dict[str, tuple[str, str]],
    parts: int | None = None,
    include_row: bool = True,
) -> DataFrame:
    """Running aggregates up to each row: ``{out: ("sum" | "min" | "max" | "product", column)}``.

    ``order`` must be total within a group, so that rows and peers agree.
    """
    index = ranked(df, keys, order, parts)
    fold = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product}
    upto = index.local().rowsBetween(W.unboundedPreceding, 0 if include_row else -1)
    previous = index.border_window().rowsBetween(W.unboundedPreceding, -1)
    side = index.border(*[fold[how](c).alias(f"__b_{out}") for out, (how, c) in columns.items()])
    side = side.select(
        *index.by,
        *[fold[how](f"__b_{out}").over(previous).alias(f"__p_{out}") for out, (how, _) in columns.items()],
    )
    here = {out: fold[how](c).over(upto) for out, (how, c) in columns.items()}
    merged = {}
    for out, (how, _) in columns.items():
        carry, now = F.col(f"__p_{out}"), F.col(out)
        if how == "sum":
            merged[out] = F.coalesce(now + carry, now, carry)
        elif how == "product":
            merged[out] = F.coalesce(now * carry, now, carry)
        else:
            merged[out] = (F.least if how == "min" else F.greatest)(now, carry)
    rows = index.attach(side).withColumns(here).withColumns(merged)
    return rows.drop("__range", *[f"__p_{out}" for out in columns])


def neighbours(
    df: DataFrame,
    keys,
    order,
    following: dict[str, str] | None = None,
    preceding: dict[str, str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Value of a column in the next and in the previous row of the group, null at the ends."""
    following, preceding = following or {}, preceding or {}
    index = ranked(df, keys, order, parts)
    position = F.struct(*index.order)
    first = F.min_by(F.struct(*following.values()), position) if following else F.lit(None)
    last = F.max_by(F.struct(*preceding.values()), position) if preceding else F.lit(None)
    across = index.border_window()
    side = index.border(first.alias("__first"), last.alias("__last")).select(
        *index.by, F.lead("__first").over(across).alias("__next"), F.lag("__last").over(across).alias("__prev")
    )
    ends = F.lead(F.lit(1)).over(index.local()).isNull()
    starts = F.lag(F.lit(1)).over(index.local()).isNull()
    new = {}
    for out, column in following.items():
        new[out] = F.when(ends, F.col("__next")[column]).otherwise(F.lead(column).over(index.local()))
    for out, column in preceding.items():
        new[out] = F.when(starts, F.col("__prev")[column]).otherwise(F.lag(column).over(index.local()))
    return index.attach(side).withColumns(new).drop("__next", "__prev", "__range")


def value_index(df: DataFrame, keys, value: str, parts: int | None = None) -> RankIndex:
    """Rank index of the distinct non-null values of each group: ``__v`` with its rows ``__c``."""
    runs = df.select(*keys, F.col(value).alias("__v")).where(F.col("__v").isNotNull())
    return ranked(runs.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c")), keys, ["__v"], parts)


def placed(index: RankIndex, wanted=None) -> DataFrame:
    """Values of a ``value_index`` with the group's rows below them, ``__low``, and in all, ``__n``.

    ``wanted`` is a test on (rows below, rows, rows of the group). Where it is given, ranges of it fail whole for a group that
    lies in several ranges, so only values of the ranges that may hold an answer are ordered.
    """
    previous = index.border_window().rowsBetween(W.unboundedPreceding, -1)
    side = index.border(F.sum("__c").alias("__rows")).select(
        *index.by,
        "__rows",
        F.coalesce(F.sum("__rows").over(previous), F.lit(0)).alias("__before"),
        F.sum("__rows").over(W.partitionBy(*index.keys)).alias("__all"),
    )
    if wanted is not None:
        side = side.withColumn("__near", wanted(F.col("__before"), F.col("__rows"), F.col("__all")))
    rows = index.attach(side)
    if wanted is not None:
        rows = rows.where(F.coalesce("__near", F.lit(True))).drop("__near")
    within = W.partitionBy(*index.by)
    upto = within.orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    return rows.select(
        *index.keys,
        "__v",
        "__c",
        (F.coalesce("__before", F.lit(0)) + F.sum("__c").over(upto) - F.col("__c")).alias("__low"),
        F.coalesce("__all", F.sum("__c").over(within)).alias("__n"),
    )


def quantiles(
    df: DataFrame,
    keys,
    value: str,
    probabilities: list[float],
    method: str = "linear",
    parts: int | None = None,
) -> DataFrame:
    """Exact quantiles per group, one row per (group, probability): ``q``, ``n`` and ``v``.

    ``method`` is ``linear`` (between the neighbours), ``lower`` or ``higher``. Position is
    ``q * (n - 1)`` in sorted order, nulls ignored.
    """
    keys = list(keys)
    wanted = F.array(*[F.lit(float(q)) for q in probabilities])
    stride = gcd(*[round(q * MICRO) for q in probabilities]) / MICRO or 1.0

    def touches(q, low: Column, count: Column, n: Column) -> Column:
        """Does the lower or upper position of ``q`` lie in [low, low + count)?"""
        place = q * (n - 1)
        down, up = F.floor(place), F.ceil(place)
        return ((down >= low) & (down < low + count)) | ((up >= low) & (up < low + count))

    def may_touch(low: Column, count: Column, n: Column) -> Column:
        """Cheap test every touched row passes: a multiple of the probabilities' common stride
        lies in the row's stretch. It keeps the exact test to a few rows per probability."""
        last = F.greatest(n - 1, F.lit(1))
        first_multiple = F.ceil(((low - 1) / last - 2 / MICRO) / stride)
        return first_multiple <= F.floor(((low + count) / last + 2 / MICRO) / stride)

    index = value_index(df, keys, value, parts)
    runs = placed(index, lambda *span: F.exists(wanted, lambda q: touches(q, *span)))
    span = F.col("__low"), F.col("__c"), F.col("__n")
    exact = F.filter(wanted, lambda q: touches(q, *span))
    hits = runs.where(may_touch(*span)).select("*", F.explode(exact).alias("q"))
    picked = hits.groupBy(*keys, "q").agg(*ends_at(F.col("q") * (F.col("__n") - 1)), F.max("__n").alias("n"))
    return picked.select(
        *keys, "q", F.col("n").cast("bigint").alias("n"), between(F.col("q") * (F.col("n") - 1), method).alias("v")
    )


def ends_at(place: Column) -> list[Column]:
    """Aggregates ``__lo`` and ``__hi``: the values at the whole positions around ``place``."""

    def at(position):
        inside = (position >= F.col("__low")) & (position < F.col("__low") + F.col("__c"))
        return F.max(F.when(inside, F.col("__v")))

    return [at(F.floor(place)).alias("__lo"), at(F.ceil(place)).alias("__hi")]


def between(place: Column, method: str = "linear") -> Column:
    """The value at ``place`` from the two that ``ends_at`` found."""
    if method == "linear":
        return F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (place - F.floor(place))
    return F.col("__lo") if method == "lower" else F.col("__hi")


def quantile_scalar(df: DataFrame, value: str, q: float, parts: int | None = None) -> Column:
    """One quantile of a whole column as a scalar subquery, for use in a filter."""
    return quantiles(df, [], value, [q], "linear", parts).select("v").scalar()
