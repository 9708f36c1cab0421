"""Filters, joins and keep-one reducers the job templates are made of."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlab.catalog import Predicate
from planlab.operators import ordered
from planlab.session import broadcast_if_small, parts_of

REPEAT = 100_000  # least copies in a piece of a repeated row
SHARES = 1000  # pieces that make up the share of a task
BLOCK = 1000  # copies written at a time
WEIGHT = "__weight"  # column with the number of rows a row stands for

COMPARE = {
    "<=": lambda c, v: c <= v,
    "<": lambda c, v: c < v,
    ">": lambda c, v: c > v,
    "==": lambda c, v: c == v,
    "contains": lambda c, v: c.contains(v),
    "not like": lambda c, v: ~c.like(v),
    "not matches": lambda c, v: ~c.rlike(v),
    "matches": lambda c, v: c.rlike(v),
}


def condition(column: str, op: str, literal) -> Column:
    """Template comparison. A date is compared as a date, text as text; "like" takes a pattern of SQL, "matches" a regular expression."""
    return COMPARE[op](F.col(column), F.lit(literal) if isinstance(literal, date) else literal)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def apply_predicate(df: DataFrame, p: Predicate) -> DataFrame:
    return df.where(condition(p.column, p.op, p.literal))


def predicate_catalogue(df: DataFrame, predicates: list[Predicate]) -> DataFrame:
    """Expected and measured selectivity of every predicate, all in one scan of ``df``."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(condition(p.column, p.op, p.literal)).alias(f"c{i}") for i, p in enumerate(predicates)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(p.table).alias("table_name"),
                F.lit(p.name).alias("predicate"),
                F.lit(p.selectivity).alias("expected"),
                F.col(f"c{i}").alias("rows_out"),
            )
            for i, p in enumerate(predicates)
        ]
    )
    return counts.select("total", F.explode(rows).alias("p")).select(
        "p.table_name",
        "p.predicate",
        "p.expected",
        F.col("p.rows_out").cast("bigint").alias("rows_out"),
        (F.col("p.rows_out") / F.col("total")).alias("actual"),
        "total",
    )


def matched_right(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Right rows that have a matching left row, with the number of matches in ``WEIGHT``.

    The equi join of ``join_keep_right`` before its rows are repeated. Only the number of matches matters, so the left
    side is counted per key first and a hot key never meets itself row by row. Either side may carry weights itself;
    chains of joins stay as short as their tables however many rows they stand for.
    """
    matches = left.where(F.col(left_key).isNotNull()).groupBy(F.col(left_key).alias("__key")).agg(
        F.sum(weight_of(left)).alias("__n")
    )
    joined = right.join(matches, F.col(right_key) == F.col("__key"))
    weight = (weight_of(right) * F.col("__n")).alias(WEIGHT)
    return joined.select(*[c for c in right.columns if c != WEIGHT], weight)


def weight_of(df: DataFrame) -> Column:
    """How many rows each row stands for."""
    return F.col(WEIGHT) if WEIGHT in df.columns else F.lit(1).cast("bigint")


def repeated(df: DataFrame, parts: int | None = None, total: Column | None = None) -> DataFrame:
    """Each row as often as its ``WEIGHT`` says; rows without the column as they are.

    A row is cut into pieces of at most REPEAT copies (more, if it has more than REPEAT pieces), and pieces are dealt
    out in turn, whatever key they have: many heavy rows of one key, or one row with most of the copies, are shared by all
    tasks. What is dealt are rows and pieces, not the copies. With the ``total`` of the copies a piece may also be one of
    SHARES in what a task gets, so rows beside many others stay whole and a task meets few of them. Copies are written by blocks.
    """
    if WEIGHT not in df.columns:
        return df
    parts = parts or parts_of(df.sparkSession)
    sizes = [F.lit(REPEAT), F.ceil(F.sqrt(WEIGHT))]
    if total is not None:
        sizes.append(F.least(F.lit(REPEAT * BLOCK), F.ceil(total / (parts * SHARES))))
    cut = df.withColumn("__size", F.greatest(*sizes).cast("bigint")).withColumn(
        "__piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(WEIGHT) - 1) / F.col("__size"))))
    )
    dealt = cut.where(F.col(WEIGHT) > 0).repartition(parts)
    copies = F.least(F.col("__size"), F.col(WEIGHT) - F.col("__piece") * F.col("__size"))
    dealt = dealt.withColumn("__left", F.explode(F.sequence(copies, F.lit(1).cast("bigint"), F.lit(-BLOCK).cast("bigint"))))
    block = F.when(F.col("__left") < BLOCK, F.array_repeat(F.lit(0), F.col("__left").cast("int")))
    dealt = dealt.withColumn("__copy", F.explode(block.otherwise(F.array_repeat(F.lit(0), BLOCK))))
    return dealt.drop(WEIGHT, "__size", "__piece", "__left", "__copy")


def join_keep_right(left: DataFrame, right: DataFrame, left_key: str, right_key: str, hot: bool = False) -> DataFrame:
    """Equi join that emits the right row once per matching left row.

    With ``hot`` keys, where most rows stand for many, the total of the copies is worked out before rows are cut.
    """
    matched = matched_right(left, right, left_key, right_key)
    return repeated(matched, total=matched.agg(F.sum(F.col(WEIGHT).cast("double"))).scalar() if hot else None)


def join_tiny(left: DataFrame, tiny: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join with a side said to be tiny: broadcast when its estimated size proves it."""
    return left.join(broadcast_if_small(tiny), on, how)


def join_huge(left: DataFrame, huge: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join with a side said to be huge: the left side is the one to broadcast, size checked."""
    return broadcast_if_small(left).join(huge, on, how)


def member_filter(df: DataFrame, ids: DataFrame, on: Column) -> DataFrame:
    """Rows whose key is in a set."""
    return df.join(broadcast_if_small(ids), on, "left_semi")


def lookup_filter(df: DataFrame, lookup: DataFrame, key: str, keep: Column) -> DataFrame:
    """Rows that satisfy a comparison with the value looked up for their key.

    A key has one value; a lookup that holds a key twice is refused, as the rows of that key would come out twice.
    """
    values = [c for c in lookup.columns if c != key]
    twice = F.raise_error(F.concat(F.lit("lookup holds a key twice: "), F.col(key).cast("string")))
    once = lookup.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in values]
    )
    once = once.select(
        key, *[F.when(F.col("__n") > 1, twice.cast(lookup.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in values]
    )
    return ordered.hot_join(df, once, [key]).where(keep).select(*df.columns)


def with_other(df: DataFrame, key: str, value: str, flag: Column | None = None, how: str = "inner") -> DataFrame:
    """Rows beside the least and greatest ``value`` among the (flagged) rows of their key.

    That is enough for EXISTS tests with ``value <> value``, without pairing rows of a key.
    """
    cell = F.col(value) if flag is None else F.when(flag, F.col(value))
    side = df.groupBy(key).agg(F.min(cell).alias("__lo"), F.max(cell).alias("__hi"))
    return ordered.hot_join(df, side, [key], how)


def exists_other(df: DataFrame, key: str, value: str, flag: Column | None = None) -> DataFrame:
    """Rows whose key also occurs with a different ``value`` (in a flagged row)."""
    differs = (F.col("__lo") != F.col(value)) | (F.col("__hi") != F.col(value))
    return with_other(df, key, value, flag).where(differs).select(*df.columns)


def not_exists_other(df: DataFrame, key: str, value: str, flag: Column | None = None) -> DataFrame:
    """Rows whose key occurs with no different ``value`` (in a flagged row).

    A null key or value differs from nothing, so such rows stay, as with NOT EXISTS.
    """
    alone = F.col("__lo").isNull() | F.col(value).isNull() | ((F.col("__lo") == F.col(value)) & (F.col("__hi") == F.col(value)))
    return with_other(df, key, value, flag, "left").where(alone).select(*df.columns)


def not_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_anti")


def distinct_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_common(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column the two frames share."""
    return a.join(b, [c for c in a.columns if c in b.columns], how)


def keep_one(df: DataFrame, by: list[str | Column] | None = None, pick: str = "first") -> DataFrame:
    """One row per key (or of the whole table): the least or greatest by all columns."""
    fold = F.min if pick == "first" else F.max
    row = fold(F.struct(*df.columns)).alias("__row")
    keys = [(F.col(k) if isinstance(k, str) else k).alias(f"__key{i}") for i, k in enumerate(by or [])]
    return df.groupBy(*keys).agg(row).where(F.col("__row").isNotNull()).select("__row.*")


def map_rows(df: DataFrame, tier: int = 0) -> DataFrame:
    """The template's map returns its row; the cost tier is only recorded with the job."""
    return df.select("*")


def hash_partition(df: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    return df.repartition(column) if partitions is None else df.repartition(partitions, column)


def range_partition(df: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    if partitions is None:
        return df.repartitionByRange(column)
    return df.repartitionByRange(partitions, column)


def sort_partitions(df: DataFrame, column: str) -> DataFrame:
    return df.sortWithinPartitions(column)
