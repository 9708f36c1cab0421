"""Metadata of the base tables: join relations, filter literals, group keys.

Literals and selectivities are the published catalogue values for the columns the tables have
(fixed values); ``profile.literal_catalogue`` derives the same kind of rows from the FILTER_FIELDS of given tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Predicate:
    table: str
    column: str
    op: str
    literal: float | str | date
    selectivity: float

    @property
    def name(self) -> str:
        return f"{self.column} {self.op} {self.literal}"


@dataclass(frozen=True)
class Relation:
    """Symmetric equality between two tables."""

    left: str
    left_key: str
    right: str
    right_key: str

    @property
    def name(self) -> str:
        return "-".join(sorted((self.left, self.right)))


def _range(table: str, column: str, literals, op: str = "<=") -> list[Predicate]:
    return [Predicate(table, column, op, v, s) for v, s in zip(literals, (0.25, 0.5, 0.75))]


def _days(*days: str) -> list[date]:
    return [date.fromisoformat(d) for d in days]


# Literal and expected selectivity per filter field.
PREDICATES = [
    *_range("lineitem", "l_quantity", (13.0, 26.0, 38.0)),
    *_range("lineitem", "l_shipdate", _days("1993-10-26", "1995-06-19", "1997-02-09")),
    Predicate("orders", "o_orderstatus", "==", "F", 0.48627533333333334),
    Predicate("orders", "o_orderstatus", "==", "O", 0.4880293333333333),
    Predicate("orders", "o_orderstatus", "==", "P", 0.025695333333333334),
    *_range("orders", "o_totalprice", (77894.7475, 144409.03999999998, 215500.225)),
    *_range("orders", "o_orderdate", _days("1993-08-27", "1995-04-20", "1996-12-10")),
    *_range("customer", "c_acctbal", (1757.6200000000001, 4477.3, 7246.3150000000005)),
    Predicate("customer", "c_mktsegment", "==", "AUTOMOBILE", 0.19834666666666667),
    Predicate("customer", "c_mktsegment", "==", "BUILDING", 0.20094666666666666),
    Predicate("customer", "c_mktsegment", "==", "FURNITURE", 0.19978666666666667),
    Predicate("customer", "c_mktsegment", "==", "HOUSEHOLD", 0.20126),
    Predicate("customer", "c_mktsegment", "==", "MACHINERY", 0.19966),
    *_range("part", "p_retailprice", (1249.2475, 1499.495, 1749.7425)),
    *_range("supplier", "s_acctbal", (1770.7175, 4541.0650000000005, 7270.635)),
    *_range("supplier", "s_nationkey", (6.0, 12.0, 18.0), "=="),
    *_range("nation", "n_regionkey", (1.0, 2.0, 3.0), "=="),
]

# Which tables join on which key.
RELATIONS = [
    Relation("lineitem", "l_orderkey", "orders", "o_orderkey"),
    Relation("lineitem", "l_partkey", "part", "p_partkey"),
    Relation("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    Relation("orders", "o_custkey", "customer", "c_custkey"),
    Relation("customer", "c_nationkey", "nation", "n_nationkey"),
    Relation("supplier", "s_nationkey", "nation", "n_nationkey"),
]

# Fields a job may filter.
FILTER_FIELDS = {
    "lineitem": ["l_quantity", "l_shipdate"],
    "orders": ["o_orderstatus", "o_totalprice", "o_orderdate"],
    "customer": ["c_acctbal", "c_mktsegment"],
    "part": ["p_retailprice"],
    "supplier": ["s_acctbal", "s_nationkey"],
    "nation": ["n_regionkey"],
}

TABLES = ["lineitem", "orders", "customer", "part", "supplier", "nation"]

# Fields a job may group by.
GROUP_KEYS = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus"],
    "customer": ["c_mktsegment"],
    "part": ["p_brand", "p_type"],
    "supplier": ["s_nationkey"],
    "nation": ["n_regionkey"],
}

FIRST_COLUMN = {
    "lineitem": "l_orderkey",
    "orders": "o_orderkey",
    "customer": "c_custkey",
    "part": "p_partkey",
    "supplier": "s_suppkey",
    "nation": "n_nationkey",
}


def pick(values, seed: int):
    """Cyclic choice from a list."""
    return values[seed % len(values)]


def relation_between(left: str, right: str) -> Relation:
    """The catalogued relation of two tables, oriented left to right."""
    for r in RELATIONS:
        if (r.left, r.right) == (left, right):
            return r
        if (r.right, r.left) == (left, right):
            return Relation(left, r.right_key, right, r.left_key)
    raise KeyError(f"no relation between {left} and {right}")


def predicates_of(table: str) -> list[Predicate]:
    return [p for p in PREDICATES if p.table == table]
