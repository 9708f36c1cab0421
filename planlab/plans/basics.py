"""Registered queries: filters, joins, reducers, profiling."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlab import catalog
from planlab.functions import scalars as X
from planlab.operators import profile
from planlab.operators import relational as R
from planlab.sources.tables import Tables, micros

ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def q(build):
    return lambda spark, directory: build(Tables(spark, directory))


# ---- filters and projections ---------------------------------------------------------------


def filter_contains(t: Tables) -> DataFrame:
    return t.part.where(R.condition("p_name", "contains", "re")).select("p_partkey", "p_name")


def filter_lookup(t: Tables) -> DataFrame:
    """Lines below a fifth of their part's average quantity, through a lookup table."""
    below = t.lineitem.groupBy("l_partkey").agg((0.2 * F.avg("l_quantity")).alias("v"))
    rows = R.lookup_filter(t.lineitem, below, "l_partkey", F.col("l_quantity") < F.col("v"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def filter_member(t: Tables) -> DataFrame:
    big = t.lineitem.where("l_quantity >= 50").select("l_orderkey").distinct()
    return R.member_filter(t.orders, big, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", "o_custkey", "o_orderstatus"
    )


def computed_columns(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.round(price, 4).alias("disc_price"),
        F.round(price * (1 + F.col("l_tax")), 6).alias("charge"),
        F.lit(1).alias("one"),
    )


def text_functions(t: Tables) -> DataFrame:
    """Split, trim, join and replace of text; regex extract with a default; modulo pick."""
    words = F.split("p_name", " ")
    place = F.concat(F.lit("Scan (at Job.run(Job.scala:"), F.col("p_size").cast("string"), F.lit(") (x))"))
    return t.part.select(
        "p_partkey",
        F.array_join(F.transform(words, lambda w: F.trim(w)), ", ").alias("joined"),
        F.regexp_replace("p_brand", "Brand#", "").cast("int").alias("brand_no"),
        F.element_at(F.split("p_brand", "#"), -1).alias("last_part"),
        X.code_line(F.when(F.col("p_size") % 2 == 0, place).otherwise(F.lit("no place"))).alias("line"),
        X.pick_from(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("p_partkey")).alias("picked"),
    )


def unit_numbers(t: Tables) -> DataFrame:
    """Prices written with M, G, K and plain, read back as numbers."""
    unit = F.get(F.array(F.lit(" M"), F.lit(" G"), F.lit(" K"), F.lit("")), F.pmod("o_orderkey", F.lit(4)).cast("int"))
    text = F.concat(F.format_string("%.2f", "o_totalprice"), unit)
    return t.orders.select("o_orderkey", F.round(X.with_unit(text), 3).alias("number"))


def log_labels(t: Tables) -> DataFrame:
    """Guarded log and its inverse, power of ten of a tier."""
    zero = F.when(F.col("o_orderkey") % 10 == 0, 0.0).otherwise(F.col("o_totalprice"))
    return t.orders.select(
        "o_orderkey",
        F.round(X.log_guarded(zero), 8).alias("log_price"),
        F.round(F.exp(X.log_guarded(zero)), 2).alias("price"),
        F.pow(F.lit(10.0), F.col("o_orderkey") % 3).alias("weight"),
    )


def date_functions(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        X.format_date(F.col("o_orderdate")).alias("day"),
        F.expr("cast(o_orderdate as date) - interval 90 days").cast("string").alias("earlier"),
        (micros("o_orderdate") / 1000).cast("bigint").alias("epoch_ms"),
        (X.parse_date(X.format_date(F.col("o_orderdate"))) == F.to_date("o_orderdate")).alias("same"),
    )


# ---- joins ---------------------------------------------------------------------------------


def join_keep_right(t: Tables) -> DataFrame:
    rows = R.join_keep_right(t.lineitem, t.orders, "l_orderkey", "o_orderkey")
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def join_hot_key(t: Tables) -> DataFrame:
    """Five event types as join keys: suppliers come out once per event of the type their number stands for.

    The number gives the type, so the copies are counted by number: a group of (number, text) costs more than twice as much per copy.
    """
    types = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    kind = F.get(types, (F.col("s_suppkey") % 5).cast("int")).alias("kind")
    rows = R.join_keep_right(t.events, t.supplier.select("s_suppkey", "s_name", kind), "event_type", "kind", hot=True)
    return rows.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("copies")).select("s_suppkey", kind, "copies")


def join_chain(t: Tables) -> DataFrame:
    """Four tables; the fact side is collapsed to segment and part before the last join."""
    buyers = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")
    brands = t.part.select("p_partkey", "p_brand")
    return (
        t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
        .join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("c_mktsegment", "l_partkey")
        .agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))
        .join(brands, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("c_mktsegment", "p_brand")
        .agg(F.sum("quantity").alias("quantity"), F.sum("n").alias("n_lines"))
    )


def join_tiny(t: Tables) -> DataFrame:
    rows = R.join_tiny(t.supplier, t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", "s_name", "n_name")


def join_huge(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_lines"))
    rows = R.join_huge(t.supplier.where("s_nationkey = 7"), lines, F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.select("s_suppkey", "s_name", "n_lines")


def join_left_null(t: Tables) -> DataFrame:
    """Left outer join projected to 0/1: does a customer have an early order?"""
    early = t.orders.where("o_orderdate < date'1997-01-01'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t.customer.join(early, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey",
        F.when(F.col("n").isNull(), 0).otherwise(1).alias("has_order"),
        F.coalesce("n", F.lit(0)).alias("n_orders"),
    )


def semi_residual(t: Tables) -> DataFrame:
    return R.exists_other(t.lineitem, "l_orderkey", "l_suppkey").select("l_orderkey", "l_suppkey", "l_linenumber")


def anti_residual(t: Tables) -> DataFrame:
    rows = R.not_exists_other(t.lineitem, "l_orderkey", "l_suppkey", F.col("l_returnflag") == "R")
    return rows.select("l_orderkey", "l_suppkey", "l_linenumber")


def scalar_share(t: Tables) -> DataFrame:
    value = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    limit = value.agg(F.sum("v") * 0.001)
    return value.where(F.col("v") > limit.scalar()).select("o_custkey", F.round("v", 2).alias("value"))


def merge_frames(t: Tables) -> DataFrame:
    """Two-column-key inner merge, left merge of an optional group, rows missing from a frame."""
    keys = ["l_partkey", "l_suppkey"]
    volume = t.lineitem.groupBy(*keys).agg(F.sum("l_quantity").alias("quantity"))
    returned = t.lineitem.where("l_returnflag = 'R'").groupBy(*keys).agg(F.count(F.lit(1)).alias("returned"))
    price = t.lineitem.groupBy(*keys).agg(F.max("l_extendedprice").alias("top_price"))
    missing = R.not_in(volume, returned, keys).select(*keys, F.lit(1).alias("never_returned"))
    merged = R.merge_common(R.merge_common(volume, price), returned, "left")
    return R.merge_common(merged, missing, "left").fillna(0)


def union_ids(t: Tables) -> DataFrame:
    a = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    b = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return R.distinct_union(a, b)


def stacked_sizes(t: Tables) -> DataFrame:
    frames = [
        df.groupBy(F.col(k).alias("nation")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
        for df, k, side in ((t.customer, "c_nationkey", "customer"), (t.supplier, "s_nationkey", "supplier"))
    ]
    return R.stack(frames)


# ---- reducers ------------------------------------------------------------------------------

TRUNCATED_SQL = """
    SELECT o_orderkey, o_custkey, o_totalprice FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY CAST(FLOOR(o_totalprice / 1000) AS INT)
            ORDER BY o_orderkey) AS rn FROM orders) x WHERE rn = 1"""


def keep_truncated(t: Tables) -> DataFrame:
    key = (F.col("o_totalprice") / 1000).cast("int")
    return R.keep_one(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), [key])


def two_columns(t: Tables) -> DataFrame:
    """Any number of template iterations equals one keyed keep-one on the first two columns."""
    return R.keep_one(t.lineitem.select("l_orderkey", "l_partkey"), ["l_orderkey"])


def partition_faults(t: Tables) -> DataFrame:
    """What the partitioning operators promise, held against the partitions they made: no key in two partitions, no range that
    overlaps the one before, no row that sorts below the row before it in its partition."""
    place = F.spark_partition_id().alias("p")
    hashed = R.hash_partition(t.customer, "c_nationkey", 7).select("c_nationkey", place)
    split = hashed.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("parts"))
    split = split.agg(F.sum("n").alias("rows_in"), F.count_if(F.col("parts") > 1).alias("faults"))
    ranges = R.range_partition(t.supplier, "s_acctbal", 5).select("s_acctbal", place).groupBy("p").agg(
        F.count(F.lit(1)).alias("n"), F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high")
    )
    before = F.lag("high").over(W.orderBy("p"))  # five partitions
    ranges = ranges.withColumn("before", before).agg(F.sum("n").alias("rows_in"), F.count_if(F.col("low") <= F.col("before")).alias("faults"))
    rows = R.sort_partitions(R.hash_partition(t.part, "p_brand", 6), "p_retailprice")
    rows = rows.select("p_retailprice", place, F.monotonically_increasing_id().alias("at"))
    last = F.lag("p_retailprice").over(W.partitionBy("p").orderBy("at"))
    rows = rows.withColumn("last", last).agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col("p_retailprice") < F.col("last")).alias("faults"))
    frames = (("hash", split), ("range", ranges), ("sort", rows))
    return R.stack([df.select(F.lit(name).alias("kind"), "rows_in", "faults") for name, df in frames])


# ---- profiling -----------------------------------------------------------------------------


def key_cardinality(t: Tables) -> DataFrame:
    frames = [
        profile.key_cardinality(getattr(t, table), keys).withColumn("table_name", F.lit(table))
        for table, keys in catalog.GROUP_KEYS.items()
    ]
    return R.stack(frames)


def quantile_literals(t: Tables) -> DataFrame:
    fields = {
        "lineitem": ["l_quantity", "l_extendedprice"],
        "orders": ["o_totalprice"],
        "customer": ["c_acctbal"],
        "part": ["p_retailprice"],
        "supplier": ["s_acctbal", "s_nationkey"],
    }
    frames = [
        profile.quantile_literals(getattr(t, table), columns, profile.QUARTILES_AND_TAIL)
        for table, columns in fields.items()
    ]
    return R.stack(frames).withColumn("literal", F.round("literal", 6))


def date_literals(t: Tables) -> DataFrame:
    """Dates as numbers: literals at the quartiles, printed as days."""
    rows = t.lineitem.select(micros("l_shipdate").alias("l_shipdate"))
    out = profile.quantile_literals(rows, ["l_shipdate"])
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("literal") / 86400000000).cast("int")), "yyyy-MM-dd")
    return out.select("field", "selectivity", day.alias("literal"))


def category_share(t: Tables) -> DataFrame:
    frames = [
        profile.category_share(getattr(t, table), column)
        .select(F.lit(column).alias("field"), "literal", F.round("selectivity", 10).alias("selectivity"))
        for table, column in (
            ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("orders", "o_orderstatus"),
            ("customer", "c_mktsegment"), ("events", "event_type"),
        )
    ]
    return R.stack(frames)


def token_share(t: Tables) -> DataFrame:
    return profile.token_share(t.part, "p_name", " ").select("token", "n", F.round("selectivity", 10).alias("selectivity"))


def whole_catalogue(t: Tables) -> DataFrame:
    return R.stack([R.predicate_catalogue(getattr(t, n), catalog.predicates_of(n)) for n in catalog.TABLES])


def derived_catalogue(t: Tables) -> DataFrame:
    """Filter literals of the given tables, derived from their rows."""
    return R.stack([profile.literal_catalogue(getattr(t, n), n, fields) for n, fields in catalog.FILTER_FIELDS.items()])


def literal_catalogue(t: Tables) -> DataFrame:
    return derived_catalogue(t).withColumns({"number": F.round("number", 6), "selectivity": F.round("selectivity", 10)})


def literal_catalogue_events(t: Tables) -> DataFrame:
    """A column with nulls, one with NaN, text with a value below the share, documents' sources and languages."""
    rows = t.events.select(
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("vals"),
        F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value") * 3).alias("nans"),
        F.when(F.col("event_id") % 400 == 0, "rare").otherwise(F.col("event_type")).alias("kind"),
        F.lit(7).alias("one"), "ts",
    )
    out = profile.literal_catalogue(rows, "events", ["vals", "nans", "kind", "one", "ts"], profile.QUARTILES_AND_TAIL)
    return out.withColumns({"number": F.round("number", 6), "selectivity": F.round("selectivity", 10)})


def derived_predicates(t: Tables) -> DataFrame:
    """Every derived predicate run against its table: expected and measured rows."""
    found: dict[str, list] = {}
    for p in profile.predicates(derived_catalogue(t)):
        found.setdefault(p.table, []).append(p)
    return R.stack([R.predicate_catalogue(getattr(t, n), ps) for n, ps in found.items()])


def derived_qerror(t: Tables) -> DataFrame:
    """How far derived selectivities and measured ones are apart, by field and rank of the literal."""
    rows = profile.qerror(derived_predicates(t)).withColumn("field", F.element_at(F.split("predicate", " "), 1))
    return rows.groupBy("table_name", "field").agg(
        F.count(F.lit(1)).alias("literals"), F.sum("rows_out").alias("rows_out"), F.round(F.max("qerror"), 6).alias("worst")
    )


def predicate_catalogue(t: Tables) -> DataFrame:
    return whole_catalogue(t).withColumn("actual", F.round("actual", 10)).drop("total")


def qerror(t: Tables) -> DataFrame:
    return profile.qerror(whole_catalogue(t)).withColumns(
        {"expected_rows": F.round("expected_rows", 4), "qerror": F.round("qerror", 6)}
    )


def _catalogue_sql() -> str:
    parts = []
    for p in catalog.PREDICATES:
        literal = repr(p.literal) if isinstance(p.literal, float) else ("DATE " if isinstance(p.literal, date) else "") + f"'{p.literal}'"
        op = "=" if p.op == "==" else p.op
        parts.append(
            f"SELECT '{p.table}' AS table_name, '{p.name}' AS predicate, "
            f"CAST({p.selectivity!r} AS DOUBLE) AS expected, "
            f"COUNT(*) FILTER (WHERE {p.column} {op} {literal}) AS rows_out, COUNT(*) AS total FROM {p.table}"
        )
    return " UNION ALL ".join(parts)


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _number_sql(table: str, c: str, p: float, rows: str | None = None) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{c}' AS field, '<=' AS op, ROUND(quantile_cont({c}::DOUBLE, {p}), 6) AS number, "
        f"NULL::VARCHAR AS text, {p}::DOUBLE AS selectivity FROM {rows or table}"
    )


def _time_sql(table: str, c: str, p: float, rows: str | None = None) -> str:
    return (
        f"SELECT '{table}', '{c}', '<=', NULL::DOUBLE, strftime(make_timestamp(floor(quantile_cont(epoch_us({c})::DOUBLE, {p}))::BIGINT), '%Y-%m-%d'), "
        f"{p}::DOUBLE FROM {rows or table}"
    )


def _share_sql(table: str, c: str, rows: str | None = None) -> str:
    of = rows or table
    return (
        f"SELECT '{table}', '{c}', '==', NULL::DOUBLE, {c}, ROUND(COUNT(*) / (SELECT COUNT(*) FROM {of})::DOUBLE, 10) FROM {of} "
        f"WHERE {c} IS NOT NULL GROUP BY {c} HAVING COUNT(*) >= 0.01 * (SELECT COUNT(*) FROM {of})"
    )


_TIMES = ("l_shipdate", "o_orderdate")
_WORDS = ("o_orderstatus", "c_mktsegment")


def _literals_sql() -> str:
    parts = []
    for table, fields in catalog.FILTER_FIELDS.items():
        for c in fields:
            if c in _WORDS:
                parts.append(_share_sql(table, c))
            else:
                one = _time_sql if c in _TIMES else _number_sql
                parts += [one(table, c, p) for p in profile.QUARTILES]
    numbers = [x for x in parts if "AS table_name" in x]
    return _union(numbers + [x for x in parts if x not in numbers])


def _derived_sql() -> str:
    """Derived literals with the rows they let through."""
    parts = []
    for table, fields in catalog.FILTER_FIELDS.items():
        total = f"(SELECT COUNT(*) FROM {table})"
        for c in fields:
            if c in _WORDS:
                parts.append(
                    f"SELECT '{table}' AS table_name, '{c}' AS field, COUNT(*) / {total}::DOUBLE AS selectivity, COUNT(*) AS rows_out, {total} AS total "
                    f"FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} HAVING COUNT(*) >= 0.01 * {total}"
                )
                continue
            for p in profile.QUARTILES:
                cut = f"quantile_cont({c}::DOUBLE, {p})"
                if c in _TIMES:
                    cut = f"CAST(make_timestamp(floor(quantile_cont(epoch_us({c})::DOUBLE, {p}))::BIGINT) AS DATE)"
                parts.append(
                    f"SELECT '{table}' AS table_name, '{c}' AS field, {p}::DOUBLE AS selectivity, "
                    f"(SELECT COUNT(*) FROM {table} WHERE {c} <= (SELECT {cut} FROM {table})) AS rows_out, {total} AS total"
                )
    return _union(parts)


QUERIES = {
    "filter_range": (
        q(lambda t: t.lineitem.where(R.condition("l_quantity", "<=", 13.0)).select("l_orderkey", "l_linenumber", "l_quantity")),
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <= 13",
    ),
    "filter_eq": (
        q(lambda t: t.customer.where(R.condition("c_mktsegment", "==", "BUILDING"))),
        "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'",
    ),
    "filter_key_eq": (
        q(lambda t: t.supplier.where(R.condition("s_nationkey", "==", 6.0))),
        "SELECT * FROM supplier WHERE s_nationkey = 6",
    ),
    "filter_date": (
        q(lambda t: t.orders.where(R.condition("o_orderdate", "<=", date(1996, 12, 10))).select("o_orderkey", F.to_date("o_orderdate").alias("d"))),
        "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate <= DATE '1996-12-10'",
    ),
    "filter_contains": (q(filter_contains), "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 're')"),
    "filter_all_of": (
        q(lambda t: t.part.where(R.all_of(R.condition("p_brand", "==", "Brand#23"), R.condition("p_size", "==", 7)))),
        "SELECT * FROM part WHERE p_brand = 'Brand#23' AND p_size = 7",
    ),
    "filter_columns": (
        q(lambda t: t.lineitem.where(F.col("l_suppkey") > F.col("l_partkey")).select("l_orderkey", "l_partkey", "l_suppkey")),
        "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey > l_partkey",
    ),
    "filter_not_like": (
        q(lambda t: t.orders.where(R.condition("o_orderpriority", "not like", "%NOT%SPEC%")).select("o_orderkey", "o_orderpriority")),
        "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT LIKE '%NOT%SPEC%'",
    ),
    "filter_pattern": (
        q(lambda t: t.customer.where(R.condition("c_name", "matches", "[02468]$")).select("c_custkey", "c_name")),
        "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[02468]$')",
    ),
    "filter_lookup": (
        q(filter_lookup),
        """SELECT l_orderkey, l_linenumber, l.l_partkey, l_quantity FROM lineitem l
           JOIN (SELECT l_partkey, 0.2 * AVG(l_quantity) AS v FROM lineitem GROUP BY 1) a
             ON l.l_partkey = a.l_partkey WHERE l_quantity < v""",
    ),
    "filter_member": (
        q(filter_member),
        """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
           WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)""",
    ),
    "computed_columns": (
        q(computed_columns),
        """SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount), 4) AS disc_price,
                  ROUND(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, 1 AS one FROM lineitem""",
    ),
    "text_functions": (
        q(text_functions),
        """SELECT p_partkey, array_to_string(string_split(p_name, ' '), ', ') AS joined,
                  CAST(replace(p_brand, 'Brand#', '') AS INT) AS brand_no,
                  string_split(p_brand, '#')[-1] AS last_part,
                  CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1000000 END AS line,
                  ['a', 'b', 'c'][1 + p_partkey % 3] AS picked FROM part""",
    ),
    "unit_numbers": (
        q(unit_numbers),
        """SELECT o_orderkey, ROUND(CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice * 1000.0
                  WHEN 3 THEN o_totalprice END, 3) AS number FROM orders""",
    ),
    "log_labels": (
        q(log_labels),
        """SELECT o_orderkey, ROUND(ln(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE o_totalprice END), 8) AS log_price,
                  ROUND(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE o_totalprice END, 2) AS price,
                  pow(10.0, o_orderkey % 3) AS weight FROM orders""",
    ),
    "date_functions": (
        q(date_functions),
        """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
                  strftime(CAST(o_orderdate AS DATE) - INTERVAL 90 DAY, '%Y-%m-%d') AS earlier,
                  epoch_ms(o_orderdate) AS epoch_ms, TRUE AS same FROM orders""",
    ),
    "join_keep_right": (
        q(join_keep_right),
        """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "join_hot_key": (
        q(join_hot_key),
        """SELECT s_suppkey, event_type AS kind, COUNT(*) AS copies FROM supplier
           JOIN events ON event_type = ['click', 'error', 'purchase', 'signup', 'view'][s_suppkey % 5 + 1] GROUP BY ALL""",
    ),
    "join_chain": (
        q(join_chain),
        """SELECT c_mktsegment, p_brand, SUM(l_quantity) AS quantity, COUNT(*) AS n_lines
           FROM customer, orders, lineitem, part
           WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_partkey = p_partkey GROUP BY 1, 2""",
    ),
    "join_tiny": (q(join_tiny), "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "join_huge": (
        q(join_huge),
        """SELECT s_suppkey, s_name, COUNT(*) AS n_lines FROM supplier JOIN lineitem ON s_suppkey = l_suppkey
           WHERE s_nationkey = 7 GROUP BY 1, 2""",
    ),
    "join_left_null": (
        q(join_left_null),
        """SELECT c_custkey, MAX(CASE WHEN o_orderkey IS NULL THEN 0 ELSE 1 END) AS has_order,
                  COUNT(o_orderkey) AS n_orders
           FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderdate < DATE '1997-01-01' GROUP BY 1""",
    ),
    "semi_residual": (
        q(semi_residual),
        """SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem a WHERE EXISTS (
             SELECT * FROM lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey)""",
    ),
    "anti_residual": (
        q(anti_residual),
        """SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem a WHERE NOT EXISTS (
             SELECT * FROM lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey
               AND b.l_returnflag = 'R')""",
    ),
    "scalar_share": (
        q(scalar_share),
        """SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS value FROM orders GROUP BY 1
           HAVING SUM(o_totalprice) > (SELECT SUM(o_totalprice) * 0.001 FROM orders)""",
    ),
    "merge_frames": (
        q(merge_frames),
        """SELECT l_partkey, l_suppkey, SUM(l_quantity) AS quantity, MAX(l_extendedprice) AS top_price,
                  COUNT(*) FILTER (WHERE l_returnflag = 'R') AS returned,
                  CASE WHEN COUNT(*) FILTER (WHERE l_returnflag = 'R') = 0 THEN 1 ELSE 0 END AS never_returned
           FROM lineitem GROUP BY 1, 2""",
    ),
    "union_ids": (
        q(union_ids),
        """SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P'
           UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0""",
    ),
    "stacked_sizes": (
        q(stacked_sizes),
        """SELECT c_nationkey AS nation, COUNT(*) AS n, 'customer' AS side FROM customer GROUP BY 1
           UNION ALL SELECT s_nationkey, COUNT(*), 'supplier' FROM supplier GROUP BY 1""",
    ),
    "distinct_values": (
        q(lambda t: t.events.select("event_type").distinct()),
        "SELECT DISTINCT event_type FROM events",
    ),
    "keep_one": (
        q(lambda t: R.keep_one(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"))),
        "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY 1, 2, 3 LIMIT 1",
    ),
    "keep_first": (
        q(lambda t: R.keep_one(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"])),
        """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
           QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) = 1""",
    ),
    "keep_last": (
        q(lambda t: R.keep_one(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "last")),
        """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
           QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC, o_totalprice DESC) = 1""",
    ),
    "keep_truncated": (q(keep_truncated), TRUNCATED_SQL),
    "keep_two_columns": (
        q(two_columns),
        "SELECT l_orderkey, MIN(l_partkey) AS l_partkey FROM lineitem GROUP BY 1",
    ),
    "count_of_counts": (
        q(lambda t: t.lineitem.groupBy("l_orderkey").count().groupBy(F.col("count").alias("lines")).agg(F.count(F.lit(1)).alias("orders"))),
        "SELECT lines, COUNT(*) AS orders FROM (SELECT COUNT(*) AS lines FROM lineitem GROUP BY l_orderkey) x GROUP BY 1",
    ),
    "hash_partitioned": (
        q(lambda t: R.hash_partition(t.customer, "c_custkey")),
        "SELECT * FROM customer",
    ),
    "range_partitioned": (
        q(lambda t: R.range_partition(t.supplier, "s_acctbal")),
        "SELECT * FROM supplier",
    ),
    "sorted_partitions": (
        q(lambda t: R.sort_partitions(R.hash_partition(R.map_rows(t.part), "p_brand"), "p_retailprice")),
        "SELECT * FROM part",
    ),
    "partition_faults": (
        q(partition_faults),
        """SELECT 'hash' AS kind, COUNT(*) AS rows_in, 0 AS faults FROM customer UNION ALL SELECT 'range', COUNT(*), 0 FROM supplier
           UNION ALL SELECT 'sort', COUNT(*), 0 FROM part""",
    ),
    "table_counts": (
        q(lambda t: profile.table_counts({n: getattr(t, n) for n in ALL_TABLES})),
        _union(f"SELECT '{n}' AS table_name, COUNT(*) AS row_count FROM {n}" for n in ALL_TABLES),
    ),
    "key_cardinality": (
        q(key_cardinality),
        _union(
            f"SELECT '{t}' AS table_name, '{k}' AS key, COUNT(DISTINCT {k}) AS n_groups FROM {t}"
            for t, keys in catalog.GROUP_KEYS.items()
            for k in keys
        ),
    ),
    "quantile_literals": (
        q(quantile_literals),
        _union(
            f"SELECT '{c}' AS field, CAST({p} AS DOUBLE) AS selectivity, "
            f"ROUND(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) AS literal FROM {t}"
            for t, c in (
                ("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("orders", "o_totalprice"),
                ("customer", "c_acctbal"), ("part", "p_retailprice"), ("supplier", "s_acctbal"),
                ("supplier", "s_nationkey"),
            )
            for p in profile.QUARTILES_AND_TAIL
        ),
    ),
    "date_literals": (
        q(date_literals),
        _union(
            f"SELECT 'l_shipdate' AS field, CAST({p} AS DOUBLE) AS selectivity, strftime(make_timestamp("
            f"CAST(floor(quantile_cont(CAST(epoch_us(l_shipdate) AS DOUBLE), {p})) AS BIGINT)), '%Y-%m-%d') AS literal FROM lineitem"
            for p in profile.QUARTILES
        ),
    ),
    "category_share": (
        q(category_share),
        _union(
            f"SELECT '{c}' AS field, {c} AS literal, ROUND(COUNT(*) * 1.0 / (SELECT COUNT(*) FROM {t}), 10) AS selectivity FROM {t} GROUP BY {c}"
            for t, c in (
                ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("orders", "o_orderstatus"),
                ("customer", "c_mktsegment"), ("events", "event_type"),
            )
        ),
    ),
    "token_share": (
        q(token_share),
        """WITH tokens AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part)
           SELECT token, COUNT(*) AS n, ROUND(COUNT(*) * 1.0 / (SELECT COUNT(*) FROM part), 10) AS selectivity
           FROM tokens JOIN part ON contains(p_name, token) GROUP BY 1""",
    ),
    "literal_catalogue": (q(literal_catalogue), _literals_sql()),
    "literal_catalogue_events": (
        q(literal_catalogue_events),
        """WITH rows AS (SELECT CASE WHEN event_id % 5 <> 0 THEN value END AS vals, CASE WHEN event_id % 9 <> 0 THEN value * 3 END AS nans,
                CASE WHEN event_id % 400 = 0 THEN 'rare' ELSE event_type END AS kind, 7 AS one, ts FROM events)
           SELECT * FROM ("""
        + _union(
            [_number_sql("events", c, p, "rows") for c in ("vals", "nans", "one") for p in profile.QUARTILES_AND_TAIL]
            + [_time_sql("events", "ts", p, "rows") for p in profile.QUARTILES_AND_TAIL]
            + [_share_sql("events", "kind", "rows")]
        )
        + ") x",
    ),
    "derived_predicates": (
        q(lambda t: derived_predicates(t).select(
            "table_name", F.element_at(F.split("predicate", " "), 1).alias("field"), F.round("expected", 10).alias("expected"), "rows_out", F.round("actual", 10).alias("actual"), "total"
        )),
        f"WITH x AS ({_derived_sql()}) SELECT table_name, field, ROUND(selectivity, 10) AS expected, rows_out, ROUND(rows_out / total, 10) AS actual, total FROM x",
    ),
    "derived_qerror": (
        q(derived_qerror),
        f"""WITH x AS ({_derived_sql()})
            SELECT table_name, field, COUNT(*) AS literals, SUM(rows_out)::BIGINT AS rows_out,
                   ROUND(MAX(CASE WHEN rows_out > 0 THEN greatest(selectivity * total / rows_out, rows_out / (selectivity * total)) END), 6) AS worst
            FROM x GROUP BY 1, 2""",
    ),
    "predicate_catalogue": (
        q(predicate_catalogue),
        f"SELECT table_name, predicate, expected, rows_out, ROUND(rows_out / total, 10) AS actual FROM ({_catalogue_sql()}) c",
    ),
    "qerror": (
        q(qerror),
        f"""SELECT table_name, predicate, ROUND(expected * total, 4) AS expected_rows, rows_out,
                   CASE WHEN rows_out > 0 THEN ROUND(greatest(expected * total / rows_out, rows_out / (expected * total)), 6) END AS qerror
            FROM ({_catalogue_sql()}) c""",
    ),
}
