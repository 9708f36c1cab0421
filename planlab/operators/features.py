"""Cardinality propagation and per-plan features.

An operator table has one row per operator of a plan: ``plan_id, pos`` (log order), ``pact,
table_name, tables, selectivity, out_cardinality, complexity``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlab.operators import ordered
from planlab.session import broadcast_if_small, stored

PERCENTILES = [0.1, 0.5, 0.9]


FIXED_SIZE = ("nation", "region")  # tables that hold the same rows at every data size


def scaled_cardinalities(counts: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Row counts of the tables at several data sizes: ``data_id, table_name, rows``."""
    sizes = F.array(*[F.struct(F.lit(d).alias("data_id"), F.lit(float(f)).alias("f")) for d, f in factors.items()])
    long = counts.select("table_name", "row_count", F.explode(sizes).alias("s"))
    factor = F.when(F.col("table_name").isin(*FIXED_SIZE), F.lit(1.0)).otherwise(F.col("s.f"))
    return long.select("s.data_id", "table_name", (F.col("row_count") * factor).alias("rows"))


def for_sizes(df: DataFrame, data_ids: list[str]) -> DataFrame:
    """Every row once per data size."""
    return df.withColumn("data_id", F.explode(F.array(*[F.lit(d) for d in data_ids])))


def propagate(ops: DataFrame, cardinalities: DataFrame, data_ids: list[str], unknown: str = "one") -> DataFrame:
    """Output cardinality of every operator of every plan at every data size.

    The rule reads a plan in log order and keeps a queue of branches. A source or join opens a
    branch at the end; other operators change the last branch: to their fixed cardinality, or by
    their selectivity, or, with neither, to 1 (``unknown="one"``; ``"carry"`` leaves it). A join
    takes the greater of the two oldest branches. The sink repeats the last branch.

    Since branches leave the queue in the order they came, the k-th join of a plan always takes
    its branches 2k-1 and 2k. So branch numbers are running counts, values inside a branch are
    running products, and only join results depend on each other; those are settled over the
    branch table by path doubling, in a number of rounds logarithmic in the join nesting. No plan
    is ever gathered in one place, however many operators it has.
    """
    pact = F.col("pact")
    push = pact.isin("Data Source", "Join")
    change = ~push & (pact != "Data Sink")
    given = F.when(change, F.col("out_cardinality").cast("double"))
    if unknown == "one":
        given = F.when(change, F.coalesce(given, F.when(F.col("selectivity").isNull(), F.lit(1.0))))
    ops = ops.withColumns(
        {
            "__push": push.cast("int"),
            "__join": (pact == "Join").cast("int"),
            "__given": given,
            "__starts": (push | given.isNotNull()).cast("int"),
            "__factor": F.when(change & given.isNull(), F.coalesce("selectivity", F.lit(1.0))).otherwise(1.0),
        }
    )
    ops = ordered.running(
        ops,
        ["plan_id"],
        ["pos"],
        {"__slot": ("sum", "__push"), "__segment": ("sum", "__starts"), "__k": ("sum", "__join")},
    )
    ops = ordered.running(
        stored(ops), ["plan_id", "__segment"], ["pos"], {"__product": ("product", "__factor")}
    )
    ops = stored(ops)  # read three times below

    start_pos = F.when(F.col("__starts") == 1, F.col("pos"))
    origin = F.struct("table_name", "selectivity", "__given", "__join")
    slots = ops.groupBy("plan_id", "__slot").agg(
        F.max(F.when(F.col("__join") == 1, F.col("__k"))).alias("__k"),
        F.max_by(origin, start_pos).alias("__origin"),
        F.max_by("__product", "pos").alias("__factor"),
    )
    lacking = F.col("__k").isNotNull() & (2 * F.col("__k") >= F.col("__slot"))
    refused = F.raise_error(F.lit("join without two open branches")).cast("bigint")
    slots = slots.withColumn("__k", F.when(lacking, refused).otherwise(F.col("__k")))
    slots = for_sizes(slots, data_ids).withColumn("table_name", F.col("__origin.table_name"))
    sizes = broadcast_if_small(cardinalities)
    slots = slots.join(sizes, ["data_id", "table_name"], "left")
    is_open = F.col("__origin.__join") == 1
    begin = F.coalesce(F.col("__origin.__given"), F.col("rows") * F.col("__origin.selectivity"))
    slots = slots.select(
        "plan_id",
        "data_id",
        "__slot",
        "__k",
        "__factor",
        is_open.alias("__open"),
        F.when(~is_open, begin * F.col("__factor")).alias("__val"),
    )
    settled = _settle(slots)

    inputs = settled.groupBy(
        "plan_id", "data_id", F.floor((F.col("__slot") + 1) / 2).alias("__k")
    ).agg(F.max("__val").alias("__joined"))
    heads = for_sizes(ops.where("__starts = 1"), data_ids)
    heads = heads.withColumn("__k", F.when(F.col("__join") == 1, F.col("__k")))
    heads = heads.join(sizes, ["data_id", "table_name"], "left")
    heads = heads.join(inputs, ["plan_id", "data_id", "__k"], "left").select(
        "plan_id",
        "data_id",
        "__segment",
        F.coalesce("__given", "__joined", F.col("rows") * F.col("selectivity")).alias("__begin"),
    )
    out = ordered.hot_join(for_sizes(ops, data_ids), heads, ["plan_id", "data_id", "__segment"], "left")
    out = out.withColumn("out_cardinality", F.col("__begin") * F.col("__product"))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def _settle(slots: DataFrame) -> DataFrame:
    """Values of join branches: the greatest input along open branches, by path doubling."""
    owner = ["plan_id", "data_id"]
    joins = slots.where("__k is not null").select(
        *owner, F.col("__k").alias("__c"), F.col("__slot").alias("__up"), F.col("__factor").alias("__upf"), "__open"
    ).where("__open").drop("__open")
    state = (
        slots.withColumn("__c", F.floor((F.col("__slot") + 1) / 2))
        .join(joins, [*owner, "__c"], "left")
        .select(*owner, "__slot", "__val", "__up", "__upf")
    )
    state = stored(state)
    while not state.where("__up is not null").isEmpty():
        gain = (
            state.where("__up is not null and __val is not null")
            .groupBy(*owner, F.col("__up").alias("__slot"))
            .agg(F.max(F.col("__val") * F.col("__upf")).alias("__gain"))
        )
        above = state.where("__up is not null").select(
            *owner, F.col("__slot").alias("__up"), F.col("__up").alias("__up2"), F.col("__upf").alias("__upf2")
        )
        state = (
            state.join(gain, [*owner, "__slot"], "left")
            .join(above, [*owner, "__up"], "left")
            .select(
                *owner,
                "__slot",
                F.greatest("__val", "__gain").alias("__val"),
                F.col("__up2").alias("__up"),
                (F.col("__upf") * F.col("__upf2")).alias("__upf"),
            )
        )
        state = stored(state)
    return state


def describe(df: DataFrame, keys: list[str], value: str, percentiles=PERCENTILES, prefix: str = "") -> DataFrame:
    """count, mean, std, min, exact percentiles and max per group."""
    v = F.col(value).cast("double")
    plain = df.groupBy(*keys).agg(
        F.count(v).alias(f"{prefix}count"),
        F.avg(v).alias(f"{prefix}mean"),
        F.stddev(v).alias(f"{prefix}std"),
        F.min(v).alias(f"{prefix}min"),
        F.max(v).alias(f"{prefix}max"),
    )
    long = ordered.quantiles(df.withColumn(value, v), keys, value, list(percentiles))
    wide = long.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("q") == float(p), F.col("v"))).alias(f"{prefix}{round(p * 100)}%")
            for p in percentiles
        ]
    )
    return ordered_join(plain, wide, keys)


def ordered_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of two per-group tables; without keys both are one row."""
    if keys:
        return ordered.null_safe(a, b, keys, "left")
    return a.select("*", *[b.select(c).scalar().alias(c) for c in b.columns])


def moments(value: str | Column, prefix: str) -> list[Column]:
    """Population kurtosis and skewness, as the usual statistics packages default to."""
    return [F.kurtosis(value).alias(f"{prefix}kurtosis"), F.skewness(value).alias(f"{prefix}skew")]


def block(value: Column, prefix: str, stats: tuple[str, ...]) -> list[Column]:
    """Aggregates of one conditional column; missing values become 0 later."""
    fold = {
        "mean": F.avg,
        "std": F.stddev,
        "min": F.min,
        "max": F.max,
        "sum": F.sum,
        "prod": F.product,
    }
    return [fold[s](value).alias(f"{prefix}_{s}") for s in stats]


def cardinality_features(ops: DataFrame, keys=("plan_id", "data_id")) -> DataFrame:
    """One feature row per plan and data size, every block in one aggregation.

    Plans without a Map or without a source have no row; absent optional blocks are 0, absent
    selectivities -1.
    """
    keys = list(keys)
    oc = F.col("out_cardinality")

    def only(pact: str) -> Column:
        return F.when(F.col("pact") == pact, oc)

    four = ("mean", "std", "min", "max")
    effort = F.when(F.col("pact") == "Map", oc * F.pow(F.lit(10.0), F.col("complexity")))
    wide = ops.groupBy(*keys).agg(
        F.count_if(F.col("pact") == "Map").alias("__maps"),
        F.count_if(F.col("pact") == "Data Source").alias("__sources"),
        *moments(oc, "outCardinality_"),
        *block(effort, "complexity", four),
        *[F.coalesce(c(F.col("selectivity")), F.lit(-1.0)).alias(f"selectivity_{n}") for n, c in (("mean", F.avg), ("min", F.min), ("max", F.max))],
        F.sum(only("Data Source")).alias("sourceCardinalitySum"),
        F.product(only("Data Source")).alias("sourceCardinalityProd"),
        *block(only("Data Source"), "sourceOutCard", four),
        *block(only("Join"), "joinOutCard", (*four, "sum", "prod")),
        *block(only("Group by"), "groupbyOutCard", four),
        *block(only("Filter"), "filterOutCard", four),
    )
    wide = wide.where("__maps > 0 and __sources > 0").drop("__maps", "__sources")
    described = describe(ops, keys, "out_cardinality", prefix="outCardinality_")
    out = described.join(wide, keys)
    numbers = [c for c, kind in out.dtypes if kind == "double"]
    return out.withColumns({c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) for c in numbers})


def used_values(ops: DataFrame, key: str, column: str) -> DataFrame:
    """Distinct values of list columns per group, in order of first use: one row per value."""
    long = ops.select(key, "pos", F.posexplode(column).alias("__i", "value"))
    first = long.groupBy(key, "value").agg(F.min(F.struct("pos", "__i")).alias("__first"))
    first = first.select(key, "value", F.col("__first.pos").alias("pos"), F.col("__first.__i").alias("i"))
    return ordered.row_numbers(first, [key], ["pos", "i"], "place").drop("pos", "i")


def table_features(used: DataFrame, cardinalities: DataFrame, tables: list[str], keys=("plan_id",)) -> DataFrame:
    """One column per table, in sorted table order: its cardinality where the plan uses it."""
    joined = used.join(broadcast_if_small(cardinalities), F.col("value") == F.col("table_name"))
    return joined.groupBy(*keys, "data_id").agg(
        *[
            F.coalesce(F.max(F.when(F.col("table_name") == t, F.col("rows"))), F.lit(0.0)).alias(f"t_{i}")
            for i, t in enumerate(sorted(tables))
        ]
    )


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """1/0 column per value of a list column."""
    return df.withColumns(
        {f"h_{i}": F.array_contains(column, v).cast("double") for i, v in enumerate(sorted(values))}
    )


def pca_factors(df: DataFrame, columns: list[str], k: int, prefix: str = "t_F") -> DataFrame:
    """Principal components of centred columns appended as ``prefix1..k`` (sign is arbitrary)."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=columns, outputCol="__x").transform(df)
    rows = StandardScaler(inputCol="__x", outputCol="__c", withMean=True, withStd=False).fit(rows).transform(rows)
    out = PCA(k=k, inputCol="__c", outputCol="__f").fit(rows).transform(rows)
    out = out.withColumn("__a", vector_to_array("__f"))
    return out.select(*df.columns, *[F.col("__a")[i].alias(f"{prefix}{i + 1}") for i in range(k)])


def plan_feature_table(ops: DataFrame, cardinalities: DataFrame, data_ids: list[str], tables: list[str]) -> DataFrame:
    """Operators and table sizes to one feature row per plan and size."""
    sized = stored(propagate(ops, cardinalities, data_ids))
    features = cardinality_features(sized)
    extra = table_features(used_values(ops, "plan_id", "tables"), cardinalities, tables)
    return features.join(extra, ["plan_id", "data_id"])


def measured_feature_table(measured: DataFrame, log: DataFrame, cardinalities: DataFrame, tables: list[str]) -> DataFrame:
    """The same features from measured operator output; per-plan averages of complexity and
    selectivity and the used tables come from the job log."""
    averages = log.groupBy("plan_id").agg(
        F.avg("complexity").alias("complexity"), F.avg("selectivity").alias("selectivity")
    )
    features = cardinality_features(measured.join(averages, "plan_id", "left"))
    extra = table_features(used_values(log, "plan_id", "tables"), cardinalities, tables)
    return features.join(extra, ["plan_id", "data_id"])


def group_mean_fill(df: DataFrame, log: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Attach each column's mean over the log rows of the group."""
    return ordered.hot_join(df, log.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns]), keys, "left")


def trim_outliers(df: DataFrame, value: str, by: str, b: float = 0.01) -> DataFrame:
    """Per group keep rows strictly above the ``b`` quantile, then strictly below the ``1 - b``
    quantile of what is left. A null group is a group; rows without a value go.

    Both cuts are read off one table of the group's values with the rows below them: once ``low`` is known, the rows
    above it are the last ones of the group, so the second quantile is a position in the same table.
    """
    values = stored(ordered.placed(ordered.value_index(df, [by], value)))
    place = F.lit(b) * (F.col("__n") - 1)
    cuts = values.groupBy(by).agg(*ordered.ends_at(place), F.max("__n").alias("__n"))
    cuts = cuts.select(by, "__n", ordered.between(place).alias("__low_cut"))
    below = F.coalesce(F.max(F.when(F.col("__v") <= F.col("__low_cut"), F.col("__low") + F.col("__c"))), F.lit(0))
    rest = ordered.null_safe(values, cuts.drop("__n"), [by], "inner").groupBy(by).agg(
        below.alias("__below"), F.first("__n").alias("__n"), F.first("__low_cut").alias("__low_cut")
    )
    place = F.col("__below") + F.lit(1.0 - b) * (F.col("__n") - F.col("__below") - 1)
    rest = rest.where("__below < __n")  # else nothing of the group is left
    above = ordered.null_safe(values.drop("__n"), rest, [by], "inner").groupBy(by).agg(
        *ordered.ends_at(place), F.first("__low_cut").alias("__low_cut"), F.first(place).alias("__place")
    )
    above = above.select(by, "__low_cut", ordered.between(F.col("__place")).alias("__high_cut"))
    kept = ordered.null_safe(df, above, [by], "inner")
    kept = kept.where((F.col(value) > F.col("__low_cut")) & (F.col(value) < F.col("__high_cut")))
    return kept.drop("__low_cut", "__high_cut")


def trim_upper(df: DataFrame, value: str, q: float = 0.99) -> DataFrame:
    """Rows strictly below one quantile of the whole column."""
    return df.where(F.col(value) < ordered.quantile_scalar(df, value, q))


def label_bins(df: DataFrame, value: str, bins: int, out: str) -> DataFrame:
    """Quantile bin of a label: number of inner cut points at or below it."""
    cuts = ordered.quantiles(df, [], value, [i / bins for i in range(1, bins)])
    edges = cuts.agg(F.array_sort(F.collect_set("v")).alias("e"))  # bins - 1 values
    return df.withColumn("__e", edges.scalar()).withColumn(
        out, F.size(F.filter("__e", lambda e: e <= F.col(value)))
    ).drop("__e")


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairwise correlations in one aggregation, undefined ones 0: ``a, b, r``."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(
        *[
            F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"{a}|{b}")
            for a, b in pairs
        ]
    )
    cells = [
        F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.coalesce(F.nanvl(F.col(f"`{a}|{b}`"), F.lit(0.0)), F.lit(0.0)).alias("r"))
        for a, b in pairs
        for x, y in ({(a, b), (b, a)})
    ]
    return wide.select(F.inline(F.array(*cells)))


def found_categories(df: DataFrame, column: str) -> list:
    """The values of a category column in order, null last. They become columns, so too many are refused as a pivot would."""
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    values = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values to spread into columns")
    return sorted(values, key=lambda v: (v is None, v if v is not None else ""))


def category_rows(df: DataFrame, key: str | list[str], category: str) -> DataFrame:
    """How often each category occurs per key, null as one of them: ``key, category, n``."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys, F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def spread(long: DataFrame, key: str | list[str], names: dict, value: Column, fold=F.sum, fill=0) -> DataFrame:
    """Rows ``key, category, ...`` to one row per key with a column per category, ``names`` by category."""
    keys = [key] if isinstance(key, str) else list(key)
    cell = lambda c: F.when(F.col("category").eqNullSafe(F.lit(c)), value)
    cells = [F.coalesce(fold(cell(c)), F.lit(fill)) if fill is not None else fold(cell(c)) for c in names]
    return long.groupBy(*keys).agg(*[x.alias(n) for x, n in zip(cells, names.values())])


def category_counts(df: DataFrame, key: str, category: str, categories: list | None = None) -> DataFrame:
    """Counts of each category spread to columns ``n_<category>``, 0 where absent: the categories that are there, null among
    them as ``n_null``, or the listed ones."""
    found = found_categories(df, category) if categories is None else categories
    names = {c: f"n_{'null' if c is None else c}" for c in found}
    return spread(category_rows(df, key, category), key, names, F.col("n"))
