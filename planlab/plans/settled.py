"""Registered queries: learners and samplers on cases whose answer SQL can state.

A tree on one column of two values has two leaves, so means, quantiles and spreads are those of two groups; one regressor gives the textbook
line; groups far apart are the clusters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlab.operators import evaluate, features, forest, graphs, ordered, sampling
from planlab.plans.basics import q
from planlab.plans.featured import rounded
from planlab.plans.sampled import RANK, SPLIT, _walk_sql, _weighted_sql
from planlab.session import stored
from planlab.sources import documents
from planlab.sources.tables import Tables


def two_groups(t: Tables) -> DataFrame:
    """Parts with a rare mark, on which their label depends."""
    mark = (F.col("p_partkey") % 40 == 0).cast("double")
    extra = F.when(F.col("p_partkey") % 40 == 0, 100.0 + F.col("p_partkey") % 1000 / 5.0).otherwise(0.0)
    rows = t.part.select("p_partkey", "p_size", mark.alias("mark"), F.lit(0.0).alias("zero"), (F.col("p_retailprice") / 100.0 + extra).alias("y"))
    return rows.withColumn("size", F.col("p_size").cast("double"))


TWO = """g AS (SELECT p_partkey, p_size::DOUBLE AS size, (p_partkey % 40 = 0)::INT::DOUBLE AS mark,
              p_retailprice / 100.0::DOUBLE + CASE WHEN p_partkey % 40 = 0 THEN 100.0::DOUBLE + (p_partkey % 1000) / 5.0::DOUBLE ELSE 0.0 END AS y FROM part),
    train AS (SELECT * FROM g WHERE {split} < 0.7), test AS (SELECT * FROM g WHERE {split} >= 0.7)""".format(split=SPLIT.format(key="p_partkey"))


def sides(t: Tables, columns=("mark",), share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    return evaluate.split(forest.with_vector(two_groups(t), list(columns)), "p_partkey", share)


def leaves(t: Tables, trees: int = 0) -> tuple[DataFrame, DataFrame]:
    """Both sides with their leaves: of one tree, or of a forest that draws no bags."""
    train, test = sides(t)
    model = forest.fit_forest(train, "y", trees, 1, bootstrap=False) if trees else forest.fit_tree(train, "y", 1)
    return forest.with_leaves(model, train), forest.with_leaves(model, test)


def group_means(t: Tables) -> DataFrame:
    """Mean predictions of a tree and of a forest of three equal trees."""
    one, many = leaves(t)[1], leaves(t, 3)[1]
    both = one.select("p_partkey", F.round("prediction", 8).alias("tree")).join(many.select("p_partkey", F.round("prediction", 8).alias("forest")), "p_partkey")
    return both


def group_quantiles(t: Tables, trees: int) -> DataFrame:
    train, test = leaves(t, trees)
    return rounded(forest.quantile_predictions(train, test, "p_partkey", "y", [25, 50, 75]), 8)


def group_spread(t: Tables) -> DataFrame:
    train, test = leaves(t, 3)
    return rounded(forest.prediction_std(train, test, "p_partkey", "y"), 7)


def widest_intervals(t: Tables) -> DataFrame:
    """Centred intervals, and of them the rows above the 0.95 quantile of the width."""
    train, test = leaves(t, 3)
    rows = stored(forest.interval(train, test, "p_partkey", "y"))
    wide = rows.where(F.col("width") > ordered.quantile_scalar(rows, "width", 0.95))
    return rounded(forest.centred(wide).select("p_partkey", "width", "low_centred", "high_centred", "pred_centred"), 7)


def group_importances(t: Tables) -> DataFrame:
    train, _ = sides(t, ("mark", "zero"))
    model = forest.fit_forest(train, "y", 3, 1, bootstrap=False)
    return forest.importances(model, ["mark", "zero"], t.spark).orderBy(F.desc("importance")).limit(15)


def simple_regression(t: Tables) -> DataFrame:
    """Intercept and slope with HC3 errors."""
    rows = two_groups(t).withColumn("one", F.lit(1.0))
    return rounded(evaluate.least_squares_hc3(rows, ["one", "size"], "y"), 6)


def straight_ridge(t: Tables) -> DataFrame:
    train, test = evaluate.split(two_groups(t), "p_partkey", 0.7)
    out = evaluate.polynomial_ridge(train, test, "size", "y", 1, 2.5)
    return out.select("p_partkey", F.round("prediction", 8).alias("prediction"))


def straight_prefixes(t: Tables) -> DataFrame:
    return rounded(evaluate.prefix_baseline(two_groups(t), "p_partkey", "size", "y", [50, 150], 1), 8)


def line_scores(t: Tables) -> DataFrame:
    """The linear model's scores on the held-out part."""
    train, test = sides(t, ("size",))
    out = evaluate.regressor("linear", "y").fit(train).transform(test)
    return rounded(evaluate.scores(out, "y", "prediction").select("r2", "mse", "mae", "n"), 6)


def line_curve(t: Tables) -> DataFrame:
    rows = forest.with_vector(two_groups(t), ["size"])
    out = evaluate.learning_curve(rows, "p_partkey", "y", evaluate.regressor("linear", "y"), [0.3, 0.6])
    return rounded(out.select("train_share", "r2", "mse", "n"), 6)


def line_sweep(t: Tables) -> DataFrame:
    rows = forest.with_vector(two_groups(t), ["size"])
    return rounded(evaluate.sweep(rows, "p_partkey", {"linear": ["y"]}, [0.5], trim="y"), 6)


def separated_classes(t: Tables) -> DataFrame:
    """A class that one column tells: the classifier's report."""
    rows = forest.with_vector(two_groups(t).withColumn("kind", F.col("mark")), ["mark"])
    train, test = evaluate.split(rows, "p_partkey", 0.7)
    out = evaluate.classifier("forest", "kind", 3, 1).fit(train).transform(test)
    return evaluate.classification_report(out, "kind")


def moved_workload(t: Tables) -> DataFrame:
    """Learned on small parts, scored on large ones."""
    rows = forest.with_vector(two_groups(t).withColumn("y", F.log("y")), ["mark"])
    out = evaluate.transfer(rows.where("p_size <= 25"), rows.where("p_size > 25"), "y", 3, 1, bootstrap=False)
    return rounded(out.where("scale = 'log'").select("r2", "mse", "mae", "n"), 8)


def two_label_sources(t: Tables) -> DataFrame:
    """Trained on forecast labels (rounded) and on true ones, scored on the others."""
    rows = forest.with_vector(two_groups(t).withColumn("y", F.log("y")), ["mark"]).withColumn("forecast", F.round("y", 1))
    train, test = rows.where("p_size <= 25"), rows.where("p_size > 25")
    out = evaluate.compare_label_sources(train, test, "forecast", "y", 3, 1, bootstrap=False)
    return out.select("trained_on", F.round("r2", 8).alias("r2"), F.round("mae", 6).alias("mae"), "n")


def two_factors(t: Tables) -> DataFrame:
    """Principal components of two columns; signs are arbitrary."""
    out = features.pca_factors(two_groups(t).select("p_partkey", "size", F.col("y").alias("label")), ["size", "label"], 2)
    return out.select("p_partkey", F.round(F.abs("t_F1"), 6).alias("f1"), F.round(F.abs("t_F2"), 6).alias("f2"))


def far_groups(t: Tables) -> DataFrame:
    """Parts in five groups a long way from each other."""
    return t.part.select("p_partkey", (F.col("p_partkey") % 5 * 1000.0 + F.col("p_retailprice")).alias("at"), (F.col("p_partkey") % 5 * 1.0).alias("also"))


def far_representatives(t: Tables) -> DataFrame:
    """The part nearest the mean of each group."""
    return sampling.representatives(far_groups(t), "p_partkey", ["at"], 5).select("p_partkey")


def spread_and_far(t: Tables) -> DataFrame:
    """Representatives and a threshold walk, half of the rows each."""
    return sampling.spread_and_representatives(far_groups(t), "p_partkey", ["at"], "at", 10)


def loops(t: Tables) -> DataFrame:
    """A plan for each nation with an iteration of three steps inside, written as text and parsed."""
    k = F.col("n_nationkey").cast("string")
    step = lambda i, before: F.concat(
        F.lit(f'{{"id": {i}, "pact": "Map", "parallelism": "'), k, F.lit(f'", "predecessors": [{before}]}}'))
    link = lambda i: f'{{"id": {i}, "ship_strategy": "Forward"}}'
    text = F.concat(
        F.lit('{"netRunTime": 1, "executionPlan": {"nodes": [{"id": 1, "type": "source", "pact": "Data Source", "parallelism": "1"}, '
              '{"id": 9, "type": "bulk_iteration", "pact": "Bulk Iteration", "parallelism": "1", "predecessors": [' + link(1) + '], "step_function": ['),
        step(10, ""), F.lit(", "), step(11, link(10)), F.lit(", "), step(12, link(11) + ", " + link(10)),
        F.lit('], "partial_solution": 10, "next_partial_solution": 12}]}}'),
    )
    plans = t.nation.select(F.col("n_nationkey").alias("plan_id"), text.alias("value"))
    return documents.plan_nodes(documents.parse_plans(plans))


def loop_nodes(t: Tables) -> DataFrame:
    return graphs.iteration_nodes(loops(t)).select("plan_id", "id", "pact", F.col("parallelism").cast("int").alias("parallelism"))


def loop_edges(t: Tables) -> DataFrame:
    return graphs.iteration_edges(loops(t))


_MEANS = "m AS (SELECT mark, AVG(y) AS p FROM train GROUP BY 1)"
_QUANTILES = _weighted_sql("SELECT mark, y AS v, 1 AS w, p_partkey AS id FROM train", "mark", [25, 50, 75]).replace(", 6)", ", 8)")


def _quantile_rows_sql() -> str:
    inner = _QUANTILES[_QUANTILES.index("WITH r AS") + 5 :]
    ctes, last = inner[: inner.rindex("SELECT mark")], inner[inner.rindex("SELECT mark") :]
    rows = " UNION ALL ".join(f"SELECT p_partkey, {q}.0::DOUBLE AS q, q{q} AS value FROM test JOIN w USING (mark)" for q in (25, 50, 75))
    return f"WITH {TWO}, {ctes.rstrip()}, w AS ({last}) {rows}"


def _line_sql(train: str, test: str) -> str:
    """Scores of the least-squares line learned on one set of rows and put to another."""
    return (
        f"SELECT 1.0::DOUBLE - AVG(pow(y - (b + a * size), 2)) / VAR_POP(y) AS r2, AVG(pow(y - (b + a * size), 2)) AS mse, "
        f"AVG(ABS(y - (b + a * size))) AS mae, COUNT(*) AS n FROM {test}, (SELECT regr_slope(y, size) AS a, regr_intercept(y, size) AS b FROM {train}) l"
    )


_U = SPLIT.format(key="p_partkey")
_LOG = f"""{TWO}, o AS (SELECT p_partkey, size, mark, ln(y) AS y, ROUND(ln(y), 1) AS forecast FROM g),
    small AS (SELECT mark, AVG(y) AS p, AVG(forecast) AS f FROM o WHERE size <= 25 GROUP BY 1)"""
_FAR = "f AS (SELECT p_partkey, p_partkey % 5 AS c, p_partkey % 5 * 1000.0::DOUBLE + p_retailprice AS x FROM part)"

QUERIES = {
    "group_means": (
        q(group_means), f"WITH {TWO}, {_MEANS} SELECT p_partkey, ROUND(p, 8) AS tree, ROUND(p, 8) AS forest FROM test JOIN m USING (mark)",
    ),
    "group_quantiles_tree": (q(lambda t: group_quantiles(t, 0)), _quantile_rows_sql()),
    "group_quantiles_forest": (q(lambda t: group_quantiles(t, 3)), _quantile_rows_sql()),
    "group_spread": (
        q(group_spread),
        f"WITH {TWO}, s AS (SELECT mark, AVG(y) AS mean, STDDEV_POP(y) AS std FROM train GROUP BY 1) SELECT p_partkey, ROUND(mean, 7) AS mean, ROUND(std, 7) AS std FROM test JOIN s USING (mark)",
    ),
    "widest_intervals": (
        q(widest_intervals),
        f"""WITH i AS (PIVOT ({_quantile_rows_sql()}) ON q IN (25.0 AS lo, 50.0 AS mid, 75.0 AS hi) USING MAX(value) GROUP BY p_partkey), {TWO}, {_MEANS},
            c AS (SELECT *, hi - lo AS width FROM i JOIN g USING (p_partkey) JOIN m USING (mark))
            SELECT p_partkey, ROUND(width, 7) AS width, ROUND(lo - (hi + lo) / 2, 7) AS low_centred, ROUND(hi - (hi + lo) / 2, 7) AS high_centred,
                   ROUND(p - (hi + lo) / 2, 7) AS pred_centred FROM c WHERE width > (SELECT quantile_cont(width, 0.95) FROM c)""",
    ),
    "group_importances": (q(group_importances), "SELECT * FROM (VALUES ('mark', 1.0::DOUBLE), ('zero', 0.0::DOUBLE)) v(feature, importance)"),
    "simple_regression": (
        q(simple_regression),
        f"""WITH {TWO}, s AS (SELECT COUNT(*)::DOUBLE AS n, SUM(size) AS sx, SUM(size * size) AS sxx, regr_slope(y, size) AS a, regr_intercept(y, size) AS b FROM g),
            d AS (SELECT *, n * sxx - sx * sx AS det FROM s),
            w AS (SELECT size, pow((y - b - a * size) / (1 - (sxx - 2 * size * sx + n * size * size) / det), 2) AS w FROM g, d),
            m AS (SELECT SUM(w) AS m0, SUM(w * size) AS m1, SUM(w * size * size) AS m2 FROM w),
            e AS (SELECT a, b, sqrt(sxx * sxx * m0 - 2 * sxx * sx * m1 + sx * sx * m2) / det AS eb, sqrt(sx * sx * m0 - 2 * n * sx * m1 + n * n * m2) / det AS ea FROM d, m)
            SELECT 'one' AS feature, ROUND(b, 6) AS coefficient, ROUND(eb, 6) AS std_error, ROUND(b / eb, 6) AS z FROM e
            UNION ALL SELECT 'size', ROUND(a, 6), ROUND(ea, 6), ROUND(a / ea, 6) FROM e""",
    ),
    "straight_ridge": (
        q(straight_ridge),
        f"""WITH {TWO}, l AS (SELECT AVG(size) AS mx, AVG(y) AS my, regr_sxy(y, size) / (regr_sxx(y, size) + 2.5) AS b FROM train)
            SELECT p_partkey, ROUND(my + b * (size - mx), 8) AS prediction FROM test, l""",
    ),
    "straight_prefixes": (
        q(straight_prefixes),
        f"WITH {TWO}, r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY {RANK.format(key='p_partkey')}, p_partkey) AS place FROM g) "
        + " UNION ALL ".join(
            f"""SELECT {n} AS size, ROUND(1.0::DOUBLE - AVG(pow(r.y - (my + b * (r.size - mx)), 2)) / VAR_POP(r.y), 8) AS r2, COUNT(*) AS n FROM r,
                (SELECT AVG(size) AS mx, AVG(y) AS my, regr_sxy(y, size) / (regr_sxx(y, size) + 1.0) AS b FROM r WHERE place <= {n}) l WHERE place > {n}"""
            for n in (50, 150)
        ),
    ),
    "line_scores": (
        q(line_scores),
        f"WITH {TWO} SELECT ROUND(r2, 6) AS r2, ROUND(mse, 6) AS mse, ROUND(mae, 6) AS mae, n FROM ({_line_sql('train', 'test')}) x",
    ),
    "line_curve": (
        q(line_curve),
        f"WITH {TWO} " + " UNION ALL ".join(
            f"SELECT {s}::DOUBLE AS train_share, ROUND(r2, 6) AS r2, ROUND(mse, 6) AS mse, n FROM ({_line_sql(f'(SELECT * FROM g WHERE {_U} < {s}) i', f'(SELECT * FROM g WHERE {_U} >= {s}) o')}) x"
            for s in (0.3, 0.6)
        ),
    ),
    "line_sweep": (
        q(line_sweep),
        f"WITH {TWO}, h AS (SELECT * FROM g WHERE y < (SELECT quantile_cont(y, 0.99) FROM g)) " + " UNION ALL ".join(
            f"SELECT 'linear' AS model, 'y' AS label, {cut} AS outliers_removed, 0.5::DOUBLE AS train_share, ROUND(r2, 6) AS score FROM ({_line_sql(f'(SELECT * FROM {of} WHERE {_U} < 0.5) i', f'(SELECT * FROM {of} WHERE {_U} >= 0.5) o')}) x"
            for cut, of in (("FALSE", "g"), ("TRUE", "h"))
        ),
    ),
    "separated_classes": (
        q(separated_classes),
        f"WITH {TWO} SELECT mark::INT AS class, COUNT(*) AS support, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1 FROM test GROUP BY 1",
    ),
    "moved_workload": (
        q(moved_workload),
        f"""WITH {_LOG} SELECT ROUND(1.0::DOUBLE - AVG(pow(y - p, 2)) / VAR_POP(y), 8) AS r2, ROUND(AVG(pow(y - p, 2)), 8) AS mse, ROUND(AVG(ABS(y - p)), 8) AS mae, COUNT(*) AS n
            FROM o JOIN small USING (mark) WHERE size > 25""",
    ),
    "two_label_sources": (
        q(two_label_sources),
        f"WITH {_LOG} " + " UNION ALL ".join(
            f"""SELECT '{name}' AS trained_on, ROUND(1.0::DOUBLE - AVG(pow(exp(y) - exp({c}), 2)) / VAR_POP(exp(y)), 8) AS r2, ROUND(AVG(ABS(exp(y) - exp({c}))), 6) AS mae, COUNT(*) AS n
                FROM o JOIN small USING (mark) WHERE size > 25"""
            for name, c in (("forecast", "f"), ("true", "p"))
        ),
    ),
    "two_factors": (
        q(two_factors),
        f"""WITH {TWO}, c AS (SELECT VAR_SAMP(size) AS a, COVAR_SAMP(size, y) AS b, VAR_SAMP(y) AS d, AVG(size) AS mx, AVG(y) AS my FROM g),
            e AS (SELECT *, (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b) AS l FROM c),
            v AS (SELECT *, b / sqrt(b * b + pow(l - a, 2)) AS vx, (l - a) / sqrt(b * b + pow(l - a, 2)) AS vy FROM e)
            SELECT p_partkey, ROUND(ABS((size - mx) * vx + (y - my) * vy), 6) AS f1, ROUND(ABS((y - my) * vx - (size - mx) * vy), 6) AS f2 FROM g, v""",
    ),
    "far_representatives": (
        q(far_representatives),
        f"""WITH {_FAR}, m AS (SELECT c, AVG(x) AS m FROM f GROUP BY 1)
            SELECT p_partkey FROM f JOIN m USING (c) QUALIFY ROW_NUMBER() OVER (PARTITION BY c ORDER BY pow(x - m, 2), p_partkey) = 1""",
    ),
    "spread_and_far": (
        q(spread_and_far),
        f"""WITH {_FAR}, m AS (SELECT c, AVG(x) AS m FROM f GROUP BY 1),
            n AS (SELECT p_partkey FROM f JOIN m USING (c) QUALIFY ROW_NUMBER() OVER (PARTITION BY c ORDER BY pow(x - m, 2), p_partkey) = 1)
            SELECT p_partkey FROM n UNION SELECT id FROM ({_walk_sql('SELECT 1 AS g, p_partkey AS id, p_partkey % 5 * 1000.0::DOUBLE + p_retailprice AS v FROM part', '5')}) x""",
    ),
    "loop_nodes": (
        q(loop_nodes),
        "SELECT n_nationkey AS plan_id, id, 'Map' AS pact, n_nationkey AS parallelism FROM nation, (VALUES (10), (11), (12)) v(id)",
    ),
    "loop_edges": (
        q(loop_edges),
        "SELECT n_nationkey AS plan_id, src, dst FROM nation, (VALUES (10, 11), (11, 12), (10, 12), (12, 10), (12, 9)) v(src, dst)",
    ),
}
