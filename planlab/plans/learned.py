"""Registered queries: scores, models, label completion, result statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlab.operators import active, evaluate, features, forest, sampling
from planlab.plans.basics import q
from planlab.plans.featured import rounded
from planlab.plans.sampled import SPLIT, part_features
from planlab.session import stored
from planlab.sources.tables import Tables

COLUMNS = ["quantity", "discount", "tax", "lines", "orders", "returned"]


def predicted_prices(t: Tables) -> DataFrame:
    """Log prices with the mean of the priority as prediction."""
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", F.log("o_totalprice").alias("y"))
    means = rows.groupBy("o_orderpriority").agg(F.avg("y").alias("p"))
    return rows.join(means, "o_orderpriority")


PREDICTED = """r AS (SELECT o_orderkey, o_orderstatus, ln(o_totalprice) AS y, AVG(ln(o_totalprice)) OVER (PARTITION BY o_orderpriority) AS p FROM orders)"""


def _scores_sql(y: str, p: str) -> str:
    return (
        f"ROUND(1.0::DOUBLE - AVG(pow({y} - {p}, 2)) / VAR_POP({y}), 8) AS r2, ROUND(AVG(pow({y} - {p}, 2)), {{d}}) AS mse, "
        f"ROUND(2.0::DOUBLE * AVG({y} * ln({y} / {p}) - {y} + {p}), {{d}}) AS poisson_deviance, "
        f"ROUND(2.0::DOUBLE * AVG(ln({p} / {y}) + {y} / {p} - 1.0::DOUBLE), 8) AS gamma_deviance, "
        f"ROUND(AVG(ABS({y} - {p})), {{d}}) AS mae, COUNT(*) AS n"
    )


def holdout_scores(t: Tables) -> DataFrame:
    out = evaluate.scores_both_scales(predicted_prices(t), "y", "p", ["o_orderstatus"])
    digits = F.when(F.col("scale") == "log", 8).otherwise(1)
    small = {c: F.round(c, 8) for c in ("r2", "gamma_deviance")}
    big = {
        c: F.when(digits == 8, F.round(c, 8)).otherwise(F.round(c, 1)) for c in ("poisson_deviance", "mae")
    }
    # squared prices are around 1e10, so their mean keeps fewer digits
    big["mse"] = F.when(digits == 8, F.round("mse", 8)).otherwise(F.round(F.col("mse") / 1e6, 1))
    return out.withColumns(small | big)


HOLDOUT_SQL = f"""WITH {PREDICTED}
    SELECT o_orderstatus, {_scores_sql('y', 'p').format(d=8)}, 'log' AS scale FROM r GROUP BY 1
    UNION ALL SELECT o_orderstatus, {_scores_sql('exp(y)', 'exp(p)').format(d=1).replace('AVG(pow(exp(y) - exp(p), 2)), 1)', 'AVG(pow(exp(y) - exp(p), 2)) / 1e6, 1)')}, 'exp' AS scale FROM r GROUP BY 1"""


def _mean_model(train: DataFrame, test: DataFrame) -> DataFrame:
    means = train.groupBy("o_orderpriority").agg(F.avg("y").alias("prediction"))
    return test.join(means, "o_orderpriority")


def fold_scores(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderpriority", F.log("o_totalprice").alias("y"))
    out = evaluate.cross_validate(rows, "o_orderkey", "y", _mean_model, 3).where("scale = 'log'")
    return rounded(out.select("fold", "mse", "r2", "n"), 8)


def fold_summary(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderpriority", F.log("o_totalprice").alias("y"))
    out = evaluate.fold_summary(evaluate.cross_validate(rows, "o_orderkey", "y", _mean_model, 3))
    return rounded(out.where("scale = 'log'").select("scale", "r2_mean", "r2_std", "mse_mean", "mse_std"), 8)


FOLDS_SQL = """n AS (SELECT o_orderkey, o_orderpriority, ln(o_totalprice) AS y, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS i, COUNT(*) OVER () AS n FROM orders),
    f AS (SELECT *, (CASE WHEN i < (n // 3 + 1) * (n % 3) THEN i // (n // 3 + 1) ELSE n % 3 + (i - (n // 3 + 1) * (n % 3)) // (n // 3) END)::INT AS fold FROM n),
    m AS (SELECT k.fold, o_orderpriority, AVG(y) AS p FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold GROUP BY 1, 2),
    s AS (SELECT f.fold, AVG(pow(y - p, 2)) AS mse, 1.0::DOUBLE - AVG(pow(y - p, 2)) / VAR_POP(y) AS r2, COUNT(*) AS n
          FROM f JOIN m ON f.fold = m.fold AND f.o_orderpriority = m.o_orderpriority GROUP BY 1)"""


def labelled_parts(t: Tables) -> DataFrame:
    """Features of the parts, summed up from their lines once for all that learn from them."""
    return forest.with_vector(stored(part_features(t)), COLUMNS)


def trained(t: Tables):
    """Forest on the hash-split 70 % of the parts; leaves of both sides."""
    train, test = evaluate.split(labelled_parts(t), "l_partkey", 0.7)
    model = forest.fit_forest(train, "price", trees=10, depth=6)
    return model, forest.with_leaves(model, train), forest.with_leaves(model, test)


def forest_mean(t: Tables) -> DataFrame:
    _, _, test = trained(t)
    return test.select("l_partkey", "prediction")


def forest_quantile(t: Tables) -> DataFrame:
    _, train, test = trained(t)
    return forest.quantile_predictions(train, test, "l_partkey", "price", [25, 50, 75])


def forest_bagged_quantile(t: Tables) -> DataFrame:
    _, train, test = trained(t)
    bags = sampling.bootstrap_weights(train, "l_partkey", 10)
    return forest.quantile_predictions(train, test, "l_partkey", "price", [50], bags)


def tree_quantile(t: Tables) -> DataFrame:
    train, test = evaluate.split(labelled_parts(t), "l_partkey", 0.7)
    model = forest.fit_tree(train, "price", depth=4)
    return forest.quantile_predictions(
        forest.with_leaves(model, train), forest.with_leaves(model, test), "l_partkey", "price", [50]
    )


def forest_std(t: Tables) -> DataFrame:
    _, train, test = trained(t)
    return forest.prediction_std(train, test, "l_partkey", "price")


def uncertainty(t: Tables) -> DataFrame:
    _, train, test = trained(t)
    return forest.centred(forest.interval(train, test, "l_partkey", "price")).orderBy("width")


def importances(t: Tables) -> DataFrame:
    model, _, _ = trained(t)
    return forest.importances(model, COLUMNS, t.spark).orderBy(F.desc("importance")).limit(15)


def grid_search(t: Tables) -> DataFrame:
    _, table = evaluate.grid_search(labelled_parts(t), "l_partkey", "price", [5, 10], [3, 6])
    return table


def least_squares(t: Tables) -> DataFrame:
    rows = part_features(t).withColumn("one", F.lit(1.0))
    return evaluate.least_squares_hc3(rows, ["one", "quantity", "lines", "returned"], "price")


def regressors(t: Tables) -> DataFrame:
    train, test = evaluate.split(labelled_parts(t), "l_partkey", 0.7)
    frames = []
    for kind in ("forest", "boosting", "linear"):
        out = evaluate.regressor(kind, "price", trees=5, depth=4).fit(train).transform(test)
        frames.append(evaluate.scores(out, "price", "prediction").select(F.lit(kind).alias("model"), "r2", "mae", "n"))
    return evaluate.stack(frames)


def classifiers(t: Tables) -> DataFrame:
    rows = features.label_bins(labelled_parts(t), "price", 3, "bin").withColumn("bin", F.col("bin").cast("double"))
    train, test = evaluate.split(rows, "l_partkey", 0.7)
    out = evaluate.classifier("forest", "bin", trees=5, depth=4).fit(train).transform(test)
    return evaluate.classification_report(out, "bin")


def classification_report(t: Tables) -> DataFrame:
    """Report of a threshold rule: bins of the price against bins of the number of lines."""
    rows = t.lineitem.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("v"), F.count(F.lit(1)).cast("double").alias("c"))
    rows = features.label_bins(features.label_bins(rows, "v", 3, "y"), "c", 3, "p")
    return rounded(evaluate.classification_report(rows, "y", "p"), 10)


def learning_curve(t: Tables) -> DataFrame:
    model = evaluate.regressor("forest", "price", trees=5, depth=4)
    return evaluate.learning_curve(labelled_parts(t), "l_partkey", "price", model, [0.1, 0.5, 0.9])


def model_sweep(t: Tables) -> DataFrame:
    rows = features.label_bins(labelled_parts(t), "price", 3, "bin3").withColumn("bin3", F.col("bin3").cast("double"))
    rows = rows.withColumn("raw_price", F.exp("price"))
    kinds = {"linear": ["price", "raw_price"], "forest": ["price"], "boosting_class": ["bin3"]}
    return evaluate.sweep(rows, "l_partkey", kinds, [0.5], "price", trees=3)


def poly_ridge(t: Tables) -> DataFrame:
    rows = part_features(t).withColumn("x", F.col("lines") / 30.0)
    return evaluate.prefix_baseline(rows, "l_partkey", "x", "price", [50, 500, 1000])


def label_sources(t: Tables) -> DataFrame:
    _, _, test = trained(t)
    rows = test.withColumnRenamed("prediction", "forecast").drop("leaves")
    a, b = evaluate.split(rows, "l_partkey", 0.85, seed=7)
    return evaluate.compare_label_sources(a, b, "forecast", "price", trees=5)


def workload_transfer(t: Tables) -> DataFrame:
    rows = labelled_parts(t).join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    first = rows.agg(F.min("p_type"))
    mine = F.col("p_type") == first.scalar()
    return evaluate.transfer(rows.where(mine), rows.where(~mine), "price", trees=5)


def split_labelled(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    known, unknown = active.split_labelled(rows, "quality")
    return known.withColumn("side", F.lit("known")).unionByName(unknown.withColumn("side", F.lit("unknown")))


def intervals(t: Tables) -> DataFrame:
    """An interval per event around its log value."""
    half = (F.get_json_object("props", "$.k").cast("int") + 1) / 100.0
    y = F.log1p(F.col("value"))
    return t.events.select(
        "event_id",
        F.dayofmonth("ts").alias("iteration"),
        y.alias("pred"),
        (y - half).alias("low"),
        (y + half).alias("high"),
        (F.get_json_object("props", "$.k").cast("int") * 2.0 + F.col("value")).alias("width"),
    )


def select_uncertain(t: Tables) -> DataFrame:
    return active.select_uncertain(intervals(t)).select("event_id", F.round("width", 4).alias("width"))


def select_random(t: Tables) -> DataFrame:
    return active.select_random(t.orders, "o_orderkey", 200, 42)


def round_uncertainty(t: Tables) -> DataFrame:
    return rounded(evaluate.round_uncertainty(intervals(t)))


def early_stop(t: Tables) -> DataFrame:
    return rounded(evaluate.early_stops(evaluate.round_uncertainty(intervals(t)), threshold=0.02))


def stop_points(t: Tables) -> DataFrame:
    return rounded(evaluate.stop_points(evaluate.round_uncertainty(intervals(t)), threshold=0.02))


def cumulated_cost(t: Tables) -> DataFrame:
    out = evaluate.cumulated_cost(intervals(t), "pred")
    return out.select("iteration", F.round("cost", 4).alias("cost"), "data_size")


def score_ratio(t: Tables) -> DataFrame:
    rows = intervals(t).withColumn("y", F.col("width"))
    a = evaluate.scores(rows, "y", "high", ["iteration"])
    b = evaluate.scores(rows, "y", "low", ["iteration"])
    return rounded(evaluate.score_ratio(a, b), 8)


def reveal_labels(t: Tables) -> DataFrame:
    asked = t.documents.where("n_chars < 500").select("doc_id")
    got, lost = active.reveal(asked, t.labels.select("doc_id", "quality"), "doc_id")
    return got.unionByName(lost.withColumn("quality", F.lit(None).cast("int")))


def latest_per_key(t: Tables) -> DataFrame:
    return active.latest_per_key(t.events.select("user_id", "event_id", "event_type", "ts"), "user_id", "ts").drop("ts")


def pending_keys(t: Tables) -> DataFrame:
    name = F.concat(F.lit("Job"), F.col("l_partkey"), F.lit("v"), F.col("l_linenumber"))
    jobs = t.lineitem.select(name.alias("job")).distinct()
    done = t.lineitem.where("l_returnflag = 'R'").select(name.alias("job")).distinct()
    return active.pending(jobs, done)


def error_summary(t: Tables) -> DataFrame:
    out = evaluate.error_summary(predicted_prices(t), "y", "p")
    return rounded(out.withColumnsRenamed({"25%": "p25", "50%": "p50", "75%": "p75"}), 5)


def highest(t: Tables) -> DataFrame:
    return rounded(evaluate.highest(predicted_prices(t), "y"), 5)


def completion(t: Tables, **options):
    rows = stored(part_features(t))
    truth = rows.select("l_partkey", F.col("price").alias("label"))
    start = sampling.uniform_sample(rows, "l_partkey", "price", 40)
    return active.complete_labels(
        rows.drop("price"), "l_partkey", COLUMNS, truth, start, max_rounds=3, trees=8, depth=5, **options
    )


INTERVALS = """i AS (SELECT event_id, day(ts) AS iteration, ln(1 + value) AS pred, ln(1 + value) - (CAST(props->>'k' AS INT) + 1) / 100.0::DOUBLE AS low,
    ln(1 + value) + (CAST(props->>'k' AS INT) + 1) / 100.0::DOUBLE AS high, CAST(props->>'k' AS INT) * 2.0::DOUBLE + value AS width FROM events)"""
ROUNDS = f"""{INTERVALS}, u AS (SELECT iteration, AVG(exp(high) - exp(low)) AS uncertainty, STDDEV_POP(exp(high) - exp(low)) AS uncertainty_std FROM i GROUP BY 1),
    s AS (SELECT *, uncertainty / LAG(uncertainty) OVER (ORDER BY iteration) AS ratio,
                 MIN(uncertainty) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM u),
    e AS (SELECT *, COALESCE(ratio <= 1 AND 1 - ratio >= 0.02, FALSE) AS stop FROM s)"""
_ROUND_COLUMNS = "iteration, ROUND(uncertainty, 6) AS uncertainty, ROUND(uncertainty_std, 6) AS uncertainty_std, ROUND(ratio, 6) AS ratio"

QUERIES = {
    "holdout_scores": (q(holdout_scores), HOLDOUT_SQL),
    "fold_scores": (
        q(fold_scores),
        f"WITH {FOLDS_SQL} SELECT fold, ROUND(mse, 8) AS mse, ROUND(r2, 8) AS r2, n FROM s",
    ),
    "fold_summary": (
        q(fold_summary),
        f"""WITH {FOLDS_SQL} SELECT 'log' AS scale, ROUND(AVG(greatest(r2, 0)), 8) AS r2_mean, ROUND(STDDEV_POP(greatest(r2, 0)), 8) AS r2_std,
            ROUND(AVG(mse), 8) AS mse_mean, ROUND(STDDEV_POP(mse), 8) AS mse_std FROM s""",
    ),
    "forest_mean": (q(forest_mean), None),
    "forest_quantile": (q(forest_quantile), None),
    "forest_bagged_quantile": (q(forest_bagged_quantile), None),
    "tree_quantile": (q(tree_quantile), None),
    "forest_std": (q(forest_std), None),
    "uncertainty": (q(uncertainty), None),
    "importances": (q(importances), None),
    "grid_search": (q(grid_search), None),
    "least_squares": (q(least_squares), None),
    "regressors": (q(regressors), None),
    "classifiers": (q(classifiers), None),
    "classification_report": (
        q(classification_report),
        """WITH a AS (SELECT l_partkey, SUM(l_extendedprice) AS v, COUNT(*)::DOUBLE AS c FROM lineitem GROUP BY 1),
            x AS (SELECT quantile_cont(v, 1.0::DOUBLE / 3) AS v1, quantile_cont(v, 2.0::DOUBLE / 3) AS v2,
                         quantile_cont(c, 1.0::DOUBLE / 3) AS c1, quantile_cont(c, 2.0::DOUBLE / 3) AS c2 FROM a),
            b AS (SELECT (CASE WHEN v >= v2 THEN 2 WHEN v >= v1 THEN 1 ELSE 0 END) AS y,
                         (CASE WHEN c >= c2 THEN 2 WHEN c >= c1 THEN 1 ELSE 0 END) AS p FROM a, x)
            SELECT k AS class, COUNT(*) FILTER (WHERE y = k) AS support,
                   ROUND(COUNT(*) FILTER (WHERE y = k AND p = k) / NULLIF(COUNT(*) FILTER (WHERE p = k), 0), 10) AS precision,
                   ROUND(COUNT(*) FILTER (WHERE y = k AND p = k) / COUNT(*) FILTER (WHERE y = k), 10) AS recall,
                   ROUND(2.0 * COUNT(*) FILTER (WHERE y = k AND p = k) / (COUNT(*) FILTER (WHERE p = k) + COUNT(*) FILTER (WHERE y = k)), 10) AS f1
            FROM b, (SELECT unnest([0, 1, 2]) AS k) c GROUP BY k""",
    ),
    "learning_curve": (q(learning_curve), None),
    "model_sweep": (q(model_sweep), None),
    "poly_ridge": (q(poly_ridge), None),
    "label_sources": (q(label_sources), None),
    "workload_transfer": (q(workload_transfer), None),
    "split_labelled": (
        q(split_labelled),
        """SELECT d.doc_id, n_chars, quality, CASE WHEN quality IS NULL THEN 'unknown' ELSE 'known' END AS side
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "select_uncertain": (
        q(select_uncertain),
        f"WITH {INTERVALS} SELECT event_id, ROUND(width, 4) AS width FROM i WHERE width > (SELECT quantile_cont(width, 0.95) FROM i)",
    ),
    "select_random": (
        q(select_random),
        f"""WITH o AS (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS place, COUNT(*) OVER () AS n FROM orders)
            SELECT turn, o_orderkey FROM range(200) r(turn) JOIN o ON place = floor({SPLIT.format(key='turn')} * n) + 1""",
    ),
    "round_uncertainty": (
        q(round_uncertainty),
        f"WITH {ROUNDS} SELECT iteration, ROUND(uncertainty, 6) AS uncertainty, ROUND(uncertainty_std, 6) AS uncertainty_std FROM u",
    ),
    "early_stop": (q(early_stop), f"WITH {ROUNDS} SELECT {_ROUND_COLUMNS}, stop FROM e"),
    "stop_points": (
        q(stop_points),
        f"WITH {ROUNDS} SELECT {_ROUND_COLUMNS}, stop FROM e WHERE stop AND uncertainty <= least",
    ),
    "cumulated_cost": (
        q(cumulated_cost),
        f"""WITH {INTERVALS} SELECT iteration, ROUND(SUM(SUM(exp(pred))) OVER (ORDER BY iteration), 4) AS cost,
            SUM(COUNT(*)) OVER (ORDER BY iteration) AS data_size FROM i GROUP BY 1""",
    ),
    "score_ratio": (
        q(score_ratio),
        f"""WITH {INTERVALS}, s AS (SELECT iteration, 1.0::DOUBLE - AVG(pow(width - high, 2)) / VAR_POP(width) AS r2_a,
                1.0::DOUBLE - AVG(pow(width - low, 2)) / VAR_POP(width) AS r2_b FROM i GROUP BY 1)
            SELECT iteration, ROUND(r2_a, 8) AS r2_a, ROUND(r2_b, 8) AS r2_b, ROUND(r2_a / r2_b, 8) AS ratio FROM s""",
    ),
    "reveal_labels": (
        q(reveal_labels),
        "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE n_chars < 500",
    ),
    "latest_per_key": (
        q(latest_per_key),
        """SELECT user_id, event_id, event_type FROM events
           QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    ),
    "pending_keys": (
        q(pending_keys),
        """SELECT 'Job' || l_partkey || 'v' || l_linenumber AS job, l_partkey AS job_no, l_linenumber::BIGINT AS version_no
           FROM lineitem GROUP BY l_partkey, l_linenumber HAVING COUNT(*) FILTER (WHERE l_returnflag = 'R') = 0""",
    ),
    "error_summary": (
        q(error_summary),
        f"""WITH {PREDICTED}, x AS (SELECT 'true' AS what, exp(y) / 1000 AS s FROM r UNION ALL SELECT 'error', ABS(exp(y) - exp(p)) / 1000 FROM r)
            SELECT what, COUNT(*) AS count, ROUND(AVG(s), 5) AS mean, ROUND(STDDEV_SAMP(s), 5) AS std, ROUND(MIN(s), 5) AS min,
                   ROUND(MAX(s), 5) AS max, ROUND(quantile_cont(s, 0.25), 5) AS p25, ROUND(quantile_cont(s, 0.5), 5) AS p50,
                   ROUND(quantile_cont(s, 0.75), 5) AS p75 FROM x GROUP BY 1""",
    ),
    "highest": (
        q(highest),
        f"WITH {PREDICTED} SELECT ROUND(exp(y) / 1000, 5) AS seconds FROM r ORDER BY y DESC LIMIT 5",
    ),
    "trim_for_display": (
        q(lambda t: features.trim_upper(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 0.97)),
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < (SELECT quantile_cont(o_totalprice, 0.97) FROM orders)",
    ),
    "complete_labels": (q(lambda t: completion(t).final), None),
    "completion_rounds": (q(lambda t: completion(t, random_choice=True).rounds), None),
}
