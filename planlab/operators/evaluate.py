"""Scores, folds, model comparisons and result statistics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlab.functions.scalars import draw
from planlab.operators import forest, ordered
from planlab.operators.relational import stack
from planlab.session import stored

# The grid the forests are searched over.
GRID_TREES = [10, 50, 100, 200, 500]
GRID_DEPTHS = [10, 50, 100, 200, 500]


def score_columns(y: str | Column, p: str | Column) -> list[Column]:
    """r2, mean squared error, Poisson and gamma deviance as aggregates."""
    y = F.col(y) if isinstance(y, str) else y
    p = F.col(p) if isinstance(p, str) else p
    squared = (y - p) * (y - p)
    log_ratio = F.when(y == 0, F.lit(0.0)).otherwise(y * F.log(y / p))
    spread = F.var_pop(y)
    return [
        (1.0 - F.try_divide(F.avg(squared), spread)).alias("r2"),
        F.avg(squared).alias("mse"),
        (2.0 * F.avg(log_ratio - y + p)).alias("poisson_deviance"),
        (2.0 * F.avg(F.log(p / y) + y / p - 1.0)).alias("gamma_deviance"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.count(F.lit(1)).alias("n"),
    ]


def scores(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Holdout scores on the given scale, one row per group."""
    return df.groupBy(*(by or [])).agg(*score_columns(y, p))


def scores_both_scales(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Scores of log labels on the log scale and after ``exp``: column ``scale``."""
    plain = df.groupBy(*(by or [])).agg(*score_columns(y, p)).withColumn("scale", F.lit("log"))
    back = df.groupBy(*(by or [])).agg(*score_columns(F.exp(F.col(y)), F.exp(F.col(p))))
    return plain.unionByName(back.withColumn("scale", F.lit("exp")))


def with_folds(df: DataFrame, row_id: str, k: int, out: str = "fold") -> DataFrame:
    """Contiguous folds by id order; the first ``n % k`` folds hold one row more."""
    placed = ordered.row_numbers(df, [], [row_id], "__rn")
    n = df.agg(F.count(F.lit(1)))
    placed = placed.withColumn("__n", n.scalar())
    small = F.floor(F.col("__n") / k)
    extra = F.col("__n") % k
    at = F.col("__rn") - 1
    head = (small + 1) * extra
    fold = F.when(at < head, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - head) / small))
    return placed.withColumn(out, fold.cast("int")).drop("__rn", "__n")


def cross_validate(
    df: DataFrame, row_id: str, label: str, fit_predict: Callable[[DataFrame, DataFrame], DataFrame], k: int = 3
) -> DataFrame:
    """Scores per fold on both scales. ``fit_predict(train, test)`` adds ``prediction`` to test."""
    folded = with_folds(df, row_id, k)
    frames = []
    for fold in range(k):
        predicted = fit_predict(folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold))
        frames.append(predicted.select(F.lit(fold).alias("fold"), F.col(label).alias("y"), "prediction"))
    return scores_both_scales(stack(frames), "y", "prediction", ["fold"])


def fold_summary(fold_scores: DataFrame) -> DataFrame:
    """Mean and population deviation over folds; negative r2 counts as 0, and a fold of one row
    has no r2."""
    r2 = F.when(F.col("n") > 1, F.greatest(F.col("r2"), F.lit(0.0)))
    cells = [F.avg(r2).alias("r2_mean"), F.stddev_pop(r2).alias("r2_std")]
    for name in ("mse", "poisson_deviance", "gamma_deviance"):
        cells += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std")]
    return fold_scores.groupBy("scale").agg(*cells)


def grid(trees=None, depths=None) -> list[tuple[int, int]]:
    """Grid points with depths held to what MLlib grows, each once."""
    pairs = [(t, min(d, forest.MAX_DEPTH)) for t in (trees or GRID_TREES) for d in (depths or GRID_DEPTHS)]
    return list(dict.fromkeys(pairs))


def grid_search(df: DataFrame, row_id: str, label: str, trees=None, depths=None, folds: int = 3, seed: int = 42):
    """Best forest by mean fold MSE: the fitted model and one score row per grid point.

    Folds are contiguous by id. Grid points share the cached fold table and are fitted in
    parallel by the cross validator.
    """
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator

    points = grid(trees, depths)
    learner = RandomForestRegressor(
        featuresCol="features", labelCol=label, featureSubsetStrategy="all", seed=seed, leafCol="leaf"
    )
    maps = [{learner.numTrees: t, learner.maxDepth: d} for t, d in points]
    validator = CrossValidator(
        estimator=learner,
        estimatorParamMaps=maps,
        evaluator=RegressionEvaluator(labelCol=label, metricName="mse"),
        numFolds=folds,
        foldCol="fold",
        parallelism=4,
    )
    fitted = validator.fit(with_folds(df, row_id, folds))
    rows = [(t, d, float(m)) for (t, d), m in zip(points, fitted.avgMetrics)]
    table = df.sparkSession.createDataFrame(rows, "trees int, depth int, mse double")
    return fitted.bestModel, table


def least_squares_hc3(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Linear regression without intercept, with HC3 standard errors.

    Two passes of plain sums: the gram matrix, then leverages and residuals. Only matrices of
    the number of columns reach the driver.
    """
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    c = [F.col(x).cast("double") for x in columns]
    y = F.col(label).cast("double")
    first = df.agg(*[F.sum(c[i] * c[j]) for i, j in pairs], *[F.sum(x * y) for x in c], F.count(F.lit(1))).first()
    gram = np.zeros((d, d))
    for (i, j), v in zip(pairs, first[: len(pairs)]):
        gram[i, j] = gram[j, i] = v
    inverse = np.linalg.inv(gram)
    beta = inverse @ np.array(first[len(pairs) : len(pairs) + d], dtype=float)
    fitted = sum(float(b) * x for b, x in zip(beta, c))
    leverage = sum(float(inverse[i, j]) * c[i] * c[j] * (1.0 if i == j else 2.0) for i, j in pairs)
    weight = (y - fitted) * (y - fitted) / ((1.0 - leverage) * (1.0 - leverage))
    second = df.agg(*[F.sum(c[i] * c[j] * weight) for i, j in pairs]).first()
    meat = np.zeros((d, d))
    for (i, j), v in zip(pairs, second):
        meat[i, j] = meat[j, i] = v
    errors = np.sqrt(np.diag(inverse @ meat @ inverse))
    rows = [(n, float(b), float(e), float(b / e)) for n, b, e in zip(columns, beta, errors)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, std_error double, z double")


def regressor(kind: str, label: str, trees: int = 20, depth: int = 5, seed: int = 42):
    """Named MLlib regressor."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    if kind == "forest":
        return RandomForestRegressor(
            featuresCol="features", labelCol=label, numTrees=trees, maxDepth=min(depth, forest.MAX_DEPTH), seed=seed
        )
    if kind == "boosting":
        return GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)
    if kind == "linear":
        return LinearRegression(featuresCol="features", labelCol=label)
    raise KeyError(kind)


def classifier(kind: str, label: str, trees: int = 20, depth: int = 5, seed: int = 42):
    """Named MLlib classifier; boosting is two-class there, so it runs one against the rest."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier

    if kind == "forest":
        return RandomForestClassifier(
            featuresCol="features", labelCol=label, numTrees=trees, maxDepth=min(depth, forest.MAX_DEPTH), seed=seed
        )
    if kind == "boosting":
        base = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed)
        return OneVsRest(classifier=base, featuresCol="features", labelCol=label)
    raise KeyError(kind)


def classification_report(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Precision, recall and F1 per class from one confusion count."""
    confusion = df.groupBy(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said")),
    )
    right = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    cells = confusion.select(F.explode(sides).alias("s"), right.alias("hit"))
    out = cells.groupBy("s.class").agg(
        F.sum("s.support").alias("support"), F.sum("s.said").alias("said"), (F.sum("hit") / 2).alias("hit")
    )
    precision = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return out.select(
        "class",
        "support",
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("hit"), F.col("said") + F.col("support")), F.lit(0.0)).alias("f1"),
    )


def macro_f1(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    return classification_report(df, label, prediction).agg(F.avg("f1").alias("macro_f1"))


def split(df: DataFrame, row_id: str, train_share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test by a hash threshold; training rows of a share contain those of smaller ones."""
    u = draw(F.lit(seed), F.col(row_id))
    return df.where(u < train_share), df.where(u >= train_share)


def learning_curve(df: DataFrame, row_id: str, label: str, model, shares: list[float]) -> DataFrame:
    """One score row per training share."""
    frames = []
    for share in shares:
        train, test = split(df, row_id, share)
        predicted = model.fit(train).transform(test)
        frames.append(scores(predicted, label, "prediction").withColumn("train_share", F.lit(share)))
    return stack(frames)


def sweep(
    df: DataFrame, row_id: str, labels: dict[str, list[str]], shares: list[float], trim: str | None = None, trees: int = 10
) -> DataFrame:
    """Score of every model kind x label x outlier flag x training share, one row each.

    ``labels`` maps a model kind (``forest``, ``boosting``, ``linear``, and with ``_class`` the
    classifiers) to its label columns. Regressors score r2, classifiers macro F1.
    """
    from planlab.operators.features import trim_upper

    frames = []
    versions = {False: stored(df)}  # every fit passes over its rows several times
    if trim is not None:
        versions[True] = stored(trim_upper(versions[False], trim))
    for kind, columns in labels.items():
        for label in columns:
            for trimmed, rows in versions.items():
                for share in shares:
                    train, test = split(rows, row_id, share)
                    if kind.endswith("_class"):
                        out = classifier(kind.removesuffix("_class"), label, trees).fit(train).transform(test)
                        score = macro_f1(out, label).select(F.col("macro_f1").alias("score"))
                    else:
                        out = regressor(kind, label, trees).fit(train).transform(test)
                        score = scores(out, label, "prediction").select(F.col("r2").alias("score"))
                    frames.append(
                        score.select(
                            F.lit(kind).alias("model"),
                            F.lit(label).alias("label"),
                            F.lit(trimmed).alias("outliers_removed"),
                            F.lit(share).alias("train_share"),
                            "score",
                        )
                    )
    return stack(frames)


def polynomial_ridge(train: DataFrame, test: DataFrame, feature: str, label: str, degree: int = 5, alpha: float = 1.0) -> DataFrame:
    """Polynomial ridge baseline on one feature; adds ``prediction`` to test.

    Least squares on the centred powers plus ``alpha`` times the squared coefficients, intercept unpenalised. Two
    passes of plain sums, the means and then the centred products, so only a matrix of the degree reaches the
    driver. Rows without feature or label are left out; without any the prediction is null.
    """

    def powers() -> list[Column]:
        return [F.pow(F.col(feature).cast("double"), F.lit(float(i))) for i in range(1, degree + 1)]

    known = train.where(F.col(feature).isNotNull() & F.col(label).isNotNull())
    y = F.col(label).cast("double")
    means = known.agg(*[F.avg(p) for p in powers()], F.avg(y)).first()
    if means[degree] is None:
        return test.withColumn("prediction", F.lit(None).cast("double"))
    gaps = [p - float(m) for p, m in zip([*powers(), y], means)]
    pairs = [(i, j) for i in range(degree) for j in range(i, degree + 1)]
    gram = np.zeros((degree, degree + 1))
    for (i, j), v in zip(pairs, known.agg(*[F.sum(gaps[i] * gaps[j]) for i, j in pairs]).first()):
        gram[i, j] = v
        if j < degree:
            gram[j, i] = v
    system = gram[:, :degree] + alpha * np.eye(degree)
    scale = 1 / np.sqrt(np.diag(system))  # powers differ by many orders of magnitude
    beta = scale * np.linalg.lstsq(system * np.outer(scale, scale), scale * gram[:, degree], rcond=None)[0]
    terms = [float(b) * (p - float(m)) for b, p, m in zip(beta, powers(), means)]
    return test.withColumn("prediction", sum(terms, F.lit(float(means[degree]))))


def prefix_baseline(df: DataFrame, row_id: str, feature: str, label: str, sizes: list[int], degree: int = 5) -> DataFrame:
    """r2 of the polynomial baseline per nested training prefix, the rest as validation."""
    from planlab.operators.sampling import prefix_samples

    ranked = prefix_samples(df, row_id, sizes)
    frames = []
    for size in sizes:
        inside = F.coalesce(F.col("prefix") <= size, F.lit(False))
        out = polynomial_ridge(ranked.where(inside), ranked.where(~inside), feature, label, degree)
        frames.append(scores(out, label, "prediction").select(F.lit(size).alias("size"), "r2", "n"))
    return stack(frames)


def compare_label_sources(
    train: DataFrame, test: DataFrame, forecast: str, true: str, trees: int = 20, depth: int = 10, bootstrap: bool = True
) -> DataFrame:
    """Train on forecast labels and on true labels, score both on held-out true labels (exp scale)."""
    frames = []
    for source, label in (("forecast", forecast), ("true", true)):
        out = forest.fit_forest(train, label, trees, depth, bootstrap=bootstrap).transform(test)
        score = out.groupBy().agg(*score_columns(F.exp(F.col(true)), F.exp(F.col("prediction"))))
        frames.append(score.withColumn("trained_on", F.lit(source)))
    return stack(frames)


def transfer(
    train: DataFrame, test: DataFrame, label: str, trees: int = 20, depth: int = 10, bootstrap: bool = True
) -> DataFrame:
    """Train on one workload, score on another, on both scales."""
    out = forest.fit_forest(train, label, trees, depth, bootstrap=bootstrap).transform(test)
    return scores_both_scales(out, label, "prediction")


def error_summary(df: DataFrame, y: str, p: str) -> DataFrame:
    """Describe true values and absolute errors in seconds: rows ``true`` and ``error``."""
    from planlab.operators.features import describe

    y_ms, p_ms = F.exp(F.col(y)), F.exp(F.col(p))
    cells = F.array(
        F.struct(F.lit("true").alias("what"), (y_ms / 1000).alias("seconds")),
        F.struct(F.lit("error").alias("what"), (F.abs(y_ms - p_ms) / 1000).alias("seconds")),
    )
    return describe(df.select(F.inline(cells)), ["what"], "seconds", [0.25, 0.5, 0.75])


def highest(df: DataFrame, y: str, n: int = 5) -> DataFrame:
    """The ``n`` greatest true values in seconds."""
    return df.select((F.exp(F.col(y)) / 1000).alias("seconds")).orderBy(F.desc("seconds")).limit(n)


def round_uncertainty(intervals: DataFrame, by: str = "iteration") -> DataFrame:
    """Mean and deviation of the interval width on the exp scale, one row per round."""
    width = F.exp(F.col("high")) - F.exp(F.col("low"))
    return intervals.groupBy(by).agg(F.avg(width).alias("uncertainty"), F.stddev_pop(width).alias("uncertainty_std"))


def early_stops(rounds: DataFrame, by: str = "iteration", threshold: float = 0.1) -> DataFrame:
    """Rounds whose uncertainty fell by at least the threshold against the round before.

    One row per round of a loop: the table is as long as the loop ran, so one ordered window
    over all of it is fine.
    """
    order = W.orderBy(by)
    ratio = F.col("uncertainty") / F.lag("uncertainty").over(order)
    return rounds.withColumn("ratio", ratio).withColumn(
        "stop", F.coalesce((F.col("ratio") <= 1) & (1 - F.col("ratio") >= threshold), F.lit(False))
    )


def stop_points(rounds: DataFrame, by: str = "iteration", threshold: float = 0.1) -> DataFrame:
    """Every stop candidate after the fact; also the round must not exceed the least uncertainty
    seen before it. Without any, the last round."""
    order = W.orderBy(by)
    least = F.min("uncertainty").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = early_stops(rounds, by, threshold).withColumn("least", least)
    stops = marked.withColumn("stop", F.col("stop") & (F.col("uncertainty") <= F.col("least")))
    none = F.max(F.col("stop").cast("int")).over(W.partitionBy()) == 0
    last = F.col(by) == F.max(by).over(W.partitionBy())
    return stops.withColumn("__keep", F.col("stop") | (none & last)).where("__keep").drop("__keep", "least")


def cumulated_cost(labels: DataFrame, label: str, by: str = "iteration") -> DataFrame:
    """Cost of the labels known up to each round: running sum of ``exp(label)`` over rounds."""
    per_round = labels.groupBy(by).agg(F.sum(F.exp(F.col(label))).alias("cost"), F.count(F.lit(1)).alias("new_labels"))
    upto = W.orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    return per_round.select(by, F.sum("cost").over(upto).alias("cost"), F.sum("new_labels").over(upto).alias("data_size"))


def score_ratio(a: DataFrame, b: DataFrame, by: str = "iteration") -> DataFrame:
    """r2 of two variants side by side and their ratio."""
    left = a.select(by, F.col("r2").alias("r2_a"))
    right = b.select(by, F.col("r2").alias("r2_b"))
    return left.join(right, by).withColumn("ratio", F.try_divide("r2_a", "r2_b"))


def widest(intervals: DataFrame, q: float = 0.95) -> DataFrame:
    """Rows strictly above a quantile of the interval width."""
    return intervals.where(F.col("width") > ordered.quantile_scalar(intervals, "width", q))
