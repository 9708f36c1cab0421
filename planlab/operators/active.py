"""Label completion: ask for the labels the model is least sure of, round by round."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlab.functions.scalars import draw
from planlab.operators import evaluate, forest, ordered
from planlab.operators.relational import stack
from planlab.session import stored


def split_labelled(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a label and rows without."""
    return df.where(F.col(label).isNotNull()), df.where(F.col(label).isNull())


def select_uncertain(intervals: DataFrame, q: float = 0.95) -> DataFrame:
    """Rows whose interval is strictly wider than the ``q`` quantile of all widths."""
    return evaluate.widest(intervals, q)


def select_random(candidates: DataFrame, row_id: str, k: int, seed: int) -> DataFrame:
    """``k`` draws with replacement: one row per draw, joined on the row's place."""
    placed = ordered.row_numbers(candidates.select(row_id), [], [row_id], "place")
    n = candidates.agg(F.count(F.lit(1)).alias("n"))
    draws = candidates.sparkSession.range(k).withColumnRenamed("id", "turn")
    u = draw(F.lit(seed), F.col("turn"))
    draws = draws.withColumn("place", (F.floor(u * n.scalar()) + 1).cast("bigint"))
    return draws.join(placed, "place").select("turn", row_id)


def reveal(chosen: DataFrame, truth: DataFrame, row_id: str) -> tuple[DataFrame, DataFrame]:
    """Labels of the chosen rows, and the chosen rows no label is known for."""
    ids = chosen.select(row_id).distinct()
    return truth.join(ids, row_id, "left_semi"), ids.join(truth, row_id, "left_anti")


def latest_per_key(df: DataFrame, key: str, time: str) -> DataFrame:
    """Most recent record per key; on equal times the greatest record."""
    row = F.struct(*[c for c in df.columns])
    return df.groupBy(key).agg(F.max(F.struct(F.col(time), row)).alias("m")).select("m.col2.*")


def job_number(column: str = "job"):
    """Sort key of ids like ``Job12v3``: the two numbers."""
    return F.struct(
        F.regexp_extract(column, r"Job(\d+)v(\d+)", 1).cast("bigint").alias("job_no"),
        F.regexp_extract(column, r"Job(\d+)v(\d+)", 2).cast("bigint").alias("version_no"),
    )


def pending(jobs: DataFrame, done: DataFrame, column: str = "job") -> DataFrame:
    """Jobs not done yet with their sort key."""
    return jobs.join(done.select(column), column, "left_anti").select(column, job_number(column).alias("n")).select(
        column, "n.job_no", "n.version_no"
    )


@dataclass
class Completion:
    """Final table, one row per round, intervals per round, and labels by the round they came in."""

    final: DataFrame
    rounds: DataFrame
    labels: DataFrame
    missing: DataFrame


def one_round(
    train: DataFrame, test: DataFrame, row_id: str, label: str, trees: int, depth: int, seed: int, search: bool = False
) -> tuple[DataFrame, object]:
    """Fit on labelled rows; mean, quartiles and width for the others."""
    if search:
        model, _ = evaluate.grid_search(train, row_id, label, seed=seed)
    else:
        model = forest.fit_forest(train, label, trees, depth, seed)
    a, b = forest.with_leaves(model, train), forest.with_leaves(model, test)
    return forest.interval(a, b, row_id, label), model


def complete_labels(
    features: DataFrame,
    row_id: str,
    columns: list[str],
    truth: DataFrame,
    initial: DataFrame,
    label: str = "label",
    max_rounds: int = 5,
    max_early_stop: int = 2,
    threshold: float = 0.1,
    q: float = 0.95,
    trees: int = 20,
    depth: int = 8,
    seed: int = 42,
    random_choice: bool = False,
    search: bool = False,
) -> Completion:
    """Rounds of fit, predict, choose and reveal until a stop rule holds.

    ``truth`` (``row_id, label``) stands for running what was asked for. Stops after
    ``max_rounds``, after ``max_early_stop`` rounds whose uncertainty fell by at least
    ``threshold``, or when nothing is left to ask. State is the table of known labels, cut from
    its lineage every round on the shared checkpoint folder; the driver keeps two numbers.
    """
    rows = stored(forest.with_vector(features, columns).select(row_id, "features"))
    known, missing = reveal(initial, truth, row_id)
    known = stored(known.select(row_id, label).withColumn("round", F.lit(0)))
    missing = [missing.withColumn("round", F.lit(0))]
    rounds, before, stops = [], None, 0
    spark = features.sparkSession
    for turn in range(max_rounds):
        told = known.select(row_id, label, F.lit(True).alias("__known"))
        sides = stored(rows.join(told, row_id, "left"))  # both sides are passed over several times
        train = sides.where("__known").drop("__known")
        test = sides.where("__known IS NULL").drop("__known", label)
        intervals, _ = one_round(train, test, row_id, label, trees, depth, seed, search)
        intervals = stored(intervals)
        width = F.exp(F.col("high")) - F.exp(F.col("low"))
        now = intervals.agg(
            F.avg(width), F.stddev_pop(width), F.avg(F.abs("width")), F.count(F.lit(1))
        ).first()
        if not now[3]:
            break
        size = known.count()
        rounds.append((turn, size, int(now[3]), now[0], now[1], now[2]))
        fell = before is not None and before > 0 and now[0] <= before and 1 - now[0] / before >= threshold
        before = now[0]
        if turn + 1 >= max_rounds:
            break
        stops += fell
        if fell and stops >= max_early_stop:
            break
        chosen = select_uncertain(intervals, q).select(row_id)
        if random_choice:
            chosen = select_random(intervals, row_id, chosen.count(), seed + turn).select(row_id)
        new, lost = reveal(chosen, truth, row_id)
        new = stored(new.select(row_id, label).withColumn("round", F.lit(turn + 1)))
        missing.append(stored(lost.withColumn("round", F.lit(turn + 1))))
        if new.isEmpty():
            break
        known = stored(known.unionByName(new))
    rounds_table = spark.createDataFrame(
        rounds,
        "iteration int, data_size long, open_rows long, uncertainty double, uncertainty_std double, mean_width double",
    )
    final = (
        rows.select(row_id)
        .join(known.select(row_id, F.col(label).alias("known")), row_id, "left")
        .join(intervals.select(row_id, "pred", "low", "high"), row_id, "left")
        .select(row_id, F.coalesce("known", "pred").alias(label), "known", "pred", "low", "high")
    )
    return Completion(final, rounds_table, known, stack(missing))

