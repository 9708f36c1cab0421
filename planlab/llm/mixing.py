"""Mixing sources to target weights (operator 9), in DataFrame expressions only.

Efraimidis-Spirakis sampling: a document with quality weight w draws the exponential key -ln(u) / w,
u a hash of its identity, and the documents of a source with the least keys are taken first. A
target above the size of its source first takes whole epochs (every document once), and only the
rest is chosen by key, through running sums of sizes in key order. The document that crosses the
target gives its first words only, so each source meets its target to the word.

Sizes and keys are worked out and written once. Rows that agree in key and hash are added up first, so copies of one row are one
record, and the running sums go over a rank index of the records (ranges of source and key, whatever the keys' distribution).
All that a row needs to know then is where its source crosses, so the sources are a small table that rows are
joined with; their targets are running sums over that table, which never passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlab.llm.common import broadcast_rows, table, word_count
from planlab.llm.pipeline import written
from planlab.operators import ordered

WEIGHTS = (5.0, 2.0, 1.0)  # of the sources in order of their names, repeating
SHARE = 1.5  # words of the mix to words of the corpus
MOST_EPOCHS = 2.0  # a source is taken at most so often
SEED = 17
COPIES = 10_000  # rows alike that a task writes at once


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0 and 1: falls with the share of symbols among the words; 1 for an empty text."""
    symbols = F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0))
    return 1.0 / (1.0 + 4.0 * symbols / F.greatest(size, F.lit(1)))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """``sources`` (``__s, n``) with ``target`` words, whole ``epochs`` and the ``rest`` in words.

    Sources weigh ``weights`` in code point order of their names, null last, repeating. ``share`` of all sizes is dealt by weight; a
    target stops at ``most`` times its source's size, and what it would have had above that goes to the
    others by weight, until none is above. In order of the level ``most * n / weight`` at which a source is full, each
    source sees what is left per weight once all before it are full; the first one that is not full at that
    level sets the level of all that follow.
    """
    named = sources.withColumn("__none", F.col("__s").isNull())
    placed = ordered.row_numbers(named, [], ["__none", "__s"], "__place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("__place") - 1) % len(weights)).cast("int"))
    placed = placed.withColumn("__w", weight).withColumn("__full", most * F.col("n") / F.col("__w"))
    upto = ordered.running(
        placed, [], ["__full", "__place"], {"__n0": ("sum", "n"), "__w0": ("sum", "__w")}, include_row=False
    )
    upto = written(upto.fillna(0, ["__n0"]).fillna(0.0, ["__w0"]), "sources")
    sums = upto.agg(F.sum("n").alias("n"), F.sum("__w").alias("w"))
    left = (share * sums.select("n").scalar() - most * F.col("__n0")) / (sums.select("w").scalar() - F.col("__w0"))
    levels = upto.select("__full", "__place", left.alias("level"))
    level = levels.where("__full >= level").agg(F.min_by("level", F.struct("__full", "__place")).alias("level"))
    target = F.least(most * F.col("n"), F.coalesce(level.scalar(), F.col("__full")) * F.col("__w")).cast("double")
    out = upto.withColumn("target", target)
    out = out.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "n")), F.lit(0)))
    out = out.withColumn("rest", F.bround(F.col("target") - F.col("epochs") * F.col("n")).cast("bigint"))
    return written(out.select("__s", "n", "target", "epochs", "rest"), "targets")


def _measured(docs: DataFrame, kept: list[str], quality: Column | None, seed: int) -> DataFrame:
    """Source, size, key and a hash of the whole row for every row of ``docs``."""
    text = F.col("`text`").cast("string")
    rows = docs.select(
        F.col("source").alias("__s"),
        F.xxhash64(F.col("doc_id").cast("string"), text).alias("__h"),
        F.xxhash64(*[F.to_json(f"`{c}`") if t.startswith("map") else F.col(f"`{c}`") for c, t in docs.dtypes]).alias("__hash"),
        word_count(text).alias("size"),
        *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(kept)],
        text.alias("__text"),
    )
    weight = quality if quality is not None else quality_weight(F.col("__text"), F.col("size"))
    unit = (F.pmod(F.xxhash64("__h", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    return rows.withColumn("__key", -F.log(unit) / weight).drop("__text", "__h")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_EPOCHS,
    quality: Column | None = None,
    seed: int = SEED,
    columns: list[str] | None = None,
) -> DataFrame:
    """Rows of ``docs`` (all columns, or ``columns``) plus ``size``, ``source_size``, ``target`` and ``taken`` (words,
    repeats counted).

    A null text has size 0 and is taken 0 times; a null or repeated doc_id is drawn by its text as well. Rows that agree in
    doc_id and text stand next to each other in the order, by a hash of all their columns. Rows equal in every column share
    one place: those at the crossing split the words taken there into parts that differ by one word at most, so reruns give the
    same rows. Input columns named like the results are replaced. ``quality`` may use the columns ``__text`` and ``size``.
    """
    made = ("size", "source_size", "target", "taken")
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in made]
    cells = [f"__c{i}" for i in range(len(kept))]
    rows = written(_measured(docs, kept, quality, seed), "measured")
    records = rows.groupBy("__s", "__key", "__hash").agg(F.sum("size").alias("__n"), F.count(F.lit(1)).alias("__copies"))
    upto = ordered.running(records, ["__s"], ["__key", "__hash"], {"__before": ("sum", "__n")}, include_row=False)
    upto = upto.withColumn("__before", F.coalesce("__before", F.lit(0)))
    plan = targets(rows.groupBy("__s").agg(F.sum("size").alias("n")), weights, share, most)
    at = ordered.null_safe(upto, broadcast_rows(plan.select("__s", "rest")), ["__s"], "inner")
    at = at.where((F.col("__before") < F.col("rest")) & (F.col("__before") + F.col("__n") >= F.col("rest")))
    at = at.select(
        "__s", F.struct("__key", "__hash").alias("__at"), (F.col("rest") - F.col("__before")).alias("__left"), "__copies"
    )
    plan = broadcast_rows(written(ordered.null_safe(plan, at, ["__s"], "left"), "crossings"))
    joined = ordered.null_safe(rows, plan, ["__s"], "inner")
    here = F.struct("__key", "__hash")
    names = [F.col(c).alias(k) for c, k in zip(cells, kept)]
    epochs = F.col("epochs") * F.col("size")
    crossing = F.coalesce(here == F.col("__at"), F.lit(False))
    part = F.when(F.coalesce(here < F.col("__at"), F.lit(False)), F.col("size")).otherwise(0)
    result = [F.col("n").cast("bigint").alias("source_size"), "target"]
    whole = joined.where(~crossing).select(*names, "size", *result, (epochs + part).cast("bigint").alias("taken"))
    # all rows at a crossing are alike: they are counted, numbered and written out again
    alike = joined.where(crossing).groupBy("__s").agg(
        *[F.first(c).alias(c) for c in [*cells, "size", "n", "target", "epochs", "__left", "__copies"]]
    )
    pieces = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__copies") - 1) / COPIES)))
    alike = alike.withColumn("__piece", pieces).repartition("__s", "__piece")
    last = F.least(F.col("__copies"), (F.col("__piece") + 1) * COPIES) - 1
    alike = alike.withColumn("__i", F.explode(F.sequence(F.col("__piece") * COPIES, last)))
    share_of = F.expr("(__left * (__i + 1)) div __copies - (__left * __i) div __copies")
    alike = alike.select(*names, "size", *result, (epochs + share_of).cast("bigint").alias("taken"))
    return whole.unionByName(alike)


def op9_mixing(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "source", "text")
    return mix(docs, columns=["doc_id"])
