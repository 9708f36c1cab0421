"""Preference formatting (operator 2), in DataFrame expressions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is rendered once as the prompt;
the rest of each is a completion, a list of segments of which only the assistant's text is trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlab.llm.common import table
from planlab.llm.pipeline import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"  # fixed values of a public chat format
ANSWERS = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: one array of (turn, role, text) a conversation, in order of turn (null first), then role and text.

    Rows without conv_id belong to no conversation and are left out. A null role or text is the empty string.
    """
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))


def best_and_rest(convs: DataFrame) -> DataFrame:
    """``chosen_id, rejected_id``: conversations with one opening turn, the best against each other one.

    The best has the most assistant characters, of equals the smallest id. A conversation that nobody shares its
    opening with is a pair with a null rejected_id. As many pairs as conversations at most.
    """
    size = F.aggregate("turns", F.lit(0).cast("bigint"), lambda n, t: n + F.when(t["role"] == ANSWERS, F.length(t["text"])).otherwise(0))
    first = F.col("turns")[0]
    rows = convs.select("conv_id", F.sha2(F.concat_ws("\x00", first["role"], first["text"]), 256).alias("o"), size.alias("size"))
    rows = written(rows, "openings", "zstd")
    best = rows.groupBy("o").agg(F.max(F.struct("size", (-F.col("conv_id")).alias("minus"))).alias("b"), F.count(F.lit(1)).alias("n"))
    best = best.select("o", (-F.col("b.minus")).alias("chosen_id"), "n")
    met = rows.join(best, "o")
    alone = F.when(F.col("n") == 1, F.lit(None)).otherwise(F.col("conv_id"))
    return met.where("n = 1 OR conv_id <> chosen_id").select("chosen_id", alone.cast("bigint").alias("rejected_id"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def _completion(turns: Column, common: Column) -> Column:
    """Segments (text, train) after the common turns: what the assistant says is trained on, the rest is masked."""

    def segments(t: Column) -> Column:
        head = F.struct(F.concat(F.lit(OPEN), t["role"], F.lit("\n")).alias("text"), F.lit(False).alias("train"))
        body = F.struct(F.concat(t["text"], F.lit(CLOSE)).alias("text"), (t["role"] == ANSWERS).alias("train"))
        return F.array(head, body)

    return F.flatten(F.transform(F.slice(turns, common + 1, F.greatest(F.size(turns) - common, F.lit(0))), segments))


def preferences(turns: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``chosen_id, rejected_id, n_common, prompt, chosen, rejected`` of every pair.

    ``pairs`` names chosen and rejected conversations; without it, those of ``best_and_rest`` are taken. Turns are
    common while role and text agree. Without a rejected conversation the prompt is all that comes before the
    chosen one's last assistant turn (all turns if it has none) and ``rejected`` is null. Equal conversations are
    wholly common and have empty completions. Pairs that name an unknown chosen conversation are left out.
    """
    # a compressed table takes a fraction of a checkpoint; the hint keeps one plan at every size
    convs = written(conversations(turns), "conversations", "zstd")
    pairs = best_and_rest(convs) if pairs is None else pairs.select("chosen_id", "rejected_id")
    left = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"))
    right = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b"))
    both = pairs.join(right.hint("merge"), "rejected_id", "left").join(left.hint("merge"), "chosen_id")
    differ = F.array_position(
        F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False))), F.lit(False)
    ).cast("int")
    shared = F.when(differ == 0, F.size("a")).otherwise(differ - 1)
    answers = F.array_position(F.reverse(F.transform("a", lambda t: t["role"] == ANSWERS)), F.lit(True)).cast("int")
    before = F.when(answers == 0, F.size("a")).otherwise(F.size("a") - answers)
    common = F.when(F.col("b").isNull(), before).otherwise(shared)
    both = both.withColumn("n_common", common)
    return both.select(
        "chosen_id", "rejected_id", "n_common",
        _rendered(F.slice("a", 1, F.col("n_common"))).alias("prompt"),
        _completion(F.col("a"), F.col("n_common")).alias("chosen"),
        F.when(F.col("b").isNotNull(), _completion(F.col("b"), F.col("n_common"))).alias("rejected"),
    )


def op2_preferences(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of the whole table; completions as text, with the trained characters of each."""

    def text(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, lambda s: s["text"]), ""))

    def trained(c: str) -> Column:
        return F.aggregate(c, F.lit(0).cast("bigint"), lambda n, s: n + F.when(s["train"], F.length(s["text"])).otherwise(0))

    out = preferences(table(spark, directory, "conversations"))
    return out.select(
        "chosen_id", "rejected_id", "n_common", "prompt", text("chosen").alias("chosen"), text("rejected").alias("rejected"),
        trained("chosen").alias("chosen_trained"), trained("rejected").alias("rejected_trained"),
    )
