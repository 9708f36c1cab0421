"""What the operators of this package share: words, row identities, written intermediates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planlab.session import checkpointed

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
# A side is broadcast by hint only after its rows have been counted and found to be at most this.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_array(text: Column) -> Column:
    """Words between ASCII white space; none for a null or empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def broadcast_rows(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a written table of at most ``most`` rows; else the planner's join stands."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not hold yet, whatever extra columns it came with."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_digest(text: Column) -> Column:
    """SHA-256 of a text; a null text is told from an empty one."""
    return F.sha2(F.coalesce(F.concat(F.lit("t"), text.cast("string")), F.lit("")), 256)


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents as ``rid, text`` with one row per distinct (doc_id, text), and the way back.

    Where every doc_id is there once, ``rid`` is the doc_id and the way back is None. Otherwise
    ``rid`` numbers the distinct (doc_id, text) pairs in the order of doc_id (null last), then of a
    text digest; the second frame is (rid, doc_id, digest, copies), so a repeated row gets the result of
    its pair. The test reads the doc_id column only.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = ids.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull())
    if repeated.limit(1).count() == 0:
        return ids.withColumnRenamed("doc_id", "rid"), None
    digest = text_digest(F.col("text"))
    # first(text) is the same for each row of a digest, so a lost task may be run again
    pairs = ids.withColumn("digest", digest).groupBy("doc_id", "digest").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")
    )
    pairs = pairs.orderBy(F.col("doc_id").asc_nulls_last(), "digest")
    pairs = checkpointed(pairs.withColumn("rid", F.monotonically_increasing_id()))
    return pairs.select("rid", "text"), pairs.select("rid", "doc_id", "digest", "copies")


def unkeyed(result: DataFrame, back: DataFrame | None) -> DataFrame:
    """Give rows keyed by ``rid`` their doc_id again, once per repeated input row."""
    if back is None:
        return result.withColumnRenamed("rid", "doc_id")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    wide = result.join(back.select("rid", "doc_id", "copies"), "rid").withColumn("__copy", copies)
    return wide.select("doc_id", *[c for c in result.columns if c != "rid"])


def joined_back(docs: DataFrame, verdicts: DataFrame, back: DataFrame | None, how: str) -> DataFrame:
    """``docs`` joined with rows keyed by ``rid``, each row with the verdict of its own (doc_id, text).

    ``back`` is the way back that ``keyed(docs)`` gave. The other columns of ``verdicts`` must be new to ``docs``.
    """
    rid, mark = free_name(docs, "__rid"), free_name(docs, "__digest")
    if back is None:
        return docs.join(verdicts.withColumnRenamed("rid", rid), F.col("doc_id").cast("bigint") == F.col(rid), how).drop(rid)
    names = back.select("rid", F.col("doc_id").alias(rid), F.col("digest").alias(mark))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(rid)) & (text_digest(F.col("text")) == F.col(mark))
    return docs.join(verdicts.join(names, "rid").drop("rid"), same, how).drop(rid, mark)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(schema))
