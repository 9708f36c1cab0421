"""Benchmark decontamination (operator 4), in DataFrame expressions only.

Containment search with MinHash: an item is the set of its distinct five-word shingles, and a document leaks it if it
holds at least ``percent`` of them; an item of fewer words is one shingle, its whole word sequence. Items fall into size
classes (powers of two of their shingle count); the sketch of an item holds its least shingle hashes, as many as may be missing
at the largest size of the class and one more. By the pigeonhole principle a document that leaks the item holds a
hash of the sketch, so no leak is lost whatever the document's length. The sketches are also laid out as a map of bits; a
document's hashes are looked up there before they become rows, so what is joined are hits and a few false ones, at every
number of items. Candidates are verified by exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlab.llm.common import broadcast_rows, free_name, keyed, lower_ascii, table, unkeyed, word_array
from planlab.session import checkpointed

WIDTH = 5
PERCENT = 80
BITS_PER_HASH, FEWEST_BITS, MOST_BITS = 64, 1 << 16, 1 << 23  # of the map; a full map lets more rows through, none is lost


def _words(text: Column) -> Column:
    return word_array(lower_ascii(text))


def _shingles(text: Column, hashed: bool, widths: list[int]) -> Column:
    """Hashes (or the words themselves) of all windows of each of ``widths`` words.

    The words are bound by a lambda over one element: as a column of their own the optimizer would write
    the split out again wherever a pushed filter mentions them.
    """

    def windows(w: Column, width: int) -> Column:
        def one(x: Column, i: Column) -> Column:
            words = [x, *[F.get(w, i + j) for j in range(1, width)]]
            return _hash(words) if hashed else F.concat_ws(" ", *words)

        return F.slice(F.transform(w, one), 1, F.greatest(F.size(w) - (width - 1), F.lit(0)))

    return F.transform(F.array(_words(text)), lambda w: F.concat(*[windows(w, n) for n in widths]))[0]


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _bits(sketch: DataFrame, rows: int) -> tuple[Column, int]:
    """The map of the sketches' hashes, 64 bits a cell, as one value, and the number of its bits."""
    size = FEWEST_BITS
    while size < min(MOST_BITS, rows * BITS_PER_HASH):
        size *= 2
    at = F.pmod("h", F.lit(size))
    cells = sketch.groupBy(F.floor(at / 64).cast("int").alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(pmod(h, 64) AS INT))")).alias("bits")
    )
    every = sketch.sparkSession.range(size // 64).select(F.col("id").cast("int").alias("cell")).join(cells, "cell", "left")
    ordered = F.array_sort(F.collect_list(F.struct("cell", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    packed = checkpointed(every.agg(F.transform(ordered, lambda x: x["bits"]).alias("map")))
    return packed.scalar(), size


def leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item`` of every leaked item.

    Words are lower-cased (A-Z) and split at ASCII white space. An item of one to four words is leaked where its words
    stand in a row. Items without a word, null ones and those without an item_id leak nowhere; null and empty documents leak
    nothing. Rows of items that share an item_id are one item with the shingles of all. Repeated document
    rows give a row each; a null doc_id is returned as such. Very long texts are read whole.
    """
    schema = "doc_id long, item_id long, n_shared long, n_item long"
    base, back = keyed(docs)
    texts = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    width = F.least(F.size(_words(F.col("text"))), F.lit(WIDTH))
    texts = checkpointed(texts.withColumn("width", width).where("width > 0"))
    widths = sorted(r["width"] for r in texts.select("width").distinct().collect())  # five values at most
    if not widths:
        return docs.sparkSession.createDataFrame([], schema)
    of_width = F.coalesce(*[F.when(F.col("width") == n, _shingles(F.col("text"), False, [n])) for n in widths])
    own = texts.select("item_id", F.explode(of_width).alias("shingle")).distinct()
    words = F.split("shingle", " ")
    own = own.withColumn("h", F.coalesce(*[F.when(F.size(words) == n, _hash([F.get(words, F.lit(j)) for j in range(n)])) for n in widths]))
    sizes = own.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    own = checkpointed(own.join(sizes, "item_id"))
    largest = F.pow(F.lit(2), F.ceil(F.log2("n_item")))
    sketch_size = F.floor((100 - percent) * largest / 100) + 1
    ranked = own.withColumn("r", F.row_number().over(W.partitionBy("item_id").orderBy("h", "shingle")))
    sketch = checkpointed(ranked.where(F.col("r") <= sketch_size).select("item_id", "h"))
    bits, size = _bits(sketch, sketch.count())
    rows = base.withColumn("__map", bits)  # one value for all rows, worked out once

    def marked(h: Column) -> Column:
        cell = F.get(F.col("__map"), F.floor(F.pmod(h, F.lit(size)) / 64).cast("int"))
        return F.call_function("shiftrightunsigned", cell, F.pmod(h, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1

    hits = F.filter(_shingles(F.col("text"), True, widths), marked)
    probes = rows.select("rid", F.explode(F.array_distinct(hits)).alias("h"))
    met = checkpointed(probes.join(broadcast_rows(sketch), "h").select("rid", "item_id").distinct())
    named = broadcast_rows(checkpointed(met.select("rid").distinct()))
    held = base.join(named, "rid", "left_semi")
    held = held.select("rid", F.explode_outer(_shingles(F.col("text"), False, widths)).alias("shingle"))
    # a shingle of many items or documents is met once per document and item
    shared = held.join(broadcast_rows(own.select("shingle", "item_id", "n_item")), "shingle").distinct()
    found = shared.groupBy("rid", "item_id").agg(F.count(F.lit(1)).alias("n_shared"), F.first("n_item").alias("n_item"))
    found = found.join(met, ["rid", "item_id"], "left_semi").where(100 * F.col("n_shared") >= percent * F.col("n_item"))
    return unkeyed(found.select("rid", "item_id", "n_shared", "n_item"), back).select("doc_id", "item_id", "n_shared", "n_item")


def without_leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns as they came; the text decides, so a row with a null
    doc_id is judged too."""
    name = free_name(docs, "__leaked")
    marked = F.sha2(F.coalesce(F.concat(F.lit("t"), F.col("text").cast("string")), F.lit("")), 256)
    if docs.where("doc_id IS NULL").limit(1).count() == 0 and docs.groupBy("doc_id").count().where("count > 1").limit(1).count() == 0:
        bad = leaks(docs, items, percent).select(F.col("doc_id").alias(name)).distinct()
        return docs.join(broadcast_rows(checkpointed(bad)), docs["doc_id"] == F.col(name), "left_anti")
    # without unique ids, texts stand for the rows
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text").distinct()
    bad = leaks(texts, items, percent).select("doc_id").distinct().join(texts, "doc_id").select(
        F.sha2(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")), 256).alias(name)
    )
    return docs.join(bad.distinct(), marked == F.col(name), "left_anti")


def op4_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "text")
    return leaks(docs, table(spark, directory, "benchmark").select("item_id", "text"))
