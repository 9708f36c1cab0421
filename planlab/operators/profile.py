"""Table profiling: row counts, key cardinality, filter literals and their selectivity."""

from __future__ import annotations

import datetime
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planlab.catalog import Predicate
from planlab.operators import ordered
from planlab.operators.relational import stack
from planlab.session import stored

QUARTILES = [0.25, 0.5, 0.75]
QUARTILES_AND_TAIL = [0.25, 0.5, 0.75, 0.95, 0.97, 0.99]
ACCURACY = 10_000  # of a quantile sketch: its answers are at most a share of 1 / ACCURACY off
FEW = 200_000  # rows of a bracket that are ordered in one task
LEAST_SHARE = 0.01  # of all rows, for a value to be a literal
TRACKED = 10_000  # values a heavy-hitter sketch holds; it finds all above a share of 7 / (0.75 * TRACKED)
DAY = 86_400_000_000  # microseconds
HEAD = 64  # characters of a suffix that are brought into order


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table."""
    return stack(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
            for name, df in tables.items()
        ]
    )


def key_cardinality(df: DataFrame, keys: list[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values of each candidate key, one scan."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    wide = df.agg(*[count(k).alias(k) for k in keys])
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("n_groups")) for k in keys])
    return wide.select(F.inline(pairs))


@dataclass
class _Bracket:
    """Values from ``low`` to ``high`` of a field: ``below`` rows lie under them and ``inside`` rows in them."""

    field: str
    low: float
    high: float
    below: int
    inside: int
    wanted: list[float]  # probabilities whose positions lie inside
    final: bool = False

    def holds(self, value: Column) -> Column:
        return (value >= self.low) & (value <= self.high)


def _places(p: float, n: int) -> tuple[int, int]:
    place = p * (n - 1)
    return math.floor(place), math.ceil(place)


def _narrowed(df: DataFrame, values: dict[str, Column], sizes: dict[str, int], brackets: list[_Bracket]) -> list[_Bracket]:
    """Each bracket cut down around its probabilities: one scan for the sketches of all, one to count.

    A sketch only proposes; the counts say whether the positions lie inside, and where they do not the bracket stays
    and is final, as is one that was not even halved.
    """
    sketches = []
    for i, b in enumerate(brackets):
        at = [(p * (sizes[b.field] - 1) - b.below) / max(b.inside - 1, 1) for p in b.wanted]
        ends = [min(1.0, max(0.0, x + d)) for x in at for d in (-2 / ACCURACY, 2 / ACCURACY)]
        sketches.append(F.percentile_approx(F.when(b.holds(values[b.field]), values[b.field]), ends, ACCURACY).alias(f"e{i}"))
    found = df.agg(*sketches).first()
    proposed: dict[tuple, _Bracket] = {}
    for i, b in enumerate(brackets):
        for p, low, high in zip(b.wanted, found[i][::2], found[i][1::2]):
            proposed.setdefault((b.field, low, high), _Bracket(b.field, low, high, 0, 0, [])).wanted.append(p)
    new = list(proposed.values())
    counts = df.agg(
        *[F.count_if(values[b.field] < b.low).alias(f"b{i}") for i, b in enumerate(new)],
        *[F.count_if(b.holds(values[b.field])).alias(f"i{i}") for i, b in enumerate(new)],
    ).first()
    out, old = [], {(b.field, p): b for b in brackets for p in b.wanted}
    for i, b in enumerate(new):
        b.below, b.inside = counts[f"b{i}"], counts[f"i{i}"]
        b.final = any(2 * b.inside > old[b.field, p].inside for p in b.wanted)  # no further cut would get far
        for p in b.wanted:
            down, up = _places(p, sizes[b.field])
            if not (b.below <= down and up < b.below + b.inside):
                before = old[b.field, p]
                out.append(_Bracket(b.field, before.low, before.high, before.below, before.inside, [p], True))
        missed = {(x.field, p) for x in out for p in x.wanted}
        b.wanted = [p for p in b.wanted if (b.field, p) not in missed]
        if b.wanted:
            out.append(b)
    return out


def quantile_literals(df: DataFrame, columns: list[str], probabilities=QUARTILES) -> DataFrame:
    """Literals for ``column <= literal`` at given selectivities, exact, numeric columns: ``field, selectivity, literal``.

    Missing values and NaN are left out; a column without a value has no literals. No column is sorted or shuffled as
    a whole: sketches bracket every position, a counting scan settles where the brackets lie, brackets of more than FEW
    rows are cut down again, and only the rows inside them are ordered. All columns share the scans.
    """
    spark = df.sparkSession
    values = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    if df.count() <= FEW:  # a table of few rows is one bracket a column
        cells = F.array(*[F.struct(F.lit(c).alias("field"), v.alias("__v")) for c, v in values.items()])
        runs = df.select(F.inline(cells)).where(F.col("__v").isNotNull()).groupBy("field", "__v").agg(F.count(F.lit(1)).alias("__c"))
        of_field = W.partitionBy("field")
        upto = of_field.orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
        runs = runs.withColumns({"__low": F.sum("__c").over(upto) - F.col("__c"), "__n": F.sum("__c").over(of_field)})
        asked = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
        both = runs.withColumn("selectivity", asked).withColumn("place", F.col("selectivity") * (F.col("__n") - 1))
        both = both.groupBy("field", "selectivity", "place").agg(*ordered.ends_at(F.col("place")))
        return both.select("field", "selectivity", ordered.between(F.col("place")).alias("literal"))
    sizes = df.agg(*[F.count(v).alias(c) for c, v in values.items()]).first().asDict()
    brackets = [_Bracket(c, -math.inf, math.inf, 0, n, list(probabilities)) for c, n in sizes.items() if n]
    schema = T.StructType.fromDDL("field string, selectivity double, literal double")
    if not brackets:
        return spark.createDataFrame([], schema)
    while any(b.inside > FEW and b.low < b.high and not b.final for b in brackets):
        wide = [b for b in brackets if b.inside > FEW and b.low < b.high and not b.final]
        brackets = [b for b in brackets if b not in wide] + _narrowed(df, values, sizes, wide)
    cells = [F.when(b.holds(values[b.field]), F.struct(F.lit(i).alias("i"), values[b.field].alias("v"))) for i, b in enumerate(brackets)]
    rows = df.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.i", F.col("x.v").alias("v"))
    if any(b.final and b.inside > FEW for b in brackets):
        placed = ordered.placed(ordered.value_index(rows, ["i"], "v"))
    else:  # few rows each, or one value
        runs = rows.groupBy("i", F.col("v").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
        upto = W.partitionBy("i").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
        placed = runs.withColumn("__low", F.sum("__c").over(upto) - F.col("__c"))
    asked = [(i, b.field, float(p), p * (sizes[b.field] - 1) - b.below) for i, b in enumerate(brackets) for p in b.wanted]
    asked = spark.createDataFrame(asked, "i int, field string, selectivity double, place double")
    both = placed.join(F.broadcast(asked), "i").groupBy("field", "selectivity", "place").agg(*ordered.ends_at(F.col("place")))
    return both.select("field", "selectivity", ordered.between(F.col("place")).alias("literal"))


def heavy_literals(df: DataFrame, columns: list[str], least: float = LEAST_SHARE) -> DataFrame:
    """Values that fill at least a share of ``least`` of all rows, with exact counts: ``field, literal, n, selectivity``.

    One scan finds the candidates of all columns in heavy-hitter sketches, one counts them. A sketch holds every value
    above its error, so ``least`` must lie above that. Null is no literal; literals are text.
    """
    if least * 0.75 * TRACKED < 7:
        raise ValueError("a heavy-hitter sketch of this size does not find shares so small")
    most = min(TRACKED, math.ceil(2 / least))
    top = F.expr  # approx_top_k has no function of its own
    found = df.agg(*[top(f"approx_top_k(CAST(`{c}` AS STRING), {most}, {TRACKED})").alias(c) for c in columns]).first()
    candidates = [(c, x["item"]) for c in columns for x in (found[c] or []) if x["item"] is not None]
    if not candidates:
        return df.sparkSession.createDataFrame([], "field string, literal string, n bigint, selectivity double")
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(f"`{c}`").cast("string") == x).alias(f"c{i}") for i, (c, x) in enumerate(candidates)],
    )
    cells = [F.struct(F.lit(c).alias("field"), F.lit(x).alias("literal"), F.col(f"c{i}").alias("n")) for i, (c, x) in enumerate(candidates)]
    rows = counts.select("total", F.explode(F.array(*cells)).alias("x"))
    rows = rows.select("x.field", "x.literal", "x.n", (F.col("x.n") / F.col("total")).alias("selectivity"))
    return rows.where(F.col("selectivity") >= least)


def literal_catalogue(df: DataFrame, table: str, columns: list[str], probabilities=QUARTILES, least: float = LEAST_SHARE) -> DataFrame:
    """Filter literals of a table with the share of rows they let through, by the kind of column:
    ``table_name, field, op, number, text, selectivity``.

    Numbers and times give ``<=`` at the probabilities (a time's literal is the day its quantile lies in, as text); text and truth
    values give ``==`` for every value that fills a share of ``least`` of the rows.
    """
    kinds = {c: df.schema[c].dataType for c in columns}
    times = [c for c, k in kinds.items() if isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    words = [c for c, k in kinds.items() if isinstance(k, (T.StringType, T.BooleanType))]
    numbers = [c for c in columns if c not in times and c not in words]
    frames = []
    if numbers or times:
        epoch = F.expr  # zone-less microseconds
        rows = df.select(
            *numbers, *[epoch(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{c}` AS TIMESTAMP_NTZ))").alias(c) for c in times]
        )
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("literal") / DAY).cast("int")).cast("string")
        timed = F.col("field").isin(*times) if times else F.lit(False)
        frames.append(quantile_literals(rows, numbers + times, probabilities).select(
            "field", F.lit("<=").alias("op"), F.when(~timed, F.col("literal")).alias("number"), F.when(timed, day).alias("text"), "selectivity"
        ))
    if words:
        frames.append(heavy_literals(df, words, least).select(
            "field", F.lit("==").alias("op"), F.lit(None).cast("double").alias("number"), F.col("literal").alias("text"), "selectivity"
        ))
    return stack(frames).select(F.lit(table).alias("table_name"), "*")


def predicates(catalogue: DataFrame) -> list[Predicate]:
    """A literal catalogue as predicates; a few per field, so they come to the driver."""
    rows = catalogue.orderBy("table_name", "field", "selectivity", "text", "number").collect()

    def literal(r):
        if r["number"] is not None:
            return r["number"]
        return datetime.date.fromisoformat(r["text"]) if r["op"] == "<=" else r["text"]

    return [Predicate(r["table_name"], r["field"], r["op"], literal(r), r["selectivity"]) for r in rows]


def category_share(df: DataFrame, column: str) -> DataFrame:
    """Literals for ``column == literal`` with their share of all rows."""
    total = df.agg(F.count(F.lit(1)))
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("literal"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("selectivity", F.col("n") / total.scalar())
    )


def contained(words: DataFrame) -> DataFrame:
    """Which words stand inside which: ``outer, piece`` for all pairs of ``words`` (one column ``word``, distinct, not empty).

    A word inside another begins one of its suffixes. Suffixes, cut at HEAD characters, and words are brought into one order,
    where the words that begin a suffix stand before it: the last word up to the suffix is one of them or begins
    with the longest of them. So every suffix takes that word, and tries the words that this one begins with in turn. A word gives a
    row for each of its characters, not for each of its substrings. Words above HEAD characters are met through
    their first HEAD characters and compared in full.
    """
    words = stored(words.select("word").withColumn("id", F.monotonically_increasing_id()))
    starts = F.explode(F.sequence(F.lit(1), F.length("word")))
    suffixes = words.select("id", "word", starts.alias("start")).select(
        "id", "start", F.substring(F.col("word"), F.col("start"), F.lit(HEAD)).alias("head")
    )
    short = words.where(F.length("word") <= HEAD).select("word")
    marked = suffixes.groupBy("head").agg(F.lit(None).cast("string").alias("word")).withColumn("kind", F.lit(1))
    lined = marked.unionByName(short.select(F.col("word").alias("head"), "word", F.lit(0).alias("kind")))
    last = ordered.running(lined, [], ["head", "kind"], {"last": ("max", "word")}).where("kind = 1").select("head", "last")
    lengths = F.explode(F.sequence(F.lit(1), F.length("word")))
    begins = short.select(F.col("word").alias("last"), lengths.alias("length"))
    begins = begins.select("last", F.substring(F.col("last"), F.lit(1), F.col("length")).alias("piece"))
    begins = begins.join(short.select(F.col("word").alias("piece")), "piece", "left_semi")
    heads = last.join(begins, "last").where(F.startswith("head", "piece")).select("head", "piece")
    found = suffixes.join(heads, "head").select("id", "piece").distinct()
    outer = words.select("id", F.col("word").alias("outer"))
    long = words.where(F.length("word") > HEAD).select(F.col("word").alias("piece"), F.substring("word", 1, HEAD).alias("head"))
    far = suffixes.join(long, "head").join(outer, "id").where(F.substring(F.col("outer"), F.col("start"), F.length("piece")) == F.col("piece"))
    both = found.join(outer, "id").select("outer", "piece").unionByName(far.select("outer", "piece"))
    return both.distinct()


def token_share(df: DataFrame, column: str, sep: str = ",") -> DataFrame:
    """For each token of a list column, the share of rows whose text contains the token.

    Containment is of text, so a token also counts where a longer token holds it. A token has no
    separator in it, hence it is in a text exactly when it is inside one of the text's tokens (``contained``).
    Equal texts are counted once with their number.
    """
    total = df.agg(F.count(F.lit(1)))
    texts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__text")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    words = F.array_distinct(F.split("__text", rf"\Q{sep}\E"))
    long = texts.select("__text", "__n", F.explode(words).alias("__word")).where("__word <> ''")
    inside = contained(long.select(F.col("__word").alias("word")).distinct())
    found = long.join(inside, F.col("__word") == F.col("outer")).select("__text", "__n", "piece").distinct()
    return found.groupBy(F.col("piece").alias("token")).agg(
        F.sum("__n").alias("n"), (F.sum("__n") / F.first(total.scalar())).alias("selectivity")
    )


def qerror(catalogue: DataFrame) -> DataFrame:
    """How far expected and measured cardinality are apart, as a factor."""
    expected = F.col("expected") * F.col("total")
    actual = F.col("rows_out").cast("double")
    return catalogue.select(
        "table_name",
        "predicate",
        expected.alias("expected_rows"),
        "rows_out",
        F.when((actual > 0) & (expected > 0), F.greatest(expected / actual, actual / expected)).alias("qerror"),
    )
