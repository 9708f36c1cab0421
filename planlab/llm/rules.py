"""Quality rules as a short-circuit cascade (operator 10), in DataFrame expressions only.

Every rule is a rejecting predicate over statistics of one text. On a bounded sample the operator
estimates what a rule costs (work units a text: how many characters, words or lines its statistics
visit) and how many texts it rejects, orders the rules by rejection per cost, and evaluates them in that order in
one CASE expression, which stops at the first rule that rejects. The order changes what is computed,
never which documents stay, so the sample decides speed only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlab.llm.common import WORD, table

SAMPLE_ROWS = 2000  # rows, about, that rank the rules
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``reject`` is SQL over the names in STATISTICS; ``uses`` are the ones it reads."""

    name: str
    reject: str
    uses: tuple[str, ...]


def _bound(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` computed once: a lambda over one element is not written out again by
    the optimizer, as a column that is used once would be."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words() -> str:
    """Words in three-word windows found twice or more in the text.

    ``grams`` holds a digest of each window with its position in the low bits, sorted, so equal
    windows are neighbours; ``low`` masks the position. As many bits go to the position as the text
    needs, the others to the digest, and neighbours are compared by their words as well.
    """
    gram = "shiftleft(xxhash64(x, get(w, i + 1), get(w, i + 2)), bits) | CAST(i AS BIGINT)"
    grams = f"sort_array(transform(w, (x, i) -> {gram}))"
    here, before = ("CAST({} & low AS INT)".format(x) for x in ("get(grams, k)", "get(grams, k - 1)"))
    words = " AND ".join(f"get(w, {here} + {j}) = get(w, {before} + {j})" for j in range(3))
    alike = f"shiftright(get(grams, k) ^ get(grams, k - 1), bits) = 0 AND {words}"
    found = f"filter(sequence(1, greatest(size(w) - 1, 1)), k -> {alike})"
    places = f"sort_array(flatten(transform({found}, k -> array({before}, {here}))))"
    covered = (
        f"aggregate({places}, named_struct('upto', -3, 'n', 0L),"
        " (a, p) -> named_struct('upto', p, 'n', a.n + least(3, p - a.upto)), a -> a.n)"
    )
    inner = _bound("low", "shiftleft(1L, bits) - 1", _bound("grams", grams, covered))
    return _bound("bits", "CAST(ceil(log2(size(w) + 2)) AS INT)", inner)


# SQL over `text`: its words, and its lines that have a word
WORDS = "array_remove(split(coalesce(text, ''), r'[\\x20\\x09-\\x0D]+'), '')"
LINES = "filter(split(coalesce(text, ''), '\\n'), x -> x RLIKE r'[^\\x20\\x09-\\x0D]')"

# statistic -> (SQL over `text`, `w` (words) and other statistics, cost units per character and per word)
STATISTICS = {
    "n_words": ("CAST(size(w) AS BIGINT)", 0.0, 0.1),
    "word_chars": ("CAST(length(array_join(w, '')) AS BIGINT)", 0.2, 0.5),
    "n_symbols": (f"CAST(coalesce(regexp_count(text, '{SYMBOLS}'), 0) AS BIGINT)", 1.0, 0.0),
    "capitals_only": (r"coalesce(text RLIKE '[A-Z]{2}' AND NOT text RLIKE '\\p{Ll}', false)", 0.02, 0.0),
    "n_dup_lines": (
        _bound("lines", LINES, "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)"), 0.6, 0.1
    ),
    "n_lines": (f"CAST(size({LINES}) AS BIGINT)", 0.5, 0.0),
    "n_repeat_words": (_repeat_words(), 0.0, 12.0),
}

BASE = (
    Rule("short", "n_words < 50", ("n_words",)),
    Rule("repetitive", "100 * n_repeat_words > 50 * n_words", ("n_words", "n_repeat_words")),
)
MORE = (
    Rule("symbols", "100 * n_symbols > 30 * n_words", ("n_words", "n_symbols")),
    Rule("shouting", "( capitals_only )", ("capitals_only",)),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words", ("n_words", "word_chars")),
    Rule("repeated_lines", "n_lines > 4 AND 100 * n_dup_lines > 50 * n_lines", ("n_lines", "n_dup_lines")),
)


def _sql(name: str) -> str:
    return STATISTICS[name][0]


def statistics(docs: DataFrame, names: list[str]) -> DataFrame:
    """``doc_id, text`` rows with the named statistics; a null text counts as empty."""
    columns = ["doc_id", "text"]
    df = docs.select(*columns, F.expr(WORDS).alias("w"))
    return df.select(*columns, *[F.expr(_sql(n)).alias(n) for n in names])


def ranked(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by estimated rejections per cost, best first; ties keep the given order.

    The cost of a rule is the sum over its statistics of unit costs times the mean characters and words
    of the sampled texts. Rows are drawn by a hash and summed up where they lie; the draw and the hash of the first
    characters decide the order of the rules only. An empty sample keeps the given order.
    """
    names = sorted({u for r in rules for u in r.uses} | {"n_words"})
    every = max(1, docs.count() // max(1, sample_rows))  # about sample_rows rows, wherever they lie
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.substring("text", 1, 64)), F.lit(every)) == 0
    sample = statistics(docs.select("doc_id", "text").where(drawn), names)
    found = sample.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.coalesce(F.length("text"), F.lit(0))).alias("chars"),
        F.avg("n_words").alias("words"),
        *[F.avg(F.expr(r.reject).cast("int")).alias(f"r{i}") for i, r in enumerate(rules)],
    ).first()
    if not found["rows"]:
        return list(rules)

    def cost(rule: Rule) -> float:
        return 1.0 + sum(STATISTICS[u][1] * found["chars"] + STATISTICS[u][2] * found["words"] for u in rule.uses)

    worth = {r.name: found[f"r{i}"] / cost(r) for i, r in enumerate(rules)}
    return sorted(rules, key=lambda r: -worth[r.name])


def _inlined(rule: Rule) -> str:
    """The rule with each statistic written out, so that a CASE computes it only when it gets there."""
    sql = f" {rule.reject} "
    for name in sorted(rule.uses, key=len, reverse=True):
        sql = sql.replace(f" {name} ", f" {_sql(name)} ")
    return sql.strip()


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` plus ``rejected_by``: the first rule of the cascade that
    rejects the text, null for a document that stays.

    Null and empty texts have no words and are rejected by ``short``. Repeated rows are judged alike.
    A null doc_id is judged as any other. Clashing column names: an input column ``rejected_by`` is
    replaced, all others are returned as they came.
    """
    order = ranked(docs, rules, sample_rows)
    branches = " ".join(f"WHEN {_inlined(r)} THEN '{r.name}'" for r in order)
    # the words are bound inside the one expression, so a filter on it may be moved anywhere
    verdict = F.expr(_bound("w", WORDS, f"CASE {branches} END"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "rejected_by"]
    return docs.select(*kept, verdict.alias("rejected_by"))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents no rule rejects, with the columns they came with."""
    order = ranked(docs, rules, sample_rows)
    branches = " ".join(f"WHEN {_inlined(r)} THEN false" for r in order)
    return docs.where(F.expr(_bound("w", WORDS, f"CASE {branches} ELSE true END")))


def op10_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    """Statistics and verdict of every document.

    The contract asks for all base statistics of all rows, so only the further rules are cut short.
    """
    docs = table(spark, directory, "documents").select("doc_id", "text")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    order = ranked(docs, MORE)
    extra = sorted({u for r in MORE for u in r.uses} - set(base))
    df = docs.select("doc_id", "text", F.expr(WORDS).alias("w"))
    df = df.select("doc_id", "text", "w", *[F.expr(_sql(n)).alias(n) for n in base])
    failed = F.expr(" OR ".join(f"({r.reject})" for r in BASE))
    inline = []
    for rule in order:
        sql = f" {rule.reject} "
        for name in extra:
            sql = sql.replace(f" {name} ", f" {_sql(name)} ")
        inline.append(f"WHEN {sql} THEN false")
    verdict = F.expr(f"CASE {' '.join(inline)} ELSE true END")
    return df.select(
        "doc_id", *base, failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(verdict).alias("kept")
    )


_SPACE_CLASS = r"[\x20\x09-\x0D]+"
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '{_SPACE_CLASS}'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) >= 3) AS s),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) AS s WHERE c > 1),
p AS (SELECT r, count(DISTINCT i + j) AS n FROM t, (SELECT unnest([0, 1, 2]) AS j) AS o GROUP BY r),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '{_SPACE_CLASS}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  regexp_matches(text, '[A-Z][A-Z]') AND NOT regexp_matches(text, '\\p{{Ll}}') AS capitals_only,
  CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM a LEFT JOIN p ON a.r = p.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {' OR '.join(f'({r.reject})' for r in MORE)}) AS kept
FROM b"""
