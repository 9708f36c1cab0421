"""URL filters as a sort-merge range join (operator 1).

A host is written with its labels reversed, each closed by a comma (``com,example,www,``), so a
rule's host and all its subdomains form one interval of keys. Keys and rules are sorted together; a
sweep keeps a stack of the rule hosts whose interval holds the current key. Intervals nest, so the
stack is as deep as hosts have labels. The rules on the stack are tested by path, and the longest wins.

A small rule table (counted, at most RULE_ROWS) goes to every task, which sweeps its own rows: no
row is shuffled. A larger one is dealt with the keys by ranges of the key, each range getting the rules whose
interval touches it; the cut points are a bounded sample's quantiles and decide balance only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlab.llm.common import parts_of, table

RULE_ROWS = 100_000
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DEFAULT = "allow"
HIGH = "\U0010ffff"
SAMPLE_ROWS = 10_000


def split_url(url):
    """``host, path`` columns: both empty without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def host_key(host):
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(",")))


def _key(host: str) -> str:
    return ",".join(reversed(host.split("."))) + "," if host else ""


def _sweep(keys: Iterable[tuple[str, str, int]], rules: list[tuple[str, str, str, str]]) -> Iterator[tuple[int, tuple | None]]:
    """Best rule of each (key, path, row), keys sorted; rules are (key, path, rule, verdict)."""
    by_host: dict[str, list] = {}
    for rule in rules:
        by_host.setdefault(rule[0], []).append(rule)
    hosts = sorted(by_host)
    stack: list[str] = []
    at = 0
    for key, path, row in keys:
        while at < len(hosts) and hosts[at] <= key:
            while stack and not hosts[at].startswith(stack[-1]):
                stack.pop()
            stack.append(hosts[at])
            at += 1
        while stack and not key.startswith(stack[-1]):
            stack.pop()
        fits = [r for host in stack for r in by_host[host] if path.startswith(r[1])]
        # longest rule; of equals the one with the longer host, then block before allow
        yield row, max(fits, key=lambda r: (len(r[2]), len(r[0]), r[3])) if fits else None


def _judge(batches: Iterator[pa.RecordBatch], fixed: list | None, default: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, paths = batch.column("__key").to_pylist(), batch.column("__path").to_pylist()
        rules = fixed
        order = sorted(range(batch.num_rows), key=lambda i: (keys[i], paths[i]))
        named, verdict = [None] * batch.num_rows, [default] * batch.num_rows
        for i, rule in _sweep(((keys[i], paths[i], i) for i in order), rules):
            if rule is not None:
                named[i], verdict[i] = rule[2], rule[3]
        columns = [batch.column("__row"), pa.array(named, pa.string()), pa.array(verdict, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "rule", "verdict"])


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, rule_rows: int = RULE_ROWS) -> DataFrame:
    """Rows of ``pages`` plus ``host, path, rule, verdict``.

    ``rules`` has ``verdict`` and ``rule`` (host, then a path from its first ``/`` on). A rule fits its host and
    all subdomains if the url's path starts with the rule's; the longest rule wins. Without one ``rule`` is
    null and ``verdict`` the default. A null url, or one without ``://``, has an empty host and path. Null
    rules are left out, repeated ones count once. Input columns named like the results are replaced.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col("`url`"))
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    inner = rows.select(F.struct("*").alias("__row"), host_key(F.col("host")).alias("__key"), F.col("path").alias("__path"))
    clean = rules.where("rule IS NOT NULL AND verdict IS NOT NULL").select(
        F.regexp_extract("rule", r"^[^/]*", 0).alias("h"), "rule", "verdict"
    ).distinct()
    clean = clean.select(host_key(F.lower("h")).alias("key"), F.expr("substring(rule, length(h) + 1)").alias("path"), "rule", "verdict")
    out = f"row {inner.schema['__row'].dataType.simpleString()}, rule string, verdict string"
    few = clean.limit(rule_rows + 1).collect()
    if len(few) <= rule_rows:
        fixed = [tuple(r) for r in few]
        judged = inner.mapInArrow(lambda it: _judge(it, fixed, default), out)
    else:
        # salted keys cut a host that fills many ranges; a rule goes to every range its interval touches
        salted = inner.withColumn("__salt", F.concat("__key", "__path", F.lit("\x00"), F.hex(F.xxhash64("__row"))))
        sample = sorted(r[0] for r in salted.select("__salt").sample(0.05, 7).limit(SAMPLE_ROWS).collect())
        n = parts_of(spark)
        cuts = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
        place = F.udf(lambda k: bisect_right(cuts, k), "int")
        span = F.udf(lambda k: list(range(bisect_left(cuts, k), bisect_right(cuts, k + HIGH) + 1)), "array<int>")
        left = salted.withColumn("__part", place("__salt"))
        right = clean.withColumn("__part", F.explode(span("key")))

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        wanted = to_arrow_schema(StructType.fromDDL(out))

        def merged(key, pages_, rules_):  # one range of keys and its rules
            fixed = list(zip(*[rules_.column(c).to_pylist() for c in ("key", "path", "rule", "verdict")]))
            judged = list(_judge(iter(pages_.combine_chunks().to_batches()), fixed, default))
            return pa.Table.from_batches(judged).cast(wanted) if judged else wanted.empty_table()

        judged = left.groupBy("__part").cogroup(right.groupBy("__part")).applyInArrow(merged, out)
    return judged.select("row.*", "rule", "verdict")


def op1_url_filters(spark: SparkSession, directory: str) -> DataFrame:
    pages = table(spark, directory, "pages").select("page_id", "url")
    rules = spark.createDataFrame(list(RULES), "verdict string, rule string")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_FITS = """(h = '{0}' OR ends_with(h, '.{0}')) AND starts_with(p, '{1}')"""
OP1_SQL = """
WITH a AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT page_id, lower(raw) AS h, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS p FROM b),
d AS (SELECT page_id, h AS host, p AS path, CASE
  WHEN {0} THEN 'www.example.com/en/' WHEN {1} THEN 'example.com/en/' WHEN {2} THEN 'com/'
  WHEN {3} THEN 'net/es/' WHEN {4} THEN 'net/fr/' END AS rule FROM c)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM d
""".format(*[_FITS.format(h, p) for h, p in (("www.example.com", "/en/"), ("example.com", "/en/"), ("com", "/"), ("net", "/es/"), ("net", "/fr/"))])
