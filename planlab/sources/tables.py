"""Base tables: Parquet scans by name, explicit schemas for delimited files, SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Row types of the delimited TPC-H files, in file order (fixed values).
TPCH_SCHEMAS = {
    "lineitem": "orderkey int, partkey int, suppkey int, linenumber int, quantity double, "
    "extendedprice double, discount double, tax double, returnflag string, linestatus string, "
    "shipdate date, commitdate date, receiptdate date, shipinstruct string, shipmode string, "
    "comment string",
    "orders": "orderkey int, custkey int, orderstatus string, totalprice double, orderdate date, "
    "orderpriority string, clerk string, shippriority int, comment string",
    "customer": "custkey int, name string, address string, nationkey int, phone string, "
    "acctbal double, mktsegment string, comment string",
    "part": "partkey int, name string, mfgr string, brand string, type string, size int, "
    "container string, retailprice double, comment string",
    "partsupp": "partkey int, suppkey int, availqty int, supplycost double, comment string",
    "supplier": "suppkey int, name string, address string, nationkey int, phone string, "
    "acctbal double, comment string",
    "nation": "nationkey int, name string, regionkey int, comment string",
}

# Row types of the delimited film tables (fixed values).
FILM_SCHEMAS = {
    "title.principals": "titleId string, ordering int, nconst string, category string, "
    "job string, characters string",
    "title.akas": "titleId string, ordering int, title string, region string, language string, "
    "types string, attributes string, isOriginalTitle string",
    "title.ratings": "titleId string, averageRating double, numVotes int",
    "title.basics": "titleId string, titleType string, primaryTitle string, "
    "originalTitle string, isAdult string, startYear int, endYear int, runtimeMinutes int, "
    "genres string",
    "name.basics": "nconst string, primaryName string, birthYear int, deathYear int, "
    "primaryProfession string, knownForTitles string",
}


class Tables:
    """Named Parquet tables of one directory; attribute access gives a lazy scan."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def register(self, *names: str) -> SparkSession:
        """Expose tables to ``spark.sql``."""
        for name in names:
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    sep: str = "|",
    date_fields: tuple[str, ...] = (),
    date_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """Header-less delimited scan typed by position; declared date fields are parsed."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    raw = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name in date_fields else f.dataType) for f in schema]
    )
    df = spark.read.schema(raw).option("sep", sep).option("dateFormat", date_format).csv(path)
    return df.withColumns({c: F.to_date(c, date_format) for c in date_fields})


def read_tpch(spark: SparkSession, path: str, table: str, sep: str = "|") -> DataFrame:
    return read_delimited(spark, path, TPCH_SCHEMAS[table], sep)


def read_film(spark: SparkSession, path: str, table: str, sep: str = ";") -> DataFrame:
    return read_delimited(spark, path, FILM_SCHEMAS[table], sep)


def sql_view(df: DataFrame, name: str) -> SparkSession:
    """Register ``df`` as a view and hand back the session to query it with."""
    df.createOrReplaceTempView(name)
    return df.sparkSession


def micros(column: str):
    """Zone-independent microseconds since the epoch of a zone-less timestamp column."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")
