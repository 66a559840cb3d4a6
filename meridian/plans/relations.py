"""Coercions, column lookup, marks of repeated rows, joins with clashing names, and the row and table functions of a semantic layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..operators import relational as rel
from .registry import query, read

_TEXT = "CASE WHEN l_linenumber = 7 THEN 'n/a' WHEN l_linenumber = 6 THEN ' ' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END"


def _amounts(spark, sf_dir) -> DataFrame:
    n = F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem", "l_linenumber", "l_quantity").select(F.when(n == 7, "n/a").when(n == 6, " ").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("s"))


@query(f"SELECT count(*) AS n_rows, count(*) FILTER (trim(s) <> '' AND try_cast(s AS DOUBLE) IS NULL) AS n_newly_null, count(*) FILTER (trim(s) = '') AS n_blank, sum(try_cast(s AS DOUBLE)) AS total FROM (SELECT {_TEXT} AS s FROM lineitem) t")
def prd23_coercion(spark, sf_dir) -> DataFrame:
    """PRD-23, PRD-03: numbers of texts, and how many filled cells became null."""
    t = _amounts(spark, sf_dir).withColumn("x", cells.number(F.col("s")))
    return t.agg(F.count("*").alias("n_rows"), F.count_if(~cells.is_blank(F.col("s")) & F.col("x").isNull()).alias("n_newly_null"), F.count_if(cells.is_blank(F.col("s"))).alias("n_blank"), F.sum("x").alias("total"))


@query(f"SELECT CAST(sum(CAST(s AS DOUBLE)) AS DOUBLE) AS total, count(*) AS n FROM (SELECT {_TEXT} AS s, l_linenumber FROM lineitem) t WHERE l_linenumber < 6")
def prd04_numeric_or_stop(spark, sf_dir) -> DataFrame:
    """PRD-04: a column that must be numeric throughout; a cell that isn't stops the query."""
    t = _amounts(spark, sf_dir).where("s not in ('n/a', ' ')")
    return rel.numeric_or_stop(t, ["s"]).agg(F.sum("s").alias("total"), F.count("*").alias("n"))


@query("SELECT count(o_totalprice) AS n, max(o_totalprice) AS high FROM orders")
def prd20_column_lookup(spark, sf_dir) -> DataFrame:
    """PRD-20: the column of an exact name, else the first whose name holds the keyword."""
    o = read(spark, sf_dir, "orders")
    name = rel.find_column(o.columns, ["amount", "total_price"], "price")
    return o.agg(F.count(name).alias("n"), F.max(name).alias("high"))


@query("SELECT c_custkey AS id, c_name AS name, n_name AS name_nation, c_nationkey AS key FROM customer JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey")
def jn03_inner_suffixed(spark, sf_dir) -> DataFrame:
    """JN-03: a many-to-one inner join whose clashing columns get a suffix."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("key"))
    n = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return rel.inner_suffixed(c, n, ["key"], "_nation")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) > 1 AS after_first, count(*) OVER (PARTITION BY p_brand, p_size) > 1 AS in_group FROM part")
def wn05_duplicate_marks(spark, sf_dir) -> DataFrame:
    """WN-05: rows that repeat a key, all of them and those after the first."""
    w = Window.partitionBy("p_brand", "p_size")
    p = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    return p.select("p_partkey", (F.row_number().over(w.orderBy("p_partkey")) > 1).alias("after_first"), (F.count("*").over(w) > 1).alias("in_group"))


@query("""SELECT c_mktsegment, count(*) AS countrows, count(DISTINCT c_nationkey) + max(CASE WHEN c_nationkey IS NULL THEN 1 ELSE 0 END) AS distinctcount, min(c_acctbal) AS low, max(c_acctbal) AS high, round(sum(c_acctbal), 2) AS total, round(sum(c_acctbal * (1 + c_nationkey)), 2) AS sumx, round(sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer), 6) AS share FROM customer GROUP BY 1""")
def ag31_summarize(spark, sf_dir) -> DataFrame:
    """AG-31: summaries by a column with added columns: rows, distinct values, extremes, a sum, a sum of an expression, a share of all."""
    c = read(spark, sf_dir, "customer", "c_mktsegment", "c_nationkey", "c_acctbal")
    b, k = F.col("c_acctbal"), F.col("c_nationkey")
    s = c.groupBy("c_mktsegment").agg(F.count("*").alias("countrows"), (F.countDistinct(k) + F.max(k.isNull().cast("long"))).alias("distinctcount"), F.min(b).alias("low"), F.max(b).alias("high"), F.sum(b).alias("t"), F.round(F.sum(b * (1 + k)), 2).alias("sumx"))
    total = c.agg(F.sum(b).alias("all"))
    return s.join(F.broadcast(total)).select("c_mktsegment", "countrows", "distinctcount", "low", "high", F.round("t", 2).alias("total"), "sumx", F.round(cells.divide(F.col("t"), F.col("all")), 6).alias("share"))


@query("SELECT o_orderkey, CAST(CAST(o_orderkey AS DECIMAL(18, 3)) + CAST(0.125 AS DECIMAL(4, 3)) AS VARCHAR) AS exact, CAST(o_orderkey AS DOUBLE) + 0.12 AS half_even, CAST(o_orderkey AS DOUBLE) + 0.13 AS half_up FROM orders")
def fn_rnd_halves(spark, sf_dir) -> DataFrame:
    """FN-RND, FN-DEC: halves to the even digit and away from zero, from exact decimals."""
    exact = F.col("o_orderkey").cast("decimal(18,3)") + F.lit(0.125).cast("decimal(4,3)")
    return read(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", exact.cast("string").alias("exact"), F.bround(exact, 2).cast("double").alias("half_even"), F.round(exact, 2).cast("double").alias("half_up"))


@query("""SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""", dates=("day",))
def ext_stream_days(spark, sf_dir) -> DataFrame:
    """An extension: the events as a stream, counted by day and type in windows with a watermark; read when the stream has caught up."""
    from ..streaming.windows import caught_up, daily_totals

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, since the table may be a file or a folder of files.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return caught_up(daily_totals(stream), ["day", "event_type"]).select("day", "event_type", "n", F.round("total", 4).alias("total"))
