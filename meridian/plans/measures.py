"""Rules, cleaning and the semantic layer: measures by slice, evaluated together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..operators.rules import Rule, evaluate
from ..operators.distinct import distinct_counts, distinct_state
from ..sources.scratch import written
from .registry import query, read

_LINE_RULES = [
    ("quantity_range", "hard", "l_quantity >= 1 AND l_quantity <= 50", None, None),
    ("discount_range", "hard", "l_discount >= 0 AND l_discount <= 0.1", None, None),
    ("price_known", "inferred", "l_extendedprice > 900", "l_returnflag <> 'N'", None),
    ("tax_small", "plausibility", "l_tax <= 0.06", "l_linestatus = 'O'", "l_quantity > 5"),
    ("status_code", "hard", "l_returnflag IN ('A', 'N', 'R')", None, None),
]


def _rule_sql(name: str, kind: str, ok: str, applies: str | None, ready: str | None) -> str:
    a, r = applies or "true", ready or "true"
    return f"SELECT '{name}' AS rule, '{kind}' AS kind, count(*) AS n_rows, count(*) FILTER (NOT ({a})) AS not_applicable, count(*) FILTER (({a}) AND NOT ({r})) AS unassessable, count(*) FILTER (({a}) AND ({r}) AND ({ok})) AS passed, count(*) FILTER (({a}) AND ({r}) AND NOT ({ok})) AS failed FROM lineitem"


@query(" UNION ALL ".join(_rule_sql(*r) for r in _LINE_RULES))
def dq_rulebook(spark, sf_dir) -> DataFrame:
    e = lambda s: None if s is None else F.expr(s)
    return evaluate(read(spark, sf_dir, "lineitem"), [Rule(n, k, F.expr(ok), e(a), e(r)) for n, k, ok, a, r in _LINE_RULES])


@query("""WITH r AS (SELECT 'orders' AS table_name, count(*) AS denominator, count(*) FILTER (o_totalprice > 0) AS numerator FROM orders UNION ALL SELECT 'customer', count(*), count(*) FILTER (c_acctbal >= 0) FROM customer UNION ALL SELECT 'part', count(*), count(*) FILTER (p_size <= 40) FROM part UNION ALL SELECT 'supplier', count(*) FILTER (s_acctbal > 1e9), 0 FROM supplier)
SELECT table_name, numerator, denominator, round(100.0 * numerator / nullif(denominator, 0), 3) AS pct FROM r""")
def ag25_scorecard(spark, sf_dir) -> DataFrame:
    one = lambda name, ok, every="true": read(spark, sf_dir, name).agg(F.lit(name).alias("table_name"), F.count_if(F.expr(f"({every}) and ({ok})")).alias("numerator"), F.count_if(F.expr(every)).alias("denominator"))
    all_ = one("orders", "o_totalprice > 0").unionByName(one("customer", "c_acctbal >= 0")).unionByName(one("part", "p_size <= 40")).unionByName(one("supplier", "false", "s_acctbal > 1e9"))
    return all_.withColumn("pct", F.round(100 * cells.divide(F.col("numerator"), F.col("denominator")), 3))


@query("""SELECT 'customer_pk' AS check_name, CASE WHEN count(*) = count(DISTINCT c_custkey) THEN 'PASS' ELSE 'FAIL' END AS status FROM customer
UNION ALL SELECT 'line_grain', CASE WHEN count(*) = count(DISTINCT (l_orderkey, l_linenumber)) THEN 'PASS' ELSE 'FAIL' END FROM lineitem
UNION ALL SELECT 'orders_customer_fk', CASE WHEN count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0 THEN 'PASS' ELSE 'FAIL' END FROM orders
UNION ALL SELECT 'order_dates', CASE WHEN count(*) FILTER (o_orderdate < TIMESTAMP '1992-01-01' OR o_orderdate > TIMESTAMP '2002-12-31') = 0 THEN 'PASS' ELSE 'FAIL' END FROM orders
UNION ALL SELECT 'negative_balances', CASE WHEN count(*) FILTER (c_acctbal < 0) = 0 THEN 'PASS' ELSE 'INFO' END FROM customer""")
def sv_star_checks(spark, sf_dir) -> DataFrame:
    status = lambda ok, bad="FAIL": F.when(ok, "PASS").otherwise(bad)
    c, o, l = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    unique = lambda d, keys, name: d.groupBy(*keys).count().agg(F.lit(name).alias("check_name"), status(F.coalesce(F.max("count"), F.lit(0)) <= 1).alias("status"))
    rows = [
        unique(c, ["c_custkey"], "customer_pk"),
        unique(l, ["l_orderkey", "l_linenumber"], "line_grain"),
        o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.lit("orders_customer_fk").alias("check_name"), status(F.count("*") == 0).alias("status")),
        o.agg(F.lit("order_dates").alias("check_name"), status(F.count_if((F.col("o_orderdate") < F.lit("1992-01-01").cast("timestamp")) | (F.col("o_orderdate") > F.lit("2002-12-31").cast("timestamp"))) == 0).alias("status")),
        c.agg(F.lit("negative_balances").alias("check_name"), status(F.count_if(F.col("c_acctbal") < 0) == 0, "INFO").alias("status")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


_PROFILE = "SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_filled, count(DISTINCT {c}) AS n_distinct, CAST(min(length(CAST({c} AS VARCHAR))) AS INTEGER) AS shortest, CAST(max(length(CAST({c} AS VARCHAR))) AS INTEGER) AS longest, min(CAST({c} AS VARCHAR)) AS least, max(CAST({c} AS VARCHAR)) AS most FROM customer"


@query(" UNION ALL ".join(_PROFILE.format(c=c) for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
def dq_profile_columns(spark, sf_dir) -> DataFrame:
    """Rows are spread before anything is counted, and each column's distinct values are counted on their own: no task holds a column, and no row is expanded."""
    spread = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    out = None
    for c in spread.columns:
        s = F.col(c).cast("string")
        one = spread.groupBy(c).agg(F.count("*").alias("m")).agg(F.lit(c).alias("column_name"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("m"))), F.lit(0)).alias("n_filled"), F.count(c).alias("n_distinct"), F.min(F.length(s)).alias("shortest"), F.max(F.length(s)).alias("longest"), F.min(s).alias("least"), F.max(s).alias("most"))
        out = one if out is None else out.unionByName(one)
    return out.select("column_name", "n_rows", "n_filled", "n_distinct", "shortest", "longest", "least", "most")


@query("""WITH b AS (SELECT user_id, CAST(ts AS DATE) AS d, arg_max(value, (ts, event_id)) AS balance FROM events GROUP BY 1, 2),
s AS (SELECT c_mktsegment AS segment, CAST(date_trunc('week', d) AS DATE) AS week, d, balance, user_id FROM b JOIN customer ON user_id = c_custkey),
l AS (SELECT *, max(d) OVER (PARTITION BY segment, week) AS last_day FROM s)
SELECT segment, week, last_day, round(sum(balance), 2) AS ending_balance, count(DISTINCT user_id) AS ending_clients, round(sum(balance) / count(DISTINCT user_id), 4) AS balance_per_client FROM l WHERE d = last_day GROUP BY 1, 2, 3""", dates=("week", "last_day"))
def ms_day_balance(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "ts", "event_id", "value")
    b = e.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.max(F.struct("ts", "event_id", "value"))["value"].alias("balance"))
    s = b.join(read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), F.col("user_id") == F.col("c_custkey"))
    # Added as decimals, so that neither the sum nor a half of the quotient depends on the order of the rows; as doubles only where a balance has more places.
    exact = F.col("balance").try_cast("decimal(24,8)")
    fits = F.bool_and(F.col("balance").isNull() | F.coalesce(exact.cast("double") == F.col("balance"), F.lit(False)))
    day = s.groupBy(F.col("c_mktsegment").alias("segment"), F.to_date(F.date_trunc("week", "d")).alias("week"), "d").agg(F.when(fits, F.sum(exact)).alias("total"), F.sum("balance").alias("rough"), F.count("*").alias("clients"))
    last = day.groupBy("segment", "week").agg(F.max_by(F.struct("d", "total", "rough", "clients"), "d").alias("x"))
    total, rough, n = F.col("x.total"), F.col("x.rough"), F.col("x.clients")
    shown = lambda x, y, places: F.coalesce(F.round(x, places).cast("double"), F.round(y, places))
    return last.select("segment", "week", F.col("x.d").alias("last_day"), shown(total, rough, 2).alias("ending_balance"), n.alias("ending_clients"), shown(total / n, rough / n, 4).alias("balance_per_client"))


@query("""WITH b AS (SELECT c_mktsegment AS segment, CAST(extract(year FROM o_orderdate) AS INTEGER) AS year, o_custkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY segment, year ORDER BY t DESC, o_custkey) AS k FROM b)
SELECT segment, year, round(CAST(sum(t) FILTER (k <= 10) AS DOUBLE) / nullif(CAST(sum(t) AS DOUBLE), 0), 6) AS top10_share FROM r GROUP BY 1, 2""")
def sl02_top10_share(spark, sf_dir) -> DataFrame:
    b = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum(cells.money(F.col("o_totalprice"))).alias("t"))
    b = b.join(read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_mktsegment", "segment")
    r = b.withColumn("k", F.row_number().over(Window.partitionBy("segment", "year").orderBy(F.desc("t"), "o_custkey")))
    return r.groupBy("segment", "year").agg(F.round(cells.divide(F.sum(F.when(F.col("k") <= 10, F.col("t"))), F.sum("t")), 6).alias("top10_share"))


_CLIENTS = "SELECT c_mktsegment AS segment, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS priority, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey"
_CONTEXT = "SELECT '{0}' AS context, {1} AS segment, {2} AS year, {3} AS priority, count(DISTINCT o_custkey) AS n_clients FROM c {4} GROUP BY ALL"


@query(f"WITH c AS ({_CLIENTS}) " + " UNION ALL ".join([_CONTEXT.format("all", "NULL", "NULL", "NULL", ""), _CONTEXT.format("year", "NULL", "year", "NULL", ""), _CONTEXT.format("segment and year", "segment", "year", "NULL", ""), _CONTEXT.format("priority", "NULL", "NULL", "priority", ""), _CONTEXT.format("urgent before 1998", "segment", "NULL", "NULL", "WHERE priority LIKE '1%' AND year < 1998")]))
def ms05_distinct_clients(spark, sf_dir) -> DataFrame:
    """MS-05, AG-04: clients of contexts that cut across years, segments and priorities, by merging bitmaps; orders are read once, and written once as state."""
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderpriority").join(read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    facts = o.select(F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority"), "o_custkey")
    state = written(distinct_state(facts, ["segment", "year", "priority"], "o_custkey"))
    contexts = {"all": ([], None), "year": (["year"], None), "segment and year": (["segment", "year"], None), "priority": (["priority"], None), "urgent before 1998": (["segment"], F.col("priority").startswith("1") & (F.col("year") < 1998))}
    return distinct_counts(state, contexts, "n_clients")
