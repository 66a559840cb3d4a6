"""Profiles, predicates and text classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..operators.quantiles import exact_quantiles
from .registry import query, read

TYPE = "concat(l_returnflag, l_linestatus)"


@query("""WITH v AS (SELECT nullif(l_quantity, 1) AS l_quantity, nullif(l_returnflag, 'R') AS l_returnflag, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_linenumber END AS l_linenumber FROM lineitem)
SELECT 'l_quantity' AS column_name, count(*) AS n_rows, count(*) - count(l_quantity) AS n_null, round(100.0 * (count(*) - count(l_quantity)) / nullif(count(*), 0), 4) AS pct_null FROM v
UNION ALL SELECT 'l_returnflag', count(*), count(*) - count(l_returnflag), round(100.0 * (count(*) - count(l_returnflag)) / nullif(count(*), 0), 4) FROM v
UNION ALL SELECT 'l_linenumber', count(*), count(*) - count(l_linenumber), round(100.0 * (count(*) - count(l_linenumber)) / nullif(count(*), 0), 4) FROM v""")
def ag01_null_profile(spark, sf_dir) -> DataFrame:
    v = read(spark, sf_dir, "lineitem").select(F.nullif("l_quantity", F.lit(1.0)).alias("l_quantity"), F.nullif("l_returnflag", F.lit("R")).alias("l_returnflag"), F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber")).alias("l_linenumber"))
    one = v.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in v.columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), (F.col("n") - F.col(c)).alias("n_null"), F.round(100 * cells.divide(F.col("n") - F.col(c), F.col("n")), 4).alias("pct_null")) for c in v.columns))
    return one.select(F.inline(rows))


_DESCRIBE = "SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS low, round(quantile_cont({c}, 0.25), 6) AS q25, round(median({c}), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS high FROM lineitem"


@query(" UNION ALL ".join(_DESCRIBE.format(c=c) for c in ("l_quantity", "l_extendedprice")))
def ag02_describe(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice")
    stats = lambda c: F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"))
    long = d.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("x")) for c in d.columns))))
    q = exact_quantiles(long, "x", [0.25, 0.5, 0.75], ("column_name",)).select("column_name", *(F.round(f"q{i}", 6).alias(n) for i, n in enumerate(("q25", "q50", "q75"))))
    return d.agg(F.array(*map(stats, d.columns)).alias("x")).select(F.inline("x")).join(F.broadcast(q), "column_name", "left")


@query("""SELECT l_returnflag || l_linestatus AS txn_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct, CAST(row_number() OVER (ORDER BY count(*) DESC, l_returnflag || l_linestatus) AS INTEGER) AS place FROM lineitem GROUP BY 1""")
def ag03_value_counts(spark, sf_dir) -> DataFrame:
    g = read(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus").groupBy(F.expr(TYPE).alias("txn_type")).agg(F.count("*").alias("n"))
    return g.select("txn_type", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("pct"), F.row_number().over(Window.orderBy(F.desc("n"), "txn_type")).alias("place"))


@query("""SELECT count(DISTINCT o_custkey) AS n_customers, count(DISTINCT p) AS n_priorities, count(DISTINCT p) + coalesce(max(CASE WHEN p IS NULL THEN 1 ELSE 0 END), 0) AS n_with_null FROM (SELECT o_custkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders)""")
def ag04_distincts(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"))
    return o.agg(F.countDistinct("o_custkey").alias("n_customers"), F.countDistinct("p").alias("n_priorities"), (F.countDistinct("p") + F.coalesce(F.max(F.col("p").isNull().cast("long")), F.lit(0))).alias("n_with_null"))


@query("""WITH t AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'not a date' WHEN o_orderkey % 11 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s FROM orders),
p AS (SELECT s, CASE WHEN regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(s AS DATE) END AS d FROM t)
SELECT min(d) AS first_date, max(d) AS last_date, count(*) - count(d) AS n_unparsed FROM p""", dates=("first_date", "last_date"))
def ag06_date_range(spark, sf_dir) -> DataFrame:
    day = lambda f: F.date_format("o_orderdate", f)
    t = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(F.when(F.col("o_orderkey") % 7 == 0, "not a date").when(F.col("o_orderkey") % 11 == 0, day("yyyy/MM/dd")).otherwise(day("yyyy-MM-dd")).alias("s"))
    d = cells.strict_date(F.col("s"))
    return t.select(d.alias("d")).agg(F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.count_if(F.col("d").isNull()).alias("n_unparsed"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2) SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_extra, count(*) FILTER (c > 1) AS n_repeating_keys, count(*) AS n_keys FROM g""")
def ag07_dup_counts(spark, sf_dir) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c"))
    return g.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("n_extra"), F.count_if(F.col("c") > 1).alias("n_repeating_keys"), F.count("*").alias("n_keys"))


@query("SELECT round(avg(l_extendedprice), 6) AS mean, round(median(l_extendedprice), 6) AS middle, round(skewness(l_extendedprice), 6) AS skew FROM lineitem")
def ag08_moments(spark, sf_dir) -> DataFrame:
    c = F.col("l_extendedprice")
    d = read(spark, sf_dir, "lineitem", "l_extendedprice")
    middle = exact_quantiles(d, "l_extendedprice", [0.5]).agg(F.round(F.max("q0"), 6).alias("middle"))
    return d.agg(F.round(F.avg(c), 6).alias("mean"), F.round(cells.corrected_skewness(c), 6).alias("skew")).join(F.broadcast(middle)).select("mean", "middle", "skew")


@query("SELECT l_returnflag || l_linestatus AS txn_type, count(*) AS n, round_even(avg(l_quantity), 2) AS mean_quantity, round_even(median(l_quantity), 2) AS median_quantity FROM lineitem GROUP BY 1")
def ag09_group_stats(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "lineitem").select(F.expr(TYPE).alias("txn_type"), "l_quantity")
    middle = exact_quantiles(d, "l_quantity", [0.5], ("txn_type",)).select("txn_type", F.bround("q0", 2).alias("median_quantity"))
    g = d.groupBy("txn_type").agg(F.count("*").alias("n"), F.bround(F.avg("l_quantity"), 2).alias("mean_quantity"))
    return g.join(F.broadcast(middle), "txn_type", "left").orderBy(F.desc("mean_quantity"), "txn_type")


@query("""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem),
u AS (SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, a AS r FROM c UNION ALL SELECT 'l_quantity', 'l_discount', b FROM c UNION ALL SELECT 'l_extendedprice', 'l_discount', c FROM c)
SELECT x, y, round(r, 6) AS r, CAST(row_number() OVER (ORDER BY abs(r) DESC, x, y) AS INTEGER) AS place FROM u""")
def ag10_corr_pairs(spark, sf_dir) -> DataFrame:
    pairs = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]
    one = read(spark, sf_dir, "lineitem").agg(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), cells.correlation(F.col(x), F.col(y)).alias("r")) for x, y in pairs)).alias("p"))
    return one.select(F.inline("p")).select("x", "y", F.round("r", 6).alias("r"), F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "x", "y")).alias("place"))


@query("SELECT n_name, min(c_acctbal) AS low, max(c_acctbal) AS high, count(*) FILTER (c_acctbal < 0) AS n_negative, count(*) FILTER (nullif(c_mktsegment, 'BUILDING') IS NULL) AS n_missing FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def ag11_cond_agg(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.groupBy("n_name").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.count_if(F.col("c_acctbal") < 0).alias("n_negative"), F.count_if(F.nullif("c_mktsegment", F.lit("BUILDING")).isNull()).alias("n_missing"))


@query("SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS VARCHAR) AS total FROM orders GROUP BY 1")
def ag12_exact_sum(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.sum(cells.money(F.col("o_totalprice"))).cast("string").alias("total"))


@query("SELECT user_id, CASE WHEN bool_and(NOT (event_id % 13 = 0)) THEN CAST(sum(CAST(value AS DECIMAL(18, 2))) AS VARCHAR) END AS total FROM events GROUP BY 1")
def ag13_all_or_nothing(spark, sf_dir) -> DataFrame:
    ok = F.col("event_id") % 13 != 0
    return read(spark, sf_dir, "events", "event_id", "user_id", "value").groupBy("user_id").agg(F.when(F.bool_and(ok), F.sum(cells.money(F.col("value"))).cast("string")).alias("total"))


@query("""WITH f AS (SELECT l_returnflag AS g, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem WHERE l_quantity <= 30 GROUP BY 1)
SELECT g, round(any_value(q1 - 1.5 * (q3 - q1)), 4) AS low_fence, round(any_value(q3 + 1.5 * (q3 - q1)), 4) AS high_fence, count(*) FILTER (l_extendedprice < q1 - 1.5 * (q3 - q1)) AS n_low, count(*) FILTER (l_extendedprice > q3 + 1.5 * (q3 - q1)) AS n_high FROM lineitem JOIN f ON g = l_returnflag GROUP BY g""")
def ag14_iqr_fences(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice").withColumnRenamed("l_returnflag", "g")
    f = exact_quantiles(d.where("l_quantity <= 30"), "l_extendedprice", [0.25, 0.75], ("g",))
    f = F.broadcast(f.select("g", (F.col("q0") - 1.5 * (F.col("q1") - F.col("q0"))).alias("low"), (F.col("q1") + 1.5 * (F.col("q1") - F.col("q0"))).alias("high")))
    return d.join(f, "g").groupBy("g").agg(F.round(F.first("low"), 4).alias("low_fence"), F.round(F.first("high"), 4).alias("high_fence"), F.count_if(F.col("l_extendedprice") < F.col("low")).alias("n_low"), F.count_if(F.col("l_extendedprice") > F.col("high")).alias("n_high"))


@query("""WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS k FROM c)
SELECT p_brand, string_agg('''' || p_size || ''':' || n, '; ' ORDER BY k) AS top_sizes FROM r WHERE k <= 5 GROUP BY 1""")
def ag16_topn_text(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "part", "p_brand", "p_size").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    r = c.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_size"))).where("k <= 5")
    items = F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("'"), "p_size", F.lit("':"), "n").alias("t"))))
    return r.groupBy("p_brand").agg(F.array_join(F.transform(items, lambda x: x["t"]), "; ").alias("top_sizes"))


@query("""WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS k, count(*) OVER (PARTITION BY p_type) AS n_values FROM c)
SELECT p_type, p_brand AS dominant, n AS n_dominant, n_values FROM r WHERE k = 1""")
def ag17_mode_map(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "part", "p_type", "p_brand").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("m"), "p_brand"))
    return c.groupBy("p_type").agg(top.alias("t"), F.count("*").alias("n_values")).select("p_type", F.col("t.p_brand").alias("dominant"), (-F.col("t.m")).alias("n_dominant"), "n_values")


@query("""WITH m AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders)
SELECT o_custkey, min(m) AS first_month, max(m) AS last_month, count(*) AS observed, CAST(date_diff('month', min(m), max(m)) + 1 - count(*) AS BIGINT) AS missing FROM m GROUP BY 1""", dates=("first_month", "last_month"))
def ag18_history_gaps(spark, sf_dir) -> DataFrame:
    m = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate").select("o_custkey", F.trunc("o_orderdate", "MM").alias("m")).distinct()
    return m.groupBy("o_custkey").agg(F.min("m").alias("first_month"), F.max("m").alias("last_month"), F.count("*").alias("observed"), (F.months_between(F.max("m"), F.min("m")).cast("long") + 1 - F.count("*")).alias("missing"))


_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


@query("SELECT event_type, " + ", ".join(f"count(*) FILTER (dayname(ts) = '{d}') AS {d}" for d in _DAYS) + " FROM events GROUP BY 1")
def ag20_pivot(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "events", "event_type", "ts").withColumn("day", F.date_format("ts", "EEEE"))
    return d.groupBy("event_type").pivot("day", _DAYS).count().na.fill(0)


@query("""SELECT p_type, concat_ws('+', CASE WHEN count(DISTINCT p_brand) > 1 THEN 'p_brand' END, CASE WHEN count(DISTINCT p_size) > 1 THEN 'p_size' END, CASE WHEN count(DISTINCT p_name) > 1 THEN 'p_name' END) AS differing, bool_and(p_retailprice > 0) AS all_priced, bool_or(p_size > 45) AS any_large FROM part GROUP BY 1""")
def ag22_differing_attrs(spark, sf_dir) -> DataFrame:
    differs = F.concat_ws("+", *(F.when(F.min(c) < F.max(c), c) for c in ("p_brand", "p_size", "p_name")))
    return read(spark, sf_dir, "part").groupBy("p_type").agg(differs.alias("differing"), F.bool_and(F.col("p_retailprice") > 0).alias("all_priced"), F.bool_or(F.col("p_size") > 45).alias("any_large"))


@query("SELECT l_returnflag, round(sum(l_discount * l_extendedprice) / nullif(sum(l_extendedprice), 0), 6) AS weighted, round(sum(CASE WHEN l_quantity > 99 THEN l_tax END) / nullif(sum(CASE WHEN l_quantity > 99 THEN 1 END), 0), 6) AS none_left FROM lineitem GROUP BY 1")
def ag24_weighted_ratio(spark, sf_dir) -> DataFrame:
    w, x = F.col("l_extendedprice"), F.col("l_discount")
    big = F.col("l_quantity") > 99
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(cells.divide(F.sum(x * w), F.sum(w)), 6).alias("weighted"), F.round(cells.divide(F.sum(F.when(big, F.col("l_tax"))), F.sum(F.when(big, 1))), 6).alias("none_left"))


@query("""SELECT c_mktsegment, CAST(extract(year FROM o_orderdate) AS INTEGER) AS year, CAST(grouping(c_mktsegment) AS INTEGER) AS is_total, CAST(grouping(extract(year FROM o_orderdate)) AS INTEGER) AS is_subtotal, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS VARCHAR) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, extract(year FROM o_orderdate))""")
def ag30_rollup(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice").join(read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).withColumn("year", F.year("o_orderdate"))
    return d.rollup("c_mktsegment", "year").agg(F.grouping("c_mktsegment").cast("int").alias("is_total"), F.grouping("year").cast("int").alias("is_subtotal"), F.count("*").alias("n"), F.sum(cells.money(F.col("o_totalprice"))).cast("string").alias("total"))


_CELLS = """WITH t AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN event_id || '.0' WHEN 2 THEN '1e400' WHEN 3 THEN '2024-1-5' WHEN 4 THEN '2024-02-30' WHEN 5 THEN strftime(ts, '%Y-%m-%d') WHEN 6 THEN 'True' WHEN 7 THEN '  ' ELSE 'None' END AS s FROM events)
SELECT s, regexp_full_match(s, '\\s*') AS blank, regexp_full_match(s, '[+-]?[0-9]+') AS is_int, regexp_full_match(s, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AS is_float, coalesce(regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(s AS DATE) IS NOT NULL, false) AS is_date, s IN ('True', 'False') AS is_bool,
CASE WHEN regexp_full_match(s, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND s <> '1e400' THEN try_cast(s AS DOUBLE) END AS num FROM t"""


@query(_CELLS)
def prd_parse_kinds(spark, sf_dir) -> DataFrame:
    i = F.col("event_id") % 9
    text = F.when(i == 0, F.col("event_id").cast("string")).when(i == 1, F.concat("event_id", F.lit(".0"))).when(i == 2, "1e400").when(i == 3, "2024-1-5").when(i == 4, "2024-02-30").when(i == 5, F.date_format("ts", "yyyy-MM-dd")).when(i == 6, "True").when(i == 7, "  ").otherwise("None")
    s = F.col("s")
    t = read(spark, sf_dir, "events", "event_id", "ts").select(text.alias("s"))
    return t.select("s", cells.is_blank(s).alias("blank"), *(cells.parses_as(s, k).alias(f"is_{k}") for k in ("int", "float", "date", "bool")), cells.number(s).alias("num"))


@query("SELECT regexp_replace(regexp_replace(c_name, '[A-Za-z]+', 'A', 'g'), '[0-9]+', '9', 'g') AS shape, count(*) AS n, count(DISTINCT lower(c_name)) AS n_values FROM customer GROUP BY 1")
def prd_shapes(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "customer", "c_name")
    return d.groupBy(cells.value_shape(F.col("c_name")).alias("shape")).agg(F.count("*").alias("n"), F.countDistinct(F.lower("c_name")).alias("n_values"))


@query("""WITH t AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'N/A' WHEN 1 THEN ' none ' WHEN 2 THEN upper(o_orderstatus) || ' ' ELSE o_orderstatus END AS s FROM orders)
SELECT count(*) FILTER (lower(trim(s)) IN ('na', 'n/a', 'null', 'none', 'nan', '-', '?', 'missing', 'nil')) AS n_tokens, count(*) FILTER (s IN ('F', 'O')) AS n_exact, count(*) FILTER (s NOT IN ('F', 'O') AND lower(trim(s)) IN ('f', 'o')) AS n_near, count(*) FILTER (s NOT IN ('F', 'O')) AS n_other FROM t""")
def prd_tokens_allowed(spark, sf_dir) -> DataFrame:
    i = F.col("o_orderkey") % 6
    t = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(F.when(i == 0, "N/A").when(i == 1, " none ").when(i == 2, F.concat(F.upper("o_orderstatus"), F.lit(" "))).otherwise(F.col("o_orderstatus")).alias("s"))
    low, exact = F.lower(F.trim("s")), F.coalesce(F.col("s").isin("F", "O"), F.lit(False))
    return t.agg(F.count_if(low.isin(*cells.NULL_TOKENS)).alias("n_tokens"), F.count_if(exact).alias("n_exact"), F.count_if(~exact & low.isin("f", "o")).alias("n_near"), F.count_if(~exact).alias("n_other"))


@query("""SELECT CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 7500 THEN 'middle' ELSE 'high' END AS band, count(*) AS n, count(*) FILTER (c_acctbal < -500 OR c_acctbal > 9000) AS n_out, count(*) FILTER (NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')) AS n_bad_name FROM customer GROUP BY 1""")
def prd_ranges(spark, sf_dir) -> DataFrame:
    b = F.col("c_acctbal")
    band = F.when(b < 0, "negative").when(b < 2500, "low").when(b < 7500, "middle").otherwise("high")
    return read(spark, sf_dir, "customer").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if(cells.out_of_bounds(b, -500, 9000)).alias("n_out"), F.count_if(~F.col("c_name").rlike("^Customer#[0-9]{9}$")).alias("n_bad_name"))


@query("""WITH t AS (SELECT l_returnflag, CASE WHEN l_returnflag = 'N' AND l_linenumber < 6 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS s FROM lineitem)
SELECT l_returnflag, count(*) FILTER (s = '') AS n_blank, count(*) FILTER ((s = '') <> (l_returnflag = 'N')) AS n_wrong FROM t GROUP BY 1""")
def prd_conditional_blank(spark, sf_dir) -> DataFrame:
    t = read(spark, sf_dir, "lineitem", "l_returnflag", "l_linenumber", "l_partkey").select("l_returnflag", F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") < 6), "").otherwise(F.col("l_partkey").cast("string")).alias("s"))
    blank = cells.is_blank(F.col("s"))
    return t.groupBy("l_returnflag").agg(F.count_if(blank).alias("n_blank"), F.count_if(blank != (F.col("l_returnflag") == "N")).alias("n_wrong"))


@query("""SELECT lang, count(*) FILTER (regexp_matches(text, '^\\s|\\s$')) AS n_edge, count(*) FILTER (regexp_matches(text, '\\s{2,}')) AS n_multi FROM documents GROUP BY 1""")
def prd_whitespace(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    # The edges are tested on the first and last character, so a long text isn't searched for them.
    edge = F.substring(t, 1, 1).rlike(r"\s") | F.right(t, F.lit(1)).rlike(r"\s")
    return read(spark, sf_dir, "documents", "lang", "text").groupBy("lang").agg(F.count_if(edge).alias("n_edge"), F.count_if(t.rlike(r"\s{2,}")).alias("n_multi"))


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey || '.0' WHEN p_partkey % 3 = 1 THEN ' ' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS s FROM part)
SELECT count(*) FILTER (s = CAST(p_partkey AS VARCHAR)) AS n_raw, count(*) FILTER (regexp_replace(trim(s), '\\.0+$', '') = CAST(p_partkey AS VARCHAR)) AS n_normalized, count(*) AS n FROM t""")
def prd_normalize_key(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    t = read(spark, sf_dir, "part", "p_partkey").withColumn("s", F.when(k % 3 == 0, F.concat(k, F.lit(".0"))).when(k % 3 == 1, F.concat(F.lit(" "), k)).otherwise(k.cast("string")))
    return t.agg(F.count_if(F.col("s") == k.cast("string")).alias("n_raw"), F.count_if(cells.normalize_key(F.col("s")) == k.cast("string")).alias("n_normalized"), F.count("*").alias("n"))
