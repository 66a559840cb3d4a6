"""Joins, windows, selections and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..operators import relational as rel
from ..operators.near import near_groups, near_pairs
from ..operators.numbering import numbered, numbered_groups, text_code
from ..operators.running import running_before
from ..operators.quantiles import exact_quantiles
from .registry import query, read


@query("""WITH p AS (SELECT p_partkey FROM part WHERE p_size <= 40), l AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey END AS k FROM lineitem)
SELECT count(*) AS n_rows, count(*) FILTER (k IS NULL) AS n_blank, count(*) FILTER (k IN (SELECT p_partkey FROM p)) AS n_match, count(*) FILTER (k IS NOT NULL AND k NOT IN (SELECT p_partkey FROM p)) AS n_orphan, count(DISTINCT k) FILTER (k NOT IN (SELECT p_partkey FROM p)) AS n_orphan_keys, (SELECT count(*) FROM p WHERE p_partkey NOT IN (SELECT k FROM l WHERE k IS NOT NULL)) AS n_unused_parents FROM l""")
def jn01_ri(spark, sf_dir) -> DataFrame:
    child = read(spark, sf_dir, "lineitem", "l_partkey", "l_linenumber").select(F.when(F.col("l_linenumber") != 7, F.col("l_partkey")).alias("k"))
    return rel.referential_integrity(child, "k", read(spark, sf_dir, "part").where("p_size <= 40"), "p_partkey")


@query("""SELECT o_orderstatus, r_name, count(*) AS n, count(n_nationkey) AS n_known, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def jn02_enrich(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_totalprice").withColumnRenamed("o_custkey", "c_custkey")
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").where("n_nationkey < 20")
    d = rel.many_to_one(o, c, ["c_custkey"]).withColumnRenamed("c_nationkey", "n_nationkey")
    d = rel.many_to_one(d, n, ["n_nationkey"], found="known").withColumnRenamed("n_regionkey", "r_regionkey")
    d = rel.many_to_one(d, read(spark, sf_dir, "region", "r_regionkey", "r_name"), ["r_regionkey"])
    return d.groupBy("o_orderstatus", "r_name").agg(F.count("*").alias("n"), F.count_if("known").alias("n_known"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _months(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Balances and fees by customer and month, aggregated before any join."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    balance = o.groupBy(F.col("o_custkey").alias("client"), F.trunc("o_orderdate", "MM").alias("month")).agg(F.sum(cells.money(F.col("o_totalprice"))).alias("balance"))
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate", "l_extendedprice", "l_discount").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    fee = F.sum(cells.money(F.col("l_extendedprice") * F.col("l_discount"), 4)).alias("fees")
    return balance, lines.groupBy(F.col("o_custkey").alias("client"), F.trunc("l_shipdate", "MM").alias("month")).agg(fee)


_MONTHS = """WITH b AS (SELECT o_custkey AS client, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS balance FROM orders GROUP BY 1, 2),
f AS (SELECT o_custkey AS client, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(CAST(l_extendedprice * l_discount AS DECIMAL(18, 4))) AS fees FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


@query(_MONTHS + """ SELECT CASE WHEN b.client IS NULL THEN 'right' WHEN f.client IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n, count(*) FILTER (coalesce(abs(balance * 0.05 - fees) <= 5000, false)) AS n_within FROM b FULL JOIN f ON b.client = f.client AND b.month = f.month GROUP BY 1""")
def jn04_outer_recon(spark, sf_dir) -> DataFrame:
    b, f = _months(spark, sf_dir)
    within = F.coalesce(F.abs(F.col("balance") * F.lit(0.05).cast("decimal(4,2)") - F.col("fees")) <= 5000, F.lit(False))
    return rel.outer_marked(b, f, ["client", "month"]).groupBy("side").agg(F.count("*").alias("n"), F.count_if(within).alias("n_within"))


@query(_MONTHS + """ SELECT count(*) AS n, round(avg(abs(CAST(balance AS DOUBLE) - CAST(fees AS DOUBLE))), 4) AS mean_gap, round(median(CAST(fees AS DOUBLE) / nullif(CAST(balance AS DOUBLE), 0)), 6) AS median_ratio FROM b JOIN f ON b.client = f.client AND b.month = f.month""")
def jn07_client_month(spark, sf_dir) -> DataFrame:
    b, f = _months(spark, sf_dir)
    x, y = F.col("balance").cast("double"), F.col("fees").cast("double")
    both = b.join(f, ["client", "month"]).select(F.abs(x - y).alias("gap"), cells.divide(y, x).alias("ratio"))
    middle = exact_quantiles(both, "ratio", [0.5]).agg(F.round(F.max("q0"), 6).alias("median_ratio"))
    return both.agg(F.count("*").alias("n"), F.round(F.avg("gap"), 4).alias("mean_gap")).join(F.broadcast(middle))


@query("""WITH s AS (SELECT DISTINCT o_custkey AS client, CAST(l_shipdate AS DATE) AS ship FROM lineitem JOIN orders ON l_orderkey = o_orderkey), o AS (SELECT DISTINCT o_custkey AS client, CAST(o_orderdate AS DATE) AS d FROM orders),
r AS (SELECT s.client, ship, d, row_number() OVER (PARTITION BY s.client, ship ORDER BY abs(date_diff('day', d, ship)), d) AS k FROM s JOIN o ON s.client = o.client)
SELECT client, ship, d AS nearest_order, CAST(date_diff('day', d, ship) AS INTEGER) AS days, CASE WHEN abs(date_diff('day', d, ship)) <= 7 THEN 'same week' WHEN d > ship THEN 'before earnings' ELSE 'after earnings' END AS timing FROM r WHERE k = 1""", dates=("ship", "nearest_order"))
def jn09_nearest(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    ships = read(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("client"), F.to_date("l_shipdate").alias("ship")).distinct()
    dated = o.select(F.col("o_custkey").alias("client"), F.to_date("o_orderdate").alias("nearest_order"))
    days = F.datediff("ship", "nearest_order")
    return rel.nearest(ships, dated, ["client"], "ship", "nearest_order", []).select("client", "ship", "nearest_order", days.alias("days"), cells.timing(days).alias("timing"))


@query(_MONTHS + """ SELECT n.client, n.month, CAST(n.balance AS VARCHAR) AS balance, CAST(p.balance AS VARCHAR) AS prior FROM b n LEFT JOIN b p ON n.client = p.client AND n.month = CAST(p.month + INTERVAL 1 MONTH AS DATE)""", dates=("month",))
def jn10_prior_month(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    b = o.groupBy(F.col("o_custkey").alias("client"), F.trunc("o_orderdate", "MM").alias("month")).agg(F.sum(cells.money(F.col("o_totalprice"))).alias("balance"))
    # One shuffle by client serves both the sums and the look back.
    w = Window.partitionBy("client").orderBy("month")
    was = F.when(F.lag("month").over(w) == F.add_months("month", -1), F.lag("balance").over(w))
    return b.select("client", "month", F.col("balance").cast("string").alias("balance"), was.cast("string").alias("prior"))


@query("""WITH c AS (SELECT p_brand, p_type, p_size, p_partkey, p_name FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN a.p_name = b.p_name THEN 'identical' WHEN lower(trim(a.p_name)) = lower(trim(b.p_name)) THEN 'case/whitespace' WHEN trim(a.p_name) <> '' AND trim(b.p_name) <> '' AND (starts_with(lower(trim(b.p_name)), lower(trim(a.p_name))) OR starts_with(lower(trim(a.p_name)), lower(trim(b.p_name)))) THEN 'truncated/extended' ELSE 'other' END AS difference
FROM c a JOIN c b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def jn11_near_dups(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part", "p_brand", "p_type", "p_size", "p_partkey", "p_name")
    return near_pairs(p, "p_partkey", ["p_brand", "p_type", "p_size"], "p_name")


@query("""WITH c AS (SELECT p_partkey AS k, p_brand, p_type, p_size, lower(trim(CASE WHEN p_partkey % 3 = 0 THEN substr(p_name, 1, 3) WHEN p_partkey % 3 = 1 THEN substr(p_name, 1, 7) || ' ' ELSE p_name END)) AS x FROM part WHERE p_size < 5),
l AS (SELECT a.k, b.k AS other, CASE WHEN length(b.x) < length(a.x) THEN b.x ELSE a.x END AS short FROM c a JOIN c b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.k <> b.k AND (a.x = b.x OR (a.x <> '' AND b.x <> '' AND (starts_with(a.x, b.x) OR starts_with(b.x, a.x))))),
r AS (SELECT c.k, p_brand, p_size, arg_min(short, length(short)) AS root, count(other) AS n_links FROM c LEFT JOIN l ON c.k = l.k GROUP BY ALL), t AS (SELECT r.k, r.p_brand, r.p_size, n_links, coalesce(root, c.x) AS root FROM r JOIN c ON r.k = c.k),
s AS (SELECT t.p_brand, t.p_size, t.root, count(*) AS n_members, min(CASE WHEN c.x = t.root THEN c.k END) AS representative FROM t JOIN c ON t.k = c.k GROUP BY 1, 2, 3)
SELECT t.k AS p_partkey, representative, n_members, n_links FROM t JOIN s ON t.p_brand = s.p_brand AND t.p_size = s.p_size AND t.root = s.root""")
def jn11_near_groups(spark, sf_dir) -> DataFrame:
    """JN-11, FN-PFX: parts of one brand and size whose names are equal or continue each other, as groups with a representative and counts of links."""
    k, n = F.col("p_partkey"), F.col("p_name")
    p = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size", "p_name").where("p_size < 5")
    cut = F.when(k % 3 == 0, F.substring(n, 1, 3)).when(k % 3 == 1, F.concat(F.substring(n, 1, 7), F.lit(" "))).otherwise(n)
    return near_groups(p.withColumn("name", cut), "p_partkey", ["p_brand", "p_size"], "name")


@query("""WITH l AS (SELECT CASE WHEN l_linenumber = 7 THEN 'x' || l_partkey ELSE CAST(l_partkey AS VARCHAR) END AS k FROM lineitem)
SELECT count(*) FILTER (NOT regexp_full_match(k, '[0-9]+')) AS n_excluded, count(*) FILTER (regexp_full_match(k, '[0-9]+')) AS n_joined, count(p_partkey) AS n_matched FROM l LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON try_cast(k AS BIGINT) = p_partkey""")
def jn12_guarded(spark, sf_dir) -> DataFrame:
    k = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("x"), "l_partkey")).otherwise(F.col("l_partkey").cast("string"))
    keys = read(spark, sf_dir, "lineitem", "l_linenumber", "l_partkey").groupBy(k.alias("k")).agg(F.count("*").alias("n"))
    valid = cells.parses_as(F.col("k"), "int")
    keyed = keys.withColumn("p_partkey", F.when(valid, F.col("k").try_cast("long")))
    parts = rel.assert_unique(read(spark, sf_dir, "part", "p_partkey", "p_size"), ["p_partkey"]).where("p_size > 10").select("p_partkey", F.lit(1).alias("found"))
    return keyed.join(parts, "p_partkey", "left").agg(F.coalesce(F.sum(F.when(~valid, F.col("n")).otherwise(0)), F.lit(0)).cast("long").alias("n_excluded"), F.coalesce(F.sum(F.when(valid, F.col("n")).otherwise(0)), F.lit(0)).cast("long").alias("n_joined"), F.coalesce(F.sum(F.when(F.col("found") == 1, F.col("n")).otherwise(0)), F.lit(0)).cast("long").alias("n_matched"))


@query("""SELECT c_custkey, 'c_acctbal' AS column_name, CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR) AS old_value, CAST(-CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR) AS new_value FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, NULL FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def jn14_cell_diff(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", cells.money(F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")
    after = c.withColumn("c_acctbal", F.abs("c_acctbal")).withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("MACHINERY")))
    return rel.cell_diff(c, after, "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"])


@query("""WITH g AS (SELECT l_orderkey, min(l_linenumber) AS first_line, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1) SELECT count(*) AS n_keys, count(*) FILTER (n_suppliers > 1) AS n_conflicts, CAST(coalesce(sum(first_line), 0) AS BIGINT) AS sum_first FROM g""")
def jn15_lookup(spark, sf_dir) -> DataFrame:
    g = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_line"), (F.min("l_suppkey") < F.max("l_suppkey")).alias("conflict"))
    return g.agg(F.count("*").alias("n_keys"), F.count_if("conflict").alias("n_conflicts"), F.coalesce(F.sum("first_line"), F.lit(0)).cast("long").alias("sum_first"))


@query("""WITH last AS (SELECT o_custkey, max(date_trunc('month', o_orderdate)) AS m FROM orders GROUP BY 1) SELECT o.o_custkey AS client, count(*) AS n_late FROM lineitem JOIN orders o ON l_orderkey = o_orderkey JOIN last ON last.o_custkey = o.o_custkey WHERE date_trunc('month', l_shipdate) > m GROUP BY 1""")
def jn16_late_activity(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    last = o.groupBy("o_custkey").agg(F.max(F.trunc("o_orderdate", "MM")).alias("m"))
    d = read(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(last, "o_custkey")
    return d.where(F.trunc("l_shipdate", "MM") > F.col("m")).groupBy(F.col("o_custkey").alias("client")).agg(F.count("*").alias("n_late"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01') AND c_custkey NOT IN (SELECT user_id FROM events)""")
def jn18_unused(spark, sf_dir) -> DataFrame:
    used = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate").where("o_orderdate >= timestamp '1999-01-01'").select(F.col("o_custkey").alias("c_custkey")).union(read(spark, sf_dir, "events", "user_id"))
    return read(spark, sf_dir, "customer", "c_custkey").join(used.distinct(), "c_custkey", "left_anti")


@query("""WITH t AS (SELECT o_custkey, l_partkey, l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
w AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY o_custkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM t)
SELECT o_custkey AS client, l_orderkey, l_linenumber, l_partkey, l_suppkey, held FROM w""")
def wn01_running_excl(spark, sf_dir) -> DataFrame:
    day = F.unix_date(F.to_date("l_shipdate")).alias("day")
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ties = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax"]
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("decimal(18,2)")
    held = running_before(lines.withColumns({"q": signed, "day": day}), ["o_custkey"], "day", ties, "q", "held", sizes=read(spark, sf_dir, "lineitem", "l_shipdate").select(day))
    return held.select(F.col("o_custkey").alias("client"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("held").cast("double").alias("held"))


@query("""SELECT event_id, CAST(coalesce(sum(CAST(value AS DECIMAL(18, 4))) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS before FROM events""")
def wn01_one_position(spark, sf_dir) -> DataFrame:
    """WN-01: all events as one position: the hottest group there can be is still summed by many tasks."""
    e = read(spark, sf_dir, "events", "event_id", "ts", "value").select("event_id", "ts", F.unix_date(F.to_date("ts")).alias("day"), F.col("value").cast("decimal(18,4)").alias("value"), F.lit("all").alias("position"))
    return running_before(e, ["position"], "day", ["ts", "event_id"], "value", "before").select("event_id", F.col("before").cast("double").alias("before"))


@query("""WITH r AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events), c AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM r)
SELECT d, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name, CAST(week(d) AS INTEGER) AS iso_week, dayname(d) AS day_name, d = last_day(d) AS month_end, d = last_day(d) AND month(d) % 3 = 0 AS quarter_end, isodow(d) < 6 AS is_weekday FROM c""", dates=("d",))
def wn02_calendar_gaps(spark, sf_dir) -> DataFrame:
    span = read(spark, sf_dir, "events", "ts").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    c = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("d"))
    end = F.col("d") == F.last_day("d")
    return c.select("d", F.year("d").alias("year"), F.quarter("d").alias("quarter"), F.month("d").alias("month"), F.date_format("d", "MMMM").alias("month_name"), F.weekofyear("d").alias("iso_week"), F.date_format("d", "EEEE").alias("day_name"), end.alias("month_end"), (end & (F.month("d") % 3 == 0)).alias("quarter_end"), (F.weekday("d") < 5).alias("is_weekday"))


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def wn03_last_per_group(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "ts", "event_id", "value")
    return e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("x")).select("user_id", "x.event_id", "x.value")


@query("SELECT event_id, user_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events) WHERE value = m")
def wn04_group_max(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events", "event_id", "user_id", "value")
    return e.withColumn("m", F.max("value").over(Window.partitionBy("user_id"))).where("value = m").drop("m")


@query("""WITH g AS (SELECT o_orderpriority, o_orderstatus, min(o_orderkey) AS first_key FROM orders GROUP BY 1, 2) SELECT o_orderpriority, o_orderstatus, CAST(row_number() OVER (ORDER BY first_key) - 1 AS INTEGER) AS group_no, 'F' || lpad(CAST(row_number() OVER (ORDER BY first_key) AS VARCHAR), 3, '0') AS finding FROM g""")
def wn06_ngroup(spark, sf_dir) -> DataFrame:
    g = numbered_groups(read(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey")
    n = F.col("group_no")
    return g.select("o_orderpriority", "o_orderstatus", (n - 1).cast("int").alias("group_no"), F.concat(F.lit("F"), F.lpad(n.cast("string"), 3, "0")).alias("finding"))


@query("""WITH g AS (SELECT o_custkey AS client, min(o_orderkey) AS first_order FROM orders GROUP BY 1) SELECT client, first_order, row_number() OVER (ORDER BY first_order) AS place FROM g""")
def sl07_first_appearance(spark, sf_dir) -> DataFrame:
    """SL-07, WN-06: clients numbered in the order in which they first appear among the orders; no task sees more than a range of them."""
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey").withColumnsRenamed({"o_custkey": "client", "o_orderkey": "order"})
    return numbered_groups(o, ["client"], "order", "place")


@query("""WITH n AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT o_orderkey, row_number() OVER (ORDER BY day DESC, o_orderkey) AS place FROM n""")
def wn07_running_ids(spark, sf_dir) -> DataFrame:
    """WN-07, SL-08: all orders numbered from the newest day on; the days cut the work, not one task's window."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").withColumn("back", -F.unix_date(F.to_date("o_orderdate")))
    return numbered(o, "back", "place", ("o_orderkey",)).select("o_orderkey", "place")


@query("""WITH q AS (SELECT DISTINCT o_custkey AS client, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter FROM orders) SELECT client, quarter, k AS place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY client ORDER BY quarter DESC) AS INTEGER) AS k FROM q) WHERE k <= 4""", dates=("quarter",))
def sl04_newest_distinct(spark, sf_dir) -> DataFrame:
    q = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate").select(F.col("o_custkey").alias("client"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("quarter")).distinct()
    return q.withColumn("place", F.row_number().over(Window.partitionBy("client").orderBy(F.desc("quarter")))).where("place <= 4")


@query("SELECT p_brand, CAST(row_number() OVER (ORDER BY length(p_brand), p_brand) AS INTEGER) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def sl06_natural_sort(spark, sf_dir) -> DataFrame:
    """SL-06: by length, then by text; a code of both cuts the order."""
    brands = read(spark, sf_dir, "part", "p_brand").distinct()
    code = F.length("p_brand").cast("long") * (1 << 48) + text_code(F.col("p_brand"), 6)
    return numbered(brands.withColumn("code", code), "code", "place", ("p_brand",)).select("p_brand", F.col("place").cast("int").alias("place"))


@query("SELECT true AS holds, count(*) AS n_raw, count(*) FILTER (o_totalprice >= 1000) AS n_kept, count(*) FILTER (o_totalprice < 1000) AS n_removed FROM orders")
def st04_partition_proof(spark, sf_dir) -> DataFrame:
    raw = read(spark, sf_dir, "orders")
    kept, removed = raw.where("o_totalprice >= 1000"), raw.where("o_totalprice < 1000")
    holds = rel.partition_proof(raw, kept, removed)
    return raw.agg(F.lit(holds).alias("holds"), F.count("*").alias("n_raw"), F.count_if(F.col("o_totalprice") >= 1000).alias("n_kept"), F.count_if(F.col("o_totalprice") < 1000).alias("n_removed"))
