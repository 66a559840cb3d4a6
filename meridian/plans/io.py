"""Queries through files: what is written as text reads back as text, and parallel arrays, maps, dates in words and filings become rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..operators.relational import RuleBroken
from ..operators.spec import STATE_NAMES
from ..sources import commits, files, paged, sinks
from ..sources.scratch import new_path
from .registry import query, read


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def src01_text_scan(spark, sf_dir) -> DataFrame:
    """SRC-01, SNK-01, SNK-02: customers written as CSV, read as text; blanks stay blanks."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    path = new_path(spark, "csv")
    sinks.write_checked(c, path)
    return files.text_table(spark, path)


@query("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS zip_code, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def src02_typed_scan(spark, sf_dir) -> DataFrame:
    """SRC-02: declared types; a code keeps its zeros, a blank is null."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("zip_code"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    path = new_path(spark, "csv")
    sinks.write_csv(c, path)
    return files.typed_table(spark, path, "c_custkey long, zip_code string, c_acctbal double")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def src03_projected_scan(spark, sf_dir) -> DataFrame:
    """SRC-03: one column of a CSV file, which alone is parsed."""
    path = new_path(spark, "csv")
    sinks.write_csv(read(spark, sf_dir, "part"), path)
    return files.text_table(spark, path, ["p_brand"]).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders", dates=("o_orderdate",))
def src04_contracted_scan(spark, sf_dir) -> DataFrame:
    """SRC-04: required columns and strict dates, checked before anything is returned."""
    path = new_path(spark, "csv")
    sinks.write_csv(read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate")), path)
    t = files.contracted_table(spark, path, ["o_orderkey", "o_orderdate"], ["o_orderdate"])
    return t.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderdate")


@query("""SELECT 'm' || c_nationkey AS measure, c_mktsegment AS slice, CASE WHEN count(*) > 1 AND c_nationkey % 5 <> 4 THEN 'repeated' WHEN c_nationkey % 5 = 3 THEN 'not a number' WHEN c_nationkey % 5 = 4 THEN 'unexpected' END AS problem FROM customer WHERE c_custkey < 60 GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1 OR c_nationkey % 5 >= 3""")
def src05_export_problems(spark, sf_dir) -> DataFrame:
    """SRC-05: an export of one row a customer below 60: repeated, unexpected and non-numeric cells are listed."""
    c = read(spark, sf_dir, "customer").where("c_custkey < 60").select(F.concat(F.lit("m"), "c_nationkey").alias("measure"), F.col("c_mktsegment").alias("slice"), F.when(F.col("c_nationkey") % 5 == 3, "1,5").otherwise(F.col("c_custkey").cast("string")).alias("value"), "c_nationkey")
    path = new_path(spark, "csv")
    sinks.write_csv(c.drop("c_nationkey"), path)
    expected = c.where("c_nationkey % 5 <> 4").select("measure", "slice", F.lit("count").alias("kind")).distinct()
    return files.exported_values(spark, path, expected)[1]


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, trim(n_name) AS n_name FROM nation WHERE n_nationkey % 4 <> 0")
def src06_clean_rows(spark, sf_dir) -> DataFrame:
    """SRC-06: trimmed cells, blank lines dropped."""
    n = read(spark, sf_dir, "nation")
    path = new_path(spark, "csv")
    keep = F.col("n_nationkey") % 4 != 0
    sinks.write_csv(n.select(F.when(keep, F.col("n_nationkey")).alias("n_nationkey"), F.when(keep, F.concat(F.lit("  "), "n_name", F.lit(" "))).otherwise(" ").alias("n_name")), path)
    return files.clean_rows(spark, path, ["n_nationkey", "n_name"])


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders")
def src07_parallel_arrays(spark, sf_dir) -> DataFrame:
    """SRC-07, FN-ARR, FN-JSON: orders of a customer as a JSON object of parallel arrays, and back to rows."""
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus")
    lists = o.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("x"))
    as_json = lists.select("o_custkey", F.to_json(F.struct(*(F.col(f"x.{c}").alias(c) for c in ("o_orderkey", "o_orderstatus")))).alias("json"))
    return files.parallel_rows(as_json, "json", {"o_orderkey": "long", "o_orderstatus": "string"}, ("o_custkey",)).drop("position")


_PAGED = """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS accession, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filed, CASE WHEN o_orderkey % 3 = 0 THEN '10-K' ELSE '8-K' END AS form, o_orderpriority AS items,
o_orderstatus AS document, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS newest, o_orderkey % greatest(1, (SELECT count(*) FROM orders) // 336000) AS bucket FROM orders),
p AS (SELECT *, CASE WHEN newest <= 500 THEN 'index' ELSE 'page=' || substr(filed, 1, 7) || '-' || bucket END AS page FROM o), l AS (SELECT page, max(filed) AS last FROM p GROUP BY 1)
SELECT p.page, accession, filed, form, items, document, false AS failed FROM p JOIN l ON p.page = l.page WHERE p.page = 'index' OR last >= '{start}' AND (SELECT min(filed) FROM p WHERE page = 'index') >= '{start}'"""


def _orders_listing(spark, sf_dir) -> str:
    """Orders as a paged listing of filings: the newest 500 are the recent list, the older ones lie in pages of about 4,000 by month and key."""
    o = read(spark, sf_dir, "orders")
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    cells_ = {"accession": key.cast("string"), "filed": day.cast("string"), "form": F.when(key % 3 == 0, "10-K").otherwise("8-K"), "items": F.col("o_orderpriority"), "document": F.col("o_orderstatus")}
    shown = o.select(day.alias("day"), "o_orderkey", *(c.alias(n) for n, c in cells_.items()))
    newest = shown.orderBy(F.desc("day"), F.desc("o_orderkey")).limit(500)
    buckets = max(1, o.count() // 336_000)
    older = shown.join(F.broadcast(newest.select("o_orderkey")), "o_orderkey", "left_anti").withColumn("page", F.concat(F.substring("filed", 1, 7), F.lit("-"), F.col("o_orderkey") % buckets))
    path = new_path(spark, "listing")
    paged.write_listing(newest, older, path)
    return path


@query(_PAGED.format(start="2000-06-01"))
def src07_paged_filings(spark, sf_dir) -> DataFrame:
    """SRC-07, SRC-08: a listing read page by page by the data source; only older pages that reach into the window are read."""
    paged.register(spark)
    listing = spark.read.format("filings").option("path", _orders_listing(spark, sf_dir)).option("start", "2000-06-01").load()
    return listing.drop("position")


@query(_PAGED.format(start="2001-01-01").replace("SELECT p.page", "SELECT * FROM (SELECT p.page") + ") q WHERE filed >= '2001-01-01' AND form = '8-K'")
def src08_filtered_filings(spark, sf_dir) -> DataFrame:
    """SRC-08, PRD-24: the filter on the day alone tells the source which pages it needs."""
    paged.register(spark)
    listing = spark.read.format("filings").option("path", _orders_listing(spark, sf_dir)).load()
    return listing.where("filed >= '2001-01-01' and form = '8-K'").drop("position")


_FILED = "SELECT CAST(event_id % 700 AS VARCHAR) AS accession, CASE event_id % 3 WHEN 0 THEN '10-K' ELSE '8-K' END AS form, CASE event_id % 4 WHEN 0 THEN '2.02, 9.01' WHEN 1 THEN '5.02,9.01' ELSE ' 5.02 ' END AS items, substr(CAST(min(ts) AS VARCHAR), 1, 10) AS filed FROM events GROUP BY event_id"


@query(f"SELECT accession, max(filed) AS filed FROM ({_FILED}) f WHERE form = '8-K' AND items LIKE '%5.02%' AND filed BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY 1")
def prd24_wanted_filings(spark, sf_dir) -> DataFrame:
    """PRD-24, SL-08: filings of a form that list an item inside a window, the newest of each accession, newest first."""
    i = F.col("event_id")
    e = read(spark, sf_dir, "events", "event_id", "ts").groupBy("event_id").agg(F.min("ts").alias("ts"))
    f = e.select((i % 700).cast("string").alias("accession"), F.when(i % 3 == 0, "10-K").otherwise("8-K").alias("form"), F.when(i % 4 == 0, "2.02, 9.01").when(i % 4 == 1, "5.02,9.01").otherwise(" 5.02 ").alias("items"), F.date_format("ts", "yyyy-MM-dd").alias("filed"))
    return files.wanted_filings(f, "8-K", "5.02", "2024-01-05", "2024-01-20").select("accession", "filed")


@query("SELECT CAST(o_custkey AS VARCHAR) AS name, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS filing_to FROM orders GROUP BY 1 HAVING CAST(max(o_orderdate) AS DATE) >= DATE '2000-06-01'")
def src08_pages_needed(spark, sf_dir) -> DataFrame:
    """SRC-08: older pages that may reach into the window, since the recent list doesn't cover it."""
    pages = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate").groupBy(F.col("o_custkey").cast("string").alias("name")).agg(F.to_date(F.max("o_orderdate")).cast("string").alias("filing_to"))
    recent = read(spark, sf_dir, "orders", "o_orderdate").where("o_orderdate >= timestamp '2001-01-01'").select(F.to_date("o_orderdate").cast("string").alias("filed"))
    return files.pages_needed(recent, pages, "2000-06-01")


@query("""WITH r AS (SELECT o_orderkey, l_linenumber AS position, max(l_partkey) AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), s AS (SELECT *, CASE WHEN part % 3 = 0 THEN 10 WHEN part % 3 = 1 THEN 5 ELSE 0 END AS score FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, position) AS n FROM s WHERE score > 0) SELECT o_orderkey, 'ex' || position AS url, CAST(score AS INTEGER) AS score FROM k WHERE n = 1""")
def src09_best_exhibit(spark, sf_dir) -> DataFrame:
    """SRC-09, SL-05: of each filing the best exhibit; the first one on ties."""
    r = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("position")).agg(F.max("l_partkey").alias("part"))
    r = r.join(read(spark, sf_dir, "orders", "o_orderkey").distinct(), "o_orderkey", "left_semi").withColumn("url", F.concat(F.lit("ex"), "position"))
    return files.best_exhibit(r, ["o_orderkey"], F.when(F.col("part") % 3 == 0, 10).when(F.col("part") % 3 == 1, 5).otherwise(0))


@query("""WITH s AS (SELECT o_custkey AS client, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS quarter_end, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS v FROM orders GROUP BY 1, 2)
SELECT c_custkey AS client, DATE '2000-06-30' AS quarter_end, CAST(v AS VARCHAR) AS value FROM customer LEFT JOIN s ON client = c_custkey AND quarter_end = DATE '2000-06-30'""", dates=("quarter_end",))
def src11_exact_quarter(spark, sf_dir) -> DataFrame:
    """SRC-11: the asked quarter or nothing."""
    end = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2)).alias("quarter_end")
    s = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice").groupBy(F.col("o_custkey").alias("client"), end).agg(F.sum(cells.money(F.col("o_totalprice"))).cast("string").alias("value"))
    asked = read(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("client"), F.lit("2000-06-30").cast("date").alias("quarter_end"))
    return files.exact_quarter(s, asked, ["client"]).select("client", "quarter_end", "value")


@query("""WITH r AS (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders) SELECT CAST(unnest(generate_series(make_date(CAST(year(a) AS INT), 1, 1), make_date(CAST(year(b) AS INT), 12, 31), INTERVAL 1 DAY)) AS DATE) AS day FROM r""", dates=("day",))
def src12_calendar(spark, sf_dir) -> DataFrame:
    """SRC-12: every day of the years that the orders lie in."""
    return files.calendar_table(spark, read(spark, sf_dir, "orders", "o_orderdate").agg(F.min("o_orderdate").alias("low"), F.max("o_orderdate").alias("high")))


@query("SELECT table_name, CAST(ordinal_position - 1 AS BIGINT) AS position, column_name FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer') AND table_schema = 'main'")
def src13_model_columns(spark, sf_dir) -> DataFrame:
    """SRC-13: the model's columns."""
    rows = files.model_columns({t: read(spark, sf_dir, t) for t in ("region", "nation", "customer")}, {"region": "r_regionkey"})
    return spark.createDataFrame([r[:3] for r in rows], "table_name string, position long, column_name string")


@query("""WITH s AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer), c AS (SELECT CAST(CASE WHEN b > a THEN least(floor((c_acctbal - a) / (b - a) * 100), 99) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM customer, s GROUP BY 1), g AS (SELECT CAST(unnest(range(100)) AS INTEGER) AS bin)
SELECT g.bin, round(a + g.bin * (b - a) / 100, 4) AS low, coalesce(n, 0) AS n FROM s, g LEFT JOIN c ON g.bin = c.bin""")
def snk06_histogram(spark, sf_dir) -> DataFrame:
    """SNK-06: the data of a chart of 100 equal bins."""
    return sinks.histogram(read(spark, sf_dir, "customer", "c_acctbal"), "c_acctbal").select("bin", F.round("low", 4).alias("low"), "n")


@query("""WITH q AS (SELECT c_mktsegment AS segment, count(*) AS n, quantile_cont(c_acctbal, 0.25) AS q1, median(c_acctbal) AS median, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1), r AS (SELECT q.*, c_acctbal AS x, q1 - 1.5 * (q3 - q1) AS a, q3 + 1.5 * (q3 - q1) AS z FROM customer JOIN q ON c_mktsegment = segment)
SELECT segment, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(x) FILTER (x >= a AND x <= z) AS low, max(x) FILTER (x >= a AND x <= z) AS high, count(*) FILTER (x < a) AS n_below, count(*) FILTER (x > z) AS n_above FROM r GROUP BY ALL""")
def snk06_box(spark, sf_dir) -> DataFrame:
    """SNK-06: the data of a box chart of balances by segment."""
    c = read(spark, sf_dir, "customer", "c_mktsegment", "c_acctbal").withColumnRenamed("c_mktsegment", "segment")
    return sinks.box_data(c, "segment", "c_acctbal").withColumns({q: F.round(q, 6) for q in ("q1", "median", "q3")})


@query("""SELECT o_orderpriority, o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k FROM orders) r WHERE k <= 200""")
def snk06_scatter(spark, sf_dir) -> DataFrame:
    """SNK-06: the points of a chart of clients and prices by priority, a bounded and repeatable draw of each."""
    return sinks.scatter_data(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", "o_custkey", "o_totalprice")


def _fingerprint_sql(table: str, columns: dict[str, str], label: str | None = None) -> str:
    """The fingerprint of text cells; columns: name to expression."""
    cell = lambda x: f"coalesce(length({x}) || ':' || {x}, '-')"
    text = {n: cell(f"coalesce(CAST({x} AS VARCHAR), '')") for n, x in columns.items()}
    text["(row)"] = " || ".join(text.values())
    sums = lambda t: ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(md5({t}), {at}, 15) AS HUGEINT)), 0) AS VARCHAR) AS sum_{k}" for at, k in ((1, "a"), (16, "b")))
    first = f"'{label}' AS table_name, " if label else ""
    return " UNION ALL ".join(f"SELECT {first}'{n}' AS column_name, count(*) AS n, {sums(t)} FROM {table}" for n, t in text.items())


@query(_fingerprint_sql("orders", {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "day": "CAST(o_orderdate AS DATE)", "remark": "CASE WHEN o_orderkey % 9 = 0 THEN 'a, \"b\" ' || o_orderpriority WHEN o_orderkey % 9 = 1 THEN NULL ELSE o_orderpriority END"}))
def snk02_fingerprints(spark, sf_dir) -> DataFrame:
    """SNK-02, SNK-07: orders through the sink with a commit, checked as they are written, and the fingerprints of what reads back."""
    remark = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit('a, "b" '), "o_orderpriority")).when(F.col("o_orderkey") % 9 != 1, F.col("o_orderpriority"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), remark.alias("remark"))
    folder = new_path(spark, "published")
    commits.publish({"orders": o}, folder)
    return commits.fingerprint(commits.published(spark, folder, "orders"))


@query(_fingerprint_sql("customer", {"c_custkey": "c_custkey", "c_name": "c_name"}, "customers") + " UNION ALL " + _fingerprint_sql("supplier", {"s_suppkey": "s_suppkey", "s_acctbal": "CAST(s_acctbal AS DECIMAL(18, 2))"}, "suppliers"))
def snk03_all_or_none(spark, sf_dir) -> DataFrame:
    """SNK-03, SNK-08, SNK-09: of three attempts to publish two tables the second replaces the first, and the third, whose checks fail, changes nothing."""
    c, s = read(spark, sf_dir, "customer", "c_custkey", "c_name"), read(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").withColumn("s_acctbal", cells.money(F.col("s_acctbal")).cast("decimal(18,2)"))
    folder = new_path(spark, "published")
    commits.publish({"customers": c.where("c_custkey % 2 = 0"), "stale": s}, folder)
    commits.publish({"customers": c, "suppliers": s}, folder)
    broken = c.agg(F.lit("customers have odd keys").alias("requirement"), F.count_if(F.col("c_custkey") % 2 == 1).alias("n_failed"))
    try:
        commits.publish({"customers": c.limit(1), "suppliers": s}, folder, broken)
    except RuleBroken:
        status = sinks.Status.INVALID
    else:
        status = sinks.Status.OK
    shown = [commits.fingerprint(commits.published(spark, folder, t)).select(F.lit(t).alias("table_name"), "*") for t in ("customers", "suppliers")]
    return shown[0].unionByName(shown[1]).where(F.lit(int(status)) == int(sinks.Status.INVALID))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json_props(spark, sf_dir) -> DataFrame:
    """FN-JSON: a field of a JSON text."""
    return read(spark, sf_dir, "events", "event_id", "props").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT n_nationkey, CASE n_nationkey % 9 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(STATE_NAMES.values())) + " ELSE n_name END AS code FROM nation")
def fn_map_codes(spark, sf_dir) -> DataFrame:
    """FN-MAP: names replaced through an explicit map, others kept."""
    names = F.create_map(*(F.lit(x) for pair in STATE_NAMES.items() for x in pair))
    order = F.array(*(F.lit(n) for n in STATE_NAMES))
    name = F.when(F.col("n_nationkey") % 9 < len(STATE_NAMES), F.get(order, (F.col("n_nationkey") % 9).cast("int"))).otherwise(F.col("n_name"))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(F.try_element_at(names, name), name).alias("code"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR AS DATE) AS year_before FROM orders", dates=("day", "year_before"))
def fn_dt2_worded_dates(spark, sf_dir) -> DataFrame:
    """FN-DT2: dates in words and with slashes, and the day a year before (February 28 for the 29th)."""
    worded = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    day = cells.worded_date(F.col("text"))
    return read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", worded.alias("text")).select("o_orderkey", day.alias("day"), F.add_months(day, -12).alias("year_before"))
