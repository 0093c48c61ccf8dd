"""Registered queries: dates, names, numbers, URLs, HTML by patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions import dates, names, numbers, text, web
from rollbook.registry import query, table


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, false AS unreadable FROM orders UNION ALL SELECT -1, NULL, true UNION ALL SELECT -2, NULL, true UNION ALL SELECT -3, NULL, false")
def j1_bill_dates(spark, sf):
    formats = ("dd/MM/yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    spelled = F.element_at(F.array(*(F.date_format("d", f) for f in formats)), (F.pmod("o_orderkey", F.lit(len(formats))) + 1).cast("int"))
    odd = spark.createDataFrame([(-1, "31/02/2020"), (-2, "soon"), (-3, " ")], "o_orderkey long, raw string")
    return orders.select("o_orderkey", spelled.alias("raw")).unionByName(odd).select("o_orderkey", dates.bill_date("raw").alias("b")).select("o_orderkey", "b.*")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%d') AS b, strftime(o_orderdate, '%d-%m-%Y') AS c, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS d, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS e, strftime(o_orderdate, '%Y-%m-%d') AS f FROM orders")
def j2_portal_dates(spark, sf):
    d = F.col("o_orderdate").cast("timestamp")
    http = F.concat(F.lit("Mon, "), F.date_format(d, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        dates.or_ten(F.date_format(d, "dd-MMM-yyyy"), "dd-MMM-yyyy").alias("a"),
        dates.or_empty(F.date_format(d, "dd/MM/yyyy"), "yyyy-MM-dd", "dd/MM/yyyy").alias("b"),
        dates.register_date(F.date_format(d, "yyyy-MM-dd")).alias("c"),
        dates.http_date(http).alias("d"),
        dates.archive_stamp(F.date_format(d, "yyyyMMddHHmmss")).alias("e"),
        dates.as_on(F.concat(F.lit("as on "), F.date_format(d, "d.M.yyyy"), F.lit("."))).alias("f"),
    )


@query("""WITH r AS (SELECT event_type, CAST(min(ts) AS DATE) - 40 AS a, CAST(max(ts) AS DATE) + 50 AS b FROM events GROUP BY 1)
SELECT event_type, CAST(greatest(m, a) AS DATE) AS "start", CAST(least(last_day(m), b) AS DATE) AS "end" FROM (SELECT event_type, a, b, CAST(unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)) AS DATE) AS m FROM r)""")
def j10_month_windows(spark, sf):
    spans = table(spark, sf, "events").groupBy("event_type").agg(F.date_sub(F.to_date(F.min("ts")), 40).alias("a"), F.date_add(F.to_date(F.max("ts")), 50).alias("b"))
    return spans.select("event_type", F.explode(dates.month_windows(F.col("a"), F.col("b"))).alias("w")).select("event_type", "w.*")


@query("""SELECT user_id, min(d) AS "first", max(d) AS "last", CAST(count(DISTINCT d) AS INTEGER) AS n FROM (SELECT user_id, CAST(ts AS DATE) AS d FROM events) GROUP BY 1""")
def j14_sittings(spark, sf):
    days = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(F.to_date("ts")).alias("d"))
    return days.select("user_id", dates.sitting("d").alias("s")).select("user_id", "s.*")


@query("""SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ' customer' AS member, lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ' customer' AS person, 'customer_' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS slug FROM customer""")
def k1_names(spark, sf):
    name = F.regexp_replace("c_name", "#", " ")
    return table(spark, sf, "customer").select("c_custkey", names.normal_member(F.concat(F.lit("Shri "), name)).alias("member"), names.normal_person(F.concat(F.regexp_replace(name, " ", ", Dr. "), F.lit(""))).alias("person"), names.slug(F.col("c_name")).alias("slug"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def l1_integers(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get(numbers.integers(F.col("props")), F.lit(0)).alias("k"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def l17_json_value(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS DECIMAL(20,4)) * CASE WHEN l_returnflag = 'A' THEN 10000000 WHEN l_returnflag = 'N' THEN 100000 ELSE 1 END AS DOUBLE) AS rupees FROM lineitem")
def l2_rupees(spark, sf):
    scale = F.when(F.col("l_returnflag") == "A", "Crore").when(F.col("l_returnflag") == "N", "lakhs").otherwise("")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numbers.scaled(F.col("l_quantity"), scale).cast("double").alias("rupees"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE regexp_replace(substr(t, 1, 60), ' [^ ]*$', '') || '...' END AS excerpt FROM t""")
def l19_excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", numbers.excerpt(F.col("text"), 60).alias("excerpt"))


@query("""SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=["'']([^"'']*)["'']')) AS links, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages""")
def m5_page_summary(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(web.strip_tags(F.col("html"))).cast("long").alias("n"), F.size(web.hrefs(F.col("html"))).cast("long").alias("links"), web.title(F.col("html")).alias("title"))


#: No page has a port.
_HOST = "regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':(80|443)$', ''), '^www\\.', '')"
_TAIL = "regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', ''), '#.*$', '')"


@query(f"SELECT page_id, {_HOST} || regexp_replace(regexp_replace({_TAIL}, '\\?.*$', ''), '/+$', '') || regexp_extract({_TAIL}, '(\\?.*)$', 1) AS key FROM pages")
def n1_canonical_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.canonical(F.col("url")).alias("key"))


@query(f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def n2_hosts(spark, sf):
    from rollbook.operators.relational import top

    return top(table(spark, sf, "pages").select(web.host(F.col("url")).alias("host")), "host", 10)


@query("""SELECT c_custkey, substr(sha256(c_name || chr(0) || c_mktsegment), 1, 16) AS id, regexp_replace(c_name, '[^A-Za-z0-9._-]', '_', 'g') AS segment FROM customer""")
def n12_stable_ids(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", web.stable_id("c_name", "c_mktsegment").alias("id"), web.safe_segment(F.col("c_name")).alias("segment"))


@query("""WITH t AS (SELECT doc_id, regexp_extract(text, '(?i)(Licensed|licensed|Released) under', 1) AS w FROM documents)
SELECT CASE WHEN lower(w) = 'licensed' THEN 'licensed' WHEN lower(w) = 'released' THEN 'released' ELSE 'none' END AS class, count(*) AS n FROM t GROUP BY 1""")
def i14_ladder(spark, sf):
    ladder = (("licensed", "(?i)licensed under"), ("released", "(?i)released under"))
    return table(spark, sf, "documents").groupBy(text.first_match(F.col("text"), ladder, "none").alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 25""")
def g2_sorted_limit(spark, sf):
    events = table(spark, sf, "events").where(F.to_date("ts").between("2024-01-05", "2024-01-20"))
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id", "event_type").limit(25)
