"""Registered queries: audits, coverage, reconciliation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollbook.functions import text, web
from rollbook.operators import audit
from rollbook.registry import query, table


@query("SELECT n AS fold FROM (SELECT n, count(*) AS c FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY 1) ORDER BY c DESC, n DESC LIMIT 1")
def e9_duplicate_fold(spark, sf):
    return audit.fold(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH t AS (SELECT month(ts) * 100 + day(ts) // 8 AS p, round(sum(value), 6) AS value, sum(CASE WHEN event_type = 'none' THEN 1 ELSE 0 END) AS zero, sum(event_id * 0 + 7) AS sevens FROM events GROUP BY 1)
SELECT 'value' AS field, count(DISTINCT value) > 1 AS responsive FROM t UNION ALL SELECT 'zero', count(DISTINCT zero) > 1 FROM t UNION ALL SELECT 'sevens', count(DISTINCT sevens) > 1 FROM t""")
def e10_responsive(spark, sf):
    events = table(spark, sf, "events").select((F.month("ts") * 100 + F.floor(F.dayofmonth("ts") / 8)).alias("p"), "value", F.when(F.col("event_type") == "none", 1).otherwise(0).alias("zero"), F.lit(7).alias("sevens"))
    return audit.responsive(events, "p", ["value", "zero", "sevens"])


@query("""SELECT 'c_custkey' AS field, bool_and(regexp_full_match(CAST(c_custkey AS VARCHAR), '[0-9]+')) AS "numeric" FROM customer UNION ALL SELECT 'c_mktsegment', bool_and(regexp_full_match(c_mktsegment, '[0-9]+')) FROM customer WHERE trim(c_mktsegment) != ''
UNION ALL SELECT 'c_nationkey', true""")
def e11_numeric(spark, sf):
    return audit.numeric_columns(table(spark, sf, "customer"), ["c_custkey", "c_mktsegment", "c_nationkey"])


@query("""SELECT CAST(year(l_shipdate) AS INTEGER) AS y, count(*) AS "rows", count(DISTINCT (l_orderkey, l_partkey)) AS distinct_rows, count(*) > count(DISTINCT (l_orderkey, l_partkey)) AS folded FROM lineitem GROUP BY 1""")
def e12_panel_audit(spark, sf):
    return audit.audit(table(spark, sf, "lineitem").withColumn("y", F.year("l_shipdate")), "y", ["l_orderkey", "l_partkey"])


@query("""SELECT s.status, count(e.event_id) AS n, CAST(coalesce(sum(e.event_id), 0) AS BIGINT) AS total FROM (VALUES ('click'), ('view'), ('lost')) AS s(status) LEFT JOIN events e ON e.event_type = s.status GROUP BY 1""")
def e13_task_summary(spark, sf):
    known = spark.createDataFrame([("click",), ("view",), ("lost",)], "status string")
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))
    zero = F.lit(0).cast("long")
    return known.join(counts, "status", "left").select("status", F.coalesce("n", zero).alias("n"), F.coalesce("total", zero).alias("total"))


@query("""SELECT user_id, count(*) AS buckets, count(*) FILTER (WHERE event_type = 'error') AS failed, CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'complete'
WHEN count(*) FILTER (WHERE event_type = 'error') = count(*) THEN 'failed' ELSE 'partial' END AS status FROM events GROUP BY 1""")
def e14_run_status(spark, sf):
    return audit.run_status(table(spark, sf, "events"), "user_id", F.col("event_type") == "error")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'lost') AS lost FROM events GROUP BY 1")
def e15_bucket_counts(spark, sf):
    return audit.counts_by(table(spark, sf, "events"), "user_id", "event_type", ["click", "error", "lost"])


@query("""WITH s AS (SELECT event_id // 100 AS page, string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS ids FROM events GROUP BY 1)
SELECT page, coalesce(lag(ids) OVER (ORDER BY page) = ids, false) AS repeated FROM s""")
def f12_repeated_pages(spark, sf):
    events = table(spark, sf, "events").withColumn("page", F.floor(F.col("event_id") / 100))
    return audit.repeated_pages(events, "page", "user_id")


@query("""WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels), f AS (SELECT a.doc_id AS a, b.doc_id AS b FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT count(a) AS known, count(b) AS got, count(*) FILTER (WHERE a IS NULL) AS new, round(CAST(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS DOUBLE) / count(a), 6) AS recall, count(*) FILTER (WHERE a IS NULL) = 0 AS saturated FROM f""")
def h1_saturation(spark, sf):
    return audit.saturation(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("""SELECT c_mktsegment AS field FROM customer GROUP BY 1 HAVING c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""")
def h2_unmapped(spark, sf):
    offered = table(spark, sf, "customer").agg(F.collect_set(F.concat(F.lit(" "), F.col("c_mktsegment"))).alias("offered"))
    return offered.select(F.explode(audit.unmapped(F.col("offered"), F.array(F.lit("BUILDING"), F.lit("MACHINERY")))).alias("field"))


@query("""WITH o AS (SELECT DISTINCT CAST(ts AS DATE) AS period, event_type || CAST(user_id % 40 AS VARCHAR) AS field FROM events WHERE value > 40)
SELECT field, period FROM (SELECT DISTINCT field FROM o), (SELECT DISTINCT CAST(ts AS DATE) AS period FROM events) EXCEPT SELECT field, period FROM o""")
def h5_absent_periods(spark, sf):
    field = F.concat("event_type", (F.col("user_id") % 40).cast("string"))
    events = table(spark, sf, "events").select(F.to_date("ts").alias("day"), F.array_compact(F.array(F.when(F.col("value") > 40, field))).alias("fields"))
    return audit.absent(events, "day", F.col("fields"))


@query("""SELECT 'priced' AS rule, count(*) AS checked, count(*) FILTER (WHERE NOT coalesce(l_extendedprice > 1000, false)) AS failed FROM lineitem
UNION ALL SELECT 'flagged', count(*), count(*) FILTER (WHERE NOT coalesce(l_returnflag IN ('A', 'N'), false)) FROM lineitem
UNION ALL SELECT 'small_discount', count(*), count(*) FILTER (WHERE NOT coalesce(l_discount <= 0.08, false)) FROM lineitem""")
def o1_validate(spark, sf):
    rules = {"priced": F.col("l_extendedprice") > 1000, "flagged": F.col("l_returnflag").isin("A", "N"), "small_discount": F.col("l_discount") <= 0.08}
    return audit.validate(table(spark, sf, "lineitem"), rules)


@query("""SELECT conv_id, count(*) AS yielded, max(turn) + 1 AS declared, CASE WHEN max(CASE WHEN turn = 7 THEN 1 ELSE 0 END) = 1 THEN false ELSE count(*) >= max(turn) + 1 END AS complete FROM conversations GROUP BY 1""")
def o7_declared_yielded(spark, sf):
    return audit.declared(table(spark, sf, "conversations"), ["conv_id"], F.col("turn") + 1, F.col("turn") == 7)


@query("""SELECT lang, CASE WHEN count(*) FILTER (WHERE n_chars < 20) > 0 THEN 'boundary_bleed' WHEN lang = 'de' THEN 'no_stated_total' WHEN count(*) != 100 THEN 'count_mismatch' ELSE 'reconciled' END AS status FROM documents GROUP BY lang""")
def o8_parse_status(spark, sf):
    out = table(spark, sf, "documents").groupBy("lang").agg(F.count_if(F.col("n_chars") < 20).alias("bleeds"), F.count("*").alias("parsed"))
    stated = F.when(F.col("lang") != "de", F.lit(100).cast("long"))
    return out.select("lang", audit.parse_status(F.col("bleeds"), stated, F.col("parsed")).alias("status"))


@query("SELECT user_id, bool_or(coalesce(event_type = 'error' OR (value > 90 AND user_id % 2 = 0), false)) AS partial FROM events GROUP BY 1")
def o9_partial_units(spark, sf):
    return audit.partial_units(table(spark, sf, "events"), ["user_id"], F.col("event_type") == "error", F.col("value") > 90, F.col("user_id") % 2 == 0)


@query("SELECT doc_id FROM documents WHERE length(trim(coalesce(text, ''))) < 200")
def o11_needs_ocr(spark, sf):
    return table(spark, sf, "documents").where(text.needs_ocr(F.col("text"))).select("doc_id")


@query("""WITH r AS (SELECT page_id, page_id % 3 != 0 AS here, page_id % 5 = 0 AS there FROM pages) SELECT here, there, CASE WHEN here THEN false WHEN there THEN true END AS needs, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def o5_reachability(spark, sf):
    probes = table(spark, sf, "pages").select((F.col("page_id") % 3 != 0).alias("here"), (F.col("page_id") % 5 == 0).alias("there"))
    return probes.withColumn("needs", text.needs_egress(F.col("here"), F.col("there"))).groupBy("here", "there", "needs").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT doc_id, CASE WHEN doc_id % 9 != 0 THEN sha256(text) END AS digest FROM documents), a AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE sha256(text) END AS archived FROM documents WHERE doc_id % 7 != 0)
SELECT o.doc_id, CASE WHEN digest IS NULL OR archived IS NULL THEN NULL ELSE digest != archived END AS changed, CASE WHEN digest IS NULL THEN 'no_digest' WHEN archived IS NULL THEN 'never_archived' END AS reason FROM o LEFT JOIN a USING (doc_id)""")
def p13_recheck(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    now = docs.withColumn("digest", F.when(F.col("doc_id") % 9 != 0, F.col("digest")))
    archive = docs.where("doc_id % 7 != 0").withColumn("archived_at", F.lit(2)).withColumn("digest", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("digest")))
    archive = archive.unionByName(docs.where("doc_id % 7 != 0").withColumn("archived_at", F.lit(1)))
    return audit.recheck(now, archive, "doc_id").select("doc_id", "changed", "reason")


@query("""SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1""")
def e18_known_sum(spark, sf):
    from rollbook.functions.numbers import sum_known

    flags = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(*(F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity").cast("long"))).alias(f) for f in ("A", "R")))
    return flags.select("l_orderkey", sum_known(F.col("A"), F.col("R")).alias("total")).where("total IS NOT NULL")


@query("SELECT l_shipmode_n AS width, c AS n FROM (SELECT len(string_split(text, ' ')) AS l_shipmode_n, count(*) AS c FROM documents GROUP BY 1) ORDER BY 2 DESC, 1 LIMIT 1")
def e19_modal_width(spark, sf):
    widths = table(spark, sf, "documents").select(F.size(F.split("text", " ", -1)).cast("long").alias("width"))
    return widths.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1)


@query("SELECT n7 AS fingerprint, count(*) AS n FROM (SELECT substr(sha1('{\"c_name\":\"' || c_name || '\",\"c_mktsegment\":\"' || c_mktsegment || '\"}'), 1, 12) AS n7 FROM customer) GROUP BY 1")
def n7_fingerprint(spark, sf):
    return table(spark, sf, "customer").groupBy(web.fingerprint("c_name", "c_mktsegment").alias("fingerprint")).agg(F.count("*").alias("n"))
