"""Registered queries: filters, joins, merges, aggregates, windows, sorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollbook.functions import dates, names, text, web
from rollbook.operators import relational as rel
from rollbook.operators import resolve
from rollbook.registry import query, table


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def c1_kind_filter(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("click", "view")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders WHERE o_orderdate IS NULL OR (o_orderdate >= '1996-03-01' AND o_orderdate < '1998-07-01') GROUP BY 1")
def c3_date_range(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.where(dates.in_range("o_orderdate", "1996-03-01", "1998-06-30")).groupBy(dates.year_bucket("o_orderdate").cast("int").alias("y")).agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n FROM documents WHERE contains(lower(text), 'heit') OR contains(lower(text), 'ation') OR contains(lower(text), 'eau') GROUP BY lang")
def c4_any_term(spark, sf):
    return table(spark, sf, "documents").where(text.contains_any(F.col("text"), ["Heit", "ation", "EAU"])).groupBy("lang").agg(F.count("*").alias("n"))


@query("""SELECT 'customer' AS kind, nationkey, count(*) AS n, count(segment) AS segments FROM (SELECT c_nationkey AS nationkey, c_mktsegment AS segment FROM customer) GROUP BY nationkey
UNION ALL SELECT 'supplier', s_nationkey, count(*), 0 FROM supplier GROUP BY s_nationkey""")
def c6_aliased_union(spark, sf):
    a = table(spark, sf, "customer").withColumnsRenamed({"c_nationkey": "nationkey", "c_mktsegment": "segment", "c_name": "name"}).select("nationkey", "segment", "name")
    b = table(spark, sf, "supplier").withColumnsRenamed({"s_nationkey": "nationkey", "s_name": "name"}).select("nationkey", "name")
    return rel.bundle(customer=a, supplier=b).groupBy(F.col("family").alias("kind"), "nationkey").agg(F.count("*").alias("n"), F.count("segment").alias("segments"))


@query("""SELECT p_type, CASE WHEN regexp_matches(p_name, '(?i)ring') THEN 'ring' WHEN regexp_matches(p_name, '(?i)widget|bolt') THEN 'part' ELSE 'other' END AS class, count(*) AS n FROM part GROUP BY 1, 2""")
def c12_class_ladder(spark, sf):
    part = table(spark, sf, "part")
    return part.withColumn("class", text.first_match(F.col("p_name"), (("ring", "(?i)ring"), ("part", "(?i)widget|bolt")), "other")).groupBy("p_type", "class").agg(F.count("*").alias("n"))


@query("""SELECT o.o_orderkey, count(l.l_orderkey) AS n_children, coalesce(string_agg(CAST(l.l_linenumber AS VARCHAR) || ':' || CAST(l.l_partkey AS VARCHAR), ',' ORDER BY l.l_linenumber, l.l_partkey), '') AS children
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey""")
def d1_children(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey").alias("at"), "l_linenumber", "l_partkey")
    out = rel.with_children(table(spark, sf, "orders").select("o_orderkey"), lines, "o_orderkey", "at")
    items = F.transform("children", lambda x: F.concat_ws(":", x.l_linenumber.cast("string"), x.l_partkey.cast("string")))
    return out.select("o_orderkey", F.size("children").cast("long").alias("n_children"), F.array_join(items, ",").alias("children"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderstatus = 'P' AS taken FROM orders), n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT r.k AS key, o.k AS original, coalesce(a.n, 0) AS answers, coalesce(b.n, 0) AS observations FROM r
LEFT JOIN r o ON o.k = r.k + 1 AND NOT o.taken LEFT JOIN n a ON a.k = r.k LEFT JOIN n b ON b.k = r.k + 1 WHERE r.taken""")
def d2_report_chain(spark, sf):
    orders = table(spark, sf, "orders")
    reports = orders.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "P", "action_taken").otherwise("subject").alias("report_type"))
    # every link twice: the last one counts
    link = orders.select(F.col("o_orderkey").alias("atr_key"), (F.col("o_orderkey") + 1).alias("references_report_key"), F.lit(2).alias("position"))
    links = link.unionByName(link.withColumn("references_report_key", F.lit(0).cast("long")).withColumn("position", F.lit(1)))
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey").alias("position"))
    out = rel.chain(reports, links, items, items)
    return out.select("key", F.col("original.key").alias("original"), F.size("answers").cast("long").alias("answers"), F.size("observations").cast("long").alias("observations"))


def _questions(spark, sf):
    turns = table(spark, sf, "conversations")
    key = F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    asked = turns.where("role = 'user'").select(key.alias("key"), F.concat(F.lit("Ministry "), (F.col("conv_id") % 7).cast("string")).alias("ministry"), F.col("text").alias("title"))
    answer_key = F.concat_ws("|", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    answers = turns.where("role = 'assistant'").select(answer_key.alias("key"), F.col("turn").alias("position"), F.lit("").alias("question_text"), F.col("text").alias("answer_text"))
    return asked, answers


@query("""SELECT 'Ministry ' || CAST(q.conv_id % 7 AS VARCHAR) AS ministry, count(*) AS n FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
WHERE q.role = 'user' AND (contains(lower(a.text), 'tion') OR contains(lower(a.text), 'heit')) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def d6_answered_questions(spark, sf):
    """Questions with an answer that mentions a term, by ministry: the top ten."""
    asked, answers = _questions(spark, sf)
    joined = rel.with_children(asked, answers, "key", "position", "answers")
    hit = joined.where(F.exists("answers", lambda a: text.contains_any(a["answer_text"], ["tion", "heit"])))
    return rel.top(hit, "ministry", 10)


@query("""SELECT q.conv_id || '|' || q.turn AS key, count(a.conv_id) AS n_answers FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
WHERE q.role = 'user' AND 'MINISTRY ' || CAST(q.conv_id % 7 AS VARCHAR) LIKE '%MINISTRY 3%' AND (contains(lower(q.text), 'que') OR contains(lower(coalesce(a.text, '')), 'que')) GROUP BY 1""")
def d6_evidence(spark, sf):
    asked, answers = _questions(spark, sf)
    return rel.evidence(asked, answers, "ministry 3", ["QUE"]).select("key", F.size("answers").cast("long").alias("n_answers"))


@query("""WITH old AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 != 0), new AS (SELECT c_custkey AS k, 'NEW' AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT v, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM (SELECT * FROM new UNION ALL SELECT * FROM old WHERE k NOT IN (SELECT k FROM new)) GROUP BY v""")
def d10_upsert(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    out = rel.upsert(customer.where("k % 3 != 0"), customer.where("k % 2 = 0").withColumn("v", F.lit("NEW")), ["k"])
    return out.groupBy("v").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50) GROUP BY event_type")
def d12_unseen(spark, sf):
    events = table(spark, sf, "events")
    return rel.unseen(events, events.where("event_type = 'error' AND value > 50"), ["user_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 12) AS fingerprint FROM documents WHERE doc_id % 2 = 1 OR doc_id % 10 = 0""")
def d13_new_or_changed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 12).alias("fingerprint"))
    seen = docs.where("doc_id % 2 = 0").withColumn("fingerprint", F.when(F.col("doc_id") % 10 == 0, "changed").otherwise(F.col("fingerprint")))
    return rel.unseen(docs, seen, ["doc_id", "fingerprint"])


@query("""SELECT d.lang, count(*) AS documents, count(l.doc_id) AS labelled, min(d.n_chars) AS shortest, max(d.n_chars) AS longest, round(CAST(count(l.doc_id) AS DOUBLE) / count(*), 3) AS coverage
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang""")
def e1_corpus_stats(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    coverage = F.round(F.count("l").cast("double") / F.nullif(F.count("*"), F.lit(0)), 3)
    return docs.groupBy("lang").agg(F.count("*").alias("documents"), F.count("l").alias("labelled"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), coverage.alias("coverage"))


@query("SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def e7_top_spenders(spark, sf):
    return rel.top(table(spark, sf, "lineitem"), "l_suppkey", 10, F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), "total")


@query("""WITH t AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1, 2)
SELECT o_custkey, y, CAST(s AS DOUBLE) AS total, CAST(s - lag(s) OVER (PARTITION BY o_custkey ORDER BY y) AS DOUBLE) AS delta FROM t""")
def e4_company_year(spark, sf):
    total = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    delta = F.col("total") - F.lag("total").over(Window.partitionBy("o_custkey").orderBy("y"))
    return total.select("o_custkey", "y", F.col("total").cast("double").alias("total"), delta.cast("double").alias("delta"))


@query("SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) >= 3")
def e5_consistent_reporters(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct(F.year("o_orderdate")).alias("years")).where("years >= 3")


@query("SELECT user_id, event_type, max(event_id) AS last_event FROM events GROUP BY 1, 2")
def f1_last_row_wins(spark, sf):
    events = table(spark, sf, "events")
    return rel.last_row(events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", F.col("event_id").alias("last_event"))


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events WHERE event_type != 'click' UNION ALL SELECT 'click' FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'click')) GROUP BY 1")
def f1_compact(spark, sf):
    events = table(spark, sf, "events")
    return rel.compact(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT min(doc_id) AS doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL GROUP BY text")
def f2_first_row_wins(spark, sf):
    docs = table(spark, sf, "documents").where("text IS NOT NULL").withColumn("h", F.sha2("text", 256))
    return rel.first_row(docs, ["h"], ["doc_id"]).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1")
def f3_last_status(spark, sf):
    return rel.last_value(table(spark, sf, "events"), ["user_id"], "event_type", ["ts", "event_id"], "status")


@query("SELECT doc_id, CAST(i AS INTEGER) AS line_no, length(string_split(text, chr(10))[i]) AS n FROM documents, generate_series(1, len(string_split(text, chr(10)))) AS g(i)")
def f4_ordinals(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")))
    return docs.select("doc_id", (F.col("pos") + 1).alias("line_no"), F.length("col").cast("long").alias("n"))


@query("SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ends_at FROM events")
def f5_segments(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.lead("event_id").over(w).alias("ends_at"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS heading FROM events")
def f6_look_back(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-7, -1)
    return table(spark, sf, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("heading"))


@query("""WITH r AS (SELECT user_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS r, lead(score) OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS next, event_type
 FROM (SELECT user_id, event_type, count(*) AS score FROM events GROUP BY 1, 2)) SELECT user_id, event_type AS winner, score - coalesce(next, 0) AS margin FROM r WHERE r = 1""")
def f9_margin(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "event_type")
    scores = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("score"))
    ranked = scores.select("*", F.row_number().over(w).alias("r"), F.lead("score").over(w).alias("next")).where("r = 1")
    return ranked.select("user_id", F.col("event_type").alias("winner"), (F.col("score") - F.coalesce("next", F.lit(0))).alias("margin"))


@query("""SELECT event_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b != event_type GROUP BY 1""")
def f11_status_changes(spark, sf):
    return rel.status_changes(table(spark, sf, "events"), ["user_id"], "event_type", ["ts", "event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS owner FROM events")
def f13_carried_header(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("ts")), ignorenulls=True).over(w).alias("owner"))


@query("""WITH h AS (SELECT page_id, length(html) AS n, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':(80|443)$', ''), '^www\\.', '') AS host FROM pages)
SELECT host, page_id, n FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, page_id DESC) AS r FROM h) WHERE r = 1""")
def g4_rank_captures(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.length("html").cast("long").alias("n"), web.host(F.col("url")).alias("host"))
    return rel.last_row(pages, ["host"], [F.coalesce("n", F.lit(-1)), F.col("page_id")]).select("host", "page_id", "n")


@query("""WITH s AS (SELECT DISTINCT user_id FROM events WHERE value > 60) SELECT user_id, count(*) AS n FROM events WHERE value > 60 OR user_id NOT IN (SELECT user_id FROM s) GROUP BY 1""")
def g10_preferred(spark, sf):
    return rel.prefer(table(spark, sf, "events"), ["user_id"], F.col("value") > 60).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT n_regionkey, CAST(sum(c) AS BIGINT) AS customers FROM nation JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1""")
def d17_prefix_join(spark, sf):
    customer = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    return table(spark, sf, "nation").join(customer, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.sum("c").alias("customers"))


@query("""WITH first AS (SELECT event_id, user_id, 'mirror' AS source FROM events WHERE event_type = 'view' AND user_id % 2 = 0), live AS (SELECT event_id, user_id, 'live' AS source FROM events WHERE event_type = 'click')
SELECT source, count(*) AS n FROM (SELECT * FROM first UNION ALL SELECT * FROM live WHERE user_id NOT IN (SELECT user_id FROM first)) GROUP BY 1""")
def d25_source_fallback(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    mirror = events.where("event_type = 'view' AND user_id % 2 = 0").withColumn("source", F.lit("mirror"))
    live = events.where("event_type = 'click'").withColumn("source", F.lit("live"))
    return rel.fallback(mirror, live, ["user_id"]).groupBy("source").agg(F.count("*").alias("n"))


@query("""SELECT 'PERSON_' || substr(sha256(lower(trim(c_name)) || '|' || lower(trim(c_mktsegment))), 1, 8) || '_' || regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS entity_id, count(*) AS n FROM customer GROUP BY 1""")
def d22_entities(spark, sf):
    customer = table(spark, sf, "customer")
    return customer.groupBy(names.entity_id(F.col("c_name"), F.col("c_mktsegment")).alias("entity_id")).agg(F.count("*").alias("n"))


@query("""SELECT e.event_id, s.started FROM events e JOIN (SELECT user_id, ts AS started, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ended FROM events WHERE event_type = 'signup') s
ON s.user_id = e.user_id AND e.ts >= s.started AND (s.ended IS NULL OR e.ts < s.ended) WHERE e.event_type = 'purchase'""")
def d24_membership_interval(spark, sf):
    events = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    spans = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("started"), F.lead("ts").over(w).alias("ended"))
    return resolve.interval_join(events.where("event_type = 'purchase'"), spans, ["user_id"], "ts", "started", "ended").select("event_id", "started")
