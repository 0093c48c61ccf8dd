"""Registered queries over segmented texts and parsed pages (Python table functions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions import text
from rollbook.functions.affidavit import affidavit
from rollbook.operators import layout, pages
from rollbook.registry import query, table


@query("""WITH q AS (SELECT q.conv_id || '|' || q.turn AS key, trim(q.text, ' ') AS question, trim(a.text, ' ') AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user')
SELECT key, length(question) AS q, length(answer) AS a, 'ANSWER' AS marker, CASE WHEN length(answer) > 50 THEN 0.85 ELSE 0.5 END AS confidence FROM q WHERE question != '' AND answer != ''""")
def i2_split_qa(spark, sf):
    turns = table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").select(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), F.col("text").alias("q"))
    said = turns.where("role = 'assistant'").select(F.concat_ws("|", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("key"), F.col("text").alias("a"))
    letters = asked.join(said, "key").select("key", F.concat("q", F.lit("\nANSWER\n"), "a").alias("text"))
    out = letters.select("key", text.split_qa(F.col("text")).alias("s"))
    trim = lambda c: F.regexp_replace(c, r"^[\n ]+|[\n ]+$", "")
    return out.where("s IS NOT NULL").select("key", F.length(trim(F.col("s.question"))).cast("long").alias("q"), F.length(trim(F.col("s.answer"))).cast("long").alias("a"), "s.marker", "s.confidence")


@query()
def m2_visible_text(spark, sf):
    return pages.visible_text(table(spark, sf, "pages"), "page_id", "html").select("page_id", F.length("text").alias("n"))


@query()
def m13_links(spark, sf):
    return pages.links(table(spark, sf, "pages"), "page_id", "html")


@query()
def n9_similarity(spark, sf):
    from rollbook.operators.segments import similarity

    turns = table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("a"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return asked.join(said, ["conv_id", "turn"]).select("conv_id", "turn", F.round(similarity("a", "b"), 6).alias("ratio"))


@query("SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=[\"'']([^\"'']+)[\"'']')) FROM pages) GROUP BY 1")
def m13_link_counts(spark, sf):
    return pages.links(table(spark, sf, "pages"), "page_id", "html").groupBy("page_id").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, 'Order ' || o_orderkey || chr(10) || 'Asked *' || o_custkey || '/' || o_orderkey || chr(10) || '(1) ' || o_orderpriority AS question, '(1) ' || o_orderstatus || chr(10) || 'in ' || year(o_orderdate) AS answer,
0.8 AS confidence, 'Order ' || o_orderkey AS subject, o_custkey || '/' || o_orderkey AS question_ref FROM orders""")
def i26_two_columns(spark, sf):
    head = F.format_string("Order %d\n7\nAsked *%d/%d\n\u0aaa\u0acd\u0ab0\u0ab6\u0acd\u0aa8      \u0a9c\u0ab5\u0abe\u0aac\n", "o_orderkey", "o_custkey", "o_orderkey")
    body = F.format_string("%s(1) %s\n%sin %d", F.rpad(F.concat(F.lit("(1) "), "o_orderpriority"), 40, " "), "o_orderstatus", F.lit(" " * 40), F.year("o_orderdate"))
    docs = table(spark, sf, "orders").select("o_orderkey", F.concat(head, body).alias("text"))
    return layout.split_columns(docs, "o_orderkey", "text").drop("marker")


@query("SELECT c_custkey, 2 AS line_no, c_mktsegment AS district, 2 AS n, CAST(c_nationkey AS DOUBLE) AS primary_figure, CAST(c_nationkey + c_custkey AS DOUBLE) AS total FROM customer")
def i27_district_figures(spark, sf):
    customers = table(spark, sf, "customer")
    districts = [r[0] for r in customers.select("c_mktsegment").distinct().limit(1001).collect()]
    if len(districts) > 1000:
        raise ValueError("more than 1,000 market segments are no gazetteer")
    spaced = F.concat(F.substring("c_mktsegment", 1, 2), F.lit(" "), F.expr("substring(c_mktsegment, 3)"))
    docs = customers.select("c_custkey", F.concat(F.lit("of "), "c_mktsegment", F.lit("\n"), spaced, F.format_string(" (1) 31/12/2025 %d  %,d", "c_nationkey", "c_custkey")).alias("text"))
    total = F.aggregate("figures", F.lit(0.0), lambda a, x: a + x)
    return layout.district_figures(docs, "c_custkey", "text", districts).select("c_custkey", "line_no", "district", F.size("figures").alias("n"), "primary_figure", total.alias("total"))


@query("""SELECT p_partkey, CASE WHEN p_size < 13 THEN 'unknown' WHEN p_size < 25 OR p_name NOT LIKE '%e%' AND (p_size < 38 OR p_name NOT LIKE '%d%') THEN 'clean' WHEN p_size >= 38 AND p_name LIKE '%e%' AND p_name LIKE '%d%' THEN 'low' ELSE 'repaired' END AS quality FROM part""")
def i28_repair(spark, sf):
    marked = F.when(F.col("p_size") < 25, F.col("p_name")).when(F.col("p_size") < 38, F.translate("p_name", "e", "\u0ae1")).otherwise(F.translate("p_name", "ed", "\u0ae1\u0ae1"))
    docs = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("1\n"), marked, F.lit("\nmore")).alias("text"), F.when(F.col("p_size") >= 13, F.col("p_name")).alias("subject"))
    return layout.repaired(docs, "text", "subject").select("p_partkey", "quality")


@query("""SELECT c_custkey, c_name || ' & co' AS name, CASE WHEN c_nationkey = 1 THEN 'Winner' END AS winner_status, c_mktsegment AS party, CAST(NULL AS VARCHAR) AS spouse_profession, CAST(c_nationkey AS BIGINT) AS age, CAST(c_custkey AS BIGINT) AS assets_rupees FROM customer""")
def m12_affidavit(spark, sf):
    won = F.when(F.col("c_nationkey") == 1, "<font size=2>(Winner)</font>").otherwise("")
    html = F.concat(F.lit("<h2>"), "c_name", F.lit(" &amp; co "), won, F.lit("</h2><b>Party:</b> "), "c_mktsegment", F.format_string("<br><b>Age:</b> %d<p>Assets:</td><td> <b>Rs&nbsp;%,d</b>", "c_nationkey", "c_custkey"))
    pages_ = table(spark, sf, "customer").select("c_custkey", affidavit(html).alias("a"))
    return pages_.select("c_custkey", "a.name", "a.winner_status", "a.party", "a.spouse_profession", "a.age", "a.assets_rupees")
