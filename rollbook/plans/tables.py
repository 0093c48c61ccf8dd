"""Registered queries of operators over manifests, payloads and texts whose inputs are made of whole
tables: what their SQL expects comes from the tables' own columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions import dates, names, web
from rollbook.functions.numbers import increasing
from rollbook.operators import audit, listings, lists, pages, resolve, segments
from rollbook.operators import relational as rel
from rollbook.registry import query, table
from rollbook.sources import payloads
from rollbook.streaming import ingest


def _line(*parts):
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


def _s(column: str):
    return F.col(column).cast("string")


# ---- relational ----


@query("SELECT o_orderkey, 'RS|' || o_orderpriority || '|' || o_custkey AS key FROM orders WHERE o_orderstatus = 'P'")
def d3_linkage(spark, sf):
    taken = table(spark, sf, "orders").where("o_orderstatus = 'P'").withColumn("title", _line("Action taken on the recommendations contained in the ", _s("o_custkey"), "th Report"))
    number = names.referenced_number(F.col("title"))
    return taken.select("o_orderkey", names.referenced_key(F.lit("RS"), F.lit(None), F.col("o_orderpriority"), number).alias("key")).where("key IS NOT NULL")


@query("SELECT 'orders' AS family, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders UNION ALL SELECT 'customer', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer")
def d5_bundle(spark, sf):
    a, b = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return rel.bundle(orders=a, customer=b).groupBy("family").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS exact, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS second FROM orders")
def d8_askers(spark, sf):
    roster = table(spark, sf, "customer").select(F.col("c_name").alias("name"), _s("c_custkey").alias("entity_id"), F.col("c_custkey").alias("position"))
    name = F.concat(F.lit("Customer#"), F.lpad(_s("o_custkey"), 9, "0"))
    asked = F.array(name, F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("Shri "), F.upper(name))).otherwise("nobody"))
    out = resolve.enrich(table(spark, sf, "orders").select("o_orderkey", asked.alias("askers")), roster, "o_orderkey", "askers")
    return out.select("o_orderkey", F.col("entity_ids")[0].alias("exact"), F.col("entity_ids")[1].alias("second"))


@query("SELECT c_nationkey, CAST(max(c_custkey) AS VARCHAR) AS entity_id FROM customer GROUP BY 1")
def d9_roster(spark, sf):
    """Of people of one name the last loaded counts."""
    roster = table(spark, sf, "customer").select(F.concat(F.lit("Person N"), _s("c_nationkey")).alias("name"), _s("c_custkey").alias("entity_id"), F.col("c_custkey").alias("position"))
    asked = table(spark, sf, "customer").select("c_nationkey").distinct().withColumn("askers", F.array(F.concat(F.lit("Person N"), _s("c_nationkey"))))
    return resolve.enrich(asked, roster, "c_nationkey", "askers").select("c_nationkey", F.col("entity_ids")[0].alias("entity_id"))


@query("""WITH l AS (SELECT c_custkey AS label_id, c_nationkey AS n, c_nationkey % 5 AS r, c_custkey % 4 AS k FROM customer)
SELECT label_id, CASE WHEN k = 3 THEN 'unresolved' WHEN k = 2 AND r != 1 THEN 'state_mismatch' ELSE 'resolved' END AS status, CASE WHEN k < 2 OR k = 2 AND r = 1 THEN CAST(n AS VARCHAR) END AS code FROM l""")
def d14_district_resolve(spark, sf):
    """Every customer's nation, spelled in four ways, among nations: a name, an alias, a state that
    it may not be of, a name that nobody has."""
    nation = table(spark, sf, "nation")
    variants = resolve.label_index(nation.select(_s("n_nationkey").alias("code"), F.col("n_name").alias("label"), (F.col("n_nationkey") % 5).cast("string").alias("state"), F.lit("exact").alias("quality"), F.lit(0).alias("priority")))
    aliases = nation.select(F.concat(F.lit("natn"), _s("n_nationkey")).alias("alias_key"), F.concat(F.lit("nation"), _s("n_nationkey")).alias("variant_key"))
    kind, n = F.col("c_custkey") % 4, _s("c_nationkey")
    label = F.when(kind == 1, F.concat(F.lit("Natn "), n)).when(kind == 3, F.concat(F.lit("nowhere "), n)).otherwise(F.concat(F.lit("Nátion-"), n))
    labels = table(spark, sf, "customer").select(F.col("c_custkey").alias("label_id"), label.alias("label"), F.when(kind == 2, "01").alias("state"))
    return resolve.resolve_labels(labels, variants, aliases)


@query("""SELECT 'nation' || n_nationkey AS variant_key, CAST(n_nationkey AS VARCHAR) AS code, n_nationkey % 2 AS priority FROM nation UNION ALL SELECT 'old' || n_nationkey, CAST(n_nationkey AS VARCHAR), 1 FROM nation WHERE n_nationkey % 3 = 0""")
def d15_label_index(spark, sf):
    """Names of a second source that lead elsewhere, and weak ones, are left out."""
    nation = table(spark, sf, "nation")
    row = lambda code, label, quality, priority: (code.cast("string").alias("code"), label.alias("label"), F.lit("0").alias("state"), F.lit(quality).alias("quality"), priority.cast("int").alias("priority"))
    key = F.col("n_nationkey")
    rows = nation.select(*row(key, F.col("n_name"), "exact", key % 2))
    rows = rows.unionByName(nation.select(*row(key + 100, F.col("n_name"), "strong", F.lit(2))))
    rows = rows.unionByName(nation.where("n_nationkey % 3 = 0").select(*row(key, F.concat(F.lit("Old "), key.cast("string")), "strong", F.lit(1))))
    rows = rows.unionByName(nation.select(*row(key, F.concat(F.lit("Weak "), key.cast("string")), "weak", F.lit(1))))
    return resolve.label_index(rows).select("variant_key", "code", "priority")


@query("""WITH p AS (SELECT c_nationkey AS n, c_custkey, c_mktsegment AS seg FROM customer), q AS (SELECT s_suppkey, s_nationkey AS n, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN 'BUILDING' ELSE 'none' END AS party FROM supplier),
c AS (SELECT s_suppkey, count(c_custkey) AS candidates, count(*) FILTER (WHERE seg = party) AS fits, min(c_custkey) AS sole, min(c_custkey) FILTER (WHERE seg = party) AS fit FROM q LEFT JOIN p USING (n) GROUP BY 1)
SELECT s_suppkey AS query_id, CASE WHEN candidates = 0 THEN 'unknown' WHEN candidates = 1 OR fits = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN candidates = 1 THEN CAST(sole AS VARCHAR) WHEN fits = 1 THEN CAST(fit AS VARCHAR) END AS entity_id, candidates FROM c""")
def d18_name_resolution(spark, sf):
    """Suppliers look for a person named after their nation among all customers, of a party that
    some name, one that nobody has, or none."""
    customer = table(spark, sf, "customer")
    people = customer.select(_s("c_custkey").alias("entity_id"), F.concat(F.lit("Shri Person, N"), _s("c_nationkey")).alias("canonical_name"), F.array().cast("array<string>").alias("alt_names"))
    none = F.lit(None).cast("string")
    members = customer.select(_s("c_custkey").alias("entity_id"), none.alias("house"), F.col("c_mktsegment").alias("party"), none.alias("party_name"), none.alias("state"))
    party = F.when(F.col("s_suppkey") % 3 == 1, "building").when(F.col("s_suppkey") % 3 == 2, "none")
    asked = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("N"), _s("s_nationkey"), F.lit(" PERSON")).alias("name"), none.alias("house"), party.alias("party"), none.alias("state"))
    return resolve.resolve_names(asked, people, members)


@query("SELECT c_custkey, round(((c_mktsegment = 'BUILDING')::INT + (c_nationkey % 5 = 2)::INT) / 2.0, 6) AS score FROM customer")
def d19_context_scores(spark, sf):
    customer = table(spark, sf, "customer")
    none = F.lit(None).cast("string")
    members = customer.select("c_custkey", none.alias("m_house"), F.col("c_mktsegment").alias("m_party"), none.alias("m_party_name"), (F.col("c_nationkey") % 5).cast("string").alias("m_state"))
    return members.select("c_custkey", F.round(resolve.context_score(none, F.lit(" Building "), F.lit("2")), 6).alias("score"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS entity_id, arg_min(c_name, c_custkey) AS canonical_name, count(*) - 1 AS others, min(c_custkey) AS first_seen_at, max(c_custkey) AS last_updated_at FROM customer GROUP BY 1")
def d20_merged_entities(spark, sf):
    rows = table(spark, sf, "customer").select(_s("c_nationkey").alias("entity_id"), F.col("c_name").alias("canonical_name"), F.array().cast("array<string>").alias("alt_names"), F.col("c_custkey").alias("first_seen_at"), F.col("c_custkey").alias("last_updated_at"))
    return rel.merge_entities(rows).select("entity_id", "canonical_name", F.size("alt_names").cast("long").alias("others"), "first_seen_at", "last_updated_at")


@query("SELECT o_orderkey, o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) OR o_orderstatus = 'O' AS settled FROM orders")
def d26_settled_documents(spark, sf):
    prior = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "failed").otherwise("new").alias("status"), _s("o_custkey").alias("path"))
    files = table(spark, sf, "customer").where("c_nationkey < 12").select(_s("c_custkey").alias("path"))
    return listings.settled_documents(prior, files).select("o_orderkey", "settled")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def e2_top_counter(spark, sf):
    return rel.top(table(spark, sf, "events"), "event_type", 3)


@query("SELECT c_name AS company, 'FY' || year(o_orderdate) AS financial_year, CAST(sum(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE CAST(o_totalprice AS DECIMAL(20,4)) END) AS DOUBLE) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def e8_spend(spark, sf):
    """Disclosure rows made of orders: an amount that is no number counts as zero."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    amount = F.when(F.col("o_orderkey") % 7 == 0, "not stated").otherwise(_s("o_totalprice"))
    cells = {"Company Name": F.concat(F.lit(" "), "c_name"), "Financial Year": F.concat(F.lit("FY"), F.year("o_orderdate").cast("string")), "PSU/Non-PSU": F.lit(""), "CSR State": _s("c_nationkey"), "CSR Development Sector": F.col("c_mktsegment"), "CSR Sub Development Sector": F.lit(None).cast("string"), "Project Amount Spent (In INR Cr.)": amount}
    return payloads.spend_by_company(payloads.spend(rows.select(*(v.alias(k) for k, v in cells.items()))))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS state, CASE WHEN count(c_custkey) = 0 THEN 'absent' WHEN bool_or(c_mktsegment != 'BUILDING' AND c_nationkey % 3 != 0) THEN 'principal_present' ELSE 'amendment_only' END AS availability
FROM nation LEFT JOIN customer ON c_nationkey + 5 = n_nationkey GROUP BY 1""")
def e21_statutes(spark, sf):
    amends = (F.col("c_mktsegment") == "BUILDING") | (F.col("c_nationkey") % 3 == 0)
    acts = table(spark, sf, "customer").select((F.col("c_nationkey") + 5).cast("string").alias("state"), F.when(amends, "The Act (Amendment) 1990").otherwise("The Act").alias("description"))
    return listings.statute_availability(acts, table(spark, sf, "nation").select(_s("n_nationkey").alias("state")))


@query("SELECT p_partkey, p_size % 50 + p_size % 7 + 3 AS posts, 3 AS kinds FROM part")
def e20_category_rosters(spark, sf):
    ads = table(spark, sf, "part").select("p_partkey", _line("Posts: UR - ", (F.col("p_size") % 50).cast("string"), ", OBC-NCL: ", (F.col("p_size") % 7).cast("string"), ", SC 3").alias("t"))
    return lists.category_rosters(ads, "p_partkey", "t").select("p_partkey", "posts", F.size("categories").alias("kinds"))


@query("""SELECT p AS position, t AS name, CAST(NULL AS VARCHAR) AS error FROM (SELECT min(position) AS p, t FROM (SELECT DISTINCT p_type AS t FROM part), (VALUES (1, 'ECON'), (2, '^S'), (3, 'O')) AS v(position, pattern) WHERE regexp_matches(t, pattern) GROUP BY t)
UNION ALL SELECT 4, NULL, 'no table matches ^none$'""")
def g9_presets(spark, sf):
    patterns = spark.createDataFrame([(1, "ECON"), (2, "^S"), (3, "O"), (4, "^none$")], "position int, pattern string")
    return listings.preset_tables(table(spark, sf, "part").select(F.col("p_type").alias("name")).distinct(), patterns)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def h8_positive_control(spark, sf):
    return audit.assert_finds(table(spark, sf, "events"), F.col("event_id") == 7, "event 7").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def c15_unfinished(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "ok").otherwise("suspect").alias("status"), F.lit("x").alias("path"))
    return ingest.resume_status(rows).where(~F.col("status").isin(*ingest.TERMINAL)).select("o_orderkey")


@query("SELECT user_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'downloaded' ELSE 'metadata_only' END ELSE arg_max(event_type, (ts, event_id)) END AS status FROM events GROUP BY 1")
def p3_resume_status(spark, sf):
    last = rel.last_row(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])
    rows = last.select("user_id", F.when(F.col("event_type") == "click", "ok").otherwise(F.col("event_type")).alias("status"), F.when(F.col("user_id") % 2 == 0, "a.pdf").otherwise(" ").alias("path"))
    return ingest.resume_status(rows).select("user_id", "status")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def p4_changed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    seen = docs.withColumn("fingerprint", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("fingerprint")))
    return ingest.changed(docs, seen, "doc_id", "fingerprint").select("doc_id")


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def p5_status_append(spark, sf):
    return rel.status_changes(table(spark, sf, "events"), ["user_id"], "event_type", ["ts", "event_id"]).select("event_id")


# ---- payloads ----


@query("SELECT h AS house, CAST(greatest(m, a) AS DATE) AS from_date, CAST(least(last_day(m), b) AS DATE) AS to_date FROM (SELECT event_type AS h, CAST(min(ts) AS DATE) - 70 AS a, CAST(max(ts) AS DATE) AS b, CAST(unnest(generate_series(date_trunc('month', CAST(min(ts) AS DATE) - 70), CAST(max(ts) AS DATE), INTERVAL 1 MONTH)) AS DATE) AS m FROM events GROUP BY 1)")
def a3_month_plan(spark, sf):
    houses = table(spark, sf, "events").groupBy(F.col("event_type").alias("house")).agg(F.date_sub(F.to_date(F.min("ts")), 70).alias("low"), F.to_date(F.max("ts")).alias("high"))
    return payloads.month_plan(houses).select("house", "from_date", "to_date")


@query("SELECT event_type AS house, user_id AS session, CAST(count(DISTINCT CAST(ts AS DATE)) AS INTEGER) AS sittings, min(CAST(ts AS DATE)) AS first_sitting, max(CAST(ts AS DATE)) AS last_sitting FROM events GROUP BY 1, 2")
def a8_sessions(spark, sf):
    days = table(spark, sf, "events").groupBy(F.col("event_type").alias("house"), F.col("user_id").alias("session")).agg(F.collect_set(F.date_format("ts", "dd/MM/yyyy")).alias("dates"))
    out = payloads.session_catalogue(days.withColumn("loksabha", F.lit(18)).withColumn("periods", F.lit(None).cast("array<string>")))
    return out.select("house", "session", "sittings", "first_sitting", "last_sitting")


@query("SELECT 'WAYBACK|' || url || '|' || strftime(DATE '2020-01-01' + CAST(page_id AS INTEGER), '%Y%m%d') || '101112' AS key, strftime(DATE '2020-01-01' + CAST(page_id AS INTEGER), '%Y-%m-%d') || 'T10:11:12Z' AS captured_at, CASE WHEN page_id % 2 = 0 THEN '200' END AS http_status, length(html) AS length FROM pages")
def a36_captures(spark, sf):
    """Index answers made of pages: a header row, a capture, a resume mark."""
    stamp = F.concat(F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("page_id").cast("int")), "yyyyMMdd"), F.lit("101112"))
    status = F.when(F.col("page_id") % 2 == 0, "200").otherwise("")
    answer = F.array(F.array(*(F.lit(x) for x in ("original", "timestamp", "statuscode", "digest", "mimetype", "length"))), F.array("url", stamp, status, F.lit("D"), F.lit("text/html"), F.length("html").cast("string")), F.array().cast("array<string>"), F.array(F.lit("mark")))
    return payloads.captures(table(spark, sf, "pages").select(F.to_json(answer).alias("body"))).select("key", "captured_at", "http_status", "length")


@query("SELECT 'BILL|' || CASE WHEN o_orderstatus = 'P' THEN 'RS' ELSE 'LS' END || '|' || year(o_orderdate) || '|' || o_orderkey AS key, CAST(o_orderdate AS DATE) AS introduced_date, o_orderkey % 5 = 0 AS unreadable FROM orders WHERE o_orderkey % 5 != 0 UNION ALL SELECT 'BILL|' || CASE WHEN o_orderstatus = 'P' THEN 'RS' ELSE 'LS' END || '|' || year(o_orderdate) || '|' || o_orderkey, NULL, true FROM orders WHERE o_orderkey % 5 = 0")
def a14_bills(spark, sf):
    day = F.when(F.col("o_orderkey") % 5 == 0, "31/02/2001").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    bill = F.struct(_s("o_orderkey").alias("billNumber"), F.year("o_orderdate").cast("string").alias("billYear"), F.col("o_orderpriority").alias("billName"), day.alias("billIntroducedDate"))
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "P", "RS").otherwise("LS").alias("house"), F.to_json(F.array(bill)).alias("body"))
    return payloads.bills(rows).select("key", "introduced_date", "unreadable")


@query("SELECT c_custkey, c_nationkey BETWEEN 3 AND 9 AND c_custkey % 10 BETWEEN 2 AND 5 AS inside FROM customer WHERE c_custkey % 4 != 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 4 = 0")
def c9_point_in_box(spark, sf):
    point = F.struct(F.when(F.col("c_custkey") % 4 == 0, "Polygon").otherwise("Point").alias("type"), F.array(F.array(F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 10).cast("double"))).alias("points"))
    return table(spark, sf, "customer").withColumn("geometry", point).select("c_custkey", payloads.in_box(F.col("geometry"), 3.0, 2.0, 9.0, 5.0).alias("inside"))


def _blocks(spark, sf, wrapper, row, data="data"):
    district = F.struct(F.col("c_name").alias("district"), F.array(F.struct(*row)).alias(data))
    return table(spark, sf, "customer").select("c_custkey", F.to_json(F.struct(F.array(F.struct(F.array(district).alias("districts"))).alias(wrapper))).alias("body"))


@query("SELECT c_custkey, c_name AS district, 'projects' AS field, CAST(c_nationkey AS DOUBLE) AS value FROM customer WHERE c_custkey % 2 = 0")
def l10_registration(spark, sf):
    return payloads.registration(_blocks(spark, sf, "registrationPTdata", (F.when(F.col("c_custkey") % 2 == 0, "Project").otherwise("Other").alias("title"), _s("c_nationkey").alias("count"))))


@query("SELECT c_custkey, c_name AS district, c_mktsegment AS field, CAST(c_nationkey AS DOUBLE) AS value FROM customer")
def l12_infrastructure(spark, sf):
    return payloads.titled(_blocks(spark, sf, "awcInfrastructureCount", (F.col("c_mktsegment").alias("title"), _s("c_nationkey").alias("count"))), "awcInfrastructureCount")


@query("SELECT c_custkey, c_name AS district, 'home_visit_' || lower(c_mktsegment) || '_0_6_months' AS field, CAST(c_nationkey AS DOUBLE) AS value FROM customer")
def l13_home_visits(spark, sf):
    return payloads.home_visits(_blocks(spark, sf, "homevisit", (F.col("c_mktsegment").alias("title"), F.lit("(0-6 months)").alias("title1"), _s("c_nationkey").alias("count"))))


@query("""SELECT c_custkey, c_name AS district, 'stunted_pct_' || CASE WHEN c_custkey % 2 = 0 THEN '0m_6y' ELSE '0m_5y' END AS field, CAST(c_nationkey AS DOUBLE) AS value FROM customer""")
def l11_growth(spark, sf):
    return payloads.growth(_blocks(spark, sf, "growthmonitoring", (F.lit("Stunted").alias("title"), F.when(F.col("c_custkey") % 2 == 0, "0-6 Years").otherwise("0-5 Years").alias("title1"), _s("c_nationkey").alias("percent"))))


@query("SELECT c_custkey, 'snp_given_' || (c_nationkey + 10) || 'd' AS field, CAST(c_custkey AS DOUBLE) AS value FROM customer UNION ALL SELECT c_custkey, 'thr_per_' || (c_nationkey + 10) || 'd', 7.5 FROM customer")
def l15_key_services(spark, sf):
    row = F.map_from_arrays(F.array(F.concat(F.lit("snp_Given"), (F.col("c_nationkey") + 10).cast("string")), F.lit("thr_per"), F.lit("_id")), F.array(_s("c_custkey"), F.lit("7.5"), F.lit("9")))
    district = F.struct(F.col("c_name").alias("district"), F.array(row).alias("data"))
    rows = table(spark, sf, "customer").select("c_custkey", F.to_json(F.struct(F.array(F.struct(F.array(district).alias("districts"))).alias("keyservices"))).alias("body"))
    return payloads.key_services(rows).select("c_custkey", "field", "value")


@query("SELECT c_custkey, c_name AS district, 'beneficiaries_' || lower(c_mktsegment) || '_new' AS field, CAST(c_nationkey AS DOUBLE) AS value FROM customer")
def l16_beneficiaries(spark, sf):
    return payloads.beneficiaries(_blocks(spark, sf, "monthWiseActiveBeneficiaries", (F.col("c_mktsegment").alias("title"), F.lit("new").alias("title1"), _s("c_nationkey").alias("count")), "activeBeneficiaries"))


# ---- texts and pages ----


@query("""SELECT o_orderkey, 1 AS recommendation_no, 'Do ' || o_orderpriority AS recommendation_text, CASE WHEN o_orderstatus = 'F' THEN 'Done.' ELSE '' END AS response_text, CASE WHEN o_orderstatus = 'F' THEN 0.9 ELSE 0.4 END AS confidence FROM orders
UNION ALL SELECT o_orderkey, 2, 'Do that.', '', 0.4 FROM orders""")
def i6_action_taken(spark, sf):
    said = _line("Recommendation No. 1\nDo ", F.col("o_orderpriority"), F.when(F.col("o_orderstatus") == "F", "\nReply of the Government\nDone.").otherwise(""), "\nObservation/Recommendation No. 2\nDo that.")
    return segments.action_taken(table(spark, sf, "orders").select("o_orderkey", said.alias("t")), "o_orderkey", "t")


@query("SELECT c_custkey, n AS recommendation_no, CASE n WHEN 1 THEN 'First ' || c_name ELSE 'Second.' END AS recommendation_text, 0.5 AS confidence FROM customer, (VALUES (1), (2)) AS v(n)")
def i7_observations(spark, sf):
    said = _line("OBSERVATIONS/RECOMMENDATIONS 5\nOBSERVATIONS / RECOMMENDATIONS\n1. First ", F.col("c_name"), "\n2. Second.\nANNEXURE\n3. no")
    return segments.observations(table(spark, sf, "customer").select("c_custkey", said.alias("t")), "c_custkey", "t")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey % 90000 + 1 AS VARCHAR) WHEN 2 THEN CAST(c_custkey % 90000 + 2 AS VARCHAR) END AS printed FROM customer")
def i10_printed_number(spark, sf):
    kind, n = F.col("c_custkey") % 3, F.col("c_custkey") % 90000
    said = F.when(kind == 0, _line("UNSTARRED QUESTION NO. ", (n + 1).cast("string"))).when(kind == 1, _line("in reply to Starred Question No.", (n + 1).cast("string"))).otherwise(_line("QUESTION 31.07.2026 then QUESTION N0.", (n + 2).cast("string")))
    return segments.printed_number(table(spark, sf, "customer").select("c_custkey", said.alias("t")), "c_custkey", "t")


@query("""SELECT p_partkey, 'in_answer_summary' AS layout, s AS service, 100 + p_size + k AS sanctioned, 90 + k AS in_position, 10 + p_size AS vacant, '2023-04-01' AS date_of_data FROM part, (VALUES ('IAS', 0), ('IPS', 100)) AS v(s, k) WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'annexure_cadre_matrix', NULL, 100 + p_size, 90, 10 + p_size, NULL FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 'evasive', NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 3 = 2""")
def i17_vacancies(spark, sf):
    size, kind = F.col("p_size"), F.col("p_partkey") % 3
    summary = _line("as on 1.4.2023\nName of Service IAS IPS\nSanctioned strength ", (size + 100).cast("string"), " ", (size + 200).cast("string"), "\nOfficers in position 90 190")
    matrix = _line("Cadre  Authorised strength  In position\n1. Kerala  ", (size + 100).cast("string"), "  90\nANNEXURE I\n2. Other  1  2")
    answer = F.when(kind == 0, summary).when(kind == 1, matrix).otherwise("The information is being collected.")
    rows = table(spark, sf, "part").select("p_partkey", F.lit("posts lying vacant").alias("q"), answer.alias("a"))
    return lists.vacancy_rows(rows, "p_partkey", "q", "a").select("p_partkey", "layout", "service", "sanctioned", "in_position", "vacant", "date_of_data")


@query("""SELECT p_partkey, line_no, signal, term, value FROM part, LATERAL (SELECT * FROM (VALUES (2, 'spend', 'consultancy', p_size * 100000.0), (3, 'headcount', 'consultants', p_size + 100.0), (3, 'spend', 'consultants', 200000.0), (4, 'mention', 'young professionals', NULL)) AS v(line_no, signal, term, value))""")
def i21_signals_told(spark, sf):
    said = _line("A sum of Rs. ", _s("p_size"), " lakh was spent\non consultancy.\nIt engaged ", (F.col("p_size") + 100).cast("string"), " consultants at Rs. 2 lakh.\nyoung professionals")
    return segments.outsourcing_signals(table(spark, sf, "part").select("p_partkey", said.alias("t")), "p_partkey", "t").select("p_partkey", "line_no", "signal", "term", "value")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS heads FROM part WHERE p_size NOT BETWEEN 1900 AND 2100")
def g6_nearest_number(spark, sf):
    """Of the numbers about a term the nearest that counts heads: no share, year, duration or amount."""
    said = _line("In 2019 for 3 years 12% of ", _s("p_size"), " consultants at Rs. 7 lakh, not 400000")
    return segments.outsourcing_signals(table(spark, sf, "part").select("p_partkey", said.alias("t")), "p_partkey", "t").where("signal = 'headcount'").select("p_partkey", F.col("value").alias("heads"))


@query("""SELECT c_custkey, 'question_list' AS list_type, CAST(n AS VARCHAR) AS qno, CASE n WHEN 1 THEN c_mktsegment ELSE 'ROADS' END AS subject, CASE n WHEN 1 THEN 'COAL' ELSE 'ROADS' END AS ministry, CASE n WHEN 1 THEN '(a) the ' || c_name ELSE '' END AS body FROM customer, (VALUES (1), (2)) AS v(n)""")
def i24_question_rows(spark, sf):
    said = _line(F.col("c_mktsegment"), "\n*1. Shri A B:\nWill the Minister of COAL be pleased to state:\n(a) the ", F.col("c_name"), "\nROADS\n*2. Dr. E F:\nWill the Minister of ROADS be pleased to state:\n")
    return lists.question_rows(table(spark, sf, "customer").select("c_custkey", said.alias("t")), "c_custkey", "t").select("c_custkey", "list_type", "qno", "subject", "ministry", "body")


@query("SELECT c_custkey, r AS row_no, CASE r WHEN 0 THEN 'Name|Segment' ELSE c_name || '|' || c_mktsegment END AS cells, CASE r WHEN 1 THEN '/x' || c_custkey END AS href FROM customer, (VALUES (0), (1)) AS v(r)")
def m1_tables(spark, sf):
    html = _line("<table><tr><th>Name</th><th>Segment</th></tr><tr><td><a href='/x", _s("c_custkey"), "'>", F.col("c_name"), "</a></td><td> ", F.col("c_mktsegment"), "</table>")
    return pages.tables(table(spark, sf, "customer").select("c_custkey", html.alias("t")), "c_custkey", "t").select("c_custkey", "row_no", F.array_join("cells", "|").alias("cells"), F.array_max("hrefs").alias("href"))


@query("SELECT c_custkey, k AS kind, CASE k WHEN 'hidden' THEN 'state' ELSE 'seg' END AS name, CASE k WHEN 'option' THEN CAST(c_nationkey + 1 AS VARCHAR) WHEN 'hidden' THEN c_name ELSE '0' END AS value, CASE k WHEN 'option' THEN c_mktsegment WHEN 'hidden' THEN '' ELSE 'Choose' END AS label FROM customer, (VALUES ('hidden'), ('placeholder'), ('option')) AS v(k)")
def m15_form_fields(spark, sf):
    html = _line('<input type="HIDDEN" name="state" value="', F.col("c_name"), '"><select name="seg"><option value="0">Choose<option value="', (F.col("c_nationkey") + 1).cast("string"), '"> ', F.col("c_mktsegment"), "</select>")
    return pages.form_fields(table(spark, sf, "customer").select("c_custkey", html.alias("t")), "c_custkey", "t")


@query("SELECT c_custkey, 'https://x.org/a/jobs/' || c_custkey || '.pdf' AS url, 'Recruitment of ' || c_mktsegment AS title FROM customer")
def m16_recruitment_links(spark, sf):
    html = _line('<a href="/">Home</a><a href="jobs/', _s("c_custkey"), '.pdf">Recruitment of ', F.col("c_mktsegment"), '</a><a href="#top">Jobs</a>')
    rows = table(spark, sf, "customer").select("c_custkey", F.lit("https://x.org/a/list").alias("u"), html.alias("t"))
    return listings.recruitment_links(rows, "c_custkey", "u", "t").select("c_custkey", "url", "title")


@query("SELECT c_custkey, '2019-20' AS year, CASE WHEN c_custkey % 2 = 0 THEN 'hindi' ELSE 'english' END AS language FROM customer")
def m18_annual_reports(spark, sf):
    html = _line('<a href="/r/Report_', F.when(F.col("c_custkey") % 2 == 0, "Hindi_").otherwise(""), '2019-20.pdf">', F.col("c_name"), '</a><a href="/r/other.pdf">x</a>')
    rows = table(spark, sf, "customer").select("c_custkey", F.lit("https://x.org/a").alias("u"), html.alias("t"))
    return listings.annual_reports(rows, "c_custkey", "u", "t").select("c_custkey", "year", "language")


@query("SELECT c_custkey, '2021-22' AS year, 'Demand no. ' || c_nationkey AS title FROM customer")
def a26_demands(spark, sf):
    html = _line('<a href="/d/', _s("c_custkey"), '_2021-22.pdf">Demand no. ', _s("c_nationkey"), '</a><a href="/d/plan.pdf">Plan</a>')
    rows = table(spark, sf, "customer").select("c_custkey", F.lit("https://x.org/a").alias("u"), html.alias("t"))
    return listings.demand_documents(rows, "c_custkey", "u", "t").select("c_custkey", "year", "title")


@query("SELECT c_custkey, '1.' AS serial, c_name AS name FROM customer")
def c13_grid_rows(spark, sf):
    html = _line("<table><tr><td>Sl. No.</td><td>Name</td><td>Segment</td></tr><tr><td>1.</td><td>", F.col("c_name"), "</td><td>", F.col("c_mktsegment"), "</td></tr><tr><td>note</td></tr></table>")
    out = listings.grid_rows(table(spark, sf, "customer").select("c_custkey", html.alias("t")), "c_custkey", "t")
    return out.select("c_custkey", F.col("cells")[0].alias("serial"), F.col("cells")[1].alias("name"))


@query("SELECT conv_id, CAST(turn + 1 AS INTEGER) AS speech_no, CASE role WHEN 'user' THEN 'SHRI A. B' ELSE 'DR. C' END AS speaker FROM conversations")
def i13_speeches(spark, sf):
    """Turns printed as a debate."""
    who = F.when(F.col("role") == "user", "SHRI A. B").otherwise("DR. C")
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(who, F.lit(": "), F.lit("said "), F.regexp_replace("text", "[:\n]", " ")).alias("said")))), lambda t: t.said), "\n").alias("text"))
    return segments.speeches(turns, "conv_id", "text").select("conv_id", "speech_no", "speaker")


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) + 1 AS INTEGER) AS line_no, 'mention' AS signal, 'consultants' AS term FROM documents")
def i21_signals(spark, sf):
    """Documents that end in a line about consultants."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit("\nconsultants")).alias("text"))
    return segments.outsourcing_signals(docs, "doc_id", "text").where("signal = 'mention' AND term = 'consultants'").select("doc_id", "line_no", "signal", "term")


@query("""SELECT key FROM (SELECT conv_id || '|' || turn AS key, conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations) WHERE following IS NOT NULL AND turn % 3 = 0""")
def f7_bleed(spark, sf):
    """Turns of which every third ends with the next one's subject."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws("|", _s("conv_id"), _s("turn")).alias("key"), F.concat(F.lit("Subject "), _s("conv_id"), F.lit("/"), _s("turn")).alias("subject"))
    following = F.concat(F.lit("Subject "), _s("conv_id"), F.lit("/"), (F.col("turn") + 1).cast("string"))
    told = turns.withColumn("text", F.concat("subject", F.lit("\nbody\n"), F.when(F.col("turn") % 3 == 0, following).otherwise("the end")))
    return audit.bleed(told, "key", "text", "subject", ["conv_id"], "turn").select("key")


@query("SELECT g.i AS position, CASE g.i % 2 WHEN 0 THEN 'a' || p_size ELSE 'b' || p_size END AS query FROM (SELECT row_number() OVER (ORDER BY p_size) - 1 AS r, p_size FROM (SELECT DISTINCT p_size FROM part)) s, generate_series(0, 1000) AS g(i) WHERE g.i // 2 = r")
def c11_search_plan(spark, sf):
    """A profile whose groups are the sizes of parts, with two queries each."""
    size = F.col("p_size").cast("string")
    sizes = table(spark, sf, "part").select("p_size").distinct()
    groups = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("p_size", F.array(F.concat(F.lit("a"), size), F.concat(F.lit("b"), size)).alias("q")))), lambda x: F.struct(x.p_size.cast("string"), x.q)))
    return rel.search_plan(sizes.agg(groups.alias("groups"))).select(F.col("position").cast("long").alias("position"), "query")


# ---- filters, names and reports ----


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN o_custkey % 2 = 0 ELSE false END AS kept, count(*) AS n FROM orders GROUP BY 1")
def c7_topic_filter(spark, sf):
    rows = rel.topic_filter(table(spark, sf, "orders"), F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 == 0)
    return rows.groupBy("kept").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def c8_question_type(spark, sf):
    rows = table(spark, sf, "events").select(F.concat(F.lit(" "), F.upper("event_type")).alias("t"))
    return rel.of_type(rows, "t", "Click ").agg(F.count("*").alias("n"))


@query("""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'rejected' WHEN c_custkey % 5 = 1 THEN 'without_code' WHEN c_custkey % 5 = 2 THEN 'absent_code' WHEN c_custkey % 5 = 3 THEN 'contradicting' ELSE 'merged' END AS verdict FROM customer) GROUP BY 1""")
def d16_crosswalk(spark, sf):
    nation = table(spark, sf, "nation")
    index = resolve.label_index(nation.select(_s("n_nationkey").alias("code"), F.col("n_name").alias("label"), F.lit("0").alias("state"), F.lit("exact").alias("quality"), F.lit(0).alias("priority")))
    kind, n = F.col("c_custkey") % 5, _s("c_nationkey")
    rows = table(spark, sf, "customer").select(
        F.col("c_name").alias("label"),
        F.when(kind == 2, F.concat(F.lit("x"), n)).when(kind != 1, n).alias("code"),
        F.when(kind == 3, "Elsewhere").otherwise(F.concat(F.lit("Nation "), n)).alias("name"),
        F.when(kind == 0, "weak").otherwise(" Exact").alias("quality"),
    )
    return resolve.crosswalk(rows, index).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS query_id, count(c_custkey) AS n, CAST(min(c_custkey) AS VARCHAR) AS least_id FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey AND c_custkey % 2 = 0 GROUP BY 1")
def d23_find_by_name(spark, sf):
    """People bear their nation's name if their number is even, another's else."""
    name = F.concat(F.lit("Person N"), F.when(F.col("c_custkey") % 2 == 0, _s("c_nationkey")).otherwise("one"))
    people = table(spark, sf, "customer").select(_s("c_custkey").alias("entity_id"), F.lit("Somebody").alias("canonical_name"), F.array(name).alias("alt_names"))
    asked = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("n"), _s("s_nationkey"), F.lit(", Shri Person")).alias("name"))
    out = resolve.find_by_name(asked, people)
    return out.select("query_id", F.size("entity_ids").cast("long").alias("n"), F.array_min(F.transform("entity_ids", lambda x: x.cast("long"))).cast("string").alias("least_id"))


@query("SELECT 2 * count(*) AS askers, count(*) + count(*) FILTER (WHERE o_custkey % 4 = 0) AS resolved, round_even(CAST(count(*) + count(*) FILTER (WHERE o_custkey % 4 = 0) AS DOUBLE) / (2 * count(*)), 3) AS rate FROM orders")
def e3_resolution_rate(spark, sf):
    rows = table(spark, sf, "orders").select(F.array("o_orderstatus", "o_orderpriority").alias("askers"), F.array(_s("o_custkey"), F.when(F.col("o_custkey") % 4 == 0, "x")).alias("ids"))
    return resolve.resolution_rate(rows, "askers", "ids")


@query("""WITH y AS (SELECT 'FY' || year(o_orderdate) AS financial_year, sum(CAST(o_totalprice AS DECIMAL(20,4))) AS amount FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT financial_year, CAST(amount AS DOUBLE) AS amount, CAST(amount - lag(amount) OVER (ORDER BY financial_year) AS DOUBLE) AS change FROM y""")
def e6_year_over_year(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("company"), F.concat(F.lit("FY"), F.year("o_orderdate").cast("string")).alias("financial_year"), F.col("o_totalprice").alias("amount"))
    return rel.year_over_year(rows, "1-URGENT")


@query("SELECT DISTINCT user_id, m AS accepted FROM (SELECT user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS m FROM events)")
def f10_increasing(spark, sf):
    """Of each user's values in order those that exceed all before them."""
    values = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x.value).alias("v"))
    return values.select("user_id", F.explode(increasing(F.col("v"))).alias("accepted"))


@query("SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 100")
def g1_brake(spark, sf):
    return rel.braked(table(spark, sf, "events"), [F.desc("value"), "event_id"], 100).select("event_id")


@query("SELECT c_nationkey, CAST(c_custkey AS VARCHAR) AS entity_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, CAST(c_custkey AS VARCHAR)) AS INTEGER) AS rank FROM customer")
def g3_ranked(spark, sf):
    rows = table(spark, sf, "customer").select("c_nationkey", _s("c_custkey").alias("entity_id"), F.col("c_acctbal").alias("score"))
    return resolve.ranked(rows, "c_nationkey", "score").select("c_nationkey", "entity_id", "rank")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name || ' of ' || c_mktsegment END AS line FROM customer")
def g7_best_line(spark, sf):
    """A garbled subject among lines; for every third there is none like it."""
    text_ = _line("a\nsome words about roads\n ", F.when(F.col("c_custkey") % 3 > 0, F.concat("c_name", F.lit(" of "), "c_mktsegment")).otherwise("~~~~~~~"), " \nand more")
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.translate("c_name", "o", "0"), F.lit(" 0f "), "c_mktsegment").alias("r"), text_.alias("t"))
    return segments.best_line(rows, "c_custkey", "r", "t")


@query("SELECT event_type, array_to_string(list_sort(list(DISTINCT CAST(user_id AS VARCHAR)))[1:50], ',') AS ids FROM events GROUP BY 1")
def g8_sampled_ids(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.array_join(audit.sample_ids(F.col("user_id")), ",").alias("ids"))


@query("SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderstatus != o_orderpriority THEN ',' || o_orderstatus ELSE '' END AS names FROM orders")
def h3_named(spark, sf):
    offered = F.array(F.concat(F.lit(" "), "o_orderpriority"), F.lit("  "), "o_orderstatus", F.concat("o_orderpriority", F.lit(" ")))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(audit.named(offered), ",").alias("names"))


@query("SELECT count(*) FILTER (WHERE event_type != 'error') AS \"values\", count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'error') > 0 AS partial FROM events")
def h7_collected(spark, sf):
    out = audit.collected(table(spark, sf, "events"), "event_id", F.col("value"), F.when(F.col("event_type") == "error", "failed"))
    return out.select("values", "failed", "partial")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS q FROM events WHERE event_type = 'click' OR value > 50")
def h10_united(spark, sf):
    events = table(spark, sf, "events")
    return rel.united([events.where("event_type = 'click'").select("event_id", F.lit(0).alias("q")), events.where("value > 50").select("event_id", F.lit(1).alias("q"))], ["event_id"])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '2020-03-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') END AS published, CASE WHEN p_partkey % 3 < 2 THEN '2021-04-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') END AS closing FROM part""")
def j8_dates_by_context(spark, sf):
    day, kind = (F.col("p_size") % 28 + 1).cast("string"), F.col("p_partkey") % 3
    both = _line("Advertisement No. 4 dated ", day, ".3.2020, in all so many posts for a year and a day and more than that. Last date: ", day, " Apr 2021")
    said = F.when(kind == 0, both).when(kind == 1, _line("to reach us by ", day, "-04-2021")).otherwise(_line("on ", day, "-04-2021 and ", day, "/13/2021"))
    return table(spark, sf, "part").select("p_partkey", dates.dates_by_context(said).alias("d")).select("p_partkey", "d.*")


@query("SELECT o_orderkey, CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month FROM (SELECT o_orderkey, unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate) + INTERVAL 3 MONTH, INTERVAL 1 MONTH)) AS m FROM orders)")
def j12_months(spark, sf):
    last = F.add_months("o_orderdate", 3)
    run = dates.months(F.year("o_orderdate"), F.month("o_orderdate"), F.year(last), F.month(last))
    return table(spark, sf, "orders").select("o_orderkey", F.explode(run).alias("m")).select("o_orderkey", "m.*")


@query("SELECT c_custkey AS ref_id, CASE c_custkey % 3 WHEN 2 THEN NULL ELSE c_nationkey END AS code FROM customer")
def k15_states(spark, sf):
    states = table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    ref = F.when(F.col("c_custkey") % 3 == 0, _s("c_nationkey")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" Nation_"), _s("c_nationkey"))).otherwise("nowhere")
    return resolve.resolve_state(table(spark, sf, "customer").select(F.col("c_custkey").alias("ref_id"), ref.alias("ref")), states)


@query("SELECT c_custkey, 'https://x.org/a%20b/Customer%23' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '/%C3%A9?q=' || c_mktsegment || '%20%2A#top' AS url FROM customer")
def n5_encoded_paths(spark, sf):
    raw = _line("https://x.org/a b/", F.replace("c_name", F.lit("#"), F.lit("%23")), "/é?q=", F.col("c_mktsegment"), " *#top")
    return table(spark, sf, "customer").select("c_custkey", web.encoded_path(web.encoded_path(raw)).alias("url"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS hash FROM documents")
def n8_topic_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", web.topic_hash(F.encode("text", "utf-8")).alias("hash"))
