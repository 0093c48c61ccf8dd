"""Registered queries of single functions over whole tables: a column's own values are spelled as
records spell them, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions import dates, names, numbers, text, web
from rollbook.registry import query, table

D = "o_orderdate"
DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def field(name: str, source: str, make, sql: str) -> None:
    """Register `make` of a table under a name."""

    def run(spark, sf):
        return make(table(spark, sf, source))

    run.__name__ = name
    query(sql)(run)


def spelled(pattern: str):
    return F.date_format(D, pattern)


# ---- dates ----
field("j3_slashed_dates", "orders", lambda t: t.select("o_orderkey", dates.or_empty(F.when(F.col("o_orderkey") % 3 == 0, spelled("dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, spelled("dd.MM.yyyy")).otherwise("soon"), "dd/MM/yyyy", "dd.MM.yyyy").alias("day")),
      f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN {DAY} ELSE '' END AS day FROM orders")
field("j4_register_dates", "orders", lambda t: t.select("o_orderkey", dates.register_date(F.when(F.col("o_orderkey") % 2 == 0, spelled("yyyy-MM-dd")).otherwise(spelled("dd/MM/yyyy"))).alias("day")),
      "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d-%m-%Y') END AS day FROM orders")
field("j5_portal_dates", "orders", lambda t: t.select("o_orderkey", dates.or_ten(F.when(F.col("o_orderkey") % 2 == 0, spelled("dd-MMM-yyyy")).otherwise(F.concat(spelled("yyyy-MM-dd"), F.lit("T10:00")))  , "dd-MMM-yyyy").alias("day")),
      f"SELECT o_orderkey, {DAY} AS day FROM orders")
field("j6_http_dates", "events", lambda t: t.select("event_id", dates.http_date(F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("Tue, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise(F.col("event_type"))).alias("at")),
      "SELECT event_id, CASE WHEN user_id % 5 > 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE event_type END AS at FROM events")
field("j7_deadlines", "orders", lambda t: t.select("o_orderkey", dates.deadline(F.concat(F.lit("Applications must be submitted on or before "), spelled("MMMM d, yyyy"), F.lit("\nLast date 01/02/2003")), 1998).alias("raw")).select("o_orderkey", dates.deadline_iso(F.col("raw")).alias("day")),
      f"SELECT o_orderkey, {DAY} AS day FROM orders")
field("j9_archive_stamps", "events", lambda t: t.select("event_id", dates.archive_stamp(F.when(F.col("user_id") % 4 > 0, F.date_format("ts", "yyyyMMddHHmmss")).otherwise(F.date_format("ts", "yyyyMMdd"))).alias("at")),
      "SELECT event_id, CASE WHEN user_id % 4 > 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS at FROM events")
field("j11_day_ranges", "events", lambda t: t.groupBy("user_id").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b")).select("user_id", F.explode(dates.day_range(F.col("a"), F.col("b"))).alias("day")),
      "SELECT user_id, CAST(unnest(generate_series(date_trunc('day', min(ts)), max(ts), INTERVAL 1 DAY)) AS DATE) AS day FROM events GROUP BY user_id")
field("j13_year_buckets", "orders", lambda t: t.groupBy(dates.year_bucket(D).alias("bucket")).agg(F.count("*").alias("n")), "SELECT CAST(year(o_orderdate) AS VARCHAR) AS bucket, count(*) AS n FROM orders GROUP BY 1")
field("j15_turned_dates", "orders", lambda t: t.select("o_orderkey", dates.or_empty(spelled("dd-MM-yyyy"), "dd-MM-yyyy").alias("dmy"), dates.or_empty(spelled("MM-dd-yyyy"), "MM-dd-yyyy").alias("mdy")),
      f"SELECT o_orderkey, {DAY} AS dmy, {DAY} AS mdy FROM orders")
field("j16_as_on", "orders", lambda t: t.select("o_orderkey", dates.as_on(F.concat(F.lit("posts as on "), spelled("d.M.yyyy"), F.lit(", in all"))).alias("day")), f"SELECT o_orderkey, {DAY} AS day FROM orders")
field("f8_as_on_windows", "orders", lambda t: t.where(dates.in_range(dates.as_on(spelled("d/M/yyyy")), "1997-01-01", "1997-12-31")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1997")

# ---- names, labels, numbers in words ----
NUMBER = "lpad(CAST(c_custkey AS VARCHAR), 9, '0')"
field("k2_member_names", "customer", lambda t: t.select("c_custkey", names.normal_member(F.concat_ws(", ", F.concat(F.lit("Person "), F.col("c_custkey").cast("string")), F.lit("Dr. A.B."))).alias("name")),
      "SELECT c_custkey, array_to_string(list_sort(['a', 'b', 'person', CAST(c_custkey AS VARCHAR)]), ' ') AS name FROM customer")
field("k3_slugs", "supplier", lambda t: t.select("s_suppkey", names.slug(F.concat(F.lit("Smt. "), F.col("s_name"), F.lit(" of X.Y"))).alias("slug")), "SELECT s_suppkey, 'supplier_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '_of_x_y' AS slug FROM supplier")
field("k4_entity_ids", "supplier", lambda t: t.select("s_suppkey", names.entity_id(F.col("s_name"), F.col("s_nationkey").cast("string")).alias("entity_id")),
      "SELECT s_suppkey, 'PERSON_' || substr(sha256(lower(s_name) || '|' || CAST(s_nationkey AS VARCHAR)), 1, 8) || '_supplier_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS entity_id FROM supplier")
field("k7_folded_labels", "documents", lambda t: t.select("doc_id", names.fold(F.col("text")).alias("folded")).select("doc_id", F.length("folded").cast("long").alias("n"), F.substring("folded", 1, 30).alias("head")),
      "SELECT doc_id, length(f) AS n, substr(f, 1, 30) AS head FROM (SELECT doc_id, regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+', '', 'g') AS f FROM documents)")
field("k8_district_codes", "customer", lambda t: t.select("c_custkey", names.district_code(F.concat(F.lit('"0'), F.col("c_nationkey").cast("string"), F.lit('.0"'))).alias("code")), "SELECT c_custkey, CASE WHEN c_nationkey > 0 THEN CAST(c_nationkey AS VARCHAR) END AS code FROM customer")
field("k9_census_titles", "nation", lambda t: t.select("n_nationkey", names.census_title(F.concat(F.lit("Census "), (F.col("n_nationkey") + 2001).cast("string"), F.lit(" village amenities of "), F.col("n_name"), F.lit(", STATE_"), F.col("n_regionkey").cast("string"))).alias("c")).select("n_nationkey", "c.*"),
      "SELECT n_nationkey, CAST(n_nationkey + 2001 AS VARCHAR) AS year, n_name AS district, 'STATE_' || n_regionkey AS state FROM nation")
field("k10_split_codes", "customer", lambda t: t.select("c_custkey", names.school_code(F.lpad(F.col("c_custkey").cast("string"), 11, "1")).alias("s"), names.dashed_id(F.concat_ws("-", F.lit("11"), "c_nationkey", "c_custkey"), ("version", "state", "place")).alias("d")).select("c_custkey", "s.school", F.col("s.state").alias("code"), "d.state", "d.place"),
      "SELECT c_custkey, substr(lpad(CAST(c_custkey AS VARCHAR), 11, '1'), 7, 5) AS school, substr(lpad(CAST(c_custkey AS VARCHAR), 11, '1'), 1, 2) AS code, CAST(c_nationkey AS VARCHAR) AS state, CAST(c_custkey AS VARCHAR) AS place FROM customer")
field("k11_names_and_seats", "customer", lambda t: t.select("c_custkey", names.name_and_seat(F.concat(F.col("c_name"), F.when(F.col("c_nationkey") > 4, F.concat(F.lit(" ("), F.col("c_mktsegment"), F.lit(")"))).otherwise(""))).alias("n")).select("c_custkey", "n.*"),
      "SELECT c_custkey, c_name AS name, CASE WHEN c_nationkey > 4 THEN c_mktsegment END AS seat FROM customer")
field("k12_labelled_codes", "customer", lambda t: t.select("c_custkey", names.labelled_code(F.concat(F.col("c_mktsegment"), F.when(F.col("c_nationkey") > 4, F.concat(F.lit(" ("), F.col("c_nationkey").cast("string"), F.lit(")"))).otherwise(""))).alias("l")).select("c_custkey", "l.*"),
      "SELECT c_custkey, c_mktsegment AS label, CASE WHEN c_nationkey > 4 THEN CAST(c_nationkey AS VARCHAR) END AS code FROM customer")
field("k13_advert_numbers", "part", lambda t: t.select("p_partkey", names.advert_number(F.concat(F.lit("Advt. No. R/"), F.col("p_partkey").cast("string"), F.lit("-"), F.col("p_size").cast("string"), F.lit(". Apply"))).alias("number")), "SELECT p_partkey, 'R/' || p_partkey || '-' || p_size AS number FROM part")
field("k14_houses", "events", lambda t: t.groupBy(names.house_short(F.when(F.col("event_type") == "click", " Lok Sabha").when(F.col("event_type") == "view", "RAJYA SABHA").otherwise(F.upper("event_type"))).alias("house")).agg(F.count("*").alias("n")),
      "SELECT CASE event_type WHEN 'click' THEN 'LS' WHEN 'view' THEN 'RS' ELSE event_type END AS house, count(*) AS n FROM events GROUP BY 1")
field("k16_sessions", "orders", lambda t: t.select("o_orderkey", F.explode(names.sessions(F.concat_ws(",", F.month(D), F.concat_ws("-", F.month(D), F.month(D) + 2)))).alias("session")),
      "SELECT o_orderkey, CAST(unnest(generate_series(month(o_orderdate), month(o_orderdate) + 2)) AS INTEGER) AS session FROM orders")
field("k17_params", "events", lambda t: t.select("event_id", names.params(F.concat(F.lit("kind="), F.col("event_type"), F.lit(",user="), F.col("user_id").cast("string"))).alias("m")).select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["user"].cast("long").alias("user")),
      'SELECT event_id, event_type AS kind, user_id AS "user" FROM events')
field("c10_states", "customer", lambda t: t.where(names.state_key(F.concat(F.lit("0"), F.col("c_nationkey").cast("string"))) == "7").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_nationkey = 7")


def _ordinal(n):
    """A number below a thousand in words, as titles spell it."""
    words = F.array(*(F.lit(w) for w, _ in sorted(names.UNITS.items(), key=lambda x: x[1])))
    tens = F.array(F.lit(""), F.lit(""), *(F.lit(w) for w, _ in sorted(names.TENS.items(), key=lambda x: x[1])))
    low = F.when(n % 100 < 20, F.when(n % 100 > 0, F.get(words, n % 100)).otherwise("")).otherwise(F.concat_ws("-", F.get(tens, F.floor(n % 100 / 10).cast("int")), F.when(n % 10 > 0, F.get(words, n % 10))))
    return F.trim(F.concat(F.when(n >= 100, F.concat(F.get(words, F.floor(n / 100).cast("int")), F.lit(" hundred and "))).otherwise(""), low))


field("k5_number_words", "orders", lambda t: t.select("o_orderkey", names.words_to_int(_ordinal((F.col("o_orderkey") % 999 + 1).cast("int"))).alias("n")), "SELECT o_orderkey, CAST(o_orderkey % 999 + 1 AS INTEGER) AS n FROM orders")
field("k6_referenced_report", "orders", lambda t: t.select("o_orderkey", names.referenced_number(F.concat(F.lit("Action taken on "), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("recommendations contained in the "), _ordinal((F.col("o_orderkey") % 999 + 1).cast("int")), F.lit(" Report of the 9th Report"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Report No. "), (F.col("o_orderkey") % 999 + 1).cast("string"))).otherwise("nothing"))).alias("n")),
      "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderkey % 999 + 1 AS INTEGER) END AS n FROM orders")
field("d4_referenced_keys", "orders", lambda t: t.select("o_orderkey", names.referenced_key(F.when(F.col("o_orderstatus") == "P", "Lok Sabha").otherwise("RS"), F.when(F.col("o_custkey") % 2 == 0, F.lit(18)), F.col("o_orderpriority"), F.col("o_orderkey")).alias("key")),
      "SELECT o_orderkey, CASE WHEN o_orderstatus != 'P' THEN 'RS|' || o_orderpriority || '|' || o_orderkey WHEN o_custkey % 2 = 0 THEN 'LS|' || o_orderpriority || '|' || o_orderkey || '|18' END AS key FROM orders")

# ---- numbers ----
field("l3_number_or_text", "events", lambda t: t.select("event_id", numbers.number_or_text(F.when(F.col("user_id") % 3 == 0, F.col("value").cast("string")).when(F.col("user_id") % 3 == 1, F.col("event_type")).otherwise("N/A")).alias("x")).select("event_id", "x.*"),
      "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN value END AS number, CASE WHEN user_id % 3 = 1 THEN event_type END AS text FROM events")
field("l4_safe_int", "lineitem", lambda t: t.select("l_orderkey", "l_linenumber", "l_partkey", numbers.safe_int(F.when(F.col("l_returnflag") == "A", F.col("l_quantity").cast("string")).when(F.col("l_returnflag") == "N", F.col("l_tax").cast("string")).otherwise("a few")).alias("n")),
      "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) WHEN l_returnflag = 'N' AND l_tax = floor(l_tax) THEN CAST(l_tax AS BIGINT) END AS n FROM lineitem")
field("l5_halved", "lineitem", lambda t: t.select("l_orderkey", "l_linenumber", "l_partkey", numbers.halved(F.col("l_partkey"), F.lit(25)).alias("size")), "SELECT l_orderkey, l_linenumber, l_partkey, CAST(greatest(25, l_partkey // 50 * 25) AS BIGINT) AS size FROM lineitem")
field("l6_facility", "part", lambda t: t.select("p_partkey", numbers.facility(F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("double").cast("string")).otherwise(F.concat(F.col("p_name"), F.lit("("), F.col("p_size").cast("string"), F.lit(" km)")))).alias("f")).select("p_partkey", "f.*"),
      "SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS BIGINT) AS n, CASE WHEN p_size % 2 = 1 THEN p_name END AS place, CASE WHEN p_size % 2 = 1 THEN CAST(p_size AS DOUBLE) END AS km FROM part")
field("l7_availability", "part", lambda t: t.groupBy(numbers.availability(F.col("p_size") % 4).alias("status")).agg(F.count("*").alias("n")), "SELECT CASE p_size % 4 WHEN 1 THEN 'available' WHEN 2 THEN 'not_available' END AS status, count(*) AS n FROM part GROUP BY 1")
field("l8_counts_by_status", "part", lambda t: t.select("p_partkey", numbers.count_or_status(F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("long")), numbers.availability(F.col("p_size") % 4)).alias("n")),
      "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS BIGINT) WHEN p_size % 4 = 2 THEN 0 END AS n FROM part")
field("l9_padded_codes", "customer", lambda t: t.select("c_custkey", numbers.padded(numbers.padded(F.col("c_custkey"), 6), 6).alias("code")), "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code FROM customer")
field("l18_records", "lineitem", lambda t: t.select("l_orderkey", "l_linenumber", "l_partkey", numbers.records(F.array(F.lit("Line No."), F.lit(""), F.lit("Supplier Key")), F.array(F.array(F.col("l_linenumber").cast("string"), F.col("l_returnflag"), F.col("l_suppkey").cast("string")))).alias("r")).select("l_orderkey", "l_linenumber", "l_partkey", F.col("r")[0]["line_no"].alias("line"), F.col("r")[0]["c1"].alias("flag"), F.col("r")[0]["supplier_key"].alias("supplier")),
      "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_linenumber AS VARCHAR) AS line, l_returnflag AS flag, CAST(l_suppkey AS VARCHAR) AS supplier FROM lineitem")
field("l20_envelopes", "documents", lambda t: t.select("doc_id", numbers.envelope(F.encode(F.to_json(F.struct(F.base64(F.encode("text", "utf-8")).alias("data"))), "utf-8")).alias("body")).select("doc_id", F.sha2("body", 256).alias("sha")),
      "SELECT doc_id, sha256(text) AS sha FROM documents")
field("e17_declared_counts", "orders", lambda t: t.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("items")).select("o_custkey", numbers.declared_count(F.when(F.col("o_custkey") % 2 == 0, "7").otherwise("many"), F.col("items")).alias("n")),
      "SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 7 ELSE count(*) END AS n FROM orders GROUP BY 1")
field("e22_posts", "lineitem", lambda t: t.groupBy("l_orderkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("n")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("m")).select("l_orderkey", numbers.posts(F.col("m")).alias("posts")),
      "SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS posts FROM lineitem GROUP BY 1")

# ---- text ----
field("i1_clean", "documents", lambda t: t.select("doc_id", text.clean(F.concat(F.lit("12\n"), "text", F.lit(" (Para 3.1)\n\n\n\n 7 \n"))).alias("c")).select("doc_id", F.length("c").cast("long").alias("n")),
      r"""SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(chr(10) || '12' || chr(10) || text || ' (Para 3.1)' || repeat(chr(10), 4) || ' 7 ' || chr(10), '(?m)^[\s]*\d+\s*$', '', 'g'), '\(Para\s+\d+(?:\.\d+)*\)', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS n FROM documents""")  # fmt: skip
field("i3_subjects", "conversations", lambda t: t.select("conv_id", "turn", text.subject(F.concat(F.lit("ANSWERED ON 3.4.2020\n"), F.regexp_replace(F.substring("text", 1, 60), r"\s+", " "), F.lit("\n*12. SHRI A B:\nWill"))).alias("subject")),
      r"SELECT conv_id, turn, regexp_replace(regexp_replace(substr(text, 1, 60), '\s+', ' ', 'g'), '^ | $', '', 'g') AS subject FROM conversations")
field("i4_stems", "conversations", lambda t: t.select("conv_id", "turn", text.stem_and_body(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Will the Minister of X be pleased to state: "), F.lit("(a) why"), F.col("turn").cast("string"))).otherwise("no stem")).alias("s")).select("conv_id", "turn", "s.*"),
      "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Will the Minister of X be pleased to state:' ELSE '' END AS stem, CASE WHEN turn % 2 = 0 THEN '(a) why' || turn ELSE '' END AS body FROM conversations")
field("i5_ministers", "customer", lambda t: t.select("c_custkey", text.minister_and_body(F.concat(F.lit("THE MINISTER OF COAL (SHRI P "), F.col("c_custkey").cast("string"), F.lit("): the answer"))).alias("m")).select("c_custkey", "m.*"),
      "SELECT c_custkey, 'SHRI P ' || c_custkey AS minister, 'the answer' AS body FROM customer")
field("i8_answers", "conversations", lambda t: t.where(text.looks_like_answer(F.concat(F.when(F.col("role") == "assistant", "LOK SABHA\nANSWER\n").otherwise("LOK SABHA TO BE ANSWERED\n"), "text"), 120)).groupBy("role").agg(F.count("*").alias("n")),
      r"SELECT role, count(*) AS n FROM conversations WHERE length(regexp_replace('LOK SABHA' || chr(10) || CASE WHEN role = 'assistant' THEN 'ANSWER' || chr(10) ELSE 'TO BE ANSWERED' || chr(10) END || text, '\s+$', '')) >= 120 AND (role = 'assistant' OR regexp_matches(text, '(?i)\banswer(ed)?\b')) GROUP BY 1")
field("i9_dispatch", "orders", lambda t: t.groupBy(text.source_class(F.when(F.col("o_orderstatus") == "F", "qa").when(F.col("o_orderstatus") == "P", "committee_report").otherwise("bill"), F.when(F.col("o_custkey") % 2 == 0, "action_taken").when(F.col("o_custkey") % 3 == 0, "subject")).alias("class")).agg(F.count("*").alias("n")),
      "SELECT CASE WHEN o_orderstatus = 'F' THEN 'qa' WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN 'atr' WHEN o_orderstatus = 'P' THEN 'observations' ELSE 'skip' END AS class, count(*) AS n FROM orders GROUP BY 1")
field("i12_number_verdicts", "orders", lambda t: t.groupBy(text.number_verdict(F.concat(F.lit("00"), F.col("o_orderkey").cast("string")), F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderkey").cast("string")).when(F.col("o_custkey") % 3 == 1, F.concat(F.lit("9"), F.col("o_orderkey").cast("string")))).alias("verdict")).agg(F.count("*").alias("n")),
      "SELECT CASE o_custkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'mismatch' ELSE 'unreadable' END AS verdict, count(*) AS n FROM orders GROUP BY 1")
field("i15_presented", "orders", lambda t: t.groupBy(text.presented(F.when(F.col("o_custkey") % 2 == 0, "x"), F.when(F.col("o_custkey") % 3 == 0, "y"), F.when(F.col("o_custkey") % 5 == 0, "z").otherwise(" ")).alias("via")).agg(F.count("*").alias("n")),
      "SELECT CASE WHEN o_custkey % 6 = 0 THEN 'both_houses' WHEN o_custkey % 2 = 0 THEN 'ls_only' WHEN o_custkey % 3 = 0 THEN 'rs_only' WHEN o_custkey % 5 = 0 THEN 'speaker_only' ELSE 'none' END AS via, count(*) AS n FROM orders GROUP BY 1")
field("i16_vacancy_gate", "documents", lambda t: t.where(F.concat("text", F.when(F.col("doc_id") % 4 == 0, " posts lying vacant").when(F.col("doc_id") % 4 == 1, " Sanctioned  strength").otherwise("")).rlike(text.VACANCY)).select("doc_id"),
      r"SELECT doc_id FROM documents WHERE doc_id % 4 < 2 OR regexp_matches(text, '(?i)vacan|sanctioned\s+(strength|posts?)|backlog')")
field("i18_vacant", "lineitem", lambda t: t.select("l_orderkey", "l_linenumber", "l_partkey", text.vacancy_counts(F.col("l_suppkey"), F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")), F.when(F.col("l_returnflag") == "A", F.col("l_quantity").cast("long"))).alias("v")).select("l_orderkey", "l_linenumber", "l_partkey", "v.*"),
      "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) WHEN l_returnflag = 'N' THEN l_suppkey - l_linenumber END AS vacant, l_returnflag = 'A' AS vacant_stated FROM lineitem")
field("i25_stated_totals", "customer", lambda t: t.select("c_custkey", F.concat(F.lit("Total number of Questions -- "), F.col("c_custkey").cast("string"), F.when(F.col("c_nationkey") == 3, "\nCORRIGENDUM").otherwise("")).alias("x")).select("c_custkey", text.stated_totals(F.col("x"))[0].alias("total"), text.is_corrigendum(F.col("x")).alias("corrigendum")),
      "SELECT c_custkey, CAST(c_custkey AS INTEGER) AS total, c_nationkey = 3 AS corrigendum FROM customer")
field("i33_post_types", "part", lambda t: t.groupBy(text.post_type(F.concat(F.when(F.col("p_size") % 5 == 0, "Assistant Professor ").when(F.col("p_size") % 5 == 1, "JRF ").when(F.col("p_size") % 5 == 2, "Post-doctoral ").when(F.col("p_size") % 5 == 3, "Technician ").otherwise(""), "p_name")).alias("type")).agg(F.count("*").alias("n")),
      "SELECT CASE p_size % 5 WHEN 0 THEN 'Faculty' WHEN 1 THEN 'Scientific' WHEN 2 THEN 'Postdoc' WHEN 3 THEN 'NonFaculty' ELSE 'Unknown' END AS type, count(*) AS n FROM part GROUP BY 1")
field("i34_contracts", "part", lambda t: t.groupBy(text.contract_status(F.concat("p_name", F.when(F.col("p_size") % 4 == 0, " on contract basis").when(F.col("p_size") % 4 == 1, " ad-hoc, regular later").when(F.col("p_size") % 4 == 2, " Permanent").otherwise(""))).alias("status")).agg(F.count("*").alias("n")),
      "SELECT CASE p_size % 4 WHEN 0 THEN 'Contractual' WHEN 1 THEN 'AdHoc' WHEN 2 THEN 'Regular' ELSE 'Unknown' END AS status, count(*) AS n FROM part GROUP BY 1")
field("i35_departments", "part", lambda t: t.select("p_partkey", text.department(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Dept. of "), "p_name", F.lit(", IIT X"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("Faculty positions in "), "p_name", F.lit(" - rolling"))).otherwise(F.col("p_name"))).alias("department")),
      "SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN p_name END AS department FROM part")
field("i36_publications", "part", lambda t: t.select("p_partkey", text.publications(F.concat(F.lit("A minimum of "), F.col("p_size").cast("string"), F.lit(" papers in  refereed journals."))).alias("said")), "SELECT p_partkey, 'minimum of ' || p_size || ' papers in refereed journals.' AS said FROM part")
field("i37_reservations", "part", lambda t: t.select("p_partkey", text.reservation_note(F.concat(F.lit("with SC- "), F.col("p_size").cast("string"), F.lit("% and ST 7%."))).alias("note")), "SELECT p_partkey, 'SC- ' || p_size || '% and ST 7%' AS note FROM part")
field("i38_pagination", "documents", lambda t: t.select("doc_id", text.without_pagination(F.concat(F.lit("Page 3 of 9\n"), "text", F.lit("\n - 4 - "))).alias("x")).select("doc_id", F.sha2("x", 256).alias("sha")), r"SELECT doc_id, sha256(chr(10) || regexp_replace(text, '(?m)^[ \t]*-+[ \t]*\d+[ \t]*-+[ \t]*$', '', 'g') || chr(10)) AS sha FROM documents")
field("i39_ligatures", "documents", lambda t: t.where(F.replace("text", F.lit("ti"), F.lit(" ")).rlike(text.tolerant("retition"))).groupBy("lang").agg(F.count("*").alias("n")), "SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(replace(text, 'ti', ' '), '(?i)re(ti|\\s)(ti|\\s)on') GROUP BY 1")
field("i41_volumes", "part", lambda t: t.groupBy(text.volume(F.concat(F.lit("Report vol-"), F.when(F.col("p_size") % 3 == 0, "II").when(F.col("p_size") % 3 == 1, "1").otherwise("x"))).alias("volume"), text.is_amendment(F.concat(F.lit("The Act "), F.when(F.col("p_size") % 2 == 0, "(Amendment)").otherwise(""))).alias("amends")).agg(F.count("*").alias("n")),
      "SELECT CASE p_size % 3 WHEN 0 THEN 'II' WHEN 1 THEN 'I' END AS volume, p_size % 2 = 0 AS amends, count(*) AS n FROM part GROUP BY 1, 2")
field("i42_challenges", "events", lambda t: t.groupBy(text.challenge(F.when(F.col("user_id") % 2 == 0, 202).otherwise(500), F.create_map(F.when(F.col("event_type") == "error", "X-Mitigated-By").otherwise("server"), F.lit("y")), F.when(F.col("user_id") % 3 == 0, "").otherwise("body")).alias("why")).agg(F.count("*").alias("n")),
      "SELECT CASE WHEN event_type = 'error' THEN 'challenge_header' WHEN user_id % 6 = 0 THEN 'empty_body' END AS why, count(*) AS n FROM events GROUP BY 1")
field("i43_geo_fences", "events", lambda t: t.where(text.geo_fenced(F.concat(F.lit("error: "), F.when(F.col("event_type") == "error", "getaddrinfo failed").otherwise(F.col("event_type"))))).select("event_id"), "SELECT event_id FROM events WHERE event_type = 'error'")
field("n10_digits", "customer", lambda t: t.select("c_custkey", text.transliterate_digits(F.translate(F.col("c_name"), "0123456789", "".join(chr(0x0AE6 + i) for i in range(10)))).alias("name")), "SELECT c_custkey, c_name AS name FROM customer")
field("n14_queries", "events", lambda t: t.groupBy("event_type").agg(F.to_date(F.min("ts")).cast("string").alias("a"), F.to_date(F.max("ts")).cast("string").alias("b")).select("event_type", text.question_query(F.col("event_type"), F.array(F.lit("x"), F.lit("y")), F.col("a"), F.col("b"), F.lit("date")).alias("q")),
      "SELECT event_type, event_type || ' doctypes: x,y fromdate: ' || CAST(min(ts) AS DATE) || ' todate: ' || CAST(max(ts) AS DATE) || ' sortby: date' AS q FROM events GROUP BY 1")

# ---- web ----
field("m3_frameworks", "pages", lambda t: t.select("page_id", web.frameworks(F.concat("html", F.when(F.col("page_id") % 2 == 0, '<div id="__next">').otherwise(""), F.when(F.col("page_id") % 3 == 0, "<app-root>").otherwise(""))).alias("f")).select("page_id", F.array_join("f", ",").alias("frameworks")),
      "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'Next.js,Angular' WHEN page_id % 2 = 0 THEN 'Next.js' WHEN page_id % 3 = 0 THEN 'Angular' ELSE '' END AS frameworks FROM pages")
field("i40_shells", "pages", lambda t: t.groupBy(web.rendered(F.col("html"), F.when(F.col("page_id") % 3 == 0, "short").otherwise(F.repeat(F.lit("long text "), 50)), 400, ("TEXT",) )["reason"].alias("reason")).agg(F.count("*").alias("n")),
      "SELECT CASE WHEN page_id % 3 = 0 THEN 'required' ELSE 'content' END AS reason, count(*) AS n FROM pages GROUP BY 1")
field("m6_browse_rows", "customer", lambda t: t.select("c_custkey", F.explode(web.browse_rows(F.concat(F.lit('<a href="/handle/1/'), F.col("c_custkey").cast("string"), F.lit('"> <b>'), "c_name", F.lit('</b></a><a href="/handle/1/'), F.col("c_custkey").cast("string"), F.lit('">again</a>')))).alias("r")).select("c_custkey", "r.handle", "r.title"),
      "SELECT c_custkey, '/handle/1/' || c_custkey AS handle, c_name AS title FROM customer")
field("m14_order_rows", "customer", lambda t: t.select("c_custkey", F.explode(web.order_rows(F.concat(F.lit("<a onclick=\"downloadFile('"), F.col("c_custkey").cast("string"), F.lit("', 'pdf')\">x</a> downloadFile("), F.col("c_custkey").cast("string"), F.lit(",pdf)")))).alias("r")).select("c_custkey", "r.*"),
      "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS gid, 'pdf' AS type FROM customer")
field("m22_metadata", "customer", lambda t: t.select("c_custkey", web.metadata(F.concat(F.lit('<meta name="DC.title" content="'), "c_name", F.lit('"><meta name="DC.title" content="x"><meta name="seg" content="'), "c_mktsegment", F.lit('">'))).alias("m")).select("c_custkey", F.col("m")["DC.title"].alias("title"), F.col("m")["seg"].alias("segment")),
      "SELECT c_custkey, c_name AS title, c_mktsegment AS segment FROM customer")
field("m23_cell_links", "pages", lambda t: t.select("page_id", web.cell_href(F.col("html")).alias("href")), "SELECT page_id, nullif(regexp_extract(html, '(?i)href=[\"'']([^\"'']+)[\"'']', 1), '') AS href FROM pages")
field("n3_destinations", "customer", lambda t: t.select("c_custkey", web.destination(F.concat(F.lit("https://x.org/a b/"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_custkey").cast("string"), F.lit(".pdf"))).otherwise("../"))).alias("path")),
      "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a_b/' || c_custkey || '.pdf' ELSE 'a_b/index.html' END AS path FROM customer")
field("n4_segments", "customer", lambda t: t.select("c_custkey", web.safe_segment(F.concat(F.lit(".. "), "c_name", F.lit("#?")), collapse=True).alias("segment")), f"SELECT c_custkey, '_Customer_' || {NUMBER} AS segment FROM customer")
field("n6_magic", "documents", lambda t: t.groupBy(web.magic(F.encode(F.concat(F.when(F.col("doc_id") % 3 == 0, "%PDF-1.4").when(F.col("doc_id") % 3 == 1, "PK\x03\x04").otherwise(""), "text", F.when(F.col("doc_id") % 2 == 0, "%%EOF").otherwise("")), "utf-8")).alias("kind")).agg(F.count("*").alias("n")),
      "SELECT CASE WHEN doc_id % 6 = 0 THEN 'pdf' WHEN doc_id % 3 = 0 THEN 'truncated_pdf' WHEN doc_id % 3 = 1 THEN 'zip' ELSE 'unknown' END AS kind, count(*) AS n FROM documents GROUP BY 1")
field("n13_unit_keys", "customer", lambda t: t.select("c_custkey", web.unit_key("c_custkey", F.col("c_custkey").cast("string").alias("text")).alias("key")), "SELECT c_custkey, '{\"c_custkey\":' || c_custkey || ',\"text\":\"' || c_custkey || '\"}' AS key FROM customer")
field("n11_public_urls", "pages", lambda t: t.select("page_id", web.public_url(F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), F.lit("?token=abc&page="), F.col("page_id").cast("string"))).alias("url")), "SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || '?page=' || page_id AS url FROM pages")
field("c14_redacted", "events", lambda t: t.select("event_id", web.redact(F.create_map(F.lit("api_KEY"), "event_type", F.lit("page"), "event_type")).alias("m")).select("event_id", F.col("m")["api_KEY"].alias("secret"), F.col("m")["page"].alias("page")), "SELECT event_id, '[redacted]' AS secret, event_type AS page FROM events")
