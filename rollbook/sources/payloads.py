"""Rows of captured responses: what adapters make of the bodies they were given. The requests
themselves are planned here as data; nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import dates, names, numbers


def _json(body, schema: str) -> Column:
    return F.from_json(body, schema)


def bucket_plan(groups: DataFrame, ministries: DataFrame) -> DataFrame:
    """(group, query, ministry) of every request. Both sides are a profile's own short lists."""
    return groups.crossJoin(F.broadcast(ministries))


def month_plan(houses: DataFrame) -> DataFrame:
    """houses: house, low, high -> house, from_date, to_date, window_id of every month window."""
    w = houses.select("house", F.explode(dates.month_windows(F.col("low"), F.col("high"))).alias("w"))
    return w.select("house", F.col("w.start").alias("from_date"), F.col("w.end").alias("to_date"), F.concat_ws("|", "house", F.date_format("w.start", "yyyy-MM-dd"), F.date_format("w.end", "yyyy-MM-dd")).alias("window_id"))


def payload_urls(plan: DataFrame, template: str, *columns: str) -> DataFrame:
    return plan.withColumn("url", F.format_string(template, *columns))


def session_catalogue(sessions: DataFrame) -> DataFrame:
    """house, loksabha, session, periods, dates -> one shape for both houses, sittings sorted."""
    days = F.array_sort(F.filter(F.transform("dates", lambda d: dates.first_of(d, "yyyy-MM-dd", "dd-MMM-yyyy", "dd/MM/yyyy")), lambda d: d.isNotNull()))
    return sessions.select("house", "loksabha", "session", F.coalesce("periods", F.array().cast("array<string>")).alias("periods"), F.size(days).alias("sittings"), F.array_min(days).alias("first_sitting"), F.array_max(days).alias("last_sitting"), days.alias("sitting_dates"))


def captures(rows: DataFrame, body: str = "body") -> DataFrame:
    """url, timestamp, captured_at, http_status, digest, media_type, length, key of an index answer:
    an array of arrays whose first row names the columns and whose last may be a resume mark."""
    table = _json(F.col(body), "array<array<string>>")
    header = F.get(table, F.lit(0))
    data = F.filter(F.slice(table, 2, F.greatest(F.size(table), F.lit(1))), lambda r: F.size(r) == F.size(header))
    one = rows.select(F.explode(F.transform(data, lambda r: F.map_from_arrays(header, r))).alias("c"))
    cell = lambda k: F.nullif(F.try_element_at("c", F.lit(k)), F.lit(""))
    stamp, url = F.coalesce(cell("timestamp"), F.lit("")), F.coalesce(cell("original"), F.lit(""))
    return one.select(F.concat_ws("|", F.lit("WAYBACK"), url, stamp).alias("key"), url.alias("url"), stamp.alias("timestamp"), dates.archive_stamp(stamp).alias("captured_at"), cell("statuscode").alias("http_status"), cell("digest").alias("digest"), cell("mimetype").alias("media_type"), cell("length").try_cast("long").alias("length"))


def study_search(rows: DataFrame, body: str = "body") -> DataFrame:
    """found, and idno, title, year of the studies of a search answer; numbers come as texts."""
    answer = _json(F.col(body), "result struct<found:string, total:string, limit:string, offset:string, rows:array<struct<id:string, idno:string, title:string, nation:string, year_start:string, year_end:string>>>")
    one = rows.select(answer.alias("a")).select(F.col("a.result.found").try_cast("long").alias("found"), F.explode("a.result.rows").alias("r"))
    return one.select("found", "r.idno", "r.title", "r.nation", F.col("r.year_start").try_cast("int").alias("year_start"), F.col("r.year_end").try_cast("int").alias("year_end"))


def bills(rows: DataFrame, body: str = "body") -> DataFrame:
    """key, house, bill_no, bill_year, title, status, introduced_date, unreadable, fingerprint. The
    fingerprint is over what the source asserts, not when it was fetched."""
    from rollbook.functions.web import fingerprint

    raw = _json(F.col(body), "array<struct<billNumber:string, billYear:string, billName:string, billType:string, status:string, billIntroducedDate:string>>")
    one = rows.select("house", F.explode(raw).alias("b"))
    number = F.nullif(F.col("b.billNumber"), F.lit(""))
    key = F.when(number.isNotNull(), F.concat_ws("|", F.lit("BILL"), "house", F.coalesce("b.billYear", F.lit("NA")), number)).otherwise(F.concat_ws("|", F.lit("BILL"), "house", F.substring(F.sha1(F.to_json("b")), 1, 12)))
    day = dates.bill_date("b.billIntroducedDate")
    out = one.select(key.alias("key"), "house", number.alias("bill_no"), F.col("b.billYear").alias("bill_year"), F.col("b.billName").alias("title"), F.col("b.status").alias("status"), day["day"].alias("introduced_date"), day["unreadable"].alias("unreadable"))
    return out.withColumn("fingerprint", fingerprint("bill_no", "bill_year", "introduced_date", "status", "title"))


def member_track(rows: DataFrame) -> DataFrame:
    """Columns of either house under one set of names; counts as number and text."""
    renames = {"MP name": "name", "Member": "name", "State": "state", "Political party": "party", "Party": "party", "Questions": "questions", "No. of questions": "questions", "Attendance": "attendance"}
    out = rows.withColumnsRenamed({k: v for k, v in renames.items() if k in rows.columns})
    for c in ("questions", "attendance"):
        if c in out.columns:
            pair = numbers.number_or_text(F.col(c))
            out = out.withColumn(f"{c}_text", pair["text"]).withColumn(c, pair["number"])
    return out


def spend(rows: DataFrame) -> DataFrame:
    """company, financial_year, psu_status, state, sector, sub_sector, amount of disclosure rows; an
    amount that is no number counts as zero, as the reports themselves do."""
    cell = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    return rows.select(
        cell("Company Name").alias("company"), cell("Financial Year").alias("financial_year"), cell("PSU/Non-PSU").alias("psu_status"), cell("CSR State").alias("state"), cell("CSR Development Sector").alias("sector"),
        cell("CSR Sub Development Sector").alias("sub_sector"), F.coalesce(cell("Project Amount Spent (In INR Cr.)").try_cast("double"), F.lit(0.0)).alias("amount"),
    )


def spend_by_company(rows: DataFrame) -> DataFrame:
    return rows.where("company != ''").groupBy("company", "financial_year").agg(F.sum(F.col("amount").cast("decimal(20,4)")).cast("double").alias("amount"))


# ---- dashboards: blocks of districts of rows, flattened to (district, field, value) ----

_ROW = "title:string, title1:string, title2:string, count:string, percent:string, percentage:string"


def _rows(payloads: DataFrame, wrapper: str, data: str = "data", row: str = f"struct<{_ROW}>") -> DataFrame:
    blocks = _json(F.col("body"), f"{wrapper} array<struct<districts:array<struct<district:string, {data}:array<{row}>>>>>")[wrapper]
    keep = [c for c in payloads.columns if c != "body"]
    one = payloads.select(*keep, F.explode(blocks).alias("b")).select(*keep, F.explode("b.districts").alias("d"))
    return one.select(*keep, F.col("d.district").alias("district"), F.explode(F.col(f"d.{data}")).alias("r"))


def _keyed(rows: DataFrame, **fields: Column) -> DataFrame:
    keep = [c for c in rows.columns if c != "r"]
    return rows.select(*keep, *(v.alias(k) for k, v in fields.items())).where("field IS NOT NULL AND field != ''")


def _underscored(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(label), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


#: The titles of the registration block, and their fields.
REGISTRATION = {
    "Anganwadi Centers": "anganwadi_centres", "Anganwadi Workers": "anganwadi_workers", "Anganwadi Helpers": "anganwadi_helpers", "Project": "projects",
    "Sector": "sectors", "Eligible Beneficiaries": "eligible_beneficiaries", "Adolescent Girl": "adolescent_girls",
}


def registration(payloads: DataFrame) -> DataFrame:
    fields = F.create_map(*(F.lit(x) for pair in REGISTRATION.items() for x in pair))
    return _keyed(_rows(payloads, "registrationPTdata"), field=F.try_element_at(fields, F.col("r.title")), value=F.col("r.count").try_cast("double"))


def growth(payloads: DataFrame) -> DataFrame:
    """The age band is part of the field: titles repeat."""
    rows = _rows(payloads, "growthmonitoring")
    title = F.replace(F.lower(F.coalesce("r.title", F.lit(""))), F.lit(" "), F.lit("_"))
    band = F.coalesce(F.nullif(F.col("r.title2"), F.lit("")), F.when(F.contains("r.title1", F.lit("6 Years")), "0m_6y").otherwise("0m_5y"))
    some = F.array_compact(F.array(
        F.when(F.col("r.percent").isNotNull(), F.struct(F.concat_ws("_", title, F.lit("pct"), band).alias("field"), F.col("r.percent").try_cast("double").alias("value"))),
        F.when(F.col("r.count").isNotNull(), F.struct(F.concat_ws("_", F.lit("children_measured"), band).alias("field"), F.col("r.count").try_cast("double").alias("value"))),
        F.when(F.col("r.count").isNotNull(), F.struct(F.concat_ws("_", F.lit("children_measured_pct"), band).alias("field"), F.coalesce(F.col("r.percentage").try_cast("double"), F.lit(0.0)).alias("value"))),
    ))
    keep = [c for c in rows.columns if c != "r"]
    return rows.select(*keep, F.explode(some).alias("x")).select(*keep, "x.field", "x.value")


def titled(payloads: DataFrame, wrapper: str) -> DataFrame:
    """title -> count: infrastructure (awcInfrastructureCount), centres (AnganwadiCenterCount)."""
    return _keyed(_rows(payloads, wrapper), field=F.col("r.title"), value=F.col("r.count").try_cast("double"))


def home_visits(payloads: DataFrame) -> DataFrame:
    """The full label is the key: definitions change in its second part."""
    label = F.trim(F.concat_ws(" ", F.coalesce("r.title", F.lit("")), F.coalesce("r.title1", F.lit(""))))
    return _keyed(_rows(payloads, "homevisit"), field=F.concat(F.lit("home_visit_"), _underscored(label)), value=F.col("r.count").try_cast("double"))


def key_services(payloads: DataFrame) -> DataFrame:
    """Shares belong to the threshold of their own row, whose days end their field."""
    rows = _rows(payloads, "keyservices", row="map<string,string>")
    threshold = F.get(F.array_sort(F.filter(F.map_keys("r"), lambda k: k.startswith("snp_Given"))), F.lit(0))
    days = F.regexp_replace(threshold, r"\D", "")
    field = F.when(threshold.isNull(), F.when(~F.col("k").startswith("_"), F.col("k"))).when(F.col("k") == threshold, F.concat(F.lit("snp_given_"), days, F.lit("d"))).when(F.col("k").isin("thr_per", "hcm_per"), F.concat_ws("_", "k", F.concat(days, F.lit("d"))))
    keep = [c for c in rows.columns if c != "r"]
    return rows.select(*keep, "r", F.explode("r").alias("k", "v")).select(*keep, field.alias("field"), F.col("v").try_cast("double").alias("value")).where("field IS NOT NULL")


def beneficiaries(payloads: DataFrame) -> DataFrame:
    """Categories by their full label, and linkage counts and shares by title."""
    label = F.trim(F.concat_ws(" ", F.coalesce("r.title", F.lit("")), F.coalesce("r.title1", F.lit(""))))
    key = F.regexp_replace(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]", "_"), r"^_+|_+$", "")
    active = _keyed(_rows(payloads, "monthWiseActiveBeneficiaries", "activeBeneficiaries"), field=F.concat(F.lit("beneficiaries_"), key), value=F.col("r.count").try_cast("double"))
    linked = _rows(payloads, "monthWiseActiveBeneficiaries", "aadharHealthData")
    name = F.replace(F.lower(F.coalesce("r.title", F.lit(""))), F.lit(" "), F.lit("_"))
    counts = _keyed(linked, field=F.concat(name, F.lit("_count")), value=F.col("r.count").try_cast("double"))
    shares = _keyed(linked, field=F.concat(name, F.lit("_pct")), value=F.col("r.percent").try_cast("double"))
    return active.unionByName(counts).unionByName(shares)


def town_rows(cells: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Facility cells of a town sheet: for each field its count, nearest place and distance."""
    out = cells
    for field, column in fields.items():
        cell = numbers.facility(F.col(column))
        out = out.withColumn(field, cell["n"]).withColumn(f"{field}_place", cell["place"]).withColumn(f"{field}_km", cell["km"])
    return out


def committee_members(rows: DataFrame) -> DataFrame:
    """One row for each member of a committee's composition, with the normal form of the name."""
    one = rows.select("house", "committee_slug", F.posexplode("members").alias("position", "m"))
    return one.select("house", "committee_slug", "position", F.col("m.name").alias("name"), F.col("m.role").alias("role"), names.normal_person(F.col("m.name")).alias("name_key"))


def in_box(geometry: Column, west: float, south: float, east: float, north: float) -> Column:
    """struct(type, points array<array<double>>) within a box: unknown for other geometries."""
    inside = lambda p: p[0].between(west, east) & p[1].between(south, north)
    placed = geometry["type"].isin("Point", "MultiPoint") & (F.size(geometry["points"]) > 0)
    return F.when(placed, F.exists(geometry["points"], inside))


def tiles(boxes: DataFrame) -> DataFrame:
    """The four quarters of each box (west, south, east, north, capped) that was capped."""
    x, y = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    quarter = lambda w, s, e, n: F.struct(w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))
    west, south, east, north = (F.col(c) for c in ("west", "south", "east", "north"))
    four = F.array(quarter(west, south, x, y), quarter(x, south, east, y), quarter(west, y, x, north), quarter(x, y, east, north))
    return boxes.where("capped").select(F.explode(four).alias("t")).select("t.*")
