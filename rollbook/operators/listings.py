"""Listing pages: grids, documents with a year, recruitment links. Built on the parsed links and
tables of `pages`; what follows is DataFrame work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.operators import pages
from rollbook.operators.relational import first_row

# What listings call demands, years, languages, advertisements and plain links.
DEMAND = r"(?i)demand|grant|मां?ग|अनुदान"
DEMAND_FILE = r"(?i)ddg"
YEAR = r"(20\d{2})\s*[-_– ]?\s*(?:20)?(\d{2})"
REPORT_YEAR = r"(20\d{2})\s*[-–_]\s*(?:20)?(\d{2})"
DASHED_YEAR = r"(20\d{2})\s*[-–]\s*(?:20)?(\d{2})"
LANGUAGE = r"(?i)(?<![a-z])(english|hindi)(?![a-z])"
RECRUITMENT = r"(?i)\b(advertisement|advt|recruitment|vacancy|position|opening|job|jobs|fellow|jrf|srf|post[- ]?doctoral|research\s+associate|project\s+scientist|professor|faculty\s+recruitment)\b"
NAVIGATION = (
    r"(?i)^\s*(home|about|about us|academics?|admissions?|programs?|departments?|calendars?|career(s)?|donate(\s+to\s+\w+)?|visit\s+\w+|search|faculty|staff|students?|directory|registrar|director"
    r"|apply\s+now|office\s+of\s+.*|centre\s+for\s+continuing\s+education)\s*$"
)
JOB_URL = r"(?i)/(career|careers|jobs?)/(staff/)?[^/]*\.(pdf|docx?)$|/(career|careers|jobs?)/jobs?/\d+"
GENERIC = ("view", "click here", "click", "download", "pdf", "read more", "view advertisement", "here", "download advertisement pdf", "download pdf", "apply here", "apply now", "apply")


def absolute(base, href) -> Column:
    """A link against the page it stands on."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(://[^/]*)?/?[^/]*$", "$1")
    folder = F.when(F.regexp_replace(base, r"[?#].*$", "").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$"), root).otherwise(folder)
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, F.lit("/"), F.regexp_replace(href, r"^(\./)+", "")))


def _following(text, pattern: str) -> Column:
    """The first two years, digits of no longer number, of which the second follows the first; a
    year may be the second of one pair and the first of the next."""
    pairs = F.regexp_extract_all(text, F.lit(rf"(?<!\d)(?=({pattern}(?!\d)))20"), F.lit(1))
    short = F.transform(pairs, lambda x: F.concat_ws("-", F.substring(x, 1, 4), F.right(x, F.lit(2))))
    return F.get(F.filter(short, lambda x: (F.substring(x, 3, 2).cast("int") + 1) % 100 == F.right(x, F.lit(2)).cast("int")), 0)


def _year(*texts, pattern: str = YEAR) -> Column:
    """Of the first text that has one: a financial year with a dash, else one of the pattern, else
    whatever fits the pattern first. An address may hold other numbers before the year: in
    2012_2021-22 the first to fit the pattern would be 2012-21."""
    first = lambda t: F.when(t.rlike(pattern), F.concat_ws("-", F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)))
    return F.coalesce(*(x for t in texts for x in (_following(t, DASHED_YEAR), _following(t, pattern), first(t))))


def _linked(rows: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, link_no, url (absolute), label of every link."""
    found = pages.links(rows, key, html).join(rows.select(key, F.col(url).alias("_base")), key)
    return found.withColumn("url", absolute(F.col("_base"), F.trim("href"))).drop("_base")


def demand_documents(rows: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """title, year, url of PDF links that speak of demands or grants, in their text or the file's
    name; the first of a URL counts, one without a year is left out."""
    found = _linked(rows, key, url, html).where(F.col("href").rlike(r"(?i)\.pdf$"))
    file = F.try_url_decode(F.regexp_extract("url", r"([^/]*)$", 1))
    found = found.where(F.col("label").rlike(DEMAND) | file.rlike(DEMAND_FILE)).withColumn("year", _year(F.col("label"), F.try_url_decode("url"))).where("year IS NOT NULL")
    return first_row(found, [key, "url"], ["link_no"]).select(key, F.col("label").alias("title"), "year", "url")


def annual_reports(rows: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """year, language, filename, url of PDF links whose file name carries a year."""
    found = _linked(rows, key, url, html).where(F.col("href").rlike(r"(?i)\.pdf$"))
    file = F.regexp_extract(F.try_url_decode(F.regexp_replace("url", r"[?#].*$", "")), r"([^/]*)$", 1)
    found = found.withColumn("filename", file).withColumn("year", _year(F.col("filename"), pattern=REPORT_YEAR)).where("year IS NOT NULL")
    language = F.coalesce(F.nullif(F.lower(F.regexp_extract("filename", LANGUAGE, 1)), F.lit("")), F.lit("english"))
    return first_row(found, [key, "url"], ["link_no"]).select(key, "year", language.alias("language"), "filename", "url")


def recruitment_links(rows: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """url, title, generic of links to advertisements: no navigation, a word of recruitment in the
    text or address; the first of a URL counts."""
    found = _linked(rows, key, url, html).where("label != '' AND href NOT LIKE '#%' AND lower(href) NOT LIKE 'javascript:%'")
    said = F.concat_ws(" ", "label", "href")
    found = found.where(~F.col("label").rlike(NAVIGATION) & (said.rlike(RECRUITMENT) | F.col("href").rlike(JOB_URL)))
    return first_row(found, [key, "url"], ["link_no"]).select(key, "url", F.col("label").alias("title"), F.lower("label").isin(*GENERIC).alias("generic"))


def grid_rows(rows: DataFrame, key: str, html: str, header: str = "sl") -> DataFrame:
    """row_no, header, cells of the grid of a page: rows as wide as most are, under the first of
    them that begins with `header`, whose first cell is a serial number. A page without such a
    header gives one row with an error instead."""
    cells = pages.tables(rows, key, html).withColumn("width", F.size("cells"))
    widths = cells.where("width > 2").groupBy(key, "width").agg(F.count("*").alias("n"))
    modal = widths.groupBy(key).agg(F.max(F.struct("n", "width")).alias("m")).select(key, F.col("m.width").alias("width"))
    wide = cells.join(modal, [key, "width"])
    at = F.struct("table_no", "row_no")
    head = wide.where(F.lower(F.trim(F.col("cells")[0])).startswith(header)).groupBy(key).agg(F.min_by("cells", at).alias("header"))
    data = wide.where(F.trim(F.col("cells")[0]).rlike(r"^\d+\.?$")).select(key, "table_no", "row_no", "cells")
    out = modal.join(head, key, "left").join(data, key, "left")
    error = F.when(F.col("header").isNull(), "no header row")
    out = out.select(key, F.when(error.isNull(), F.struct("table_no", "row_no")).alias("at"), "header", F.when(error.isNull(), F.col("cells")).alias("cells"), error.alias("error"))
    w = Window.partitionBy(key).orderBy("at")
    return out.where("error IS NOT NULL OR cells IS NOT NULL").withColumn("row_no", F.row_number().over(w) - 1).where("error IS NULL OR row_no = 0").drop("at")


def statute_availability(acts: DataFrame, states: DataFrame) -> DataFrame:
    """states: state; acts: state, description -> absent, principal_present or amendment_only."""
    principal = ~F.coalesce("description", F.lit("")).rlike(r"(?i)\bamendment\b")
    found = acts.groupBy("state").agg(F.bool_or(principal).alias("principal"))
    verdict = F.when(F.col("principal").isNull(), "absent").when(F.col("principal"), "principal_present").otherwise("amendment_only")
    return states.join(found, "state", "left").select("state", verdict.alias("availability"))


def preset_tables(tables: DataFrame, patterns: DataFrame) -> DataFrame:
    """tables: name; patterns: position, pattern -> each table once, by the first pattern that
    matches it, in order; a pattern that matches nothing is an error row. Both are catalogues."""
    hits = patterns.join(F.broadcast(tables), F.expr("name RLIKE pattern"), "left")
    once = hits.where("name IS NOT NULL").groupBy("name").agg(F.min("position").alias("position")).select("position", "name", F.lit(None).cast("string").alias("error"))
    none = hits.where("name IS NULL").select("position", F.lit(None).cast("string").alias("name"), F.concat(F.lit("no table matches "), "pattern").alias("error"))
    return once.unionByName(none)


def settled_documents(prior: DataFrame, files: DataFrame, retry_failed: bool = False) -> DataFrame:
    """prior: key, field, url, status, path; files: path -> settled: ok and its file is there, or
    failed and no retry was asked for."""
    there = files.select(F.col("path"), F.lit(True).alias("_there")).distinct()
    out = prior.join(there, "path", "left")
    ok = (F.col("status") == "ok") & F.coalesce("_there", F.lit(False))
    return out.withColumn("settled", ok | ((F.col("status") == "failed") & F.lit(not retry_failed))).drop("_there")
