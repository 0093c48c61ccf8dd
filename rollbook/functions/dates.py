"""Dates as records spell them. What cannot be read is null or flagged, never cut short."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH = "dd-MMM-yyyy"


def _text(value) -> Column:
    return F.trim(value.cast("string") if isinstance(value, Column) else F.col(value).cast("string"))


def in_range(day, low=None, high=None) -> Column:
    """Inclusive; a row without a day passes, and so does a blank bound. Compares ten characters."""
    day = F.substring(_text(day), 1, 10)
    keep = F.lit(True)
    if low:
        keep = keep & (day >= F.lit(low[:10]))
    if high:
        keep = keep & (day <= F.lit(high[:10]))
    return day.isNull() | (day == "") | keep


def first_of(value, *patterns: str) -> Column:
    """The date by the first pattern that reads all of the text."""
    text = _text(value)
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)).cast("date") for p in patterns))


#: The spellings of a bill's dates, each with the shape it needs, and an ISO stamp
#: whose time must be a possible one.
BILL_DATES = (
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$", "yyyy-M-d H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
)
ISO_STAMP = r"^\d{4}-\d{2}-\d{2}[T ](?:[01]\d|2[0-3]):[0-5]\d(?::(?:[0-5]\d|60)(?:\.\d+)?)?(?:Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d)?$"


def bill_date(value) -> Column:
    """struct(day, unreadable): four spellings, then an ISO stamp; a text that none of them reads,
    an impossible day among them, is unreadable. A date is never cut out of what it isn't."""
    text = _text(value)
    read = [F.when(text.rlike(shape), first_of(text, pattern)) for shape, pattern in BILL_DATES]
    stamp = F.when(text.rlike(ISO_STAMP), first_of(F.substring(text, 1, 10), "yyyy-MM-dd"))
    day = F.coalesce(*read, stamp)
    return F.struct(day.alias("day"), (day.isNull() & text.isNotNull() & (text != "")).alias("unreadable"))


def or_ten(value, pattern: str) -> Column:
    """ISO text of a date in one spelling; else the first ten characters as they are."""
    text = _text(value)
    return F.coalesce(F.date_format(F.try_to_timestamp(text, F.lit(pattern)), "yyyy-MM-dd"), F.substring(text, 1, 10))


def or_empty(value, *patterns: str) -> Column:
    """ISO text of a date; unreadable and missing ones are empty."""
    return F.coalesce(F.date_format(first_of(value, *patterns), "yyyy-MM-dd"), F.lit(""))


def register_date(value) -> Column:
    """dd-MM-yyyy of an ISO or dashed date; a slashed one is refused (null)."""
    text = _text(value)
    return F.when(text.contains("/"), F.lit(None)).otherwise(F.date_format(first_of(text, "yyyy-MM-dd", "dd-MM-yyyy"), "dd-MM-yyyy"))


def http_date(value) -> Column:
    """ISO with Z of an HTTP date; anything else as it is."""
    text = _text(value)
    at = F.try_to_timestamp(F.regexp_extract(text, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), text)


def archive_stamp(value) -> Column:
    """ISO with Z of a 14-digit stamp; malformed ones are null."""
    text = _text(value)
    at = F.when(text.rlike(r"^\d{14}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def as_on(value) -> Column:
    """ISO of d/m/y with points, slashes or dashes between, as they appear in a sentence."""
    d, m, y = (F.regexp_extract(value, r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})", i) for i in (1, 2, 3))
    return F.date_format(F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")


def month_windows(low, high) -> Column:
    """array(struct(start, end)): the calendar months of a range, clipped to it."""
    months = F.sequence(F.trunc(low, "MM"), high, F.expr("interval 1 month"))
    return F.when(low <= high, F.transform(months, lambda m: F.struct(F.greatest(m.cast("date"), low).alias("start"), F.least(F.last_day(m), high).alias("end")))).otherwise(F.array())


def day_range(low, high) -> Column:
    """All days, inclusive; a reversed range is an error."""
    return F.when(low > high, F.raise_error(F.lit("reversed date range"))).otherwise(F.sequence(low, high))


def year_bucket(value) -> Column:
    """The first four characters; blank is null."""
    text = F.substring(_text(value), 1, 4)
    return F.when(text != "", text)


def sitting(dates) -> Column:
    """struct(first, last, n) of a session's array of dates."""
    return F.struct(F.array_min(dates).alias("first"), F.array_max(dates).alias("last"), F.size(dates).alias("n"))


#: How advertisements state a deadline, in order.
DEADLINES = (
    r"(?is)(?:application[s]?|complete[d]?\s+application|submitted)[^\n]{0,300}?(?:on\s+or\s+before|deadline[:\s]+|last\s+date[^\n]{0,20}?)\s+([A-Z][a-z]+\s+\d{1,2},?\s+\d{4})",
    r"(?is)(?:on\s+or\s+before|deadline\s+is|last\s+date\s+(?:for|of))\s+([A-Z][a-z]+\s+\d{1,2},?\s+\d{4})",
    r"(?i)Application\s+Last\s+Date[^\d]{0,40}?(\d{1,2}/\d{1,2}/\d{4})",
    r"(?i)last\s+date[^\n]{0,40}?(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})",
    r"(?i)last\s+date[^\n]{0,40}?([A-Z][a-z]+\s+\d{1,2},?\s+\d{4})",
)


def deadline(text, as_of: int) -> Column:
    """The first stated deadline, as written, whose year (where it can be read) is not before the
    year before `as_of`."""
    flat = F.regexp_replace(text, r"[ \t]+", " ")
    found = F.concat(*(F.regexp_extract_all(flat, F.lit(p), F.lit(1)) for p in DEADLINES))
    year = lambda d: F.regexp_extract(d, r"(20\d{2})$", 1).try_cast("int")
    return F.get(F.filter(F.transform(found, lambda d: F.trim(d)), lambda d: F.coalesce(year(d) >= as_of - 1, F.lit(True))), F.lit(0))


def deadline_iso(raw) -> Column:
    bare = F.regexp_replace(F.trim(raw), r"\.$", "")
    return F.date_format(first_of(bare, "MMMM d, yyyy", "MMM d, yyyy", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy"), "yyyy-MM-dd")


def months(first_year, first_month, last_year, last_month) -> Column:
    """array(struct(year, month)) from one month to another, both among them."""
    run = F.sequence(F.make_date(first_year, first_month, F.lit(1)), F.make_date(last_year, last_month, F.lit(1)), F.expr("interval 1 month"))
    return F.transform(run, lambda d: F.struct(F.year(d).alias("year"), F.month(d).alias("month")))


#: A date as advertisements print it, and the words before one that tell its role.
PRINTED = r"(?i)(\d{1,2})[\s.\-/](Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|[0-1]?\d)[\s.\-/](20\d{2})"
CLOSING = r"(?i)(last|closing|deadline|apply\s*by)\s*(date)?"
PUBLISHED = r"(?i)(advertise|publish|issued|dated)"
_MONTH_NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _printed_iso(raw: Column) -> Column:
    day, month, year = (F.regexp_extract(raw, PRINTED, i) for i in (1, 2, 3))
    number = F.coalesce(month.try_cast("int"), F.nullif(F.array_position(F.array(*map(F.lit, _MONTH_NAMES)), F.lower(month)).cast("int"), F.lit(0)))
    fits = number.between(1, 12) & day.try_cast("int").between(1, 31) & year.try_cast("int").between(2015, 2035)
    return F.when(fits, F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0")))


def dates_by_context(text) -> Column:
    """struct(published, closing): the first date each that a word of its role stands before, within
    60 characters; a lone date closes."""
    found, between = F.regexp_extract_all(text, F.lit(PRINTED), F.lit(0)), F.split(text, PRINTED, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<said:string,iso:string>>").alias("out"))

    def step(s, x):
        here = s.at + F.length(x.before)
        said = F.substring(text, F.greatest(here - 59, F.lit(1)), F.least(here, F.lit(60)))
        return F.struct((here + F.length(x.raw)).alias("at"), F.concat(s.out, F.array(F.struct(said.alias("said"), _printed_iso(x.raw).alias("iso")))).alias("out"))

    pairs = F.transform(found, lambda raw, i: F.struct(F.get(between, i).alias("before"), raw.alias("raw")))
    known = F.filter(F.aggregate(pairs, start, step, lambda s: s.out), lambda x: x.iso.isNotNull())
    closes = lambda x: x.said.rlike(CLOSING)
    lone = F.when(F.size(found) == 1, _printed_iso(F.get(found, F.lit(0))))
    return F.struct(
        F.get(F.filter(known, lambda x: ~closes(x) & x.said.rlike(PUBLISHED)), F.lit(0)).iso.alias("published"),
        F.coalesce(F.get(F.filter(known, closes), F.lit(0)).iso, lone).alias("closing"),
    )
