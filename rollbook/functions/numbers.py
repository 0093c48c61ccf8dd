"""Numbers as texts and payloads hold them. Unknown is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def integers(text) -> Column:
    """All integers of a text, their commas removed."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d,]*"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").try_cast("long"))


def scaled(value, scale) -> Column:
    """Rupees of a value and its scale word."""
    word = F.lower(F.trim(scale))
    factor = F.when(word.isin("crore", "crores", "cr", "cr."), 10_000_000).when(word.isin("lakh", "lakhs", "lac", "lacs"), 100_000).when(word.isin("thousand", "thousands"), 1000).otherwise(1)
    return (value.cast("decimal(20,4)") * factor).cast("decimal(24,2)")


def rupees(text) -> Column:
    """Rupees of the first amount with a scale word."""
    pattern = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*(crores?|cr\.?|lakhs?|lacs?)\b"
    return F.when(text.rlike(pattern), scaled(F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("decimal(20,4)"), F.regexp_extract(text, pattern, 2)))


def number_or_text(value) -> Column:
    """struct(number, text): blanks and N/A are null, what is no number stays text."""
    text = F.trim(value.cast("string"))
    known = F.when(~F.lower(text).isin("", "n/a", "na"), text)
    return F.struct(known.try_cast("double").alias("number"), F.when(known.try_cast("double").isNull(), known).alias("text"))


def safe_int(value) -> Column:
    """'12.0' is 12; junk is null."""
    number = F.trim(value.cast("string")).try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("long"))


def halved(size, unit) -> Column:
    """Half of a size as a multiple of the unit, the unit at least."""
    return F.greatest(unit, F.floor(size / 2 / unit) * unit).cast("long")


def facility(cell) -> Column:
    """struct(n, place, km): a count, or the nearest place, in which case the count is zero."""
    text = F.trim(cell.cast("string"))
    place = r"^(.*?)\s*\((\d+(?:\.\d+)?)[^)]*\)$"
    elsewhere = text.rlike(place)
    return F.struct(
        F.when(elsewhere, F.lit(0).cast("long")).otherwise(safe_int(text)).alias("n"),
        F.when(elsewhere, F.trim(F.regexp_extract(text, place, 1))).alias("place"),
        F.when(elsewhere, F.regexp_extract(text, place, 2).try_cast("double")).alias("km"),
    )


def availability(code) -> Column:
    n = safe_int(code)
    return F.when(n == 1, "available").when(n == 2, "not_available")


def count_or_status(count, status) -> Column:
    """An empty count with 'not_available' is zero; without a status it is unknown."""
    return F.coalesce(count, F.when(status == "not_available", F.lit(0).cast("long")))


def padded(code, width: int) -> Column:
    """Digits filled with zeros to a width, once or twice alike."""
    text = F.trim(code.cast("string"))
    return F.when(text.rlike(r"^\d+$") & (F.length(text) < width), F.lpad(text, width, "0")).otherwise(text)


def sum_known(*values) -> Column:
    """The sum of what is known; null if nothing is."""
    nothing = F.lit(True)
    for v in values:
        nothing = nothing & v.isNull()
    total = F.lit(0)
    for v in values:
        total = total + F.coalesce(v, F.lit(0))
    return F.when(~nothing, total)


def values_of(metadata, key: str) -> Column:
    """All `value` fields under a key of map<string, array<struct<value>>>."""
    return F.filter(F.transform(F.coalesce(F.try_element_at(metadata, F.lit(key)), F.array().cast("array<struct<value:string>>")), lambda x: x.value), lambda v: v.isNotNull())


def excerpt(text, most: int) -> Column:
    """White space collapsed, cut at the last space within `most` characters, with three points."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(flat, 1, most)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("...")))


def records(header, rows) -> Column:
    """array of maps: snake-case header cells (blank: c and the position) to the cells of a row."""
    names = F.transform(header, lambda h, i: F.when(F.trim(h) == "", F.concat(F.lit("c"), i.cast("string"))).otherwise(F.regexp_replace(F.regexp_replace(F.lower(F.trim(h)), r"[^a-z0-9]+", "_"), "^_|_$", "")))
    return F.transform(rows, lambda row: F.map_from_arrays(F.slice(names, 1, F.size(row)), row))


def declared_count(total, items) -> Column:
    """The declared total, else the length of the list, else null."""
    return F.coalesce(total.try_cast("long"), F.when(items.isNotNull(), F.size(items).cast("long")))


def posts(categories) -> Column:
    """The sum of a category map; null without one."""
    return F.when(F.size(categories) > 0, F.aggregate(F.map_values(categories), F.lit(0).cast("long"), lambda a, x: a + x))


def envelope(body) -> Column:
    """The document of a base64 JSON envelope, or the body where it is one already."""
    text = body.cast("string")
    inner = F.coalesce(F.get_json_object(text, "$.data"), F.get_json_object(text, "$.content"), F.get_json_object(text, "$.file"))
    return F.when(F.substring(body, 1, 4) == F.lit("%PDF").cast("binary"), body).otherwise(F.try_to_binary(inner, F.lit("base64")))


def increasing(values) -> Column:
    """Of an array of numbers those that exceed all before them: printed lists count upwards, noise
    between them doesn't."""
    return F.filter(values, lambda x, i: (i == 0) | (x > F.array_max(F.slice(values, F.lit(1), F.greatest(i, F.lit(1))))))
