"""Summaries of candidates' affidavits, from the HTML of one page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where the page states each field, and the named entities that are decoded, & last.
TEXTS = {
    "name": r"<h2>([^<]+?)\s*(?:<font[^>]*>\([^)]+\)</font>)?\s*</h2>",
    "winner_status": r"<h2>[^<]+?\s*<font[^>]*>\(([^)]+)\)</font>\s*</h2>",
    "party": r"<b>Party:</b>\s*([^<]+)",
    "self_profession": r"<b>Self Profession:</b>\s*([^<]+)",
    "spouse_profession": r"<b>Spouse Profession:</b>\s*([^<]+)",
    "education_category": r"Category:\s*([^<]+?)\s*<br>",
}
NUMBERS = {
    "age": r"<b>Age:</b>\s*(\d+)",
    "assets_rupees": r"Assets:\s*</td><td>\s*<b>Rs&nbsp;([\d,]+)</b>",
    "liabilities_rupees": r"Liabilities:\s*</td><td>\s*<b>Rs&nbsp;([\d,]+)</b>",
    "criminal_cases_declared": r"\['Cases',\s*(\d+)\]",
}
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def _stated(html, pattern: str) -> Column:
    """The first group of the first match; null where the page does not state it."""
    return F.when(F.regexp_like(html, F.lit(pattern)), F.regexp_extract(html, pattern, 1))


def _plain(text: Column) -> Column:
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def affidavit(html) -> Column:
    """A struct of all fields, each null where the page lacks it (all are for a null page), figures as
    long without their commas. Entities other than `ENTITIES` stay as they are."""
    texts = [(_plain(_stated(html, p)) if k != "winner_status" else _stated(html, p)).alias(k) for k, p in TEXTS.items()]
    numbers = [F.replace(_stated(html, p), F.lit(","), F.lit("")).try_cast("long").alias(k) for k, p in NUMBERS.items()]
    return F.struct(*texts, *numbers)
