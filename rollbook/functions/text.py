"""Text of documents: cleaning, splitting and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where an answer begins, in order of priority; the last also stands in headers.
BOUNDARIES = (
    r"^\s*ANSWER\s*$",
    r"^\s*REPLY\s*$",
    r"^\s*Reply\s+by\b.{0,200}?:",
    r"^\s*Answer\s+by\b.{0,200}?:",
    r"\bSHRI\b.{0,60}\b(?:MINISTER|MOS)\b",
    r"\bTO\s+BE\s+ANSWERED\s+ON\b",
)
#: Marks of an answer, of a letterhead and of a question's header, and letters of
#: another alphabet that are drawn like Latin ones.
ANSWER_MARKS = r"(?i)\bANSWER(?:ED)?\b|उ.{0,4}राथ|उत्तर"
LETTERHEADS = r"(?i)\b(?:LOK|RAJYA)\s*S[AH]{1,3}BHA\b|GOVERNMENT\s+OF\s+INDIA|(?:UN[-\s]?)?STARRED\s+QUESTION|(?:लोक|रा.{0,3}?)\s*सभा|भारत\s*सरकार|अतारां|तारांिकत"
QUESTION_HEADER = r"(?i)\bTO\s+BE\s+ANSWER(?:ED)?\b"
LOOKALIKES = ("АВЕКМНОРСТХУІЈ", "ABEKMHOPCTXYIJ")
#: The line of the answering day, the asker's line, the question's stem, and a
#: minister's name in the head of an answer.
ANSWERED_ON = r"\bANSWERED\s+ON\b\s*[:.,]?\s*\d.*?$"
ASKER = r"^\s*\*?\s*\d+\.?\s+(?:SHRI|SHRIMATI|SMT|DR|KUMARI|PROF)[A-Z\.\s,]+:\s*$"
STEM = r"(?is)\bWill\s+the\s+Minister\b.*?:"
MINISTER = r"(?is)\b(?:THE\s+)?MINISTER\s+(?:OF\s+STATE\s+(?:IN\s+THE\s+MINISTRY\s+OF|FOR)\b|OF\s+(?!STATE)|FOR)[^()]{0,250}?\(([^()]{4,}?\s[^()]{1,})\)"


def stripped(text) -> Column:
    """Without white space at either end, line breaks too."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def contains_any(text, terms) -> Column:
    """Any of the terms as a substring, without case."""
    low, found = F.lower(text), F.lit(False)
    for t in terms:
        found = found | low.contains(t.lower())
    return F.coalesce(found, F.lit(False))


def tolerant(term: str) -> str:
    """A pattern of a term whose 'ti' may have lost its ligature to a space."""
    import re

    return r"(?i)" + re.escape(term).replace("ti", r"(?:ti|\s)")


def first_match(text, ladder, default) -> Column:
    """The name of the first pattern of a ladder that matches."""
    out = F.lit(default)
    for name, pattern in reversed(ladder):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


#: Ladders, the first that matches counts.
REPORT_TYPES = (
    ("action_taken", r"(?i)\baction[\s\-]+taken\b"),
    ("demands_for_grants", r"(?i)\bdemands?\s+for\s+grants?\b"),
    ("bill", r"(?i)\b(?:Bill|Bills)\b"),
    ("subject", r"(?i)\b(?:review|working|functioning|performance|evolving\s+role|role\s+of|promoting|promotion\s+of|roadmap|status|examination|implementation|impact|study|assessment|emerging\s+issues|policy|issues\s+(?:relating|pertaining)\s+to)\b"),
)
POST_TYPES = (
    ("Postdoc", r"(?i)\bpost[- ]?doc|\bpostdoctoral\b|\bpost[- ]?doctoral\b|\bpdf\s+position\b"),
    ("Faculty", r"(?i)\bprofessor\b|\blecturer\b|\breader\b|\bfaculty\s+recruit"),
    ("Scientific", r"(?i)\b(?:junior|senior)\s+research\s+fellow\b|\bJRF\b|\bSRF\b|\bresearch\s+associate\b|\bproject\s+(?:research\s+)?scientist\b"),
    (
        "NonFaculty",
        r"(?i)\bproject\s+(?:associate|officer|manager|assistant|engineer)\b|\btechnician\b|\bweb\s+developer\b|\benergy\s+(?:manager|engineer)\b|\bsecurity\s+(?:analyst|engineer)\b"
        r"|\balumni\s+relations\b|\bfire\s+safety\b|\boffice\s+executive\b|\bmedical\s+officer\b|\bconsultant\b",
    ),
)
CONTRACTS = (("Guest", r"(?i)guest"), ("AdHoc", r"(?i)ad-?hoc"), ("Contractual", r"(?i)contractual|contract basis"), ("Visiting", r"(?i)visiting"), ("TenureTrack", r"(?i)tenure[ -]track"), ("Regular", r"(?i)regular|permanent"))
DEPARTMENTS = (
    r"(?i)\bDep(?:artment|t)\.?\s+of\s+([^,\n]+?)(?:,\s*IIT|,\s*IIM|,\s*IISER|\s*$)",
    r"(?i)\b(?:faculty|professor|lecturer|chair)\s+(?:positions?|posts?|openings?)\s+in\s+(.+?)(?:\s+[—–\-]{1,2}\s+|\s*$)",
)
PUBLICATIONS = tuple(rf"(?is)({opening}\s+(?:THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|TEN|\d+)[^.]{{10,400}}?(?:journals?|publications?|conferences?)\.?)" for opening in (r"minimum of", r"at least"))
RESERVATION = (
    r"(?i)(SC[-\s]\s*\d+(?:\.\d+)?%[^.\n]{0,200}(?:ST|OBC|EWS|PwBD|PwD|NCL)[^\n]{0,40}%)",
    r"(?i)((?:SC|ST|OBC|EWS|PwBD|PwD)[-\s]\s*\d+(?:\.\d+)?%(?:\s*[;,&]\s*(?:SC|ST|OBC|EWS|PwBD|PwD|NCL)[^\n]{0,30}%){2,})",
)
VACANCY = r"(?iu)vacan|sanctioned\s+(?:strength|posts?)|men[\s-]+in[\s-]+position|backlog|lying\s+vacant|posts?\s+abolished|abolition\s+of\s+posts?|shortage\s+of\s+(?:staff|officers|manpower)|रिक्त|मंज़ूर\s*पद|मंजूर\s*पद"


def clean(text) -> Column:
    """Lines that are a number and paragraph marks dropped, blanks collapsed, two line breaks at
    most, stripped."""
    out = F.regexp_replace(text, r"(?m)^\s*\d+\s*$", "")
    out = F.regexp_replace(out, r"\(Para\s+\d+(?:\.\d+)*\)", "")
    return stripped(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def split_qa(text) -> Column:
    """struct(question, answer, marker, confidence) of a letter: cut at the first boundary by
    priority, not by place. Null without a boundary, or if that one leaves a side empty."""
    body = clean(text)
    out = F.lit(None).cast("struct<question:string,answer:string,marker:string,confidence:double>")
    for boundary in reversed(BOUNDARIES):
        pattern = "(?im)" + boundary
        parts = F.split(body, pattern, 2)
        question, answer = stripped(parts[0]), stripped(F.get(parts, F.lit(1)))
        found = F.struct(question.alias("question"), answer.alias("answer"), stripped(F.regexp_extract(body, pattern, 0)).alias("marker"), F.when(F.length(answer) > 50, 0.85).otherwise(0.5).alias("confidence"))
        out = F.when(body.rlike(pattern), F.when((question != "") & (answer != ""), found)).otherwise(out)
    return out


def subject(question) -> Column:
    """What stands between the line of the answering day and the asker's (else in the next 300
    characters), its lines joined, 200 characters at most; empty without such a day."""
    after = F.get(F.split(question, "(?im)" + ANSWERED_ON, 2), F.lit(1))
    before_asker = F.split(after, "(?im)" + ASKER, 2)
    found = F.when(F.size(before_asker) == 2, before_asker[0]).otherwise(F.substring(after, 1, 300))
    lines = F.filter(F.transform(F.split(found, r"\r\n|\r|\n"), stripped), lambda x: x != "")
    return F.coalesce(F.substring(F.array_join(lines, " "), 1, 200), F.lit(""))


def stem_and_body(question) -> Column:
    """struct(stem, body): 'Will the Minister ... :' and what follows; both empty without it."""
    stem = F.regexp_extract(question, STEM, 0)
    body = F.get(F.split(question, STEM, 2), F.lit(1))
    return F.struct(stripped(stem).alias("stem"), F.coalesce(stripped(body), F.lit("")).alias("body"))


def minister_and_body(answer) -> Column:
    """struct(minister, body): the name in the head of an answer and the rest, else the whole."""
    rest = F.get(F.split(answer, MINISTER, 2), F.lit(1))
    return F.struct(stripped(F.regexp_extract(answer, MINISTER, 1)).alias("minister"), F.coalesce(F.regexp_replace(rest, r"^[\s:]+", ""), answer).alias("body"))


def looks_like_answer(text, least: int = 200) -> Column:
    """Long enough, an answer's mark outside the question's header, and a letterhead."""
    body = F.translate(stripped(text), *LOOKALIKES)
    rest = F.regexp_replace(body, QUESTION_HEADER, " ")
    return F.coalesce((F.length(body) >= least) & rest.rlike(ANSWER_MARKS) & body.rlike(LETTERHEADS), F.lit(False))


def needs_ocr(text, least: int = 200) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def recovery(before, after, accepted) -> Column:
    """What becomes of a second reading: only a longer one that is accepted replaces the first."""
    return F.when(after.isNull() | (F.length(after) <= F.length(F.coalesce(before, F.lit("")))), "kept").when(accepted, "recovered").otherwise("rejected")


def report_type(title) -> Column:
    return first_match(F.coalesce(title, F.lit("")), REPORT_TYPES, "other")


def presented(ls, rs, speaker) -> Column:
    """Through which houses, by the dates that are not blank."""
    there = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return F.when(there(ls) & there(rs), "both_houses").when(there(ls), "ls_only").when(there(rs), "rs_only").when(there(speaker), "speaker_only").otherwise("none")


def source_class(kind, report_type_) -> Column:
    """Which extractor a record goes to: every committee report but an action-taken one holds
    observations."""
    return F.when(kind == "qa", "qa").when((kind == "committee_report") & F.coalesce(report_type_ == "action_taken", F.lit(False)), "atr").when(kind == "committee_report", "observations").otherwise("skip")


def number_verdict(requested, printed) -> Column:
    strip = lambda c: F.regexp_replace(F.trim(c), "^0+", "")
    return F.when(printed.isNull() | (F.trim(printed) == ""), "unreadable").when(strip(F.coalesce(requested, F.lit(""))) == strip(printed), "verified").otherwise("mismatch")


def vacancy_counts(sanctioned, in_position, vacant) -> Column:
    """struct(vacant, vacant_stated): the stated number, else the difference; unknown stays null."""
    return F.struct(F.coalesce(vacant, sanctioned - in_position).alias("vacant"), vacant.isNotNull().alias("vacant_stated"))


def post_type(title) -> Column:
    return first_match(title, POST_TYPES, "Unknown")


def contract_status(context) -> Column:
    return first_match(context, CONTRACTS, "Unknown")


def department(title) -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(title, p, 1)), F.lit("")) for p in DEPARTMENTS))


def publications(text) -> Column:
    """Up to three different phrases about publications."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in PUBLICATIONS))
    flat = F.array_distinct(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))))
    return F.nullif(F.array_join(F.slice(flat, 1, 3), " | "), F.lit(""))


def reservation_note(text) -> Column:
    flat = F.regexp_replace(text, r"\s+", " ")
    return F.coalesce(*(F.nullif(F.regexp_replace(F.trim(F.regexp_extract(flat, p, 1)), r"[.,;]+$", ""), F.lit("")) for p in RESERVATION))


def without_pagination(text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\f", "\n"), r"(?im)^[ \t]*page \d+ of \d+[ \t]*$", ""), r"(?m)^[ \t]*-+[ \t]*\d+[ \t]*-+[ \t]*$", "")


def stated_totals(text) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)Total\s+number\s+of\s+questions\s*[-–—:]+\s*(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))


def is_corrigendum(text) -> Column:
    return text.rlike(r"(?im)^\s*CORRIGEND(?:UM|A)")


def volume(signal) -> Column:
    """The second volume is tested first: its mark holds the first's."""
    return F.when(signal.rlike(r"(?i)vol(?:ume)?[ ._-]*(?:ii|2)\b"), "II").when(signal.rlike(r"(?i)vol(?:ume)?[ ._-]*(?:i|1)\b"), "I")


def is_amendment(title) -> Column:
    return title.rlike(r"(?i)\bamendment\b")


def challenge(status, headers, body, expected: bool = True) -> Column:
    """Why a response is a firewall's, else null."""
    empty = F.length(F.coalesce(body, F.lit(""))) == 0
    return F.when(F.exists(F.map_keys(headers), lambda k: F.lower(k).rlike("challenge|mitigated")), "challenge_header").when(F.lit(expected) & status.between(200, 299) & empty, "empty_body")


def geo_fenced(error) -> Column:
    return error.rlike(r"(?i)name or service not known|nodename nor servname|getaddrinfo|private address|not permitted")


def needs_egress(here, there) -> Column:
    """Reachable here: no. Not here but there: yes. Anything else is unknown."""
    return F.when(here, False).when((~here) & there, True)


def question_query(query, types, low=None, high=None, sort=None) -> Column:
    """A search phrase with its tokens."""
    parts = [query, F.when(F.size(types) > 0, F.concat(F.lit("doctypes: "), F.array_join(types, ",")))]
    parts += [F.concat(F.lit(f"{k}: "), v) for k, v in (("fromdate", low), ("todate", high), ("sortby", sort)) if v is not None]
    return F.nullif(F.trim(F.concat_ws(" ", *parts)), F.lit(""))


def transliterate_digits(text) -> Column:
    """Gujarati digits to ASCII."""
    return F.translate(text, "".join(chr(0x0AE6 + i) for i in range(10)), "0123456789")


def gujarati(text) -> Column:
    """Digits in ASCII, and a doubled long-a sign (no word has one) as a single one."""
    return F.regexp_replace(transliterate_digits(text), "\u0abe{2,}", "\u0abe")
