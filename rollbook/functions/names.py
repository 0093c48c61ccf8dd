"""People, places and numbers spelled in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is dropped from a name, as entities and as members spell it.
HONORIFICS = r"(?i)\b(Shri|Smt|Dr|Prof|Babu|Ven'ble|Kumari|Sushri|Sardar|Adv|Hon'ble|Mr|Mrs|Ms)\b\.?\s*"
MEMBER_HONORIFICS = r"(?i)\b(Shri|Smt|Dr|Prof|Babu|Ven'ble|Kumari|Sushri|Sardar)\b\.?\s*"
UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
ORDINALS = {"first": 1, "second": 2, "third": 3, "fifth": 5, "eighth": 8, "ninth": 9, "twelfth": 12}
SCALES = {"hundred": 100, "thousand": 1000}


def number_words() -> dict[str, int]:
    """Every word of a cardinal or ordinal below a hundred: a rule, not a table."""
    out = UNITS | TENS | ORDINALS
    out |= {w + "th": n for w, n in UNITS.items() if n and n not in ORDINALS.values()}
    out |= {w[:-1] + "ieth": n for w, n in TENS.items()}
    return out


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def normal_person(name) -> Column:
    """'Last, First' turned round at the first comma, honorifics dropped, lower case, all but
    letters and digits of ASCII to spaces, tokens sorted."""
    turned = F.when(F.instr(name, ",") > 0, F.concat_ws(" ", F.trim(F.regexp_extract(name, r"(?s)^[^,]*,(.*)$", 1)), F.trim(F.regexp_extract(name, r"^([^,]*),", 1)))).otherwise(name)
    plain = F.regexp_replace(F.lower(F.regexp_replace(turned, HONORIFICS, "")), r"[^a-z0-9]+", " ")
    return F.array_join(F.array_sort(_tokens(plain)), " ")


def normal_member(name) -> Column:
    """A comma turns the name only if it is the only one; points to spaces, other punctuation is
    removed, not spaced; tokens sorted."""
    parts = F.split(name, ",")
    turned = F.when(F.size(parts) == 2, F.concat_ws(" ", F.trim(parts[1]), F.trim(parts[0]))).otherwise(name)
    plain = F.replace(F.lower(F.regexp_replace(turned, MEMBER_HONORIFICS, "")), F.lit("."), F.lit(" "))
    return F.array_join(F.array_sort(_tokens(F.regexp_replace(plain, r"[^a-z0-9\s]", ""))), " ")


def slug(name) -> Column:
    """Words in their order, joined by underscores, honorifics dropped."""
    plain = F.regexp_replace(F.replace(F.lower(name), F.lit("."), F.lit(" ")), HONORIFICS, "")
    return F.array_join(_tokens(F.regexp_replace(plain, r"[^a-z0-9\s]", " ")), "_")


def entity_id(name, *context) -> Column:
    """PERSON_, eight digits of the hash of the parts in lower case, and the slug."""
    parts = F.concat_ws("|", *(F.lower(F.trim(p)) for p in (name, *context)))
    return F.concat(F.lit("PERSON_"), F.substring(F.sha2(parts, 256), 1, 8), F.lit("_"), slug(name))


def words_to_int(phrase) -> Column:
    """'three hundred and sixty sixth' is 366. A word that is no number makes it null, zero too;
    a scale without a number before it counts once."""
    values = F.create_map(*(F.lit(x) for pair in number_words().items() for x in pair))
    scales = F.create_map(*(F.lit(x) for pair in SCALES.items() for x in pair))
    tokens = F.filter(F.split(F.regexp_replace(F.lower(phrase), r"[^a-z]+", " "), " "), lambda t: ~t.isin("", "and"))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("now"), F.lit(True).alias("ok"))

    def step(s, t):
        value, scale = F.try_element_at(values, t), F.try_element_at(scales, t)
        grown = F.when(scale.isNotNull(), F.when(s.now == 0, 1).otherwise(s.now) * scale).otherwise(s.now + F.coalesce(value, F.lit(0)))
        closed = F.coalesce(scale >= 1000, F.lit(False))
        return F.struct(
            F.when(closed, s.total + grown).otherwise(s.total).alias("total"),
            F.when(closed, 0).otherwise(grown).alias("now"),
            (s.ok & (scale.isNotNull() | value.isNotNull())).alias("ok"),
        )

    out = F.aggregate(tokens, start, step, lambda s: F.when(s.ok, s.total + s.now))
    return F.when(out > 0, out)


#: The phrases that name another report.
CONTAINED = r"(?is)contained\s+in\s+the\s+(.{1,80}?)\s+Report\b"
REPORT_NO = r"(?i)\bReport\s+No\.?\s*(\d{1,9})\b"
ANY_ORDINAL = r"(?i)(\d{1,9})(?:st|nd|rd|th)?\s+Report\b"


def referenced_number(title) -> Column:
    """The report that a title refers to: an anchored phrase (digits at its end, else words), then
    'Report No.', then any numbered report."""
    phrase = F.trim(F.regexp_extract(title, CONTAINED, 1))
    return F.coalesce(
        F.regexp_extract(phrase, r"(\d{1,9})(?:st|nd|rd|th)?$", 1).try_cast("int"),
        F.when(phrase != "", words_to_int(phrase)),
        F.regexp_extract(title, REPORT_NO, 1).try_cast("int"),
        F.regexp_extract(title, ANY_ORDINAL, 1).try_cast("int"),
    )


def referenced_key(house, term, slug_, number) -> Column:
    """LS|slug|number|term or RS|slug|number; the lower house needs its term; what is missing makes
    the key null."""
    low = F.lower(house)
    enough = F.coalesce(slug_ != "", F.lit(False)) & number.isNotNull()
    parts = (slug_, number.cast("string"))
    lower_ = F.when(term.isNotNull(), F.concat_ws("|", F.lit("LS"), *parts, term.cast("string")))
    return F.when(enough, F.when(low.startswith("lok") | (low == "ls"), lower_).when(low.startswith("raj") | (low == "rs"), F.concat_ws("|", F.lit("RS"), *parts)))


def _unmarked() -> tuple[str, str]:
    """Letters whose decomposition is one ASCII letter and marks, and those letters."""
    import unicodedata

    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        if len(bare) == 1 and bare.isascii() and c == c.lower():
            pairs.append((c, bare))
    return "".join(c for c, _ in pairs), "".join(x for _, x in pairs)


def fold(label) -> Column:
    """A label without case, marks, spaces and punctuation."""
    return F.regexp_replace(F.translate(F.regexp_replace(F.lower(label), r"\p{M}+", ""), *_unmarked()), r"[^\p{L}\p{N}]+", "")


def district_code(value) -> Column:
    """'"0553.0"' is 553; zero and blanks are null."""
    digits = F.regexp_replace(F.regexp_replace(F.trim(value.cast("string")), "[\"']", ""), r"\.0+$", "")
    plain_ = F.regexp_replace(digits, "^0+", "")
    return F.when(digits.rlike(r"^\d+$") & (plain_ != ""), plain_)


def state_key(state) -> Column:
    """Numeric codes lose leading zeros; names are folded."""
    text = F.trim(state.cast("string"))
    return F.coalesce(text.try_cast("int").cast("string"), fold(text))


def census_title(title) -> Column:
    """struct(year, district, state) of a product title."""
    year = F.nullif(F.regexp_extract(title, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(title, r"(?i)\b(?:19|20)\d{2}\b|village amenities|town amenities|census|data|of|for", " "), r"\s+", " ")
    parts = F.split(F.trim(rest), r"\s*[,-]\s*")
    return F.struct(year.alias("year"), F.nullif(F.trim(parts[0]), F.lit("")).alias("district"), F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("state"))


def dashed_id(value, fields: tuple[str, ...]) -> Column:
    """A struct of the dash-separated segments; null unless there are exactly as many."""
    parts = F.split(value, "-")
    return F.when(F.size(parts) == len(fields), F.struct(*(F.get(parts, F.lit(i)).alias(f) for i, f in enumerate(fields))))


def school_code(value) -> Column:
    """struct(state, district, block, school) of 11 digits, else null."""
    return F.when(value.rlike(r"^\d{11}$"), F.struct(*(F.substring(value, a, n).alias(f) for f, a, n in (("state", 1, 2), ("district", 3, 2), ("block", 5, 2), ("school", 7, 5)))))


def name_and_seat(cell) -> Column:
    """struct(name, seat) of 'Name (Seat)'."""
    seat = F.regexp_extract(cell, r"\(([^()]*)\)\s*$", 1)
    return F.struct(F.trim(F.regexp_replace(cell, r"\s*\([^()]*\)\s*$", "")).alias("name"), F.nullif(F.trim(seat), F.lit("")).alias("seat"))


def labelled_code(label) -> Column:
    """struct(label, code) of 'Label (123)' or 'Label - 123'; without a code the label stays."""
    code = F.regexp_extract(label, r"[\s(\[-]+(\d+)[)\]]?\s*$", 1)
    return F.struct(F.when(code == "", F.trim(label)).otherwise(F.trim(F.regexp_replace(label, r"[\s(\[-]+\d+[)\]]?\s*$", ""))).alias("label"), F.nullif(code, F.lit("")).alias("code"))


def advert_number(text) -> Column:
    found = F.regexp_extract(text, r"(?i)(?:advt|advertisement|advert)\.?\s*(?:no|number)?\.?\s*:?\s*([A-Za-z0-9/().-]*\d[A-Za-z0-9/().-]*)", 1)
    return F.nullif(F.regexp_replace(found, r"[.,;)(]+$", ""), F.lit(""))


def house_short(house) -> Column:
    low = F.lower(F.trim(house))
    return F.when(low.startswith("lok"), "LS").when(low.startswith("raj"), "RS").otherwise(low)


def sessions(text) -> Column:
    """'1-3,7' is [1, 2, 3, 7]."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    bounds = F.transform(parts, lambda p: F.split(p, r"\s*-\s*"))
    runs = F.transform(bounds, lambda b: F.sequence(b[0].cast("int"), F.get(b, F.size(b) - 1).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(runs)))


def params(text) -> Column:
    """'a=1,b=2' as a map."""
    return F.str_to_map(text, F.lit(","), F.lit("="))
