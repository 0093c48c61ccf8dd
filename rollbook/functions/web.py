"""URLs, HTML by patterns, hashes and file heads. HTML that needs a parser is in udtf."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of pages that a script fills, and what they stand for.
FRAMEWORKS = (("__NUXT__", "Nuxt"), ("data-n-head-ssr", "Nuxt"), ("__NEXT_DATA__", "Next.js"), ('id="__next"', "Next.js"), ("__N_SSP", "Next.js (server-side props)"), ("<app-root", "Angular"), ('id="root"', "React root element"))
#: The authority of a URL, its host and its port; a URL may come without a scheme.
_AUTHORITY = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?"


def _full(url) -> Column:
    return F.when(url.contains("//"), url).otherwise(F.concat(F.lit("//"), url))


def host(url) -> Column:
    """Lower case, without www.; a port stays unless the scheme (http, if none is given) implies it."""
    full = _full(url)
    scheme, name, port = (F.regexp_extract(full, _AUTHORITY, i) for i in (1, 2, 3))
    implied = F.when(F.lower(scheme) == "https", "443").otherwise("80")
    return F.concat(F.regexp_replace(F.lower(name), r"^www\.", ""), F.when((port != "") & (port != implied), F.concat(F.lit(":"), port)).otherwise(""))


def canonical(url) -> Column:
    """Host, path and query without scheme, www., default port, fragment and trailing slashes."""
    tail = F.regexp_replace(F.regexp_replace(_full(url), _AUTHORITY, ""), r"#.*$", "")
    path, query = F.regexp_replace(tail, r"\?.*$", ""), F.regexp_extract(tail, r"(\?.+)$", 1)
    return F.concat(host(url), F.regexp_replace(path, r"/+$", ""), query)


def on_host(url, own: str) -> Column:
    """The URL without its fragment and www., blank on another host."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"(?i)^(https?://)www\.", "$1")
    return F.when(host(url) == own.lower(), bare).otherwise("")


def safe_segment(value, collapse: bool = False, strip: bool = True) -> Column:
    """All but letters, digits, '.', '_' and '-' to '_'; no leading points; 'unknown' if empty.
    collapse: a run becomes one, and (strip) none stays at the ends."""
    out = F.regexp_replace(F.trim(value), r"[^A-Za-z0-9._-]" + ("+" if collapse else ""), "_")
    if collapse and strip:
        out = F.regexp_replace(out, r"^_+|_+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(out, r"^\.+", ""), F.lit("")), F.lit("unknown"))


def destination(url, most: int = 120) -> Column:
    """A relative path for a URL: index.html in folders and for paths without a suffix, a hash for
    a query, segments of safe characters."""
    bare = F.regexp_replace(F.regexp_replace(url, _AUTHORITY, ""), r"#.*$", "")
    path, query = F.regexp_replace(F.try_url_decode(F.regexp_replace(bare, r"\?.*$", "")), r"^/+", ""), F.regexp_extract(bare, r"\?(.*)$", 1)
    path = F.when((path == "") | path.endswith("/"), F.concat(path, F.lit("index.html"))).when(~path.rlike(r"[^/]\.[^./]+$"), F.concat(path, F.lit("/index.html"))).otherwise(path)
    path = F.concat(path, F.when(query != "", F.concat(F.lit("__"), F.substring(F.sha1(query), 1, 8))).otherwise(""))
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))
    return F.array_join(F.transform(parts, lambda p: F.substring(F.regexp_replace(p, r"[^A-Za-z0-9._+~-]", "_"), 1, most)), "/")


def public_url(url) -> Column:
    """Without secret parameters."""
    out = F.regexp_replace(url, r"(?i)([?&])(?:api-?key|key|token|access_token|secret|password|auth)=[^&#]*&?", "$1")
    return F.regexp_replace(out, r"[?&]+$", "")


def strip_tags(html) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))


def title(html) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def frameworks(html) -> Column:
    """The frameworks whose marks occur, each once, in fixed order."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(html, F.lit(mark)), F.lit(name)) for mark, name in FRAMEWORKS))))


def hrefs(html) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"']*)[\"']"), F.lit(1))


def cell_href(cell) -> Column:
    return F.nullif(F.regexp_extract(cell, r"(?i)href=[\"']([^\"']+)[\"']", 1), F.lit(""))


def rendered(html, text, least: int = 400, required: tuple[str, ...] = ()) -> Column:
    """struct(rendered, reason, missing, frameworks): required texts that are absent decide first,
    then the length of the visible text."""
    missing = F.filter(F.array(*map(F.lit, required)).cast("array<string>"), lambda r: ~F.contains(F.lower(text), F.lower(r)))
    reason = F.when(F.size(missing) > 0, "required").when(F.length(text) < least, F.when(F.size(frameworks(html)) > 0, "shell").otherwise("short")).otherwise("content")
    return F.struct((reason == "content").alias("rendered"), reason.alias("reason"), missing.alias("missing"), frameworks(html).alias("frameworks"))


def browse_rows(html) -> Column:
    """array(struct(handle, title)) of a listing; the first title of a handle counts."""
    pattern = r"(?is)<a[^>]*href=[\"'](/handle/[\d./]+)[\"'][^>]*>(.*?)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("handle"), F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(2)), lambda t: strip_tags(t)).alias("title"))
    return F.filter(pairs, lambda p, i: F.array_position(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), p.handle) == i + 1)


def order_rows(html) -> Column:
    """Different (id, type) pairs of download calls, in order."""
    pattern = r"(?i)download\w*\(\s*['\"]?(\w+)['\"]?\s*,\s*['\"]?(\w+)['\"]?\s*\)"
    return F.array_distinct(F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("gid"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("type")))


def metadata(html) -> Column:
    """map of the meta tags of an item page."""
    pattern = r"(?is)<meta\s+name=[\"']([^\"']+)[\"']\s+content=[\"']([^\"']*)[\"']"
    names = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    pairs = F.arrays_zip(names.alias("k"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("v"))
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(names, p.k) == i + 1))


def magic(content) -> Column:
    """pdf, truncated_pdf, ole2, zip or unknown of a binary."""
    pdf = F.substring(content, 1, 4) == F.lit(b"%PDF")
    return (
        F.when(pdf & F.contains(content, F.lit(b"%%EOF")), "pdf").when(pdf, "truncated_pdf").when(F.substring(content, 1, 4) == F.lit(bytes([0xD0, 0xCF, 0x11, 0xE0])), "ole2").when(F.substring(content, 1, 4) == F.lit(b"PK\x03\x04"), "zip").otherwise("unknown")
    )


def fingerprint(*columns) -> Column:
    """Twelve digits over the JSON of the given columns, volatile ones left out by the caller."""
    return F.substring(F.sha1(F.to_json(F.struct(*columns))), 1, 12)


def stable_id(*parts) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 16)


def unit_key(*columns) -> Column:
    """JSON of a unit: the text "1" and the number 1 differ."""
    return F.to_json(F.struct(*columns))


def redact(props) -> Column:
    """A map<string, string> whose secret values are masked, by parts of their keys."""
    secret = r"(?i)key|token|secret|password|passwd|auth|cookie"
    return F.transform_values(props, lambda k, v: F.when(k.rlike(secret), F.lit("[redacted]")).otherwise(v))


def encoded_path(url) -> Column:
    """The URL with unsafe characters of its path and query percent-encoded; what is encoded stays."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"

    def quoted(text, safe):
        each = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
        return F.array_join(F.transform(each, lambda c: F.when(c.rlike(f"[A-Za-z0-9_.~{safe}-]"), c).when(c == "*", "%2A").otherwise(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")))), "")

    root, path, asked, mark = (F.regexp_extract(url, parts, i) for i in (1, 2, 3, 4))
    return F.concat(root, quoted(path, "/%+"), quoted(asked, "?=&%+"), mark)


def topic_hash(content) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))
