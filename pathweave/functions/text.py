"""String functions; all of them are built-in expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces that may be shortened.
NAMESPACES = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "skos": "http://www.w3.org/2004/02/skos/core#"}


def local_name(url: Column) -> Column:
    """Text after the last ``/`` or ``#``, and of that the first run without digits; empty if there is none."""
    return F.regexp_extract(F.regexp_extract(url, r"([^/#]+)$", 1), r"([^0-9]+)", 1)


def first_word(x: Column) -> Column:
    return F.regexp_extract(x, r"([A-Za-z]+)", 1)


def count_literal(text: Column, part: Column) -> Column:
    """How often ``part`` stands in ``text``, without overlap; 0 for the empty part."""
    n = F.length(part)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / n).cast("int")).otherwise(F.when(text.isNotNull(), 0))


def strip_prefix(x: Column, prefix: str) -> Column:
    return F.when(x.startswith(prefix), F.substring(x, len(prefix) + 1, 1 << 30)).otherwise(x)


def escape_quotes(x: Column) -> Column:
    """Backslashes and double quotes preceded by a backslash."""
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def url_encode(x: Column) -> Column:
    """Form encoding: line ends as CR LF, all but letters and digits as %XX, blanks as ``+``."""
    y = F.url_encode(F.regexp_replace(x, "\r?\n", "\r\n"))
    for c, code in ((".", "%2E"), ("-", "%2D"), ("_", "%5F"), ("*", "%2A")):
        y = F.replace(y, F.lit(c), F.lit(code))
    return y


def url_decode(x: Column) -> Column:
    """Percent decoding that leaves ``+`` alone; null if the text cannot be decoded."""
    return F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def compact_uri(x: Column, namespaces: dict[str, str] = NAMESPACES) -> Column:
    """``prefix:name`` for known namespaces, as it is if already so, else ``<x>``."""
    out = F.when(x.rlike("^(" + "|".join(namespaces) + "):"), x)
    for p, uri in namespaces.items():
        out = out.when(x.startswith(uri), F.concat(F.lit(p + ":"), strip_prefix(x, uri)))
    return out.otherwise(F.concat(F.lit("<"), x, F.lit(">")))


def split_pair(x: Column, sep: str = "@") -> tuple[Column, Column]:
    return F.split_part(x, F.lit(sep), F.lit(1)), F.split_part(x, F.lit(sep), F.lit(2))


def side_suffix(x: Column) -> Column:
    """L or R of ``node@L``; empty if there is none."""
    return F.regexp_extract(x, r"@(\w)$", 1)


def unordered_key(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit(","), F.greatest(a, b))


def one_space(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def words(x: Column) -> Column:
    """The words between white space, in order."""
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def distinct_words(x: Column) -> Column:
    return F.array_distinct(words(x))


def lines(x: Column) -> Column:
    """Non-empty lines."""
    return F.filter(F.split(x, "[\r\n]+"), lambda w: w != "")


def data_url(page: Column) -> Column:
    """Address of the RDF document of a page."""
    return F.concat(F.replace(page, F.lit("/page"), F.lit("/data")), F.lit(".rdf"))


def resource_url(page: Column) -> Column:
    return F.replace(page, F.lit("/page"), F.lit("/resource"))


def bgp_text(query: Column) -> Column:
    """Triple patterns of a query: what stands between ``{`` and FILTER (or the last ``}``), without angle brackets."""
    body = F.regexp_extract(query, r"(?s)\{(.*?)(?:FILTER|\}\s*(?:LIMIT\s+\d+\s*)?$)", 1)
    return F.trim(F.translate(body, "<>", ""))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def wiki_title(html: Column) -> Column:
    """Title of the linked article: the last step of the address in the ``hreflang`` link, decoded."""
    return F.replace(url_decode(F.regexp_extract(html, r'<a [^>]*href="[^"]*/wiki/([^"]+)"[^>]*hreflang="en"', 1)), F.lit("_"), F.lit(" "))


def comma_items(x: Column) -> Column:
    """Non-empty items between commas."""
    return F.filter(F.split(x, ","), lambda w: w != "")


def key_head(x: Column) -> Column:
    """The part of a pattern key up to its first ``}:``, the brace included; empty if there is none."""
    return F.regexp_extract(x, r"(?s)^(.*?\})(?=:)", 1)
