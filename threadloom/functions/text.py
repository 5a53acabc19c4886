"""Scalar text expressions (F16-F29, F42-F51) and the few that need Python."""

from __future__ import annotations

import html
import re
from functools import lru_cache
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.identity import strip

#: Lengths from which an unbroken run counts as an encoded payload.
RUN_WITHOUT_SLASH, RUN_WITH_SLASH = 200, 300
#: Bounds of a removable signature and of the body that must remain.
SIGNATURE_CHARS, SIGNATURE_LINES, BODY_LEFT = 600, 12, 40
#: Magnitude words of figures in text.
MAGNITUDES = {"k": 3, "thousand": 3, "m": 6, "mm": 6, "mn": 6, "million": 6, "b": 9, "bn": 9, "billion": 9, "t": 12, "tn": 12, "trillion": 12}
#: Query parameters that only track.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name utm_brand utm_social fbclid gclid dclid gbraid wbraid msclkid yclid twclid "
    "mc_cid mc_eid ml_subscriber _hsenc _hsmi hsctatracking vero_conv vero_id ck_subscriber_id _branch_match_id ref_src s_cid icid spm"
).split()
#: Signs at an address's end that belong to the sentence.
SENTENCE_SIGNS = ".,;:!?"
#: RFC 2397: a media type, parameters, the base64 marker and the payload.
DATA_URI = r"(?i)data:[\w.+/-]{0,128}(?:;[\w-]+=[\w.-]+)*;base64,[a-z0-9+/]+={0,2}"


def strip_encoded_blobs(c: Column) -> Column:
    """F16. Data URIs first, then long runs with and without slashes."""
    c = F.regexp_replace(c, DATA_URI, " ")
    c = F.regexp_replace(c, rf"[A-Za-z0-9+/]{{{RUN_WITH_SLASH},}}={{0,2}}", " ")
    return F.regexp_replace(c, rf"[A-Za-z0-9+]{{{RUN_WITHOUT_SLASH},}}={{0,2}}", " ")


def strip_signature(c: Column) -> Column:
    """F18. The part from the only ``--`` line on, if it is small and enough remains."""
    cut = F.regexp_count(c, F.lit(r"\n--[ \t]*\n"))
    kept = F.substring_index(F.regexp_replace(c, r"\n--[ \t]*\n", "\u0001"), "\u0001", 1)
    removed = F.substring(c, F.length(kept) + 1, F.length(c))
    small = (F.length(removed) <= SIGNATURE_CHARS) & (F.length(removed) - F.length(F.translate(removed, "\n", "")) <= SIGNATURE_LINES)
    return F.when((cut == 1) & small & (F.length(strip(kept)) >= BODY_LEFT), kept).otherwise(c)


def trim_lines(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?m)(?<![ \t])[ \t]++$", ""), r"\n{3,}", "\n\n"))


def normalize_whitespace(c: Column) -> Column:
    """F19. Line ends trimmed, horizontal runs to one space, at most one blank line."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?m)(?<![ \t])[ \t]++$", ""), r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


_ADDRESS = r"https?://[^\s\"'<>)]+"
_URL = re.compile(_ADDRESS)


@lru_cache(maxsize=1 << 14)
def clean_url(url: str) -> str:
    """An address without tracking parameters, its query written anew; as it is where it has none or cannot be read."""
    bare = url.rstrip(SENTENCE_SIGNS)
    try:
        parts = urlsplit(bare)
        pairs = parse_qsl(parts.query, keep_blank_values=True) if parts.query else None
    except ValueError:
        return url
    if pairs is None:
        return url
    query = urlencode([(k, v) for k, v in pairs if k.lower() not in TRACKING])
    return urlunsplit(parts._replace(query=query)) + url[len(bare) :]


@F.pandas_udf(T.StringType())
def _addresses_cleaned(s: pd.Series) -> pd.Series:
    return s.map(lambda t: _URL.sub(lambda m: clean_url(m[0]), t), na_action="ignore")


def strip_tracking(c: Column) -> Column:
    """F17. Tracking parameters out of the addresses of a text; only texts that have an address with a query leave the JVM."""
    return F.coalesce(_addresses_cleaned(F.when(c.contains("http") & c.contains("?"), c)), c)


def clean_body(c: Column) -> Column:
    """F19. Blobs, tracking, line ends, signature, white space, in this order; idempotent."""
    return normalize_whitespace(strip_signature(trim_lines(strip_tracking(strip_encoded_blobs(c)))))


_DROP = re.compile(r"(?is)<(script|style|head|title)\b.*?</\1\s*>|<!--.*?-->")
_BLOCK = re.compile(r"(?i)</?(?:p|div|br|tr|li|ul|ol|h[1-6]|table|blockquote|section|article|hr)\b[^>]*>")
_TAG = re.compile(r"(?s)<[a-zA-Z/!?][^>]*>")


def html_text(markup: str | None) -> str | None:
    """F14. Text of HTML: block tags break lines, scripts and comments go, entities are resolved."""
    if markup is None:
        return None
    text = html.unescape(_TAG.sub("", _BLOCK.sub("\n", _DROP.sub(" ", markup))))
    lines = (re.sub(r"[ \t\xa0]+", " ", line).strip() for line in text.splitlines())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


@F.pandas_udf(T.StringType())
def html_to_text(s: pd.Series) -> pd.Series:
    return s.map(html_text, na_action="ignore")


def numeric_tokens(c: Column) -> Column:
    """F21. Canonical integers of figures that carry a comma, a decimal part or a magnitude; ordered, each once."""
    pattern = r"(?<![\w.])((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:\s*[A-Za-z]{1,8})?)"
    power = F.create_map(*[F.lit(x) for kv in MAGNITUDES.items() for x in kv])

    def canonical(m: Column) -> Column:
        core = F.translate(F.regexp_extract(m, r"^[\d,]+", 0), ",", "")
        frac = F.regexp_extract(m, r"\.(\d+)", 1)
        exp = F.coalesce(F.element_at(power, F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1))), F.lit(0))
        marked = m.contains(",") | (frac != "") | (exp > 0)
        rest = F.substring(F.rpad(frac, 12, "0"), F.lit(1), exp)
        exact = F.regexp_replace(F.substring(F.rpad(frac, 40, "0"), exp + 1, F.lit(40)), "0", "") == ""
        digits = F.regexp_replace(F.concat(core, rest), r"^0+(?=\d)", "")
        return F.when(marked & exact, digits)

    found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), canonical)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def augment_numeric(c: Column) -> Column:
    """F21. Text followed by its canonical figures."""
    t = numeric_tokens(c)
    return F.when(F.size(t) > 0, F.concat(c, F.lit("\n"), F.array_join(t, " "))).otherwise(c)


def estimate_tokens(c: Column) -> Column:
    """F25. A quarter of the code points."""
    return F.floor(F.length(c) / 4).cast("int")


def count_tokens(c: Column) -> Column:
    """F25. Words and single signs."""
    return F.regexp_count(c, F.lit(r"(?U)\w+|[^\w\s]"))


def lexical_overlap(query: Column, text: Column) -> Column:
    """F29. Share of the query's ASCII words that the text has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    q = words(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, words(text))) / F.size(q))


def sender_domain(c: Column) -> Column:
    """F42."""
    return F.regexp_extract(F.lower(c), r"@([\w.\-]+)", 1)


def transcription(c: Column) -> Column:
    """F45. Text without the description that a model puts before what it read."""
    return F.regexp_replace(c, r"(?is)^\s*DESCRIPTION:.*?\bTEXT:\s*", "")


def measure(c: Column) -> Column:
    """F44. Struct of characters, words of two ASCII letters or more, different words and digits of a transcription."""
    t = strip(transcription(F.coalesce(c, F.lit(""))))
    words = F.regexp_extract_all(t, F.lit("[A-Za-z]{2,}"), F.lit(0))
    different = F.array_distinct(F.transform(words, F.lower))
    return F.struct(F.length(t).alias("chars"), F.size(words).alias("words"), F.size(different).alias("unique_words"), F.regexp_count(t, F.lit(r"\p{Nd}")).alias("digits"))


def mime_base(c: Column) -> Column:
    """F46. Type without parameters, lower case."""
    return F.lower(F.trim(F.split_part(F.coalesce(c, F.lit("")), F.lit(";"), F.lit(1))))


def printable(c: Column) -> Column:
    """F47. Control characters as question marks."""
    return F.regexp_replace(c, r"\p{Cntrl}", "?")


def cadence_seconds(c: Column) -> Column:
    """F48. '12h', '30m', '7d', '90s' in seconds; null otherwise."""
    unit = F.create_map(*[F.lit(x) for kv in {"s": 1, "m": 60, "h": 3600, "d": 86400}.items() for x in kv])
    n = F.regexp_extract(F.lower(F.trim(c)), r"^(\d+)\s*([smhd])$", 1)
    return F.when(n != "", n.cast("bigint") * F.element_at(unit, F.regexp_extract(F.lower(F.trim(c)), r"([smhd])$", 1)))


def safe_name(c: Column) -> Column:
    """F41. File-system safe form with a digest, so different names stay different."""
    return F.concat(F.substring(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), 1, 80), F.lit("-"), F.substring(F.sha2(c, 256), 1, 12))


def line_snippets(body: Column, literal: str, width: int = 200, most: int = 20) -> Column:
    """F27, L8. Lines that contain a literal, regardless of case, cut to ``width`` code points around it."""
    low = literal.lower()
    hits = F.filter(F.split(body, "\n"), lambda l: F.contains(F.lower(l), F.lit(low)))

    def window(l: Column) -> Column:
        start = F.greatest(F.lit(1), F.instr(F.lower(l), low) - (width - len(literal)) // 2)
        return F.trim(F.substring(l, start, F.lit(width)))

    return F.slice(F.transform(hits, window), 1, most)


def calendar_field(c: Column, name: str) -> Column:
    """F20. First value of an iCalendar property."""
    return F.trim(F.regexp_extract(c, rf"(?m)^{name}[^:\n]*:([^\r\n]*)", 1))


def is_calendar(c: Column) -> Column:
    """P10."""
    return F.coalesce(F.contains(c, F.lit("BEGIN:VCALENDAR")), F.lit(False))
