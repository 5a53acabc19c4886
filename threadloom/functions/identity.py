"""Identity expressions (F1-F8): Message-ID, thread key, content hash, message key, uuid5.

All are plain Column expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Trim Unicode white space (and the four separator controls) at both ends."""
    return F.regexp_replace(c, rf"(?U)^{_WS}+|{_WS}+$", "")


def normalize_message_id(c: Column) -> Column:
    """F1. Trimmed id without one pair of angle brackets; null becomes ''."""
    bare = strip(F.coalesce(c, F.lit("")))
    return strip(F.regexp_replace(bare, r"(?s)^<(.*)>$", "$1"))


def subject_slug(c: Column) -> Column:
    """F2. Subject without any depth of reply/forward prefixes, one space between words, lower case."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?iU)^{_WS}*(?:(?:re|fwd|fw){_WS}*:{_WS}*)+", "")
    return F.lower(strip(F.regexp_replace(bare, rf"(?U){_WS}+", " ")))


def strip_one_prefix(c: Column) -> Column:
    """F2, second variant: a single leading prefix is dropped."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^\s*(re|fwd|fw)\s*:\s*", "")


def _first_token(c: Column) -> Column:
    return F.split(strip(c), rf"(?U){_WS}+").getItem(0)


def thread_id(message_id: Column, in_reply_to: Column, references: Column, subject: Column) -> Column:
    """F3. First reference, else first in-reply-to token, else own id; subject slug when all are empty."""
    blank = F.lit("")
    refs = strip(F.coalesce(references, blank))
    parent = F.coalesce(in_reply_to, blank)
    root = (
        F.when(refs != "", _first_token(refs))
        .when(parent != "", F.coalesce(_first_token(parent), blank))
        .otherwise(F.coalesce(message_id, blank))
    )
    key, slug = normalize_message_id(root), subject_slug(subject)
    return F.when(key != "", key).when(slug != "", F.concat(F.lit("subj:"), slug)).otherwise("")


def norm_inline(c: Column) -> Column:
    """F4. White space runs collapsed, ends trimmed."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U){_WS}+", " "))


def norm_body(c: Column) -> Column:
    """F4. CRLF and CR to LF, every line right-trimmed, ends trimmed."""
    lf = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    return strip(F.regexp_replace(lf, r"(?Um)[\s\x1c-\x1f&&[^\n]]+$", ""))


def content_sha256(sender: Column, subject: Column, date_iso: Column, body: Column) -> Column:
    """F5. sha256 over NUL-joined normalised fields; the Message-ID is left out on purpose."""
    parts = [norm_inline(sender), norm_inline(subject), F.coalesce(date_iso, F.lit("")), norm_body(body)]
    return F.sha2(F.concat_ws("\0", *parts), 256)


def message_key(message_id: Column, content_hash: Column, limit: int = 998) -> Column:
    """F5. Normalised id, else content hash; an id over ``limit`` code points is hashed, never cut."""
    mid = normalize_message_id(message_id)
    key = F.when(mid != "", mid).otherwise(content_hash)
    return F.when(F.length(key) > limit, F.concat(F.lit("mid-sha256:"), F.sha2(key, 256))).otherwise(key)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """F6. RFC 4122 version 5 over a 32-digit namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    # the variant digit is 8..b: its two low bits come from the digest
    variant = F.lit("89ab89ab89ab89ab")
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant.substr(nibble + 1, F.lit(1)), F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def truncate(c: Column, n: int) -> Column:
    """F8. At most ``n`` code points, the last three being dots when something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def policy_fingerprint(*parts: Column) -> Column:
    """F7. First 16 hex digits of the joined policy settings."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
