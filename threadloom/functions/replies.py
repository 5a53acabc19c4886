"""Reply chains, bulk headers, judge replies and provenance."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ORIGINAL = re.compile(r"^\s*[-_=]{3,}\s*(?:original message|forwarded message|ursprüngliche nachricht|message d.origine|mensaje original|mensagem original|원본 메시지|原始邮件|元のメッセージ|pesan asli)\b.*$", re.I)
_WROTE = re.compile(r"^(?:on|am|le|el|em|il|pada|vào)?\b.{0,120}(?:wrote|schrieb|a écrit|escribió|escreveu|ha scritto|작성|写道|のメール|เขียนว่า|đã viết|menulis)\s?.{0,80}[:：]\s*$", re.I)
_FIELD = re.compile(r"^\s*\*?(?:from|von|de|da|보낸\s?사람|发件人|差出人|จาก|từ|dari)\s?[:：]", re.I)
_NEXT = re.compile(r"^\s*\*?(?:sent|date|to|subject|gesendet|an|betreff|envoyé|objet|enviado|para|asunto|assunto|보낸\s?날짜|제목|发送时间|主题|件名)\s?[:：]", re.I)


def _separator(lines: list[str], i: int) -> int:
    """Number of lines of a separator that begins at line i; 0 where none does."""
    line = lines[i]
    if _ORIGINAL.match(line) or (_WROTE.match(line) and re.search(r"\d|@", line)):
        return 1
    if i + 1 < len(lines) and re.search(r"\d|@", line) and _WROTE.match(f"{line} {lines[i + 1]}"):
        return 2
    if _FIELD.match(line) and any(_NEXT.match(x) for x in lines[i + 1 : i + 4]):
        return 1
    return 0


def without_reply_chain(text: str | None) -> str | None:
    """F15. What stands above the first separator; if nothing does, what follows the quoted lines below it."""
    if text is None:
        return None
    lines = text.replace("\r\n", "\n").split("\n")
    for i in range(len(lines)):
        if n := _separator(lines, i):
            above = "\n".join(x for x in lines[:i] if not x.startswith(">")).strip()
            if above:
                return above
            below = [x for x in lines[i + n :] if not x.startswith(">")]
            return "\n".join(below).strip() or text.strip()
    return "\n".join(x for x in lines if not x.startswith(">")).strip() or text.strip()


@F.pandas_udf(T.StringType())
def strip_reply_chain(s: pd.Series) -> pd.Series:
    return s.map(without_reply_chain, na_action="ignore")


def header_values(headers: Column, name: str) -> Column:
    """Values of a header, regardless of case, in order; of an array of name-value structs."""
    return F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), lambda h: F.coalesce(h["value"], F.lit("")))


def header_value(headers: Column, name: str) -> Column:
    """First value of a header; null where it is missing."""
    return F.get(header_values(headers, name), F.lit(0))


#: Hosts whose unsubscribe links a group relay adds itself.
RELAY_HOSTS = ("googlegroups.com", "groups.google.com")


def _under(host: Column, domain: Column) -> Column:
    """Whether a host is a domain or below it."""
    bare = lambda c: F.lower(F.btrim(c, F.lit(". ")))
    h, d = bare(host), bare(domain)
    return (d != "") & ((h == d) | F.endswith(h, F.concat(F.lit("."), d)))


def final_domain(headers: Column) -> Column:
    """Domain of a Delivered-To above every Received header, which only the server of final delivery writes; '' where there is none."""
    first = F.get(F.filter(headers, lambda h: F.lower(h["name"]).isin("received", "delivered-to")), F.lit(0))
    return F.when(F.lower(first["name"]) == "delivered-to", F.regexp_extract(F.coalesce(first["value"], F.lit("")), r"@([^\s<>@,;]+)", 1)).otherwise("")


def is_bulk(headers: Column) -> Column:
    """P5. Any bulk precedence; else an unsubscribe link or list precedence, unless a list on the mailbox's own domain relays the mail and every unsubscribe link is the relay's own."""
    precedence = F.transform(header_values(headers, "Precedence"), lambda v: F.lower(F.trim(v)))
    links = header_values(headers, "List-Unsubscribe")
    marked = (F.size(links) > 0) | F.coalesce(F.get(precedence, F.lit(0)) == "list", F.lit(False))
    own = final_domain(headers)
    listed = F.coalesce(header_value(headers, "List-Id"), F.lit(""))
    angle = F.regexp_extract(listed, "<([^<>]+)>", 1)
    relayed = _under(F.when(angle != "", angle).otherwise(listed), own)

    def foreign(link: Column) -> Column:
        hosts = F.regexp_extract_all(link, F.lit(r"(?:@|://)([A-Za-z0-9.-]+)"), F.lit(1))
        allowed = lambda h: _under(h, own) | _under(h, F.lit(RELAY_HOSTS[0])) | _under(h, F.lit(RELAY_HOSTS[1]))
        return (F.size(hosts) == 0) | F.exists(hosts, lambda h: ~allowed(h))

    return F.array_contains(precedence, "bulk") | (marked & (~relayed | F.exists(links, foreign)))


def json_reply(c: Column) -> Column:
    """F37. Struct (summary, is_noise, confidence, reason) of a model's reply: fences go, the outermost braces are parsed, single fields are rescued; confidence in [0, 1]."""
    body = F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    j = F.from_json(body, "summary string, is_noise boolean, confidence double, reason string")
    raw = F.coalesce(c, F.lit(""))
    noise = F.regexp_extract(raw, r'(?i)"is_noise"\s*:\s*(true|false)', 1)
    conf = F.regexp_extract(raw, r'"confidence"\s*:\s*([\d.]+)', 1)
    confidence = F.coalesce(j["confidence"], F.when(conf != "", conf.cast("double")), F.lit(0.0))
    summary = F.coalesce(j["summary"], F.nullif(F.regexp_extract(raw, r'"summary"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit("")))
    return F.struct(summary.alias("summary"), F.coalesce(j["is_noise"], F.when(noise != "", F.lower(noise) == "true")).alias("is_noise"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"), j["reason"].alias("reason"))


def grade(c: Column) -> Column:
    """F38. The figure 0 to 3 that follows the word grade, else the first digit of all, at most 3; 0 where there is none."""
    found = [F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit("")) for p in (r"(?i)grade\"?\s*[:=]\s*([0-3])", r"(?i)grade\D{0,5}([0-3])", r"([0-9])")]
    digit = F.coalesce(*found).cast("int")
    return F.when(digit > 3, 3).otherwise(F.coalesce(digit, F.lit(0)))


def valid(c: Column) -> Column:
    """F39. A verdict counts only if it clearly says so."""
    return F.coalesce(F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), "valid boolean")["valid"], F.lit(False))


def endpoint_source(url: Column) -> Column:
    """F51. 'local' for loop-back hosts, else 'remote'."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z]+://(?:[^@/]*@)?(\[[^\]]*\]|[^:/]+)", 1)
    return F.when(host.isin("localhost", "127.0.0.1", "[::1]", "0.0.0.0"), "local").otherwise("remote")


#: Whole folder names, in lower case, and their roles.
ROLES = {
    "inbox": "inbox", "sent": "sent", "sent messages": "sent", "sent items": "sent", "sent mail": "sent", "archive": "archive", "all mail": "archive", "drafts": "drafts", "junk": "junk",
    "junk e-mail": "junk", "spam": "junk", "bulk mail": "junk", "trash": "trash", "deleted messages": "trash", "deleted items": "trash", "bin": "trash",
}
#: Special-use attributes (RFC 6154) and their roles.
FLAG_ROLES = {"\\inbox": "inbox", "\\sent": "sent", "\\archive": "archive", "\\all": "archive", "\\drafts": "drafts", "\\junk": "junk", "\\trash": "trash"}


def folder_role(name: Column, flags: Column, overrides: dict[str, str] | None = None) -> Column:
    """F52. A user's own role for the name, else the first known flag's, else the whole name's, else 'other'; a sub-folder of an inbox is none."""
    lookup = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    for k, v in (overrides or {}).items():
        if v.lower() not in {*ROLES.values(), "other"}:
            raise ValueError(f"unknown role {v!r} of folder {k!r}")
    own = F.element_at(lookup({k.lower(): v.lower() for k, v in overrides.items()}), F.lower(name)) if overrides else F.lit(None).cast("string")
    flagged = F.get(F.filter(F.transform(flags, lambda f: F.element_at(lookup(FLAG_ROLES), F.lower(f))), lambda r: r.isNotNull()), F.lit(0))
    return F.coalesce(own, flagged, F.element_at(lookup(ROLES), F.lower(F.trim(name))), F.lit("other"))
