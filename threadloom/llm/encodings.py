"""Problem 7: text that was decoded with the wrong character encoding.

For every pair (written, read) of encodings and every character that mail texts use, the garbled
sequence is computed beforehand.  One multi-pattern automaton finds all of them in a text; only
the matched spans are replaced, so correct text beside them stays as it is.  Text garbled twice is
repaired by a second round over the result.  Pairs of which a correct text of another language may hold the
sequences (one character for one, double-byte and Cyrillic ones) are replaced only where the corpus speaks for it:
the letter groups that the repair makes must be commoner in all other texts than those it removes.  U+FFFD marks text whose bytes are lost: the field is
reported, and what stands there is kept.

Defined results: null, empty and correct texts are unchanged and not reported; very long texts are
searched whole, in linear time; a text may hold garbled and correct spans side by side.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.runtime import materialise

#: Encodings in which UTF-8 bytes are wrongly read.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp1251", "cp1250", "cp437", "cp850", "iso8859-15", "iso8859-2", "koi8-r")
#: Double-byte encodings whose bytes are wrongly read as one of the Western single-byte ones.
DOUBLE_BYTE = (("euc_kr", "cp1252"), ("euc_kr", "latin-1"), ("euc_kr", "mac_roman"), ("euc_kr", "cp1251"), ("euc_kr", "cp437"))
LOST = "�"


def _decode_byte(b: int, enc: str) -> str:
    """One byte read in ``enc``; bytes it leaves undefined come out as C1 controls, as mail software does."""
    try:
        return bytes([b]).decode(enc)
    except UnicodeDecodeError:
        return chr(b)


@lru_cache(maxsize=None)
def _table(enc: str) -> list[str]:
    return [_decode_byte(b, enc) for b in range(256)]


def garble(text: str, written: str = "utf-8", read: str = "cp1252") -> str:
    return "".join(_table(read)[b] for b in text.encode(written))


def alphabet() -> list[str]:
    """Characters that mail texts of the supported languages hold: Latin letters and signs, typography, symbols, Hangul, kana, emoji."""
    ranges = [(0x80, 0x17F), (0x192, 0x192), (0x2C6, 0x2C6), (0x2DC, 0x2DC), (0x2010, 0x2027), (0x2030, 0x203A), (0x20AC, 0x20AC), (0x2116, 0x2122), (0x2190, 0x2193), (0x2500, 0x2501), (0x25A0, 0x25CF), (0x2600, 0x27BF), (0x3001, 0x3002), (0x3041, 0x30FE), (0xAC00, 0xD7A3), (0xFE0F, 0xFE0F), (0x1F300, 0x1F6FF), (0x1F900, 0x1F9FF), (0xFEFF, 0xFEFF)]
    return [chr(c) for a, b in ranges for c in range(a, b + 1)]


#: Single-byte text read in another single-byte encoding: one character for one, certain only in context.
SINGLE_BYTE = (("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"))
_CYRILLIC = {READ_AS.index("cp1251"), READ_AS.index("koi8-r")}
_BOX = set(map(chr, range(0x2500, 0x25A0)))
#: Read characters that no text of these languages has inside a word.
_ODD = set("³²¹´¯÷¾½¼·¨¸¶§þðòìå¤ƒˆ˜‰‡†„‚ﬂﬁΘΣτπαΦΩφεΓδ∩⌠≤≥ⁿ±√∞∂∑∏∫")


#: Letters of none of these languages.
_FOREIGN = set("ÒòÞþÐðÝýØøÅåÌìÆ")


#: A letter beyond ASCII with its ASCII neighbours, a sign, or a Hangul syllable: what the corpus is counted by.
GROUP = r"[a-z]?[\u0080-\u05ff\u1e00-\u25ff\ufb01\ufb02][a-z]?|[가-힣]"
_GROUP = re.compile(GROUP)


class Evidence:
    """Counts of letter groups in ``all`` texts and in the ``clean`` ones, in which nothing looks garbled; bounded by alphabets, not by the corpus."""

    def __init__(self, all: dict[str, int], clean: dict[str, int]):
        self.all, self.clean = all, clean

    def speaks_for(self, text: str, repaired: str) -> bool:
        """Whether the groups that a repair makes are at least twice as common, on a logarithmic mean, in clean texts as those it removes in all others."""
        was, now = Counter(_GROUP.findall(text.lower())), Counter(_GROUP.findall(repaired.lower()))
        lost, made = was - now, now - was
        if not made:
            return False
        before = sum(k * log(1 + max(0, self.all.get(g, 0) - was[g])) for g, k in lost.items()) / max(1, lost.total())
        return sum(k * log(1 + self.clean.get(g, 0)) for g, k in made.items()) / made.total() > before + log(2)


def _groups(texts: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(texts), F.lit(GROUP), F.lit(0)), F.array().cast("array<string>"))


def corpus_evidence(df: DataFrame, fields: list[str], suspects: DataFrame) -> Evidence:
    """Evidence of all fields of all rows; ``suspects`` holds the ``text`` of those that look garbled."""
    count = lambda groups: {r["g"]: r["n"] for r in groups.groupBy("g").agg(F.count("*").alias("n")).collect()}
    whole = count(df.select(F.explode(F.concat(*[_groups(F.col(f).cast("string")) for f in fields])).alias("g")))
    odd = count(suspects.select(F.explode(_groups(F.col("text"))).alias("g")))
    return Evidence(whole, {g: n - odd.get(g, 0) for g, n in whole.items() if n > odd.get(g, 0)})


@lru_cache(maxsize=2)
def automaton(with_singles: bool = True):
    """Garbled sequence -> (length, {pair number: correct character})."""
    import ahocorasick

    words: dict[str, dict[int, str]] = {}

    def add(seq: str, pair: int, ch: str) -> None:
        if seq != ch and not seq.isascii():
            words.setdefault(seq, {}).setdefault(pair, ch)

    chars = alphabet()
    for pair, read in enumerate(READ_AS):
        t = _table(read)
        for ch in chars:
            add("".join(t[b] for b in ch.encode("utf-8")), pair, ch)
    for pair, (written, read) in enumerate(DOUBLE_BYTE, len(READ_AS)):
        t = _table(read)
        for c in range(0xAC00, 0xD7A4):
            try:
                raw = chr(c).encode(written)
            except UnicodeEncodeError:
                continue
            if len(raw) == 2:
                add("".join(t[b] for b in raw), pair, chr(c))
    for pair, (written, read) in enumerate(SINGLE_BYTE if with_singles else (), len(READ_AS) + len(DOUBLE_BYTE)):
        t = _table(read)
        for b in range(0x80, 0x100):
            if (ch := _table(written)[b]) != t[b] and ord(ch) > 0x9F:
                add(t[b], pair, ch)
    a = ahocorasick.Automaton()
    for seq, by in words.items():
        a.add_word(seq, (len(seq), by))
    a.make_automaton()
    return a


def _single_is_garbled(text: str, i: int, ch: str) -> bool:
    """Whether one character at ``i`` that could stand for ``ch`` cannot be meant."""
    g, before, after = text[i], text[i - 1 : i], text[i + 1 : i + 2]
    if g in _BOX:
        # a line of box characters is a drawing
        return before not in _BOX and after not in _BOX and not (ch.isalpha() and not (before.isalpha() or after.isalpha()))
    if ch.isalpha() or ch == "’":
        if g in _FOREIGN and before.isalpha() and before.isascii():
            return True
        if g.isalpha() and g.isupper():
            return before.islower() and (after.islower() or not after.isalpha()) and ord(before) < 0x250
        return g in _ODD and before.isalpha() and before.isascii() and after.isalpha() and after.isascii()
    if ch == "€":
        return g == "Ç" and after.isdigit()
    return ch == "–" and g == "û" and before == " " and after == " "


def _drawing(text: str, a: int, b: int) -> bool:
    """Whether the span is part of a line of box characters."""
    return all(c in _BOX for c in text[a:b]) and (text[a - 1 : a] in _BOX or text[b : b + 1] in _BOX)


def _apply(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, ch in spans:
        parts += [text[at:a], ch]
        at = b
    return "".join([*parts, text[at:]])


def _chosen(text: str, singles: bool = True, evidence: Evidence | None = None) -> list[tuple[int, int, str]]:
    """Non-overlapping garbled spans: pairs of encodings that explain more of the text come first, within a pair the leftmost.

    Without ``evidence`` form alone decides, which serves for reading a text but not for changing it.
    """
    by_pair: dict[int, list[tuple[int, int, str]]] = {}
    for end, (n, by) in automaton(singles).iter(text):
        for pair, ch in by.items():
            by_pair.setdefault(pair, []).append((end + 1 - n, end + 1, ch))
    ranked = []
    doubles, single = len(READ_AS), len(READ_AS) + len(DOUBLE_BYTE)
    for pair, hits in by_pair.items():
        hits.sort(key=lambda h: (h[0], -h[1]))
        kept, at = [], 0
        for h in hits:
            if h[0] >= at and (not _drawing(text, h[0], h[1]) if pair < single else _single_is_garbled(text, h[0], h[2])):
                kept.append(h)
                at = h[1]
        if doubles <= pair < single:
            kept = _runs(text, kept)
        # a Cyrillic letter before a sign is no word in any language
        uncertain = pair >= doubles or pair in _CYRILLIC and all(text[a:b].isalpha() for a, b, _ in kept)
        if kept and evidence and uncertain and not evidence.speaks_for(text, _apply(text, kept)):
            continue
        if kept:
            ranked.append((-sum(b - a for a, b, _ in kept), pair, kept))
    ranked.sort(key=lambda r: r[:2])
    out: list[tuple[int, int, str]] = []
    taken: set[int] = set()
    for _, _, kept in ranked:
        for a, b, ch in kept:
            if taken.isdisjoint(range(a, b)):
                taken.update(range(a, b))
                out.append((a, b, ch))
    return sorted(out)


def _runs(text: str, hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Two Western letters may stand together by right: pairs count where two of them adjoin and no ASCII letter is attached in front."""
    runs: list[list[tuple[int, int, str]]] = []
    for h in hits:
        if runs and runs[-1][-1][1] == h[0]:
            runs[-1].append(h)
        else:
            runs.append([h])
    ascii_letter = lambda c: c.isascii() and c.isalpha()
    free = lambda r: not ascii_letter(text[r[0][0] - 1 : r[0][0]]) and not ascii_letter(text[r[-1][1] : r[-1][1] + 1])
    if not any(len(r) >= 2 and free(r) for r in runs):
        return []
    return [h for r in runs for h in r]


def repair(text: str, rounds: int = 3, evidence: Evidence | None = None) -> tuple[str, int, bool]:
    """(restored text, spans replaced, whether some bytes are lost)."""
    n = 0
    for _ in range(rounds):
        spans = _chosen(text, evidence=evidence)
        if not spans:
            break
        n += len(spans)
        text = _apply(text, spans)
    return text, n, LOST in text


def suspicion() -> str:
    """Java regular expression that every text with a garbled sequence or lost bytes matches.

    It begins with one class of characters, which most of a text fails at once; what stands before and after is looked at only there.
    """
    escape = lambda chars: "".join(f"\\x{{{ord(c):x}}}" for c in sorted(set(chars)))
    parts = [f"(?<={LOST})"]
    for enc in READ_AS:
        t = _table(enc)
        parts.append(f"(?<=[{escape(t[0xC2:0xF5])}])[{escape(t[0x80:0xC0])}]")
    for _, enc in DOUBLE_BYTE:
        t = _table(enc)
        lead, trail = f"[{escape(t[0xB0:0xC9])}]", f"[{escape(t[0xA1:0xFF])}]"
        parts.append(f"(?<={lead}){trail}{lead}{trail}")
    # the single-byte pairs as _single_is_garbled has them: any upper-case letter that one of them reads
    upper = escape(c for _, read in SINGLE_BYTE for c in _table(read)[0x80:] if c.isalpha() and c.isupper())
    parts += ["(?<=[\\x{2500}-\\x{259f}])", f"(?<=[\\p{{Ll}}ªº][{upper}])", f"(?<=[A-Za-z][{escape(_ODD)}])[A-Za-z]", "(?<=Ç)\\p{N}", "(?<= û) ", f"(?<=[A-Za-z][{escape(_FOREIGN)}])"]
    return r"[^\x00-\x7f](?:" + "|".join(dict.fromkeys(parts)) + ")"


@lru_cache(maxsize=1)
def _lead_trail() -> tuple[re.Pattern, re.Pattern]:
    """A cheap and an exact test for a lead byte before a trail byte, as read in one of the encodings."""
    escaped = lambda chars: "".join(re.escape(c) for c in sorted(set(chars)))
    pairs = [("".join(_table(e)[0xC2:0xF5]), "".join(_table(e)[0x80:0xC0])) for e in READ_AS]
    cheap = f"[{escaped(''.join(a for a, _ in pairs))}][{escaped(''.join(b for _, b in pairs))}]"
    return re.compile(cheap), re.compile("|".join(f"[{escaped(a)}][{escaped(b)}]" for a, b in pairs))


def suspect(text: str) -> bool:
    """Whether a text may hold UTF-8 that was read in another encoding."""
    cheap, exact = _lead_trail()
    return bool(cheap.search(text) and exact.search(text))


def suspicious(c: Column) -> Column:
    return F.coalesce(c.rlike(suspicion()), F.lit(False))


def repair_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, restored, n_spans, lost) of every field of which some part was wrongly decoded; all rows are the evidence."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields])).alias("x")
    rows = df.select(F.col(key).cast("bigint").alias("_key"), pairs).select("_key", "x.field_name", "x.text").where(suspicious(F.col("text")))
    rows = materialise(rows, "suspects")
    evidence = corpus_evidence(df, fields, rows.select("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fixed = [repair(t, evidence=evidence) for t in b["text"]]
            out = b[["_key", "field_name"]].assign(restored=[f[0] for f in fixed], n_spans=[f[1] for f in fixed], lost=[f[2] for f in fixed])
            yield out[(out["n_spans"] > 0) | out["lost"]].astype({"n_spans": "int32"})

    return rows.mapInPandas(run, "_key bigint, field_name string, restored string, n_spans int, lost boolean").withColumnRenamed("_key", key)
