"""Problem 10: texts that were cut off by a field limit or during transfer.

Positives are made by cutting texts of the corpus at random places, at the lengths their source
shows as limits, and with what systems put after a cut; the corpus as it stands is the negative
class (it holds few cut texts, which a linear model outvotes).  A logistic regression over hashed
features of the closing characters, the last line, punctuation, the last word's corpus frequency and
the length against the source's limits scores every record.

Limits are lengths, in code points or bytes, that a source shows far more often than the lengths
around them; word frequencies and limits are counted over all documents.  All documents are fitted on as well, in
shards of about 20,000 by the hash of the id, whose models' mean scores the records; the threshold follows all scores.

Defined results: null, empty and white-space texts are never cut; very long texts count like others;
a null source is a source of its own; repeated rows are scored one by one; an empty table gives an
empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.linear import HashedLogistic, slot
from threadloom.runtime import materialise

#: What systems put after a cut.
SUFFIXES = ("...", "…")
NOTICES = (" [...]", " […]", "\n\n[View entire message]", "\n[message clipped]", " [truncated]", "\n[Message truncated]")
_NOTICE = re.compile(r"(?:\[[^\[\]\n]{1,40}\]|<[^<>@\n]{3,40}>)\Z")
NOTICE_CHARS = 42
_DOTS = re.compile(r"(\s?)(\.{3}|…)\Z")
_WORD = re.compile(r"[^\W_]+(?:[’'-][^\W_]+)*")
_TAIL_WORD = re.compile(r"[^\W_]+(?:[’'-][^\W_]+)*\Z")
_URL = re.compile(r"https?://\S+\Z")
_REF = re.compile(r"\([A-Z]{2,4}-\d+\)\Z")
_ITEM = re.compile(r"\s*(?:[-*•]|\d{1,3}[.)])\s")
_NAME = re.compile(r"(?:[-–—]\s)?[^\W\d_][\w'’-]*(?:\s[^\W\d_][\w.'’-]*){0,3}\Z")
_CLOSED = set(".!?。！？…:;")
SHORT_LINE = 60
_MARK = re.compile(r"^\s*(?:[-*•]|\d{1,3}[.)])?\s*")
#: White space within a line.
SPACES = " \t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LAST_WORD = r"([\p{L}\p{N}]+(?:[’'-][\p{L}\p{N}]+)*)"
#: ``strip_notice`` for Spark, on the last ``NOTICE_CHARS`` of a text without white space at its end.
ADDED = r"(?:\[[^\[\]\n]{1,40}\]|<[^<>@\n]{3,40}>|\.{3}|…)\z"


def _shape(token: str) -> str:
    out = ""
    for c in token:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "k" if c.isalpha() else c
        if k != out[-1:]:
            out += k
    return out[:12]


def strip_notice(text: str) -> tuple[str, str]:
    """Text without what a system may have put after a cut, and the kind of that."""
    text = text.rstrip()
    if text[-1:] in ("]", ">") and (m := _NOTICE.search(text, max(0, len(text) - NOTICE_CHARS))):
        return text[: m.start()].rstrip(), "notice"
    if text[-1:] in (".", "…") and (m := _DOTS.search(text, max(0, len(text) - 4))):
        return text[: m.start()].rstrip(), "spaced dots" if m[1] else "dots"
    return text, ""


def ending(text: str) -> str:
    """The last three lines and what was put after a cut: all that ``features`` reads of a text."""
    text = text.rstrip()
    body = strip_notice(text)[0]
    return "\n".join(body.rsplit("\n", 3)[-3:]) + text[len(body) :]


def last_word(text: str) -> str:
    """Word that a text ends with once notices are stripped; '' if it ends otherwise."""
    m = _TAIL_WORD.search(strip_notice(text)[0][-80:])
    return m[0].lower() if m else ""


def last_line(text: str) -> str:
    """Last line without list mark and notice, if it is short; '' otherwise."""
    line = strip_notice(text)[0].rsplit("\n", 1)[-1]
    line = _MARK.sub("", line).strip()
    return line if len(line) <= SHORT_LINE else ""


def _known(count: int) -> str:
    return "0" if not count else "1" if count < 3 else "2" if count < 10 else "3" if count < 100 else "4"


def features(text: str, at_chars: bool, at_bytes: bool, kind: str, count: int, lines_seen: int) -> np.ndarray:
    """Slots of one text.  ``at_*``: its length is a limit of its source; ``count``, ``lines_seen``: occurrences of its last word and last line inside texts."""
    body, mark = strip_notice(text)
    lines = body.rsplit("\n", 3)
    last, prev = lines[-1].strip("\r "), lines[-2].strip("\r ") if len(lines) > 1 else ""
    end = body[-1:]
    closed = end in _CLOSED
    words = _WORD.findall(last)
    token = last.split(" ")[-1]
    limit = "limit" if at_chars or at_bytes else "free"
    known, seen = _known(count), _known(lines_seen)
    tabs = last.count("\t")
    if not end:
        form = "empty"
    elif tabs or "\t" in prev:
        form = f"table{tabs == prev.count('\t') or last.startswith('Total')}{bool(re.search(r'[.,]\d\d\Z', last))}{last.startswith('Total')}"
    elif _URL.search(last):
        form = "url"
    elif _REF.search(last):
        form = "ref"
    elif _ITEM.match(last):
        form = "item" + ("closed" if closed else f"open{min(len(words), 6)}")
    elif closed:
        form = "closed"
    elif not end.isalnum():
        form = f"sign {end if ord(end) < 0x3000 else 'wide'}"
    elif len(words) <= 4 and _NAME.match(last) and len(lines) > 1:
        form = f"name{'comma' if prev[-1:] in ',，' else 'blank' if not prev else 'closed' if prev[-1:] in _CLOSED else 'other'}"
    elif len(lines) > 1 and not prev and len(words) <= 9:
        form = "short"
    else:
        form = "open"
    script = "hangul" if "가" <= end <= "힣" else "latin"
    parts = [
        f"form {form}", f"mark {mark}", f"limit {limit}", f"form {form} {mark}", f"form {form} {limit}", f"mark {mark} {limit}",
        f"closed {closed} {mark} {limit}", f"form {form} {known}", f"known {known}", f"known {known} {limit}", f"end {end}", f"shape {_shape(token)}",
        f"shape {_shape(token)} {form}", f"token {token.lower() if count >= 10 else known} {form}", f"words {min(len(words), 12)} {form}", f"kind {kind} {form}", f"script {script} {form} {known}",
        f"case {last[:1].isupper()} {form}", f"prev {prev[-1:]} {form}", f"len {min(len(last) // 10, 12)} {form}", f"both {form} {mark} {limit} {known}",
        f"seen {seen} {form}", f"seen {seen} {known} {form.rstrip('0123456789')} {limit} {mark}",
    ]
    return np.fromiter({slot(p) for p in parts}, np.int64)


def limits(docs: DataFrame, least: int = 5, times: float = 4.0) -> DataFrame:
    """(src, unit, n, is_limit): lengths a source shows ``least`` times or more and ``times`` as often as the 20 around them on average; copies of a text count once."""
    docs = docs.groupBy("src", F.xxhash64("text")).agg(F.first("_c").alias("_c"), F.first("_b").alias("_b"))
    lengths = docs.select("src", F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.col("_c").alias("n")), F.struct(F.lit("b").alias("unit"), F.col("_b").alias("n")))).alias("x")).select("src", "x.*")
    counted = lengths.groupBy("src", "unit", "n").agg(F.count("*").alias("c"))
    near = counted.select("src", "unit", F.explode(F.sequence(F.col("n") - 10, F.col("n") + 10)).alias("n"), "c").groupBy("src", "unit", "n").agg(F.sum("c").alias("around"))
    return (
        counted.where(F.col("c") >= least).join(near, ["src", "unit", "n"])
        .where(F.col("c") * 20 >= (F.col("around") - F.col("c")) * times)
        .select("src", "unit", "n", F.lit(True).alias("is_limit"))
    )


def _prepared(docs: DataFrame, key: str, text: str, source: str, kind: str) -> DataFrame:
    """Key, text, limit flags and last word's count of every document that has a text."""
    base = docs.select(F.col(key).cast("bigint").alias("_key"), F.coalesce(F.col(source), F.lit("\0")).alias("src"), F.coalesce(F.col(kind), F.lit("")).alias("kind"), F.col(text).alias("text")).where(F.col("text").rlike(r"\S"))
    base = base.withColumns({"_c": F.length("text"), "_b": F.octet_length("text")})
    found = materialise(limits(base), "limits")
    by = lambda unit, flag: found.where(F.col("unit") == unit).select("src", F.col("n").alias(f"_{unit}"), F.col("is_limit").alias(flag))
    base = base.join(by("c", "at_chars"), ["src", "_c"], "left").join(by("b", "at_bytes"), ["src", "_b"], "left")
    no = F.lit(False)
    return base.select("_key", "kind", "text", F.coalesce("at_chars", no).alias("at_chars"), F.coalesce("at_bytes", no).alias("at_bytes"))


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """(item, count) of all words that something follows in their text, and of all short lines that another line follows, led by a line feed.

    What a system put after a cut is no part of a text here, else a cut word would count as one inside its text.  Every expression is
    linear in the length of a text: no pattern can start anew inside a run that it has read.
    """
    trimmed = F.rtrim(F.col(text), F.lit(SPACES + "\n"))
    added = F.length(F.regexp_extract(F.right(trimmed, F.lit(NOTICE_CHARS)), ADDED, 0))
    t = F.when(added > 0, F.substring(trimmed, F.lit(1), F.length(trimmed) - added)).otherwise(F.col(text))
    all_words = F.regexp_extract_all(F.lower(t), F.lit(LAST_WORD), F.lit(1))
    # possessive, from a single letter on, so a run of white space is read once
    open_end = t.rlike(r"[\p{L}\p{N}][’'-]*+\s*+\z").cast("int")
    words = F.slice(all_words, F.lit(1), F.size(all_words) - open_end)
    lines = F.filter(F.split(t, "\n"), lambda l: F.btrim(l, F.lit(SPACES)) != "")
    before_last = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))
    bare = F.transform(before_last, lambda l: F.btrim(F.regexp_replace(F.btrim(l, F.lit(SPACES)), r"^(?:[-*•]|\d{1,3}[.)])?", ""), F.lit(SPACES)))
    short = F.transform(F.filter(bare, lambda l: (F.length(l) <= SHORT_LINE) & (l != "")), lambda l: F.concat(F.lit("\n"), l))
    return docs.where(F.col(text).isNotNull()).select(F.explode(F.concat(words, short)).alias("item")).groupBy("item").agg(F.count("*").alias("count"))


def _cut(text: str, rng: random.Random) -> tuple[str, bool] | None:
    """A text cut on purpose, and whether its length then passes for a limit."""
    body = strip_notice(text)[0]
    if len(body) < 40:
        return None
    at = rng.randrange(20, len(body) - 1)
    part = body[:at].rstrip()
    if part[-1:] in _CLOSED or part[-1:] == "\n":
        return None
    roll = rng.random()
    if roll < 0.3:
        return part + rng.choice(SUFFIXES), True
    if roll < 0.5:
        return part + rng.choice(NOTICES), False
    return part, roll < 0.75


def _counted(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Counts of each row's last word (n) and last line (m).

    About half of all texts end in no word or in no short line: their keys are spread over values that no item has.
    """
    nothing = F.concat(F.lit("\0"), F.pmod(F.xxhash64("_key"), F.lit(1 << 16)).cast("string"))
    rows = rows.withColumns({"word": F.when(F.col("word") == "", nothing).otherwise(F.col("word")), "line": F.when(F.col("line") == "\n", nothing).otherwise(F.col("line"))})
    words = vocab.select(F.col("item").alias("word"), F.col("count").alias("n"))
    lines = vocab.where(F.col("item").startswith("\n")).select(F.col("item").alias("line"), F.col("count").alias("m"))
    return rows.join(words, "word", "left").join(lines, "line", "left").select("_key", "kind", "text", "at_chars", "at_bytes", "y", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))


def fit(texts: list[np.ndarray], cuts: list[np.ndarray], keep: float = 0.3) -> HashedLogistic:
    """Model of intact against cut texts.  ``texts`` holds some cut ones: what a model fitted on the other half finds cut is left out of the final fit."""
    half = np.arange(len(texts)) % 2 == 0
    sure = np.zeros(len(texts), bool)
    for side in (half, ~half):
        rows = [texts[i] for i in np.flatnonzero(side)]
        m = HashedLogistic().fit(rows + cuts, np.repeat([0.0, 1.0], [len(rows), len(cuts)]), epochs=3)
        other = np.flatnonzero(~side)
        sure[other] = m.score([texts[i] for i in other]) < keep
    rows = [texts[i] for i in np.flatnonzero(sure)]
    return HashedLogistic().fit(rows + cuts, np.repeat([0.0, 1.0], [len(rows), len(cuts)]), epochs=6)


def _fitted(slots: DataFrame, n: int, shard: int) -> HashedLogistic:
    """Mean of the models of all shards of about ``shard`` documents, each slot's weight by how often a shard's rows hold it."""
    shards = max(1, -(-n // shard))

    def of_shard(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["_key", "y"], kind="stable")
        x, y = [np.asarray(v, np.int64) for v in b["x"]], b["y"].to_numpy()
        m = fit([x[i] for i in np.flatnonzero(y == 0)], [x[i] for i in np.flatnonzero(y == 1)])
        seen = np.bincount(np.concatenate(x), minlength=len(m.w))
        at = np.flatnonzero(seen)
        return pd.DataFrame({"slot": np.append(at, -1), "w": np.append(m.w[at], m.b).astype(float), "seen": np.append(seen[at], len(x))})

    of = F.pmod(F.xxhash64(F.lit("shard"), "_key"), F.lit(shards))
    parts = slots.groupBy(of.alias("_shard")).applyInPandas(of_shard, "slot long, w double, seen long")
    mean = parts.groupBy("slot").agg((F.sum(F.col("w") * F.col("seen")) / F.sum("seen")).alias("w")).toPandas()  # a row per slot at most
    out, real = HashedLogistic(), mean[mean["slot"] >= 0]
    out.w[real["slot"].to_numpy(np.int64)] = real["w"]
    out.b = float(mean["w"][mean["slot"] < 0].sum())
    return out


def cut_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", kind: str = "content_kind", shard: int = 20_000, seed: int = 11) -> DataFrame:
    """(key, score, is_cut) of every document with a text.

    The fit sees every document and, where it can be cut, a cut of it; a score counts as cut where its odds outweigh the share of
    cut texts that all documents together show.
    """
    base = _prepared(docs, key, text, source, kind)

    def with_cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, kd, t, c, by in zip(b["_key"], b["kind"], b["text"], b["at_chars"], b["at_bytes"]):
                out.append((k, kd, ending(t), c, by, last_word(t), "\n" + last_line(t), 0))
                if made := _cut(t, random.Random(int(k) * 31 + seed)):
                    out.append((k, kd, ending(made[0]), made[1], False, last_word(made[0]), "\n" + last_line(made[0]), 1))
            yield pd.DataFrame(out, columns=["_key", "kind", "text", "at_chars", "at_bytes", "word", "line", "y"])

    def as_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [features(*r).astype(np.int32) for r in zip(b["text"], b["at_chars"], b["at_bytes"], b["kind"], b["n"], b["m"])]
            yield pd.DataFrame({"_key": b["_key"], "y": b["y"], "x": x})

    schema = "_key bigint, kind string, text string, at_chars boolean, at_bytes boolean, word string, line string, y int"
    vocab = materialise(vocabulary(docs, text), "vocabulary")
    # from here on only the endings of texts travel, then only their slots
    counted = _counted(base.mapInPandas(with_cuts, schema), vocab)
    slots = materialise(counted.mapInPandas(as_slots, "_key bigint, y int, x array<int>"), "slots")
    rows = slots.where("y = 0").select("_key", "x")
    model = _fitted(slots, rows.count(), shard)
    weights, bias = model.w, model.b

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = HashedLogistic(weights, bias)
        for b in batches:
            yield pd.DataFrame({"_key": b["_key"], "score": m.score([np.asarray(v, np.int64) for v in b["x"]])})

    scores = materialise(rows.mapInPandas(score, "_key bigint, score double"), "scores")
    share = scores.agg(F.avg((F.col("score") > 0.5).cast("int"))).first()[0]
    threshold = 1 - min(max(0.5 if share is None else share, 0.01), 0.5)
    return scores.select(F.col("_key").alias(key), "score", (F.col("score") >= threshold).alias("is_cut"))
