"""Problem 6: personal data inside free text, found and replaced by typed placeholders.

High-recall generators propose overlapping spans: mail addresses in plain and spelled-out form, runs of
digits, street addresses, and runs of name parts.
Boosted trees score every candidate by its format and its surroundings; a span counts where its score
reaches a threshold calibrated on held-out candidates.  Of overlapping spans the street wins over the
mail address, that over numbers, numbers over names, and longer over shorter.

The lexicon of name parts is counted over the headers and bodies of all e-mails.  A capitalised word that no header
has is a name part too where it directly follows a known first name, or leads a known family name, in at least half of
its occurrences in all bodies.  A run of capitalised words of which none is known is proposed as well: a model of its own, which
sees no list but the words around it, the line and the run's shape, is taught by the runs that the lexicon does explain, with their
entries hidden; its threshold is the lowest at which ``UNLISTED_PRECISION`` of held-out runs it accepts are names.  The trees are fitted on at most ``sample`` e-mails
(default 6,000, those with the smallest hash of the id).  The annotation they learn from comes from cues beside a
candidate ("call", "identity number", "part no.") and from header structure.
Wrongly decoded text is repaired first and spans are mapped back, so ``pii_text`` is as stored.

Defined results: null and empty fields hold nothing; a text that occurs twice in a field is one row; long
texts are searched whole; repeated rows are searched one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.boost import Boosted
from threadloom.llm.encodings import _chosen, suspect
from threadloom.llm.sampling import bounded_sample, portions

TYPES = ("street", "email", "phone", "id_number", "name")
_UP = "A-ZÀ-ÖØ-ÞŁŚŠŽŒ"
_W = r"[^\W\d_]"
_WORDS = rf"[{_UP}](?:{_W}|[’'-](?={_W}))*"
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+'=$-"
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_DIGITS = re.compile(r"\d+")
_GROUPS = re.compile(r"\w+")
_DATE = re.compile(r"\d{4}-\d\d-\d\d|\d\d?[./]\d\d?[./]\d{4}\b")
_CLOCK = re.compile(r":\d")
_IDENTIFIED = re.compile(r"message-id|references|in-reply-to|\bmid\b|msgid")
_DOTTED = re.compile(r"[\d.]+")
_RELAY = re.compile(r"(?:mx|relay|mta|smtp|srv)\d*\.")
_HEX = re.compile(r"(?:CA\+)?[0-9a-f]{10,}(?:-\d)?")
_CODE = re.compile(r"\b\d{5}\b|\b[A-Z]{2}\d{3}\b|\b[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}\b|\d호")
#: A run of digits that is a house number before a street word, a postcode or a Hangul unit, as far as the signs beside it show.
_PLACE = re.compile(rf"\d(?<!\d\d)(?:\d{{4}}(?![^\W_])(?<![-.]\d{{5}})(?<![^\W_]\d{{5}})|\d\d(?![^\W_])|\d{{0,4}}(?:호|(?=[A-Z]? [{_UP}])))")
#: Seven digits or more, at most four other characters of a line between two of them.
_CLUSTER = re.compile(r"\d(?<!\d\d)" + r"[^\n\d]{0,4}+\d" * 6 + r"(?:[^\n\d]{0,4}+\d)*+")
_RUN = re.compile(rf"[{_UP}](?<![\w@.’'-][{_UP}]){_W}+(?:[’'-]{_W}+)*(?: (?:(?:de|da|do|dos|van|von|der) )?[{_UP}]{_W}+(?:[’'-]{_W}+)*){{1,3}}(?![\w@]|[-’']\w)")
#: Share of names that runs of unknown words must have where the model accepts them.
UNLISTED_PRECISION = 0.995
_SPELLED = re.compile(
    r"[A-Za-z0-9_][A-Za-z0-9._%+-]* ?[\[({](?:at|AT|@|arroba|ät)[\])}] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[({](?:dot|DOT|punkt|point|punto|ponto)[\])}] ?)[A-Za-z0-9-]+)+"
    r"|[A-Za-z0-9_][A-Za-z0-9._%+-]* (?:at|AT) [A-Za-z0-9-]+(?: (?:dot|DOT) [A-Za-z0-9-]+)+|[A-Za-z0-9_][A-Za-z0-9._%+-]*＠[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
)
_NUMBER = re.compile(r"(?<![\w.@=&/-])(?:(?!ID\b)[A-Z]{1,2} ?)?(?:\+ ?|\()?\d[\dA-Z]*(?:[ ./-]{1,2}\(?[\dA-Z]*\d[\dA-Z]*\)?|\)[ ./-]?\d+|[ ./-]?\(\d+\)[ ./-]?\d*){0,7}(?:[ -][A-Z])?(?![\w@]|\.\d)")
_STREET = re.compile(
    rf"(?:(?:Unit|Apt|Flat|Suite|Apartment) \w{{1,4}}, )?\b\d{{1,5}}[A-Z]? (?:[NSEW] )?(?:{_WORDS} ){{1,3}}(?:Street|St|Lane|Ln|Road|Rd|Avenue|Ave|Crescent|Cres|Drive|Dr|Court|Ct|Way|Close|Place|Pl|Square|Sq|Terrace|Row|Boulevard|Blvd)\b\.?(?:, (?:Apt|Unit|Flat|Suite) \w{{1,4}})?(?:, {_WORDS}(?: {_WORDS}(?!\w)){{0,2}}(?: [A-Z]{{1,2}}\d{{1,5}}(?: \d[A-Z]{{2}})?| [A-Z]{{2}} \d{{5}}| \d{{5}})?)?"
    rf"|\b\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|quai|boulevard|place|chemin|impasse|allée|route|cours)(?: (?:de la|de|des|du|d))?[ ’'](?:l[’'])?(?:{_WORDS}[ -]?){{1,3}}, \d{{5}} {_WORDS}(?:[ -](?:(?:sur|sous|lès|en|de|du|la)[ -])?{_WORDS}){{0,2}}"
    rf"|\b(?:(?:Am|An der|An den|Auf dem|Auf der|Im|In der|Zum|Zur|Beim|Hinter der|Hinter dem|Unter den) {_WORDS}|{_WORDS}(?:weg|straße|strasse|str\.|gasse|allee|platz|ring|damm|ufer|steig|kai|graben)|{_WORDS} (?:Weg|Straße|Str\.|Gasse|Allee|Platz|Ring|Damm|Ufer)) \d{{1,4}}[a-z]?, \d{{5}} {_WORDS}(?:[ -]{_WORDS}){{0,2}}"
    rf"|\b(?:Calle|C/|Avda\.|Avenida|Plaza|Paseo|Camino|Ronda|Rua|R\.|Av\.|Travessa|Largo|Praça|Alameda|Estrada|Via)(?: (?:de la|de los|de las|del|de|da|do|das|dos))? ?(?:{_WORDS} ?(?:(?:de la|del|de|da|do|das|dos) )?){{1,4}},? ?\d{{1,5}}(?:, (?:\d{{1,2}}[ºª°]? ?[A-Za-z]?|apto\.? \w+))?, \d{{5}}(?:-\d{{3}})? {_WORDS}(?: (?:(?:de la|del|de|da|do|das|dos) )?{_WORDS}){{0,3}}"
    r"|[가-힣]{1,6}(?:시|군|구|도)(?: [가-힣]{1,6}(?:시|군|구|동|읍|면))* [가-힣0-9]{1,8}(?:로|길) \d{1,4}(?:-\d{1,4})?(?:, ?(?:[가-힣A-Za-z0-9]+동 ?)?\d{1,4}호)?"
)
_HOUSE = re.compile(rf" (?:[NSEW] )?(?:{_WORDS} ){{1,3}}(?:Street|St|Lane|Ln|Road|Rd|Avenue|Ave|Crescent|Drive|Dr|Court|Way|Close|Place|Square|Terrace|Row|Boulevard|Blvd)\b")
_INITIAL = re.compile(rf"(?<!\w)([{_UP}]\.(?:-?[{_UP}]\.)?) ?\Z")
_AFTER_INITIAL = re.compile(rf" ([{_UP}]\.)(?!\w)")
_DISPLAY = re.compile(r'"([^"<>@]+)"\s*<|(?:^|[,;])\s*([^<>@",;()]+?)\s*<[^<>]*@|\S+@\S+\s*\(([^()@]+)\)')
#: The same for headers without a bracket.
_DISPLAY_PLAIN = re.compile(_DISPLAY.pattern.rsplit("|", 1)[0])
_JOSA = ("", "님", "씨", "님께", "씨가", "님이", "님은", "님의", "님과", "드림", "올림", "에게", "께", "이", "가", "은", "는", "을", "를", "의", "과", "와", "도", "님께서", "씨에게", "씨께", "씨는", "이가", "한테", "님에게", "님을", "씨의", "씨를", "씨와")
#: Words beside a number, in lower case; the nearest one tells what it is.
_CUES = {
    1: ("☎", "📞", "tel.", "tel:", "tél", "tel ", "fon:", "phone", "t: ", "m: ", " ring ", " call ", "reach me", "numéro direct", "nuevo es", "número é", "teléfono", "telefon", "celular", "móvil", "mobile", "handy", "erreich", "ligue", "llam", "appel", "rufnummer", "연락처", "전화", "new number", "direct line", "fax", "desde el", "pelo "),
    2: ("identity", " id ", "with id", "payroll has", "passport", "permit lists", "ausweis", "numéro de carte", "carte de", "pièce d’identité", " dni", "cpf", "documento", "주민", "등록번호", "신분", "social security", " ssn", "steuer", "national insurance", "identif", "porte le numéro"),
    3: ("part no", "version", "tracking", "counter", "serial", "invoice", "rechnung", "facture", "factura", "fatura", " row ", " order", "hrb", "company no", "handelsregister", "gate ", "message-id", " ref", "article", "item no", "batch", "estimate", "isbn"),
}
_PHONE_AFTER = re.compile(r"^\W{0,3}(?:until|if the|as of|ab|jusqu|até|hasta|bis)\b", re.I)
_ID_AFTER = re.compile(r"^\W{0,3}(?:on file|angegeben|para|en el formulario|no formulário)\b", re.I)
_GOODS_AFTER = re.compile(r"^\W{0,3}(?:fits|of the plan|shows|moves)\b", re.I)
_GREETING = re.compile(r"(?:hi|hello|hey|dear|good (?:morning|afternoon|evening)|guten (?:tag|morgen|abend)|hallo|liebe[r]?|lieber|sehr geehrte\w*(?: herr| frau)?|bonjour|bonsoir|salut|cher(?:/chère)?|chère|hola|estimad\w(?:/\w)?|buenos días|buenas tardes|prezad\w(?:\(a\))?|olá|oi|bom dia|boa tarde|car[oa]|안녕하세요|.{0,14}vorab,)", re.I)
_HEAD_LEAD = re.compile(r"\*?(?:from|to|cc|von|an|de|para|à|da|kopie|copie|organizer) ?:\*?(?:.*,)?", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_LOWER = re.compile(r"(?<!\w)[a-zß-ÿ]{3,12}(?!\w)")
_WHOLE = re.compile(rf"(?<!\w){_W}(?:{_W}|[’'-](?={_W}))*")
_NEXT_WORD = re.compile(rf" ({_WORDS})(?!\w)")
_WORD_BEFORE = re.compile(rf"(?<!\w)({_WORDS}) \Z")
_SPACES = re.compile(r"\s*\n[>|\s]*")


@dataclass
class Lexicon:
    """Name parts: how many different partners each was seen with, and how often the word also stands in lower case."""

    first: dict[str, int] = field(default_factory=dict)
    last: dict[str, int] = field(default_factory=dict)
    plain: dict[str, int] = field(default_factory=dict)
    after: dict[str, int] = field(default_factory=dict)  # words in lower case that follow a first and last name
    held: dict[str, tuple[int, int, int]] = field(default_factory=dict, repr=False, compare=False)

    def steps(self, word: str) -> tuple[int, int, int]:
        """Steps of a word's counts as a first name, as a family name and in lower case; only the lexicon's own words are held."""
        if (got := self.held.get(word)) is None:
            got = _bucket(self.first.get(word, 0)), _bucket(self.last.get(word, 0)), _bucket(self.plain.get(word, 0), _PLAIN_STEPS)
            if word in self.first or word in self.last:
                self.held[word] = got
        return got

    def automaton(self):
        """All name parts; built once per process."""
        import ahocorasick

        if (held := _AUTOMATA.get(id(self))) is None:
            made = ahocorasick.Automaton()
            for w in {*self.first, *self.last}:
                if len(w) > 1 and w[0].isalpha() and (w[0].isupper() or "가" <= w[0] <= "힣"):
                    made.add_word(w, w)
            made.add_word("\0", "\0")
            made.make_automaton()
            _AUTOMATA.clear()
            held = _AUTOMATA[id(self)] = (self, made)  # held, so that no other lexicon gets its id
        return held[1]


_AUTOMATA: dict[int, tuple] = {}


def header_names(text: str | None) -> list[tuple[str, int, int]]:
    """(name, start, end) of the display names in an address header."""
    text = text or ""
    return [(m[m.lastindex], *m.span(m.lastindex)) for m in (_DISPLAY if "(" in text else _DISPLAY_PLAIN).finditer(text)]


def name_parts(name: str) -> tuple[str, str] | None:
    """(first, last) of a display name, '' where there is none."""
    name = " ".join(name.split())
    if "," in name:
        last, _, first = name.partition(",")
        return first.strip(), last.strip()
    if re.fullmatch(r"[가-힣]{2,4}", name):
        cut = len(name) - 2
        return name[cut:], name[:cut]
    parts = name.split(" ")
    return parts[0], " ".join(parts[1:])


def _header_pairs(header: str) -> Iterator[tuple[str, str, str]]:
    """("first" or "last", name part, partner) of the display names of a line of a header."""
    for n, _, _ in header_names(header):
        a, b = name_parts(n)
        if a and b and not re.search(r"\d", n):
            yield "first", a, b
            for part in b.split(" "):
                yield "last", part, a
            if "가" <= b[0] <= "힣":
                yield "first", b + a, "*full*"
                yield "first", b + a, b


def _partners(pairs: Iterable[tuple[str, str, str]]) -> Lexicon:
    seen: dict[str, dict[str, set]] = {"first": defaultdict(set), "last": defaultdict(set)}
    for kind, part, partner in pairs:
        seen[kind][part].add(partner)
    return Lexicon(*[{k: len(v) for k, v in seen[kind].items()} for kind in ("first", "last")])


def _body_counts(bodies: Iterable[str], lex: Lexicon) -> Counter:
    """Counts of a body's (kind, word, partner): "plain" name parts in lower case, words "after" a name, unknown words beside a known part ("first", "last")."""
    out: Counter = Counter()
    import ahocorasick

    lowered = ahocorasick.Automaton()
    for w in {v.lower() for v in (*lex.first, *lex.last)}:
        if _LOWER.fullmatch(w):
            lowered.add_word(w, w)
    lowered.add_word("\0", "\0")
    lowered.make_automaton()
    for b in bodies:
        for end, w in lowered.iter(b):
            after, before = b[end + 1 : end + 2], b[end - len(w) : end + 1 - len(w)]
            if not (after.isalnum() or before.isalnum() or after == "_" or before == "_" or w == "\0"):
                out["plain", w, ""] += 1
        tokens = _known_words(b, lex)
        for (_, e, w), (x, y, v) in zip(tokens, tokens[1:]):
            if b[e:x] == " " and w in lex.first and v in lex.last and (m := _LETTERS.match(b, y + 1)) and b[y] == " " and m[0].islower():
                out["after", m[0], ""] += 1
        starts, ends = {a for a, _, _ in tokens}, {e for _, e, _ in tokens}
        for a, e, w in tokens:
            if w in lex.first:
                if e + 1 not in starts and not "가" <= w[0] <= "힣" and (m := _NEXT_WORD.match(b, e)):
                    out["last", m[1], w] += 1
            elif a - 1 not in ends and b[a - 1 : a] == " " and b[a - 2 : a - 1].isalpha() and (m := _WORD_BEFORE.search(b[max(0, a - 40) : a])) and not _GREETING.fullmatch(m[1]) and not (lex.first.get(m[1]) or lex.last.get(m[1])):
                out["first", m[1], w] += 1
    return out


def _occurrences(bodies: Iterable[str], words: frozenset[str]) -> Counter:
    """How often each of ``words`` stands in the bodies as a whole word, in whatever case; keys are in lower case."""
    import ahocorasick

    sought = ahocorasick.Automaton()
    for w in (*words, "\0"):
        sought.add_word(w, w)
    sought.make_automaton()
    out: Counter = Counter()
    for b in bodies:
        low = b.lower()
        for end, w in sought.iter(low):
            a = end + 1 - len(w)
            before = low[a - 1 : a] if a else ""
            if before and (before.isalnum() or before == "_" or (before in "’'-" and low[a - 2 : a - 1].isalpha())):
                continue
            if (m := _WHOLE.match(low, a)) and m.end() == end + 1:
                out[w] += 1
    return out


def _rates(lex: Lexicon, plain: dict[str, float], after: dict[str, float], beside: Iterable[tuple[str, str, int, int]], total: dict[str, int]) -> Lexicon:
    """A lexicon with ``lex``'s partners, with counts in bodies, and with the unknown words (kind, word, partners, times) that mostly stand beside a known part."""
    parts = {"first": dict(lex.first), "last": dict(lex.last)}
    for kind, word, partners, times in beside:
        if 2 * times >= total[word.lower()]:
            parts[kind].setdefault(word, partners)
    words = {*parts["first"], *parts["last"]}
    return Lexicon(parts["first"], parts["last"], {w: n for w in words if (n := round(plain.get(w.lower(), 0)))}, {w: round(n) for w, n in after.items()})


def build_lexicon(headers: list[str], bodies: list[str]) -> Lexicon:
    """The lexicon of some headers and bodies in memory; ``corpus_lexicon`` counts the same over a table."""
    lex = _partners(p for h in headers for p in _header_pairs(h))
    counts = _body_counts(bodies, lex)
    plain = {w: n for (k, w, _), n in counts.items() if k == "plain"}
    after = {w: n for (k, w, _), n in counts.items() if k == "after"}
    near = Counter()
    for (k, w, _), n in counts.items():
        if k in ("first", "last"):
            near[k, w] += n
    beside = [(k, w, sum(x[:2] == (k, w) for x in counts), n) for (k, w), n in near.items()]
    return _rates(lex, plain, after, beside, _occurrences(bodies, frozenset(w.lower() for _, w in near)) if near else {})


def corpus_lexicon(emails: DataFrame, body: str, to: str, cc: str, sender: str, sample: int) -> Lexicon:
    """The lexicon of all headers and bodies.

    Only its rows, one per different name part, come to the driver.  Counts in bodies are features with fixed steps, so they
    are given per ``sample`` e-mails of a larger table.
    """
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = {line for h in set(b["h"]) for line in h.split("\n")}
            yield pd.DataFrame(list({p for line in lines for p in _header_pairs(line)}), columns=["kind", "part", "partner"])

    heads = emails.select(F.explode(F.array(to, cc, sender)).alias("h")).where("h <> ''").mapInPandas(pairs, "kind string, part string, partner string")
    lex = Lexicon()
    for r in heads.groupBy("kind", "part").agg(F.countDistinct("partner").alias("n")).collect():
        getattr(lex, r["kind"])[r["part"]] = r["n"]
    first, last = lex.first, lex.last

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Lexicon(first, last)
        for b in batches:
            yield pd.DataFrame([(*k, n) for k, n in _body_counts(b["b"], known).items()], columns=["kind", "word", "partner", "n"])

    bodies = emails.select(F.col(body).alias("b")).where("b <> ''")
    rows = bodies.mapInPandas(counts, "kind string, word string, partner string, n bigint")
    per_word = rows.groupBy("kind", "word").agg(F.sum("n").alias("n"), F.countDistinct("partner").alias("partners")).collect()
    scale = sample / max(sample, emails.count())
    plain, after = ({r["word"]: r["n"] * scale for r in per_word if r["kind"] == k} for k in ("plain", "after"))
    beside = [(r["kind"], r["word"], r["partners"], r["n"]) for r in per_word if r["kind"] in ("first", "last")]
    total: dict[str, int] = {}
    if beside:
        words = frozenset(w.lower() for _, w, _, _ in beside)

        def occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame(list(_occurrences(b["b"], words).items()), columns=["word", "n"])

        total = {r["word"]: r["n"] for r in bodies.mapInPandas(occurrences, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return _rates(lex, plain, after, beside, total)


_PLAIN_STEPS = (0, 2, 10, 50, 200)
_FUNCTION_WORDS = frozenset(("the", "period", "you", "we", "i", "it", "of", "to", "is", "not", "be", "a", "an", "all", "for"))


def _bucket(n: int, steps=(0, 1, 3, 8, 30)) -> int:
    return bisect_left(steps, n)


def _near(text: str, a: int, b: int) -> tuple[str, str]:
    """Text left and right of a span, with line breaks and quote marks folded to one space."""
    return _flat(text[max(0, a - 44) : a]), _flat(text[b : b + 24])


def _flat(part: str) -> str:
    return _SPACES.sub(" ", part) if "\n" in part else part


def _edges(text: str, a: int, b: int) -> tuple[int, int]:
    """What stands directly before and after: line edge, space, letter, digit or a sign."""
    return _sign(text[a - 1 : a]), _sign(text[b : b + 1])


@lru_cache(maxsize=1 << 12)
def _sign(c: str) -> int:
    if not c or c == "\n":
        return 0
    return min(1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 + ",.:;|/(<[\"'-–!?>)]".find(c) + 1, 31)


def _number_spans(text: str) -> Iterator[re.Match]:
    """Matches near clusters of digit runs that together have seven digits or more."""
    done = 0
    for cluster in _CLUSTER.finditer(text):
        start, end = cluster.span()
        stop = text.find("\n", end)
        limit = min(len(text) if stop < 0 else stop, end + 40)
        for m in _NUMBER.finditer(text, max(done, start - 4), limit):
            if m.start() >= end:
                break
            done = m.end()
            yield m


@lru_cache(maxsize=1)
def _cues():
    """All cues with their place in ``_CUES`` and their kind."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, (c, k) in enumerate((c, k) for k, words in _CUES.items() for c in words):
        if c not in made:
            made.add_word(c, (i, k))
    made.make_automaton()
    return made


@lru_cache(maxsize=1 << 15)
def _cue(low: str) -> tuple[int, int]:
    """Kind and end of the last cue, of those that end together the first one listed; quoted mail brings the same context again and again."""
    at, _, k = max(((end, -i, k) for end, (i, k) in _cues().iter(low)), default=(-2, 0, 0))
    return k, at + 1


def number_candidates(text: str) -> list[tuple[int, int, tuple]]:
    out = []
    for m in _number_spans(text):
        s = m[0]
        digits = sum(map(str.isdigit, s))
        if digits < 7 or digits > 16:
            continue
        a, b = m.span()
        left, right = _near(text, a, b)
        low = " " + left.lower()
        cue, cue_at = _cue(low)
        gap = len(low) - cue_at if cue else 44
        groups = _GROUPS.findall(s)
        line_start = text.rfind("\n", 0, a) + 1
        lead = text[line_start:a]
        before, after = _edges(text, a, b)
        feats = (
            digits, min(len(groups), 9), s.startswith("+"), "(" in s, s.count("."), s.count("-"), s.count(" "), "/" in s, min(len(groups[0]), 15), min(len(groups[-1]), 15),
            s[0].isalpha(), s[-1].isalpha(), sum(map(str.isalpha, s)), cue == 1, cue == 2, cue == 3,
            bool(_PHONE_AFTER.match(right)), bool(_ID_AFTER.match(right)), bool(_GOODS_AFTER.match(right)), before, after, not lead.strip(" >|\t"), text[b : b + 1] in ("", "\n", "\r"), "|" in lead,
            s.startswith("00"), s[0] == "0", s[0] == "9", min(len(groups[1]) if len(groups) > 1 else 0, 15),
            bool(_DATE.match(s)) or bool(_CLOCK.match(right)), min(gap // 2, 31),
        )
        out.append((a, b, feats))
    return out


def label_number(f: tuple) -> tuple[int, int]:
    """(is phone, is identity number); -1 where the cues say nothing."""
    digits, phone, ident, goods, alone = f[0], f[13], f[14], f[15], f[21] and f[22]
    if f[18] or f[28]:
        return 0, 0
    if f[17] and not f[13]:
        return 0, 1
    if f[16] and not f[14]:
        return int(8 <= digits <= 15), 0
    if goods:
        return 0, 0
    if ident:
        return 0, 1
    if phone:
        return int(8 <= digits <= 15), 0
    if alone or (f[23] and not goods):  # a line or a card field of its own
        return int(9 <= digits <= 14 and not f[12]), 0
    return -1, -1


def mail_candidates(text: str) -> list[tuple[int, int, tuple]]:
    out = []
    spans: list[tuple[int, int, int]] = []
    at = text.find("@")
    while at >= 0:
        start = at
        while start:
            part = text[max(0, start - 40) : start]
            rest = len(part.rstrip(_LOCAL))
            start -= len(part) - rest
            if rest:
                break
        while start < at and text[start] in ".%+'=$-":
            start += 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            spans.append((start, m.end(), 0))
        at = text.find("@", at + 1)
    if "at" in text or "AT" in text or "＠" in text or "@]" in text or "@)" in text:
        if "(at" in text or "[at" in text or "(AT" in text or "[AT" in text or "{at" in text or " dot " in text or " DOT " in text or "＠" in text or "arroba" in text:
            spans += [(m.start(), m.end(), 1) for m in _SPELLED.finditer(text)]
    for a, b, spelled in spans:
        local, _, domain = text[a:b].partition("@")
        low = _flat(text[max(0, a - 44) : a]).lower()[-24:]
        f = (
            spelled, min(len(local), 31), sum(map(str.isdigit, local)) * 4 // max(1, len(local)), "$" in local, ("id" in low or "re" in low) and bool(_IDENTIFIED.search(low)),
            local.count("."), bool(_DOTTED.fullmatch(local)), bool(_RELAY.match(domain)), bool(_HEX.fullmatch(local)), ".JavaPost" in local or ".JavaMail" in local, *_edges(text, a, b),
        )
        out.append((a, b, f))
    return out


def label_mail(f: tuple) -> int:
    return int(not (f[4] or f[3] or (f[6] and f[7]) or f[8] or f[9]))


def street_candidates(text: str) -> list[tuple[int, int, tuple]]:
    """Addresses are sought in lines that have a postcode, a unit or a house number before a street word."""
    out: list[tuple[int, int, tuple]] = []
    done = -1
    for run in _PLACE.finditer(text):
        a, b = run.span()
        if a < done:
            continue
        if text[b - 1] == "호":
            fits = True
        else:
            before, after = text[a - 1 : a], text[b : b + 1]
            fits = (b - a == 5 and before not in ("-", ".") and not before.isalnum() and not after.isalnum()) or (b - a == 3 and text[a - 2 : a].isupper() and not after.isalnum())
            fits = fits or (before not in ("-", ".") and (after == " " and _HOUSE.match(text, b) or "A" <= after <= "Z" and _HOUSE.match(text, b + 1)))
        if fits:
            start = text.rfind("\n", 0, a) + 1
            done = text.find("\n", b)
            done = len(text) if done < 0 else done
            _streets_of_line(text, start, done, out)
    return out


def _streets_of_line(text: str, start: int, end: int, out: list) -> None:
    for m in _STREET.finditer(text, start, end):
        a, b = m.span()
        s = m[0]
        line_start = start
        code = bool(_CODE.search(s))
        f = (code, s.count(","), min(len(s) // 4, 31), not text[line_start:a].strip(" >|\t"), text[b : b + 1] in ("", "\n", "\r"), min(sum(map(str.isdigit, s)), 31), s[0].isdigit(), *_edges(text, a, b))
        out.append((a, b, f))


def label_street(f: tuple) -> int:
    return int(f[0]) if f[0] or not f[3] else -1


def _known_words(text: str, lex: Lexicon) -> list[tuple[int, int, str]]:
    """Whole words of the lexicon; of a Hangul word the longest beginning."""
    out: list[tuple[int, int, str]] = []
    for last, w in lex.automaton().iter(text):
        a, b = last + 1 - len(w), last + 1
        if len(w) == 2 and "가" <= text[a - 1 : a] <= "힣" and text[a - 1] in lex.last and w in lex.first and not text[a - 2 : a - 1].isalpha():
            a, w = a - 1, text[a - 1 : b]  # a known family and given name that no header has together
            if out and out[-1][:2] == (a, b):
                continue
        elif a and (text[a - 1].isalpha() or text[a - 1] in "@_" or (text[a - 1] in ".-" and text[a - 2 : a - 1].islower())):
            continue
        if "가" <= w[0] <= "힣":
            if out and out[-1][0] == a:
                out.pop()
            out.append((a, b, w))
            continue
        nxt = text[b : b + 1]
        if nxt.isalnum() or nxt in ("@", "_") or (nxt and nxt in "-’'." and text[b + 1 : b + 2].islower()):
            continue
        out.append((a, b, w))
    return out


def name_candidates(text: str, lex: Lexicon, own: frozenset[str] = frozenset()) -> list[tuple[int, int, tuple]]:
    """Runs of name parts of the lexicon, with an initial before or after; of a Hangul full name that no header has, a known family and given name."""
    out = []
    tokens = _known_words(text, lex)
    first, last = lex.first, lex.last
    i, n = 0, len(tokens)
    while i < n:
        a, b, w = tokens[i]
        if "가" <= w[0] <= "힣":
            given = w if w in first else w[1:]
            if given in first:
                end = b
                while "가" <= text[end : end + 1] <= "힣":
                    end += 1
                rest = text[b:end]
                out.append((a, b, _name_features(text, a, b, [given], lex, own, 0, 1 + (_JOSA.index(rest) > 1 if rest in _JOSA else 8))))
            i += 1
            continue
        j, end, words = i, b, [w]
        while j + 1 < n:
            x, y, v = tokens[j + 1]
            between = text[end:x]
            if between in (" ", ", ", " de ", " da ", " do ", " dos ", " von ", " van ") and len(words) < 4 and not (between == ", " and not (w in last and v in first and len(words) == 1)):
                words.append(v)
                end = y
                j += 1
            else:
                break
        initial = 0
        if w in last and text[a - 2 : a] == ". " and (m := _INITIAL.search(text[max(0, a - 7) : a])):
            a -= len(m[0])
            initial = 1
        elif len(words) == 1 and w in first and text[end : end + 1] == " " and (m := _AFTER_INITIAL.match(text, end)):
            # "Ines M." may also end a sentence after "hall B."
            out.append((a, m.end(1), _name_features(text, a, m.end(1), words, lex, own, 2, 0)))
        out.append((a, end, _name_features(text, a, end, words, lex, own, initial, 0)))
        i = j + 1
    return out


@lru_cache(maxsize=1 << 15)
def _lead_kind(lead: str) -> tuple[bool, bool]:
    """Whether what stands before a name on its line is a greeting or the label of a header."""
    return bool(_GREETING.fullmatch(lead)), ":" in lead and bool(_HEAD_LEAD.fullmatch(lead))


def _name_features(text: str, a: int, b: int, words: list[str], lex: Lexicon, own: frozenset[str], initial: int, hangul: int) -> tuple:
    from_ = a - 40 if a > 40 else 0
    cut = text.rfind("\n", from_, a)
    whole = cut >= 0 or not from_
    lead = text[cut + 1 if cut >= 0 else from_ : a].strip(" >|\t\r")
    bare = whole and not lead.strip("-–* ")
    if lead:
        p = lead.rsplit(None, 1)[-1]
    elif cut > 0:
        above = text[max(0, cut - 30) : cut].split()
        p = above[-1] if above else ""
        if text[cut - 1 : cut] == "\n" or p in (">", "|"):
            p = ""
    else:
        p = ""
    tail = text[b : b + 16]
    flat_right = (_SPACES.sub(" ", tail) if "\n" in tail else tail).lstrip()
    q = _LETTERS.match(flat_right)
    r = q[0] if q else ""
    greeting, head = _lead_kind(lead) if whole and lead else (False, False)
    first, last, plain = lex.steps(words[0])
    zfirst, zlast, _ = lex.steps(words[-1]) if len(words) > 1 else (first, last, plain)
    nxt, p1, r1, right1 = tail[:1], p[:1], r[:1], flat_right[:1]
    return (
        len(words), first, last, zfirst, zlast, plain,
        not own.isdisjoint(words), initial, hangul, _sign(text[a - 1 : a]), _sign(nxt), bare, nxt in ("", "\n", "\r"), greeting, not p or p[-1] in ".!?:;>|", p1.islower(),
        p1.isupper(), r1.islower(), r1.isupper(), right1 in "<(", r.lower() in _FUNCTION_WORDS, "," in text[a:b],
        bare and right1 in ",!:-–", lead[:1] == "-", tail[:2] in (" |", " /", ", "), head, _bucket(lex.after[r], _PLAIN_STEPS) if r in lex.after else 0,
    )


def label_name(f: tuple) -> int:
    words, first, last, zfirst, zlast, plain, own, initial, hangul, before, after, bare, eol, greeting, sentence, p_low, p_up, r_low, r_up, addr, func, comma, salute, dash, card, head, follows = f
    if hangul:
        return 0 if hangul > 8 else 1
    if initial == 2:
        return -1 if first < 3 else 0
    if initial == 1:
        return 1 if last >= 2 else 0
    if words >= 2:
        known = max(min(first, zlast), min(last, zfirst) if comma else 0)
        if known == 1 and (first >= 2 or comma and zfirst >= 2):  # a family name seen with one partner: with a common first name it is a person
            return 1 if first >= 3 or comma and zfirst >= 3 else -1
        return int(known >= 2)
    if first < 3:  # a family name or a place by itself
        return 1 if last >= 2 and (greeting or (bare and eol)) and not first else 0
    if greeting or salute or (bare and eol) or addr or dash and eol or head:
        return 1
    if sentence and r_low and follows >= 2:
        return 1
    if plain and sentence and r_low:
        return 0
    if func:
        return 0
    if p_low:
        return 1
    if sentence and r_low and not plain:
        return 1
    return -1


def _mapping(text: str) -> tuple[str, list[tuple[int, int]] | None]:
    """Repaired text and, for each of its characters, the span it had; None where nothing was garbled."""
    where: list[tuple[int, int]] | None = None
    for _ in range(3):
        spans = _chosen(text, singles=False)
        if not spans:
            break
        where = where or [(i, i + 1) for i in range(len(text))]
        out, pos, at = [], [], 0
        for a, b, ch in spans:
            out += [text[at:a], ch]
            pos += where[at:a]
            pos.append((where[a][0], where[b - 1][1]))
            at = b
        text = "".join([*out, text[at:]])
        where = pos + where[at:]
    return text, where


def unlisted_runs(text: str, lex: Lexicon, known: bool = False) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of capitalised words of which the lexicon has none; with ``known`` those that it explains as a first and a family name."""
    first, last = lex.first, lex.last
    for m in _RUN.finditer(text):
        words = [w for w in m[0].split(" ") if w[0].isupper()]
        if known:
            if len(words) < 4 and first.get(words[0], 0) >= 2 and last.get(words[-1], 0) >= 2:
                yield *m.span(), words
        elif not any(w in first or w in last for w in words):
            yield *m.span(), words


@dataclass
class Surroundings:
    """What the sample shows of runs: shares of names by the word before and after, and words that also stand in lower case."""

    before: dict[str, int] = field(default_factory=dict)
    after: dict[str, int] = field(default_factory=dict)
    lower: frozenset[str] = frozenset()
    model: Boosted | None = None


def _beside_run(text: str, a: int, b: int) -> tuple[str, str]:
    """Word or sign before and after a run; a line's edge is a line feed, an end of a sentence a full stop."""
    cut = text.rfind("\n", max(0, a - 24), a)
    left = text[cut + 1 if cut >= 0 else max(0, a - 24) : a].strip(" >|*\t\r")
    p = _DIGITS.sub("0", left.rsplit(None, 1)[-1].lower()) if left else "\n"
    right = text[b : b + 24].split("\n", 1)[0].lstrip(" *\t\r")
    m = _LETTERS.match(right)
    return "." if p[-1] in ".!?" and p != "." and len(p) > 2 else p, (m[0].lower() if m else right[:1] or "\n")


def _run_features(text: str, a: int, b: int, words: list[str], seen: Surroundings) -> tuple:
    p, r = _beside_run(text, a, b)
    return (
        seen.before.get(p, 0), seen.after.get(r, 0), len(words), sum(map(str.isupper, words)), sum(map(seen.lower.__contains__, lows := [*map(str.lower, words)])),
        lows[0] in seen.lower, b - a - sum(map(len, words)) - len(words) + 1 > 0, *_edges(text, a, b), p == "\n", r == "\n",
        _sign(text[max(0, a - 24) : a].rstrip(" >|*\t\r\n")[-1:]) if p == "\n" else 0,
    )


def _shares(pairs: Iterable[tuple[str, int]], least: int = 5) -> dict[str, int]:
    """Step 1 to 10 by the share of names beside each word seen ``least`` times or more."""
    n: Counter = Counter()
    names: Counter = Counter()
    for w, y in pairs:
        n[w] += 1
        names[w] += y
    return {w: 1 + round(9 * names[w] / c) for w, c in n.items() if c >= least}


def fit_unlisted(bodies: list[str], lex: Lexicon, precision: float = UNLISTED_PRECISION) -> Surroundings:
    """A model of names without a lexicon, taught by the runs of the bodies that the lexicon explains against those of which it knows no word."""
    runs = [(i % 5 == 0, t, a, b, w, y) for i, t in enumerate(bodies) for y in (0, 1) for a, b, w in unlisted_runs(t, lex, bool(y))]
    lower: Counter = Counter(w for t in bodies for w in set(_LOWER.findall(t)))
    taught = [(_beside_run(t, a, b), y) for held, t, a, b, _, y in runs if not held]
    seen = Surroundings(_shares((p, y) for (p, _), y in taught), _shares((r, y) for (_, r), y in taught), frozenset(w for w, c in lower.items() if c > 1))
    if not any(y for *_, y in runs):
        return seen
    x = np.clip(np.array([_run_features(t, a, b, w, seen) for _, t, a, b, w, _ in runs], np.int64), 0, 31)
    y, held = np.array([r[5] for r in runs], float), np.array([r[0] for r in runs])
    model = Boosted().fit(x[~held], y[~held])
    p = model.score(x[held])
    good = [c for c in np.linspace(0.5, 0.995, 100) if (p >= c).sum() >= 20 and y[held][p >= c].mean() >= precision]
    model.threshold = float(good[0]) if good else 2.0
    seen.model = model
    return seen


def candidates(text: str, lex: Lexicon, own: frozenset[str]) -> dict[str, list[tuple[int, int, tuple]]]:
    return {"number": number_candidates(text), "email": mail_candidates(text), "street": street_candidates(text), "name": name_candidates(text, lex, own)}


class Finder:
    """Generators, trees and selection."""

    #: Header texts whose spans are held; most stand in several e-mails.
    HELD = 50_000
    #: Characters whose candidates are held at a time: with those of a whole batch the collector's walks cost a quarter of the search.
    PORTION = 250_000

    def __init__(self, lex: Lexicon, models: dict[str, Boosted], seen: Surroundings | None = None):
        self.lex, self.models, self.seen = lex, models, seen or Surroundings()
        self.memo: dict[str, dict[tuple, bool]] = {k: {} for k in (*models, "unlisted")}
        self.headers: dict[str, list[tuple[int, int, str]]] = {}

    def _accept(self, kind: str, wanted: list[tuple]) -> dict[tuple, bool]:
        """Decision for each feature tuple; every different tuple is scored once."""
        memo = self.memo[kind]
        new = list({f for f in wanted if f not in memo})
        if new:
            m = self.seen.model if kind == "unlisted" else self.models[kind]
            x = np.clip(np.array(new, np.int64), 0, 31)
            memo.update(zip(new, (m.score(x) >= m.threshold).tolist()))
        return memo

    def find_headers(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Selected spans of each header, whose own names are those it states itself."""
        if len(self.headers) > self.HELD:
            self.headers.clear()
        new = [t for t in dict.fromkeys(texts) if t not in self.headers]
        self.headers.update(zip(new, self.find(new, [_own(t) for t in new])))
        return [self.headers[t] for t in texts]

    def find(self, texts: list[str], owners: list[frozenset[str]]) -> list[list[tuple[int, int, str]]]:
        """Selected (start, end, type) of each text."""
        return [spans for i, j in portions(texts, self.PORTION) for spans in self._find(texts[i:j], owners[i:j])]

    def _find(self, texts: list[str], owners: list[frozenset[str]]) -> list[list[tuple[int, int, str]]]:
        read, maps = [], []
        for t in texts:
            fixed, where = _mapping(t) if not t.isascii() and suspect(t) else (t, None)
            read.append(fixed)
            maps.append(where)
        found = [candidates(t, self.lex, o) for t, o in zip(read, owners)]
        wanted = {k: [f for c in found for _, _, f in c[k]] for k in ("street", "email", "number", "name")}
        street, email, name = (self._accept(k, wanted[k]) for k in ("street", "email", "name"))
        phone, ident = (self._accept(k, wanted["number"]) for k in ("phone", "id_number"))
        runs = [[(a, b, _run_features(t, a, b, w, self.seen)) for a, b, w in unlisted_runs(t, self.lex)] for t in read] if self.seen.model else [[]] * len(read)
        unlisted = self._accept("unlisted", [f for r in runs for _, _, f in r])
        out = []
        for c, r, where in zip(found, runs, maps):
            spans = [(0, a - b, a, b, "street") for a, b, f in c["street"] if street[f]]
            spans += [(1, a - b, a, b, "email") for a, b, f in c["email"] if email[f]]
            spans += [(2, a - b, a, b, "id_number" if ident[f] else "phone") for a, b, f in c["number"] if ident[f] or phone[f]]
            spans += [(3, a - b, a, b, "name") for a, b, f in c["name"] if name[f]]
            spans += [(4, a - b, a, b, "name") for a, b, f in r if unlisted[f]]
            spans.sort(key=lambda s: s[:2])
            starts: list[int] = []
            kept: list[tuple[int, int, str]] = []
            for _, _, a, b, t in spans:  # kept spans are disjoint and in order
                i = bisect_left(starts, b)
                if not i or kept[i - 1][1] <= a:
                    starts.insert(i, a)
                    kept.insert(i, (a, b, t))
            if where is not None:
                kept = sorted((where[a][0], where[b - 1][1], t) for a, b, t in kept)
            out.append(kept)
        return out


def _own(*headers: str | None) -> frozenset[str]:
    return frozenset(w for h in headers for n, _, _ in header_names(h) for w in n.replace(",", " ").split())


def fit(rows: list[tuple[str, str, str, str]], lex: Lexicon, seed: int = 3) -> Finder:
    """``rows``: (body, to, cc, sender) of the sample."""
    data: dict[str, list[tuple[tuple, int]]] = {t: [] for t in TYPES}
    for body, to, cc, sender in rows:
        for text, own in ((body, _own(to, cc, sender)), (to, _own(to)), (cc, _own(cc))):
            if not text:
                continue
            c = candidates(text, lex, own)
            for _, _, f in c["number"]:
                p, i = label_number(f)
                if p >= 0:
                    data["phone"].append((f, p))
                    data["id_number"].append((f, i))
            data["email"] += [(f, label_mail(f)) for _, _, f in c["email"]]
            data["street"] += [(f, y) for _, _, f in c["street"] if (y := label_street(f)) >= 0]
            data["name"] += [(f, y) for _, _, f in c["name"] if (y := label_name(f)) >= 0]
    rng = np.random.default_rng(seed)
    models = {}
    for t, pairs in data.items():
        width = {"phone": 30, "id_number": 30, "email": 12, "street": 9, "name": 27}[t]
        x = np.clip(np.array([f for f, _ in pairs], np.int64).reshape(-1, width), 0, 31)
        y = np.array([v for _, v in pairs], float)
        held = rng.random(len(y)) < 0.2
        models[t] = Boosted().fit(x[~held], y[~held]).calibrate(x[held], y[held])
    return Finder(lex, models, fit_unlisted([r[0] for r in rows if r[0]], lex))


def fitted(emails: DataFrame, key: str, body: str, to: str, cc: str, sender: str, sample: int = 6000) -> Finder:
    empty = F.lit("")
    rows = [tuple(r)[1:5] for r in bounded_sample(emails.select(key, *[F.coalesce(F.col(c), empty).alias(f"_{i}") for i, c in enumerate((body, to, cc, sender))]), key, sample)]
    return fit(rows, corpus_lexicon(emails, body, to, cc, sender, sample))


def _batches(finder: Finder, b: pd.DataFrame, fields: list[str]):
    owners = [_own(t, c, s) for t, c, s in zip(b["_to"], b["_cc"], b["_sender"])]
    for name in fields:
        col = b[f"_{name}"].tolist()
        pick = [i for i, t in enumerate(col) if t]
        texts = [col[i] for i in pick]
        yield name, pick, texts, finder.find(texts, [owners[i] for i in pick]) if name == "body" else finder.find_headers(texts)


def _input(emails: DataFrame, key: str, body: str, to: str, cc: str, sender: str) -> DataFrame:
    return emails.select(F.col(key).cast("bigint").alias("_key"), F.col(body).alias("_body"), F.col(to).alias("_to"), F.col(cc).alias("_cc"), F.col(sender).alias("_sender"))


def find_personal(emails: DataFrame, key: str = "email_id", body: str = "body", to: str = "to_text", cc: str = "cc_text", sender: str = "sender", sample: int = 6000) -> DataFrame:
    """(key, field_name, pii_type, pii_text): one row per different text of a type in a field."""
    finder = fitted(emails, key, body, to, cc, sender, sample)
    lex, models, seen = finder.lex, finder.models, finder.seen
    named = {"body": body, "to": to, "cc": cc}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Finder(lex, models, seen)
        for b in batches:
            keys = b["_key"].tolist()
            out = []
            for name, pick, texts, spans in _batches(f, b, ["body", "to", "cc"]):
                for i, t, found in zip(pick, texts, spans):
                    out += [(keys[i], named[name], kind, s) for kind, s in {(k, t[a:z]) for a, z, k in found}]
            yield pd.DataFrame(out, columns=["_key", "field_name", "pii_type", "pii_text"])

    return _input(emails, key, body, to, cc, sender).mapInPandas(run, "_key bigint, field_name string, pii_type string, pii_text string").withColumnRenamed("_key", key)


def redact_personal(emails: DataFrame, key: str = "email_id", body: str = "body", to: str = "to_text", cc: str = "cc_text", sender: str = "sender", sample: int = 6000) -> DataFrame:
    """(key, body, to, cc) with every span replaced by [NAME], [EMAIL], [PHONE], [ID_NUMBER] or [STREET]; nulls stay null."""
    finder = fitted(emails, key, body, to, cc, sender, sample)
    lex, models, seen = finder.lex, finder.models, finder.seen

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Finder(lex, models, seen)
        for b in batches:
            res = {n: b[f"_{n}"].tolist() for n in ("body", "to", "cc")}
            for name, pick, texts, spans in _batches(f, b, ["body", "to", "cc"]):
                for i, t, found in zip(pick, texts, spans):
                    parts, at = [], 0
                    for a, z, k in found:
                        parts += [t[at:a], f"[{k.upper()}]"]
                        at = z
                    res[name][i] = "".join([*parts, t[at:]])
            yield pd.DataFrame({"_key": b["_key"], "_body": res["body"], "_to": res["to"], "_cc": res["cc"]})

    got = _input(emails, key, body, to, cc, sender).mapInPandas(run, "_key bigint, _body string, _to string, _cc string")
    return got.select(F.col("_key").alias(key), F.col("_body").alias(body), F.col("_to").alias(to), F.col("_cc").alias(cc))
