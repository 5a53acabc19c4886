"""Problem 3: only what the sender newly wrote, by labelling the lines of an e-mail.

Each non-blank line gets a kind (prefix, punctuation, phrase and shape classes, found by vectorised
regular expressions).  A linear-chain model with one state per role (new, introduction, quoted under
a prefix, quoted under headers, signature, notice) scores kinds of the line and of its neighbours,
blank lines around it and its position; the best state sequence comes from a Viterbi pass over all
e-mails of a batch at once.  The model is an averaged structured perceptron, fitted on the driver on
at most ``sample`` e-mails (default 4,000, those with the smallest hash of the id).  Their labels come from a
reading of whole e-mails and, where the message that one answers is there, from that message: a block of two
lines or more that it holds word for word is earlier mail, whatever the reading says, and what the reading
misses of it is taught as such.  ``evidence_agreement`` measures a model by those lines alone.

Bodies are labelled in portions of about ``LINES_PORTION`` characters, so memory does not follow the rows of a batch.

Defined results: null and blank bodies have no lines; blank lines are never reported; a CR before an
LF belongs to no line; line numbers count all lines from 1; very long bodies are labelled whole;
repeated rows are labelled one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.identity import normalize_message_id
from threadloom.llm.encodings import repair, suspect
from threadloom.llm.sampling import bounded_sample, portions

STATES = ("new", "intro", "quoted", "headed", "signature", "notice")
NEW, INTRO, QUOTED, HEADED, SIGNATURE, NOTICE = range(6)

_HEAD = r"(?:From|Von|De|Da|보낸 ?사람|Sent|Gesendet|Envoyé|Enviado(?: el)?|Enviada(?: em)?|보낸 ?날짜|Date|Datum|Fecha|Data|날짜|To|An|À|Para|Pour|받는 ?사람|Cc|Copie|Kopie|참조|Subject|Betreff|Objet|Asunto|Assunto|제목|Reply-To|Message-ID)"
_FROM = r"(?:From|Von|De|Da|보낸 ?사람)"
_NAME = r"(?:\p{Lu}[\p{L}\p{M}'’.-]*|[\p{Hangul}]{2,4})"
_FULL = rf"{_NAME}(?: (?:(?:de|da|do|dos|van|von|der|di|la|le|du|y|e) )?{_NAME}){{0,3}}"
_VERB = r"(?:wrote|writes|schrieb|a écrit|escreveu|escribió|ha scritto|님이 작성|님이 씀|작성)"
_CLOSING = (
    r"(?:(?:(?:with )?(?:my )?(?:best|kind|kindest|warm|warmest|many|sincere) )?(?:regards|wishes|thanks|greetings)|best|cheers|yours(?: (?:sincerely|faithfully|truly))?|sincerely(?: yours)?|thank you|thanks(?: in advance| again| a lot)?|all the best|take care|"
    r"(?:mit )?(?:freundlichen|freundliche|besten|beste|viele|vielen|liebe|lieben|schöne|schönen|herzliche|herzlichen)? ?(?:grüßen|grüße|gruß|gruss|grüsse|dank)|hochachtungsvoll|mfg|lg|vg|"
    r"(?:bien )?cordialement|bien à vous|à bientôt|merci(?: d[’']avance| beaucoup)?|amicalement|salutations(?: distinguées)?|sincères salutations|bonne journée|"
    r"(?:muchas )?gracias|(?:un )?(?:cordial )?saludos?(?: cordiales)?|atentamente|un abrazo|"
    r"obrigad[oa]|abraços?|atenciosamente|cumprimentos|com os melhores cumprimentos|"
    r"감사합니다|고맙습니다|드림|올림|"
    r"(?:mit freundlichen |viele |beste |liebe |schöne |sch�+ne )?gr�+(?:e|en)?|abra�+os|merci d�+avance|bien �+ vous|�+ bient�+t|�{6,})"
)
#: Kinds in order of precedence; the first that matches a line names it.
KINDS: list[tuple[str, str]] = [
    ("gt", r"^[ \t]?>"),
    ("bar", r"^[ \t]?\|"),
    ("original", r"(?i)^\s*[-_=]{2,} ?(?:original|forwarded|weitergeleitete|ursprüngliche|message|mensaje|mensagem|원본|전달)[^-]{0,40}[-_=]{2,}\s*$|^\s*-{3,} ?[^\d<>@-]{4,40} ?-{3,}\s*$"),
    ("begin_forward", r"(?i)^\s*(?:begin forwarded message|anfang der weitergeleiteten nachricht|début du message (?:transféré|réexpédié)|inicio del mensaje reenviado|início da mensagem (?:encaminhada|reencaminhada)|전달된 메시지)\s*:?\s*$"),
    ("head_from", rf"^\s*\*?{_FROM}\s?:\*? ?\S.*$"),
    ("head", rf"^\s*\*?{_HEAD}\s?:\*?( |$)"),
    ("intro_tail", rf"(?i)^\s*<[^<>\s]+@[^<>\s]+>\s*{_VERB}?\s*:\s*$"),
    ("intro", rf"(?i)(?:\d.*|<[^<>\s]+@[^<>\s]+>.*){_VERB}[^:]{{0,60}}:\s*$|<[^<>\s]+@[^<>\s]+>\s*:\s*$|{_VERB} .{{0,40}}\d{{1,2}}:\d{{2}}\s*:\s*$"),
    ("intro_open", r"^(?:(?:On|Am|Le|El|Em|Il|Den|Op) )?(?:[A-Z][a-z]{2}, )?(?:\d{1,2} [A-Z][a-z]{2} \d{4}|[A-Z][a-z]{2} \d{1,2}, \d{4}|\d{4}-\d{2}-\d{2})(?: (?:at|um|à|a las|às))? \d{1,2}:\d{2}(?:,? \S.{0,60}| schrieb .{1,60})?$"),
    ("banner", r"(?i)^\s*(?:\[extern(?:al|o|e)?\b|\*{2,} ?(?:caution|achtung|warning|attention|cuidado)|⚠|caution:|warning: )"),
    ("device", r"(?i)^\s*(?:sent (?:from|via|with)|get \S+ for|von mein\S+ .{0,40}gesendet|gesendet (?:von|mit)|envoyé (?:de|depuis)|enviado (?:do|desde|de)|내 .{0,20}에서 보냄|.{2,30}에서 보냄)[^.]{0,60}$"),
    ("list", r"(?i)mailing list|unsubscribe|to leave the list|you receive this|abmelden|désabonner|darse de baja|list(?:info|-leave)|-leave@"),
    ("legal", r"(?i)confidentiality notice|may be privileged|\b(?:messages?|e-?mails?|mensaje|mensagem|nachricht|courriel)\b.{0,40}(?:confiden|vertraulich|privileged)|only for the addressee|meant only for|delete it and tell|handelsregister|registered (?:office|in)|sitz der gesellschaft|company no\.|siège social|지정된 수신인|무단 배포|author's and not necessarily|contract is formed by e-mail|before you print|think of the trees|virus|disclaimer|reached you by mistake"),
    ("sep_long", r"^\s*[_=\-]{18,}\s*$"),
    ("sep", r"^\s*(?:--|—|__+|\*{3,}|~{3,}|-{3,}|={3,}|_{5,})\s*$"),
    ("closing", rf"(?i)^\s*{_CLOSING}\s*[,.!，]?\s*$"),
    ("dash_name", rf"^\s*[-–—] ?{_FULL}\s*$"),
    ("stop", rf"^\s*{_FULL}\.\s*$"),
    ("name", rf"^\s*{_FULL}\s*$"),
    ("closing_name", rf"(?i)^\s*{_CLOSING}[,.!]? (?-i:{_FULL})\s*$"),
    ("greeting", r"(?i)^\s*(?:hi|hello|hey|dear|good (?:morning|afternoon|evening|day)|guten (?:tag|morgen|abend)|hallo|liebe[r]?|sehr geehrte|moin|bonjour|bonsoir|salut|cher|chère|hola|estimad|buenos|buenas|prezad|olá|bom dia|boa tarde|caro|cara|안녕하세요)\b?.{0,60}[,!:.]?\s*$|^\s*\S+( \S+)? ?(?:-|,|!|님,|님 안녕하세요,)\s*$"),
    ("card", rf"^\s*{_FULL}\s*(?:[|/] ?\S.{{0,200}}|, [\p{{L}} ]{{3,40}}(?: ?[|/] ?\S.{{0,200}})?)$"),
    ("phone", r"(?i)^\s*(?:☎|📞|(?:tel|fon|phone|mobile|mobil|móvil|telefon|teléfono|fax|t|m|p)\b[.:]*)?\s*[+(]?\d[\d\s().\-/]{5,24}$|^\s*(?:☎|�+ ?\d)"),
    ("mail", r"(?i)^\s*(?:(?:e|mail|e-mail|email)\s*:|mailto:)?\s*\S+@\S+\s*$|^\s*E: \S+"),
    ("url", r"(?i)^\s*(?:https?://|www\.)\S+\s*$"),
    ("item", r"^\s*(?:[-*•]|\d{1,3}[.)])\s"),
    ("table", r"\t"),
    ("address", r"^[^.!?]{0,70}\d[^.!?]{0,40}(?:, ?[^.!?]{2,40}\d*[^.!?]{0,20})?$"),
    ("sentence", r"[.!?。:]['\"”’)]?\s*$"),
]
KIND = {k: i for i, (k, _) in enumerate(KINDS)} | {"long": len(KINDS), "short": len(KINDS) + 1, "tab": len(KINDS) + 2}
N_KINDS = len(KINDS) + 3
EDGE = N_KINDS  # stands for what lies beyond either end
_QUOTE_MARKS = (KIND["gt"], KIND["bar"], KIND["tab"])


def line_kinds(lines: pa.Array) -> np.ndarray:
    """Kind of every line, all lines of a batch at once."""
    kind = np.full(len(lines), KIND["short"], np.int16)
    kind[pc.utf8_length(lines).to_numpy(zero_copy_only=False) > 50] = KIND["long"]
    left = np.arange(len(lines))
    rest = lines
    for name, pattern in KINDS:
        if not len(left):
            break
        hit = pc.match_substring_regex(rest, pattern).to_numpy(zero_copy_only=False)
        kind[left[hit]] = KIND[name]
        left = left[~hit]
        rest = rest.filter(pa.array(~hit))
    indented = pc.starts_with(lines, "\t").to_numpy(zero_copy_only=False)
    kind[indented] = KIND["tab"]
    return kind


#: Characters labelled at a time; a pass takes as many steps as its longest e-mail has lines, so portions are not small.
LINES_PORTION = 4_000_000
#: Shortest line that says where it comes from.
TELLING = 25


def _readable(text: str) -> str:
    """Text with wrongly decoded spans restored, so that its closing words and marks are known; the lines stay the same."""
    if text.isascii() or not suspect(text):
        return text
    fixed = repair(text)[0]
    return fixed if fixed.count("\n") == text.count("\n") else text


class Lines:
    """Non-blank lines of a batch of bodies: owner, number, kind and blank lines around."""

    def __init__(self, bodies: list[str | None]):
        flat = pa.array([_readable((b or "").replace("\r\n", "\n")) for b in bodies], pa.large_string())
        split = pc.split_pattern(flat, "\n")
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        values = pc.list_flatten(split)
        owner = np.repeat(np.arange(len(bodies)), counts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        full = pc.match_substring_regex(values, r"[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]").to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(full)
        self.owner, self.number = owner[keep], number[keep]
        self.text = values.take(pa.array(keep))
        self.kind = line_kinds(self.text)
        n = len(keep)
        first = np.r_[True, self.owner[1:] != self.owner[:-1]] if n else np.zeros(0, bool)
        last = np.r_[first[1:], True] if n else first
        self.first, self.last = first, last
        gap = np.minimum(np.diff(self.number, prepend=0) - 1, 2)
        self.before = np.where(first, 3, gap) if n else gap
        self.after = np.where(last, 3, np.r_[gap[1:], 0]) if n else gap

    def shifted(self, k: int) -> np.ndarray:
        """Kind of the line ``k`` further on in the same e-mail."""
        n = len(self.kind)
        out = np.full(n, EDGE, np.int64)
        if k > 0 and n > k:
            same = self.owner[k:] == self.owner[:-k]
            out[:-k][same] = self.kind[k:][same]
        elif k < 0 and n > -k:
            same = self.owner[-k:] == self.owner[:k]
            out[-k:][same] = self.kind[:k][same]
        return out


#: Kinds that decide what the lines after them are.
_MARKERS = np.zeros(N_KINDS, bool)
_MARKERS[[KIND[k] for k in ("gt", "bar", "tab", "original", "begin_forward", "head_from", "head", "intro", "intro_tail", "intro_open", "banner", "device", "list", "legal", "sep_long", "sep", "closing", "dash_name", "closing_name", "card", "phone", "mail", "url")]] = True


def _context(x: Lines, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind of the last marker above each line, whether blank lines lie between, and whether the e-mail's headers have been quoted above."""
    n = len(x.kind)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(x.first, at, 0))
    mark = np.r_[-1, np.maximum.accumulate(np.where(_MARKERS[x.kind], at, -1))[:-1]]
    has = mark >= start
    last = np.where(has, x.kind[np.maximum(mark, 0)], EDGE).astype(np.int64)
    blanks = np.cumsum(np.where(x.first, 0, x.before > 0))
    gap = np.where(has, blanks - blanks[np.maximum(mark, 0)] > 0, False).astype(np.int64)
    opener = (x.kind == KIND["head_from"]) & (n1 == KIND["head"]) & (x.after == 0) | (x.kind == KIND["original"]) | (x.kind == KIND["begin_forward"])
    opened = np.cumsum(opener)
    seen = (opened - (opened[start] - opener[start]) > 0).astype(np.int64)
    return last, gap, seen


def feature_codes(x: Lines) -> tuple[list[np.ndarray], list[int]]:
    """Categorical features of every line, as codes below a size each."""
    k = x.kind.astype(np.int64)
    m = N_KINDS + 1
    p1, p2, n1, n2 = x.shifted(-1), x.shifted(-2), x.shifted(1), x.shifted(2)
    size = np.bincount(x.owner)[x.owner] if len(k) else k
    start = np.cumsum(np.r_[0, np.bincount(x.owner)])[:-1][x.owner] if len(k) else k
    at = np.arange(len(k)) - start
    to_end = np.minimum(size - at, 9)
    b, a = x.before, x.after
    last, gap, seen = _context(x, n1)
    codes = [
        (seen * m + k, 2 * m), (((last * 2 + gap) * m + k) * 2 + seen, m * m * 4), (((last * 2 + gap) * m + k) * 4 + b, m * m * 8), (((last * 2 + gap) * m + k) * m + n1, m**3 * 2),
        (k, m), (k * 4 + b, m * 4), (k * 4 + a, m * 4), ((k * m + p1) * 4 + b, m * m * 4), ((k * m + n1) * 4 + a, m * m * 4), ((p1 * m + k) * m + n1, m**3), (k * m + p2, m * m),
        (k * m + n2, m * m), (n1 * m + n2, m * m), (p1 * m + p2, m * m), (k * 10 + np.minimum(at, 9), m * 10), (k * 10 + to_end, m * 10), (b * 4 + a, 16), ((k * 4 + b) * 4 + a, m * 16),
        ((k * m + n1) * m + n2, m**3),
    ]
    return [c for c, _ in codes], [s for _, s in codes]


def heuristic(x: Lines) -> np.ndarray:
    """Labels by a reading of whole e-mails: the annotation the model is fitted on."""
    out = np.zeros(len(x.kind), np.int8)
    starts = np.flatnonzero(x.first)
    for a, z in zip(starts, [*starts[1:], len(x.kind)]):
        out[a:z] = _annotate(x.kind[a:z], x.before[a:z], x.after[a:z])
    return out


_NAMED = {KIND[k] for k in ("name", "dash_name")}
_CARD = {KIND[k] for k in ("name", "card", "phone", "mail", "url", "address", "short", "closing_name")}
_HEADS = {KIND["head"], KIND["head_from"]}


def _annotate(kind: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    n, K = len(kind), KIND
    kinds = [int(v) for v in kind]
    out = [NEW] * n
    i = 0
    while i < n:
        k = kinds[i]
        nxt = kinds[i + 1] if i + 1 < n else EDGE
        far = kinds[i + 2] if i + 2 < n else EDGE
        if k in (K["gt"], K["bar"]):
            out[i] = QUOTED
        elif k == K["tab"]:
            out[i] = QUOTED if i and out[i - 1] in (QUOTED, INTRO) else NEW
        elif (
            k == K["original"] and (nxt in _HEADS or nxt == EDGE)
            or k == K["begin_forward"]
            or k == K["sep_long"] and nxt == K["head_from"]
            or k == K["head_from"] and nxt == K["head"] and after[i] == 0
        ):
            for j in range(i, n):
                out[j] = HEADED
            break
        elif k in (K["intro"], K["intro_tail"]) or (k in (K["intro_open"], K["name"], K["short"]) and nxt == K["intro_tail"] and after[i] == 0) or (k == K["intro_open"] and nxt == K["intro"] and after[i] == 0):
            two = k not in (K["intro"], K["intro_tail"])
            out[i] = INTRO
            if two:
                out[i + 1] = INTRO
            following = far if two else nxt
            if following not in _QUOTE_MARKS and following != EDGE:
                for j in range(i + 1 + two, n):
                    out[j] = HEADED
                break
            i += two
        elif k in (K["banner"], K["device"], K["list"]):
            out[i] = NOTICE
            while i + 1 < n and after[i] == 0 and k != K["device"] and k != K["banner"] and kinds[i + 1] not in _QUOTE_MARKS:
                i += 1
                out[i] = NOTICE
        elif k == K["legal"] or (k == K["sep_long"] and nxt in (K["legal"], K["list"])) or (k == K["sep"] and nxt in (K["list"], K["legal"])):
            out[i] = NOTICE
            while i + 1 < n and after[i] == 0 and kinds[i + 1] not in _QUOTE_MARKS:
                i += 1
                out[i] = NOTICE
        elif (
            k == K["closing"] and (nxt in _NAMED or nxt in (K["card"], K["sep"], EDGE) or (nxt == K["closing_name"]) or out[i - 1 if i else 0] == SIGNATURE)
            or k == K["closing_name"] and i > 0
            or k == K["dash_name"] and before[i] in (1, 2)
            or k == K["sep"] and nxt in _CARD and after[i] == 0
            or k in (K["card"], K["name"]) and before[i] in (1, 2) and i and out[i - 1] == SIGNATURE and nxt != K["intro_tail"]
            or k in (K["card"], K["name"]) and before[i] == 2 and nxt in (*_CARD, EDGE)
            or k == K["card"] and before[i] in (1, 2) and after[i] > 0
            or k == K["card"] and before[i] in (1, 2) and (nxt in (K["phone"], K["mail"], K["url"], K["name"], K["address"]) and after[i] == 0)
            or k == K["name"] and before[i] in (1, 2) and nxt in (K["phone"], K["mail"], K["url"], K["sep"])
            or k == K["name"] and before[i] in (1, 2) and nxt == K["name"] and (far in (K["phone"], K["mail"], K["url"]))
        ):
            out[i] = SIGNATURE
            while i + 1 < n and (after[i] == 0 or (k in (K["closing"],) and kinds[i + 1] in _NAMED)) and kinds[i + 1] not in (*_QUOTE_MARKS, K["intro"], K["intro_open"], K["intro_tail"], K["original"], K["banner"], K["device"], K["list"], K["legal"], K["sep_long"], K["head_from"]):
                k = -1
                i += 1
                out[i] = SIGNATURE
        i += 1
    return np.array(out, np.int8)


class LineModel:
    """Weights of the feature codes and of the state transitions."""

    def __init__(self, sizes: list[int]):
        self.offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.w = np.zeros((int(sum(sizes)), len(STATES)), np.float32)
        self.t = np.zeros((len(STATES) + 1, len(STATES)), np.float32)  # the last row is the start

    def emit(self, codes: list[np.ndarray]) -> np.ndarray:
        e = np.zeros((len(codes[0]), len(STATES)), np.float32)
        for c, o in zip(codes, self.offset):
            e += self.w[c + o]
        return e

    def decode(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best states of all sequences; those that are still running advance together, longest first."""
        n = len(e)
        if not n:
            return np.zeros(0, np.int8)
        starts = np.flatnonzero(first)
        length = np.diff(np.append(starts, n))
        order = np.argsort(-length, kind="stable")
        starts, length = starts[order], length[order]
        back = np.zeros((n, len(STATES)), np.int8)
        score = e[starts] + self.t[-1]
        final = np.zeros((len(starts), len(STATES)), np.float32)
        trans = self.t[:-1].copy()
        trans[HEADED, np.arange(len(STATES)) != HEADED] = -1e6  # mail quoted under its headers runs to the end
        live = len(starts)
        for step in range(1, int(length[0]) + 1):
            still = int(np.searchsorted(-length, -step, side="left"))  # sequences longer than step
            final[still:live] = score[still:live]
            if not still:
                break
            score, live = score[:still], still
            both = score[:, :, None] + trans[None]
            at = starts[:still] + step
            back[at] = both.argmax(1)
            score = both.max(1) + e[at]
        out = np.zeros(n, np.int8)
        state = final.argmax(1).astype(np.int8)
        for step in range(int(length[0]) - 1, -1, -1):
            running = int(np.searchsorted(-length, -step, side="left"))
            at = starts[:running] + step
            out[at] = state[:running]
            if step:
                state[:running] = back[at, state[:running]]
        return out


def fit(x: Lines, y: np.ndarray, epochs: int = 8, batch: int = 64, seed: int = 5) -> LineModel:
    """Averaged structured perceptron over mini-batches of whole e-mails."""
    codes, sizes = feature_codes(x)
    model = LineModel(sizes)
    total_w, total_t, n_sum = np.zeros_like(model.w), np.zeros_like(model.t), 0
    starts = np.flatnonzero(x.first)
    ends = np.append(starts[1:], len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs if len(starts) else 0):
        order = rng.permutation(len(starts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            rows = np.concatenate([np.arange(starts[p], ends[p]) for p in pick])
            sub = [c[rows] for c in codes]
            first = x.first[rows]
            got, want = model.decode(model.emit(sub), first), y[rows]
            bad = got != want
            if bad.any():
                for c, o in zip(sub, model.offset):
                    np.add.at(model.w, (c[bad] + o, want[bad]), 1)
                    np.add.at(model.w, (c[bad] + o, got[bad]), -1)
                prev = lambda s: np.where(first, len(STATES), np.r_[0, s[:-1]])
                np.add.at(model.t, (prev(want), want), 1)
                np.add.at(model.t, (prev(got), got), -1)
            total_w += model.w
            total_t += model.t
            n_sum += 1
    if n_sum:
        model.w, model.t = total_w / n_sum, total_t / n_sum
    return model


def label(model: LineModel, bodies: list[str | None]) -> tuple[Lines, np.ndarray]:
    x = Lines(bodies)
    if not len(x.kind):
        return x, np.zeros(0, np.int8)
    return x, model.decode(model.emit(feature_codes(x)[0]), x.first)


def copied(x: Lines, answered: list[str | None]) -> np.ndarray:
    """Lines of blocks of two or more that the answered message (one for each body, null where it is not there) holds word for word."""
    bare = lambda t: t.lstrip("> |\t").strip()
    held = [{bare(line) for line in (a or "").replace("\r\n", "\n").split("\n")} for a in answered]
    hit = np.array([len(b) >= TELLING and b in held[o] for o, b in zip(x.owner.tolist(), map(bare, x.text.to_pylist()))], bool)
    if not len(hit):
        return hit
    near = np.r_[hit[1:] & ~x.first[1:], False] | np.r_[False, hit[:-1] & ~x.first[1:]]
    return hit & near


def _taught(emails: DataFrame, key: str, body: str, reply: tuple[str, str, str] | None, sample: int) -> tuple[Lines, np.ndarray]:
    """(lines of the sample, which of them are copied from the answered message)."""
    blank = F.lit(None).cast("string")
    own, parent = (F.concat_ws("\0", F.col(reply[0]).cast("string"), normalize_message_id(F.col(c))) if reply else blank for c in (reply or ("", "", ""))[1:])
    known = F.length(normalize_message_id(F.col(reply[2]))) > 0 if reply else F.lit(False)
    rows = bounded_sample(emails.select(F.col(key).alias("k"), F.col(body).alias("b"), F.when(known, parent).alias("p")).where("b is not null"), "k", sample)
    wanted = sorted({r["p"] for r in rows if r["p"]})
    found: dict[str, str] = {}
    if wanted:
        keys = emails.sparkSession.createDataFrame([(w,) for w in wanted], "p string")  # at most a row per sampled e-mail
        same = emails.select(own.alias("p"), F.col(body).alias("b")).where("b is not null").join(F.broadcast(keys), "p")
        found = {r["p"]: r["b"] for r in same.groupBy("p").agg(F.min_by("b", F.xxhash64("b")).alias("b")).collect()}
    x = Lines([r["b"] for r in rows])
    return x, copied(x, [found.get(r["p"]) for r in rows])


def fitted(emails: DataFrame, key: str, body: str, sample: int = 4000, reply: tuple[str, str, str] | None = None) -> LineModel:
    """Model of a table.  ``reply``: columns of the account, of the Message-ID and of the answered Message-ID."""
    x, old = _taught(emails, key, body, reply, sample)
    y = heuristic(x)
    y[old & (y == NEW)] = QUOTED
    return fit(x, y)


def evidence_agreement(emails: DataFrame, key: str, body: str, reply: tuple[str, str, str], sample: int = 4000) -> tuple[int, float]:
    """(lines copied from the answered message, share of them that the model takes for earlier mail): a measure the reading has no part in."""
    x, old = _taught(emails, key, body, reply, sample)
    if not old.any():
        return 0, 1.0
    model = fitted(emails, key, body, sample, reply)
    y = model.decode(model.emit(feature_codes(x)[0]), x.first)
    return int(old.sum()), float((y[old] != NEW).mean())


def label_lines(emails: DataFrame, key: str = "email_id", body: str = "body", sample: int = 4000, reply: tuple[str, str, str] | None = None) -> DataFrame:
    """(key, line_no, role) of every non-blank line that its sender did not newly write."""
    model = fitted(emails, key, body, sample, reply)
    # features that the sample never showed have no weight; only the others travel to the executors
    used = np.flatnonzero(np.abs(model.w).sum(1) > 0)
    w, t, offset, shape = model.w[used], model.t, model.offset, model.w.shape
    roles = np.array(STATES, object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = LineModel([0])
        m.offset, m.t = offset, t
        m.w = np.zeros(shape, np.float32)
        m.w[used] = w
        for b in batches:
            bodies, keys = b["_body"].tolist(), b["_key"].to_numpy()
            for a, z in portions(bodies, LINES_PORTION):
                x, y = label(m, bodies[a:z])
                old = y != NEW
                yield pd.DataFrame({"_key": keys[a:z][x.owner[old]], "line_no": x.number[old].astype(np.int32), "role": roles[y[old]]})

    rows = emails.select(F.col(key).cast("bigint").alias("_key"), F.col(body).alias("_body")).where("_body is not null")
    return rows.mapInPandas(run, "_key bigint, line_no int, role string").withColumnRenamed("_key", key)


def new_text(emails: DataFrame, key: str = "email_id", body: str = "body", sample: int = 4000, reply: tuple[str, str, str] | None = None) -> DataFrame:
    """(key, new_text): every body reduced to the lines its sender newly wrote; '' where there are none."""
    model = fitted(emails, key, body, sample, reply)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bodies, keys = b["_body"].tolist(), b["_key"].to_numpy()
            for a, z in portions(bodies, LINES_PORTION):
                texts = [t.replace("\r\n", "\n") for t in bodies[a:z]]
                x, y = label(model, texts)
                drop: dict[int, set[int]] = {}
                for o, no in zip(x.owner[y != NEW].tolist(), x.number[y != NEW].tolist()):
                    drop.setdefault(o, set()).add(no)
                kept = ["\n".join(s for i, s in enumerate(t.split("\n"), 1) if i not in drop.get(o, ())).strip() for o, t in enumerate(texts)]
                yield pd.DataFrame({"_key": keys[a:z], "new_text": kept})

    rows = emails.select(F.col(key).cast("bigint").alias("_key"), F.coalesce(F.col(body), F.lit("")).alias("_body"))
    return rows.mapInPandas(run, "_key bigint, new_text string").withColumnRenamed("_key", key)
