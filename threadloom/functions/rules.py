"""Small decision rules as Columns or driver scalars: F30, F35, F36, F40, F43, F49, F53, F9, P13, P20, P21, P23, A37, K17, W11."""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.identity import strip

#: Threads shown, hits expanded, and the depth of a single leg.
SHOWN, EXPANDED, LEG_DEPTH = 3, 10, 20
#: Shared vocabulary under which a question cannot be answered from its thread; ties in gain; share of long threads in percent.
LEAST_OVERLAP, TIE, LONG_SHARE = 0.15, 0.02, 10.0
#: Words of records and of promotions.
RECORD = r"(?i)receipt|invoice|order|booking|reservation|statement|payment|delivery|shippe|itinerary|ticket|boarding|refund|transaction|account|policy|\btax\b|enrol|appointment|\bbill"
PROMOTION = r"(?i)market|promot|newsletter|\bsale\b|discount|offer|advertis|\bdeal\b|digest|recommend"
#: Fixed value: share of a cadence by which a run may come early.
GRACE = 0.1
#: Fixed value: longest argument kept in the log of calls.
ARGUMENT_CHARS = 200


def miss_bucket(distinct_rank: Column, thread_rank: Column, dense_rank: Column, sparse_rank: Column) -> Column:
    """F30. Where the wanted thread sank: shown, in reach of the expansion, seen by one leg, or hard.  Ranks count from 0, null is absent."""
    return F.when(distinct_rank < SHOWN, "covered").when(thread_rank < EXPANDED, "budget").when((dense_rank < LEG_DEPTH) | (sparse_rank < LEG_DEPTH), "fusion").otherwise("hard")


def root_cause(body_rank: Column) -> Column:
    """F30. Of a hard miss: its own body finds the thread, so words differ, or does not."""
    return F.when(body_rank < EXPANDED, "vocab_gap").otherwise("index_or_chunking")


def bad_query(body_rank: Column, overlap: Column) -> Column:
    return (root_cause(body_rank) == "index_or_chunking") & (overlap < LEAST_OVERLAP)


def decisions(gains: dict[str, dict[str, float]], thread_arm: str, other_arms: Iterable[str], long_percent: float | None = None) -> dict[str, bool]:
    """F35. Whether threads replace the other arms: as good within the tie on terse and spanning questions and at least as good on content; and whether long threads must be bounded."""
    mine = lambda g: gains.get(thread_arm, {}).get(g, 0.0)
    best = lambda g: max((gains.get(a, {}).get(g, 0.0) for a in other_arms), default=0.0)
    slack = {"terse": TIE, "spanning": TIE, "content": 0.0}
    return {"retire": all(mine(g) + s >= best(g) for g, s in slack.items()), "bound": (long_percent or 0.0) > LONG_SHARE}


def default_clusters(n: int, asked: int | None = None, most: int = 50) -> int:
    """F36. Half the threads' root, or what was asked for, between 2 and the cap."""
    return max(2, min(asked or max(2, round(math.sqrt(n / 2))), most, n))


def recommended_persona(obvious: float, enough: float) -> str:
    """F36. Verified trimming where enough is obvious noise, else judging everything."""
    return "llm-verify" if obvious >= enough else "llm-all"


def _joined(*columns: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])


def false_noise(is_noise: Column, subject: Column, reason: Column, summary: Column) -> Column:
    """P13. Judged noise, though it reads like a record."""
    return F.coalesce(is_noise, F.lit(False)) & _joined(subject, reason, summary).rlike(RECORD)


def false_keep(is_noise: Column, subject: Column, reason: Column, summary: Column) -> Column:
    """P13. Kept, though it reads like a promotion and not like a record."""
    return ~F.coalesce(is_noise, F.lit(False)) & _joined(subject, reason, summary).rlike(PROMOTION) & ~_joined(subject, summary).rlike(RECORD)


def usable(questions: Column, text: Column, least: int = 120) -> Column:
    """P20. A benchmark row with a question and enough text."""
    return F.coalesce((F.size(questions) > 0) & (F.length(text) > least), F.lit(False))


def wanted_role(role: Column, include: list[str], exclude: list[str]) -> Column:
    """P21. Exclusion wins; without an inclusion list everything else is wanted."""
    return ~role.isin(*exclude) & (role.isin(*include) if include else F.lit(True))


def is_due(cadence_seconds: Column, last_success: Column, now: Column) -> Column:
    """P23. Whether the cadence, less its grace, has passed since the last success; without a readable one it is due."""
    since = F.try_to_timestamp(last_success.cast("string"))
    elapsed = F.unix_micros(now) / 1e6 - F.unix_micros(since) / 1e6
    return F.coalesce(elapsed >= cadence_seconds * (1 - GRACE), F.lit(True))


def shortest_cadence(cadences: DataFrame, column: str) -> int:
    """A37. The shortest positive cadence; none is an error."""
    least = cadences.where(F.col(column) > 0).agg(F.min(column)).first()[0]
    if least is None:
        raise ValueError("no cadence given")
    return int(least)


def address_preview(header: Column) -> Column:
    """F9. The addresses of a header, each once, in order; the header itself where it has none."""
    found = F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit(r"[^\s<>()\[\]\",;:]+@[^\s<>()\[\]\",;:]+"), F.lit(0))
    return F.when(F.size(found) > 0, F.array_join(F.array_distinct(found), ", ")).otherwise(F.coalesce(header, F.lit("")))


def payload_body(payload: Column) -> Column:
    """F43. Text of a stored point: its own field, else that of the node it nests as JSON, else ''."""
    nested = F.get_json_object(payload, "$._node_content")
    found = [F.nullif(F.get_json_object(c, p), F.lit("")) for c, p in ((payload, "$.text"), (nested, "$.text"), (nested, "$.text_resource.text"), (payload, "$.body"))]
    return F.coalesce(*found, F.lit(""))


def storable(c: Column, most: int) -> Column:
    """F49. Text that any store takes: invalid sequences and NULs replaced, cut to ``most`` code points."""
    return F.left(F.translate(F.decode(F.encode(F.coalesce(c, F.lit("")), "UTF-8"), "UTF-8"), "\0", "�"), F.lit(most))


def failure_class(error: BaseException) -> str:
    """F53. 'unavailable' where the error, or one it came from, is of the connection or the system; else 'error'."""
    seen: set[int] = set()
    e: BaseException | None = error
    while e is not None and id(e) not in seen:
        seen.add(id(e))
        if isinstance(e, (ConnectionError, TimeoutError)) or (isinstance(e, OSError) and not isinstance(e, FileNotFoundError)) or type(e).__name__ in ("APIConnectionError", "APITimeoutError"):
            return "unavailable"
        e = e.__cause__ or e.__context__
    return "error"


def failure_is_permanent(error: BaseException) -> bool:
    """F53. Whether the next run would only repeat a failure of the attachment store."""
    return isinstance(error, (PermissionError, NotADirectoryError, IsADirectoryError))


def argument_summary(arguments: dict[str, Any], names_only: bool = False) -> dict[str, Any]:
    """K17. Arguments a caller chose, long texts cut, other objects by their type."""

    def brief(v: Any) -> Any:
        if not names_only and isinstance(v, (bool, int, float)):
            return v
        if not names_only and isinstance(v, str):
            return v if len(v) <= ARGUMENT_CHARS else v[:ARGUMENT_CHARS] + "…"
        return f"<{type(v).__name__}>"

    return {k: brief(v) for k, v in arguments.items() if v is not None}


#: Own wording; the named parts are filled by ``prompt``.
PROMPTS = {
    "summary": "Sum up this message in one or two sentences.\n\nFrom: {sender}\nSubject: {subject}\n\n{body}",
    "preceding": "Earlier messages of the conversation:\n{context}\n\nSum up what this message adds, in one or two sentences.\n\nFrom: {sender}\nSubject: {subject}\n\n{body}",
    "thread": "The conversation:\n{context}\n\nSum up this message in the light of the whole conversation, in one or two sentences.\n\nSubject: {subject}\n\n{body}",
    "rubric": "{rubric}\n\nDecide whether this message is noise. Reply with JSON: summary, is_noise, confidence (0 to 1), reason.\n\nFrom: {sender}\nSubject: {subject}\n\n{body}",
    "hypothetical": "Write a short message that would answer this question.\n\n{query}",
    "judge": "Question:\n{query}\n\nMessage:\n{body}\n\nHow well does the message answer it, from 0 (not at all) to 3 (fully)? Reply with the figure alone.",
    "answer": "Answer from the conversations below only, and name the messages used. Say so if they do not hold the answer.\n\n{context}\n\nQuestion: {query}",
    "valid": "Can this question be answered from the conversation alone? Reply with JSON: valid (true or false).\n\n{context}\n\nQuestion: {query}",
}


def prompt(kind: str, **parts: Column) -> Column:
    """F40. A prompt of a kind with its parts filled in; a null part is empty."""
    import re

    out = [F.lit(x) if i % 2 == 0 else F.coalesce(parts[x], F.lit("")) for i, x in enumerate(re.split(r"\{(\w+)\}", PROMPTS[kind]))]
    return F.concat(*out)


def bounded_thread(lines: Column, budget: int, size) -> Column:
    """W11. The lines of a thread where they fit; else the first and the last with a note of how many were left out between them."""
    total = F.aggregate(F.transform(lines, size), F.lit(0), lambda a, n: a + n.cast("int"))
    short = F.array(F.element_at(lines, 1), F.format_string("[%d messages left out]", F.size(lines) - 2), F.element_at(lines, -1))
    return F.when((F.size(lines) <= 2) | (total <= budget), lines).otherwise(short)


def blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""
