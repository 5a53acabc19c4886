"""Queries of corpus operators, ledger stages, documents and rules over the project's tables, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import identity as I
from threadloom.functions import rules as U
from threadloom.functions import text as X
from threadloom.functions.replies import folder_role
from threadloom.operators import corpora as C
from threadloom.operators import reporting as P
from threadloom.queries.catalogue import _KNN, _ROLE, _U, _WS, _knn, _mid, _slug, _strip, _vectors
from threadloom.runtime import table
from threadloom.streaming import stages as S

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- documents and texts

_ADDR = r'''[^\s<>()\[\]",;:]+@[^\s<>()\[\]",;:]+'''


def _preview(c: str) -> str:
    found = f"regexp_extract_all(coalesce({c}, ''), '{_ADDR}')"
    return f"CASE WHEN len({found}) > 0 THEN array_to_string(list_filter({found}, lambda x, i: list_position({found}, x) = i), ', ') ELSE coalesce({c}, '') END"


@query(f"SELECT email_id, {_preview('to_text')} AS to_preview, {_preview('cc_text')} AS cc_preview FROM thread_emails")
def ref_f9_address_previews(s, sf):
    return table(s, sf, "thread_emails").select("email_id", U.address_preview(F.col("to_text")).alias("to_preview"), U.address_preview(F.col("cc_text")).alias("cc_preview"))


def _cut(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n - 3}) || '...' ELSE {c} END"


_INLINE = lambda c: _strip(f"regexp_replace(coalesce({c}, ''), '{_U}+', ' ', 'g')")
_BODY = _strip(f"array_to_string(list_transform(string_split(replace(replace(coalesce(body, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda l: regexp_replace(l, '{_U}+$', '')), chr(10))")
_KEY = f"CASE WHEN length(k0) > 998 THEN 'mid-sha256:' || sha256(k0) ELSE k0 END"
_DOCS = (
    f"WITH e AS (SELECT *, {_mid('message_id')} AS m, sha256({_INLINE('sender')} || chr(0) || {_INLINE('subject')} || chr(0) || coalesce(date_text, '') || chr(0) || {_BODY}) AS h, {_preview('to_text')} AS tp, {_preview('cc_text')} AS cp, {_slug('subject')} AS slug, "
    f"CASE WHEN coalesce(in_reply_to, '') <> '' THEN {_mid('regexp_split_to_array(trim(in_reply_to, ' + _WS + '), ' + chr(39) + chr(92) + 's+' + chr(39) + ')[1]')} ELSE {_mid('message_id')} END AS root FROM thread_emails), "
    f"f AS (SELECT *, {_KEY} AS k FROM (SELECT *, CASE WHEN m <> '' THEN m ELSE h END AS k0, CASE WHEN root <> '' THEN root WHEN slug <> '' THEN 'subj:' || slug ELSE '' END AS tid FROM e)) "
    f"SELECT 'body:' || k AS doc_id, {_cut('sender', 128)} AS sender, {_cut('subject', 256)} AS subject, \"date\", source, nullif({_cut('tp', 512)}, '') AS \"to\", nullif({_cut('cp', 512)}, '') AS cc, {_cut('tid', 998)} AS thread_id, nullif({_cut('mid', 998)}, '') AS message_id, nullif({_cut('summary', 1024)}, '') AS summary "
    "FROM (SELECT k, tp, cp, tid, coalesce(sender, '') AS sender, coalesce(subject, '') AS subject, coalesce(nullif(date_text, ''), 'unknown') AS \"date\", source_name AS source, coalesce(message_id, '') AS mid, coalesce(summary, '') AS summary FROM f)"
)


@query(_DOCS)
def ref_p9_documents(s, sf):
    return C.documents(table(s, sf, "thread_emails")).select("doc_id", "sender", "subject", "date", "source", "to", "cc", "thread_id", "message_id", "summary")


@query("SELECT doc_id, left(replace(text, chr(0), chr(65533)), 300) AS stored FROM documents")
def ref_f49_storable(s, sf):
    return table(s, sf, "documents").select("doc_id", U.storable(F.col("text"), 300).alias("stored"))


@query("SELECT email_id, 'Question:' || chr(10) || coalesce(subject, '') || chr(10) || chr(10) || 'Message:' || chr(10) || coalesce(body, '') || chr(10) || chr(10) || 'How well does the message answer it, from 0 (not at all) to 3 (fully)? Reply with the figure alone.' AS prompt FROM thread_emails")
def ref_f40_judge_prompts(s, sf):
    return table(s, sf, "thread_emails").select("email_id", U.prompt("judge", query=F.col("subject"), body=F.col("body")).alias("prompt"))


@query("SELECT email_id, CASE WHEN trim(coalesce(summary, '')) <> '' THEN trim(summary) || chr(10) || chr(10) || body ELSE body END AS embedded FROM thread_emails")
def ref_f22_embed_texts(s, sf):
    return table(s, sf, "thread_emails").select("email_id", P.embed_text(F.col("summary"), F.col("body")).alias("embedded"))


@query()
def ref_v7_sentence_chunks(s, sf):
    """Sentences packed to 512 with an overlap of 64; tested against its definition."""
    return C.split_documents(table(s, sf, "documents"), "doc_id", "text")[0]


@query(
    "WITH e AS (SELECT account_id, thread_id, email_id, subject, length(subject) // 4 AS t FROM thread_emails WHERE thread_id <> ''), a AS (SELECT account_id, thread_id, coalesce(sum(t), 0) AS n, count(*) AS c, first(subject ORDER BY email_id) AS f, last(subject ORDER BY email_id) AS l, "
    "string_agg(subject, chr(10) ORDER BY email_id) AS whole FROM e GROUP BY ALL) SELECT account_id, thread_id, CASE WHEN n <= 20 OR c <= 2 THEN coalesce(whole, '') ELSE concat_ws(chr(10), f, '[' || (c - 2) || ' messages left out]', l) END AS text, CASE WHEN n <= 20 OR c <= 2 THEN 0 ELSE c - 2 END AS left_out FROM a"
)
def ref_w11_thread_texts(s, sf):
    e = table(s, sf, "thread_emails").where("thread_id <> ''").select("account_id", "thread_id", "email_id", "subject")
    return C.bound_threads(e, ["account_id", "thread_id"], ["email_id"], "subject", 20)


# ---------------------------------------------------------------- ledger


@query(f"SELECT folder, count(*) AS n, count(CASE WHEN CASE lower(trim(folder)) {_ROLE} ELSE 'other' END NOT IN ('junk', 'trash') THEN 1 END) AS wanted FROM messages GROUP BY folder")
def ref_p21_wanted_roles(s, sf):
    role = folder_role(F.col("folder"), F.array().cast("array<string>"))
    return table(s, sf, "messages").groupBy("folder").agg(F.count("*").alias("n"), F.count_if(U.wanted_role(role, [], ["junk", "trash"])).alias("wanted"))


@query("SELECT a.account_id, m.t IS NULL OR epoch_us(n.t) - epoch_us(m.t) >= 86400 * 0.9 * 1000000 AS due FROM accounts a LEFT JOIN (SELECT account_id, max(fetched_at) AS t FROM messages WHERE state = 'done' GROUP BY 1) m ON m.account_id = a.account_id, (SELECT max(fetched_at) AS t FROM messages) n")
def ref_p23_due_accounts(s, sf):
    """Accounts whose last finished message is a day old, less the grace, when the last of all was fetched."""
    m = table(s, sf, "messages")
    last = m.where("state = 'done'").groupBy("account_id").agg(F.max("fetched_at").alias("t"))
    now = m.agg(F.max("fetched_at")).first()[0]
    return table(s, sf, "accounts").select("account_id").join(last, "account_id", "left").select("account_id", U.is_due(F.lit(86400), F.col("t"), F.lit(now).cast("timestamp")).alias("due"))


def _ledger(s, sf):
    m = table(s, sf, "messages")
    return m.select("account_id", F.col("delivery_id").cast("string").alias("message_key"), "state", F.lit(None).cast("timestamp").alias("judged_at"), F.lit(None).cast("timestamp").alias("indexed_at"), "error", "attempts", "internal_date", (~F.endswith(F.coalesce("eml_path", F.lit("")), F.lit("7.eml"))).alias("eml_exists"))


@query(
    "SELECT CAST(delivery_id AS VARCHAR) AS message_key, CASE WHEN state = 'abandoned' THEN 'new' WHEN attempts >= 2 AND state <> 'done' THEN 'abandoned' WHEN state IN ('new', 'indexed_unjudged', 'done') THEN 'judged' ELSE state END AS state, "
    "CASE WHEN state = 'abandoned' THEN NULL WHEN attempts >= 2 AND state <> 'done' THEN 'too many' WHEN attempts >= 2 THEN error ELSE NULL END AS error, CASE WHEN state = 'abandoned' THEN 0 ELSE coalesce(attempts, 0) END AS attempts, state <> 'abandoned' AND coalesce(attempts, 0) < 2 AS stamped FROM "
    "(SELECT delivery_id, attempts, error, CASE WHEN state = 'done' AND coalesce(attempts, 0) >= 2 THEN 'done' ELSE state END AS state FROM messages) WHERE NOT (state = 'done' AND coalesce(attempts, 0) >= 2) "
    "UNION ALL SELECT CAST(delivery_id AS VARCHAR), state, error, attempts, FALSE FROM messages WHERE state = 'done' AND coalesce(attempts, 0) >= 2"
)
def ref_t7_applied_events(s, sf):
    """Abandoned deliveries are put back in play, those with two attempts are given up (which a finished one refuses), all others are judged."""
    led = _ledger(s, sf)
    event = F.when(F.col("state") == "abandoned", "requeued").when(F.coalesce("attempts", F.lit(0)) >= 2, "abandoned").otherwise("judged")
    events = led.select(*S.KEY, F.lit(0).cast("bigint").alias("order_no"), event.alias("event"), F.when(event == "abandoned", "too many").otherwise("").alias("reason"))
    return S.apply_events(led, events).select("message_key", "state", "error", "attempts", F.col("judged_at").isNotNull().alias("stamped"))


@query(
    "WITH w AS (SELECT CAST(delivery_id AS VARCHAR) AS message_key, coalesce(attempts, 0) AS a, NOT coalesce(eml_path, '') LIKE '%7.eml' AS x, delivery_id % 5 AS r FROM messages WHERE state IN ('new', 'indexed_unjudged')) "
    "SELECT message_key, 'abandoned' AS event, 0 AS order_no FROM w WHERE NOT x UNION ALL SELECT message_key, CASE WHEN r = 0 THEN 'failed' ELSE 'judged' END, 0 FROM w WHERE x AND r <> 1 UNION ALL SELECT message_key, 'abandoned', 1 FROM w WHERE x AND r = 0 AND a + 1 >= 3"
)
def ref_t8_judge_events(s, sf):
    """A sweep in which a fifth of the deliveries fail and another fifth find the endpoint unavailable."""
    waiting = S.work(_ledger(s, sf), "judged")
    r = F.col("message_key").cast("bigint") % 5
    outcomes = waiting.select(*S.KEY, F.when(r == 0, "error").when(r == 1, "unavailable").otherwise("done").alias("outcome"))
    return S.judge_stage(waiting, outcomes, lambda: True).select("message_key", "event", F.col("order_no").cast("int").alias("order_no"))


@query("SELECT CAST(delivery_id AS VARCHAR) AS message_key, CASE delivery_id % 4 WHEN 0 THEN 'abandoned' WHEN 1 THEN 'deferred' WHEN 2 THEN 'indexed' ELSE 'abandoned' END AS event, CASE delivery_id % 4 WHEN 0 THEN 'attachments cannot be stored' WHEN 1 THEN 'attachments failed' WHEN 2 THEN '' ELSE 'did not reach the index' END AS reason FROM messages WHERE state = 'judged'")
def ref_t9_index_events(s, sf):
    waiting = S.work(_ledger(s, sf), "indexed")
    r = F.col("message_key").cast("bigint") % 4
    attached = waiting.select(*S.KEY, F.when(r == 0, "permanent").when(r == 1, "transient").otherwise("").alias("failure"))
    return S.index_stage(waiting, attached, waiting.where(r == 2)).select("message_key", "event", "reason")


@query(
    "SELECT user_id, list_reduce(list_prepend('new', list(e ORDER BY event_id)), lambda s, e: CASE WHEN e = 'judged' AND s IN ('new', 'indexed_unjudged', 'done') THEN 'judged' WHEN e = 'indexed' AND s = 'new' THEN 'indexed_unjudged' WHEN e = 'indexed' AND s = 'judged' THEN 'done' WHEN e = 'abandoned' AND s IN ('new', 'indexed_unjudged', 'judged') THEN 'abandoned' WHEN e = 'requeued' AND s = 'abandoned' THEN 'new' ELSE s END) AS state, "
    "count(*) AS n_events FROM (SELECT user_id, event_id, ['judged', 'indexed', 'abandoned', 'requeued'][event_id % 4 + 1] AS e FROM events) GROUP BY user_id"
)
def ref_t7_folded_in_blocks(s, sf):
    e = F.element_at(F.array(*map(F.lit, ("judged", "indexed", "abandoned", "requeued"))), (F.col("event_id") % 4 + 1).cast("int"))
    ev = table(s, sf, "events").select("user_id", "event_id", e.alias("e"))
    return S.fold_in_blocks(ev, ["user_id"], "event_id", "e", block=1000).select("user_id", "state", "n_events")


@query("SELECT account_id, content_sha256 FROM messages WHERE fetched_at IS NOT NULL EXCEPT SELECT account_id, content_sha256 FROM messages WHERE indexed_at IS NOT NULL")
def ref_u4_dropped(s, sf):
    m = table(s, sf, "messages")
    return S.dropped(m.where("fetched_at is not null"), m.where("indexed_at is not null"), ["account_id", "content_sha256"])


@query(f"SELECT DISTINCT p AS mid FROM (SELECT {_mid('in_reply_to')} AS p FROM thread_emails) WHERE p <> '' AND p NOT IN (SELECT {_mid('message_id')} FROM thread_emails)")
def ref_u5_missing_parents(s, sf):
    e = table(s, sf, "thread_emails")
    parents = e.select(I.normalize_message_id(F.col("in_reply_to")).alias("mid")).where("mid <> ''")
    return C.missing(parents, e.select(I.normalize_message_id(F.col("message_id")).alias("mid")), "mid")


@query("SELECT content_sha256, count(*) AS n FROM messages WHERE content_sha256 NOT IN (SELECT content_sha256 FROM messages WHERE judged_at IS NOT NULL AND content_sha256 IS NOT NULL) GROUP BY content_sha256")
def ref_j6_never_judged(s, sf):
    m = table(s, sf, "messages").select("content_sha256", "judged_at").where("content_sha256 is not null")
    return m.join(m.where("judged_at is not null").select("content_sha256"), "content_sha256", "left_anti").groupBy("content_sha256").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- judgments and evaluation


@query("SELECT count(*) AS n, coalesce(round(avg(CASE WHEN a.v IS NOT DISTINCT FROM b.v THEN 1 ELSE 0 END), 9), 0) AS agreement FROM (SELECT content_sha256 AS k, max(state) AS v FROM messages WHERE folder = 'INBOX' GROUP BY 1) a JOIN (SELECT content_sha256 AS k, max(state) AS v FROM messages WHERE folder <> 'INBOX' GROUP BY 1) b ON a.k = b.k")
def ref_j11_agreement_on_shared_keys(s, sf):
    m = table(s, sf, "messages")
    side = lambda c: m.where(c).groupBy("content_sha256").agg(F.max("state").alias("v"))
    return C.agreement(side("folder = 'INBOX'"), side("folder <> 'INBOX'"), ["content_sha256"], "v").withColumn("agreement", F.round("agreement", 9))


@query("SELECT count(*) AS total, count(CASE WHEN content_kind = 'newsletter' THEN 1 END) AS noise, count(CASE WHEN content_kind IS DISTINCT FROM 'newsletter' THEN 1 END) AS kept FROM documents")
def ref_a6_judgment_counts(s, sf):
    return C.judgment_counts(table(s, sf, "documents").select((F.col("content_kind") == "newsletter").alias("is_noise")))


@query("SELECT arm, CASE WHEN g = 1 THEN 'ALL' ELSE category END AS category, n, hit FROM (SELECT source AS arm, content_kind AS category, grouping(content_kind) AS g, count(*) AS n, count(CASE WHEN n_chars >= 500 THEN 1 END) AS hit FROM documents GROUP BY GROUPING SETS ((source, content_kind), (source)))")
def ref_a10_recall_counts(s, sf):
    return C.recall_counts(table(s, sf, "documents").select(F.col("source").alias("arm"), F.col("content_kind").alias("category"), (F.col("n_chars") >= 500).alias("hit")), ["hit"])


@query(_KNN + ", f AS (SELECT query, label, min(rank) AS r FROM knn GROUP BY ALL), p AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY r, label) AS k FROM f) SELECT count(*) AS n_queries, round(avg(CASE WHEN p.k IS NULL THEN 0 ELSE 1 END), 9) AS coverage FROM (SELECT vec_id AS query, label FROM embeddings WHERE vec_id % 100 = 0) g LEFT JOIN p ON p.query = g.query AND p.label = g.label AND p.k <= 3")
def ref_a26_coverage_at_3(s, sf):
    v = _vectors(s, sf).select("item", F.col("label").cast("string").alias("thread_id"))
    hits = _knn(s, sf).join(v, "item").select("query", "thread_id", "rank")
    gold = v.where("item % 100 = 0").select(F.col("item").alias("query"), "thread_id")
    return C.coverage_at(hits, gold, 3).withColumn("coverage", F.round("coverage", 9))


@query("SELECT count(*) AS n, round(100.0 * count(CASE WHEN t > 512 THEN 1 END) / count(*), 9) AS percent FROM (SELECT sum(length(body) // 4) AS t FROM thread_emails WHERE thread_id <> '' GROUP BY account_id, thread_id)")
def ref_a28_over_budget(s, sf):
    t = table(s, sf, "thread_emails").where("thread_id <> ''").groupBy("account_id", "thread_id").agg(F.sum(X.estimate_tokens(F.col("body"))).alias("t"))
    return C.over_budget(t, "t", 512).withColumn("percent", F.round("percent", 9))


@query("SELECT source AS setup, count(n_chars) AS n, round(avg(least(n_chars // 300, 3)), 9) AS mean_grade FROM documents GROUP BY source")
def ref_a31_mean_grades(s, sf):
    g = table(s, sf, "documents").select(F.col("source").alias("setup"), F.least(F.floor(F.col("n_chars") / 300), F.lit(3)).alias("grade"))
    return C.mean_grades(g).withColumn("mean_grade", F.round("mean_grade", 9))


@query(
    _KNN + ", g AS (SELECT vec_id AS query, label FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT k.query, min(k.rank) - 1 AS r FROM knn k JOIN g ON g.query = k.query AND g.label = k.label GROUP BY 1) "
    "SELECT g.query, CASE WHEN r < 3 THEN 'covered' WHEN r < 10 THEN 'budget' WHEN r < 20 THEN 'fusion' ELSE 'hard' END AS bucket FROM g LEFT JOIN b ON b.query = g.query"
)
def ref_f30_miss_buckets(s, sf):
    """Where the first hit of a query's own label stands."""
    v = _vectors(s, sf).select("item", "label")
    gold = v.where("item % 100 = 0").select(F.col("item").alias("query"), "label")
    best = _knn(s, sf).join(v, "item").join(gold, ["query", "label"]).groupBy("query").agg((F.min("rank") - 1).alias("r"))
    r = F.col("r")
    return gold.join(best, "query", "left").select("query", U.miss_bucket(r, r, r, F.lit(None).cast("int")).alias("bucket"))


@query(
    _KNN + ", g AS (SELECT vec_id AS query, label FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT k.query, min(k.rank) - 1 AS r FROM knn k JOIN g ON g.query = k.query AND g.label = k.label GROUP BY 1), m AS (SELECT CASE WHEN r < 3 THEN 'covered' WHEN r < 10 THEN 'budget' WHEN r < 20 THEN 'fusion' ELSE 'hard' END AS bucket FROM g LEFT JOIN b ON b.query = g.query) "
    "SELECT bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM m GROUP BY bucket"
)
def ref_a29_miss_histogram(s, sf):
    c = ref_f30_miss_buckets(s, sf).groupBy("bucket").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("_n"))
    return c.crossJoin(F.broadcast(total)).select("bucket", "n", F.round(100.0 * F.col("n") / F.col("_n"), 6).alias("percent"))  # one row


@query(
    "WITH q AS (SELECT account_id || ':' || thread_id AS t FROM thread_emails WHERE thread_id <> '' GROUP BY 1 HAVING count(*) BETWEEN 3 AND 6) "
    "SELECT q.t AS query, q.t AS thread_id, list_sort(list(DISTINCT m.message_id)) AS message_ids, len(list(DISTINCT m.message_id)) AS n_messages FROM q JOIN (SELECT account_id || ':' || thread_id AS t, message_id FROM thread_emails WHERE thread_id <> '' AND message_id IS NOT NULL) m ON m.t = q.t GROUP BY q.t"
)
def ref_j21_spanning_members(s, sf):
    e = table(s, sf, "thread_emails").where("thread_id <> ''").select(F.concat_ws(":", "account_id", "thread_id").alias("thread_id"), "message_id")
    q = e.groupBy("thread_id").agg(F.count("*").alias("n")).where("n between 3 and 6").select(F.col("thread_id").alias("query"), "thread_id")
    return C.spanning_members(q, e.where("message_id is not null")).select("query", "thread_id", "message_ids", F.col("n_messages").cast("bigint").alias("n_messages"))


@query("SELECT query, item, arm, rank FROM (SELECT query, item, arm, rank, row_number() OVER (PARTITION BY query, item ORDER BY arm, rank) AS k FROM (SELECT thread_id AS query, sender AS item, 'documents' AS arm, doc_id AS rank FROM documents WHERE thread_id <> '' AND sender IS NOT NULL UNION ALL SELECT thread_id, sender, 'emails', email_id FROM thread_emails WHERE thread_id <> '' AND sender IS NOT NULL)) WHERE k = 1")
def ref_u1_pooled_hits(s, sf):
    """Senders of each conversation from two arms, each once with the first arm's best rank."""
    arm = lambda t, name, i: table(s, sf, t).where("thread_id <> '' and sender is not null").select(F.col("thread_id").alias("query"), F.col("sender").alias("item"), F.lit(name).alias("arm"), F.col(i).alias("rank"))
    return C.pooled(arm("documents", "documents", "doc_id").unionByName(arm("thread_emails", "emails", "email_id")))


@query("SELECT email_id, CASE WHEN len(lines) > 0 THEN lines ELSE [subject] END AS lines FROM (SELECT email_id, subject, list_transform(list_filter(string_split(coalesce(body, ''), chr(10)), lambda l: contains(lower(l), 'scaffold'))[1:20], lambda l: trim(substr(l, greatest(1, instr(lower(l), 'scaffold') - 96), 200))) AS lines FROM thread_emails WHERE contains(lower(coalesce(body, '')), 'scaffold') OR contains(lower(coalesce(subject, '')), 'scaffold')) ORDER BY email_id LIMIT 500")
def ref_l5_bounded_grep(s, sf):
    """The bounded scan; its limit of 500 matches is the operator's own."""
    rows, _ = C.bounded_grep(table(s, sf, "thread_emails"), "scaffold")
    return s.createDataFrame([tuple(r) for r in rows], "email_id bigint, lines array<string>")
