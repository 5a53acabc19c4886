"""Queries of the reference-style operators over the project's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import evaluation as E
from threadloom.functions import identity as I
from threadloom.functions import text as X
from threadloom.functions.replies import ROLES, folder_role
from threadloom.operators import mail as M
from threadloom.operators import retrieval as R
from threadloom.operators.products import best
from threadloom.runtime import table

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


# SQL fragments: white space as the expressions trim it, and a normalised id
_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


def _mid(c: str) -> str:
    return f"trim(regexp_replace(trim(coalesce({c}, ''), {_WS}), '^<(.*)>$', '\\1', 's'), {_WS})"


def _slug(c: str) -> str:
    ws = "[\\s\\x{a0}\\x{2007}\\x{202f}\\x{85}]"
    return f"lower(trim(regexp_replace(regexp_replace(coalesce({c}, ''), '^{ws}*((re|fwd|fw){ws}*:{ws}*)+', '', 'i'), '{ws}+', ' ', 'g')))"


# ---------------------------------------------------------------- identity and scalar text


@query(f"SELECT email_id, {_mid('message_id')} AS mid, {_mid('in_reply_to')} AS parent FROM thread_emails")
def ref_f1_message_ids(s, sf):
    return table(s, sf, "thread_emails").select("email_id", I.normalize_message_id(F.col("message_id")).alias("mid"), I.normalize_message_id(F.col("in_reply_to")).alias("parent"))


@query(f"SELECT email_id, {_slug('subject')} AS slug, regexp_replace(coalesce(subject, ''), '^\\s*(re|fwd|fw)\\s*:\\s*', '', 'i') AS one FROM thread_emails")
def ref_f2_subject_slugs(s, sf):
    return table(s, sf, "thread_emails").select("email_id", I.subject_slug(F.col("subject")).alias("slug"), I.strip_one_prefix(F.col("subject")).alias("one"))


@query(
    f"SELECT email_id, CASE WHEN k <> '' THEN k WHEN slug <> '' THEN 'subj:' || slug ELSE '' END AS tid FROM (SELECT email_id, {_slug('subject')} AS slug, "
    f"CASE WHEN coalesce(in_reply_to, '') <> '' THEN {_mid('regexp_split_to_array(trim(in_reply_to, ' + _WS + chr(41) + ', ' + chr(39) + chr(92) + 's+' + chr(39) + ')[1]')} ELSE {_mid('message_id')} END AS k FROM thread_emails)"
)
def ref_f3_thread_ids(s, sf):
    e = table(s, sf, "thread_emails")
    return e.select("email_id", I.thread_id(F.col("message_id"), F.col("in_reply_to"), F.lit(None).cast("string"), F.col("subject")).alias("tid"))


#: White space as Unicode has it, and the four separator controls.
_U = "[\\s\\x{b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_U}+', ''), '{_U}+$', '')"


@query(
    f"SELECT doc_id, sha256({_strip(f"regexp_replace(coalesce(sender, ''), '{_U}+', ' ', 'g')")} || chr(0) || '' || chr(0) || coalesce(lang, '') || chr(0) || "
    f"{_strip(f"array_to_string(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda l: regexp_replace(l, '{_U}+$', '')), chr(10))")}) AS digest FROM documents"
)
def ref_f5_content_hashes(s, sf):
    return table(s, sf, "documents").select("doc_id", I.content_sha256(F.col("sender"), F.lit(""), F.col("lang"), F.col("text")).alias("digest"))


@query(f"SELECT delivery_id, CASE WHEN length(k) > 998 THEN 'mid-sha256:' || sha256(k) ELSE k END AS message_key FROM (SELECT delivery_id, CASE WHEN m <> '' THEN m ELSE content_sha256 END AS k FROM (SELECT delivery_id, content_sha256, {_mid('message_id')} AS m FROM messages))")
def ref_f5_message_keys(s, sf):
    return table(s, sf, "messages").select("delivery_id", I.message_key(F.col("message_id"), F.col("content_sha256")).alias("message_key"))


#: Fixed value: name space of chunk ids.
_NS = "6f1d2a3e9c474b8a9f1e2d5c7a840b13"


@query(
    f"SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid "
    f"FROM (SELECT doc_id, sha1(unhex('{_NS}') || encode('body:' || doc_id || ':0')) AS h FROM documents)"
)
def ref_f6_point_ids(s, sf):
    return table(s, sf, "documents").select("doc_id", I.uuid5(_NS, F.concat(F.lit("body:"), F.col("doc_id"), F.lit(":0"))).alias("uuid"))


@query("SELECT doc_id, CASE WHEN length(text) > 256 THEN substr(text, 1, 253) || '...' ELSE text END AS cut FROM documents")
def ref_f8_truncated(s, sf):
    return table(s, sf, "documents").select("doc_id", I.truncate(F.col("text"), 256).alias("cut"))


@query("SELECT email_id, regexp_replace(regexp_replace(regexp_replace(body, '(?i)data:[a-zA-Z0-9_./+-]{0,128}(?:;[a-zA-Z0-9_-]+=[a-zA-Z0-9_.-]+)*;base64,[A-Za-z0-9+/]+={0,2}', ' ', 'g'), '[A-Za-z0-9+/]{300,}={0,2}', ' ', 'g'), '[A-Za-z0-9+]{200,}={0,2}', ' ', 'g') AS stripped FROM thread_emails")
def ref_f16_blobs_stripped(s, sf):
    return table(s, sf, "thread_emails").select("email_id", X.strip_encoded_blobs(F.col("body")).alias("stripped"))


@query(
    "SELECT email_id, CASE WHEN n = 1 AND length(body) - length(kept) <= 600 AND (length(substr(body, length(kept) + 1)) - length(replace(substr(body, length(kept) + 1), chr(10), ''))) <= 12 AND length(trim(kept, ' ' || chr(9) || chr(10) || chr(13))) >= 40 THEN kept ELSE body END AS stripped "
    "FROM (SELECT email_id, body, len(regexp_extract_all(body, '\\n--[ \\t]*\\n')) AS n, split_part(regexp_replace(body, '\\n--[ \\t]*\\n', chr(1), 'g'), chr(1), 1) AS kept FROM thread_emails)"
)
def ref_f18_signatures_stripped(s, sf):
    return table(s, sf, "thread_emails").select("email_id", X.strip_signature(F.col("body")).alias("stripped"))


@query()
def ref_f19_clean_bodies(s, sf):
    return table(s, sf, "thread_emails").select("email_id", X.clean_body(F.col("body")).alias("clean"))


@query()
def ref_f21_numeric_tokens(s, sf):
    return table(s, sf, "documents").select("doc_id", F.array_join(X.numeric_tokens(F.col("text")), " ").alias("figures"))


@query("SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS est, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ascii_words FROM documents")
def ref_f25_token_estimates(s, sf):
    return table(s, sf, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("est"), F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).cast("bigint").alias("ascii_words"))


@query(
    "SELECT email_id, CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, t)) / len(q) END AS overlap FROM (SELECT email_id, list_distinct(regexp_extract_all(lower(coalesce(subject, '')), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(body), '[a-z0-9]+')) AS t FROM thread_emails)"
)
def ref_f29_lexical_overlap(s, sf):
    return table(s, sf, "thread_emails").select("email_id", X.lexical_overlap(F.coalesce("subject", F.lit("")), F.col("body")).alias("overlap"))


@query("SELECT email_id, regexp_extract(lower(sender), '@([\\w.\\-]+)', 1) AS domain FROM thread_emails WHERE sender IS NOT NULL")
def ref_f42_sender_domains(s, sf):
    return table(s, sf, "thread_emails").where("sender is not null").select("email_id", X.sender_domain(F.col("sender")).alias("domain"))


@query(
    f"SELECT doc_id, length(t) AS chars, len(w) AS words, len(list_distinct(list_transform(w, lambda x: lower(x)))) AS unique_words, len(regexp_extract_all(t, '\\p{{Nd}}')) AS digits FROM (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]{{2,}}') AS w "
    f"FROM (SELECT doc_id, {_strip("regexp_replace(text, '^\\s*DESCRIPTION:.*?\\bTEXT:\\s*', '', 'is')")} AS t FROM documents))"
)
def ref_f44_text_measures(s, sf):
    m = X.measure(F.col("text"))
    return table(s, sf, "documents").select("doc_id", m.alias("m")).select("doc_id", *[F.col(f"m.{c}").cast("bigint").alias(c) for c in ("chars", "words", "unique_words", "digits")])


@query("SELECT doc_id, trim(regexp_extract(text, '(?m)^(Location|Organizer):([^\\r\\n]*)', 2)) AS place, contains(text, 'BEGIN:VCALENDAR') AS vcal FROM documents WHERE content_kind = 'calendar'")
def ref_f20_calendar_fields(s, sf):
    d = table(s, sf, "documents").where("content_kind = 'calendar'")
    return d.select("doc_id", F.trim(F.regexp_extract("text", r"(?m)^(Location|Organizer):([^\r\n]*)", 2)).alias("place"), X.is_calendar(F.col("text")).alias("vcal"))


# ---------------------------------------------------------------- predicates and selections

_RULES = [{"type": "prefix", "value": "spool/003"}, {"type": "direct-root-files", "value": "spool/017/2b"}, {"type": "container-root"}]


@query("SELECT delivery_id, coalesce(starts_with(eml_path, 'spool/003/') OR (starts_with(eml_path, 'spool/017/2b/') AND NOT contains(substr(eml_path, 14), '/')) OR NOT contains(eml_path, '/'), NULL) AS selected FROM messages")
def ref_p1_path_rules(s, sf):
    return table(s, sf, "messages").select("delivery_id", M.selection(F.col("eml_path"), _RULES).alias("selected"))


_NOISE = [("alerts", "sender_re", "^gate|alert"), ("lists", "domain", "lists.quarrypost.example"), ("promo", "domain", "promo.ostrelgrow.example"), ("minutes", "subject_re", r"^(re: )?minutes")]


@query(
    "SELECT email_id, CASE WHEN regexp_matches(coalesce(sender, ''), '(?i)^gate|alert') THEN 'alerts' WHEN contains(lower(coalesce(sender, '')), '@lists.quarrypost.example') OR contains(lower(coalesce(sender, '')), '.lists.quarrypost.example') THEN 'lists' "
    "WHEN contains(lower(coalesce(sender, '')), '@promo.ostrelgrow.example') OR contains(lower(coalesce(sender, '')), '.promo.ostrelgrow.example') THEN 'promo' WHEN regexp_matches(coalesce(subject, ''), '(?i)^(re: )?minutes') THEN 'minutes' END AS category FROM thread_emails"
)
def ref_p4_noise_categories(s, sf):
    return table(s, sf, "thread_emails").select("email_id", M.first_category(_NOISE, F.col("sender"), F.col("subject")).alias("category"))


@query("SELECT source_name, count(*) AS n, count(CASE WHEN regexp_matches(coalesce(sender, ''), '(?i)^gate|alert') THEN 1 END) AS tagged FROM thread_emails GROUP BY source_name")
def ref_p6_tagging_rates(s, sf):
    tagged = M.first_category(_NOISE[:1], F.col("sender"), F.col("subject")).isNotNull()
    return table(s, sf, "thread_emails").groupBy("source_name").agg(F.count("*").alias("n"), F.count_if(tagged).alias("tagged"))


@query(f"SELECT email_id FROM thread_emails WHERE length({_strip('body')}) < 80")
def ref_p11_terse_emails(s, sf):
    return table(s, sf, "thread_emails").where(F.length(I.strip(F.col("body"))) < 80).select("email_id")


@query(
    "WITH m AS (SELECT content_sha256 AS sha, folder, count(*) AS n, length(max(source_uid)) * 9 AS chars, max(state) = 'done' AS ok FROM messages GROUP BY ALL) "
    "SELECT sha, folder, CASE WHEN NOT ok THEN NULL WHEN folder = 'INBOX' AND n >= 20 THEN TRUE WHEN chars >= 100 OR folder <> 'INBOX' THEN FALSE WHEN chars < 30 AND n >= 5 THEN TRUE END AS decoration FROM m"
)
def ref_p14_decoration_verdicts(s, sf):
    m = table(s, sf, "messages").groupBy(F.col("content_sha256").alias("sha"), "folder").agg(F.count("*").alias("n"), (F.length(F.max("source_uid")) * 9).alias("chars"), (F.max("state") == "done").alias("ok"))
    status = F.when(F.col("ok"), "extracted").otherwise("error")
    return m.select("sha", "folder", M.decoration(status, F.lit(True), F.col("chars"), F.col("n"), F.col("folder") == "INBOX").alias("decoration"))


@query("SELECT delivery_id, state IN ('new', 'indexed_unjudged') AS needs_judge, state IN ('judged') AS needs_index FROM messages WHERE fetched_at IS NULL OR fetched_at >= TIMESTAMP '2022-01-01'")
def ref_p22_pending_stages(s, sf):
    m = table(s, sf, "messages").where("fetched_at is null or fetched_at >= timestamp'2022-01-01'")
    return m.select("delivery_id", M.pending(F.col("state"), "judged").alias("needs_judge"), M.pending(F.col("state"), "indexed").alias("needs_index"))


@query("SELECT email_id, list_transform(list_filter(string_split(body, chr(10)), lambda l: contains(lower(l), 'invoice'))[1:20], lambda l: trim(substr(l, greatest(1, instr(lower(l), 'invoice') - 96), 200))) AS lines FROM thread_emails WHERE contains(lower(body), 'invoice')")
def ref_p29_grep_snippets(s, sf):
    e = table(s, sf, "thread_emails").where(F.contains(F.lower("body"), F.lit("invoice")))
    return e.select("email_id", X.line_snippets(F.col("body"), "invoice").alias("lines"))


# ---------------------------------------------------------------- joins and set operations


@query(f"WITH s AS (SELECT mid, max(summary) AS summary FROM (SELECT {_mid('message_id')} AS mid, summary FROM thread_emails WHERE summary IS NOT NULL) WHERE mid <> '' GROUP BY mid) SELECT m.delivery_id, s.summary FROM (SELECT delivery_id, {_mid('message_id')} AS mid FROM messages) m LEFT JOIN s ON m.mid = s.mid")
def ref_j1_summaries_injected(s, sf):
    e = table(s, sf, "thread_emails").where("summary is not null").select(I.normalize_message_id(F.col("message_id")).alias("mid"), "summary")
    return M.prioritised(table(s, sf, "messages").select("delivery_id", I.normalize_message_id(F.col("message_id")).alias("m")), [(e, "m", "mid")], "summary").select("delivery_id", "summary")


@query(
    f"WITH e AS (SELECT {_mid('message_id')} AS mid, lower(subject) AS subj, summary FROM thread_emails WHERE summary IS NOT NULL), a AS (SELECT mid, max(summary) AS v FROM e WHERE mid <> '' GROUP BY 1), b AS (SELECT subj, max(summary) AS v FROM e WHERE subj <> '' GROUP BY 1) "
    f"SELECT t.email_id, coalesce(a.v, b.v) AS summary FROM (SELECT email_id, {_mid('message_id')} AS mid, lower(subject) AS subj FROM thread_emails) t LEFT JOIN a ON a.mid = t.mid LEFT JOIN b ON b.subj = t.subj"
)
def ref_j2_prioritised_lookup(s, sf):
    e = table(s, sf, "thread_emails").select("email_id", I.normalize_message_id(F.col("message_id")).alias("mid"), F.lower("subject").alias("subj"), "summary")
    known = e.where("summary is not null").select(F.col("mid").alias("k1"), F.col("subj").alias("k2"), "summary")
    return M.prioritised(e.select("email_id", "mid", "subj"), [(known, "mid", "k1"), (known, "subj", "k2")], "summary").select("email_id", "summary")


@query(f"SELECT DISTINCT delivery_id FROM messages WHERE {_mid('message_id')} NOT IN (SELECT {_mid('message_id')} FROM thread_emails WHERE message_id IS NOT NULL)")
def ref_j3_not_in_threads(s, sf):
    ids = table(s, sf, "thread_emails").where("message_id is not null").select(I.normalize_message_id(F.col("message_id")).alias("mid"))
    return table(s, sf, "messages").select("delivery_id", I.normalize_message_id(F.col("message_id")).alias("mid")).join(ids, "mid", "left_anti").select("delivery_id").distinct()


@query("SELECT content_sha256, min(delivery_id) AS first_delivery, count(*) AS n FROM messages WHERE judged_at IS NULL GROUP BY content_sha256")
def ref_j6_unmeasured(s, sf):
    return table(s, sf, "messages").where("judged_at is null").groupBy("content_sha256").agg(F.min("delivery_id").alias("first_delivery"), F.count("*").alias("n"))


@query("SELECT e.thread_id, count(DISTINCT d.doc_id) AS n_docs FROM thread_emails e JOIN documents d ON d.thread_id = e.thread_id WHERE e.thread_id <> '' GROUP BY e.thread_id")
def ref_j5_documents_of_threads(s, sf):
    threads = table(s, sf, "thread_emails").where("thread_id <> ''").select("thread_id").distinct()
    return table(s, sf, "documents").join(threads, "thread_id", "left_semi").groupBy("thread_id").agg(F.countDistinct("doc_id").alias("n_docs"))


@query(f"SELECT DISTINCT e.email_id, m.folder FROM (SELECT email_id, {_mid('message_id')} AS a, {_mid('in_reply_to')} AS b, account_id FROM thread_emails) e JOIN (SELECT {_mid('message_id')} AS mid, account_id, folder FROM messages) m ON m.account_id = e.account_id AND m.mid <> '' AND (m.mid = e.a OR m.mid = e.b)")
def ref_j14_either_key(s, sf):
    e = table(s, sf, "thread_emails").select("email_id", F.concat_ws("|", "account_id", I.normalize_message_id(F.col("message_id"))).alias("ka"), F.concat_ws("|", "account_id", I.normalize_message_id(F.col("in_reply_to"))).alias("kb"))
    m = table(s, sf, "messages").select(I.normalize_message_id(F.col("message_id")).alias("mid"), "account_id", "folder").where("mid <> ''").select(F.concat_ws("|", "account_id", "mid").alias("k"), "folder").distinct()
    return M.either_key(e, m, [("ka", "k"), ("kb", "k")], ["email_id", "folder"])


@query("SELECT coalesce(a.source, b.source_name) AS source, coalesce(a.n, 0) AS docs, coalesce(b.n, 0) AS emails FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source) a FULL JOIN (SELECT source_name, count(*) AS n FROM thread_emails GROUP BY source_name) b ON a.source = b.source_name")
def ref_j15_outer_overlay(s, sf):
    a = table(s, sf, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("docs"))
    b = table(s, sf, "thread_emails").groupBy(F.col("source_name").alias("source")).agg(F.count("*").alias("emails"))
    return a.join(b, "source", "full").select("source", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("emails", F.lit(0)).alias("emails"))


@query("SELECT sender FROM documents WHERE sender IS NOT NULL UNION SELECT sender FROM thread_emails WHERE sender IS NOT NULL")
def ref_u1_pooled_senders(s, sf):
    d, e = (table(s, sf, t).where("sender is not null").select("sender") for t in ("documents", "thread_emails"))
    return d.unionByName(e).distinct()


@query("SELECT account_id, folder FROM messages EXCEPT SELECT account_id, folder FROM messages WHERE state = 'abandoned'")
def ref_u3_difference(s, sf):
    m = table(s, sf, "messages")
    return m.select("account_id", "folder").subtract(m.where("state = 'abandoned'").select("account_id", "folder"))


# ---------------------------------------------------------------- aggregations


@query(
    "WITH p AS (SELECT thread_id, coalesce(sender, '') AS sender, count(*) AS c, min(email_id) AS f, count(CASE WHEN summary IS NULL THEN 1 END) AS t FROM thread_emails WHERE thread_id <> '' GROUP BY ALL) "
    "SELECT thread_id, CAST(sum(c) AS BIGINT) AS n_emails, arg_max(sender, (c, -f)) AS dominant_sender, round(max(c) / sum(c), 4) AS top_sender_share, count(*) AS n_senders, round(sum(t) / sum(c), 4) AS tag_fraction FROM p GROUP BY thread_id"
)
def ref_a1_thread_meta(s, sf):
    e = table(s, sf, "thread_emails").where("thread_id <> ''").select("thread_id", F.coalesce("sender", F.lit("")).alias("sender"), "email_id", F.col("summary").isNull().alias("tag"))
    return M.thread_meta(e, "thread_id", "sender", "email_id", "tag")


@query("SELECT thread_id, string_agg(email_id || ': ' || coalesce(subject, ''), chr(10) ORDER BY ingested_at, email_id) AS text FROM thread_emails WHERE thread_id <> '' GROUP BY thread_id")
def ref_a2_rendered_threads(s, sf):
    e = table(s, sf, "thread_emails").where("thread_id <> ''").select("thread_id", "ingested_at", "email_id", "subject")
    return M.render_thread(e, "thread_id", [F.col("ingested_at"), F.col("email_id")], F.concat(F.col("email_id"), F.lit(": "), F.coalesce("subject", F.lit(""))))


@query("SELECT label, i AS dim, round(avg(v), 5) AS mean FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def ref_a3_mean_vectors(s, sf):
    return table(s, sf, "embeddings").select("label", F.posexplode("embedding").alias("p", "v")).groupBy("label", (F.col("p") + 1).cast("bigint").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"))


@query("SELECT content_sha256, count(DISTINCT account_id) AS accounts FROM messages GROUP BY content_sha256")
def ref_a4_distinct_per_blob(s, sf):
    return table(s, sf, "messages").groupBy("content_sha256").agg(F.countDistinct("account_id").alias("accounts"))


@query("SELECT state || '@' || folder AS judge, count(*) AS n FROM messages GROUP BY ALL")
def ref_a5_judges(s, sf):
    return table(s, sf, "messages").groupBy(F.concat_ws("@", "state", "folder").alias("judge")).agg(F.count("*").alias("n"))


@query("SELECT account_id, count(*) AS total, count(CASE WHEN state IN ('new', 'indexed_unjudged') THEN 1 END) AS awaiting, count(CASE WHEN state = 'done' THEN 1 END) AS done, count(CASE WHEN error IS NOT NULL THEN 1 END) AS errors FROM messages GROUP BY account_id")
def ref_a7_ledger_counts(s, sf):
    return table(s, sf, "messages").groupBy("account_id").agg(F.count("*").alias("total"), F.count_if(M.pending(F.col("state"), "judged")).alias("awaiting"), F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("error").isNotNull()).alias("errors"))


@query("SELECT event_type AS tool, k AS arg, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL")
def ref_a8_argument_counts(s, sf):
    keys = F.explode(F.json_object_keys("props")).alias("arg")
    return table(s, sf, "events").select(F.col("event_type").alias("tool"), keys).groupBy("tool", "arg").agg(F.count("*").alias("n"))


@query("SELECT coalesce(content_kind, 'overall') AS grp, count(*) AS n, round(avg(n_chars), 6) AS n_chars FROM documents GROUP BY GROUPING SETS ((), (content_kind))")
def ref_a9_means_overall_and_by_category(s, sf):
    return E.grouped_means(table(s, sf, "documents").select("content_kind", "n_chars"), "content_kind", ["n_chars"]).withColumn("n_chars", F.round("n_chars", 6))


@query("WITH s AS (SELECT source, list_sort(list(n_chars)) AS v FROM documents WHERE source IS NOT NULL GROUP BY source) SELECT source, v[CAST(least(len(v), floor(len(v) * 50 / 100) + 1) AS BIGINT)] AS p50, v[CAST(least(len(v), floor(len(v) * 90 / 100) + 1) AS BIGINT)] AS p90, v[CAST(least(len(v), floor(len(v) * 99 / 100) + 1) AS BIGINT)] AS p99 FROM s")
def ref_a12_nearest_rank_percentiles(s, sf):
    return M.percentile_from_counts(table(s, sf, "documents").where("source is not null"), ["source"], "n_chars", [50, 90, 99])


@query("WITH v AS (SELECT list_sort(list(n_chars)) AS v FROM documents WHERE n_chars > 0), p AS (SELECT v[CAST(least(len(v), floor(len(v) * 90 / 100) + 1) AS BIGINT)] AS p90 FROM v) SELECT CAST(least(1024, greatest(256, ceil(p90 / 64.0) * 64)) AS BIGINT) AS suggested FROM p")
def ref_a14_suggested_chunk_size(s, sf):
    p = M.percentile_from_counts(table(s, sf, "documents").where("n_chars > 0").withColumn("_g", F.lit(1)), ["_g"], "n_chars", [90])
    return p.select(F.least(F.lit(1024), F.greatest(F.lit(256), F.ceil(F.col("p90") / 64) * 64)).cast("bigint").alias("suggested"))


@query("WITH t AS (SELECT thread_id, count(*) AS n, sum(length(body) // 4) AS tok FROM thread_emails WHERE thread_id <> '' GROUP BY 1) SELECT count(*) AS threads, CAST(sum(n) AS BIGINT) AS emails, count(CASE WHEN n = 1 THEN 1 END) AS singletons, count(CASE WHEN tok > 1000 THEN 1 END) AS over_1k, count(CASE WHEN tok > 4000 THEN 1 END) AS over_4k, max(n) AS longest FROM t")
def ref_a15_thread_census(s, sf):
    t = table(s, sf, "thread_emails").where("thread_id <> ''").groupBy("thread_id").agg(F.count("*").alias("n"), F.sum(X.estimate_tokens(F.col("body"))).alias("tok"))
    return t.agg(F.count("*").alias("threads"), F.sum("n").alias("emails"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("tok") > 1000).alias("over_1k"), F.count_if(F.col("tok") > 4000).alias("over_4k"), F.max("n").alias("longest"))


@query(
    "WITH p AS (SELECT string_split(eml_path, '/') AS x FROM messages WHERE eml_path <> ''), f AS (SELECT array_to_string(x[1:unnest(range(1, greatest(len(x), 2)))], '/') AS folder, array_to_string(x[1:len(x) - 1], '/') AS own FROM p) "
    "SELECT folder, count(*) AS total, count(CASE WHEN folder = own THEN 1 END) AS direct FROM f GROUP BY folder"
)
def ref_a16_folder_tree(s, sf):
    return M.folder_counts(table(s, sf, "messages").where("eml_path <> ''").select("eml_path"), "eml_path")


@query("SELECT regexp_extract(lower(sender), '@([\\w.\\-]+)', 1) AS domain, count(DISTINCT email_id) AS emails, count(DISTINCT sender) AS senders FROM thread_emails WHERE sender IS NOT NULL GROUP BY 1")
def ref_a18_domain_stats(s, sf):
    e = table(s, sf, "thread_emails").where("sender is not null")
    return e.groupBy(X.sender_domain(F.col("sender")).alias("domain")).agg(F.count("*").alias("emails"), F.countDistinct("sender").alias("senders"))


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(subject), '[a-z]{3,}')) AS w FROM thread_emails) WHERE w NOT IN ('the', 'and', 'for', 'fwd') GROUP BY w ORDER BY n DESC, w LIMIT 40")
def ref_a21_subject_words(s, sf):
    w = F.explode(F.regexp_extract_all(F.lower("subject"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")
    return table(s, sf, "thread_emails").select(w).where(~F.col("word").isin("the", "and", "for", "fwd")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(40)


@query("SELECT n AS thread_size, count(*) AS threads FROM (SELECT thread_id, count(*) AS n FROM thread_emails WHERE thread_id <> '' GROUP BY 1) GROUP BY n")
def ref_a30_histogram_of_sizes(s, sf):
    return table(s, sf, "thread_emails").where("thread_id <> ''").groupBy("thread_id").agg(F.count("*").alias("thread_size")).groupBy("thread_size").agg(F.count("*").alias("threads"))


@query(
    "WITH c AS (SELECT coalesce(lang, '?') AS a, CASE WHEN content_kind = 'email' THEN 'en' ELSE coalesce(lang, '?') END AS b, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT sum(n) AS t, sum(CASE WHEN a = b THEN n ELSE 0 END) AS s FROM c), "
    "l AS (SELECT a AS v, sum(n) AS l FROM c GROUP BY a), r AS (SELECT b AS v, sum(n) AS r FROM c GROUP BY b), e AS (SELECT sum(l * r) AS e FROM l JOIN r USING (v)) SELECT round((s / t - e / (t * t)) / (1 - e / (t * t)), 9) AS kappa FROM t, e"
)
def ref_a33_cohen_kappa(s, sf):
    d = table(s, sf, "documents").select(F.coalesce("lang", F.lit("?")).alias("a"), F.when(F.col("content_kind") == "email", "en").otherwise(F.coalesce("lang", F.lit("?"))).alias("b"))
    return E.cohen_kappa(d, "a", "b").select(F.round("kappa", 9).alias("kappa"))


@query(
    "WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS b FROM events) SELECT event_type, round(corr(a, b), 9) AS rho FROM r GROUP BY event_type"
)
def ref_a34_spearman(s, sf):
    return E.spearman(table(s, sf, "events").select("event_type", "value", "user_id"), ["event_type"], "value", "user_id").withColumn("rho", F.round("rho", 9))


# ---------------------------------------------------------------- windows


@query("SELECT arg_min(doc_id, doc_id) AS doc_id, sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS h FROM documents GROUP BY 2")
def ref_w5_exact_dedup(s, sf):
    d = table(s, sf, "documents").select("doc_id", "text")
    body = F.trim(F.col("text"), F.lit(" \t\n\r"))
    return M.first_copies(d.select("doc_id", body.alias("t")), F.col("t"), [F.col("doc_id")]).select("doc_id", F.sha2("t", 256).alias("h"))


@query("SELECT email_id, list(email_id) OVER (PARTITION BY account_id, thread_id ORDER BY ingested_at, email_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS earlier FROM thread_emails WHERE thread_id <> ''")
def ref_w7_preceding_context(s, sf):
    e = table(s, sf, "thread_emails").where("thread_id <> ''").withColumn("_t", F.struct("account_id", "thread_id"))
    c = M.preceding(e, "_t", ["ingested_at", "email_id"], "email_id")
    return e.select("email_id", F.when(F.size(c) > 0, c).alias("earlier"))


@query("SELECT source, content_kind, n, k FROM (SELECT source, content_kind, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, content_kind) AS k FROM (SELECT source, content_kind, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL)) WHERE k <= 3")
def ref_w13_top3_per_group(s, sf):
    c = table(s, sf, "documents").where("source is not null").groupBy("source", "content_kind").agg(F.count("*").alias("n"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "content_kind")).cast("bigint")).where("k <= 3")


@query("SELECT account_id, arg_max(delivery_id, (fetched_at, delivery_id)) AS last_delivery, epoch_us(max(fetched_at)) AS last_fetch FROM messages GROUP BY account_id")
def ref_w16_last_run(s, sf):
    return M.keep_latest(table(s, sf, "messages").select("account_id", F.col("delivery_id").alias("last_delivery"), F.unix_micros("fetched_at").alias("last_fetch")), ["account_id"], [F.col("last_fetch"), F.col("last_delivery")])


@query("SELECT state, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM messages GROUP BY state")
def ref_w17_share_of_total(s, sf):
    c = table(s, sf, "messages").groupBy("state").agg(F.count("*").alias("n"))
    return c.select("state", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("share"))


# ---------------------------------------------------------------- retrieval and evaluation


def _vectors(s, sf):
    return table(s, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec"), "label")


def _knn(s, sf, k=20):
    v = _vectors(s, sf)
    q = v.where("item % 100 = 0").select(F.col("item").alias("query"), F.col("vec").alias("qvec"))
    return R.nearest(q, v, k)


_KNN = (
    "WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), z AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS nn FROM n), "
    "sc AS (SELECT q.vec_id AS query, d.vec_id AS item, d.label, round(list_dot_product(q.e, d.e) / greatest(q.nn * d.nn, 1e-12), 6) AS score FROM z q, z d WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id), "
    "knn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM sc QUALIFY rank <= 20) "
)


@query(_KNN + "SELECT query, item, rank FROM knn")
def ref_j18_nearest_vectors(s, sf):
    return _knn(s, sf).select("query", "item", F.col("rank").cast("bigint").alias("rank"))


_TERMS = "(SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM documents) GROUP BY ALL)"
_SPARSE = f"WITH t AS {_TERMS}, sp AS (SELECT q.doc_id AS query, d.doc_id AS item, CAST(sum(q.tf * d.tf) AS DOUBLE) AS score FROM t q JOIN t d ON q.w = d.w WHERE q.doc_id % 100 = 0 AND q.doc_id <> d.doc_id GROUP BY ALL) "


@query(_SPARSE + "SELECT query, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) - 1 AS rank FROM sp) WHERE rank < 20")
def ref_j18_sparse_leg(s, sf):
    t = table(s, sf, "documents").select(F.col("doc_id").alias("item"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)).alias("terms"))
    q = t.where("item % 100 = 0").withColumnRenamed("item", "query")
    return best(q, t, 20, log=False, exclude_self=True).select("query", "item", "score", F.col("rank").cast("bigint").alias("rank"))


@query()
def ref_j18_sparse_terms(s, sf):
    """The sparse leg over the engine's own terms of whole texts, in any script; ``ref_j18_sparse_leg`` has only the words that its SQL names."""
    from threadloom.plans.search import sparse_terms

    t = table(s, sf, "documents").select(F.col("doc_id").alias("item"), sparse_terms(F.col("text")).alias("terms"))
    q = t.where("item % 100 = 0").withColumnRenamed("item", "query")
    return best(q, t, 20, exclude_self=True).select("query", "item", "score", F.col("rank").cast("bigint").alias("rank"))


def _fused(s, sf, p):
    dense = _knn(s, sf).select("query", "item", (F.col("rank") - 1).alias("rank"))
    v = _vectors(s, sf)
    near = dense.join(v.select("item", "label"), "item")
    second = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("label", "item")) - 1).select("query", "item", "rank")
    return R.fuse([(dense, 1.0), (second, 1.5)], p=p, top=10)


def _fused_sql(score: str) -> str:
    return (
        _KNN + ", a AS (SELECT query, item, rank - 1 AS r FROM knn), b AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY label, item) - 1 AS r FROM knn), "
        "t AS (SELECT query, item, 1.0 / (r + 61) AS term, r AS pos FROM a UNION ALL SELECT query, item, 1.5 / (r + 61), 1000000000 + r FROM b), "
        f"f AS (SELECT query, item, round({score}, 12) AS score, round(sum(term), 12) AS st, min(pos) AS pos FROM t GROUP BY ALL) "
        "SELECT query, item, round(score, 9) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, st DESC, pos, item) AS rank FROM f QUALIFY rank <= 10"
    )


@query(_fused_sql("sum(CAST(term AS DOUBLE))"))
def ref_v5_rank_fusion(s, sf):
    return _fused(s, sf, 1.0).select("query", "item", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(_fused_sql("max(CAST(term AS DOUBLE))"))
def ref_v5_max_fusion(s, sf):
    return _fused(s, sf, float("inf")).select("query", "item", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(_KNN + ", f AS (SELECT query, label, min(rank) AS r FROM knn GROUP BY ALL) SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY r, label) AS distinct_rank FROM f")
def ref_w3_distinct_thread_ranks(s, sf):
    hits = _knn(s, sf).join(_vectors(s, sf).select("item", "label"), "item")
    return R.first_seen(hits, "label").select("query", "label", F.col("distinct_rank").cast("bigint").alias("distinct_rank"))


@query(_KNN + ", f AS (SELECT query, label, min(rank) AS r FROM knn GROUP BY ALL), d AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY r, label) AS k FROM f) SELECT d.query, d.k AS thread_rank, count(*) AS n_chunks FROM d JOIN embeddings e ON e.label = d.label WHERE d.k <= 3 GROUP BY ALL")
def ref_j4_thread_expansion(s, sf):
    v = _vectors(s, sf)
    hits = _knn(s, sf).join(v.select("item", "label"), "item")
    wide = R.expand_threads(hits, v.select("item", "label"), "label").where("distinct_rank <= 3")
    return wide.groupBy("query", F.col("distinct_rank").cast("bigint").alias("thread_rank")).agg(F.count("*").alias("n_chunks"))


@query(
    _KNN + ", lab AS (SELECT k.query, k.rank, q.label AS category, k.label = q.label AS hit FROM knn k JOIN embeddings q ON q.vec_id = k.query), b AS (SELECT query, category, min(CASE WHEN hit THEN rank END) AS r FROM lab GROUP BY ALL) "
    "SELECT coalesce(CAST(category AS VARCHAR), 'ALL') AS category, count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN r <= 5 THEN 1 ELSE 0 END), 6) AS recall_5, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM b GROUP BY GROUPING SETS ((), (category))"
)
def ref_a11_recall_and_mrr(s, sf):
    v = _vectors(s, sf)
    hits = _knn(s, sf).join(v.select("item", "label"), "item").select("query", F.col("label").alias("item"), "rank")
    gold = v.where("item % 100 = 0").select(F.col("item").alias("query"), F.col("label").alias("category"), F.col("label").alias("gold"))
    return R.recall_at(hits, gold, [1, 5])


@query(
    _KNN + ", g AS (SELECT k.query, list(CASE WHEN k.label = q.label THEN 2 WHEN k.label % 2 = q.label % 2 THEN 1 ELSE 0 END ORDER BY k.rank) AS g FROM knn k JOIN embeddings q ON q.vec_id = k.query GROUP BY 1), "
    "d AS (SELECT query, list_sum(list_transform(g[1:10], lambda x, i: x / log2(i + 1))) AS dcg, list_sum(list_transform(list_reverse_sort(g)[1:10], lambda x, i: x / log2(i + 1))) AS best, g FROM g) "
    "SELECT query, round(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 9) AS ndcg, len(list_filter(g[1:10], lambda x: x >= 1)) / 10.0 AS p10 FROM d"
)
def ref_f31_ndcg(s, sf):
    v = _vectors(s, sf).select("item", "label")
    q = v.select(F.col("item").alias("query"), F.col("label").alias("ql"))
    grade = F.when(F.col("label") == F.col("ql"), 2).when(F.col("label") % 2 == F.col("ql") % 2, 1).otherwise(0)
    rows = _knn(s, sf).join(v, "item").join(q, "query").select("query", "rank", grade.alias("g"))
    arr = rows.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "g"))), lambda x: x["g"]).alias("g"))  # 20 hits a query
    return arr.select("query", F.round(E.ndcg(F.col("g"), 10), 9).alias("ndcg"), E.precision(F.col("g"), 10, 1).alias("p10"))


@query("WITH c AS (SELECT state, count(*) AS n, count(CASE WHEN error IS NOT NULL THEN 1 END) AS h FROM messages GROUP BY state) SELECT state, round((h / n + 1.9208 / n - 1.96 * sqrt(h / n * (1 - h / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 9) AS low FROM c")
def ref_f33_wilson_interval(s, sf):
    c = table(s, sf, "messages").groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("h"))
    return c.select("state", F.round(E.wilson(F.col("h"), F.col("n"))["low"], 9).alias("low"))


@query("SELECT b, c, round(least(1.0, CASE WHEN b + c = 0 THEN 1.0 ELSE 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))) END), 9) AS p FROM (SELECT regionkey AS b, x AS c FROM (SELECT n_regionkey AS regionkey, n_nationkey % 7 AS x FROM nation) GROUP BY ALL)")
def ref_f34_mcnemar(s, sf):
    n = table(s, sf, "nation").select(F.col("n_regionkey").alias("b"), (F.col("n_nationkey") % 7).alias("c")).distinct()
    return n.select("b", "c", F.round(E.mcnemar_exact(F.col("b"), F.col("c")), 9).alias("p"))


# ---------------------------------------------------------------- ledger and events


_NEXT = " ".join(f"WHEN s = '{s}' AND e = '{e}' THEN '{t}'" for e, m in M.TRANSITIONS.items() for s, t in m.items())


@query(f"SELECT s AS state, e AS event, CASE {_NEXT} ELSE s END AS next_state, count(*) AS n FROM (SELECT state AS s, ['judged', 'indexed', 'abandoned', 'requeued'][1 + delivery_id % 4] AS e FROM messages) GROUP BY ALL")
def ref_t6_transitions(s, sf):
    event = F.element_at(F.array(*map(F.lit, ("judged", "indexed", "abandoned", "requeued"))), (F.col("delivery_id") % 4 + 1).cast("int"))
    m = table(s, sf, "messages").select("state", event.alias("event"))
    return m.select("state", "event", M.next_state(F.col("state"), F.col("event")).alias("next_state")).groupBy("state", "event", "next_state").agg(F.count("*").alias("n"))


@query()
def ref_t7_event_fold(s, sf):
    event = F.when(F.col("event_type") == "click", "judged").when(F.col("event_type") == "view", "indexed").when(F.col("event_type") == "error", "abandoned").otherwise("requeued")
    return M.fold_events(table(s, sf, "events").select("user_id", "event_id", event.alias("event")), ["user_id"], "event_id", "event")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling_windows(s, sf):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return table(s, sf, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM k GROUP BY user_id, k"
)
def ext_session_windows(s, sf):
    w = F.session_window(F.col("ts").cast("timestamp"), "2 hours")
    return table(s, sf, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


@query("SELECT p.event_id, v.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def ext_asof_join(s, sf):
    """As-of join as one window: no inequality join."""
    e = table(s, sf, "events").where("event_type in ('purchase', 'view')")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("last_view", last).where("event_type = 'purchase'").select("event_id", "last_view")


@query(
    "SELECT n_name, o_orderpriority, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL"
)
def ext_star_join(s, sf):
    """Filters and column lists reach the scans; small sides are broadcast by their size only."""
    line = table(s, sf, "lineitem").where("l_shipdate >= timestamp_ntz'1995-01-01'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = table(s, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(s, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(s, sf, "nation").select("n_nationkey", "n_name")
    j = line.groupBy("l_orderkey").agg(F.sum("r").alias("r")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("r"), 2).alias("revenue"))


# ---------------------------------------------------------------- chunking and pipelines


@query()
def ref_v7_chunks(s, sf):
    from threadloom.operators.chunking import chunks

    return chunks(table(s, sf, "documents"), "doc_id", "text", 128).select("doc_key", "ordinal", "point_id", "content_hash")


@query()
def ref_v8_row_chunks(s, sf):
    from threadloom.operators.chunking import row_chunks

    return row_chunks(table(s, sf, "documents").where("text like '%\t%'"), "doc_id", "text", 64)


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE content_kind = 'email') UNION ALL SELECT doc_id, CAST(-1 AS BIGINT) FROM documents WHERE content_kind = 'email'")
def ref_k5_upsert(s, sf):
    d = table(s, sf, "documents")
    old = d.select("doc_id", F.length("text").cast("bigint").alias("n"))
    return M.upsert(old, d.where("content_kind = 'email'").select("doc_id", F.lit(-1).cast("bigint").alias("n")), ["doc_id"])


@query("SELECT message_id, any_value(state) AS state FROM (SELECT message_id, state, row_number() OVER (PARTITION BY message_id ORDER BY fetched_at DESC, delivery_id DESC) AS k FROM messages WHERE message_id <> '') WHERE k = 1 GROUP BY message_id")
def ref_k8_latest_judgments(s, sf):
    m = table(s, sf, "messages").where("message_id <> ''").select("message_id", "state", "fetched_at", "delivery_id")
    return M.keep_latest(m, ["message_id"], [F.col("fetched_at"), F.col("delivery_id")]).select("message_id", "state")


@query()
def ref_index_build(s, sf):
    """The chunk table of all thread e-mails."""
    from threadloom.plans.pipeline import index_rows

    e = table(s, sf, "thread_emails").select("message_id", "in_reply_to", "sender", "subject", "body")
    return index_rows(e, _NOISE[:2]).select("doc_key", "ordinal", "point_id", "content_hash", "thread_id")


@query()
def ref_v4_hybrid_search(s, sf):
    from threadloom.plans.search import hybrid

    d = table(s, sf, "documents").select(F.col("doc_id").alias("item"), "text")
    return hybrid(d.where("item % 100 = 0").select(F.col("item").alias("query"), "text"), d, top=10)


@query()
def ref_v6_reranked_search(s, sf):
    from threadloom.plans.search import hybrid, rerank

    d = table(s, sf, "documents").select(F.col("doc_id").alias("item"), "text")
    q = d.where("item % 100 = 0").select(F.col("item").alias("query"), "text")
    return rerank(hybrid(q, d, "sparse", top=20), X.lexical_overlap, d, q, 5)


@query()
def ref_j4_conversations_of_hits(s, sf):
    from threadloom.plans.search import hybrid, threads_of

    e = table(s, sf, "thread_emails").where("thread_id <> ''")
    c = e.select(F.col("email_id").alias("item"), "thread_id", I.normalize_message_id(F.col("message_id")).alias("message_id"), F.col("email_id").alias("ordinal"), F.col("ingested_at").alias("sent_at"), "sender", F.col("body").alias("text"))
    q = e.where("email_id % 100 = 0 and subject is not null").select(F.col("email_id").alias("query"), F.col("subject").alias("text"))
    return threads_of(hybrid(q, c.select("item", "text"), "sparse", top=10), c, 3)


@query()
def ref_v10_thread_clusters(s, sf):
    from threadloom.plans.pipeline import cluster_threads

    v = table(s, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return cluster_threads(v, 8).select("vec_id", "cluster", "size", "tightness")


@query("SELECT email_id, string_split(body, chr(10))[1:20] AS lines FROM thread_emails WHERE FALSE UNION ALL SELECT email_id, lines FROM (SELECT email_id, list_transform(list_filter(string_split(body, chr(10)), lambda l: contains(lower(l), 'permit'))[1:20], lambda l: trim(substr(l, greatest(1, instr(lower(l), 'permit') - 97), 200))) AS lines, coalesce(contains(lower(body), 'permit'), FALSE) AS b, subject FROM thread_emails) WHERE b ORDER BY email_id LIMIT 500")
def ref_l5_grep(s, sf):
    from threadloom.plans.pipeline import grep

    return grep(table(s, sf, "thread_emails").where(F.contains(F.lower("body"), F.lit("permit"))), "permit")


@query(
    "SELECT email_id, CASE WHEN len(lines) > 0 THEN lines ELSE [subject] END AS lines FROM (SELECT email_id, subject, list_transform(list_filter(string_split(coalesce(body, ''), chr(10)), lambda l: contains(lower(l), 'permit'))[1:20], lambda l: trim(substr(l, greatest(1, instr(lower(l), 'permit') - 97), 200))) AS lines "
    "FROM thread_emails WHERE contains(lower(coalesce(body, '')), 'permit') OR contains(lower(coalesce(subject, '')), 'permit')) ORDER BY email_id LIMIT 500"
)
def ref_l5_grep_messages(s, sf):
    """Grep over all messages, also those that match by subject alone; ``ref_l5_grep`` has only the bodies that its SQL names."""
    from threadloom.plans.pipeline import grep

    return grep(table(s, sf, "thread_emails"), "permit")


@query("SELECT source_name, subject, n FROM (SELECT source_name, subject, n, row_number() OVER (PARTITION BY source_name ORDER BY n DESC, subject) AS k FROM (SELECT source_name, subject, count(*) AS n FROM thread_emails WHERE subject IS NOT NULL GROUP BY ALL)) WHERE k <= 10")
def ref_a22_frequent_subjects(s, sf):
    c = table(s, sf, "thread_emails").where("subject is not null").groupBy("source_name", "subject").agg(F.count("*").alias("n"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("source_name").orderBy(F.desc("n"), "subject"))).where("k <= 10").drop("k")


@query("SELECT sender, n FROM (SELECT coalesce(sender, '') AS sender, coalesce(subject, '') AS subject, count(*) AS n FROM thread_emails GROUP BY ALL) WHERE n > 1")
def ref_a25_repeated_buckets(s, sf):
    e = table(s, sf, "thread_emails").select(F.coalesce("sender", F.lit("")).alias("sender"), F.coalesce("subject", F.lit("")).alias("subject"))
    return e.groupBy("sender", "subject").agg(F.count("*").alias("n")).where("n > 1").select("sender", "n")


@query(_KNN + ", f AS (SELECT query, label, min(rank) AS r FROM knn GROUP BY ALL), d AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY r, label) AS k FROM f), g AS (SELECT q.vec_id AS query, min(CASE WHEN d.label = q.label THEN d.k END) AS k FROM embeddings q LEFT JOIN d ON d.query = q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1) SELECT n, round(avg(CASE WHEN k <= n THEN 1 ELSE 0 END), 6) AS coverage FROM g, (SELECT unnest([1, 2, 3, 5, 10]) AS n) GROUP BY n")
def ref_a27_coverage_by_n(s, sf):
    v = _vectors(s, sf)
    d = R.first_seen(_knn(s, sf).join(v.select("item", "label"), "item"), "label")
    q = v.where("item % 100 = 0").select(F.col("item").alias("query"), F.col("label").alias("gold"))
    k = q.join(d, (q["query"] == d["query"]) & (q["gold"] == d["label"]), "left").groupBy(q["query"]).agg(F.min("distinct_rank").alias("k"))
    n = F.explode(F.array(*[F.lit(x) for x in (1, 2, 3, 5, 10)])).alias("n")
    return k.select("k", n).groupBy("n").agg(F.round(F.avg(F.coalesce(F.col("k") <= F.col("n"), F.lit(False)).cast("int")), 6).alias("coverage"))


@query("SELECT bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM (SELECT CASE WHEN coalesce(trim(message_id, ' ' || chr(9) || chr(10) || chr(13)), '') = '' THEN 'no id' WHEN in_reply_to IS NULL OR in_reply_to = '' THEN 'root' ELSE 'reply' END AS bucket FROM thread_emails) GROUP BY bucket")
def ref_a29_cause_histogram(s, sf):
    e = table(s, sf, "thread_emails")
    bucket = F.when(I.normalize_message_id(F.col("message_id")) == "", "no id").when(F.coalesce("in_reply_to", F.lit("")) == "", "root").otherwise("reply")
    c = e.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return c.select("bucket", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))


@query("SELECT a.account_id, a.folder FROM (SELECT account_id, folder, max(state) AS v FROM messages GROUP BY ALL) a FULL JOIN (SELECT account_id, folder, min(state) AS v FROM messages GROUP BY ALL) b ON a.account_id = b.account_id AND a.folder = b.folder WHERE a.v IS DISTINCT FROM b.v")
def ref_j20_decision_flips(s, sf):
    m = table(s, sf, "messages")
    a = m.groupBy("account_id", "folder").agg(F.max("state").alias("v"))
    b = m.groupBy("account_id", "folder").agg(F.min("state").alias("w"))
    return a.join(b, ["account_id", "folder"], "full").where(~F.col("v").eqNullSafe(F.col("w"))).select("account_id", "folder")


@query("SELECT p.account_id, round(avg(CASE WHEN p.chunk_size = q.chunk_size THEN 1.0 ELSE 0.0 END), 9) AS agreement FROM corpus_profiles p JOIN corpus_profiles q ON p.account_id = q.account_id AND p.profile_id < q.profile_id WHERE p.chunk_size IS NOT NULL AND q.chunk_size IS NOT NULL GROUP BY 1")
def ref_j11_agreement(s, sf):
    """Agreement of the versions of a profile: pairs of equal values from value counts, no pairs are formed."""
    c = table(s, sf, "corpus_profiles").where("chunk_size is not null").groupBy("account_id", "chunk_size").agg(F.count("*").alias("c"))
    n = F.sum("c")
    both = c.groupBy("account_id").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"), (n * (n - 1) / 2).alias("pairs"))
    return both.where("pairs > 0").select("account_id", F.round(F.col("same") / F.col("pairs"), 9).alias("agreement"))


@query("SELECT account_id, bool_or(state = 'done') AS any_done, CASE WHEN count(*) = count(indexed_at) THEN 'complete' WHEN count(indexed_at) = 0 THEN 'empty' ELSE 'partial' END AS completeness FROM messages GROUP BY account_id")
def ref_a38_completeness(s, sf):
    n = F.count("indexed_at")
    return table(s, sf, "messages").groupBy("account_id").agg(F.max(F.col("state") == "done").alias("any_done"), F.when(F.count("*") == n, "complete").when(n == 0, "empty").otherwise("partial").alias("completeness"))


# ---------------------------------------------------------------- further operators


@query()
def ref_f15_reply_chains_stripped(s, sf):
    from threadloom.functions.replies import strip_reply_chain

    return table(s, sf, "thread_emails").select("email_id", strip_reply_chain("body").alias("new_part"))


_ROLE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items())


@query(f"SELECT delivery_id, CASE lower(trim(folder)) {_ROLE} ELSE 'other' END AS role FROM messages")
def ref_f52_folder_roles(s, sf):
    return table(s, sf, "messages").select("delivery_id", folder_role(F.col("folder"), F.array().cast("array<string>")).alias("role"))


@query("SELECT thread_id, email_id, list_filter(a, lambda x: x <> email_id)[-24:] AS others FROM (SELECT thread_id, email_id, list(email_id) OVER (PARTITION BY account_id, thread_id ORDER BY ingested_at, email_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a FROM thread_emails WHERE thread_id <> '')")
def ref_w8_whole_thread_context(s, sf):
    """The last 24 others: 25 messages from the end and the row's place decide, no whole thread is collected."""
    e = table(s, sf, "thread_emails").where("thread_id <> ''").select("thread_id", "account_id", "email_id", "ingested_at")
    w = Window.partitionBy("account_id", "thread_id").orderBy(F.desc("ingested_at"), F.desc("email_id"))
    k = e.withColumn("k", F.row_number().over(w))
    last = k.where("k <= 25").groupBy("account_id", "thread_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), "email_id"))), lambda x: x["email_id"]).alias("a"))
    others = F.filter("a", lambda x: x != F.col("email_id"))
    return k.join(last, ["account_id", "thread_id"]).select("thread_id", "email_id", F.slice(others, F.greatest(F.size(others) - 23, F.lit(1)), 24).alias("others"))


@query("SELECT account_id, thread_id, min(email_id) AS first_id, max(email_id) AS last_id, greatest(count(*) - 2, 0) AS elided FROM thread_emails WHERE thread_id <> '' GROUP BY ALL")
def ref_w11_bounded_threads(s, sf):
    return table(s, sf, "thread_emails").where("thread_id <> ''").groupBy("account_id", "thread_id").agg(F.min("email_id").alias("first_id"), F.max("email_id").alias("last_id"), F.greatest(F.count("*") - 2, F.lit(0)).alias("elided"))


@query("SELECT regexp_extract(lower(sender), '@([\\w.\\-]+)', 1) AS domain, substr(string_agg(coalesce(subject, ''), ' | ' ORDER BY email_id), 1, 800) AS joined FROM thread_emails WHERE sender LIKE '%@%' GROUP BY 1")
def ref_a19_domain_regroup(s, sf):
    """The first 800 characters of a domain's texts: a separator of three between rows that may be empty, so 268 rows a domain suffice."""
    e = table(s, sf, "thread_emails").where("sender like '%@%'").select(X.sender_domain(F.col("sender")).alias("domain"), "email_id", F.coalesce("subject", F.lit("")).alias("t"))
    w = Window.partitionBy("domain").orderBy("email_id")
    e = e.withColumn("k", F.row_number().over(w)).where("k <= 268")
    return e.groupBy("domain").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("email_id", "t"))), lambda x: x["t"]), " | "), 1, 800).alias("joined"))


@query("SELECT category, count(*) AS vectors, count(DISTINCT sender) AS senders FROM (SELECT sender, CASE WHEN contains(lower(coalesce(sender, '')), '@postbox.test') OR contains(lower(coalesce(sender, '')), '.postbox.test') THEN 'private' END AS category FROM thread_emails) WHERE category IS NOT NULL GROUP BY category")
def ref_a20_purge_counts(s, sf):
    e = table(s, sf, "thread_emails").select("sender", M.first_category([("private", "domain", "postbox.test")], F.col("sender"), F.lit("")).alias("category"))
    return e.where("category is not null").groupBy("category").agg(F.count("*").alias("vectors"), F.countDistinct("sender").alias("senders"))


@query(_KNN + ", t AS (SELECT query, count(*) FILTER (WHERE label = (SELECT label FROM embeddings e WHERE e.vec_id = query)) AS hit FROM knn WHERE rank <= 5 GROUP BY query), g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT t.query, round(t.hit / g.n, 9) AS completeness FROM t JOIN embeddings e ON e.vec_id = t.query JOIN g ON g.label = e.label")
def ref_a32_conversation_completeness(s, sf):
    v = _vectors(s, sf).select("item", "label")
    q = v.select(F.col("item").alias("query"), F.col("label").alias("ql"))
    sizes = v.groupBy(F.col("label").alias("ql")).agg(F.count("*").alias("n"))
    hit = _knn(s, sf).where("rank <= 5").join(v, "item").join(q, "query").join(sizes, "ql")
    return hit.groupBy("query", "n").agg(F.count_if(F.col("label") == F.col("ql")).alias("h")).select("query", F.round(F.col("h") / F.col("n"), 9).alias("completeness"))


@query("SELECT source, count(*) AS total, count(CASE WHEN n_chars >= 500 THEN 1 END) AS relevant FROM documents WHERE source IS NOT NULL GROUP BY source")
def ref_a35_total_relevant(s, sf):
    return table(s, sf, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") >= 500).alias("relevant"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT content_sha256 AS k, max(state) AS v FROM messages GROUP BY 1) a FULL JOIN (SELECT content_sha256 AS k, min(state) AS v FROM messages WHERE folder = 'Archive' GROUP BY 1) b ON a.k = b.k")
def ref_j10_overlay_merge(s, sf):
    m = table(s, sf, "messages")
    a = m.groupBy(F.col("content_sha256").alias("k")).agg(F.max("state").alias("local"))
    b = m.where("folder = 'Archive'").groupBy(F.col("content_sha256").alias("k")).agg(F.min("state").alias("ref"))
    return a.join(b, "k", "full").select("k", F.coalesce("ref", "local").alias("v"))


@query("SELECT p.account_id, p.n AS profiles, coalesce(m.n, 0) AS deliveries FROM (SELECT account_id, count(*) AS n FROM corpus_profiles GROUP BY 1) p LEFT JOIN (SELECT account_id, count(*) AS n FROM messages GROUP BY 1) m ON m.account_id = p.account_id")
def ref_j12_counts_with_default(s, sf):
    p = table(s, sf, "corpus_profiles").groupBy("account_id").agg(F.count("*").alias("profiles"))
    m = table(s, sf, "messages").groupBy("account_id").agg(F.count("*").alias("deliveries"))
    return p.join(m, "account_id", "left").select("account_id", "profiles", F.coalesce("deliveries", F.lit(0)).alias("deliveries"))


@query("SELECT thread_id FROM (SELECT thread_id, count(*) AS n FROM thread_emails WHERE thread_id <> '' GROUP BY 1) WHERE n BETWEEN 3 AND 6")
def ref_p12_threads_of_size(s, sf):
    return table(s, sf, "thread_emails").where("thread_id <> ''").groupBy("thread_id").agg(F.count("*").alias("n")).where("n between 3 and 6").select("thread_id")


@query("SELECT tool, calls, slow, empty_results FROM (SELECT event_type AS tool, count(*) AS calls, count(CASE WHEN value > 50 THEN 1 END) AS slow, count(CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) = 0 THEN 1 END) AS empty_results FROM events GROUP BY 1)")
def ref_p19_usage_filters(s, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(s, sf, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"), F.count_if(F.col("value") > 50).alias("slow"), F.count_if(F.coalesce(k == 0, F.lit(False))).alias("empty_results"))


@query("WITH s AS (SELECT source_name AS src, list_sort(list(length(body))) AS v FROM thread_emails GROUP BY 1) SELECT src, v[CAST(floor((len(v) - 1) * 0.5) AS BIGINT) + 1] AS q50, v[CAST(floor((len(v) - 1) * 0.95) AS BIGINT) + 1] AS q95 FROM s")
def ref_a13_lower_percentiles(s, sf):
    from threadloom.operators.reporting import lower_percentile

    return lower_percentile(table(s, sf, "thread_emails").select(F.col("source_name").alias("src"), F.length("body").cast("bigint").alias("n")), ["src"], "n", [0.5, 0.95])


@query("SELECT CASE WHEN NOT contains(eml_path, '/') THEN '(root)' ELSE array_to_string(string_split(eml_path, '/')[1:least(2, len(string_split(eml_path, '/')) - 1)], '/') END AS label, count(*) AS total, count(CASE WHEN c IS NULL THEN 1 END) AS unclaimed FROM (SELECT DISTINCT eml_path FROM messages) m LEFT JOIN (SELECT DISTINCT eml_path AS p, 1 AS c FROM messages WHERE state = 'done') d ON d.p = m.eml_path GROUP BY 1")
def ref_a17_coverage(s, sf):
    from threadloom.operators.reporting import coverage

    m = table(s, sf, "messages").select(F.col("eml_path").alias("path"), "state").where("path is not null")
    return coverage(m, m.where("state = 'done'"))


@query("SELECT count(*) AS n_rows, count(CASE WHEN coalesce(trim(text), '') = '' THEN 1 END) AS n_empty, count(CASE WHEN coalesce(trim(sender), '') = '' THEN 1 END) AS without_sender, count(CASE WHEN coalesce(trim(lang), '') = '' THEN 1 END) AS without_lang FROM documents")
def ref_p25_completeness(s, sf):
    from threadloom.operators.reporting import completeness

    return completeness(table(s, sf, "documents").select("text", "sender", "lang"), "text", ["sender", "lang"])


@query("SELECT domain, n FROM (SELECT regexp_extract(lower(sender), '@([\\w.\\-]+)', 1) AS domain, count(*) AS n FROM thread_emails WHERE sender IS NOT NULL GROUP BY 1) WHERE n >= 20 AND domain NOT IN (SELECT split_part(address, '@', 2) FROM account_addresses) AND domain <> ''")
def ref_p18_candidate_domains(s, sf):
    from threadloom.operators.reporting import candidate_domains

    e = table(s, sf, "thread_emails").where("sender is not null").groupBy(X.sender_domain(F.col("sender")).alias("domain")).agg(F.count("*").alias("n")).where("domain <> ''")
    own = table(s, sf, "account_addresses").select(F.split_part("address", F.lit("@"), F.lit(2)).alias("domain"))
    return candidate_domains(e, 20, own, own.limit(0)).select("domain", "n")


@query()
def ref_j17_slice_with_gold(s, sf):
    from threadloom.operators.reporting import slice_with_gold

    t = table(s, sf, "thread_emails").where("thread_id <> ''").groupBy("thread_id").agg(F.count("*").alias("n_emails"))
    return slice_with_gold(t, table(s, sf, "documents").where("thread_id is not null").select("thread_id"), 500)


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^0-9A-Za-z ]+', ' ', 'g'), ' +', ' ', 'g')) AS q FROM documents")
def ref_f50_sanitized(s, sf):
    from threadloom.operators.reporting import sanitized_query

    return table(s, sf, "documents").select("doc_id", sanitized_query(F.col("text")).alias("q"))
