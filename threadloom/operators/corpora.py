"""Corpora and runs: scoping (P28, S25, S26), ordered fetches (S3, S16, L3, L5), documents (P9), splitting by sentences (V7), set tables (K19, K21, K22, U1, U4, U5),
judgment tables (J8, J9, J11, J21, A6, A10, A26, A28, A31, A36), bounded threads (W11), layouts (K2, V12) and model passes (M1-M8)."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.identity import content_sha256, message_key, thread_id, truncate
from threadloom.functions.rules import address_preview, argument_summary, prompt
from threadloom.functions.text import estimate_tokens, line_snippets
from threadloom.operators.attachments import count_tokens
from threadloom.operators.mail import keep_latest, upsert
from threadloom.runtime import materialise

# ---------------------------------------------------------------- scoping and ordered fetches


def scope(files: DataFrame, collections: DataFrame, name: str) -> DataFrame:
    """P28. Files (path) of a named collection (collection, root): those at or below its roots; an unknown name is an error, never an empty answer."""
    roots = [r["root"] for r in collections.where(F.col("collection") == name).select("root").distinct().collect()]  # a few per collection
    if not roots:
        raise ValueError(f"unknown collection {name!r}")
    hit = F.lit(False)
    for r in roots:
        if r is not None:
            base = r.rstrip("/")
            hit = hit | (F.col("path") == base) | F.startswith("path", F.lit(base + "/"))
    return files.where(hit)


def collection_catalog(spark: SparkSession, default: str | None = None, prefix: str = "") -> list[Row]:
    """S25. Index tables of the session with their rows and which is the default."""
    make = Row("collection", "n_rows", "is_default")
    return [make(t.name, spark.table(t.name).count(), t.name == default) for t in spark.catalog.listTables() if t.name.startswith(prefix)]


def latest_manifest(spark: SparkSession, folder: str) -> str | None:
    """S26. Collection of the manifest written last, by time, then name; None without any."""
    rows = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    m = rows.select(F.get_json_object("value", "$.collection").alias("c"), F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("o"))
    return m.agg(F.max_by("c", "o")).first()[0]


def first_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    """S3, L3. The first files by path; none at all is an error."""
    if files.isEmpty():
        raise ValueError("no message files found")
    return files if limit is None else files.orderBy("path").limit(limit)


def fetch_in_order(rows: DataFrame, manifest: DataFrame, key: str, position: str) -> DataFrame:
    """S16, U5. Rows of a manifest's keys with its positions; a key that no row has is an error that names some."""
    lost = [r[0] for r in missing(manifest, rows, key).orderBy(key).limit(5).collect()]
    if lost:
        raise ValueError(f"not in the data set: {', '.join(map(str, lost))}")
    return rows.join(manifest.select(key, position), key)


def missing(manifest: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """U5. Keys of a manifest that were not found."""
    return manifest.select(key).distinct().join(found.select(key), key, "left_anti")


def bounded_grep(emails: DataFrame, literal: str, most: int = 500, max_rows: int | None = None, seconds: float | None = None, key: str = "email_id", steps: int = 16) -> tuple[list[Row], dict]:
    """L5. Matches by id within bounds of matches, rows read and time, with what was read and why it ended.

    The id range is read in ``steps`` parts, each one job whose filter reaches the scan, so a bound ends the scan between parts; at most ``most`` rows come back.
    """
    if not literal:
        raise ValueError("an empty pattern matches nothing")
    ends = emails.agg(F.min(key), F.max(key), F.count("*")).first()
    report = {"scanned": 0, "corpus_rows": ends[2], "complete": True, "stop_reason": None}
    out: list[Row] = []
    if not ends[2]:
        return out, report
    low, began = literal.lower(), time.monotonic()
    lines = line_snippets(F.coalesce("body", F.lit("")), literal)
    hit = F.contains(F.lower(F.coalesce("body", F.lit(""))), F.lit(low)) | F.contains(F.lower(F.coalesce("subject", F.lit(""))), F.lit(low))
    width = (ends[1] - ends[0]) // steps + 1
    for i in range(steps):
        part = emails.where(F.col(key).between(ends[0] + i * width, ends[0] + (i + 1) * width - 1))
        if max_rows is not None:
            left = max_rows - report["scanned"]
            n = part.count()
            if n > left:
                part = part.orderBy(key).limit(left)
            report["scanned"] += min(n, left)
        else:
            told = Observation()
            part = part.observe(told, F.count(F.lit(1)).alias("n"))
        found = part.where(hit).select(key, F.when(F.size(lines) > 0, lines).otherwise(F.array("subject")).alias("lines")).orderBy(key).limit(most - len(out) + 1).collect()
        if max_rows is None:
            report["scanned"] += told.get["n"]
        out += found
        stop = "max_matches" if len(out) > most else "max_files" if max_rows is not None and report["scanned"] >= max_rows and max_rows < ends[2] else "deadline" if seconds is not None and time.monotonic() - began > seconds and i + 1 < steps else None
        if stop:
            return out[:most], report | {"complete": False, "stop_reason": stop}
    return out, report


# ---------------------------------------------------------------- documents and chunks

#: Longest metadata of a document.
SENDER_CHARS, SUBJECT_CHARS, PREVIEW_CHARS, FULL_CHARS, SUMMARY_CHARS, ID_CHARS = 128, 256, 512, 4096, 1024, 998
#: Metadata that is stored but not embedded.
NOT_EMBEDDED = ("source_id", "message_key", "to", "to_full", "cc", "cc_full", "thread_id", "message_id", "in_reply_to", "summary", "is_bulk", "noise_candidate")


def documents(emails: DataFrame) -> DataFrame:
    """P9. One document per e-mail: text, stable key and bounded metadata; optional fields are null where they are empty.

    ``emails``: sender, subject, date_text, body, to_text, cc_text, message_id, in_reply_to, summary, source_name, and is_bulk and noise_candidate where known.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    some = lambda c, n: F.nullif(truncate(c, n), F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in emails.columns else F.lit(False)
    key = truncate(message_key(F.col("message_id"), content_sha256(F.col("sender"), F.col("subject"), F.col("date_text"), F.col("body"))), ID_CHARS)
    return emails.select(
        F.concat(F.lit("body:"), key).alias("doc_id"), text("body").alias("text"), key.alias("message_key"), truncate(text("sender"), SENDER_CHARS).alias("sender"), truncate(text("subject"), SUBJECT_CHARS).alias("subject"),
        F.coalesce(F.nullif(text("date_text"), F.lit("")), F.lit("unknown")).alias("date"), F.col("source_name").alias("source"), some(address_preview(F.col("to_text")), PREVIEW_CHARS).alias("to"),
        some(text("to_text"), FULL_CHARS).alias("to_full"), some(address_preview(F.col("cc_text")), PREVIEW_CHARS).alias("cc"), some(text("cc_text"), FULL_CHARS).alias("cc_full"),
        truncate(thread_id(F.col("message_id"), F.col("in_reply_to"), F.lit(None).cast("string"), F.col("subject")), ID_CHARS).alias("thread_id"), some(text("message_id"), ID_CHARS).alias("message_id"),
        some(text("in_reply_to"), ID_CHARS).alias("in_reply_to"), some(text("summary"), SUMMARY_CHARS).alias("summary"), flag("is_bulk").alias("is_bulk"), flag("noise_candidate").alias("noise_candidate"),
    )


_SENTENCE = re.compile(r"[^.!?。\n]*(?:[.!?。]+[\"'”’)\]]*\s*|\n+|$)")


def sentence_chunks(text: str, size: int = 512, overlap: int = 64, count: Callable[[str], int] = count_tokens) -> list[str]:
    """V7. Sentences joined while they fit; the last ones of a chunk, up to ``overlap`` tokens, begin the next.  A sentence over the size is cut between words."""
    units: list[tuple[str, int]] = []
    for m in _SENTENCE.finditer(text):
        if not m[0]:
            continue
        n = count(m[0])
        if n <= size:
            units.append((m[0], n))
            continue
        open_, used = "", 0
        for w in re.findall(r"\s*\S+\s*", m[0]):
            k = count(w)
            if open_ and used + k > size:
                units.append((open_, used))
                open_, used = "", 0
            open_, used = open_ + w, used + k
        units.append((open_, used))
    out: list[str] = []
    held: list[tuple[str, int]] = []
    fresh = False
    for u in units:
        if fresh and sum(n for _, n in held) + u[1] > size:
            out.append("".join(t for t, _ in held).strip())
            back: list[tuple[str, int]] = []
            for h in reversed(held):
                if sum(n for _, n in back) + h[1] > overlap or sum(n for _, n in back) + h[1] + u[1] > size:
                    break
                back.insert(0, h)
            held = back
        held.append(u)
        fresh = True
    if fresh and (last := "".join(t for t, _ in held).strip()):
        out.append(last)
    return [c for c in out if c]


def split_documents(docs: DataFrame, key: str, text: str, size: int = 512, overlap: int = 64, count: Callable[[str], int] = count_tokens) -> tuple[DataFrame, DataFrame]:
    """V7. (chunks (key, ordinal, text), documents that failed (key, error)): one bad document does not end the run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["_key"], b["_text"]):
                try:
                    out += [(k, i, c, None) for i, c in enumerate(sentence_chunks(t, size, overlap, count))]
                except Exception as e:
                    out.append((k, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["_key", "ordinal", "text", "error"]).astype({"ordinal": "Int32"})

    rows = docs.select(F.col(key).cast("string").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInPandas(run, "_key string, ordinal int, text string, error string")
    rows = materialise(rows.withColumnRenamed("_key", key), "split")
    return rows.where("error is null").drop("error"), rows.where("error is not null").select(key, "error")


def bound_threads(rows: DataFrame, thread: list[str], order: list[str], text: str, budget: int) -> DataFrame:
    """W11. A text per thread: all lines where they fit the budget or are at most two, else the first and the last around a note of what was left out.

    Sums decide first, so only threads that fit are ever collected.
    """
    sums = rows.groupBy(*thread).agg(F.sum(estimate_tokens(F.col(text))).alias("_n"), F.count("*").alias("_c"), F.min_by(text, F.struct(*order)).alias("_first"), F.max_by(text, F.struct(*order)).alias("_last"))
    fits = (F.col("_n") <= budget) | (F.col("_c") <= 2)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda r: r["_t"])
    whole = rows.join(sums.where(fits).select(*thread), thread, "left_semi").groupBy(*thread).agg(F.array_join(lines, "\n").alias("text"), F.lit(0).cast("bigint").alias("left_out"))
    note = F.format_string("[%d messages left out]", F.col("_c") - 2)
    return whole.unionByName(sums.where(~fits).select(*thread, F.concat_ws("\n", "_first", note, "_last").alias("text"), (F.col("_c") - 2).alias("left_out")))


def write_layout(rows: DataFrame, path: str, keys: list[str], sort: str = "thread_id") -> None:
    """K2. A table sorted by ``sort`` within files, so that statistics skip row groups, with Bloom filters on the other looked-up columns."""
    w = rows.repartition(sort).sortWithinPartitions(sort).write.mode("overwrite")
    for k in keys:
        w = w.option(f"parquet.bloom.filter.enabled#{k}", "true")
    w.parquet(path)


def index_variant(rows: DataFrame, kind: str) -> DataFrame:
    """V12. The same chunks for another collection: 'full', 'body' (no attachments), 'dense' (no sparse vector)."""
    if kind == "full":
        return rows
    if kind == "body":
        return rows.where(~F.startswith("doc_key", F.lit("att:")))
    if kind == "dense":
        return rows.drop("sparse")
    raise ValueError(f"unknown kind {kind!r}")


# ---------------------------------------------------------------- set tables and sinks


def merge_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """K19. Rules (rule_key, domain) with the new ones whose domain none covers; a key that is taken gets -2, -3 and so on."""
    fresh = new.join(old.select("domain"), "domain", "left_anti").groupBy("domain").agg(F.min("rule_key").alias("rule_key"))
    taken = old.groupBy(F.regexp_replace("rule_key", r"-\d+$", "").alias("_base")).agg(F.max(F.coalesce(F.nullif(F.regexp_extract("rule_key", r"-(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))).alias("_top"))
    n = F.row_number().over(Window.partitionBy("rule_key").orderBy("domain")) + F.coalesce("_top", F.lit(0))
    named = fresh.join(taken, fresh["rule_key"] == taken["_base"], "left").withColumn("_n", n)
    key = F.when(F.col("_n") > 1, F.concat_ws("-", "rule_key", "_n")).otherwise(F.col("rule_key"))
    return old.select("rule_key", "domain").unionByName(named.select(key.alias("rule_key"), "domain"))


def merged_profile(base: dict, mine: dict, theirs: dict) -> dict:
    """K20. Fields that only one side changed are taken; a field that both changed differently is a conflict."""
    out, clash = dict(theirs), []
    for k in {*base, *mine, *theirs}:
        b, m, t = base.get(k), mine.get(k), theirs.get(k)
        if m != b and t != b and m != t:
            clash.append(k)
        elif m != b:
            out[k] = m
    if clash:
        raise ValueError(f"changed on both sides: {', '.join(sorted(clash))}")
    return {k: v for k, v in out.items() if v is not None}


def save_json(path: str, value: object) -> None:
    """K18, K20. A report, whole or not at all."""
    next_ = Path(f"{path}.{os.getpid()}.part")
    next_.write_text(json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True, default=str) + "\n")
    os.replace(next_, path)


def log_call(path: str | None, tool: str, arguments: dict, seconds: float, ok: bool, result: object = None, error: BaseException | None = None) -> None:
    """K17. One line in the log of calls; a log that cannot be written never fails the call."""
    try:
        if path is None:
            return
        line: dict = {"ts": time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime()), "tool": tool, "args": argument_summary(arguments), "duration_ms": round(seconds * 1000, 1), "ok": ok}
        rows = result if isinstance(result, list) else next((result[k] for k in ("matches", "sources") if isinstance(result.get(k), list)), None) if isinstance(result, dict) else None
        if rows is not None:
            line["result_count"] = len(rows)
        if isinstance(result, dict):
            line |= {k: result[k] for k in ("complete", "scanned", "stop_reason") if "complete" in result and k in result}
        if error is not None:
            line["error"] = f"{type(error).__name__}: {error}"[:200]
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(line, ensure_ascii=False) + "\n")
    except Exception:
        return


def emptied(table: DataFrame, path: str) -> None:
    """K21. The table's schema without its rows."""
    table.limit(0).write.mode("overwrite").parquet(path)


def without_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """K21. All rows but those of some ids."""
    return table.join(ids.select(key), key, "left_anti")


def write_fixture(rows: DataFrame, gold: DataFrame, key: str, path: str) -> None:
    """K22. A corpus as JSON lines, only if every gold key is in it."""
    if not (lost := missing(gold, rows, key)).isEmpty():
        raise ValueError(f"{lost.count()} gold keys are not in the corpus")
    rows.write.mode("overwrite").json(path)


def pooled(hits: DataFrame) -> DataFrame:
    """U1. (query, item, arm, rank) of every arm's hits once: the first arm, in it the best rank."""
    return hits.groupBy("query", "item").agg(F.min(F.struct("arm", "rank")).alias("x")).select("query", "item", "x.*")


# ---------------------------------------------------------------- judgment tables


def aligned(metas: DataFrame, vectors: DataFrame, key: str, position: str) -> DataFrame:
    """J8. Metas that have a vector, numbered by their own order."""
    rows = metas.join(vectors, key)
    return rows.orderBy(position)


def paired(mine: DataFrame, theirs: DataFrame, key: list[str], value: str) -> DataFrame:
    """J9. Values of both judges on the keys they share."""
    return mine.select(*key, F.col(value).alias("a")).join(theirs.select(*key, F.col(value).alias("b")), key)


def agreement(mine: DataFrame, theirs: DataFrame, key: list[str], value: str) -> DataFrame:
    """J11. One row: shared keys and the share of equal values, 0 where none is shared."""
    return paired(mine, theirs, key, value).agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("a").eqNullSafe(F.col("b")).cast("int")), F.lit(0.0)).alias("agreement"))


def spanning_members(questions: DataFrame, emails: DataFrame) -> DataFrame:
    """J21. Messages of each question's thread: (query, thread_id, n_messages, message_ids); a thread is bounded by what a question may span."""
    members = emails.join(questions.select("thread_id").distinct(), "thread_id", "left_semi").groupBy("thread_id").agg(F.sort_array(F.collect_set("message_id")).alias("message_ids"))
    return questions.select("query", "thread_id").join(members, "thread_id").withColumn("n_messages", F.size("message_ids"))


def judgment_counts(judgments: DataFrame) -> DataFrame:
    """A6. One row: all judgments, noise, kept."""
    noise = F.coalesce("is_noise", F.lit(False))
    return judgments.agg(F.count("*").alias("total"), F.count_if(noise).alias("noise"), F.count_if(~noise).alias("kept"))


def recall_counts(hits: DataFrame, flags: list[str]) -> DataFrame:
    """A10. Hits of every flag per arm and category, and per arm over 'ALL'."""
    out = hits.groupingSets([[F.col("arm"), F.col("category")], [F.col("arm")]], F.col("arm"), F.col("category")).agg(F.grouping("category").alias("_g"), F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f) for f in flags])
    return out.select("arm", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("category")).alias("category"), "n", *flags)


def coverage_at(hits: DataFrame, gold: DataFrame, n: int = 3) -> DataFrame:
    """A26. One row: questions and the share whose gold thread is among the first ``n`` different threads of its hits (query, thread_id, rank)."""
    first = hits.groupBy("query", "thread_id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank", "thread_id"))
    good = first.withColumn("_p", place).where(F.col("_p") <= n).join(gold.select("query", "thread_id"), ["query", "thread_id"], "left_semi").select("query").distinct()
    return gold.select("query").distinct().join(good.withColumn("_ok", F.lit(1)), "query", "left").agg(F.count("*").alias("n_queries"), F.avg(F.coalesce("_ok", F.lit(0))).alias("coverage"))


def over_budget(threads: DataFrame, tokens: str, budget: int) -> DataFrame:
    """A28. One row: threads and the percentage over the budget."""
    return threads.agg(F.count("*").alias("n"), F.coalesce(100.0 * F.count_if(F.col(tokens) > budget) / F.count("*"), F.lit(0.0)).alias("percent"))


def mean_grades(grades: DataFrame) -> DataFrame:
    """A31. Mean grade and number of answers per setup."""
    return grades.groupBy("setup").agg(F.count("grade").alias("n"), F.avg("grade").alias("mean_grade"))


def counted(rows: DataFrame, outcome: str, names: list[str]) -> tuple[DataFrame, Observation]:
    """A36. The rows, and counters of their outcomes that fill when they are written: no second pass."""
    told = Observation()
    return rows.observe(told, F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(outcome) == n).alias(n) for n in names]), told


# ---------------------------------------------------------------- model passes: the model is a function of prompts

Model = Callable[[DataFrame], DataFrame]  #: (key, prompt) -> (key, reply, outcome: done, unavailable or error)


def echo_model(prompts: DataFrame) -> DataFrame:
    """A deterministic stand-in: the reply is made of the prompt alone."""
    reply = F.to_json(F.struct(F.substring(F.col("prompt"), -80, 80).alias("summary"), F.lit(False).alias("is_noise"), F.lit(0.5).alias("confidence"), F.lit(True).alias("valid")))
    return prompts.select("key", reply.alias("reply"), F.when(F.length("prompt") > 0, "done").otherwise("error").alias("outcome"))


def model_pass(work: DataFrame, done: DataFrame | None, make_prompt: Column, model: Model) -> tuple[DataFrame, DataFrame]:
    """M1-M3, M5, M7. (table of replies, outcomes of this run).  What has a reply is not asked again, so a run that ended early goes on; failures leave no reply, which is not the same as an empty one."""
    todo = work if done is None else work.join(done.select("key"), "key", "left_anti")
    got = materialise(model(todo.select("key", make_prompt.alias("prompt"))), "replies")
    fresh = got.where("outcome = 'done'").select("key", "reply")
    outcomes = got.select("key", "outcome")
    if done is not None:
        outcomes = outcomes.unionByName(work.join(done.select("key"), "key", "left_semi").select("key", F.lit("cached").alias("outcome")))
    return fresh if done is None else upsert(done, fresh, ["key"]), outcomes


def guarded_pass(work: DataFrame, done: DataFrame | None, make_prompt: Column, model: Model, probe: int = 3, most_failed: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """M4. A pass that first asks for a few, and is an error if those all fail or if more than a quarter of all do."""
    head = work.orderBy("key").limit(probe)
    tried = model(head.select("key", make_prompt.alias("prompt")))
    if not head.isEmpty() and tried.where("outcome = 'done'").isEmpty():
        raise RuntimeError("the model does not answer")
    replies, outcomes = model_pass(work, done, make_prompt, model)
    n, bad = outcomes.agg(F.count("*"), F.count_if(~F.col("outcome").isin("done", "cached"))).first()
    if n and bad / n > most_failed:
        raise RuntimeError(f"{bad} of {n} failed")
    return replies, outcomes


def answer_question(query: str, threads: DataFrame, model: Model, most: int = 3) -> dict:
    """M6. An answer from the texts of the first threads (rank, thread_id, text), with its sources; without any thread the model is not asked."""
    top = threads.orderBy("rank").limit(most).select("thread_id", "text").collect()
    if not top:
        return {"answer": None, "sources": []}
    asked = threads.sparkSession.createDataFrame([(query, "\n\n".join(r["text"] for r in top))], "q string, c string")
    row = model(asked.select(F.lit("answer").alias("key"), prompt("answer", query=F.col("q"), context=F.col("c")).alias("prompt"))).first()
    return {"answer": row["reply"] if row["outcome"] == "done" else None, "sources": [r["thread_id"] for r in top]}


def discovered_rules(counts: DataFrame, samples: DataFrame, model: Model, least: int) -> DataFrame:
    """M8, A18, A19. Replies for frequent domains (domain, n), each asked with its sample text (domain, sample)."""
    work = counts.where(F.col("n") >= least).join(samples, "domain").select(F.col("domain").alias("key"), "sample")
    return model_pass(work, None, prompt("rubric", rubric=F.lit("Is mail of this domain noise?"), sender=F.col("key"), subject=F.lit(""), body=F.col("sample")), model)[0]


def newest_judgments(judgments: DataFrame) -> DataFrame:
    """K8. The last judgment of each key by created_at."""
    return keep_latest(judgments, ["key"], [F.col("created_at")])
