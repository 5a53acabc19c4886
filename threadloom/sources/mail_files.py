"""Mail files as DataFrames: S1-S5 (.eml), S9 (mbox), S18 (hash lists), S19 (attachment parts), S13 (event logs)."""

from __future__ import annotations

import email
import email.policy
import hashlib
import re
from collections.abc import Iterator
from email.header import decode_header, make_header
from email.message import Message

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import html_text
from threadloom.schemas import ATTACHMENT, EMAIL

#: Fixed value: attachment parts looked at in one message.
MAX_PARTS = 500


def eml_files(spark: SparkSession, root: str, any_case: bool = True) -> DataFrame:
    """S1, S2. (path, content) of every .eml file below ``root``; the reader splits files over tasks by size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if not any_case:
        return files.option("pathGlobFilter", "*.eml").load(root).select("path", "content")
    return files.load(root).where(F.lower("path").endswith(".eml")).select("path", "content")


def strip_preamble(raw: bytes) -> bytes:
    """F13. Bytes from the first header line on: an mbox 'From ' line and stray byte counts before it go."""
    lines = raw.split(b"\n", 8)
    for i, line in enumerate(lines[:8]):
        if re.match(rb"[!-9;-~]+:[ \t\r]?", line) and not line.startswith(b"From "):
            return b"\n".join(lines[i:])
        if line.strip() and not line.startswith((b"From ", b">From ")) and not line.strip().isdigit():
            break
    return raw


def header_text(value: object) -> str:
    """F10. A header with its encoded words decoded; undecodable bytes become replacement characters."""
    if value is None:
        return ""
    try:
        return str(make_header(decode_header(str(value))))
    except (LookupError, UnicodeError, ValueError):
        return str(value)


def payload_text(part: Message) -> str:
    """F12. A text part in its charset, with replacement; UTF-8, then Latin-1 where none is known."""
    raw = part.get_payload(decode=True) or b""
    try:
        return raw.decode(part.get_content_charset() or "utf-8", "strict" if not part.get_content_charset() else "replace")
    except (LookupError, UnicodeDecodeError):
        return raw.decode("latin-1")


def body_text(msg: Message) -> tuple[str, bool]:
    """Plain text of a message, from HTML where there is no plain part, and whether it holds a calendar part."""
    plain, rich, calendar = [], [], False
    for part in msg.walk():
        kind = part.get_content_type()
        calendar |= kind == "text/calendar"
        if part.get_content_disposition() == "attachment" or part.is_multipart():
            continue
        if kind == "text/plain":
            plain.append(payload_text(part))
        elif kind == "text/html":
            rich.append(html_text(payload_text(part)) or "")
    return "\n".join(plain or rich).replace("\r\n", "\n"), calendar


def parse_emails(files: DataFrame) -> DataFrame:
    """S5. One row per file; a file that cannot be read is a row with ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    msg = email.message_from_bytes(strip_preamble(bytes(content)))
                    body, calendar = body_text(msg)
                    h = {k.lower(): header_text(v) for k, v in reversed(msg.items())}
                    n = sum(1 for p in msg.walk() if p.get_filename())
                    get = lambda k: h.get(k, "")
                    out.append((path, get("from"), get("subject"), get("date"), body, get("to"), get("cc"), get("message-id"), get("in-reply-to"), get("references"), [{"name": k, "value": str(v)} for k, v in msg.items()], calendar, n, None))
                except Exception as e:  # one bad file does not end the scan
                    out.append((path, *[None] * 9, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["path", "sender", "subject", "date_raw", "body", "recipients", "cc", "message_id", "in_reply_to", "refs", "headers", "is_calendar", "n_attachments", "error"])

    return files.mapInPandas(run, EMAIL)


def attachments(files: DataFrame) -> DataFrame:
    """S19. One row per attachment part, at most MAX_PARTS a message; a message or part that cannot be read is a row with ``error``, so they can be counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    msg = email.message_from_bytes(strip_preamble(bytes(content)))
                    parts = [p for p in msg.walk() if not p.is_multipart() and (p.get_filename() or p.get_content_disposition() == "attachment")]
                except Exception as e:
                    out.append((path, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
                    continue
                mid = header_text(msg.get("Message-ID"))
                for i, p in enumerate(parts[:MAX_PARTS]):
                    try:
                        data = p.get_payload(decode=True) or b""
                        inline = p.get_content_disposition() == "inline" or bool(p.get("Content-ID"))
                        out.append((path, mid, i, header_text(p.get_filename()), p.get_content_type(), inline, len(data), hashlib.sha256(data).hexdigest(), data, None))
                    except Exception as e:
                        out.append((path, mid, i, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["path", "message_id", "part_no", "filename", "mime", "inline", "size", "sha256", "data", "error"]).astype({"part_no": "Int32", "size": "Int64"})

    return files.mapInPandas(run, ATTACHMENT)


def mbox_messages(spark: SparkSession, path: str) -> DataFrame:
    """S9. (path, content) of the messages of mbox files.  Spark cuts the file at the lines that begin a message, so a large one is read by many tasks; quoted 'From ' lines lose one '>'."""
    text = spark.read.option("lineSep", "\nFrom ").text(path).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, start, i, v in zip(b["p"], b["b"], b["i"], b["value"]):
                rest = bytes(v).partition(b"\n")[2]  # without the line that begins the message
                if rest.strip():
                    out.append((f"{p}#{start}-{i}", re.sub(rb"(?m)^>(>*From )", rb"\1", rest)))
            yield pd.DataFrame(out, columns=["path", "content"])

    return text.mapInPandas(run, "path string, content binary")


def hash_list(spark: SparkSession, path: str) -> DataFrame:
    """S18. Hashes of a list file; comments and blank lines are skipped."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(line.alias("sha256")).where("sha256 <> ''").distinct()


def event_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S13. JSON lines; corrupt ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def spool(emails: DataFrame, root: str) -> None:
    """K12. Messages by year and month of ``ts``, 'undated' without one; rows already there by ``message_key`` are not written again."""
    spark = emails.sparkSession
    rows = emails.withColumns({"year": F.coalesce(F.date_format("ts", "yyyy"), F.lit("undated")), "month": F.coalesce(F.date_format("ts", "MM"), F.lit("00"))}).dropDuplicates(["message_key"])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    if hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
        rows = rows.join(spark.read.parquet(root).select("message_key"), "message_key", "left_anti")
    rows.write.mode("append").partitionBy("year", "month").parquet(root)


def enron_rows(rows: DataFrame, text: str = "email") -> DataFrame:
    """S8. (sender, subject, date_raw, recipients, body) of a benchmark row: headers stand in the first eight lines; a rule of equals signs with more than 40 characters behind it begins the body."""
    lines = F.slice(F.split(F.col(text), "\r?\n"), 1, 8)

    def header(name: str):
        low = f"{name}:"
        hit = F.get(F.filter(lines, lambda l: F.startswith(F.lower(F.ltrim(l)), F.lit(low))), F.lit(0))
        return F.coalesce(F.trim(F.substring(F.ltrim(hit), len(low) + 1, 1 << 20)), F.lit(""))

    tail = F.trim(F.regexp_extract(text, r"(?s)={5,}[^\n]*\n(.*)", 1))
    return rows.withColumns({"sender": header("from"), "subject": header("subject"), "date_raw": header("date"), "recipients": header("to"), "body": F.when(F.length(tail) > 40, tail).otherwise(F.trim(F.col(text)))})


def load_emails(spark: SparkSession, kind: str, root: str, limit: int | None = None) -> DataFrame:
    """S7, S23, X6. The e-mails of a source by its kind: 'eml', 'mbox' or 'table'."""
    from threadloom.operators.corpora import first_files

    if kind == "table":
        return spark.read.parquet(root)
    files = {"eml": eml_files, "mbox": mbox_messages}.get(kind)
    if files is None:
        raise ValueError(f"unknown source {kind!r}")
    return parse_emails(first_files(files(spark, root), limit))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S14. Queries, fixtures and pools, a JSON object a line; Spark's reader passes over blank lines."""
    return spark.read.schema(schema).json(path)


def relevance_judgments(spark: SparkSession, path: str) -> DataFrame:
    """S15. (topic, doc, grade) of a tab-separated judgment file."""
    return spark.read.option("sep", "\t").schema("topic string, doc string, grade int").csv(path)


def topics(spark: SparkSession, path: str) -> DataFrame:
    """S15. (topic, query) of a JSON object of topics."""
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return one.select(F.explode("m").alias("topic", "query"))


def yaml_rows(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """S17. The entries of a section of a YAML file, in order, as rows of ``schema``; read on the driver, as such files are small."""
    import yaml

    entries = (yaml.safe_load("\n".join(r[0] for r in spark.read.text(path).collect())) or {}).get(section) or []
    if isinstance(entries, dict):
        entries = [{"name": k, **(v if isinstance(v, dict) else {"value": v})} for k, v in entries.items()]
    return spark.createDataFrame(entries, schema)


def sheet_rows(files: DataFrame) -> DataFrame:
    """S20. (path, sheet, row_no, cells) of spreadsheet files, every sheet; a file that cannot be read is one row with ``error``."""
    from threadloom.operators.attachments import _xlsx

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    out += [(path, parts[0].removeprefix("[sheet: ").removesuffix("]"), i, r.split("\t"), None) for _, parts in _xlsx(bytes(content)) for i, r in enumerate(parts[1:])]
                except Exception as e:
                    out.append((path, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["path", "sheet", "row_no", "cells", "error"]).astype({"row_no": "Int32"})

    return files.mapInPandas(run, "path string, sheet string, row_no int, cells array<string>, error string")
