"""Problem 2: conversations rebuilt from scattered, repeated and partly missing message rows.

A row gives two message hashes: that of the message it answers and its own.  Rows of a thread that arrive one after
the other and answer each other form an export fragment, a run of hashes; where the end of one run is the beginning of
another, the runs overlap, and as a message has one hash wherever it stands, overlaps of any length are the stretches
that runs share in one graph.  Where a hash has exactly one successor and that one exactly one predecessor, the
overlap is unambiguous and both lie on one path; paths are merged by pointer doubling.  A path that begins with a
hash no row brings is a gap, and the whole conversation is dropped.  Replies that point at themselves or round in a
circle have no beginning and no gap.

Threads of up to ``HOT`` rows come sorted out of one exchange and are assembled many at a time in Arrow batches
(``assemble_batch``), with one thread at most carried over; larger ones are assembled by keyed aggregations and
equi-joins (``assemble``), so that no thread is ever collected in one task.  Both give the same rows.

Defined results: rows without a thread id belong to no conversation; rows without a message id are
messages of their own; a null or white-space body counts for completeness and is no turn; a null or
address-less sender speaks as 'unknown'; turns without an instant come last; copies of a message are
one turn, represented by the smallest row id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.identity import normalize_message_id
from threadloom.operators.ranking import grouped_row_number
from threadloom.runtime import materialise

ADDRESS = r"[^\s<>()\[\]\",;:]+@[^\s<>()\[\]\",;:]+"
#: Rows of a thread from which it is assembled by joins.
HOT = 100_000
SPEAKERS = ("unknown", "owner", "correspondent")
_LAST = (1 << 63) - 1


def address_of(c: Column) -> Column:
    """First mail address in a header value, lower case; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), f"({ADDRESS})", 1))


def fragments(emails: DataFrame, addresses: DataFrame) -> DataFrame:
    """One row per export fragment: thread and message hashes, and what a turn needs.  ``emails`` has ``utc_micros``."""
    thread, mid, parent = (normalize_message_id(F.col(c)) for c in ("thread_id", "message_id", "in_reply_to"))
    rows = emails.select(
        F.col("email_id").cast("bigint").alias("email_id"), "account_id", thread.alias("thread_id"), mid.alias("_mid"), parent.alias("_parent"),
        address_of(F.col("sender")).alias("_from"), F.col("utc_micros").alias("_t"),
        F.coalesce(F.col("body").rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False)).alias("_spoken"),
    ).where("thread_id <> ''")
    own = addresses.select("account_id", F.lower("address").alias("_from"), F.lit(True).alias("_own")).distinct()
    rows = rows.join(own, ["account_id", "_from"], "left")
    speaker = F.when(F.col("_from") == "", "unknown").when(F.col("_own"), "owner").otherwise("correspondent")
    return rows.select(
        "thread_id",
        "email_id",
        F.struct(*[F.xxhash64(F.lit(i), F.coalesce("account_id", F.lit(-1)), "thread_id").alias(f"_{i}") for i in (0, 1)]).alias("_th"),  # 128 bits: threads are many
        F.when(F.col("_mid") != "", F.xxhash64(F.lit("m"), "_mid")).otherwise(F.xxhash64(F.lit("row"), "email_id")).alias("_mh"),
        F.when(F.col("_parent") != "", F.xxhash64(F.lit("m"), "_parent")).alias("_ph"),
        (F.col("thread_id").startswith("subj:") | (F.col("_mid") == F.col("thread_id"))).alias("_rooted"),
        speaker.alias("speaker"),
        "_t",
        "_spoken",
    )


def merge_paths(overlaps: DataFrame) -> DataFrame:
    """Merged paths of the overlap graph.  ``overlaps``: distinct (_th, _mh, _ph, _known).

    Gives (_th, _mh, head, depth) for every message that answers another: the first message of its merged path and its
    place in it.  ``head`` of a circle is any of its members.
    """
    known = F.col("_known")
    counted = overlaps.join(overlaps.groupBy("_th", "_ph").agg(F.count("*").alias("_out")), ["_th", "_ph"])
    counted = counted.join(overlaps.groupBy("_th", "_mh").agg(F.count("*").alias("_in")), ["_th", "_mh"])
    single = known & (F.col("_out") == 1) & (F.col("_in") == 1) & (F.col("_ph") != F.col("_mh"))
    table = materialise(counted.groupBy("_th", "_mh").agg(F.max(F.when(single, F.col("_ph"))).alias("up")), "paths")
    # messages with no unambiguous parent head their path
    table = table.select("_th", "_mh", F.coalesce("up", "_mh").alias("head"), F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("depth"))
    open_ = table.where("depth > 0")
    longest = open_.groupBy("_th").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(math.ceil(math.log2(longest + 1)) if longest else 0):
        up = table.select("_th", F.col("_mh").alias("head"), F.col("head").alias("far"), F.col("depth").alias("more")).where("more > 0")
        table = materialise(
            table.join(up, ["_th", "head"], "left").select(
                "_th", "_mh", F.coalesce("far", "head").alias("head"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
            ),
            "paths",
        )
    return table


def assemble_batch(t: np.ndarray, email: np.ndarray, own: np.ndarray, parent: np.ndarray, answers: np.ndarray) -> dict[str, np.ndarray]:
    """Overlap graph and merged paths of whole threads, all at once.

    ``t`` numbers the threads from 0; per row its id, own hash, parent's hash and whether it has a parent.  Gives for every
    node of the graph (``thread``, ``row``: row that represents it or -1, ``head``, ``depth``) and per thread ``n_gaps`` and ``n_paths``.
    """
    n, up_rows = len(t), np.flatnonzero(answers)
    thread, hashed = np.r_[t, t[up_rows]], np.r_[own, parent[up_rows]]
    # rows before parents and small ids first, so that a node's first entry is the row that represents it
    first = np.r_[email, np.full(len(up_rows), _LAST)]
    order = np.lexsort((np.arange(len(thread)) >= n, first, hashed, thread))
    new = np.r_[True, (thread[order][1:] != thread[order][:-1]) | (hashed[order][1:] != hashed[order][:-1])]
    node = np.empty(len(thread), np.int64)
    node[order] = np.cumsum(new) - 1
    lead = order[new]
    nodes = len(lead)
    row = np.where(lead < n, lead, -1)
    # runs of hashes overlap where they share a node; each pair of neighbours is one edge, however many runs hold it
    edges = np.unique(node[n:] * nodes + node[up_rows]) if len(up_rows) else np.zeros(0, np.int64)
    a, b = edges // max(nodes, 1), edges % max(nodes, 1)
    out, into = np.bincount(a, minlength=nodes), np.bincount(b, minlength=nodes)
    single = (out[a] == 1) & (into[b] == 1) & (a != b)
    head = np.arange(nodes)
    head[b[single]] = a[single]
    starts = head == np.arange(nodes)
    depth = (~starts).astype(np.int64)
    for _ in range(math.ceil(math.log2(nodes + 1)) if nodes else 0):
        if (depth[head] == 0).all():
            break
        depth, head = depth + depth[head], head[head]
    threads = int(t[-1]) + 1 if n else 0
    gaps = np.bincount(thread[lead], np.where(starts & (row < 0), out, 0), threads).astype(np.int64)
    return {"thread": thread[lead], "row": row, "head": head, "depth": depth, "n_gaps": gaps, "n_paths": np.bincount(thread[lead], starts, threads).astype(np.int64)}


def _whole_threads(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of whole threads and the threads' numbers; ``batches`` are sorted by thread."""
    held: list[pd.DataFrame] = []

    def numbered(b: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        x, y = b["_a"].to_numpy(), b["_b"].to_numpy()
        return b, np.cumsum(np.r_[False, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])

    for b in batches:
        if not len(b):
            continue
        x, y = b["_a"].to_numpy(), b["_b"].to_numpy()
        cut = int(np.flatnonzero((x != x[-1]) | (y != y[-1]))[-1]) + 1 if (x[0], y[0]) != (x[-1], y[-1]) else 0
        if cut:  # the last thread may go on
            yield numbered(pd.concat([*held, b.iloc[:cut]], ignore_index=True))
            held = [b.iloc[cut:]]
        elif held and (held[0]["_a"].iat[0], held[0]["_b"].iat[0]) != (x[0], y[0]):
            yield numbered(pd.concat(held, ignore_index=True))
            held = [b]
        else:
            held.append(b)
    if held:
        yield numbered(pd.concat(held, ignore_index=True))


def _facts(b: pd.DataFrame, t: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, np.ndarray]]:
    """(graph, rows that represent a message, facts of each thread)."""
    g = assemble_batch(t, b["email_id"].to_numpy(), b["_mh"].to_numpy(), b["_ph"].to_numpy(), b["_answers"].to_numpy(bool))
    rows = g["row"][g["row"] >= 0]
    n = int(t[-1]) + 1
    spoken, speaker = b["_spoken"].to_numpy(bool)[rows], b["speaker"].to_numpy()[rows]
    count = lambda mask: np.bincount(t[rows], mask, n).astype(np.int64)
    facts = {
        "n_messages": count(np.ones(len(rows))), "n_turns": count(spoken), "n_gaps": g["n_gaps"], "n_paths": g["n_paths"], "rooted": np.bincount(t, b["_rooted"].to_numpy(bool), n) > 0,
        "n_owner": count(spoken & (speaker == SPEAKERS[1])), "n_correspondent": count(spoken & (speaker == SPEAKERS[2])),
    }
    facts["sound"] = (facts["n_gaps"] == 0) & facts["rooted"] & (facts["n_owner"] > 0) & (facts["n_correspondent"] > 0)
    return g, rows, facts


def _turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b, t in _whole_threads(batches):
        _, rows, facts = _facts(b, t)
        rows = rows[facts["sound"][t[rows]] & b["_spoken"].to_numpy(bool)[rows]]
        rows = rows[np.lexsort((b["email_id"].to_numpy()[rows], b["_t"].to_numpy()[rows], t[rows]))]
        at = np.arange(len(rows))
        begin = np.maximum.accumulate(np.where(np.r_[True, t[rows][1:] != t[rows][:-1]], at, 0)) if len(rows) else at
        out = b.iloc[rows][["thread_id", "email_id", "speaker"]]
        yield out.assign(turn_no=(at - begin + 1).astype(np.int32))[["thread_id", "turn_no", "email_id", "speaker"]]


def _threads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b, t in _whole_threads(batches):
        _, _, facts = _facts(b, t)
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        yield pd.DataFrame({"thread_id": b["thread_id"].to_numpy()[first], **facts})


def _split(rows: DataFrame, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """(threads of up to ``hot`` rows, sorted by thread in each partition; rows of larger ones, None where there are none)."""
    big = materialise(rows.groupBy("_th").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("_th"), "hot")
    large = None
    if not big.isEmpty():
        large = rows.join(big, "_th", "left_semi")
        rows = rows.join(big, "_th", "left_anti")
    flat = rows.select(
        F.col("_th._0").alias("_a"), F.col("_th._1").alias("_b"), "thread_id", "email_id", "_mh", F.coalesce("_ph", F.lit(0)).alias("_ph"), F.col("_ph").isNotNull().alias("_answers"),
        F.coalesce("_rooted", F.lit(False)).alias("_rooted"), "speaker", F.coalesce("_t", F.lit(_LAST)).alias("_t"), "_spoken",
    )
    return flat.repartition("_a", "_b").sortWithinPartitions("_a", "_b"), large


_THREAD_COLUMNS = "thread_id string, n_messages bigint, n_turns bigint, n_gaps bigint, n_paths bigint, rooted boolean, n_owner bigint, n_correspondent bigint, sound boolean"


def assemble(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, threads) of fragments of huge threads: one row per message with its merged path, and one per thread with what makes it sound."""
    first = F.min_by(F.struct("thread_id", "speaker", "_t", "_spoken"), "email_id")
    messages = (
        rows.groupBy("_th", "_mh")
        .agg(F.min("email_id").alias("email_id"), first.alias("x"), F.max("_rooted").alias("_rooted"), F.count("*").alias("n_rows"))
        .select("_th", "_mh", "email_id", "x.*", "_rooted", "n_rows")
    )
    messages = materialise(messages, "messages")
    prefixes = rows.where("_ph is not null").select("_th", "_mh", "_ph").distinct()
    brought = messages.select("_th", F.col("_mh").alias("_ph"), F.lit(True).alias("_known"))
    overlaps = materialise(prefixes.join(brought, ["_th", "_ph"], "left").withColumn("_known", F.coalesce("_known", F.lit(False))), "overlaps")
    paths = merge_paths(overlaps)
    # a path that begins with a hash no row brings is a gap; inner links are brought by construction
    heads = paths.where("head = _mh").select("_th", "_mh")
    gaps = overlaps.where(~F.col("_known")).join(heads, ["_th", "_mh"], "left_semi").groupBy("_th").agg(F.count("*").alias("n_gaps"), F.countDistinct("_ph").alias("_lost"))
    # messages that answer nothing begin a path as well; a circle has no beginning
    begun = messages.join(paths, ["_th", "_mh"], "left").where("head is null or depth = 0").groupBy("_th").agg(F.count("*").alias("_heads"))
    known_singles = overlaps.where(~F.col("_known")).groupBy("_th", "_ph").agg(F.count("*").alias("_out"), F.min("_mh").alias("_mh"))
    joined = known_singles.where("_out = 1").join(overlaps.groupBy("_th", "_mh").agg(F.count("*").alias("_in")).where("_in = 1"), ["_th", "_mh"]).groupBy("_th").agg(F.count("*").alias("_joined"))
    turn = F.col("_spoken")
    threads = (
        messages.groupBy("_th")
        .agg(
            F.first("thread_id").alias("thread_id"),
            F.count("*").alias("n_messages"),
            F.count_if(turn).alias("n_turns"),
            F.max("_rooted").alias("rooted"),
            F.count_if(turn & (F.col("speaker") == "owner")).alias("n_owner"),
            F.count_if(turn & (F.col("speaker") == "correspondent")).alias("n_correspondent"),
        )
        .join(gaps, "_th", "left").join(begun, "_th", "left").join(joined, "_th", "left")
        .withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0)))
        # a lost hash with one answer is that path's beginning, others are paths of their own
        .withColumn("n_paths", F.coalesce("_heads", F.lit(0)) + F.coalesce("_lost", F.lit(0)) - F.coalesce("_joined", F.lit(0)))
    )
    sound = (F.col("n_gaps") == 0) & F.col("rooted") & (F.col("n_owner") > 0) & (F.col("n_correspondent") > 0)
    threads = threads.withColumn("sound", sound)
    path = paths.select("_th", "_mh", F.col("head").alias("path_head"), F.col("depth").alias("path_pos"))
    return messages.join(path, ["_th", "_mh"], "left"), threads


def conversation_turns(emails: DataFrame, addresses: DataFrame, hot: int = HOT) -> DataFrame:
    """(thread_id, turn_no, email_id, speaker) of every sound conversation.  ``emails`` needs ``utc_micros``."""
    small, large = _split(materialise(fragments(emails, addresses), "fragments"), hot)
    done = small.mapInPandas(_turns, "thread_id string, turn_no int, email_id bigint, speaker string")
    if large is None:
        return done
    messages, threads = assemble(materialise(large, "huge"))
    turns = messages.where("_spoken").join(threads.where("sound").select("_th", "n_turns"), "_th")
    order = [F.col("_t").asc_nulls_last(), F.col("email_id")]
    return done.unionByName(grouped_row_number(turns, "_th", "n_turns", order, "turn_no").select("thread_id", "turn_no", "email_id", "speaker"))


def conversation_threads(emails: DataFrame, addresses: DataFrame, hot: int = HOT) -> DataFrame:
    """Every conversation with its number of messages, turns, gaps and merged paths, and whether it is sound."""
    small, large = _split(materialise(fragments(emails, addresses), "fragments"), hot)
    done = small.mapInPandas(_threads, _THREAD_COLUMNS)
    return done if large is None else done.unionByName(assemble(materialise(large, "huge"))[1].select(*done.columns))
