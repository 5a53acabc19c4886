"""Problem 5: texts over a size limit cut into overlapping pieces at natural boundaries.

Every boundary of a text (paragraph, line, sentence, word, or, inside a word longer than a piece,
every place that splits no character cluster) is a state.  Its successor is the farthest legal end
of a piece that starts ``overlap`` code points before it.  Squaring the successor table (jump by 1,
2, 4, ... pieces) yields all greedy cuts of all texts of a batch at once, in log2(pieces) steps.

A piece ends at the strongest boundary in the second half of what it may still take: paragraph before
line before sentence; else at the farthest word; else at the farthest cluster; else at the limit.

Defined results: texts within the limit, null and empty texts give no piece; sizes below 1 or null
are the default; a negative or null overlap is its default, and one of half the size or more is cut
to less than half, so that every piece makes progress.  Pieces cover the text without a hole, start
``overlap`` before the previous end, and never exceed the size.  Columns other than the key are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.sampling import portions

DEFAULT_SIZE, DEFAULT_OVERLAP = 512, 64
_SENTENCE_END = np.array([ord(c) for c in ".!?…。！？;:"], np.uint32)
#: Code point ranges that never begin a cluster: combining marks, joiners, variation selectors, skin tones, tags.
_GLUED = [(0x300, 0x36F), (0x200D, 0x200D), (0xFE00, 0xFE0F), (0x1F3FB, 0x1F3FF), (0xE0020, 0xE007F), (0x20D0, 0x20FF)]


def _space(c: np.ndarray) -> np.ndarray:
    return (c == 32) | ((c >= 9) & (c <= 13)) | (c == 0xA0) | (c == 0x3000) | ((c >= 0x2000) & (c <= 0x200A)) | (c == 0x2028) | (c == 0x2029) | (c == 0x85)


def _last_at_most(at: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Largest element of sorted ``at`` not over each limit; -1 where there is none."""
    if not len(at):
        return np.full(len(limit), -1)
    k = np.searchsorted(at, limit, side="right") - 1
    return np.where(k >= 0, at[np.maximum(k, 0)], -1)


def cut_texts(texts: list[str], sizes: np.ndarray, overlaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of every piece, in order; all texts must be longer than their size."""
    if not texts:
        return (np.zeros(0, np.int64),) * 3
    chars = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    length = np.array([len(c) for c in chars], np.int64)
    stop = np.cumsum(length)
    begin = stop - length
    c = np.concatenate(chars)
    n = len(c)
    space = _space(c)
    # place p lies before character p; a word boundary has space before and none after
    word = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    newline = np.cumsum(c == 10)
    run_start = np.maximum.accumulate(np.where(~space, np.arange(n), -1)) + 1  # first space of the run that ends before p
    opened = run_start[word - 1]
    breaks = newline[word - 1] - np.where(opened > 0, newline[np.maximum(opened - 1, 0)], 0)
    paragraph, line = word[breaks >= 2], word[breaks >= 1]
    ended = np.isin(c[np.maximum(opened - 1, 0)], _SENTENCE_END) & (opened > 0)
    sentence = word[ended | (breaks >= 1)]
    glued = np.zeros(n + 1, bool)
    for low, high in _GLUED:
        glued[:n] |= (c >= low) & (c <= high)
    glued[1:n] |= (c[:-1] == 0x200D) | ((c[:-1] == 13) & (c[1:] == 10))
    cluster = np.flatnonzero(~glued[: n + 1])
    # states: text begins and ends, words, and every cluster inside a stretch without words longer than a step
    step = sizes - overlaps
    fixed = np.unique(np.concatenate([begin, stop, word]))
    owner = np.minimum(np.searchsorted(stop, fixed[:-1], side="right"), len(texts) - 1)
    wide = np.flatnonzero(np.diff(fixed) > step[owner])
    extra = []
    for a, b, k in zip(fixed[wide], fixed[wide + 1], owner[wide]):
        inside = cluster[np.searchsorted(cluster, a, "right") : np.searchsorted(cluster, b)]
        # one cluster may itself be longer than a step
        hard = np.arange(a, b, 1) if not len(inside) or np.diff(np.concatenate([[a], inside, [b]])).max() > step[k] else inside
        extra.append(hard)
    state = np.unique(np.concatenate([fixed, *extra])) if extra else fixed
    # a place shared by two texts is the begin of the later one; ends are kept apart as the state after the last
    doc = np.minimum(np.searchsorted(stop, state, side="right"), len(texts) - 1)
    is_begin = state == begin[doc]
    reach = state + np.where(is_begin, sizes[doc], step[doc])
    limit = np.minimum(reach, stop[doc])
    half = state + (limit - state) // 2
    past = state + np.where(is_begin, overlaps[doc], 0)  # a first piece reaches beyond the overlap, so that the next one starts inside the text
    best = np.full(len(state), -1)
    for at, least in ((paragraph, half), (line, half), (sentence, half), (word, past), (cluster, past)):
        found = _last_at_most(at, limit)
        best = np.where((best < 0) & (found > least), found, best)
    best = np.where(best < 0, limit, best)
    best = np.where(reach >= stop[doc], stop[doc], best)
    # successor as a state number; the end of a text is a sink of its own
    sink = len(state)
    ends = best >= stop[doc]
    succ = np.append(np.where(ends, sink, np.searchsorted(state, np.minimum(best, n))), sink)
    del doc
    reached = np.searchsorted(state, begin)
    seen = np.zeros(sink + 1, bool)
    seen[reached] = True
    jump = succ
    while True:  # jump spans 1, 2, 4, ... pieces
        new = jump[np.flatnonzero(seen[:sink])]
        new = new[new < sink]
        before = int(seen.sum())
        seen[new] = True
        if int(seen.sum()) == before and bool((jump[:sink][seen[:sink]] == sink).all()):
            break
        jump = jump[jump]
    cut = np.flatnonzero(seen[:sink])
    place = state[cut]
    k = np.minimum(np.searchsorted(stop, place, side="right"), len(texts) - 1)
    end = np.where(ends[cut], stop[k], best[cut])
    start = np.where(place == begin[k], place, place - overlaps[k])
    return k, start - begin[k], end - begin[k]


def limits(size: Column, overlap: Column) -> tuple[Column, Column]:
    """Effective size and overlap."""
    s = F.when(F.coalesce(size, F.lit(0)) < 1, DEFAULT_SIZE).otherwise(size).cast("bigint")
    o = F.when(F.coalesce(overlap, F.lit(-1)) < 0, DEFAULT_OVERLAP).otherwise(overlap).cast("bigint")
    return s, F.least(o, F.floor((s - 1) / 2)).cast("bigint")


def split_oversized(df: DataFrame, key: str, text: str, size: str, overlap: str, with_text: bool = True) -> DataFrame:
    """(key, piece_no, start_at, end_at[, piece]) of every text with more code points than its size."""
    s, o = limits(F.col(size), F.col(overlap))
    over = df.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"), s.alias("_size"), o.alias("_overlap")).where(
        F.length("_text") > F.col("_size")
    )
    schema = "_key bigint, piece_no int, start_at bigint, end_at bigint" + ", piece string" * with_text

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            whole, keys = b["_text"].tolist(), b["_key"].to_numpy()
            sizes, overlaps = b["_size"].to_numpy(np.int64), b["_overlap"].to_numpy(np.int64)
            for low, high in portions(whole):  # about ten numbers a character are held at a time
                texts = whole[low:high]
                k, start, end = cut_texts(texts, sizes[low:high], overlaps[low:high])
                first = np.searchsorted(k, k)  # k ascends: number of pieces of earlier texts
                out = {"_key": keys[low:high][k], "piece_no": (np.arange(len(k)) - first + 1).astype(np.int32), "start_at": start, "end_at": end}
                if with_text:
                    out["piece"] = [texts[i][a:z] for i, a, z in zip(k.tolist(), start.tolist(), end.tolist())]
                yield pd.DataFrame(out)

    return over.mapInPandas(cut, schema).withColumnRenamed("_key", key)


def profiles_in_force(profiles: DataFrame) -> DataFrame:
    """(account_id, chunk_size, chunk_overlap): the version updated last, of equal times the larger id."""
    latest = F.max_by(F.struct("chunk_size", "chunk_overlap"), F.struct(F.coalesce(F.unix_micros("updated_at"), F.lit(-(2**62))), "profile_id"))
    return profiles.groupBy("account_id").agg(latest.alias("p")).select("account_id", "p.chunk_size", "p.chunk_overlap")
