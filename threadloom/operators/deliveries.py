"""Problem 4: exactly one copy of each mail that was delivered at least once.

``DeliveryIndex`` keeps the identifiers seen so far as immutable runs: one row per hash prefix
(bucket) holding sorted parallel arrays.  An incoming batch is first deduplicated locally (one
map-side combined aggregation), then probed against the runs by binary search, and what is novel
or earlier is written as a further run.  Once ``fan_in`` runs exist they are merged into one.

Two kinds of identifier exist per account: the normalised Message-ID (``m``) and the content
digest (``s``).  Deliveries of one account are the same mail if they share a Message-ID, or share
a digest and one of them has no Message-ID; sameness is closed transitively.  The earliest
delivery (``fetched_at``, nulls last, then ``delivery_id``) stays.

Defined results: a delivery with neither identifier is never a copy; a null account is an account
of its own; an empty ledger gives an empty result; extra columns are ignored.  A hot Message-ID,
digest or account collapses in the map-side combine before anything is shuffled, and buckets cut
the hash, not the account, so an account with a third of all rows spreads over all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.identity import normalize_message_id, strip
from threadloom.runtime import materialise, new_path

_IDS = ["_h", "_g"]  # two independent 64-bit hashes: 128 bits of identity
#: _t, _d: instant and id of the earliest delivery under the identifier; _n: some delivery under it has no Message-ID.
_ENTRY = "_h bigint, _g bigint, _t bigint, _d bigint, _n boolean"
_RUN = "_bucket int, _run int, hs array<bigint>, gs array<bigint>, ts array<bigint>, ds array<bigint>, ns array<boolean>"
_COMMIT = "commit_no int, bits int, made int, runs array<string>"
_LAST = 2**63 - 1
#: Identifiers per bucket that a run aims at; one task handles one bucket's arrays.
BUCKET_IDS = 1 << 15


def _hashes(*parts: Column) -> tuple[Column, Column]:
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *reversed(parts))


def identifiers(ledger: DataFrame, account: str, message_id: str, digest: str, fetched: str, delivery: str, batch: str) -> DataFrame:
    """One row per delivery: (_d, _b, _t, _mh, _mg, _sh, _sg); hashes are null where the identifier is missing."""
    mid = normalize_message_id(F.col(message_id))
    sha = strip(F.coalesce(F.col(digest), F.lit("")))
    acc = F.coalesce(F.col(account).cast("string"), F.lit(""))
    mh, mg = _hashes(F.lit("m"), acc, mid)
    sh, sg = _hashes(F.lit("s"), acc, sha)
    has_m, has_s = mid != "", sha != ""
    return ledger.select(
        F.col(delivery).cast("bigint").alias("_d"),
        F.coalesce(F.col(batch).cast("bigint"), F.lit(_LAST)).alias("_b"),
        F.coalesce(F.unix_micros(F.col(fetched).cast("timestamp")), F.lit(_LAST)).alias("_t"),
        F.when(has_m, mh).alias("_mh"), F.when(has_m, mg).alias("_mg"),
        F.when(has_s, sh).alias("_sh"), F.when(has_s, sg).alias("_sg"),
    )


def _entries(ids: DataFrame) -> DataFrame:
    """Local deduplication: the earliest delivery of each identifier."""
    no_mid = F.col("_mh").isNull()
    pairs = F.array(
        F.struct(F.col("_mh").alias("_h"), F.col("_mg").alias("_g"), F.lit(False).alias("_n")),
        F.struct(F.col("_sh").alias("_h"), F.col("_sg").alias("_g"), no_mid.alias("_n")),
    )
    return (
        ids.select("_t", "_d", F.explode(pairs).alias("_p"))
        .select("_t", "_d", "_p.*")
        .where(F.col("_h").isNotNull())
        .groupBy(*_IDS)
        .agg(F.min(F.struct("_t", "_d")).alias("_first"), F.max("_n").alias("_n"))
        .select(*_IDS, F.col("_first._t").alias("_t"), F.col("_first._d").alias("_d"), "_n")
    )


def _search(runs: pd.DataFrame, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Earliest (t, d) and the flag of each probed identifier over all runs of its bucket; t is _LAST where unknown."""
    t, d, n = np.full(len(h), _LAST), np.full(len(h), _LAST), np.zeros(len(h), bool)
    for hs, gs, ts, ds, ns in zip(runs["hs"], runs["gs"], runs["ts"], runs["ds"], runs["ns"]):
        hs, gs = np.asarray(hs, np.int64), np.asarray(gs, np.int64)
        at = np.searchsorted(hs, h)
        end = np.searchsorted(hs, h, side="right")
        width = int((end - at).max(initial=0))  # over 1 only where 64-bit hashes collide
        for k in range(width):
            p = np.minimum(at + k, len(hs) - 1)
            hit = (at + k < end) & (gs[p] == g)
            rt, rd = np.asarray(ts, np.int64)[p], np.asarray(ds, np.int64)[p]
            better = hit & ((rt < t) | ((rt == t) & (rd < d)))
            t, d = np.where(better, rt, t), np.where(better, rd, d)
            n |= hit & np.asarray(ns, bool)[p]
    return t, d, n


class DeliveryIndex:
    """Immutable sorted runs under ``path``; ``bits`` of the hash select the bucket.

    Every ``add`` ends with a commit that names the valid runs, so another process can ``open`` the index and go on; runs that no commit names
    are left over from a job that ended early and are never read.
    """

    def __init__(self, spark: SparkSession, path: str, bits: int, fan_in: int = 3):
        self.spark, self.path, self.bits, self.fan_in = spark, path, bits, fan_in
        self.runs: list[str] = []
        self.made = 0
        self.commits = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, fan_in: int = 3) -> "DeliveryIndex":
        """The index as its last commit left it."""
        last = spark.read.schema(_COMMIT).parquet(f"{path}/commits/*").orderBy(F.desc("commit_no")).first()
        index = cls(spark, path, last["bits"], fan_in)
        index.runs, index.made, index.commits = list(last["runs"]), last["made"], last["commit_no"]
        return index

    def _commit(self) -> None:
        self.commits += 1
        row = self.spark.createDataFrame([(self.commits, self.bits, self.made, self.runs)], _COMMIT)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{self.commits:09d}")

    def _bucket(self) -> Column:
        return F.shiftrightunsigned(F.col("_h"), 64 - self.bits).cast("int") if self.bits else F.lit(0)

    def _write_run(self, entries: DataFrame) -> None:
        """Sort each bucket's identifiers into arrays and store them as one run."""
        self.made += 1
        path = f"{self.path}/run={self.made}"
        arr = F.array_sort(F.collect_list(F.struct("_h", "_g", "_t", "_d", "_n")))
        (
            entries.groupBy(self._bucket().alias("_bucket")).agg(arr.alias("a"))
            .select("_bucket", F.lit(self.made).alias("_run"), F.col("a._h").alias("hs"), F.col("a._g").alias("gs"), F.col("a._t").alias("ts"), F.col("a._d").alias("ds"), F.col("a._n").alias("ns"))
            .write.mode("overwrite").parquet(path)
        )
        self.runs.append(path)

    def read_runs(self) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(*self.runs)

    def entries(self) -> DataFrame:
        """All identifiers, the earliest entry of each; runs overlap only where a later batch held an earlier delivery."""
        if not self.runs:
            return self.spark.createDataFrame([], _ENTRY)
        z = F.explode(F.arrays_zip("hs", "gs", "ts", "ds", "ns")).alias("z")
        rows = self.read_runs().select(z).select(F.col("z.hs").alias("_h"), F.col("z.gs").alias("_g"), F.col("z.ts").alias("_t"), F.col("z.ds").alias("_d"), F.col("z.ns").alias("_n"))
        if len(self.runs) == 1:
            return rows
        return rows.groupBy(*_IDS).agg(F.min(F.struct("_t", "_d")).alias("x"), F.max("_n").alias("_n")).select(*_IDS, "x._t", "x._d", "_n")

    def probe(self, entries: DataFrame) -> DataFrame:
        """``entries`` that are novel, earlier than the index's, or the first without a Message-ID under their digest."""
        if not self.runs:
            return entries

        def search(batch: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
            if not len(batch):
                return batch[["_h", "_g", "_t", "_d", "_n"]]
            t, d, n = _search(runs, batch["_h"].to_numpy(), batch["_g"].to_numpy())
            bt, bd, bn = batch["_t"].to_numpy(), batch["_d"].to_numpy(), batch["_n"].to_numpy().astype(bool)
            new = (bt < t) | ((bt == t) & (bd < d)) | (bn & ~n)
            return batch.loc[new, ["_h", "_g", "_t", "_d", "_n"]]

        keyed = entries.withColumn("_bucket", self._bucket())
        return keyed.groupBy("_bucket").cogroup(self.read_runs().groupBy("_bucket")).applyInPandas(search, _ENTRY)

    def add(self, ids: DataFrame) -> None:
        """Take in one batch of ``identifiers``."""
        self._write_run(self.probe(_entries(ids)))
        if len(self.runs) >= self.fan_in:
            merged, self.runs = self.entries(), []
            self._write_run(merged)
        self._commit()


def _components(edges: DataFrame) -> DataFrame:
    """(a, root): smallest reachable node for every node of ``edges`` (a, b), by label hooking and pointer jumping."""
    both = materialise(edges.union(edges.select("b", "a")).distinct(), "edges")
    label = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("root")), "label")
    while True:
        near = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hooked = label.join(near, "a").select("a", F.least("root", "near").alias("hook"), F.col("root").alias("was"))
        # the label of the label halves the remaining distance
        jump = label.select(F.col("a").alias("hook"), F.col("root").alias("far"))
        step = materialise(hooked.join(jump, "hook", "left").select("a", F.least("hook", F.coalesce("far", "hook")).alias("root"), "was"), "label")
        label = step.select("a", "root")
        if step.where("root <> was").isEmpty():
            return label


def repeated_deliveries(
    ledger: DataFrame, account: str = "account_id", message_id: str = "message_id", digest: str = "content_sha256",
    fetched: str = "fetched_at", delivery: str = "delivery_id", batch: str = "batch_id", rounds: int = 4,
) -> DataFrame:
    """Deliveries to remove, column ``delivery``.  ``rounds``: index updates in which the ledger's batches are taken in."""
    spark = ledger.sparkSession
    ids = materialise(identifiers(ledger, account, message_id, digest, fetched, delivery, batch), "ids")
    n, low, high = ids.agg(F.count("*"), F.min("_b"), F.max(F.when(F.col("_b") < _LAST, F.col("_b")))).first()
    bits = max(0, min(31, math.ceil(math.log2(max(1, 2 * n / BUCKET_IDS)))))
    index = DeliveryIndex(spark, new_path(spark, "delivery-index"), bits)
    low, high = low or 0, high or 0
    cuts = [low + (high - low + 1) * k // rounds for k in range(rounds)]
    for a, b in zip(cuts, [*cuts[1:], None]):
        if b is None or a < b:
            index.add(ids.where((F.col("_b") >= a) & (F.lit(True) if b is None else F.col("_b") < b)))
    entries = index.entries()
    if len(index.runs) > 1:
        entries = materialise(entries, "entries")
    m_keys = entries.select(F.col("_h").alias("_mh"), F.col("_g").alias("_mg"), F.col("_d").alias("a"))
    # a digest joins mails only if some delivery under it has no Message-ID
    active = entries.where("_n").select(F.col("_h").alias("_sh"), F.col("_g").alias("_sg"), F.col("_d").alias("b"))
    bridge = ids.where("_mh is not null").join(active, ["_sh", "_sg"]).select("_mh", "_mg", "b").distinct()
    edges = materialise(bridge.join(m_keys, ["_mh", "_mg"]).where("a <> b").select("a", "b").distinct(), "bridge")
    mine = ids.select("_d", F.coalesce("_mh", "_sh").alias("_h"), F.coalesce("_mg", "_sg").alias("_g")).where("_h is not null")
    first = mine.join(entries.select(*_IDS, F.col("_d").alias("a"), F.col("_t").alias("at")), _IDS)
    if edges.isEmpty():
        return first.where("_d <> a").select(F.col("_d").alias(delivery))
    label = _components(edges)
    when = entries.select(F.col("_d").alias("a"), F.col("_t").alias("at"))
    best = label.join(when, "a").groupBy("root").agg(F.min(F.struct("at", "a")).alias("x")).select("root", F.col("x.a").alias("keep"))
    keep = label.join(best, "root").select("a", "keep")
    return first.join(keep, "a", "left").where(F.col("_d") != F.coalesce("keep", "a")).select(F.col("_d").alias(delivery))
