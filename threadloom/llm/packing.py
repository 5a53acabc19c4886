"""Problem 8: documents packed into containers of a fixed number of tokens.

Linear grouping: items over ``small`` of the capacity are sorted by size and cut into groups of about
equal cardinality, each rounded up to its largest size.  What is left is a problem with few sizes:
the driver, which only holds a histogram of at most ``capacity`` sizes, builds patterns (how many items
of each group a container takes), each one starting from the largest size left and filled by a knapsack,
and applies a pattern as often as the groups allow.  Real items then take the slots by their rank in
their group, which is arithmetic on a row number, and never exceed the rounded sizes.  Small items go
best-fit into what the containers really have left, in shards of bounded size.

Defined results: a document over the capacity is cut into full containers and a rest that is packed
like any other item; nothing else is cut.  Documents without a token take no room and are left out.
Equal sizes are told apart by key and part.  An empty table gives no container.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ranking import grouped_row_number
from threadloom.runtime import materialise

#: Items and open containers a best-fit shard aims at.
SHARD = 20_000
#: Container names are exact at any size: 'p' and a number for planned ones, 'f' with key and part for full pieces of cut documents,
#: 's' with shard and number for what the shards opened.


def group_sizes(histogram: list[tuple[int, int]], groups: int) -> list[tuple[int, int, int]]:
    """(smallest, largest, count) of at most about ``groups`` groups of equal cardinality, largest sizes first."""
    total = sum(n for _, n in histogram)
    aim = max(1, -(-total // groups))
    out: list[tuple[int, int, int]] = []
    high = low = count = 0
    for size, n in sorted(histogram, reverse=True):
        if count and count + n > aim:
            out.append((low, high, count))
            count = 0
        if not count:
            high = size
        low, count = size, count + n
    if count:
        out.append((low, high, count))
    return out


def best_fill(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """How many items of each size fill ``capacity`` most, by a bounded knapsack over reachable sums; larger sizes first among equals."""
    if not capacity or not sizes:
        return [0] * len(sizes)
    reach = np.zeros(capacity + 1, bool)
    reach[0] = True
    steps: list[tuple[int, int, np.ndarray]] = []
    for i, (s, n) in enumerate(zip(sizes, counts)):
        n = min(n, capacity // s)
        k = 1
        while n > 0:  # binary splitting of the multiplicity
            k = min(k, n)
            before = reach.copy()
            if k * s <= capacity:
                reach[k * s :] |= before[: capacity + 1 - k * s]
            steps.append((i, k, before))
            n -= k
            k *= 2
    at = int(np.flatnonzero(reach)[-1])
    used = [0] * len(sizes)
    for i, k, before in reversed(steps):
        if not before[at]:
            used[i] += k
            at -= k * sizes[i]
    return used


def plan(groups: list[tuple[int, int, int]], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (items of each group) and how many containers follow each."""
    sizes, left = [g[1] for g in groups], [g[2] for g in groups]
    out = []
    while any(left):
        first = next(i for i, n in enumerate(left) if n)
        left[first] -= 1
        used = best_fill(sizes, left, capacity - sizes[first])
        left[first] += 1
        used[first] += 1
        times = min(n // u for n, u in zip(left, used) if u)
        out.append((used, times))
        left = [n - u * times for n, u in zip(left, used)]
    return out


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(group, first rank, end rank, items a container takes, its first container) of each pattern's share of a group."""
    out, at = [], 0
    rank: dict[int, int] = {}
    for used, times in patterns:
        for g, u in enumerate(used):
            if u:
                start = rank.get(g, 0)
                out.append((g, start, start + u * times, u, at))
                rank[g] = start + u * times
        at += times
    return out


def _best_fit(capacity: int, small: pd.DataFrame, open_: pd.DataFrame) -> pd.DataFrame:
    """Largest small item first, each into the fullest container that still takes it."""
    shard = int((small if len(small) else open_)["_shard"].iat[0]) if len(small) or len(open_) else 0
    free = sorted(zip(open_["_free"].tolist(), open_["container_id"].tolist()))
    made, out = 0, []
    for key, part, n in sorted(zip(small["_key"].tolist(), small["part_no"].tolist(), small["n"].tolist()), key=lambda r: (-r[2], r[0], r[1])):
        i = bisect.bisect_left(free, (n, ""))
        if i < len(free):
            room, c = free.pop(i)
        else:
            room, c = capacity, f"s{shard}-{made}"
            made += 1
        out.append((key, part, n, c))
        if room > n:
            bisect.insort(free, (room - n, c))
    return pd.DataFrame(out, columns=["_key", "part_no", "n", "container_id"])


def pack(sized: DataFrame, key: str, tokens: str, capacity: int, groups: int = 160, small: float = 0.1) -> DataFrame:
    """(container_id, key, part_no, token_start, n_tokens) of every document with tokens."""
    spark = sized.sparkSession
    base = sized.select(F.col(key).cast("bigint").alias("_key"), F.col(tokens).cast("bigint").alias("_n")).where("_n > 0")
    whole = F.floor(F.col("_n") / capacity)
    full = (
        base.where(F.col("_n") > capacity)
        .select("_key", F.explode(F.sequence(F.lit(1), whole.cast("int"))).alias("part_no"))
        .select("_key", "part_no", F.lit(capacity).cast("bigint").alias("n"))
    )
    full = full.withColumn("container_id", F.concat(F.lit("f"), "_key", F.lit("-"), "part_no"))
    over = F.col("_n") > capacity
    items = base.select(
        "_key", F.when(over, whole.cast("int") + 1).otherwise(1).alias("part_no"), F.when(over, F.col("_n") % capacity).otherwise(F.col("_n")).alias("n")
    ).where("n > 0")
    items = materialise(items, "items")
    least = max(1, int(capacity * small))
    histogram = [(r[0], r[1]) for r in items.where(F.col("n") > least).groupBy("n").agg(F.count("*")).collect()]  # at most ``capacity`` rows
    made = group_sizes(histogram, groups)
    large = items.where(F.col("n") > least)
    if made:
        edges = sorted(g[0] for g in made)  # a group is a run of sizes, found by its smallest
        number = {g[0]: i for i, g in enumerate(made)}
        group = F.lit(None).cast("int")
        for e in edges:
            group = F.when(F.col("n") >= e, number[e]).otherwise(group)
        counts = F.element_at(F.array(*[F.lit(g[2]) for g in made]), F.col("_g") + 1)
        ranked = grouped_row_number(large.withColumn("_g", group).withColumn("_size", counts), "_g", "_size", [F.col("n").desc(), F.col("_key"), F.col("part_no")], "_rank")
        by_group: dict[int, list[tuple[int, int, int]]] = {}
        for g, start, _, per, at in slots(plan(made, capacity)):
            by_group.setdefault(g, []).append((start, per, at))
        table = spark.createDataFrame([(g, sorted(s)) for g, s in by_group.items()], "_g int, _slots array<struct<start:bigint,per:bigint,base:bigint>>")
        r = F.col("_rank") - 1
        # a row a group; the last slot that starts at or before a rank is its own
        slot = F.element_at("_slots", F.size(F.filter("_slots", lambda s: s["start"] <= r)))
        placed = ranked.join(F.broadcast(table), "_g").withColumn("_s", slot)
        placed = placed.select("_key", "part_no", "n", F.concat(F.lit("p"), (F.col("_s.base") + F.floor((r - F.col("_s.start")) / F.col("_s.per"))).cast("bigint")).alias("container_id"))
    else:
        placed = large.withColumn("container_id", F.lit("p0"))
    placed = materialise(placed, "placed")
    little = items.where(F.col("n") <= least)
    free = placed.groupBy("container_id").agg((F.lit(capacity) - F.sum("n")).alias("_free")).where("_free > 0")
    n_small, n_free = little.count(), free.count()
    shards = max(1, -(-max(n_small, n_free) // SHARD))
    a = little.withColumn("_shard", F.pmod(F.xxhash64("_key", "part_no"), F.lit(shards)).cast("int")).groupBy("_shard")
    b = free.withColumn("_shard", F.pmod(F.xxhash64("container_id"), F.lit(shards)).cast("int")).groupBy("_shard")
    fitted = a.cogroup(b).applyInPandas(lambda x, y: _best_fit(capacity, x, y), "_key bigint, part_no int, n bigint, container_id string")
    out = full.unionByName(placed).unionByName(fitted)
    return out.select("container_id", F.col("_key").alias(key), "part_no", ((F.col("part_no") - 1) * F.lit(capacity).cast("bigint")).alias("token_start"), F.col("n").alias("n_tokens"))
