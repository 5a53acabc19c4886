"""Problem 9: a mixture of sources with target shares of all tokens.

A plan's weights are propagated down a tree domain - language - source: a leaf gets its source's target
share times its part of that source.  Budgets are capacities (tokens times allowed repeats) against
weights times the total; what a leaf cannot take goes to its siblings first, then to its language's
siblings, then to other domains, always in proportion to weight.  A named source without documents is
a leaf of capacity 0 in a domain of its own, so its share goes to the other domains.  Each leaf then
contributes whole seeded epochs and a token-prefix of one more, in the order of a hash of document,
epoch and seed; what the prefixes of a source's leaves leave over, less than a document each, is filled
with its largest documents that still fit.

Without a total the largest one is taken at which no source that has documents falls short, so that the
shares are met; ``total="all"`` takes all tokens of the plan's sources once over, where scarce sources
fall short and the redistribution decides.

The end of a prefix is found by sums over ``FAN`` ranges of the hash, refined until the range where it
lies holds at most ``EDGE`` documents; only one row a leaf comes to the driver, and documents are never
shuffled.

Defined results: documents of sources a plan does not name, and documents without a token, are not
used; rows that repeat a key are taken or left together; a null language or kind is a node of its own; a
plan whose sources have no documents gives no rows; max_repeats below 1 or null counts as 1; targets that
are null or not positive count as 0.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from threadloom.runtime import materialise

#: Ranges of a hash range that are summed at a time, and the documents of a leaf that one window may order.
FAN, EDGE = 1 << 12, 100_000
_SPAN = 1 << 60
_NULL, _NOWHERE = "\0", "\1"
_LEAF = ["plan_id", "kind", "lang", "source"]


def fill(nodes: list[tuple[tuple, float, float]], total: float) -> list[float]:
    """Budgets of leaves (path, weight, capacity): shortages go to siblings before ancestors' siblings."""

    def spread(members: list[int], amount: float, got: list[float]) -> float:
        """Give ``amount`` to leaves by weight, again and again as they fill up; what none can take comes back."""
        open_ = [i for i in members if nodes[i][2] > got[i] + 1e-9 and nodes[i][1] > 0]
        while amount > 1e-9 and open_:
            weight = sum(nodes[i][1] for i in open_)
            over = 0.0
            for i in open_:
                want = amount * nodes[i][1] / weight
                take = min(want, nodes[i][2] - got[i])
                got[i] += take
                over += want - take
            amount = over
            open_ = [i for i in open_ if nodes[i][2] > got[i] + 1e-9]
        return amount

    got = [0.0] * len(nodes)
    weight = sum(w for _, w, _ in nodes)
    if weight <= 0:
        return got
    short: dict[tuple, float] = defaultdict(float)
    for i, (path, w, cap) in enumerate(nodes):
        got[i] = min(total * w / weight, cap)
        short[path[:-1]] += total * w / weight - got[i]
    depth = max(len(p) for p, _, _ in nodes)
    for level in range(depth - 1, -1, -1):  # siblings, then the nodes above, at last the root
        upper: dict[tuple, float] = defaultdict(float)
        for path, amount in short.items():
            members = [i for i, (p, _, _) in enumerate(nodes) if p[: len(path)] == path]
            rest = spread(members, amount, got)
            if path:
                upper[path[:-1]] += rest
        short = upper
    return got


def largest_total(nodes: list[tuple[tuple, float, float]]) -> float:
    """Largest total at which no source that has documents falls short."""
    weight: dict = defaultdict(float)
    cap: dict = defaultdict(float)
    for path, w, c in nodes:
        weight[path[-1]] += w
        cap[path[-1]] += c
    whole = sum(w for s, w in weight.items() if cap[s] > 0)
    return min((cap[s] * whole / w for s, w in weight.items() if w > 0 and cap[s] > 0), default=0.0)


def _base(docs: DataFrame, targets: DataFrame, key: str, tokens: str, source: str, lang: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(documents of named sources, targets of plans), cleaned."""
    base = docs.select(
        F.col(key).cast("bigint").alias("_key"), F.col(source).alias("source"), F.coalesce(F.col(lang), F.lit(_NULL)).alias("lang"), F.coalesce(F.col(kind), F.lit(_NULL)).alias("kind"), F.col(tokens).cast("bigint").alias("n")
    ).where("n > 0 and source is not null")
    wanted = targets.select("plan_id", "source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("repeats"))
    return materialise(base.join(wanted.select("source").distinct(), "source", "left_semi"), "mix-docs"), wanted


def _budgets(base: DataFrame, wanted: DataFrame, total: float | str | None) -> list[Row]:
    """One row a leaf of a plan's tree: tokens, capacity, tokens wanted by weight, budget after redistribution."""
    members: dict[int, list] = defaultdict(list)
    for r in base.groupBy("kind", "lang", "source").agg(F.sum("n").alias("tokens")).join(wanted, "source").collect():
        members[r["plan_id"]].append((r["kind"], r["lang"], r["source"], r["tokens"], r["share"], r["repeats"]))
    for r in wanted.collect():
        if not any(m[2] == r["source"] for m in members[r["plan_id"]]):
            members[r["plan_id"]].append((_NOWHERE, _NOWHERE, r["source"], 0, r["share"], r["repeats"]))
    rows = []
    make = Row("plan_id", "kind", "lang", "source", "tokens", "capacity", "wanted", "budget", "repeats")
    for plan, leaves in sorted(members.items()):
        leaves.sort()
        size: Counter = Counter()
        for *_, s, n, _, _ in leaves:
            size[s] += n
        nodes = [((k, l, s), share * (n / size[s] if size[s] else 1.0), float(n * rep)) for k, l, s, n, share, rep in leaves]
        amount = largest_total(nodes) if total is None else float(sum(size.values())) if total == "all" else float(total)
        weight = sum(w for _, w, _ in nodes)
        for (k, l, s, n, _, rep), (_, w, cap), b in zip(leaves, nodes, fill(nodes, amount)):
            rows.append(make(plan, k, l, s, n, cap, amount * w / weight if weight else 0.0, b, rep))
    return rows


def budget_tree(docs: DataFrame, targets: DataFrame, key: str = "doc_id", tokens: str = "n_tokens", source: str = "source", lang: str = "lang", kind: str = "content_kind", total: float | str | None = None) -> DataFrame:
    """(plan_id, kind, lang, source, tokens, capacity, wanted, budget, short): the leaves of every plan's tree, a row each; ``short`` is what a leaf cannot take of what its weight asks for."""
    rows = [(r.plan_id, *(None if v in (_NULL, _NOWHERE) else v for v in r[1:3]), r.source, r.tokens, r.capacity, round(r.wanted, 3), round(r.budget, 3), round(max(0.0, r.wanted - r.capacity), 3)) for r in _budgets(*_base(docs, targets, key, tokens, source, lang, kind), total)]
    return docs.sparkSession.createDataFrame(rows, f"plan_id int, {kind} string, {lang} string, {source} string, tokens bigint, capacity double, wanted double, budget double, short double")


def _prefix_ends(open_: DataFrame, leaves: list[tuple], fan: int, edge: int) -> dict[tuple, tuple[int, int, int]]:
    """(hash, key, tokens) of the last document of each leaf's prefix; ``leaves``: (plan, kind, lang, source, rest).  ``open_`` has the leaf, _key, _o and n."""
    spark = open_.sparkSession
    state = [(*leaf, 0, _SPAN, 0) for leaf in leaves]
    done: list[tuple] = []
    while state:
        at = spark.createDataFrame(state, "plan_id int, kind string, lang string, source string, rest double, lo bigint, width bigint, before bigint")
        step = F.greatest(F.floor(F.col("width") / fan), F.lit(1))
        inside = open_.join(F.broadcast(at), _LEAF).where("_o >= lo and _o < lo + width")  # a row a leaf
        sums = inside.groupBy(*_LEAF, "rest", "lo", "before", step.alias("step"), F.floor((F.col("_o") - F.col("lo")) / step).alias("_b")).agg(F.sum("n").alias("s"), F.count("*").alias("c"))
        upto = F.col("before") + F.sum("s").over(Window.partitionBy(*_LEAF).orderBy("_b"))
        first = sums.withColumn("_upto", upto).where("_upto > rest").groupBy(*_LEAF, "rest").agg(F.min(F.struct("_b", (F.col("_upto") - F.col("s")).alias("before"), "c", "lo", "step")).alias("e"))
        state = []
        for r in first.collect():
            lo = r["e"]["lo"] + r["e"]["_b"] * r["e"]["step"]
            (done if r["e"]["c"] <= edge or r["e"]["step"] == 1 else state).append((*(r[c] for c in _LEAF), r["rest"], lo, r["e"]["step"], r["e"]["before"]))
    if not done:
        return {}
    at = spark.createDataFrame(done, "plan_id int, kind string, lang string, source string, rest double, lo bigint, width bigint, before bigint")
    inside = open_.join(F.broadcast(at), _LEAF).where("_o >= lo and _o < lo + width")
    run = F.col("before") + F.sum("n").over(Window.partitionBy(*_LEAF).orderBy("_o", "_key"))  # rows of one key together
    ends = inside.withColumn("_upto", run).where("_upto <= rest").groupBy(*_LEAF).agg(F.max(F.struct("_o", "_key", "_upto")).alias("e")).collect()
    found = {tuple(r[c] for c in _LEAF): tuple(r["e"]) for r in ends}
    return {d[:4]: found.get(d[:4], (d[5] - 1, 0, d[7])) for d in done}


def _gap_sizes(gap: float, sizes: dict[int, int]) -> dict[int, int]:
    """Sizes that fill a gap, the largest that fits first, and how often each."""
    take: dict[int, int] = {}
    for n in sorted(sizes, reverse=True):
        if k := min(sizes[n], int(gap // n)):
            take[n] = k
            gap -= k * n
    return take


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", tokens: str = "n_tokens", source: str = "source", lang: str = "lang", kind: str = "content_kind", total: float | str | None = None, seed: int = 17, fan: int = FAN, edge: int = EDGE) -> DataFrame:
    """(plan_id, key, source, uses, n_tokens): how often each document is used in each plan."""
    spark = docs.sparkSession
    base, wanted = _base(docs, targets, key, tokens, source, lang, kind)
    rows = []
    for r in _budgets(base, wanted, total):
        if r.tokens:
            epochs = min(int((r.budget + 1e-6) // r.tokens), r.repeats)
            rows.append((r.plan_id, r.kind, r.lang, r.source, epochs, max(0.0, r.budget - epochs * r.tokens) + 1e-6 if epochs < r.repeats else -1.0))
    leaf = "plan_id int, kind string, lang string, source string"
    order = F.pmod(F.xxhash64("_key", F.col("epochs"), F.lit(seed)), F.lit(_SPAN))
    used = base.join(F.broadcast(spark.createDataFrame(rows, f"{leaf}, epochs int, rest double")), ["kind", "lang", "source"]).withColumn("_o", order)  # a row a leaf
    begun = [(*r[:4], r[5]) for r in rows if r[5] > 0]
    ends = _prefix_ends(used.where("rest > 0").drop("rest", "epochs"), begun, fan, edge)
    limits = [(*r[:4], *ends.get(r[:4], (-1, 0, 0))[:2]) for r in rows]
    used = used.join(F.broadcast(spark.createDataFrame(limits, f"{leaf}, _to bigint, _tk bigint")), _LEAF)
    within = (F.col("_o") < F.col("_to")) | ((F.col("_o") == F.col("_to")) & (F.col("_key") <= F.col("_tk")))
    used = used.withColumn("_in", within & (F.col("rest") > 0))
    # what the prefixes of a source's leaves leave over
    gap: dict[tuple, float] = defaultdict(float)
    for r in begun:
        gap[r[0], r[3]] += r[4] - ends.get(r[:4], (0, 0, 0))[2]
    extra = spark.createDataFrame([], "plan_id int, _key bigint")
    if gap:
        gaps = spark.createDataFrame([(*k, v) for k, v in gap.items()], "plan_id int, source string, gap double")
        left = used.where("rest > 0 and not _in").join(F.broadcast(gaps), ["plan_id", "source"]).where("n <= gap")  # a row a plan and source
        sizes: dict[tuple, dict[int, int]] = defaultdict(dict)
        for r in left.groupBy("plan_id", "source", "n").agg(F.count("*").alias("c")).collect():  # different sizes below a gap
            sizes[r["plan_id"], r["source"]][r["n"]] = r["c"]
        picks = [(*k, n, c) for k, by in sizes.items() for n, c in _gap_sizes(gap[k], by).items()]
        if picks:
            asked = spark.createDataFrame(picks, "plan_id int, source string, n bigint, _c int")
            rank = F.row_number().over(Window.partitionBy("plan_id", "source", "n").orderBy("_o", "_key"))
            extra = left.join(F.broadcast(asked), ["plan_id", "source", "n"]).withColumn("_r", rank).where(F.col("_r") <= max(x[3] for x in picks)).where("_r <= _c").select("plan_id", "_key").distinct()
    extra = materialise(extra.withColumn("_more", F.lit(1)), "mix-extra")
    uses = F.col("epochs") + F.when(F.col("_in") | F.col("_more").isNotNull(), 1).otherwise(0)
    return used.join(extra, ["plan_id", "_key"], "left").select("plan_id", F.col("_key").alias(key), "source", uses.alias("uses"), F.col("n").alias("n_tokens")).where("uses > 0")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of every source of every plan."""
    got = mix.groupBy("plan_id", "source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.max("uses").alias("most_uses"))
    rows = targets.select("plan_id", "source", "target_share", "max_repeats").join(got, ["plan_id", "source"], "left")
    total = F.sum("tokens").over(Window.partitionBy("plan_id"))
    return rows.select("plan_id", "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.round(F.coalesce(F.col("tokens") / total, F.lit(0.0)), 6).alias("reached_share"))
