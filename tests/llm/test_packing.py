import random

from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm.packing import best_fill, group_sizes, pack, plan, slots


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=6), st.integers(0, 90))
def test_knapsack_is_optimal(stock, capacity):
    sizes, counts = list(stock), list(stock.values())
    sums = {0}
    for s, n in stock.items():
        sums = {a + k * s for a in sums for k in range(n + 1)}
    used = best_fill(sizes, counts, capacity)
    assert all(u <= n for u, n in zip(used, counts))
    assert sum(u * s for u, s in zip(used, sizes)) == max(a for a in sums if a <= capacity)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(5, 100), st.integers(1, 30), min_size=1, max_size=30), st.integers(1, 12))
def test_plan_places_everything_within_capacity(stock, groups):
    made = group_sizes(list(stock.items()), groups)
    assert sum(g[2] for g in made) == sum(stock.values()) and all(a > b for (a, _, _), (_, b, _) in zip(made, made[1:]))
    patterns = plan(made, 100)
    for g in range(len(made)):
        assert sum(u[g] * t for u, t in patterns) == made[g][2]
    assert all(sum(n * made[i][1] for i, n in enumerate(u)) <= 100 for u, _ in patterns)
    covered = sorted((g, a, b) for g, a, b, _, _ in slots(patterns))
    assert all(x[0] != y[0] or x[2] == y[1] for x, y in zip(covered, covered[1:]))


def check(rows, got, capacity):
    want = {k: n for k, n in rows if n}
    parts, load = {}, {}
    for r in got:
        parts.setdefault(r["doc_id"], []).append((r["part_no"], r["token_start"], r["n_tokens"]))
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
    assert {k: sum(p[2] for p in v) for k, v in parts.items()} == want
    for k, v in parts.items():
        at = 0
        for _, start, n in sorted(v):
            assert start == at
            at += n
        assert len(v) == 1 or want[k] > capacity
    assert max(load.values(), default=0) <= capacity
    return len(load)


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, max(0, int(rng.lognormvariate(4, 1.2)))) for i in range(1500)] + [(9001, 1000), (9002, 512), (9003, 513), (9004, None), (9005, 0), (9006, 5120)]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint")
    n = check([(k, v or 0) for k, v in rows], pack(df, "doc_id", "n", 512).collect(), 512)
    least = -(-sum(v or 0 for _, v in rows) // 512)
    assert n <= least * 1.03 + 1


def test_edges(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (3, 3)], "doc_id bigint, n bigint")
    assert check([(1, 3), (2, 3), (3, 3)], pack(df, "doc_id", "n", 6).collect(), 6) == 2
    assert pack(df.limit(0), "doc_id", "n", 6).count() == 0
    same = spark.createDataFrame([(i, 100) for i in range(700)], "doc_id bigint, n bigint")
    assert check([(i, 100) for i in range(700)], pack(same, "doc_id", "n", 512).collect(), 512) == 140
