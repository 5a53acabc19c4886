import random

import pytest

from threadloom.llm.mixing import budget_tree, fill, largest_total, mixture, shares
from threadloom.llm.tokens import encoder, token_counts

DOCS = "doc_id bigint, n_tokens bigint, source string, lang string, content_kind string, uses int"
TARGETS = "plan_id int, source string, target_share double, max_repeats int"


def test_shortages_go_to_siblings_first():
    nodes = [(("a", "x", "s1"), 1.0, 10.0), (("a", "x", "s2"), 1.0, 100.0), (("b", "x", "s3"), 2.0, 100.0)]
    assert fill(nodes, 100) == [10.0, 40.0, 50.0]
    nodes = [(("a", "x", "s1"), 1.0, 10.0), (("a", "x", "s2"), 1.0, 30.0), (("b", "x", "s3"), 2.0, 100.0)]
    assert fill(nodes, 100) == pytest.approx([10.0, 30.0, 60.0])
    assert fill(nodes, 1000) == [10.0, 30.0, 100.0]
    assert largest_total(nodes) == pytest.approx(40)


def test_mixture(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(1, 60), rng.choice(["a"] * 8 + ["b", "b", "c"]), rng.choice(["en", None, "de"]), "email", 1) for i in range(4000)]
    rows += [(9000, None, "a", "en", "email", 1), (9001, 0, "a", "en", "email", 1), (9002, 5, None, "en", None, 1), (9003, 5, "other", "en", None, 1)]
    plans = [(1, "a", 0.5, 1), (1, "b", 0.3, 2), (1, "c", 0.2, 3), (2, "a", 0.7, None), (2, "missing", 0.3, 4), (3, "missing", 1.0, 1)]
    docs, targets = spark.createDataFrame(rows, DOCS), spark.createDataFrame(plans, TARGETS)
    mix = mixture(docs, targets)
    got = mix.collect()
    cap = {(p, s): r or 1 for p, s, _, r in plans}
    assert all(1 <= r["uses"] <= cap[r["plan_id"], r["source"]] for r in got)
    assert len({(r["plan_id"], r["doc_id"]) for r in got}) == len(got) and not {9000, 9001, 9002, 9003} & {r["doc_id"] for r in got}
    reached = {(r["plan_id"], r["source"]): r["reached_share"] for r in shares(mix, targets).collect()}
    for p, s, share, _ in plans[:3]:
        assert reached[p, s] == pytest.approx(share, abs=0.003)
    assert reached[2, "a"] == 1 and reached[2, "missing"] == 0 and reached[3, "missing"] == 0
    assert {tuple(r) for r in got} == {tuple(r) for r in mixture(docs, targets).collect()}


def test_given_total_and_empty(spark):
    docs = spark.createDataFrame([(i, 10, "a" if i < 10 else "b", "en", "k", 0) for i in range(110)], DOCS)
    targets = spark.createDataFrame([(1, "a", 0.5, 2), (1, "b", 0.5, 1)], TARGETS)
    got = {r["source"]: r["tokens"] for r in shares(mixture(docs, targets, total=800), targets).collect()}
    assert got == {"a": 200, "b": 600}
    assert mixture(docs.limit(0), targets).count() == 0


def test_tokens_round_trip(spark):
    enc = encoder()
    for t in ["Café 한국 \n\n  x", "", "a" * 5000]:
        assert enc.decode(enc.encode_ordinary(t)) == t
    df = spark.createDataFrame([(1, None), (2, "hello world")], "doc_id bigint, text string")
    assert {tuple(r) for r in token_counts(df, "doc_id", "text").collect()} == {(1, 0), (2, 2)}


def poured(nodes, total):
    """Independent reading of the redistribution: at each level, from the leaves' parents up, raise a common level until the shortage is placed."""
    weight = sum(w for _, w, _ in nodes)
    got = [min(total * w / weight, c) for _, w, c in nodes]
    due = {}
    for i, (path, w, _) in enumerate(nodes):
        due[path[:2]] = due.get(path[:2], 0) + total * w / weight - got[i]
    for depth in (2, 1, 0):
        for node in sorted({p[:depth] for p, _, _ in nodes}):
            amount = sum(v for p, v in due.items() if p[:depth] == node)
            inside = [i for i, (p, w, _) in enumerate(nodes) if p[:depth] == node and w > 0]
            room = sum(nodes[i][2] - got[i] for i in inside)
            lo, hi = 0.0, 1e9
            for _ in range(200):
                mid = (lo + hi) / 2
                if sum(min(nodes[i][2] - got[i], mid * nodes[i][1]) for i in inside) < min(amount, room):
                    lo = mid
                else:
                    hi = mid
            for i in inside:
                got[i] += min(nodes[i][2] - got[i], hi * nodes[i][1])
            due = {p: v for p, v in due.items() if p[:depth] != node} | {node: max(0.0, amount - room)}
    return got


@pytest.mark.parametrize("seed", range(20))
def test_redistribution_at_every_level(seed):
    rng = random.Random(seed)
    nodes = [((d, l, s), rng.choice([0.0, 0.1, 0.5, 1.0, 3.0]) or 0.2, float(rng.choice([0, 5, 40, 400]))) for d in "ab" for l in "xy" for s in "123"]
    total = rng.choice([50.0, 400.0, 1500.0])
    assert fill(nodes, total) == pytest.approx(poured(nodes, total), abs=1e-3)


def test_budget_tree_keeps_empty_sources(spark):
    docs = spark.createDataFrame([(1, 60, "a", "en", "k", 0), (2, 40, "a", None, "k", 0), (3, 10, "b", "en", "k", 0), (4, 300, "c", "en", "z", 0)], DOCS)
    targets = spark.createDataFrame([(1, "a", 0.4, 1), (1, "b", 0.4, 2), (1, "gone", 0.2, 5)], TARGETS)
    got = {(r["source"], r["lang"]): r for r in budget_tree(docs, targets, total="all").collect()}
    assert set(got) == {("a", "en"), ("a", None), ("b", "en"), ("gone", None)}
    assert (got["b", "en"]["wanted"], got["b", "en"]["budget"], got["b", "en"]["short"]) == (44, 20, 24) and (got["gone", None]["budget"], got["gone", None]["short"]) == (0, 22)
    # 24 of b go to a's English leaf (26.4 wanted), of 22 of the empty source both leaves of a take by weight
    assert got["a", "en"]["budget"] == pytest.approx(60) and got["a", None]["budget"] == pytest.approx(30)
    assert sum(r["budget"] for r in got.values()) == pytest.approx(110)


def test_refined_ranges_choose_the_same(spark):
    """However finely the hash is cut, and with repeated rows and one hot source, the prefix is that of the plain order."""
    rng = random.Random(9)
    rows = [(i, rng.randrange(1, 40), "hot" if i % 3 else rng.choice("abc"), rng.choice(["en", "de"]), "k", 0) for i in range(3000)]
    rows += [rows[5]] * 4 + [(5000, 10**6, "hot", "en", "k", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([(1, "hot", 0.3, 1), (1, "a", 0.4, 2), (1, "b", 0.3, 3)], TARGETS)
    results = [sorted(map(tuple, mixture(docs, targets, fan=f, edge=e).collect())) for f, e in ((4096, 100_000), (8, 5), (2, 1))]
    assert results[0] == results[1] == results[2]
    reached = {r["source"]: r["reached_share"] for r in shares(mixture(docs, targets), targets).collect()}
    assert reached["hot"] == pytest.approx(0.3, abs=0.005) and reached["a"] == pytest.approx(0.4, abs=0.005)
