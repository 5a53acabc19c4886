import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm.splitting import cut_texts, split_oversized


def check(texts, size, overlap):
    over = [t for t in texts if len(t) > size]
    k, a, z = cut_texts(over, np.full(len(over), size), np.full(len(over), overlap))
    for i, t in enumerate(over):
        mine = sorted((int(s), int(e)) for j, s, e in zip(k, a, z) if j == i)
        assert mine[0][0] == 0 and mine[-1][1] == len(t) and len(mine) > 1
        for (_, e1), (s2, e2) in zip(mine, mine[1:]):
            assert s2 == e1 - overlap and e2 > e1
        assert all(0 < e - s <= size for s, e in mine)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\r.!é한👍🏽‍́", max_size=90), max_size=4), st.integers(2, 12), st.integers(0, 5))
def test_pieces_cover_texts_within_the_limit(texts, size, overlap):
    check(texts, size, min(overlap, (size - 1) // 2))


def test_a_boundary_within_the_overlap_ends_no_first_piece():
    check([" aaaaa", "a bbbbbbbb"], 5, 2)


def test_natural_boundaries():
    t = "One two. Three four five.\n\nSix seven eight nine ten. Eleven twelve thirteen"
    k, a, z = cut_texts([t], np.array([40]), np.array([0]))
    assert t[a[0] : z[0]] == "One two. Three four five.\n\n"
    word = "x" * 50 + " tail"
    k, a, z = cut_texts([word], np.array([20]), np.array([5]))
    assert z[0] == 20 and (z - a).max() <= 20
    thumbs = "👍🏽" * 9
    k, a, z = cut_texts([thumbs], np.array([5]), np.array([0]))
    assert all(e % 2 == 0 for e in z)


def test_greedy_equals_one_by_one():
    rng = np.random.default_rng(3)
    words = ["a" * n for n in rng.integers(1, 15, 4000)]
    t = " ".join(words)
    k, a, z = cut_texts([t, t + " end"], np.array([100, 70]), np.array([10, 0]))
    end, ends = 0, []
    while end < len(t):
        limit = 100 if not ends else end - 10 + 100
        if limit >= len(t):
            end = len(t)
        else:
            end = max(p for p in range(end + 1, limit + 1) if t[p - 1] == " ")
        ends.append(end)
    assert list(z[k == 0]) == ends


def test_operator(spark):
    rows = [(1, "x " * 400, 100, 10, "c"), (2, None, 100, 10, None), (3, "", 1, 0, ""), (4, "y" * 600, None, None, ""), (5, "z" * 512, None, -1, ""), (6, "ab cd", 3, 99, ""), (7, "w" * 200_000, 50, 0, "")]
    df = spark.createDataFrame(rows, "id bigint, t string, s int, o int, piece string")
    got = split_oversized(df, "id", "t", "s", "o").collect()
    assert {r["id"] for r in got} == {1, 4, 6, 7}
    for r in got:
        assert rows[r["id"] - 1][1][r["start_at"] : r["end_at"]] == r["piece"]
    assert sorted(r["piece_no"] for r in got if r["id"] == 7) == list(range(1, 4001))
    assert split_oversized(df.limit(0), "id", "t", "s", "o").count() == 0
