from datetime import datetime
from itertools import product

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from threadloom.operators.deliveries import DeliveryIndex, identifiers, repeated_deliveries

SCHEMA = "delivery_id bigint, batch_id bigint, account_id int, content_sha256 string, message_id string, fetched_at timestamp, _d string"


def norm(m):
    v = (m or "").strip()
    if v.startswith("<") and v.endswith(">"):
        v = v[1:-1]
    return v.strip()


def brute(rows):
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in product(rows, rows):
        ma, mb, sa, sb = norm(a[4]), norm(b[4]), (a[3] or "").strip(), (b[3] or "").strip()
        if a[2] == b[2] and ((ma and ma == mb) or ((not ma or not mb) and sa and sa == sb)):
            root[find(a[0])] = find(b[0])
    groups = {}
    for r in rows:
        groups.setdefault(find(r[0]), []).append((r[5] or datetime.max, r[0]))
    return {d for g in groups.values() for _, d in sorted(g)[1:]}


def found(spark, rows):
    return {r[0] for r in repeated_deliveries(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_closure_and_ties(spark):
    t = [datetime(2024, 1, d) for d in range(1, 6)]
    rows = [
        (1, 1, 1, "s1", "<a@x>", t[0], ""), (2, 1, 1, "s1", None, t[1], ""), (3, 2, 1, "s1", "b@x", t[2], ""), (4, 9, 1, "s2", " b@x ", t[3], ""),
        (5, 9, 1, "s9", "c@x", t[4], ""), (6, 9, 1, "s9", "d@x", t[4], ""), (7, 9, 2, "s1", "a@x", t[4], ""), (8, 3, 1, None, None, t[0], ""),
        (9, 3, 1, None, "< >", t[0], ""), (10, 3, None, "s1", "a@x", t[0], ""), (11, 3, None, "s1", "a@x", t[0], ""), (12, 0, 1, "s7", "c@x", None, ""),
    ]
    assert found(spark, rows) == brute(rows) == {2, 3, 4, 11, 12}


def test_empty_and_hot(spark):
    assert found(spark, []) == set()
    rows = [(i, i % 7, 1, f"s{i}", "<hot@x>" if i % 3 == 0 else f"{i}@x", datetime(2024, 1, 1), "") for i in range(300)]
    assert found(spark, rows) == brute(rows)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from([1, None]), st.sampled_from(["a", "b", "c", "", None]), st.sampled_from(["<m>", "n", "", None, "o"]), st.sampled_from([1, 2, 3])), max_size=14))
def test_random(spark, picks):
    rows = [(i, b, a, s, m, datetime(2024, 1, d), "") for i, (b, a, s, m, d) in enumerate(picks)]
    assert found(spark, rows) == brute(rows)


def test_index_is_opened_again(spark, tmp_path):
    """Another process goes on where the last commit ended; a run that no commit names is not read."""
    rows = [(i, i // 10, 1, f"s{i}", f"<m{i % 25}>", f"2024-01-01 00:{i % 60:02d}:00") for i in range(100)]
    ledger = spark.createDataFrame(rows, "delivery_id bigint, batch_id bigint, account_id int, content_sha256 string, message_id string, fetched_at string")
    ids = identifiers(ledger, "account_id", "message_id", "content_sha256", "fetched_at", "delivery_id", "batch_id")
    path = str(tmp_path / "index")
    whole = DeliveryIndex(spark, str(tmp_path / "whole"), 2)
    whole.add(ids)
    DeliveryIndex(spark, path, 2).add(ids.where("_b < 3"))
    DeliveryIndex.open(spark, path).add(ids.where("_b >= 3 and _b < 6"))
    lost = DeliveryIndex.open(spark, path)
    lost._write_run(ids.limit(0).selectExpr("_d as _h", "_d as _g", "_t", "_d", "true as _n"))  # the job ends before its commit
    last = DeliveryIndex.open(spark, path)
    assert len(last.runs) == 2 and last.bits == 2
    last.add(ids.where("_b >= 6"))
    order = ["_h", "_g"]
    assert last.entries().orderBy(*order).collect() == whole.entries().orderBy(*order).collect() and len(DeliveryIndex.open(spark, path).runs) == 1


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from threadloom.runtime import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    session = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master=master))
    for master in ("yarn", "spark://x:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
