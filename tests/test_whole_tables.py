"""Queries read whole tables: small fixtures whose answer lies outside any prefix of ids or days."""

from __future__ import annotations

import json
import random

from chronolith import queries as Q


def _brute_cycles(edges):
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)

    def reach(n):
        seen, stack = set(), [n]
        while stack:
            for x in to.get(stack.pop(), set()) - seen:
                seen.add(x)
                stack.append(x)
        return seen

    far = {n: reach(n) for e in edges for n in e}
    both = {n: {m for m in far[n] if n in far[m]} | {n} for n in far}
    return {(min(c), n) for n, c in both.items() if len(c) > 1}


def test_cycles_of_all_events(spark, tmp_path):
    r = random.Random(6)
    pairs = [(100, 161), (161, 100), (7, 67), (67, 127), (1000, 1001), (1001, 1002), (1002, 1000)] + [(r.randint(200, 290), r.randint(200, 290)) for _ in range(110)]
    rows = [(5000 + i, a, "error", json.dumps({"k": b})) for i, (a, b) in enumerate(pairs)] + [(1, 127, "click", '{"k": 7}'), (2, 5, "error", '{"k": 5}')]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    want = _brute_cycles({(a, b) for a, b in pairs if a != b})
    assert {(100, 161), (1000, 1002)} <= want and max(n for _, n in want) > 60
    got = Q.queries()["scc_members"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(x.component, x.node) for x in got} == want
    groups = Q.queries()["cycle_vs_cluster"](spark, str(tmp_path)).collect()
    assert {x.component: x.members for x in groups} == {c: ",".join(str(n) for n in sorted(m for d, m in want if d == c)) for c, _ in want}


def test_orphans_of_all_days(spark, tmp_path):
    days = {1: "1995-01-05", 2: "2001-03-04"}
    orders = [(k, k, "F", 1.0, d, "1-URGENT") for k, d in days.items()]
    o = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, d string, o_orderpriority string")
    o.selectExpr("* except (d)", "cast(d as timestamp) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, 1, 1, 2.0), (2, 2, 1, 1, 2.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "p", "b", "t", 5, 1.0) for k in (1, 2, 3)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    assert [(x.rel, x.code) for x in Q.queries()["orphan_files"](spark, str(tmp_path)).collect()] == [("3", 50)]
