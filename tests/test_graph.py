"""Graph operators on hand graphs and random ones against plain Python."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Row

from fathom.operators import graph as G
from fathom.operators import small
from fathom.operators.components import connected_components

DECL = "decl_id bigint, parent_id bigint, name string, kind string, supers string, mods string, anns string, language string"


def edges(spark, pairs, ambiguous=()):
    return spark.createDataFrame([Row(src=a, dst=b, kind="Call", ambiguous=(a, b) in ambiguous) for a, b in pairs], "src bigint, dst bigint, kind string, ambiguous boolean")


def decls(spark, rows):
    return spark.createDataFrame([(i, p, f"n{i}", k, "", "", "", "Kotlin") for i, p, k in rows], DECL)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "node bigint")


def nodes(df):
    return {r["node"] for r in df.collect()}


def test_reach_is_least_hops_and_stops_on_cycles(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (1, 3), (4, 5), (None, 1)])
    assert {tuple(r) for r in G.reach(ids(spark, 1, None), e).collect()} == {(1, 0), (2, 1), (3, 1)}


def test_reach_never_enters_avoided_nodes(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 4)])
    assert nodes(G.reach(ids(spark, 1), e, avoid=ids(spark, 2))) == {1, 4}
    assert nodes(G.reach(ids(spark, 2), e, avoid=ids(spark, 2))) == set()


def test_reach_of_nothing(spark):
    assert G.reach(ids(spark), edges(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_against_closure(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(35)}
    closed = {p for p in pairs}
    while True:
        more = {(a, d) for a, b in closed for c, d in closed if b == c} | closed
        if more == closed:
            break
        closed = more
    expect = {}
    for a in range(25):
        own = {b for b in range(25) if (a, b) in closed and (b, a) in closed}
        if len(own | {a}) > 1:
            expect[a] = max(own | {a})
    got = {r["node"]: r["component"] for r in G.strong_components(edges(spark, pairs)).collect()}
    assert got == expect


def test_components_of_a_long_path_and_a_star(spark):
    e = edges(spark, [(i, i + 1) for i in range(10, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7)])
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, **{k: 100 for k in range(100, 130)}}


def test_kill_list_spares_shared_symbols(spark):
    d = decls(spark, [(i, None, "Class") for i in (1, 2, 3, 4)])
    e = edges(spark, [(1, 3), (2, 3), (1, 4)])
    assert nodes(G.kill_list(ids(spark, 1), ids(spark, 1, 2), d, e)) == {1, 4}


def test_kill_list_ambiguous_reference_kills_nothing(spark):
    d = decls(spark, [(i, None, "Class") for i in (1, 2)])
    assert nodes(G.kill_list(ids(spark, 1), ids(spark, 1), d, edges(spark, [(1, 2)], {(1, 2)}))) == {1}


def test_zombies_are_pairs_once(spark):
    e = edges(spark, [(1, 2), (2, 1), (2, 1), (3, 4), (4, 3)])
    assert [tuple(r) for r in G.zombie_pairs(e, ids(spark, 3, 4)).collect()] == [(1, 2)]


def test_ancestors_live_but_not_by_ambiguous_references(spark):
    d = decls(spark, [(10, None, "Class"), (11, 10, "Method"), (20, None, "Class"), (21, 20, "Method"), (1, None, "Method")])
    e = edges(spark, [(1, 11), (1, 21)], {(1, 21)})
    live = nodes(G.enhanced_reach(ids(spark, 1), d, e))
    assert 10 in live and 20 not in live and 21 in live


def test_ground_truth_no_live_reported_all_dead_found(spark):
    """main calls Engine.start; three orphans; one orphan calls a leaf that nothing else calls."""
    d = decls(spark, [(1, None, "Function"), (2, None, "Class"), (3, 2, "Method"), (4, None, "Class"), (5, None, "Class"), (6, None, "Class"), (7, None, "Class")])
    e = edges(spark, [(1, 2), (1, 3), (4, 7)])
    live = nodes(G.deep_reach(ids(spark, 1), d, e))
    assert live == {1, 2, 3}
    assert {r["decl_id"] for r in d.collect()} - live == {4, 5, 6, 7}


def test_why_alive_names_a_nearer_node(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4)])
    assert {tuple(r) for r in G.why_alive(ids(spark, 1, 4, 9), ids(spark, 1), e).collect()} == {(1, 0, None), (4, 2, 2)}


def test_alive_paths_are_shortest_and_least(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (1, 9), (9, 5)])
    assert {(r["node"], tuple(r["path"])) for r in G.alive_path(ids(spark, 1, 4, 5, 8), ids(spark, 1), e).collect()} == {(1, (1,)), (4, (1, 2, 4)), (5, (1, 9, 5))}


def test_inheritance_depth_is_cut_on_cycles(spark):
    names = [("A", "B<T>"), ("B", "p.C()"), ("C", ""), ("X", "Y"), ("Y", "X"), ("Z", "Y"), *[(f"K{k}", f"K{k + 1}") for k in range(9)]]
    rows = [(i, None, n, "Class", s, "", "", "Kotlin") for i, (n, s) in enumerate(names)]
    got = {names[r["node"]][0]: r["depth"] for r in G.inheritance_depth(spark.createDataFrame(rows, DECL), most=6).collect()}
    assert (got["A"], got["B"], got["C"]) == (2, 1, 0) and (got["X"], got["Y"], got["Z"]) == (6, 6, 6) and (got["K0"], got["K4"]) == (6, 4)


def test_cycles_that_count_as_dead(spark):
    e = edges(spark, [(1, 2), (2, 1), (3, 4), (4, 3), (9, 3), (5, 6), (6, 5), (7, 8), (8, 7)])
    kinds = spark.createDataFrame([(i, i not in (7, 8)) for i in range(1, 10)], "node bigint, matters boolean")
    assert {tuple(r) for r in G.dead_cycles(e, ids(spark, 5), kinds).collect()} == {(2, 2)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_task_and_many_agree(spark, seed, monkeypatch):
    rng = random.Random(seed)
    pairs = [(rng.choice("abcdefghijklmnop"), rng.choice("abcdefghijklmnop")) for _ in range(14)]
    e = spark.createDataFrame(pairs + [(None, "a")], "src string, dst string")
    s, avoid = spark.createDataFrame([("a",), ("b",), ("zz",), (None,)], "node string"), spark.createDataFrame([("c",), ("b",)], "node string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for few in (None, 0):
        monkeypatch.setattr("fathom.operators.small.ROWS", 2_000_000 if few is None else 0)
        found = rows(G.reach(s, e)), rows(G.reach(s, e, avoid=avoid)), rows(G.strong_components(e.where("src is not null"))), rows(connected_components(e)), G.reach(s.limit(0), e).count(), connected_components(e.limit(0)).count()
        if few is None:
            first = found
    assert first == found


def test_large_components_in_one_task():
    n = 50_000
    path = pa.table({"u": list(range(1, n)), "v": list(range(n - 1))})
    assert set(small.components(path)["component"].to_pylist()) == {0}
    ring = pa.table({"src": list(range(n)), "dst": [*range(1, n), 0]})
    assert set(small.strong(ring)["component"].to_pylist()) == {n - 1}
