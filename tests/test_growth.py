"""Steps whose rows must grow with their input, not with the pairs of equal names."""

import random
import re

from fathom.operators import graph as G
from fathom.operators import joins as J
from fathom.operators import text_rules as T
from fathom.plans import islands as I
from fathom.plans import memo
from fathom.plans import roots as R
from fathom.plans import steps as S
from fathom.plans.model import project
from fathom.sources.reports import dead_keep_rules

DECL = "decl_id bigint, parent_id bigint, name string, fqn string, kind string, file string, line bigint, lines bigint, anns string, mods string, supers string, language string"
EDGE = "src bigint, dst bigint, kind string, ambiguous boolean"
SMOKE = "/root/testdata/sf0.001"


def decls(spark, rows):
    return spark.createDataFrame([(i, p, n, f"p.{n}", k, f"m/src/main/F{i}.kt", i, 3, "", "", s, "Kotlin") for i, p, n, k, s in rows], DECL)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_supers_lead_by_one_node_a_name(spark):
    d = decls(spark, [(i, None, "Port", "Interface", "") for i in range(300)] + [(1000 + i, None, "Impl", "Class", "Port") for i in range(300)])
    none, root = spark.createDataFrame([], EDGE), spark.createDataFrame([(7,)], "decl_id bigint")
    life, via = G.life_edges(root, d, none)
    assert via.count() == 1 and life.count() == 600
    assert {r["node"] for r in G.deep_reach(root, d, none).collect()} == {7, *range(1000, 1300)}


def test_a_taken_number_is_no_name_node(spark):
    one = spark.createDataFrame([(1, "A")], "src bigint, name string")
    two = spark.createDataFrame([("A", 2)], "name string, dst bigint")
    first = G.name_nodes(one, two, one.select("src")).first()["via"]
    assert G.name_nodes(one, two, spark.createDataFrame([(first,)], "id bigint")).first()["via"] != first


def test_words_of_literals_lead_by_one_node_a_word(spark, monkeypatch):
    d = decls(spark, [(i, None, "Same", "Class", "") for i in range(200)] + [(1000 + i, None, "says", "Class", "") for i in range(200)])
    said = spark.createDataFrame([(1000 + i, "Same") for i in range(200)], "decl_id bigint, word string")
    seen, reach = [], G.reach
    monkeypatch.setattr(G, "reach", lambda seeds, e, *a, **k: seen.append(e.count()) or reach(seeds, e, *a, **k))
    root = spark.createDataFrame([(1003,)], "decl_id bigint")
    assert I.islands(d, spark.createDataFrame([(i, i + 1, "Call", False) for i in range(0, 200, 2)], EDGE), root, literals=said).count() == 0
    assert max(seen) <= 100 + 400


def test_necromancy_makes_no_pairs_of_namesakes(spark):
    rows = [("a", None), ("b", "p.b"), ("b", "q.b"), ("c", "p.c")]
    base = spark.createDataFrame(rows, "name string, fqn string")
    d = spark.createDataFrame([(1, "a", "x.a", "f", 1), (2, "b", "p.b", "f", 2), (3, "b", "z.b", "f", 3), (4, "c", None, "f", 4), (5, "d", None, "f", 5), (9, "by", "by", "g", 9)], "decl_id bigint, name string, fqn string, file string, line bigint")
    for i, hit in ((1, True), (2, True), (3, False), (4, True), (5, False)):
        got = S.raised(base, d, spark.createDataFrame([(9, i), (9, i)], "src bigint, dst bigint"))
        assert got.count() == hit
    assert not re.search(r"Join Inner,.*\bname#", plan(got))


def test_drift_by_boxes_equals_all_pairs(spark):
    rng = random.Random(5)
    some = lambda n: [(i, rng.choice("ab"), rng.choice([None, *range(-60, 60)]), rng.choice([None, None, "x", "y"])) for i in range(n)]
    found, known = some(400), some(25)
    for drift in (0, 3, 10):
        has = {i for i, k, line, f in found for _, k2, line2, f2 in known if k == k2 and (f == f2 if f and f2 else None not in (line, line2) and abs(line - line2) <= drift)}
        a, b = (spark.createDataFrame(x, "id int, file string, line bigint, fqn string") for x in (found, known))
        left, kept = J.drift_anti(a, b, ["file"], drift=drift), J.drift_semi(a, b, ["file"], drift=drift)
        assert {r["id"] for r in kept.collect()} == has and {r["id"] for r in left.collect()} == {r[0] for r in found} - has
        assert left.columns == a.columns and "abs(" not in plan(left)


def test_only_what_is_asked_of_the_tables_is_written(spark, tmp_path):
    at = tmp_path / "sf"
    at.symlink_to(SMOKE)
    c = project(spark, str(at))
    assert c.decls.count() > 0
    kept = {k[2]: df for k, (_, df) in memo._kept.items() if k[1] == str(at)}
    assert set(kept) == {"members", "params"} and all(t in ("bigint", "int") for df in kept.values() for _, t in df.dtypes)


def test_mentions_and_keep_rules_are_met_before_they_are_missed(spark):
    d = decls(spark, [(1, None, "Home", "Class", ""), (2, None, "HomeArgs", "Class", ""), (3, None, "User", "Class", "")])
    said = spark.createDataFrame([("HomeArgs",), ("UserArgs",)], "m string")
    got = R.generated_roots(d, said)
    assert [r["decl_id"] for r in got.collect()] == [3]
    kept = dead_keep_rules(spark.createDataFrame([("p.Gone",), ("p.User",), ("q.Gone",)], "spec string"), d)
    assert [r["spec"] for r in kept.collect()] == ["p.Gone"]
    assert all("LeftSemi" in plan(x).split("LeftAnti")[1] for x in (got, kept))


def test_lines_are_sifted_before_they_are_sorted_or_joined(spark):
    x = spark.createDataFrame([("a.kt", "m", "main", "kt", n, t) for n, t in enumerate(["fun f(x: Int) {", "noise()", "this.x = y", "this.z = y", "val z = 1", "this.z = y"], 1)], "file string, module string, source_set string, ext string, line bigint, text string")
    got = T.redundant_this(x)
    assert [(r["line"], r["name"]) for r in got.collect()] == [(4, "z")]
    assert all("fun " in part for part in plan(got).split("Window [")[1:])
    files = spark.createDataFrame([("m/assets/a/one.png",), ("m/assets/two.png",), ("m/assets/three.png",)], "file string")
    y = spark.createDataFrame([("b.kt", "kt", 1, 'open("a/one.png")'), ("b.kt", "kt", 2, "xtwo.png"), ("g", "gradle", 3, "three.png"), ("m/assets/three.png", "kt", 4, "three.png")], "file string, ext string, line bigint, text string")
    got = T.unused_assets(files, y)
    assert [r["file"] for r in got.collect()] == ["m/assets/three.png"] and "sequence(" not in plan(got)


def test_near_twins_abstract_a_text_once(spark):
    text = "a = 1\nif (b) {\ncall(x)\nreturn"
    c = spark.createDataFrame([(1, "n", "f", text), (2, "n", "g", text), (3, "n", "h", "x()\ny()\nz()")], "decl_id bigint, name string, file string, text string")
    got = T.near_twin_callables(c)
    assert [(r["a"], r["b"]) for r in got.collect()] == [(1, 2)] and "regexp_replace" not in plan(got)
