"""Joins, rules and text operators on small fixtures."""

from pyspark.sql import functions as F

from fathom.operators import joins as J
from fathom.plans import roots as R
from fathom.plans.rules import evaluate, facts, rules
from fathom.plans.text_queries import near_twins
from fathom.sources.reports import keep_pattern


def test_innermost_span_ends_included_ties_to_the_earliest(spark):
    spans = spark.createDataFrame([("f", 0, 100, 1), ("f", 10, 20, 2), ("f", 20, 30, 3), ("f", 10, 20, 9), ("g", 0, 5, 4)], "file string, begin int, end int, span_id int")
    points = spark.createDataFrame([(1, "f", 20), (2, "f", 50), (3, "g", 6), (4, "h", 0)], "point_id int, file string, at int")
    assert {tuple(r) for r in J.enclosing_span(points, spans, "file").collect()} == {(1, 2), (2, 1), (3, None), (4, None)}


def test_as_of_takes_equal_times_and_greatest_of_ties(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id int, g string, t int")
    right = spark.createDataFrame([("a", 5, 7), ("a", 5, 8), ("a", 2, 1)], "g string, t int, v int")
    assert {(r["id"], r["v"]) for r in J.as_of(left, right, "g", "t", "v").collect()} == {(1, 8), (2, None), (3, None)}


def test_next_within_is_strictly_later_and_bounded(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "a", 6)], "id int, g string, t int")
    right = spark.createDataFrame([("a", 5), ("a", 8), ("a", 8)], "g string, t int")
    assert {(r["id"], r["n"]) for r in J.next_within(left, right, "g", "t", 3, "n").collect()} == {(1, 8), (2, None), (3, 8)}


def test_first_tier_with_a_target_wins_whole(spark):
    refs = spark.createDataFrame([(1, "x", "p"), (2, "none", "p"), (3, "none", "none")], "ref_id int, a string, b string")
    one = spark.createDataFrame([("x", 10)], "k string, target int")
    two = spark.createDataFrame([("p", 20), ("p", 21)], "k string, target int")
    got = {tuple(r) for r in J.tiered(refs, [(one, "k", "a"), (two, "k", "b")]).collect()}
    assert got == {(1, 1, 10, False), (2, 2, 20, True), (2, 2, 21, True)}


def test_baseline_names_replace_drift(spark):
    found = spark.createDataFrame([(1, "f", 100, "a.B"), (2, "f", 100, None), (3, "f", 111, None), (4, "f", 100, "a.C")], "id int, file string, line int, fqn string")
    known = spark.createDataFrame([("f", 500, "a.B"), ("f", 100, None)], "file string, line int, fqn string")
    # a name on one side only falls back to lines
    assert {r["id"] for r in J.drift_anti(found, known, ["file"]).collect()} == {3}


D = "decl_id bigint, file string, module string, source_set string, language string, line bigint, bytes bigint, lines bigint, name string, fqn string, kind string, visibility string, anns string, supers string, mods string, type_name string, parent_id bigint"


def decl(i, name, kind, parent=None, vis="Public", anns="", supers="", mods="", size=100, module="m", sset="main", tname="", lang="Kotlin"):
    return (i, f"{module}/src/{sset}/f.{'java' if lang == 'Java' else 'kt'}", module, sset, lang, i, size, size // 40, name, f"{module}.{name}", kind, vis, anns, supers, mods, tname, parent)


def codes(spark, rows, refs=(), roots=(), live=None, iterated=None):
    d = spark.createDataFrame(rows, D)
    e = spark.createDataFrame(list(refs), "src bigint, dst bigint, kind string")
    r = spark.createDataFrame([(x,) for x in roots], "decl_id bigint")
    alive = spark.createDataFrame([(x,) for x in (live if live is not None else [row[0] for row in rows])], "node bigint")
    listed = None if iterated is None else spark.createDataFrame([(x,) for x in iterated], "decl_id bigint")
    out = {}
    for x in evaluate(facts(d, e, r, alive, listed), rules()).collect():
        out.setdefault(x["decl_id"], {})[x["code"]] = x["confidence"]
    return out


def test_rules_on_their_own_cases(spark):
    rows = [
        decl(1, "Counter", "Class"), decl(2, "total", "Property", 1, vis="Private", mods="var"),
        decl(3, "run", "Method", 1), decl(4, "used", "Parameter", 3), decl(5, "unused", "Parameter", 3), decl(6, "_skip", "Parameter", 3),
        decl(7, "Old", "Class", supers="AsyncTask<Void>"), decl(8, "toString", "Method", 7, mods="override"),
        *[decl(20 + k, f"p{k}", "Parameter", 3) for k in range(5)],
    ]
    refs = [(3, 2, "Write"), (8, 4, "Read"), (3, 1, "Call"), (1, 7, "Type"), (1, 3, "Call")]
    got = codes(spark, rows, refs, roots=[1])
    assert got[2]["DC002b"] == "High" and "DC002a" in got[2]
    assert "DC003" in got[5] and "DC003" not in got.get(4, {}) and "DC003" not in got.get(6, {})
    assert got[7]["AP029"] == "High"
    assert "DC009" not in got.get(8, {})  # it refers to something
    assert got[3]["AP023"] == "Medium"  # eight parameters


def test_global_state_is_judged_by_the_property(spark):
    rows = [
        decl(1, "A", "Object", vis="Internal"), decl(2, "x", "Property", 1, mods="var"),
        decl(3, "B", "Object"), decl(4, "x", "Property", 3, vis="Private", mods="var"), decl(5, "y", "Property", 3, mods="val"), decl(6, "z", "Property", 3, anns="VisibleForTesting", mods="var"),
    ]
    got = codes(spark, rows)
    assert got[1]["AP001"] == "High" and "AP001" not in got.get(3, {})


def test_dead_means_unreachable_not_unreferenced(spark):
    rows = [decl(1, "a", "Function"), decl(2, "b", "Function"), decl(3, "C", "Class"), decl(4, "m", "Method", 3), decl(5, "toString", "Method", mods="override"), decl(6, "FakeApi", "Class"), decl(7, "live", "Function")]
    got = codes(spark, rows, [(1, 2, "Call"), (2, 1, "Call")], live=[7])
    assert {1, 2, 3} <= {i for i, c in got.items() if "DC001" in c}
    assert "DC001" not in got.get(4, {}) and "DC001" not in got.get(5, {}) and "DC001" not in got.get(7, {})
    assert got[6]["DC001p"] == "High"


def test_members_that_nothing_uses(spark):
    rows = [decl(1, "C", "Class"), decl(2, "used", "Method", 1), decl(3, "idle", "Method", 1), decl(4, "onCreate", "Method", 1), decl(5, "kept", "Method", 1, anns='Suppress("unused")'), decl(6, "wired", "Method", 1, anns="Provides")]
    got = codes(spark, rows, [(1, 2, "Call")], roots=[1])
    assert "DC001m" in got[3] and "DC001m" in got[4] and not any("DC001m" in got.get(k, {}) for k in (1, 2, 5, 6))
    rows[0] = decl(1, "C", "Class", supers="Activity")
    assert "DC001m" not in codes(spark, rows, [(1, 2, "Call")], roots=[1]).get(4, {})


def test_view_models_are_told_by_super_types(spark):
    rows = [
        decl(1, "HomeViewModel", "Class"), *[decl(10 + k, f"f{k}", "Method", 1) for k in range(20)],
        decl(2, "Home", "Class", supers="AndroidViewModel(app)"), *[decl(40 + k, f"p{k}", "Parameter", 2) for k in range(7)],
        decl(3, "view", "Property", 1), decl(4, "mContext", "Property", 1), decl(5, "items", "Property", 1, tname="List<View>"), decl(6, "pane", "Property", 1, tname="android.view.View?"),
        decl(7, "HomeVm", "Class", supers="Fragment"), decl(8, "view", "Property", 7),
    ]
    got = codes(spark, rows)
    assert "AP007" not in got.get(1, {}) and got[2]["AP007"] == "Medium"
    assert got[3]["AP017"] == got[4]["AP017"] == "Medium" and got[6]["AP017"] == "High"
    assert "AP017" not in got.get(5, {}) and "AP017" not in got.get(8, {})


def test_single_implementations_and_deep_chains(spark):
    rows = [
        decl(1, "Api", "Interface"), decl(2, "Impl", "Class", supers="Api"), decl(3, "ApiFake", "Interface"), decl(4, "F", "Class", supers="ApiFake"),
        decl(5, "Two", "Interface"), decl(6, "X", "Class", supers="Two"), decl(7, "Y", "Class", supers="Base() Two"), decl(8, "Base", "Class"),
        decl(9, "B1", "Class", supers="Base()"), decl(10, "B2", "Class", supers="a.B1<T>"), decl(11, "B3", "Class", supers="B2"), decl(12, "L", "Class", supers="M"), decl(13, "M", "Class", supers="L"),
    ]
    got = codes(spark, rows)
    assert "AP003" in got[1] and "AP003" not in got.get(3, {}) and "AP003" not in got.get(5, {})
    assert "AP002" in got[11] and "AP002" not in got.get(10, {}) and "AP002" in got[12]


def test_enum_cases_and_sealed_variants(spark):
    rows = [
        decl(1, "Mode", "Enum"), decl(2, "A", "EnumCase", 1), decl(3, "Other", "Enum"), decl(4, "B", "EnumCase", 3),
        decl(5, "Shape", "Class", mods="sealed"), decl(6, "Circle", "Class", supers="Shape()"), decl(7, "Dot", "Object", supers="Shape()"), decl(8, "Plain", "Class", supers="Open()"), decl(9, "Open", "Class"),
    ]
    got = codes(spark, rows, [(9, 6, "Inheritance"), (9, 7, "Read")], iterated=[3])
    assert "DC005" in got[2] and "DC005" not in got.get(4, {})
    assert "DC008" in got[6] and "DC008" not in got.get(7, {}) and "DC008" not in got.get(8, {})


def test_thresholds_are_strict(spark):
    rows = [decl(1, "f", "Function", size=40 * 50 + 39), decl(2, "g", "Function", size=40 * 51)]
    got = codes(spark, rows)
    assert "AP012" not in got.get(1, {}) and "AP012" in got[2]


def test_roots_and_empty_tables(spark):
    assert codes(spark, []) == {}
    assert "DC001" not in codes(spark, [decl(1, "main", "Function")], roots=[1]).get(1, {})


def reasons(spark, rows, refs=()):
    d = spark.createDataFrame(rows, D)
    return {r["decl_id"]: r["reason"] for r in R.find_roots(d, spark.createDataFrame(list(refs), "src bigint, dst bigint, kind string")).collect()}


def test_entry_points(spark):
    rows = [
        decl(1, "main", "Function"), decl(2, "main", "Method", 9), decl(3, "main", "Method", 9, mods="static"), decl(4, "plus", "Method", 9, mods="operator"), decl(5, "get", "Method", 9, mods="override"),
        decl(6, "component2", "Function"), decl(7, "Home", "Class", supers="ComponentActivity()"), decl(8, "t", "Method", 9, anns="ParameterizedTest"), decl(9, "Plain", "Class"), decl(10, "get", "Method", 9, lang="Java", mods="override"),
        decl(11, "api", "Method", 9, anns="Provides", tname="Api"), decl(12, "Api", "Class"), decl(13, "other", "Method", 9, anns="Binds", tname="a.Repo<X>"), decl(14, "Repo", "Class"), decl(15, "far", "Method", 9, anns="Provides", tname="Foreign"),
    ]
    got = reasons(spark, rows, [(9, 14, "Type"), (11, 12, "Call"), (9, 12, "Inheritance")])
    assert got == {1: "main", 3: "main", 4: "convention", 5: "convention", 6: "convention", 7: "component", 8: "annotation", 13: "provider", 15: "provider"}


def test_roots_by_name(spark):
    d = spark.createDataFrame([decl(1, "Home", "Class"), decl(2, "Home", "Class", module="n"), decl(3, "UserDao", "Interface"), decl(4, "state", "Field"), decl(5, "Made", "Class"), decl(6, "DaggerHere", "Class"), decl(7, "Here", "Class")], D)
    ids = lambda df: {r["decl_id"] for r in df.collect()}
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "n string")
    assert ids(R.named_roots(d, names("m.Home"))) == {1} and ids(R.named_roots(d, names("x.y.Home", None))) == {1, 2}
    assert ids(R.kept_roots(d, [keep_pattern("m.Use*")])) == {3} and ids(R.kept_roots(d, [])) == set()
    assert ids(R.retained_roots(d, ["*Dao", "n.Home"])) == {2, 3} and ids(R.retained_roots(d, [])) == set()
    assert ids(R.generated_roots(d, names("Made_Factory", "DaggerHere"))) == {5}
    assert ids(R.accessor_roots(d, names("setState"))) == {4}


def test_near_twins_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    base = [str(k) for k in range(12)]
    rows = [(i, "g" if i % 2 else "h", [x if rng.random() > 0.1 else f"{i}{x}" for x in base][: rng.randint(2, 12)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, g string, parts array<string>")
    got = {(r["a"], r["b"]) for r in near_twins(df, "g", "id", F.col("parts")).collect()}
    jac = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    expect = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and len(set(a[2])) >= 3 and len(set(b[2])) >= 3 and jac(a[2], b[2]) >= 0.8}
    assert got == expect and got
