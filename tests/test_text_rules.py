"""Rules over lines on small files, steps of findings and islands on hand cases."""

import re

from fathom.operators import text_rules as T
from fathom.plans import islands as I
from fathom.plans import steps as S

L = "file string, module string, source_set string, ext string, line bigint, text string"


def lines(spark, **files):
    rows = []
    for name, text in files.items():
        base, ext = name.rsplit("_", 1)
        path = f"m/src/main/{base}.{ext}"
        rows += [(path, "m", "main", ext, k, t) for k, t in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, L)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_imports(spark):
    x = lines(spark, A_kt="import a.B\nimport a.C as D\nimport a.*\nimport a.B\nimport static q.E\nval x = B()\n// D", B_java="import z.F;\nclass G { F f; }")
    assert rows(T.unused_imports(x), "line", "name") == [(5, "E")]
    assert rows(T.duplicate_imports(x), "line", "path", "first_line") == [(4, "a.B", 1)]


def test_redundant_this_needs_a_head_and_no_shadow(spark):
    text = "this.a = b\nfun f(c: Int) {\nthis.c = d\nthis.e = g\nval h = 1\nthis.h = k\nthis.m = m\n// this.n = o\n}\nfun q() {\nthis.h = k\n}"
    assert rows(T.redundant_this(lines(spark, A_kt=text)), "line", "name") == [(4, "e"), (11, "h")]


def test_preferences_by_literal_and_constant(spark):
    x = lines(spark, A_kt='const val K = "k"\nconst val TWO = "x"\nedit.putString(K, v)\nedit.putInt("only", 1)\nedit.putInt(TWO, 1)\nbundle.putString("b", v)\nputLong("google_z", 1)', B_kt='const val TWO = "y"\nprefs.getString("k", null)')
    assert rows(T.unread_preferences(x), "key") == [("$TWO",), ("only",)]


def test_settled_flag(spark):
    x = lines(spark, A_kt="if (NEW) { New() } else { Old(); Shared() }\nval s = Shared()\nclass Old {", B_kt="if (!done && NEW) { Fresh() }")
    assert rows(T.settled_flag(x, "NEW", True), "name") == [("Old",)]
    assert rows(T.settled_flag(x, "NEW", False), "name") == [("Fresh",), ("New",)]


def test_modules_by_typed_accessor(spark):
    g = [("settings.gradle", "root", "include(':core:my-lib')"), ("settings.gradle", "root", 'include(":app")'), ("app/build.gradle", "app", "api(projects.core.myLib)"), ("settings.gradle", "root", "include(':gone')"), ("app/build.gradle", "app", 'id("com.android.application")')]
    x = spark.createDataFrame([(f, m, "main", "gradle", k, t) for k, (f, m, t) in enumerate(g)], L)
    assert rows(T.dead_modules(x), "module") == [(":gone",)]


def abstracted(text):
    """Plain Python: names to _, blanks away, quotes kept."""
    out = set()
    for line in text.split("\n"):
        parts = line.strip().split('"')
        for i in range(0, len(parts), 2):
            parts[i] = re.sub(r"\b(?!(?:" + "|".join(T._KEPT) + r")\b)[A-Za-z_]\w*\b(?!\s*\()", "_", parts[i]).replace(" ", "")
        if '"'.join(parts):
            out.add('"'.join(parts))
    return out


def test_near_twins_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    base = ["val a = load(x)", "if (a > 1) stop()", 'log("same")', "return a", "for (i in a) go(i)", "val b = a + c"]
    rows_ = []
    for i in range(40):
        body = [re.sub(r"\ba\b", rng.choice("apq"), t) if rng.random() < 0.9 else f"other{i}({i})" for t in rng.sample(base, rng.randint(2, 6))]
        rows_.append((i, rng.choice("fg"), f"F{rng.randrange(12)}", "\n".join(body)))
    df = spark.createDataFrame(rows_, "decl_id bigint, name string, file string, text string")
    sets = {i: abstracted(t) for i, _, _, t in rows_}
    expect = {(a[0], b[0]) for a in rows_ for b in rows_ if a[0] < b[0] and a[1] == b[1] and a[2] != b[2] and min(len(sets[a[0]]), len(sets[b[0]])) >= 3 and len(sets[a[0]] & sets[b[0]]) >= 0.8 * len(sets[a[0]] | sets[b[0]])}
    assert {(r["a"], r["b"]) for r in T.near_twin_callables(df).collect()} == expect and expect


F_ = "code string, confidence string, decl_id bigint, name string, kind string, fqn string, file string, line bigint, source_set string, visibility string, anns string"


def finding(i, code="DC001", confidence="Medium", name=None, kind="Class", file="f.kt", line=1, sset="main", vis="Public", anns=""):
    return (code, confidence, i, name or f"N{i}", kind, f"p.{name or f'N{i}'}", file, line, sset, vis, anns)


def test_hybrid_order_of_words(spark):
    f = spark.createDataFrame([finding(1), finding(2), finding(3), finding(4, kind="Method", vis="Private"), finding(5, kind="Property", line=7), finding(6, name="Tail")], F_)
    shrunk = spark.createDataFrame([("p.N1", None), ("q.X", "N2")], "class_name string, member string")
    symbols = spark.createDataFrame([("class", "p.N2", True), ("class", "p.N3", False), ("class", "z.MyTail", True)], "kind string, fqn string, covered boolean")
    covered = spark.createDataFrame([("f.kt", 7, False)], "file string, line bigint, covered boolean")
    got = {r["decl_id"]: (r["confidence"], r["runtime_confirmed"]) for r in S.hybrid(f, shrunk, symbols, covered).collect()}
    assert got == {1: ("Confirmed", False), 2: ("Low", False), 3: ("Confirmed", True), 4: ("High", False), 5: ("Confirmed", True), 6: ("Low", False)}


def test_baseline_prune_ratchet_and_necromancy(spark):
    f = spark.createDataFrame([finding(1), finding(2, line=50)], F_)
    base = spark.createDataFrame([("f.kt", "N1", "Class", 9, None), ("f.kt", "N2", "Class", 55, "p.N2"), ("f.kt", "Old", "Class", 1, None)], "file string, name string, kind string, line bigint, fqn string")
    ok, kept = S.ratchet(f, base)
    assert ok and rows(kept, "name") == [("N1",), ("N2",)]
    ok, kept = S.ratchet(f.unionByName(spark.createDataFrame([finding(3)], F_)), base)
    assert not ok and kept.count() == 3
    d = spark.createDataFrame([(1, "N1", "p.N1", "f", 1), (2, "N2", "other.N2", "f", 2), (3, "caller", "c", "g", 5)], "decl_id bigint, name string, fqn string, file string, line bigint")
    e = spark.createDataFrame([(3, 1), (3, 2), (3, 1)], "src bigint, dst bigint")
    assert rows(S.raised(base, d, e), "name", "by", "file", "line") == [("N1", "caller", "g", 5)]


D = "decl_id bigint, parent_id bigint, name string, fqn string, kind string, file string, line bigint, lines bigint, anns string, mods string, supers string, language string"


def code(spark, decls, refs):
    full = [(i, p, n, f"p.{n}", k, f, i, 3, a, "", "", "Kotlin") for i, p, n, k, f, a in decls]
    return spark.createDataFrame(full, D), spark.createDataFrame([(a, b, "Call", False) for a, b in refs], "src bigint, dst bigint, kind string, ambiguous boolean")


def island(spark, decls, refs, roots=(), **more):
    d, e = code(spark, decls, refs)
    r = spark.createDataFrame([(x,) for x in roots], "decl_id bigint")
    return [(r["members"], r["test_only"], r["keep_covered"]) for r in I.islands(d, e, r, **more).collect()]


PAIR = [(1, None, "A", "Class", "m/src/main/A.kt", ""), (2, None, "B", "Class", "m/src/main/B.kt", ""), (3, None, "main", "Function", "m/src/main/M.kt", "")]


def test_islands(spark):
    refs = [(1, 2), (2, 1)]
    assert island(spark, PAIR, refs, [3]) == [(2, False, False)]
    assert island(spark, PAIR, [*refs, (3, 1)], [3]) == []  # one caller from outside dissolves it
    assert island(spark, PAIR, refs, [3], literals=spark.createDataFrame([(3, "A")], "decl_id bigint, word string")) == []
    assert island(spark, PAIR, refs, [3], literals=spark.createDataFrame([(1, "B")], "decl_id bigint, word string")) == [(2, False, False)]
    assert island(spark, PAIR, refs, [3], rooted_names=spark.createDataFrame([("B",)], "name string")) == []
    tested = [*PAIR, (4, None, "t", "Function", "m/src/test/T.kt", "")]
    assert island(spark, tested, [*refs, (4, 1)], [3]) == [(2, True, False)]
    assert island(spark, PAIR, refs, [3], keeps=["^p\\.A$"]) == [(2, False, True)]
    d, e = code(spark, PAIR, refs)
    ids = spark.createDataFrame([(1,), (2,)], "node bigint")
    assert rows(I.kept_alive_by(ids, d, e), "node", "by") == [(1, ["B"]), (2, ["A"])]
