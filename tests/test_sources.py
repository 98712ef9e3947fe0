"""Extraction, side inputs, sinks and the watch, on files in a temporary folder."""

import json
import time

import pytest
from pyspark.sql import Row

from fathom.functions import sinks
from fathom.plans.scan import Options, analyse, scan
from fathom.sources import reports as R
from fathom.sources.code import parse
from fathom.sources.config import load_options, merged
from fathom.sources.files import phantom_sets, read_project
from fathom.streaming.watch import watch

KT = '''package a
import a.Engine
// class Ghost
fun main() { val e = Engine(); e.start(1) }
class Orphan { fun call(x: Int) { ZombieLeaf() } }
class ZombieLeaf
object Lonely { const val K = "class Fake" }
'''
ENGINE = """package a
class Engine {
    fun start(n: Int) { helper(n) }
    private fun helper(k: Int) = println(k)
    fun unusedOne() {}
}
"""
JAVA = """package b;
public class Tool extends Base {
    private int count = 0;
    public int next(int step) { count = count + step; return count; }
}
"""


def test_parse_kinds_parents_and_blanks():
    p = parse(KT, False)
    assert [(x["name"], x["kind"]) for x in p.decls if x["kind"] != "Parameter"] == [("main", "Function"), ("Orphan", "Class"), ("call", "Method"), ("ZombieLeaf", "Class"), ("Lonely", "Object"), ("K", "Property")]
    assert p.decls[2]["name"] == "x" or p.decls[2]["parent"] == 1
    assert p.imports == ["a.Engine"]
    assert ("Engine", None, "Instantiation") in {r[1:] for r in p.refs} and "Fake" not in {r[1] for r in p.refs}
    j = parse(JAVA, True)
    assert {(x["name"], x["kind"]) for x in j.decls} == {("Tool", "Class"), ("count", "Field"), ("next", "Method"), ("step", "Parameter")}
    assert ("count", None, "Write") in {r[1:] for r in j.refs} and ("Base", None, "Inheritance") in {r[1:] for r in j.refs}
    e = parse("", False)
    assert (e.decls, e.refs, e.imports) == ([], [], [])


def test_parse_heads_cases_and_constructors():
    text = """@Suppress("unused") sealed class Shape(val n: Int, private var m: Map<String, Int>, k: Foo = bar(1, 2)) : Base<X>(n), Face {
    companion object { const val K = 1 }
    constructor(a: Int) : this(a, x(), 2) { go() }
    fun go(y: Int): Api { this.m = y; return a.b.Engine(y) }
    enum class Mode { ONE, TWO(2), THREE; fun f() {} }
}"""
    p = parse(text, False)
    got = {(d["name"], d["kind"]): d for d in p.decls}
    assert got["Shape", "Class"]["supers"] == "Base<X>(n) Face" and got["Shape", "Class"]["anns"] == 'Suppress("unused")' and got["Shape", "Class"]["mods"] == "sealed"
    assert got["m", "Property"]["visibility"] == "Private" and got["m", "Property"]["mods"] == "var" and got["k", "Parameter"]["type"] == "Foo"
    assert {d["name"] for d in p.decls if d["kind"] == "EnumCase"} == {"ONE", "TWO", "THREE"} and ("constructor", "Constructor") in got
    assert got["K", "Property"]["mods"] == "const val" and got["Companion", "Object"]["mods"] == "companion" and got["go", "Method"]["type"] == "Api"
    refs = {r[1:] for r in p.refs}
    assert ("Engine", "a.b.Engine", "Instantiation") in refs and ("m", "this.m", "Write") in refs and ("Base", None, "Inheritance") in refs and ("Foo", None, "Type") in refs
    made = parse("class T { public T(int a) { } void f() { new T(1); } }", True)
    assert [d["kind"] for d in made.decls if d["name"] == "T"] == ["Class", "Constructor"]


def project(tmp_path, files):
    for name, text in files.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(tmp_path)


def found(spark, at, **options):
    return {(r["code"], r["name"]): r for r in scan(spark, at, Options(**options)).collect()}


def test_scan_reports_the_dead_and_only_them(spark, tmp_path):
    at = project(tmp_path, {"src/main/Main.kt": KT, "src/main/Engine.kt": ENGINE, "src/main/Gen.kt": "// Generated by a tool\nclass Gen", "build/x/Old.kt": "class Built", ".hid/H.kt": "class Hidden"})
    got = {k[1] for k in found(spark, at) if k[0] in ("DC001", "DC001m")}
    assert got == {"Orphan", "ZombieLeaf", "Lonely", "unusedOne"}


def test_names_of_two_packages_are_told_apart_by_imports(spark, tmp_path):
    at = project(tmp_path, {
        "src/main/A.kt": "package a\nclass Thing\n", "src/main/B.kt": "package b\nclass Thing\n", "src/main/C.kt": "package c\nclass Thing\n",
        "src/main/Main.kt": "package m\nimport b.Thing\nimport a.Thing as Other\nimport gone.Absent as Thing2\nfun main() { Thing(); val x = Other(); Thing2() }\n",
    })
    p = analyse(spark, at)
    dead = {r["fqn"] for r in p.decls.join(p.live, p.decls.decl_id == p.live.node, "left_anti").collect()}
    assert dead == {"c.Thing", "a.Thing"} or dead == {"c.Thing"}
    edges = {(r["name"], r["ambiguous"]) for r in p.edges.collect()}
    assert ("Thing", False) in edges


def test_parameters_are_meant_only_inside(spark, tmp_path):
    at = project(tmp_path, {"src/main/M.kt": "fun main() { one(1); two(2) }\nfun one(size: Int) { println(size) }\nfun two(size: Int) { println(3) }\n"})
    got = found(spark, at)
    assert [k for k in got if k[0] == "DC003"] == [("DC003", "size")] and got["DC003", "size"]["line"] == 3


def test_java_calls_reach_kotlin_properties(spark, tmp_path):
    at = project(tmp_path, {"src/main/U.kt": "class User { val firstName = 1\n val other = 2 }\n", "src/main/M.java": "public class M { public static void main(String[] a) { new User().getFirstName(); } }"})
    p = analyse(spark, at)
    hit = {r["name"] for r in p.edges.join(p.decls.select(p.decls.decl_id.alias("dst"), p.decls.name.alias("d")), "dst").where("d = 'firstName'").collect()}
    assert hit == {"getFirstName"}


def test_roots_outside_of_the_code(spark, tmp_path):
    at = project(tmp_path, {
        "app/src/main/AndroidManifest.xml": '<manifest package="a"><application><activity android:name=".Home"/><meta-data android:value="a.Meta"/></application></manifest>',
        "app/src/main/res/layout/view.xml": '<a.Custom android:onClick="@{() -> vm.save()}"/>', "app/src/main/res/navigation/n.xml": '<fragment android:name="a.Nav"/>', "app/rules.pro": "-keep class a.Kept { *; }\n",
        "app/src/main/All.kt": "package a\nclass Home\nclass Meta\nclass Custom\nclass Nav\nclass Kept\nclass Gone\nclass Made\nval x = Made_Factory()\nclass V { fun save() {} }\nclass Asked\nclass HeldDao\n",
    })
    p = analyse(spark, at, Options(entry_points=("a.Asked",), retain=("*Dao",)))
    reason = {r["name"]: r["reason"] for r in p.decls.join(p.roots, "decl_id").collect()}
    assert reason == {"Home": "named", "Meta": "named", "Custom": "named", "Nav": "named", "save": "named", "Kept": "keep rule", "Made": "generated", "Asked": "configured", "HeldDao": "retained"}
    assert {"Home", "Meta", "Custom", "Nav", "save", "Kept", "Made", "Asked", "HeldDao"} <= set(reason) and "Gone" not in reason


def test_steps_of_a_scan(spark, tmp_path):
    at = project(tmp_path, {
        "src/main/M.kt": 'fun main() { println("Named") }\n', "src/main/A.kt": "class Named\n// fathom:ignore(kept for a test)\nclass Ignored\n// fathom:ignore\nclass Refused\nclass Tested\nenum class E { A, B }\nfun all() = E.values()\n",
        "src/main/B.kt": '@file:Suppress("unused")\npackage b\nclass Muted\n', "src/test/ATest.kt": "fun t() { Tested() }\n", "src/main/D.kt": "fun gone() {\n  if (false) { x() }\n}\n",
    })
    got = found(spark, at)
    one = lambda n: next(r for (c, k), r in got.items() if k == n and c.startswith("DC001"))
    assert one("Named")["risk"] == "High" and one("Named")["confidence"] == "Low" and "Ignored" not in {k[1] for k in got}
    assert "a directive without a reason" in one("Refused")["notes"] and "file suppressed" in one("Muted")["notes"] and one("Muted")["confidence"] == "Low"
    assert not [k for k in got if k[0] == "DC005"] and ("DC007", "") in got
    assert {k[0][:2] for k in got} == {"DC"}


def test_watch_fires_on_edits_and_deletions(spark, tmp_path):
    at = tmp_path / "p"
    at.mkdir()
    (at / "M.kt").write_text("fun main() { }\nclass One\n")
    seen = []
    q = watch(spark, str(at), lambda df, k: seen.append({r["name"] for r in df.collect()}), name=tmp_path.name)

    def until(n):
        end = time.time() + 120
        while len(seen) < n and time.time() < end and q.isActive:
            time.sleep(0.2)
        assert len(seen) >= n, q.exception()
        return seen[n - 1]

    try:
        assert "One" in until(1)
        (at / "M.kt").write_text("fun main() { One() }\nclass One\nclass Two\n")
        assert until(2) == {"Two"}
        (at / "M.kt").unlink()
        assert until(3) == set()
    finally:
        q.stop()


def test_phantom_source_sets(spark, tmp_path):
    at = project(tmp_path, {"build.gradle": "sourceSets { extra { } }\nflavors { create('paid') }\n", "src/main/A.kt": "class A", "src/paid/B.kt": "class B", "src/ghost/C.kt": "class C", "src/testDebug/D.kt": "class D"})
    files = read_project(spark, at)
    assert [r["file"].rsplit("/", 1)[1] for r in phantom_sets(files, files.where("ext = 'gradle'")).collect()] == ["C.kt"]
    assert read_project(spark, at, exclude=["/paid/"]).count() == 4


def test_side_inputs(spark, tmp_path):
    (tmp_path / "a.info").write_text("SF:x.kt\nDA:1,0\nDA:2,3\nend_of_record\nSF:y.kt\nDA:1,1\nSF:x.kt\nDA:1,5\n")
    assert {tuple(r) for r in R.read_lcov(spark, str(tmp_path / "a.info")).collect()} == {("x.kt", 1, True), ("x.kt", 2, True), ("y.kt", 1, True)}
    (tmp_path / "b.info").write_text("SF:x.kt\nFN:1,p.f\nFNDA:0,p.f\nFNDA:2,p.g,h\nBRDA:4,0,0,-\nBRDA:4,0,1,3\nDA:9,1\nend_of_record\nFNDA:1,p.f\n" + "SF:" + "d/" * 9000 + "z.kt\nDA:1,1\n")
    assert {tuple(r) for r in R.read_lcov_symbols(spark, str(tmp_path / "b.info")).collect()} == {("method", "p.f", True), ("method", "p.g,h", True)}
    assert [tuple(r) for r in R.read_lcov_branches(spark, str(tmp_path / "b.info")).collect()] == [("x.kt", 4, 1, 2)]
    assert {len(r["file"]) for r in R.read_lcov(spark, str(tmp_path / "b.info")).collect()} == {4, 18_004}
    (tmp_path / "s.xml").write_text('<report><package name="p"><class name="p/A$B"><method name="f" desc="()V"><counter type="METHOD" missed="1" covered="0"/></method><method name="g"><counter type="LINE" missed="0" covered="1"/><counter type="METHOD" missed="0" covered="1"/></method><counter type="CLASS" missed="0" covered="1"/></class></package></report>')
    assert {tuple(r) for r in R.read_jacoco_symbols(spark, str(tmp_path / "s.xml")).collect()} == {("class", "p.A.B", True), ("method", "p.A.B.f", False), ("method", "p.A.B.g", True)}
    (tmp_path / "f.xml").write_text("<ID>UnusedPrivateMember:A.kt$A$private fun gone(x: Int)</ID><ID>LongMethod:A.kt$A$fun f()</ID><ID>UnusedImport:B.kt$import x.Y</ID>")
    assert {tuple(r) for r in R.read_foreign_baseline(spark, str(tmp_path / "f.xml")).collect()} == {("UnusedPrivateMember", "A.kt", "gone"), ("UnusedImport", "B.kt", "import")}
    (tmp_path / "c.toml").write_text('codes = ["DC", "AP"]\nlibrary = true\n[limits]\nmethod_lines = 9\n')
    o = load_options(tmp_path / "c.toml")
    assert o.codes == ("DC", "AP") and o.library and o.limits.method_lines == 9 and merged(o, {"m/": Options(exclude=("/x/",))}).exclude == ("m/.*/x/",)
    (tmp_path / "c.json").write_text('{"librar": true}')
    with pytest.raises(ValueError, match="library"):
        load_options(tmp_path / "c.json")
    (tmp_path / "j.xml").write_text('<report><package name="p"><sourcefile name="A.kt"><line nr="3" mi="1" ci="0"/><line nr="4" mi="0" ci="2"/></sourcefile></package></report>')
    assert {tuple(r) for r in R.read_jacoco(spark, str(tmp_path / "j.xml")).collect()} == {("p/A.kt", 3, False), ("p/A.kt", 4, True)}
    (tmp_path / "usage.txt").write_text("a.B:\n    void f()\na.C\n")
    assert {tuple(r) for r in R.read_usage(spark, str(tmp_path / "usage.txt")).collect()} == {("a.B", "void f()", False), ("a.C", None, True)}
    assert R.keep_rules("-keep class a.**.B* { *; }\n-keepclassmembers class x.Y\n-keep class bad<T>") == [r"^a\..*\.B[^.]*$"]
    (tmp_path / "AndroidManifest.xml").write_text('<manifest package="a.b"><application><activity android:name=".Main"/><service x="1" android:name="c.S"/></application></manifest>')
    assert {r["class_name"] for r in R.read_manifests(spark, str(tmp_path)).collect()} == {"a.b.Main", "c.S"}
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "1", "name": "n", "kind": "Class", "file": "f", "line": 1}], "edges": [{"from": "1", "to": "2"}], "roots": ["1"]}))
    n, e, r = R.read_graph(spark, str(tmp_path / "g.json"))
    assert n.count() == 1 and tuple(e.first()) == ("1", "2") and r.first()["node"] == "1"
    (tmp_path / "b.json").write_text(json.dumps({"version": "1", "issues": [{"file": "f", "name": "n", "kind": "class", "line": 3}]}))
    assert R.read_baseline(spark, str(tmp_path / "b.json")).first()["line"] == 3


def test_sinks(spark, tmp_path):
    rows = [("DC001", "Class", "A<b>", "x.kt", 0, "High", ["why"], 2), ("DC003", "Parameter", "p|q", "x.kt", 3, "Low", [], 1), ("AP001", "Object", "O", "y.kt", 1, "Confirmed", None, 1)]
    f = spark.createDataFrame(rows, "code string, kind string, name string, file string, line int, confidence string, notes array<string>, lines int")
    run = json.loads(sinks.sarif(f))["runs"][0]
    assert run["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1 and [r["level"] for r in run["results"]] == ["warning", "note", "error"]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["DC001", "DC003", "AP001"]
    assert sinks.checkstyle(f).count("<file ") == sinks.checkstyle(f).count("</file>") == 2 and "A&lt;b" in sinks.checkstyle(f)
    assert "| DC001 | x.kt:0 | Class A<b> [why] |" in sinks.markdown(f) and r"p\|q" in sinks.markdown(f)
    quality = json.loads(sinks.gitlab(f))
    assert len({q["fingerprint"] for q in quality}) == 3 and [q["severity"] for q in quality] == ["major", "info", "critical"]
    assert [json.loads(x)["severity"] for x in sinks.reviewdog(f).split("\n")] == ["WARNING", "INFO", "ERROR"]
    assert sinks.compact(f).split("\n")[1] == "x.kt:3: DC003 Parameter p|q" and sinks.terminal(f).endswith("3 findings") and sinks.terminal(f.limit(0)) == "nothing found"
    assert "<td>Class A&lt;b&gt; [why]</td>" in sinks.web_page(f)
    assert json.loads(sinks.badge(f))["message"] == "3" and "| AP001 | 1 |" in sinks.summary_text(f)
    files = spark.createDataFrame([("x.kt", "l1\nl2\nl3\nl4"), ("z.kt", "x")], "file string, content string")
    spans = spark.createDataFrame([("x.kt", 2, 2), ("x.kt", 3, 1)], "file string, line int, lines int")
    assert sinks.removal_patch(spans, files) == "--- a/x.kt\n+++ b/x.kt\n@@ -2,2 +1,0 @@\n-l2\n-l3\n"
    sinks.write_json(f, str(tmp_path / "j"))
    sinks.write_csv(f, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 3
    sinks.write_baseline(f, str(tmp_path / "b"))
    assert {r["name"] for r in R.read_baseline(spark, str(tmp_path / "b")).collect()} == {"A<b>", "p|q", "O"}
    d = spark.createDataFrame([(-1, "a", "Class", "f", 1), (2, "b", "Class", "f", 2)], "decl_id bigint, name string, kind string, file string, line bigint")
    e = spark.createDataFrame([(-1, 2), (-1, 2)], "src bigint, dst bigint")
    assert list(sinks.dot(d, e)) == ["digraph code {", '  nm1 [label="a"];', '  n2 [label="b"];', "  nm1 -> n2;", "}"]
    sinks.write_graph(d, e, d.limit(1), str(tmp_path / "graph"))
    assert spark.read.json(str(tmp_path / "graph/edges")).collect() == [Row(**{"from": "-1", "to": "2"})]
