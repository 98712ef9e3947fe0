"""Findings of the driver tables as code: the steps after the rules, and the reports over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators import graph as G
from fathom.plans import islands as I
from fathom.plans import steps as S
from fathom.plans.graph_queries import live
from fathom.plans.memo import memo
from fathom.plans.model import SQL, project
from fathom.plans.registry import query, table
from fathom.plans.rule_queries import LIMITS, facts_of
from fathom.plans.rule_sql import HEAD, findings_sql
from fathom.plans.rules import evaluate, rules
from fathom.sources.reports import keep_pattern

W = f"WITH RECURSIVE {SQL}"


def _case(col: str, values: dict) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in values.items()) + " END"


#: Words of string literals besides the types of events, and customers whose files show signs of reflection.
WORDS = ["counter", "EmptyState", "loadUser"]
SEGMENT = "BUILDING"


def literals(spark, sf_dir) -> DataFrame:
    own = spark.createDataFrame([(w,) for w in WORDS], "word string")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("word")).distinct().unionByName(own)


def types_where(spark, sf_dir, condition: str) -> DataFrame:
    """(decl_id) of the types of some customers."""
    return table(spark, sf_dir, "customer").where(condition).select((F.col("c_custkey") * 8 + 1).alias("decl_id"))


def raw(spark, sf_dir) -> DataFrame:
    """All findings of all rules with the columns that steps ask for, once a session."""

    def build() -> DataFrame:
        more = project(spark, sf_dir).decls.select("decl_id", "fqn", "visibility", "anns", "lines", "parent_id")
        return evaluate(facts_of(spark, sf_dir), rules(LIMITS)).join(more, "decl_id")

    return memo(spark, sf_dir, "raw", build)


def found(spark, sf_dir) -> DataFrame:
    """Findings, one for dead code a declaration, with risk and a notch less where their name is in a literal, once a session."""

    def build() -> DataFrame:
        d = project(spark, sf_dir).decls
        marked = d.join(types_where(spark, sf_dir, f"c_mktsegment = '{SEGMENT}'"), "decl_id", "left_semi").select("file")
        return S.risk(S.one_each(raw(spark, sf_dir)), literals(spark, sf_dir), marked)

    return memo(spark, sf_dir, "found", build)


RAW = f"{HEAD}, raw AS (SELECT r.*, e.fqn, e.visibility, e.anns, e.lines, e.parent_id FROM ({findings_sql()}) r JOIN decls e USING (decl_id))"
FOUND = f"""{RAW}, once AS (SELECT * FROM raw QUALIFY code NOT IN ('DC001', 'DC001m', 'DC001p') OR row_number() OVER (PARTITION BY decl_id, code IN ('DC001', 'DC001m', 'DC001p') ORDER BY {_case('confidence', S.RANK)} DESC, code) = 1),
words AS (SELECT DISTINCT event_type AS w FROM events UNION SELECT unnest({WORDS!r})),
risky AS (SELECT *, name IN (SELECT w FROM words) AS soft, CASE WHEN name IN (SELECT w FROM words) OR len(list_filter({S.KEPT_BY_NAME!r}, lambda a: contains(anns, a))) > 0 THEN 'High'
  WHEN file IN (SELECT file FROM decls x JOIN customer ON x.decl_id = c_custkey * 8 + 1 WHERE c_mktsegment = '{SEGMENT}') THEN 'Medium' ELSE 'Low' END AS risk FROM once),
finds AS (SELECT * REPLACE (CASE WHEN soft THEN {_case('confidence', S.DOWN)} ELSE confidence END AS confidence) FROM risky)"""


def report_order(findings: DataFrame) -> DataFrame:
    """The total order of a report."""
    return findings.orderBy("file", "line", "code", "name", "decl_id")


@query("risk_annotate", f"{FOUND} SELECT code, decl_id, confidence, risk FROM finds")
def risk_annotate(spark, sf_dir):
    return found(spark, sf_dir).select("code", "decl_id", "confidence", "risk")


@query("one_each", f"{FOUND} SELECT code, decl_id FROM once")
def one_each(spark, sf_dir):
    """One of the dead-code findings that the analyses and the patterns give a declaration."""
    return S.one_each(raw(spark, sf_dir)).select("code", "decl_id")


@query("min_confidence", f"{FOUND} SELECT code, decl_id FROM finds WHERE {_case('confidence', S.RANK)} >= 1")
def min_confidence(spark, sf_dir):
    return found(spark, sf_dir).where(S.mapped("confidence", S.RANK) >= 1).select("code", "decl_id")


@query("toggles", f"{FOUND} SELECT code, decl_id FROM finds WHERE code NOT IN ('DC003', 'DC009') AND NOT starts_with(code, 'V')")
def toggles(spark, sf_dir):
    """Findings with two rules and the views switched off."""
    return found(spark, sf_dir).where(~F.col("code").isin("DC003", "DC009") & ~F.col("code").startswith("V")).select("code", "decl_id")


@query("report_order", f"{FOUND} SELECT file, line, code, name, decl_id FROM finds")
def ordered(spark, sf_dir):
    return report_order(found(spark, sf_dir)).select("file", "line", "code", "name", "decl_id")


# --- the shrinker's and coverage's word (shrunk: rich customers' types, dear orders; coverage: by customer, priority and status) ---

SHRUNK = """shrunk AS (SELECT fqn AS class_name, CAST(NULL AS VARCHAR) AS member FROM decls JOIN customer ON decl_id = c_custkey * 8 + 1 WHERE c_acctbal > 9000
  UNION ALL SELECT t.module || '.T' || t.decl_id, m.name FROM decls m JOIN decls t ON t.decl_id = m.parent_id JOIN orders ON m.decl_id = o_orderkey * 8 + 2 WHERE o_totalprice > 450000)"""
COVER = """sym AS (SELECT 'class' AS kind, fqn, c_acctbal > 0 AS covered FROM decls JOIN customer ON decl_id = c_custkey * 8 + 1 WHERE c_custkey % 3 = 1 UNION ALL SELECT 'class', 'lib.OldParserV2', TRUE UNION ALL SELECT 'class', 'lib.Mode', FALSE
  UNION ALL SELECT 'method', fqn, o_orderstatus = 'F' FROM decls JOIN orders ON decl_id = o_orderkey * 8 + 2 WHERE o_orderpriority LIKE '1%' AND kind IN ('Method', 'Function')),
cov AS (SELECT file, line, bool_or(o_orderstatus <> 'P') AS covered FROM decls JOIN orders ON decl_id = o_orderkey * 8 + 2 WHERE o_orderpriority LIKE '2%' GROUP BY file, line)"""


def shrunk(spark, sf_dir) -> DataFrame:
    d = project(spark, sf_dir).decls
    whole = d.join(types_where(spark, sf_dir, "c_acctbal > 9000"), "decl_id").select(F.col("fqn").alias("class_name"), F.lit(None).cast("string").alias("member"))
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select((F.col("o_orderkey") * 8 + 2).alias("decl_id"))
    parts = d.join(dear, "decl_id").select(F.concat("module", F.lit(".T"), "parent_id").alias("class_name"), F.col("name").alias("member"))
    return whole.unionByName(parts)


def symbols(spark, sf_dir) -> DataFrame:
    d = project(spark, sf_dir).decls
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 = 1").select((F.col("c_custkey") * 8 + 1).alias("decl_id"), (F.col("c_acctbal") > 0).alias("covered"))
    o = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select((F.col("o_orderkey") * 8 + 2).alias("decl_id"), (F.col("o_orderstatus") == "F").alias("covered"))
    extra = spark.createDataFrame([("class", "lib.OldParserV2", True), ("class", "lib.Mode", False)], "kind string, fqn string, covered boolean")
    classes = d.join(c, "decl_id").select(F.lit("class").alias("kind"), "fqn", "covered")
    methods = d.where("kind in ('Method', 'Function')").join(o, "decl_id").select(F.lit("method").alias("kind"), "fqn", "covered")
    return classes.unionByName(methods).unionByName(extra)


def covered_lines(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderpriority like '2%'").select((F.col("o_orderkey") * 8 + 2).alias("decl_id"), (F.col("o_orderstatus") != "P").alias("covered"))
    return project(spark, sf_dir).decls.join(o, "decl_id").select("file", "line", "covered")


_GONE = "(fqn IN (SELECT class_name FROM shrunk WHERE member IS NULL) OR EXISTS (SELECT 1 FROM shrunk WHERE member = name AND (class_name = fqn OR class_name = left(fqn, length(fqn) - length(list_last(string_split(fqn, '.'))) - 1))))"
STATUS = """CASE WHEN kind IN ('Class', 'Object', 'Interface') THEN coalesce((SELECT CASE WHEN bool_or(covered) THEN 'executed' ELSE 'never' END FROM sym WHERE sym.kind = 'class' AND sym.fqn = x.fqn HAVING count(*) > 0),
  (SELECT CASE WHEN bool_or(covered) THEN 'executed' ELSE 'never' END FROM ends WHERE ends.name = x.name HAVING count(*) > 0))
WHEN kind IN ('Function', 'Method') THEN coalesce((SELECT CASE WHEN bool_or(covered) THEN 'executed' ELSE 'never' END FROM sym WHERE sym.kind = 'method' AND sym.fqn = x.fqn HAVING count(*) > 0),
  (SELECT CASE WHEN bool_or(covered) THEN 'executed' ELSE 'never' END FROM sym WHERE sym.kind = 'method' AND split_part(sym.fqn, '.', -1) = x.name HAVING count(*) > 0))
WHEN kind IN ('Property', 'Field') THEN (SELECT CASE WHEN covered THEN 'executed' ELSE 'never' END FROM cov WHERE cov.file = x.file AND cov.line = x.line) END"""
ENDS = "ends AS (SELECT n.name, covered FROM (SELECT DISTINCT name FROM decls WHERE kind IN ('Class', 'Object', 'Interface')) n JOIN sym ON sym.kind = 'class' AND suffix(sym.fqn, n.name))"


@query("hybrid", f"""{RAW}, {SHRUNK}, {COVER}, {ENDS}, s AS (SELECT *, {_GONE} AS gone, {STATUS} AS status FROM raw x)
SELECT code, decl_id, CASE WHEN gone THEN 'Confirmed' WHEN status = 'never' THEN 'Confirmed' WHEN status = 'executed' THEN 'Low' WHEN kind = 'Parameter' OR kind IN ('Function', 'Method') AND visibility = 'Private' THEN 'High' ELSE 'Medium' END AS confidence,
  NOT gone AND coalesce(status = 'never', FALSE) AS runtime_confirmed FROM s""")
def hybrid(spark, sf_dir):
    """Findings by what the shrinker removed and what runs executed."""
    return S.hybrid(raw(spark, sf_dir), shrunk(spark, sf_dir), symbols(spark, sf_dir), covered_lines(spark, sf_dir)).select("code", "decl_id", "confidence", "runtime_confirmed")


@query("runtime_dead", f"{HEAD}, {COVER}, {ENDS}, s AS (SELECT decl_id, {STATUS} AS status FROM decls x WHERE kind IN ('Class', 'Object', 'Function', 'Method') AND decl_id IN (SELECT node FROM alive)) SELECT decl_id FROM s WHERE status = 'never'")
def runtime_dead(spark, sf_dir):
    """Live types and functions that never ran."""
    alive = project(spark, sf_dir).decls.join(live(spark, sf_dir).select(F.col("node").alias("decl_id")), "decl_id", "left_semi")
    return S.runtime_dead(alive, symbols(spark, sf_dir))


@query("coverage_only", f"""{RAW}, {SHRUNK} SELECT code, decl_id, CASE WHEN {_GONE} THEN 'Confirmed' WHEN kind = 'Parameter' OR kind IN ('Function', 'Method') AND visibility = 'Private' THEN 'High' ELSE 'Medium' END AS confidence FROM raw x""")
def coverage_only(spark, sf_dir):
    """Findings by the shrinker alone: a mere name gives way to the estimate."""
    return S.hybrid(raw(spark, sf_dir), shrunk(spark, sf_dir)).select("code", "decl_id", "confidence")


# --- directives, tests, suppressions, baselines ---

NOTED = """directives AS (SELECT file, line, 'kept' AS reason FROM decls WHERE decl_id % 13 = 0 UNION SELECT file, line - 1, '' FROM decls WHERE decl_id % 17 = 0 UNION SELECT file, line - 1, 'why' FROM decls WHERE decl_id % 19 = 0),
own AS (SELECT file, line, max(reason) AS reason FROM directives GROUP BY file, line)"""


def directives(spark, sf_dir) -> DataFrame:
    """(file, line, text) with directives, the one with the greatest reason of a line."""
    d = project(spark, sf_dir).decls.select("decl_id", "file", "line")
    a = d.where("decl_id % 13 = 0").select("file", "line", F.lit("kept").alias("r"))
    b = d.where("decl_id % 17 = 0").select("file", F.expr("line - 1 as line"), F.lit("").alias("r"))
    c = d.where("decl_id % 19 = 0").select("file", F.expr("line - 1 as line"), F.lit("why").alias("r"))
    best = a.unionByName(b).unionByName(c).groupBy("file", "line").agg(F.max("r").alias("r"))
    return best.select("file", "line", F.when(F.col("r") == "", "x() // fathom:ignore").otherwise(F.concat(F.lit("// fathom:ignore( "), "r", F.lit(")"))).alias("text"))


@query("inline_ignore", f"""{RAW}, {NOTED}, j AS (SELECT raw.*, coalesce(a.reason, b.reason) AS reason FROM raw LEFT JOIN own a ON a.file = raw.file AND a.line = raw.line LEFT JOIN own b ON b.file = raw.file AND b.line = raw.line - 1)
SELECT code, decl_id, coalesce(reason = '', FALSE) AS refused FROM j WHERE reason IS NULL OR reason = ''""")
def inline_ignore(spark, sf_dir):
    """Findings that directives leave, and which directives lack a reason."""
    return S.inline_ignore(raw(spark, sf_dir), directives(spark, sf_dir)).select("code", "decl_id", (F.size("notes") > 0).alias("refused"))


@query("test_mention", f"{RAW} SELECT code, decl_id, source_set <> 'test' AND name IN (SELECT name FROM decls WHERE source_set = 'test' AND kind = 'Method' AND decl_id % 5 = 0) AS said FROM raw")
def test_mention(spark, sf_dir):
    """Findings whose name tests still have."""
    words = project(spark, sf_dir).decls.where("source_set = 'test' and kind = 'Method' and decl_id % 5 = 0").select(F.col("name").alias("word"))
    return S.test_mention(raw(spark, sf_dir), words).select("code", "decl_id", (F.size("notes") > 0).alias("said"))


_MARKED = {"m1": ["unused", "X"], "m2": ["dc003"], "m3": ["RedundantOverride"], "m4": ["UNUSED_VARIABLE", "unused_parameter"]}


@query("file_suppression", f"""{RAW}, marks AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {[x.lower() for x in v]!r})" for k, v in _MARKED.items())}) v(m, names)),
hit AS (SELECT raw.*, file LIKE '%.kt' AND coalesce(list_contains(names, lower(code)) OR list_contains(names, 'unused') AND code IN ('DC001', 'DC001m', 'DC001p', 'DC002a', 'DC002b', 'DC003', 'DC005', 'DC008')
  OR list_contains(names, 'unused_variable') AND code LIKE 'DC002%' OR list_contains(names, 'unused_parameter') AND code = 'DC003' OR list_contains(names, 'redundantoverride') AND code = 'DC009', FALSE) AS hit FROM raw LEFT JOIN marks ON marks.m = raw.module)
SELECT code, decl_id, CASE WHEN hit THEN {_case('confidence', S.DOWN)} ELSE confidence END AS confidence, hit AS suppressed FROM hit""")
def file_suppression(spark, sf_dir):
    """Findings with those of suppressed files a notch lower."""
    marks = spark.createDataFrame(list(_MARKED.items()), "module string, names array<string>")
    headers = project(spark, sf_dir).decls.select("file", "module").distinct().join(F.broadcast(marks), "module").select("file", "names")
    return S.file_suppression(raw(spark, sf_dir), headers).select("code", "decl_id", "confidence", (F.size("notes") > 0).alias("suppressed"))


BASE = """base AS (SELECT file, name, kind, line + decl_id % 25 AS line, CASE WHEN decl_id % 3 = 0 THEN fqn END AS fqn FROM decls WHERE decl_id % 7 = 0)"""


def baseline(spark, sf_dir) -> DataFrame:
    """A baseline of a seventh of the declarations, their lines moved."""
    return project(spark, sf_dir).decls.where("decl_id % 7 = 0").select("file", "name", "kind", F.expr("line + decl_id % 25 as line"), F.when(F.expr("decl_id % 3 = 0"), F.col("fqn")).alias("fqn"))


_SAME = "b.file = r.file AND b.name = r.name AND b.kind = r.kind AND CASE WHEN b.fqn IS NOT NULL AND r.fqn IS NOT NULL THEN b.fqn = r.fqn ELSE abs(b.line - r.line) <= 10 END"


@query("baseline_new", f"{RAW}, {BASE} SELECT code, decl_id FROM raw r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE {_SAME})")
def baseline_new(spark, sf_dir):
    return S.baseline_new(raw(spark, sf_dir), baseline(spark, sf_dir)).select("code", "decl_id")


@query("baseline_prune", f"{RAW}, {BASE} SELECT * FROM base b WHERE EXISTS (SELECT 1 FROM raw r WHERE {_SAME})")
def baseline_prune(spark, sf_dir):
    return S.baseline_prune(baseline(spark, sf_dir), raw(spark, sf_dir))


@query("diff_base", f"{RAW} SELECT code, decl_id FROM raw r WHERE NOT EXISTS (SELECT 1 FROM raw o WHERE o.file = r.file AND o.name = r.name AND o.code = r.code AND o.decl_id % 4 <> 0)")
def diff_base(spark, sf_dir):
    """Findings that another run (over three quarters of the declarations) doesn't have by file, name and code."""
    r = raw(spark, sf_dir)
    return r.join(r.where("decl_id % 4 <> 0").select("file", "name", "code"), ["file", "name", "code"], "left_anti").select("code", "decl_id")


@query("necromancy", f"{W}, {BASE} SELECT DISTINCT b.name, s.name AS \"by\", s.file, s.line FROM base b JOIN decls d ON d.name = b.name AND (d.fqn IS NULL OR b.fqn IS NULL OR d.fqn = b.fqn) JOIN edges e ON e.dst = d.decl_id JOIN decls s ON s.decl_id = e.src")
def necromancy(spark, sf_dir):
    """References to what the baseline has as dead."""
    c = project(spark, sf_dir)
    return S.raised(baseline(spark, sf_dir), c.decls, c.edges)


# --- reports ---


@query("score", f"{FOUND} SELECT code, decl_id, round(lines * {_case('confidence', S.SCORE)} / {_case('risk', S.DIVISOR)}, 6)::DOUBLE AS score FROM finds")
def score(spark, sf_dir):
    s = F.col("lines") * S.mapped("confidence", S.SCORE) / S.mapped("risk", S.DIVISOR)
    return found(spark, sf_dir).select("code", "decl_id", F.round(s.cast("double"), 6).alias("score")).orderBy(F.col("score").desc(), "code", "decl_id")


@query("top_files", f"""{FOUND}, o AS (SELECT DISTINCT file, decl_id, parent_id, lines FROM finds WHERE starts_with(code, 'DC')), t AS (SELECT file, CAST(sum(lines) AS BIGINT) AS lines, count(*) AS n FROM o WHERE parent_id IS NULL OR parent_id NOT IN (SELECT decl_id FROM o) GROUP BY file)
SELECT * FROM t ORDER BY lines DESC, file LIMIT 20""")
def top_files(spark, sf_dir):
    """The 20 files with the most dead lines; of nested declarations the outermost counts."""
    o = found(spark, sf_dir).where("startswith(code, 'DC')").select("file", "decl_id", "parent_id", "lines").distinct()
    top = o.join(o.select(F.col("decl_id").alias("parent_id")), "parent_id", "left_anti")
    return top.groupBy("file").agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("n")).orderBy(F.col("lines").desc(), "file").limit(20)


@query("by_module", f"{FOUND}, t AS (SELECT module, code, count(*) AS n FROM finds GROUP BY module, code) SELECT module, CAST(sum(n) AS BIGINT) AS n, first(code ORDER BY n DESC, code) AS top_rule FROM t GROUP BY module")
def by_module(spark, sf_dir):
    t = found(spark, sf_dir).groupBy("module", "code").agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy("module").agg(F.min(F.struct((-F.col("n")).alias("m"), "code")).alias("b"), F.sum("n").alias("total")).select("module", F.col("total").alias("n"), F.col("b.code").alias("top_rule"))


@query("health", f"""{FOUND}, gone AS (SELECT module, count(DISTINCT decl_id) AS dead FROM finds WHERE starts_with(code, 'DC') AND code NOT IN ('DC003', 'DC006', 'DC009') GROUP BY module), t AS (SELECT module, count(*) AS total FROM decls GROUP BY module)
SELECT module, coalesce(dead, 0) AS dead, total, CASE WHEN 100.0 * coalesce(dead, 0) / total <= 1 THEN 'A' WHEN 100.0 * coalesce(dead, 0) / total <= 3 THEN 'B' WHEN 100.0 * coalesce(dead, 0) / total <= 8 THEN 'C' WHEN 100.0 * coalesce(dead, 0) / total <= 15 THEN 'D' ELSE 'F' END AS grade FROM t LEFT JOIN gone USING (module)""")
def health(spark, sf_dir):
    """Share of dead declarations of each module, findings that merely inform aside, and its grade."""
    dead = found(spark, sf_dir).where(F.col("code").startswith("DC") & (S.severity() != "Info")).groupBy("module").agg(F.count_distinct("decl_id").alias("dead"))
    t = project(spark, sf_dir).decls.groupBy("module").agg(F.count(F.lit(1)).alias("total")).join(dead, "module", "left").na.fill(0)
    share = F.col("dead") * 100.0 / F.col("total")
    return t.select("module", "dead", "total", F.when(share <= 1, "A").when(share <= 3, "B").when(share <= 8, "C").when(share <= 15, "D").otherwise("F").alias("grade"))


_CATEGORY = "CASE WHEN starts_with(code, 'DC') THEN 'Dead Code' WHEN starts_with(code, 'V') THEN 'View' WHEN code <= 'AP006' THEN 'Architecture' WHEN code <= 'AP010' OR code BETWEEN 'AP021' AND 'AP025' THEN 'Kotlin' WHEN code <= 'AP015' THEN 'Performance' WHEN code <= 'AP030' THEN 'Android' ELSE 'Compose' END"
_SEVERITY = f"CASE WHEN code IN {tuple(S.INFO)!r} THEN 'Info' ELSE 'Warning' END"


@query("summary", f"""{FOUND}, x AS (SELECT code, confidence, {_CATEGORY} AS category, {_SEVERITY} AS severity, file FROM finds)
SELECT code, category, severity, confidence, count(*) AS n, count(DISTINCT file) AS n_files FROM x GROUP BY GROUPING SETS ((code), (category), (severity), (confidence), ())""")
def summary(spark, sf_dir):
    """Counts by rule, category, severity, confidence and in all: files are told apart before the sets are made."""
    dims = ["code", "category", "severity", "confidence"]
    per = found(spark, sf_dir).select("code", "confidence", "file", S.category().alias("category"), S.severity().alias("severity")).groupBy(*dims, "file").agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for d in [*dims, None]:
        keys = [d] if d else []
        files = per.groupBy(*keys, "file").agg(F.sum("n").alias("n"))
        g = files.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_files"))
        parts.append(g.select(*[F.col(x) if x == d else F.lit(None).cast("string").alias(x) for x in dims], "n", "n_files"))
    return reduce(DataFrame.unionByName, parts)


@query("top_rules", f"{FOUND} SELECT code, count(*) AS n FROM finds GROUP BY code ORDER BY n DESC, code LIMIT 10")
def top_rules(spark, sf_dir):
    """The ten rules with the most findings."""
    return found(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "code").limit(10)


@query("first_finding", f"{FOUND} SELECT decl_id, code FROM finds WHERE starts_with(code, 'DC') QUALIFY row_number() OVER (PARTITION BY decl_id ORDER BY {_case('confidence', S.RANK)} DESC, code) = 1")
def first_finding(spark, sf_dir):
    """One dead-code finding a declaration: the most confident, then the least code."""
    w = Window.partitionBy("decl_id").orderBy(S.mapped("confidence", S.RANK).desc(), "code")
    return found(spark, sf_dir).where("startswith(code, 'DC')").withColumn("i", F.row_number().over(w)).where("i = 1").select("decl_id", "code")


# --- clusters and islands ---


def components_sql(nodes: str, links: str, name: str = "cc") -> str:
    """Common table expressions for the components over ``links`` (a, b) of ``nodes`` (node)."""
    return f"""{name}_s AS (SELECT a, b FROM {links} WHERE a <> b UNION SELECT b, a FROM {links} WHERE a <> b),
{name}(node, component) USING KEY (node) AS (SELECT node, node FROM {nodes} UNION
  (SELECT s.b, min(u.component) FROM {name} u JOIN {name}_s s ON s.a = u.node JOIN recurring.{name} t ON t.node = s.b WHERE u.component < t.component GROUP BY s.b))"""


DEAD = f"""{HEAD}, dead0 AS (SELECT decl_id AS node FROM decls WHERE decl_id NOT IN (SELECT node FROM alive) AND kind <> 'Parameter'),
dead AS (SELECT node FROM dead0 UNION SELECT decl_id FROM decls JOIN dead ON parent_id = node),
ties AS (SELECT src AS a, dst AS b FROM edges WHERE src IN (SELECT node FROM dead) AND dst IN (SELECT node FROM dead) UNION SELECT parent_id, decl_id FROM decls WHERE parent_id IN (SELECT node FROM dead) AND decl_id IN (SELECT node FROM dead)),
{components_sql("dead", "ties")}"""


def clusters_of(spark, sf_dir) -> DataFrame:
    """(node, component) of the unreachable, once a session."""
    c = project(spark, sf_dir)
    dead = c.decls.where("kind <> 'Parameter'").select(F.col("decl_id").alias("node")).join(live(spark, sf_dir), "node", "left_anti")
    return memo(spark, sf_dir, "clusters", lambda: I.dead_clusters(dead, c.decls, c.edges))


@query("clusters", f"{DEAD} SELECT node, component FROM cc")
def clusters(spark, sf_dir):
    """Dead declarations and their members by what refers to or encloses what."""
    return clusters_of(spark, sf_dir)


TOP = "top AS (SELECT x.node, x.component, p.component IS DISTINCT FROM x.component AS top FROM cc x JOIN decls d ON d.decl_id = x.node LEFT JOIN cc p ON p.node = d.parent_id)"


@query("cluster_sizes", f"{DEAD}, {TOP} SELECT component, count_if(top) AS members, count(*) AS declarations, CAST(sum(bytes) FILTER (WHERE top) AS BIGINT) AS bytes FROM top JOIN decls ON decl_id = node GROUP BY component")
def cluster_sizes(spark, sf_dir):
    """Clusters with their outermost members, declarations and bytes, largest first."""
    d = project(spark, sf_dir).decls
    top = I.outermost(clusters_of(spark, sf_dir), d).join(d.select(F.col("decl_id").alias("node"), "bytes"), "node")
    g = top.groupBy("component").agg(F.count_if("top").alias("members"), F.count(F.lit(1)).alias("declarations"), F.sum(F.when(F.col("top"), F.col("bytes"))).alias("bytes"))
    return g.orderBy(F.col("declarations").desc(), "component")


@query("quick_wins", f"""{FOUND}, dead0 AS (SELECT decl_id AS node FROM decls WHERE decl_id NOT IN (SELECT node FROM alive) AND kind <> 'Parameter'),
dead AS (SELECT node FROM dead0 UNION SELECT decl_id FROM decls JOIN dead ON parent_id = node),
ties AS (SELECT src AS a, dst AS b FROM edges WHERE src IN (SELECT node FROM dead) AND dst IN (SELECT node FROM dead) UNION SELECT parent_id, decl_id FROM decls WHERE parent_id IN (SELECT node FROM dead) AND decl_id IN (SELECT node FROM dead)),
{components_sql("dead", "ties")}, {TOP}, bad AS (SELECT DISTINCT node FROM cc JOIN finds ON decl_id = node AND starts_with(code, 'DC') AND risk <> 'Low')
SELECT component, count(*) AS declarations, CAST(sum(lines) FILTER (WHERE top) AS BIGINT) AS lines FROM top JOIN decls ON decl_id = node GROUP BY component HAVING count_if(node IN (SELECT node FROM bad)) = 0""")
def quick_wins(spark, sf_dir):
    """Clusters in which no member carries a risk above Low, most lines first."""
    d = project(spark, sf_dir).decls
    bad = found(spark, sf_dir).where("startswith(code, 'DC') and risk <> 'Low'").select(F.col("decl_id").alias("node")).distinct().withColumn("bad", F.lit(True))
    top = I.outermost(clusters_of(spark, sf_dir), d).join(d.select(F.col("decl_id").alias("node"), "lines"), "node").join(bad, "node", "left")
    g = top.groupBy("component").agg(F.count(F.lit(1)).alias("declarations"), F.sum(F.when(F.col("top"), F.col("lines"))).alias("lines"), F.count_if("bad").alias("n_bad"))
    return g.where("n_bad = 0").drop("n_bad").orderBy(F.col("lines").desc(), "component")


ISLANDS = f"""{W}, ok AS (SELECT d.decl_id AS node FROM decls d LEFT JOIN decls p ON p.decl_id = d.parent_id
  WHERE d.kind NOT IN ('File', 'Package', 'Import', 'EnumCase') AND NOT contains(d.file, '/src/test/') AND NOT list_contains(string_split(d.mods, ' '), 'override') AND NOT (d.language = 'Java' AND d.kind = 'Method' AND coalesce(p.supers, '') <> '')
    AND len(list_filter(string_split(regexp_replace(d.anns, '[(][^)]*[)]', '', 'g'), ' '), lambda a: a <> '' AND len(list_filter({I.BENIGN!r}, lambda b: contains(a, b))) = 0)) = 0),
barred AS (SELECT decl_id, parent_id FROM decls WHERE decl_id NOT IN (SELECT node FROM ok)),
climb AS (SELECT decl_id, parent_id AS up_id FROM barred WHERE parent_id IS NOT NULL UNION SELECT climb.decl_id, d.parent_id FROM climb JOIN decls d ON d.decl_id = climb.up_id WHERE climb.up_id NOT IN (SELECT node FROM ok) AND d.parent_id IS NOT NULL),
near AS (SELECT decl_id, up_id FROM climb WHERE up_id IN (SELECT node FROM ok)),
outside AS (SELECT src, dst FROM edges WHERE src IN (SELECT decl_id FROM barred) AND src NOT IN (SELECT decl_id FROM decls WHERE contains(file, '/src/test/'))),
names AS (SELECT unnest(['Mode', 'LoadingCard']) AS name),
seeds AS (SELECT decl_id AS node FROM roots UNION SELECT dst FROM outside WHERE src NOT IN (SELECT decl_id FROM near) UNION SELECT d.decl_id FROM decls d JOIN decls p ON p.decl_id = d.parent_id AND contains(p.anns, 'Module') UNION SELECT decl_id FROM decls WHERE name IN (SELECT name FROM names)),
ways AS (SELECT src, dst FROM edges UNION SELECT decl_id, parent_id FROM decls WHERE parent_id IS NOT NULL UNION SELECT up_id, dst FROM outside JOIN near ON near.decl_id = src
  UNION SELECT l.decl_id, d.decl_id FROM decls l JOIN decls d ON d.name = 'ParserV2' AND d.decl_id IN (SELECT node FROM ok) WHERE l.name = 'openStream'),
awake AS (SELECT node FROM seeds WHERE node IN (SELECT node FROM ok) UNION SELECT dst FROM ways JOIN awake ON src = node),
dead0 AS (SELECT node FROM ok WHERE node NOT IN (SELECT node FROM awake)), dead AS (SELECT node FROM dead0 UNION SELECT decl_id FROM decls JOIN dead ON parent_id = node),
ties AS (SELECT src AS a, dst AS b FROM edges WHERE src IN (SELECT node FROM dead) AND dst IN (SELECT node FROM dead) UNION SELECT parent_id, decl_id FROM decls WHERE parent_id IN (SELECT node FROM dead) AND decl_id IN (SELECT node FROM dead)),
{components_sql("dead", "ties")}, {TOP}, sizes AS (SELECT component, count_if(top) AS members, count(*) AS declarations FROM top GROUP BY component HAVING count_if(top) BETWEEN 2 AND {I.MOST})"""


def islands_of(spark, sf_dir) -> DataFrame:
    c = project(spark, sf_dir)
    names = spark.createDataFrame([("Mode",), ("LoadingCard",)], "name string")
    said = c.decls.where("name = 'openStream'").select("decl_id", F.lit("ParserV2").alias("word"))
    return I.islands(c.decls, c.edges, c.roots, names, said, [keep_pattern("m1.Parser*.*"), keep_pattern("m2?.Mode.**")])


@query("islands", f"""{ISLANDS} SELECT s.component, s.members, s.declarations, CAST(sum(CASE WHEN top THEN lines + 1 ELSE 0 END) AS BIGINT) AS lines, bool_or(node IN (SELECT dst FROM edges WHERE src IN (SELECT decl_id FROM decls WHERE contains(file, '/src/test/')))) AS test_only,
  bool_or(coalesce(regexp_full_match(fqn, 'm1[.]Parser[^.]*[.][^.]*') OR regexp_full_match(fqn, 'm2[^.][.]Mode[.].*'), FALSE)) AS keep_covered FROM sizes s JOIN top USING (component) JOIN decls ON decl_id = node GROUP BY s.component, s.members, s.declarations""")
def islands(spark, sf_dir):
    """Islands of 2 to 8 members, largest first."""
    return islands_of(spark, sf_dir).orderBy(F.col("members").desc(), F.col("lines").desc(), "component")


@query("twin_directories", f"{W}, dirs AS (SELECT module AS dir, count(*) AS n FROM decls GROUP BY module) SELECT a.dir AS old, b.dir AS new FROM dirs a JOIN dirs b ON b.dir IN (a.dir || 'V2', a.dir || 'V3', a.dir || 'v2', a.dir || '2', a.dir || 'New') WHERE a.n >= 3 AND b.n >= 3")
def twin_directories(spark, sf_dir):
    """Directories of three declarations or more whose name with a version's mark another one has: the first hints of a report."""
    n = project(spark, sf_dir).decls.groupBy(F.col("module").alias("dir")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("dir")
    marked = n.select(F.col("dir").alias("old"), F.explode(F.array(*[F.concat("dir", F.lit(s)) for s in ("V2", "V3", "v2", "2", "New")])).alias("new"))
    return marked.join(n.withColumnRenamed("dir", "new"), "new", "left_semi").select("old", "new")


@query("version_twins", f"""{W}, n AS (SELECT name, count(DISTINCT d.decl_id) AS types, count(e.dst) AS refs FROM decls d LEFT JOIN edges e ON e.dst = d.decl_id WHERE parent_id IS NULL AND d.kind IN ('Class', 'Interface', 'Object', 'Enum') GROUP BY name)
SELECT a.name, b.name AS twin, a.refs, b.refs AS twin_refs FROM n a JOIN n b ON b.name IN (a.name || 'V2', a.name || 'V3', a.name || 'V4', a.name || 'Legacy', a.name || 'Old', a.name || 'New', a.name || 'Deprecated')""")
def version_twins(spark, sf_dir):
    """Top-level types of which another has the name with a version's mark, and how often both are referred to."""
    c = project(spark, sf_dir)
    types = c.decls.where("parent_id is null and kind in ('Class', 'Interface', 'Object', 'Enum')").select("name", F.col("decl_id").alias("dst"))
    n = types.join(c.edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")), "dst", "left").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("refs"))
    marked = n.select("name", "refs", F.explode(F.array(*[F.concat("name", F.lit(s)) for s in ("V2", "V3", "V4", "Legacy", "Old", "New", "Deprecated")])).alias("twin"))
    return marked.join(n.select(F.col("name").alias("twin"), F.col("refs").alias("twin_refs")), "twin").select("name", "twin", "refs", "twin_refs")


@query("dead_accessors", f"""{W}, m AS (SELECT parent_id, name, decl_id, (SELECT count(*) FROM edges WHERE dst = decl_id) AS refs FROM decls WHERE kind = 'Method'),
f AS (SELECT decl_id, parent_id, name, file, upper(name[1]) || name[2:] AS cap FROM decls WHERE kind = 'Field' AND language = 'Java' AND parent_id IS NOT NULL),
g AS (SELECT f.*, (SELECT min(refs) FROM m WHERE m.parent_id = f.parent_id AND m.name = 'get' || cap) AS g1, (SELECT min(refs) FROM m WHERE m.parent_id = f.parent_id AND m.name = 'is' || cap) AS g2, (SELECT max(refs) FROM m WHERE m.parent_id = f.parent_id AND m.name = 'set' || cap) AS s FROM f)
SELECT decl_id, CASE WHEN coalesce(s, 0) > 0 THEN 'WriteOnly' ELSE 'Dead' END AS verdict FROM g WHERE coalesce(g1, g2) = 0 AND NOT EXISTS (SELECT 1 FROM edges e JOIN decls s ON s.decl_id = e.src WHERE e.dst = g.decl_id AND s.file <> g.file)""")
def dead_accessors(spark, sf_dir):
    """Java fields whose getter nobody calls and no other file touches; write-only if the setter is called."""
    c = project(spark, sf_dir)
    return dead_accessors_of(c.decls, c.edges)


def dead_accessors_of(decls: DataFrame, edges: DataFrame) -> DataFrame:
    """(decl_id, verdict) of fields with dead accessors."""
    refs = edges.groupBy(F.col("dst").alias("decl_id")).agg(F.count(F.lit(1)).alias("refs"))
    m = decls.where("kind = 'Method'").join(refs, "decl_id", "left").select("parent_id", "name", F.coalesce("refs", F.lit(0)).alias("refs"))
    f = decls.where("kind = 'Field' and language = 'Java' and parent_id is not null").select("decl_id", "parent_id", "file", F.concat(F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)")).alias("cap"))
    for mark in ("get", "is", "set"):
        n = m.where(F.col("name").startswith(mark)).groupBy("parent_id", F.expr(f"substring(name, {len(mark) + 1})").alias("cap")).agg((F.max if mark == "set" else F.min)("refs").alias(f"n_{mark}"))
        f = f.join(n, ["parent_id", "cap"], "left")
    place = decls.select(F.col("decl_id").alias("src"), F.col("file").alias("s_file"))
    touched = edges.select("src", F.col("dst").alias("decl_id")).join(f.select("decl_id", "file"), "decl_id").join(place, "src").where("file <> s_file").select("decl_id").distinct()
    dead = f.where(F.coalesce("n_get", "n_is") == 0).join(touched, "decl_id", "left_anti")
    return dead.select("decl_id", F.when(F.col("n_set") > 0, "WriteOnly").otherwise("Dead").alias("verdict"))


@query("variant_scope", f"""{W}, r AS (SELECT dst, list_sort(list(DISTINCT s.source_set)) AS sets FROM edges e JOIN decls s ON s.decl_id = e.src GROUP BY dst)
SELECT decl_id, array_to_string(sets, ',') AS sets, len(list_filter(sets, lambda x: x <> 'test')) = 0 AS test_only FROM decls JOIN r ON dst = decl_id WHERE parent_id IS NULL AND source_set = 'main' AND NOT list_contains(sets, 'main')""")
def variant_scope(spark, sf_dir):
    """Top-level declarations of main sources that only other source sets refer to, and whether all of those are tests."""
    c = project(spark, sf_dir)
    by = c.decls.select(F.col("decl_id").alias("src"), "source_set")
    r = c.edges.join(by, "src").groupBy(F.col("dst").alias("decl_id")).agg(F.array_sort(F.collect_set("source_set")).alias("sets"))
    top = c.decls.where("parent_id is null and source_set = 'main'").select("decl_id").join(r, "decl_id").where(~F.array_contains("sets", "main"))
    return top.select("decl_id", F.array_join("sets", ",").alias("sets"), F.forall("sets", lambda s: s == "test").alias("test_only"))


@query("explain", f"""{HEAD} SELECT d.decl_id, (SELECT count(*) FROM edges WHERE dst = d.decl_id) AS refs, d.decl_id IN (SELECT decl_id FROM roots) AS is_root, d.decl_id IN (SELECT node FROM alive) AS is_live FROM decls d WHERE d.kind IN ('Class', 'Object')""")
def explain(spark, sf_dir):
    """Why types count as dead or alive: references to them, whether they are roots, whether the analysis reaches them."""
    return facts_of(spark, sf_dir).where("kind in ('Class', 'Object')").select("decl_id", F.col("n_in").alias("refs"), "is_root", "is_live")


@query("exclusive_dependents", f"""{W}, t AS (SELECT decl_id AS node FROM decls WHERE kind = 'Class' AND module = 'm5' AND source_set = 'debug'), doomed AS (SELECT node FROM t UNION SELECT decl_id FROM decls JOIN doomed ON parent_id = node),
fall AS (SELECT node FROM doomed UNION SELECT dst FROM edges JOIN fall ON src = node WHERE NOT ambiguous),
awake AS (SELECT decl_id AS node FROM roots WHERE decl_id NOT IN (SELECT node FROM doomed) UNION SELECT dst FROM edges JOIN awake ON src = node WHERE dst NOT IN (SELECT node FROM doomed))
SELECT node FROM fall WHERE node NOT IN (SELECT node FROM awake) AND node NOT IN (SELECT node FROM t)""")
def exclusive_dependents(spark, sf_dir):
    """What falls with some types besides themselves."""
    c = project(spark, sf_dir)
    t = c.decls.where("kind = 'Class' and module = 'm5' and source_set = 'debug'").select("decl_id")
    return G.kill_list(t, c.roots, c.decls, c.edges).join(t.withColumnRenamed("decl_id", "node"), "node", "left_anti")
