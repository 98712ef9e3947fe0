"""Text rules over lines of source, resource and build files that are made of all lineitems.

An order is a file, its lineitems are the lines, in the order of line number,
part and supplier; what a line says is chosen by its keys from a vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators import text_rules as T
from fathom.plans.memo import memo
from fathom.plans.model import _q, project
from fathom.plans.model import SQL as CODE_SQL
from fathom.plans.registry import query, table

#: Lines by the kind of file; # stands for a small number, ~ for a larger one.
VOCABULARY = {
    "kt": [
        "package a.b", "import a.b.Name#", "import a.b.Name# as Alias#", "import a.b.*", "import com.lib#.core.Tool", "val u = Name#(1)", "val w = Alias#()", "if (false) { x() }", "// if (false) old()", "while ( false ) y()",
        "this.field# = other#", "this.same# = same#", "fun setField#(field#: Int) {", "fun plain#() {", "var field# = 3", "if ((ready#)) go()", "return (value#)", "if (list#.size == 0) stop()", "while (s.length > 0) cut()",
        'prefs.edit().putString("key~", v)', 'val v = prefs.getString("key~", null)', "editor.putInt(KEY_~, 1)", 'const val KEY_~ = "key~"', 'bundle.putString("key~", v)', 'editor.putLong("google_#", 1)', 'intent.putExtra("extra~", 1)',
        'val e = intent.getStringExtra("extra~")', 'if (intent.hasExtra("extra~")) f()', 'intent.putExtra("android.x#", 1)', 'imageCache.put("img~", bmp)', 'val b = imageCache["img~"]', 'val b = imageCache.get("img~")',
        'val on = config.getBoolean("flag_~")', '@SerializedName("f#") val dto~: String,', "val s = R.string.text_#", "val t = inflate(R.layout.view_~)", "val v = View~Binding.bind(x)", "bus.post(Event~(1))", "bus.post(Runnable())",
        "@Subscribe fun on#(e: Event~) {", "bus.register(Event~::class)", "val feed~: StateFlow<Int> = s", "private val feed~: Flow<Int> = s", "feed~.collect { }", "// TODO remove after launch #", "class Thing~ {",
        'open("pics/photo_#.png")', "val m = LocationManager()", "fun pass#(x: Int) = target#.pass(x)", "if (NEW_HOME) { Home#() } else { OldHome~() }", "val h = OldHome~()", "@Dao interface Store#", "@Insert fun put(x: Row)", "@Query fun all()",
        '@file:Suppress("unused", "DC003")', 'getIdentifier(n, "color", p)', "// fathom:ignore(kept)",
    ],
    "java": [
        "import static a.b.Name#.CALL;", "import a.b.Name#;", "private String s# = null;", "private final String f# = null;", "static int n# = null;", "return (value#);", "if (((x#))) y();", "if (list.length != 0) z();", "new Name#();",
        'prefs.contains("key~");', 'intent.putExtra("extra~", 2);', 'cache.put("img~", b);', "bus.post(new Event~(2));", "@Subscribe public void on(Event~ e) {", "public class Tool~ {", '@SerializedName("g#") private String dto~;', 'String q = "flag_~";',
        "Class.forName(n);", "import okhttp#.Client;", "while(false) {}",
    ],
    "xml": [
        '<string name="text_#">Value #</string>', '<string name="app_name">App</string>', '<color name="text_#">red</color>', "<key>flag_~</key><value>true</value>", "<key>flag_~</key><value>12</value>", "<key> flag_~ </key><value>False</value>",
        '<include layout="@layout/view_~"/>', '<TextView android:text="@string/text_#"/>', '<uses-permission android:name="android.permission.CAMERA"/>', '<uses-permission android:name="android.permission.ACCESS_FINE_LOCATION"/>',
        '<uses-permission android:name="android.permission.UNKNOWN_#"/>', '<img src="photo_#.png"/>', '<string name="_hidden#">x</string>',
    ],
    "gradle": [
        'include(":mod~")', "include ':lib:sub-part#'", 'implementation(project(":mod~"))', "api(projects.lib.subPart#)", 'implementation("com.lib#:core-ktx:1.0")', "implementation 'org.okhttp#:client-core:2'", 'testImplementation("x.y#:only-test#:3")',
        'id("com.android.application")', "// nothing #",
    ],
}
ARGS, MANY = 37, 9973
_N = {k: len(v) for k, v in VOCABULARY.items()}

LINES = f"""WITH vocabulary(ext, i, t) AS (VALUES {", ".join(f"('{e}', {i}, {_q(t)})" for e, ts in VOCABULARY.items() for i, t in enumerate(ts))}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line, CASE l_orderkey % 8 WHEN 4 THEN 'java' WHEN 5 THEN 'java' WHEN 6 THEN 'xml' WHEN 7 THEN 'gradle' ELSE 'kt' END AS ext FROM lineitem),
lines AS (SELECT 'm' || (l_orderkey % 5) || CASE ext WHEN 'gradle' THEN '/build.gradle' WHEN 'xml' THEN '/src/main/res/values' || CASE WHEN l_orderkey // 8 % 2 = 1 THEN '-fr' ELSE '' END || '/v' || l_orderkey || '.xml'
    ELSE '/src/' || CASE WHEN l_orderkey % 3 = 0 THEN 'test' ELSE 'main' END || '/F' || l_orderkey || '.' || ext END AS file, 'm' || (l_orderkey % 5) AS module,
  CASE WHEN ext IN ('kt', 'java') AND l_orderkey % 3 = 0 THEN 'test' ELSE 'main' END AS source_set, ext, line, replace(replace(t, '#', CAST(l_partkey % {ARGS} AS VARCHAR)), '~', CAST(l_orderkey % {MANY} AS VARCHAR)) AS text
  FROM numbered JOIN vocabulary USING (ext) WHERE i = (l_orderkey // 8 + l_linenumber * 5 + l_partkey) % CASE ext {" ".join(f"WHEN '{k}' THEN {n}" for k, n in _N.items())} END),
code AS (SELECT * FROM lines WHERE ext IN ('kt', 'java'))"""
_COMMENT = "(ltrim(text) LIKE '//%' OR ltrim(text) LIKE '*%')"


def lines(spark, sf_dir) -> DataFrame:
    """(file, module, source_set, ext, line, text): keys and line numbers, written once a session; texts are made of them where they are read."""

    def numbered() -> DataFrame:
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).cast("bigint").alias("line"))

    k, kind = F.col("l_orderkey"), F.col("l_orderkey") % 8
    ext = F.when(kind.isin(4, 5), "java").when(kind == 6, "xml").when(kind == 7, "gradle").otherwise("kt")
    n = F.floor(k / 8) + F.col("l_linenumber") * 5 + F.col("l_partkey")
    said = None
    for e, ts in VOCABULARY.items():
        t = F.element_at(F.array(*map(F.lit, ts)), (n % len(ts) + 1).cast("int"))
        said = F.when(F.col("ext") == e, t) if said is None else said.when(F.col("ext") == e, t)
    test = F.col("ext").isin("kt", "java") & (k % 3 == 0)
    folder = F.when(F.floor(k / 8) % 2 == 1, "-fr").otherwise("")
    path = F.when(F.col("ext") == "gradle", "/build.gradle").when(F.col("ext") == "xml", F.concat(F.lit("/src/main/res/values"), folder, F.lit("/v"), k, F.lit(".xml")))
    path = path.otherwise(F.concat(F.lit("/src/"), F.when(test, "test").otherwise("main"), F.lit("/F"), k, F.lit("."), "ext"))
    module = F.concat(F.lit("m"), k % 5)
    text = F.replace(F.replace(said, F.lit("#"), (F.col("l_partkey") % ARGS).cast("string")), F.lit("~"), (k % MANY).cast("string"))
    x = memo(spark, sf_dir, "numbered", numbered).withColumn("ext", ext)
    return x.select(F.concat(module, path).alias("file"), module.alias("module"), F.when(test, "test").otherwise("main").alias("source_set"), "ext", "line", text.alias("text"))


def _plain(name: str, sql: str, rule) -> None:
    @query(name, f"{LINES} {sql}")
    def run(spark, sf_dir):
        return rule(lines(spark, sf_dir))

    run.__doc__ = rule.__doc__


_plain("dc004_unused_imports", r""", im AS (SELECT file, line, rtrim(trim(regexp_replace(substr(trim(text), 8), '^static ', '')), ';') AS path FROM code WHERE ltrim(text) LIKE 'import %'),
nm AS (SELECT *, CASE WHEN path LIKE '%.*' THEN NULL WHEN contains(path, ' as ') THEN split_part(path, ' as ', 2) ELSE split_part(path, '.', -1) END AS name FROM im)
SELECT file, line, name FROM nm WHERE name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM code b WHERE b.file = nm.file AND ltrim(b.text) NOT LIKE 'import %' AND regexp_matches(b.text, '\b' || nm.name || '\b'))""", T.unused_imports)
_plain("dc007_dead_branches", rf"SELECT file, line FROM code WHERE NOT {_COMMENT} AND (regexp_matches(replace(text, ' ', ''), '(^|[^A-Za-z0-9_])if\(false\)') OR regexp_matches(replace(text, ' ', ''), '(^|[^A-Za-z0-9_])while\(false\)'))", T.dead_branches)
_plain("dc012_duplicate_imports", r""", im AS (SELECT file, line, rtrim(trim(regexp_replace(substr(trim(text), 8), '^static ', '')), ';') AS path FROM code WHERE ltrim(text) LIKE 'import %')
SELECT a.file, a.line, a.path, min(b.line) AS first_line FROM im a JOIN im b ON a.file = b.file AND a.path = b.path AND b.line < a.line GROUP BY ALL""", T.duplicate_imports)
_plain("dc013_null_initialisers", "SELECT file, line, list_last(string_split(trim(split_part(text, '=', 1)), ' ')) AS name FROM lines WHERE ext = 'java' AND NOT contains(text, 'final') AND replace(text, ' ', '') LIKE '%=null;' AND (text LIKE 'private %' OR text LIKE 'static %')", T.null_initialisers)
_plain("dc014_redundant_this", r""", a AS (SELECT file, line, regexp_extract(text, 'this\.(\w+)', 1) AS name, regexp_extract(text, '=\s*(\w+)\s*$', 1) AS other FROM lines WHERE ext = 'kt' AND text LIKE 'this.%'),
h AS (SELECT a.*, (SELECT max(f.line) FROM lines f WHERE f.file = a.file AND f.line < a.line AND contains(f.text, 'fun ')) AS head FROM a)
SELECT h.file, h.line, name FROM h JOIN lines f ON f.file = h.file AND f.line = head WHERE name <> other AND NOT regexp_matches(f.text, '\b' || name || '\s*:') AND NOT EXISTS (SELECT 1 FROM lines v WHERE v.file = h.file AND v.line > head AND v.line < h.line AND regexp_matches(v.text, '\bva[lr]\s+' || name || '\b'))""", T.redundant_this)
_plain("dc015_redundant_parens", rf"SELECT file, line FROM code WHERE NOT {_COMMENT} AND (regexp_matches(text, '\b(if|while)\s*\(\([^()]*\)\)') OR regexp_matches(rtrim(text, '; '), '\breturn \(\w+\)$'))", T.redundant_parens)
_plain("dc016_size_against_zero", "SELECT file, line, CASE WHEN contains(text, '==') THEN '==' WHEN contains(text, '!=') THEN '!=' ELSE '>' END AS operator FROM code WHERE regexp_matches(text, '(size|length) (==|!=|>) 0[^0-9]')", T.size_against_zero)
_plain("dc010_unread_preferences", r""", c AS (SELECT name, min(value) AS value FROM (SELECT regexp_extract(text, '([A-Z][A-Z0-9_]*) = "', 1) AS name, regexp_extract(text, '= "([^"]*)"', 1) AS value FROM code WHERE text LIKE 'const val %') GROUP BY name HAVING count(DISTINCT value) = 1),
x AS (SELECT *, coalesce(nullif(regexp_extract(text, '\("([^"]*)"', 1), ''), (SELECT value FROM c WHERE c.name = regexp_extract(text, '\(([A-Z][A-Z0-9_]*)[,)]', 1)), '$' || regexp_extract(text, '\(([A-Z][A-Z0-9_]*)[,)]', 1)) AS key FROM code WHERE NOT contains(lower(text), 'bundle.') AND NOT contains(lower(text), 'intent.'))
SELECT key, file, line FROM x WHERE regexp_matches(text, 'put(String|Int|Long)\(') AND NOT starts_with(key, 'google_') AND key NOT IN (SELECT key FROM x WHERE regexp_matches(text, '(getString|getBoolean|contains)\(') AND key IS NOT NULL)""", T.unread_preferences)
_plain("dc011_write_only_daos", r""", d AS (SELECT file, line, text, (SELECT max(h.line) FROM code h WHERE h.file = code.file AND h.line <= code.line AND h.text LIKE '@Dao%') AS top FROM code)
SELECT d.file, split_part(h.text, ' ', 3) AS dao, CAST(sum(w) AS BIGINT) AS writes FROM (SELECT file, top, (text LIKE '@Insert%')::INT AS w, (text LIKE '@Query%')::INT AS r FROM d WHERE top IS NOT NULL) d JOIN code h ON h.file = d.file AND h.line = top GROUP BY 1, 2 HAVING sum(w) > 0 AND sum(r) = 0""", T.write_only_daos)
_plain("dc019_unread_extras", r""", p AS (SELECT regexp_extract(text, 'putExtra\("([^"]+)"', 1) AS key, file, line FROM code WHERE source_set <> 'test' AND contains(text, 'putExtra(')),
g AS (SELECT regexp_extract(text, '(getStringExtra|hasExtra)\("([^"]+)"', 2) AS key FROM code WHERE source_set <> 'test')
SELECT key, min((file, line))[1] AS file, min((file, line))[2] AS line FROM p WHERE key NOT LIKE 'android.%' AND key NOT IN (SELECT key FROM g) GROUP BY key""", T.unread_extras)
_plain("t2_unread_cache_keys", r""", g AS (SELECT regexp_extract(text, '[Cc]ache(\.get\(|\[)"([^"]+)"', 2) AS key FROM code)
SELECT key, min((file, line))[1] AS file, min((file, line))[2] AS line FROM (SELECT regexp_extract(text, '[Cc]ache\.put\("([^"]+)"', 1) AS key, file, line FROM code WHERE regexp_matches(text, '[Cc]ache\.put\(')) WHERE key NOT IN (SELECT key FROM g) GROUP BY key""", T.unread_cache_keys)
RES = r""", res AS (SELECT regexp_extract(text, '<(string|color) name', 1) AS type, regexp_extract(text, 'name="([^"]+)"', 1) AS name, trim(split_part(split_part(text, '>', 2), '<', 1)) AS value, file, module, line, CASE WHEN contains(file, 'values-fr') THEN 'fr' ELSE '' END AS locale FROM lines WHERE ext = 'xml' AND (text LIKE '<string%' OR text LIKE '<color%'))"""
_plain("dc017_unused_resources", RES + r""" SELECT type, name, file, line, CASE type WHEN 'color' THEN 'Medium' ELSE 'High' END AS confidence, CASE type WHEN 'color' THEN 'High' ELSE 'Low' END AS risk FROM res WHERE locale = '' AND name NOT LIKE '\_%' ESCAPE '\' AND name <> 'app_name'
AND NOT EXISTS (SELECT 1 FROM lines u WHERE (u.text LIKE '%R.string.%' AND split_part(u.text, 'R.string.', 2) = name OR u.text LIKE '%@string/%' AND split_part(split_part(u.text, '@string/', 2), '"', 1) = name) AND type = 'string')""", T.unused_resources)
_plain("dc022_orphan_translations", RES + " SELECT name, file, line FROM res WHERE type = 'string' AND locale = 'fr' AND (module, name) NOT IN (SELECT (module, name) FROM res WHERE type = 'string' AND locale = '')", T.orphan_translations)
_plain("t7_duplicate_strings", RES + " SELECT value, count(DISTINCT module) AS n_modules, count(*) AS n FROM res WHERE type = 'string' AND locale = '' AND value <> '' GROUP BY value HAVING count(DISTINCT module) >= 2", T.duplicate_strings)
CONFIG = r""", cfg AS (SELECT trim(split_part(split_part(text, '<key>', 2), '</key>', 1)) AS key, lower(split_part(split_part(text, '<value>', 2), '</value>', 1)) AS value, file, line FROM lines WHERE ext = 'xml' AND text LIKE '%<key>%')"""
_plain("dc020_dead_config_keys", CONFIG + """ SELECT key, file, line, FALSE AS swept FROM cfg WHERE NOT EXISTS (SELECT 1 FROM code WHERE contains(text, '"' || key || '"'))""", T.dead_config_keys)
_plain("t8_boolean_flags", CONFIG + " SELECT DISTINCT key, value = 'true' AS enabled FROM cfg WHERE value = 'true' OR value = 'false'", T.boolean_flags)
_plain("dc021_dead_dto_fields", r""", f AS (SELECT regexp_extract(text, '(dto\d+)', 1) AS name, file, line FROM code WHERE text LIKE '@SerializedName%'), w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM code)
SELECT name, file, line FROM f WHERE name IN (SELECT name FROM w GROUP BY name HAVING count(*) <= 1)""", T.dead_dto_fields)
_plain("t1_bus_orphans", r""", s AS (SELECT DISTINCT regexp_extract(text, '(Event\d+)', 1) AS event, text LIKE 'bus.post%' AS posted FROM code WHERE text LIKE 'bus.post(%Event%' OR text LIKE '@Subscribe%' OR text LIKE 'bus.register%')
SELECT event, CASE WHEN bool_and(posted) THEN 'posted' ELSE 'subscribed' END AS side FROM s GROUP BY event HAVING count(*) = 1""", T.bus_orphans)
_plain("t9_unobserved_streams", r"SELECT regexp_extract(text, 'val (\w+):', 1) AS name, file, line FROM lines a WHERE ext = 'kt' AND text LIKE 'val feed%' AND NOT EXISTS (SELECT 1 FROM lines b WHERE b.ext = 'kt' AND b.text = regexp_extract(a.text, 'val (\w+):', 1) || '.collect { }')", T.unobserved_streams)
_plain("t4_dead_modules", r""", b AS (SELECT * FROM lines WHERE ext = 'gradle'), i AS (SELECT DISTINCT regexp_extract(text, '(:[\w:-]+)', 1) AS m FROM b WHERE text LIKE 'include%'),
u AS (SELECT regexp_extract(text, '"(:mod\d+)"', 1) AS m FROM b WHERE text LIKE 'implementation(project%' UNION SELECT ':lib:sub-part' || regexp_extract(text, 'subPart(\d+)', 1) FROM b WHERE text LIKE 'api(projects%')
SELECT m AS module FROM i WHERE m NOT IN (SELECT m FROM u)""", T.dead_modules)
_plain("t5_unused_dependencies", r""", d AS (SELECT DISTINCT regexp_extract(text, '["'']([^"'':]+:[^"'':]+)', 1) AS coordinate, file FROM lines WHERE ext = 'gradle' AND regexp_matches(text, '(implementation|testImplementation)(\(| )["'']')),
p AS (SELECT DISTINCT regexp_extract(text, 'import (static )?([\w.]+)', 2) AS p FROM code WHERE text LIKE 'import %'), s AS (SELECT DISTINCT unnest(string_split(p, '.')) AS s FROM p),
t AS (SELECT coordinate, unnest(list_append(list_filter(string_split(split_part(coordinate, ':', 2), '-'), lambda x: x NOT IN ('core', 'ktx', 'test', 'lib', 'api')), split_part(split_part(coordinate, ':', 1), '.', -1))) AS s FROM d)
SELECT DISTINCT coordinate, file FROM d WHERE coordinate NOT IN (SELECT coordinate FROM t WHERE s IN (SELECT s FROM s)) AND NOT EXISTS (SELECT 1 FROM p WHERE p = split_part(coordinate, ':', 1) OR starts_with(p, split_part(coordinate, ':', 1) || '.'))""", T.unused_dependencies)
_plain("t6_unused_permissions", """SELECT CASE WHEN contains(text, 'CAMERA') THEN 'CAMERA' ELSE 'ACCESS_FINE_LOCATION' END AS permission, file, line FROM lines WHERE ext = 'xml' AND text LIKE '<uses-permission%CAMERA%' OR ext = 'xml' AND text LIKE '<uses-permission%ACCESS_FINE_LOCATION%' AND NOT EXISTS (SELECT 1 FROM code WHERE contains(text, 'LocationManager'))""", T.unused_permissions)
_plain("f6_test_words", r"SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM code WHERE contains(file, '/test/')", T.test_words)
_plain("f10_literal_words", r"""SELECT DISTINCT unnest(regexp_extract_all(list_reduce(list_prepend('', regexp_extract_all(text, '"[^"]*"')), lambda a, b: a || ' ' || b), '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM code""", T.literal_words)
_plain("f10_reflection_files", "SELECT DISTINCT file FROM code WHERE contains(text, 'Class.forName') OR contains(text, '@Subscribe')", T.reflection_files)


@query("f7_suppression_headers", f"""{LINES}, b AS (SELECT file, min(line) AS body FROM lines WHERE ext = 'kt' AND (text LIKE 'package%' OR text LIKE 'import%') GROUP BY file)
SELECT DISTINCT file, ['DC003', 'unused'] AS names FROM lines LEFT JOIN b USING (file) WHERE ext = 'kt' AND text LIKE '@file:Suppress%' AND (body IS NULL OR line < body)""")
def suppression_headers(spark, sf_dir):
    """Codes that headers of Kotlin files suppress."""
    return T.suppression_headers(lines(spark, sf_dir)).select("file", F.array_sort("names").alias("names"))


@query("t10_settled_flag", f"""{LINES}, k AS (SELECT DISTINCT unnest(regexp_extract_all(text, 'OldHome[0-9]+')) AS name FROM lines WHERE ext = 'kt' AND text LIKE 'if (NEW_HOME)%') SELECT name FROM k WHERE NOT EXISTS (SELECT 1 FROM lines WHERE ext = 'kt' AND text = 'val h = ' || name || '()')""")
def settled_flag(spark, sf_dir):
    """What only the old home's branches have."""
    return T.settled_flag(lines(spark, sf_dir), "NEW_HOME", True)


@query("dc018_dead_layouts", f"""{LINES}, l AS (SELECT 'm0/src/main/res/layout/view_' || p_partkey || '.xml' AS file, CAST(p_partkey AS VARCHAR) AS n FROM part)
SELECT file FROM l WHERE NOT EXISTS (SELECT 1 FROM lines x WHERE x.ext IN ('kt', 'java') AND (x.text = 'val v = View' || n || 'Binding.bind(x)' OR x.text = 'val t = inflate(R.layout.view_' || n || ')') OR x.text = '<include layout="@layout/view_' || n || '"/>')""")
def dead_layouts(spark, sf_dir):
    """Layouts, one a part, that nothing names."""
    n = table(spark, sf_dir, "part").select(F.concat(F.lit("m0/src/main/res/layout/view_"), "p_partkey", F.lit(".xml")).alias("file"))
    return T.dead_layouts(n, lines(spark, sf_dir))


@query("t3_unused_assets", f"""{LINES}, a AS (SELECT 'm0/src/main/assets/pics/photo_' || (s_suppkey % 60) || '.png' AS file, 'photo_' || (s_suppkey % 60) || '.png' AS name FROM supplier)
SELECT DISTINCT file FROM a WHERE NOT EXISTS (SELECT 1 FROM lines x WHERE ext <> 'gradle' AND (x.text = 'open("pics/' || name || '")' OR x.text = '<img src="' || name || '"/>'))""")
def unused_assets(spark, sf_dir):
    """Pictures, one for each of some suppliers, that no line names."""
    a = table(spark, sf_dir, "supplier").select(F.concat(F.lit("m0/src/main/assets/pics/photo_"), (F.col("s_suppkey") % 60).cast("string"), F.lit(".png")).alias("file")).distinct()
    return T.unused_assets(a, lines(spark, sf_dir))


@query("t11_promises", f"""WITH RECURSIVE {CODE_SQL}, {LINES[5:]}, h AS (SELECT file, line FROM lines WHERE ext = 'kt' AND text LIKE '// TODO remove%'),
c AS (SELECT l.file, l.line, (l_orderkey * 8 + 2) AS decl_id FROM lines l JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l.file LIKE '%/F' || l_orderkey || '.kt' AND l.ext = 'kt' WHERE l.text LIKE 'class Thing%'),
n AS (SELECT h.file, h.line, min((c.line, c.decl_id))[2] AS decl_id FROM h JOIN c ON c.file = h.file AND c.line > h.line AND c.line <= h.line + 3 GROUP BY ALL)
SELECT n.*, (SELECT count(*) FROM edges WHERE dst = decl_id) AS refs FROM n""")
def promises(spark, sf_dir):
    """Promised removals above classes, with references to the order's declaration."""
    x = lines(spark, sf_dir)
    d = x.where("ext = 'kt' and startswith(text, 'class Thing')").select("file", "line", (F.regexp_extract("file", "F([0-9]+)", 1).cast("bigint") * 8 + 2).alias("decl_id"))
    return T.promises(x, d, project(spark, sf_dir).edges)


@query("v6_middlemen", f"""{LINES}, m AS (SELECT file AS parent_id, text FROM lines WHERE ext = 'kt' AND text LIKE 'fun %'),
r AS (SELECT parent_id, CASE WHEN text LIKE 'fun pass%' THEN split_part(split_part(text, '= ', 2), '.', 1) END AS r FROM m) SELECT parent_id, min(r) AS receiver, count(*) AS n FROM r GROUP BY parent_id HAVING count(*) >= 2 AND count(r) = count(*) AND count(DISTINCT r) = 1""")
def middlemen(spark, sf_dir):
    """Files whose functions, two or more, all forward to one receiver."""
    return T.middlemen(lines(spark, sf_dir).where("ext = 'kt' and startswith(text, 'fun ')").select(F.col("file").alias("parent_id"), "text"))


@query("v3_near_twins")
def near_twin_callables(spark, sf_dir):
    """Documents of one source as callables of one name: those whose abstracted lines are at least 80 % alike."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return T.near_twin_callables(d.select(F.col("doc_id").alias("decl_id"), F.col("source").alias("name"), F.col("doc_id").cast("string").alias("file"), "text"))


@query("v13_changed_alone", f"""{LINES}, w AS (SELECT DISTINCT file, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM code), n AS (SELECT word, count(*) AS files FROM w GROUP BY word),
d AS (SELECT file, line, regexp_extract(text, 'class (\\w+)', 1) AS name FROM code WHERE text LIKE '%class %' AND regexp_extract(file, 'F(\\d+)', 1)::BIGINT % 5 = 0)
SELECT file, line, name FROM d JOIN n ON n.word = d.name WHERE name <> '' AND files = 1""")
def changed_alone(spark, sf_dir):
    """Classes of changed files (those of every fifth order) whose name no other file has."""
    x = lines(spark, sf_dir)
    d = T.all_of(T.code(x).where("cast(regexp_extract(file, 'F([0-9]+)', 1) as bigint) % 5 = 0"), r"class (\w+)", "name", keep=("file", "line"))
    return T.only_here(d, x).select("file", "line", "name")
