"""Rules over the lines of source, resource and build files.

Every operator takes ``lines`` (file, module, source_set, ext, line, text), line
numbers from 1, and finds matches with expressions that stay in the JVM; what
must not occur elsewhere is an anti-join on the extracted key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.scratch import stash
from fathom.operators.joins import as_of

WORD = "[A-Za-z_][A-Za-z0-9_]*"


def code(lines: DataFrame) -> DataFrame:
    """Kotlin and Java lines."""
    return lines.where("ext in ('kt', 'java')")


def all_of(lines: DataFrame, pattern: str, key: str = "key", group: int = 1, keep: tuple[str, ...] = ("file", "module", "source_set", "line")) -> DataFrame:
    """A row for each match of the pattern, with one of its groups."""
    return lines.where(F.col("text").rlike(pattern)).select(*keep, F.explode(F.regexp_extract_all("text", F.lit(pattern), group)).alias(key))


def not_comment() -> Column:
    return ~F.ltrim("text").rlike(r"^(//|\*)")


def words_of(lines: DataFrame, *keep: str) -> DataFrame:
    """(keep..., word) of identifiers, distinct."""
    return lines.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), 0))).alias("word")).distinct()


def only_here(named: DataFrame, lines: DataFrame) -> DataFrame:
    """``named`` (file, name, ...) whose name is a word of no other code file."""
    n = words_of(code(lines), "file").groupBy(F.col("word").alias("name")).agg(F.min("file").alias("lo"), F.max("file").alias("hi"))
    return named.join(n, "name", "left").where("lo is null or lo = hi and lo = file").drop("lo", "hi")


# --- imports ---


def imports(lines: DataFrame) -> DataFrame:
    """(file, line, path, name) of imports; the name that a star binds is null."""
    rest = F.regexp_extract("text", r"^\s*import\s+(?:static\s+)?(.*?)\s*;?\s*$", 1)
    x = code(lines).where(F.ltrim("text").startswith("import ")).select("file", "line", rest.alias("path"))
    alias = F.regexp_extract("path", r"\sas\s+(\w+)$", 1)
    name = F.when(F.col("path").endswith(".*"), None).when(alias != "", alias).otherwise(F.element_at(F.split("path", r"\."), -1))
    return x.select("file", "line", "path", name.alias("name"))


def unused_imports(lines: DataFrame) -> DataFrame:
    """(file, line, name) of imports whose name no other line of the file has."""
    body = words_of(code(lines).where(~F.ltrim("text").startswith("import ")), "file").withColumnRenamed("word", "name")
    return imports(lines).where("name is not null").join(body, ["file", "name"], "left_anti").select("file", "line", "name")


def duplicate_imports(lines: DataFrame) -> DataFrame:
    """(file, line, path, first_line) of imports that an earlier line of the file has."""
    x = imports(lines)
    first = F.min("line").over(Window.partitionBy("file", "path"))
    return x.withColumn("first_line", first).where("line > first_line").select("file", "line", "path", "first_line")


# --- lines on their own ---


def dead_branches(lines: DataFrame) -> DataFrame:
    """(file, line) of conditions that are the literal false."""
    return code(lines).where(not_comment() & F.col("text").rlike(r"\b(if|while)\s*\(\s*false\s*\)")).select("file", "line")


def null_initialisers(lines: DataFrame) -> DataFrame:
    """(file, line, name) of Java fields set to null where they are declared."""
    field = r"^\s*(?:(?:private|protected|public|static|volatile|transient)\s+)+[\w<>\[\], .?]+?\s(\w+)\s*=\s*null\s*;"
    x = lines.where((F.col("ext") == "java") & F.col("text").rlike(field) & ~F.contains("text", F.lit("final")))
    return x.select("file", "line", F.regexp_extract("text", field, 1).alias("name"))


def redundant_parens(lines: DataFrame) -> DataFrame:
    """(file, line) of conditions in two pairs of parentheses and returned words in one."""
    double, word = r"\b(if|while)\s*\(\([^()]*\)\)", r"\breturn\s*\(\w+\)\s*;?\s*$"
    return code(lines).where(not_comment() & (F.col("text").rlike(double) | F.col("text").rlike(word))).select("file", "line")


def size_against_zero(lines: DataFrame) -> DataFrame:
    """(file, line, operator) of sizes compared with 0."""
    p = r"\.(?:size|length)\s*(==|!=|>)\s*0\b"
    return code(lines).where(not_comment() & F.col("text").rlike(p)).select("file", "line", F.regexp_extract("text", p, 1).alias("operator"))


def redundant_this(lines: DataFrame) -> DataFrame:
    """(file, line, name) of ``this.f = g`` in Kotlin where nothing above, up to the nearest function head, declares f as parameter or local."""
    k = lines.where("ext = 'kt'")
    w = Window.partitionBy("file").orderBy("line")
    head = F.last(F.when(F.contains("text", F.lit("fun ")), F.struct("line", "text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    sides = F.split("text", "=")
    left, right = F.trim(F.split_part("text", F.lit("="), F.lit(1))), F.trim(F.split_part("text", F.lit("="), F.lit(2)))
    field = F.element_at(F.split(left, r"this\."), -1)
    assigns = (F.size(sides) == 2) & F.contains(left, F.lit("this.")) & field.rlike(r"^\w+$") & right.rlike(r"^\w+$") & not_comment()
    local = r"\bva[lr]\s+(\w+)\b"
    declares = F.col("text").rlike(local) & ~F.contains("text", F.lit("fun "))
    # other lines change no head
    k = k.where(assigns | declares | F.contains("text", F.lit("fun "))).withColumn("head", head).where(assigns | declares)
    a = k.where(assigns).select("file", "line", "head", field.alias("name"), right.alias("other"))
    a = a.where("head is not null and name <> other").where(~F.expr(r"regexp_like(head.text, concat('\\b', name, '\\s*:'))"))
    v = k.where(declares & F.col("head").isNotNull())
    v = v.select(F.col("file").alias("v_file"), F.col("line").alias("v_line"), F.col("head.line").alias("v_head"), F.explode(F.regexp_extract_all("text", F.lit(local), 1)).alias("v_name"))
    same = (F.col("file") == F.col("v_file")) & (F.col("head.line") == F.col("v_head")) & (F.col("name") == F.col("v_name")) & (F.col("v_line") < F.col("line"))
    return a.join(v, same, "left_anti").select("file", "line", "name")


def enclosing(hits: DataFrame, decls: DataFrame) -> DataFrame:
    """``hits`` (file, line, ...) with the declaration that begins last at or above their line; hits without one go."""
    d = decls.where("kind in ('Function', 'Method', 'Constructor', 'Class', 'Object')").select("file", "line", "decl_id")
    return as_of(hits, d, "file", "line", "decl_id").where("decl_id is not null")


# --- keys written and read ---


def _unread(writes: DataFrame, reads: DataFrame, keep: str = "first") -> DataFrame:
    left = writes.join(reads.select("key").distinct(), "key", "left_anti")
    if keep == "all":
        return left.select("key", "file", "line")
    return left.groupBy("key").agg(F.min(F.struct("file", "line")).alias("at")).select("key", F.col("at.file").alias("file"), F.col("at.line").alias("line"))


_KINDS = "String|Int|Boolean|Long|Float|StringSet"
_CARRIED = r'Bundle\(|Intent\(|putExtra\(|(?i:bundle\.|intent\.|args\.|arguments\.|outstate\.|savedinstancestate\.|extras\.)'
_ARGUMENT = r'\(\s*(?:"([^"]*)"|(?:\w+\.)*([A-Z][A-Z0-9_]*)\s*[,)])'
_SDK = "^(com_braze_|com_appboy_|google_|firebase_|facebook_|crashlytics_|appsflyer_)"


def unread_preferences(lines: DataFrame) -> DataFrame:
    """(key, file, line) of preference keys that are put and never got, at every place.

    A constant stands for its value if the corpus gives it one value only; lines
    about bundles and intents are passed over, and so are keys of kits.
    """
    x = code(lines).where(~F.col("text").rlike(_CARRIED))
    const = all_of(code(lines), r'\b([A-Z][A-Z0-9_]*\s*=\s*"[^"]*)"', "c").select(F.regexp_extract("c", r"^(\w+)", 1).alias("name"), F.regexp_extract("c", r'"(.*)$', 1).alias("value"))
    const = const.groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo = hi").select("name", F.col("lo").alias("value"))

    def keys(verb: str) -> DataFrame:
        p = verb + _ARGUMENT
        y = x.where(F.col("text").rlike(p)).select("file", "line", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(p), 1).alias("a"), F.regexp_extract_all("text", F.lit(p), 2).alias("b"))).alias("z"))
        y = y.select("file", "line", F.col("z.a").alias("a"), F.col("z.b").alias("name")).join(const, "name", "left")
        return y.select("file", "line", F.when(F.col("name") != "", F.coalesce("value", F.concat(F.lit("$"), "name"))).otherwise(F.col("a")).alias("key"))

    writes = keys(rf"\bput(?:{_KINDS})").where(~F.col("key").rlike(_SDK))
    return _unread(writes, keys(rf"\b(?:get(?:{_KINDS})|contains)"), "all")


def unread_extras(lines: DataFrame) -> DataFrame:
    """(key, file, line) of intent extras that are put and never got, where they are put first; tests and the platform's keys aside."""
    x = code(lines).where("source_set not in ('test', 'androidTest')")
    reads = all_of(x, r'\bget\w*Extras?\s*\(\s*"([^"]+)"').unionByName(all_of(x, r'\bhasExtra\s*\(\s*"([^"]+)"'))
    writes = all_of(x, r'\bputExtra\s*\(\s*"([^"]+)"').where(~F.col("key").startswith("android.") & ~F.col("key").isin("app_package", "app_uid"))
    return _unread(writes, reads)


def unread_cache_keys(lines: DataFrame) -> DataFrame:
    """(key, file, line) of keys put into caches and never got, where they are put first."""
    x = code(lines)
    reads = all_of(x, r'[Cc]ache\w*\s*\.\s*get\s*\(\s*"([^"]+)"').unionByName(all_of(x, r'[Cc]ache\w*\s*\[\s*"([^"]+)"\s*\]'))
    return _unread(all_of(x, r'[Cc]ache\w*\s*\.\s*put\s*\(\s*"([^"]+)"'), reads)


def write_only_daos(lines: DataFrame) -> DataFrame:
    """(file, dao, writes) of data access types with writing methods and no reading one.

    A type takes the annotations that follow it, up to the next such type of the file.
    """
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = r"^\s*@Dao\s+(?:abstract\s+class|interface|class)\s+(\w+)"
    x = code(lines).withColumn("dao", F.last(F.when(F.col("text").rlike(head), F.regexp_extract("text", head, 1)), ignorenulls=True).over(w)).where("dao is not null")
    writes, reads = F.col("text").rlike(r"^\s*@(Insert|Update|Delete|Upsert)\b"), F.col("text").rlike(r"^\s*@(Query|RawQuery)\b")
    g = x.groupBy("file", "dao").agg(F.count_if(writes).alias("writes"), F.count_if(reads).alias("reads"))
    return g.where("writes > 0 and reads = 0").select("file", "dao", "writes")


# --- resources and remote configuration ---

_TYPES = "string|color|dimen|style|drawable|bool|integer|array|plurals|id"


def resources(lines: DataFrame) -> DataFrame:
    """(type, name, file, module, line, value, locale) of values in resource files; the locale is '' for the base."""
    p = rf'<({_TYPES})\s+name="([^"]+)"[^>]*>([^<]*)'
    x = lines.where((F.col("ext") == "xml") & F.col("text").rlike(p))
    cols = [F.regexp_extract("text", p, k).alias(n) for k, n in enumerate(["type", "name", "value"], 1)]
    return x.select("file", "module", "line", *cols, F.regexp_extract("file", r"/values-?([^/]*)/", 1).alias("locale"))


def mentioned_resources(lines: DataFrame) -> DataFrame:
    """(type, name), distinct, of resources that code or other resources name."""
    p = rf"(?:R\.|@)(?:\+)?({_TYPES}|layout)[./](\w+)"
    x = lines.where(F.col("text").rlike(p)).select(F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(p), 1).alias("t"), F.regexp_extract_all("text", F.lit(p), 2).alias("n"))).alias("z"))
    return x.select(F.col("z.t").alias("type"), F.col("z.n").alias("name")).distinct()


def unused_resources(lines: DataFrame) -> DataFrame:
    """(type, name, file, line, confidence, risk) of base resources that nothing names; less sure where a type is looked up by name."""
    plain = ~F.col("name").rlike(r"^(Theme\.|Base\.|_)") & ~F.col("name").isin("app_name", "content_description")
    defined = resources(lines).where((F.col("locale") == "") & plain)
    looked = all_of(code(lines), r'getIdentifier\([^,]*,\s*"(\w+)"', "type").select("type").distinct().withColumn("dynamic", F.lit(True))
    x = defined.join(mentioned_resources(lines), ["type", "name"], "left_anti").join(looked, "type", "left")
    return x.select("type", "name", "file", "line", F.when(F.col("dynamic"), "Medium").otherwise("High").alias("confidence"), F.when(F.col("dynamic"), "High").otherwise("Low").alias("risk"))


def orphan_translations(lines: DataFrame) -> DataFrame:
    """(name, file, line) of translated strings whose base, in the same resource folder, lacks them."""
    s = resources(lines).where("type = 'string'").withColumn("res", F.regexp_extract("file", r"^(.*)/values[^/]*/", 1))
    return s.where("locale <> ''").join(s.where("locale = ''").select("res", "name"), ["res", "name"], "left_anti").select("name", "file", "line")


def duplicate_strings(lines: DataFrame) -> DataFrame:
    """(value, n_modules, n) of base strings that several modules have."""
    s = resources(lines).where("type = 'string' and locale = ''").select("module", F.trim("value").alias("value")).where("value <> ''")
    g = s.groupBy("value", "module").agg(F.count(F.lit(1)).alias("n")).groupBy("value").agg(F.count(F.lit(1)).alias("n_modules"), F.sum("n").alias("n"))
    return g.where("n_modules >= 2")


def dead_layouts(layouts: DataFrame, lines: DataFrame) -> DataFrame:
    """(file) of ``layouts`` (file) that no binding class, inflation or inclusion names."""
    x = layouts.select("file", F.regexp_extract("file", r"([^/]+)\.xml$", 1).alias("stem"))
    parts = F.transform(F.split("stem", "[_-]"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))))
    x = x.withColumn("binding", F.concat(F.array_join(parts, ""), F.lit("Binding")))
    bound = words_of(code(lines)).where(F.col("word").endswith("Binding")).withColumnRenamed("word", "binding")
    named = mentioned_resources(lines).where("type = 'layout'").select(F.col("name").alias("stem"))
    return x.join(bound, "binding", "left_anti").join(named, "stem", "left_anti").select("file")


def config_keys(lines: DataFrame) -> DataFrame:
    """(key, value, file, line) of remote configuration defaults."""
    p = r"<key>\s*([^<]+?)\s*</key>\s*(?:<value>\s*([^<]*?)\s*</value>)?"
    x = lines.where((F.col("ext") == "xml") & F.col("text").rlike(p))
    return x.select(F.regexp_extract("text", p, 1).alias("key"), F.regexp_extract("text", p, 2).alias("value"), "file", "line")


def dead_config_keys(lines: DataFrame) -> DataFrame:
    """(key, file, line, swept) of defaults that no literal names, and whether some line lists all keys."""
    said = all_of(code(lines), r'"([^"]+)"').select("key").distinct()
    sweep = code(lines).where(F.col("text").rlike(r"RemoteConfig\.getInstance\(\)\.all|remoteConfig\.all|getKeysByPrefix|\.getAll\(\)")).agg((F.count(F.lit(1)) > 0).alias("swept"))
    return config_keys(lines).join(said, "key", "left_anti").select("key", "file", "line").join(F.broadcast(sweep), F.lit(True))


def boolean_flags(lines: DataFrame) -> DataFrame:
    """(key, enabled) of defaults that are true or false."""
    v = F.lower("value")
    return config_keys(lines).where(v.isin("true", "false")).select("key", (v == "true").alias("enabled")).distinct()


def dead_dto_fields(lines: DataFrame) -> DataFrame:
    """(name, file, line) of serialised fields whose name the corpus has once."""
    p = r"@SerializedName\([^)]*\)\s*(?:va[lr]|[A-Za-z_][\w<>,.\[\] ]*?)\s+([a-z]\w*)\s*[:;=,)]"
    fields = all_of(code(lines), p, "name")
    n = code(lines).select(F.explode(F.regexp_extract_all("text", F.lit(WORD), 0)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n <= 1")
    return fields.join(n, "name", "left_semi").select("name", "file", "line")


# --- events, streams, promises ---


def bus_orphans(lines: DataFrame) -> DataFrame:
    """(event, side): events with a subscriber and no post, or posted and without one."""
    x = code(lines)
    kotlin = r"@Subscribe\b(?:\([^)]*\))?\s*(?:[a-z]+\s+)*fun\s+\w+\(\s*\w+\s*:\s*([A-Z][\w.]*)"
    java = r"@Subscribe\b(?:\([^)]*\))?\s*(?:[a-z]+\s+)*void\s+\w+\(\s*(?:final\s+)?([A-Z][\w.]*)\s+\w+"
    inline = r"\.(?:subscribe|register)\s*(?:<\s*|\(\s*)([A-Z][\w.]*)(?:\s*>|::class)"
    heard = all_of(x, kotlin).unionByName(all_of(x, java)).unionByName(all_of(x, inline))
    posted = all_of(x, r"\.post(?:Sticky)?\(\s*(?:new\s+)?([A-Z][\w.]*)\s*\(").where("key <> 'Runnable'")
    both = heard.select("key", F.lit("subscribed").alias("side")).unionByName(posted.select("key", F.lit("posted").alias("side")))
    g = both.groupBy("key").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo = hi")
    return g.select(F.col("key").alias("event"), F.col("lo").alias("side"))


STREAMS = ["Flow", "LiveData", "MutableLiveData", "MutableSharedFlow", "MutableStateFlow", "SharedFlow", "StateFlow"]


def unobserved_streams(lines: DataFrame) -> DataFrame:
    """(name, file, line) of streams that aren't private and that nothing takes a member of."""
    k = lines.where("ext = 'kt'")
    # a declaration's head ends at its first colon, its type at the first angle
    head = F.split(F.trim(F.split_part("text", F.lit(":"), F.lit(1))), " +")
    kind = F.element_at(F.split(F.trim(F.split_part(F.split_part("text", F.lit(":"), F.lit(2)), F.lit("<"), F.lit(1))), r"\."), -1)
    x = k.where(F.contains("text", F.lit(":")) & F.contains("text", F.lit("<"))).select("file", "line", head.alias("h"), kind.alias("t"))
    x = x.where((F.size("h") >= 2) & F.col("t").isin(STREAMS)).where("element_at(h, -2) = 'val' and not arrays_overlap(h, array('private', 'protected'))")
    used = all_of(k, r"(\w+)\s*\.\s*[A-Za-z]", "name").select("name").distinct()
    return x.select(F.element_at("h", -1).alias("name"), "file", "line").join(used, "name", "left_anti")


GAP = 3


def promises(lines: DataFrame, decls: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, line, decl_id, refs) of comments that promise a removal, with the declaration within three lines below and the references to it."""
    p = r"(?i)^\s*(?://|\*)\s*.*\b(?:TODO|FIXME)\b.*\b(?:remove|delete)\b"
    x = code(lines).where(F.col("text").rlike(p)).select("file", "line")
    d = decls.select("file", F.col("line").alias("d_line"), "decl_id")
    near = x.withColumn("d_line", F.explode(F.array(*[F.col("line") + k for k in range(1, GAP + 1)]))).join(d, ["file", "d_line"])
    best = near.groupBy("file", "line").agg(F.min(F.struct("d_line", "decl_id")).alias("b")).select("file", "line", F.col("b.decl_id").alias("decl_id"))
    n = edges.groupBy(F.col("dst").alias("decl_id")).agg(F.count(F.lit(1)).alias("refs"))
    return best.join(n, "decl_id", "left").select("file", "line", "decl_id", F.coalesce("refs", F.lit(0)).alias("refs"))


def settled_flag(lines: DataFrame, flag: str, enabled: bool) -> DataFrame:
    """(name): capitalised names that only the branches have which lose once ``flag`` is settled, and their declarations.

    A branch is an if on one line whose condition names the flag: the text in the
    first braces, and that in the braces after else.
    """
    k = lines.where("ext = 'kt'")
    gate = r"\bif\s*\([^)]*" + flag + r"[^)]*\)\s*\{([^}]*)\}(?:\s*else\s*\{([^}]*)\})?"
    g = k.where(F.col("text").rlike(gate))
    lose, win = (2, 1) if enabled else (1, 2)
    names = lambda col: F.regexp_extract_all(col, F.lit(r"\b[A-Z]\w*"), 0)
    part = lambda n: F.regexp_extract("text", gate, n)
    losing = g.select(F.explode(names(part(lose))).alias("name")).distinct()
    winning = g.select(F.explode(names(part(win))).alias("name")).distinct()
    rest = F.when(F.col("text").rlike(gate), F.replace(F.col("text"), part(lose), F.lit(" "))).otherwise(F.col("text"))
    declared = r"\b(?:class|interface|object|fun|val|var)\s+"
    said = k.select(rest.alias("t")).select("t", F.explode(F.array_distinct(names(F.col("t")))).alias("name"))
    said = said.where(~F.expr(r"regexp_like(t, concat('" + declared.replace("\\", "\\\\") + r"', name, '\\b'))")).select("name").distinct()
    return losing.join(winning, "name", "left_anti").join(said, "name", "left_anti")


# --- assets and build files ---


def unused_assets(assets: DataFrame, lines: DataFrame) -> DataFrame:
    """(file) of ``assets`` (file, under a folder called assets) of which no other file's line has the name or the path, at the end of a word of a path."""
    a = assets.select("file", F.regexp_extract("file", r"(?:^|/)assets/(.+)$", 1).alias("rel")).where("rel <> ''").withColumn("name", F.element_at(F.split("rel", "/"), -1))
    sizes = stash(a.agg(F.collect_set(F.length("name")).alias("sizes")))
    w = lines.where((F.col("ext") != "gradle") & F.contains("text", F.lit("."))).join(F.broadcast(sizes), F.lit(True))
    w = w.select(F.col("file").alias("by"), "sizes", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\w./-]*\w"), 0))).alias("w"))
    # an end of a word can be a name only if some name is as long
    ends = F.transform(F.filter("sizes", lambda n: n <= F.length("w")), lambda n: F.col("w").substr(F.length("w") - n + 1, n))
    tails = w.where(F.contains("w", F.lit("."))).select("by", F.explode(ends).alias("name"))
    hit = a.join(tails, "name").where("file <> by").select("file").distinct()
    return a.join(hit, "file", "left_anti").select("file")


def dead_modules(lines: DataFrame) -> DataFrame:
    """(module) of included modules that no other module's build file names and that are no application."""
    b = lines.where("ext = 'gradle'")
    included = all_of(b, r"""\binclude\s*\(?\s*["'](:?[\w:-]+)["']""", "m").select(F.regexp_replace("m", "^:?", ":").alias("m")).distinct()
    quoted = all_of(b.where(~F.col("text").rlike(r"\binclude\b")), r"""["'](:[\w:-]+)["']""", "m", keep=("module",))
    humps = lambda p: F.array_join(F.transform(F.split(p, "[-_]"), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x))))), "")
    camel = F.transform(F.split(F.expr("substring(m, 2)"), ":"), humps)
    named = included.withColumn("accessor", F.concat(F.lit("projects."), F.array_join(camel, ".")))
    typed = all_of(b, r"\b(projects\.[\w.]+)", "accessor", keep=("module",))
    used = quoted.unionByName(named.select("m", "accessor").join(typed, "accessor").select("module", "m"))
    own = F.element_at(F.split("m", ":"), -1)
    used = used.where(F.col("module") != own).select("m").distinct()
    app = b.where(F.contains("text", F.lit("com.android.application"))).select(F.col("module").alias("last")).distinct()
    x = included.join(used, "m", "left_anti").withColumn("last", own).join(app, "last", "left_anti")
    return x.select(F.col("m").alias("module"))


GENERIC = "android annotations api bom common core impl jvm kotlin ktx lib library plugin runtime test".split()


def unused_dependencies(lines: DataFrame) -> DataFrame:
    """(coordinate, file) of dependencies of which no import has the group, its last part, or a telling part of the artifact."""
    p = r"""^\s*(?:implementation|api|compileOnly|testImplementation|androidTestImplementation|debugImplementation|releaseImplementation)\s*\(?\s*["']([^"':]+:[^"':]+)"""
    d = all_of(lines.where("ext = 'gradle'"), p, "coordinate").select("coordinate", "file").distinct().withColumn("group", F.split_part("coordinate", F.lit(":"), F.lit(1)))
    d = d.where("group <> ''")
    paths = imports(lines).select(F.regexp_extract("path", r"^([\w.]+)", 1).alias("p")).distinct()
    segments = F.split("p", r"\.")
    seg = paths.select(F.explode(segments).alias("s")).distinct()
    heads = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, F.lit(1), i), "."))).alias("group")).distinct()
    tokens = F.array_union(F.array(F.element_at(F.split("group", r"\."), -1)), F.filter(F.split(F.split_part("coordinate", F.lit(":"), F.lit(2)), "-"), lambda t: ~t.isin(GENERIC)))
    by_word = d.select("coordinate", F.explode(tokens).alias("s")).join(seg, "s", "left_semi").select("coordinate").distinct()
    return d.join(heads, "group", "left_anti").join(by_word, "coordinate", "left_anti").select("coordinate", "file")


#: Permissions and the words of code that need them.
PERMISSIONS = {
    "CAMERA": ["CameraManager", "camera2", "CameraX"],
    "ACCESS_FINE_LOCATION": ["LocationManager", "FusedLocationProviderClient", "requestLocationUpdates"],
    "READ_CONTACTS": ["ContactsContract"],
    "RECORD_AUDIO": ["MediaRecorder", "AudioRecord"],
    "VIBRATE": ["Vibrator", "vibrate"],
    "INTERNET": ["OkHttpClient", "HttpURLConnection", "Retrofit", "WebView"],
    "BLUETOOTH": ["BluetoothAdapter"],
    "NFC": ["NfcAdapter"],
}


def unused_permissions(lines: DataFrame, dictionary: dict[str, list[str]] | None = None) -> DataFrame:
    """(permission, file, line) of known permissions whose words, and whose own name, no code has."""
    known = [(p, w) for p, words in (dictionary or PERMISSIONS).items() for w in [*words, p]]
    asked = all_of(lines.where("ext = 'xml'"), r'<uses-permission[^>]*android:name="android\.permission\.(\w+)"', "permission")
    k = lines.sparkSession.createDataFrame(known, "permission string, word string")
    used = F.broadcast(k).join(words_of(code(lines)), "word", "left_semi").select("permission").distinct()
    return asked.join(k.select("permission").distinct(), "permission", "left_semi").join(used, "permission", "left_anti").select("permission", "file", "line")


# --- classes that only forward, callables that look alike ---


def middlemen(methods: DataFrame) -> DataFrame:
    """(parent_id, receiver, n) of classes of two or more methods that all forward to one receiver; ``methods`` is (parent_id, text)."""
    head = F.split_part("text", F.lit("{"), F.lit(1))
    # what follows the equals sign after the parameters: a word, a dot, a word and a parenthesis
    whole = F.trim(F.expr("substring(head, locate('=', head, locate(')', head)) + 1)"))
    m = methods.where("parent_id is not null").select("parent_id", head.alias("head"))
    m = m.withColumn("body", F.when(F.expr("locate(')', head) > 0 and locate('=', head, locate(')', head)) > 0"), whole))
    call = F.split(F.split_part("body", F.lit("("), F.lit(1)), r"\.")
    plain = F.contains("body", F.lit("(")) & (F.size(call) == 2) & F.forall(call, lambda w: F.trim(w).rlike(r"^\w+$"))
    m = m.select("parent_id", F.when(plain, F.trim(F.element_at(call, 1))).alias("r"))
    g = m.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.count("r").alias("n_r"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    return g.where("n >= 2 and n = n_r and lo = hi").select("parent_id", F.col("lo").alias("receiver"), "n")


_KEPT = "also apply as boolean catch class else false finally for fun if in int interface is it let new null object return run static String super this throw true try val var void when while with".split()


def abstract_lines(text: Column) -> Column:
    """The different lines of a text with its names abstracted: identifiers that aren't called or keywords are _, blanks go; what is between quotes stays."""
    name = r"\b(?!(?:" + "|".join(_KEPT) + r")\b)[A-Za-z_]\w*+(?!\s*\()"

    def one(line: Column) -> Column:
        parts = F.transform(F.split(line, '"'), lambda p, i: F.when(i % 2 == 0, F.replace(F.regexp_replace(p, name, "_"), F.lit(" "), F.lit(""))).otherwise(p))
        return F.array_join(parts, '"')

    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda x: one(F.trim(x))), lambda x: x != ""))


def near_twin_callables(callables: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """(a, b, similarity) of callables (decl_id, name, file, text) of one name in different files with ``share`` of their abstracted lines in common, a < b.

    Pairs come from an index of parts in the order of how rare they are, so a line
    that all have brings none together by itself unless it is all they have.
    """
    x = stash(callables.select("decl_id", "name", "file", F.transform(abstract_lines(F.col("text")), lambda v: F.xxhash64(v)).alias("h")).where(F.size("h") >= least))
    n = x.select("name", F.explode("h").alias("k")).groupBy("name", "k").agg(F.count(F.lit(1)).alias("df"))
    keyed = x.select("name", "decl_id", "file", F.explode("h").alias("k")).join(n, ["name", "k"])
    sets = keyed.groupBy("name", "decl_id", "file").agg(F.array_sort(F.collect_list(F.struct("df", "k"))).alias("s"))
    size = F.size("s")
    keys = sets.select("name", "decl_id", "file", F.explode(F.slice("s", F.lit(1), size - F.ceil(size * share).cast("int") + 1)).alias("z"))
    # a part that only one callable has brings nobody together, but takes its place in the order
    keys = keys.where("z.df > 1").select("name", "decl_id", "file", F.col("z.k").alias("k"))
    a, b = (keys.select("name", "k", F.col("decl_id").alias(i), F.col("file").alias(f"f{i}")) for i in ("a", "b"))
    pairs = a.join(b, ["name", "k"]).where("a < b and fa <> fb").select("a", "b").distinct()
    h = lambda i: x.select(F.col("decl_id").alias(i), F.col("h").alias(f"h{i}"))
    both = pairs.join(h("a"), "a").join(h("b"), "b")
    j = F.size(F.array_intersect("ha", "hb")) / F.size(F.array_union("ha", "hb"))
    return both.select("a", "b", j.alias("similarity")).where(F.col("similarity") >= share)


# --- what the steps after the rules ask of files ---


def literal_words(lines: DataFrame) -> DataFrame:
    """(word), distinct, of identifiers inside string literals."""
    s = all_of(code(lines), r'("(?:[^"\\]|\\.)*")', "s")
    return s.select(F.explode(F.regexp_extract_all("s", F.lit(WORD), 0)).alias("word")).distinct()


def reflection_files(lines: DataFrame) -> DataFrame:
    """(file), distinct, with signs of reflection."""
    return code(lines).where(F.col("text").rlike(r"Class\.forName|getDeclaredMethod|getDeclaredField|::class\.java|@Subscribe|EventBus")).select("file").distinct()


def test_words(lines: DataFrame) -> DataFrame:
    """(word), distinct, of test files."""
    return words_of(code(lines).where(F.col("file").rlike(r"(^|/)(test|androidTest|sharedTest)/|Tests?\.(kt|kts|java)$")))


def suppression_headers(lines: DataFrame) -> DataFrame:
    """(file, names) that the suppressions above a Kotlin file's first package or import line name."""
    k = lines.where("ext = 'kt'")
    body = k.where(F.col("text").rlike(r"^\s*(package|import)\b")).groupBy("file").agg(F.min("line").alias("body"))
    head = k.join(body, "file", "left").where("body is null or line < body")
    bare = F.replace(F.col("text"), F.lit(" "), F.lit(""))
    marked = head.where(not_comment()).withColumn("bare", bare).where("startswith(bare, '@file:') and contains(bare, 'Suppress(')")
    s = marked.select("file", F.explode(F.slice(F.split("bare", r"Suppress\("), F.lit(2), F.length("bare"))).alias("rest")).select("file", F.split_part("rest", F.lit(")"), F.lit(1)).alias("args"))
    return s.select("file", F.explode(F.regexp_extract_all("args", F.lit(r"\w+"), 0)).alias("n")).groupBy("file").agg(F.collect_set("n").alias("names"))
