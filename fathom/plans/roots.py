"""Entry points: every reason why a declaration lives without a reference.

Reasons that its own columns give are one array of conditions in one scan;
reasons that need other rows (consumed providers, names in side inputs, keep
rules, generated names, accessors) are joins on names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Annotations that make a root, found inside longer ones too.
ENTRY = (
    "ActivityScoped After AfterAll AfterEach AndroidEntryPoint Before BeforeAll BeforeEach BindingAdapter BindingConversion BindingMethod BindingMethods "
    "BindsInstance BindsOptionalOf Body CName ColumnInfo Component Contextual DELETE Dao Database Delete Embedded Entity EntryPoint ExperimentalCoroutinesApi Expose "
    "Factory Field FieldMap FlowPreview ForeignKey FormUrlEncoded FragmentScoped GET HEAD HTTP Header HeaderMap Headers HiltAndroidApp HiltViewModel HiltWorker Ignore "
    "Inject Insert InstallIn InverseBindingAdapter JavascriptInterface JsExport JsName Json JsonAdapter JsonClass JvmStatic Keep KeepPublicApi KoinViewModel Module Multipart "
    "NavDestination NavGraph OPTIONS OnLifecycleEvent PATCH POST PUT ParameterizedTest Parcelize Path Polymorphic Preview PreviewParameter PrimaryKey Query RawQuery Relation "
    "Reusable RunWith SerialName Serializable SerializedName ServiceScoped Single Singleton Streaming Subcomponent Subscribe Test Transaction TypeConverter TypeConverters Update Url ViewModelScoped"
).split()
#: Parts of super types that the platform creates.
COMPONENTS = "Activity Adapter Application BroadcastReceiver ContentProvider Fragment RecyclerView Service View ViewModel".split()
SERIALIZED = "Entity JsonClass Parcelize Serializable".split()
#: Functions that operators call by convention when they override.
CONVENTIONS = (
    "compareTo contains dec div divAssign equals get getValue hasNext inc invoke iterator minus minusAssign next not plus plusAssign "
    "provideDelegate rangeTo rangeUntil rem remAssign set setValue times timesAssign unaryMinus unaryPlus"
).split()


def contains_any(col: str | Column, words: list[str]) -> Column:
    return (F.col(col) if isinstance(col, str) else col).rlike("|".join(words))


def is_word(col: str, *words: str) -> Column:
    """One of the words stands in a column of words with blanks between."""
    return F.arrays_overlap(F.split(col, " "), F.array(*map(F.lit, words)))


def is_convention() -> Column:
    """Called through an operator: marked so, a component function, or an override of a conventional name."""
    override = is_word("mods", "override") | F.contains("anns", F.lit("Override"))
    by_name = F.col("name").rlike("^component[0-9]+$") | (override & F.col("name").isin(CONVENTIONS))
    return (F.col("language") == "Kotlin") & F.col("kind").isin("Method", "Function") & (is_word("mods", "operator") | by_name)


def _reasons() -> Column:
    main = (F.col("name") == "main") & ((F.col("kind") == "Function") | ((F.col("kind") == "Method") & (is_word("mods", "static") | F.contains("anns", F.lit("JvmStatic")))))
    return F.array_compact(F.array(
        F.when(is_convention(), "convention"),
        F.when(contains_any("supers", COMPONENTS), "component"),
        F.when(contains_any("anns", ENTRY), "annotation"),
        F.when(main, "main"),
        F.when(contains_any("anns", SERIALIZED), "serialized"),
    ))


def produced() -> Column:
    """Simple name of a provider's type."""
    return F.element_at(F.split(F.regexp_replace("type_name", r"[<(?].*$", ""), r"\."), -1)


def consumed_providers(decls: DataFrame, edges: DataFrame) -> DataFrame:
    """(decl_id, consumed) of providers: whether their type is foreign, unknown, or referred to by anything but an equal provider or a subtype."""
    p = decls.where(contains_any("anns", ["Provides", "Binds"]) & F.col("kind").isin("Method", "Function")).select("decl_id", produced().alias("made"))
    types = decls.where(F.col("kind").isin("Class", "Interface", "Object", "Enum", "TypeAlias", "Annotation")).select("decl_id", "name")
    wanted = types.join(p.select(F.col("made").alias("name")).distinct(), "name", "left_semi")
    uses = edges.where("kind <> 'Inheritance'").select("src", F.col("dst").alias("decl_id")).join(wanted, "decl_id").select("src", "name")
    own = p.select(F.col("decl_id").alias("src"), F.col("made").alias("name"))
    used = uses.join(own, ["src", "name"], "left_anti").select(F.col("name").alias("made")).distinct().withColumn("used", F.lit(True))
    known = wanted.select(F.col("name").alias("made")).distinct().withColumn("known", F.lit(True))
    got = p.join(known, "made", "left").join(used, "made", "left")
    return got.select("decl_id", (F.col("known").isNull() | F.col("used").isNotNull()).alias("consumed"))


def named_roots(decls: DataFrame, names: DataFrame) -> DataFrame:
    """(decl_id) that ``names`` (first column; manifest, layout, navigation, configuration) mean: full names' carriers, else those of the simple name."""
    n = names.toDF("n", *[f"x{k}" for k in range(len(names.columns) - 1)]).select("n").where("n is not null").distinct()
    full = n.join(decls.select("decl_id", F.col("fqn").alias("n")), "n").select("n", "decl_id")
    rest = n.join(full.select("n").distinct(), "n", "left_anti").select(F.element_at(F.split("n", r"[.$]"), -1).alias("name"))
    types = decls.where(F.col("kind") != "Parameter").select("decl_id", "name")
    return full.select("decl_id").unionByName(types.join(rest.distinct(), "name", "left_semi").select("decl_id")).distinct()


def kept_roots(decls: DataFrame, patterns: list[str]) -> DataFrame:
    """(decl_id) whose full name one of the keep rules' expressions matches."""
    return decls.where(F.col("fqn").rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)).select("decl_id")


def retained_roots(decls: DataFrame, globs: list[str]) -> DataFrame:
    """(decl_id) that a glob keeps: a star at one end of a simple name, or a whole simple or full name."""

    def one(g: str) -> Column:
        if g.startswith("*"):
            return F.col("name").endswith(g[1:])
        if g.endswith("*"):
            return F.col("name").startswith(g[:-1])
        return (F.col("name") == g) | (F.col("fqn") == g)

    return decls.where(reduce(lambda a, b: a | b, map(one, globs), F.lit(False))).select("decl_id")


_GENERATED = [r"^Dagger([A-Z]\w*)$", r"^([A-Z]\w*)_(?:Factory|MembersInjector|Impl)$", r"^([A-Z]\w*?)(?:Directions|Args)$"]


def generated_roots(decls: DataFrame, mentions: DataFrame) -> DataFrame:
    """(decl_id) of types that generated code is named after: the generated name is mentioned (first column) and not declared."""
    m = mentions.toDF("m", *[f"x{k}" for k in range(len(mentions.columns) - 1)]).select("m").distinct()
    m = m.join(decls.select(F.col("name").alias("m")).join(m, "m", "left_semi").distinct(), "m", "left_anti")
    base = F.array(*[F.regexp_extract("m", g, 1) for g in _GENERATED])
    of = m.select(F.explode(F.array_remove(base, "")).alias("name")).distinct()
    return decls.where(F.col("kind").isin("Class", "Interface", "Object", "Enum")).join(of, "name", "left_semi").select("decl_id")


def accessor_roots(decls: DataFrame, mentions: DataFrame) -> DataFrame:
    """(decl_id) of fields whose generated getter or setter is mentioned (first column)."""
    m = mentions.toDF("m", *[f"x{k}" for k in range(len(mentions.columns) - 1)]).select("m").distinct()
    cap = F.concat(F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)"))
    fields = decls.where("kind = 'Field'").select("decl_id", F.explode(F.array(*[F.concat(F.lit(k), cap) for k in ("get", "set", "is")])).alias("m"))
    return fields.join(m, "m", "left_semi").select("decl_id").distinct()


def find_roots(decls: DataFrame, edges: DataFrame, more: dict[str, DataFrame] | None = None) -> DataFrame:
    """(decl_id, reason): every root with the least of its reasons; ``more`` has reasons with their (decl_id)."""
    own = decls.withColumn("reason", F.explode(_reasons())).select("decl_id", "reason")
    every = own.unionByName(consumed_providers(decls, edges).where("consumed").select("decl_id", F.lit("provider").alias("reason")))
    for reason, ids in (more or {}).items():
        every = every.unionByName(ids.select("decl_id", F.lit(reason).alias("reason")))
    return every.groupBy("decl_id").agg(F.min("reason").alias("reason"))


def _any(col: str, words: list[str]) -> str:
    return f"len(list_filter({words!r}, lambda w: contains({col}, w))) > 0"


#: The same over the common table expressions decls and edges.
ROOTS_SQL = f"""
made AS (SELECT decl_id, split_part(split_part(type_name, '<', 1), '.', -1) AS made FROM decls WHERE (contains(anns, 'Provides') OR contains(anns, 'Binds')) AND kind IN ('Method', 'Function')),
providers AS (SELECT decl_id, NOT EXISTS (SELECT 1 FROM decls t WHERE t.name = made AND t.kind IN ('Class', 'Interface', 'Object', 'Enum'))
  OR EXISTS (SELECT 1 FROM edges e JOIN decls t ON t.decl_id = e.dst AND t.kind IN ('Class', 'Interface', 'Object', 'Enum') LEFT JOIN made m ON m.decl_id = e.src AND m.made = t.name WHERE t.name = made.made AND m.decl_id IS NULL) AS consumed FROM made),
reasons AS (
  SELECT decl_id, 'convention' AS reason FROM decls WHERE language = 'Kotlin' AND kind IN ('Method', 'Function') AND (list_contains(string_split(mods, ' '), 'operator') OR regexp_full_match(name, 'component[0-9]+')
    OR ((list_contains(string_split(mods, ' '), 'override') OR contains(anns, 'Override')) AND list_contains({CONVENTIONS!r}, name)))
  UNION ALL SELECT decl_id, 'component' FROM decls WHERE {_any('supers', COMPONENTS)}
  UNION ALL SELECT decl_id, 'annotation' FROM decls WHERE {_any('anns', ENTRY)}
  UNION ALL SELECT decl_id, 'main' FROM decls WHERE name = 'main' AND (kind = 'Function' OR kind = 'Method' AND (list_contains(string_split(mods, ' '), 'static') OR contains(anns, 'JvmStatic')))
  UNION ALL SELECT decl_id, 'serialized' FROM decls WHERE {_any('anns', SERIALIZED)}
  UNION ALL SELECT decl_id, 'provider' FROM providers WHERE consumed),
roots AS (SELECT decl_id, min(reason) AS reason FROM reasons GROUP BY decl_id)
"""
