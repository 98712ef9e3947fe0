"""From a folder of sources to findings: extraction, resolution, roots, reachability, rules, steps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.scratch import stash
from fathom.operators import text_rules as T
from fathom.operators.graph import deep_reach
from fathom.plans import roots as R
from fathom.plans import steps as S
from fathom.plans.resolve import resolve
from fathom.plans.rules import Limits, evaluate, facts, rules
from fathom.sources.code import extract
from fathom.sources.files import lines_of, phantom_sets, read_project, xml_names
from fathom.sources.reports import keep_rules

#: Rules of a plain scan; the others are asked for.
DEFAULT = ("DC",)


@dataclass(frozen=True)
class Options:
    """What a scan is asked for."""

    codes: tuple[str, ...] = DEFAULT
    exclude: tuple[str, ...] = ()
    retain: tuple[str, ...] = ()
    entry_points: tuple[str, ...] = ()
    honor_keep_rules: bool = True
    library: bool = False
    limits: Limits = field(default_factory=Limits)
    least: str = "Low"


@dataclass
class Project:
    """What is known of a folder before any rule."""

    files: DataFrame
    lines: DataFrame
    decls: DataFrame
    edges: DataFrame
    roots: DataFrame
    live: DataFrame
    keeps: list[str]


def analyse(spark: SparkSession, path: str, options: Options = Options()) -> Project:
    """Read, extract, resolve, find roots and what they reach."""
    files = read_project(spark, path, list(options.exclude))
    builds = files.where("ext = 'gradle'")
    files = stash(files.join(phantom_sets(files, builds), "file", "left_anti")) if not builds.isEmpty() else stash(files)
    lines = stash(lines_of(files))
    got = extract(files)
    decls = stash(got.decls)
    edges = resolve(decls, got.refs, got.imports)
    rules_text = [r["content"] for r in files.where("ext = 'pro'").select("content").toLocalIterator()]
    keeps = [p for text in rules_text for p in keep_rules(text)]
    words = T.words_of(T.code(lines)).select("word")
    names = xml_names(files)
    more = {"named": R.named_roots(decls, names.select("name")), "generated": R.generated_roots(decls, words), "accessor": R.accessor_roots(decls, words)}
    if options.entry_points:
        more["configured"] = R.named_roots(decls, spark.createDataFrame([(n,) for n in options.entry_points], "n string"))
    if options.honor_keep_rules:
        more["keep rule"] = R.kept_roots(decls, keeps)
    more["retained"] = R.retained_roots(decls, list(options.retain))
    if options.library:
        more["library"] = decls.where("parent_id is null and visibility = 'Public'").select("decl_id")
    found = stash(R.find_roots(decls, edges, more))
    live = stash(deep_reach(found, decls, edges).distinct())
    return Project(files, lines, decls, edges, found, live, keeps)


def iterated_enums(decls: DataFrame, lines: DataFrame) -> DataFrame:
    """(decl_id) of enums whose cases are listed by reflection: by name anywhere, or barely in their own file."""
    enums = decls.where("kind = 'Enum'").select("decl_id", "name", "file")
    qualified = T.all_of(T.code(lines), r"\b(\w+)(?:\.|::)(?:values|entries|valueOf)\b", "name", keep=()).unionByName(T.all_of(T.code(lines), r"\benum(?:Values|Entries)<(\w+)>", "name", keep=()))
    bare = T.code(lines).where(F.col("text").rlike(r"(?<![\w.])(values\(\)|valueOf\(|entries(?!\w))")).select("file").distinct()
    return enums.join(qualified.distinct(), "name", "left_semi").select("decl_id").unionByName(enums.join(bare, "file", "left_semi").select("decl_id")).distinct()


def text_findings(p: Project) -> DataFrame:
    """(code, confidence, file, line, name) of the rules over lines."""
    x, d = p.lines, p.decls
    layouts = p.files.where("file like '%/res/layout%/%' and ext = 'xml'").select("file")
    null = F.lit("").alias("name")

    def row(code: str, df: DataFrame, name=null, confidence=F.lit("High")) -> DataFrame:
        return df.select(F.lit(code).alias("code"), confidence.alias("confidence"), "file", F.col("line").cast("bigint").alias("line"), name.alias("name") if name is not null else null)

    at = lambda df: T.enclosing(df, d)
    top = lambda df: df.withColumn("line", F.lit(1))
    parts = [
        row("DC004", T.unused_imports(x), F.col("name")),
        row("DC007", at(T.dead_branches(x))),
        row("DC010", T.unread_preferences(x), F.col("key")),
        row("DC011", top(T.write_only_daos(x)), F.col("dao")),
        row("DC012", T.duplicate_imports(x), F.col("path")),
        row("DC013", T.null_initialisers(x), F.col("name")),
        row("DC014", at(T.redundant_this(x)), F.col("name"), F.lit("Medium")),
        row("DC015", at(T.redundant_parens(x))),
        row("DC016", at(T.size_against_zero(x)), F.col("operator")),
        row("DC017", T.unused_resources(x), F.col("name"), F.col("confidence")),
        row("DC018", top(T.dead_layouts(layouts, x))),
        row("DC019", T.unread_extras(x), F.col("key")),
        row("DC020", T.dead_config_keys(x), F.col("key")),
        row("DC021", T.dead_dto_fields(x), F.col("name")),
        row("DC022", T.orphan_translations(x), F.col("name")),
    ]
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


def scan(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """(file, line, code, name, kind, confidence, risk, notes, decl_id) of all findings below ``path``, in report order.

    Rules over declarations, then those over lines; of the dead-code analyses one
    finding a declaration; what a directive ignores is gone, suppressed files and
    names in literals lower the confidence, and what is below the least asked
    for is left out.
    """
    p = analyse(spark, path, options)
    chosen = [r for r in rules(options.limits) if r.code.startswith(options.codes)]
    f = facts(p.decls, p.edges, p.roots, p.live, iterated_enums(p.decls, p.lines))
    own = S.one_each(evaluate(f, chosen).join(p.decls.select("decl_id", "fqn", "visibility", "anns", "lines", "parent_id"), "decl_id"))
    text = text_findings(p).where(F.col("code").rlike("^(" + "|".join(options.codes) + ")"))
    place = p.files.select("file", "module", "source_set")
    text = text.join(place, "file").withColumns({"decl_id": F.lit(None).cast("bigint"), "kind": F.lit("Text"), "bytes": F.lit(0).cast("bigint"), "fqn": F.lit(None).cast("string"), "visibility": F.lit(""), "anns": F.lit(""), "lines": F.lit(1).cast("bigint"), "parent_id": F.lit(None).cast("bigint")})
    found = own.unionByName(text.select(own.columns))
    found = S.inline_ignore(found, p.lines.select("file", "line", "text"))
    found = S.file_suppression(found, T.suppression_headers(p.lines))
    found = S.test_mention(found, T.test_words(p.lines))
    found = S.risk(found, T.literal_words(p.lines), T.reflection_files(p.lines))
    found = found.where(S.mapped("confidence", S.RANK) >= S.RANK[options.least])
    return found.select("file", "line", "code", "name", "kind", "confidence", "risk", "notes", "decl_id").orderBy("file", "line", "code", "name")
