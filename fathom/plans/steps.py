"""What happens to findings on their way to a report.

A step takes findings with at least code, confidence, decl_id, name, kind, fqn,
file and line, and gives them back with confidence, risk or notes changed, or
some of them gone.  Notes are an array, in the order of the steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.joins import drift_anti, drift_semi

RANK = {"Low": 0, "Medium": 1, "High": 2, "Confirmed": 3}
SCORE = {"Low": 0.25, "Medium": 0.5, "High": 0.75, "Confirmed": 1.0}
DOWN = {"Low": "Low", "Medium": "Low", "High": "Medium", "Confirmed": "Confirmed"}
DIVISOR = {"High": 4.0, "Medium": 2.0, "Low": 1.0}
KEPT_BY_NAME = "Expose JsonClass JsonProperty Keep Parcelize SerialName Serializable SerializedName".split()
DIRECTIVE = r"fathom:ignore(?:\(([^)]*)\))?"
INFO = "AP003 AP009 AP010 AP014 AP018 AP020 AP022 AP024 AP025 AP034 DC003 DC004 DC006 DC009 DC013 DC014 DC015 DC016".split()
GROUPS = {
    "Architecture": [1, 2, 3, 4, 5, 6],
    "Kotlin": [7, 8, 9, 10, 21, 22, 23, 24, 25],
    "Performance": [11, 12, 13, 14, 15],
    "Android": [16, 17, 18, 19, 20, 26, 27, 28, 29, 30],
    "Compose": [31, 32, 33, 34],
}
#: Codes that a file's suppression may name besides the finding's own.
FAMILY = {
    **{k: ["unused", "UnusedPrivateMember", "UnusedPrivateClass", "UnusedPrivateProperty"] for k in ("DC001", "DC001m", "DC001p", "DC005", "DC008", "DC010", "DC011", "DC019", "DC020", "DC021")},
    **{k: ["unused", "UNUSED_VARIABLE", "UNUSED_EXPRESSION", "ASSIGNED_VALUE_IS_NEVER_READ"] for k in ("DC002a", "DC002b")},
    "DC003": ["unused", "UNUSED_PARAMETER"],
    "DC004": ["unused", "UNUSED_IMPORT", "UnusedImports"],
    "DC006": ["MemberVisibilityCanBePrivate", "RedundantVisibilityModifier"],
    "DC007": ["UNREACHABLE_CODE", "SENSELESS_COMPARISON"],
    "DC009": ["RedundantOverride"],
    "DC017": ["UnusedResources"],
    "DC018": ["UnusedResources"],
}


def mapped(col: str, values: dict) -> Column:
    """The value of a small dictionary for a column."""
    out = None
    for k, v in values.items():
        out = F.when(F.col(col) == k, F.lit(v)) if out is None else out.when(F.col(col) == k, F.lit(v))
    return out


def lower_if(condition: Column) -> Column:
    """The confidence, a notch lower where the condition holds."""
    return F.when(condition, mapped("confidence", DOWN)).otherwise(F.col("confidence"))


def severity() -> Column:
    return F.when(F.col("code").isin(INFO), "Info").otherwise("Warning")


def category() -> Column:
    out = F.when(F.col("code").startswith("DC"), "Dead Code")
    for name, numbers in GROUPS.items():
        out = out.when(F.col("code").isin([f"AP{k:03}" for k in numbers]), name)
    return out.otherwise("View")


def noted(found: DataFrame) -> DataFrame:
    """Findings with an array of notes, empty where there was none."""
    return found if "notes" in found.columns else found.withColumn("notes", F.array().cast("array<string>"))


def note(condition: Column, text: Column) -> Column:
    return F.when(condition, F.array_append("notes", text)).otherwise(F.col("notes"))


def one_each(found: DataFrame) -> DataFrame:
    """One dead-code finding a declaration of those that the two dead-code analyses and the patterns give: the most confident, then the least code."""
    same = F.col("code").isin("DC001", "DC001m", "DC001p")
    key = F.struct((-mapped("confidence", RANK)).alias("r"), "code")
    best = found.where(same).groupBy("decl_id").agg(F.min(key).alias("b")).select("decl_id", F.col("b.code").alias("code"))
    return found.where(~same).unionByName(found.join(best, ["decl_id", "code"], "left_semi").select(found.columns))


def hybrid(found: DataFrame, shrunk: DataFrame | None = None, symbols: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Findings checked against what a shrinker removed and what a run executed.

    ``shrunk`` is (class_name, member), a null member meaning the whole class;
    ``symbols`` (kind "class" or "method", fqn, covered); ``lines`` (file, line,
    covered).  A class or member that the shrinker removed is Confirmed, and that
    is that; a mere name that it removed makes High.  Then, with coverage, what
    was never executed is Confirmed, what was executed Low, and what is unknown
    gets the estimate of its kind; without coverage the estimate counts.
    """
    f = noted(found).withColumn("owner", F.regexp_extract("fqn", r"^(.*)\.[^.]*$", 1))
    yes = F.lit(True)
    if shrunk is not None:
        gone = shrunk.where("member is null").select(F.col("class_name").alias("fqn")).distinct().withColumn("s_class", yes)
        members = shrunk.where("member is not null").select(F.col("class_name").alias("owner"), F.col("member").alias("name")).distinct()
        own = members.select(F.col("owner").alias("fqn"), "name").withColumn("s_own", yes)
        f = f.join(gone, "fqn", "left").join(members.withColumn("s_member", yes), ["owner", "name"], "left").join(own, ["fqn", "name"], "left")
    else:
        f = f.withColumns({k: F.lit(None).cast("boolean") for k in ("s_class", "s_member", "s_own")})
    hit = F.coalesce("s_class", "s_member", "s_own", F.lit(False))
    types, funs, props = F.col("kind").isin("Class", "Object", "Interface"), F.col("kind").isin("Function", "Method"), F.col("kind").isin("Property", "Field")
    state = lambda a, b: F.when(F.col(a), "executed").when(F.col(b), "never")
    status = F.lit(None).cast("string")
    if symbols is not None:
        s = symbols.groupBy("kind", "fqn").agg(F.bool_or("covered").alias("yes"), F.bool_or(~F.col("covered")).alias("no"))
        whole = s.select(F.when(F.col("kind") == "class", "t").otherwise("f").alias("what"), "fqn", state("yes", "no").alias("c_exact"))
        # a class counts for every name that its own ends with, a method for its last part
        tails = F.when(F.col("kind") == "class", F.transform(F.sequence(F.lit(1), F.length("fqn")), lambda i: F.substring("fqn", i, F.length("fqn")))).otherwise(F.array(F.element_at(F.split("fqn", r"\."), -1)))
        by_name = s.select(F.when(F.col("kind") == "class", "t").otherwise("f").alias("what"), F.explode(tails).alias("name"), "yes", "no")
        by_name = by_name.join(found.select("name").distinct(), "name", "left_semi").groupBy("what", "name").agg(F.bool_or("yes").alias("yes"), F.bool_or("no").alias("no"))
        by_name = by_name.select("what", "name", state("yes", "no").alias("c_name"))
        f = f.withColumn("what", F.when(types, "t").when(funs, "f")).join(whole, ["what", "fqn"], "left").join(by_name, ["what", "name"], "left")
        status = F.when(types | funs, F.coalesce("c_exact", "c_name"))
    if lines is not None:
        at = lines.groupBy("file", "line").agg(F.bool_or("covered").alias("c_line"))
        f = f.join(at, ["file", "line"], "left")
        status = F.coalesce(status, F.when(props & F.col("c_line").isNotNull(), F.when(F.col("c_line"), "executed").otherwise("never")))
    guess = F.when(funs & (F.col("visibility") == "Private"), "High").when(F.col("kind").isin("Parameter", "Import"), "High").otherwise("Medium")
    f = f.withColumn("status", status)
    told = F.when(hit, "Confirmed").when(F.col("status") == "never", "Confirmed").when(F.col("status") == "executed", "Low").otherwise(guess)
    text = F.when(hit, "confirmed by the shrinker").when(F.col("status") == "never", "never executed").when(F.col("status") == "executed", "executed in a run")
    f = f.withColumns({"confidence": told, "runtime_confirmed": ~hit & F.coalesce(F.col("status") == "never", F.lit(False)), "notes": note(text.isNotNull(), text)})
    return f.select(*noted(found).columns, "runtime_confirmed")


def runtime_dead(live: DataFrame, symbols: DataFrame) -> DataFrame:
    """(decl_id) of live types and functions that no run executed: by full name, else by the end of it."""
    marked = live.where("kind in ('Class', 'Object', 'Function', 'Method')").withColumns({"confidence": F.lit("High"), "line": F.col("line")})
    return hybrid(marked, None, symbols).where("runtime_confirmed").select("decl_id")


def inline_ignore(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings without those that a directive with a reason ignores, on their line or the one above; a directive without a reason gives a note.

    ``lines`` is (file, line, text).  A directive on the line itself comes first.
    """
    d = lines.where(F.col("text").rlike(DIRECTIVE)).select("file", "line", F.trim(F.regexp_extract("text", DIRECTIVE, 1)).alias("reason"))
    here = d.select("file", "line", F.col("reason").alias("r_own"))
    above = d.select("file", (F.col("line") + 1).alias("line"), F.col("reason").alias("r_above"))
    f = noted(found).join(here, ["file", "line"], "left").join(above, ["file", "line"], "left").withColumn("r", F.coalesce("r_own", "r_above"))
    f = f.where(F.col("r").isNull() | (F.col("r") == ""))
    return f.withColumn("notes", note(F.col("r") == "", F.lit("a directive without a reason"))).select(noted(found).columns)


def test_mention(found: DataFrame, words: DataFrame) -> DataFrame:
    """Findings outside tests with a note where a test file has their name; ``words`` is (word) of all test files."""
    w = words.select(F.col("word").alias("name")).distinct().withColumn("said", F.lit(True))
    f = noted(found).join(w, "name", "left")
    return f.withColumn("notes", note(F.col("said") & (F.col("source_set") != "test"), F.lit("still referenced by tests"))).select(noted(found).columns)


def file_suppression(found: DataFrame, headers: DataFrame) -> DataFrame:
    """Findings a notch lower, with a note, where their file's header suppresses their code or its family; none goes.

    ``headers`` is (file, names), the words that the header's suppressions name;
    case doesn't matter.  Only Kotlin files have such headers.
    """
    names = headers.select("file", F.transform("names", lambda n: F.lower(n)).alias("names"))
    f = noted(found).join(names, "file", "left")
    family = F.array(F.lower("code"))
    for code, words in FAMILY.items():
        family = F.when(F.col("code") == code, F.array(F.lower("code"), *[F.lit(w.lower()) for w in words])).otherwise(family)
    hit = F.coalesce(F.arrays_overlap("names", family), F.lit(False)) & F.col("file").rlike(r"\.kts?$")
    return f.withColumn("hit", hit).withColumns({"notes": note(F.col("hit"), F.lit("file suppressed")), "confidence": lower_if(F.col("hit"))}).select(noted(found).columns)


def risk(found: DataFrame, literals: DataFrame, marked: DataFrame) -> DataFrame:
    """Findings with their risk: High where the name is a word of a string literal (and a notch lower) or an annotation keeps it by name, Medium in files with signs of reflection.

    ``literals`` is (word), ``marked`` (file).
    """
    soft = literals.select(F.col("word").alias("name")).distinct().withColumn("soft", F.lit(True))
    signs = marked.select("file").distinct().withColumn("signs", F.lit(True))
    f = noted(found).join(soft, "name", "left").join(signs, "file", "left")
    level = F.when(F.col("soft"), "High").when(F.col("anns").rlike("|".join(KEPT_BY_NAME)), "High").when(F.col("signs"), "Medium").otherwise("Low")
    return f.withColumns({"risk": level, "confidence": lower_if(F.col("soft")), "notes": note(F.col("soft"), F.lit("name in a string literal"))}).select(*noted(found).columns, "risk")


KEYS = ["file", "name", "kind"]


def baseline_new(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that the baseline doesn't have."""
    return drift_anti(found, baseline, KEYS)


def baseline_prune(baseline: DataFrame, found: DataFrame) -> DataFrame:
    """Baseline entries that still have a finding."""
    return drift_semi(baseline, found, KEYS)


def ratchet(found: DataFrame, baseline: DataFrame) -> tuple[bool, DataFrame]:
    """Whether nothing is new, and the baseline to keep: the pruned one, or the old one if something is new."""
    if not baseline_new(found, baseline).isEmpty():
        return False, baseline
    return True, baseline_prune(baseline, found)


def raised(baseline: DataFrame, decls: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, by, file, line): references to what the baseline has as dead; full names must agree where both have one."""
    bare = baseline.where("fqn is null").select("name").distinct()
    full = baseline.where("fqn is not null").select("name", "fqn").distinct()
    d = decls.select("name", "fqn", F.col("decl_id").alias("dst"))
    # names first: pairs of a name and its many namesakes are never made
    rest = d.join(bare, "name", "left_anti")
    hit = d.join(bare, "name", "left_semi").unionByName(rest.join(full, ["name", "fqn"], "left_semi")).unionByName(rest.where("fqn is null").join(full.select("name"), "name", "left_semi")).select("name", "dst")
    by = decls.select(F.col("decl_id").alias("src"), F.col("name").alias("by"), "file", "line")
    return edges.select("src", "dst").join(hit, "dst").select("src", "name").distinct().join(by, "src").select("name", "by", "file", "line").distinct()
