"""From identifiers to edges: which declarations a reference means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.scratch import drop, stash
from fathom.operators import graph as G
from fathom.operators.joins import enclosing_span

TYPES = ["Class", "Interface", "Object", "Enum", "TypeAlias", "Annotation"]
#: Tiers: full names, then a file's imports in their order, then simple names.
FULL, IMPORTED, SIMPLE = 1, 2, 1 << 20


def place(decls: DataFrame, refs: DataFrame) -> DataFrame:
    """``refs`` with ``src``: the innermost declaration around them that is no parameter, else the first of the file."""
    spans = decls.where("kind <> 'Parameter'").select("file", "begin", "end", F.col("decl_id").alias("span_id"))
    first = decls.groupBy("file").agg(F.min_by("decl_id", F.struct("begin", "decl_id")).alias("head"))
    points = refs.select(F.col("ref_id").alias("point_id"), "file", "at")
    own = enclosing_span(points, spans, "file").withColumnRenamed("point_id", "ref_id")
    return refs.join(own, "ref_id").join(first, "file").withColumn("src", F.coalesce("span_id", "head")).drop("span_id", "head")


def dotted(refs: DataFrame, decls: DataFrame, path: str = "path") -> DataFrame:
    """(key columns of ``refs``..., dst): what a dotted path means: the longest full name that begins it, then members by name, parameters aside.

    ``refs`` has the path and any key columns.  There are as many steps as the
    longest rest has parts.
    """
    keys = [c for c in refs.columns if c != path]
    parts = F.split(path, r"\.")
    each = refs.select(*keys, parts.alias("parts"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("n", "fqn"))
    met = each.join(decls.select("fqn", F.col("decl_id").alias("dst")), "fqn")
    best = F.max("n").over(Window.partitionBy(*keys, "parts"))
    at = stash(met.withColumn("m", best).where("n = m").select(*keys, F.expr("slice(parts, n + 2, size(parts))").alias("rest"), "dst"))
    members = decls.where("kind <> 'Parameter' and parent_id is not null").select(F.col("parent_id").alias("dst"), "name", F.col("decl_id").alias("next"))
    out, stashes = at.where("size(rest) = 0").select(*keys, "dst"), [at]
    open_ = at.where("size(rest) > 0")
    while not open_.isEmpty():
        step = stash(open_.withColumn("name", F.col("rest")[0]).join(members, ["dst", "name"]).select(*keys, F.expr("slice(rest, 2, size(rest))").alias("rest"), F.col("next").alias("dst")))
        stashes.append(step)
        out = out.unionByName(step.where("size(rest) = 0").select(*keys, "dst"))
        open_ = step.where("size(rest) > 0")
    got = stash(out.distinct())
    for x in stashes:
        drop(x)
    return got


def resolve(decls: DataFrame, refs: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst, kind, name, ambiguous): every declaration that a reference means, in the first tier that has one.

    Tiers: carriers of the qualified name; the file's imports in order (the name
    itself, or below a star; an alias binds even to nothing); all declarations
    of the simple name, parameters only inside what declares them.  A call of an
    accessor also means the property, and a call of a type in the first two tiers
    its constructors.  A reference is ambiguous if it means several, counted
    before those edges go that a declaration has to itself or, across files, to a
    property of its own name.
    """
    r = stash(place(decls, refs))
    full = dotted(r.where("qualified is not null").select("ref_id", F.col("qualified").alias("path")), decls).withColumn("tier", F.lit(FULL))
    alias = F.regexp_extract("path", r"\sas\s+(\w+)$", 1)
    bare = F.regexp_replace("path", r"\sas\s+\w+$", "")
    i = imports.withColumns({"alias": alias, "bare": bare})
    last = F.when(F.col("alias") != "", F.col("alias")).otherwise(F.element_at(F.split("bare", r"\."), -1))
    named = i.where(~F.col("bare").endswith(".*")).select("file", F.col("ord"), last.alias("name"), F.col("bare").alias("target"), (F.col("alias") != "").alias("bound"))
    short = r.select("ref_id", "file", "name")
    by_name = short.join(named, ["file", "name"]).select("ref_id", "ord", "target", "bound")
    stars = i.where(F.col("bare").endswith(".*")).select("file", "ord", F.expr("substring(bare, 1, length(bare) - 1)").alias("package"))
    by_star = short.join(stars, "file").select("ref_id", "ord", F.concat("package", "name").alias("target"), F.lit(False).alias("bound"))
    wanted = stash(by_name.unionByName(by_star))
    hit = dotted(wanted.select("ref_id", "ord", F.col("target").alias("path")), decls)
    imported = hit.select("ref_id", "dst", (F.col("ord") + IMPORTED).alias("tier"))
    # an alias that means nothing ends the search
    nothing = wanted.where("bound").select("ref_id", "ord").distinct().join(hit.select("ref_id", "ord"), ["ref_id", "ord"], "left_anti")
    nothing = nothing.select("ref_id", F.lit(None).cast("bigint").alias("dst"), (F.col("ord") + IMPORTED).alias("tier"))
    early = full.select("ref_id", "dst", "tier").unionByName(imported).unionByName(nothing)
    types = decls.where(F.col("kind").isin(TYPES)).select(F.col("decl_id").alias("dst"))
    made = decls.where("kind = 'Constructor'").select(F.col("parent_id").alias("dst"), F.col("decl_id").alias("made"))
    calls = r.where("kind in ('Call', 'Instantiation')").select("ref_id")
    opened = early.join(calls, "ref_id", "left_semi").join(types, "dst", "left_semi").join(made, "dst").select("ref_id", F.col("made").alias("dst"), "tier")
    plain = decls.where("kind <> 'Parameter'").select("name", F.col("decl_id").alias("dst"))
    simple = r.select("ref_id", "name").join(plain, "name").select("ref_id", "dst", F.lit(SIMPLE).alias("tier"))
    params = decls.where("kind = 'Parameter'").select("name", F.col("decl_id").alias("dst"), F.col("parent_id").alias("home"))
    above = stash(_homes(r, decls))
    inside = r.select("ref_id", "name", "src").join(params, "name").join(above, ["src", "home"], "left_semi").select("ref_id", "dst", F.lit(SIMPLE).alias("tier"))
    prop = F.regexp_extract("name", r"^(?:get|set|is)([A-Z]\w*)$", 1)
    prop = F.when(prop.rlike("^[A-Z][A-Z0-9_]*$") & (F.length(prop) > 1), prop).otherwise(F.concat(F.lower(F.substring(prop, 1, 1)), prop.substr(F.lit(2), F.length(prop))))
    asked = r.where("kind = 'Call'").select("ref_id", prop.alias("name")).where("name <> ''")
    bridge = asked.join(decls.where("language = 'Kotlin' and kind in ('Property', 'Field')").select("name", F.col("decl_id").alias("dst")), "name").select("ref_id", "dst", F.lit(SIMPLE).alias("tier"))
    every = early.unionByName(opened).unionByName(simple).unionByName(inside).unionByName(bridge).distinct()
    w = Window.partitionBy("ref_id")
    first = every.withColumn("best", F.min("tier").over(w)).where("tier = best and dst is not null")
    first = first.withColumn("ambiguous", F.count(F.lit(1)).over(w) > 1).select("ref_id", "dst", "ambiguous")
    own = decls.select(F.col("decl_id").alias("src"), F.col("name").alias("s_name"), F.col("file").alias("s_file"))
    met = decls.select(F.col("decl_id").alias("dst"), F.col("name").alias("d_name"), F.col("file").alias("d_file"), F.col("kind").alias("d_kind"))
    e = first.join(r.select("ref_id", "src", "kind", "name"), "ref_id").where("src <> dst").join(own, "src").join(met, "dst")
    e = e.where(~((F.col("s_name") == F.col("d_name")) & (F.col("s_file") != F.col("d_file")) & F.col("d_kind").isin("Property", "Field")))
    out = stash(e.select("src", "dst", "kind", "name", "ambiguous"))
    for x in (r, wanted, full, hit, above):
        drop(x)
    return out


def _homes(refs: DataFrame, decls: DataFrame) -> DataFrame:
    """(src, home): each declaration that refers to something, with itself and all that encloses it."""
    up = decls.select(F.col("decl_id").alias("home"), F.col("parent_id").alias("next"))
    level = stash(refs.select("src", F.col("src").alias("home")).distinct())
    out, levels = level, [level]
    while True:
        level = stash(level.join(up, "home").where("next is not null").select("src", F.col("next").alias("home")))
        levels.append(level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.distinct()
