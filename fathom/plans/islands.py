"""Dead clusters, and islands: declarations that only keep each other alive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.scratch import drop, stash
from fathom.operators import graph as G
from fathom.operators.components import connected_components
from fathom.plans.roots import is_word

#: Annotations that bring nothing to life.
BENIGN = "Composable Deprecated JvmField JvmOverloads JvmStatic NonNull Nullable Override Suppress SuppressLint SuppressWarnings Throws".split()
TESTISH = r"/src/[^/]*[Tt][Ee][Ss][Tt][^/]*/|/(test|androidTest|sharedTest)/|Tests?\.(kt|kts|java)$"
MOST = 8


def dead_clusters(dead: DataFrame, decls: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of all dead declarations (first column) and what is inside them; a lone one is its own component.

    Two are together if one refers to the other, ambiguous or not, or is its parent.
    """
    nodes = stash(G.with_members(dead, decls).distinct())
    inside = lambda k: nodes.select(F.col("node").alias(k))
    links = edges.select("src", "dst").unionByName(G.child_edges(decls)).join(inside("src"), "src", "left_semi").join(inside("dst"), "dst", "left_semi")
    label = connected_components(links.select("src", "dst"))
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def outermost(clusters: DataFrame, decls: DataFrame) -> DataFrame:
    """(node, component, top): whether the parent is outside of the cluster."""
    own = clusters.join(decls.select(F.col("decl_id").alias("node"), "parent_id"), "node")
    up = clusters.select(F.col("node").alias("parent_id"), F.col("component").alias("p_component"))
    return own.join(up, "parent_id", "left").select("node", "component", (~F.col("component").eqNullSafe(F.col("p_component"))).alias("top"))


def eligible(decls: DataFrame) -> DataFrame:
    """(node) that may belong to an island: no file, package, import or enum case, no test, and nothing that annotations, overriding or the platform could call."""
    words = F.filter(F.split(F.regexp_replace("anns", r"\([^)]*\)", ""), " +"), lambda a: (a != "") & ~a.rlike("|".join(BENIGN)))
    parent = decls.select(F.col("decl_id").alias("parent_id"), F.col("supers").alias("psupers"))
    d = decls.join(parent, "parent_id", "left")
    called = (F.col("language") == "Java") & (F.col("kind") == "Method") & (F.coalesce("psupers", F.lit("")) != "")
    open_ = ~F.col("kind").isin("File", "Package", "Import", "EnumCase") & ~F.col("file").rlike(TESTISH)
    return d.where(open_ & (F.size(words) == 0) & ~is_word("mods", "override") & ~called).select(F.col("decl_id").alias("node"))


def islands(decls: DataFrame, edges: DataFrame, roots: DataFrame, rooted_names: DataFrame | None = None, literals: DataFrame | None = None, keeps: list[str] | None = None, most: int = MOST) -> DataFrame:
    """(component, members, declarations, lines, test_only, keep_covered) of islands of 2 to ``most`` outermost members.

    Alive are roots, ``rooted_names`` (name; words outside of any declaration),
    what lies in modules of injection, and what is referred to from where no
    eligible declaration encloses; and from there on, until nothing grows, what
    the living refer to, what words of their string literals (``literals``:
    decl_id, word) name, and what encloses them.  What tests refer to is marked,
    not revived.  ``keeps`` are the keep rules' expressions.
    """
    ok = stash(eligible(decls))
    d = stash(decls.select("decl_id", "parent_id", "name").join(ok, F.col("decl_id") == F.col("node"), "left_semi"))
    e = edges.where("kind <> 'Import'").select("src", "dst")
    tests = decls.where(F.col("file").rlike(TESTISH)).select("decl_id")
    barred = decls.join(ok, F.col("decl_id") == F.col("node"), "left_anti").select("decl_id", "parent_id")
    # the nearest eligible ancestor of what isn't eligible itself
    up, found = barred.select("decl_id", F.col("parent_id").alias("at")).where("at is not null"), None
    parents = decls.select(F.col("decl_id").alias("at"), F.col("parent_id").alias("next"))
    while not up.isEmpty():
        hit = up.join(ok, F.col("at") == F.col("node"), "left_semi")
        found = hit if found is None else found.unionByName(hit)
        up = stash(up.join(ok, F.col("at") == F.col("node"), "left_anti").join(parents, "at").where("next is not null").select("decl_id", F.col("next").alias("at")))
    outside = e.join(barred.select(F.col("decl_id").alias("src")), "src", "left_semi").join(tests.select(F.col("decl_id").alias("src")), "src", "left_anti")
    deferred, loose = None, outside
    if found is not None:
        near = stash(found.select(F.col("decl_id").alias("src"), "at"))
        deferred = outside.join(near, "src").select(F.col("at").alias("src"), "dst")
        loose = outside.join(near, "src", "left_anti")
    modules = decls.where(F.contains("anns", F.lit("Module"))).select(F.col("decl_id").alias("parent_id"))
    seeds = roots.select("decl_id").unionByName(loose.select(F.col("dst").alias("decl_id"))).unionByName(d.join(modules, "parent_id", "left_semi").select("decl_id"))
    if rooted_names is not None:
        seeds = seeds.unionByName(d.join(rooted_names.select("name").distinct(), "name", "left_semi").select("decl_id"))
    seeds = seeds.join(ok, F.col("decl_id") == F.col("node"), "left_semi")
    every = e.unionByName(G.reversed_edges(G.child_edges(decls)))
    if deferred is not None:
        every = every.unionByName(deferred)
    if literals is not None:
        said = literals.select(F.col("decl_id").alias("src"), F.col("word").alias("name")).distinct()
        words = d.select("name", F.col("decl_id").alias("dst"))
        every = every.unionByName(G.by_name(said, words, G.name_nodes(said, words, decls.select("decl_id", "parent_id"), e, literals.select("decl_id"))))
    alive = G.reach(seeds, every).select("node")
    dead = ok.join(alive, "node", "left_anti")
    top = stash(outermost(dead_clusters(dead, decls, edges), decls))
    sizes = top.groupBy("component").agg(F.count_if("top").alias("members"), F.count(F.lit(1)).alias("declarations")).where(F.col("members").between(2, most))
    own = top.join(sizes.select("component"), "component", "left_semi").join(decls.select(F.col("decl_id").alias("node"), "lines", "fqn"), "node")
    tested = edges.join(tests.select(F.col("decl_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().withColumn("tested", F.lit(True))
    covered = F.col("fqn").rlike("|".join(f"(?:{k})" for k in keeps)) if keeps else F.lit(False)
    marks = own.join(tested, "node", "left").groupBy("component").agg(
        F.sum(F.when(F.col("top"), F.col("lines") + 1).otherwise(0)).alias("lines"), F.bool_or(F.coalesce("tested", F.lit(False))).alias("test_only"), F.bool_or(F.coalesce(covered, F.lit(False))).alias("keep_covered")
    )
    out = stash(sizes.join(marks, "component"))
    for x in (ok, d):
        drop(x)
    return out


def kept_alive_by(clusters: DataFrame, decls: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, by): names of the dead that refer to each member of ``clusters`` (node), sorted; a name equal to its own comes with file and line."""
    ids = clusters.select("node").distinct()
    e = edges.where("kind <> 'Import' and src <> dst").select("src", "dst")
    e = e.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    by = decls.select(F.col("decl_id").alias("src"), F.col("name").alias("s_name"), F.concat("name", F.lit(" ("), F.element_at(F.split("file", "/"), -1), F.lit(":"), "line", F.lit(")")).alias("place"))
    own = decls.select(F.col("decl_id").alias("dst"), "name")
    each = e.join(by, "src").join(own, "dst").select(F.col("dst").alias("node"), F.when(F.col("s_name") == F.col("name"), F.col("place")).otherwise(F.col("s_name")).alias("by"))
    return each.groupBy("node").agg(F.array_sort(F.collect_set("by")).alias("by"))
