"""Fixpoints over (src, dst) edges: reachability, closures, paths, cycles.

Every hop joins only the nodes that the last hop found (semi-naive) and is
written to the shared folder, so the plan of a hop stays small and a lost
executor costs one hop.  Graphs below a checked size are closed in one task.
Node ids may be of any type with an order.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.scratch import drop, shared_dir, stash
from fathom.operators import small
from fathom.operators.small import fits, in_one_task

#: Rounds of trimming before a colouring.
TRIMS = 3


def ready(edges: DataFrame) -> DataFrame:
    """(node, dst) of the edges, written once, for several closures over them."""
    if getattr(edges, "_fathom_ready", False):
        return edges
    out = stash(edges.select(F.col("src").alias("node"), "dst").where("node is not null and dst is not null").distinct())
    out._fathom_ready = True
    return out


def reach(seeds: DataFrame, edges: DataFrame, avoid: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """(node, hop): everything reachable from ``seeds`` (first column) with its least number of hops.

    Nodes of ``avoid`` (first column) are never entered, not even as seeds.
    Null nodes are passed over.  ``edges`` are (src, dst), or what ``ready`` made of
    them.  A graph of at most ``rows`` rows is closed in one task.
    """
    spark = seeds.sparkSession
    e = ready(edges)
    start = seeds.select(F.col(seeds.columns[0]).alias("node")).where("node is not null").distinct()
    blocked = None if avoid is None else stash(avoid.select(F.col(avoid.columns[0]).alias("node")).distinct())
    if fits(e, *([] if blocked is None else [blocked]), rows=rows):
        row = lambda k, df, b: df.select(F.lit(k).alias("t"), F.col("node").alias("a"), b.alias("b"))
        none = F.lit(None).cast(e.schema["dst"].dataType)
        every = row(0, e, F.col("dst")).unionByName(row(1, start, none))
        if blocked is not None:
            every = every.unionByName(row(2, blocked, none))
        out = stash(in_one_task(every, small.reach, f"node {e.schema['dst'].dataType.simpleString()}, hop int"))
    else:
        base = f"{shared_dir(spark)}/reach/{uuid.uuid4().hex}"
        new, paths = start, []
        while True:
            if blocked is not None:
                new = new.join(blocked, "node", "left_anti")
            hop = len(paths)
            path = f"{base}/{hop}"
            new = new.select(F.col("node").cast(e.schema["dst"].dataType).alias("node"), F.lit(hop).alias("hop"))
            new.write.parquet(path)
            paths.append(path)
            # the types are known: no job to look them up in the files of every hop
            read = spark.read.schema(new.schema)
            frontier = read.parquet(path)
            if frontier.isEmpty():
                break
            seen = read.parquet(*paths).select("node")
            new = frontier.join(e, "node").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        out = read.parquet(*paths)
    if e is not edges:
        drop(e)
    drop(blocked)
    return out


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def child_edges(decls: DataFrame) -> DataFrame:
    """Edges from parent to child."""
    return decls.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("decl_id").alias("dst"))


def with_members(targets: DataFrame, decls: DataFrame) -> DataFrame:
    """(node): the targets and all that is declared inside them."""
    return reach(targets, child_edges(decls)).select("node")


def ancestors(nodes: DataFrame, decls: DataFrame) -> DataFrame:
    """(node): the nodes and all that encloses them."""
    return reach(nodes, reversed_edges(child_edges(decls))).select("node")


def ancestor_seeds(found: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node) of ``found`` that may bring their ancestors to life: reached without ambiguous references, or never referenced."""
    strict = reach(roots, edges.where("not ambiguous")).select("node")
    free = found.select("node").join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    return found.select("node").join(strict.unionByName(free).distinct(), "node", "left_semi")


def standard_reach(roots: DataFrame, decls: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): two rounds of references, ancestors of seeds in between, members after each; not a full fixpoint."""
    e = ready(edges)
    wide = enhanced_reach(roots, decls, edges, e)
    again = reach(wide, e).select("node")
    drop(e)
    return with_members(again, decls).distinct()


def enhanced_reach(roots: DataFrame, decls: DataFrame, edges: DataFrame, prepared: DataFrame | None = None) -> DataFrame:
    """(node): references, ancestors of seeds, then members to the last; references of those members aren't followed."""
    first = reach(roots, edges if prepared is None else prepared).select("node")
    up = ancestors(ancestor_seeds(first, roots, edges), decls)
    return with_members(first.unionByName(up).distinct(), decls).distinct()


SERIAL_NAMES = "ColumnInfo Entity JsonField JsonProperty Parcelable Parcelize PrimaryKey Serializable SerializedName".split()
SERIAL_METHODS = "createFromParcel describeContents newArray readFromParcel readObject readObjectNoData readResolve writeObject writeReplace writeToParcel".split()


def serialized(anns: str = "anns", panns: str = "panns", psupers: str = "psupers") -> Column:
    """Whether a declaration is read or written by serialisation: its annotation, a field of such a type, or a method by its name."""
    marks = "|".join(SERIAL_NAMES)
    kin = F.col(panns).rlike(marks) | F.col(psupers).rlike(r"(^|[. ])(Serializable|Parcelable|Externalizable)($|[ <(])")
    return F.coalesce(F.col(anns).rlike(marks) | (F.col("kind").isin("Property", "Field") & kin) | (F.col("kind").isin("Function", "Method") & F.col("name").isin(SERIAL_METHODS)), F.lit(False))


def simple_supers(supers: str = "supers") -> Column:
    """Simple names of the super types in a column of them: no package, type arguments or constructor call."""
    bare = F.regexp_replace(supers, r"[<(][^ ]*", "")
    return F.transform(F.array_remove(F.split(bare, " +"), ""), lambda x: F.element_at(F.split(x, r"\."), -1))


def name_nodes(sources: DataFrame, targets: DataFrame, *ids: DataFrame) -> DataFrame:
    """(name, via) of the names that both sides have: a number for each that is none of the ``ids`` (frames of whole numbers).

    The numbers are hashes, and others are tried should one be taken.
    """
    names = stash(sources.select("name").distinct().join(targets.select("name").distinct(), "name", "left_semi"))
    taken = reduce(DataFrame.unionByName, [df.select(F.col(c).cast("bigint").alias("via")) for df in ids for c in df.columns])
    for salt in count():
        via = stash(names.select("name", F.xxhash64("name", F.lit(salt)).alias("via")))
        if not via.groupBy("via").count().where("count > 1").count() and not taken.join(via, "via", "left_semi").count():
            drop(names)
            return via
        drop(via)


def by_name(sources: DataFrame, targets: DataFrame, via: DataFrame) -> DataFrame:
    """(src, dst) that lead from every row of ``sources`` (src, name) to all of ``targets`` (name, dst) of its name, by the name's node.

    So edges grow with the rows, not with the pairs of one name.
    """
    return sources.join(via, "name").select("src", F.col("via").alias("dst")).unionByName(targets.join(via, "name").select(F.col("via").alias("src"), "dst"))


def life_edges(roots: DataFrame, decls: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst): who lives as soon as another does, references aside; and (name, via), the nodes of names that some of them lead by.

    From a type to its members that overriding, serialisation, delegation or
    coroutines keep, to its companion, and to its constructors if it is created
    anywhere or a root; from a sealed type or an interface to what names it as super
    type, by the name's node.
    """
    owner = decls.select(F.col("decl_id").alias("parent_id"), F.col("anns").alias("panns"), F.col("supers").alias("psupers"))
    made = edges.where("kind in ('Call', 'Instantiation')").select(F.col("dst").alias("parent_id")).unionByName(roots.select(F.col(roots.columns[0]).alias("parent_id"))).distinct()
    kept = (
        F.contains("anns", F.lit("Override"))
        | F.arrays_overlap(F.split("mods", " "), F.array(F.lit("override")))
        | serialized()
        | ((F.col("kind") == "Object") & F.contains("mods", F.lit("companion")))
        | ((F.col("kind") == "Property") & F.contains("mods", F.lit("delegated")))
        | (F.col("kind").isin("Function", "Method") & F.contains("mods", F.lit("suspend")))
        | F.contains("name", F.lit("Flow"))
        | F.col("anns").rlike("FlowPreview|ExperimentalCoroutinesApi")
    )
    # only these can be kept, whatever the parent is
    some = decls.withColumns({"panns": F.lit(""), "psupers": F.lit("")}).where(kept | F.col("kind").isin("Property", "Field", "Constructor")).drop("panns", "psupers")
    members = some.join(owner, "parent_id")
    blessed = members.where(kept).unionByName(members.where("kind = 'Constructor'").join(made, "parent_id", "left_semi"))
    open_ = decls.where("kind = 'Interface' or (kind = 'Class' and language = 'Kotlin' and contains(mods, 'sealed'))").select("name", F.col("decl_id").alias("src"))
    named = decls.where("supers <> ''").select(F.explode(simple_supers()).alias("name"), F.col("decl_id").alias("dst"))
    via = name_nodes(open_, named, decls.select("decl_id", "parent_id"), edges.select("src", "dst"), roots.select(roots.columns[0]))
    return blessed.select(F.col("parent_id").alias("src"), F.col("decl_id").alias("dst")).unionByName(by_name(open_, named, via)), via


def deep_reach(roots: DataFrame, decls: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): references, ancestors of seeds, what fields of reachable types refer to, and then references and ``life_edges`` until nothing grows.  Ids are whole numbers."""
    first = reach(roots, edges).select("node")
    up = ancestors(ancestor_seeds(first, roots, edges), decls)
    live = stash(first.unionByName(up).distinct())
    types = decls.where("kind in ('Class', 'Interface', 'Object', 'Enum', 'TypeAlias', 'Annotation')").select(F.col("decl_id").alias("node"))
    fields = decls.where("kind in ('Property', 'Field') and parent_id is not null").select(F.col("parent_id").alias("node"), "decl_id")
    own = fields.join(types.join(live, "node", "left_semi"), "node", "left_semi").select(F.col("decl_id").alias("src"))
    followed = edges.join(own, "src", "left_semi").select(F.col("dst").alias("node"))
    life, via = life_edges(roots, decls, edges)
    every = edges.select("src", "dst").unionByName(life)
    out = stash(reach(live.unionByName(followed).distinct(), every).select("node").join(via.select(F.col("via").alias("node")), "node", "left_anti"))
    drop(via)
    drop(live)
    return out


def kill_list(targets: DataFrame, roots: DataFrame, decls: DataFrame, edges: DataFrame) -> DataFrame:
    """(node) that falls with ``targets``: what they alone keep alive.  Ambiguous references kill nothing but keep alive."""
    doomed = with_members(targets, decls)
    fall = reach(doomed, edges.where("not ambiguous")).select("node")
    alive = reach(roots, edges, avoid=doomed).select("node")
    return fall.join(alive, "node", "left_anti")


def why_alive(targets: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, hop, pred) of the targets that roots reach: least hops, and the least node one hop nearer."""
    found = reach(roots, edges)
    near = found.select(F.col("node").alias("src"), F.col("hop").alias("before"))
    step = found.join(targets.select(F.col(targets.columns[0]).alias("node")), "node", "left_semi").join(edges.select("src", F.col("dst").alias("node")), "node", "left")
    step = step.join(near, "src", "left").withColumn("p", F.when(F.col("before") == F.col("hop") - 1, F.col("src")))
    return step.groupBy("node", "hop").agg(F.min("p").alias("pred"))


def alive_path(targets: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, path) of the targets that roots reach: a shortest path from a root, of several the least node at each step back."""
    found = reach(roots, edges)
    near = found.select(F.col("node").alias("src"), F.col("hop").alias("before"))
    step = edges.select("src", F.col("dst").alias("at")).distinct().join(near, "src").join(found.select(F.col("node").alias("at"), "hop"), "at").where("before = hop - 1")
    back = stash(step.groupBy("at").agg(F.min("src").alias("pred")))
    open_ = found.join(targets.select(F.col(targets.columns[0]).alias("node")).distinct(), "node", "left_semi")
    open_ = open_.select("node", F.col("node").alias("at"), "hop", F.array("node").alias("path"))
    out, stashes = open_.where("hop = 0").select("node", "path"), [back]
    open_ = open_.where("hop > 0")
    while not open_.isEmpty():
        level = stash(open_.join(back, "at").select("node", F.col("pred").alias("at"), (F.col("hop") - 1).alias("hop"), F.array_prepend("path", F.col("pred")).alias("path")))
        stashes.append(level)
        out = out.unionByName(level.where("hop = 0").select("node", "path"))
        open_ = level.where("hop > 0")
    got = stash(out)
    for x in stashes:
        drop(x)
    return got


def depth(nodes: DataFrame, parent: str = "parent_id", node: str = "decl_id") -> DataFrame:
    """(node, depth) of a forest: 0 at the top.  Nodes on a cycle of parents have none."""
    top = nodes.where(F.col(parent).isNull()).select(F.col(node).alias("node"))
    down = nodes.where(F.col(parent).isNotNull()).select(F.col(parent).alias("src"), F.col(node).alias("dst"))
    return reach(top, down).select("node", F.col("hop").alias("depth"))


def inheritance_depth(decls: DataFrame, most: int = 16) -> DataFrame:
    """(node, depth): longest chain of supertypes in the corpus, by simple name, from each type, counted up to ``most``.

    Types on a cycle, and what extends them, have depth ``most``; so there are at
    most that many steps, each over the pairs of names that are so far apart.
    """
    links = stash(
        decls.where("supers <> ''").select("name", F.explode(simple_supers()).alias("up")).distinct().join(decls.select(F.col("name").alias("up")).distinct(), "up", "left_semi")
    )
    step, level = links.select(F.col("name").alias("up"), F.col("up").alias("top")), links
    levels = []
    while len(levels) < most and not level.isEmpty():
        levels.append(level)
        level = stash(level.join(step, "up").select("name", F.col("top").alias("up")).distinct())
    found = decls.select("name", F.lit(0).alias("d")).distinct()
    for k, x in enumerate(levels, 1):
        found = found.unionByName(x.select("name", F.lit(k).alias("d")))
    by = stash(found.groupBy("name").agg(F.max("d").alias("depth")))
    for x in [*levels[1:], level, links]:
        drop(x)
    return decls.join(by, "name").select(F.col("decl_id").alias("node"), "depth")


def zombie_pairs(edges: DataFrame, alive: DataFrame) -> DataFrame:
    """(a, b), a < b: unreachable nodes that refer to each other."""
    live = alive.select(F.col(alive.columns[0]).alias("src"))
    dead = edges.select("src", "dst").distinct().join(live, "src", "left_anti")
    dead = dead.join(live.withColumnRenamed("src", "dst"), "dst", "left_anti")
    back = dead.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return dead.join(back, ["src", "dst"], "left_semi").where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def dead_cycles(edges: DataFrame, alive: DataFrame, kinds: DataFrame) -> DataFrame:
    """(component, members): cycles of two or more without a reachable member or a reference from outside.

    ``kinds`` are (node, matters); a cycle without a member that matters is passed over.
    """
    parts = strong_components(edges)
    at = lambda k: parts.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}"))
    outside = edges.select("src", "dst").join(at("dst"), "dst").join(at("src"), "src", "left").where(~F.col("c_src").eqNullSafe(F.col("c_dst")))
    reached = parts.join(alive.select(F.col(alive.columns[0]).alias("node")), "node", "left_semi")
    bad = outside.select(F.col("c_dst").alias("component")).unionByName(reached.select("component")).distinct()
    left = parts.join(bad, "component", "left_anti").join(kinds, "node", "left")
    g = left.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.count_if("matters").alias("n"))
    return g.where("n > 0").select("component", "members")


def _spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the greatest node that reaches each node, itself included."""
    cur = stash(nodes.select("node", F.col("node").alias("label"), F.lit(True).alias("moved")))
    while True:
        sent = cur.where("moved").join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max("label").alias("got"))
        better = F.col("got").isNotNull() & (F.col("got") > F.col("label"))
        new = stash(cur.join(sent, "node", "left").select("node", F.greatest("label", "got").alias("label"), F.coalesce(better, F.lit(False)).alias("moved")))
        drop(cur)
        cur = new
        if cur.where("moved").isEmpty():
            return cur.select("node", "label")


def strong_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) of nodes on a cycle of two or more; the component is its greatest node.

    Colouring: a node's colour is the greatest node that reaches it; the nodes
    of a colour that reach that node are its component.  What is left goes
    another round; nodes without an edge in or out are trimmed a few times
    before each.  A graph of at most ``rows`` rows is done in one task.
    """
    e = stash(edges.select("src", "dst").where("src <> dst").distinct())
    if fits(e, rows=rows):
        kind = e.schema["src"].dataType.simpleString()
        out = stash(in_one_task(e, small.strong, f"node {kind}, component {kind}"))
        drop(e)
        return out
    out = None
    while True:
        for _ in range(TRIMS):
            kept = stash(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            same = kept.count() == e.count()
            drop(e)
            e = kept
            if same:
                break
        if e.isEmpty():
            break
        nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
        colour = stash(_spread(nodes, e))
        own = e.join(colour.select(F.col("node").alias("src"), F.col("label").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("cd")), "dst")
        inner = own.where("cs = cd").select("src", "dst")
        heads = colour.where("node = label").select("node")
        back = reach(heads, reversed_edges(inner)).select("node")
        got = stash(colour.join(back, "node").select("node", F.col("label").alias("component")))
        out = got if out is None else out.unionByName(got)
        rest = e.join(got.select(F.col("node").alias("src")), "src", "left_anti").join(got.select(F.col("node").alias("dst")), "dst", "left_anti")
        e = stash(rest.select("src", "dst"))
    if out is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    big = out.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return out.join(big, "component", "left_semi").select("node", "component")
