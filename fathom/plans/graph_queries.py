"""Graph operators over the driver tables as code, and over a small cyclic graph of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import graph as G
from fathom.plans.memo import memo
from fathom.plans.model import SQL, project
from fathom.plans.registry import query, table

W = f"WITH RECURSIVE {SQL}"
FOUND = "found AS (SELECT decl_id AS node FROM roots UNION SELECT dst FROM edges JOIN found ON src = node)"
STRICT = "strict AS (SELECT decl_id AS node FROM roots UNION SELECT dst FROM edges JOIN strict ON src = node WHERE NOT ambiguous)"
UP = """seeds AS (SELECT node FROM found WHERE node IN (SELECT node FROM strict) OR node NOT IN (SELECT dst FROM edges)),
up AS (SELECT node FROM seeds UNION SELECT parent_id FROM decls JOIN up ON decl_id = node WHERE parent_id IS NOT NULL)"""
DOWN = "{name} AS (SELECT node FROM {base} UNION SELECT decl_id FROM decls JOIN {name} ON parent_id = node)"
TARGETS = "kind IN ('Class', 'Object') AND module = 'm3'"


@query("unreferenced_decls", f"{W} SELECT decl_id, name, file, line FROM decls WHERE decl_id NOT IN (SELECT dst FROM edges) AND decl_id NOT IN (SELECT decl_id FROM roots)")
def unreferenced_decls(spark, sf_dir):
    c = project(spark, sf_dir)
    d = c.decls.join(c.edges.select(F.col("dst").alias("decl_id")), "decl_id", "left_anti").join(c.roots, "decl_id", "left_anti")
    return d.select("decl_id", "name", "file", "line")


@query("unreferenced_orders", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unreferenced_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("reach", f"{W}, {FOUND} SELECT node FROM found")
def reach(spark, sf_dir):
    c = project(spark, sf_dir)
    return G.reach(c.roots, c.edges).select("node")


@query("reach_strict", f"{W}, {STRICT} SELECT node FROM strict")
def reach_strict(spark, sf_dir):
    c = project(spark, sf_dir)
    return G.reach(c.roots, c.edges.where("not ambiguous")).select("node")


@query("reach_avoiding", f"""{W}, found AS (SELECT decl_id AS node FROM roots WHERE decl_id NOT IN (SELECT decl_id FROM decls WHERE language = 'Java') UNION SELECT dst FROM edges JOIN found ON src = node WHERE dst NOT IN (SELECT decl_id FROM decls WHERE language = 'Java')) SELECT node FROM found""")
def reach_avoiding(spark, sf_dir):
    c = project(spark, sf_dir)
    return G.reach(c.roots, c.edges, avoid=c.decls.where("language = 'Java'")).select("node")


@query("with_members", f"{W}, t AS (SELECT decl_id AS node FROM decls WHERE {TARGETS}), {DOWN.format(name='m', base='t')} SELECT node FROM m")
def with_members(spark, sf_dir):
    c = project(spark, sf_dir)
    return G.with_members(c.decls.where(TARGETS), c.decls)


@query("ancestors", f"{W}, up AS (SELECT decl_id AS node FROM decls WHERE kind = 'Parameter' AND name = 'id' UNION SELECT parent_id FROM decls JOIN up ON decl_id = node WHERE parent_id IS NOT NULL) SELECT node FROM up")
def ancestors(spark, sf_dir):
    c = project(spark, sf_dir)
    return G.ancestors(c.decls.where("kind = 'Parameter' and name = 'id'"), c.decls)


@query("ancestor_seeds", f"{W}, {FOUND}, {STRICT}, {UP} SELECT node FROM seeds")
def ancestor_seeds(spark, sf_dir):
    c = project(spark, sf_dir)
    return G.ancestor_seeds(G.reach(c.roots, c.edges), c.roots, c.edges)


ENHANCED = f"{FOUND}, {STRICT}, {UP}, b1 AS (SELECT node FROM found UNION SELECT node FROM up), {DOWN.format(name='live', base='b1')}"


@query("reach_enhanced", f"{W}, {ENHANCED} SELECT DISTINCT node FROM live")
def reach_enhanced(spark, sf_dir):
    c = project(spark, sf_dir)
    return G.enhanced_reach(c.roots, c.decls, c.edges)


STANDARD = f"{ENHANCED}, again AS (SELECT node FROM live UNION SELECT dst FROM edges JOIN again ON src = node), {DOWN.format(name='std', base='again')}"


@query("reach_standard", f"{W}, {STANDARD} SELECT DISTINCT node FROM std")
def reach_standard(spark, sf_dir):
    c = project(spark, sf_dir)
    return G.standard_reach(c.roots, c.decls, c.edges)


def _listed(col: str, words: list[str]) -> str:
    return f"len(list_filter({words!r}, lambda w: contains({col}, w))) > 0"


#: Super types of each declaration by simple name.
SUPERS = """bases AS (SELECT decl_id, list_last(string_split(split_part(split_part(s, '<', 1), '(', 1), '.')) AS base FROM (SELECT decl_id, unnest(string_split(supers, ' ')) AS s FROM decls WHERE supers <> '') WHERE s <> '')"""
SERIAL = f"""(({_listed("c.anns", G.SERIAL_NAMES)}) OR c.kind IN ('Property', 'Field') AND (({_listed("p.anns", G.SERIAL_NAMES)}) OR list_has_any(list_transform(string_split(p.supers, ' '), lambda z: list_last(string_split(split_part(split_part(z, '<', 1), '(', 1), '.'))), ['Serializable', 'Parcelable', 'Externalizable']))
  OR c.kind IN ('Function', 'Method') AND c.name IN {tuple(G.SERIAL_METHODS)!r})"""
LIFE = f"""{SUPERS},
life AS (
  SELECT p.decl_id AS src, c.decl_id AS dst FROM decls c JOIN decls p ON c.parent_id = p.decl_id
  WHERE list_contains(string_split(c.mods, ' '), 'override') OR contains(c.anns, 'Override') OR coalesce({SERIAL}, FALSE) OR c.kind = 'Object' AND contains(c.mods, 'companion') OR c.kind = 'Property' AND contains(c.mods, 'delegated')
    OR c.kind IN ('Function', 'Method') AND contains(c.mods, 'suspend') OR contains(c.name, 'Flow') OR contains(c.anns, 'FlowPreview') OR contains(c.anns, 'ExperimentalCoroutinesApi')
    OR c.kind = 'Constructor' AND (p.decl_id IN (SELECT decl_id FROM roots) OR p.decl_id IN (SELECT dst FROM edges WHERE kind IN ('Call', 'Instantiation')))
  UNION ALL
  SELECT p.decl_id, b.decl_id FROM decls p JOIN bases b ON b.base = p.name WHERE p.kind = 'Interface' OR p.kind = 'Class' AND p.language = 'Kotlin' AND contains(p.mods, 'sealed'))"""
DEEP = f"""{FOUND}, {STRICT}, {UP}, b1 AS (SELECT node FROM found UNION SELECT node FROM up), {LIFE},
more AS (SELECT src, dst FROM edges UNION SELECT src, dst FROM life),
b2 AS (SELECT node FROM b1 UNION SELECT e.dst FROM edges e JOIN decls d ON d.decl_id = e.src JOIN decls t ON t.decl_id = d.parent_id AND t.kind IN ('Class', 'Interface', 'Object', 'Enum') WHERE d.kind IN ('Property', 'Field') AND d.parent_id IN (SELECT node FROM b1)),
deep AS (SELECT node FROM b2 UNION SELECT dst FROM more JOIN deep ON src = node)"""


def live(spark, sf_dir):
    """(node): what the deep analysis reaches, once a session."""
    c = project(spark, sf_dir)
    return memo(spark, sf_dir, "live", lambda: G.deep_reach(c.roots, c.decls, c.edges).distinct())


@query("reach_deep", f"{W}, {DEEP} SELECT DISTINCT node FROM deep")
def reach_deep(spark, sf_dir):
    return live(spark, sf_dir)


@query("unreachable_decls", f"""{W}, {DEEP} SELECT decl_id, name, kind, file, line, CASE WHEN decl_id IN (SELECT dst FROM edges) THEN 'only referenced from dead code' ELSE 'never referenced' END AS message
FROM decls WHERE decl_id NOT IN (SELECT node FROM deep) AND kind <> 'Parameter'""")
def unreachable_decls(spark, sf_dir):
    """Declarations that the deep analysis doesn't reach."""
    c = project(spark, sf_dir)
    alive = live(spark, sf_dir).select(F.col("node").alias("decl_id"))
    into = c.edges.select(F.col("dst").alias("decl_id")).distinct().withColumn("hit", F.lit(True))
    dead = c.decls.where("kind <> 'Parameter'").join(alive, "decl_id", "left_anti").join(into, "decl_id", "left")
    return dead.select("decl_id", "name", "kind", "file", "line", F.when(F.col("hit"), "only referenced from dead code").otherwise("never referenced").alias("message"))


KILL_TARGETS = "kind = 'Class' AND decl_id IN (SELECT decl_id FROM roots) AND source_set = 'debug'"


@query("kill_list", f"""{W}, t AS (SELECT decl_id AS node FROM decls WHERE {KILL_TARGETS}), {DOWN.format(name='doomed', base='t')},
fall AS (SELECT node FROM doomed UNION SELECT dst FROM edges JOIN fall ON src = node WHERE NOT ambiguous),
alive AS (SELECT decl_id AS node FROM roots WHERE decl_id NOT IN (SELECT node FROM doomed) UNION SELECT dst FROM edges JOIN alive ON src = node WHERE dst NOT IN (SELECT node FROM doomed))
SELECT node FROM fall WHERE node NOT IN (SELECT node FROM alive)""")
def kill_list(spark, sf_dir):
    c = project(spark, sf_dir)
    targets = c.decls.where("kind = 'Class' and source_set = 'debug'").join(c.roots, "decl_id", "left_semi")
    return G.kill_list(targets, c.roots, c.decls, c.edges)


@query("why_alive", f"""{W}, hops AS (SELECT decl_id AS node, 0 AS hop FROM roots UNION SELECT dst, hop + 1 FROM edges JOIN hops ON src = node WHERE hop < 30),
best AS (SELECT node, min(hop) AS hop FROM hops GROUP BY node)
SELECT b.node, b.hop, min(p.node) AS pred FROM best b JOIN decls d ON d.decl_id = b.node AND d.kind <> 'Parameter' LEFT JOIN edges e ON e.dst = b.node LEFT JOIN best p ON p.node = e.src AND p.hop = b.hop - 1 GROUP BY b.node, b.hop""")
def why_alive(spark, sf_dir):
    c = project(spark, sf_dir)
    return G.why_alive(c.decls.where("kind <> 'Parameter'"), c.roots, c.edges)


@query("alive_paths", f"""{W}, hops AS (SELECT decl_id AS node, 0 AS hop FROM roots UNION SELECT dst, hop + 1 FROM edges JOIN hops ON src = node WHERE hop < 30),
best AS (SELECT node, min(hop) AS hop FROM hops GROUP BY node), back AS (SELECT b.node AS at_, min(p.node) AS pred FROM best b JOIN edges e ON e.dst = b.node JOIN best p ON p.node = e.src AND p.hop = b.hop - 1 GROUP BY b.node),
walk AS (SELECT b.node, b.node AS at_, b.hop, CAST(b.node AS VARCHAR) AS path FROM best b JOIN decls d ON d.decl_id = b.node AND d.kind IN ('Class', 'Object') UNION ALL SELECT w.node, back.pred, w.hop - 1, back.pred || '>' || w.path FROM walk w JOIN back ON back.at_ = w.at_ WHERE w.hop > 0)
SELECT node, path FROM walk WHERE hop = 0""")
def alive_paths(spark, sf_dir):
    """A shortest path from a root to every type that has one."""
    c = project(spark, sf_dir)
    p = G.alive_path(c.decls.where("kind in ('Class', 'Object')"), c.roots, c.edges)
    return p.select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("nesting_depth", f"{W}, t AS (SELECT decl_id AS node, 0 AS depth FROM decls WHERE parent_id IS NULL UNION ALL SELECT decl_id, depth + 1 FROM decls JOIN t ON parent_id = node) SELECT depth, count(*) AS n FROM t GROUP BY depth")
def nesting_depth(spark, sf_dir):
    return G.depth(project(spark, sf_dir).decls).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


#: A graph with cycles over all parts: steps of 7k + 3, steps back by size, and some of the first turned round.
CYCLIC = """n AS (SELECT count(*) AS n FROM part),
cyc AS (SELECT p_partkey AS src, (p_partkey * 7 + 3) % n AS dst FROM part, n WHERE p_size <= 45
  UNION SELECT p_partkey, p_partkey - p_size FROM part WHERE p_brand = 'Brand#1' AND p_partkey >= p_size
  UNION SELECT (p_partkey * 7 + 3) % n, p_partkey FROM part, n WHERE p_brand = 'Brand#2' AND p_size > 25)"""
CYCLE_ROOTS = "p_size = 1 AND p_brand = 'Brand#3'"


def cyclic(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    p = p.crossJoin(p.agg(F.count(F.lit(1)).alias("n")))
    step = (k * 7 + 3) % F.col("n")
    one = p.where("p_size <= 45").select(k.alias("src"), step.alias("dst"))
    back = p.where("p_brand = 'Brand#1' and p_partkey >= p_size").select(k, k - F.col("p_size"))
    turned = p.where("p_brand = 'Brand#2' and p_size > 25").select(step, k)
    return one.union(back).union(turned).distinct()


CLOSED = f"WITH RECURSIVE {CYCLIC}, c AS (SELECT src, dst FROM cyc UNION SELECT c.src, cyc.dst FROM c JOIN cyc ON c.dst = cyc.src)"


@query("strong_components", f"{CLOSED}, m AS (SELECT a.src AS node, max(a.dst) AS component, count(DISTINCT a.dst) AS n FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) SELECT node, component FROM m WHERE n > 1")
def strong_components(spark, sf_dir):
    return G.strong_components(cyclic(spark, sf_dir))


@query("cycle_stats", f"{CLOSED}, m AS (SELECT a.src AS node, max(a.dst) AS component, count(DISTINCT a.dst) AS n FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src), s AS (SELECT component, count(*) AS n FROM m WHERE n > 1 GROUP BY component) SELECT count(*) AS cycles, CAST(max(n) AS BIGINT) AS largest, CAST(sum(n) AS BIGINT) AS nodes FROM s")
def cycle_stats(spark, sf_dir):
    per = G.strong_components(cyclic(spark, sf_dir)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("cycles"), F.max("n").alias("largest"), F.sum("n").alias("nodes"))


LIVE_CYC = f"live AS (SELECT p_partkey AS node FROM part WHERE {CYCLE_ROOTS} UNION SELECT dst FROM cyc JOIN live ON src = node)"


@query("dead_cycles", f"""{CLOSED}, {LIVE_CYC}, m AS (SELECT a.src AS node, max(a.dst) AS component, count(DISTINCT a.dst) AS n FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
s AS (SELECT node, component FROM m WHERE n > 1), bad AS (SELECT component FROM s WHERE node IN (SELECT node FROM live)
  UNION SELECT x.component FROM cyc JOIN s x ON x.node = cyc.dst LEFT JOIN s y ON y.node = cyc.src WHERE y.component IS DISTINCT FROM x.component)
SELECT component, count(*) AS members FROM s JOIN part ON p_partkey = node WHERE component NOT IN (SELECT component FROM bad) GROUP BY component HAVING count(*) FILTER (WHERE p_size > 5) > 0""")
def dead_cycles(spark, sf_dir):
    """Cycles that nothing outside refers to, without a reachable member, with a member of a kind that matters (parts above size 5)."""
    e, p = cyclic(spark, sf_dir), table(spark, sf_dir, "part")
    kinds = p.select(F.col("p_partkey").alias("node"), (F.col("p_size") > 5).alias("matters"))
    return G.dead_cycles(e, G.reach(p.where(CYCLE_ROOTS).select("p_partkey"), e), kinds)


@query("zombie_pairs", f"WITH RECURSIVE {CYCLIC}, live AS (SELECT p_partkey AS node FROM part WHERE {CYCLE_ROOTS} UNION SELECT dst FROM cyc JOIN live ON src = node) SELECT a.src AS a, a.dst AS b FROM cyc a JOIN cyc b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst AND a.src NOT IN (SELECT node FROM live) AND a.dst NOT IN (SELECT node FROM live)")
def zombie_pairs(spark, sf_dir):
    e = cyclic(spark, sf_dir)
    return G.zombie_pairs(e, G.reach(table(spark, sf_dir, "part").where(CYCLE_ROOTS).select("p_partkey"), e))


@query("module_usage", f"""{W}, x AS (SELECT d.module AS m, s.module AS by_m FROM edges e JOIN decls s ON s.decl_id = e.src JOIN decls d ON d.decl_id = e.dst WHERE NOT ambiguous)
SELECT t.module, CASE WHEN count(by_m) FILTER (WHERE m <> by_m) > 0 THEN 'used' WHEN count(by_m) > 0 THEN 'internal' ELSE 'unreferenced' END AS state, count(DISTINCT by_m) FILTER (WHERE m <> by_m) AS n_users, count(by_m) AS n_refs
FROM (SELECT DISTINCT module FROM decls UNION SELECT 'm' || (25 + r_regionkey) FROM region) t LEFT JOIN x ON x.m = t.module GROUP BY t.module""")
def module_usage(spark, sf_dir):
    """Modules, some without a declaration, by who refers to them without ambiguity."""
    c = project(spark, sf_dir)
    m = c.decls.select("decl_id", "module")
    every = m.select("module").unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("m"), (F.col("r_regionkey") + 25).cast("string")).alias("module"))).distinct()
    x = c.edges.where("not ambiguous").join(m.select(F.col("decl_id").alias("src"), F.col("module").alias("by_m")), "src").join(m.select(F.col("decl_id").alias("dst"), "module"), "dst")
    n = x.groupBy("module", "by_m").agg(F.count(F.lit(1)).alias("n"))
    far = F.col("module") != F.col("by_m")
    g = n.groupBy("module").agg(F.coalesce(F.sum(F.when(far, F.col("n"))), F.lit(0)).alias("n_far"), F.count_if(far).alias("n_users"), F.sum("n").alias("n_refs"))
    g = every.join(g, "module", "left").na.fill(0)
    state = F.when(F.col("n_far") > 0, "used").when(F.col("n_refs") > 0, "internal").otherwise("unreferenced")
    return g.select("module", state.alias("state"), "n_users", "n_refs")


@query("migration_blockers", f"{W} SELECT d.module, count(*) AS blockers FROM edges e JOIN decls s ON s.decl_id = e.src JOIN decls d ON d.decl_id = e.dst WHERE NOT e.ambiguous AND d.language = 'Java' AND s.language = 'Kotlin' GROUP BY d.module")
def migration_blockers(spark, sf_dir):
    c = project(spark, sf_dir)
    side = lambda k, lang: c.decls.where(f"language = '{lang}'").select(F.col("decl_id").alias(k), F.col("module").alias(f"m_{k}"))
    x = c.edges.where("not ambiguous").join(side("src", "Kotlin"), "src").join(side("dst", "Java"), "dst")
    return x.groupBy(F.col("m_dst").alias("module")).agg(F.count(F.lit(1)).alias("blockers"))


@query("refs_of", f"{W} SELECT dst, e.kind, count(*) AS n FROM edges e JOIN decls d ON d.decl_id = dst AND d.kind IN ('Class', 'Object', 'Interface') GROUP BY dst, e.kind")
def refs_of(spark, sf_dir):
    c = project(spark, sf_dir)
    types = c.decls.where("kind in ('Class', 'Object', 'Interface')").select(F.col("decl_id").alias("dst"))
    return c.edges.join(types, "dst", "left_semi").groupBy("dst", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("dead_symbols", f"{W} SELECT decl_id FROM decls WHERE kind IN ('Class', 'Interface', 'Object', 'Method', 'Function', 'Property') AND decl_id NOT IN (SELECT dst FROM edges) AND decl_id NOT IN (SELECT decl_id FROM roots)")
def dead_symbols(spark, sf_dir):
    c = project(spark, sf_dir)
    d = c.decls.where("kind in ('Class', 'Interface', 'Object', 'Method', 'Function', 'Property')").select("decl_id")
    return d.join(c.edges.select(F.col("dst").alias("decl_id")), "decl_id", "left_anti").join(c.roots, "decl_id", "left_anti")
