"""Entry points over the driver tables as code, with side inputs made of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.plans import roots as R
from fathom.plans.model import SQL, project
from fathom.plans.registry import query, table
from fathom.sources.reports import dead_keep_rules, keep_pattern

W = f"WITH RECURSIVE {SQL}"
NAMES = ["DetailScreen", "gone.Nowhere", "a.b.SyncTask"]


@query("root_reasons", f"{W} SELECT reason, count(*) AS n FROM reasons GROUP BY reason")
def root_reasons(spark, sf_dir):
    """Declarations by every reason that they have."""
    c = project(spark, sf_dir)
    own = c.decls.select("decl_id", F.explode(R._reasons()).alias("reason"))
    p = R.consumed_providers(c.decls, c.edges).where("consumed").select("decl_id", F.lit("provider").alias("reason"))
    return own.unionByName(p).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("retention_audit", f"""{W}, w AS (SELECT unnest({R.ENTRY!r}) AS annotation), h AS (SELECT annotation, count(*) AS n FROM w JOIN decls ON contains(anns, annotation) GROUP BY annotation)
SELECT annotation, n, round(100.0 * n / (SELECT count(*) FROM decls), 6)::DOUBLE AS share, 100.0 * n / (SELECT count(*) FROM decls) >= 1 AS broad FROM h""")
def retention_audit(spark, sf_dir):
    """Declarations that each root annotation keeps, their share in per cent, and whether it is broad."""
    d = project(spark, sf_dir).decls
    each = F.filter(F.array(*map(F.lit, R.ENTRY)), lambda w: F.contains(F.col("anns"), w))
    n = d.where("anns <> ''").select(F.explode(each).alias("annotation")).groupBy("annotation").agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(100.0) * F.col("n") / F.lit(d.count())
    return n.select("annotation", "n", F.round(share, 6).alias("share"), (share >= 1).alias("broad"))


@query("di_bindings", f"{W} SELECT decl_id, consumed FROM providers")
def di_bindings(spark, sf_dir):
    """Providers, and whether anything takes what they provide."""
    c = project(spark, sf_dir)
    return R.consumed_providers(c.decls, c.edges)


@query("dead_di_modules", f"""{W} SELECT m.decl_id, m.name, count(*) AS bindings FROM decls m JOIN decls p ON p.parent_id = m.decl_id JOIN providers v ON v.decl_id = p.decl_id
WHERE m.kind = 'Class' AND contains(m.anns, 'Module') GROUP BY m.decl_id, m.name HAVING NOT bool_or(v.consumed)""")
def dead_di_modules(spark, sf_dir):
    """Modules with bindings of which none is consumed."""
    c = project(spark, sf_dir)
    p = R.consumed_providers(c.decls, c.edges).join(c.decls.select("decl_id", "parent_id"), "decl_id").groupBy(F.col("parent_id").alias("decl_id"))
    p = p.agg(F.count(F.lit(1)).alias("bindings"), F.bool_or("consumed").alias("any")).where("not any")
    return c.decls.where((F.col("kind") == "Class") & F.contains("anns", F.lit("Module"))).join(p, "decl_id").select("decl_id", "name", "bindings")


@query("roots_named", f"""{W}, n AS (SELECT fqn AS n FROM decls JOIN customer ON decl_id = c_custkey * 8 + 1 WHERE c_acctbal < 0 UNION SELECT unnest({NAMES!r})),
f AS (SELECT n, decl_id FROM n JOIN decls ON fqn = n) SELECT decl_id FROM f UNION SELECT decl_id FROM decls WHERE kind <> 'Parameter' AND name IN (SELECT split_part(n, '.', -1) FROM n WHERE n NOT IN (SELECT n FROM f))""")
def roots_named(spark, sf_dir):
    """Declarations that manifests and layouts would name: types of indebted customers, and three fixed names."""
    d = project(spark, sf_dir).decls
    owed = table(spark, sf_dir, "customer").where("c_acctbal < 0").select((F.col("c_custkey") * 8 + 1).alias("decl_id"))
    names = d.join(owed, "decl_id").select("fqn").unionByName(spark.createDataFrame([(n,) for n in NAMES], "fqn string"))
    return R.named_roots(d, names)


@query("roots_kept", f"{W} SELECT decl_id FROM decls WHERE starts_with(fqn, 'm1.') AND regexp_full_match(split_part(fqn, '.', 2), 'Parser[^.]*') AND len(string_split(fqn, '.')) = 3 OR fqn LIKE 'm2_.Mode.%'")
def roots_kept(spark, sf_dir):
    """Declarations that two keep rules match."""
    return R.kept_roots(project(spark, sf_dir).decls, [keep_pattern("m1.Parser*.*"), keep_pattern("m2?.Mode.**")])


@query("roots_retained", f"{W} SELECT decl_id FROM decls WHERE name LIKE '%Dao' OR name LIKE 'Sync%' OR name = 'loadUser'")
def roots_retained(spark, sf_dir):
    return R.retained_roots(project(spark, sf_dir).decls, ["*Dao", "Sync*", "loadUser"])


MENTIONS = ["DaggerNetworkModule", "UserRepository_Factory", "PhotoScreenDirections", "DetailScreenArgs", "Parser_Impl", "ParserV2", "lowerArgs"]


@query("roots_generated", f"{W} SELECT decl_id FROM decls WHERE kind IN ('Class', 'Interface', 'Object', 'Enum') AND name IN ('NetworkModule', 'UserRepository', 'PhotoScreen', 'DetailScreen', 'Parser')")
def roots_generated(spark, sf_dir):
    """Types whose generated companions are mentioned."""
    return R.generated_roots(project(spark, sf_dir).decls, spark.createDataFrame([(m,) for m in MENTIONS], "m string"))


@query("roots_accessors", f"{W} SELECT f.decl_id FROM decls f WHERE f.kind = 'Field' AND EXISTS (SELECT 1 FROM decls m WHERE m.name IN (SELECT k || upper(f.name[1]) || f.name[2:] FROM (VALUES ('get'), ('set'), ('is')) v(k)))")
def roots_accessors(spark, sf_dir):
    """Fields whose accessors occur by name."""
    d = project(spark, sf_dir).decls
    return R.accessor_roots(d, d.select("name"))


SPECS = ["m1.Parser.1", "m1.Gone.7", "m2.*", "m3.Mode", "zz.Nowhere"]


@query("t12_dead_keep_rules", f"""{W}, s AS (SELECT unnest({SPECS!r}) AS spec UNION SELECT 'm' || n_nationkey || '.Gone.' || n_nationkey FROM nation UNION SELECT 'm' || n_nationkey || '.Mode.1' FROM nation)
SELECT spec FROM s WHERE NOT contains(spec, '*') AND left(spec, length(spec) - length(list_last(string_split(spec, '.'))) - 1) IN (SELECT left(fqn, length(fqn) - length(list_last(string_split(fqn, '.'))) - 1) FROM decls WHERE parent_id IS NULL) AND spec NOT IN (SELECT fqn FROM decls)""")
def dead_keeps(spark, sf_dir):
    """Exact keep rules for what a known package doesn't have."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n"))
    specs = spark.createDataFrame([(x,) for x in SPECS], "spec string").union(n.select(F.concat(F.lit("m"), "n", F.lit(".Gone."), "n"))).union(n.select(F.concat(F.lit("m"), "n", F.lit(".Mode.1"))))
    return dead_keep_rules(specs, project(spark, sf_dir).decls)
