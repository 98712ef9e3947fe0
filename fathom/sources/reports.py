"""Side inputs: LCOV, JaCoCo and Kover XML, shrinker usage, keep rules, manifests, baselines, saved graphs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, line): files whole, so that line order is known."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("t"))
    return raw.select("path", F.posexplode(F.split("t", "\r?\n")).alias("n", "line"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(file, tag, rest) of LCOV records under the SF above them; only the order within one file matters."""
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = _numbered(spark, path).select("path", "n", F.regexp_extract("line", "^([A-Z]+):", 1).alias("tag"), F.regexp_extract("line", "^[A-Z]+:(.*)$", 1).alias("rest"))
    return x.withColumn("file", F.last(F.when(F.col("tag") == "SF", F.col("rest")), ignorenulls=True).over(w)).where("file is not null and tag not in ('', 'SF')").select("file", "tag", "rest")


def read_lcov(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, covered) of DA records."""
    p = F.split("rest", ",")
    d = _records(spark, path).where("tag = 'DA'")
    return merge_coverage(d.select("file", p[0].cast("int").alias("line"), (p[1].cast("bigint") > 0).alias("covered")))


def read_lcov_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(kind, fqn, covered) of FNDA records."""
    d = _records(spark, path).where("tag = 'FNDA'")
    x = d.select(F.lit("method").alias("kind"), F.regexp_extract("rest", "^[0-9]+,(.*)$", 1).alias("fqn"), (F.regexp_extract("rest", "^([0-9]+)", 1).cast("bigint") > 0).alias("covered"))
    return x.groupBy("kind", "fqn").agg(F.bool_or("covered").alias("covered"))


def read_lcov_branches(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, hit, total) of BRDA records; a dash is no hit."""
    p = F.split("rest", ",")
    d = _records(spark, path).where("tag = 'BRDA'").select("file", p[0].cast("int").alias("line"), p[1].alias("block"), p[2].alias("branch"), F.coalesce(p[3].try_cast("bigint") > 0, F.lit(False)).alias("taken"))
    one = d.groupBy("file", "line", "block", "branch").agg(F.bool_or("taken").alias("taken"))
    return one.groupBy("file", "line").agg(F.count_if("taken").alias("hit"), F.count(F.lit(1)).alias("total"))


def read_jacoco_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(kind, fqn, covered) of class and method elements, by their own counters; Kover writes the same."""
    raw = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("t"))
    c = raw.select(F.explode(F.regexp_extract_all("t", F.lit(r'(?s)(<class name="[^"]*".*?</class>)'), 1)).alias("c"))
    c = c.select("c", F.translate(F.regexp_extract("c", 'class name="([^"]*)"', 1), "/$", "..").alias("owner"))
    hit = lambda col, kind: F.regexp_extract(col, rf'type="{kind}"[^>]*covered="([0-9]+)"', 1).try_cast("bigint") > 0
    own = F.regexp_replace("c", r"(?s)<method\b.*?</method>", "")
    classes = c.select(F.lit("class").alias("kind"), F.col("owner").alias("fqn"), F.coalesce(hit(own, "CLASS"), hit(own, "METHOD")).alias("covered"))
    m = c.select("owner", F.explode(F.regexp_extract_all("c", F.lit(r'(?s)(<method name="[^"]*".*?</method>)'), 1)).alias("m"))
    name = F.regexp_extract("m", 'method name="([^"]*)"', 1)
    methods = m.select(F.lit("method").alias("kind"), F.concat("owner", F.lit("."), name).alias("fqn"), hit(F.col("m"), "METHOD").alias("covered"))
    return classes.unionByName(methods).where("covered is not null").groupBy("kind", "fqn").agg(F.bool_or("covered").alias("covered"))


def read_jacoco(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, covered) of line elements under their sourcefile and package; Kover writes the same."""
    raw = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("t"))
    pk = raw.select(F.explode(F.regexp_extract_all("t", F.lit(r'(?s)(<package name="[^"]*".*?</package>)'), 1)).alias("p"))
    sf = pk.select(F.regexp_extract("p", 'package name="([^"]*)"', 1).alias("pkg"), F.explode(F.regexp_extract_all("p", F.lit(r'(?s)(<sourcefile name="[^"]*".*?</sourcefile>)'), 1)).alias("s"))
    ln = sf.select(F.concat_ws("/", "pkg", F.regexp_extract("s", 'sourcefile name="([^"]*)"', 1)).alias("file"), F.explode(F.regexp_extract_all("s", F.lit("(<line [^>]*>)"), 1)).alias("l"))
    return merge_coverage(ln.select("file", F.regexp_extract("l", 'nr="([0-9]+)"', 1).cast("int").alias("line"), (F.regexp_extract("l", 'ci="([0-9]+)"', 1).cast("int") > 0).alias("covered")))


def merge_coverage(runs: DataFrame) -> DataFrame:
    """A line is covered if any run covers it."""
    return runs.groupBy("file", "line").agg(F.bool_or("covered").alias("covered"))


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """(class_name, member, dead_class): a class line without member lines is wholly dead."""
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = _numbered(spark, path).where("trim(line) <> ''")
    top = F.when(~F.col("line").rlike(r"^\s"), F.regexp_replace("line", ":$", ""))
    x = x.withColumn("class_name", F.last(top, ignorenulls=True).over(w)).withColumn("member", F.when(F.col("line").rlike(r"^\s"), F.trim("line")))
    x = x.withColumn("dead_class", F.count("member").over(Window.partitionBy("path", "class_name")) == 0)
    return x.where("member is not null or dead_class").select("class_name", "member", "dead_class")


def keep_pattern(spec: str) -> str | None:
    """The regular expression of a keep rule's class; None if it has other signs than names and wildcards."""
    if re.search(r"[^\w.$*?]", spec):
        return None
    part = {"**": ".*", "*": "[^.]*", "?": ".", ".": r"\.", "$": r"\$"}
    return "^" + re.sub(r"\*\*|[*?.$]", lambda m: part[m.group()], spec) + "$"


def keep_rules(text: str) -> list[str]:
    """Patterns of -keep rules; rules that keep members only are passed over."""
    specs = re.findall(r"^\s*-keep(?!classmember)\w*(?:,\w+)*\s+(?:(?:public|abstract|final|@\S+)\s+)*(?:class|interface|enum)\s+(\S+)", text, re.M)
    return [p for p in map(keep_pattern, specs) if p]


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(file, class_name) of names in manifests; a leading dot stands for the package."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "AndroidManifest.xml").load(path)
    x = raw.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("t"))
    x = x.select("file", F.regexp_extract("t", 'package="([^"]+)"', 1).alias("pkg"), F.explode(F.regexp_extract_all("t", F.lit(r'(?s)<(?:activity|service|receiver|provider|application)\b[^>]*?:name="([^"]+)"'), 1)).alias("n"))
    return x.select("file", F.when(F.col("n").startswith("."), F.concat("pkg", "n")).otherwise(F.col("n")).alias("class_name")).distinct()


BASELINE = "version string, created_at string, total_at_baseline bigint, issues array<struct<file:string, name:string, kind:string, line:int, fqn:string, rule:string>>"


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BASELINE).option("multiLine", "true").json(path).select(F.inline("issues"))


GRAPH = "nodes array<struct<id:string, name:string, kind:string, file:string, line:int>>, edges array<struct<`from`:string, `to`:string>>, roots array<string>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges (src, dst) and roots of a saved graph."""
    g = spark.read.schema(GRAPH).option("multiLine", "true").json(path)
    e = g.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"))
    return g.select(F.inline("nodes")), e, g.select(F.explode("roots").alias("node"))


def read_foreign_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(rule, file, name) of the unused-code entries of another linter's baseline, "<ID>Rule:File$Signature</ID>"."""
    raw = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("t"))
    x = raw.select(F.explode(F.regexp_extract_all("t", F.lit(r"<ID>(Unused\w*:[^<]+)</ID>"), 1)).alias("id"))
    signature = F.regexp_extract("id", r"^[^$]*\$(.*)$", 1)
    name = F.regexp_extract(F.regexp_replace(signature, r"\b(?:private|public|internal|protected|override|suspend|inline|const|lateinit)\b", ""), r"(?:\b(?:fun|val|var|class|object|interface)\s+)(?:<[^>]*>\s*)?(?:\w+\.)*(\w+)", 1)
    return x.select(F.regexp_extract("id", r"^(\w+):", 1).alias("rule"), F.regexp_extract("id", r"^\w+:([^$]*)", 1).alias("file"), F.when(name != "", name).otherwise(F.regexp_extract(signature, r"(\w+)", 1)).alias("name"))


def dead_keep_rules(specs: DataFrame, decls: DataFrame) -> DataFrame:
    """(spec) of exact keep rules, without wildcards, whose package the corpus has and whose class it doesn't."""
    s = specs.toDF("spec", *[f"x{k}" for k in range(len(specs.columns) - 1)]).select("spec").where(~F.col("spec").rlike(r"[*?]")).distinct()
    package = lambda c: F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)
    known = decls.where("parent_id is null").select(package("fqn").alias("package")).distinct()
    declared = decls.select(F.col("fqn").alias("spec")).join(s, "spec", "left_semi").distinct()
    return s.withColumn("package", package("spec")).join(known, "package", "left_semi").join(declared, "spec", "left_anti").select("spec")
