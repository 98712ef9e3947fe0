"""Files of a project as lines, and what its resource files name.

A project is read as whole files, so that lines have numbers; hidden folders,
build output, generated sources and what a caller excludes are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a path that are passed over.
SKIPPED = r"/(\.[^/]+|build|generated|node_modules)/"
GENERATED = "(?i)generated by|do not (edit|modify)"


def read_project(spark: SparkSession, path: str, exclude: list[str] | None = None, glob: str = "*") -> DataFrame:
    """(file, content, ext, module, source_set, language, is_test) of the text files below ``path``.

    ``exclude`` are expressions for paths that are left out.  A module is the
    folder above "src", or that of the build file; files whose first lines say
    that they are generated go.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    base = path.removeprefix("file://").rstrip("/")
    f = raw.select(F.regexp_replace("path", "^file:/*", "/").alias("file"), F.decode("content", "UTF-8").alias("content"))
    inside = F.col("file").substr(F.lit(len(base) + 1), F.length("file"))
    f = f.where(~inside.rlike(SKIPPED)).where(F.col("file").rlike(r"\.(kt|kts|java|xml|gradle|pro|json|info|txt)$"))
    for e in exclude or []:
        f = f.where(~F.col("file").rlike(e))
    name = F.element_at(F.split("file", "/"), -1)
    ext = F.when(name.rlike(r"\.gradle(\.kts)?$"), "gradle").otherwise(F.regexp_replace(F.regexp_extract("file", r"\.(\w+)$", 1), "^kts$", "kt"))
    f = f.withColumn("ext", ext)
    head = F.array_join(F.slice(F.split("content", "\n"), 1, 10), "\n")
    f = f.where(~(F.col("ext").isin("kt", "java") & head.rlike(GENERATED)))
    module = F.regexp_extract(F.regexp_extract("file", r"^(.*?)/(?:src/|[^/]*$)", 1), r"([^/]+)$", 1)
    source_set = F.coalesce(F.nullif(F.regexp_extract("file", r"/src/([^/]+)/", 1), F.lit("")), F.lit("main"))
    return f.select("file", "content", "ext", module.alias("module"), source_set.alias("source_set"), F.when(F.col("ext") == "java", "Java").otherwise("Kotlin").alias("language"), is_test().alias("is_test"))


def is_test() -> Column:
    return F.col("file").rlike(r"/(test|androidTest|sharedTest)/|/src/[^/]*[Tt]est[^/]*/|Tests?\.(kt|kts|java)$")


def phantom_sets(files: DataFrame, builds: DataFrame) -> DataFrame:
    """(file) under source sets that no convention and no build file (text in ``content``) declares.

    A set is known if it begins with a conventional name or one that a build file
    creates or names in quotes or as a block.
    """
    usual = "main test androidTest debug release commonMain commonTest jvmMain androidMain iosMain sharedTest staging".split()
    declared = builds.select(F.explode(F.regexp_extract_all("content", F.lit(r"""(?:create\(|register\(|getByName\(|maybeCreate\(|named\()\s*["'](\w+)["']|^\s*(\w+)\s*\{"""), 1)).alias("d")).where("d <> ''").distinct()
    sets = files.where("file like '%/src/%'").select("source_set").distinct()
    known = sets.where(F.col("source_set").rlike("^(" + "|".join(usual) + ")"))
    by_build = sets.join(declared, F.expr("startswith(source_set, d)"), "left_semi")
    ghost = sets.join(known, "source_set", "left_anti").join(by_build, "source_set", "left_anti")
    return files.where("file like '%/src/%'").join(ghost, "source_set", "left_semi").select("file")


def lines_of(files: DataFrame) -> DataFrame:
    """(file, module, source_set, ext, line, text) of every line, numbers from 1."""
    each = files.select("file", "module", "source_set", "ext", F.posexplode(F.split("content", "\r?\n")).alias("p", "text"))
    return each.select("file", "module", "source_set", "ext", (F.col("p") + 1).cast("bigint").alias("line"), "text")


def xml_names(files: DataFrame) -> DataFrame:
    """(name, source) of classes that manifests, layouts, navigation and menus name.

    A manifest's leading dot stands for its package.  A layout names its tags
    and classes with a dot, its context, the types of its variables, and the
    methods that bindings refer to; other resources any full class name.
    """
    x = files.where("ext = 'xml'").select("file", "content")

    def every(rows: DataFrame, pattern: str, source: str) -> DataFrame:
        return rows.select("file", "content", F.explode(F.regexp_extract_all("content", F.lit(pattern), 1)).alias("n")).select("file", "content", "n", F.lit(source).alias("source"))

    manifests = x.where("file like '%/AndroidManifest.xml'")
    m = every(manifests, r'(?s)<(?:activity(?:-alias)?|service|receiver|provider|application|instrumentation)\b[^>]*?:(?:name|backupAgent|appComponentFactory)="([^"]+)"', "manifest")
    m = m.unionByName(every(manifests, r'android:(?:backupAgent|appComponentFactory)="([^"]+)"', "manifest")).unionByName(every(manifests, r'(?s)<meta-data\b[^>]*?android:value="([A-Za-z_][\w$]*(?:\.[\w$]+)+)"', "manifest"))
    package = F.regexp_extract("content", r'package="([^"]+)"', 1)
    m = m.withColumn("n", F.when(F.col("n").startswith("."), F.concat(package, "n")).otherwise(F.col("n")))
    layouts = x.where("file like '%/layout%/%'")
    parts = [
        every(layouts, r"<([a-z][\w]*(?:\.[\w$]+)+)", "layout"), every(layouts, r'\bclass="([\w.$]+)"', "layout"), every(layouts, r'tools:context="([\w.$]+)"', "layout"),
        every(layouts, r'(?s)<fragment\b[^>]*?android:name="([\w.$]+)"', "layout"), every(layouts, r'(?s)<variable\b[^>]*?type="([\w.$]+)', "layout"), every(layouts, r'="@\{[^"]*?::(\w+)', "binding"),
        every(layouts, r'="@=?\{[^"]*?\.(\w+)\(', "binding"),
    ]
    nav = x.where("file like '%/navigation%/%'")
    parts.append(every(nav, r'android:name="([\w.$]+)"', "navigation"))
    menus = x.where("file like '%/menu%/%'")
    parts.append(every(menus, r'(?:actionViewClass|actionProviderClass)="([\w.$]+)"', "menu"))
    res = x.where("file like '%/res/xml/%'")
    parts.append(every(res, r'"([a-z][\w]*(?:\.[\w$]+)+)"', "res"))
    for p in parts:
        m = m.unionByName(p)
    return m.select(F.regexp_replace("n", r"\$", ".").alias("name"), "source").where("name <> ''").distinct()
