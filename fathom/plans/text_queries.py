"""Text rules over documents and pages: line lints, repeats, near twins, resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.plans.registry import query, table


def lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, line_no from 1, line, ...) of every line."""
    return docs.select(F.col(id_col), *keep, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(id_col, *keep, (F.col("p") + 1).cast("bigint").alias("line_no"), "line")


LINES = "lines AS (SELECT doc_id, lang, source, CAST(generate_subscripts(l, 1) AS BIGINT) AS line_no, unnest(l) AS line FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
LINTS = [("L1", r"[!?]{2,}"), ("L2", r"(?i)copyright|license"), ("L3", r"\.length *(==|>) *0|\(\(\w+\)\)"), ("L4", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+"), ("L5", r"#{3}|\${3}")]


@query("regex_lints", f"WITH {LINES} " + " UNION ALL ".join(f"SELECT doc_id, line_no, '{c}' AS code FROM lines WHERE regexp_matches(line, '{r}')" for c, r in LINTS))
def regex_lints(spark, sf_dir):
    """All patterns in one scan of the lines."""
    hit = F.array_compact(F.array(*[F.when(F.col("line").rlike(r), F.lit(c)) for c, r in LINTS]))
    return lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.explode(hit).alias("code"))


@query("duplicate_import", f"WITH {LINES} SELECT doc_id, line_no, first_line FROM (SELECT doc_id, line_no, min(line_no) OVER (PARTITION BY doc_id, line) AS first_line FROM lines WHERE trim(line) <> '') WHERE line_no > first_line")
def duplicate_import(spark, sf_dir):
    """Every repeat of a line in one document, with the first one."""
    x = lines(table(spark, sf_dir, "documents")).where("trim(line) <> ''")
    return x.withColumn("first_line", F.min("line_no").over(Window.partitionBy("doc_id", "line"))).where("line_no > first_line").select("doc_id", "line_no", "first_line")


@query("duplicate_strings", f"WITH {LINES} SELECT md5(trim(line)) AS value, count(DISTINCT source) AS n_modules, count(*) AS n FROM lines WHERE trim(line) <> '' GROUP BY trim(line) HAVING count(DISTINCT source) >= 2")
def duplicate_strings(spark, sf_dir):
    x = lines(table(spark, sf_dir, "documents"), keep=("source",)).where("trim(line) <> ''")
    g = x.groupBy(F.trim("line").alias("v")).agg(F.count_distinct("source").alias("n_modules"), F.count(F.lit(1)).alias("n"))
    return g.where("n_modules >= 2").select(F.md5("v").alias("value"), "n_modules", "n")


WORDS = "words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE text IS NOT NULL)"


@query("dead_fields", f"WITH {WORDS} SELECT word, min(doc_id) AS doc_id FROM words GROUP BY word HAVING count(*) = 1")
def dead_fields(spark, sf_dir):
    """Words that occur once in the corpus."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").select("word", "doc_id")


@query("changed_since", f"WITH {WORDS}, w AS (SELECT DISTINCT doc_id, word FROM words) SELECT word, min(doc_id) AS doc_id FROM w GROUP BY word HAVING count(*) = 1")
def changed_since(spark, sf_dir):
    """Words that no other document has."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").select("word", "doc_id")


HREF = 'href="([^"]+)"'


@query("unused_resource", f"""WITH h AS (SELECT DISTINCT ltrim(unnest(regexp_extract_all(html, '{HREF}', 1)), '/') AS name FROM pages), {WORDS} SELECT name FROM h WHERE lower(name) NOT IN (SELECT word FROM words)""")
def unused_resource(spark, sf_dir):
    """Link names that are no word of any document."""
    names = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("h")).select(F.regexp_replace("h", "^/+", "").alias("name")).distinct()
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).distinct()
    return names.join(w, F.lower("name") == F.col("word"), "left_anti")


@query("orphan_translation", f"""WITH h AS (SELECT DISTINCT regexp_extract(html, 'html lang="([a-z]+)"', 1) AS lang, unnest(regexp_extract_all(html, '{HREF}', 1)) AS key FROM pages) SELECT lang, key FROM h WHERE lang <> 'en' AND key NOT IN (SELECT key FROM h WHERE lang = 'en')""")
def orphan_translation(spark, sf_dir):
    """Keys of other languages that the base language lacks."""
    h = table(spark, sf_dir, "pages").select(F.regexp_extract("html", 'html lang="([a-z]+)"', 1).alias("lang"), F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("key")).distinct()
    return h.where("lang <> 'en'").join(h.where("lang = 'en'").select("key"), "key", "left_anti").select("lang", "key")


def near_twins(items: DataFrame, group: str, item: str, parts: Column, least: int = 3, share: float = 0.8) -> DataFrame:
    """(a, b, jaccard) of items of one group whose sets of parts are at least ``share`` alike.

    Pairs come from an index: of an item's n parts, the rarest in its group first,
    one of the first n - ceil(share * n) + 1 is among the first so many of a
    partner.  So a line that all share brings none together unless they have
    little else.
    """
    x = items.select(group, F.col(item).alias("item"), F.transform(F.array_distinct(parts), lambda v: F.xxhash64(v)).alias("h")).where(F.size("h") >= least)
    each = x.select(group, "item", F.explode("h").alias("k"))
    rare = each.groupBy(group, "k").agg(F.count(F.lit(1)).alias("df"))
    # a part that only one item has brings nobody together, but takes its place in the order
    ranked = each.join(rare, [group, "k"]).groupBy(group, "item").agg(F.array_sort(F.collect_list(F.struct("df", "k"))).alias("s"))
    n = F.size("s")
    keys = ranked.select(group, "item", F.explode(F.slice("s", F.lit(1), n - F.ceil(n * share).cast("int") + 1)).alias("z")).where("z.df > 1").select(group, "item", F.col("z.k").alias("k"))
    a = keys.withColumnRenamed("item", "a")
    pairs = a.join(keys.withColumnRenamed("item", "b"), [group, "k"]).where("a < b").select("a", "b").distinct()
    sets = x.select("item", "h")
    both = pairs.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b")
    j = F.size(F.array_intersect("ha", "hb")) / F.size(F.array_union("ha", "hb"))
    return both.select("a", "b", j.alias("jaccard")).where(F.col("jaccard") >= share)


@query("near_twins", f"""WITH {LINES}, s AS (SELECT doc_id, lang, list(DISTINCT trim(line)) AS l FROM lines WHERE trim(line) <> '' GROUP BY doc_id, lang HAVING count(DISTINCT trim(line)) >= 3)
SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.l, b.l)) / (len(a.l) + len(b.l) - len(list_intersect(a.l, b.l)))::DOUBLE AS jaccard FROM s a JOIN s b ON a.lang = b.lang AND a.doc_id < b.doc_id
WHERE len(list_intersect(a.l, b.l)) >= 0.8 * (len(a.l) + len(b.l) - len(list_intersect(a.l, b.l)))""")
def near_twin_docs(spark, sf_dir):
    """Documents of one language whose lines are at least 80 % alike."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return near_twins(d, "lang", "doc_id", F.filter(F.transform(F.split("text", "\n"), F.trim), lambda v: v != ""))


@query("page_hosts", "SELECT regexp_extract(url, '://([^/]+)', 1) AS host, count(*) AS n_pages, count(DISTINCT regexp_extract(html, 'html lang=\"([a-z]+)\"', 1)) AS n_langs FROM pages GROUP BY 1")
def page_hosts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.regexp_extract("html", 'html lang="([a-z]+)"', 1).alias("lang"))
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"), F.count_distinct("lang").alias("n_langs"))
