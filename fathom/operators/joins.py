"""Joins that Spark lacks: enclosing span, as-of, next within a gap, tiers, drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def enclosing_span(points: DataFrame, spans: DataFrame, group: str, at: str = "at", begin: str = "begin", end: str = "end", span_id: str = "span_id", point_id: str = "point_id") -> DataFrame:
    """(point_id, span_id): the innermost span of the point's group around it, both ends included.

    Ties go to the earliest start, then the least id.  A point without one has a
    null.  The join is an equi-join on the group with a residual; the choice
    is one grouped minimum, so no sort of the matches is needed.
    """
    s = spans.select(F.col(group).alias("__g"), F.col(begin).alias("__b"), F.col(end).alias("__e"), F.col(span_id).alias("span_id"))
    hit = points.join(s, (F.col(group) == F.col("__g")) & (F.col("__b") <= F.col(at)) & (F.col(at) <= F.col("__e")), "left")
    best = F.min(F.when(F.col("__b").isNotNull(), F.struct(F.col("__e") - F.col("__b"), "__b", "span_id")))
    return hit.groupBy(F.col(point_id).alias("point_id")).agg(best.alias("m")).select("point_id", F.col("m.span_id").alias("span_id"))


def as_of(left: DataFrame, right: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the last row of ``right`` at or before it in its group, null if none.

    One sort by (group, at) of both sides together, right before left at equal
    times; of several right rows at one time the greatest value counts.
    """
    r = right.groupBy(group, at).agg(F.max(value).alias("__v")).select(group, at, F.lit(0).alias("__side"), "__v")
    both = r.unionByName(left.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(group).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__side", "__v").withColumnRenamed("__last", value)


def next_within(left: DataFrame, right: DataFrame, group: str, at: str, gap, out: str) -> DataFrame:
    """``left`` with the least ``at`` of ``right`` in its group that is later by at most ``gap``."""
    r = right.select(group, at, F.lit(1).alias("__side"))
    both = left.withColumn("__side", F.lit(0)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(group).orderBy(F.col(at).desc(), F.col("__side")).rowsBetween(Window.unboundedPreceding, -1)
    got = both.withColumn("__n", F.last(F.when(F.col("__side") == 1, F.col(at)), ignorenulls=True).over(w)).where("__side = 0")
    return got.withColumn(out, F.when((F.col("__n") > F.col(at)) & (F.col("__n") <= F.col(at) + gap), F.col("__n"))).drop("__side", "__n")


def tiered(refs: DataFrame, tiers: list[tuple[DataFrame, str, str]], ref_id: str = "ref_id") -> DataFrame:
    """(ref_id, tier, target, ambiguous): all targets of the first tier that has any.

    A tier is (targets with columns key and target, column of ``refs`` to look
    up).  A reference is ambiguous if its tier has several targets.
    """
    parts = [
        refs.join(t.select(F.col(key).alias("__k"), F.col("target")), F.col(col) == F.col("__k")).select(ref_id, F.lit(i + 1).alias("tier"), "target")
        for i, (t, key, col) in enumerate(tiers)
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    w = Window.partitionBy(ref_id)
    first = every.distinct().withColumn("__min", F.min("tier").over(w)).where("tier = __min")
    return first.withColumn("ambiguous", F.count(F.lit(1)).over(w) > 1).select(ref_id, "tier", "target", "ambiguous")


def _drifted(found: DataFrame, known: DataFrame, keys: list[str], line: str, fqn: str, drift: int) -> DataFrame:
    """``found`` with a column ``__has``: whether ``known`` has the row.

    Lines, which are whole numbers, are put in boxes of ``drift`` + 1: any line of
    a row's own box is near, of the box before only the last can be the nearest,
    of the box after only the first.  So ``known`` is one row a box, and the work
    grows with the rows however many share their keys.
    """
    k = known.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col(line).alias("__line"), F.col(fqn).alias("__fqn"))
    ks, size = [f"__{c}" for c in keys], drift + 1
    box = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(size))
    equal = lambda: reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in keys])
    bare = F.col("__fqn").isNull()
    lines = k.where("__line is not null").groupBy(*ks, box("__line").alias("__at"))
    lines = lines.agg(F.min("__line").alias("lo"), F.max("__line").alias("hi"), F.min(F.when(bare, F.col("__line"))).alias("bare_lo"), F.max(F.when(bare, F.col("__line"))).alias("bare_hi"))
    # each box tells itself, the next and the one before
    told = lines.withColumn("__to", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("__at", F.col("__at") + F.col("__to") * size)
    sides = {f"__{p}{n}": f(F.when(F.col("__to") == to, F.col(f"{p}{e}"))).alias(f"__{p}{n}") for p in ("", "bare_") for n, f, to, e in (("own", F.min, 0, "lo"), ("last", F.max, 1, "hi"), ("first", F.min, -1, "lo"))}
    told = told.groupBy(*ks, "__at").agg(*sides.values())
    names = k.where("__fqn is not null").select(*ks, "__fqn").distinct().withColumn("__named", F.lit(True))
    near = lambda p: F.coalesce(F.col(f"__{p}own").isNotNull() | (F.col(line) - F.col(f"__{p}last") <= drift) | (F.col(f"__{p}first") - F.col(line) <= drift), F.lit(False))
    x = found.join(told, equal() & (box(line) == F.col("__at")), "left").withColumns({"__near": near(""), "__bare_near": near("bare_")}).select(*found.columns, "__near", "__bare_near")
    x = x.join(names, equal() & (F.col(fqn) == F.col("__fqn")), "left")
    has = F.when(F.col(fqn).isNull(), F.col("__near")).otherwise(F.col("__bare_near") | F.coalesce("__named", F.lit(False)))
    return x.select(*found.columns, has.alias("__has"))


def drift_anti(found: DataFrame, known: DataFrame, keys: list[str], line: str = "line", fqn: str = "fqn", drift: int = 10) -> DataFrame:
    """Rows of ``found`` that ``known`` doesn't have: keys equal, then equal names if both have one, else lines at most ``drift`` apart."""
    return _drifted(found, known, keys, line, fqn, drift).where("not __has").drop("__has")


def drift_semi(found: DataFrame, known: DataFrame, keys: list[str], line: str = "line", fqn: str = "fqn", drift: int = 10) -> DataFrame:
    """Rows of ``found`` that ``known`` has, in the same sense."""
    return _drifted(found, known, keys, line, fqn, drift).where("__has").drop("__has")
