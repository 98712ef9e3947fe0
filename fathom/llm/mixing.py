"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target weight times the total budget is its token budget.  Whole
epochs of the source are taken first, as often as they fit; the rest of the
budget is filled from one more pass in the order of exponential keys
``-ln(u) / w``, where u is a hash of the document's id and w its quality
weight.  A document is taken as long as the running sum of tokens in that order
stays within the rest of the budget.

No source is ever sorted whole.  Tokens are summed by source and bucket of the
key, buckets being even in the key's logarithm, so that they are small whatever
the scale of the weights; running sums over buckets find the one bucket of each
source in which the budget ends.  That bucket is cut into cells in the same
way, and only the one cell in which the budget ends is sorted.  What remains is
one cut-off key a source, with which documents are filtered where they lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.scratch import drop, stash
from fathom.llm.words import Words, parts_of, slices

NAME = "op10_mixing"
#: Buckets of the key for each doubling of it; cells of one bucket.
STEPS, CELLS = 2048, 65_536
SEED = 17
#: Without given weights a source gets a share in proportion to its tokens to this power.
ALPHA = 0.7

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL, _INNER = np.zeros(256, np.int64), np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#$%&*|!<>{}[]=_~^\\/@+"]] = 1
_INNER[128:192] = 1

#: Texts to their weights.
Scorer = Callable[[pa.Array], np.ndarray]


def _counts(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of each text that ``table`` marks."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(table[data], out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def word_counts(texts: pa.Array) -> np.ndarray:
    """Runs of characters that are not ASCII white space; null counts 0."""
    parts = [Words(data, offsets, _SPACE).count for _, _, data, offsets in slices(texts)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def letter_share(texts: pa.Array) -> np.ndarray:
    """Quality weight from 0.05 to 1: how much of a text is not ASCII symbols."""
    parts = [np.empty(0)]
    for _, _, data, offsets in slices(texts):
        size = np.diff(offsets) - _counts(_INNER, data, offsets)
        parts.append(np.maximum(1 - _counts(_SYMBOL, data, offsets) / np.maximum(size, 1), 0.05))
    return np.concatenate(parts)


def uniform(id_col: Column, seed: int) -> Column:
    """A hash of the id in (0, 1)."""
    head = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 12)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def _beside(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the source; null is a source like any other."""
    return left.join(right.withColumnRenamed("s", "right_s"), F.col("s").eqNullSafe(F.col("right_s")), how).drop("right_s")


def _measured(raw: DataFrame, text: str, scorer: Scorer, drop_text: bool) -> DataFrame:
    """``raw`` with tokens ``n`` and weight ``w`` of its text."""
    at = raw.columns.index(text)
    stay = [k for k in range(len(raw.columns)) if not (drop_text and k == at)]
    schema = T.StructType([*[raw.schema[k] for k in stay], T.StructField("n", T.LongType()), T.StructField("w", T.DoubleType())])

    return raw.mapInArrow(_measure(at, stay, schema.names, scorer, drop_text), schema)


def _measure(at: int, stay: list[int], names: list[str], scorer: Scorer, counted: bool):
    """Rows with a text in column ``at`` to their columns ``stay``, words if ``counted``, else 0, and weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in parts_of(whole, at)):
            n = word_counts(b.column(at)) if counted else np.zeros(b.num_rows, np.int64)
            arrays = [*[b.column(k) for k in stay], pa.array(n), pa.array(np.asarray(scorer(b.column(at)), np.float64))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _key(id_col: Column, w: Column, seed: int) -> Column:
    """The exponential key; null for a weight that isn't positive, which never comes first."""
    good = w.isNotNull() & ~F.isnan(w) & (w > 0)
    return F.when(good, -F.log(uniform(id_col, seed)) / F.when(good, w))


def _bucket(k: Column) -> Column:
    return F.floor(F.log2(k) * STEPS)


def _cell(k: Column, b: Column) -> Column:
    low, high = F.pow(F.lit(2.0), b / STEPS), F.pow(F.lit(2.0), (b + 1) / STEPS)
    return F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor((k - low) / (high - low) * CELLS)))


def _ends_in(sums: DataFrame, rest: DataFrame, part: str) -> DataFrame:
    """Of (s, part, n): (s, part, before, rest) of the part in which the rest of each source's budget ends."""
    up_to = Window.partitionBy("s").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    run = _beside(sums.withColumn("sum", F.coalesce(F.sum("n").over(up_to), F.lit(0))), rest)
    run = run.withColumn("before", F.col("before") + F.col("sum"))
    return run.where("before <= rest and before + n > rest").select("s", part, "before", "rest")


def plan_mix(narrow: DataFrame, targets: dict[str, float] | None, total: int | None, alpha: float) -> DataFrame:
    """Of (s, i, n, k): (__s, epochs, __all, __k, __i), whole epochs of each source, whether the part epoch has every key, and the last key in it.

    The sums over buckets of a source are at most a few hundred thousand rows,
    whatever the number of its documents.
    """
    sums = stash(narrow.groupBy("s", F.when(F.col("k").isNotNull(), _bucket(F.col("k"))).alias("b")).agg(F.sum("n").alias("n")))
    size = sums.groupBy("s").agg(F.sum("n").alias("t")).where("t > 0")
    if targets is not None:
        given = narrow.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "s string, w double")
        size = _beside(size, given, "left").select("s", "t", F.coalesce("w", F.lit(0.0)).alias("w"))
    else:
        size = size.withColumn("w", F.pow(F.col("t").cast("double"), F.lit(alpha)))
    whole = size.agg(F.sum("w").alias("all_w"), F.sum("t").alias("all_t"))
    budget = F.floor(F.col("w") / F.col("all_w") * (F.lit(total) if total is not None else F.col("all_t")))
    size = size.join(F.broadcast(whole), F.lit(True)).withColumn("budget", F.when(F.col("all_w") > 0, budget).otherwise(F.lit(0)).cast("bigint"))
    size = stash(size.select("s", "t", F.expr("budget div t").alias("epochs"), F.expr("budget % t").alias("rest")))
    edge = stash(_ends_in(sums.where("b is not null"), size.select("s", "rest", F.lit(0).alias("before")), "b"))
    inside = _beside(narrow.where("k is not null"), edge.select("s", F.col("b").alias("edge_b"))).where(_bucket(F.col("k")) == F.col("edge_b"))
    inside = stash(inside.groupBy("s", "k", "i").agg(F.sum("n").alias("n"), F.min(_cell(F.col("k"), F.col("edge_b"))).alias("c")))
    cells = stash(_ends_in(inside.groupBy("s", "c").agg(F.sum("n").alias("n")), edge.select("s", "before", "rest"), "c"))
    # all rows of one key and id are one row by now
    last = _beside(inside, cells.withColumnRenamed("c", "edge_c")).where("c = edge_c").select("s", "k", "i", "n", "before", "rest")
    peers = Window.partitionBy("s").orderBy("k", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = last.withColumn("upto", F.col("before") + F.sum("n").over(peers)).where("upto <= rest")
    taken = taken.select("s", "k", "i").unionByName(_beside(inside, cells.withColumnRenamed("c", "edge_c")).where("c < edge_c").select("s", "k", "i"))
    top = taken.groupBy("s").agg(F.max(F.struct("k", "i")).alias("last"))
    out = _beside(_beside(size.select("s", "epochs", "rest"), edge.select("s", F.col("b").alias("eb")), "left"), top, "left")
    every = F.col("eb").isNull() & (F.col("rest") > 0)
    out = stash(out.select(F.col("s").alias("__s"), "epochs", every.alias("__all"), F.col("eb").alias("__b"), F.col("last.k").alias("__k"), F.col("last.i").alias("__i")))
    for x in (sums, size, edge, inside, cells):
        drop(x)
    return out


def mix_sources(docs: DataFrame, targets: dict[str, float] | None = None, total: int | None = None, alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", source: str = "source", text: str = "text", scorer: Scorer = letter_share) -> DataFrame:
    """``docs`` sampled to its sources' budgets, each row as often as it is taken, with a last column ``__epoch``.

    Epochs count from 0; the part epoch has the number of whole ones.  Without
    ``targets`` the shares go with tokens ** ``alpha``; a source that
    ``targets`` leaves out gets nothing.  ``total`` is the tokens of the mix, by
    default those of ``docs``; tokens are the words of the text.  ``scorer``
    gives the quality weights of an Arrow array of texts.

    A weight that is null, not a number, 0 or less keeps a row out of the part
    epoch, not out of whole ones.  A null source is a source of its own.  A null
    or empty text has no tokens: such a row comes with every whole epoch, and
    with the part epoch if its key isn't above the cut-off.  Rows of one id and
    source and weight have one key and are taken together or not at all in the
    part epoch; null ids share one number, and come first among equal keys.  Ids
    may be of any type with an order and a text form.  Other columns pass
    through, whatever their names, but for ``__epoch``, which is replaced; an
    empty table gives an empty one.
    """
    names = docs.columns
    stay = [j for j, c in enumerate(names) if c != "__epoch"]
    raw = docs.toDF(*[f"c{k}" for k in range(len(names))])
    i, s, t = (f"c{names.index(c)}" for c in (id_col, source, text))
    narrow = _measured(raw.select(F.col(i).alias("i"), F.col(s).cast("string").alias("s"), F.col(t).alias("t")), "t", scorer, True)
    narrow = stash(narrow.select("s", "i", "n", _key(F.col("i"), F.col("w"), seed).alias("k")))
    cuts = plan_mix(narrow, targets, total, alpha)
    drop(narrow)
    keyed = _measured(raw, t, scorer, False).withColumns({"k": _key(F.col(i), F.col("w"), seed), "i": F.col(i), "s": F.col(s).cast("string")})
    got = keyed.join(cuts, F.col("s").eqNullSafe(F.col("__s")))
    b = _bucket(F.col("k"))
    part = (b < F.col("__b")) | ((b == F.col("__b")) & F.col("__k").isNotNull() & (F.struct("k", "i") <= F.struct(F.col("__k").alias("k"), F.col("__i").alias("i"))))
    part = F.col("k").isNotNull() & (F.col("__all") | F.coalesce(part, F.lit(False)))
    times = (F.col("epochs") + F.coalesce(part, F.lit(False)).cast("bigint")).cast("int")
    got = got.withColumn("times", times).where("times > 0")
    got = got.withColumn("e", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return got.select(*[F.col(f"c{j}").alias(names[j]) for j in stay], F.col("e").alias("__epoch"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, epoch) of the mix of all documents at shares of tokens ** 0.7."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", F.col("__epoch").alias("epoch"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '\S+')), 0) AS BIGINT) AS n,
    greatest(1 - coalesce((length(text) - length(translate(text, '#$%&*|!<>{}[]=_~^\/@+', ''))) / greatest(length(text), 1), 0.0), 0.05) AS w,
    (CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':17'), 1, 12)) AS UBIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents),
k AS (SELECT doc_id, source, n, -ln(u) / w AS k FROM d),
t AS (SELECT source, sum(n) AS t, pow(sum(n)::DOUBLE, 0.7) AS w FROM k GROUP BY source HAVING sum(n) > 0),
g AS (SELECT source, t, CAST(floor(w / sum(w) OVER () * sum(t) OVER ()) AS BIGINT) AS budget FROM t),
r AS (SELECT k.*, budget // t AS epochs, budget % t AS rest, sum(n) OVER (PARTITION BY k.source ORDER BY k, doc_id) AS upto FROM k JOIN g USING (source)),
m AS (SELECT doc_id, source, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS times FROM r)
SELECT doc_id, source, CAST(unnest(range(times)) AS INTEGER) AS epoch FROM m
"""
