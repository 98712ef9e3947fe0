"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(x . w - theta_k): all thresholds share the weights w, and
theta_1 < theta_2 < theta_3.  x marks which hashed features a text has: its
lower-cased words, and their first 4, 5 and 6 bytes (whole characters), which
inflected forms share.

The label table only says toxic or not, so ordered grades are made of it, and
severity is no more than this: a clean text has grade 0; toxic ones are ranked
by how surely a regression of one threshold, fitted on the other ``FOLDS`` - 1
parts of the labelled texts, takes them for toxic, and cut into three equal
parts.  A table of real grades goes in as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.scratch import drop, stash
from fathom.llm.quality import labelled
from fathom.llm.words import PUNCT, Words, slices

NAME = "op3_toxicity"
BITS = 20
#: Size of the model: features kept, those that tell toxic from clean labels best.
KEPT = 8192
#: A feature in fewer labelled texts than this is none of them.
LEAST = 4
GRADES = 3
#: Parts of the labelled texts, by a hash of the text, for the ranks that grades come from, and steps of the models that rank.
FOLDS, RANK_STEPS = 2, 120
#: Labelled rows that the model is fitted on: the ones with the smallest hash of their id.
MAX_TRAIN = 12_000
PENALTY = 2.0
STEPS = 300
#: How many times worse it is to let a toxic text pass than to flag a clean one; a text is toxic from the probability of grade 1 or more at which both cost the same.
MISS_COST = 4
THRESHOLD = 1 / (1 + MISS_COST)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The text of each word, and its buckets: whole word, first 4, 5 and 6 bytes."""
    words = Words(_LOWER[data], offsets, PUNCT)
    kinds = [words.hashes(n) for n in (None, 4, 5, 6)]
    return words.row, [(h >> np.uint64(64 - BITS)).astype(np.int64) for h in kinds]


def _distinct(row: np.ndarray, kinds: list[np.ndarray], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket), or (text, place in the chosen features)."""
    rows, found = [], []
    for b in kinds:
        if chosen is None:
            rows.append(row)
            found.append(b)
        else:
            at = chosen[b]
            hit = np.flatnonzero(at >= 0)
            rows.append(row[hit])
            found.append(at[hit].astype(np.int64))
    key = np.unique((np.concatenate(rows) << BITS) | np.concatenate(found))
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Model:
    """Places and weights of the chosen features, and the thresholds."""

    chosen: np.ndarray
    weights: np.ndarray
    theta: np.ndarray

    def linear(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for i, j, data, offsets in slices(column):
            row, kinds = features(data, offsets)
            r, f = _distinct(row, kinds, self.chosen)
            out[i:j] = np.bincount(r, self.weights[f], j - i)
        return out

    def exceed(self, eta: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES."""
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.theta[None, :], -40, 40)))


def fit_ordinal(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, size: int, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds of greatest penalised likelihood, by Adam on the full gradient."""
    n, levels = len(grade), int(grade.max())
    share = np.array([(grade >= k).mean() for k in range(1, levels + 1)])
    theta = -np.log(share / (1 - share))
    par = np.concatenate([np.zeros(size), [theta[0]], np.log(np.maximum(np.diff(theta), 1e-2))])
    m, v = np.zeros_like(par), np.zeros_like(par)
    for t in range(1, steps + 1):
        w, gaps = par[:size], np.exp(par[size + 1 :])
        theta = par[size] + np.concatenate([[0], np.cumsum(gaps)])
        eta = np.bincount(row, w[feature], n)
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        low, high = 1 / (1 + np.exp(-np.clip(bounds[grade] - eta, -500, 500))), 1 / (1 + np.exp(-np.clip(bounds[grade + 1] - eta, -500, 500)))
        p = np.maximum(high - low, 1e-12)
        dl, dh = low * (1 - low), high * (1 - high)
        g_eta = (dh - dl) / p
        g_theta = np.array([(dl / p)[grade == k].sum() - (dh / p)[grade == k - 1].sum() for k in range(1, levels + 1)])
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(feature, g_eta[row], size) + penalty * w, [tail[0]], tail[1:] * gaps]) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        par = par - 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
    return par[:size], par[size] + np.concatenate([[0], np.cumsum(np.exp(par[size + 1 :]))])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = MAX_TRAIN, id_col: str = "doc_id", text: str = "text") -> Model | None:
    """A model of ``labels`` (doc_id, label); None if no document is labelled or all have one label.

    Labels are 0 or 1, of which grades are made, or grades from 0 themselves, if
    any is greater than 1.  At most ``bound`` labelled ids are fitted on, those
    with the least hashes; the model has at most ``KEPT`` features.  A null id or
    label, an id without a document and a null text are passed over; of several
    labels of one id the greatest counts.  With fewer toxic texts than grades
    there are fewer grades.  Ids must be integers, or strings of integers.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in slices(b.column(0)):
                r, f = _distinct(*features(data, offsets))
                cut = np.searchsorted(r, np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(f.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), lists, b.column(2).slice(i, j - i)], ["y", "f", "t"])

    train = labelled(docs, labels, label, bound, id_col, text).withColumn("t", F.xxhash64("text"))
    seen = stash(train.mapInArrow(extract, "y double, f array<int>, t bigint"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False) > 0
            f = b.column(1).flatten().to_numpy(zero_copy_only=False)
            toxic = np.repeat(y, np.diff(b.column(1).offsets.to_numpy()))
            total[0] += np.bincount(f[~toxic], minlength=1 << BITS)
            total[1] += np.bincount(f[toxic], minlength=1 << BITS)
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0][at]), pa.array(total[1][at])], ["f", "n0", "n1"])

    n0, n1 = seen.agg(F.coalesce(F.count_if(F.col("y") == 0), F.lit(0)), F.coalesce(F.count_if(F.col("y") > 0), F.lit(0))).first()
    if not n0 or not n1:
        drop(seen)
        return None
    sums = seen.mapInArrow(tally, "f int, n0 bigint, n1 bigint").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    r0, r1 = (F.col("n0") + 0.5) / (n0 + 1), (F.col("n1") + 0.5) / (n1 + 1)
    error = F.sqrt(1 / (F.col("n0") + 0.5) + 1 / (F.col("n1") + 0.5))
    sums = sums.where(F.col("n0") + F.col("n1") >= LEAST).withColumn("z", F.log(r1 / r0) / error)
    best = sums.orderBy(F.abs("z").desc(), "f").limit(KEPT).select("f").collect()
    chosen = np.full(1 << BITS, -1, np.int16)
    chosen[[r["f"] for r in best]] = np.arange(len(best))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = chosen[b.column(1).flatten().to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))[at >= 0]
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(at[at >= 0]))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, b.column(2)], ["y", "f", "t"])

    got = seen.mapInArrow(place, "y double, f array<smallint>, t bigint").toArrow().sort_by("t")
    drop(seen)
    lists = got.column("f").combine_chunks()
    y, fold = got.column("y").to_numpy().astype(np.int64), got.column("t").to_numpy() % FOLDS
    feature = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    grade = y if y.max() > 1 else grades(row, feature, y, fold, len(best))
    weights, theta = fit_ordinal(row, feature, np.searchsorted(np.unique(grade), grade), len(best))
    return Model(chosen, weights, theta)


def grades(row: np.ndarray, feature: np.ndarray, y: np.ndarray, fold: np.ndarray, size: int) -> np.ndarray:
    """Grades 0 to GRADES of labels 0 and 1: the rank of a toxic text among them by a model that didn't see it."""
    eta = np.zeros(len(y))
    for f in range(FOLDS):
        own = fold == f
        if own.any() and len(np.unique(y[~own])) == 2:
            number = np.cumsum(~own) - 1
            used = ~own[row]
            w, _ = fit_ordinal(number[row[used]], feature[used], y[~own], size, steps=RANK_STEPS)
            eta[own] = np.bincount(row, w[feature], len(y))[own]
    toxic = np.flatnonzero(y)
    rank = np.empty(len(toxic), np.int64)
    rank[np.argsort(eta[toxic], kind="stable")] = np.arange(len(toxic))
    out = np.zeros(len(y), np.int64)
    out[toxic] = 1 + rank * GRADES // len(toxic)
    return out


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, severity, grade, is_toxic) of every row of ``docs``.

    ``severity`` is the expected grade, ``grade`` the most probable one.  A null
    text counts as empty, an empty text has no features and gets the base rate;
    repeated rows score alike; a null id stays null; other columns are ignored.
    Without a model (no labels, or only one) severity and grade are null and
    nothing is toxic.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("severity"), F.lit(None).cast("int").alias("grade"), F.lit(False).alias("is_toxic"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = sent.value.exceed(sent.value.linear(b.column(1)))
            each = np.concatenate([np.ones((len(p), 1)), p], 1) - np.concatenate([p, np.zeros((len(p), 1))], 1)
            parts = [pa.array(p.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(p[:, 0] >= THRESHOLD)]
            yield pa.RecordBatch.from_arrays([b.column(0), *parts], ["doc_id", "severity", "grade", "is_toxic"])

    return rows.mapInArrow(run, "doc_id bigint, severity double, grade int, is_toxic boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity, grade, and whether it is toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


SQL = None
