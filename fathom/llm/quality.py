"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a document go through cosines of random projections, which
approximates a Gaussian kernel.  Each partition of the labelled rows adds up its
normal equations, those of each fold apart; the sum of all folds is solved for
ridge weights.  For the calibration a row is scored with weights of the other
folds, which never saw it: a monotone function from raw score to probability is
fitted by pooling adjacent violators on counts of a fine grid of such scores,
also summed by partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.scratch import drop, stash
from fathom.llm.words import PUNCT, SPACE, Words, parts_of, slices

NAME = "op9_quality_classifier"
FEATURES = 256
SIGMA = 2.5
RIDGE = 1e-3
SEED = 11
#: Parts of the labelled rows, by a hash of the text, for scores that the calibration is fitted on.
FOLDS = 5
#: Score grid of the calibration.
GRID = 2048
#: Labelled rows that the classifier is fitted on: the ones with the smallest hash of their id.
MAX_TRAIN = 20_000
#: Bytes of text and rows of statistics that are worked on at once.
STEP, ROWS = 1 << 18, 1024
#: Documents below this probability of being good are rejected.
THRESHOLD = 0.5

_LOWER, _UPPER, _DIGIT, _SYMBOL, _STOP = (np.zeros(256, bool) for _ in range(5))
_LOWER[97:123], _UPPER[65:91], _DIGIT[48:58] = True, True, True
_SYMBOL[[ord(c) for c in "#$%&*|<>{}[]=_~^\\/@+!"]] = True
_STOP[[ord(c) for c in ".,;:?"]] = True
_HIGH = np.arange(256) >= 128
_LINE = np.arange(256) == 10
_CLASSES = np.stack([_LOWER, _UPPER, _DIGIT, _SYMBOL, _STOP, _HIGH, SPACE, _LINE], 1).astype(np.float64)
STATS = _CLASSES.shape[1] + 6


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers about each text: byte classes, word lengths, repetition, symbols at word ends."""
    n = len(offsets) - 1
    words = Words(data, offsets, SPACE)
    sizes = np.diff(offsets)
    out = np.zeros((n, STATS))
    full = np.maximum(sizes, 1)
    at = data if n == 1 else np.repeat(np.arange(n) * 256, sizes) + data
    counts = np.bincount(at, minlength=n * 256).reshape(n, 256)
    out[:, :8] = counts @ _CLASSES / full[:, None]
    many = np.maximum(words.count, 1)
    length = (words.end - words.start).astype(np.float64)
    where = words.row
    mean = np.bincount(where, length, n) / many
    out[:, 8] = np.minimum(mean, 40) / 10
    out[:, 9] = np.sqrt(np.maximum(np.bincount(where, length**2, n) / many - mean**2, 0)) / 10
    if len(where):
        h = words.hashes()
        order = np.lexsort((h, where))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (where[order][1:] != where[order][:-1])
        distinct = np.bincount(where[order][fresh], minlength=n)
        out[:, 10] = distinct / many ** 0.9
        out[:, 11] = np.bincount(where, _SYMBOL[data[words.end - 1]], n) / many
        out[:, 12] = np.bincount(where, PUNCT[data[words.start]], n) / many
    out[:, 13] = np.log1p(words.count) / 10
    return np.minimum(out, 10)


@dataclass
class Model:
    """What scoring needs; a few kilobytes whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def project(self, stats: np.ndarray) -> np.ndarray:
        z = np.cos((stats - self.mean) / self.scale @ self.directions + self.phases) * np.sqrt(2 / FEATURES)
        return np.concatenate([z, np.ones((len(z), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        parts = [self.project(stats[k : k + ROWS]) @ self.weights for k in range(0, len(stats), ROWS)]
        return np.concatenate(parts) if parts else np.empty(0)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.edges, self.values)


def batch_stats(column: pa.Array) -> np.ndarray:
    parts = [statistics(d, o) for _, _, d, o in slices(column, STEP)]
    return np.concatenate(parts) if parts else np.zeros((0, STATS))


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to ``values``, by pooling adjacent violators."""
    level: list[list[float]] = []
    for v, w in zip(values, weights):
        level.append([v, w, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            b, a = level.pop(), level.pop()
            w2 = a[1] + b[1]
            level.append([(a[0] * a[1] + b[0] * b[1]) / w2 if w2 else a[0], w2, a[2] + b[2]])
    return np.concatenate([np.full(int(k), v) for v, _, k in level]) if level else np.array([])


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, y) of at most ``bound`` labelled documents: the ids with the smallest hashes.

    The bound caps what is broadcast; everything else is left to the join.
    """
    want = labels.select(F.col("doc_id").cast("bigint").alias("i"), F.col(label).cast("double").alias("y")).where("i is not null and y is not null")
    want = want.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(bound)
    rows = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text).alias("text")).where("text is not null")
    return rows.join(F.broadcast(want), "i").select("text", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = MAX_TRAIN, id_col: str = "doc_id", text: str = "text") -> Model | None:
    """A model of ``labels`` (doc_id, label 0 or 1); None if no document is labelled or all have one label.

    At most ``bound`` labelled ids are fitted on, the ones with the least hashes.
    A null id or label, an id without a document and a null text are passed
    over; of several labels of one id the greatest counts.  Ids must be integers,
    or strings of integers.
    """
    train = labelled(docs, labels, label, bound, id_col, text)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = batch_stats(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), STATS).cast(pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "y", "fold"])

    train = train.select("text", "y", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    seen = stash(train.mapInArrow(stats, "x array<double>, y double, fold int"))
    cols = [F.element_at("x", j + 1) for j in range(STATS)]
    row = seen.agg(F.count(F.lit(1)), F.min("y"), F.max("y"), *[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    if not row[0] or row[1] == row[2]:
        drop(seen)
        return None
    mean, spread = np.array(row[3 : 3 + STATS]), np.array(row[3 + STATS :])
    rng = np.random.Generator(np.random.PCG64(SEED))
    model = Model(mean, np.maximum(spread, 1e-3), rng.standard_normal((STATS, FEATURES)) / SIGMA, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    size = FEATURES + 1

    def read(b: pa.RecordBatch) -> np.ndarray:
        return b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, STATS)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size + 1))
        for b in batches:
            z = model.project(read(b))
            y, fold = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for f in range(FOLDS):
                at = fold == f
                total[f, :, :size] += z[at].T @ z[at]
                total[f, :, size] += z[at].T @ y[at]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    each = _sum(seen.mapInArrow(equations, "m binary"), (FOLDS, size, size + 1))

    def solved(whole: np.ndarray) -> np.ndarray:
        # the last feature is 1, so the last entry counts the rows
        return np.linalg.solve(whole[:, :size] + RIDGE * whole[size - 1, size - 1] * np.eye(size), whole[:, size])

    whole = each.sum(0)
    model.weights = solved(whole)
    others = np.stack([solved(whole - part) if part[size - 1, size - 1] < whole[size - 1, size - 1] else model.weights for part in each])

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, GRID))
        for b in batches:
            y, fold = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            raw = (model.project(read(b)) * others[fold]).sum(1)
            at = np.clip(((raw + 0.5) * (GRID / 2)).astype(np.int64), 0, GRID - 1)
            total[0] += np.bincount(at, minlength=GRID)
            total[1] += np.bincount(at, y, GRID)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    n, good = _sum(seen.mapInArrow(grid, "m binary"), (2, GRID))
    drop(seen)
    at = np.flatnonzero(n)
    model.edges = (at + 0.5) / (GRID / 2) - 0.5
    model.values = isotonic(good[at] / n[at], n[at])
    return model


def _sum(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of one matrix a partition, added up in groups of 64 before the last step."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer(), np.float64).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    grouped = parts.coalesce(64).mapInArrow(add, "m binary")
    total = np.zeros(shape)
    for r in grouped.toLocalIterator():
        total += np.frombuffer(bytes(r["m"]), np.float64).reshape(shape)
    return total


def _pass(model: Model, text_at: int, keep: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in parts_of(whole, text_at)):
            raw = model.raw(batch_stats(b.column(text_at)))
            p = model.probability(raw)
            if keep is not None:
                yield b.filter(pa.array(p >= keep))
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw), pa.array(p), pa.array(p >= THRESHOLD)], ["doc_id", "score", "probability", "keep"])

    return run


def score_quality(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, probability, keep) of every row of ``docs``.

    A null text counts as empty; repeated rows score alike; a null id stays
    null.  Other columns are ignored.  Without a model (no labels, or only one)
    scores are null and everything is kept.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("probability"), F.lit(True).alias("keep"))
    return rows.mapInArrow(_pass(model, 1, None), "doc_id bigint, score double, probability double, keep boolean")


def filter_quality(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose probability of being good is at least ``threshold``, all columns kept, whatever their names.

    A null text counts as empty; repeated rows stay or go together; without a
    model everything stays; an empty table gives an empty one.
    """
    if model is None:
        return docs
    raw = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return raw.mapInArrow(_pass(model, docs.columns.index(text), threshold), raw.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, calibrated probability of being good, and whether it is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


SQL = None
