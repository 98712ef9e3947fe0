"""The classifiers' queries against plain NumPy and Python over the same rows."""

import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from fathom.llm import quality, toxicity
from fathom.llm.quality import FOLDS, GRID, RIDGE, batch_stats, fit_quality, isotonic
from fathom.llm.toxicity import features, fit_ordinal, fit_toxicity, grades

SF = "/root/testdata/sf0.01"


def tables(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    labels = dict(duckdb.sql(f"SELECT doc_id, max(quality) FROM '{SF}/labels.parquet' WHERE quality IS NOT NULL GROUP BY doc_id").fetchall())
    h = {r["doc_id"]: r["h"] for r in spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "xxhash64(text) as h").collect()}
    return docs, labels, h


def pooled(values, weights):
    """Isotonic regression by its min-max formula."""
    n = len(values)
    mean = [[np.average(values[i : j + 1], weights=weights[i : j + 1]) if j >= i else math.inf for j in range(n)] for i in range(n)]
    return np.array([max(min(mean[i][j] for j in range(k, n)) for i in range(k + 1)) for k in range(n)])


def test_isotonic_is_the_min_max_formula():
    rng = np.random.default_rng(3)
    for _ in range(20):
        v, w = rng.integers(0, 5, 12).astype(float), rng.integers(1, 4, 12).astype(float)
        assert np.allclose(isotonic(v, w), pooled(v, w))


def test_quality_query_is_ridge_on_all_rows_and_calibration_on_the_others(spark):
    docs, labels, h = tables(spark)
    own = [(i, t) for i, t in docs if i in labels and t is not None]
    y = np.array([labels[i] for i, _ in own], float)
    x = batch_stats(pa.array([t for _, t in own]))
    model = fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-3))
    z = model.project(x)
    fit = lambda z, y: np.linalg.lstsq(np.vstack([z, math.sqrt(RIDGE * len(z)) * np.eye(z.shape[1])]), np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(model.weights, fit(z, y), atol=1e-6)
    fold = np.array([h[i] % FOLDS for i, _ in own])
    raw = np.empty(len(y))
    for k in range(FOLDS):
        raw[fold == k] = z[fold == k] @ fit(z[fold != k], y[fold != k])
    at = np.clip(((raw + 0.5) * (GRID / 2)).astype(int), 0, GRID - 1)
    cells = np.unique(at)
    n = np.array([(at == c).sum() for c in cells], float)
    good = np.array([y[at == c].sum() for c in cells])
    edges, values = (cells + 0.5) / (GRID / 2) - 0.5, isotonic(good / n, n)
    got = {r["doc_id"]: r for r in quality.query(spark, SF).collect()}
    every = model.project(batch_stats(pa.array([t for _, t in docs]))) @ fit(z, y)
    assert np.allclose([got[i]["score"] for i, _ in docs], every, atol=1e-6)
    assert np.mean(np.abs(np.interp(every, edges, values) - [got[i]["probability"] for i, _ in docs]) < 0.02) > 0.99


WORD = re.compile(rb"[^\x09-\x0d\x1c-\x20!-/:-@\[-`{-~]+")


def test_toxicity_query_is_its_model_word_by_word(spark):
    docs, _, _ = tables(spark)
    model = fit_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r["doc_id"]: r for r in toxicity.query(spark, SF).collect()}
    assert len(got) == len(docs) and (np.diff(model.theta) > 0).all()

    def buckets(word):
        kinds = features(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[1]
        return {int(k[0]) for k in kinds}

    for i, t in docs[:200]:
        held = {int(model.chosen[b]) for w in set(WORD.findall((t or "").encode())) for b in buckets(w)} - {-1}
        eta = sum(model.weights[f] for f in held)
        p = [1 / (1 + math.exp(-(eta - c))) for c in model.theta]
        each = [1 - p[0], *[a - b for a, b in zip(p, p[1:])], p[-1]]
        assert abs(got[i]["severity"] - sum(k * q for k, q in enumerate(each))) < 1e-9 and got[i]["grade"] == int(np.argmax(each))
        assert got[i]["is_toxic"] == (p[0] >= toxicity.THRESHOLD)


def test_ordinal_fit_is_a_maximum():
    """No small step from the fit makes the penalised likelihood greater by more than rounding."""
    rng = np.random.default_rng(6)
    x = rng.random((600, 4)) < 0.4
    grade = (x @ np.array([1.5, -1, 0.5, 0]) + rng.logistic(size=600) > np.array([[0.2], [1.5]])).sum(0)
    row, feature = np.nonzero(x)
    w, theta = fit_ordinal(row, feature, grade, 4, penalty=1.0, steps=2000)

    def value(w, theta):
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        cdf = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
        eta = x @ w
        return np.log(cdf(bounds[grade + 1] - eta) - cdf(bounds[grade] - eta)).sum() - 0.5 * (w**2).sum()

    best = value(w, theta)
    for k in range(6):
        for step in (0.02, -0.02):
            par = np.concatenate([w, theta])
            par[k] += step
            assert value(par[:4], par[4:]) < best + 1e-3


def test_grades_rank_the_toxic_and_are_even():
    rng = np.random.default_rng(7)
    y = (rng.random(900) < 0.2).astype(int)
    x = rng.random((900, 6)) < np.where(y[:, None] == 1, 0.6, 0.1)
    row, feature = np.nonzero(x)
    g = grades(row, feature, y, rng.integers(0, toxicity.FOLDS, 900), 6)
    assert (g[y == 0] == 0).all() and np.ptp(np.bincount(g[y == 1])[1:]) <= 1
    hits = x.sum(1)
    assert hits[g == 3].mean() > hits[g == 1].mean()
    assert set(grades(row, feature, np.where(np.arange(900) == np.flatnonzero(y)[0], 1, 0), rng.integers(0, toxicity.FOLDS, 900), 6)) == {0, 1}


@pytest.mark.parametrize("part", [1, 3])
def test_toxicity_on_splits_that_set_nothing(spark, part):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.xxhash64("doc_id", F.lit("fresh")) % 4 == part
    rows = toxicity.score_toxicity(docs, fit_toxicity(docs, labels.where(~held))).join(labels.where(held), "doc_id").select("is_toxic", "toxic").toPandas()
    bad = rows["toxic"] == 1
    print(part, rows["is_toxic"][bad].mean(), rows["is_toxic"][~bad].mean())
    assert rows["is_toxic"][bad].mean() > 0.8 and rows["is_toxic"][~bad].mean() < 0.02
