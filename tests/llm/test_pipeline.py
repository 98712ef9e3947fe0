"""The pipeline: every stage alone on awkward rows, and the whole against plain Python on a small table."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from fathom.llm.bpe import VOCABULARY, encoding  # noqa: E402
from fathom.llm.quality import THRESHOLD, batch_stats  # noqa: E402
from fathom.llm.simhash import MAX_BITS, apart, signatures  # noqa: E402
from fathom.llm.words import slices  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
GOOD = "The river was slow that morning, and nobody on the bridge seemed to mind the long wait for the boats to pass. "
ROWS = [
    (1, GOOD * 3, "en", "a", 1), (1, GOOD * 3, "en", "a", 1), (2, GOOD * 3, "en", "b", 2), (3, None, None, None, None), (3, None, "en", "a", 0),
    (4, "", "en", "a", 0), (5, "", "en", None, 0), (None, GOOD, "en", "a", 3), (None, None, None, "b", None), (6, "é" * 200_000, "de", "b", 9), (7, " .,\n", "en", "b", 4),
    (8, GOOD + GOOD.replace("river", "creek") + GOOD, "en", "a", 5),
]


def table(spark, rows, extra=True):
    d = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for c in ("__gone", "__listed", "k", "c0", "h", "own", "tokens"):
            d = d.withColumn(c, F.lit(7))
        d = d.withColumn("a.b", F.lit("x"))
    return d


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("k", range(5), ids=[n for n, _ in pipeline.STAGES])
def test_stage_on_awkward_rows(spark, k):
    name, stage = pipeline.STAGES[k]
    got = stage(spark, table(spark, ROWS), SF)
    assert got.columns == (pipeline.COLUMNS if k < 4 else ["doc_id", "source", "tokens", "n_tokens"])
    found = rows_of(got)
    if k < 4:
        assert set(found) <= set(ROWS)
    if name == "exact_dedup":
        assert sorted(found, key=str) == sorted([ROWS[0], ROWS[3], ROWS[4], ROWS[5], *ROWS[7:12]], key=str)
    if name == "near_dedup":
        assert (2, GOOD * 3, "en", "b", 2) not in found and {ROWS[3], ROWS[4], ROWS[5], ROWS[6], ROWS[8], ROWS[10]} <= set(found)
    if name == "bpe":
        assert len(found) == len(ROWS) and all((r[2] is None) == (r[3] is None) for r in found)
    assert stage(spark, table(spark, []), SF).count() == 0
    assert rows_of(stage(spark, table(spark, ROWS), SF)) == found


def test_the_whole_against_plain_python(spark):
    got = pipeline.run(spark, SF).collect()
    docs = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    model = pipeline._model(spark, SF)
    p = lambda texts: model.probability(model.raw(batch_stats(pa.array(texts))))
    kept = [d for d, ok in zip(docs, p([d[1] for d in docs]) >= THRESHOLD) if ok]
    first = {}
    for d in kept:
        first.setdefault(d[1], d)
    kept = list(first.values())
    parts = [signatures(data, offsets)[0] for _, _, data, offsets in slices(pa.array([d[1] for d in kept]))]
    sig = np.concatenate(parts).view(np.uint64)
    near = (apart(sig[:, None], sig[None]) <= MAX_BITS).astype(int)
    while True:
        wider = (near @ near > 0).astype(int)
        if (wider == near).all():
            break
        near = wider
    kept = [d for k, d in enumerate(kept) if near[k].argmax() == k]
    # the mix keeps each source's whole epochs, and of the part epoch what fits in the order of the keys
    size = {}
    for _, text, source in kept:
        size[source] = size.get(source, 0) + len(re.findall(r"[^\t-\r ]+", text))
    root = {s: float(n) ** 0.7 for s, n in size.items()}
    times = {}
    for s, n in size.items():
        budget = int(np.floor(root[s] / sum(root.values()) * sum(size.values())))
        own = [d for d in kept if d[2] == s]
        w = np.maximum(np.round(p([d[1] for d in own]), 4), 0.01)
        md5 = lambda i: __import__("hashlib").md5(f"{i}:17".encode()).hexdigest()[:12]
        key = [-np.log((int(md5(d[0]), 16) + 0.5) / 2**48) / x for d, x in zip(own, w)]
        run = 0
        for k in np.argsort(key):
            run += len(re.findall(r"[^\t-\r ]+", own[k][1]))
            times[own[k][0]] = budget // n + (run <= budget % n)
    enc = encoding(VOCABULARY)
    text = {d[0]: d[1] for d in kept}
    expect = sorted((i, enc.encode_ordinary(text[i])) for i, n in times.items() for _ in range(n))
    assert sorted((r["doc_id"], r["tokens"]) for r in got) == expect
    assert all(r["n_tokens"] == len(r["tokens"]) for r in got)
