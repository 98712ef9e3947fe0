"""Near pairs against all pairs: certain below 2 * SEGMENTS bits, recall of at least 0.9 up to the largest distance."""

import random

import numpy as np
import pyarrow as pa
import pytest

from fathom.llm import simhash
from fathom.llm.simhash import BITS, MAX_BITS, SEGMENTS, _fixed, apart, near_edges, near_groups, signatures
from fathom.llm.words import slices


def components(n, pairs):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def flipped(rng, row, errors):
    out = row.copy()
    out[rng.choice(BITS, errors, replace=False)] ^= 1
    return out


def edges(spark, bits):
    sig = _fixed(np.packbits(bits, axis=1)).to_pylist()
    return {tuple(r) for r in near_edges(spark.createDataFrame(list(enumerate(sig)), "node bigint, sig binary")).collect()}


@pytest.mark.parametrize("errors", [1, 2 * SEGMENTS - 1, 50, 65, MAX_BITS])
def test_pairs_with_random_bit_errors_are_found(spark, errors):
    rng = np.random.default_rng(errors)
    bits = rng.integers(0, 2, (1500, BITS), dtype=np.uint8)
    got = edges(spark, np.concatenate([bits, [flipped(rng, row, errors) for row in bits]]))
    assert got <= {(i, i + 1500) for i in range(1500)}
    assert len(got) >= (1.0 if errors < 2 * SEGMENTS else 0.9) * 1500


@pytest.mark.parametrize("dense, hot", [(8, 8192), (0, 8192), (0, 40)], ids=["pairs", "forest", "cells"])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, dense, hot):
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(12):  # clouds of mutually near ones, chains, and loners
        head = rng.integers(0, 2, BITS, dtype=np.uint8)
        rows += [head, *[flipped(rng, head, int(rng.integers(1, 18))) for _ in range(30)]]
        for _ in range(4):
            head = flipped(rng, head, 2 * SEGMENTS - 1)
            rows.append(head)
    bits = np.array(rows)
    words = np.packbits(bits, axis=1).view(np.uint64)
    d = apart(words[:, None], words[None])
    near = np.argwhere(np.triu(d <= MAX_BITS, 1))
    got = edges(spark, bits)
    assert got <= {tuple(p) for p in near}
    assert components(len(rows), got) == components(len(rows), near)


def test_classes_of_a_table_are_those_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").where("text is not null").collect())
    parts = [signatures(data, offsets) for _, _, data, offsets in slices(pa.array([r["text"] for r in rows]))]
    sig, worded = np.concatenate([p[0] for p in parts]).view(np.uint64), np.concatenate([p[1] for p in parts])
    near = [(i, j) for i in range(len(rows)) if worded[i] for j in i + 1 + np.flatnonzero((apart(sig[i], sig[i + 1 :]) <= MAX_BITS) & worded[i + 1 :])]
    top = components(len(rows), near)
    expect = {rows[i]["doc_id"]: rows[t]["doc_id"] for i, t in enumerate(top) if top.count(t) > 1}
    got = {r["doc_id"]: r["group_id"] for r in near_groups(docs).collect()}
    assert set(got) <= set(expect) and sum(expect[i] == g for i, g in got.items()) >= 0.98 * len(expect)


def test_copies_with_edits_of_6_to_12_percent_of_the_words(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 8)))
    texts = []
    for _ in range(500):
        own = [word() for _ in range(300)]
        edited = list(own)
        for at in rng.sample(range(300), rng.randint(18, 36)):
            edited[at] = word()
        texts += [" ".join(own), " ".join(edited)]
    sig = np.concatenate([signatures(data, offsets)[0] for _, _, data, offsets in slices(pa.array(texts))]).view(np.uint64)
    d = apart(sig[0::2], sig[1::2])
    group = {r["doc_id"]: r["group_id"] for r in near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    near = [k for k in range(500) if 60 <= d[k] <= MAX_BITS]
    assert len(near) > 150
    assert np.mean([group.get(2 * k) == 2 * k == group.get(2 * k + 1) for k in near]) >= 0.9
