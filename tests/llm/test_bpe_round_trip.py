"""The round trip of long texts covers the stitching of their pieces."""

import pytest
from pyspark.sql import functions as F

from fathom.llm import bpe

TEXT = " ".join(f"word{k} é" for k in range(60))


def trips(spark):
    rows = [(1, TEXT), (2, "short"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    return {r["doc_id"]: r["round_trip"] for r in bpe.encode(df, chunk=64, overlap=16, verify=True).collect()}


def test_whole_pieces_round_trip(spark):
    assert trips(spark) == {1: True, 2: True, 3: None, 4: True}


@pytest.mark.parametrize("spoil", [lambda p: p.where("piece <> 1"), lambda p: p.union(p.where("piece = 1")), lambda p: p.withColumn("piece", -F.col("piece"))], ids=["lost", "repeated", "misordered"])
def test_spoilt_pieces_do_not(spark, monkeypatch, spoil):
    whole = bpe.pieces
    monkeypatch.setattr(bpe, "pieces", lambda *a: spoil(whole(*a)))
    assert trips(spark) == {1: False, 2: True, 3: None, 4: True}
