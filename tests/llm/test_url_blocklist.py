"""The registered filter over all URLs: a complement at every size, several levels, exact."""

import re

import __spark_entry__ as entry
import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fathom.llm.url_cascade import BLOCKED, NAME, build_cascade, cascade_filter, host, url_key


def levels(cascade):
    at, n = 0, 0
    while at < len(cascade):
        at += 16 + (int(np.frombuffer(cascade, np.int64, 1, at)[0]) + 7) // 8
        n += 1
    return n


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_listed_urls_are_those_of_blocked_sites(spark, sf):
    at = f"/root/testdata/{sf}"
    got = {r["page_id"]: r for r in entry.queries()[NAME](spark, at).collect()}
    urls = {r["page_id"]: r["url"] for r in pq.read_table(f"{at}/pages.parquet", columns=["page_id", "url"]).to_pylist()}
    assert {i: r["listed"] for i, r in got.items()} == {i: bool(set(re.split(r"[./]+", u.split("://")[1])) & set(BLOCKED)) for i, u in urls.items()}
    assert 0 < sum(r["listed"] for r in got.values()) < len(got) / 2
    assert len({r["key"] for r in got.values()}) > 0.9 * len(urls)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{at}/pages.parquet'")
    assert set(db.execute(entry.oracle_sql()[NAME]).fetchall()) == {tuple(r) for r in got.values()}


def test_cascade_of_the_registered_list_has_several_levels(spark):
    out = entry.queries()[NAME](spark, "/root/testdata/sf0.1").select(F.xxhash64("key").alias("h"), "listed").distinct().toPandas()
    h, flag = out["h"].to_numpy().view(np.uint64), out["listed"].to_numpy()
    assert levels(build_cascade(h[flag], h[~flag])) >= 2


def test_url_keys(spark):
    urls = ["HTTP://A.b/C/d.html?x=1#y", "https://a.b:443/C/d.html", "https://x?q", "https://x/", "https://u@x.\\a//", "nothing", None]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(url_key(F.col("u"))).collect()] == ["a.b/C/d.html", "a.b/C/d.html", "x", "x", "x/a", None, None]


def test_a_host_is_the_same_however_it_is_written(spark):
    urls = ["http://evil.com/x", "http://user@evil.com:80/x", "http://a:b@c@evil.com", "http://evil.com./", "//evil.com/a", " HTTPS://EVIL.com?q@r", "http://evil.com\\@good.com/", "http://[::1]:8/", "http:///x", "http://@/", "mailto:a@b", ""]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(host(F.col("u"))).collect()]
    assert got == ["evil.com"] * 7 + ["[::1]", None, None, None, None]


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_clashing_and_dotted_names(spark, limit):
    rows = spark.createDataFrame([("a", 1, True, 5), ("b", 2, True, 6), (None, 3, True, 7)], "k string, `a.b` int, hit boolean, __h int")
    got = cascade_filter(spark, rows, F.col("k"), spark.createDataFrame([("a", 0)], "`x.y` string, k int"), broadcast_bytes=limit, flag="hit")
    assert got.columns == ["k", "a.b", "__h", "hit"]
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 1, 5, True), ("b", 2, 6, False), (None, 3, 7, False)]
