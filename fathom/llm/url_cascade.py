"""Exact membership in a key list through cascades of Bloom filters.

Level 1 of a cascade holds the listed keys; level 2 holds the keys of the
universe that level 1 takes for listed and are not; level 3 holds the listed
keys that level 2 takes; and so on until nobody is taken wrongly.  A key of the
universe is listed exactly if the first level that misses it is an even one
(counting the level after the last as a miss).  Keys are spread over shards by
hash, and each shard has a cascade of its own, so that building is parallel and
a shard's filter stays small however large the list is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.scratch import drop, stash

NAME = "op6_url_filter"
U = np.uint64
#: Keys of the universe in one shard, on average.
SHARD_KEYS = 200_000
#: Parts that the rows of one shard are spread over where filters aren't broadcast.
SALTS = 8
#: All filters together are sent to every executor up to this many bytes.
BROADCAST_BYTES = 32 << 20


def _salted(h: np.ndarray, level: int) -> np.ndarray:
    x = h ^ U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _slots(h: np.ndarray, level: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    x = _salted(h, level)
    a, b = x & U(0xFFFFFFFF), (x >> U(32)) | U(1)
    for i in range(hashes):
        yield (a + U(i) * b) % U(bits)


def _build(inside: np.ndarray, level: int, rate: float) -> tuple[int, int, np.ndarray]:
    bits = max(64, math.ceil(-len(inside) * math.log(rate) / math.log(2) ** 2))
    hashes = max(1, round(bits / max(1, len(inside)) * math.log(2)))
    flags = np.zeros(bits, bool)
    for s in _slots(inside, level, bits, min(hashes, 16)):
        flags[s] = True
    return bits, min(hashes, 16), np.packbits(flags)


def _taken(h: np.ndarray, level: int, bits: int, hashes: int, packed: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for s in _slots(h, level, bits, hashes):
        hit &= (packed[(s >> U(3)).astype(np.int64)] >> (U(7) - (s & U(7))).astype(np.uint8)) & 1 == 1
    return hit


def build_cascade(listed: np.ndarray, others: np.ndarray) -> bytes:
    """A cascade that tells ``listed`` from ``others`` without error; both are arrays of distinct 64-bit hashes.

    The first level errs on sqrt(r/2) of r listed to other keys, later ones on half.
    """
    out, level, inside, outside = [], 0, listed, others
    while len(inside):
        rate = 0.5 if level else min(0.5, max(1e-6, math.sqrt(0.5) * len(inside) / max(1, len(outside))))
        bits, hashes, packed = _build(inside, level, rate)
        out.append(np.array([bits, hashes], np.int64).tobytes() + packed.tobytes())
        inside, outside = outside[_taken(outside, level, bits, hashes, packed)], inside
        level += 1
    return b"".join(out)


def ask_cascade(cascade: bytes, h: np.ndarray) -> np.ndarray:
    """Whether each hash is listed; exact for every key of the universe."""
    at, level = 0, 0
    open_ = np.arange(len(h))
    verdict = np.zeros(len(h), bool)
    while at < len(cascade) and len(open_):
        bits, hashes = np.frombuffer(cascade, np.int64, 2, at)
        n = (int(bits) + 7) // 8
        packed = np.frombuffer(cascade, np.uint8, n, at + 16)
        at += 16 + n
        hit = _taken(h[open_], level, int(bits), int(hashes), packed)
        verdict[open_[~hit]] = level % 2 == 1
        open_ = open_[hit]
        level += 1
    verdict[open_] = level % 2 == 1
    return verdict


def _shard_cascades(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, hash, listed) sorted by shard to one cascade a shard."""
    open_shard, parts = None, []

    def close() -> pa.RecordBatch:
        h = np.concatenate([p[0] for p in parts]).view(np.uint64)
        flag = np.concatenate([p[1] for p in parts])
        made = build_cascade(h[flag], h[~flag])
        return pa.RecordBatch.from_arrays([pa.array([open_shard], pa.int32()), pa.array([made], pa.binary())], ["shard", "cascade"])

    for b in batches:
        shard, h, flag = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if open_shard is not None and shard[i] != open_shard:
                yield close()
                parts = []
            open_shard = int(shard[i])
            parts.append((h[i:j], flag[i:j]))
    if open_shard is not None:
        yield close()


def _shard(hash_: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(hash_, 20), F.lit(shards)).cast("int")


def cascade_filter(spark: SparkSession, rows: DataFrame, key: Column, listed: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, flag: str = "__listed") -> DataFrame:
    """``rows`` with a last column ``flag``: whether ``key`` is among the keys of ``listed`` (its first column).

    The universe is all keys of ``rows`` and of ``listed``.  Two different keys
    with one 64-bit hash, of which one is listed, raise an error rather than
    give a wrong answer.  A null key is not listed; null listed keys are passed
    over, repeated ones count once; empty tables work on either side.  All other
    columns pass through, whatever their names, but for one called ``flag``,
    which is replaced.  The filters are broadcast if they fit in
    ``broadcast_bytes``; beyond that rows travel to their shard and meet its one
    filter there.
    """
    names = rows.columns
    stay = [i for i, c in enumerate(names) if c != flag]
    rows = rows.select("*", key.alias("__key")).toDF(*[f"c{i}" for i in range(len(names))], "k")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    want = listed.toDF(*[f"k{i}" for i in range(len(listed.columns))]).select(F.col("k0").alias("k")).where("k is not null").distinct().withColumn("l", F.lit(True))
    have = rows.select("k").where("k is not null").distinct().withColumn("l", F.lit(False))
    universe = want.unionByName(have).groupBy("k").agg(F.max("l").alias("l")).withColumn("h", F.xxhash64("k"))
    known = stash(universe.groupBy("h").agg(F.max("l").alias("l"), F.min("l").alias("all_l")))
    n, clash = known.agg(F.count(F.lit(1)), F.count_if(F.col("l") & ~F.col("all_l"))).first()
    if clash:
        raise ValueError(f"{clash} 64-bit hashes stand for both a listed and an unlisted key")
    shards = max(1, math.ceil(n / SHARD_KEYS))
    made = (
        known.select(_shard(F.col("h"), shards).alias("shard"), "h", "l")
        .repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_shard_cascades, "shard int, cascade binary")
    )
    made = stash(made)
    drop(known)
    size = made.agg(F.coalesce(F.sum(F.octet_length("cascade")), F.lit(0))).first()[0]
    sent = rows.select(*[f"c{i}" for i in stay], F.when(F.col("k").isNotNull(), F.xxhash64("k")).alias("__h"))
    schema = "".join(f"c{i} {kinds[f'c{i}']}, " for i in stay) + "l boolean"
    if size <= broadcast_bytes:
        table = spark.sparkContext.broadcast({r["shard"]: bytes(r["cascade"]) for r in made.toLocalIterator()})
        drop(made)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                col = b.column(b.num_columns - 1)
                h = col.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
                yield _answer(b, h, (h >> U(20)) % U(shards), table.value, col)

        out = sent.mapInArrow(ask, schema)
    else:
        # a shard of filters and the rows of a hot shard are spread over salts; each salt gets its own copy of the filter
        spread = F.pmod(F.xxhash64("__h", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
        at = sent.withColumns({"__s": _shard(F.coalesce("__h", F.lit(0)), shards), "__t": spread})
        small = made.select(F.col("shard").alias("__s"), F.col("cascade").alias("__c"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__t"))
        near = at.withColumn("__c", F.lit(None).cast("binary")).unionByName(
            small.select(*[F.lit(None).cast(kinds[f"c{i}"]).alias(f"c{i}") for i in stay], F.lit(None).cast("bigint").alias("__h"), "__s", "__t", "__c")
        )
        near = near.repartition("__s", "__t").sortWithinPartitions("__s", "__t", F.col("__c").isNull())

        def ask_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here: dict[int, bytes] = {}
            for b in batches:
                shard = b.column("__s").to_numpy(zero_copy_only=False)
                head = b.column("__c").is_valid().to_numpy(zero_copy_only=False)
                for i in np.flatnonzero(head):
                    here[int(shard[i])] = b.column("__c")[int(i)].as_py()
                rest = b.filter(pa.array(~head))
                if rest.num_rows:
                    here = {s: here[s] for s in {int(x) for x in shard} if s in here}
                    col = rest.column("__h")
                    h = col.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
                    yield _answer(rest.drop_columns(["__s", "__t", "__c"]), h, (h >> U(20)) % U(shards), here, col)

        out = near.mapInArrow(ask_near, schema)
    return out.toDF(*[names[i] for i in stay], flag)


def _answer(b: pa.RecordBatch, h: np.ndarray, shard: np.ndarray, table: dict[int, bytes], col: pa.Array) -> pa.RecordBatch:
    verdict = np.zeros(len(h), bool)
    for s in np.unique(shard):
        at = np.flatnonzero(shard == s)
        verdict[at] = ask_cascade(table.get(int(s), b""), h[at])
    verdict &= col.is_valid().to_numpy(zero_copy_only=False)
    arrays = [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(verdict)]
    return pa.RecordBatch.from_arrays(arrays, [*b.schema.names[:-1], "l"])


_HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#\\]*@)?(\[[^\]/?#]*\]|[^/?#\\:@]*)"
_PATH = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#\\]*([/\\][^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host of a URL, null where there is none.

    User info, port, dots at the end and white space before it are no part of it;
    a back slash ends it like a slash; a URL without a scheme has one if it
    begins with two slashes.
    """
    h = F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit("."))
    return F.when(h != "", h)


def url_key(url: Column) -> Column:
    """Host and path of a URL, without slashes at its end; null where there is no host."""
    path = F.translate(F.regexp_extract(url, _PATH, 1), "\\", "/")
    return F.concat(host(url), F.rtrim(path, F.lit("/")))


#: Sites whose URLs are listed, under whatever prefix and domain, however many pages they have.
BLOCKED = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with whether its URL is listed: URLs of blocked sites, out of all URLs."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    pages = pages.withColumn("key", url_key(F.col("url")))
    listed = pages.where(F.arrays_overlap(F.split(host(F.col("url")), r"\."), F.array(*map(F.lit, BLOCKED)))).select("key")
    return cascade_filter(spark, pages, F.col("key"), listed, flag="listed")


SQL = """
WITH r AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) WHEN starts_with(url, '//') THEN substr(url, 3) END AS rest FROM pages),
a AS (SELECT *, split_part(translate(rest, '?#' || chr(92), '///'), '/', 1) AS authority, split_part(split_part(rest, '?', 1), '#', 1) AS place FROM r),
h AS (SELECT *, list_last(string_split(authority, '@')) AS named FROM a),
p AS (SELECT page_id, url, nullif(rtrim(lower(CASE WHEN starts_with(named, '[') THEN split_part(named, ']', 1) || ']' ELSE split_part(named, ':', 1) END), '.'), '') AS host,
  rtrim(replace(substr(place, length(authority) + 1), chr(92), '/'), '/') AS path FROM h),
k AS (SELECT page_id, url, host || path AS key, list_has_any(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS bad FROM p)
SELECT page_id, url, key, key IS NOT NULL AND key IN (SELECT key FROM k WHERE bad AND key IS NOT NULL) AS listed FROM k
"""
