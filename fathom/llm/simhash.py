"""SimHash near-deduplication over deletion variants of signature segments.

The signature of a text is the sign of a weighted sum of random directions, one
for each of its distinct words; a word weighs more the longer it is and the more
often it occurs.  Two texts are near if their signatures differ in at most
``MAX_BITS`` of ``BITS`` bits.

A signature is cut into ``SEGMENTS`` segments and a segment into ``CHUNKS``
chunks.  The variants of a segment leave out one chunk each: two segments have
a variant in common exactly if all their differing bits lie in one chunk, so in
particular if they differ in at most one bit.  Of two signatures that differ in
fewer than 2 * SEGMENTS bits some segment differs in at most one, so those are
always found; up to ``MAX_BITS`` the tests state the recall.  Variants are
joined on equality, candidates pass a check of ``LOW_WORDS`` words of the
signature where they meet, and whole signatures decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.scratch import drop, stash
from fathom.llm.words import PUNCT, Words, mix, slices
from fathom.operators.components import connected_components

NAME = "op5_simhash_near_dedup"
U = np.uint64
BITS = 512
#: Segments of a signature, chunks of a segment, bits of a chunk; the last 26 bits of a signature are in no segment.
SEGMENTS, CHUNKS, CHUNK = 18, 3, 9
KEY = (CHUNKS - 1) * CHUNK
#: Signatures of near texts differ in at most this many of the 512 bits: an angle of 28 degrees.
MAX_BITS = 80

#: Candidates that differ in more than LOW_BITS of their first LOW_WORDS words of 64 bits are dropped at once.
LOW_WORDS, LOW_BITS = 2, 40

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SALTS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, BITS // 64, dtype=np.uint64) * U(2) + U(1)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1
#: A place that gives more candidates than so many a node is parted by whole signatures instead.
DENSE = 8
#: Nodes of one place that one task compares; larger places are cut into blocks, and blocks meet in pairs.
HOT = 8192
#: Texts whose sums are made at once.
GROUP = 64


def signatures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of BITS / 8 bytes for each text, and whether it has any word."""
    n = len(offsets) - 1
    words = Words(_LOWER[data], offsets, PUNCT)
    row, h = words.row, words.hashes()
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    size = (words.end - words.start)[order][at]
    weight = (1 + np.log(np.diff(np.append(at, len(h))))) * np.clip(size - 2, 0.25, 8)
    row, h = row[at], h[at]
    out = np.zeros((n, BITS // 8), np.uint8)
    cuts = np.searchsorted(row, np.arange(0, n + GROUP, GROUP))
    for g, (i, j) in enumerate(zip(cuts, cuts[1:])):
        if i == j:
            continue
        first, m = g * GROUP, min(GROUP, n - g * GROUP)
        base, w, hh = (row[i:j] - first) * 256, weight[i:j], h[i:j]
        for s, salt in enumerate(_SALTS):
            octets = mix(hh * salt).view(np.uint8).reshape(-1, 8)
            for o in range(8):
                sums = np.bincount(base + octets[:, o], w, m * 256).astype(np.float32).reshape(m, 256) @ _BYTE_BITS
                out[first : first + m, s * 8 + o] = np.packbits(sums > 0, axis=1)[:, 0]
    return out, words.count > 0


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text in the last column to its signature, other columns as they are; rows without a word are left out."""
    for b in batches:
        names = [*b.schema.names[:-1], "sig"]
        for i, j, data, offsets in slices(b.column(b.num_columns - 1)):
            sig, any_ = signatures(data, offsets)
            keep = np.flatnonzero(any_)
            yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i).take(pa.array(keep)) for c in b.columns[:-1]], _fixed(sig[keep])], names)


def _fixed(sig: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(sig.shape[1]), len(sig), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


_LOW = [f"w{k}" for k in range(LOW_WORDS)]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A signature to a row a variant: (place, node, its first words)."""
    weight = 1 << np.arange(CHUNK, dtype=np.int32)
    variants = SEGMENTS * CHUNKS
    for b in batches:
        for z in range(0, b.num_rows, 2000):
            part = b.slice(z, 2000)
            sig = _matrix(part.column("sig"))
            bits = np.unpackbits(sig, axis=1)[:, : variants * CHUNK].reshape(-1, SEGMENTS, CHUNKS, CHUNK)
            chunk = bits @ weight
            kept = [[c for c in range(CHUNKS) if c != gone] for gone in range(CHUNKS)]
            keys = np.stack([sum(chunk[:, :, c] << (CHUNK * i) for i, c in enumerate(cs)) for cs in kept], 2).reshape(-1, variants)
            place = (np.arange(variants, dtype=np.int32) << KEY) | keys
            node = np.repeat(part.column("node").to_numpy(zero_copy_only=False), variants)
            low = np.repeat(sig.view(np.int64)[:, :LOW_WORDS], variants, 0)
            arrays = [pa.array(place.ravel().astype(np.int32)), pa.array(node), *[pa.array(np.ascontiguousarray(low[:, k])) for k in range(LOW_WORDS)]]
            yield pa.RecordBatch.from_arrays(arrays, ["place", "node", *_LOW])


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits signatures differ; rows of 64-bit words."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def _forest(sig: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what nearness connects among these signatures, found breadth first."""
    left, right = [], []
    rest = np.arange(len(sig))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = apart(sig[rest], sig[x]) <= max_bits
            got = rest[near]
            left.append(np.full(len(got), x))
            right.append(got)
            front.extend(got.tolist())
            rest = rest[~near]
    return np.concatenate(left or [rest]), np.concatenate(right or [rest])


def _candidates(place: np.ndarray, node: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of nodes that share a place, and (place, node) of places with too many; rows sorted by place."""
    found, dense = [], []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
    size = np.diff(cut)
    for n in np.unique(size[size > 1]):
        begin = cut[:-1][size == n]
        if n > 2 * DENSE:
            for at in begin:
                pairs = _within(low[at : at + n]) if n <= HOT else None
                if pairs is None:
                    dense.append(np.stack([place[at : at + n].astype(np.int64), node[at : at + n]], 1))
                else:
                    found.append(node[at + pairs])
            continue
        a, b = np.triu_indices(n, 1)
        step = max(1, 100_000 // len(a))
        for z in range(0, len(begin), step):
            at = begin[z : z + step, None]
            x, y = (at + a).ravel(), (at + b).ravel()
            near = apart(low[x], low[y]) <= LOW_BITS
            found.append(np.stack([node[x[near]], node[y[near]]], 1))
    none = np.empty((0, 2), np.int64)
    return np.unique(np.sort(np.concatenate([none, *found]), 1), axis=0), np.concatenate([none, *dense])


def _within(low: np.ndarray) -> np.ndarray | None:
    """Candidate pairs among these nodes; None if they are more than DENSE a node."""
    found, total, n = [], 0, len(low)
    for i in range(0, n, 256):
        near = apart(low[i : i + 256, None], low[None, i:]) <= LOW_BITS
        r, c = np.nonzero(np.triu(near, 1))
        total += len(r)
        if total > DENSE * n:
            return None
        found.append(np.stack([r + i, c + i], 1))
    return np.concatenate(found)


def _batched(emit):
    """Rows sorted by their first column, given to ``emit`` some hundred thousand rows of whole groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [_matrix(c).view(np.uint64) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns]
            held.append(cols)
            rows += b.num_rows
            if rows >= 200_000 and cols[0][-1] != held[0][0][0]:
                whole = [np.concatenate(x) for x in zip(*held)]
                end = np.searchsorted(whole[0], whole[0][-1])
                yield emit(*[x[:end] for x in whole])
                held, rows = [[x[end:] for x in whole]], len(whole[0]) - end
        if rows:
            yield emit(*[np.concatenate(x) for x in zip(*held)])

    return run


def _meet(place: np.ndarray, node: np.ndarray, *low: np.ndarray) -> pa.RecordBatch:
    pairs, dense = _candidates(place, node, np.stack(low, 1).view(np.uint64))
    crowd = np.concatenate([np.zeros(len(pairs), np.int64), dense[:, 0] + 1])
    both = np.concatenate([pairs, np.repeat(dense[:, 1:], 2, 1)])
    return pa.RecordBatch.from_arrays([pa.array(crowd), pa.array(both[:, 0]), pa.array(both[:, 1])], ["crowd", "a", "b"])


def _part(max_bits: int):
    """Rows (cell, node, signature) sorted by cell to edges that connect what is near in it."""

    def emit(cell: np.ndarray, node: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        found = [np.empty((0, 2), np.int64)]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
        for i, j in zip(cut, cut[1:]):
            a, b = _forest(sig[i:j], max_bits)
            found.append(np.stack([node[i + a], node[i + b]], 1))
        e = np.unique(np.sort(np.concatenate(found), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return emit


def _near(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (_matrix(b.column(c)).view(np.uint64) for c in ("sa", "sb"))
                yield b.select(["a", "b"]).filter(pa.array(apart(x, y) <= max_bits))

    return run


def near_edges(signed: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: links among nodes of ``signed`` (node, sig; distinct signatures) that connect near ones.

    All near pairs that differ in fewer than 2 * SEGMENTS bits are connected; of
    those that differ in more, up to ``max_bits``, a pair is missed only if in
    each segment its differing bits spread over several chunks and nothing else
    links it.  A place that many near nodes share doesn't give all their pairs:
    whole signatures are brought there and parted into a forest.  A place of
    more than HOT nodes is cut into blocks by a hash of the node, and every two
    blocks meet in a cell of their own, so no task holds more than two blocks.
    """
    parts = signed.mapInArrow(_parts, "place int, node bigint, " + ", ".join(f"{w} bigint" for w in _LOW))
    met = stash(parts.repartition("place").sortWithinPartitions("place").mapInArrow(_batched(_meet), "crowd bigint, a bigint, b bigint"))
    pairs = met.where("crowd = 0").select("a", "b").distinct()
    sig = lambda k: signed.select(F.col("node").alias(k), F.col("sig").alias(f"s{k}"))
    direct = pairs.join(sig("a"), "a").join(sig("b"), "b").mapInArrow(_near(max_bits), "a bigint, b bigint")
    dense = met.where("crowd > 0").select("crowd", F.col("a").alias("node"))
    blocks = dense.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("g"))
    cells = dense.join(blocks, "crowd").withColumn("s", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    cells = cells.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cells = cells.where("g = 1 or s <> t").select(F.xxhash64("crowd", F.least("s", "t"), F.greatest("s", "t")).alias("cell"), "node")
    forest = cells.join(signed.select("node", "sig"), "node").select("cell", "node", "sig").repartition("cell").sortWithinPartitions("cell")
    edges = stash(direct.unionByName(forest.mapInArrow(_batched(_part(max_bits)), "a bigint, b bigint")).distinct())
    drop(met)
    return edges


def _classes(signed: DataFrame, rank: Column, max_bits: int) -> DataFrame:
    """(sig, head, n_links) of every signature of ``signed``: the least ``rank`` of its class, and its links."""
    least = signed.groupBy("sig").agg(F.min(rank).alias("r"))
    nodes = stash(least.withColumn("node", F.monotonically_increasing_id()))
    edges = near_edges(nodes.select("sig", "node"), max_bits)
    label = stash(connected_components(edges, "a", "b"))
    heads = stash(nodes.join(label, "node").groupBy("component").agg(F.min("r").alias("head")))
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    links = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    known = nodes.join(label, "node", "left").join(links, "node", "left").join(heads, "component", "left")
    known = stash(known.select("sig", F.coalesce("head", "r").alias("head"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links")))
    for x in (nodes, edges, label, heads):
        drop(x)
    return known


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, group_id, n_links) of every document that has a near one; group_id is the least id of its group.

    Groups are the connected components of nearness.  ``n_links`` counts the
    different signatures that a document's own was linked with (where many near
    ones share a place, only as many as connect them); equal signatures are one
    node, so thousands of copies cost no more than one and are in a group
    without a link.  A text without a word (null, empty, only white space and
    ASCII punctuation) is near to none; rows of a null id are passed over;
    repeated rows count once, and several texts of one id make it a member of
    each of their groups.  Ids must be integers, or strings of integers.  Other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    signed = stash(rows.mapInArrow(_sign, "doc_id bigint, sig binary"))
    known = _classes(signed, F.struct("doc_id"), max_bits)
    every = stash(signed.join(known, "sig").groupBy("doc_id", F.col("head.doc_id").alias("group_id")).agg(F.max("n_links").alias("n_links")))
    drop(signed)
    drop(known)
    several = every.where("doc_id <> group_id").select("group_id").distinct()
    return every.join(several, "group_id", "left_semi").select("doc_id", "group_id", "n_links")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each group of near texts; all columns are kept, whatever their names.

    The document of the least id stays, of one id that of the least hash of
    the text; null ids rank last.  A document is an id with a text: of an id with
    several texts, a near copy of one leaves the others, and repeated rows of an
    id and a text stay or go together.  Rows whose text has no word (null and
    empty ones too) all stay.  An empty table gives an empty one.
    """
    names = docs.columns
    i, t = f"c{names.index(id_col)}", f"c{names.index(text)}"
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))]).withColumn("h", F.xxhash64(F.col(t).cast("string")))
    asked = rows.where(F.col(t).isNotNull()).select(F.col(i).alias("id"), "h", F.col(t).cast("string").alias("text"))
    signed = stash(asked.mapInArrow(_sign, T.StructType([T.StructField("id", asked.schema["id"].dataType), T.StructField("h", T.LongType()), T.StructField("sig", T.BinaryType())])))
    known = _classes(signed, F.struct(F.col("id").isNull().alias("last"), "id", "h"), max_bits)
    own = signed.join(known, "sig").where(~(F.col("id").eqNullSafe(F.col("head.id")) & (F.col("h") == F.col("head.h"))))
    gone = stash(own.select(F.col("id").alias("gone_id"), F.col("h").alias("gone_h")).distinct())
    drop(signed)
    drop(known)
    return rows.join(gone, F.col(i).eqNullSafe(F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left_anti").drop("h").toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that goes as a near copy, with its class (the document that stays) and its number of links."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.where("doc_id <> group_id").select("doc_id", F.col("group_id").alias("kept_id"), "n_links")


SQL = None
