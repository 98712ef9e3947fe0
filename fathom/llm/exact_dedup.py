"""Exact deduplication with Patricia tries of whole texts.

Where rows lie, copies within some megabytes of text are found first, so of a
text that a third of all rows share only a few rows a task are sent.  They
travel to partitions by the length and a hash of their text's bytes, so equal
texts meet.  A partition inserts the full byte strings into a compressed radix
trie; the node where a string ends keeps the smallest identifier, its owner.
Nothing is decided by hash: two texts are equal if they end at one node.
A trie over its memory budget writes its heaviest subtree to the shared folder,
and later strings of that subtree go straight to the file; each file is then
read into a trie of its own.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.scratch import shared_dir, stash

NAME = "op7_exact_dedup"
#: Bytes of rows among which copies are found before anything is sent.
LOCAL_BYTES = 32 << 20
#: Bytes of edge labels that one trie keeps in memory.
TRIE_BYTES = 96 << 20
#: What a node costs besides its label.
NODE_BYTES = 400


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, step = 0, 32
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    hi = min(n, lo + step)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Node:
    """An edge label, children by their label's first byte, and the owner of what ends here."""

    __slots__ = ("label", "kids", "owner", "ends", "spill")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner, self.ends, self.spill = label, {}, None, False, None


class Trie:
    """A compressed radix trie from byte strings to their smallest identifier.

    Identifiers must come in ascending order for one string.
    """

    def __init__(self, budget: int = TRIE_BYTES, folder: str | None = None):
        self.root, self.size, self.budget, self.folder, self.files = Node(b""), 0, budget, folder, []

    def insert(self, key: bytes, owner: int | None, payload: bytes | None = None) -> tuple[bool, int | None] | None:
        """(whether the string is new, its owner); None if its subtree is on file, with ``payload``."""
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                pickle.dump((key[at:], owner, payload, False), node.spill)
                return None
            if at == len(key):
                new, node.ends = not node.ends, True
                if new:
                    node.owner = owner
                return new, node.owner
            kid = node.kids.get(key[at])
            if kid is None:
                leaf = Node(key[at:])
                leaf.owner, leaf.ends = owner, True
                node.kids[key[at]] = leaf
                self.size += len(leaf.label) + NODE_BYTES
                if self.size > self.budget and self.folder is not None:
                    self._spill()
                return True, owner
            n = common(kid.label, key[at:])
            if n < len(kid.label):
                middle = Node(kid.label[:n])
                kid.label = kid.label[n:]
                middle.kids[kid.label[0]] = kid
                node.kids[middle.label[0]] = middle
                self.size += NODE_BYTES
                kid = middle
            node, at = kid, at + n

    def _spill(self) -> None:
        """Move the heaviest subtree below the first branching to a file."""
        top = self.root
        while len(top.kids) == 1:
            (only,) = top.kids.values()
            if only.spill is not None or not only.kids:
                break
            top = only
        node = max((k for k in top.kids.values() if k.spill is None), key=self._weight, default=None)
        if node is None:
            return
        where, path = fs.FileSystem.from_uri(f"{self.folder}/trie-{uuid.uuid4().hex}")
        where.create_dir(path.rsplit("/", 1)[0], recursive=True)
        out = where.open_output_stream(path)
        self.size -= self._weight(node) - len(node.label) - NODE_BYTES
        stack = [(node, b"")]
        while stack:
            x, p = stack.pop()
            if x.ends:
                pickle.dump((p, x.owner, None, True), out)
            stack.extend((k, p + k.label) for k in x.kids.values())
        node.kids, node.ends, node.spill = {}, False, out
        self.files.append((out, where, path))

    @staticmethod
    def _weight(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.label) + NODE_BYTES
            stack.extend(x.kids.values())
        return total

    def filed(self) -> Iterator[tuple[bool, int | None, int | None, bytes]]:
        """(new, owner, identifier, payload) of every string that went to a file."""
        for out, where, path in self.files:
            out.close()
            below = Trie(self.budget, self.folder)
            with where.open_input_stream(path) as f:
                while True:
                    try:
                        key, owner, payload, known = pickle.load(f)
                    except EOFError:
                        break
                    got = below.insert(key, owner, payload)
                    if got is not None and not known:
                        yield got[0], got[1], owner, payload
            yield from below.filed()
            where.delete_file(path)


def _local(text_at: int, id_at: int, limit: int):
    """Rows (..., n, h, x) to the same with ``own``, ``key`` and ``lo``: of equal texts near each other the least (id, x) owns.

    The others come without their text, with the key and the identifier of their owner.
    """

    def close(parts: list[pa.RecordBatch], base: int) -> pa.RecordBatch:
        b = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        text = b.column(text_at).cast(pa.large_binary())
        code = text.dictionary_encode().indices
        frame = pa.table({"code": code, "id": b.column(id_at), "x": b.column(b.num_columns - 1)})
        order = pc.sort_indices(frame, [("code", "ascending"), ("id", "ascending"), ("x", "ascending")], null_placement="at_end").to_numpy()
        c = code.fill_null(-1).to_numpy(zero_copy_only=False)[order]
        fresh = np.ones(len(c), bool)
        fresh[1:] = (c[1:] != c[:-1]) | (c[1:] < 0)
        owner = np.empty(len(c), np.int64)
        owner[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(c)), 0))]
        own = owner == np.arange(len(c))
        bare = pc.if_else(pa.array(own), b.column(text_at), pa.scalar(None, b.column(text_at).type))
        columns = [bare if k == text_at else col for k, col in enumerate(b.columns)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(own), pa.array(base + owner), b.column(id_at).take(pa.array(owner))], [*b.schema.names, "own", "key", "lo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, parts, size = TaskContext.get().partitionId() << 40, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            parts.append(b)
            size += b.nbytes
            if size > limit:
                yield close(parts, base)
                base += sum(x.num_rows for x in parts)
                parts, size = [], 0
        if parts:
            yield close(parts, base)

    return run


def _walk(text_at: int, id_at: int, folder: str, budget: int, pairs: bool):
    """Rows (..., n, h, key) sorted by (n, h, identifier) to owners' rows, or to (key, identifier, owner) of the others."""

    def couple(keys: list, ids: list, owners: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, ids, owners)], ["key", "doc_id", "owner_id"])

    def filed(trie: Trie) -> Iterator[pa.RecordBatch]:
        for new, owner, own, payload in trie.filed():
            if pairs:
                if not new:
                    yield couple([int.from_bytes(payload)], [own], [owner])
            elif new:
                yield pa.ipc.open_stream(payload).read_next_batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = Trie(budget, folder), None
        for b in batches:
            keep, found = [False] * b.num_rows, []
            rest = b.select(range(b.num_columns - 3))
            sizes, hashes, keys = (b.column(b.num_columns - k).to_pylist() for k in (3, 2, 1))
            texts, own = b.column(text_at).cast(pa.large_binary()), b.column(id_at).to_pylist()
            for i in range(b.num_rows):
                text = texts[i].as_py()
                if text is None:
                    keep[i] = True
                    continue
                if (sizes[i], hashes[i]) != last:
                    last = sizes[i], hashes[i]
                    if trie.size > budget // 2:
                        yield from filed(trie)
                        trie = Trie(budget, folder)
                got = trie.insert(text, own[i]) if not trie.files else trie.insert(text, own[i], keys[i].to_bytes(8) if pairs else _bytes(rest.slice(i, 1)))
                if got is not None:
                    keep[i] = got[0]
                    if not got[0]:
                        found.append((keys[i], own[i], got[1]))
            if pairs:
                yield couple(*([list(x) for x in zip(*found)] or [[], [], []]))
            else:
                yield rest.filter(pa.array(keep, pa.bool_()))
        yield from filed(trie)

    return run


def _bytes(row: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def _near(docs: DataFrame, id_col: str, text: str, limit: int) -> tuple[DataFrame, int, int]:
    """Rows with positional names, then n, h, x, own, key, lo; copies that lie near each other are known."""
    names = docs.columns
    i, t = names.index(id_col), names.index(text)
    raw = docs.toDF(*[f"c{k}" for k in range(len(names))])
    size = F.octet_length(f"c{t}").cast("bigint")
    h = F.when(F.col(f"c{t}").isNotNull(), F.xxhash64(f"c{t}")).otherwise(F.xxhash64(f"c{i}"))
    plain = [c for c, f in zip(raw.columns, raw.schema) if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    raw = raw.withColumns({"n": F.coalesce(size, F.lit(-1).cast("bigint")), "h": h, "x": F.xxhash64(*plain)})
    schema = T.StructType([*raw.schema, T.StructField("own", T.BooleanType()), T.StructField("key", T.LongType()), T.StructField("lo", raw.schema[i].dataType)])
    return raw.mapInArrow(_local(t, i, limit), schema), i, t


def _met(near: DataFrame, i: int, columns: list[str]) -> DataFrame:
    """What near rows own, equal texts adjacent in one partition, n, h and key last."""
    own = near.where("own").repartition("n", "h").sortWithinPartitions("n", "h", F.col(f"c{i}").asc_nulls_last(), "x")
    return own.select(*columns, "n", "h", "key")


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = TRIE_BYTES, limit: int = LOCAL_BYTES) -> DataFrame:
    """The rows of ``docs`` that own their text: of rows with byte-equal texts, the one with the smallest id.

    All columns are kept, whatever their names.  Of rows equal in id and text
    one stays, that whose columns have the least hash.  Rows with a null text
    have no text to share and all stay.  Null ids rank after all others.  The
    empty text is a text like any other.  Ids may be of any type with an order.
    An empty table gives an empty one.
    """
    near, i, t = _near(docs, id_col, text, limit)
    columns = [f"c{k}" for k in range(len(docs.columns))]
    schema = docs.toDF(*columns).schema
    return _met(near, i, columns).mapInArrow(_walk(t, i, shared_dir(docs.sparkSession), budget, False), schema).toDF(*docs.columns)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = TRIE_BYTES, limit: int = LOCAL_BYTES) -> DataFrame:
    """(doc_id, owner_id) of every row that ``dedup_exact`` drops; ids must be integers, or strings of integers."""
    near, i, t = _near(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null"), "doc_id", "text", limit)
    near = stash(near)
    far = stash(_met(near, i, ["c0", "c1"]).mapInArrow(_walk(t, i, shared_dir(docs.sparkSession), budget, True), "key bigint, doc_id bigint, owner_id bigint"))
    copies = near.where("not own").select("key", F.col("c0").alias("doc_id"), "lo")
    copies = copies.join(far.select("key", "owner_id"), "key", "left").select("doc_id", F.coalesce("owner_id", "lo").alias("owner_id"))
    return copies.unionByName(far.select("doc_id", "owner_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose text another one owns, with the owner."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, owner_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS owner_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS i
  FROM documents WHERE text IS NOT NULL) WHERE i > 1
"""
