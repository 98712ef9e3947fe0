"""Byte-level BPE encoding and decoding, long texts by overlapping chunks.

A text of more than ``chunk`` characters is cut into chunks that each reach
``overlap`` characters into the next.  Chunks are pre-tokenised in parallel.
From a position that is a pre-token boundary in two runs, both go on alike, so
the first boundary that two neighbours share in their overlap is a true one: the
text is cut there and the pieces are encoded in parallel.  Where an overlap has
no shared boundary (one pre-token covers it) the cut moves to the first step from
a character to white space, which is always a boundary; where there is none
either, the neighbours stay one piece.  Shorter texts are a piece as they are.
Decoding concatenates the bytes of the tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.scratch import stash

NAME = "op4_bpe"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters in a chunk, and how far it reaches into the next one.
CHUNK = 65_536
OVERLAP = 1_024
#: Bytes of text whose tokens are sent back together.
OUT_BYTES = 4 << 20

_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = set(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: White space so long that the regular expression engine would run out of stack.
_LONG_RUN = re.compile(f"[{_WHITE}]{{4096,}}")
_EDGE = re.compile(f"[^{_WHITE}](?=[{_WHITE}])")
_PRE = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^W\p{L}\p{N}]+|[W]+(?![^W])|[W]+".replace("W", _WHITE)
)


@lru_cache(4)
def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary in ``path``: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def _table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens joined, where each begins, and its length; -1 where no token has the number."""
    enc = encoding(path)
    size = np.full(enc.max_token_value + 1, -1, np.int64)
    words = [b""] * len(size)
    for token in enc.token_byte_values():
        k = enc.encode_single_token(token)
        words[k], size[k] = token, len(token)
    start = np.concatenate([[0], np.cumsum(np.maximum(size, 0))[:-1]])
    return np.frombuffer(b"".join(words), np.uint8), start, size


def decode_lists(lists: pa.ListArray, path: str) -> Iterator[pa.Array]:
    """The joined bytes of each list of tokens, some megabytes at a time; null for a null list."""
    data, start, size = _table(path)
    length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(length)])
    flat = lists.flatten()
    if flat.null_count:
        raise ValueError("a token is null")
    ids = flat.to_numpy(zero_copy_only=False)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or (size[ids] < 0).any()):
        raise ValueError("a token isn't in the vocabulary")
    i = 0
    while i < len(length):
        j = max(i + 1, int(np.searchsorted(at, at[i] + OUT_BYTES // 4, "right")) - 1)
        own = ids[at[i] : at[j]]
        n = size[own]
        cut = np.concatenate([[0], np.cumsum(n)])
        body = data[np.repeat(start[own] - cut[:-1], n) + np.arange(cut[-1])]
        offsets = cut[at[i : j + 1] - at[i]]
        out = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(body)]).cast(pa.binary())
        part = lists.slice(i, j - i)
        yield pc.if_else(part.is_valid(), out, pa.scalar(None, pa.binary())) if part.null_count else out
        i = j


def encode_piece(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Tokens of a text; special tokens' strings are ordinary text."""
    run = _LONG_RUN.search(text) if len(text) >= 4096 else None
    if run is None:
        return enc.encode_ordinary(text)
    out, at = [], 0
    while run is not None:
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : end])
        at = end
        run = _LONG_RUN.search(text, at + 1)
    return out + enc.encode_ordinary(text[at:])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    cut = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=cut[1:])
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))


def _encode(path: str):
    """The text in the first column to tokens, the other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            texts, start, size, parts = b.column(0), 0, 0, []
            for i in range(b.num_rows):
                text = texts[i].as_py()
                if text is None:
                    parts.append(None)
                else:
                    tokens = encode_piece(enc, text)
                    size += len(text)
                    parts.append(np.array(tokens, np.int32))
                if size >= OUT_BYTES or i + 1 == b.num_rows:
                    yield _out(b.slice(start, i + 1 - start), parts)
                    start, size, parts = i + 1, 0, []

    return run


def _out(rows: pa.RecordBatch, parts: list) -> pa.RecordBatch:
    lists = _lists([np.empty(0, np.int32) if p is None else p for p in parts])
    if any(p is None for p in parts):
        lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array([p is None for p in parts]))
    arrays = [lists] + [rows.column(k) for k in range(1, rows.num_columns)]
    return pa.RecordBatch.from_arrays(arrays, ["tokens", *rows.schema.names[1:]])


def _seams(overlap: int):
    """Rows (row, chunk, text, last) to the boundaries of each chunk's run where it meets its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("size").to_pylist()
            heads, tails, edges = [], [], []
            for i in range(b.num_rows):
                text = b.column("text")[i].as_py()
                ends = [m.end() for m in _PRE.finditer(text)]
                if len(text) > size[i]:
                    ends = ends[:-2]  # what the end of the chunk cuts off isn't a boundary
                ends = [e for e in ends if text[e - 1] not in _BLANKS]  # white space at the end of a piece would be grouped otherwise
                heads.append([0] + [e for e in ends if e <= overlap])
                tails.append([e - size[i] for e in ends if e >= size[i]])
                first = _EDGE.search(text[: size[i]])
                edges.append(first.end() if first else None)
            parts = [pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32())), pa.array(edges, pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("chunk"), *parts], ["row", "chunk", "head", "tail", "edge"])

    return run


def pieces(long: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, piece, text): the texts of ``long`` (row, text) cut at true pre-token boundaries."""
    if not 0 < overlap < chunk:
        raise ValueError("overlap must be positive and less than chunk")
    length = F.length("text")
    each = long.select("row", "text", F.explode(F.sequence(F.lit(0), F.floor((length - 1) / chunk).cast("int"))).alias("chunk"))
    each = each.select(
        "row", "chunk", F.substring("text", F.col("chunk") * chunk + 1, F.lit(chunk + overlap)).alias("text"), F.least(F.lit(chunk), length - F.col("chunk") * chunk).alias("size")
    )
    seams = each.repartition("row", "chunk").mapInArrow(_seams(overlap), "row bigint, chunk int, head array<int>, tail array<int>, edge int")
    order = F.array_sort(F.collect_list(F.struct("chunk", "head", "tail", "edge")))
    per = seams.groupBy("row").agg(order.alias("s"))
    # a shared boundary counts only after a chunk whose own run has met the true one
    fold = f"""aggregate(s, named_struct('cuts', cast(array() as array<int>), 'tail', array(0)), (a, x) -> named_struct(
        'cuts', array_append(a.cuts, x.chunk * {chunk} + coalesce(array_min(array_intersect(x.head, a.tail)), x.edge)),
        'tail', if(coalesce(array_min(array_intersect(x.head, a.tail)), x.edge) is null, cast(array() as array<int>), x.tail)), a -> a.cuts)"""
    cuts = per.select("row", F.expr(f"filter({fold}, c -> c is not null)").alias("cuts"))
    joined = long.join(cuts, "row").select("row", "text", F.posexplode("cuts").alias("piece", "begin"), "cuts")
    stop = F.coalesce(F.try_element_at("cuts", F.col("piece") + 2), F.length("text"))
    return joined.select("row", "piece", F.substring("text", F.col("begin") + 1, stop - F.col("begin")).alias("text"))


def encode(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, verify: bool = False) -> DataFrame:
    """``docs`` with its text replaced by ``tokens`` (array<int>), as the last column; all other columns are kept.

    With ``verify`` a column ``round_trip`` follows: whether the row's final
    tokens, decoded as in ``decode``, are the bytes of the whole text.  A null text
    has null tokens, an empty one none; repeated rows are encoded each; an empty
    table gives an empty one; columns called ``tokens``, or ``round_trip`` with
    ``verify``, are replaced.  The result equals encoding each text at once, for
    any ``chunk`` and ``overlap``; a text that is one pre-token (a megabyte of one
    letter) stays one piece, for it has no other boundary.
    """
    names = docs.columns
    t = names.index(text)
    others = [k for k in range(len(names)) if k != t and names[k] not in (["tokens", "round_trip"] if verify else ["tokens"])]
    raw = docs.toDF(*[f"c{k}" for k in range(len(names))])
    kinds = {f.name: f.dataType.simpleString() for f in raw.schema}
    carried = [*others, t] if verify else others
    rest = "".join(f", c{k} {kinds[f'c{k}']}" for k in carried)
    is_long = F.length(f"c{t}") > chunk
    short = raw.where(is_long.isNull() | ~is_long).select(F.col(f"c{t}").alias("text"), *[f"c{k}" for k in carried])
    out = short.mapInArrow(_encode(vocabulary), f"tokens array<int>{rest}")
    long = stash(raw.where(is_long).withColumn("row", F.monotonically_increasing_id()))
    cut = pieces(long.select("row", F.col(f"c{t}").alias("text")), chunk, overlap)
    coded = cut.select("text", "row", "piece").repartition("row", "piece").mapInArrow(_encode(vocabulary), "tokens array<int>, row bigint, piece int")
    whole = coded.groupBy("row").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "tokens"))), lambda x: x["tokens"])).alias("tokens"),
    )
    whole = long.join(whole, "row").select(*out.columns)
    both = out.unionByName(whole)
    tail = ["tokens"]
    if verify:
        schema = T.StructType([*[f for f in both.schema if f.name != f"c{t}"], T.StructField("round_trip", T.BooleanType())])
        both = both.mapInArrow(_trips(both.columns.index(f"c{t}"), vocabulary), schema)
        tail.append("round_trip")
    return both.select(*[F.col(f"c{k}").alias(names[k]) for k in others], *tail)


def _trips(text_at: int, path: str):
    """Rows (tokens, ..., text, ...) to the same without the text, and whether the decoded tokens are its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [pc.equal(x, t) for x, t in _beside(decode_lists(b.column(0), path), b.column(text_at))]
            same = pa.concat_arrays(parts) if parts else pa.array([], pa.bool_())
            stay = [k for k in range(b.num_columns) if k != text_at]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in stay], same], [*[b.schema.names[k] for k in stay], "round_trip"])

    return run


def _beside(parts: Iterator[pa.Array], texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    at = 0
    for x in parts:
        yield x, texts.slice(at, len(x)).cast(pa.binary())
        at += len(x)


def decode(coded: DataFrame, tokens: str = "tokens", vocabulary: str = VOCABULARY, as_bytes: bool = False) -> DataFrame:
    """``coded`` with a last column ``text``: the tokens' bytes joined and read as UTF-8, or left as they are with ``as_bytes``.

    Null tokens give null; bytes that are no UTF-8 (a token list cut inside a
    character) become replacement characters; an unknown or null token raises.
    A column called ``text`` is replaced; an empty table gives an empty one.
    """
    stay = [k for k, c in enumerate(coded.columns) if c != "text"]
    names = [coded.columns[k] for k in stay]
    raw = coded.toDF(*[f"c{k}" for k in range(len(coded.columns))]).select(*[f"c{k}" for k in stay])
    at = names.index(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = 0
            for x in decode_lists(b.column(at), vocabulary):
                rows = b.slice(i, len(x))
                i += len(x)
                if not as_bytes:
                    x = pa.array([None if v is None else v.decode("utf-8", "replace") for v in x.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns, x], [*b.schema.names, "text"])

    schema = T.StructType([*raw.schema, T.StructField("text", T.BinaryType() if as_bytes else T.StringType())])
    return raw.mapInArrow(run, schema).toDF(*names, "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, their number, and whether they decode to the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, verify=True).withColumn("n_tokens", F.size("tokens"))


SQL = None
