"""Repeated passages across documents, by suffix arrays of induced sorting.

A passage repeats if ``LEAST`` words in a row (runs of bytes that are neither
white space nor ASCII punctuation) occur in two documents.  Every window of that
many words has one anchor, the least hash among its runs of ``GRAM`` words, so
equal windows have equal anchors.  Anchors that only one document has are
dropped; around the others, texts travel to the shard of their anchor, where
each different stretch is kept once.  A shard sorts the suffixes of its
stretches over the alphabet of words, numbered by their bytes: suffixes are classified, the
leftmost-smaller ones sorted through their substrings, recursively where names
repeat, and all others induced from them in two linear scans.  Permuted common
prefixes of that array part it into groups of suffixes that share ``LEAST``
words; a group with two documents is a repeat.

An anchor with more than ``HOT`` different stretches is split: equal windows
have all their runs of ``GRAM`` words in common, so also the least hash above
that of the anchor.  Its stretches are cut where that one changes, and anchor
and next hash together are the new anchor, again and again until none is hot.
Hashes only bring stretches together; what is equal is decided on words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.functions.scratch import drop, stash
from fathom.llm.words import PUNCT, Words, mix, slices, windows

U = np.uint64
NAME = "op8_suffix_array_dedup"
#: Words in a row that make a repeat.
LEAST = 50
#: Words in the runs that anchors are chosen from.
GRAM = 8
#: Words of whole anchor groups that are sorted in one array.
SHARD_WORDS = 400_000
#: Different stretches of one anchor that are sorted in one array; an anchor with more is split.
HOT = 20_000


# --- suffix arrays -----------------------------------------------------------


def _smaller(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the empty suffix is the smallest."""
    step = np.sign(np.diff(s, append=-1))
    step[-1] = -1
    known = np.where(step != 0, np.arange(len(s)), len(s))
    return step[np.minimum.accumulate(known[::-1])[::-1]] > 0


def _induce(s: np.ndarray, order: np.ndarray, is_s: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller ones in ``order``: two linear scans."""
    n = len(s)
    sa_ = np.full(n, -1, np.int64)
    c = s[order]
    by = np.argsort(c, kind="stable")
    c, seeds = c[by], order[by]
    last = np.searchsorted(c, c, "right")
    slots = ends[c] - (last - np.arange(len(c)))
    sa_[slots] = seeds
    before = np.full(n + 1, -1, np.int64)
    before[1:n] = s[: n - 1]
    # entry j is the character of suffix j - 1, where that suffix is of the kind in turn
    kind = np.concatenate([[False], is_s[: n - 1], [False]])
    larger = np.where(kind, -1, before).tolist()
    smaller = np.where(kind, before, -1).tolist()
    begins = np.concatenate([[0], ends[:-1]])
    sa, head = sa_.tolist(), begins.tolist()
    c0 = int(s[n - 1])
    sa[head[c0]] = n - 1
    head[c0] += 1
    for j in sa:
        k = larger[j]
        if k >= 0:
            h = head[k]
            sa[h] = j - 1
            head[k] = h + 1
    for x in slots.tolist():
        sa[x] = -1
    tail = ends.tolist()
    for j in reversed(sa):
        k = smaller[j]
        if k >= 0:
            h = tail[k] - 1
            tail[k] = h
            sa[h] = j - 1
    return np.array(sa, np.int64)


def _names(s: np.ndarray, ordered: np.ndarray, lms: np.ndarray, is_s: np.ndarray) -> np.ndarray:
    """The name of each leftmost-smaller substring; equal ones share it."""
    end = np.empty(len(s), np.int64)
    end[lms] = np.append(lms[1:], len(s))
    length = end[ordered] - ordered
    a, b = ordered[:-1], ordered[1:]
    same = (length[:-1] == length[1:]) & (end[a] < len(s)) & (end[b] < len(s))
    open_, at = np.flatnonzero(same), 0
    while len(open_):
        x, y = a[open_] + at, b[open_] + at
        ok = (s[x] == s[y]) & (is_s[x] == is_s[y])
        same[open_[~ok]] = False
        open_ = open_[ok & (at < length[:-1][open_])]
        at += 1
    return np.concatenate([[0], np.cumsum(~same)])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` (integers from 0, few gaps) in lexicographic order."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    is_s = _smaller(s)
    ends = np.cumsum(np.bincount(s))
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if not len(lms):
        return _induce(s, lms, is_s, ends)
    first = _induce(s, lms, is_s, ends)
    mark = np.zeros(n, bool)
    mark[lms] = True
    ordered = first[mark[first]]
    name = _names(s, ordered, lms, is_s)
    if name[-1] + 1 < len(lms):
        reduced = np.empty(n, np.int64)
        reduced[ordered] = name
        ordered = lms[suffix_array(reduced[lms])]
    return _induce(s, ordered, is_s, ends)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """At place i of the array, the common prefix of its suffix and the one before it; made in text order."""
    n = len(s)
    if not n:
        return np.empty(0, np.int64)
    phi_ = np.full(n, -1, np.int64)
    phi_[sa[1:]] = sa[:-1]
    phi, t, size = phi_.tolist(), [*s.tolist(), -1], 0
    out = [0] * n
    for i in range(n):
        k = phi[i]
        if k < 0:
            size = 0
            continue
        # the longer of the two ends at a character that no other place has
        while t[i + size] == t[k + size]:
            size += 1
        out[i] = size
        if size:
            size -= 1
    return np.array(out, np.int64)[sa]


# --- anchors and stretches ---------------------------------------------------


def _argmin(v: np.ndarray, w: int) -> np.ndarray:
    """Where the first least value of every w consecutive ones is."""
    at, have, low = np.arange(len(v)), 1, v
    while have < w:
        step = min(have, w - have)
        later = low[step:] < low[:-step] if step else None
        low, at = np.where(later, low[step:], low[:-step]), np.where(later, at[step:], at[:-step])
        have += step
    return at


def stretches(words: Words, least: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of one anchor: (its hash, text, first window, number of windows), windows by word in the slice."""
    gram = min(GRAM, least)
    none = np.empty(0, np.int64)
    if len(words.start) < least:
        return np.empty(0, np.uint64), none, none, none
    h = windows(words.hashes(), gram)
    pick = _argmin(h, least - gram + 1)
    row = words.row
    whole = np.flatnonzero(row[: len(pick)] == row[least - 1 :])
    if not len(whole):
        return np.empty(0, np.uint64), none, none, none
    p, r = pick[whole], row[whole]
    fresh = np.ones(len(whole), bool)
    fresh[1:] = (p[1:] != p[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(fresh)
    return h[p[at]], r[at], whole[at], np.diff(np.append(at, len(whole)))


def _anchors(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in slices(b.column(1)):
                words = Words(data, offsets, PUNCT)
                h, row, first, n = stretches(words, least)
                ids, body = (b.column(k).slice(i, j - i).take(pa.array(row)) for k in (0, 2))
                arrays = [pa.array(h.view(np.int64)), ids, body, pa.array((first - words.bounds[row]).astype(np.int32)), pa.array(n.astype(np.int16))]
                yield pa.RecordBatch.from_arrays(arrays, ["h", "doc_id", "body", "first", "n"])

    return run


def _cut(least: int):
    """Rows (doc_id, text, hash of the text, stretches) to one row a stretch, with its part of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in slices(b.column(1)):
                words = Words(data, offsets, PUNCT)
                lists = b.column(3).slice(i, j - i)
                row = np.repeat(np.arange(j - i), lists.value_lengths().to_numpy(zero_copy_only=False))
                each = lists.flatten()
                first, n = (each.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
                at = words.bounds[row] + first
                begin, end = words.start[at], words.end[at + n + least - 2]
                body, cut = _bodies(data, begin, end)
                texts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cut), pa.py_buffer(body)]).cast(pa.binary())
                ids, whole = (b.column(k).slice(i, j - i).take(pa.array(row)) for k in (0, 2))
                yield pa.RecordBatch.from_arrays([each.field(0), texts, ids, whole, pa.array(first.astype(np.int32))], ["h", "part", "doc_id", "body", "first"])

    return run


def _resplit(least: int):
    """Rows (anchor, last hash, part, doc_id, body, first) to the same, parted by the least hash above the last one."""
    gram = min(GRAM, least)
    top = np.uint64(2**64 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in slices(b.column("part").cast(pa.large_binary())):
                words = Words(data, offsets, PUNCT)
                floor = b.column("last").slice(i, j - i).to_numpy(zero_copy_only=False).view(np.uint64)
                row = words.row
                h = windows(words.hashes(), gram)
                h = np.where(h > floor[row[: len(h)]], h, top)
                pick = _argmin(h, least - gram + 1)
                whole = np.flatnonzero(row[: len(pick)] == row[least - 1 :])
                at_, r = pick[whole], row[whole]
                # windows whose hashes are used up stay together
                at_ = np.where(h[at_] == top, -1 - r, at_)
                fresh = np.ones(len(whole), bool)
                fresh[1:] = (at_[1:] != at_[:-1]) | (r[1:] != r[:-1])
                k = np.flatnonzero(fresh)
                n = np.diff(np.append(k, len(whole)))
                first, r, at_ = whole[k], r[k], at_[k]
                value = np.where(at_ < 0, top, h[np.maximum(at_, 0)])
                old = b.column("h").slice(i, j - i).to_numpy(zero_copy_only=False).view(np.uint64)[r]
                body, cut = _bodies(data, words.start[first], words.end[first + n + least - 2])
                part = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(cut), pa.py_buffer(body)]).cast(pa.binary())
                ids, whole_, begin = (b.column(c).slice(i, j - i).take(pa.array(r)) for c in ("doc_id", "body", "first"))
                begin = (begin.to_numpy(zero_copy_only=False) + first - words.bounds[r]).astype(np.int32)
                arrays = [pa.array(mix(old ^ (value * U(0x9E3779B97F4A7C15))).view(np.int64)), pa.array(value.view(np.int64)), part, ids, whole_, pa.array(begin)]
                yield pa.RecordBatch.from_arrays(arrays, ["h", "last", "part", "doc_id", "body", "first"])

    return run


def _bodies(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte ranges joined, and where each begins."""
    size = end - begin
    cut = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=cut[1:])
    return data[np.repeat(begin - cut[:-1], size) + np.arange(cut[-1])], cut


def repeats_in(texts: list[bytes], low: np.ndarray, high: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(stretch, first window, windows, least document) of runs of windows that two documents have.

    ``low`` and ``high`` are the least and greatest document of each stretch.
    """
    joined = np.frombuffer(b" ".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    bounds[-1] -= 1
    words = Words(joined, bounds, PUNCT)
    m = len(texts)
    body, cut = _bodies(joined, words.start, words.end)
    each = pa.Array.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(cut), pa.py_buffer(body)])
    symbol = each.dictionary_encode().indices.to_numpy().astype(np.int64)
    # an end that no other stretch has follows each stretch
    s = np.empty(len(symbol) + m, np.int64)
    stop = words.bounds[1:] + np.arange(m)
    inner = np.ones(len(s), bool)
    inner[stop] = False
    s[inner] = symbol + m
    s[stop] = np.arange(m)
    of = np.repeat(np.arange(m), words.count + 1)
    sa = suffix_array(s)
    lcp = common_prefixes(s, sa)
    cuts = np.flatnonzero(lcp < least)
    d = of[sa]
    lo, hi = np.minimum.reduceat(low[d], cuts), np.maximum.reduceat(high[d], cuts)
    several = np.repeat(lo != hi, np.diff(np.append(cuts, len(sa))))
    owner = np.repeat(lo, np.diff(np.append(cuts, len(sa))))
    begin = stop - words.count
    room = words.count[d] - (sa - begin[d]) >= least
    hit = several & room
    at, own = sa[hit], owner[hit]
    order = np.argsort(at)
    at, own = at[order], own[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) != 1) | (of[at[1:]] != of[at[:-1]]) | (own[1:] != own[:-1])
    k = np.flatnonzero(fresh)
    n = np.diff(np.append(k, len(at)))
    return zip(of[at[k]].tolist(), (at[k] - begin[of[at[k]]]).tolist(), n.tolist(), own[k].tolist())


def _shards(least: int):
    """Rows (h, part, low, high) sorted by h to the repeated windows of each stretch."""

    def close(h: list, parts: list, low: list, high: list, ids: list) -> pa.RecordBatch:
        found = list(repeats_in(parts, np.array(low, np.int64), np.array(high, np.int64), least))
        cols = [[h[x[0]] for x in found], [ids[x[0]] for x in found], *[[x[k] for x in found] for k in (1, 2, 3)]]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["h", "sid", "skip", "n", "owner"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        size = 0
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("h", "part", "low", "high", "sid")]
            for row in zip(*cols):
                if size > SHARD_WORDS * 6 and row[0] != held[0][-1]:
                    yield close(held[0], held[1], held[2], held[3], held[4])
                    held, size = [[], [], [], [], []], 0
                for x, v in zip(held, row):
                    x.append(v)
                size += len(row[1])
        if size:
            yield close(held[0], held[1], held[2], held[3], held[4])

    return run


def _unique(parts: DataFrame) -> DataFrame:
    return parts.groupBy("h", "sid", "part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))


def _split_hot(parts: DataFrame, least: int, hot: int) -> DataFrame:
    """``parts`` (h, last, part, doc_id, body, first, sid), stashed, until no anchor has more than ``hot`` different stretches."""
    while True:
        several = stash(parts.select("h", "sid").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("h"))
        # a window whose hashes are used up can't be parted again
        open_ = parts.join(several, "h", "left_semi").where("last <> -1")
        if several.isEmpty() or open_.isEmpty():
            drop(several)
            return parts
        new = open_.select("h", "last", "part", "doc_id", "body", "first").mapInArrow(_resplit(least), "h bigint, last bigint, part binary, doc_id bigint, body bigint, first int")
        new = stash(new.withColumn("sid", F.xxhash64("part")))
        shared = new.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
        rest = parts.join(several, "h", "left_anti").unionByName(parts.join(several, "h", "left_semi").where("last = -1"))
        out = stash(rest.unionByName(new.join(shared, "h", "left_semi")))
        for x in (parts, several, new):
            drop(x)
        parts = out


def _spans(docs: DataFrame, id_col: str, text: str, least: int, hot: int) -> DataFrame:
    """(doc_id, body, a, z, owner): words a to z of the text with hash ``body`` are in windows that ``owner`` is the least document to have."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    rows = rows.withColumn("body", F.xxhash64("text"))
    anchors = stash(rows.mapInArrow(_anchors(least), "h bigint, doc_id bigint, body bigint, first int, n smallint"))
    shared = stash(anchors.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h"))
    both = anchors.join(shared, "h", "left_semi")
    per = stash(both.groupBy("doc_id", "body").agg(F.collect_set(F.struct("h", "first", "n")).alias("s")))
    drop(anchors)
    drop(shared)
    texts = rows.join(per, ["doc_id", "body"]).select("doc_id", "text", "body", "s")
    parts = texts.mapInArrow(_cut(least), "h bigint, part binary, doc_id bigint, body bigint, first int")
    parts = _split_hot(stash(parts.withColumns({"last": F.col("h"), "sid": F.xxhash64("part")})), least, hot)
    shards = stash(_unique(parts).repartition("h").sortWithinPartitions("h").mapInArrow(_shards(least), "h bigint, sid bigint, skip int, n int, owner bigint"))
    drop(per)
    hits = parts.select("h", "sid", "doc_id", "body", "first").join(shards, ["h", "sid"])
    return hits.select("doc_id", "body", (F.col("first") + F.col("skip")).alias("a"), (F.col("first") + F.col("skip") + F.col("n") + least - 1).alias("z"), "owner")


def _joined(spans: DataFrame) -> DataFrame:
    """Spans of one text that touch or overlap, as one: (doc_id, body, a, z, owner)."""
    order = Window.partitionBy("doc_id", "body").orderBy("a", "z")
    spans = spans.withColumn("reach", F.max("z").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    begins = F.when(F.col("a") <= F.col("reach"), 0).otherwise(1)
    spans = spans.withColumn("k", F.sum(begins).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "body", "k").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.min("owner").alias("owner")).drop("k")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(doc_id, first_word, n_words, first_id): every stretch of a document that other documents have too.

    A word of a document is in a stretch exactly if some ``least`` words in a
    row around it occur in another document; ``first_word`` counts from 0, and
    touching windows make one stretch.  ``first_id`` is the least document
    that has one of the stretch's windows; it lists its own stretches as well.
    Repeats inside one document alone don't count.  Words are equal if their
    bytes are, so case matters; white space and ASCII punctuation between them
    don't.

    Rows with a null id or text are passed over; repeated rows count once.
    Several texts of one id are parts of one document, each with its own count
    of words.  A text of fewer words has none.  Ids must be integers, or strings
    of integers.  Other columns are ignored; an empty table gives no rows.
    """
    whole = _joined(_spans(docs, id_col, text, least, hot))
    return whole.select("doc_id", F.col("a").alias("first_word"), (F.col("z") - F.col("a")).alias("n_words"), F.col("owner").alias("first_id"))


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, hot: int = HOT) -> DataFrame:
    """``docs`` with every repeated window of words cut from all documents but the least that has it; all columns are kept.

    What is cut goes from the first byte of its first word to the last byte of
    its last one.  Rows without a repeat, with a null id or text stay as they
    are, and so does their number.  Each window of words stays in one document
    at least; in an id's several texts it stays wherever it is.
    """
    names = docs.columns
    i, t = names.index(id_col), names.index(text)
    spans = _spans(docs, id_col, text, least, hot).where("owner <> doc_id")
    cuts = stash(_joined(spans).groupBy("doc_id", "body").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("s")))
    raw = docs.toDF(*[f"c{k}" for k in range(len(names))])
    keyed = raw.withColumns({"doc_id": F.col(f"c{i}").cast("bigint"), "body": F.xxhash64(F.col(f"c{t}").cast("string"))})
    met = keyed.join(cuts, ["doc_id", "body"], "left").select(*raw.columns, "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(t), b.column(b.num_columns - 1)
            out = []
            for k in range(b.num_rows):
                if not spans[k].is_valid or not texts[k].is_valid:
                    out.append(texts[k].as_py())
                    continue
                body = texts[k].as_py().encode()
                words = Words(np.frombuffer(body, np.uint8), np.array([0, len(body)]), PUNCT)
                at, kept = 0, []
                for x in spans[k].as_py():
                    kept.append(body[at : words.start[x["a"]]])
                    at = words.end[x["z"] - 1]
                out.append(b"".join([*kept, body[at:]]).decode())
            arrays = [pa.array(out, pa.string()) if c == t else b.column(c) for c in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(arrays, b.schema.names[:-1])

    return met.mapInArrow(run, raw.schema).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that several documents share, in each of them."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
