"""Exact top-k search by histogram selection.

The query set, by default every vector of the table, is held in blocks against
all vectors in blocks.  Scores are fixed
point (cosine or dot product to nine decimals), so that equal vectors tie
exactly.  A round scores all pairs block by block and adds up one histogram of
scores a query; the bin that holds the kth score becomes the next round's
range.  When at most ``slack`` candidates lie at or above the lower edge, or
the bin is one score wide, a last round keeps the pairs at or above the edge and
ranks them by score and then by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.scratch import drop, stash

NAME = "op2_exact_topk"
SCALE = 1_000_000_000
BINS = 64
#: Vectors in a block of data, and of queries.
BLOCK, ASKED = 2048, 512
K = 10
#: Tasks of a round for each core that the session has.
WAVES = 3
#: The registered query asks for the vectors whose id is a multiple of this.
EVERY = 50
#: A product of matrices of other shapes may round otherwise; what the last round keeps reaches so far below the edge.
ROUNDING = 2
NONE = -(1 << 62)
STATE = "bid bigint, lo binary, hi binary, above binary, open binary, left bigint"


def _pack(batches: Iterator[pa.RecordBatch], block: int, unit: bool) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) to blocks (ids, float64 matrix), both as bytes."""
    ids, rows, dim = [], [], 0

    def out() -> pa.RecordBatch:
        m = np.stack(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([m.shape[1]], pa.int32())],
            ["ids", "m", "dim"],
        )

    for b in batches:
        for i, v in zip(b.column(0).to_pylist(), b.column(1)):
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
            if unit:
                size = np.sqrt(np.dot(x, x))
                x = x / size if size > 0 else x
            if rows and (len(rows) == block or len(x) != dim):
                yield out()
                ids, rows = [], []
            dim = len(x)
            ids.append(i)
            rows.append(x)
    if rows:
        yield out()


def _start(batches: Iterator[pa.RecordBatch], edge: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for bid, ids in zip(b.column("bid").to_pylist(), b.column("ids").to_pylist()):
            n = len(ids) // 8
            parts = np.full(n, -edge), np.full(n, edge), np.zeros(n, np.int64), np.ones(n, bool)
            yield pa.RecordBatch.from_arrays([pa.array([bid], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in parts], pa.array([n], pa.int64())], ["bid", "lo", "hi", "above", "open", "left"])


def _scores(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.rint(q @ d.T * SCALE).astype(np.int64)


def _blocks(b: pa.RecordBatch, open_only: bool) -> Iterator[tuple]:
    """(block id, size, rows asked, their ids, vectors, lo, hi, data ids, data vectors) of each pair of blocks."""
    for i in range(b.num_rows):
        get = lambda c, t: np.frombuffer(b.column(c)[i].as_buffer(), t)  # noqa: E731, B023
        dim, q = b.column("dim")[i].as_py(), get("qids", np.int64)
        if b.column("qdim")[i].as_py() != dim:
            continue
        rows = np.flatnonzero(get("open", np.bool_)) if open_only else np.arange(len(q))
        if len(rows):
            vectors = get("qm", np.float64).reshape(-1, dim)[rows]
            yield b.column("qbid")[i].as_py(), len(q), rows, q, vectors, get("lo", np.int64)[rows], get("hi", np.int64)[rows], get("ids", np.int64), get("m", np.float64).reshape(-1, dim)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bin counts of each query block that a task met."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for bid, n, rows, q, vectors, lo, hi, ids, data in _blocks(b, True):
            total = sums.setdefault(bid, np.zeros((n, BINS + 1), np.int64))
            s = _scores(vectors, data)
            s[q[rows][:, None] == ids[None, :]] = NONE
            width = -(-(hi - lo + 1) // BINS)
            for r, own in enumerate(rows):
                x = s[r][s[r] >= lo[r]]
                at = np.minimum((x - lo[r]) // width[r], BINS)
                at[x > hi[r]] = BINS
                total[own] += np.bincount(at, minlength=BINS + 1)
    for bid, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([bid], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["bid", "h"])


def _refine(k: int, slack: int):
    """Sum the counts of every block and give the next range of its queries.

    Rows come sorted by block; the block's present ranges come with ``h`` null.
    """

    def close(bid: int, state: list, total: np.ndarray | None) -> pa.RecordBatch:
        lo, hi, above, open_ = (x.copy() for x in state)
        if total is None:
            open_[:] = False
        for r in np.flatnonzero(open_):
            width = -(-(int(hi[r]) - int(lo[r]) + 1) // BINS)
            counts, got = total[r, :BINS], int(above[r])
            if got + int(counts.sum()) <= max(k, slack):
                open_[r] = False
                continue
            j = BINS - 1
            while got + counts[j] < k:
                got += int(counts[j])
                j -= 1
            base = int(lo[r])
            lo[r], hi[r], above[r] = base + j * width, min(int(hi[r]), base + (j + 1) * width - 1), got
            open_[r] = got + counts[j] > slack and width > 1
        parts = [pa.array([x.tobytes()], pa.binary()) for x in (lo, hi, above, open_)]
        return pa.RecordBatch.from_arrays([pa.array([bid], pa.int64()), *parts, pa.array([int(open_.sum())], pa.int64())], ["bid", "lo", "hi", "above", "open", "left"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bid, state, total = None, None, None
        for b in batches:
            for i in range(b.num_rows):
                own = b.column("bid")[i].as_py()
                if own != bid:
                    if bid is not None:
                        yield close(bid, state, total)
                    bid, state, total = own, None, None
                if b.column("h")[i].as_py() is None:
                    kinds = (("lo", np.int64), ("hi", np.int64), ("above", np.int64), ("open", np.bool_))
                    state = [np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in kinds]
                else:
                    h = np.frombuffer(b.column("h")[i].as_buffer(), np.int64).reshape(-1, BINS + 1)
                    total = h.copy() if total is None else total + h
        if bid is not None:
            yield close(bid, state, total)

    return run


def _keep(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, list]] = {}
        for b in batches:
            for bid, _, rows, q, vectors, lo, _, ids, data in _blocks(b, False):
                s = _scores(vectors, data)
                s[q[:, None] == ids[None, :]] = NONE
                r, c = np.nonzero((s >= lo[:, None] - ROUNDING) & (s > NONE))
                found = [r, s[r, c], ids[c]]
                if bid in best:
                    found = [np.concatenate(x) for x in zip(best[bid][1], found)]
                order = np.lexsort((found[2], -found[1], found[0]))
                found = [x[order] for x in found]
                top = np.arange(len(order)) - np.searchsorted(found[0], found[0]) < k
                best[bid] = q.copy(), [x[top] for x in found]
        for q, (r, s, i) in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(i), pa.array(s)], ["query_id", "neighbor_id", "s"])

    return run


def exact_topk(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, metric: str = "cosine", slack: int | None = None, block: int = BLOCK, asked: Column | None = None, ask_block: int = ASKED) -> DataFrame:
    """(query_id, rank, neighbor_id, score) of the k best other vectors for every vector that ``asked``, a condition on the table, holds for.

    Without ``asked`` all vectors are queries; a null condition asks nothing.
    Rows with a null id, a null or empty vector or a null or non-finite element
    are neither asked nor found.  Vectors of another length than the query's
    are not its candidates.  A zero vector scores 0 against all under "cosine".
    A vector isn't its own neighbour, and neither is another row of its id; of
    repeated rows of one id, the one with the greatest vector counts, and it is
    a query if any of them is.  Ties rank by ascending id.  A query with fewer
    than k others gets all of them.  Ids must be integers, or strings of
    integers.  Further columns are ignored; an empty table gives no rows.

    Work is the queries * n scores of each round; what is shuffled is the
    histograms, queries * tasks * 65 counts, and at the end k rows a query and task.
    """
    slack = 4 * k if slack is None else slack
    want = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    v = vectors.select(F.col(id_col).cast("bigint").alias("i"), F.col(vector).cast("array<double>").alias("x"), want.alias("want"))
    v = v.where("i is not null and size(x) > 0 and not exists(x, e -> e is null or isnan(e) or abs(e) > 1.7976931348623157E308D)")
    v = v.groupBy("i").agg(F.max("x").alias("x"), F.bool_or("want").alias("want"))
    unit = metric == "cosine"
    n, n_asked, longest, dims = v.agg(F.count(F.lit(1)), F.coalesce(F.count_if("want"), F.lit(0)), F.max(F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e)), F.count_distinct(F.size("x"))).first()
    schema = "query_id bigint, rank int, neighbor_id bigint, score double"
    if not n_asked:
        return spark.createDataFrame([], schema)

    def packed(rows: DataFrame, size: int, count: int) -> DataFrame:
        spread = rows.repartition(count, "i").sortWithinPartitions(F.size("x"), "i") if dims > 1 else rows.repartition(count, "i")
        return spread.select("i", "x").mapInArrow(lambda b: _pack(b, size, unit), "ids binary, m binary, dim int")

    data_blocks, asked_parts = -(-n // block), min(-(-n_asked // ask_block), 4096)
    data_parts = max(1, min(data_blocks, -(-WAVES * spark.sparkContext.defaultParallelism // asked_parts)))
    data = stash(packed(v, block, data_blocks))
    queries = stash(packed(v.where("want"), ask_block, asked_parts).select(F.xxhash64("ids").alias("bid"), "*"))
    edge = SCALE + 2 if unit else int(longest * SCALE) + 2
    state = stash(queries.mapInArrow(lambda b: _start(b, edge), STATE))
    spread = data.repartition(data_parts)

    def pairs(state: DataFrame) -> DataFrame:
        """Blocks of queries with their ranges, each beside every block of data."""
        q = queries.select(F.col("bid").alias("qbid"), F.col("ids").alias("qids"), F.col("m").alias("qm"), F.col("dim").alias("qdim"))
        q = q.join(state.select(F.col("bid").alias("qbid"), "lo", "hi", "open"), "qbid")
        return q.repartition(asked_parts, "qbid").crossJoin(spread.hint("shuffle_replicate_nl"))

    while True:
        h = pairs(state.where("left > 0")).mapInArrow(_histograms, "bid bigint, h binary")
        both = state.withColumn("h", F.lit(None).cast("binary")).unionByName(h, allowMissingColumns=True)
        both = both.repartition(asked_parts, "bid").sortWithinPartitions("bid")
        new = stash(both.mapInArrow(_refine(k, slack), STATE))
        drop(state)
        state = new
        if state.where("left > 0").isEmpty():
            break
    found = stash(pairs(state).mapInArrow(_keep(k), "query_id bigint, neighbor_id bigint, s bigint"))
    for x in (data, queries, state):
        drop(x)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "neighbor_id"))), 1, k)
    top = found.groupBy("query_id").agg(best.alias("t"))
    return top.select("query_id", F.posexplode("t").alias("p", "r")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("r.neighbor_id").alias("neighbor_id"), (-F.col("r.s") / F.lit(float(SCALE))).alias("score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other embeddings, out of all, of every embedding whose id is divisible by 50."""
    return exact_topk(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), asked=F.col("vec_id") % EVERY == 0)


SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS n FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0),
u AS (SELECT vec_id, list_transform(x, lambda y: CASE WHEN n > 0 THEN y / n ELSE y END) AS x FROM e),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, CAST(round(list_inner_product(a.x, b.x) * 1000000000) AS BIGINT) AS s FROM u a JOIN u b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbor_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, s / 1000000000.0::DOUBLE AS score FROM r WHERE rank <= 10
"""
