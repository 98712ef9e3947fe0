"""Graphs that one task can hold, closed in one task.

A fixpoint over a large graph is a job a hop.  Below ``ROWS`` rows, a stated
and checked bound, the whole graph fits one executor's task, which finds the
same rows at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of edges and seeds up to which a graph is closed in one task: about 100 MB of numbers.
ROWS = 2_000_000


def fits(*parts: DataFrame, rows: int | None = None) -> bool:
    """Whether the parts together have at most ``rows`` rows."""
    limit = ROWS if rows is None else rows
    total = 0
    for p in parts:
        total += p.count() if limit else 1
        if total > limit:
            return False
    return True


def in_one_task(rows: DataFrame, run: Callable[[pa.Table], dict[str, pa.Array]], schema: str) -> DataFrame:
    """All of ``rows`` as one Arrow table in one task, to what ``run`` makes of it."""
    kinds = to_arrow_schema(rows.schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            out = pa.table(run(pa.Table.from_batches(parts).combine_chunks()))
        else:
            out = pa.table(run(kinds.empty_table()))
        yield from out.combine_chunks().to_batches()

    return rows.coalesce(1).mapInArrow(task, schema)


class Codes:
    """Values of two columns as numbers in the order of the values."""

    def __init__(self, *columns: pa.ChunkedArray):
        parts = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        every = pc.unique(pa.concat_arrays(parts))
        every = every.filter(every.is_valid())
        self.values = every.take(pc.array_sort_indices(every))
        self._columns = parts

    def of(self, k: int) -> np.ndarray:
        return pc.index_in(self._columns[k], self.values).to_numpy(zero_copy_only=False).astype(np.int64)

    def back(self, codes: np.ndarray) -> pa.Array:
        return self.values.take(pa.array(codes))


def _starts(src: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])


def reach(t: pa.Table) -> dict[str, pa.Array]:
    """Rows (t, a, b): edges with t 0, seeds with t 1, nodes never entered with t 2, to (node, hop)."""
    kind, ids = t["t"].to_numpy(), Codes(t["a"], t["b"])
    n = len(ids.values)
    edge = kind == 0
    a = ids.of(0) if n else np.zeros(len(kind), np.int64)
    src, dst = (a[edge], pc.index_in(t["b"].filter(pa.array(edge)), ids.values).to_numpy().astype(np.int64)) if n else (a[edge], a[edge])
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    first = _starts(src, n)
    closed = np.zeros(n, bool)
    closed[a[kind == 2]] = True
    new = np.unique(a[kind == 1])
    new = new[~closed[new]]
    nodes, hops, hop = [new[:0]], [np.empty(0, np.int32)], 0
    while len(new):
        closed[new] = True
        nodes.append(new)
        hops.append(np.full(len(new), hop, np.int32))
        hop += 1
        size = first[new + 1] - first[new]
        at = np.repeat(first[new] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        new = np.unique(dst[at])
        new = new[~closed[new]]
    return {"node": ids.back(np.concatenate(nodes)), "hop": pa.array(np.concatenate(hops))}


def components(t: pa.Table) -> dict[str, pa.Array]:
    """Rows (u, v) to (node, component), the least node that is connected."""
    ids = Codes(t["u"], t["v"])
    u, v = ids.of(0), ids.of(1)
    top = np.arange(len(ids.values))
    while len(u):
        low, high = np.minimum(top[u], top[v]), np.maximum(top[u], top[v])
        np.minimum.at(top, high, low)
        while (top[top] != top).any():
            top = top[top]
        open_ = top[u] != top[v]
        u, v = u[open_], v[open_]
    return {"node": ids.values, "component": ids.back(top)}


def strong(t: pa.Table) -> dict[str, pa.Array]:
    """Rows (src, dst) to (node, component) of nodes on a cycle of two or more; the component is its greatest node."""
    ids = Codes(t["src"], t["dst"])
    src, dst, n = ids.of(0), ids.of(1), len(ids.values)
    order = np.argsort(src, kind="stable")
    first, to = _starts(src, n).tolist(), dst[order].tolist()
    number, low, on = [0] * n, [0] * n, [False] * n
    stack: list[int] = []
    part = np.arange(n)
    size = np.ones(n, np.int64)
    count = 0
    for root in range(n):
        if number[root]:
            continue
        work = [(root, first[root])]
        while work:
            x, at = work.pop()
            if at == first[x]:
                count += 1
                number[x] = low[x] = count
                stack.append(x)
                on[x] = True
            end = first[x + 1]
            while at < end:
                y = to[at]
                at += 1
                if not number[y]:
                    work.append((x, at if at > first[x] else first[x] + 1))
                    work.append((y, first[y]))
                    break
                if on[y] and number[y] < low[x]:
                    low[x] = number[y]
            else:
                if low[x] == number[x]:
                    own = []
                    while True:
                        y = stack.pop()
                        on[y] = False
                        own.append(y)
                        if y == x:
                            break
                    part[own] = max(own)
                    size[own] = len(own)
                if work:
                    up = work[-1][0]
                    low[up] = min(low[up], low[x])
    hit = np.flatnonzero(size > 1)
    return {"node": ids.back(hit), "component": ids.back(part[hit])}
