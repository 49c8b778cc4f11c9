"""Closest-first matches of two sets of points without their pairs.

The closest pair of free rows is taken again and again; ties go by row.  Rows at one place and time are one node with a queue
of rows, of which only the first can be next.  Radii grow in steps: pairs of nodes within a radius are taken before any
beyond it is looked at, and rows that are taken by then make no pairs, so that a step meets a few pairs a row.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import partitions

#: Pairs a node that a step may look at, if a smaller radius is left, and pairs that are looked at together.
FEW, TOGETHER = 8, 1 << 21


class _Side:
    """The nodes of one side: their place and time, and ``ids``, the rows of one node after another, up to ``ends``."""

    def __init__(self, place: np.ndarray, ids: np.ndarray, ends: np.ndarray):
        self.place, self.ids, self.end = place, ids, ends.tolist()
        self.next = [0, *self.end[:-1]]
        self.free = np.arange(len(ends))

    def keep_free(self) -> None:
        self.free = np.array([n for n in self.free.tolist() if self.next[n] < self.end[n]], int)


def _nodes(row: np.ndarray, place: np.ndarray) -> tuple[_Side, np.ndarray]:
    """Rows as nodes, and the position of each row of their queues."""
    order = np.lexsort((row, *place))
    at = place[:, order]
    new = np.ones(len(row), bool)
    new[1:] = (at[:, 1:] != at[:, :-1]).any(0)
    return _Side(at[:, new], row[order], np.append(np.flatnonzero(new)[1:], len(row))), order


def _ranges(a: _Side, b: _Side, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """b's free nodes in order of cells, and for each free node of a three ranges of them that hold all within r."""
    side = r * (1 + 1e-9)
    (ax, ay), (bx, by) = (np.floor(s.place[:2, s.free] / side).astype(np.int64) for s in (a, b))
    low, wide = min(ay.min(), by.min()) - 1, max(ay.max(), by.max()) - min(ay.min(), by.min()) + 3
    left = min(ax.min(), bx.min()) - 1
    key = (bx - left) * wide + by - low
    order = np.argsort(key, kind="stable")
    key = key[order]
    own = ((ax - left) * wide + ay - low)[:, None] + np.arange(-1, 2) * wide
    return b.free[order], np.searchsorted(key, own - 1), np.searchsorted(key, own + 1, side="right")


def _pairs(a: _Side, b: _Side, found, limit: float, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes, lo, hi = found
    n = (hi - lo).sum(1)
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // TOGETHER)) + 1
    out = []
    for part in np.split(np.arange(len(n)), cuts):
        length = (hi - lo)[part].ravel()
        i = np.repeat(np.repeat(a.free[part], 3), length)
        j = nodes[np.repeat(lo[part].ravel() - np.cumsum(length) + length, length) + np.arange(length.sum())]
        dx, dy = (a.place[k, i] - b.place[k, j] for k in (0, 1))
        d2 = dx * dx + dy * dy
        ok = (d2 <= limit) & (np.minimum(a.place[3, i], b.place[3, j]) - np.maximum(a.place[2, i], b.place[2, j]) + 1 >= overlap)
        out.append((d2[ok], i[ok], j[ok]))
    d2, i, j = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(d2, kind="stable")
    return d2[order], i[order], j[order]


def matches(a_row: np.ndarray, a_place: np.ndarray, b_row: np.ndarray, b_place: np.ndarray, d: float, overlap: int = 1) -> list[tuple[int, int, float]]:
    """(position in a, position in b, squared distance); places are rows x, y, first and last frame of finite numbers."""
    if not len(a_row) or not len(b_row):
        return []
    (a, a_at), (b, b_at) = _nodes(a_row, a_place), _nodes(b_row, b_place)
    i, j, d2 = _spread(_taken(a, b, d, overlap))
    return list(zip(a_at[i].tolist(), b_at[j].tolist(), d2.tolist(), strict=True))


def _spread(runs: list[tuple[int, int, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The queue positions and squared distances of runs of matches, one by one."""
    i, j, n, d2 = (np.array([r[k] for r in runs], t) for k, t in enumerate((np.int64, np.int64, np.int64, np.float64)))
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(i, n) + step, np.repeat(j, n) + step, np.repeat(d2, n)


def _taken(a: _Side, b: _Side, d: float, overlap: int) -> list[tuple[int, int, int, float]]:
    """Runs of matches: from which position of a's and of b's rows on, how many, and their squared distance."""
    out: list[tuple[int, int, int, float]] = []
    both = np.concatenate([a.place[:2], b.place[:2]], 1)
    least, done = max(float(np.ptp(both, axis=1).max()), float(np.abs(both).max())) / (1 << 28), 0.0  # cells have numbers

    def take(p: int, q: int, d2: float, n: int = 1) -> None:
        out.append((a.next[p], b.next[q], n, d2))
        a.next[p] += n
        b.next[q] += n

    left = lambda p, q: min(a.end[p] - a.next[p], b.end[q] - b.next[q])
    free = lambda p, q: a.next[p] < a.end[p] and b.next[q] < b.end[q]
    while len(a.free) and len(b.free) and done < d:
        r = d
        while (found := _ranges(a, b, r)) and (found[2] - found[1]).sum() > FEW * (len(a.free) + len(b.free)) and r / 2 > max(done, least):
            r /= 2
        d2, i, j = _pairs(a, b, found, r * r, overlap)
        ends = np.flatnonzero(np.append(d2[1:] != d2[:-1], True)[: len(d2)]) + 1
        d2, i, j, at = d2.tolist(), i.tolist(), j.tolist(), 0
        for end in ends.tolist():
            if end == at + 1:
                if n := left(i[at], j[at]):
                    take(i[at], j[at], d2[at], n)
            else:  # pairs at one distance take turns by their rows
                heads = lambda p, q: (a.ids[a.next[p]], b.ids[b.next[q]], p, q)
                heap = [heads(p, q) for p, q in zip(i[at:end], j[at:end], strict=True) if free(p, q)]
                heapq.heapify(heap)
                while heap:
                    top = heapq.heappop(heap)
                    p, q = top[2:]
                    if not free(p, q):
                        continue
                    if top == heads(p, q):
                        take(p, q, d2[at])
                    if free(p, q):
                        heapq.heappush(heap, heads(p, q))
            at = end
        done = r
        a.keep_free()
        b.keep_free()
    return out


def match_groups(rows: DataFrame, d: float, overlap: int = 1) -> DataFrame:
    """(group, a_row_id, b_row_id, d2, overlap) of rows (group, side, row_id, x, y, frame, end_frame): side 0 is matched with
    side 1 within each group, which one task holds.  Instead of row_id, rows may have ``row_ids``: those of a place in order."""
    nodes = "row_ids" in rows.columns
    name = "row_ids" if nodes else "row_id"
    kind = rows.schema[name].dataType.elementType if nodes else rows.schema[name].dataType
    schema = rows.select(F.col("group").cast("long"), F.lit(None).cast(kind).alias("a_row_id"), F.lit(None).cast(kind).alias("b_row_id"), F.lit(0.0).alias("d2"), F.lit(0).alias("overlap")).schema
    finite = "group IS NOT NULL AND abs(x) < double('inf') AND abs(y) < double('inf')"  # NaN is above all numbers
    dealt = rows.where(finite).selectExpr("CAST(group AS LONG) AS group", "side", name, "CAST(x AS DOUBLE) AS x", "CAST(y AS DOUBLE) AS y", "CAST(frame AS DOUBLE) AS frame", "CAST(end_frame AS DOUBLE) AS end_frame")
    dealt = dealt.repartition(partitions(rows), "group").sortWithinPartitions("group")

    def side_of(t: pa.Table, k: int) -> tuple[_Side, pa.Array, np.ndarray]:
        """Its nodes, their rows' ids as stored, and the node of each row."""
        t = t.filter(pc.equal(t["side"], k))
        place = np.stack([t[c].to_numpy() for c in ("x", "y", "frame", "end_frame")])
        ids = t[name].combine_chunks()
        if nodes:
            n, ids = pc.list_value_length(ids).to_numpy(), ids.flatten()
            return _Side(place, ids.to_numpy(), np.cumsum(n)), ids, np.repeat(np.arange(len(n)), n)
        side, order = _nodes(ids.to_numpy(zero_copy_only=False), place)
        return side, ids.take(pa.array(order)), np.repeat(np.arange(len(side.end)), np.diff([0, *side.end]))

    def solve(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        group = t["group"][0].as_py()
        (a, a_ids, a_node), (b, b_ids, b_node) = side_of(t, 0), side_of(t, 1)
        del t
        i, j, d2 = _spread(_taken(a, b, d, overlap)) if len(a_ids) and len(b_ids) else (np.empty(0, np.int64),) * 2 + (np.empty(0),)
        p, q = a_node[i], b_node[j]
        common = (np.minimum(a.place[3, p], b.place[3, q]) - np.maximum(a.place[2, p], b.place[2, q]) + 1).astype(np.int32)
        for at in range(0, len(i), 1 << 16):  # batches of a bounded size
            part = slice(at, at + (1 << 16))
            columns = [pa.array(np.full(len(i[part]), group), pa.int64()), a_ids.take(pa.array(i[part])), b_ids.take(pa.array(j[part])), pa.array(d2[part]), pa.array(common[part])]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end > at:
                    if held and held[0].column(0)[0].as_py() != group[at]:
                        yield from solve(held)
                        held = []
                    held.append(batch.slice(at, end - at))
        if held:
            yield from solve(held)

    return dealt.mapInArrow(run, schema)


def places(rows: DataFrame) -> DataFrame:
    """(side, x, y, frame, end_frame, row_ids) of rows of both sides: those of one place and time are one row.  Rows without
    an id match nothing."""
    met = rows.where("row_id IS NOT NULL").groupBy("side", "x", "y", "frame", "end_frame")
    return met.agg(F.sort_array(F.collect_list("row_id")).alias("row_ids"))


def sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (row_id, x, y, frame, end_frame) of both, with their side."""
    pick = lambda t, k: t.select(F.lit(k).alias("side"), "row_id", "x", "y", "frame", "end_frame")
    return pick(a, 0).union(pick(b, 1))
