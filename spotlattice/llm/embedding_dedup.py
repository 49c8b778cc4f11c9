"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

On unit vectors cosine >= c is distance <= r = sqrt(2 - 2c).  Equal vectors are one class with a multiplicity.  The upper
level of the tree is a set of pivots (farthest-first on a bounded sample); the vectors of a pivot are dealt into blocks, and
each block gets its own cover tree: nested nets whose radius halves from level to level, each node with its true covering
radius.  Pairs of pivots, then of nodes, are pruned when their centres are further apart than r and both radii, and taken
whole when even the farthest members are within r; what is left at the bottom is compared in double precision.

Links are counted, not listed: a pair of nodes taken whole adds its mass to both ranges, and a task returns one count and at
most one tree edge a vector.  In high dimensions unrelated vectors are far from every net point; then the nets' matrix of
centre distances is the comparison itself, by matrix product.

Pairs of blocks go to tasks by tiles: trees are dealt into groups, and a tile holds the trees of two groups, so a tree is sent
once for each group that it meets, not once for each tree.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing and are kept; vectors
of different lengths do not link; repeated rows are different vectors of one id, each with its own links and component (named
by the smallest id in it); rows with a null id are returned with no links; other columns are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, partitions, shared_table

#: Vectors in a block; rows of the sample for pivots; pivots; net radii of the levels; slack of the bounds.
BLOCK, SAMPLE, PIVOTS, RADII, SLACK = 4096, 2048, 16, (0.5, 0.25, 0.125), 1e-7
#: Pairs of vectors that are compared at once; trees and bytes of trees in a group.
SMALL, GROUP, GROUP_BYTES = 1 << 16, 16, 1 << 26


def _unit(batches):
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(0)
            norm = np.sqrt(x @ x) if len(x) and np.isfinite(x).all() else 0.0
            out.append((x / norm).tobytes() if norm > 0 and np.isfinite(norm) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["_id", "_v"])


def _net(left: np.ndarray, small: np.ndarray, cosine: float):
    """A net's cells, greedily: the first member left takes all within the radius.  Single precision only moves members
    between cells; the nodes' radii are measured afterwards."""
    if len(left) == 1:
        yield left
        return
    while len(left):
        heads = left[:256]
        near = small[heads] @ small[left].T >= cosine
        free = np.ones(len(left), bool)
        for k in range(len(heads)):
            if free[k]:
                near[k, k] = True
                own = np.flatnonzero(near[k] & free)
                free[own] = False
                yield left[own]
        left = left[free]


class CoverTree:
    """levels[l]: arrays start, end, radius, child_start, child_end and centres of the nodes; vectors lie in node order."""

    def __init__(self, ids: np.ndarray, mass: np.ndarray, vectors: np.ndarray):
        order, small = np.arange(len(ids)), vectors.astype(np.float32)
        spans = [[(0, len(ids))]]
        for radius in RADII:
            below = []
            for start, end in spans[-1]:
                at = start
                for own in _net(order[start:end].copy(), small, 1 - radius * radius / 2):
                    order[at : at + len(own)] = own
                    below.append((at, at + len(own)))
                    at += len(own)
            spans.append(below)
        self.ids, self.mass, self.vectors = ids[order], mass[order], vectors[order]
        self.total = np.concatenate([[0], np.cumsum(self.mass)])
        self.levels = []
        for depth, nodes in enumerate(spans):
            start, end = np.array([a for a, _ in nodes]), np.array([b for _, b in nodes])
            radius = np.array([np.linalg.norm(self.vectors[a:b] - self.vectors[a], axis=1).max() if b > a + 1 else 0.0 for a, b in nodes])
            below = np.array([a for a, _ in spans[depth + 1]]) if depth + 1 < len(spans) else np.zeros(0, int)
            self.levels.append({"start": start, "end": end, "radius": radius, "first": np.searchsorted(below, start), "last": np.searchsorted(below, end)})


class _Groups:
    """Labels of 0..n-1 under merges; a merge relabels, so that a merged pair is known by two equal labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def merge(self, members: np.ndarray) -> None:
        found = np.unique(self.label[members])
        if len(found) > 1:
            self.label[np.isin(self.label, found[1:])] = found[0]


def _near_nodes(a: CoverTree, b: CoverTree, la: dict, lb: dict, ia: np.ndarray, ib: np.ndarray, r: float):
    """Node pairs that the bound dist <= r + both radii cannot prune.

    The bound is a lower bound on the cosine of the centres.  Single precision with a margin makes the first cut, for nodes
    of like radius together, so that each matrix of cosines meets one number; one buffer serves all.
    """
    buffer = np.empty(512 * 1024, np.float32)
    kinds = lambda level, at: [at[c] for c in (np.digitize(level["radius"][at], (1e-12, 0.15, 0.3, 0.6))[None, :] == np.arange(5)[:, None])]
    for xs in kinds(la, ia):
        for ys in kinds(lb, ib):
            if not len(xs) or not len(ys):
                continue
            reach = r + la["radius"][xs].max() + lb["radius"][ys].max()
            least = np.float32(1 - min(reach, 2.0) ** 2 / 2 - 1e-5)
            left, right = (t.vectors[level["start"][at]].astype(np.float32) for t, level, at in ((a, la, xs), (b, lb, ys)))
            for i in range(0, len(xs), 512):
                for j in range(0, len(ys), 1024):
                    x, y = left[i : i + 512], right[j : j + 1024]
                    cos = np.matmul(x, y.T, out=buffer[: len(x) * len(y)].reshape(len(x), len(y)))
                    if cos.max() < least:
                        continue
                    for k, m in zip(*np.nonzero(cos >= least), strict=True):
                        p, q = xs[i + k], ys[j + m]
                        if np.sqrt(max(0.0, 2 - 2 * float(cos[k, m]))) - la["radius"][p] - lb["radius"][q] <= r + 1e-4:
                            yield p, q


def dual_links(a: CoverTree, b: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masses linked to each vector of a and of b, and labels of linked groups over a's then b's vectors."""
    r, same, n = np.sqrt(2 - 2 * cosine), a is b, len(a.ids)
    rise_a, rise_b = np.zeros(n + 1), np.zeros(len(b.ids) + 1)
    groups = _Groups(n if same else n + len(b.ids))
    shift = 0 if same else n

    def whole(sa: int, ea: int, sb: int, eb: int) -> None:
        rise_a[[sa, ea]] += np.array([1, -1]) * (b.total[eb] - b.total[sb])
        rise_b[[sb, eb]] += np.array([1, -1]) * (a.total[ea] - a.total[sa])
        groups.merge(np.concatenate([np.arange(sa, ea), np.arange(sb, eb) + shift]))

    def compare(sa: int, ea: int, sb: int, eb: int) -> None:
        for s in range(sa, ea, 512):
            e = min(ea, s + 512)
            hit = a.vectors[s:e] @ b.vectors[sb:eb].T >= cosine
            if not hit.any():
                continue
            add_a, add_b = hit @ b.mass[sb:eb], a.mass[s:e] @ hit
            rise_a[s:e] += add_a
            rise_a[s + 1 : e + 1] -= add_a
            rise_b[sb:eb] += add_b
            rise_b[sb + 1 : eb + 1] -= add_b
            for i in np.flatnonzero(hit.any(1)):
                js = np.flatnonzero(hit[i]) + sb + shift
                if (groups.label[js] != groups.label[s + i]).any():
                    groups.merge(np.concatenate([[s + i], js]))

    open_ = [(0, 0, 0)]
    while open_:
        depth, i, j = open_.pop()
        la, lb = a.levels[depth + 1], b.levels[depth + 1]
        ia, ib = np.arange(a.levels[depth]["first"][i], a.levels[depth]["last"][i]), np.arange(b.levels[depth]["first"][j], b.levels[depth]["last"][j])
        for p, q in _near_nodes(a, b, la, lb, ia, ib, r):
            sa, ea, sb, eb = la["start"][p], la["end"][p], lb["start"][q], lb["end"][q]
            gap, reach = np.linalg.norm(a.vectors[sa] - b.vectors[sb]), la["radius"][p] + lb["radius"][q]
            if gap + reach <= r - SLACK:
                whole(sa, ea, sb, eb)
            elif (ea - sa) * (eb - sb) <= SMALL or depth + 2 == len(a.levels):
                compare(sa, ea, sb, eb)
            else:
                open_.append((depth + 1, p, q))
    return np.cumsum(rise_a)[:-1], np.cumsum(rise_b)[:-1], groups.label


def farthest_first(vectors: np.ndarray, most: int) -> np.ndarray:
    chosen, gap = [0], np.linalg.norm(vectors - vectors[0], axis=1)
    while len(chosen) < min(most, len(vectors)) and gap.max() > RADII[-1]:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(vectors - vectors[chosen[-1]], axis=1))
    return vectors[chosen]


def _to_pivots(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at, far = [], []
            for v in batch.column(1).to_pylist():
                x = np.frombuffer(v)
                d = np.linalg.norm(pivots[len(x)] - x, axis=1) if len(x) in pivots else np.zeros(1)
                at.append(int(d.argmin()))
                far.append(float(d.min()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(v) // 8 for v in batch.column(1).to_pylist()], pa.int32()), pa.array(at, pa.int32()), pa.array(far, pa.float64())], ["_rep", "_v", "_mass", "_dim", "_pivot", "_far"])

    return run


def _plant(table: pa.Table) -> pa.Table:
    """One block's rows to one row that holds its tree."""
    ids, mass = table["_rep"].to_numpy(), table["_mass"].to_numpy()
    order = np.argsort(ids)
    vectors = np.stack([np.frombuffer(x) for x in table["_v"].to_pylist()])[order]
    tree = CoverTree(ids[order], mass[order].astype(float), vectors)
    return pa.table({"_dim": table["_dim"][:1], "_pivot": table["_pivot"][:1], "_block": pa.array([int(ids.min())], pa.int64()), "_tree": pa.array([pickle.dumps(tree, 5)], pa.binary())})


def _traverse(cosine: float, near: set[tuple[int, int, int]]):
    """Rows (tile, first group, own group, dim, pivot, block, tree), sorted by tile: the links of the pairs of its two groups."""

    def links(a: CoverTree, b: CoverTree) -> pa.RecordBatch:
        n_a, n_b, label = dual_links(a, b, cosine)
        ids = a.ids if a is b else np.concatenate([a.ids, b.ids])
        n = np.rint(n_a - a.mass if a is b else np.concatenate([n_a, n_b])).astype(np.int64)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        root = least[label]
        keep = (n > 0) | (root != ids)
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(root[keep]), pa.array(n[keep])], ["_rep", "_root", "_n"])

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        first, other = [r for r in rows if r[0] == r[1]], [r for r in rows if r[0] != r[1]]
        pairs = [(x, y) for x in first for y in other] if other else [(x, y) for k, x in enumerate(first) for y in first[k:]]
        for (_, _, dim, p, _, a), (_, _, dim_b, q, _, b) in pairs:
            if dim == dim_b and (dim, p, q) in near:
                yield links(a, b)

    def run(batches):
        tile, rows = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                t, *row, tree = (c[k].as_py() for c in batch.columns)
                if t != tile:
                    yield from solve(rows)
                    tile, rows = t, []
                rows.append((*row, pickle.loads(tree)))
        yield from solve(rows)

    return run


def near_dups(table: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = table.sparkSession
    raw = table.select(table[id_col].cast("long").alias("_id"), table[vector_col].cast("array<double>").alias("_e"))
    rows = shared_table(raw.mapInArrow(_unit, "_id long, _v binary"))
    classes = rows.where("_v is not null and _id is not null").groupBy("_v").agg(F.min("_id").alias("_least"), F.count("*").alias("_mass"))
    classes = shared_table(classes.withColumn("_rep", F.monotonically_increasing_id()))  # a class's number is fixed by being written
    sample: dict[int, list[np.ndarray]] = {}
    for r in classes.orderBy(F.xxhash64("_v"), "_v").limit(SAMPLE).select("_v").collect():
        sample.setdefault(len(r["_v"]) // 8, []).append(np.frombuffer(bytes(r["_v"])))
    pivots = {d: farthest_first(np.stack(v), PIVOTS) for d, v in sample.items()}
    placed = shared_table(classes.select("_rep", "_v", "_mass").mapInArrow(_to_pivots(pivots), "_rep long, _v binary, _mass long, _dim int, _pivot int, _far double"))
    size = placed.groupBy("_dim", "_pivot").agg(F.count("*").alias("_n"), F.max("_far").alias("_radius"))
    r, near = float(np.sqrt(2 - 2 * cosine)), set()
    upper: dict[int, list] = {}
    for x in size.collect():  # at most PIVOTS rows a vector length
        upper.setdefault(x["_dim"], []).append(x)
    for d, nodes in upper.items():
        for x in nodes:
            for y in nodes:
                gap = np.linalg.norm(pivots[d][x["_pivot"]] - pivots[d][y["_pivot"]]) if d in pivots else 0.0
                if d not in pivots or gap - x["_radius"] - y["_radius"] <= r + SLACK:
                    near.add((d, x["_pivot"], y["_pivot"]))
    if not near:
        found = spark.createDataFrame([], "_rep long, _root long, _n long")
    else:
        parts = F.pmod(F.xxhash64("_rep", F.lit(3)), F.ceil(F.col("_n") / BLOCK)).cast("int")
        blocks = placed.join(F.broadcast(size.select("_dim", "_pivot", "_n")), ["_dim", "_pivot"]).withColumn("_part", parts)
        trees = shared_table(blocks.groupBy("_dim", "_pivot", "_part").applyInArrow(_plant, "_dim int, _pivot int, _block long, _tree binary"))
        n, widest = trees.count(), max(upper)
        most = max(1, min(GROUP, GROUP_BYTES // (8 * widest * BLOCK)))
        each = min(most, max(4, math.ceil(n / (2 * math.sqrt(2 * partitions(table))))))
        groups = math.ceil(n / each)
        own = F.pmod(F.xxhash64("_block"), F.lit(groups)).cast("int")
        tiles = trees.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        first = F.least("_own", "_other")
        tiles = tiles.select((first * groups + F.greatest("_own", "_other")).cast("long").alias("_tile"), first.alias("_first"), "_own", "_dim", "_pivot", "_block", "_tree")
        dealt = tiles.repartition(min(4 * partitions(table), groups * (groups + 1) // 2), "_tile").sortWithinPartitions("_tile", "_block")
        found = shared_table(dealt.mapInArrow(_traverse(cosine, near), "_rep long, _root long, _n long"))
    links = found.groupBy("_rep").agg(F.sum("_n").alias("_n"))
    roots = connected_components(found.select(F.col("_root").alias("a"), F.col("_rep").alias("b"))).select(F.col("node").alias("_rep"), "component")
    of = classes.select("_rep", "_v", "_least", "_mass").join(links, "_rep", "left").join(roots, "_rep", "left").withColumn("_c", F.coalesce("component", "_rep"))
    of = shared_table(of.select("_v", "_least", "_c", (F.coalesce("_n", F.lit(0)) + F.col("_mass") - 1).alias("_n")))
    names = shared_table(of.groupBy("_c").agg(F.min("_least").alias("_name")))
    named = shared_table(of.join(names, "_c").select("_v", "_n", "_name"))  # stored, so that a hot vector's rows are split
    joined = rows.where("_v is not null and _id is not null").join(named.hint("shuffle_hash"), "_v").select("_id", "_n", "_name")
    alone = rows.where("_v is null or _id is null").select("_id", F.lit(0).cast("long").alias("_n"), F.col("_id").alias("_name"))
    out = joined.union(alone)
    return out.select(F.col("_id").alias("vec_id"), F.col("_n").alias("n_links"), F.col("_name").alias("component_id"), F.coalesce(F.col("_id") == F.col("_name"), F.lit(True)).alias("kept"))


def query(embeddings: DataFrame) -> DataFrame:
    return near_dups(embeddings)


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = v.vec_id
"""
