"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

Sets of word shingles are binned by size; a window of two neighbouring bins holds every pair that can reach the threshold,
and within it two such sets differ in at most k features.  The feature domain is dealt into partitions by hash and subsets
of them are enumerated: n1 first-level partitions of n2 parts each, one signature for each choice of all but k2 parts.  Two
sets that differ in at most k features have at least ``spare`` signatures in common, so a set may leave out its first
``spare`` - 1 signatures in the order (features covered, signature): the last common one is never among them, for either
set.  That keeps near-empty signatures, which unrelated sets share, out of the buckets.

A bucket only ever ties its members to its smallest one, so the rows made are the signatures, never the pairs; a task keeps
one row of a bucket for the shuffle and ties its other members itself, so that a bucket is no larger than the tasks that met
it.  Components of these ties hold every link.  A small component is one cell of the exact check, which counts common
shingles through an inverted index.  In a large one the ties themselves are checked first (a member against the smallest it
is tied to, in cells of a bounded size), and what hangs together by links is one piece.  Unlike texts tie as well, ever more of
them as texts grow in number, until most hang together in one component; so what is left is compared bucket by bucket, never
across a component.  A star is a smallest member and all that met it in any bucket, also through the smallest that a task
kept; two sets with a link are in a star together.  In each star only the members outside its largest piece are compared with
all its others, by pairs of blocks, each a task: first by counts of their shingles in 256 parts, the smaller of which add up to
no less than what two sets have in common, then, where that is enough for a link, by their texts.

Defined results: null and empty texts, and texts of blanks, have the empty set and link with nothing; with fewer words than
a shingle the sequence is the one shingle; equal sets are one class, represented by its smallest id; rows that repeat an id
with different texts are one node; rows with a null id are returned with a null component; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, forget, map_texts, partitions, shared_table

#: Documents and shingles of one cell of a small component, documents and shingles of a block of a large one.
CELL_DOCS, CELL_SHINGLES, BLOCK_DOCS, BLOCK_SHINGLES = 256, 1_000_000, 1024, 2_000_000
#: Hashes of words that a task keeps; signatures that it holds before it sorts them; sets whose copies it knows.
MEMO, HELD, KNOWN = 300_000, 1 << 19, 250_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, n: int, words: _WordHash) -> np.ndarray:
    """The distinct n-word shingles of a text as sorted 64-bit hashes."""
    found = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII blanks only
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def signatures(u: np.ndarray, threshold: float) -> list[np.ndarray]:
    """The signatures of one set, an array for each of its two windows of sizes."""
    ratio = 1.0005 / threshold
    bin_ = math.floor(math.log(len(u)) / math.log(ratio))
    k2, n2 = 1, 3
    out = []
    for window in (bin_ - 1, bin_):  # pairs within its lower bin, and pairs of its two bins
        most = math.floor(ratio ** (window + 1)) + math.floor(ratio ** (window + 2)) + 2
        k = math.floor(most * (1 - threshold) / (1 + threshold) + 1e-9)
        if k == 0:
            continue  # sets of these sizes must be equal
        broken = k // (k2 + 1)  # first-level partitions that can differ in more than k2 features
        spare = max(2, round(0.3 * (broken + 1)))
        n1 = broken + spare
        seed, salt = (np.uint64((window + 1_000) * m & 0xFFFFFFFFFFFFFFFF) for m in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))
        part = (_mix(u ^ seed) % np.uint64(n1 * n2)).astype(np.int64)
        n = np.bincount(part, minlength=n1 * n2).reshape(n1, n2)
        total = np.zeros(n1 * n2, np.uint64)
        np.add.at(total, part, _mix(u + seed))
        total = total.reshape(n1, n2)
        n, total = n.sum(1, keepdims=True) - n, total.sum(1, keepdims=True, dtype=np.uint64) - total  # leave each part out in turn
        n = n.ravel()
        found = _mix(total.ravel() + _mix(np.arange(len(n), dtype=np.uint64) + salt))
        out.append(found[np.lexsort((found, n))[spare - 1 :]])
    return out


def _set_hash(u: np.ndarray) -> bytes:
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest()


def _describe(n: int):
    def run(batches):
        words = _WordHash()
        for batch in batches:
            sets = [shingle_set(t, n, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_hash(s) if len(s) else None for s in sets], pa.binary())], ["_id", "_n", "_set"])

    return run


def _heads(found: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    """Of a task's signatures: one row for each bucket, with its smallest id, and one for each tie of another member to it.

    A tie's row travels under a number of its own.
    """
    sig, of = (np.concatenate([np.empty(0, t), *x]) for t, x in ((np.uint64, found), (np.int64, ids)))
    order = np.lexsort((of, sig))
    sig, of = sig[order], of[order]
    head = np.ones(len(sig), bool)
    head[1:] = sig[1:] != sig[:-1]
    least = of[head][np.cumsum(head) - 1] if len(sig) else of
    ties = np.unique(np.stack([least, of], 1)[~head & (least != of)], axis=0)
    number = _mix(ties[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ _mix(ties[:, 1].astype(np.uint64)))
    other = np.concatenate([np.zeros(int(head.sum()), np.int64), ties[:, 0]])
    none = np.concatenate([np.ones(int(head.sum()), bool), np.zeros(len(ties), bool)])
    columns = [np.concatenate([sig[head], number]).view(np.int64), np.concatenate([of[head], ties[:, 1]])]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(other, mask=none)], ["_sig", "_id", "_other"])


def _sign(n: int, threshold: float):
    """(signature, id, other) of a task's different sets: copies that meet in a task leave one set of rows."""

    def run(batches):
        words, seen, ids, found, held = _WordHash(), set(), [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, n, words)
                if len(s) == 0 or (h := _set_hash(s)) in seen:
                    continue
                if len(seen) < KNOWN:  # bounds the table only: a copy signed twice changes nothing
                    seen.add(h)
                for a in signatures(s, threshold):
                    found.append(a)
                    ids.append(np.full(len(a), i, np.int64))
                    held += len(a)
                if held > HELD:
                    yield _heads(found, ids)
                    ids, found, held = [], [], 0
        yield _heads(found, ids)

    return run


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, hundredths: int) -> Iterator[tuple[int, int]]:
    """Index pairs (of left, of right) whose sets reach the threshold, by counts over an inverted index of the left sets."""
    size = np.array([len(s) for s in sets], np.int64)
    if len(left) == 0 or len(right) == 0:
        return
    features, inverse = np.unique(np.concatenate([sets[i] for i in left]), return_inverse=True)
    owner = np.repeat(np.arange(len(left)), size[left])
    order = np.argsort(inverse, kind="stable")
    owner = owner[order]
    ends = np.cumsum(np.bincount(inverse, minlength=len(features)))
    starts = np.concatenate([[0], ends[:-1]])
    for j in right:
        at = np.searchsorted(features, sets[j])
        at = at[: np.searchsorted(at, len(features))]  # sorted, as the set is
        at = at[features[at] == sets[j][: len(at)]]
        lengths = ends[at] - starts[at]
        if not len(lengths):
            continue
        offsets = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        common = np.bincount(owner[offsets], minlength=len(left))
        for i in left[np.flatnonzero(100 * common >= hundredths * (size[left] + size[j] - common))]:
            if i != j:
                yield int(i), int(j)


def _check_cells(n: int, hundredths: int):
    """Rows (cell, side, id, text) sorted by cell: a forest of each cell's links, as (a, b) with a the smallest of its tree.

    Side -1: all are compared with all; else those of side 0 with those of side 1.
    """

    def solve(rows: list[tuple[int, int, bytes]], words: _WordHash) -> list[tuple[int, int]]:
        sets = [shingle_set(t, n, words) for _, _, t in rows]
        side = np.array([s for s, _, _ in rows])
        left = np.flatnonzero(side <= 0)
        right = np.flatnonzero(side == 1) if (side >= 0).any() else left
        up = {i: i for _, i, _ in rows}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in _links(sets, left, right, hundredths):
            a, b = sorted((top(rows[a][1]), top(rows[b][1])))
            up[b] = a
        return [(top(x), x) for x in up if top(x) != x]

    def run(batches):
        words, cell, rows = _WordHash(), None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for c, side, i, text in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if c != cell:
                    out += solve(rows, words) if len(rows) > 1 else []
                    cell, rows = c, []
                rows.append((side, i, text))
            yield _pairs(out)
        yield _pairs(solve(rows, words) if len(rows) > 1 else [])

    return run


def _sketch(n: int):
    """(id, counts of the set's shingles in 256 parts); null where a part has too many for two bytes."""

    def run(batches):
        words = _WordHash()
        for batch in batches:
            counts = [np.bincount((shingle_set(t, n, words) & np.uint64(255)).astype(np.int64), minlength=256) for t in batch.column(1).to_pylist()]
            out = [c.astype(np.uint16).tobytes() if c.max() < 1 << 16 else None for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["_id", "_counts"])

    return run


def _may_link(hundredths: int):
    """Rows (cell, side, hub, id, n, piece, counts) sorted by cell: (hub, id) of those whose counts leave room for a link to
    one of another piece."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        side, n, piece = (np.array([r[k] for r in rows], np.int64) for k in (0, 3, 4))
        free = np.array([r[5] is None for r in rows])
        counts = np.stack([np.frombuffer(r[5] or bytes(512), np.uint16) for r in rows])
        left = np.flatnonzero(side <= 0)
        right = np.flatnonzero(side == 1) if (side >= 0).any() else left
        near = np.zeros(len(rows), bool)
        for j in right:
            common = np.minimum(counts[left], counts[j]).sum(1, dtype=np.int64)
            ok = (piece[left] != piece[j]) & (free[left] | free[j] | (100 * common >= hundredths * (n[left] + n[j] - common)))
            near[left[ok]] = True
            near[j] |= ok.any()
        return [rows[k][1:3] for k in np.flatnonzero(near)]

    def run(batches):
        cell, rows = None, []
        pairs = lambda out: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["_hub", "node"])
        for batch in batches:
            out: list[tuple[int, int]] = []
            for c, *row in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if c != cell:
                    out += solve(rows) if len(rows) > 1 else []
                    cell, rows = c, []
                rows.append(tuple(row))
            yield pairs(out)
        yield pairs(solve(rows) if len(rows) > 1 else [])

    return run


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], ["a", "b"])


def _deal(n_docs, n_shingles, docs: int, shingles: int):
    """How many blocks so many documents and shingles make."""
    return F.greatest(F.ceil(n_docs / docs), F.ceil(n_shingles / shingles)).cast("int")


def components(docs: DataFrame, words: int = 5, hundredths: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; two texts link when 100 * |common| >= hundredths * |union|."""
    texts = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("binary").alias("_text"))
    info = shared_table(map_texts(texts, _describe(words), "_id long, _n long, _set binary"))
    named = info.where("_set is not null and _id is not null")
    classes = shared_table(named.groupBy("_set").agg(F.min("_id").alias("_rep"), F.first("_n").alias("_n")))
    of = shared_table(named.select("_id", "_set").join(classes, "_set").select("_id", "_rep").distinct())

    signed = map_texts(texts.where("_id is not null"), _sign(words, hundredths / 100), "_sig long, _id long, _other long").repartition(partitions(docs), "_sig")
    least = F.min(F.when(F.col("_other").isNull(), F.col("_id"))).over(Window.partitionBy("_sig"))  # one shuffle; a full bucket spills
    ties = signed.select("_id", F.coalesce("_other", least).alias("_least"), F.col("_other").isNotNull().alias("_within"))
    met = shared_table(ties.where("_id <> _least").select("_least", "_id", "_within").distinct())
    ties = met.select("_least", "_id").join(of, "_id").select("_least", F.col("_rep").alias("b")).join(of.withColumnRenamed("_id", "_least"), "_least").select(F.col("_rep").alias("a"), "b")
    ties = shared_table(ties.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    near = shared_table(connected_components(ties))
    tied = shared_table(texts.join(near.select(F.col("node").alias("_id")).hint("shuffle_hash"), "_id"))  # all texts move once, here

    def links(cells: DataFrame) -> DataFrame:
        """Of (_id, _cell, _side): the texts dealt to their cells, and the forests of links found there."""
        moved = tied.join(cells.hint("shuffle_hash"), "_id").select("_cell", "_side", "_id", "_text")
        dealt = moved.repartition(partitions(docs), "_cell").sortWithinPartitions("_cell")
        return shared_table(dealt.mapInArrow(_check_cells(words, hundredths), "a long, b long"))

    sized = near.join(classes.select(F.col("_rep").alias("node"), "_n"), "node")
    n_docs, n_shingles = F.count("*"), F.sum("_n")
    sizes = shared_table(sized.groupBy("component").agg(_deal(n_docs, n_shingles, CELL_DOCS, CELL_SHINGLES).alias("_cells")))
    placed = shared_table(near.join(sizes, "component").join(classes.select(F.col("_rep").alias("node"), "_n"), "node"))
    found = links(placed.where("_cells = 1").select(F.col("node").alias("_id"), F.xxhash64("component").alias("_cell"), F.lit(-1).alias("_side")))
    large = placed.where("_cells > 1")
    if large.limit(1).count():
        sketches = shared_table(map_texts(tied, _sketch(words), "_id long, _counts binary"))
        found = found.union(_large_components(ties, _stars(met, of), sketches, shared_table(large.select("node", "component", "_n")), links, hundredths))

    twice = of.groupBy("_id").agg(F.min("_rep").alias("a"), F.max("_rep").alias("_most")).where("a < _most")
    again = shared_table(twice.join(of, "_id").where("a <> _rep").select("a", F.col("_rep").alias("b")))
    group = shared_table(connected_components(found.union(again)))
    for t in (tied, met, ties, near, sizes, placed, of, again):  # nothing below reads them; tied has texts
        forget(t)
    class_of = classes.select("_set", "_rep").join(group, F.col("_rep") == F.col("node"), "left").select("_set", F.coalesce("component", "_rep").alias("_component"))
    linked = named.select("_id", "_n", "_set").join(shared_table(class_of), "_set").select("_id", "_n", "_component")
    alone = info.where("_set is null or _id is null").select("_id", "_n", F.col("_id").alias("_component"))
    return linked.union(alone).select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"))


def _stars(met: DataFrame, of: DataFrame) -> DataFrame:
    """(_hub, node): of each bucket, all members under the smallest one, which is a member too.

    A task ties members of a bucket to the smallest that it met itself, which is tied to the smallest of all: two steps.
    """
    within = met.where("_within").select(F.col("_least").alias("_by"), "_id")
    beyond = met.where("NOT _within").select(F.col("_id").alias("_by"), "_least")
    pairs = met.select("_least", "_id").union(within.join(beyond, "_by").select("_least", "_id")).distinct()
    pairs = pairs.join(of, "_id").select("_least", F.col("_rep").alias("node")).join(of.withColumnRenamed("_id", "_least"), "_least").select(F.col("_rep").alias("_hub"), "node")
    return pairs.union(pairs.select("_hub", F.col("_hub").alias("node"))).distinct()


def _large_components(ties: DataFrame, stars: DataFrame, sketches: DataFrame, large: DataFrame, links, hundredths: int) -> DataFrame:
    """The forests of links inside components that are too large for one cell."""
    # members against the smallest that they are tied to: a cell holds that one and a bounded number of its members
    star = ties.join(large.select(F.col("node").alias("b"), "_n"), "b").groupBy("b").agg(F.min("a").alias("a"), F.first("_n").alias("_n"))
    star = shared_table(star)
    hubs = shared_table(star.groupBy("a").agg(_deal(F.count("*"), F.sum("_n"), CELL_DOCS, CELL_SHINGLES).alias("_cells")))
    members = star.join(hubs, "a").select(F.col("b").alias("_id"), F.xxhash64("a", F.pmod(F.xxhash64("b", F.lit(5)), F.col("_cells")).cast("int")).alias("_cell"), F.lit(1).alias("_side"))
    centres = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)).alias("_k")).select(F.col("a").alias("_id"), F.xxhash64("a", "_k").alias("_cell"), F.lit(0).alias("_side"))
    found = links(members.union(centres))
    # what hangs together by now; the largest piece of a star is its body
    pieces = connected_components(found).select("node", F.col("component").alias("_piece"))
    pieced = shared_table(large.join(pieces, "node", "left").withColumn("_piece", F.coalesce("_piece", "node")))
    parts = pieced.groupBy("component", "_piece").agg(F.count("*").alias("_docs")).groupBy("component")
    few = parts.agg((F.sum("_docs") - F.max("_docs") <= BLOCK_DOCS).alias("_few"))  # outside the largest piece: one block, so the component is one star
    pieced = shared_table(pieced.join(few, "component"))
    inside = stars.join(pieced.where("NOT _few"), "node").select("_hub", "node", "_n", "_piece")
    inside = inside.union(pieced.where("_few").select(F.col("component").alias("_hub"), "node", "_n", "_piece")).join(star.select(F.col("b").alias("node"), F.col("a").alias("_checked")), "node", "left")
    inside = shared_table(inside.select("_hub", "node", "_n", "_piece", (F.col("_checked") == F.col("_hub")).alias("_checked")))
    whole = inside.groupBy("_hub").agg(F.count("*").alias("_docs"), F.max("_checked").alias("_checked"), F.min("_piece").alias("_low"), F.max("_piece").alias("_high"))
    unlike = whole.where("_low < _high AND (_docs > 2 OR NOT coalesce(_checked, false))").select("_hub")  # the others are settled
    inside = shared_table(inside.join(unlike, "_hub").drop("_checked").join(sketches.select(F.col("_id").alias("node"), "_counts"), "node"))
    cells = _dealt(inside.drop("_counts")).join(inside.select("_hub", F.col("node").alias("_id"), "_n", "_piece", "_counts"), ["_hub", "_id"])
    cells = cells.select("_cell", "_side", "_hub", "_id", "_n", "_piece", "_counts").repartition(partitions(ties), "_cell").sortWithinPartitions("_cell")
    near = shared_table(cells.mapInArrow(_may_link(hundredths), "_hub long, node long").distinct())
    found = found.union(links(_dealt(inside.drop("_counts").join(near, ["_hub", "node"]))))
    for t in (inside, near, sketches):
        forget(t)
    return found


def _dealt(inside: DataFrame) -> DataFrame:
    """(_hub, _id, _cell, _side): cells that compare the members of each star outside its largest piece with all others."""
    inside = shared_table(inside)
    counts = inside.groupBy("_hub", "_piece").agg(F.count("*").alias("_docs"))
    body = shared_table(counts.groupBy("_hub").agg(F.max_by("_piece", F.struct("_docs", -F.col("_piece"))).alias("_body")))
    sided = shared_table(inside.join(body, "_hub").withColumn("_rest", F.col("_piece") != F.col("_body")))
    deals = sided.groupBy("_hub", "_rest").agg(_deal(F.count("*"), F.sum("_n"), BLOCK_DOCS, BLOCK_SHINGLES).alias("_blocks"))
    deals = shared_table(deals.groupBy("_hub").agg(*[F.coalesce(F.max(F.when(F.col("_rest") == x, F.col("_blocks"))), F.lit(0)).alias(c) for c, x in (("_body_blocks", False), ("_rest_blocks", True))]))
    dealt = sided.join(deals, "_hub").where("_rest_blocks > 0")
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(11)), F.col(n)).cast("int")
    cell = lambda kind, i, j: F.xxhash64("_hub", F.lit(kind), i, j).alias("_cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("_k")
    rest, main = dealt.where("_rest").withColumn("_b", own("_rest_blocks")), dealt.where("NOT _rest").withColumn("_b", own("_body_blocks"))
    across = rest.where("_body_blocks > 0").select("node", "_hub", "_b", every("_body_blocks")).select("_hub", F.col("node").alias("_id"), cell("across", F.col("_b"), F.col("_k")), F.lit(0).alias("_side"))
    met = main.select("node", "_hub", "_b", every("_rest_blocks")).select("_hub", F.col("node").alias("_id"), cell("across", F.col("_k"), F.col("_b")), F.lit(1).alias("_side"))
    inside = rest.select("node", "_hub", "_b", every("_rest_blocks")).select(
        "_hub", F.col("node").alias("_id"), cell("inside", F.least("_b", "_k"), F.greatest("_b", "_k")), F.when(F.col("_b") == F.col("_k"), -1).when(F.col("_b") < F.col("_k"), 0).otherwise(1).alias("_side")
    )
    return across.union(met).union(inside)


def query(docs: DataFrame) -> DataFrame:
    return components(docs, words=3, hundredths=90)


def one_of_each(docs: DataFrame, words: int = 5, hundredths: int = 80, id_col: str = "doc_id") -> DataFrame:
    """docs with the same columns: of each component the rows of its smallest id, and the rows without an id."""
    found = components(docs, words, hundredths, id_col)
    stays = found.where("doc_id = component_id").select(F.col("doc_id").alias("_stays")).distinct()
    lost = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_lost")).join(stays, F.col("_lost") == F.col("_stays"), "left_anti").distinct()
    return docs.join(shared_table(lost).hint("shuffle_hash"), docs[id_col].cast("long") == F.col("_lost"), "left_anti")


#: All pairs of documents with a common shingle, those that reach the threshold, and what they reach.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id FROM n JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = n.doc_id
"""
