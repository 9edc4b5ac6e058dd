"""N-gram Jaccard self-join with count-vector R-trees.

A document's shingles are hashed into GROUPS groups; the counts of its groups are a point. Two documents
share at most the sum of the smaller coordinates of their points, and two boxes of points at most
the same sum of their upper corners. An R-tree over the points is joined with itself from the
root down: pairs of boxes, then of points, whose bound can't reach the threshold are dropped.
What survives is verified on the shingle sets themselves.

Points of unrelated documents of one length lie too close together for boxes to tell them apart, so
one tree over the corpus would compare nearly all pairs. The forest is therefore keyed first: a tree
holds documents that share a band of min-hashes (BANDS bands of ROWS; a pair at the threshold shares none
with a probability of 5e-8, a nearer one less).

Trees aren't expanded into all pairs. Equal sets are one class. In each tree, members are first
verified against one leader, and what is linked is united; only trees that still hold several components are
joined, and only between components. A tree of more than CHUNK members is joined in blocks, each a task. A leader of many
members meets them in parts, so no join key has many rows.

Defined cases: null and empty texts, and texts without words, have an empty set, link with nothing
and are their own component; a null doc_id gets a null component and links nothing; rows that repeat
a doc_id are one node, linked where any of its texts is; equal texts link; an empty table gives no
rows; texts of any length are used whole; other columns are kept by representatives() and not read by
jaccard_components().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import components
from .common import discard, fresh, in_parts, small, staged, text_bytes
from .shingles import Bands, linked, overlap, shingle_set, text_words

WIDTH = 5
PERCENT = 80
BANDS, ROWS = 32, 4
GROUPS = 256
CHUNK = 256
#: So many pairs of one document meet its text or point in one place.
PART = 512
LEAF = 32


def count_vector(s: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((s >> np.uint64(40)).astype(np.int64) % groups, minlength=groups).astype(np.int32)


def packed(point: np.ndarray) -> bytes:
    """16 bits a count, or 32 if one needs them."""
    return point.astype("<u2" if point.max(initial=0) < 1 << 16 else "<u4").tobytes()


def unpacked(points: list[bytes], groups: int = GROUPS) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<u2" if len(x) == 2 * groups else "<u4").astype(np.int32) for x in points])


def least_overlap(n_a, n_b, percent: int = PERCENT):
    """The smallest intersection that links sets of these sizes: 100 i >= percent (a + b - i)."""
    return -(-percent * (n_a + n_b) // (100 + percent))


class CountTree:
    """An R-tree over count vectors, packed by size, then by coordinates, LEAF points to a box and LEAF boxes to a box above."""

    def __init__(self, points: np.ndarray):
        self.points = points
        size = points.sum(axis=1)
        heavy = points.argmax(axis=1)
        self.order = np.lexsort((heavy, size))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # upper corners, least and greatest sizes of boxes
        upper, low, high = points[self.order], size[self.order], size[self.order]
        while True:
            cuts = np.arange(0, len(upper), LEAF)
            upper, low, high = np.maximum.reduceat(upper, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((upper, low, high))
            if len(upper) <= LEAF:
                break

    @staticmethod
    def may_link(up_a: np.ndarray, low_a: np.ndarray, high_a: np.ndarray, up_b: np.ndarray, low_b: np.ndarray, high_b: np.ndarray, percent: int) -> np.ndarray:
        """Whether points in boxes a and b can reach the threshold, by the summed minima of upper corners and by size."""
        bound = np.minimum(np.minimum(up_a, up_b).sum(axis=1), np.minimum(high_a, high_b))
        return bound >= least_overlap(low_a, low_b, percent)

    def pairs(self, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of the pairs of points (each once) that survive all bounds, in parts."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        a, b = np.triu_indices(n)
        yield from self._descend(top, a, b, percent)

    def _descend(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        upper, low, high = self.levels[level]
        for s in range(0, len(a), 4096):
            x, y = a[s : s + 4096], b[s : s + 4096]
            go = self.may_link(upper[x], low[x], high[x], upper[y], low[y], high[y], percent)
            x, y = x[go], y[go]
            below = len(self.order) if level == 0 else len(self.levels[level - 1][0])
            for t in range(0, len(x), 16):
                u, v = x[t : t + 16], y[t : t + 16]
                grid = np.arange(LEAF)
                p = np.repeat(u[:, None] * LEAF + grid, LEAF, axis=1).ravel()
                q = np.tile(v[:, None] * LEAF + grid, (1, LEAF)).ravel()
                ok = (p < below) & (q < below) & ((p < q) if level == 0 else (p <= q))
                p, q = p[ok], q[ok]
                if level:
                    yield from self._descend(level - 1, p, q, percent)
                else:
                    p, q = self.order[p], self.order[q]
                    pts = self.points
                    n_p, n_q = pts[p].sum(axis=1), pts[q].sum(axis=1)
                    ok = np.minimum(pts[p], pts[q]).sum(axis=1) >= least_overlap(n_p, n_q, percent)
                    if ok.any():
                        yield p[ok], q[ok]


def signatures(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_shingles, class (digest of the set), point and band keys (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(BANDS, ROWS)
        for b in small(batches, "text"):
            texts = [x.lower() for x in text_bytes(b.column("text"))]
            n, digest, point, keys = ([None] * len(texts) for _ in range(4))
            for i, words in text_words(texts):
                s = shingle_set(words, WIDTH)
                n[i] = len(s)
                if len(s):
                    digest[i] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    point[i] = packed(count_vector(s))
                    keys[i] = bands.keys(s)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(point, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "class", "point", "keys"],
            )

    return in_parts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, class binary, point binary, keys array<long>")


def dealt_out(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (a, b) with the parts of a and b that each belongs to, part_a and part_b, and the ids that have several: side, id, parts."""
    counts = [pairs.groupBy(F.col(k).alias("id")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1").select(F.lit(k).alias("side"), "id", "parts") for k in "ab"]
    hot = staged(counts[0].unionByName(counts[1]), "join-hot")  # as a table of known size it is broadcast only if it is small
    for k, other in (("a", "b"), ("b", "a")):
        part = F.coalesce(F.pmod(F.xxhash64(other), F.col("parts")), F.lit(0)).cast("int")
        pairs = pairs.join(hot.where(F.col("side") == k).select(F.col("id").alias(k), "parts"), k, "left").withColumn(f"part_{k}", part).drop("parts")
    return pairs, hot


def beside(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """a, b and, as x and y, what rows (id and `column`) holds for either.

    An id with many pairs, as the leader of a large tree, isn't one key: a copy of its row goes to each of its parts.
    """
    pairs, hot = dealt_out(pairs)
    for k, name in (("b", "y"), ("a", "x")):
        many = hot.where(F.col("side") == k).select(F.col("id").alias(k), "parts")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        met = rows.select(F.col("id").alias(k), F.col(column).alias(name)).join(many, k, "left").withColumn(f"part_{k}", copies).drop("parts")
        pairs = pairs.join(met, [k, f"part_{k}"])
    return pairs.select("a", "b", "x", "y")


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) whose points allow a link, by the summed minima."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for s in range(0, t.num_rows, 1024):
                u = t.slice(s, 1024)
                p, q = (unpacked(u.column(c).to_pylist()) for c in ("x", "y"))
                ok = np.minimum(p, q).sum(axis=1) >= least_overlap(p.sum(axis=1), q.sum(axis=1))
                yield u.select(["a", "b"]).filter(pa.array(ok))

    return beside(pairs, points, "point").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets do link. texts (id, text) holds each text a pair may name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for t in batches:
            ok = []
            for s in range(0, t.num_rows, 64):
                u = t.slice(s, 64)
                left, right = text_bytes(u.column("x")), text_bytes(u.column("y"))
                a = u.column("a").to_pylist()
                fresh = {k: x for k, x in zip(a, left) if k not in kept}
                kept = {k: kept[k] for k in a if k in kept} | {k: shingle_set(w, WIDTH) for k, w in zip(fresh, (w for _, w in text_words([x.lower() for x in fresh.values()])))}
                for k, (_, w) in zip(a, text_words([x.lower() for x in right])):
                    y = shingle_set(w, WIDTH)
                    ok.append(linked(len(kept[k]), len(y), overlap(kept[k], y), PERCENT))
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return beside(pairs, texts, "text").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles and class of every row; and component_id of every class."""
    signed = staged(signatures(docs), "join-signatures")
    points = staged(signed.where("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_id", "n_shingles", "point", "keys")).alias("s")).select("class", F.col("s.doc_id").alias("id"), F.col("s.n_shingles").alias("n"), "s.point", "s.keys"), "join-classes")
    # trees with several members, and the leader of each
    banded = points.select("id", "n", F.explode("keys").alias("key"))
    trees = staged(banded.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("m")).where("m > 1"), "join-trees")
    members = staged(banded.join(trees, "key").select("key", "id", "leader", "m"), "join-members")
    involved = members.select("id").distinct()
    texts = staged(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(involved, "id", "left_semi"), "join-texts")
    few = staged(points.select("id", "point", "keys").join(involved, "id", "left_semi"), "join-points")
    to_leader = staged(members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "join-to-leader")
    tried = staged(bounded(to_leader, few.select("id", "point")), "join-leaders")
    links = staged(verified(tried, texts).distinct(), "join-links")
    discard(trees)
    discard(to_leader)
    roots = components(links, name="join")
    # what the leaders left apart: trees with several components
    placed = members.select("key", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    placed = staged(placed, "join-placed")
    open_trees = staged(placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low < high").select("key", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks")), "join-open")
    blocks = (
        placed.join(open_trees, "key")
        .join(few, "id")
        .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "root", "point", "keys")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trees follow each other, sorted; each is joined when its last row is read. A pair that several trees hold is left to the first of them."""
        pending: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, root, mine = (rows.column(c).to_numpy() for c in ("id", "root", "mine"))
            if root.min() == root.max():
                return
            apart = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
            keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            band = int((keys[0] == rows.column("key")[0].as_py()).argmax())
            tree = CountTree(unpacked(rows.column("point").to_pylist()))
            for p, q in tree.pairs():
                ok = (root[p] != root[q]) & ~(keys[p, :band] == keys[q, :band]).any(axis=1)
                if apart:
                    ok &= mine[p] != mine[q]
                p, q = ids[p[ok]], ids[q[ok]]
                if len(p):  # few: most pairs of a tree are united already or out of bounds
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            key = [b.column(c).to_numpy() for c in ("key", "i", "j")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            cuts = [0, *new.tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                part = b.slice(s, e - s)
                if pending and any(pending[0].column(c)[0] != part.column(c)[0] for c in ("key", "i", "j")):
                    yield from done(pa.Table.from_batches(pending))
                    pending = []
                pending.append(part)
        if pending:
            yield from done(pa.Table.from_batches(pending))

    crossed = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(join, "a long, b long")
    crossed = staged(crossed.join(tried, ["a", "b"], "left_anti"), "join-crossed")
    for t in (members, few, placed, open_trees, tried):
        discard(t)
    if not crossed.isEmpty():
        more = staged(verified(crossed, texts).distinct(), "join-more-links")
        if not more.isEmpty():
            roots = components(links.unionByName(more), name="join")
    named = staged(points.select("class", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("class", F.coalesce("root", "id").alias("component_id")), "join-named")
    for t in (points, texts, links, crossed, roots):
        discard(t)
    return signed.select("doc_id", "n_shingles", "class"), named


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    rows, named = jaccard_components(docs)
    return rows.join(named, "class", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, with all its columns: that of the smallest doc_id. Rows with a null doc_id stay; rows that repeat a doc_id stay or go together."""
    rows, named = jaccard_components(docs)
    name = fresh(docs, "__gone")
    gone = rows.join(named, "class").where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(staged(gone, "join-gone"), F.col("doc_id").cast("long") == F.col(name), "left_anti")
