"""Embedding near-duplicates by sorted projection passes.

Each pass draws random hyperplanes; a vector's signs are its hash, and the concatenated hashes order the vectors
of a label lexicographically. A window is the run of vectors that agree in the first bits, so many
that a run holds about RUN vectors on average. All pairs in a run are verified by cosine in double
precision. A run of more than CHUNK vectors is cut into chunks, and each pair of chunks is compared
in a task of its own: windows have no cap, and no task holds a whole hot run.

Pairs are not emitted. A run that is not the first to hold a pair leaves it to the one that was, which the
prefixes of the earlier passes tell, so links can be counted for each vector by adding counts; what
leaves a run besides is a spanning forest of its links, which components then unite across passes.

The number of passes of a label grows with its prefix, so that a pair at the threshold is missed by all
passes with a probability below `miss`; small labels have few passes beside large ones.

Defined cases: a vector that is null, zero, or holds null or non-finite numbers, or whose label is null, links with
nothing; vectors of unlike length don't link; equal vectors of a label are one class with a count,
each linked with all others; rows that repeat a vec_id are vectors of their own, each with its own links and component; an
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import components
from .common import discard, in_parts, staged

RUN = 256
CHUNK = 1024
PASSES = 16


def passes_for(bits: int, least: float, miss: float) -> int:
    """So many passes that a pair with cosine least shares no run of bits hashes with a probability below miss; PASSES at least."""
    together = (1 - math.acos(least) / math.pi) ** bits
    return max(PASSES, math.ceil(math.log(miss) / math.log1p(-together)) if together < 1 else 1)


def forest(n: int, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, as pairs (node, root)."""
    at = np.arange(n)
    while len(rows):
        low = np.minimum(at[rows], at[cols])
        np.minimum.at(at, rows, low)
        np.minimum.at(at, cols, low)
        np.minimum.at(at, at[rows], low)
        np.minimum.at(at, at[cols], low)
        at = at[at]
        go = at[rows] != at[cols]
        rows, cols = rows[go], cols[go]
    while (at[at] != at).any():
        at = at[at]
    return [(i, int(r)) for i, r in enumerate(at) if i != r]


def matrix(column: pa.Array, dims: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a list column by their length: row numbers and a matrix of them."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        yield rows, flat[(ends[rows] - d)[:, None] + np.arange(d)].astype(float)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row as bytes: in single precision if that holds it exactly."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    exact = (single == x).all(axis=1)
    return [(a if e else b).tobytes() for a, b, e in zip(single, x, exact.tolist())]


def unpacked(data: list[bytes], dims: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dims else float).astype(float) for v in data])


def near_duplicates(vectors: DataFrame, *, least: float = 0.93, seed: int = 3, miss: float = 1e-4) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    good = "vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND size(e) > 0 AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(e, x -> x <> 0)"
    rows = staged(rows.withColumn("class", F.when(F.expr(good), F.md5(F.concat_ws("|", "label", F.array_join(F.col("e").cast("array<string>"), ","))))), "vectors")
    # classes have numbers of their own, since rows of unlike vectors may share a vec_id
    classes = staged(
        rows.where("class IS NOT NULL").groupBy("class", "label").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("e").alias("e")).select("*", F.monotonically_increasing_id().alias("id")), "vector-classes"
    )
    rows = rows.select("vec_id", "class")
    sizes = staged(classes.groupBy("label", F.size("e").alias("dims")).agg(F.count("*").alias("n")), "vector-labels")
    top = sizes.agg(F.max("n")).first()[0]
    if top is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    most_bits = max(0, math.ceil(math.log2(top / RUN)))
    passes_of = np.array([passes_for(k, least, miss) if k else 1 for k in range(most_bits + 1)])  # a label's own, by its bits; one that is one run has one pass
    passes = int(passes_of.max())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims, n = b.column("dims").to_numpy().astype(np.int64), b.column("n").to_numpy()
            bits = np.array([max(0, math.ceil(math.log2(m / RUN))) for m in n.tolist()], np.int64)
            several = passes_of[bits]
            keys, data = np.zeros((b.num_rows, passes), np.int64), [b""] * b.num_rows
            for at, x in matrix(b.column("e"), dims):
                d = x.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((passes * most_bits, d))
                for i, v in zip(at.tolist(), packed(x)):
                    data[i] = v
                for n_passes in np.unique(several[at]).tolist():
                    mine = np.flatnonzero(several[at] == n_passes)
                    side = (x[mine] @ planes[d][: n_passes * most_bits].T > 0).reshape(len(mine), n_passes, most_bits)
                    weight = np.where(np.arange(most_bits) < bits[at[mine]][:, None], 1 << np.arange(most_bits, dtype=np.int64), 0)
                    keys[at[mine], :n_passes] = (side * weight[:, None, :]).sum(axis=2)
            ends = np.append(0, np.cumsum(several)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[np.arange(passes) < several[:, None]]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("copies"), b.column("label"), b.column("dims"), pa.array(data, pa.binary()), lists], names=["id", "copies", "label", "dims", "data", "keys"])

    signed = staged(
        in_parts(classes).withColumn("dims", F.size("e")).join(sizes, ["label", "dims"]).select("id", "copies", "label", "dims", "e", "n").mapInArrow(sign, "id long, copies long, label string, dims int, data binary, keys array<long>"),
        "vector-hashes",
    )
    run = ["pass", "label", "dims", "key"]
    hot = staged(
        signed.select("label", "dims", F.posexplode("keys").alias("pass", "key")).groupBy(*run).agg(F.count("*").alias("m")).where(F.col("m") > CHUNK).select(*run, F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks")),
        "vector-hot-runs",
    )
    placed = (
        signed.select("*", F.posexplode("keys").alias("pass", "key"))
        .join(hot, run, "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("mine", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .withColumn("i", F.least("mine", "other"))
        .withColumn("j", F.greatest("mine", "other"))
        .select(*run, "i", "j", "mine", "id", "copies", "data", "keys")
    )

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        p, i, j = (key[k].as_py() for k in (0, 4, 5))
        t = t.sort_by("id")
        ids, copies, mine = (t.column(c).to_numpy() for c in ("id", "copies", "mine"))
        x = unpacked(t.column("data").to_pylist(), key[2].as_py())
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        prefix = np.array(t.column("keys").to_pylist(), np.int64).reshape(len(ids), -1)[:, :p]
        links = np.zeros(len(ids), np.int64)
        found_r, found_c = [], []
        for s in range(0, len(ids), 512):
            r, c = np.nonzero(x[s : s + 512] @ x[s:].T >= least)
            r, c = r + s, c + s
            ok = r < c
            if i != j:
                ok &= mine[r] != mine[c]
            r, c = r[ok], c[ok]
            for q in range(0, len(r), 1 << 18):
                a, b = r[q : q + (1 << 18)], c[q : q + (1 << 18)]
                first = ~(prefix[a] == prefix[b]).any(axis=1)
                a, b = a[first], b[first]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                for u, v in forest(len(ids), a, b):
                    found_r.append(u)
                    found_c.append(v)
        tree = forest(len(ids), np.array(found_r, np.int64), np.array(found_c, np.int64))
        some = np.flatnonzero(links)
        return pa.table({
            "id": pa.array(np.concatenate([ids[some], ids[[u for u, _ in tree]]]) if tree else ids[some], pa.int64()),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(tree), np.int64)]), pa.int64()),
            "other": pa.array([None] * len(some) + [int(ids[v]) for _, v in tree], pa.int64()),
        })

    found = staged(placed.groupBy(*run, "i", "j").applyInArrow(compare, "id long, links long, other long"), "vector-links")
    roots = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")), name="vectors")
    links = staged(found.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("links")), "vector-counts")
    of = classes.select("class", "id", "first_id", "copies").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    firsts = of.groupBy("root").agg(F.min("first_id").alias("component"))
    per_class = staged(of.join(firsts, "root").join(links, "id", "left").select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component"), "vector-results")
    for t in (classes, sizes, signed, hot, found, links):
        discard(t)
    return rows.join(per_class, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept")
    )
