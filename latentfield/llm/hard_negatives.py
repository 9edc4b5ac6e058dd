"""Hard negatives by a Voronoi-partitioned kNN join.

Vectors get one more component that brings them all to the same norm, and anchors a zero there, so that the order of
distances is the order of inner products. PIVOTS rows chosen by a hash, and the zero vector, part the space into
cells; each row goes to its nearest pivot and keeps its distance to it. Cells' numbers of rows and least and greatest
distances bound how far an anchor lies from any row of a cell (triangle inequality): a row is sent to a group of
anchors only if one of them might need it, and there all inner products are taken exactly.

The join runs twice. Positives: for an anchor, the bound of the last one needed comes from the cells that
hold enough such rows. Negatives: what an anchor may need lies in a ring, neither nearer than its largest upper limit nor
farther than its smallest lower limit or than a cell's worth of rows that surely qualify. Bounds only spare work, results are
exact. Anchors go in groups of at most GROUP, rows in chunks of about CHUNK, each pair of them a task's
work of its own, which leaves the best few for each anchor; hot cells and labels are cut in many.

Components are floor(256 * x); scores are whole numbers. Sums that a double can't hold exactly are taken in long or in Python's integers.

Defined cases: rows whose id, label or vector is null, or that hold a null or non-finite component, take no part; an empty vector scores 0 with
others that are empty, and vectors of unlike length don't meet; ties go to the smaller vec_id; rows that repeat a vec_id are rows of
their own, also as each other's positives; zero vectors score 0; an anchor without positives, or a positive without negatives,
gives no rows, and neither does an empty table; a score beyond a long raises; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_parts, staged

#: Pivots at most, and components of all of them together: they are sent to the driver and to every task.
PIVOTS, PIVOT_NUMBERS = 128, 1 << 20
#: Anchors of a group, and bytes of a chunk's components (8,192 rows of 64), about.
GROUP, CHUNK = 2048, 4 << 20
#: A task compares so many anchors with its chunk at a time.
SLICE = 256
#: What rounding may add to a distance, as a share of the longest vector.
SLACK = 1e-6


def whole(column: pa.Array) -> list[np.ndarray]:
    """Each list's components as whole numbers in doubles."""
    flat, ends = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(float)), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[s:e] for s, e in zip(ends, ends[1:])]


def stacked(data: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), float).reshape(len(data), dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, exact: in doubles where those can hold them, else in longs, else in Python's integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    if top < 2**56:  # scores times 100 still fit
        return a.astype(np.int64) @ b.astype(np.int64).T
    x, y = ([[int(v) for v in row] for row in m] for m in (a, b))
    out = np.empty((len(x), len(y)), object)
    for i, u in enumerate(x):
        for j, v in enumerate(y):
            out[i, j] = sum(p * q for p, q in zip(u, v))
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score descending, id)."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], ids[j]))[:k], int)
    if len(scores) > k:
        at_least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= at_least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def chain(points: np.ndarray) -> list[int]:
    """An order of the pivots in which near ones mostly follow each other; there are PIVOTS at most."""
    left, out = set(range(1, len(points))), [0]
    while left:
        out.append(min(left, key=lambda j: (float(((points[j] - points[out[-1]]) ** 2).sum()), j)))
        left.remove(out[-1])
    return out


def prepared(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label, dims, data (whole components as bytes), norm2 and is_anchor of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("e"), F.coalesce(F.col("is_anchor").cast("boolean"), F.lit(False)).alias("is_anchor"))
    good = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = whole(b.column("e"))
            norm2 = [float(x @ x) for x in own]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("is_anchor"), pa.array(list(map(len, own)), pa.int32()), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(norm2, pa.float64())], names=["vec_id", "label", "is_anchor", "dims", "data", "norm2"])

    packed = in_parts(good.select("vec_id", "label", "is_anchor", "e")).mapInArrow(pack, "vec_id long, label string, is_anchor boolean, dims int, data binary, norm2 double")
    return staged(packed.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")


def pivots(rows: DataFrame, seed: int) -> list[tuple[int, np.ndarray]]:
    """Length and components of pivots, in an order in which near ones mostly follow each other: of a sample of about 64 rows for each, those with the smallest hashes."""
    n, widest = rows.agg(F.count("*"), F.max("dims")).first()
    most = max(1, min(PIVOTS, PIVOT_NUMBERS // max(1, widest or 1)))
    hashed = F.xxhash64(F.lit(seed), "data")
    some = rows.where(F.pmod(hashed, F.lit(max(1, n // (64 * most)))) == 0)
    found = some.select("dims", "data").distinct().orderBy(hashed, "data").limit(most).collect()
    out = []
    for d in sorted({r.dims for r in found}):
        own = stacked([r.data for r in found if r.dims == d], d)
        out += [(d, own[k]) for k in chain(own)]
    return out


def placed(rows: DataFrame, points: list[tuple[int, np.ndarray]], top: float) -> DataFrame:
    """rows with cell and r (the distance to its pivot), and for anchors qcell, the nearest pivot, and to, the distances to all pivots of their length.

    top is the largest squared norm. Cell 0 is the zero vector's, which all lengths have.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, n = b.column("dims").to_numpy(), b.num_rows
            data, norm2, anchor = b.column("data").to_pylist(), b.column("norm2").to_numpy(), b.column("is_anchor").to_pylist()
            cell, r, qcell, to = np.zeros(n, np.int32), np.zeros(n), np.zeros(n, np.int32), [None] * n
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = stacked([data[i] for i in at], d)
                numbers = [0] + [k for k, (m, _) in enumerate(points, 1) if m == d]
                p = np.stack([np.zeros(d)] + [v for m, v in points if m == d])
                dot, p2, x2 = x @ p.T, (p * p).sum(axis=1), norm2[at]
                near = np.sqrt(np.maximum(0, 2 * top - 2 * (dot + np.sqrt(np.maximum(0, top - x2))[:, None] * np.sqrt(np.maximum(0, top - p2)))))
                far = np.sqrt(np.maximum(0, x2[:, None] + top - 2 * dot))
                low = near.argmin(axis=1)
                cell[at], r[at] = np.array(numbers)[low], near[np.arange(len(at)), low]
                qcell[at] = np.array(numbers)[far.argmin(axis=1)]
                for k, i in enumerate(at.tolist()):
                    if anchor[i]:
                        to[i] = [{"cell": c, "d": v} for c, v in zip(numbers, far[k].tolist())]
            more = [pa.array(cell), pa.array(r), pa.array(qcell), pa.array(to, pa.list_(pa.struct([("cell", pa.int32()), ("d", pa.float64())])))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "cell", "r", "qcell", "to"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return staged(in_parts(rows).mapInArrow(place, f"{fields}, cell int, r double, qcell int, to array<struct<cell: int, d: double>>"), "negatives-cells")


def grouped(anchors: DataFrame, by: list[str]) -> DataFrame:
    """anchors with grp: at most about GROUP of them that share `by`, cells that follow each other together, a hot cell in parts."""
    cells = anchors.groupBy(*by, "qcell").agg(F.count("*").alias("m"))
    before = Window.partitionBy(*by).orderBy("qcell").rowsBetween(Window.unboundedPreceding, -1)  # PIVOTS + 1 rows at most
    start = cells.select(*by, "qcell", F.floor(F.coalesce(F.sum("m").over(before), F.lit(0)) / GROUP).alias("run"), F.ceil(F.col("m") / GROUP).alias("parts"))
    return anchors.join(start, [*by, "qcell"]).withColumn("grp", F.concat_ws("/", *by, "run", F.pmod(F.xxhash64("row"), F.col("parts")))).drop("run", "parts")


def sent(rows: DataFrame, anchors: DataFrame, cells: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows, each in one chunk of each group that may need it, and the anchors, in all chunks of their group.

    anchors: grp, near and far (between which distances matter) and to. cells: by, cell, n, low and high (distances to the pivot).
    """
    a = anchors.select(*by, "grp", "near", "far", F.explode("to").alias("t")).select(*by, "grp", "near", "far", "t.cell", "t.d")
    met = a.join(cells, [*by, "cell"]).where((F.greatest(F.lit(0.0), F.col("d") - F.col("high"), F.col("low") - F.col("d")) <= F.col("far")) & (F.col("d") + F.col("high") >= F.col("near")))
    # within a cell, rows at r lie between |d - r| and d + r from the anchor
    serves = met.groupBy(*by, "cell", "grp", "n").agg(F.min(F.greatest(F.col("d") - F.col("far"), F.col("near") - F.col("d"))).alias("r_from"), F.max(F.col("d") + F.col("far")).alias("r_to"))
    serves = staged(serves, "negatives-serves")
    chunks = serves.groupBy("grp").agg(F.ceil(F.sum(F.col("n") * 8 * (F.col("dims") + 8)) / CHUNK).cast("int").alias("chunks"))
    lists = serves.join(chunks, "grp").groupBy(*by, "cell").agg(F.collect_list(F.struct("grp", "chunks", "r_from", "r_to")).alias("groups"))  # one for each group of anchors
    to = F.filter("groups", lambda g: (F.col("r") >= g["r_from"]) & (F.col("r") <= g["r_to"]))
    copies = rows.join(lists, [*by, "cell"]).select("row", "vec_id", "label", "data", F.explode(to).alias("g"))
    copies = copies.select("row", "vec_id", "label", "data", "g.grp", F.pmod(F.xxhash64("row"), F.col("g.chunks")).cast("int").alias("chunk"))
    ends = anchors.join(chunks, "grp").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("to", "near", "far", "chunks")
    return copies, ends


def compared(copies: DataFrame, ends: DataFrame, take, schema: str) -> DataFrame:
    """What take(anchors, their products with a chunk, the chunk's row numbers, ids and labels) gives for each group and chunk."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("row")
            d = right.column("dims")[0].as_py()
            x, ids, numbers, labels = stacked(left.column("data").to_pylist(), d), left.column("vec_id").to_numpy(), left.column("row").to_numpy(), np.array(left.column("label").to_pylist(), object)
            anchors = right.to_pylist()
            for s in range(0, len(anchors), SLICE):
                part = anchors[s : s + SLICE]
                scores = products(stacked([a["data"] for a in part], d), x)
                for a, own in zip(part, scores):
                    out += take(a, own, numbers, ids, labels)
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = [{"long": pa.int64(), "int": pa.int32()}[f.split()[1]] for f in schema.split(", ")]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*out) if out else [[]] * len(names), kinds)})

    return copies.groupBy("grp", "chunk").cogroup(ends.groupBy("grp", "chunk")).applyInArrow(join, schema)


def hard_negatives(vectors: DataFrame, *, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, seed: int = 11) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    vectors: vec_id, label, embedding, is_anchor. An anchor's positives are its nearest rows of the same label; for each the nearest rows of other labels whose
    score is from `least` to `most` hundredths of the positive's, ranked from 1.
    """
    rows = prepared(vectors)
    top = rows.agg(F.max("norm2")).first()[0] or 0.0
    if not math.isfinite(top):
        raise OverflowError("components are too large for whole-number scores")
    cells = placed(rows, pivots(rows, seed), top)
    discard(rows)
    slack = SLACK * (1 + math.sqrt(top))
    sizes = {"n": F.count("*"), "low": F.min("r") - slack, "high": F.max("r") + slack}
    own = staged(cells.groupBy("label", "dims", "cell").agg(*(v.alias(k) for k, v in sizes.items())), "negatives-labels")
    anchors = cells.where("is_anchor").select("row", "vec_id", "label", "dims", "data", "norm2", "qcell", "to")

    # positives: no farther than the worst row of the nearest cell that holds enough of the label
    by = ["label", "dims"]
    reach = anchors.select("row", *by, F.explode("to").alias("t")).select("row", *by, "t.cell", "t.d").join(own.where(F.col("n") > positives), [*by, "cell"]).groupBy("row").agg(F.min(F.col("d") + F.col("high")).alias("far"))
    a = staged(grouped(anchors.join(reach, "row", "left").withColumn("far", F.coalesce("far", F.lit(float("inf")))).withColumn("near", F.lit(0.0)), by), "negatives-anchors")
    left, right = sent(cells, a, own, by)

    def first_take(a: dict, scores: np.ndarray, numbers: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[tuple]:
        other = np.flatnonzero(numbers != a["row"])
        return [(a["row"], int(ids[other[k]]), int(scores[other[k]])) for k in best(scores[other], ids[other], positives)]

    found = compared(left, right.select("grp", "chunk", "row", "dims", "data"), first_take, "row long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id"))
    firsts = staged(found.withColumn("place", place).where(F.col("place") <= positives), "negatives-positives")

    # negatives: in the ring between the limits, and no farther than the worst row of a cell that surely holds enough
    limits = firsts.where("positive_score >= 0").groupBy("row").agg(F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("wanted"), F.max("positive_score").alias("s_max"), F.min("positive_score").alias("s_min"))

    def distance(score):
        return F.sqrt(F.greatest(F.lit(0.0), F.col("norm2") + F.lit(top) - 2 * score))

    asked = anchors.join(limits, "row")
    asked = asked.withColumn("near", distance(F.col("s_max") * (most / 100)) - slack).withColumn("far", distance(F.col("s_min") * (least / 100)) + slack).withColumn("sure", distance(F.col("s_min") * (most / 100)) + slack)
    asked = staged(asked, "negatives-asked")
    all_ = staged(own.groupBy("dims", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")), "negatives-sizes")
    mine = own.select("label", "dims", "cell", F.col("n").alias("own_n"))
    inside = (
        asked.select("row", "label", "dims", "sure", F.explode("to").alias("t"))
        .select("row", "label", "dims", "sure", "t.cell", "t.d")
        .join(all_, ["dims", "cell"])
        .where(F.greatest(F.col("d") - F.col("high"), F.col("low") - F.col("d")) >= F.col("sure"))
        .join(mine, ["label", "dims", "cell"], "left")
        .where(F.col("n") - F.coalesce("own_n", F.lit(0)) >= negatives)
        .groupBy("row")
        .agg(F.min(F.col("d") + F.col("high")).alias("enough"))
    )
    b = staged(grouped(asked.join(inside, "row", "left").withColumn("far", F.least("far", F.coalesce("enough", F.col("far")))).drop("enough", "sure", "s_max", "s_min"), ["dims"]), "negatives-rings")
    left, right = sent(cells, b, all_, ["dims"])

    def second_take(a: dict, scores: np.ndarray, numbers: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[tuple]:
        low = min(least * w["positive_score"] for w in a["wanted"])
        other = np.flatnonzero((labels != a["label"]) & (100 * scores >= low))
        some, own_ids = scores[other], ids[other]
        out = []
        for w in a["wanted"]:
            fits = np.flatnonzero((100 * some >= least * w["positive_score"]) & (100 * some <= most * w["positive_score"]))
            out += [(a["vec_id"], a["row"], w["place"], w["positive_id"], w["positive_score"], int(own_ids[fits[k]]), int(some[fits[k]])) for k in best(some[fits], own_ids[fits], negatives)]
        return out

    met = compared(left, right.select("grp", "chunk", "row", "vec_id", "label", "dims", "data", "wanted"), second_take, "anchor_id long, row long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    result = staged(met.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for t in (cells, own, a, firsts, asked, all_, b):
        discard(t)
    return result
