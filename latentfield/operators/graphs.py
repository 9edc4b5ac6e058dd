"""Graph operators (GRA*): edges are rows, reachability and components are rounds of joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.staging import discard, staged
from .ranking import numbered

MAX_HOPS = 8


def undirected(edges: DataFrame) -> DataFrame:
    """SET5, FLT12: both directions of each edge (src, dst), once, without loops."""
    both = edges.where("src <> dst").select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
    return both.select("e.src", "e.dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """GRA8: out- and in-degree of every node that has an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def seated(nodes: DataFrame, *order: str) -> DataFrame:
    """(node, block, i, bit): each node's place among 64 that share a block, in an order. Nodes that are asked for together should be next to each other."""
    seats = numbered(nodes, *order, name="seat", first=0)
    return seats.select("node", F.shiftright("seat", 6).alias("block"), (F.col("seat") % 64).cast("int").alias("i")).withColumn("bit", F.expr("shiftleft(1L, i)"))


#: About so many edges are worked on together, and so many neighbours of a node are one row.
TILE, CHUNK = 1 << 22, 4096


def tiled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(at, src, dsts): each node's neighbours as arrays, and (node, at): the tile that each node with an edge is worked on in.

    Nodes that lie close together share a tile, so what is merged within it is nearly all that can be merged. Any dealing gives the same results.
    """
    edges = staged(edges.select("src", "dst"), "hops-links")
    degrees = staged(edges.groupBy("src").agg(F.count("*").alias("degree"), F.min("dst").alias("low")).select("src", "degree", F.least("src", "low").alias("low")), "hops-degrees")
    near = edges.join(degrees.select(F.col("src").alias("dst"), "low"), "dst").groupBy("src").agg(F.min("low").alias("tile"))
    placed = degrees.join(near, "src", "left").select("src", "degree", F.coalesce("tile", "low").alias("tile"))
    parts = placed.groupBy("tile").agg(F.ceil(F.sum("degree") / TILE).cast("int").alias("parts"))
    at = F.xxhash64("tile", F.pmod(F.xxhash64("src"), F.col("parts")))
    places = staged(placed.join(parts, "tile").select("src", "degree", at.alias("at")), "hops-places")
    chunk = F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / CHUNK))
    lists = staged(edges.join(places, "src").groupBy("at", "src", chunk.alias("chunk")).agg(F.collect_list("dst").alias("dsts")).select("at", "src", "dsts"), "hops-edges")
    for t in (edges, degrees):
        discard(t)
    return lists, places.select(F.col("src").alias("node"), "at")


#: So many words of bits are sent to a task, and so many are merged at once there.
WORDS, MERGED = 1 << 22, 1 << 18
#: Words are merged as a table of nodes and blocks if at least one of so many of its cells is there, else one by one.
FILLED = 8


def uniting(merged: int, filled: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The function that merges what is sent to a tile, which goes to tasks by value."""

    def united(sent: pa.Table, lists: pa.Table) -> pa.Table:
        """(node, block, got): the union of what the neighbours of each node hold; what is merged one by one may be several rows. sent: node, blocks, words. lists: at, src, dsts, where src gets what dsts hold."""
        nodes = sent.column("node").combine_chunks()
        blocks, words = (sent.column(c).combine_chunks() for c in ("blocks", "words"))
        lengths = blocks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = np.cumsum(lengths) - lengths
        names, blocks = np.unique(blocks.flatten().to_numpy(), return_inverse=True)
        words = words.flatten().to_numpy().view(np.uint64)
        lists = lists.sort_by([("at", "ascending"), ("src", "ascending")])
        dsts = lists.column("dsts").combine_chunks()
        sizes, dsts = dsts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), dsts.flatten()
        ends = np.append(0, np.cumsum(sizes))
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]]

        def keep(*columns: np.ndarray) -> None:
            for column, values in zip(found, columns):
                column.append(values)

        def dense(near: np.ndarray, starts: np.ndarray, to: np.ndarray) -> None:
            rows, near = np.unique(near, return_inverse=True)
            n = lengths[rows]
            row = np.repeat(np.arange(len(rows)), n)
            cell = np.repeat(firsts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            some, column = np.unique(blocks[cell], return_inverse=True)
            width = max(1, min(16, len(some)))
            steps = np.searchsorted(starts, np.arange(0, len(near), max(1, merged // width)), "right") - 1  # a node's neighbours stay together
            steps = np.append(np.unique(steps), len(starts))
            whole = np.append(starts, len(near))
            room = np.empty((int(np.max(whole[steps[1:]] - whole[steps[:-1]])), width), np.uint64)
            for x in range(0, len(some), width):
                here = (column >= x) & (column < x + width)
                table = np.zeros((len(rows), width), np.uint64)
                table[row[here], column[here] - x] = words[cell[here]]
                for y, z in zip(steps[:-1], steps[1:]):
                    taken = np.take(table, near[whole[y] : whole[z]], axis=0, out=room[: whole[z] - whole[y]], mode="clip")
                    got = np.bitwise_or.reduceat(taken, whole[y:z] - whole[y], axis=0)
                    i, j = np.nonzero(got)
                    keep(to[y:z][i], names[some[x + j]], got[i, j])

        def sparse(near: np.ndarray, of: np.ndarray) -> None:
            n = lengths[near]
            work = np.append(0, np.cumsum(n))
            x = 0
            while x < len(near):
                y = max(x + 1, int(np.searchsorted(work, work[x] + (merged << 2), "right")) - 1)
                m = n[x:y]
                cell = np.repeat(firsts[near[x:y]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                key = np.repeat(of[x:y], m) * len(names) + blocks[cell]
                order = np.argsort(key, kind="stable")
                key = key[order]
                start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                keep(key[start] // len(names), names[key[start] % len(names)], np.bitwise_or.reduceat(words[cell[order]], start))
                x = y

        x = 0
        while x < len(sizes) and len(nodes):
            # as many nodes as have about so many neighbours; those of one tile follow each other, and hold much the same
            y = max(x + 1, int(np.searchsorted(ends, ends[x] + (merged << 2), "right")) - 1)
            near = pc.index_in(dsts.slice(ends[x], ends[y] - ends[x]), value_set=nodes).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(x, y), sizes[x:y])[near >= 0]
            near = near[near >= 0]
            if len(near):
                pairs, rows = lengths[near].sum(), np.unique(near)
                wide = min(int(lengths[rows].sum()), len(names))
                if len(near) * wide <= filled * pairs:
                    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                    dense(near, starts, of[starts])
                else:
                    sparse(near, of)
            x = y
        row, block, got = (np.concatenate(column) for column in found)
        return pa.table([lists.column("src").combine_chunks().take(pa.array(row)), block, got.view(np.int64)], names=["node", "block", "got"])

    return united


def reached(edges: DataFrame, seats: DataFrame, most: int) -> list[DataFrame]:
    """For each number of hops from 0, (node, block, bits, hops): the sources that reach the node in so many hops and not in fewer, 64 to a row.

    All sources advance together. What a round reached goes to the tiles of the nodes that have it for a neighbour, and is merged there word by word, so neither hubs nor
    the number of sources multiply rows; each (source, node) is one bit, written once. Where a tile would get more than WORDS words, its blocks are dealt to several tasks.
    """
    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists, places = tiled(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    # several tiles to a group, so that small ones don't cost a call each
    groups = max(n, -(-2 * (lists.agg(F.sum(F.size("dsts"))).first()[0] or 0) // TILE))
    tiles = lists.select(F.pmod(F.xxhash64("at"), F.lit(groups)).cast("int").alias("tile"), "at", "src", "dsts")
    asks = staged(tiles.select("tile", F.explode("dsts").alias("node")).distinct(), "hops-asks")
    # of a connected graph nothing is left once all pairs are found
    rest = seats.join(places, "node").count() * (places.count() - 1)
    name = tiles.schema["src"].dataType.simpleString()
    levels = [staged(seats.select("node", "block", F.col("bit").alias("bits"), F.lit(0).alias("hops")), "hops-0")]
    n_rows = levels[0].count()
    for k in range(1, most + 1):
        parts = 1
        if n_rows > WORDS:
            held = levels[-1].groupBy("node").agg(F.count("*").alias("n"))
            parts = -(-(held.join(asks, "node").groupBy("tile").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) // WORDS) or 1
        packed = levels[-1].groupBy("node", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part")).agg(F.collect_list("block").alias("blocks"), F.collect_list("bits").alias("words"))
        sent = asks.join(packed, "node").select("tile", "part", asks["node"], "blocks", "words").repartition(n, "tile", "part")
        to = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(n, "tile", "part")
        got = sent.groupBy("tile", "part").cogroup(to.groupBy("tile", "part")).applyInArrow(uniting(MERGED, FILLED), f"node {name}, block long, got long")
        seen = reduce(DataFrame.unionByName, levels).groupBy("node", "block").agg(F.bit_or("bits").alias("seen"))
        new = got.groupBy("node", "block").agg(F.bit_or("got").alias("got")).join(seen, ["node", "block"], "left").withColumn("bits", F.expr("got & ~coalesce(seen, 0L)")).where("bits <> 0")
        level = staged(new.select("node", "block", "bits", F.lit(k).alias("hops")), f"hops-{k}")
        n_rows, n_bits = level.agg(F.count("*"), F.sum(F.expr("bit_count(bits)"))).first()
        if not n_rows:
            discard(level)
            break
        levels.append(level)
        rest -= n_bits
        if not rest:
            break
    for t in (lists, places, asks):
        discard(t)
    return levels


def hops(edges: DataFrame, sources: DataFrame, *, most: int = MAX_HOPS) -> DataFrame:
    """GRA3: (source, node, hops) for every node within `most` hops of each source (column source), itself at 0. edges must hold both directions."""
    seats = staged(seated(sources.select(F.col("source").alias("node")).where("node IS NOT NULL").distinct(), "node"), "hops-seats")
    found = reduce(DataFrame.unionByName, reached(edges, seats, most))
    names = seats.groupBy("block").agg(F.collect_list(F.struct("i", F.col("node").alias("source"))).alias("names"))  # 64 at most
    set_ = F.explode(F.expr("filter(names, s -> getbit(bits, s.i) = 1)"))
    return found.join(names, "block").select("node", "hops", set_.alias("s")).select("s.source", "node", "hops")


def mean_distances(members: DataFrame, edges: DataFrame, *, most: int = MAX_HOPS) -> DataFrame:
    """AGG11, JN7: (owner, distance): the mean over all pairs of an owner's nodes of hops / (hops + 2), or 1 without a path. members: owner, node. A single node gives 0.

    No pair is ever a row: an owner's nodes are bits, and at each node of the owner those that reached it are counted.
    """
    own = staged(members.select("owner", "node").where("owner IS NOT NULL AND node IS NOT NULL").distinct(), "distance-members")
    seats = staged(seated(own.groupBy("node").agg(F.min("owner").alias("first")), "first", "node"), "distance-seats")
    masks = staged(own.join(seats, "node").groupBy("owner", "block").agg(F.bit_or("bit").alias("mask")), "distance-masks")
    levels = reached(edges, seats, most)
    met = reduce(DataFrame.unionByName, levels).where("hops > 0").join(own, "node").join(masks, ["owner", "block"])
    # each pair is counted from both ends
    near = met.groupBy("owner", "hops").agg((F.sum(F.expr("bit_count(bits & mask)")) / 2).cast("long").alias("n"))
    near = near.groupBy("owner").agg(F.sum("n").alias("linked"), F.sum(F.col("n") * S.hop_distance(F.col("hops")).cast("decimal(18,12)")).cast("double").alias("near"))
    sizes = own.groupBy("owner").agg(F.count("*").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    result = sizes.join(near, "owner", "left").select("owner", F.when(F.col("n") > 1, (F.coalesce("near", F.lit(0.0)) + pairs - F.coalesce("linked", F.lit(0))) / pairs).otherwise(F.lit(0.0)).alias("distance"), F.col("n").alias("n_nodes"))
    result = staged(result, "distances")
    for t in (seats, masks, *levels):
        discard(t)
    return result


def components(edges: DataFrame, *, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """GRA7: from edges (a, b), node and root (the smallest node reachable) of every node that has an edge to another.

    In each round every node moves to its smallest neighbour's smallest neighbour, edges are renamed
    accordingly, and those inside one node disappear; rounds grow with the logarithm of the graph. Where a node ends is read off the rounds' moves afterwards.
    """
    between = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = staged(between.distinct(), f"{name}-edges")
    moves = []
    for _ in range(most_rounds):
        if rest.isEmpty():
            break
        both = rest.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
        to = both.groupBy(F.col("e.u").alias("u")).agg(F.min("e.v").alias("v")).select("u", F.least("u", "v").alias("to"))
        moves.append(staged(to.join(to.select(F.col("u").alias("to"), F.col("to").alias("further")), "to").select("u", F.col("further").alias("to")), f"{name}-moves"))
        moved = rest.join(moves[-1].select(F.col("u").alias("a"), F.col("to").alias("x")), "a").join(moves[-1].select(F.col("u").alias("b"), F.col("to").alias("y")), "b")
        old, rest = rest, staged(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-edges")
        discard(old)
    else:
        raise RuntimeError("components did not settle")
    if not moves:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    discard(rest)
    # every node that has an edge moves in the first round; in later ones those that still have edges do
    nodes = moves[0].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for m in moves[1:]:
        nodes = nodes.join(m.select(F.col("u").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    if len(moves) == 1:
        return nodes
    nodes = staged(nodes, f"{name}-nodes")
    for m in moves:
        discard(m)
    return nodes
