"""Grid and solid operators (AGG19, GRA9-11): stencils as self-joins, fixpoints and waves as rounds of them.

A board is rows (cell, clue) with edges (cell, near) to the cells that a clue counts, the cell itself among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import staged


def square_board(spark: SparkSession, side: int) -> DataFrame:
    """(cell, near) of a square grid: each cell with the up to nine cells of its 3x3 block."""
    cells = spark.range(side * side).select(F.col("id").cast("int").alias("cell"))
    steps = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1))))
    moved = cells.select("cell", steps.alias("s")).select("cell", (F.col("cell") % side + F.col("s.x")).alias("x"), (F.floor(F.col("cell") / side).cast("int") + F.col("s.y")).alias("y"))
    return moved.where((F.col("x") >= 0) & (F.col("x") < side) & (F.col("y") >= 0) & (F.col("y") < side)).select("cell", (F.col("y") * side + F.col("x")).cast("int").alias("near"))


def clues(filled: DataFrame, near: DataFrame) -> DataFrame:
    """AGG19: (cell, clue): how many cells near each cell are filled. filled: cell, value 0 or 1."""
    return near.join(filled.select(F.col("cell").alias("near"), "value"), "near").groupBy("cell").agg(F.sum("value").alias("clue"))


def solved(given: DataFrame, near: DataFrame, *, most_rounds: int = 200) -> DataFrame:
    """GRA9: (cell, state): 1 filled, 0 empty, null undecided, after all clues have been drawn on until nothing changes.

    A clue that its filled cells reach makes the rest empty; one that needs all its undecided cells fills them.
    """
    state = staged(near.select("cell").distinct().withColumn("state", F.lit(None).cast("int")), "puzzle-state")
    rules = staged(given.where("clue IS NOT NULL").join(near, "cell"), "puzzle-rules")
    for _ in range(most_rounds):
        open_ = rules.join(state.select(F.col("cell").alias("near"), "state"), "near")
        known = open_.groupBy("cell", "clue").agg(F.coalesce(F.sum("state"), F.lit(0)).alias("filled"), F.count_if(F.col("state").isNull()).alias("unknown")).where("unknown > 0")
        decided = known.withColumn("value", F.when(F.col("filled") == F.col("clue"), 0).when(F.col("filled") + F.col("unknown") == F.col("clue"), 1)).where("value IS NOT NULL")
        new = staged(decided.join(rules.select("cell", "near"), "cell").groupBy(F.col("near").alias("cell")).agg(F.max("value").alias("value")).join(state.where("state IS NULL"), "cell", "left_semi"), "puzzle-new")
        if new.isEmpty():
            return state
        state = staged(state.join(new, "cell", "left").select("cell", F.coalesce("state", "value").alias("state")), "puzzle-state")
    raise RuntimeError("the puzzle did not settle")


def wave(start: DataFrame, near: DataFrame, *, most: int) -> DataFrame:
    """GRA10: (cell, step) that a wave from the start cells reaches in at most `most` steps."""
    seen = staged(start.select("cell").distinct().withColumn("step", F.lit(0)), "wave-0")
    front = seen
    for k in range(1, most + 1):
        reached = front.select("cell").join(near, "cell").select(F.col("near").alias("cell")).distinct()
        front = staged(reached.join(seen, "cell", "left_anti").withColumn("step", F.lit(k)), f"wave-{k}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def cube_surface(spark: SparkSession, side: int) -> DataFrame:
    """GRA11: (cell, near) on the surface of a cube: cells are near if they share an edge, told by the edge's midpoint.

    Cell f * side**2 + y * side + x lies on face f of six; an edge's midpoint is in whole numbers on a doubled grid.
    """
    cells = spark.range(6 * side * side).select(F.col("id").cast("int").alias("cell"))
    f, y, x = F.floor(F.col("cell") / (side * side)).cast("int"), F.floor(F.col("cell") / side).cast("int") % side, F.col("cell") % side
    ends = F.array(*(F.struct((2 * x + a).alias("u"), (2 * y + b).alias("v")) for a, b in ((1, 0), (1, 2), (0, 1), (2, 1))))
    e = cells.select("cell", f.alias("f"), F.explode(ends).alias("e")).select("cell", "f", F.col("e.u").alias("u"), F.col("e.v").alias("v"))
    axis, far = F.floor(F.col("f") / 2).cast("int"), (F.col("f") % 2) * (2 * side)
    point = F.when(axis == 0, F.array(far, F.col("u"), F.col("v"))).when(axis == 1, F.array(F.col("u"), far, F.col("v"))).otherwise(F.array(F.col("u"), F.col("v"), far))
    at = e.select("cell", point.alias("point"))
    return at.join(at.select(F.col("cell").alias("near"), "point"), "point").where("cell <> near").select("cell", "near").distinct()
