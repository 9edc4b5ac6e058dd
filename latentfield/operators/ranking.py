"""Places over a whole table without a task that holds it (WIN1, WIN3, SRT1-5).

The table is dealt out in ranges of the order and sorted within them, each range numbers its rows, and the
number of rows in all ranges before it is added. What the driver sees is one count for each range.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged

#: monotonically_increasing_id() holds the partition above this bit and the row's number in it below.
LOCAL_BITS = 33
#: Ranges for each core of the cluster.
RANGES = 2


def numbered(rows: DataFrame, *order: Column | str, name: str = "rank", first: int = 1, per: str | None = None) -> DataFrame:
    """rows with their place (long, from `first`) in an order; `per` numbers each value of that column by itself.

    Places are the same in every run if no two rows are equal in all of the order, so it should end with a key. Null comes first in
    ascending and last in descending order. No rows give no places. The result is a table of its own under the shared folder.
    """
    spark = rows.sparkSession
    at, key = "__at_" + name, "__range_" + name
    keys = [*([per] if per else []), *order]
    ranges = max(spark.sparkContext.defaultParallelism * RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = staged(rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), "ranked")
    dealt = dealt.withColumn(key, F.shiftright(at, LOCAL_BITS))
    # ranges follow each other, so the first row of all, or of a value of `per`, has the least id
    if per is None:
        counts = {r[key]: r.n for r in dealt.groupBy(key).agg(F.count("*").alias("n")).collect()}  # one row a range
        before = dict(zip(sorted(counts), accumulate((counts[k] for k in sorted(counts)), initial=0)))
        offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], f"{key} long, n long")
        joined = dealt.join(F.broadcast(offsets), key)  # one row a range
        return joined.withColumn(name, F.col("n") + F.col(at).bitwiseAND((1 << LOCAL_BITS) - 1) + first).drop(key, at, "n")
    parts = dealt.groupBy(per, key).agg(F.count("*").alias("n"), F.min(at).alias("start"))
    other = parts.select(F.col(per).alias("__p"), F.col(key).alias("__k"), F.col("n").alias("__n"))
    earlier = (F.col(per).eqNullSafe(F.col("__p"))) & (F.col("__k") < F.col(key))
    offsets = parts.join(other, earlier, "left").groupBy(per, key).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__n"), F.first("start").alias("__start"))
    offsets = offsets.select(F.col(per).alias("__p"), F.col(key).alias("__k"), "__n", "__start")
    joined = dealt.join(offsets, F.col(per).eqNullSafe(F.col("__p")) & (F.col(key) == F.col("__k")))
    return joined.withColumn(name, F.col("__n") + F.col(at) - F.col("__start") + first).drop(key, at, "__p", "__k", "__n", "__start")
