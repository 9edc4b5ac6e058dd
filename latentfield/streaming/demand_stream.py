"""The demand field over a stream of events: an extension, kept equal to the batch operator.

Counts and weights of each capability, and the counts of its direction tags, are sums, so each micro-batch
is aggregated and added to a table of sums; reading the table gives the field so far. A batch that is
run again after a failure replaces its own rows, since rows carry the batch's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S
from ..operators.fields import total, weighted


def batch_sums(events: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each capability and tag (null: the events themselves) of a batch, and of each value of the columns `by`."""
    e = weighted(events)
    tagged = F.col("arrow") & (F.coalesce(F.size("direction"), F.lit(0)) > 0)
    sums = e.groupBy(*by, "capability").agg(
        F.lit(None).cast("string").alias("tag"), F.count("*").alias("n"), total(F.col("w")).alias("demand"), total(F.when(F.col("arrow"), F.col("w")).otherwise(F.lit(0.0))).alias("arrow_demand"), F.max(tagged).alias("direction_known")
    )
    tags = e.where(tagged).select(*by, "capability", F.explode("direction").alias("tag")).groupBy(*by, "capability", "tag").agg(F.count("*").alias("n"))
    return sums.unionByName(tags.withColumns({"demand": F.lit(0.0), "arrow_demand": F.lit(0.0), "direction_known": F.lit(False)}))


def start(events: DataFrame, table: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Keeps the sums of a stream of events in the folder table."""

    def add(batch: DataFrame, number: int) -> None:
        batch_sums(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def demand_so_far(spark: SparkSession, table: str) -> DataFrame:
    """The field of all batches so far, with the columns of the batch operator."""
    sums = spark.read.parquet(table)
    per_tag = sums.groupBy("capability", "tag").agg(F.sum("n").alias("n"), total(F.col("demand")).alias("demand"), total(F.col("arrow_demand")).alias("arrow_demand"), F.max("direction_known").alias("direction_known"))
    own = per_tag.where("tag IS NULL")
    tags = per_tag.where("tag IS NOT NULL").groupBy(F.col("capability").alias("of")).agg((F.max("n") / F.sum("n")).alias("coherence"))
    return own.join(tags, F.col("capability").eqNullSafe(F.col("of")), "left").select(
        "capability",
        F.col("n").alias("count"),
        "demand",
        F.when(F.col("demand") > 0, S.clamp01(F.col("arrow_demand") / F.col("demand"))).otherwise(F.lit(0.0)).alias("arrow_share"),
        F.coalesce("coherence", F.lit(0.5)).alias("coherence"),
        "direction_known",
    )


def windowed_demand(events: DataFrame, *, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Demand by capability and window of event time `at`; events later than the watermark are left out, windows past it are final."""
    return weighted(events.withWatermark("at", late)).groupBy(F.window("at", window), "capability").agg(F.count("*").alias("count"), F.sum("w").alias("demand"))
