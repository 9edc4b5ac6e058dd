"""Keeps a ledger of demand by day from files of events that keep arriving.

    python -m jobs.demand_ledger --config jobs/demand_ledger.json --events E --state S --output O

events: a folder of files of ts, capability, kind, weight, after, direction, each written once. A run takes the files that no run
has taken before, as a stream that ends when there is nothing new, and adds each micro-batch's sums to a table in folders by day and batch.
Then it writes anew the days that batches touched since the last published batch: one row for each day and
capability, with the day's demand, its coherence and its change against the capability's day before. Late events change their own day (and the change of the day
after it), whatever has come since.

The state folder holds the stream's checkpoint, the sums and the mark of the last published batch; they belong together. A run that breaks off can be
run again: a batch that is repeated replaces its own sums, and days between the mark and the newest batch are published again. Without
anything new, a run changes nothing.

Defined cases: events without a time are of the day null, those without a capability of the capability null; weights and kinds as for the demand
field; a folder without files gives an empty ledger.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from latentfield.functions import scalars as S
from latentfield.operators.fields import total
from latentfield.plans.staging import staged
from latentfield.streaming.demand_stream import batch_sums

from .common import FORMATS, command, log, parser

DEFAULTS = {"format": "parquet", "files_per_batch": 1000, "time_type": "timestamp"}
#: Up to so many touched days are named in the plan, so that only their folders are read; beyond, most of the table is touched anyway.
NAMED_DAYS = 400
EVENTS = "ts {time_type}, capability string, kind string, weight double, after string, direction array<string>"
SUMS = "capability string, tag string, n bigint, demand double, arrow_demand double, direction_known boolean, day date, batch bigint"
LEDGER = "capability string, count bigint, demand double, arrow_share double, coherence double, direction_known boolean, previous_day date, demand_change double, day date"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one before anything is written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def take(events: DataFrame, state: str) -> StreamingQuery:
    """Starts the stream that adds what is new to the sums."""

    def add(batch: DataFrame, number: int) -> None:
        sums = batch_sums(batch.withColumn("day", F.to_date("ts")), by=("day",)).withColumn("batch", F.lit(number))
        writer = sums.repartition("day").write.partitionBy("day", "batch").option("partitionOverwriteMode", "dynamic")
        writer.mode("overwrite").parquet(f"{state}/sums")  # a batch that is repeated replaces its own folders

    return events.writeStream.foreachBatch(add).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()


def mark(spark: SparkSession, state: str) -> int:
    """The last batch whose days are published; -1 if none is, and then all days are published."""
    found = stored(spark, f"{state}/mark", "batch bigint").agg(F.max("batch")).first()[0]
    return -1 if found is None else found


def by_day(sums: DataFrame) -> DataFrame:
    """The demand field of each day and capability from its sums, with the columns of the batch operator."""
    per_tag = sums.groupBy("day", "capability", "tag").agg(F.sum("n").alias("n"), total(F.col("demand")).alias("demand"), total(F.col("arrow_demand")).alias("arrow_demand"), F.max("direction_known").alias("direction_known"))
    # the row without a tag holds the events themselves, the others how often each tag occurs
    return per_tag.groupBy("day", "capability").agg(
        F.sum(F.when(F.col("tag").isNull(), F.col("n"))).alias("count"),
        F.sum("demand").alias("demand"),
        F.sum("arrow_demand").alias("arrow_demand"),
        F.coalesce(F.max(F.when(F.col("tag").isNotNull(), F.col("n"))) / F.sum(F.when(F.col("tag").isNotNull(), F.col("n"))), F.lit(0.5)).alias("coherence"),
        F.max("direction_known").alias("direction_known"),
    )


def of_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """The rows of the days, null among them."""
    few = [r.day for r in days.limit(NAMED_DAYS + 1).collect()]
    if len(few) <= NAMED_DAYS:
        wanted = F.col("day").isin([d for d in few if d is not None])
        return rows.where(wanted | F.col("day").isNull() if None in few else wanted)
    return rows.join(days.withColumnRenamed("day", "d"), F.col("day").eqNullSafe(F.col("d")), "left_semi")


def published(spark: SparkSession, state: str, output: str) -> tuple[int, int]:
    """Writes the days that batches behind the mark touch, and the days after those; gives the numbers of events and of days."""
    sums = stored(spark, f"{state}/sums", SUMS)
    fresh = sums.where(F.col("batch") > mark(spark, state))
    newest, events = fresh.agg(F.max("batch"), F.sum(F.when(F.col("tag").isNull(), F.col("n")))).first()
    if newest is None:
        return 0, 0
    days = staged(fresh.select("day").distinct(), "ledger-days")
    touched = staged(days.unionByName(days.select(F.date_add("day", 1).alias("day"))).distinct(), "ledger-touched")
    # a touched day needs its own sums and, for the change, those of the day before
    field = staged(by_day(of_days(sums, touched.unionByName(touched.select(F.date_sub("day", 1).alias("day"))).distinct())), "ledger-field")
    before = field.select(F.date_add("day", 1).alias("day"), F.col("day").alias("previous_day"), "capability", F.col("demand").alias("earlier"))
    rows = of_days(field, touched).join(before, ["day", "capability"], "left").select(
        "capability", "count", "demand", F.when(F.col("demand") > 0, S.clamp01(F.col("arrow_demand") / F.col("demand"))).otherwise(F.lit(0.0)).alias("arrow_share"), "coherence", "direction_known",
        "previous_day", (F.col("demand") - F.col("earlier")).alias("demand_change"), "day",
    )
    rows.repartition("day").write.partitionBy("day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(output)
    spark.range(1).select(F.lit(newest).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{state}/mark")
    return events or 0, touched.count()


def read_output(spark: SparkSession, output: str) -> DataFrame:
    return stored(spark, output, LEDGER)


def run(spark: SparkSession, *, events: DataFrame | str, state: str, output: str, settings: dict | None = None) -> DataFrame:
    """The job: reads a folder (or takes a stream), waits for the stream's end, writes the ledger and returns it read back."""
    s = DEFAULTS | (settings or {})
    if s["format"] not in FORMATS:
        raise ValueError(f"format {s['format']} is none of {', '.join(FORMATS)}")
    if isinstance(events, str):
        events = spark.readStream.schema(EVENTS.format(**s)).format(s["format"]).option("maxFilesPerTrigger", s["files_per_batch"]).load(events)
    take(events, state).awaitTermination()
    rows, days = published(spark, state, output)
    log.info("read %s new events", rows)
    log.info("wrote %s days to %s", days, output)
    return read_output(spark, output)


def main() -> None:
    make = parser(__doc__, ("events", "folder of files of events"), ("state", "folder of the checkpoint, sums and mark"), ("output", "folder of the ledger"))
    command(make, run, DEFAULTS, "demand-ledger")


if __name__ == "__main__":
    main()
