"""The three fields: weighted demand, matched capacity, observed use (AGG1-7, JN1, JN5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Kind, weight, whether it shows a direction: fixed values.
SIGNAL_KINDS = (
    ("correction", 1.0, True),
    ("request", 1.0, True),
    ("repetition", 0.8, True),
    ("workaround", 0.6, True),
    ("abandonment", 0.5, False),
    ("retry", 0.4, False),
)
#: A table of signal keys is broadcast up to so many rows (about 50 bytes each); beyond, the match is a shuffle join.
BROADCAST_KEYS = 200_000


def signal_kinds(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{k}', double({w}), {str(d).lower()})" for k, w, d in SIGNAL_KINDS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(kind, kind_weight, directional)")


def weighted(events: DataFrame) -> DataFrame:
    """JN1: events with w (own weight, else the kind's) and arrow (they show where users want to go). An unknown kind counts as a correction."""
    kinds = F.broadcast(signal_kinds(events.sparkSession))  # six rows
    return events.join(kinds, "kind", "left").withColumns({
        "w": F.coalesce("weight", "kind_weight", F.lit(1.0)),
        "arrow": F.coalesce("directional", F.lit(True)) & (F.length(F.coalesce("after", F.lit(""))) > 0),
    })


def total(x: F.Column) -> F.Column:
    """A sum of doubles that doesn't depend on their order: decimal inside; NaN if any is NaN."""
    bad = F.max(F.isnan(x))
    return F.when(bad, F.lit(float("nan"))).otherwise(F.coalesce(F.sum(F.when(~F.isnan(x), x).cast("decimal(24,6)")).cast("double"), F.lit(0.0)))


def coherence(events: DataFrame) -> DataFrame:
    """AGG4: of each capability's arrow events, the share of the most common tag among all tags."""
    tags = events.where("arrow AND size(direction) > 0").select("capability", F.explode("direction").alias("tag"))
    return tags.groupBy("capability", "tag").agg(F.count("*").alias("n")).groupBy("capability").agg((F.max("n") / F.sum("n")).alias("coherence"))


def demand(events: DataFrame) -> DataFrame:
    """AGG1-5: count, demand, arrow_share, coherence and direction_known of each capability. events: capability, kind, weight, after, direction."""
    e = weighted(events)
    tagged = F.col("arrow") & (F.coalesce(F.size("direction"), F.lit(0)) > 0)
    sums = e.groupBy("capability").agg(
        F.count("*").alias("count"),
        total(F.col("w")).alias("demand"),
        total(F.when(F.col("arrow"), F.col("w")).otherwise(F.lit(0.0))).alias("arrow_demand"),
        F.max(tagged).alias("direction_known"),
    )
    tags = coherence(e).withColumnRenamed("capability", "of")
    return sums.join(tags, F.col("capability").eqNullSafe(F.col("of")), "left").select(
        "capability",
        "count",
        "demand",
        F.when(F.col("demand") > 0, S.clamp01(F.col("arrow_demand") / F.col("demand"))).otherwise(F.lit(0.0)).alias("arrow_share"),
        F.coalesce("coherence", F.lit(0.5)).alias("coherence"),
        "direction_known",
    )


def usage(events: DataFrame) -> DataFrame:
    """AGG6: total use of each capability. A capability without a row is unknown, one with 0 is known to be unused."""
    return events.groupBy("capability").agg(total(F.greatest(F.lit(0.0), F.col("count").cast("double"))).alias("usage_total"), F.lit(True).alias("known"))


def signal_rows(capabilities: DataFrame) -> DataFrame:
    """Each declared signal by its number, with the keys it matches by."""
    return capabilities.select(F.col("id").alias("capability"), F.posexplode("signals").alias("k", "signal")).select("capability", "k", "signal", F.explode(S.signal_keys(F.col("signal"))).alias("key")).select(
        "capability", "k", "signal", "key.space", "key.token"
    )


def matches(capabilities: DataFrame, tokens: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """JN5: (capability, k, signal, path) for each signal found in a file, by equality on (space, token). tokens: path, space, token.

    `by` names columns of tokens that tell file trees apart; they come along.
    """
    keys = signal_rows(capabilities)
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return tokens.join(keys, ["space", "token"]).select(*by, "capability", "k", "signal", "path").distinct()


def capacity_of(found: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """AGG7 over matches(): files, hits and distinct matched signals of each capability, in one reading of them."""
    return found.groupBy(*by, "capability").agg(F.count_distinct("path").alias("n_files"), F.count("*").alias("hits"), F.count_distinct("signal").alias("n_matched"))


def capacity(capabilities: DataFrame, tokens: DataFrame) -> DataFrame:
    """AGG7 in numbers alone. No list grows with the corpus, and the corpus is lexed once."""
    return capacity_of(matches(capabilities, tokens))


def leading_files(found: DataFrame, most: int, *, by: tuple[str, ...] = ()) -> DataFrame:
    """The `most` files with most hits of each capability, first by hits, then by path: (capability, leading) with leading a list of path and hits."""
    hits = found.groupBy(*by, "capability", "path").agg(F.count("*").alias("hits"))
    place = F.row_number().over(Window.partitionBy(*by, "capability").orderBy(F.desc("hits"), "path"))
    best = hits.withColumn("place", place).where(F.col("place") <= most)  # each task keeps its own first ones before the shuffle
    ordered = F.array_sort(F.collect_list(F.struct("place", "path", "hits")))
    return best.groupBy(*by, "capability").agg(F.transform(ordered, lambda x: F.struct(x["path"].alias("path"), x["hits"].alias("hits"))).alias("leading"))


def capacity_evidence(capabilities: DataFrame, tokens: DataFrame) -> DataFrame:
    """AGG7 with sorted lists of files and matched signals, for reports over a source tree."""
    return matches(capabilities, tokens).groupBy("capability").agg(
        F.array_sort(F.collect_set("path")).alias("files"),
        F.array_sort(F.collect_set("signal")).alias("matched_signals"),
        F.count("*").alias("hits"),
    ).withColumns({"n_files": F.size("files").cast("long"), "n_matched": F.size("matched_signals").cast("long")})
