"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

A source's target is the level times its weight, but at most max_epochs times its size. The level at
which all targets sum to the budget is what clamping full sources and resharing their excess by
weight ends in; sorting sources by the level at which they are full gives it without a loop.

Each source is taken whole as often as its target allows; of the rest, documents are taken in the
order of a keyed hash up to the one nearest to the target. That is a cut in the hash's order, found
from sums over the hash's first 12 bits and then among the documents of the bucket that holds the
cut. So no source, however large, is sorted or gathered whole, and documents themselves are never shuffled.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a source
without words has target 0 and is never taken; documents without words are taken as their place in the hash's order says, so never
more often than max_epochs; a null doc_id hashes as the word null; rows that repeat a doc_id share
its hash and so are taken or left together; an empty table gives no rows; other columns are kept by
mixed_rows() and not read by mix().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

WEIGHTS = (5, 2, 1)
BUCKET_BITS = 12
HASH_BITS = 60
#: With at most so many sources their table (under 100 bytes a row) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    """Number of words: each loses the one white space before it, so the lengths differ by as much."""
    padded = F.concat(F.lit(" "), text)
    return F.coalesce((F.length(padded) - F.length(F.regexp_replace(padded, r"[\x20\x09-\x0D](?=[^\x20\x09-\x0D])", ""))).cast("long"), F.lit(0).cast("long"))


def hashed(doc_id: Column, seed: int) -> Column:
    """60 bits of MD5, as both Spark and plain SQL engines can compute them."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 15), 16, 10).cast("long")


def source_plan(sizes: DataFrame, *, weights: Sequence[float] = WEIGHTS, max_epochs: float = 3.0, budget: float = 1.0) -> DataFrame:
    """From rows (__source, __hash, __size): one row for each source with source_size, target, whole repetitions and the hash up to which one more is taken."""
    buckets = staged(
        sizes.groupBy("__source", F.shiftright("__hash", HASH_BITS - BUCKET_BITS).alias("__bucket")).agg(F.sum("__size").alias("__words")),
        "mix-buckets",
    )
    by_name = Window.orderBy(F.col("__source").isNull(), "__source")  # one row for each source from here on
    total = Window.partitionBy()
    upto = Window.orderBy("__full_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    k = (F.row_number().over(by_name) - 1) % len(weights)
    sources = (
        buckets.groupBy("__source")
        .agg(F.sum("__words").alias("source_size"))
        .withColumn("__w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), k + 1))
        .withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("__full_at", F.col("__cap") / F.col("__w"))
        .withColumn("__t", F.sum("source_size").over(total) * F.lit(float(budget)))
        .withColumn("__all_w", F.sum("__w").over(total))
        .withColumn("__filled", F.sum("__cap").over(upto) + F.col("__full_at") * (F.col("__all_w") - F.sum("__w").over(upto)))
        .withColumn("__is_full", F.col("__filled") < F.col("__t"))
        .withColumn("__rest", F.col("__t") - F.sum(F.when(F.col("__is_full"), F.col("__cap")).otherwise(0.0)).over(total))
        .withColumn("__rest_w", F.col("__all_w") - F.sum(F.when(F.col("__is_full"), F.col("__w")).otherwise(0.0)).over(total))
        .withColumn("target", F.when(F.col("__is_full") | (F.col("__rest_w") <= 0), F.col("__cap")).otherwise(F.least("__cap", F.col("__rest") / F.col("__rest_w") * F.col("__w"))))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("__quota", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("__source", "source_size", "target", "whole", "__quota")
    )
    sources = staged(sources, "mix-sources")
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        buckets.withColumn("__before", F.coalesce(F.sum("__words").over(before), F.lit(0)))
        .join(sources.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s")))
        .where("__before < __quota AND __before + __words > __quota")
        .select("__s", F.col("__bucket").alias("__b"), "__before", "__quota")
    )
    edge = staged(edge, "mix-edges")
    at = Window.partitionBy("__s").orderBy("__hash").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        sizes.join(edge, F.col("__source").eqNullSafe(F.col("__s")) & (F.shiftright("__hash", HASH_BITS - BUCKET_BITS) == F.col("__b")))
        .groupBy("__s", "__hash", "__before", "__quota")
        .agg(F.sum("__size").alias("__size"))
        .withColumn("__upto", F.col("__before") + F.coalesce(F.sum("__size").over(at), F.lit(0)))
        .where(F.col("__upto") + F.col("__size") / 2.0 <= F.col("__quota"))  # a quota of 0 has no edge
        .groupBy("__s")
        .agg(F.max("__hash").alias("__last"))
    )
    full = (
        buckets.withColumn("__before", F.coalesce(F.sum("__words").over(before), F.lit(0)))
        .join(sources.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s")))
        .where("__quota > 0 AND __before + __words <= __quota")
        .groupBy("__s")
        .agg(F.max("__bucket").alias("__full"))
        .select("__s", (F.shiftleft(F.col("__full") + 1, HASH_BITS - BUCKET_BITS) - 1).alias("__last"))
    )
    best = cuts.unionByName(full).groupBy("__s").agg(F.max("__last").alias("hash_upto"))
    return staged(
        sources.join(best, F.col("__source").eqNullSafe(F.col("__s")), "left").select("__source", "source_size", "target", "whole", F.coalesce("hash_upto", F.lit(-1).cast("long")).alias("hash_upto")),
        "mix-plan",
    )


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with __source and __hash), their source's plan and repeats."""
    plan = plan.withColumnRenamed("__source", "__s")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    return rows.join(plan, F.col("__source").eqNullSafe(F.col("__s"))).withColumn("repeats", F.col("whole") + (F.col("__hash") <= F.col("hash_upto")).cast("long")).drop("__s")


def keyed(docs: DataFrame, seed: int) -> list[Column]:
    return [F.col("source").cast("string").alias("__source"), hashed(F.col("doc_id"), seed).alias("__hash")]


def mix(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, max_epochs: float = 3.0, budget: float = 1.0, seed: int = 5) -> DataFrame:
    """doc_id, size, source_size, target and repeats (how often the mix takes the document) of every row."""
    sizes = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keyed(docs, seed), n_words(F.col("text")).alias("__size")), "mix-sizes")
    plan = source_plan(sizes.select("__source", "__hash", "__size"), weights=weights, max_epochs=max_epochs, budget=budget)
    return with_plan(sizes, plan).select("doc_id", F.col("__size").alias("size"), "source_size", "target", "repeats")


def mixed_rows(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, max_epochs: float = 3.0, budget: float = 1.0, seed: int = 5) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    sizes = staged(docs.select(*keyed(docs, seed), n_words(F.col("text")).alias("__size")), "mix-sizes")
    plan = source_plan(sizes, weights=weights, max_epochs=max_epochs, budget=budget)
    rows = with_plan(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), *keyed(docs, seed)), plan)
    return rows.select("__row", F.explode(F.expr("CASE WHEN repeats > 0 THEN sequence(1L, repeats) ELSE array() END")).alias("__k")).select("__row.*")
