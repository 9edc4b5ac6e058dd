"""Readings of all capabilities under any number of configurations (PIP3, SCL16-22, WIN1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranking import numbered

#: Default scales: demand, files and use at which a field is at 63 %, and the use assumed where none is known.
DEFAULT_CONFIG = (3.0, 2.0, 20.0, 0.5)


def config(spark: SparkSession, c_half: float = DEFAULT_CONFIG[0], k_half: float = DEFAULT_CONFIG[1], u_half: float = DEFAULT_CONFIG[2], unknown_util_prior: float = DEFAULT_CONFIG[3]) -> DataFrame:
    return spark.range(1).select(F.lit(0).alias("config_id"), *(F.lit(float(v)).alias(k) for k, v in (("c_half", c_half), ("k_half", k_half), ("u_half", u_half), ("unknown_util_prior", unknown_util_prior))))


def evidence(capabilities: DataFrame, demand: DataFrame, capacity: DataFrame, usage: DataFrame) -> DataFrame:
    """JN2-4: one row for each capability; a missing field is null, which for use means unknown."""
    return (
        capabilities.select("ord", F.col("id").alias("capability"), "label", F.coalesce(F.size("signals"), F.lit(0)).alias("declared"))
        .join(demand, "capability", "left")
        .join(capacity, "capability", "left")
        .join(usage, "capability", "left")
    )


#: A grid of configurations is broadcast up to so many rows (about 50 bytes each); beyond, the join shuffles.
BROADCAST_CONFIGS = 50_000


def readings(rows: DataFrame, configs: DataFrame, *, hi: float = S.HI, lo: float = S.LO, keep: tuple[str, ...] = ()) -> DataFrame:
    """The scores of evidence() rows under each configuration: one row, or a grid of parameters. `keep` names columns of rows that come along."""
    if configs.limit(BROADCAST_CONFIGS + 1).count() <= BROADCAST_CONFIGS:
        configs = F.broadcast(configs)
    c = F.col
    known = F.coalesce(c("known"), F.lit(False))
    demand = F.coalesce(c("demand"), F.lit(0.0))
    coherence = F.coalesce(c("coherence"), F.lit(0.0))
    matched, files = F.coalesce(c("n_matched"), F.lit(0)), F.coalesce(c("n_files"), F.lit(0)).cast("double")
    raw = (
        rows.crossJoin(configs)
        .withColumn("known", known)
        .withColumn("_c", S.clamp01(S.saturate(demand, c("c_half")) * (F.lit(0.5) + F.lit(0.5) * coherence)))
        .withColumn("_k", S.clamp01(F.when(c("declared") > 0, matched / c("declared")).otherwise(0.0) * S.saturate(files, c("k_half"))))
        .withColumn("_u", F.when(known, S.saturate(F.coalesce(c("usage_total"), F.lit(0.0)), c("u_half"))).otherwise(F.lit(0.0)))
        .withColumn("_cc", S.correction_confidence(demand, F.coalesce(c("arrow_share"), F.lit(0.0)), coherence, F.coalesce(c("direction_known"), F.lit(False))))
        .withColumn("_kc", S.capacity_confidence(matched, c("declared")))
        .withColumn("_uc", S.utilization_confidence(c("known")))
    )
    scored = raw.select(
        *(x for x in ("config_id", "c_half", "k_half", "u_half", "unknown_util_prior", "ord", "capability", "label", "known", "declared")),
        S.rounded(c("_c")).alias("correction"),
        S.rounded(c("_k")).alias("capacity"),
        S.rounded(c("_u")).alias("utilization"),
        S.rounded(c("_c") * (c("_cc") * c("_kc") * c("_uc")) * (1 - c("_u"))).alias("score"),
        S.rounded(c("_c") * c("_k") * (1 - F.when(c("known"), c("_u")).otherwise(c("unknown_util_prior")))).alias("collapse_potential"),
        S.rounded(c("_cc") * c("_kc") * c("_uc")).alias("confidence"),
        F.struct(
            F.coalesce("count", F.lit(0)).alias("correction_count"),
            S.rounded(demand).alias("demand"),
            S.rounded(F.coalesce(c("arrow_share"), F.lit(0.0))).alias("arrow_share"),
            S.rounded(coherence).alias("direction_coherence"),
            F.coalesce("direction_known", F.lit(False)).alias("direction_known"),
            *([F.coalesce("files", F.expr("array()").cast("array<string>")).alias("capacity_files"), F.coalesce("matched_signals", F.expr("array()").cast("array<string>")).alias("matched_signals")] if "files" in rows.columns else []),
            F.coalesce("usage_total", F.lit(0.0)).alias("usage_count"),
            S.rounded(c("_cc")).alias("correction_confidence"),
            S.rounded(c("_kc")).alias("capacity_confidence"),
            S.rounded(c("_uc")).alias("utilization_confidence"),
        ).alias("evidence"),
        *(c(k) for k in keep),
    )
    return scored.withColumn("category", S.category(c("correction"), c("capacity"), c("utilization"), c("known"), hi, lo))


def ranked(scores: DataFrame) -> DataFrame:
    """WIN1, WIN2: place in each configuration by rounded score; equal ones in input order. A configuration may hold any number of rows."""
    return numbered(scores, F.desc("score"), "ord", per="config_id")
