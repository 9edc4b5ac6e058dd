"""Parameter sweeps: the grid is data, and the readings under all of it are one plan (PIP5-6, AGG12-14, WIN4-5, JN19-20)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .readings import DEFAULT_CONFIG, config, ranked, readings

KNOBS = ("c_half", "k_half", "u_half", "unknown_util_prior", "hi", "lo")
#: Fixed levels of the second-level sweep: 3**6 = 729 configurations.
LEVELS = {
    "c_half": (1.5, 3.0, 6.0),
    "k_half": (1.0, 2.0, 4.0),
    "u_half": (10.0, 20.0, 40.0),
    "unknown_util_prior": (0.3, 0.5, 0.7),
}
THRESHOLDS = {"hi": (0.5, 0.6, 0.7), "lo": (0.25, 0.34, 0.45)}
#: Fixed ends of the third level's designs: factors on the scales, and priors.
RADII = {
    "narrow": ((0.75, 1.333), (0.4, 0.6)),
    "medium": ((0.5, 2.0), (0.3, 0.7)),
    "wide": ((0.333, 3.0), (0.2, 0.8)),
}
POINTS = (3, 5)
CONVERGES = 0.35


def grid(spark: SparkSession, levels: dict[str, tuple[float, ...]]) -> DataFrame:
    """SCL33: all combinations, one row each, by chained explosions."""
    out = spark.range(1).select(F.lit(0).alias("config_id"))
    for knob, values in levels.items():
        out = out.select("*", F.posexplode(F.array(*(F.lit(float(v)) for v in values))).alias("_i", knob)).withColumn("config_id", F.col("config_id") * len(values) + F.col("_i")).drop("_i")
    return out


def scaled_by(value: float):
    return lambda f: f * F.lit(value)


def design(spark: SparkSession, name: str, radius: str, n: int) -> DataFrame:
    """SCL32: one design's configurations, (design, config_id and the four scales)."""
    (low, high), (a, b) = RADII[radius]
    out = spark.range(1).select(F.lit(name).alias("design"), F.lit(0).alias("config_id"))
    factors = S.geom_space(low, high, n)
    for k, knob in enumerate(("c_half", "k_half", "u_half")):
        scaled = F.transform(factors, scaled_by(DEFAULT_CONFIG[k]))
        out = out.select("*", F.posexplode(scaled).alias("_i", knob)).withColumn("config_id", F.col("config_id") * n + F.col("_i")).drop("_i")
    return out.select("*", F.posexplode(S.lin_space(a, b, n)).alias("_i", "unknown_util_prior")).withColumn("config_id", F.col("config_id") * n + F.col("_i")).drop("_i")


def swept(evidence: DataFrame, configs: DataFrame) -> DataFrame:
    """Readings under each configuration, without what only reports need, and whether each is the first of its configuration.

    A first place is an aggregate: no configuration's readings are sorted, however many there are.
    """
    scores = readings(evidence, configs).drop("evidence")
    first = scores.groupBy(F.col("config_id").alias("c")).agg(F.max(F.struct("score", (-F.col("ord")).alias("o"))).alias("best"))
    return scores.join(first, F.col("config_id") == F.col("c")).withColumn("is_first", F.col("ord") == -F.col("best.o")).drop("c", "best")


def candidacies(thresholds: dict[str, tuple[float, ...]]) -> dict[tuple[float, float], Column]:
    """JN19: for each pair of thresholds whether a reading is a candidate under it, 0 or 1."""
    c = F.col
    return {(h, l): S.is_candidate(S.category(c("correction"), c("capacity"), c("utilization"), c("known"), h, l)).cast("long") for h in thresholds["hi"] for l in thresholds["lo"]}


def counts(scores: DataFrame, levels: dict[str, tuple[float, ...]], thresholds: dict[str, tuple[float, ...]]) -> DataFrame:
    """AGG12, AGG13: a row for each capability with all that the sweep counts, in one aggregate of its readings.

    A reading isn't repeated for thresholds or knobs: how often it is a candidate is added up under all pairs of thresholds, under each of either
    threshold, and for each level of the other knobs. `cells` holds (knob_ord, knob, level, t, c): times judged and times a candidate.
    """
    pairs = candidacies(thresholds)
    sums = {("hi", h): sum((x for (a, _), x in pairs.items() if a == h), F.lit(0)) for h in thresholds["hi"]} | {("lo", l): sum((x for (_, b), x in pairs.items() if b == l), F.lit(0)) for l in thresholds["lo"]}
    named = {key: f"c_{k}" for k, key in enumerate(sums)}
    rows = scores.withColumns({named[key]: x for key, x in sums.items()})
    all_ = sum((F.col(named["hi", h]) for h in thresholds["hi"]), F.lit(0))
    cells = []
    for knob_ord, knob in enumerate(KNOBS):
        for level in (levels | thresholds)[knob]:
            if knob in thresholds:
                t, c = F.count("*") * (len(pairs) // len(thresholds[knob])), F.sum(named[knob, level])
            else:
                here = F.col(knob) == F.lit(float(level))
                t, c = F.count_if(here) * len(pairs), F.coalesce(F.sum(F.when(here, all_)), F.lit(0))
            cells.append(F.struct(F.lit(knob_ord).alias("knob_ord"), F.lit(knob).alias("knob"), F.lit(float(level)).alias("level"), t.alias("t"), c.alias("c")))
    return rows.groupBy("capability").agg(
        (F.count("*") * len(pairs)).alias("configurations"),
        (F.sum(F.col("is_first").cast("int")) / F.count("*")).alias("rank1_share"),
        (F.sum(all_) / (F.count("*") * len(pairs))).alias("candidate_share"),
        F.min("collapse_potential").alias("cp_min"),
        F.max("collapse_potential").alias("cp_max"),
        F.array(*cells).alias("cells"),
    )


def second_level(evidence: DataFrame, levels: dict[str, tuple[float, ...]] | None = None, thresholds: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """counts() under all scales and thresholds."""
    levels, thresholds = levels or LEVELS, thresholds or THRESHOLDS
    return counts(swept(evidence, grid(evidence.sparkSession, levels)), levels, thresholds)


def shares(evidence: DataFrame, counted: DataFrame) -> DataFrame:
    """For each capability the baseline, its shares of first places and candidacies, and the range of its potential."""
    base = ranked(readings(evidence, config(evidence.sparkSession)).drop("evidence")).select("ord", "capability", "label", F.col("collapse_potential").alias("baseline_cp"), F.col("rank").alias("baseline_rank"), F.col("category").alias("baseline_category"))
    return base.join(counted, "capability")


def level2(evidence: DataFrame, *, levels: dict[str, tuple[float, ...]] | None = None, thresholds: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """PIP5: shares() of the second level, and each capability's most sensitive knob."""
    counted = shares(evidence, second_level(evidence, levels, thresholds))
    best = sensitivity(F.col("cells"))
    knob = {x: best[x] for x in ("knob", "low_level", "low_share", "high_level", "high_share")}
    return counted.select(*(c for c in counted.columns if c != "cells"), *(v.alias(k) for k, v in knob.items()))


def knob_levels(counted: DataFrame) -> DataFrame:
    """AGG13: (capability, knob, level): times judged (t) and times a candidate (c)."""
    return counted.select("capability", F.inline("cells")).select("capability", "knob", "level", "t", "c")


def of_knob(k: int):
    return lambda x: x["knob_ord"] == k


def sensitivity(cells: Column) -> Column:
    """WIN4, WIN5: of a capability's cells the knob whose levels' shares differ most (the first, if equal; null if no share differs) with its lowest and highest level.

    Levels of a knob are judged equally often, so counts are compared: whole numbers tie exactly.
    """
    knobs = []
    for k, knob in enumerate(KNOBS):
        own = F.filter(cells, of_knob(k))
        low = F.array_min(F.transform(own, lambda x: F.struct(x["c"].alias("c"), x["level"].alias("level"), x["t"].alias("t"))))
        high = F.array_max(F.transform(own, lambda x: F.struct(x["c"].alias("c"), x["level"].alias("level"), x["t"].alias("t"))))
        knobs.append(F.struct((low["c"] - high["c"]).alias("negated"), F.lit(k).alias("k"), F.lit(knob).alias("knob"), low["level"].alias("low_level"), (low["c"] / low["t"]).alias("low_share"), high["level"].alias("high_level"), (high["c"] / high["t"]).alias("high_share")))
    widest = F.array_min(F.array(*knobs))
    return F.when(widest["negated"] < 0, widest)


def design_shares(evidence: DataFrame) -> DataFrame:
    """Candidate and first-place shares of each capability in each of the six designs."""
    spark = evidence.sparkSession
    designs = None
    for k, (radius, n) in enumerate(itertools.product(RADII, POINTS)):
        d = design(spark, f"{radius}-{n}", radius, n).withColumn("config_id", F.col("config_id") + k * 10_000)
        designs = d if designs is None else designs.unionByName(d)
    names = designs.select("config_id", "design")
    scores = swept(evidence, designs.drop("design")).withColumn("candidate", S.is_candidate(F.col("category")).cast("int"))
    return scores.join(F.broadcast(names), "config_id").groupBy("capability", "design").agg(  # 2,118 names
        (F.sum("candidate") / F.count("*")).alias("share"), (F.sum(F.col("is_first").cast("int")) / F.count("*")).alias("rank1")
    )


def level3(evidence: DataFrame) -> DataFrame:
    """PIP6, AGG14: how much a capability's candidate share depends on the design of the sweep itself."""
    designs = design_shares(evidence).groupBy("capability").agg(
        F.min("share").alias("min_share"), F.max("share").alias("max_share"), F.avg("share").alias("mean_share"), (F.max("share") - F.min("share")).alias("spread"), F.min("rank1").alias("rank1_min")
    )
    two = shares(evidence, second_level(evidence)).select("ord", "capability", "label", "baseline_cp", F.col("candidate_share").alias("l2_share"))
    return two.join(designs, "capability").withColumn("class_converges", F.col("spread") <= CONVERGES)
