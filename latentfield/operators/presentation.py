"""Which rows a display shows, and where it puts them (PIP10, FLT14-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranking import numbered


def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with their place in an order, and in that order."""
    return numbered(rows, *order, name="place").orderBy("place")


def by_members(proposals: DataFrame) -> DataFrame:
    """SRT2: largest clusters first, then by id."""
    return placed(proposals, F.desc("n_members"), "id", "ord")


def by_change(changes: DataFrame) -> DataFrame:
    """SRT3: largest changes of the potential first."""
    return placed(changes, F.desc(F.abs("d_collapse_potential")), "capability")


def by_baseline(sweep: DataFrame) -> DataFrame:
    """SRT4: largest potential under the default parameters first."""
    return placed(sweep, F.desc("baseline_cp"), "ord")


def by_links(modules: DataFrame) -> DataFrame:
    """SRT5: modules that most others import first, then those that define most."""
    return placed(modules, F.desc("in_degree"), F.desc("n_defs"), "path")


def quadrant(scores: DataFrame) -> DataFrame:
    """Readings with a distance and a score above 0.001: x is the distance, y the score, side where the point lies."""
    shown = scores.where("integration_distance IS NOT NULL AND score > 0.001")
    d = F.col("integration_distance")
    side = F.when(d <= 0.45, "ripe").when(d >= 0.75, "deep").otherwise("moderate")
    return shown.select("capability", "label", d.alias("x"), F.col("score").alias("y"), side.alias("side"))


def badges(scores: DataFrame) -> DataFrame:
    """What marks a reading: its distance's label, use that wasn't observed, and the share of demand without a direction."""
    e = F.col("evidence")
    heat = F.when((e.correction_count > 0) & (e.arrow_share < 0.999), F.floor((1 - e.arrow_share) * 100 + 0.5).cast("long"))
    return scores.select("capability", S.integration_label(F.col("integration_distance")).alias("distance"), (~F.col("known")).alias("unverified"), heat.alias("heat_percent"), S.interpretation(F.col("category")).alias("interpretation"))


def stability_cards(level2: DataFrame, level3: DataFrame) -> DataFrame:
    """Capabilities that are or may become candidates, with their range over designs and the knob that decides, unless the verdict is all but constant."""
    shown = level2.where("baseline_cp >= 0.001 OR candidate_share > 0.05")
    swings = (F.col("candidate_share") > 0.05) & (F.col("candidate_share") < 0.95)
    return shown.withColumn("knob", F.when(swings, F.col("knob"))).join(level3.select("capability", "min_share", "max_share", "l2_share", "class_converges"), "capability", "left")


def printed_designs(level3: DataFrame) -> DataFrame:
    """Third-level rows worth printing."""
    return level3.where("baseline_cp >= 0.01")
