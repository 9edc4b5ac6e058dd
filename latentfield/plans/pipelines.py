"""The pipelines (PIP1-9) over a source tree and a folder of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lexers import lexed, match_tokens
from ..operators import changes, fields, modules, proposals, sweeps
from ..operators.presentation import by_baseline, by_change, by_links, by_members
from ..operators.readings import config, evidence, ranked, readings
from ..operators.symbols import integration
from ..sources import inputs
from ..sources.code_tree import code_files
from .staging import discard, staged


class NoInput(ValueError):
    """An input that a pipeline can't do without is empty."""


def lexed_tree(spark: SparkSession, root: str, *, texts: bool = False) -> DataFrame:
    """The tree read and lexed once; fields, graphs and map share it. Only the map needs the texts."""
    found = lexed(code_files(spark, root))
    return staged(found if texts else found.drop("text"), "lexed")


def tree_tokens(files: DataFrame) -> DataFrame:
    return match_tokens(files, F.col("identifiers"))


def with_distance(scores: DataFrame, capabilities: DataFrame, found: DataFrame, files: DataFrame) -> DataFrame:
    d = integration(capabilities, found.select("capability", "files"), files)
    return scores.join(d, "capability", "left").withColumn("integration_distance", S.rounded(F.col("integration_distance"), 4)).withColumn("integration", S.integration_label(F.col("integration_distance")))


def scan(spark: SparkSession, root: str, data: str) -> DataFrame:
    """PIP1: ranked readings of the declared capabilities."""
    capabilities = inputs.capabilities(spark, data)
    if capabilities.isEmpty():
        raise NoInput(f"no capabilities in {data}/capabilities.json")
    files = lexed_tree(spark, root)
    found = staged(fields.capacity_evidence(capabilities, tree_tokens(files)), "evidence")
    rows = evidence(capabilities, fields.demand(inputs.corrections(spark, data)), found, fields.usage(inputs.usage(spark, data)))
    scores = ranked(readings(rows, config(spark))).withColumn("interpretation", S.interpretation(F.col("category")))
    return with_distance(scores, capabilities, found, files).orderBy("rank")


def discover(spark: SparkSession, root: str, data: str) -> DataFrame:
    """PIP2: ranked readings of proposed capabilities. Their use is unknown, since use is counted for declared ones."""
    events = staged(inputs.corrections(spark, data), "events")
    if events.isEmpty():
        raise NoInput(f"no corrections in {data}/corrections.json")
    proposed, members = proposals.propose(events.select("ord", F.col("id"), F.coalesce("after", F.lit("")).alias("after")))
    proposed = staged(proposed, "proposals")
    members = staged(members, "members")
    # places among proposals, most members first, decide ties of the score
    keyed = by_members(proposed).select(F.col("place").alias("ord"), F.col("ord").cast("string").alias("id"), "label", "signals", F.col("id").alias("name"))
    # both sides grow with the events; a few columns of a table seem so small to the planner that it would send them all through the driver
    relabelled = staged(events.drop("capability").join(members.hint("merge"), "ord").withColumn("capability", F.col("root").cast("string")), "relabelled")
    for t in (events, members):
        discard(t)
    files = lexed_tree(spark, root)
    found = staged(fields.capacity_evidence(keyed, tree_tokens(files)), "evidence")
    unknown = spark.createDataFrame([], "capability string, usage_total double, known boolean")
    scores = ranked(readings(evidence(keyed, fields.demand(relabelled), found, unknown), config(spark))).withColumn("interpretation", S.interpretation(F.col("category")))
    full = with_distance(scores, keyed, found, files)
    ids = relabelled.groupBy("capability").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda p: p["id"]).alias("member_ids"))
    names = keyed.select(F.col("id").alias("capability"), "name", "signals")
    return full.withColumnRenamed("ord", "place").join(ids, "capability").join(names, "capability").withColumn("capability", F.col("name")).drop("name").orderBy("rank")


def sweep_evidence(spark: SparkSession, root: str, data: str) -> DataFrame:
    capabilities = inputs.capabilities(spark, data)
    if capabilities.isEmpty():
        raise NoInput(f"no capabilities in {data}/capabilities.json")
    found = fields.capacity(capabilities, tree_tokens(lexed_tree(spark, root)))
    return staged(evidence(capabilities, fields.demand(inputs.corrections(spark, data)), found, fields.usage(inputs.usage(spark, data))), "sweep-evidence")


def reflect(spark: SparkSession, root: str, data: str, level: int = 2) -> DataFrame:
    """PIP5, PIP6: stability of each verdict under other parameters (2), or under other designs of the sweep (3)."""
    rows = sweep_evidence(spark, root, data)
    found = sweeps.level3(rows) if level == 3 else sweeps.level2(rows).withColumn("verdict", S.stability_verdict(F.col("baseline_cp"), F.col("candidate_share"), F.col("rank1_share")))
    return by_baseline(found)


def reflection(spark: SparkSession, root: str, data: str) -> tuple[DataFrame, DataFrame]:
    """PIP9: both levels over inputs that are aggregated once."""
    rows = sweep_evidence(spark, root, data)
    return by_baseline(sweeps.level2(rows)), by_baseline(sweeps.level3(rows))


def save_baseline(spark: SparkSession, root: str, data: str, path: str) -> None:
    """PIP7."""
    inputs.write_baseline(scan(spark, root, data), path)


def compare(spark: SparkSession, root: str, data: str, path: str) -> DataFrame:
    """PIP7: what has changed since the newest baseline."""
    return by_change(changes.compared(inputs.read_baseline(spark, path), scan(spark, root, data)))


def code_map(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """PIP8: modules with their roles, and the totals."""
    files = lexed_tree(spark, root, texts=True)
    found = staged(modules.roles(modules.module_map(files)), "modules")
    return by_links(found), modules.totals(files, found)
