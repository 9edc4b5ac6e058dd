"""Scans many bodies of text at once: for each source, its capabilities ranked by what users ask for, what its texts support and what is used.

    python -m jobs.fleet_scan --config jobs/fleet_scan.json --documents D --capabilities C --events E --usage U --output O

documents: source, path, text (settings `source_column` and `path_column` name the first two); capabilities: ord, id, label, signals; events: capability, kind, weight, after, direction; usage:
capability, count. The output is one Parquet table in folders by source, a row for each source and capability with its rank
in the source and the files that support it most. A run for all sources replaces the whole table; a run for some (setting `sources`) replaces their
folders and leaves the others. Either way a rerun gives the same table.

Defined cases: documents with a null or empty source are one source, null; null text is empty; a source whose texts support nothing still has
a row for each capability; no capabilities or no documents give no rows; of capabilities that repeat an id the one with the smallest ord is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from latentfield.functions.lexers import text_tokens
from latentfield.functions.scalars import interpretation
from latentfield.operators import fields
from latentfield.operators.ranking import numbered
from latentfield.operators.readings import config, evidence, readings
from latentfield.plans.staging import discard, staged

from .common import command, counted, log, parser, passed, table

DEFAULTS = {"c_half": 3.0, "k_half": 2.0, "u_half": 20.0, "unknown_util_prior": 0.5, "hi": 0.6, "lo": 0.34, "leading_files": 3, "sources": [], "source_column": "source", "path_column": "path", "format": "parquet"}
CAPABILITIES = "ord bigint, id string, label string, signals array<string>"
SCHEMA = (
    "rank bigint, capability string, label string, correction double, capacity double, utilization double, score double, collapse_potential double, confidence double, category string, interpretation string, "
    "known boolean, n_files bigint, hits bigint, n_matched bigint, leading array<struct<path: string, hits: bigint>>, source string"
)
MEASURES = ("correction", "capacity", "utilization", "score", "collapse_potential", "confidence")


def scanned(documents: DataFrame, capabilities: DataFrame, events: DataFrame, usage: DataFrame, settings: dict, seen: Observation | None = None) -> DataFrame:
    """The output's rows. Demand and use are a capability's own; capacity is each source's. seen: counts the documents that are lexed."""
    spark = documents.sparkSession
    by = ("tree",)
    first = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    caps = staged(capabilities.where("id IS NOT NULL").withColumn("n", first).where("n = 1").drop("n"), "fleet-capabilities")
    source = F.col(settings["source_column"]).cast("string")
    docs = documents.select(F.when(source != "", source).alias("source"), F.col(settings["path_column"]).cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    if settings["sources"]:
        docs = docs.where(F.coalesce("source", F.lit("")).isin([x or "" for x in settings["sources"]]))
    # a source goes through joins by its digest, which is never null
    docs = docs.withColumn("tree", F.md5(F.coalesce("source", F.lit(""))))
    sources = staged(docs.select("source", "tree").distinct(), "fleet-sources")
    tokens = text_tokens(counted(docs, seen), by=by)
    found = staged(fields.matches(caps, tokens, by=by), "fleet-matches")
    support = fields.capacity_of(found, by=by).join(fields.leading_files(found, settings["leading_files"], by=by), ["tree", "capability"])
    wanted, used = fields.demand(events), fields.usage(usage)
    common = evidence(caps, wanted, spark.createDataFrame([], "capability string, no_files long"), used).drop("no_files")
    rows = common.crossJoin(sources).join(support, ["tree", "capability"], "left")  # the output has a row for each source and capability
    rows = staged(rows, "fleet-evidence")
    scales = config(spark, *(settings[k] for k in ("c_half", "k_half", "u_half", "unknown_util_prior")))
    scores = readings(rows, scales, hi=settings["hi"], lo=settings["lo"], keep=("tree", "source", "n_files", "hits", "n_matched", "leading"))
    placed = numbered(scores, F.desc("score"), "ord", per="tree")
    out = placed.select(
        "rank", "capability", "label", *MEASURES, "category", interpretation(F.col("category")).alias("interpretation"), "known", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_files", "hits", "n_matched")),
        F.coalesce("leading", F.array().cast("array<struct<path: string, hits: bigint>>")).alias("leading"), "source",
    )
    for t in (found, rows):
        discard(t)
    return out


def write(rows: DataFrame, output: str, some: bool) -> None:
    """All of the table, or the folders of the sources in rows. Both can be done again."""
    writer = rows.repartition("source").write.partitionBy("source").option("partitionOverwriteMode", "dynamic" if some else "static")
    writer.mode("overwrite").parquet(output)


def read_output(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(output)


def run(spark: SparkSession, *, documents: DataFrame | str, capabilities: DataFrame | str, events: DataFrame | str, usage: DataFrame | str, output: str, settings: dict | None = None) -> DataFrame:
    """The job: reads paths (or takes tables), writes the output and returns it read back."""
    s = DEFAULTS | (settings or {})
    given = {"documents": documents, "capabilities": capabilities, "events": events, "usage": usage}
    tables = {k: table(spark, v, s["format"], CAPABILITIES if k == "capabilities" else None) if isinstance(v, str) else v for k, v in given.items()}
    seen, written = Observation("fleet-documents"), Observation("fleet-output")
    out = counted(scanned(tables["documents"], tables["capabilities"], tables["events"], tables["usage"], s, seen), written)
    write(out, output, bool(s["sources"]))
    log.info("read %s rows of documents%s", passed(seen), f" of {len(s['sources'])} sources" if s["sources"] else "")
    log.info("wrote %s rows to %s", passed(written), output)
    return read_output(spark, output)


def main() -> None:
    make = parser(__doc__, ("documents", "table of source, path, text"), ("capabilities", "table of ord, id, label, signals"), ("events", "table of demand events"), ("usage", "table of capability, count"), ("output", "folder of the output"))
    command(make, run, DEFAULTS, "fleet-scan")


if __name__ == "__main__":
    main()
