"""The jobs as registered queries over the whole tables, run twice into one new folder, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentfield.functions import scalars as S
from latentfield.plans.oracle import CAPACITY, EVENTS, ONE, USE, demand, scores
from latentfield.plans.staging import shared_dir
from latentfield.sources import views as V

from . import demand_ledger, fleet_scan


def job1_fleet_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All documents by source, with the warehouse's items as capabilities."""
    at = f"{shared_dir(spark)}/fleet-{uuid.uuid4().hex}"
    settings = {"c_half": V.C_HALF, "k_half": V.K_HALF, "u_half": V.U_HALF, "unknown_util_prior": V.PRIOR, "path_column": "doc_id"}
    for _ in range(2):
        out = fleet_scan.run(
            spark, documents=f"{sf}/documents.parquet", capabilities=V.capabilities(spark, sf), events=V.corrections(spark, sf), usage=V.usage(spark, sf), output=f"{at}/output", settings=settings
        )
    leading = F.array_join(F.transform("leading", lambda x: F.concat_ws(":", x["path"], x["hits"].cast("string"))), ",")
    return out.select("source", "rank", "capability", *fleet_scan.MEASURES, "known", "category", "n_files", "hits", "n_matched", leading.alias("leading"))


def job2_demand_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """All events as a stream of files."""
    at = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    for _ in range(2):
        out = demand_ledger.run(spark, events=V.as_corrections(V.table_stream(spark, sf, "events")), state=f"{at}/state", output=f"{at}/output")
    day = {c: F.col(c).cast("string").alias(c) for c in ("day", "previous_day")}
    return out.select(day["day"], "capability", "count", "demand", *(S.rounded(F.col(c), 6).alias(c) for c in ("arrow_share", "coherence")), "direction_known", day["previous_day"], S.rounded(F.col("demand_change"), 6).alias("demand_change"))


QUERIES = {f.__name__: f for f in (job1_fleet_scan, job2_demand_ledger)}

FLEET = f"""WITH {CAPACITY}, {EVENTS}, {demand()}, {USE},
trees AS (SELECT DISTINCT nullif(source, '') AS source FROM documents),
per AS (SELECT nullif(d.source, '') AS source, m.* FROM matched m JOIN documents d USING (doc_id)),
support AS (SELECT source, capability, count(DISTINCT signal) AS n_matched, count(DISTINCT doc_id) AS n_files, count(*) AS hits FROM per GROUP BY 1, 2),
leads AS (SELECT source, capability, string_agg(path || ':' || n, ',' ORDER BY n DESC, path) AS leading FROM (
  SELECT *, row_number() OVER (PARTITION BY source, capability ORDER BY n DESC, path) AS place FROM (SELECT source, capability, doc_id::VARCHAR AS path, count(*) AS n FROM per GROUP BY ALL)) WHERE place <= 3 GROUP BY 1, 2),
evi AS (SELECT t.source, c.ord, c.capability, c.declared, coalesce(d.demand, 0.0::DOUBLE) AS demand, coalesce(d.coherence, 0.0::DOUBLE) AS coherence, coalesce(d.arrow_share, 0.0::DOUBLE) AS arrow_share, coalesce(d.direction_known, FALSE) AS direction_known,
  coalesce(k.n_matched, 0) AS n_matched, coalesce(k.n_files, 0) AS n_files, coalesce(k.hits, 0) AS hits, u.usage_total IS NOT NULL AS known, coalesce(u.usage_total, 0.0::DOUBLE) AS usage_total
  FROM caps c CROSS JOIN trees t LEFT JOIN dem d USING (capability) LEFT JOIN support k ON k.capability = c.capability AND k.source IS NOT DISTINCT FROM t.source LEFT JOIN us u ON u.capability = c.capability),
{scores('rd', 'evi', ONE, by='source')}
SELECT r.source, r.rank, r.capability, r.correction, r.capacity, r.utilization, r.score, r.collapse_potential, r.confidence, r.known, r.category, e.n_files, e.hits, e.n_matched, coalesce(l.leading, '') AS leading
FROM rd r JOIN evi e ON e.capability = r.capability AND e.source IS NOT DISTINCT FROM r.source LEFT JOIN leads l ON l.capability = r.capability AND l.source IS NOT DISTINCT FROM r.source"""

LEDGER = f"""WITH {EVENTS},
days AS (SELECT ts::DATE AS day, k::VARCHAR AS capability, count(*) AS "count", sum(tenths) / 10.0::DOUBLE AS demand, sum(CASE WHEN arrow THEN tenths ELSE 0 END) / sum(tenths)::DOUBLE AS arrow_share, bool_or(arrow) AS direction_known FROM ev GROUP BY 1, 2),
tags AS (SELECT day, capability, max(n) / sum(n)::DOUBLE AS coherence FROM (SELECT ts::DATE AS day, k::VARCHAR AS capability, way, count(*) AS n FROM ev WHERE arrow GROUP BY ALL) GROUP BY 1, 2)
SELECT d.day::VARCHAR AS day, d.capability, d."count", d.demand, floor(d.arrow_share * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS arrow_share, floor(coalesce(t.coherence, 0.5::DOUBLE) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS coherence, d.direction_known,
  p.day::VARCHAR AS previous_day, floor((d.demand - p.demand) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS demand_change
FROM days d LEFT JOIN tags t ON t.day = d.day AND t.capability = d.capability LEFT JOIN days p ON p.capability = d.capability AND p.day = d.day - 1"""

SQL = {"job1_fleet_scan": FLEET, "job2_demand_ledger": LEDGER}
