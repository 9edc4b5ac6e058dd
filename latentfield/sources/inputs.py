"""The three JSON inputs (SRC1-2) and stored results (SRC8, SNK1-4).

Each input is one array of objects in a file. A file that is missing or not such an array is an empty
table. Order in the array is kept as ord, since it decides ties. Large arrays are read in parts.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import size_of, split_size
from .json_array import SPACE, split_rows, struct_type

CAPABILITIES = "id string, label string, description string, signals array<string>"
CORRECTIONS = "id string, capability string, kind string, before string, after string, weight double, at string, direction array<string>"
USAGE = "capability string, count double"
#: Inputs of up to so many bytes are read whole. The check of a text as JSON gives up on larger ones somewhere above this.
WHOLE = 8 << 20


def whole_rows(texts: DataFrame, schema: str) -> DataFrame:
    """The rows of arrays that are one text each; further columns of texts stay before them."""
    kept = [c for c in texts.columns if c != "value"]
    # what isn't JSON as a whole counts as empty, not in part; a parser that stops behind the first value doesn't within brackets of both kinds
    strict = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), "value", F.lit("}"))).isNotNull()
    checked = texts.withColumn("value", F.when(strict & ~F.regexp_like("value", F.lit(f"^{SPACE}$")), F.col("value")))
    parsed = F.from_json("value", f"array<{struct_type(schema)}>")
    return checked.select(*kept, F.posexplode(parsed).alias("ord", "r")).select(*kept, "ord", "r.*")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """ord and the fields of schema, one row for each object of the array in the file (or of each file in a folder).

    Small inputs are read whole. Larger ones are read in parts, but for files that aren't arrays of objects: these are read whole as well,
    which Spark's JSON check does up to some MB; beyond, such a file counts as malformed.
    """
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return whole_rows(spark.createDataFrame([], "value string"), schema)
    if size_of(whole) <= min(split_size(spark), WHOLE):
        return whole_rows(whole, schema)
    rows, other = split_rows(spark, path, schema)
    if other:
        rows = rows.drop("file").unionByName(whole_rows(spark.read.text(other, wholetext=True), schema))
    return rows.drop("file")


def capabilities(spark: SparkSession, folder: str) -> DataFrame:
    return json_rows(spark, f"{folder}/capabilities.json", CAPABILITIES)


def corrections(spark: SparkSession, folder: str) -> DataFrame:
    return json_rows(spark, f"{folder}/corrections.json", CORRECTIONS)


def usage(spark: SparkSession, folder: str) -> DataFrame:
    return json_rows(spark, f"{folder}/usage.json", USAGE)


def write_report(df: DataFrame, path: str) -> None:
    """SNK1-2: the last report, one JSON object a line, in place of the one before."""
    df.write.mode("overwrite").json(path)


def write_baseline(readings: DataFrame, path: str) -> str:
    """SNK3, PRJ2: four measures of each capability as a version of its own, beside earlier baselines; gives the version.

    A version is a folder, named by the time of writing and a random part, so that two savings at one instant stay apart. Its line in the
    manifest is written last: a version whose saving broke off has none and is never read.
    """
    spark = readings.sparkSession
    at = spark.sql("SELECT current_timestamp()").first()[0]
    version = f"{at:%Y%m%dT%H%M%S.%f}-{uuid.uuid4().hex[:12]}"
    rows = readings.select("capability", "correction", "capacity", "utilization", "collapse_potential", F.lit(at).cast("timestamp").alias("saved_at"))
    rows.write.mode("errorifexists").parquet(f"{path}/rows/version={version}")
    mark = spark.range(1).select(F.lit(version).alias("version"), F.lit(at).cast("timestamp").alias("saved_at"))
    mark.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


BASELINE = "capability string, correction double, capacity double, utilization double, collapse_potential double, saved_at timestamp, version string"


def baseline_versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, saved_at) of all whole baselines; an error if there is none."""
    return spark.read.schema("version string, saved_at timestamp").parquet(f"{path}/manifest")


def read_baseline(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """SRC8: a baseline, the newest if none is named; an error if there is none. Only its folder is read."""
    if version is None:
        newest = baseline_versions(spark, path).orderBy(F.desc("saved_at"), F.desc("version")).first()
        if newest is None:
            raise ValueError(f"no baseline in {path}")
        version = newest.version
    return spark.read.schema(BASELINE).parquet(f"{path}/rows").where(F.col("version") == version)


def as_json(df: DataFrame) -> DataFrame:
    """SNK4: one JSON text a row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
