"""What the jobs share: their settings, readers and the lines they log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("latentfield.jobs")

FORMATS = ("parquet", "orc", "json", "csv")


def settings(path: str | None, defaults: dict) -> dict:
    """The config file's values over the defaults; a name that isn't known is an error."""
    given = json.loads(Path(path).read_text()) if path else {}
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def table(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"format {kind} is none of {', '.join(FORMATS)}")
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    return (reader.schema(schema) if schema else reader).load(path)


def counted(df: DataFrame, seen: Observation | None) -> DataFrame:
    """df, whose rows `seen` counts as they pass by; no job of its own counts them."""
    return df if seen is None else df.observe(seen, F.count(F.lit(1)).alias("rows"))


def passed(seen: Observation) -> int:
    """What counted() has counted, once the job has run. A plan that Spark sees to be empty isn't run, and nothing is counted."""
    try:
        return seen.get["rows"]
    except Py4JJavaError:
        return 0


def parser(doc: str, *paths: tuple[str, str]) -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=doc)
    out.add_argument("--config", help="JSON file of settings")
    for name, text in paths:
        out.add_argument(f"--{name}", required=True, help=text)
    return out


def command(make: argparse.ArgumentParser, run: Callable, defaults: dict, name: str) -> None:
    """Parses the arguments, creates the session, runs the job and stops the session."""
    args = vars(make.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    given = settings(args.pop("config"), defaults)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, settings=given, **args)
    finally:
        spark.stop()
