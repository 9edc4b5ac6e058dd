"""The command line: python -m latentfield.plans.cli scan|discover|map|reflect|serve|experiment [...]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from ..operators.presentation import printed_designs
from ..sources.inputs import as_json, write_report
from . import pipelines

OUT = ".latentfield"


def arguments(argv: list[str]) -> argparse.Namespace:
    """SCL34."""
    parser = argparse.ArgumentParser(prog="latentfield")
    parser.add_argument("command", choices=("scan", "discover", "map", "reflect", "serve", "experiment"))
    parser.add_argument("step", nargs="?", choices=("baseline", "compare"))
    parser.add_argument("--repo", default=".")
    parser.add_argument("--data", default="data")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--top", type=int)
    parser.add_argument("--level", type=int, default=2)
    parser.add_argument("--port", type=int, default=4317)
    parser.add_argument("--out", default=OUT)
    return parser.parse_args(argv)


SCAN = ("rank", "capability", "correction", "capacity", "utilization", "known", "score", "collapse_potential", "confidence", "integration_distance", "integration", "category")
SHOWN = {
    "scan": SCAN,
    "discover": (*SCAN, "signals", "member_ids"),
    "map": ("module", "n_defs", "in_degree", "out_degree", "is_foundation", "is_surface", "is_rich", "is_isolated"),
    "reflect": ("capability", "baseline_cp", "candidate_share"),
}


def show(df: DataFrame, columns: tuple[str, ...] | None, top: int) -> None:
    """LIM1, SNK5: the first rows as a table. Only these come to the driver."""
    wanted = [c for c in columns if c in df.columns] if columns else df.columns
    df.select(*wanted).limit(top).show(top, truncate=60)


def emit(df: DataFrame) -> None:
    for row in as_json(df).toLocalIterator():
        print(row.json)


def main(argv: list[str] | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("latentfield").getOrCreate()
    top = a.top or (8 if a.command == "map" else 10)
    try:
        if a.command == "scan" or a.command == "discover":
            found = (pipelines.scan if a.command == "scan" else pipelines.discover)(spark, a.repo, a.data)
            path = f"{a.out}/last-{'report' if a.command == 'scan' else 'discovery'}"
            write_report(found, path)
            found = spark.read.schema(found.schema).json(path).orderBy("rank")
            emit(found) if a.json else show(found, SHOWN[a.command], top)
        elif a.command == "map":
            found, totals = pipelines.code_map(spark, a.repo)
            if a.json:
                emit(found)
            else:
                totals.show()
                for role in ("is_foundation", "is_surface", "is_rich", "is_isolated"):
                    print(role)
                    show(found.where(role), SHOWN["map"], 12 if role == "is_isolated" and not a.top else top)
        elif a.command == "reflect":
            found = pipelines.reflect(spark, a.repo, a.data, a.level)
            emit(found) if a.json else show(printed_designs(found) if a.level == 3 else found, None, top)
        elif a.command == "serve":
            from .server import serve

            serve(spark, a.repo, a.data, a.port)
        elif a.step == "baseline":
            pipelines.save_baseline(spark, a.repo, a.data, f"{a.out}/baseline")
        elif a.step == "compare":
            show(pipelines.compare(spark, a.repo, a.data, f"{a.out}/baseline"), None, top)
        else:
            print("give baseline or compare", file=sys.stderr)
            return 2
    except pipelines.NoInput as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
