"""The module map: what code defines and how its modules depend on each other (PIP8, JN14, JN18, FLT8-10, AGG15-17, SRT5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lexers import import_specs
from ..plans.staging import staged

#: FLT8: paths of tests.
TEST_FOLDER, TEST_NAMES = r"(^|[\\/])tests?[\\/]", (r"^test_", r"_test\.\w+$", r"^conftest\.")


def is_test(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^\\/]*)$", 1)
    found = path.rlike(TEST_FOLDER)
    for pattern in TEST_NAMES:
        found = found | name.rlike(pattern)
    return found


def imported(files: DataFrame) -> DataFrame:
    """LEX9, JN14: (path, target): the files that each file's import lines name; a module, else the package that holds the name."""
    named = files.select("path", S.module_name(F.col("path")).alias("module"))
    index = named.groupBy("module").agg(F.max("path").alias("target"))  # AGG16: the last path of a name, as walks are in order
    specs = files.select("path", S.module_name(F.col("path")).alias("importer"), F.explode(import_specs(F.col("text"))).alias("spec"))
    wanted = specs.select("path", S.absolute_module(F.col("spec"), F.col("importer")).alias("module")).distinct().withColumn("parent", S.parent_module(F.col("module")))
    exact, above = index, index.select(F.col("module").alias("parent"), F.col("target").alias("above"))
    return wanted.join(exact, "module", "left").join(above, "parent", "left").select("path", F.coalesce("target", "above").alias("target")).where("target IS NOT NULL AND target <> path").distinct()


def module_map(files: DataFrame) -> DataFrame:
    """path, module, n_defs, defs, in_degree, out_degree of every module that isn't a test and has any of them (FLT9). files: path, text, definitions."""
    code = staged(files.where(~is_test(F.col("path"))).select("path", "text", "definitions"), "modules")  # read many times, lexed once
    links = staged(imported(code), "module-links")
    out = links.groupBy("path").agg(F.count("*").alias("out_degree"))
    into = links.groupBy(F.col("target").alias("path")).agg(F.count("*").alias("in_degree"))
    return (
        code.select("path", S.module_name(F.col("path")).alias("module"), F.col("definitions").alias("defs"), F.size("definitions").cast("long").alias("n_defs"))
        .join(out, "path", "left")
        .join(into, "path", "left")
        .withColumns({"out_degree": F.coalesce("out_degree", F.lit(0)), "in_degree": F.coalesce("in_degree", F.lit(0))})
        .where("n_defs > 0 OR out_degree > 0 OR in_degree > 0")
    )


def roles(modules: DataFrame) -> DataFrame:
    """FLT10: whether a module is a foundation, a surface, rich but little used, or isolated."""
    return modules.withColumns({
        "is_foundation": F.col("in_degree") >= 2,
        "is_surface": (F.col("in_degree") == 0) & (F.col("out_degree") >= 2) & (F.col("n_defs") > 0),
        "is_rich": (F.col("n_defs") >= 5) & (F.col("in_degree") <= 1) & (F.col("out_degree") <= 1),
        "is_isolated": (F.col("in_degree") == 0) & (F.col("out_degree") == 0) & (F.col("n_defs") > 0),
    })


def totals(files: DataFrame, modules: DataFrame) -> DataFrame:
    """AGG15, AGG17: modules, links, definitions and tests set aside, in one row."""
    tests = files.agg(F.count_if(is_test(F.col("path"))).alias("n_tests"))
    return modules.agg(F.count("*").alias("n_modules"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("n_links"), F.coalesce(F.sum("n_defs"), F.lit(0)).alias("n_definitions")).crossJoin(F.broadcast(tests))  # one row
