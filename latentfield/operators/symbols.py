"""Symbol and import graphs of a source tree, and distances over them (GRA1-2, GRA4-6, JN6, JN11-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .fields import signal_rows
from ..plans.staging import staged
from .graphs import mean_distances, undirected

#: In this order a specifier's candidates are tried, for each: with its extension replaced, added, and as a folder's index.
RESOLVED = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def declarations(lexed: DataFrame) -> DataFrame:
    """(symbol, name, ref): declared names in lower case with every name within them."""
    d = lexed.select(F.explode("declarations").alias("d"))
    return d.select(F.lower("d.name").alias("symbol"), F.col("d.name").alias("name"), F.explode_outer("d.refs").alias("ref")).withColumn("ref", F.lower("ref"))


def symbol_graph(lexed: DataFrame) -> DataFrame:
    """GRA2, JN11: undirected edges between defined symbols."""
    d = staged(declarations(lexed).select("symbol", "ref"), "declarations")  # read twice, lexed once
    defined = d.select(F.col("symbol").alias("dst")).distinct()
    return undirected(d.where("ref IS NOT NULL").select(F.col("symbol").alias("src"), F.col("ref").alias("dst")).distinct().join(defined, "dst", "left_semi"))


def symbol_tokens(lexed: DataFrame) -> DataFrame:
    """(symbol, space, token) that signals can match, of one spelling of each symbol."""
    names = declarations(lexed).groupBy("symbol").agg(F.min("name").alias("name"))
    return names.select("symbol", F.explode(S.identifier_tokens(F.col("name"))).alias("t")).select("symbol", "t.space", "t.token")


def capability_symbols(capabilities: DataFrame, lexed: DataFrame) -> DataFrame:
    """JN6: (owner, node): the symbols that a capability's signals match."""
    return signal_rows(capabilities).join(symbol_tokens(lexed), ["space", "token"]).select(F.col("capability").alias("owner"), F.col("symbol").alias("node")).distinct()


def symbol_distance(capabilities: DataFrame, lexed: DataFrame) -> DataFrame:
    """GRA4, AGG18: (owner, distance) for owners of two symbols or more."""
    members = capability_symbols(capabilities, lexed)
    return mean_distances(members, symbol_graph(lexed)).where("n_nodes >= 2").select("owner", "distance")


def resolution_index(files: DataFrame) -> DataFrame:
    """(key, slot, i, target): each file once under every name that can stand for it: its path, that without its extension, and as the index of its folder. files: path.

    i is the extension's place in RESOLVED. Of paths that differ in case alone the last counts.
    """
    path = S.plain_path(F.col("path"))

    def without(end: str, slot: str, i: int) -> F.Column:
        return F.when(F.endswith(path, F.lit(end)), F.struct(F.substring(path, F.lit(1), F.length(path) - len(end)).alias("key"), F.lit(slot).alias("slot"), F.lit(i).alias("i")))

    names = [F.struct(path.alias("key"), F.lit("exact").alias("slot"), F.lit(0).alias("i")), without(".py", "module", 0), without("/__init__.py", "package", 1)]
    names += [x for i, e in enumerate(RESOLVED) for x in (without(e, "plain", i), without(f"/index{e}", "index", i))]
    return files.select("path", F.explode(F.array_compact(F.array(*names))).alias("n")).groupBy("n.key", "n.slot", "n.i").agg(F.max("path").alias("target"))


def ordinal() -> F.Column:
    """JN12, JN13: the place at which a name of the index is tried for a specifier's key, null if it isn't. A script's are: the base itself, then for each extension the stem
    with it, the base with it, and the base as its folder; Python's the module, then the package."""
    role, slot, i = F.col("role"), F.col("slot"), F.col("i")
    base = F.when(slot == "exact", 0).when(slot == "plain", F.when(role == "both", 1 + 3 * i).otherwise(2 + 3 * i)).when(slot == "index", 3 + 3 * i)
    return F.when(role == "python", F.when(slot.isin("module", "package"), i)).when(role == "stem", F.when(slot == "plain", 1 + 3 * i)).otherwise(base)


def import_graph(lexed: DataFrame) -> DataFrame:
    """GRA1: undirected edges between files. A specifier is looked up by its base and its stem, at most two rows, and of the files there the one that is tried first counts (WIN8)."""
    lexed = staged(lexed.select("path", "ext", "imports"), "imports")  # read twice, lexed once
    folder = F.regexp_replace("path", r"[^/]*$", "")
    up = F.repeat(F.lit("../"), F.greatest(F.lit(0), F.col("i.dots") - 1))
    specs = lexed.select("path", "ext", F.explode("imports").alias("i")).where("ext = '.py' OR startswith(i.spec, '.')")  # FLT11
    based = specs.select("path", "ext", F.col("i.spec").alias("spec"), S.plain_path(F.concat(folder, up, "i.spec")).alias("base"))
    stem = F.regexp_replace(F.col("base"), r"(?<=[^/])\.[^./]*$", "")

    def look(role: str, key: F.Column) -> F.Column:
        return F.struct(F.lit(role).alias("role"), key.alias("key"))

    looks = F.when(F.col("ext") == ".py", F.array(look("python", F.col("base")))).when(stem == F.col("base"), F.array(look("both", F.col("base")))).otherwise(F.array(look("base", F.col("base")), look("stem", stem)))
    asked = based.select("path", "spec", "base", F.explode(looks).alias("l")).select("path", "spec", "base", "l.*")
    met = asked.join(resolution_index(lexed.select("path")), "key").withColumn("k", ordinal()).where("k IS NOT NULL")
    found = met.groupBy("path", "spec", "base").agg(F.min_by("target", "k").alias("target"))
    return undirected(found.select(F.col("path").alias("src"), F.col("target").alias("dst")))


def file_distance(members: DataFrame, edges: DataFrame) -> DataFrame:
    """GRA5: (owner, distance) over an owner's files; one file gives 0, no file no row."""
    return mean_distances(members, edges).select("owner", "distance")


def integration(capabilities: DataFrame, evidence: DataFrame, lexed: DataFrame) -> DataFrame:
    """GRA6: (capability, integration_distance): over symbols, and over files where fewer than two symbols match. evidence: capability, files."""
    by_symbol = symbol_distance(capabilities, lexed).withColumnRenamed("distance", "by_symbol")
    files = evidence.select(F.col("capability").alias("owner"), F.explode("files").alias("node"))
    by_file = file_distance(files.join(by_symbol, "owner", "left_anti"), import_graph(lexed)).withColumnRenamed("distance", "by_file")
    return capabilities.select(F.col("id").alias("owner")).join(by_symbol, "owner", "left").join(by_file, "owner", "left").select(F.col("owner").alias("capability"), F.coalesce("by_symbol", "by_file").alias("integration_distance"))
