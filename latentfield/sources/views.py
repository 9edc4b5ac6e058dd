"""The model's tables as views of a warehouse: capabilities, files, events of demand and use, graphs.

Keys are the items of `benchmark`; demand comes from `events`, use from `lineitem`, text from `documents`,
`pages` and `conversations`, and the graph from suppliers that share an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexers import text_tokens
from ..operators.readings import config
from ..plans.staging import spread

#: So many keys take events and use.
KEYS = 40
#: Scales that fit these tables.
C_HALF, K_HALF, U_HALF, PRIOR = 150.0, 5.0, 30.0, 0.5
SIGNALS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files. A stream reads folders, so of a table that is one file its folder is read, and in it that name alone."""
    path = f"{sf_dir}/{name}.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return reader.parquet(path) if is_folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with its longest words as signals."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)))
    longest = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, SIGNALS)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("item_id").cast("string").alias("id"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("label"), F.transform(longest, lambda x: x["w"]).alias("signals"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("path"), "text")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts dealt out evenly: a file of short rows makes many files of a tree, each of which is lexed or written in Python. Up to a GB that costs far more than dealing them out."""
    return spread(table(spark, sf_dir, "part"), 1 << 30)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_tokens(files(spark, sf_dir))


def uneven(a: Column, b: Column) -> Column:
    """A key from two numbers: small keys are common, large ones rare, and the last has nothing."""
    return F.floor((a % KEYS) * (b % KEYS) / KEYS).cast("int")


def as_corrections(events: DataFrame) -> DataFrame:
    """Events as signals of demand: kind by type; heat has no destination; most users pull one way."""
    k = uneven(F.regexp_extract("props", r'"k": (\d+)', 1).cast("int"), F.col("event_id"))
    kind = F.expr("CASE event_type WHEN 'click' THEN 'correction' WHEN 'signup' THEN 'request' WHEN 'purchase' THEN 'repetition' WHEN 'view' THEN 'retry' ELSE 'abandonment' END")
    heat = F.col("event_type").isin("view", "error")
    way = F.when(F.col("user_id") % 10 < 7, F.lit("0")).otherwise((F.col("user_id") % 10).cast("string"))
    return events.select("ts", k.alias("k"), kind.alias("kind"), F.lit(None).cast("double").alias("weight"), F.when(~heat, F.lit("done")).alias("after"), F.array(way).alias("direction")).withColumn("capability", F.col("k").cast("string"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_corrections(table(spark, sf_dir, "events"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fiftieth of a use for each line, large keys being common; some keys are never observed."""
    return table(spark, sf_dir, "lineitem").select((KEYS - 1 - uneven(F.col("l_partkey"), F.col("l_suppkey"))).cast("string").alias("capability"), F.lit(0.02).alias("count"))


def scales(spark: SparkSession) -> DataFrame:
    return config(spark, C_HALF, K_HALF, U_HALF, PRIOR)


def turns(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """Turns of conversations as texts of events."""
    return table(spark, sf_dir, "conversations").where(F.col("role") == role).select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("after"))


def supplier_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) of all suppliers that share an order, in both directions.

    Orders are dealt out by ranges of their keys, and neighbours are merged as bits, 64 suppliers to a row, before they are shuffled: orders near each other
    repeat the same pairs.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").where("l_orderkey IS NOT NULL AND l_suppkey IS NOT NULL")
    orders = lines.repartitionByRange("l_orderkey").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s")).where("size(s) > 1")
    pairs = orders.select("s", F.explode("s").alias("src")).select("src", F.explode("s").alias("dst")).where("src <> dst")
    sets = pairs.groupBy("src", F.shiftright("dst", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(dst & 63 AS int))")).alias("bits"))
    at = F.explode(F.expr("filter(sequence(0, 63), i -> getbit(bits, i) = 1)"))
    return sets.select("src", "block", at.alias("i")).select("src", (F.shiftleft("block", 6) + F.col("i")).alias("dst"))


def half(events: DataFrame, later: bool) -> DataFrame:
    middle = F.lit("2024-01-16").cast("date")
    day: Column = F.to_date("ts")
    return events.where(day >= middle if later else day < middle)


MODEL = {"capabilities": capabilities, "files": files, "tokens": tokens, "corrections": corrections, "usage": usage, "supplier_links": supplier_links}


def register(spark: SparkSession, sf_dir: str) -> None:
    """The model's tables as temporary views, for SQL."""
    for name, view in MODEL.items():
        view(spark, sf_dir).createOrReplaceTempView(name)
