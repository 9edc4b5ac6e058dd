"""Large JSON arrays of objects, read in as many tasks as the file has splits (SRC1).

Spark's text reader cuts a file at every closing brace, which it can do in all splits at once. Each piece is then told, for both
cases of how it may begin (within a string or not), how many quotes and brackets it holds; sums within each split, and over
the few splits of a file, tell which case holds and how deep it lies. A brace that leads back to the array's own depth ends a record.

A file is taken in this way only if it is an array of objects as a whole: what stands between records is one comma, each record is JSON by itself,
and no byte is left over. Any other file is left to the caller, who reads it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import discard, staged

#: What JSON takes for space between tokens.
SPACE = r"[\x20\t\r\n]*"


def struct_type(schema: str) -> str:
    return "struct<" + ", ".join("{}: {}".format(*x.split(" ", 1)) for x in schema.split(", ")) + ">"


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between closing braces, in order of `at` within a split (file, block), with quotes and depth for both ways to begin."""
    read = spark.read.option("lineSep", "}").text(path).select("_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size", "value", F.monotonically_increasing_id().alias("at"))
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # a piece begins behind a brace, never behind a backslash
    string = F.lit(r'"[^"]*("|$)')
    outside = F.regexp_replace(plain, string, F.lit(""))
    inside = F.regexp_replace(F.regexp_replace(plain, r'^[^"]*("|$)', ""), string, F.lit(""))
    rise = {"rise_out": count_of(outside, "[{") - count_of(outside, "]"), "rise_in": count_of(inside, "[{") - count_of(inside, "]")}
    return read.select(F.col("file_path").alias("file"), F.col("file_block_start").alias("block"), F.col("file_size").alias("size"), "at", "value", (count_of(plain, '"') % 2).alias("quotes"), *(c.alias(k) for k, c in rise.items()))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, n, good and r (the fields of schema) for each record of each file under path; n is the record's place. The rest of a file behind its last record is one row more, without r."""
    before = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    so_far = before.rowsBetween(Window.unboundedPreceding, 0)
    # within the split, as if it began outside of a string; if it begins inside, all pieces are the other way round
    told = pieces(spark, path).withColumn("start", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    end = (F.col("start") + F.col("quotes")) % 2
    told = told.withColumns({
        "end": end,
        "fall_0": F.when(F.col("start") == 0, F.col("rise_out")).otherwise(F.col("rise_in")) - (1 - end),
        "fall_1": F.when(F.col("start") == 0, F.col("rise_in")).otherwise(F.col("rise_out")) - end,
    })
    told = told.withColumns({f"depth_{k}": F.sum(f"fall_{k}").over(so_far) for k in (0, 1)})
    told = staged(told.select("file", "block", "size", "at", "value", "quotes", "end", "fall_0", "fall_1", "depth_0", "depth_1"), "json-pieces")
    # one row a split
    splits = told.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum("fall_0").alias("fall_0"), F.sum("fall_1").alias("fall_1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("flip", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("base", F.coalesce(F.sum(F.when(F.col("flip") == 0, F.col("fall_0")).otherwise(F.col("fall_1"))).over(earlier), F.lit(0)))
    depth = F.col("base") + F.when(F.col("flip") == 0, F.col("depth_0")).otherwise(F.col("depth_1"))
    placed = told.join(splits.select("file", "block", "flip", "base"), ["file", "block"])
    placed = placed.select("file", "block", "size", "at", "value", (((F.col("end") + F.col("flip")) % 2 == 0) & (depth == 1)).cast("int").alias("ends"))
    counts = placed.groupBy("file", "block").agg(F.sum("ends").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    numbered = placed.withColumn("n", F.coalesce(F.sum("ends").over(before), F.lit(0))).join(counts, ["file", "block"]).withColumn("n", F.col("n") + F.col("first"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda p: p["value"])
    whole = numbered.groupBy("file", "n").agg(F.array_join(parts, "}").alias("text"), F.max("ends").alias("ends"), F.max("size").alias("size"))
    lead = F.when(F.col("n") == 0, F.lit(r"\[")).otherwise(F.lit(","))
    begins = F.regexp_like("text", F.concat(F.lit(f"^{SPACE}"), lead, F.lit(SPACE + r"\{")))
    body = F.concat(F.regexp_replace("text", f"^{SPACE}[\\[,]{SPACE}", ""), F.lit("}"))
    is_record = F.col("ends") == 1
    good = F.when(is_record, begins & F.try_parse_json(body).isNotNull()).otherwise(F.regexp_like("text", F.lit(f"^{SPACE}\\]{SPACE}$")) & (F.col("n") > 0))
    size = F.octet_length("text") + F.col("ends")
    out = whole.select("file", "n", good.alias("good"), size.alias("bytes"), "size", F.when(is_record, F.from_json(body, struct_type(schema))).alias("r"))
    out = staged(out, "json-records")
    discard(told)
    return out


def split_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, list[str]]:
    """(file, ord and the fields of schema) of each object in the arrays under path, and the files that aren't such arrays as a whole."""
    found = records(spark, path, schema)
    # a rest must be there, once, and all bytes accounted for
    whole = F.bool_and("good") & (F.count_if(F.col("r").isNull()) == 1) & (F.sum("bytes") == F.max("size"))
    checked = found.groupBy("file").agg(F.coalesce(whole, F.lit(False)).alias("whole"))
    other = [x.file for x in checked.where("NOT whole").collect()]  # file names alone
    taken = found.where(F.col("r").isNotNull())
    if other:
        taken = taken.join(checked.where("NOT whole"), "file", "left_anti")
    return taken.select("file", F.col("n").cast("int").alias("ord"), "r.*"), other
