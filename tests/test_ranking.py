"""Places over whole tables: equal to a sort, from partitions of their own."""

import re

import pytest
from pyspark.sql import functions as F

from latentfield.operators.presentation import by_members
from latentfield.operators.ranking import numbered
from latentfield.operators.readings import ranked


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_equal_a_sort(spark):
    rows = [(k, float(k * 7919 % 13), None if k % 11 == 0 else f"n{k % 3}") for k in range(5000)]
    df = spark.createDataFrame(rows, "ord int, score double, name string")
    got = {r.ord: r.place for r in numbered(df, F.desc("score"), "ord", name="place").collect()}
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert got == want
    by_name = {r.ord: r.rank for r in numbered(df, "score", F.desc("ord"), per="name", first=0).collect()}
    for name in (None, "n0", "n1", "n2"):
        own = sorted((r for r in rows if r[2] == name), key=lambda r: (r[1], -r[0]))
        assert [by_name[r[0]] for r in own] == list(range(len(own)))


def test_no_rows_and_one_value(spark):
    none = spark.createDataFrame([], "ord int, score double")
    assert numbered(none, "score", "ord").count() == 0 and numbered(none, "ord", per="score").count() == 0
    same = spark.range(3000).select(F.col("id").alias("ord"), F.lit(0.0).alias("score"))
    assert sorted(r.rank for r in numbered(same, F.desc("score"), "ord").collect()) == list(range(1, 3001))


def test_one_value_is_spread_over_ranges(spark):
    """A tie over a whole table doesn't meet in one task: the key behind it divides it."""
    same = spark.range(40_000).select(F.col("id").alias("ord"), F.lit(0.0).alias("score"), F.lit(0).alias("config_id"))
    most = ranked(same).withColumn("task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0]
    assert most <= 20_000


@pytest.mark.parametrize("make", [ranked, by_members])
def test_no_window_holds_the_table(spark, make):
    df = spark.createDataFrame([(0, k, 0.5, 3, "x") for k in range(20)], "config_id int, ord int, score double, n_members int, id string")
    text = plan(make(df))
    assert "Window" not in text and not re.search("SinglePartition", text)
