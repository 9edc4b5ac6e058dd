import duckdb
from pyspark.sql import functions as F

from latentfield.llm.mixing import mix, mixed_rows, n_words
from latentfield.llm.queries import MIX_SQL, op3_source_mixing


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({MIX_SQL}) ORDER BY ALL").fetchall()
    got = sorted(tuple(r) for r in op3_source_mixing(spark, sf).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == want


def test_water_filling_clamps_and_reshares(spark):
    sizes = {"a": 10, "b": 100, "c": 1000, "d": 400, None: 490}
    rows = [(k * 10_000 + i, "w " * 5, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n // 5)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumn("taken", F.col("size") * F.col("repeats"))
    per = {r.source_size: r for r in got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("repeats")).alias("most")).collect()}
    total, weights = 2000, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    target, full = {}, set()
    while True:  # clamp, reshare, again
        rest = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * n if s in full else rest * weights[s] / sum(weights[x] for x in sizes if x not in full) for s, n in sizes.items()}
        over = {s for s in sizes if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s, n in sizes.items():
        assert abs(per[n].target - target[s]) < 1e-6 and abs(per[n].taken - target[s]) <= 5 and per[n].most <= 3


def test_rows_without_words_are_never_taken_too_often(spark):
    rows = [(i, "w w" if i % 4 == 0 else " ", "small") for i in range(400)] + [(1000 + i, "w " * 50, "large") for i in range(400)] + [(5000 + i, None, "wordless") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.max("repeats").alias("most"), F.max("target").alias("target")).collect()
    most = {r.source: (r.most, r.target) for r in got}
    assert most["wordless"] == (0, 0.0) and most["small"][0] == 3 and most["large"][0] <= 3
    assert mixed_rows(docs).where("source = 'wordless'").count() == 0
    assert mixed_rows(docs).groupBy("doc_id").count().where("count > 3").count() == 0


def test_reruns_agree(docs):
    assert mix(docs).orderBy("doc_id").collect() == mix(docs.repartition(7)).orderBy("doc_id").collect()


def test_words(spark):
    texts = ["", " a", "a\tb\x0b\x0c\r\nc ", " x y", None]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(n_words(F.col("t")).alias("n")).collect()]
    assert got == [0, 1, 3, 1, 0]


def test_odd_rows(odd, none):
    got = mix(odd).collect()
    assert len(got) == odd.count() and mix(none).count() == 0
    assert {r["size"] for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert len({r.repeats for r in got if r.doc_id == 7}) == 1
    rows = mixed_rows(odd)
    assert rows.columns == odd.columns and rows.count() == sum(r.repeats for r in got) and mixed_rows(none).count() == 0


def test_native_plan(docs):
    plan = mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
