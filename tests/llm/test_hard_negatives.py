import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from latentfield.llm import hard_negatives as H
from latentfield.llm.queries import ORACLE_SQL, QUERIES, op12_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, is_anchor boolean"


def brute(rows, positives=5, negatives=10):
    good = [(i, [math.floor(256 * x) for x in e], lab, a) for i, e, lab, a in rows if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for k, (i, e, lab, anchor) in enumerate(good):
        if anchor:
            scored = [(-sum(p * q for p, q in zip(e, f)), j, m) for n, (j, f, m, _) in enumerate(good) if n != k and len(e) == len(f)]
            for p, j, _ in sorted(x for x in scored if x[2] == lab)[:positives]:
                fits = sorted(x for x in scored if x[2] != lab and 30 * -p <= 100 * -x[0] <= 90 * -p)[:negatives]
                out += [(i, j, n, x[1], -p, -x[0]) for n, x in enumerate(fits, 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = []
    for c in range(30):
        centre = rng.standard_normal(12)
        for _ in range(25):
            v = centre * rng.choice([0.3, 1, 2]) + rng.normal(0, rng.choice([0.1, 0.5]), 12)
            out.append((len(out), [float(x) for x in v], int(rng.integers(0, 4)), bool(rng.random() < 0.08)))
    hot = out[7][1]
    out += [(len(out) + k, hot, k % 3, k % 97 == 0) for k in range(400)]
    n = len(out)
    odd = [(None, hot, 1, True), (n, None, 1, True), (n + 1, hot, None, True), (n + 2, [1.0, None], 1, True), (n + 3, [float("nan")] * 12, 1, True), (n + 4, [float("inf")] * 12, 1, False)]
    odd += [(n + 5, [0.0] * 12, 1, True), (n + 6, [], 1, True), (n + 7, [], 2, False), (n + 8, [], 1, False), (n + 9, [1.0, 2.0], 0, True), (n + 10, [2.0, 4.0], 0, None), (n + 11, [1.0, 1.0], 1, False)]
    return out + odd + [out[3], out[3], (out[3][0], out[9][1], 2, True), (-5, hot, 1, True)]


@pytest.mark.parametrize(("group", "chunk", "pivots"), [(2048, 4 << 20, 128), (5, 1 << 14, 16), (1, 1 << 12, 3)])
def test_equals_brute_force(spark, rows, monkeypatch, group, chunk, pivots):
    monkeypatch.setattr(H, "GROUP", group)
    monkeypatch.setattr(H, "CHUNK", chunk)
    monkeypatch.setattr(H, "PIVOTS", pivots)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row", "2 AS cell", "3 AS data", "4 AS grp", "5 AS rank")
    assert result(H.hard_negatives(df)) == brute(rows)


def test_bounds_spare_far_cells(spark, monkeypatch):
    """Clusters far from each other: a group is sent a part of the rows, and results stay exact."""
    monkeypatch.setattr(H, "GROUP", 4)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 8)) * 3
    rows = [(k, [float(x) for x in centres[k % 20] + rng.normal(0, 0.05, 8)], k // 20 % 2, k % 25 == 0) for k in range(1500)]
    moved = []
    plain = H.compared

    def counting(copies, ends, take, schema):
        moved.append((copies.count(), ends.select("grp").distinct().count()))
        return plain(copies, ends, take, schema)

    monkeypatch.setattr(H, "compared", counting)
    assert result(H.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    (first, groups), (second, more) = moved
    assert first < 0.25 * 750 * groups and second < 0.75 * 1500 * more


def test_large_components(spark):
    """Scores beyond what doubles hold exactly, and beyond longs."""
    rng = np.random.default_rng(1)
    for size in (4e5, 1e5, 2e3):
        rows = [(k, [float(x) for x in rng.integers(-10, 10, 6) * size + rng.integers(0, 9, 6)], k % 2, k % 10 == 0) for k in range(120)]
        assert result(H.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    with pytest.raises(Exception, match="too large"):
        H.hard_negatives(spark.createDataFrame([(0, [1e300], 0, True)], SCHEMA))


def test_empty_tables_and_no_anchors(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for none in (df.where("false"), df.withColumn("is_anchor", F.lit(False)), df.withColumn("label", F.lit(None).cast("int"))):
        assert H.hard_negatives(none).count() == 0
    one = df.withColumn("label", F.lit(1))
    assert H.hard_negatives(one).count() == 0


def test_labels_are_text_too(spark, rows):
    named = [(i, e, None if lab is None else "ab/"[lab % 3] * (lab + 1), a) for i, e, lab, a in rows]
    assert result(H.hard_negatives(spark.createDataFrame(named, SCHEMA.replace("label int", "label string")))) == brute(named)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = QUERIES["op12_hard_negatives"](spark, sf)
    want = con.execute(ORACLE_SQL["op12_hard_negatives"])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
    assert got.count() > 0 and op12_hard_negatives is QUERIES["op12_hard_negatives"]
