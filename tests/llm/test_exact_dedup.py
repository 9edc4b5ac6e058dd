import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from latentfield.llm import exact_dedup as E
from latentfield.llm.queries import ORACLE_SQL, QUERIES


def brute(rows):
    """Result rows for (doc_id, text) pairs, as a sorted list of tuples."""
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k, i))
    out = []
    for text, own in groups.items():
        best = min(own)
        out += [(x[4], best[4], len(own), x is best, hashlib.sha256(text.encode()).hexdigest()) for x in sorted(own)]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    """Texts of 0 to 40 blocks, many alike but for one place, with copies that differ in white space alone."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé") for _ in range(n)) for n in (1, 7, 8, 9, 16, 63, 64, 65, 300)]
    texts = list(base)
    for t in base:
        for at in (0, len(t) // 2, len(t) - 1):
            texts.append(t[:at] + "x" + t[at + 1 :])
        texts += [t + "a", t[:-1], t * 2]
    out = []
    for t in texts:
        for _ in range(rng.choice([1, 1, 2, 5])):
            out.append("".join(c + rng.choice(["", "", " ", "\n", "\x0b\t", " " if rng.random() < 0.02 else ""]) for c in t))
    out += ["hot" * 30] * 700 + [None, "", " \r\n", "\x0c"]
    return [(k, t) for k, t in enumerate(out)] + [(None, base[3]), (None, None), (3, out[3]), (3, out[3]), (4, out[3])]


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_equals_brute_force(spark, rows, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS name", "3 AS i", "4 AS m")
    assert result(E.exact_duplicates(df)) == brute(rows)


def test_no_step_trusts_a_hash(spark, rows, monkeypatch):
    """With addresses of which each holds many blocks, names still tell all texts apart."""
    monkeypatch.setattr(E, "BLOCK", 8)
    monkeypatch.setattr(E, "address", lambda b: (F.pmod(F.xxhash64(b), F.lit(5)), F.octet_length(b).cast("long")))
    assert result(E.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert result(E.exact_duplicates(odd)) == brute(rows)
    assert E.exact_duplicates(none).count() == 0
    left = E.without_copies(odd)
    assert left.columns == odd.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(kept(rows), key=repr)
    assert E.without_copies(none).count() == 0


def kept(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    return [rows[min(own)[3]] for own in groups.values()]


def test_hot_copies_are_dealt_out(spark):
    """10,000 copies of one text are no more than a few hundred rows in any part."""
    rows = spark.range(10_000).select(F.col("id").alias("row"), F.lit(0).alias("i"), F.lit(3).alias("a"))
    names = spark.createDataFrame([(3, 10_000, 77)], "a int, m long, name long")
    dealt = E.given_back(rows, names, ["a"])
    assert dealt.count() == 10_000 and dealt.where("name = 77").count() == 10_000
    assert "part" in dealt._jdf.queryExecution().optimizedPlan().toString()


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = QUERIES["op11_exact_dedup"](spark, sf)
    want = con.execute(ORACLE_SQL["op11_exact_dedup"])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
    assert got.where("NOT kept").count() > 0
