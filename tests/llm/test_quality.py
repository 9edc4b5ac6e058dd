import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from latentfield.llm import quality
from latentfield.llm.quality import FEATURES, Trees, grow, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    windows = list(zip(w, w[1:], w[2:]))
    n = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_counts_equal_brute_force(spark, docs, odd):
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    extra = spark.createDataFrame([(90_000, "a b c a b c\n\n a b c\na b c x\x1fy\x85z\xa0w v\r\na b c")], "doc_id long, text string")
    rows = rows.union(extra)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = Counter((r.doc_id, *(r[c] for c in names)) for r in quality.with_statistics(rows).collect())
    assert got == Counter((r.doc_id, *brute(r.text)) for r in rows.collect())


def test_base_rules_and_verdict(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_rules(spark, docs, labels).collect()
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    kept = {r.doc_id for r in got if r.kept}
    passed = {r.doc_id for r in got if not r.base_failed}
    assert len(good & kept) >= 0.98 * len(good & passed) and len(bad & kept) <= 0.2 * len(bad)
    assert {r.doc_id for r in quality.passing(docs, quality.train(docs, labels)).collect()} == kept


def test_scores_follow_the_constraints():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + rng.normal(0, 0.2, 3000)) < 0.5).astype(float)
    t = grow(x, y, directions=(-1, 0, 1))
    probe = rng.random((200, 3))
    for j, sign in ((0, -1), (2, 1)):
        line = np.repeat(probe, 30, axis=0)
        line[:, j] = np.tile(np.linspace(0, 1, 30), 200)
        steps = np.diff(t.scores(line).reshape(200, 30), axis=1)
        assert (sign * steps >= -1e-12).all()
    assert ((t.scores(x) > 0) == (y > 0)).mean() > 0.8


def test_flat_trees_equal_a_walk_by_hand():
    rng = np.random.default_rng(4)
    x = rng.random((500, 2))
    t: Trees = grow(x, (x[:, 0] > x[:, 1]).astype(float), trees=5)

    def walk(row):
        total = t.base
        for k in t.roots:
            while t.left[k] != k:
                k = t.left[k] if row[t.feature[k]] <= t.threshold[k] else t.right[k]
            total += t.value[k]
        return total

    assert np.allclose(t.scores(x), [walk(r) for r in x])


def test_held_out_labels(docs, spark):
    """Fitted on small-scale labels, right on documents it hasn't seen."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    all_ = spark.read.parquet(f"{sf}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    model = quality.train(all_, labels.where(~fold))
    got = quality.judged(all_, model).join(labels.where(fold), "doc_id").where("NOT base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in got) >= 0.97 * len(got)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(9)] + [(None, 1, 1), (3, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(FEATURES) == 10
    got = quality_rules(spark, odd, labels).collect()
    assert len(got) == odd.count() and all(r.kept == (not r.base_failed) for r in got)
    assert quality_rules(spark, none, labels).count() == 0 and quality_rules(spark, odd, labels.where("false")).count() == odd.count()
    assert quality.passing(odd, quality.EMPTY).columns == odd.columns
