import re
from collections import Counter

import numpy as np

from latentfield.llm import jaccard_join as module
from latentfield.llm.jaccard_join import CountTree, beside, count_vector, dealt_out, jaccard_join, least_overlap, representatives
from latentfield.llm.shingles import BLOCK, pieces, shingle_set, text_words, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sets(rows):
    out = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute(rows):
    s = sets(rows)
    at = {d: d for d in s}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    holders = {}
    for d in s:
        for x in s[d]:
            holders.setdefault(x, []).append(d)
    for d in s:
        for e, n in Counter(e for x in s[d] for e in holders[x] if e > d).items():
            if 100 * n >= 80 * (len(s[d]) + len(s[e]) - n):
                u, v = sorted((top(d), top(e)))
                at[v] = u
    return {d: (len(s[d]), top(d)) for d in s}


def test_equals_brute_force(spark, docs):
    # chains of near copies, on top of those in the table: each step changes one word more
    base = [f"c{k}" for k in range(60)]
    more = [(10_000 + k, " ".join(f"x{j}" if j < k else w for j, w in enumerate(base))) for k in range(12)]
    more += [(10_100, "One two"), (10_101, "one  TWO\n"), (10_102, "one two three"), (10_103, "ÉA b c d e"), (10_104, "éa b c d e")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    want = brute([tuple(r) for r in rows.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(rows).collect()}
    assert got == want and any(k != v[1] for k, v in want.items())
    assert {r.doc_id for r in representatives(rows).collect()} == {v[1] for v in want.values()}


def test_trees_drop_no_pair_that_may_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (40, 90)).astype(np.uint64)
    points = np.stack([count_vector(np.concatenate([b[: 90 - k], rng.integers(0, 1 << 63, k).astype(np.uint64)])) for b in base for k in (0, 3, 8, 30)])
    size = points.sum(axis=1)
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if np.minimum(points[i], points[j]).sum() >= least_overlap(size[i], size[j])}
    got = [(min(i, j), max(i, j)) for p, q in CountTree(points).pairs() for i, j in zip(p.tolist(), q.tolist())]
    assert set(got) == want and len(got) == len(want)


def test_words_of_huge_texts_are_whole():
    data = b" ".join(b"w%d" % k for k in range(500_000))
    (_, got), = text_words([data])
    assert len(data) > 2 * BLOCK and b"".join(pieces(data)) == data
    assert (got == word_hashes(data)[1]).all() and len(got) == 500_000
    assert len(shingle_set(got)) == 499_996


def test_odd_rows(odd, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(odd).collect()), key=repr)
    want = {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 6: (14, 6), 7: (14, 6), 9: (1, 9)}
    assert all((n, c) == want[d] for d, n, c in got if d in want) and len(got) == odd.count()
    assert {c for d, _, c in got if d in (5, 8)} == {5} and {c for d, _, c in got if d is None} == {None}
    assert jaccard_join(none).count() == 0
    kept = representatives(odd)
    assert kept.columns == odd.columns and sorted(kept.select("doc_id").collect(), key=repr) == sorted(odd.where("doc_id IS NULL OR doc_id IN (1, 2, 3, 4, 5, 6, 9)").select("doc_id").collect(), key=repr)


def test_a_templated_corpus_below_the_threshold(spark, monkeypatch):
    """Documents that share a template, at a similarity of 0.75 to 0.79, in blocks: every pair has to be looked at, and none links."""
    from latentfield.llm import jaccard_join as J

    template = [f"t{k}" for k in range(180)]
    rows = [(d, " ".join(template + [f"d{d}w{k}" for k in range(22)])) for d in range(150)]
    rows += [(1000 + d, " ".join(template + [f"d{d}w{k}" for k in range(22 - d % 2)])) for d in range(0, 150, 7)]
    monkeypatch.setattr(J, "CHUNK", 64)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and got[0][0] == 198


def test_blocks(spark, docs, monkeypatch):
    from latentfield.llm import jaccard_join as J

    monkeypatch.setattr(J, "CHUNK", 4)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    base = [f"c{k}" for k in range(60)]
    rows += [(10_000 + k, " ".join(f"x{j}" if j < k else w for j, w in enumerate(base))) for k in range(12)]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


def test_a_leader_of_many_is_dealt_out(spark):
    pairs = spark.range(1, 20_001).selectExpr("0L AS a", "id AS b").union(spark.range(30_000, 30_050).selectExpr("id AS a", "20000L AS b"))
    rows = spark.range(0, 30_050).selectExpr("id", "concat('t', id) AS text")
    placed, hot = dealt_out(pairs)
    assert {(r.side, r.id) for r in hot.collect()} == {("a", 0)}
    assert max(r["count"] for r in placed.groupBy("a", "part_a").count().collect()) <= 2 * module.PART
    got = beside(pairs, rows, "text")
    assert got.count() == pairs.count() and got.where("x <> concat('t', a) OR y <> concat('t', b)").count() == 0


def test_near_copies_of_one_template(spark, monkeypatch):
    """One leader for hundreds of documents, all different, some of them below the threshold; with small parts."""
    monkeypatch.setattr(module, "PART", 8)
    rng = np.random.default_rng(7)
    rows = []
    for d in range(400):
        words = [f"w{k}" for k in range(120)]
        for k in range(int(rng.integers(1, 5))):
            words[int(rng.integers(0, 120))] = f"d{d}x{k}"
        rows.append((d, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
