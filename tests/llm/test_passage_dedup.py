import random
import re

from pyspark.sql import functions as F

from latentfield.llm.passage_dedup import ASKS, SPAN, WINDOW, deduplicated, paragraph_starts, parts_of, repeated_documents, repeated_passages, rolled, tuned_bands
from latentfield.llm.shingles import text_words


def test_every_repeat_of_fifty_words_is_found(docs):
    seen = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), set()).add(r.doc_id)
    truth = {d for s in seen.values() if len(s) > 1 for d in s}
    assert SPAN + WINDOW - 1 == 50 and truth
    assert truth <= {r.doc_id for r in repeated_documents(docs).collect()}


def planted(spark):
    passage = " ".join(f"p{k}" for k in range(120))
    text = lambda d, n=80: " ".join(f"d{d}w{k}" for k in range(n))
    near = passage.replace("p60", "q60")  # what is left on either side has over 50 words
    rows = [(1, f"{text(1)} {passage} {text(2)}"), (2, f"{passage}"), (3, f"{text(3, 7)}\n{near} {text(4, 11)}"), (4, text(5, 300)), (5, text(6, 90) + " " + text(6, 90))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_clean_documents_are_left_alone(spark):
    got = {r.doc_id: r for r in repeated_documents(planted(spark)).collect()}
    assert set(got) == {1, 2, 3} and got[1].n_removed == 0 and got[2].n_removed == got[2].n_paragraphs


def test_near_paragraphs_link(spark):
    words = [f"w{k}" for k in range(16)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["x"])), (3, " ".join(words[:8] + ["y"] + words[9:]))]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2} and len({r.component for r in got}) == 1  # 11 of 13 shingles; the third shares 7 of 17


def test_bands_reach_the_recall():
    assert 1 - (1 - 0.8**2) ** tuned_bands() >= 0.98 > 1 - (1 - 0.8**2) ** (tuned_bands() - 1)


def test_odd_rows(odd, none):
    got = {r.doc_id for r in repeated_documents(odd).collect()}
    assert got == {5, 6, 7, 8} and repeated_documents(none).count() == 0


def test_whole_passages_are_removed(spark):
    own = lambda d, n: " ".join(f"d{d}w{k}" for k in range(n))
    rows = []
    for n in (50, 64, 100, 200, 1000):
        passage = " ".join(f"P{n}x{k}" for k in range(n))
        # as much text of their own around, so that lines and whole texts aren't near copies
        rows += [(n, f"{own(n, 70)} {passage} {own(-n, n)}"), (n + 1, f"{own(n + 1, 41)}\n{passage}  {own(-n - 1, n)}"), (n + 2, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in deduplicated(docs).collect()}
    counts = {r.doc_id: r for r in repeated_documents(docs).collect()}
    for n in (50, 64, 100, 200, 1000):
        assert got[n] == dict(rows)[n] and got[n + 2] == ""
        assert got[n + 1] == f"{own(n + 1, 41)}\n{own(-n - 1, n)}"
        assert (counts[n + 1].n_removed, counts[n + 1].n_words_removed, counts[n + 1].spans) == (1, n, f"41:{41 + n}")


def test_near_copies_with_changes_inside_are_found(spark):
    """Whole texts, lines and blocks of lines with one or two words changed, of a Jaccard similarity of 0.8 or more."""
    rows, want, base = [], set(), 0
    for n, changed in ((50, (49,)), (55, (27,)), (60, (30,)), (80, (40,)), (100, (33, 66))):
        for k in range(20):
            words = [f"t{n}k{k}w{i}" for i in range(n)]
            near = [f"x{w}" if i in changed else w for i, w in enumerate(words)]
            around = [" ".join(f"{c}{n}k{k}o{i}" for i in range(30)) for c in "ab"]
            one, two = (" ".join(words), " ".join(near)) if k % 3 == 0 else (f"{around[0]}\n{' '.join(words)}", f"{' '.join(near)}\n{around[1]}")
            if k % 3 == 2:
                one, two = (f"{around[0]}\n\n" + "\n".join(" ".join(words[i : i + 10]) for i in range(0, n, 10)), f"{' '.join(near)}\n\n{around[1]}")
            rows += [(base, one), (base + 1, two)]
            want.add((base + 1, n))
            base += 2
    got = {r.doc_id: r for r in repeated_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = [d for d, n in want if d in got and got[d].n_words_removed >= n]
    assert len(hit) >= 0.95 * len(want)


def brute(rows):
    """The rows of repeated_documents() in plain loops: only the choice of windows and their hash are taken from the library."""
    texts = {i: x.encode().lower() for i, x in rows if i is not None and x}
    words = {i: x.split() for i, x in texts.items()}
    hashes = {i: next(h for _, h in text_words([x])) for i, x in texts.items()}
    found = []  # document, start, n, is a block
    for i, w in words.items():
        if len(w) < SPAN:
            continue
        blocks = {(0, len(w))}
        for pattern in (rb"\n", rb"\n[ \t\r\x0b\x0c]*\n"):
            at = 0
            for part in re.split(pattern, texts[i]):
                n = len(part.split())
                blocks |= {(at, n)} if n >= SPAN else set()
                at += n
        anchors = {(int(s), SPAN) for s in paragraph_starts(rolled(hashes[i], 3)[: len(w) - SPAN + 1])} - blocks
        found += [(i, s, n, True) for s, n in blocks] + [(i, s, n, False) for s, n in anchors]
    by_class = {}
    for i, s, n, block in found:
        by_class.setdefault(tuple(words[i][s : s + n]), []).append((i, s, n, block))
    shingled = {c: {c[k : k + 5] for k in range(len(c) - 4)} for c, places in by_class.items() if any(p[3] for p in places)}
    holders = {}
    for c, shingles in shingled.items():
        for x in shingles:
            holders.setdefault(x, []).append(c)
    root = {c: c for c in by_class}

    def top(c):
        while root[c] != c:
            c = root[c]
        return c

    pairs = {(a, b) for cs in holders.values() for k, a in enumerate(cs) for b in cs[:k]}
    for a, b in pairs:
        if 100 * len(shingled[a] & shingled[b]) >= 80 * len(shingled[a] | shingled[b]):
            root[top(a)] = top(b)
    groups = {}
    for c, places in by_class.items():
        groups.setdefault(top(c), []).append(c)
    out = {}
    for classes in groups.values():
        all_places = [p[:3] for c in classes for p in by_class[c]]
        first = min(all_places)
        if len({p[0] for p in all_places}) < 2:
            continue
        for c in classes:
            own = min(p[:3] for p in by_class[c])
            for i, s, n, _ in by_class[c]:
                r = out.setdefault(i, {"first": set(), "kept": set(), "gone": set()})
                r["first"].add(first[0])
                if i == first[0]:
                    r["kept"].add((s, n))
                    continue
                j, t, m = first if i == own[0] else own
                a, b, begin, end, u, v = words[i], words[j], s, s + n, t, t + m
                while begin and u and a[begin - 1] == b[u - 1]:
                    begin, u = begin - 1, u - 1
                while end < len(a) and v < len(b) and a[end] == b[v]:
                    end, v = end + 1, v + 1
                r["gone"].add((begin, end))
    want = {}
    for i, r in out.items():
        spans = []
        for s, e in sorted(r["gone"]):
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(e, spans[-1][1])
            else:
                spans.append([s, e])
        stay = [x for x in r["kept"] if not any(s <= x[0] and x[0] + x[1] <= e for s, e in spans)]
        want[i] = (len(stay) + len(spans), len(spans), min(r["first"]), sum(e - s for s, e in spans), ",".join(f"{s}:{e}" for s, e in spans))
    return want


def rows_of(docs):
    return {r.doc_id: (r.n_paragraphs, r.n_removed, r.first_doc_id, r.n_words_removed, r.spans) for r in repeated_documents(docs).collect()}


def test_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got, want = rows_of(docs), brute(rows)
    # banding may miss a pair near the threshold, which takes its documents' rows along
    assert len(got.keys() ^ want.keys()) <= 0.02 * len(want) and sum(got.get(i) == r for i, r in want.items()) >= 0.97 * len(want) > 20


def test_equals_brute_force_on_planted_copies(spark):
    """Exact and near copies far above the threshold, chained ones, hot lines, blank-line blocks and overlapping passages: every column agrees."""
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(10**6)}"
    hot, long = " ".join(word() for _ in range(20)), [word() for _ in range(300)]
    rows = []
    for d in range(120):
        own = [word() for _ in range(rng.randrange(10, 60))]
        kind = d % 6
        if kind == 0:
            text = " ".join(own) + "\n" + hot
        elif kind == 1:
            s = rng.randrange(200)
            text = " ".join(own) + " " + " ".join(long[s : s + 90])
        elif kind == 2:
            copy = long[:100].copy()
            copy[rng.randrange(100)] = word()
            text = "\n".join(" ".join(copy[k : k + 25]) for k in range(0, 100, 25)) + "\n\n" + " ".join(own)
        elif kind == 3:
            text = " ".join(long[40:140]) + " " + " ".join(long[200:260])
        elif kind == 4:
            text = " ".join(own * 2)
        else:
            text = hot
        rows.append((d, text))
    got, want = rows_of(spark.createDataFrame(rows, "doc_id long, text string")), brute(rows)
    assert got == want and len(want) == 100


def test_a_text_that_many_share_with(spark):
    """One long document holds what 3,000 short ones repeat: parts of it are compared, in several tasks."""
    long = [f"l{k}" for k in range(6000)]
    own = lambda d: [f"d{d}o{k}" for k in range(40)]
    rows = [(0, " ".join(long))] + [(d, " ".join([*own(d), *long[d : d + 60], *own(-d)])) for d in range(1, 3001)]
    got = rows_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(got) == 3001 and all(got[d][1:] == (1, 0, 60, "40:100") for d in range(1, 3001))


def test_asks_for_one_text_are_dealt_out(spark):
    """A document that many ask for isn't read by one task."""
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        n = 8 * ASKS
        docs = spark.createDataFrame([(0, " ".join(f"w{k}" for k in range(100))), (1, "a b c")], "doc_id long, text string")
        asks = spark.range(n).select("id", F.when(F.col("id") < n - 1, 0).otherwise(1).cast("long").alias("at"), F.lit(1).alias("low"), F.lit(3).alias("high"))
        got = parts_of(asks, docs).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(coalesce, before)
    assert sorted(r.id for r in got) == list(range(n)) and all(len(r.words) == 16 for r in got)
    assert len({r.task for r in got if r.id < n - 1}) > 2
