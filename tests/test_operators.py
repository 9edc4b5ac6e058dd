"""Operators by themselves, on hand-written rows."""

import itertools
import math
import posixpath
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latentfield.functions import lexers
from latentfield.functions import scalars as S
from latentfield.operators import changes, fields, graphs, modules, proposals, puzzles, sweeps
from latentfield.operators.readings import config, evidence, ranked, readings
from latentfield.operators.symbols import import_graph
from latentfield.plans import queries
from latentfield.sources import inputs
from latentfield.sources import views as V

EVENT = "capability string, kind string, weight double, after string, direction array<string>"


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT)


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def demand(spark, *rows):
    return fields.demand(events(spark, *rows)).first()


def test_demand_of_heat_alone(spark):
    d = demand(spark, *[("a", "abandonment", None, "", None)] * 4)
    assert (d["count"], d.demand, d.arrow_share, d.coherence, d.direction_known) == (4, 2.0, 0.0, 0.5, False)


def test_demand_of_arrows_and_heat(spark):
    d = demand(spark, ("a", None, None, "x", None), ("a", "retry", None, "", None), ("a", "retry", None, "", None))
    assert (d.demand, round(d.arrow_share, 4)) == (1.8, 0.5556)


def test_own_weight_and_unknown_kind(spark):
    assert demand(spark, ("a", "retry", 0.0, "", None), ("a", "correction", 2.5, "x", None)).demand == 2.5
    assert demand(spark, ("a", "zzz", None, "x", None)).demand == 1.0


def test_no_destination_is_no_arrow(spark):
    assert demand(spark, ("a", "correction", None, "", ["t"])).direction_known is False


def test_coherence_of_scattered_tags(spark):
    assert demand(spark, *[("a", None, None, "x", [t]) for t in "aabc"]).coherence == 0.5


def test_nan_weight_gives_no_demand(spark):
    d = demand(spark, ("a", None, float("nan"), "x", None))
    assert math.isnan(d.demand) and one(spark, S.saturate(F.lit(float("nan")), 3.0)) == 0.0


def test_usage_unknown_zero_and_negative(spark):
    rows = spark.createDataFrame([("z", 0.0), ("n", -5.0), ("n", 3.0)], "capability string, count double")
    got = {r.capability: r.usage_total for r in fields.usage(rows).collect()}
    assert got == {"z": 0.0, "n": 3.0}


def test_duplicate_signals_count_twice_as_declared(spark):
    caps = spark.createDataFrame([(0, "c", "C", ["a", "a"])], "ord int, id string, label string, signals array<string>")
    tokens = spark.createDataFrame([("f", "part", "a"), ("f", "full", "a")], "path string, space string, token string")
    k = fields.capacity(caps, tokens).first()
    assert (k.n_matched, k.n_files, k.hits) == (1, 1, 2)
    e = evidence(caps, fields.demand(events(spark)), fields.capacity(caps, tokens), fields.usage(spark.createDataFrame([], "capability string, count double")))
    r = readings(e, config(spark)).first()
    assert r.evidence.capacity_confidence == 0.5 and r.utilization == 0 and not r.known


@pytest.mark.parametrize(("x", "want"), [("invoiceTotal", ["invoice", "total"]), ("invoice_total", ["invoice", "total"]), ("HTTPServer2x", ["http", "server2x"]), ("__", []), ("ownerIds", ["owner", "ids"])])
def test_identifier_words(spark, x, want):
    assert one(spark, S.split_identifier(F.lit(x))) == want


def test_singular(spark):
    assert [one(spark, S.singular(F.lit(x))) for x in ("owners", "class", "bus", "glass", "items")] == ["owner", "class", "bus", "glass", "item"]


def test_spaces_and_rounding(spark):
    assert [round(x, 6) for x in one(spark, S.geom_space(0.5, 2.0, 3))] == [0.5, 1.0, 2.0] and one(spark, S.geom_space(1.0, 4.0, 1)) == [2.0]
    assert one(spark, S.lin_space(0.2, 0.8, 3)) == [0.2, 0.5, 0.8] and one(spark, S.lin_space(0.2, 0.8, 1)) == [0.5]
    assert one(spark, S.rounded(F.lit(0.0625), 3)) == 0.063 and one(spark, S.clamp01(F.lit(float("nan")))) == 0.0


@pytest.mark.parametrize(
    ("c", "k", "u", "known", "want"),
    [
        (0.6, 0.6, 0.0, False, "candidate-unverified"),
        (0.6, 0.6, 0.34, True, "uncollapsed-feature"),
        (0.6, 0.34, 0.9, True, "unsupported-wish"),
        (0.34, 0.6, 0.34, True, "dormant-capacity"),
        (0.5, 0.5, 0.6, True, "already-collapsed"),
        (0.5, 0.5, 0.5, True, "low-signal"),
    ],
)
def test_categories_at_their_bounds(spark, c, k, u, known, want):
    got = one(spark, S.category(F.col("c"), F.col("k"), F.col("u"), F.col("known")), c=c, k=k, u=u, known=known)
    assert got == want and one(spark, S.interpretation(F.lit(got)))


def test_labels_and_verdicts(spark):
    assert [one(spark, S.integration_label(F.lit(x).cast("double"))) for x in (0.1, 0.45, 0.6, 0.75, None)] == ["CO-LOCATED", "RIPE", "MODERATE", "DEEP", None]
    assert [one(spark, S.change_verdict(F.lit(p), F.lit(u))) for p, u in ((-0.1, 0.1), (-0.1, 0.0), (0.1, 0.0), (0.0, 0.5))] == ["collapsed", "decaying", "intensifying", "stable"]
    assert one(spark, S.stability_verdict(F.lit(0.5), F.lit(0.9), F.lit(0.3))) == "sometimes first; robust"


def test_compare_needs_both_sides(spark):
    schema = "capability string, correction double, utilization double, collapse_potential double"
    before = spark.createDataFrame([("a", 0.5, 0.1, 0.6), ("b", 0.5, 0.1, 0.1)], schema)
    now = spark.createDataFrame([("a", 0.4, 0.5, 0.2), ("c", 0.5, 0.1, 0.1)], schema)
    assert [(r.capability, r.verdict) for r in changes.compared(before, now).collect()] == [("a", "collapsed")]


def test_paths_and_modules(spark):
    assert one(spark, S.plain_path(F.lit("A\\b/./c/../D.ts"))) == "a/b/d.ts"
    assert one(spark, S.module_name(F.lit("a/b/__init__.py"))) == "a.b"
    assert [one(spark, S.absolute_module(F.lit(s), F.lit("p.q.m"))) for s in (".x", "..x.y", ".", "a.b")] == ["p.q.x", "p.x.y", "p.q", "a.b"]
    assert [one(spark, modules.is_test(F.lit(p))) for p in ("tests/a.py", "a/test/b.go", "contest/a.py", "test_a.py", "a_test.go", "conftest.py", "a.py")] == [True, True, False, True, True, True, False]
    assert 0 <= one(spark, S.uniform(F.lit("seed"))) < 1
    assert (one(spark, S.bar(F.lit(0.26))), one(spark, S.percent(F.lit(0.266))), one(spark, S.signed(F.lit(-0.1)))) == ("###.......", "27%", "-0.10")


def path_edges(spark, n):
    return graphs.undirected(spark.createDataFrame([(k, k + 1) for k in range(n)] + [(0, 0)], "src int, dst int"))


def test_hops_end_at_eight(spark):
    got = {r.node: r.hops for r in graphs.hops(path_edges(spark, 10), spark.createDataFrame([(0,)], "source int")).collect()}
    assert got == {k: k for k in range(9)}


def test_mean_distance(spark):
    members = spark.createDataFrame([("a", 0), ("a", 1), ("a", 99), ("b", 5), ("c", 0), ("c", 2)], "owner string, node int")
    got = {r.owner: round(r.distance, 4) for r in graphs.mean_distances(members, path_edges(spark, 10)).collect()}
    assert got == {"a": round((1 / 3 + 1 + 1) / 3, 4), "b": 0.0, "c": 0.5}


def test_resolution_equals_trying_each_path(spark):
    """Specifiers with and without extensions, of any case, against a loop over all candidates in their order."""
    from latentfield.operators.symbols import RESOLVED

    rng = random.Random(11)
    ends = [*RESOLVED, ".py", "/index.ts", "/index.js", "/__init__.py", "", ".rb", ".D.ts"]
    paths = sorted({f"{rng.choice(['src', 'src/in', 'lib'])}/{rng.choice('abcAB')}{rng.choice(ends)}" for _ in range(120)})
    specs = [f"./{rng.choice(['', 'in/', '../lib/', '../'])}{rng.choice('abcB')}{rng.choice(['', '', '.js', '.ts', '.d', '.py', '.jsx'])}" for _ in range(150)]
    files = [(p, ".py" if p.endswith(".py") else ".ts", [(rng.choice(specs), 1 if p.endswith(".py") else 0) for _ in range(6)]) for p in paths]
    index, want = {}, set()
    for p in paths:
        index[p.lower()] = max(index.get(p.lower(), ""), p)
    for path, ext, imports in files:
        for spec, _ in imports:
            base = posixpath.normpath(posixpath.join(posixpath.dirname(path), spec)).lower()
            head, _, name = base.rpartition("/")
            stem = base[: len(head) + 1 + name.rfind(".")] if name.rfind(".") > 0 else base
            tried = [base + ".py", base + "/__init__.py"] if ext == ".py" else [base, *(x for e in RESOLVED for x in (stem + e, base + e, f"{base}/index{e}"))]
            target = next((index[t] for t in tried if t in index), None)
            if target and target != path:
                want |= {(path, target), (target, path)}
    lexed = spark.createDataFrame(files, "path string, ext string, imports array<struct<spec: string, dots: int>>")
    assert {tuple(r) for r in import_graph(lexed).collect()} == want and len(want) > 100


def test_baselines_are_versions(spark, tmp_path):
    """Savings don't mix, one that broke off isn't read, and reading prunes to one folder."""
    at = f"file://{tmp_path}/baselines"

    def scores(v):
        return spark.createDataFrame([(f"c{k}", v, v, v, v) for k in range(3)], "capability string, correction double, capacity double, utilization double, collapse_potential double")

    first = inputs.write_baseline(scores(0.1), at)
    second = inputs.write_baseline(scores(0.2), at)
    assert first != second
    scores(0.9).write.parquet(f"{at}/rows/version=99990101T000000.000000-torn")  # without a line in the manifest
    got = inputs.read_baseline(spark, at)
    assert {r.correction for r in got.collect()} == {0.2} and got.count() == 3
    assert {r.correction for r in inputs.read_baseline(spark, at, first).collect()} == {0.1}
    assert inputs.baseline_versions(spark, at).count() == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan
    with pytest.raises(Exception, match=r"manifest|PATH_NOT_FOUND"):
        inputs.read_baseline(spark, f"{at}/none")


def test_signals_of_a_large_cluster(spark):
    """Equal to a sort of the whole vocabulary; words that don't recur count only where none does."""
    rng = random.Random(3)
    counts = [(0, f"w{k}", rng.randrange(1, 9)) for k in range(3000)] + [(1, f"v{k}", 1) for k in range(50)] + [(2, "import", 9), (2, "once", 1), (3, "class", 4)]
    got = sorted(tuple(r) for r in proposals.signals(spark.createDataFrame(counts, "root int, token string, n int")).collect())
    want = []
    for root in (0, 1, 2):
        usable = [(r, t, n) for r, t, n in counts if r == root and t not in proposals.CODE_KEYWORDS]
        top = max(n for *_, n in usable)
        some = sorted((x for x in usable if x[2] >= 2 or top < 2), key=lambda x: (-x[2], x[1]))[:6]
        want += [(*x, k) for k, x in enumerate(some, 1)]
    assert got == sorted(want)


def test_hops_of_many_sources(spark):
    """More sources than bits in a word, hubs and separate parts: equal to walking from each; and far fewer rows than pairs are written."""
    rng = random.Random(4)
    edges = {(rng.randrange(200), rng.randrange(200)) for _ in range(260)} | {(0, k) for k in range(100, 190)} | {(k, k + 1) for k in range(300, 320)} | {(500, 500)}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = set()
    for source in [*range(190), 305, 999]:
        seen, front = {source}, {source}
        for k in range(9):
            want |= {(source, n, k) for n in front}
            front = {m for n in front for m in near.get(n, ())} - seen
            seen |= front
    both = graphs.undirected(spark.createDataFrame(list(edges), "src int, dst int"))
    sources = spark.createDataFrame([(k,) for k in [*range(190), 305, 999, 999, None]], "source int")
    found = graphs.hops(both, sources)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    seats = graphs.seated(sources.select(F.col("source").alias("node")).where("node IS NOT NULL").distinct(), "node")
    assert sum(x.count() for x in graphs.reached(both, seats, 8)) * 8 < len(want)


def test_mean_distance_of_shared_nodes(spark):
    """Owners share nodes, one has more than a word of bits, one node has no edge."""
    rng = random.Random(9)
    edges = {(rng.randrange(150), rng.randrange(150)) for _ in range(200)}
    members = [("big", k) for k in range(140)] + [("odd", k) for k in range(1, 60, 2)] + [("lone", 777), ("two", 3), ("two", 888)]
    both = graphs.undirected(spark.createDataFrame(list(edges), "src int, dst int"))
    hops = {(r.source, r.node): r.hops for r in graphs.hops(both, spark.createDataFrame([(n,) for _, n in members], "source int")).collect()}
    got = {r.owner: r.distance for r in graphs.mean_distances(spark.createDataFrame(members, "owner string, node int"), both).collect()}
    for owner in ("big", "odd", "lone", "two"):
        own = [n for o, n in members if o == owner]
        d = [(h / (h + 2) if (h := hops.get((a, b))) is not None else 1.0) for k, a in enumerate(own) for b in own[k + 1 :]]
        assert abs(got[owner] - (sum(d) / len(d) if d else 0.0)) < 1e-9


def test_degrees(spark):
    got = {r.node: (r.out_degree, r.in_degree) for r in graphs.degrees(spark.createDataFrame([(1, 2), (1, 3)], "src int, dst int")).collect()}
    assert got == {1: (2, 0), 2: (0, 1), 3: (0, 1)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components_root_is_the_smallest(spark, edges):
    at = {x: x for e in edges for x in e}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        u, v = sorted((top(a), top(b)))
        at[v] = u
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}


def test_clusters_with_expansion(spark):
    rows = [(0, "alpha beta"), (1, "beta gamma"), (2, "gamma delta"), (3, "omega"), (4, "omega"), (5, "to the")]
    words = proposals.event_words(spark.createDataFrame(rows, "ord int, after string"))
    assert {r.ord: r.root for r in proposals.clusters(words).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    assert {r.ord: r.root for r in proposals.clusters(words, threshold=0.6, least=0).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}
    assert {(r.a, r.b) for r in proposals.overlap_pairs(words).collect()} == {(0, 1), (1, 2), (3, 4)}


def overlapping(sets, threshold):
    """Roots of single linkage by the overlap coefficient, pair by pair."""
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) >= threshold:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in sets}


def as_words(spark, sets):
    return spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "ord int, token string")


def test_hot_events_and_words_are_joined_in_parts(spark, monkeypatch):
    """One event holds all words, one word stands in all events: pairs and counts are those of a plain loop, and no join key has many rows."""
    monkeypatch.setattr(proposals, "HOT", 16)
    rng = random.Random(12)
    sets = {k: {f"w{i}" for i in rng.sample(range(150), rng.randrange(1, 12))} | {"all"} for k in range(80)} | {80: {f"w{i}" for i in range(150)}}
    words = as_words(spark, sets)
    want = {}
    for s in sets.values():
        for a in s:
            for b in s - {a}:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r.token, r.other): r.n for r in proposals.cooccurrence(words).collect()} == want
    copies = spark.createDataFrame([(k, 1 + k % 3) for k in sets], "ord int, copies int")
    assert sum(r.n for r in proposals.cooccurrence(words, copies).collect()) == sum((1 + k % 3) * len(s) * (len(s) - 1) for k, s in sets.items())
    for key, item in (("ord", "token"), ("token", "ord")):
        left, right = proposals.dealt(words, key, item)
        assert max(r["count"] for side in (left, right) for r in side.groupBy(key, "p", "q").count().collect()) <= 40
    for threshold in (0.3, 0.34, 0.8):
        pairs = {(r.a, r.b): round(r.overlap, 9) for r in proposals.overlap_pairs(words, threshold).collect()}
        plain = {(a, b): round(len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])), 9) for a in sets for b in sets if a < b}
        assert pairs == {k: v for k, v in plain.items() if v >= threshold}


@pytest.mark.parametrize(("seed", "dense"), [(0, 8), (1, 8), (2, 8), (3, 0)])
def test_clusters_of_unlike_sizes(spark, seed, dense, monkeypatch):
    """Small events inside large ones, chains, copies and templates: equal to comparing all pairs, with hot words in parts too."""
    monkeypatch.setattr(proposals, "HOT", 8)
    monkeypatch.setattr(proposals, "DENSE", dense)  # 0: all as bits
    rng = random.Random(seed)
    sets = {}
    for k in range(160):
        n = rng.choice([1, 2, 3, 5, 8, 13, 40])
        words = {f"w{int(rng.paretovariate(0.7)) % 900}" for _ in range(n)}
        sets[k] = set(sets[rng.randrange(k)]) if k and rng.random() < 0.1 else words | ({f"t{k % 3}"} if rng.random() < 0.5 else set())
    for threshold in (0.34, 0.5, 1.0):
        got = {r.ord: r.root for r in proposals.clusters(as_words(spark, sets), threshold=threshold, least=0).collect()}
        assert got == overlapping(sets, threshold), threshold


def expanded_sets(sets):
    """Each set united with all that stand beside one of its words."""
    near = {}
    for s in sets.values():
        for t in s:
            near.setdefault(t, set()).update(s)
    return {k: set().union(*(near[t] for t in s)) for k, s in sets.items()}


@pytest.mark.parametrize(("seed", "hot"), [(0, 4096), (2, 4)])
def test_clusters_of_expanded_events(spark, seed, hot, monkeypatch):
    """Communities that share some words, copies, lone events and one that holds much: equal to expanding and comparing all, also where bounds of large events stand for counts."""
    monkeypatch.setattr(proposals, "HOT", hot)
    rng = random.Random(seed)
    sets = {}
    for k in range(150):
        c = rng.randrange(6)
        words = {f"c{c}w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.choice([1, 2, 3, 5, 9]))}
        if rng.random() < 0.05:
            words |= {f"c{(c + 1) % 6}w{rng.randrange(100, 400)}" for _ in range(3)}
        sets[k] = set(sets[rng.randrange(k)]) if k and rng.random() < 0.1 else words
    sets[150] = {f"c0w{i}" for i in range(60)}
    for threshold in (0.34, 0.8):
        got = {r.ord: r.root for r in proposals.clusters(as_words(spark, sets), threshold=threshold).collect()}
        assert got == overlapping(expanded_sets(sets), threshold), threshold


def test_clusters_without_anchors(spark, monkeypatch):
    """Where no event anchors a word, what is done for the rest alone finds the same."""
    monkeypatch.setattr(proposals, "anchored", lambda own, bounds, threshold: bounds.where("ord < 0").select(F.col("ord").alias("a"), F.col("ord").alias("b")))
    rng = random.Random(8)
    sets = {k: {f"c{k % 3}w{int(rng.paretovariate(0.5)) % 300}" for _ in range(rng.randrange(1, 9))} | ({"shared"} if k % 10 == 0 else set()) for k in range(90)}
    assert {r.ord: r.root for r in proposals.clusters(as_words(spark, sets)).collect()} == overlapping(expanded_sets(sets), 0.34)


def rows_staged(monkeypatch):
    """The most rows of each table that proposals stages from now on."""
    rows, plain = {}, proposals.staged

    def counted(df, name):
        table = plain(df, name)
        rows[name] = max(rows.get(name, 0), table.count())
        return table

    monkeypatch.setattr(proposals, "staged", counted)
    return rows


def test_expanded_events_are_not_written(spark, monkeypatch):
    """Each event holds a frequent word, so each expanded set is most of 4,000 words: 62 rows of bits an event. No table has more rows than the events have words."""
    rng = random.Random(4)
    sets = {k: {f"f{k % 2}"} | {f"w{rng.randrange(4000)}" for _ in range(k // 2 % 4)} for k in range(3000)}
    words = spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "ord int, token string")
    rows = rows_staged(monkeypatch)
    assert proposals.clusters(words).select("root").distinct().count() == 1
    assert max(rows.values()) <= words.count(), rows


def test_candidate_pairs_are_not_written(spark, monkeypatch):
    """Templated events share 10 of their 34 words: none of 44,850 pairs links at 0.34 and all do at 0.29, and neither way are candidates written."""
    sets = {k: {f"t{i}" for i in range(10)} | {f"own{k}x{i}" for i in range(24)} for k in range(300)}
    words = as_words(spark, sets)
    for parts, few in ((8, 1024), (8, 16), (1, 1 << 20)):
        monkeypatch.setattr(proposals, "MORE", parts)
        monkeypatch.setattr(proposals, "FEW", few)
        monkeypatch.setattr(proposals, "COUNTS", 1000 if parts == 1 else 1 << 22)
        with monkeypatch.context() as m:
            rows = rows_staged(m)
            assert proposals.overlap_pairs(words).count() == 0
            assert proposals.overlap_pairs(words, 0.29).count() == 300 * 299 / 2
            assert max(rows.values()) <= words.count(), rows


def test_dense_sets_without_guesses(spark, monkeypatch):
    """Sets that hold much of the vocabulary, of which guesses have united few: the exact step alone finds the same."""
    rng = random.Random(6)
    halves = [[f"a{i}" for i in range(300)], [f"b{i}" for i in range(300)]]
    sets = {k: set(rng.sample(halves[k % 2], rng.randrange(60, 250))) | ({"common"} if k % 5 else set()) for k in range(60)}
    sets |= {60: {"a1", "b1", "c"}, 61: {f"c{i}" for i in range(40)}, 62: {f"c{i}" for i in range(27)} | {f"b{i}" for i in range(13)}}
    plain = proposals.guesses
    monkeypatch.setattr(proposals, "guesses", lambda *a: plain(*a).where("b % 7 = 0"))
    words = as_words(spark, sets)
    ids = words.join(words.groupBy("token").count().orderBy(F.desc("count"), "token").select("token", F.monotonically_increasing_id().alias("id")), "token")
    got = {k: k for k in sets} | {r.node: r.root for r in proposals.linked_roots(proposals.blocks(ids, "ord", 6), 0.34).collect()}
    assert got == overlapping(sets, 0.34)


def test_templated_events_below_the_threshold(spark):
    """Every event shares 30 to 33 of its 100 words with all others. None links, and the index offers next to no pair."""
    rng = random.Random(2)
    sets = {k: {f"t{i}" for i in rng.sample(range(33), rng.randrange(30, 34))} for k in range(120)}
    for k, s in sets.items():
        s |= {f"own{k}x{i}" for i in range(100 - len(s))}
    sets[120], sets[121] = set(list(sets[7])[:50]), {f"t{i}" for i in range(33)} | {"one more"}
    words = as_words(spark, sets)
    assert {r.ord: r.root for r in proposals.clusters(words, least=0).collect()} == overlapping(sets, 0.34)
    ids = words.join(words.groupBy("token").count().orderBy("count", "token").select("token", F.monotonically_increasing_id().alias("id")), "token")
    alone = ids.where("ord < 120").join(ids.groupBy("ord").count().withColumnRenamed("count", "size"), "ord").select("id", "ord", F.col("ord").alias("root"), "size")
    assert proposals.candidates(alone, 0, 0.34).count() == 0


def test_equal_proposal_ids_stay_apart(spark):
    rows = [(k, f"e{k}", f"red blue green {w}") for k, w in enumerate(("one1", "two2"))] + [(k + 2, f"f{k}", f"red blue green {' '.join(f'{w}{j}' for j in range(30))}") for k, w in enumerate(("three", "four"))]
    found, _ = proposals.propose(spark.createDataFrame(rows, "ord int, id string, after string"), threshold=0.99, least=0)
    assert found.count() == 4 and found.select("ord").distinct().count() == 4


def test_code_keywords_are_no_signals(spark):
    found, members = proposals.propose(spark.createDataFrame([(0, "a", "export import"), (1, "b", "export csv")], "ord int, id string, after string"), threshold=0.9, least=0)
    assert [r.signals for r in found.collect()] == [["csv"]] and members.count() == 1


def test_sweep_grid_and_ties(spark):
    assert sweeps.grid(spark, sweeps.LEVELS).select("config_id").distinct().count() == 81
    assert [sweeps.design(spark, "d", "wide", n).count() for n in (3, 5)] == [81, 625]
    rows = [(0, k, k, 0.0, 0.0, 0.0) for k in range(3)]
    got = ranked(spark.createDataFrame([(0, o, s) for o, s in ((0, 0.1), (1, 0.5), (2, 0.5))], "config_id int, ord int, score double")).orderBy("rank")
    assert [r.ord for r in got.collect()] == [1, 2, 0] and rows


def test_puzzle_is_solved(spark):
    near = puzzles.square_board(spark, 3)
    filled = spark.createDataFrame([(k, 1) for k in range(9)], "cell int, value int")
    clues = puzzles.clues(filled, near)
    assert {r.cell: r.clue for r in clues.collect()}[4] == 9
    assert all(r.state == 1 for r in puzzles.solved(clues, near).collect())
    assert puzzles.cube_surface(spark, 2).groupBy("cell").count().where("count <> 4").isEmpty()
    assert puzzles.wave(spark.createDataFrame([(0,)], "cell int"), near, most=1).count() == 4


def test_text_lexer(spark):
    text = "a1 /* gone */ \"str\" 'x' `t` // rest\n# all\nfooBar return " + '"' + "x" * 200_000 + '" last'
    got = spark.createDataFrame([(text,)], "t string").select(lexers.text_identifiers(F.col("t")).alias("x")).first().x
    assert got == ["a1", "fooBar", "last"] == lexers.plain_identifiers(text)


def test_apostrophe_in_a_comment_hides_code():
    assert lexers.plain_identifiers("// don't\nhidden // it's\nseen") == ["seen"]


def test_script_lexer():
    text = "const re = /a[/]b/g; const t = `x ${inner.call(`${deep}`)} y`; // c\nclass K { #p = 1; run(a: string) { return this.#p; } }\nimport x from './m.js'; export * from \"./n\"; const r = require('./o'); import('./p')"
    names = lexers.script_identifiers(text)
    assert {"re", "t", "inner", "call", "deep", "K", "p", "run", "a", "x", "r"} <= set(names) and not {"string", "return", "c", "y"} & set(names)
    assert lexers.script_imports(text) == ["./m.js", "./n", "./o", "./p"]
    assert {"re", "t", "K", "run", "r"} == {n for n, _ in lexers.script_declarations(text)}


def test_other_lexers():
    assert lexers.definitions("class A:\n  def b(self): pass\nasync def c(): pass", ".py") == ["A", "c", "b"]
    assert lexers.definitions("func (s *T) Run() {}\ntype T struct{} // func no()", ".go") == ["Run", "T"]
    assert lexers.definitions("class A\n def b\n end\nend", ".rb") == ["A", "b"]
    assert lexers.definitions("class A { void run(int x) { if (x) {} } }", ".java") == ["A", "run"]
    assert lexers.identifiers("def broken(:\n  x = 'a", ".py")
    assert lexers.python_relative_imports("from . import a, b as c\nfrom ..x.y import z\nimport q") == [(1, "a"), (1, "b"), (2, "x/y")]
    assert lexers.quoted_imports("require('./a'); import \"b\"") == ["./a"]


def test_import_resolution_order(spark):
    files = [("src/a.ts", ".ts", "import './b.js'; import './c'; import 'ext'"), ("src/b.ts", ".ts", ""), ("src/b.js", ".js", ""), ("src/c/index.ts", ".ts", ""), ("p/m.py", ".py", "from . import n\nfrom ..src import a"), ("p/n/__init__.py", ".py", "")]
    edges = import_graph(lexers.lexed(spark.createDataFrame(files, "path string, ext string, text string"))).where("src < dst")
    assert {(r.src, r.dst) for r in edges.collect()} == {("src/a.ts", "src/b.js"), ("src/a.ts", "src/c/index.ts"), ("p/m.py", "p/n/__init__.py")}


def test_lexers_and_views_in_sql(spark, sf):
    from latentfield.sources import views

    lexers.register(spark)
    got = {tuple(r) for r in spark.sql("SELECT * FROM lex_tokens('const ownerIds = HTTPServer2x', '.ts')").collect()}
    want = spark.range(1).select(F.explode(F.concat(S.identifier_tokens(F.lit("ownerIds")), S.identifier_tokens(F.lit("HTTPServer2x")))).alias("t")).select("t.*").collect()
    assert got == {tuple(r) for r in want}
    assert spark.sql("SELECT name FROM lex_declarations('def a(): pass', '.py')").first().name == "a"
    views.register(spark, sf)
    assert spark.sql("SELECT count(DISTINCT capability) AS n FROM corrections JOIN capabilities ON capability = id").first().n > 0


def test_small_tables_of_few_files_are_dealt_out(spark, tmp_path):
    from latentfield.plans import staging

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "many"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan(staging.spread(spark.read.parquet(str(tmp_path / "one"))))
    assert "Exchange" not in plan(staging.spread(spark.read.parquet(str(tmp_path / "many"))))


def test_presentation(spark):
    from latentfield.operators import presentation as P

    e = "named_struct('correction_count', 2L, 'arrow_share', double(0.75)) AS evidence"
    rows = spark.sql(f"SELECT * FROM VALUES ('a', 'A', 0.3, 0.5, true, 'low-signal'), ('b', 'B', NULL, 0.5, false, 'low-signal'), ('c', 'C', 0.8, 0.001, true, 'low-signal') AS t(capability, label, integration_distance, score, known, category)").selectExpr("*", e)
    assert [(r.capability, r.side) for r in P.quadrant(rows).collect()] == [("a", "ripe")]
    assert [(r.distance, r.unverified, r.heat_percent) for r in P.badges(rows).collect()] == [("RIPE", False, 25), (None, True, 25), ("DEEP", False, 25)]
    two = spark.sql("SELECT * FROM VALUES ('a', 0.5, 0.7, 'hi'), ('b', 0.0, 0.0, 'lo'), ('c', 0.0, 0.99, 'lo') AS t(capability, baseline_cp, candidate_share, knob)")
    three = spark.sql("SELECT 'a' AS capability, 0.1 AS min_share, 0.9 AS max_share, 0.7 AS l2_share, false AS class_converges, 0.5 AS baseline_cp")
    assert {(r.capability, r.knob) for r in P.stability_cards(two, three).collect()} == {("a", "hi"), ("c", None)}
    assert P.printed_designs(three).count() == 1


def test_malformed_inputs_are_empty(spark, tmp_path):
    for k, text in enumerate(('[{"id": "a"', '{"id": "a"}', "")):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "capabilities.json").write_text(text)
        assert inputs.capabilities(spark, str(tmp_path / f"{k}")).count() <= 1
    assert inputs.capabilities(spark, str(tmp_path / "missing")).count() == 0
    assert inputs.capabilities(spark, str(tmp_path / "0")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from latentfield.streaming import demand_stream

    rows = [("a", None, None, "x", ["t"]), ("a", "retry", None, "", None), ("b", "request", 2.0, "y", ["u", "v"])]
    for k, r in enumerate(rows):
        events(spark, r).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    demand_stream.start(stream, str(tmp_path / "sums"), str(tmp_path / "at")).awaitTermination()
    got = demand_stream.demand_so_far(spark, str(tmp_path / "sums")).orderBy("capability").collect()
    assert got == fields.demand(events(spark, *rows)).orderBy("capability").collect()
    assert k == 2


def test_reach_is_merged_in_tiles_before_it_is_shuffled(spark, monkeypatch):
    """Parts of a graph that are apart lie in tiles of their own; small tiles and short rows of neighbours give the same hops."""
    links = [(c * 100 + a, c * 100 + b) for c in range(3) for a in range(12) for b in range(12) if a != b and 0 < min((a - b) % 12, (b - a) % 12) <= 3]
    edges = spark.createDataFrame(links, "src long, dst long")
    lists, places = graphs.tiled(edges)
    assert len({(r.node // 100, r["at"]) for r in places.collect()}) == places.select("at").distinct().count() == 3
    assert lists.count() == places.count() == 36
    sources = edges.select(F.col("src").alias("source")).distinct()
    want = sorted((c * 100 + a, c * 100 + b, (min((a - b) % 12, (b - a) % 12) + 2) // 3) for c in range(3) for a in range(12) for b in range(12))
    for tile, chunk in ((graphs.TILE, graphs.CHUNK), (7, 2)):
        monkeypatch.setattr(graphs, "TILE", tile)
        monkeypatch.setattr(graphs, "CHUNK", chunk)
        assert sorted(map(tuple, graphs.hops(edges, sources).collect())) == want


def test_supplier_links_are_merged_before_they_are_shuffled(spark, tmp_path):
    """What is shuffled of pairs that many orders repeat is one row for 64 suppliers, not one a pair."""
    rows = [(o, s) for o in range(3000) for s in ((o % 5), (o % 5) + 1, (o % 5) + 2)]
    spark.createDataFrame([*rows, (1, None), (None, 3)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = V.supplier_links(spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == {(a, b) for a in range(7) for b in range(7) if a != b and abs(a - b) <= 2}
    assert "bit_or" in df._jdf.queryExecution().toString() and "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_are_dealt_out_before_they_are_lexed(spark, tmp_path):
    from latentfield.plans.queries import script_files

    spark.range(60).selectExpr("id AS p_partkey", "'x' AS p_type").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert lexers.lexed(script_files(spark, str(tmp_path))).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_script_is_scanned_once(monkeypatch):
    scans, scan = [], lexers.script_scan
    monkeypatch.setattr(lexers, "script_scan", lambda text: scans.append(text) or scan(text))
    text = "import a from './b.js';\nconst c = a(1);\n"
    assert lexers.findings(text, ".ts") == (["a", "c"], [], [("./b.js", 0)], [("c", ["a", "c"])]) and len(scans) == 1
    for other, ext in ((text, ".rb"), ("from .m import x\ndef f(): pass\n", ".py"), (" \n", ".py"), ("", ".ts"), ("def (:", ".py")):
        assert lexers.findings(other, ext)[:3] == (lexers.identifiers(other, ext), lexers.definitions(other, ext), lexers.imports(other, ext))


@pytest.mark.parametrize("least", [1, 2])
def test_sizes_of_expanded_events(spark, least):
    words = spark.createDataFrame([(k, f"w{(k * 7 + j * j) % 23}") for k in range(40) for j in range(5)], "ord long, token string").distinct()
    want = sorted((r.ord, r["count"]) for r in proposals.expanded(words, least).groupBy("ord").count().collect())
    assert sorted(map(tuple, proposals.expanded_sizes(words, least).select("ord", "n_expanded").collect())) == want


def test_what_is_blanked_is_tried_only_where_its_mark_stands(spark):
    texts = ["plain words here", 'a "b \\" c" d', "x 'y' `z` /* k */ // m\nn # o", "/*'*/' / / it's", "a/*b", "/\"*\"* c */ d", "q /'/'/ r", "#'\n' s 't", "", None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, text string")
    plain = F.col("text")
    for pattern in lexers.STRIPPED:
        plain = F.regexp_replace(plain, pattern, " ")
    assert all(r.a == r.b for r in rows.select(lexers.stripped(F.col("text")).alias("a"), plain.alias("b")).collect())
    assert "regexp_replace(regexp_replace(" not in rows.select(lexers.stripped(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()


def test_words_become_tokens_in_generated_code(spark):
    names = ["labels", "class_", "Boss", "glass", "bus", "ownerIds", "HTTPServer2x", "_", "$", "A", "a", "X9s", "parts_parts"]
    files = spark.createDataFrame([(n, n) for n in names], "path string, text string")
    tokens = lexers.match_tokens(files, F.array("text"))
    want = files.select("path", F.explode(S.identifier_tokens(F.col("text"))).alias("t")).select("path", "t.space", "t.token").distinct()
    assert sorted(map(tuple, tokens.distinct().collect())) == sorted(map(tuple, want.collect()))
    plan = tokens._jdf.queryExecution().executedPlan().toString()
    made = plan.split("Generate explode(coalesce(", 1)[1].split("\n")[0]
    assert "lambda" not in made and plan.count("RLIKE") == 1  # split once, and words not at all


def test_reach_is_merged_word_by_word():
    """What neighbours hold is united as tables of words or word by word, in pieces of any size, alike and as a loop does it; names may be numbers or texts."""
    rng = random.Random(2)
    for name in (int, str):
        held = {name(u): {rng.randrange(20) * 3: rng.getrandbits(64) - (1 << 63) for _ in range(rng.randrange(1, 9))} for u in range(0, 60, 2)}
        sent = pa.table({"node": list(held), "blocks": [list(x) for x in held.values()], "words": [list(x.values()) for x in held.values()]})
        rows = [(rng.randrange(3), name(v), [name(u) for u in rng.sample(range(70), rng.randrange(1, 12))]) for v in range(50)]
        want = {}
        for _, v, near in rows:
            for u in near:
                for block, word in held.get(u, {}).items():
                    want[v, block] = want.get((v, block), 0) | word
        lists = pa.table(dict(zip(("at", "src", "dsts"), zip(*rows))))
        for merged, filled in ((1 << 18, 8), (16, 8), (16, 0), (16, 1 << 40)):
            got = {}
            for r in graphs.uniting(merged, filled)(sent, lists).to_pylist():
                got[r["node"], r["block"]] = got.get((r["node"], r["block"]), 0) | r["got"]
            assert got == {k: w for k, w in want.items() if w}
        assert graphs.uniting(16, 8)(sent.slice(0, 0), lists).num_rows == graphs.uniting(16, 8)(sent, lists.slice(0, 0)).num_rows == 0


def test_hops_of_a_connected_graph_end_with_its_last_pair(spark, monkeypatch):
    """Nothing is asked of a graph once all pairs are found; small tasks, which get their blocks in parts, give the same."""
    edges = graphs.undirected(spark.createDataFrame([(a, (a + k) % 90) for a in range(90) for k in range(1, 24)], "src long, dst long"))
    sources = spark.createDataFrame([(k,) for k in [*range(90), 999]], "source long")
    want = sorted([(a, b, -(-min((a - b) % 90, (b - a) % 90) // 23)) for a in range(90) for b in range(90)] + [(999, 999, 0)])
    for words in (graphs.WORDS, 40):
        monkeypatch.setattr(graphs, "WORDS", words)
        rounds, write = [], graphs.staged
        monkeypatch.setattr(graphs, "staged", lambda df, name: rounds.append(name) or write(df, name))
        assert sorted(map(tuple, graphs.hops(edges, sources).collect())) == want
        monkeypatch.setattr(graphs, "staged", write)
        assert [x for x in rounds if re.fullmatch(r"hops-\d", x)] == ["hops-0", "hops-1", "hops-2"]


def test_mean_distance_of_a_connected_graph_ends_with_its_last_pair(spark, monkeypatch):
    """No round follows the one that finds the last pair, also if blocks are dealt to several tasks; a node without an edge is at distance 1."""
    edges = graphs.undirected(spark.createDataFrame([(a, (a + k) % 130) for a in range(130) for k in range(1, 33)], "src int, dst int"))
    members = spark.createDataFrame([(k % 2, k) for k in range(130)] + [(2, 0), (2, 500)], "owner int, node int")
    near = {o: [-(-min(b - a, 130 - b + a) // 32) for a in range(o, 130, 2) for b in range(a + 2, 130, 2)] for o in (0, 1)}
    want = {o: sum(h / (h + 2) for h in d) / len(d) for o, d in near.items()} | {2: 1.0}
    monkeypatch.setattr(graphs, "WORDS", 100)
    rounds, write = [], graphs.staged
    monkeypatch.setattr(graphs, "staged", lambda df, name: rounds.append(name) or write(df, name))
    got = {r.owner: r.distance for r in graphs.mean_distances(members, edges).collect()}
    assert got.keys() == want.keys() and all(abs(got[o] - d) < 1e-9 for o, d in want.items())
    assert "hops-3" in rounds and "hops-4" not in rounds


def test_integration_label_of_suppliers_that_all_share_an_order(spark, tmp_path, monkeypatch):
    """One round finds all pairs, so none follows; the label is that of a distance of a third."""
    spark.createDataFrame([(k, k % 3) for k in range(100)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(7, k) for k in range(100)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    rounds, write = [], graphs.staged
    monkeypatch.setattr(graphs, "staged", lambda df, name: rounds.append(name) or write(df, name))
    assert sorted(map(tuple, queries.integration_label(spark, str(tmp_path)).collect())) == [(k, "RIPE") for k in range(3)]
    assert "hops-1" in rounds and "hops-2" not in rounds


def test_expanded_events_are_counted_in_parts(spark, monkeypatch):
    """Each pair of words is written once, a rare word in none; parts of events and blocks of any size count alike, as a loop does it."""
    rng = random.Random(8)
    texts = {k: {f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(rng.randrange(1, 30))} for k in range(70)} | {900: {"only", "here"}}
    words = spark.createDataFrame([(k, w) for k, ws in texts.items() for w in ws], "ord long, token string")
    held = Counter(w for ws in texts.values() for w in ws)
    common = Counter(p for ws in texts.values() for p in itertools.permutations(ws, 2))
    for least in (1, 3):
        near = {w: {w} for w in held}
        for (a, b), n in common.items():
            if n >= least:
                near[a].add(b)
        want = sorted((k, len(set().union(*(near[w] for w in ws)))) for k, ws in texts.items())
        for rows, at_once in ((1 << 20, 4096), (40, 3)):
            monkeypatch.setattr(proposals, "ROWS", rows)
            monkeypatch.setattr(proposals, "AT_ONCE", at_once)
            monkeypatch.setattr(proposals, "FEW", 20)
            tables, write = {}, proposals.staged
            monkeypatch.setattr(proposals, "staged", lambda df, name: tables.setdefault(name, write(df, name)))
            assert sorted(map(tuple, proposals.expanded_sizes(words, least).select("ord", "n_expanded").collect())) == want
            monkeypatch.setattr(proposals, "staged", write)
            if least > 1:
                assert tables["expanded-pairs"].count() == sum(n >= least for n in common.values()) // 2
                assert tables["expanded-asks"].select("id").distinct().count() == sum(n >= least for n in held.values())
