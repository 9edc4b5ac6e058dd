"""Whole pipelines over the small inputs, against the formulas in plain Python and values worked out by hand."""

import pytest

from latentfield.plans import pipelines, samples
from latentfield.sources import inputs as json_inputs
from tests import fixtures


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    return fixtures.write(tmp_path_factory.mktemp("inputs"))


def test_scan(spark, inputs):
    got = {r.capability: r for r in pipelines.scan(spark, *inputs).collect()}
    columns = ("correction", "capacity", "utilization", "score", "collapse_potential", "confidence")
    want = {name: fixtures.reading(e) for name, e in fixtures.EVIDENCE.items()}
    assert {k: tuple(r[c] for c in columns) for k, r in got.items()} == want
    assert {k: r.category for k, r in got.items()} == {k: fixtures.judged(v, fixtures.EVIDENCE[k][-1]) for k, v in want.items()}
    assert [k for k, r in sorted(got.items(), key=lambda x: x[1].rank)] == sorted(want, key=lambda k: -want[k][3])
    # watering matches symbols of one script only, so files count: one import of three pairs; frost: two files apart; stall: a call between its two symbols
    assert {k: r.integration_distance for k, r in got.items()} == {"watering": 0.7778, "bees": 0.0, "frost": 1.0, "seeds": 0.0, "stall": 0.3333}
    assert {k: r.integration for k, r in got.items()} == {"watering": "DEEP", "bees": "CO-LOCATED", "frost": "DEEP", "seeds": "CO-LOCATED", "stall": "RIPE"}
    e = got["watering"].evidence
    assert e.capacity_files == ["garden/water.py", "garden/weather.py", "pumps/drip.ts"] and e.matched_signals == ["dripLine", "rain_forecast", "soilMoisture", "valveSchedule"]
    assert (e.correction_count, e.demand, e.arrow_share, e.direction_coherence, e.usage_count) == (5, 4.2, 0.905, 0.8, 3.0)


def test_discover(spark, inputs):
    """Members and signals by hand: words that recur in a cluster, most frequent first; evidence as for declared capabilities."""
    got = {r.capability: r for r in pipelines.discover(spark, *inputs).collect()}
    want = {
        "emergent-hive-weight-chart": (["hive", "weight", "chart"], ["g7", "g8", "g9", "g10"], (4.0, 1.0, 1.0, True, 2, 3, 1, None)),
        "emergent-beds-dry-soil": (["beds", "dry", "soil", "water"], ["g0", "g1", "g2", "g3"], (3.8, 1.0, 4 / 5, True, 2, 4, 1, None)),
        "emergent-night-siren": (["night", "siren"], ["g5", "g6"], (3.5, 1.0, 1 / 2, True, 1, 2, 2, None)),
        "emergent-coin-receipt-returned": (["coin", "receipt", "returned"], ["g12"], (1.0, 1.0, 1.0, True, 0, 3, 0, None)),
    }
    assert {k: (r.signals, r.member_ids) for k, r in got.items()} == {k: v[:2] for k, v in want.items()}
    for name, (_, _, evidence) in want.items():
        r, values = got[name], fixtures.reading(evidence)
        assert (r.correction, r.capacity, r.utilization, r.score, r.collapse_potential, r.confidence) == values
        assert r.category == fixtures.judged(values, None)
    assert [r.rank for r in sorted(got.values(), key=lambda r: -r.score)] == [1, 2, 3, 4]


def test_discover_sends_no_table_of_events_through_the_driver(spark, inputs, monkeypatch):
    """Events meet their clusters once, by merging, however small the planner takes a few of their columns to be; what is returned reads no table of all events besides."""
    plans, write = {}, pipelines.staged
    monkeypatch.setattr(pipelines, "staged", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(df, name))
    full = pipelines.discover(spark, *inputs)
    assert "SortMergeJoin" in plans["relabelled"] and "BroadcastHashJoin" not in plans["relabelled"]
    files = full.inputFiles()
    assert any("/relabelled-" in f for f in files) and not any("/events-" in f or "/members-" in f for f in files)
    assert sorted(len(r.member_ids) for r in full.collect()) == [1, 2, 4, 4]


def test_reflect(spark, inputs):
    two = {r.capability: r for r in pipelines.reflect(spark, *inputs).collect()}
    knobs = ("c_half", "k_half", "u_half", "unknown_util_prior", "hi", "lo")
    for name, rows in fixtures.second_level().items():
        r = two[name]
        assert (r.configurations, r.cp_min, r.cp_max) == (729, min(x[4] for x in rows), max(x[4] for x in rows))
        assert r.rank1_share == pytest.approx(sum(x[2] for x in rows) / 729) and r.candidate_share == pytest.approx(sum(x[3] for x in rows) / 729)
        spread = {}
        for i, knob in enumerate(knobs):
            n = {}
            for s, cut, _, candidate, _ in rows:
                n[(*s, *cut)[i]] = n.get((*s, *cut)[i], 0) + candidate
            spread[knob] = (max(n.values()) - min(n.values()), n)
        best = max(knobs, key=lambda k: spread[k][0])
        assert r.knob == (best if spread[best][0] else None)
        if spread[best][0]:
            assert r.high_share == pytest.approx(max(spread[best][1].values()) / 243) and r.low_share == pytest.approx(min(spread[best][1].values()) / 243)
    three = {r.capability: r for r in pipelines.reflect(spark, *inputs, level=3).collect()}
    designs = fixtures.third_level()
    for name in fixtures.EVIDENCE:
        shares = [sum(x[3] for x in d[name]) / len(d[name]) for d in designs]
        first = [sum(x[2] for x in d[name]) / len(d[name]) for d in designs]
        r = three[name]
        assert (r.min_share, r.max_share, r.mean_share, r.rank1_min) == pytest.approx((min(shares), max(shares), sum(shares) / 6, min(first)))
        assert r.class_converges == (max(shares) - min(shares) <= 0.35)


def test_baseline_and_compare(spark, inputs, tmp_path):
    root, data = inputs
    pipelines.save_baseline(spark, root, data, str(tmp_path / "base"))
    now = pipelines.compare(spark, root, data, str(tmp_path / "base")).collect()
    assert len(now) == 5 and {r.verdict for r in now} == {"stable"}


def test_empty_inputs_are_told(spark, tmp_path):
    (tmp_path / "capabilities.json").write_text("[{")
    with pytest.raises(pipelines.NoInput):
        pipelines.scan(spark, str(tmp_path), str(tmp_path))
    with pytest.raises(pipelines.NoInput):
        pipelines.discover(spark, str(tmp_path), str(tmp_path))


def test_unrelated_capability_changes_no_reading(spark, inputs):
    from latentfield.operators import fields
    from latentfield.operators.readings import config, evidence, readings
    from latentfield.sources import inputs as sources

    root, data = inputs
    tokens = pipelines.tree_tokens(pipelines.lexed_tree(spark, root))
    caps = sources.capabilities(spark, data)
    d, u = fields.demand(sources.corrections(spark, data)), fields.usage(sources.usage(spark, data))
    found = [{r.capability: r for r in readings(evidence(c, d, fields.capacity(c, tokens), u), config(spark)).drop("ord").collect()} for c in (caps, caps.where("id <> 'seeds'"))]
    assert all(found[0][k] == r for k, r in found[1].items())


def test_module_map(spark, tmp_path):
    tree = {
        "pkg/__init__.py": "",
        "pkg/base.py": "class A:\n    def f(self): pass\ndef g(): pass\n",
        "pkg/use.py": "from .base import A\nfrom pkg import base\ndef h(): pass\n",
        "pkg/more.py": "import pkg.base\nfrom . import use\ndef k(): pass\n",
        "pkg/alone.py": "def z(): pass\n",
        "tests/test_use.py": "from pkg.use import h\ndef test_h(): pass\n",
        "node_modules/x/y.js": "function n() {}",
        "pkg/_hidden.py": "def q(): pass\n",
    }
    for path, text in tree.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found, totals = pipelines.code_map(spark, str(tmp_path))
    got = {r.path: (r.module, r.n_defs, r.in_degree, r.out_degree, r.is_isolated) for r in found.collect()}
    assert got["pkg/base.py"] == ("pkg.base", 3, 2, 0, False)
    assert got["pkg/use.py"] == ("pkg.use", 1, 0, 2, False)
    assert got["pkg/alone.py"][-1] and got["pkg/_hidden.py"][-1]
    assert "tests/test_use.py" not in got and "node_modules/x/y.js" not in got
    assert totals.first().n_tests == 1


def test_command_line_and_server(spark, inputs, tmp_path, capsys):
    import json
    import threading
    import urllib.request

    from latentfield.plans import cli
    from latentfield.plans.server import server

    root, data = inputs
    assert cli.main(["scan", "--repo", root, "--data", data, "--json", "--out", str(tmp_path / "o")]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["capability"] for x in lines][0] == "watering" and len(lines) == 5
    assert cli.main(["experiment"]) == 2
    with server(spark, root, data, 0) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{s.server_address[1]}"
        assert json.loads(urllib.request.urlopen(f"{at}/api/scan").read())[0]["capability"] == "watering"
        assert b"<table" in urllib.request.urlopen(at).read()
        s.shutdown()


def test_plans_match_by_equality(spark, sf):
    from latentfield.operators import fields
    from latentfield.sources import views

    found = fields.matches(views.capabilities(spark, sf), views.tokens(spark, sf))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_inputs_are_not_written_as_one_row(spark, tmp_path):
    """Order, nulls and repeated rows of an input stay, and its array is written a record a line."""
    rows = spark.createDataFrame([(3, "c", None), (1, "a", 1.0), (2, "b ]}", 2.0), (3, "c", None)], "ord int, capability string, count double")
    samples.write_json(rows, "usage", str(tmp_path))
    assert [tuple(r) for r in json_inputs.usage(spark, str(tmp_path)).orderBy("ord").collect()] == [(0, "a", 1.0), (1, "b ]}", 2.0), (2, "c", None), (3, "c", None)]
    assert spark.read.text(f"{tmp_path}/usage.json").count() == 4
    assert [f.endswith(".txt") for f in spark.read.text(f"{tmp_path}/usage.json").inputFiles()] == [True]
    samples.write_json(rows.limit(0), "corrections", str(tmp_path))
    assert json_inputs.corrections(spark, str(tmp_path)).isEmpty()
    assert spark.read.text(f"{tmp_path}/corrections.json").first().value == "[]"


def test_texts_are_staged_only_for_the_map(spark, inputs):
    assert "text" not in pipelines.lexed_tree(spark, inputs[0]).columns
    assert "text" in pipelines.lexed_tree(spark, inputs[0], texts=True).columns
