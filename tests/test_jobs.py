"""The jobs over small tables: reruns, growing input, runs that broke off, odd rows, command lines."""

import datetime
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import demand_ledger, fleet_scan
from jobs.common import settings
from latentfield.operators.fields import demand

ROOT = Path(__file__).resolve().parent.parent
EVENTS = demand_ledger.EVENTS.format(time_type="timestamp")


def files(folder):
    return sorted((p, os.path.getsize(p), os.path.getmtime(p)) for p in Path(folder).rglob("*.parquet"))


def event(day, capability, kind="correction", weight=None, tag="a", after="x"):
    at = None if day is None else datetime.datetime(2024, 3, day, 12)
    return (at, capability, kind, weight, after, None if tag is None else [tag])


FIRST = [event(1, "search"), event(1, "search", "retry"), event(1, "export", tag="b"), event(2, "search", weight=2.5), event(2, "search", tag="b"), event(None, "search"), event(3, None)]
MORE = [event(2, "search", tag="b"), event(4, "export"), event(4, "export", "request", tag=None), event(1, "audit", "zzz", after="")]


def expected(rows):
    """Demand of each day and capability by the batch operator, a day at a time."""
    out = {}
    for day in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == day]
        for r in demand(SPARK.createDataFrame(own, EVENTS)).collect():
            out[day and day.date(), r.capability] = (r["count"], round(r.demand, 6), round(r.arrow_share, 6), round(r.coherence, 6), r.direction_known)
    return out


def ledger(df):
    return {(r.day, r.capability): (r["count"], round(r.demand, 6), round(r.arrow_share, 6), round(r.coherence, 6), r.direction_known) for r in df.collect()}


@pytest.fixture(autouse=True)
def session(spark):
    global SPARK
    SPARK = spark


def test_ledger_takes_only_what_is_new(spark, tmp_path):
    events, state, output = f"{tmp_path}/events", f"{tmp_path}/state", f"{tmp_path}/ledger"
    spark.createDataFrame(FIRST, EVENTS).repartition(2).write.parquet(events)
    first = demand_ledger.run(spark, events=events, state=state, output=output)
    assert ledger(first) == expected(FIRST)
    before = files(output)
    assert ledger(demand_ledger.run(spark, events=events, state=state, output=output)) == expected(FIRST)
    assert files(output) == before  # nothing new, nothing written
    spark.createDataFrame(MORE, EVENTS).write.mode("append").parquet(events)
    second = demand_ledger.run(spark, events=events, state=state, output=output)
    assert ledger(second) == expected(FIRST + MORE)
    kept = {p for p, *_ in files(output)} & {p for p, *_ in before}
    assert any("day=__HIVE" in str(p) for p in kept) and not any("day=2024-03-02" in str(p) for p in kept)  # untouched days keep their files
    new = spark.read.schema(demand_ledger.SUMS).parquet(f"{state}/sums").where("batch = 1 AND tag IS NULL").agg(F.sum("n")).first()[0]
    assert new == len(MORE)  # the second batch holds the new events alone


def test_changes_follow_late_events(spark, tmp_path):
    events, state, output = f"{tmp_path}/events", f"{tmp_path}/state", f"{tmp_path}/ledger"
    spark.createDataFrame([event(1, "a"), event(2, "a"), event(2, "a"), event(9, "a")], EVENTS).write.parquet(events)

    def changes():
        return {r.day.day: (r.previous_day and r.previous_day.day, r.demand_change) for r in demand_ledger.run(spark, events=events, state=state, output=output).collect()}

    assert changes() == {1: (None, None), 2: (1, 1.0), 9: (None, None)}
    spark.createDataFrame([event(1, "a"), event(8, "a")], EVENTS).write.mode("append").parquet(events)
    assert changes() == {1: (None, None), 2: (1, 0.0), 8: (None, None), 9: (8, 0.0)}


def test_a_run_that_broke_off_is_made_good(spark, tmp_path, monkeypatch):
    events, state, output = f"{tmp_path}/events", f"{tmp_path}/state", f"{tmp_path}/ledger"
    spark.createDataFrame(FIRST, EVENTS).write.parquet(events)

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # the sums are there, the ledger isn't
        m.setattr(demand_ledger, "published", fails)
        with pytest.raises(RuntimeError):
            demand_ledger.run(spark, events=events, state=state, output=output)
    assert demand_ledger.read_output(spark, output).count() == 0
    assert ledger(demand_ledger.run(spark, events=events, state=state, output=output)) == expected(FIRST)
    # the newest batch is done again: its commit is lost, so the stream repeats it
    for name in ("0", ".0.crc"):
        os.remove(f"{state}/checkpoint/commits/{name}")
    assert ledger(demand_ledger.run(spark, events=events, state=state, output=output)) == expected(FIRST)


def test_many_days_and_no_files(spark, tmp_path, monkeypatch):
    os.mkdir(f"{tmp_path}/none")
    assert demand_ledger.run(spark, events=f"{tmp_path}/none", state=f"{tmp_path}/s0", output=f"{tmp_path}/o0").count() == 0
    monkeypatch.setattr(demand_ledger, "NAMED_DAYS", 1)
    spark.createDataFrame(FIRST + MORE, EVENTS).write.json(f"{tmp_path}/events")
    got = demand_ledger.run(spark, events=f"{tmp_path}/events", state=f"{tmp_path}/s", output=f"{tmp_path}/o", settings={"format": "json", "files_per_batch": 1})
    assert ledger(got) == expected(FIRST + MORE)


CAPS = [(0, "find", "Find", ["invoice", "total"]), (1, "send", "Send", ["mail", "mail"]), (2, "rare", "Rare", ["zeppelin"]), (3, "find", "again", ["mail"])]
DOCS = [("red", "a", "invoiceTotal mail"), ("red", "b", "invoice"), ("red", "c", None), ("", "d", "mail_total"), (None, "e", "mail"), ("blue", "f", "nothing here")]


def fleet(spark, tmp_path, docs, **more):
    caps = spark.createDataFrame(CAPS, fleet_scan.CAPABILITIES)
    events = spark.createDataFrame([("find", "request", None, "x", ["a"]), ("send", "retry", None, "", None)], "capability string, kind string, weight double, after string, direction array<string>")
    usage = spark.createDataFrame([("send", 4.0)], "capability string, count double")
    docs = spark.createDataFrame(docs, "source string, path string, text string")
    return fleet_scan.run(spark, documents=docs, capabilities=caps, events=events, usage=usage, output=f"{tmp_path}/fleet", settings=more)


def test_fleet_scan_by_source(spark, tmp_path):
    got = {(r.source, r.capability): r for r in fleet(spark, tmp_path, DOCS).collect()}
    assert set(got) == {(s, c) for s in ("red", "blue", None) for c in ("find", "send", "rare")}
    red = got["red", "find"]
    assert (red.n_files, red.hits, red.n_matched, red.rank, red.label) == (2, 3, 2, 1, "Find")
    assert [(x.path, x.hits) for x in red.leading] == [("a", 2), ("b", 1)]
    none = got[None, "send"]
    assert (none.n_files, none.hits, none.n_matched, none.known) == (2, 4, 1, True)  # null and empty sources are one
    assert got["blue", "find"].n_files == 0 and got["blue", "find"].score == 0 and got["blue", "find"].leading == []
    for s in ("red", "blue", None):
        assert sorted(got[s, c].rank for c in ("find", "send", "rare")) == [1, 2, 3]


def test_fleet_scan_again_and_in_part(spark, tmp_path):
    first = sorted(map(repr, fleet(spark, tmp_path, DOCS).collect()))
    assert sorted(map(repr, fleet(spark, tmp_path, DOCS).collect())) == first
    changed = [("red", "a", "mail mail"), ("blue", "f", "mail")]
    part = {(r.source, r.capability): r.n_files for r in fleet(spark, tmp_path, changed, sources=["red"]).collect()}
    assert part["red", "send"] == 1 and part["red", "find"] == 0 and part["blue", "send"] == 0 and part[None, "send"] == 2  # other folders stay
    whole = {r.source for r in fleet(spark, tmp_path, changed).collect()}
    assert whole == {"red", "blue"}  # a whole run leaves nothing of before
    assert fleet(spark, tmp_path, []).count() == 0


def test_settings(tmp_path):
    for job in (fleet_scan, demand_ledger):
        name = job.__name__.rsplit(".", 1)[-1]
        assert set(settings(str(ROOT / "jobs" / f"{name}.json"), job.DEFAULTS)) == set(job.DEFAULTS)
    (tmp_path / "odd.json").write_text(json.dumps({"colour": 1}))
    with pytest.raises(ValueError, match="colour"):
        settings(str(tmp_path / "odd.json"), fleet_scan.DEFAULTS)


def test_command_line(spark, tmp_path):
    spark.createDataFrame(FIRST, EVENTS).write.parquet(f"{tmp_path}/events")
    args = [sys.executable, "-m", "jobs.demand_ledger", "--config", "jobs/demand_ledger.json", "--events", f"{tmp_path}/events", "--state", f"{tmp_path}/state", "--output", f"{tmp_path}/out"]
    done = subprocess.run(args, cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.session.timeZone=UTC pyspark-shell"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"read {len(FIRST)} new events" in done.stderr and "wrote" in done.stderr
    assert ledger(demand_ledger.read_output(spark, f"{tmp_path}/out")) == expected(FIRST)
