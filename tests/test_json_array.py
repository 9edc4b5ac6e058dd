"""Arrays read in parts against the same arrays parsed whole."""

import json
import random

import pytest

from latentfield.sources import inputs
from latentfield.sources.json_array import split_rows

SCHEMA = "id string, n double, l array<string>"
ODD = ["", "}", "{", '"', '\\"', "\\", "]},{[", "é}ü", "\n\t", "💧", 'a"}b', "null", "x" * 300, '\\\\"}']


def made(seed, n):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(ODD) for _ in range(r.randrange(4)))
    rows = [{"id": text(), "n": r.choice([1.5, -2e3, 7, None]), "l": [text() for _ in range(r.randrange(3))], "more": {"deep": [{"x": text()}, {}, []]}} for _ in range(n)]
    for row in rows:
        for k in ("n", "l", "more"):
            if r.random() < 0.2:
                del row[k]
    return rows


@pytest.fixture
def splits(spark):
    """Sets the size of splits, for the test alone."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, str(size))
    spark.conf.set(name, before)


def plain(rows):
    return [(k, r.get("id"), None if r.get("n") is None else float(r["n"]), r.get("l")) for k, r in enumerate(rows)]


def got(df):
    return [(r.ord, r.id, r.n, r.l) for r in df.orderBy("ord").collect()]


@pytest.mark.parametrize("size", [40, 64, 1000, 1 << 20])
def test_parts_equal_the_whole(spark, tmp_path, splits, size):
    rows = made(size, 12 if size < 50 else 60)
    form = {40: {"indent": 2}, 64: {"ensure_ascii": False}, 1000: {"separators": (" ,\r\n", "\t: ")}}.get(size, {})
    path = tmp_path / "a.json"
    path.write_bytes((" \n" + json.dumps(rows, **form) + "\n ").encode())
    splits(size)
    df, other = split_rows(spark, str(path), SCHEMA)
    assert not other and got(df) == plain(rows)
    assert got(inputs.json_rows(spark, str(path), SCHEMA)) == plain(rows)


BROKEN = [
    '[{"id": "a"}, {"id": "b", "n": }]', '[{"id": "a"} {"id": "b"}]', '[{"id": "a"},, {"id": "b"}]', '[{"id": "a"}, {"id": "b"}]}', '[{"id": "a"}, {"id": "b"}', '[{"id": "a"}, {"id": "b"},]',
    '{"id": "a"}, {"id": "b"}]', '[{"id": "a"}, {"id": "b"}] x', '[{"id": "a"}, 3, {"id": "b"}]', '[{"id": "a", "id": "c"}, {"id": "b"}]', '[{"id": "a}, {"id": "b"}]', '[[{"id": "a"}, {"id": "b"}]]',
    '[{"id": "a"}, {"id": "b"}]]', '[{"id": "a"}, {"id": "b"}], [{"id": "c"}]', '[{"id": "a"}, {"id": "b"}], "k": 1', '[{"id": "a"}, {"id": "b"}}', '[{"id": "a\\"}, {"id": "b"}]', '[{"id": a}, {"id": "b"}]', '[{"id": "a"} , ] {"id": "b"}]',
]


def test_malformed_arrays_are_empty_in_parts_too(spark, tmp_path, splits):
    """All of a file or nothing of it; a file beside it is read all the same."""
    for k, text in enumerate(BROKEN):
        (tmp_path / f"{k:02}.json").write_text(text)
    (tmp_path / "zz.json").write_text('[{"id": "good"}, {"id": "too"}]')
    splits(20)
    df, other = split_rows(spark, str(tmp_path), SCHEMA)
    assert sorted(x.rsplit("/", 1)[1] for x in other) == [f"{k:02}.json" for k in range(len(BROKEN))]
    assert [r.id for r in df.orderBy("ord").collect()] == ["good", "too"]
    assert [r.id for r in inputs.json_rows(spark, str(tmp_path), SCHEMA).orderBy("ord").collect()] == ["good", "too"]


def test_what_is_no_array_of_objects_is_read_whole(spark, tmp_path, splits):
    for k, text in enumerate(("[]", "  [ ]\n", "", '{"id": "a"}', '[null, {"id": "b"}]', '\ufeff[{"id": "c"}]', '[{"id": "d"}, {"id": "e"}]')):
        (tmp_path / f"{k}.json").write_text(text + " " * 90 if text else text)
    splits(60)
    parts = sorted(got(inputs.json_rows(spark, str(tmp_path), SCHEMA)), key=str)
    splits(1 << 20)
    assert parts == sorted(got(inputs.json_rows(spark, str(tmp_path), SCHEMA)), key=str)
    assert [(r[0], r[1]) for r in parts] == [(0, "a"), (0, "d"), (0, None), (1, "b"), (1, "e")]


def test_parts_are_tasks(spark, tmp_path, splits):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(made(1, 400)))
    splits(path.stat().st_size // 16)
    from latentfield.sources.json_array import pieces

    assert pieces(spark, str(path)).rdd.getNumPartitions() >= 16


def test_arrays_are_one_file_each_however_the_join_is_planned(spark, tmp_path):
    """A join that is planned as a shuffle and turned into a broadcast while it runs leaves no array in pieces."""
    from latentfield.plans.queries import json_arrays

    rows = [(k, "en", f"text {k} }}") for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(x, None) for x in names]
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], str(10 << 20))
        spark.conf.set(names[2], "false")
        found = sorted((r.doc_id, r.ord) for r in json_arrays(spark, str(tmp_path)).collect())
    finally:
        for name, value in zip(names, before):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert found == [(k, k // 4) for k in range(400)]
