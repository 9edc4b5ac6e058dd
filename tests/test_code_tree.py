"""The source of a code tree: what it lists, opens and how it deals files out."""

import builtins
import os

import pytest
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from latentfield.sources import code_tree as C


def write(root, paths):
    for p in paths:
        os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
        with open(f"{root}/{p}", "w") as f:
            f.write(f"# {p}")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tree"))
    write(at, ["a.py", "b.ts", "_own/__init__.py", "core/x.py", "core/deep/y.py", "core/deep/z.go", "core2/w.py", "node_modules/no.py", ".git/no.py", "core/.hidden.py", "notes.txt", "core/README"])
    return at


def seen(reader, monkeypatch):
    """Paths that all partitions give, and those that were opened for it."""
    opened, plain = [], builtins.open

    def counting(path, *a, **k):
        opened.append(path)
        return plain(path, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(builtins, "open", counting)
        return sorted(p for part in reader.partitions() for p, _, _ in reader.read(part)), sorted(reader.relative(x) for x in opened)


ALL = ["_own/__init__.py", "a.py", "b.ts", "core/.hidden.py", "core/deep/y.py", "core/deep/z.go", "core/x.py", "core2/w.py"]


@pytest.mark.parametrize("most", [2_000_000, 1, 0])
def test_all_files(root, monkeypatch, most):
    monkeypatch.setattr(C, "MOST", most)  # what isn't listed is walked by tasks
    assert seen(C.CodeTreeReader(root, C.EXTENSIONS), monkeypatch) == (ALL, ALL)


@pytest.mark.parametrize(
    ("filters", "want", "left"),
    [
        ([EqualTo(("ext",), ".go")], ["core/deep/z.go"], 0),
        ([In(("ext",), (".go", ".ts", ".txt"))], ["b.ts", "core/deep/z.go"], 0),
        ([StringStartsWith(("path",), "core/")], ["core/.hidden.py", "core/deep/y.py", "core/deep/z.go", "core/x.py"], 0),
        ([StringStartsWith(("path",), "core/d"), EqualTo(("ext",), ".py")], ["core/deep/y.py"], 0),
        ([StringStartsWith(("path",), "core"), StringStartsWith(("path",), "co")], ["core/.hidden.py", "core/deep/y.py", "core/deep/z.go", "core/x.py", "core2/w.py"], 0),
        ([EqualTo(("path",), "core/x.py")], ["core/x.py"], 1),
        ([EqualTo(("ext",), ".txt")], [], 0),
        ([EqualTo(("text",), "x")], ALL, 1),
    ],
)
@pytest.mark.parametrize("most", [2_000_000, 1])
def test_only_what_is_asked_for_is_opened(root, monkeypatch, filters, want, left, most):
    monkeypatch.setattr(C, "MOST", most)
    reader = C.CodeTreeReader(root, C.EXTENSIONS)
    assert len(list(reader.pushFilters(filters))) == left
    got, opened = seen(reader, monkeypatch)
    assert got == want and opened == want


def test_filters_reach_the_source(spark, root):
    files = C.code_files(spark, root)
    assert sorted(r.path for r in files.collect()) == ALL
    some = files.where("ext = '.py' AND startswith(path, 'core/') AND length(text) > 3").select("path")
    assert sorted(r.path for r in some.collect()) == ["core/.hidden.py", "core/deep/y.py", "core/x.py"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    left = plan.split("Filter", 1)[1].split("\n")[0]
    assert "ext#" not in left.replace("text#", "") and "path#" not in left  # Spark has only the length left to test


def test_a_flat_folder_is_dealt_out(tmp_path):
    """Many files of one folder make many tasks of about equal size, one large file a task of its own."""
    write(str(tmp_path), [f"f{k:05d}.py" for k in range(6000)])
    with open(tmp_path / "f03000.py", "w") as f:
        f.write("x" * (20 << 20))
    reader = C.CodeTreeReader(str(tmp_path), C.EXTENSIONS)
    parts = reader.partitions()
    assert len(parts) >= 64
    counts = [sum(1 for _ in reader.files(p)) for p in parts]
    assert sum(counts) == 6000 and max(counts) < 6000 / 40
    assert any(r == [(str(tmp_path), "f03000.py", "f03000.py")] for r in (p.runs for p in parts))


def test_tasks_do_not_list_a_folder_again(tmp_path, monkeypatch):
    """Each of the many parts of a flat folder knows its own files, so the folder is listed once, by the driver."""
    names = [f"f{k:05d}.py" for k in range(3000)] + ["ä ö.py"]
    write(str(tmp_path), names)
    open(os.fsencode(tmp_path) + b"/\xff.py", "wb").close()  # no text
    reader = C.CodeTreeReader(str(tmp_path), C.EXTENSIONS)
    parts = reader.partitions()
    assert len(parts) >= 64

    def no_list(*_):
        raise AssertionError("a folder was listed by a task")

    with monkeypatch.context() as m:
        m.setattr(os, "listdir", no_list)
        m.setattr(os, "scandir", no_list)
        m.setattr(os, "walk", no_list)
        assert sorted(p for part in parts for p, _, _ in reader.read(part)) == sorted([*names, "\udcff.py"])


def test_no_tree(spark, tmp_path):
    assert C.code_files(spark, str(tmp_path / "none")).count() == 0
