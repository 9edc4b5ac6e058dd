"""A source tree as a table (SRC3-7): path, ext, text.

Spark's own file readers drop names that begin with _ or . and don't prune folders, so the tree is listed here. The driver lists
names and sizes, as it does for Spark's own readers, and deals them out by size: a partition is a few runs of names, so a large flat
folder has many and small folders share one. A run brings its names along, packed, since a task that listed its folder again would list
all of it for the few files of its own. A tree of more than MOST files is listed as far as that; a task walks each folder below.
Filters on ext and on the beginning of path are taken over: other files are never opened, and folders off the path never listed.
Unreadable folders and files are skipped. Reading needs a file system that all executors mount.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

#: Folders that never hold a project's own code; fixed list, and this engine's output folder.
IGNORED = frozenset([
    "node_modules", ".git", "dist", "build", ".latentfield",
    ".venv", "venv", "env", "__pycache__", ".pytest_cache", ".mypy_cache",
    "site-packages", ".tox", "vendor", "target", ".next", "out", "coverage",
])
#: Extensions that are scanned, case-sensitive; fixed list.
EXTENSIONS = (
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs",
    ".py", ".go", ".rb", ".java", ".rs", ".php", ".cs",
)
SCHEMA = "path string, ext string, text string"
#: Partitions that are wanted at least, if there are as many files, and bytes of one at most, but for a single larger file.
ENOUGH, BYTES = 128, 64 << 20
#: What opening a file costs, in bytes read.
OPENING = 64 << 10
#: Files that the driver lists at most; it holds each one's name and a number while it deals them out.
MOST = 8_000_000
#: Spark asks a source of this kind for its filters only with this setting.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def extension(name: str) -> str:
    """From the last dot, unless that leads the name."""
    at = name.rfind(".")
    return name[at:] if at > 0 else ""


def packed(names: list[str]) -> bytes:
    """No name holds a slash."""
    return zlib.compress("/".join(names).encode("utf-8", "surrogateescape"), 1)


def unpacked(names: bytes) -> list[str]:
    return zlib.decompress(names).decode("utf-8", "surrogateescape").split("/")


class Part(InputPartition):
    """Runs of names (folder, first, last) whose files are read, with all names of each run, and folders that are walked whole."""

    def __init__(self, runs: list[tuple[str, str, str]], names: list[bytes], deep: list[str]):
        super().__init__((runs, names, deep))
        self.runs, self.names, self.deep = runs, names, deep


class CodeTreeReader(DataSourceReader):
    def __init__(self, root: str, extensions: tuple[str, ...]):
        self.root, self.extensions, self.prefixes = root, extensions, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over equality and lists of extensions, and equality with and beginnings of the path; what isn't taken over is given back."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("ext",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.extensions = tuple(e for e in self.extensions if e in wanted)
            elif isinstance(f, IsNotNull):
                continue  # no column is ever null
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            else:
                if isinstance(f, EqualTo) and f.attribute == ("path",) and isinstance(f.value, str):
                    self.prefixes.append(f.value)  # leads there; the equality itself is left to Spark
                yield f

    def relative(self, full: str) -> str:
        return os.path.relpath(full, self.root).replace(os.sep, "/")

    def leads(self, folder: str) -> bool:
        """Whether files that are asked for can lie below the folder."""
        inside = "" if folder == self.root else self.relative(folder) + "/"
        return all(inside.startswith(p) or p.startswith(inside) for p in self.prefixes)

    def wanted(self, folder: str, name: str) -> bool:
        return extension(name) in self.extensions and (not self.prefixes or all(self.relative(os.path.join(folder, name)).startswith(p) for p in self.prefixes))

    def listed(self, folder: str) -> tuple[list[tuple[str, int]], list[str]]:
        """Names and sizes of a folder's files that are asked for, in order, and the folders in it."""
        files, inside = [], []
        try:
            for e in sorted(os.scandir(folder), key=lambda e: e.name):
                if e.is_dir():
                    if e.name not in IGNORED and not e.is_symlink() and self.leads(full := os.path.join(folder, e.name)):
                        inside.append(full)
                elif self.wanted(folder, e.name):
                    try:
                        files.append((e.name, e.stat().st_size + OPENING))
                    except OSError:
                        continue
        except OSError:
            return files, []
        return files, inside

    def partitions(self) -> list[Part]:
        folders, todo, n = [], [self.root], 0
        while todo and n < MOST:
            folder = todo.pop()
            files, inside = self.listed(folder)
            n += len(files)
            if files:  # a text and an array, not objects for each file
                folders.append((folder, "/".join(name for name, _ in files), array("q", (size for _, size in files))))
            todo += reversed(inside)
        most = max(1, min(BYTES, sum(sum(sizes) for _, _, sizes in folders) // ENOUGH))
        parts, runs, texts, held = [], [], [], 0

        def end_run(folder: str, names: list[str]) -> None:
            if names:
                runs.append((folder, names[0], names[-1]))
                texts.append(packed(names))

        for folder, joined, sizes in folders:
            names = []
            for name, size in zip(joined.split("/"), sizes):
                if held and held + size > most:
                    end_run(folder, names)
                    parts.append(Part(runs, texts, []))
                    runs, texts, names, held = [], [], [], 0
                names.append(name)
                held += size
            end_run(folder, names)
        return [*parts, *([Part(runs, texts, [])] if runs else []), *(Part([], [], [x]) for x in todo)] or [Part([], [], [])]

    def files(self, part: Part) -> Iterator[tuple[str, str]]:
        for (folder, _, _), names in zip(part.runs, part.names):
            yield from ((folder, x) for x in unpacked(names))
        for top in part.deep:
            for folder, inside, names in os.walk(top):
                inside[:] = sorted(x for x in inside if x not in IGNORED and self.leads(os.path.join(folder, x)))
                yield from ((folder, x) for x in sorted(names))

    def read(self, partition: Part) -> Iterator[tuple[str, str, str]]:
        for folder, name in self.files(partition):
            if not self.wanted(folder, name):
                continue
            full = os.path.join(folder, name)
            try:
                with open(full, encoding="utf-8", errors="replace", newline="") as f:
                    yield self.relative(full), extension(name), f.read()
            except OSError:
                continue


class CodeTree(DataSource):
    """spark.read.format("codetree").option("extensions", ".py,.go").load(root)"""

    @classmethod
    def name(cls) -> str:
        return "codetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CodeTreeReader:
        wanted = self.options.get("extensions")
        return CodeTreeReader(self.options["path"], tuple(wanted.split(",")) if wanted else EXTENSIONS)


def code_files(spark: SparkSession, root: str) -> DataFrame:
    """All files of the tree; filters on ext and path, and conditions joined by AND to them, go into the listing. Turns PUSHDOWN on for the session."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(CodeTree)
    return spark.read.format("codetree").load(root)
