"""A source tree made from the keys of a warehouse table: inputs of the registered queries over trees. {k} is a file's key, {p} the one before, {o} another's."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .staging import shared_dir

#: One file's text for each extension that is scanned.
TEXTS = {
    ".ts": "import { makeT{o} } from './t{o}.js';\n// makes {k}\nexport function makeT{k}(size: number) {\n  return makeT{o}(size);\n}\n",
    ".tsx": "import x{k} from 'react';\nimport { makeT{p} } from './f{p}';\nexport const View{k} = (props: Props) => makeT{p}(x{k}(props));\n",
    ".js": "const a{k} = require('./a{o}');\nmodule.exports = a{k}.run;\n",
    ".jsx": "export default class Box{k} extends Base {\n  draw() { return this.edge{k}; }\n}\n",
    ".mjs": "export * from './m{o}.mjs';\nlet count{k} = 0x1f;\n",
    ".cjs": "var s{k} = `a ${b{k}} c`; // 'd'\n",
    ".py": "from .m{o} import x{k}\nfrom . import y{k}\n\nclass Cls{k}:\n    def run{k}(self):  # z\n        return x{k} + y{k}\n",
    ".go": "package p\n\n// Note\nfunc Do{k}(n Count) Count { return n }\n\ntype T{k} struct { Name Label }\n",
    ".rb": "require './r{o}'\nclass Shelf{k}\n  def pick{k}(name) # later\n    name.size\n  end\nend\n",
    ".java": "class Cart{k} {\n  /* sum */\n  long total{k}(Item item) { return item.price; }\n}\n",
    ".rs": "struct Pump{k} { rate: u32 }\nfn drain{k}(p: &Pump{k}) -> u32 { p.rate }\n",
    ".php": "<?php\nfunction greet{k}($name) { return 'x' . $name; }\nclass Host{k} {}\n",
    ".cs": "class Gate{k} {\n  public bool Open{k}(Pass pass) { return pass.Valid; }\n}\n",
}
#: What no lexer of its extension can read.
BROKEN = "def (:\n  total{k} = other{k}\n"
#: Folders by key: the last is among those that are never walked.
FOLDERS = ("app", "lib", "core/deep", "_own", "node_modules")


def filled(text: Column, key: Column, other: Column) -> Column:
    for mark, number in (("{k}", key), ("{p}", key - 1), ("{o}", other)):
        text = F.replace(text, F.lit(mark), number.cast("string"))
    return text


def by_key(choices: Iterable[str], key: Column) -> Column:
    return F.element_at(F.array(*(F.lit(c) for c in choices)), (key % len(tuple(choices)) + 1).cast("int"))


def tree(parts: DataFrame) -> DataFrame:
    """(path, ext, text) of a file for each part; one Python file in seven is broken."""
    key, other = F.col("p_partkey"), (F.col("p_partkey") * 7 + 3) % 100
    ext = by_key(tuple(TEXTS), key)
    text = F.when((ext == ".py") & (key % 7 == 0), F.lit(BROKEN)).otherwise(by_key(tuple(TEXTS.values()), key))
    return parts.select(F.concat(by_key(FOLDERS, F.floor(key / 13)), F.lit("/f"), key.cast("string"), ext).alias("path"), ext.alias("ext"), filled(text, key, other).alias("text"))


def write_tree(files: DataFrame) -> str:
    """Writes (path, text) as files of a new folder that driver and executors share, by tasks; gives the folder."""
    found = shared_dir(files.sparkSession)
    if not found.startswith(("file:", "/")):
        raise ValueError("a source tree needs a shared folder that is mounted")
    root = f"/{found.removeprefix('file:').lstrip('/')}/tree-{uuid.uuid4().hex}"

    def put(rows: Iterable[Row]) -> None:
        made = set()
        for r in rows:
            at = os.path.join(root, r.path)
            if (folder := os.path.dirname(at)) not in made:
                os.makedirs(folder, exist_ok=True)
                made.add(folder)
            with open(at, "w", encoding="utf-8", newline="") as f:
                f.write(r.text)

    files.select("path", "text").foreachPartition(put)
    return root


def write_json(rows: DataFrame, name: str, folder: str) -> None:
    """An input file: one JSON array, a record a line, in order of ord. The array is never one row; one task writes its lines, since it is one file."""
    fields = [c for c in rows.columns if c != "ord"]
    placed = numbered(rows.select("ord", F.to_json(F.struct(*fields)).alias("value")), "ord", "value", name="place")
    n = placed.count()
    before, behind = F.when(F.col("place") == 1, F.lit("[")).otherwise(F.lit(",")), F.when(F.col("place") == n, F.lit("]")).otherwise(F.lit(""))
    lines = placed.repartition(1).sortWithinPartitions("place").select(F.concat(before, "value", behind).alias("value"))
    (lines if n else rows.sparkSession.range(1).select(F.lit("[]").alias("value"))).write.text(f"{folder}/{name}.json")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/inputs-{uuid.uuid4().hex}"
