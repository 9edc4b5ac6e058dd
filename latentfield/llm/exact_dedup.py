"""Exact duplicates by deterministic block naming.

Texts without their white space are cut into blocks of BLOCK bytes. The distinct blocks are sorted and each is
named by its place; then adjacent names are paired, the distinct pairs sorted and named, and so on until a
document has one name. Texts of the same number of blocks have the same name exactly if all their bytes are
equal: no step trusts a hash.

A block is sorted by its address (two 64-bit hashes) and then by its bytes. Its bytes travel once, to the task that
counts the distinct blocks of an address; only where an address holds several are bytes needed again to tell the
names apart. Map tasks merge equal blocks and pairs first, and the name of a key with many rows goes back to them in
parts, so copies that hold a third of all rows meet in no task. A document's blocks are rows, so a level never holds a whole text.

Defined cases: null text counts as empty, and all empty texts are equal; a null doc_id comes after all others, and a
group whose kept row has none has a null keep_id; rows that repeat a doc_id are documents of their own, of which one is
kept; ties in length go to the smaller doc_id; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .common import discard, fresh, staged

#: Bytes of a block.
BLOCK = 4096
#: A key with more rows than this share of all, and than LEAST, gives its name back in parts; so at most 1,024 keys do.
SHARE, LEAST = 1024, 256
#: White space that doesn't count: fixed by the contract of the operator.
BLANKS = r"[\x20\x09-\x0D]+"


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def cut(data: Column) -> Column:
    """The blocks of a text's bytes; an empty text is one empty block."""
    last = F.floor(F.greatest(F.octet_length(data) - 1, F.lit(0)) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * BLOCK + 1, F.lit(BLOCK)))


def address(block: Column) -> tuple[Column, Column]:
    """Where a block is sorted to: two hashes that don't follow from each other."""
    return F.xxhash64(block), F.xxhash64(F.lit(1), block)


def given_back(rows: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """rows (row, i and keys) with what names say of their keys. names: one row for each, m of them in rows; a key with many is dealt out by row and number."""
    most = max(LEAST, (names.agg(F.sum("m")).first()[0] or 0) // SHARE)
    parts = F.ceil(F.col("m") / most)
    hot = names.where(F.col("m") > most).select(*keys, parts.cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("row", "i"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("part", part).drop("parts")  # SHARE rows at most
    return dealt.join(names.withColumn("part", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1))), [*keys, "part"]).drop("part", "m")


def block_names(texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Names (h, g, v, m, name) of all distinct blocks of texts (data); v tells blocks of one address apart. Besides, the blocks (h, g, block, v) of such addresses."""
    blocks = texts.select(F.explode(cut(F.col("data"))).alias("block"))
    h, g = address(F.col("block"))
    distinct = blocks.select(h.alias("h"), g.alias("g"), "block").groupBy("h", "g", "block").agg(F.count("*").alias("m"))
    held = staged(distinct.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("m").alias("m")), "block-addresses")
    clashing = held.where("n > 1").select("h", "g")
    several = None if clashing.isEmpty() else staged(by_place(distinct.drop("m").join(clashing, ["h", "g"])), "block-clashes")
    keys = held.select("h", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("v"), "m")
    return numbered(keys, "h", "g", "v", name="name", first=0), several


def by_place(blocks: DataFrame) -> DataFrame:
    """v: a block's place among the distinct blocks of its address."""
    at = numbered(blocks, "h", "g", "block", name="at", first=0)
    first = at.groupBy("h", "g").agg(F.min("at").alias("least"))
    return at.join(first, ["h", "g"]).select("h", "g", "block", (F.col("at") - F.col("least")).alias("v"))


def named(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_chars (of the original text), text_sha256, n_blocks and name of every row of docs (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("n_chars"), normal(F.col("text")).cast("binary").alias("data"))
    names, several = block_names(texts)
    parts = cut(F.col("data"))
    hashed = F.transform(parts, lambda b: F.struct(address(b)[0].alias("h"), address(b)[1].alias("g"), *([b.alias("block")] if several is not None else [])))
    rows = staged(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", F.sha2("data", 256).alias("text_sha256"), hashed.alias("blocks")), "named-rows")
    level = rows.select("row", F.posexplode("blocks").alias("i", "b")).select("row", "i", "b.*")
    if several is None:
        level = level.withColumn("v", F.lit(0).cast("long"))
    else:
        told = several.withColumnRenamed("v", "told")
        level = level.join(told, ["h", "g", "block"], "left").select("row", "i", "h", "g", F.coalesce("told", F.lit(0)).alias("v"))
    sized = rows.select("row", "doc_id", "n_chars", "text_sha256", F.size("blocks").alias("n_blocks"))
    level = staged(given_back(level, names, ["h", "g", "v"]).select("row", "i", "name"), "names-0")
    done = level.join(sized.where("n_blocks = 1").select("row"), "row", "left_semi").select("row", "name")
    open_ = level.join(sized.where("n_blocks > 1").select("row"), "row", "left_semi")
    old = [names, *([several] if several is not None else [])]
    k = 0
    while not open_.isEmpty():
        k += 1
        half = F.floor(F.col("i") / 2).cast("int")
        side = [F.max(F.when(F.col("i") % 2 == s, F.col("name"))) for s in (0, 1)]
        pairs = staged(open_.groupBy("row", half.alias("i")).agg(side[0].alias("a"), F.coalesce(side[1], F.lit(-1)).alias("b")), f"pairs-{k}")
        names = numbered(pairs.groupBy("a", "b").agg(F.count("*").alias("m")), "a", "b", name="name", first=0)
        level = staged(given_back(pairs, names, ["a", "b"]).select("row", "i", "name"), f"names-{k}")
        more = level.where("i > 0").select("row").distinct()
        done = done.unionByName(level.join(more, "row", "left_anti").select("row", "name"))
        open_ = level.join(more, "row", "left_semi")
        old += [pairs, names]
    result = staged(sized.join(done, "row"), "identities")
    for t in old:
        discard(t)
    return result


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs (doc_id, text). Of equal texts the longest original stays, then the smallest doc_id."""
    rows = named(docs)
    # of a group's rows the greatest stays: most characters, then the smallest id (none last), then any
    order = F.struct("n_chars", F.col("doc_id").isNotNull().alias("has_id"), (-F.col("doc_id")).alias("low"), "row")
    groups = rows.groupBy("n_blocks", "name").agg(F.max(order).alias("best"), F.count("*").alias("group_size"))
    keeps = staged(groups.select("n_blocks", "name", (-F.col("best.low")).alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size", F.col("group_size").alias("m")), "groups")
    found = given_back(rows.withColumn("i", F.lit(0)), keeps, ["n_blocks", "name"])
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    mark = fresh(docs, "__mark")
    numbered_docs = staged(docs.select(F.monotonically_increasing_id().alias(mark), *(F.col(f"`{c}`") for c in docs.columns)), "numbered-docs")
    rows = named(numbered_docs.select(F.col(mark).alias("doc_id"), "text"))
    ids = numbered_docs.select(F.col(mark).alias("at"), F.col("doc_id").cast("long").alias("own_id"))
    rows = rows.join(ids, rows.doc_id == ids.at)
    order = F.struct("n_chars", F.col("own_id").isNotNull().alias("has_id"), (-F.col("own_id")).alias("low"), "row")
    best = rows.groupBy("n_blocks", "name").agg(F.max(F.struct(order.alias("o"), "at")).alias("best")).select(F.col("best.at").alias(mark))
    return numbered_docs.join(best, mark, "left_semi").drop(mark)
