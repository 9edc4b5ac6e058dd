"""Substring dedup by paragraph MinHash banding.

Repeated passages sit anywhere in a text, so its paragraphs are found by content, not by line ends: of each
run of WINDOW words the one where the smallest hash of ANCHOR words stands begins a paragraph of SPAN
words. Any passage of SPAN + WINDOW - 1 = 50 words or more holds at least one, the same one wherever it
stands; a changed word moves only the anchors that it is part of.

Each line, each block between blank lines and the whole text, of SPAN words or more, is a paragraph as
well, so near copies with changes inside are compared whole.

Equal paragraphs are one class. Classes are banded by min-hashes of their 5-word shingles, with as
many bands as the wanted recall at the threshold needs; those that collide are verified by exact
Jaccard similarity, and linked classes are united to components. A component that stands in several
documents is a repeat: it stays in the first of them, in the others it is a removal. Paragraphs only find the
matches: each is compared with the first document that holds it and grows to both sides over all words that agree;
spans that touch are one. deduplicated() gives the texts without these spans.

Defined cases: null and empty texts and texts of fewer than SPAN words have no paragraphs and no
rows, as have rows with a null doc_id; rows that repeat a doc_id count as one document; repeats inside one document
alone aren't reported; an empty table gives no rows; long texts are used whole; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import components
from .common import discard, fresh, in_parts, small, staged, text_bytes
from .shingles import IS_SPACE, Bands, linked, mixed, overlap, pieces, powers, text_words, word_hashes

SPAN = 16
WINDOW = 35
ANCHOR = 3
WIDTH = 5
PERCENT = 80
CHUNK = 512


def tuned_bands(rows: int = 2, least: float = PERCENT / 100, recall: float = 0.98) -> int:
    """The fewest bands of so many rows whose collisions find a pair at the threshold with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - least**rows))


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of width words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(width))
    for i in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mixed(h)


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least or greatest of each run of width numbers, from runs of doubled lengths."""
    have = 1
    while 2 * have <= width:
        x, have = best(x[:-have], x[have:]), 2 * have
    return best(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def paragraph_starts(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Where the smallest hash of each run of windows stands: all places where it does, or the first alone in texts that repeat themselves much."""
    n = len(grams)
    if n <= window:
        return np.array([grams.argmin()]) if n else np.zeros(0, np.int64)
    least = sliding(grams, window, np.minimum)
    around = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    out = np.flatnonzero(sliding(around, window, np.maximum) == grams)
    if len(out) <= n // 6:
        return out
    first = []
    for s in range(0, n - window + 1, 1 << 16):
        part = np.lib.stride_tricks.sliding_window_view(grams[s : s + (1 << 16) + window - 1], window)
        first.append(np.unique(part.argmin(axis=1) + np.arange(len(part))) + s)
    return np.unique(np.concatenate(first))


def blocks_of(data: bytes, n_words: int) -> np.ndarray:
    """First word and number of words of each line, each block between blank lines and the whole text, of SPAN words or more."""
    line_ends = []
    words = 0
    for part in pieces(data):  # cut behind white space, so no word is cut
        raw = np.frombuffer(part, np.uint8)
        space = IS_SPACE[raw]
        starts = np.flatnonzero(~space & np.append(True, space[:-1])) if len(raw) else np.zeros(0, np.int64)
        line_ends.append(np.searchsorted(starts, np.flatnonzero(raw == 10)) + words)
        words += len(starts)
    ends, times = np.unique(np.concatenate(line_ends), return_counts=True)
    spans = [np.array([[0, n_words]], np.int64)]
    for cuts in (ends, ends[times > 1]):
        cuts = np.concatenate([[0], cuts[(cuts > 0) & (cuts < n_words)], [n_words]])
        spans.append(np.stack([cuts[:-1], np.diff(cuts)], axis=1))
    found = np.concatenate(spans)
    found = found[found[:, 1] >= SPAN]
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    return found[np.append(True, (found[1:] != found[:-1]).any(axis=1))] if len(found) else found


def block_least(shingles: np.ndarray, spans: np.ndarray, hashes: Bands) -> np.ndarray:
    """The min-hashes of each span (first word, number of words) over all its shingles: a row for each hash."""
    bounds = np.stack([spans[:, 0], spans[:, 0] + spans[:, 1] - WIDTH + 1], axis=1).ravel()
    padded = np.append(shingles, np.uint64(0))  # a span may end with the text
    return np.stack([np.minimum.reduceat((padded ^ y) * x, bounds)[::2] for x, y in zip(hashes.a, hashes.b)])


def distinct_shingles(shingles: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """How many different shingles each span has."""
    out = spans[:, 1] - WIDTH + 1
    in_order = np.sort(shingles)
    if (in_order[1:] == in_order[:-1]).any():  # else no part of the text repeats a shingle
        for k, (s, n) in enumerate(zip(spans[:, 0].tolist(), out.tolist())):
            part = np.sort(shingles[s : s + n])
            out[k] -= int((part[1:] == part[:-1]).sum())
    return out


def span_hashes(words: np.ndarray, spans: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The class of each span (first word, number of words): a polynomial over its words, from running sums. grams: those of SPAN words."""
    p, inverse = powers(len(words))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * p[: len(words)], dtype=np.uint64)])
    start, n = spans[:, 0], spans[:, 1]
    found = mixed((sums[start + n] - sums[start]) * inverse[start] + n.astype(np.uint64))
    window = n == SPAN
    found[window] = grams[start[window]]
    return found


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, words (in the text), start (word number), n (words) and class (hash of the words) of each paragraph, and the size (different shingles) and band keys of lines, blocks and whole texts.

    The windows have none: one changed word takes nearly half of their shingles.
    """
    bands = tuned_bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Bands(bands, 2)
        numbers = np.arange(bands, dtype=np.uint64)[:, None]
        for b in small(batches, "text"):
            ids = b.column("doc_id").to_numpy()
            found: list[tuple[np.ndarray, ...]] = []
            rows = 0
            texts = [x.lower() for x in text_bytes(b.column("text"))]
            for i, words in text_words(texts):
                grams = rolled(words, SPAN)
                if not len(grams):
                    continue
                whole = blocks_of(texts[i], len(words))
                shingles = rolled(words, WIDTH)
                least = block_least(shingles, whole, hashes)
                keys = mixed(mixed(numbers * np.uint64(0xD6E8FEB86659FD93) + mixed(least[::2])) + mixed(least[1::2]))
                classes = span_hashes(words, whole, grams)
                at = paragraph_starts(rolled(words, ANCHOR)[: len(grams)])
                at = at[~np.isin(at, whole[whole[:, 1] == SPAN, 0])]  # a block that is just a window is there already
                size = len(whole) + len(at)
                found.append((np.full(size, ids[i]), np.full(size, len(words)), np.append(whole[:, 0], at), np.append(whole[:, 1], np.full(len(at), SPAN)), np.append(classes, grams[at]).view(np.int64), np.append(distinct_shingles(shingles, whole), np.zeros(len(at), np.int64)), keys.T.ravel().view(np.int64)))
                rows += size
                if rows > 50_000:
                    yield batch(found, bands)
                    found, rows = [], 0
            if found:
                yield batch(found, bands)

    return in_parts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, words int, start int, n int, class long, size int, keys array<long>")


def batch(found: list[tuple[np.ndarray, ...]], bands: int) -> pa.RecordBatch:
    ids, words, at, n, classes, sizes, keys = (np.concatenate(x) for x in zip(*found))
    none = sizes == 0
    offsets = np.append(0, np.cumsum(np.where(none, 0, bands))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(none, False)), pa.array(keys))
    numbers = [pa.array(x.astype(np.int32)) for x in (words, at, n)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *numbers, pa.array(classes), pa.array(sizes.astype(np.int32), mask=none), lists], names=["doc_id", "words", "start", "n", "class", "size", "keys"])


def shingle_rows(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted (class, doc_id, start, n) with the sorted shingles of that paragraph, read again from the texts; several times where rows repeat a doc_id and its text."""
    starts = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("class", "start", "n")).alias("at"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, "text"):
            at = b.column("at").to_pylist()
            classes, sets = [], []
            for i, words in text_words([x.lower() for x in text_bytes(b.column("text"))]):
                shingles = rolled(words, WIDTH)
                spans = np.array([(p["start"], p["n"]) for p in at[i] if p["start"] + p["n"] <= len(words)], np.int64).reshape(-1, 2)
                wanted_here = {p["class"] for p in at[i]}
                for (start, n), c in zip(spans.tolist(), span_hashes(words, spans, rolled(words, SPAN)).view(np.int64).tolist()):
                    if c in wanted_here:  # not if it's the text of another row with the same id
                        classes.append(c)
                        sets.append(np.unique(shingles[start : start + n - WIDTH + 1]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], names=["class", "shingles"])

    return texts.join(starts, "doc_id").select("text", "at").mapInArrow(run, "class long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("p")), "a").join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("q")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column("p").to_pylist(), t.column("q").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                ok.append(linked(len(x), len(y), overlap(x, y), PERCENT))
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "p", "q").mapInArrow(run, "a long, b long")


def block_links(t: pa.Table) -> pa.Table:
    """Links between the components of one block, as a spanning forest: sets become rows of zeros and ones, whose product counts what two share."""
    _, once = np.unique(t.column("class").to_numpy(), return_index=True)
    t = t.take(pa.array(once))
    classes, root = t.column("class").to_numpy(), t.column("root").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
    size = np.array([len(x) for x in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row, times = np.repeat(np.arange(len(sets)), size), np.bincount(column)
    # shingles of one set alone are shared with none; the others are counted in parts, since sets of long blocks are large
    several = times > 1
    row, column = row[several[column]], (np.cumsum(several) - 1)[column[several[column]]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for s in range(0, int(several.sum()), 4096):
        u, v = np.searchsorted(column, [s, s + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[u:v], column[u:v] - s] = 1
        shared += m @ m.T
    out: list[tuple[int, int]] = []
    at = {int(r): int(r) for r in root}

    def top(x: int) -> int:
        while at[x] != x:
            at[x] = x = at[at[x]]
        return x

    for s in range(0, len(sets), 256):
        common = shared[s : s + 256]
        r, c = np.nonzero(100 * common >= PERCENT * (size[s : s + 256, None] + size[None, :] - common))
        for x, y in zip((r + s).tolist(), c.tolist()):
            u, v = top(int(root[x])), top(int(root[y]))
            if u != v:
                at[max(u, v)] = min(u, v)
                out.append((int(classes[x]), int(classes[y])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def repeats(docs: DataFrame) -> DataFrame:
    """Each paragraph that repeats across documents: doc_id, words (in the text), start (word number), n (words), class, component, first_doc_id, and where else it stands: other (document), other_start, other_n and other_words.

    What is removed is matched with the first document that has the very same words, or else the component's first.
    """
    found = staged(paragraphs(docs), "passage-paragraphs")
    # keys are the same in all rows of a class; as numbers of their own they are aggregated by hash, without a sort
    keys = [f"key{i}" for i in range(tuned_bands())]
    blocks = staged(
        found.where("keys IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_id", "start", "n")).alias("at"), F.min("size").alias("size"), *(F.min(F.col("keys")[i]).alias(k) for i, k in enumerate(keys))).select("class", "at.*", "size", *keys),
        "passage-blocks",
    )
    # classes that share a band; each is verified against the band's first class, unless their sizes alone rule a link out
    banded = blocks.select("class", "size", F.explode(F.array(*keys)).alias("key"))
    shared = staged(banded.groupBy("key").agg(F.min(F.struct("class", "size")).alias("lead"), F.max("class").alias("other"), F.count("*").alias("m")).where("lead.class < other").select("key", "lead", "m"), "passage-bands")
    banded = staged(banded.join(shared, "key").select("key", "class", "size", "lead", "m"), "passage-banded")
    alike = 100 * F.least("size", "lead.size") >= PERCENT * F.greatest("size", "lead.size")
    pairs = staged(banded.where((F.col("class") != F.col("lead.class")) & alike).select(F.col("lead.class").alias("a"), F.col("class").alias("b")).distinct(), "passage-pairs")
    near = pairs.select(F.explode(F.array("a", "b")).alias("class")).union(banded.where("m > 2").select("class")).distinct()
    sets = staged(shingle_rows(blocks.join(near, "class").select("class", "doc_id", "start", "n"), docs), "passage-shingles")
    discard(blocks)
    discard(shared)
    links = staged(verified(pairs, sets), "passage-links")
    roots = components(links, name="passage")
    # bands that still hold several components are compared whole, in blocks
    placed = staged(banded.where("m > 2").select("key", "class").join(roots.withColumnRenamed("node", "class"), "class", "left").select("key", "class", F.coalesce("root", "class").alias("root")), "passage-placed")
    apart = staged(placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low < high").select("key", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks")), "passage-apart")
    crossed = (
        placed.join(apart, "key")
        .join(sets, "class")
        .withColumn("mine", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "class", "root", "shingles")
    )
    more = staged(crossed.groupBy("key", "i", "j").applyInArrow(block_links, "a long, b long").distinct(), "passage-more")
    if not more.isEmpty():
        roots = components(links.unionByName(more), name="passage")
    for t in (banded, pairs, sets, placed, apart, more, links):
        discard(t)
    # what is in one document alone and near nothing goes here, before anything is joined with places
    at = F.min(F.struct("doc_id", "start", "n", "words"))
    classes = found.groupBy("class").agg(at.alias("at"), F.max("doc_id").alias("last_doc_id"))
    named = staged(
        classes.join(roots.withColumnRenamed("node", "class"), "class", "left").where("root IS NOT NULL OR at.doc_id < last_doc_id").select("class", F.coalesce("root", "class").alias("component"), "at", "last_doc_id"),
        "passage-named",
    )
    repeated = named.groupBy("component").agg(F.min("at").alias("first"), F.max("last_doc_id").alias("last_doc_id")).where("first.doc_id < last_doc_id").select("component", "first")
    members = staged(named.select("class", "component", "at").join(repeated, "component"), "passage-members")
    rows = staged(found.select("doc_id", "words", "start", "n", "class").join(members, "class"), "passage-rows")
    for t in (found, named, members):
        discard(t)
    # in the first document that has these very words, the match is the component's first place, elsewhere theirs
    other = F.when(F.col("doc_id") == F.col("at.doc_id"), F.col("first")).otherwise(F.col("at"))
    return rows.select("doc_id", "words", "start", "n", "class", "component", F.col("first.doc_id").alias("first_doc_id"), *(other[c].alias("other" if c == "doc_id" else f"other_{c}") for c in ("doc_id", "start", "n", "words")))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Each paragraph that repeats across documents: doc_id, start (word number), component, first_doc_id and removed (false in the component's first document)."""
    return repeats(docs).select("doc_id", "start", "component", "first_doc_id", (F.col("doc_id") != F.col("first_doc_id")).alias("removed"))


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many words a and b have in common from their begins on."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def extended(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """The matches in at (start and n in a, start and n in b, a row each) with all words before and behind that agree: begin and end in a."""
    out: list[tuple[int, int]] = []
    done: dict[int, int] = {}
    for s, n, x, m in at[np.argsort(at[:, 0], kind="stable")].tolist():
        e, y = s + n, x + m
        if s - x == e - y and done.get(s - x, -1) >= e:
            continue
        begin, end = s - agreeing(a[:s][::-1], b[:x][::-1]), e + agreeing(a[e:], b[y:])
        done[e - y] = end
        out.append((begin, end))
    return out


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """spans in order, those that touch or overlap as one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


SPANS = "array<struct<begin:int,end:int>>"


#: So many asks for parts of one text are answered by one copy of it.
ASKS = 512


def parts_of(asks: DataFrame, docs: DataFrame) -> DataFrame:
    """asks (at, low, high and others) with what they ask for: words, the hashes of words low to high of the text of document at, and text_key, a hash of that text.

    A text that many ask for goes to many tasks, once for ASKS of them; rows that repeat a doc_id count as one document, each with words of its own.
    """
    asks = staged(asks, "passage-asks")
    others = [c for c in asks.columns if c not in ("at", "high")]
    hot = staged(asks.groupBy("at").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("chunks")).where("chunks > 1"), "passage-hot")
    # one column for document and chunk: a shuffle by the document alone would do for two, and bring all chunks back together
    chunk = F.pmod(F.xxhash64(*asks.columns), F.coalesce("chunks", F.lit(1))).cast("int")
    dealt = asks.join(hot, "at", "left").withColumn("slot", F.struct("at", chunk.alias("chunk"))).groupBy("slot").agg(F.collect_list(F.struct(*others, "high")).alias("asks"))
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("at"), F.col("text").cast("string").alias("text"))
    texts = texts.join(hot, "at", "left").select("at", "text", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk")).select(F.struct("at", "chunk").alias("slot"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, "text"):
            lists = b.column("asks").to_pylist()
            rows: list[tuple] = []
            size = 0
            for i, words in text_words([x.lower() for x in text_bytes(b.column("text"))]):
                for a in lists[i]:
                    part = words[a["low"] : a["high"]].tobytes()
                    rows.append((*(a[c] for c in others), b.column("text_key")[i].as_py(), part))
                    size += len(part)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[*others, "text_key", "words"])
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[*others, "text_key", "words"])

    types = [{"bigint": pa.int64(), "int": pa.int32()}[asks.schema[c].dataType.simpleString()] for c in others] + [pa.int64(), pa.binary()]
    schema = ", ".join(f"{c} {asks.schema[c].dataType.simpleString()}" for c in others)
    return in_parts(dealt).join(texts, "slot").select("asks", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"{schema}, text_key long, words binary")


def removed_spans(found: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text) and spans: the whole extents, in words, of all that is removed from each document, merged where they touch. found: as from repeats().

    Of both texts of a match only that part is compared which the other one is long enough to agree with.
    """
    pairs = staged(
        found.where("doc_id <> first_doc_id")
        .groupBy("doc_id", "other")
        .agg(
            F.collect_list(F.struct("start", "n", "class", "other_start", "other_n")).alias("at"),
            F.greatest(F.lit(0), F.min(F.col("start") - F.col("other_start"))).alias("low"),
            F.max(F.expr("start + n + other_words - other_start - other_n")).alias("high"),
            F.greatest(F.lit(0), F.min(F.col("other_start") - F.col("start"))).alias("other_low"),
            F.max(F.expr("other_start + other_n + words - start - n")).alias("other_high"),
        ),
        "passage-matches",
    )
    asks = pairs.select("doc_id", "other", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("doc_id").alias("at"), "low", "high"), F.struct(F.lit(1).alias("side"), F.col("other").alias("at"), F.col("other_low").alias("low"), F.col("other_high").alias("high")))).alias("x"))
    parts = staged(parts_of(asks.select("doc_id", "other", "x.side", "x.at", "x.low", "x.high"), docs), "passage-parts")
    mine = parts.where("side = 0").select("doc_id", "other", "text_key", "low", "words")
    theirs = parts.where("side = 1").select("doc_id", "other", F.col("low").alias("other_low"), F.col("words").alias("other_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(small(batches, "words"), "other_words"):
            lists = b.column("at")
            flat, ends = lists.flatten(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
            matches = np.stack([flat.field(c).to_numpy().astype(np.int64) for c in ("start", "n", "other_start", "other_n")], axis=1)
            classes, spans = flat.field("class").to_numpy(), []
            for k, (low, words, other_low, other_words) in enumerate(zip(*(b.column(c).to_pylist() for c in ("low", "words", "other_low", "other_words")))):
                words, other_words = np.frombuffer(words, np.uint64), np.frombuffer(other_words, np.uint64)
                at = matches[ends[k] : ends[k + 1]] - [low, 0, other_low, 0]
                inside = at[:, 0] + at[:, 1] <= len(words)
                at, own = at[inside], classes[ends[k] : ends[k + 1]][inside]
                at = at[span_hashes(words, at[:, :2], rolled(words, SPAN)).view(np.int64) == own]  # not if it's the text of another row with the same id
                spans.append([{"begin": s + low, "end": e + low} for s, e in merged(extended(words, other_words, at))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "text_key", "spans"])

    both = mine.join(theirs, ["doc_id", "other"]).join(pairs.select("doc_id", "other", "at"), ["doc_id", "other"])
    each = in_parts(both).select("doc_id", "text_key", "at", "low", "words", "other_low", "other_words").mapInArrow(run, f"doc_id long, text_key long, spans {SPANS}")

    union = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.array().cast(SPANS),
        lambda out, x: F.when((F.size(out) > 0) & (x["begin"] <= F.try_element_at(out, F.lit(-1))["end"]), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(out, F.lit(-1))["begin"].alias("begin"), F.greatest(F.try_element_at(out, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(out, F.array(x))),
    )
    return each.groupBy("doc_id", "text_key").agg(union.alias("spans"))


def without(text: str, spans: list[dict]) -> str:
    """text without the words of spans and the white space behind each of them."""
    data = text.encode()
    starts = np.append(np.concatenate([word_hashes(x)[0] + o for x, o in placed_pieces(data)]), len(data))
    out, at = [], 0
    for x in spans:
        out.append(data[at : starts[x["begin"]]])
        at = starts[x["end"]]
    return b"".join([*out, data[at:]]).decode()


def placed_pieces(data: bytes) -> Iterator[tuple[bytes, int]]:
    at = 0
    for x in pieces(data):
        yield x, at
        at += len(x)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the whole extents of repeated passages taken out of text, but for each passage's first document; all other columns stay."""
    own, key, gone = (fresh(docs, x) for x in ("__id", "__text_key", "__spans"))
    spans = removed_spans(staged(repeats(docs), "passage-repeats"), docs).select(F.col("doc_id").alias(own), F.col("text_key").alias(key), F.col("spans").alias(gone))
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, at):
            cols, found = list(b.columns[: len(names)]), b.column(len(names)).to_pylist()
            cols[at] = pa.array([without(x, s) if x and s else x for x, s in zip(cols[at].to_pylist(), found)], b.schema.types[at])
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = in_parts(docs).join(spans, (F.col("doc_id").cast("long") == F.col(own)) & (F.xxhash64(F.col("text").cast("string")) == F.col(key)), "left").select(*(F.col(f"`{c}`") for c in names), gone)
    return rows.mapInArrow(run, docs.schema)


def repeated_documents(docs: DataFrame) -> DataFrame:
    """One row for each document that shares a passage with another: doc_id, n_paragraphs (those that stay and the spans that go), n_removed (spans), first_doc_id (the smallest that any was seen in first), n_words_removed, and spans (begin:end in words, in order)."""
    found = staged(repeats(docs), "passage-repeats")
    kept = found.groupBy("doc_id").agg(F.collect_list(F.when(F.col("doc_id") == F.col("first_doc_id"), F.struct("start", "n"))).alias("kept"), F.min("first_doc_id").alias("first_doc_id"))
    n = F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long")
    words = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["begin"]), F.lit(0).cast("long"))
    text = F.coalesce(F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["begin"], x["end"])), ","), F.lit(""))
    gone = removed_spans(found, docs).groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    gone_at = F.coalesce("spans", F.array().cast(SPANS))
    stays = F.filter("kept", lambda p: ~F.exists(gone_at, lambda x: (x["begin"] <= p["start"]) & (x["end"] >= p["start"] + p["n"])))
    return kept.join(gone, "doc_id", "left").select("doc_id", (F.size(stays).cast("long") + n).alias("n_paragraphs"), n.alias("n_removed"), "first_doc_id", words.alias("n_words_removed"), text.alias("spans"))
