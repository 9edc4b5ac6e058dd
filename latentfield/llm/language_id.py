"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1 drawn from a keyed hash of its code point. A 3-gram binds
its letters' vectors: they are permuted by position (rotated) and multiplied. A text, or a language,
bundles the vectors of its n-grams: it is their sum. A text's language is the prototype with the
highest cosine; prototypes and texts are centred on the mean prototype, so that what all languages
share doesn't count.

Bundling is linear, so a language's n-gram counts are summed first and bound once for each batch.
All sums are of whole numbers, so the order of rows and tasks changes nothing. Up to MOST_LANGUAGES prototypes go to each task; more
stay a table, of which blocks meet chunks of documents.

Defined cases: a text that is null or has no letter is 'und' with score 0, as is every text if no
labelled text with letters was learned from; a null doc_id hashes as null and is not learned from;
equal cosines go to the smaller label; long texts are cut into overlapping parts whose n-grams
add up to those of the whole; other columns are never read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, discard, in_parts, small, staged

DIMENSIONS = 1024
#: Up to so many prototypes, 8 KB each, come to the driver and go to each task. More stay a table.
MOST_LANGUAGES = 2000
#: Bundles that a task of learn() holds before it sends them on.
HELD = 1000
#: Of a table of prototypes so many are compared with so many documents at once.
BLOCK, CHUNK = 512, 2048
PART = 1 << 18
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd multipliers, so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Binder:
    """Letter vectors, and n-gram vectors made from them."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 11):
        self.d, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.is_letter = np.zeros(0x110000, bool)
        self.is_letter[[c for c in range(0x110000) if chr(c).isalpha()]] = True

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            words = mixed(np.arange(self.d // 64, dtype=np.uint64) + np.uint64((c + 1) * 0x9E3779B97F4A7C15 + self.seed & 0xFFFFFFFFFFFFFFFF))
            self.letters[c] = np.unpackbits(words.view(np.uint8)).astype(np.int8) * 2 - 1
        return self.letters[c]

    def parts(self, texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """Rows and lower-cased parts of about PART characters together. A text has a blank before and after it; its parts overlap by two characters."""
        padded = (f" {x} " for x in texts)
        each = ((i, x[s : s + PART + 2]) for i, x in enumerate(padded) for s in range(0, max(len(x) - 2, 1), PART))
        for group in by_size(each, lambda p: len(p[1]) + 20, PART):
            yield [i for i, _ in group], [x.lower().replace("\x00", " ") for _, x in group]

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, index and letters of the 3-grams of the texts: (row of each, index of each, letters of each index). Other characters are a blank; 3-grams with two blanks in a row, and those over a NUL, which ends a text here (parts() puts a blank for those within texts), don't count."""
        data = "\x00".join(texts)
        points = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
        letter = self.is_letter[points]
        alphabet = np.flatnonzero(np.bincount(points[letter], minlength=1)) if letter.any() else np.zeros(0, np.int64)
        dense = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.int64)
        dense[alphabet] = np.arange(1, len(alphabet) + 1)
        code = np.where(letter, dense[np.minimum(points, len(dense) - 1)], 0)
        k = len(alphabet) + 1
        a, b, c = code[:-2], code[1:-1], code[2:]
        end = points == 0
        good = ~((b == 0) & ((a == 0) | (c == 0)) | end[:-2] | end[1:-1] | end[2:])
        starts = np.cumsum([0] + [len(x) + 1 for x in texts[:-1]])
        at = np.flatnonzero(good)
        row = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(points))))[at]
        key = (a[at] * k + b[at]) * k + c[at]
        used, index = np.unique(key, return_inverse=True) if k**3 > 1 << 24 else self.dense_index(key, k**3)
        codes = np.concatenate([[0x20], alphabet])
        return row, index, codes[np.stack([used // k // k, used // k % k, used % k], axis=1)]

    @staticmethod
    def dense_index(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        seen = np.zeros(size, bool)
        seen[key] = True
        used = np.flatnonzero(seen)
        at = np.zeros(size, np.int32)
        at[used] = np.arange(len(used), dtype=np.int32)
        return used, at[key]

    def bound(self, letters: np.ndarray) -> np.ndarray:
        """The vector of each 3-gram: letters rotated by their place and multiplied."""
        base = {int(c): self.letter(int(c)) for c in np.unique(letters)}
        stack = np.stack([base[c] for c in base])
        place = {c: i for i, c in enumerate(base)}
        at = np.vectorize(place.get, otypes=[np.int64])(letters) if letters.size else letters
        return np.roll(stack, 2, axis=1)[at[:, 0]] * np.roll(stack, 1, axis=1)[at[:, 1]] * stack[at[:, 2]]

    def bundles(self, rows: int, row: np.ndarray, index: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The sum of the 3-gram vectors of each row; exact, since a part is far below 2**24 n-grams."""
        out = np.zeros((rows, self.d), np.float32)
        for s in range(0, len(letters), 2048):
            mine = (index >= s) & (index < s + 2048)
            width = min(2048, len(letters) - s)
            counts = np.bincount(row[mine] * width + (index[mine] - s), minlength=rows * width).reshape(rows, width).astype(np.float32)
            out += counts @ self.bound(letters[s : s + width]).astype(np.float32)
        return out


@dataclass
class Profiles:
    languages: list[str]
    vectors: np.ndarray  # one centred, normalised row for each language
    mean: np.ndarray  # of the normalised prototypes
    dimensions: int
    seed: int

    def compare(self, bundles: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The nearest language of each bundle, of equal ones the first name, and its cosine."""
        size = np.linalg.norm(bundles, axis=1, keepdims=True)
        centred = bundles / np.maximum(size, 1e-12) - self.mean
        centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
        cosine = np.round(centred @ self.vectors.T, 9)
        best = cosine.argmax(axis=1)
        return [self.languages[i] for i in best], cosine[np.arange(len(best)), best]

    def predict(self, bundles: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(bundles), np.zeros(len(bundles))
        names, cosine = self.compare(bundles)
        none = ~bundles.any(axis=1)
        return ["und" if n else x for x, n in zip(names, none)], np.where(none, 0.0, np.clip(cosine, 0, 1))


def bundled(labelled: DataFrame, *, dimensions: int = DIMENSIONS, seed: int = 11) -> DataFrame:
    """(lang, i, x): the bundle of each language in labelled (text, lang), over all its rows, a row for each dimension.

    A task sends one bundle for each of its languages, HELD at a time; they are summed by language and dimension.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binder, sums = None, defaultdict(lambda: np.zeros(dimensions, np.int64))

        def sent() -> pa.RecordBatch:
            names = sorted(sums)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array([sums[x].tolist() for x in names], pa.list_(pa.int64()))], names=["lang", "v"])

        for b in small(batches, "text"):
            binder = binder or Binder(dimensions, seed)
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for rows, parts in binder.parts(texts):
                own = [langs[i] for i in rows]
                for names in by_size(sorted(set(own)), lambda _: 1, HELD):
                    number = {x: i for i, x in enumerate(names)}
                    at = [k for k, x in enumerate(own) if x in number]
                    row, index, letters = binder.grams([parts[k] for k in at])
                    of = np.array([number[own[k]] for k in at])
                    v = binder.bundles(len(names), of[row], index, letters) if len(row) else ()
                    for i, x in enumerate(v):
                        sums[names[i]] += np.rint(x).astype(np.int64)
                    if len(sums) >= HELD:
                        yield sent()
                        sums.clear()
        if sums:
            yield sent()

    return (
        in_parts(labelled).where("text IS NOT NULL AND lang IS NOT NULL")
        .select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        .mapInArrow(run, "lang string, v array<long>")
        .select("lang", F.posexplode("v").alias("i", "x"))
        .groupBy("lang", "i")
        .agg(F.sum("x").alias("x"))
    )


def as_lists(bundles: DataFrame) -> DataFrame:
    """(lang, v) of bundled() rows."""
    return bundles.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", F.transform("v", lambda p: p["x"]).alias("v"))


def profiles_of(bundles: DataFrame, dimensions: int = DIMENSIONS, seed: int = 11) -> Profiles:
    """The prototypes of a bounded number of languages, on the driver."""
    found = sorted((r["lang"], np.array(r["v"], float)) for r in as_lists(bundles).collect() if any(r["v"]))
    names = [k for k, _ in found]
    if not names:
        return Profiles([], np.zeros((0, dimensions)), np.zeros(dimensions), dimensions, seed)
    v = np.stack([x / np.linalg.norm(x) for _, x in found])
    mean = v.mean(axis=0) if len(names) > 1 else np.zeros(dimensions)
    centred = v - mean
    return Profiles(names, centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12), mean, dimensions, seed)


def learn(labelled: DataFrame, *, dimensions: int = DIMENSIONS, seed: int = 11, most_languages: int = MOST_LANGUAGES) -> Profiles:
    """Prototypes of the languages in labelled (text, lang) as one object, which can hold most_languages; language_id() takes any number.

    What comes to the driver is languages x dimensions numbers, whatever the number of rows; more languages raise an error before anything is collected.
    """
    bundles = staged(bundled(labelled, dimensions=dimensions, seed=seed), "language-bundles")
    if bundles.where("i = 0").count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    found = profiles_of(bundles, dimensions, seed)
    discard(bundles)
    return found


def is_held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id's text modulo 5 is 0; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def document_bundles(binder: Binder, texts: list[str]) -> Iterator[np.ndarray]:
    """The bundles of whole texts, in order, a few rows at a time."""
    pending: list[tuple[int, np.ndarray]] = []
    for rows, parts in binder.parts(texts):
        row, index, letters = binder.grams(parts)
        v = binder.bundles(len(parts), row, index, letters) if len(row) else np.zeros((len(parts), binder.d), np.float32)
        for i, x in zip(rows, v):  # parts of one text follow each other
            if pending and pending[-1][0] == i:
                pending[-1] = (i, pending[-1][1] + x)
            else:
                pending.append((i, x))
        done, pending = pending[:-1], pending[-1:]
        if done:
            yield np.stack([x for _, x in done]).astype(float)
    if pending:
        yield np.stack([x for _, x in pending]).astype(float)


def asked(docs: DataFrame) -> DataFrame:
    return in_parts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), is_held_out().alias("held_out")).select("doc_id", "held_out", "text")


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from its text alone; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binder = None
        for b in small(batches, "text"):
            binder = binder or Binder(profiles.dimensions, profiles.seed)
            langs, scores = [], []
            for v in document_bundles(binder, [x or "" for x in b.column("text").to_pylist()]):
                got = profiles.predict(v)
                langs += got[0]
                scores += got[1].tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return asked(docs).mapInArrow(run, SCHEMA)


def identify_by_blocks(docs: DataFrame, bundles: DataFrame, *, dimensions: int = DIMENSIONS, seed: int = 11) -> DataFrame:
    """identify() against a table of bundles of any number of languages: blocks of prototypes meet chunks of documents, and the best of all blocks counts."""
    norms = staged(bundles.groupBy("lang").agg(F.sqrt(F.sum(F.col("x").cast("double") * F.col("x"))).alias("norm")).where("norm > 0"), "language-norms")
    languages = norms.count()
    sums = bundles.join(norms, "lang").groupBy("i").agg(F.sum(F.col("x") / F.col("norm")).alias("s")).collect()  # one row a dimension
    mean = np.zeros(dimensions)
    if languages > 1:
        mean[[r.i for r in sums]] = [r.s / languages for r in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binder = None
        for b in small(batches, "text"):
            binder = binder or Binder(dimensions, seed)
            data = [x.astype(np.float32).tobytes() if x.any() else None for v in document_bundles(binder, [x or "" for x in b.column("text").to_pylist()]) for x in v]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(data, pa.binary())], names=["doc_id", "held_out", "v"])

    rows = staged(asked(docs).mapInArrow(run, "doc_id long, held_out boolean, v binary").withColumn("row", F.monotonically_increasing_id()), "language-documents")
    n = rows.count()
    blocks, chunks = -(-languages // BLOCK), max(1, -(-n // CHUNK))
    left = rows.where("v IS NOT NULL").select("row", "v", F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))).alias("block"))
    right = as_lists(bundles.join(norms, "lang", "left_semi")).select("lang", "v", F.pmod(F.xxhash64("lang"), F.lit(max(1, blocks))).cast("int").alias("block")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out = ([], [], [])
        if a.num_rows and b.num_rows:
            b = b.sort_by("lang")
            names, v = b.column("lang").to_pylist(), np.array(b.column("v").to_pylist(), float)
            v = v / np.linalg.norm(v, axis=1, keepdims=True) - mean
            part = Profiles(names, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), mean, dimensions, seed)
            x = np.stack([np.frombuffer(d, np.float32) for d in a.column("v").to_pylist()]).astype(float)
            out = (a.column("row").to_pylist(), *part.compare(x))
        return pa.table({"row": pa.array(out[0], pa.int64()), "lang": pa.array(out[1], pa.string()), "cosine": pa.array(out[2], pa.float64())})

    met = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(compare, "row long, lang string, cosine double")
    best = met.groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "lang")).alias("best"))  # of equal ones the first name
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -F.col("best.c")))
    return rows.join(best, "row", "left").select("doc_id", "held_out", F.coalesce("best.lang", F.lit("und")).alias("lang_pred"), F.when(F.col("best").isNotNull(), score).otherwise(0.0).alias("score"))


def language_id(docs: DataFrame, *, dimensions: int = DIMENSIONS, seed: int = 11, most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """Learns from the rows that aren't held out and predicts all rows. Beyond most_languages prototypes stay a table, with the same results."""
    bundles = staged(bundled(docs.where(~is_held_out()).select("text", "lang"), dimensions=dimensions, seed=seed), "language-bundles")
    if bundles.where("i = 0").count() > most_languages:
        return identify_by_blocks(docs, bundles, dimensions=dimensions, seed=seed)
    profiles = profiles_of(bundles, dimensions, seed)
    discard(bundles)
    return identify(docs, profiles)
