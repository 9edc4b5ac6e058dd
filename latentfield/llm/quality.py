"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are grown here, on a bounded sample of labelled rows, by histogram boosting with logistic
loss. Splits on features with a declared direction keep the score monotone in that feature. The
ensemble is flattened into numpy node arrays, so that a batch of documents is scored level by level.

Defined cases: null text is a text without words (all counts 0, base_failed); a null doc_id is passed
through; repeated rows are judged one by one and alike; a table without usable labels gives an empty
model, and the base rules decide alone; other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_parts, small, text_bytes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
#: Name and direction of each feature: -1 if the score may only fall as the feature grows.
FEATURES = (
    ("log_words", 0),
    ("mean_word_chars", 0),
    ("symbols_per_word", -1),
    ("dup_line_share", -1),
    ("repeat_word_share", -1),
    ("upper_share", -1),
    ("digit_share", 0),
    ("punct_share", 0),
    ("line_words", 0),
    ("distinct_word_share", 0),
)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    twice = {w for w, n in Counter(windows).items() if n > 1}
    found, upto = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            found += i + 3 - max(i, upto)
            upto = i + 3
    return found


def statistics(data: bytes) -> tuple[int, int, int, int, int, list[float]]:
    """The base counts and the features of one whole text."""
    words = data.split()
    n = len(words)
    codes = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, np.int64)
    chars = int(codes.sum() - codes[0x80:0xC0].sum())
    spaces = int(codes[32] + codes[9:14].sum())
    word_chars = chars - spaces
    symbols = int(sum(codes[c] for c in SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    each, letters = max(n, 1), max(word_chars, 1)
    punct = int(codes[33:48].sum() + codes[58:65].sum() + codes[91:97].sum() + codes[123:127].sum())
    features = [
        float(np.log1p(n)),
        word_chars / each,
        symbols / each,
        dup / max(len(lines), 1),
        repeat / each,
        float(codes[65:91].sum()) / letters,
        float(codes[48:58].sum()) / letters,
        punct / letters,
        n / max(len(lines), 1),
        len(set(words)) / each,
    ]
    return n, word_chars, symbols, dup, repeat, features


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, "text"):
            found = [statistics(x) for x in text_bytes(b.column("text"))]
            cols = list(zip(*found)) if found else [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.list_(pa.float64()))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features"],
            )

    return in_parts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


@dataclass
class Trees:
    """Nodes of all trees in flat arrays. A leaf points to itself, so that depth steps reach it from any root."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x."""
        out = np.full(len(x), self.base)
        if not len(x) or not len(self.roots):
            return out
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return out + self.value[at].sum(axis=1)


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 48, least: int = 8, ridge: float = 1.0, directions: tuple[int, ...] | None = None) -> Trees:
    """Boosts regression trees on the logistic loss. directions: -1, 0 or 1 for each feature."""
    n, m = x.shape
    sign = directions or (0,) * m
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
    margin = np.full(n, base)
    nodes: list[list[float]] = []
    roots: list[int] = []

    def leaf(value: float) -> int:
        k = len(nodes)
        nodes.append([0, np.inf, k, k, value])
        return k

    def weight(g: float, h: float, low: float, high: float) -> float:
        return min(max(-g / (h + ridge), low), high)

    def gain(g: float, h: float, w: float) -> float:
        return -(g * w + 0.5 * (h + ridge) * w * w)

    def split(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        own = weight(g, h, low, high)
        best = (1e-6, -1, 0, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            for j in range(m):
                k = len(edges[j]) + 1
                at = binned[rows, j]
                gs, hs, cs = (np.cumsum(np.bincount(at, v, minlength=k))[:-1] for v in (grad[rows], hess[rows], None))
                for c in np.flatnonzero((cs >= least) & (cs <= len(rows) - least)):
                    a, b = weight(gs[c], hs[c], low, high), weight(g - gs[c], h - hs[c], low, high)
                    if sign[j] * (b - a) < 0:
                        continue
                    more = gain(gs[c], hs[c], a) + gain(g - gs[c], h - hs[c], b) - gain(g, h, own)
                    if more > best[0]:
                        best = (more, j, int(c), a, b)
        _, j, c, a, b = best
        if j < 0:
            k = leaf(rate * own)
            margin[rows] += rate * own
            return k
        k = leaf(0.0)
        middle = (a + b) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[sign[j]]
        goes = binned[rows, j] <= c
        left = split(rows[goes], level + 1, *bounds[0])
        right = split(rows[~goes], level + 1, *bounds[1])
        nodes[k] = [j, edges[j][c], left, right, 0.0]
        return k

    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-9)
        roots.append(split(np.arange(n), 0, -np.inf, np.inf))
    a = np.array(nodes, dtype=float).reshape(-1, 5)
    return Trees(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots, np.int64), depth, base)


EMPTY = Trees(*(np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64, float, np.int64)), 0, 20.0)


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 4000, seed: int = 7) -> Trees:
    """Fits on the sample_rows labelled documents (at most) whose ids hash lowest, so the driver gets a bounded set of rows.

    Of rows that repeat those ids, up to sample_rows more are used, by their statistics' order. Both classes must be there, else the empty model is returned, which keeps what the base rules keep.
    """
    pick = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(sample_rows)
    )
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(pick.select("doc_id")), "doc_id")  # sample_rows ids at most
    rows = with_statistics(wanted).join(F.broadcast(pick), "doc_id").select("doc_id", "features", "quality").orderBy("doc_id", "features").limit(2 * sample_rows).collect()
    y = np.array([r.quality for r in rows])
    if len(rows) < 40 or y.min() == y.max():
        return EMPTY
    return grow(np.array([r.features for r in rows]), y, directions=tuple(d for _, d in FEATURES))


def judged(docs: DataFrame, model: Trees, *, least_probability: float = 0.3) -> DataFrame:
    """Adds base_failed, quality_score (probability) and kept to the statistics. least_probability below one half keeps doubtful documents."""
    margin = float(np.log(least_probability / (1 - least_probability)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("features").to_pylist(), dtype=float).reshape(b.num_rows, len(FEATURES))
            s = np.concatenate([model.scores(x[i : i + 1000]) for i in range(0, b.num_rows, 1000)] or [np.zeros(0)])
            counts = {k: b.column(k).to_numpy() for k in ("n_words", "n_repeat_words")}
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
            kept = ~failed & (s >= margin)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(failed), pa.array(1 / (1 + np.exp(-s))), pa.array(kept)], names=[*b.schema.names[:6], "base_failed", "quality_score", "kept"])

    return with_statistics(docs).mapInArrow(run, SCHEMA.replace("features array<double>", "base_failed boolean, quality_score double, kept boolean"))


def passing(docs: DataFrame, model: Trees, *, least_probability: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they were, that judged() keeps; decided row by row beside the text, without a join."""
    margin = float(np.log(least_probability / (1 - least_probability)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, at):
            found = [statistics(x) for x in text_bytes(b.column(at))]
            x = np.array([f[5] for f in found], dtype=float).reshape(len(found), len(FEATURES))
            s = np.concatenate([model.scores(x[i : i + 1000]) for i in range(0, len(found), 1000)] or [np.zeros(0)])
            keep = [f[0] >= MIN_WORDS and 100 * f[4] <= MAX_REPEAT_PERCENT * f[0] and v >= margin for f, v in zip(found, s)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return in_parts(docs).mapInArrow(run, docs.schema)


def quality_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, train(docs, labels))
