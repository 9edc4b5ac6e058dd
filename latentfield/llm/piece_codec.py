"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text's symbols are merged best score first, as an agenda of candidate merges is worked off. Each
candidate is skipped if a keyed hash of (seed, the document's key, the word's number in the text, place, left symbol,
right symbol) falls below the dropout rate, so each occurrence of a word is segmented by itself, and reproducibly.
Without dropout the pieces are those of the sentencepiece library.

No piece of the model reaches over a word's begin, so words are encoded by themselves. What the agenda
does depends only on the word and on which of the offered candidates are skipped, so that is what the bounded cache
holds: a node for a word and a set of skipped candidates has the pieces and the candidates that were merged on the way; an
occurrence tests them with its own key and goes on to the node of those that it skips, until it skips no more. New nodes
of a batch, and occurrences that need a node that no other one of the batch needs, are merged together in numpy arrays, one merge for each word and
round; words of over LONG characters go through a heap instead, in time that grows as n log n.

Characters outside the vocabulary, and a literal U+2581, become byte pieces: decoding gives back every text exactly.

Defined cases: null text has null pieces and decodes to null (the query counts 0 pieces and calls it
lossless); an empty text has none; a null doc_id has a key of its own; equal rows get equal pieces;
texts of any length are encoded whole; other columns pass through unread, but for one named piece_ids, which the pieces replace.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_size, fresh, in_parts, small

SPACE = "▁"
LONG = 40
BIG = np.int64(1 << 40)
M64 = (1 << 64) - 1
CACHE_NODES = 200_000
#: Candidates of a node that fit into a mask.
MASK_BITS = 62
#: Words are merged together with others of about their length, so many at once.
WIDTHS, BLOCK = (6, 9, 13, 20), 1 << 13
#: The symbol of a place that is empty, and the rank of a pair that can't be merged.
GONE, LAST = -(1 << 30), 1 << 30
#: Bits of a symbol in a candidate's number.
SYMBOL_BITS = 17


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mixed_one(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


#: Bits of a candidate's number: place in a short word, left and right symbol.
OFFER_BITS = 6 + 2 * SYMBOL_BITS


def offer_hash(place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(place.astype(np.uint64) << np.uint64(48) ^ left.astype(np.uint64) << np.uint64(24) ^ right.astype(np.uint64))


class Codec:
    """Encodes and decodes with the BPE model at path."""

    def __init__(self, path: str, *, dropout: float = 0.1, seed: int = 1):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.encode("a  b", out_type=str)[:1] != [SPACE + "a"] or "".join(sp.encode(" x\t ", out_type=str)).count(SPACE) != 3:
            raise ValueError("the model changes texts before it encodes them, so decoding would not give them back")
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.full(256, -1, np.int32)
        ids: dict[str, int] = {}
        self.table: list[bytes] = []
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.table.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.table.append(b"")
            else:
                ids[p] = i
                self.table.append(p.replace(SPACE, " ").encode())
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces, so unknown characters would be lost")
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece reaches over the begin of a word")
        apart = "" if any("\n" in p for p in ids) else "\n"
        self.words = re.compile(f" *[^ {apart}]+| +" + f"|{apart}" * bool(apart))
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in ids.values()}, reverse=True))}
        self.rank = np.full(n, BIG, np.int64)
        self.rank[list(ids.values())] = [order[sp.get_score(i)] for i in ids.values()]
        self.rank32 = np.minimum(self.rank, LAST).astype(np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[0x20], self.char[0x2581] = ids.get(SPACE, -1), -1
        keys, merged = [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(i)
        by = np.argsort(np.array(keys, np.int64))
        self.pair_keys, self.pair_ids = np.array(keys, np.int64)[by], np.array(merged, np.int32)[by]
        self.pairs = dict(zip(keys, merged))
        # the same pairs in an open table with places for eight times as many
        self.bits = max(int(np.ceil(np.log2(8 * max(len(keys), 1)))), 4)
        self.slot_keys, self.slot_ids, self.probes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32), 1
        for k, i in zip(keys, merged):
            s, probe = self.slot(k), 1
            while self.slot_keys[s] >= 0:
                s, probe = (s + 1) & ((1 << self.bits) - 1), probe + 1
            self.slot_keys[s], self.slot_ids[s], self.probes = k, i, max(self.probes, probe)
        self.cut = int(dropout * 2**32)
        if n >= 1 << SYMBOL_BITS:
            raise ValueError("the model has too many pieces")
        self.seed = seed
        self.forget()

    def forget(self) -> None:
        """Empties the cache. Of each node: word, skipped candidates, pieces, and where its own candidates stand."""
        self.roots: dict[str, int] = {}
        self.children: dict[tuple[int, int], int] = {}
        self.node_words: list[str] = []
        self.node_skips: list[np.ndarray] = []
        self.node_data: list[bytes] = []
        self.node_ends = np.zeros(1, np.int64)
        self.offers = np.zeros(0, np.int64)
        self.offer_hashes = np.zeros(0, np.uint64)

    def slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & M64) >> (64 - self.bits)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols merges to, or -1."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.slot_keys[at]
        out = np.where(got == key, self.slot_ids[at], -1)
        open_ = np.flatnonzero((got != key) & (got >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got = self.slot_keys[at[open_]]
            hit = got == key[open_]
            out[open_[hit]] = self.slot_ids[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return np.where((left >= 0) & (right >= 0), out, -1)

    def text_key(self, key: int | tuple | None) -> int:
        return int.from_bytes(hashlib.blake2b(f"{self.seed}:{key}".encode(), digest_size=8).digest(), "little")

    def skipped(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return (mixed(keys ^ hashes) >> np.uint64(32)).astype(np.int64) < self.cut

    def agenda(self, word: str, key: int) -> list[int]:
        """The pieces of one occurrence of a word by a heap of candidates."""
        points = [ord(c) for c in word]
        sym = [int(self.char[c]) for c in points]
        n = len(sym)
        after, before, dead = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= n or sym[i] < 0 or sym[j] < 0:
                return
            m = self.pairs.get(sym[i] << 32 | sym[j])
            if m is None:
                return
            if self.cut and mixed_one(key ^ mixed_one((i << 48 ^ sym[i] << 24 ^ sym[j]) & M64)) >> 32 < self.cut:
                return
            heapq.heappush(heap, (int(self.rank[m]), i, sym[i], sym[j], m))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], dead[j], after[i] = m, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out: list[int] = []
        i = 0
        while i < n:
            out += [sym[i]] if sym[i] >= 0 else [int(self.byte_ids[x]) for x in chr(points[i]).encode()]
            i = after[i]
        return out

    def merge_all(self, words: list[str], keys: list[int] | np.ndarray) -> list[bytes]:
        """The pieces of many short words, as bytes of 32-bit ids. keys: of each occurrence."""
        keys = np.asarray(keys, np.uint64)

        def skip(word: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            return self.skipped(keys[word], offer_hash(place, left, right))

        return self.merged(words, skip if self.cut else None)

    def explored(self, words: list[str], skips: list[np.ndarray]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The pieces of words if exactly the candidates in skips are skipped, and the candidates that are merged: word's number and candidate, in order.

        A candidate that never gets to its merge changes nothing, skipped or not, so an occurrence tests only these.
        """
        gone = np.concatenate([s | i << OFFER_BITS for i, s in enumerate(skips)] or [np.zeros(0, np.int64)])
        gone.sort()
        done: list[np.ndarray] = []

        def numbered(word: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            return word << OFFER_BITS | place << 2 * SYMBOL_BITS | left << SYMBOL_BITS | right

        def skip(*offered: np.ndarray) -> np.ndarray:
            x = numbered(*offered)
            return gone[np.minimum(np.searchsorted(gone, x), len(gone) - 1)] == x

        data = self.merged(words, skip if len(gone) else None, (lambda *x: done.append(numbered(*x))) if self.cut else None)
        x = np.sort(np.concatenate(done or [np.zeros(0, np.int64)]))
        return data, x >> OFFER_BITS, x & ((1 << OFFER_BITS) - 1)

    def added(self, words: list[str], skips: list[np.ndarray], tested: list[np.ndarray]) -> range:
        """New nodes; tested: candidates of the nodes above, which need no second test."""
        first = len(self.node_data)
        data, of, offers = self.explored(words, skips)
        above = np.concatenate([t | i << OFFER_BITS for i, t in enumerate(tested)] or [np.zeros(0, np.int64)])
        new = ~np.isin(of << OFFER_BITS | offers, above)
        of, offers = of[new], offers[new]
        self.node_words += words
        self.node_skips += skips
        self.node_data += data
        self.node_ends = np.append(self.node_ends, self.node_ends[-1] + np.cumsum(np.bincount(of, minlength=len(words))))
        self.offers = np.append(self.offers, offers)
        ones = (1 << SYMBOL_BITS) - 1
        self.offer_hashes = np.append(self.offer_hashes, offer_hash(offers >> 2 * SYMBOL_BITS, offers >> SYMBOL_BITS & ones, offers & ones))
        return range(first, first + len(words))

    def occurrences(self, words: list[str], keys: np.ndarray, times: Counter[str] | None = None) -> list[bytes]:
        """The pieces of occurrences of short words, each with its key; the same as merge_all gives. times: how often each word occurs."""
        new = sorted(w for w, n in (Counter(words) if times is None else times).items() if n > 1 and w not in self.roots)
        none = np.zeros(0, np.int64)
        if new:
            self.roots.update(zip(new, self.added(new, [none] * len(new), [none] * len(new))))
        at = np.fromiter(map(self.roots.get, words, repeat(-1)), np.int64, len(words))
        alone = np.flatnonzero(at < 0).tolist()  # a word that the batch has once is merged for itself
        active = np.flatnonzero(at >= 0) if self.cut else np.zeros(0, np.int64)
        while len(active):
            size = self.node_ends[at[active] + 1] - self.node_ends[at[active]]
            alone += active[size > MASK_BITS].tolist()
            some = (size > 0) & (size <= MASK_BITS)
            active, size = active[some], size[some]
            if not len(active):
                break
            begin = np.cumsum(size) - size
            bit = np.arange(int(size.sum())) - np.repeat(begin, size)
            hit = self.skipped(np.repeat(keys[active], size), self.offer_hashes[np.repeat(self.node_ends[at[active]], size) + bit])
            mask = np.add.reduceat(hit.astype(np.int64) << bit, begin)
            active, mask = active[mask != 0], mask[mask != 0]
            steps = list(zip(at[active].tolist(), mask.tolist()))
            missing = Counter(x for x in steps if x not in self.children)
            make = [x for x, n in missing.items() if n > 1]
            if make:
                own = [self.offers[self.node_ends[k] : self.node_ends[k + 1]] for k, _ in make]
                more = [o[(m >> np.arange(len(o))) & 1 > 0] for o, (_, m) in zip(own, make)]
                skips = [np.append(self.node_skips[k], x) for (k, _), x in zip(make, more)]
                # candidates above that were tested and not skipped may be offered again, and testing them again changes nothing
                self.children.update(zip(make, self.added([self.node_words[k] for k, _ in make], skips, own)))
            to = np.fromiter(map(self.children.get, steps, repeat(-1)), np.int64, len(steps))
            alone += active[to < 0].tolist()
            active = active[to >= 0]
            at[active] = to[to >= 0]
        out = [self.node_data[k] if k >= 0 else b"" for k in at.tolist()]
        if alone:
            for i, x in zip(alone, self.merge_all([words[i] for i in alone], keys[alone])):
                out[i] = x
        return out

    def merged(self, words: list[str], skip: Callable | None, seen: Callable | None = None) -> list[bytes]:
        """The pieces of many short words, without the candidates (word's number, place, left, right) that skip tells; seen is given those that are merged."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = [b""] * len(words)
        low = 0
        for width in (*WIDTHS, max(int(size.max(initial=0)), WIDTHS[-1] + 1)):
            alike = np.flatnonzero((size > low) & (size <= width))
            for s in range(0, len(alike), BLOCK):
                rows = alike[s : s + BLOCK]
                for i, data in zip(rows.tolist(), self.merged_block([words[i] for i in rows.tolist()], rows, width, skip, seen)):
                    out[i] = data
            low = width
        return out

    def merged_block(self, words: list[str], names: np.ndarray, width: int, skip: Callable | None, seen: Callable | None) -> list[bytes]:
        """merged() for words of up to width symbols, a row of places for each; names: what skip and seen know them as.

        In each round each word merges its best pair. A symbol knows its neighbours' places; the spare place behind all stands for none.
        """
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(n), size)
        at = np.arange(len(points)) + (np.arange(n) * width - np.cumsum(size) + size)[row]
        none = n * width
        sym = np.full(none + 1, GONE, np.int32)
        own = self.char[points]
        sym[at] = np.where(own < 0, -1 - points.astype(np.int32), own)
        after, before = np.full(none + 1, none, np.int32), np.full(none + 1, none, np.int32)
        joined = np.flatnonzero(row[1:] == row[:-1])
        after[at[joined]], before[at[joined + 1]] = at[joined + 1], at[joined]
        to, rank = np.full(none + 1, -1, np.int32), np.full(none + 1, LAST, np.int32)

        def offer(left: np.ndarray, right: np.ndarray) -> None:
            """Puts the pairs at these places on the agenda, in place of what was there."""
            a, b = sym[left], sym[right]
            m = self.lookup(a, b)
            r = np.where(m >= 0, self.rank32[m], LAST)
            if skip is not None:
                some = np.flatnonzero(m >= 0)
                p = left[some].astype(np.int64)
                r[some[skip(names[p // width], p % width, a[some].astype(np.int64), b[some].astype(np.int64))]] = LAST
            to[left], rank[left] = m, r

        offer(at[joined], at[joined + 1])
        rows = rank[:none].reshape(n, width)
        active = np.arange(n)
        while len(active):
            own = rows if len(active) == n else rows[active]
            best = own.argmin(axis=1)
            place = active * width + best
            go = rank[place] < LAST
            active, best, place = active[go], best[go], place[go]
            behind = after[place]
            if seen is not None and len(active):
                seen(names[active], best, sym[place].astype(np.int64), sym[behind].astype(np.int64))
            sym[place], sym[behind], rank[behind] = to[place], GONE, LAST
            right, left = after[behind], before[place]
            after[place], before[right] = right, place
            offer(np.concatenate([left, place]), np.concatenate([place, right]))
            rank[none], sym[none] = LAST, GONE
        kept = sym[:none] != GONE
        ends = np.cumsum(kept.reshape(n, width).sum(axis=1))
        ids = sym[:none][kept]
        if (ids < 0).any():
            parts = [np.array([x], np.int32) if x >= 0 else self.byte_ids[np.frombuffer(chr(-1 - x).encode(), np.uint8)] for x in ids.tolist()]
            ends = np.append(0, np.cumsum([len(x) for x in parts]))[ends]
            ids = np.concatenate(parts)
        data = ids.astype("<i4").tobytes()
        ends = (4 * ends).tolist()
        return [data[s:e] for s, e in zip([0, *ends[:-1]], ends)]

    def encode(self, texts: list[str], keys: list) -> list[bytes]:
        """The pieces of each text as bytes of 32-bit little-endian ids. keys: of each text, such as its doc_id."""
        if len(self.node_data) > CACHE_NODES:
            self.forget()
        each = [self.words.findall(" " + x) if x else [] for x in texts]
        size = np.fromiter(map(len, each), np.int64, len(each))
        ends = np.cumsum(size)
        words = list(chain.from_iterable(each))
        number = np.arange(len(words), dtype=np.uint64) - np.repeat((ends - size).astype(np.uint64), size)
        own = mixed(np.repeat(np.array([self.text_key(k) for k in keys], np.uint64), size) + number * np.uint64(0x9E3779B97F4A7C15))
        times = Counter(words)
        above = {w for w in times if len(w) > LONG}
        long = [i for i, w in enumerate(words) if w in above] if above else []
        for i in long:
            times[words[i]] = 0
        short = [" " if w in above else w for w in words] if above else words
        out = self.occurrences(short, own, times)
        for i in long:
            out[i] = np.array(self.agenda(words[i], int(own[i])), "<i4").tobytes()
        return [b"".join(out[e - n : e]) for n, e in zip(size.tolist(), ends.tolist())]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids))[1:].decode("utf-8", "replace")


PART = 1 << 20


@lru_cache(maxsize=2)
def codec_of(path: str, dropout: float = 0.1, seed: int = 1) -> Codec:
    """One for all tasks of a Python worker, so that each starts with the cache of those before."""
    return Codec(path, dropout=dropout, seed=seed)


def with_pieces(docs: DataFrame, path: str, *, dropout: float = 0.1, seed: int = 1, key: str = "doc_id", keep: list[str] | None = None, occurrence: str | None = None) -> DataFrame:
    """The columns in keep (default: all but text) and piece_ids, an array of ids, in place of a column of that name; one pass, no shuffle. occurrence: a column with numbers from 1 for repetitions of a document, each segmented by itself."""
    keep = [c for c in docs.columns if c not in ("text", "piece_ids", occurrence)] if keep is None else keep
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, len(keep)):
            codec = codec_of(path, dropout, seed)
            texts, times = b.column(len(keep)).to_pylist(), b.column(len(keep) + 2).to_pylist()
            keys = [k if n == 1 else (k, n) for k, n in zip(b.column(len(keep) + 1).to_pylist(), times)]
            start = 0
            for part in by_size(range(len(texts)), lambda i: len(texts[i] or ""), PART):
                data = codec.encode([texts[i] or "" for i in part], [keys[i] for i in part])
                offsets = np.append(0, np.cumsum([len(x) // 4 for x in data])).astype(np.int32)
                none = np.array([texts[i] is None for i in part] + [False])
                ids = pa.ListArray.from_arrays(pa.array(offsets, mask=none), pa.array(np.frombuffer(b"".join(data), "<i4")))
                cols = [c.slice(start, len(part)) for c in b.columns[: len(keep)]]
                start += len(part)
                yield pa.RecordBatch.from_arrays([*cols, ids], names=[*(f.name for f in fields), "piece_ids"])

    schema = T.StructType([*fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))])
    text, own, times = (fresh(docs, x) for x in ("__text", "__key", "__times"))
    return in_parts(docs).select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias(text), F.col(key).cast("long").alias(own), (F.lit(1) if occurrence is None else F.col(occurrence)).cast("long").alias(times)).mapInArrow(run, schema)


def with_text(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with the text that its piece_ids decode to, in place of the ids."""
    keep = [c for c in encoded.columns if c not in ("piece_ids", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codec = codec_of(path)
            texts = [None if x is None else codec.decode(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField("text", T.StringType())])
    return in_parts(encoded).select(*(F.col(f"`{c}`") for c in keep), "piece_ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, *, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """For each document: n_pieces, ids_crc (of the ids' bytes) and whether the pieces decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, "text"):
            codec = codec_of(path, dropout, seed)
            texts, keys = [x or "" for x in b.column("text").to_pylist()], b.column("doc_id").to_pylist()
            rows = []
            for part in by_size(range(len(texts)), lambda i: len(texts[i]), PART):
                for i, data in zip(part, codec.encode([texts[i] for i in part], [keys[i] for i in part])):
                    ids = np.frombuffer(data, "<i4").tolist()
                    rows.append((len(ids), zlib.crc32(data), codec.decode(ids) == texts[i]))
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_())))], names=["doc_id", "n_pieces", "ids_crc", "lossless"])

    return in_parts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc long, lossless boolean")
