"""Token counts by overlap resynchronisation.

A text of up to chunk_chars is counted in units, each white space and what follows up to the next white space: the
byte-level pre-tokeniser always cuts before white space that follows another character, and what it cuts behind
depends on nothing before, so the counts of units add up to the text's. The library encodes each unit once;
a bounded cache holds its count. Texts with special strings or rare white space, and tokenizers of other kinds,
go through the library whole.

A longer text is cut into chunks that overlap. Each
chunk is encoded by itself, with offsets, and two neighbours are spliced at a boundary that both of
them show and that is proven stable: the pre-tokeniser cuts from left to right and what it cuts
after a boundary depends on nothing before it, so once the right chunk shares a cut between two
pre-tokens with the (true) left chunk, all later cuts agree as well. Cuts near the left chunk's end
don't count, since more text could change the last pre-tokens there or complete a special string.
If no common cut is found, the overlap is doubled, in the end up to the whole of both chunks.

Defined cases: null text is empty (0 bytes, 0 tokens); a null doc_id is passed through; rows are
counted one by one, so repeats and ties don't matter; other columns are never read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, in_parts, small

LIMIT = 512
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Characters in the cache of units, each unit counted as 100 more.
CACHE_CHARS = 64 << 20
#: White space, and what some Unicode version may take for it, besides blank, tab and line ends.
RARE_SPACE = "\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
RARE = re.compile(f"[{RARE_SPACE}]")
UNITS = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
#: A part between blanks (a line end begins a part) that can't be counted apart from its neighbours; a lone line end can.
UNSURE = re.compile(rf"(?!\n\Z)(?:\Z|\n\n|\n?[ \t\r{RARE_SPACE}]|.*[ \t\r\n{RARE_SPACE}]\Z)", re.DOTALL)
#: What stands for the count of such a part.
NEVER = 1 << 50


class Counter:
    """Counts tokens as the tokenizers library does, without begin, end or padding tokens."""

    def __init__(self, path: str, chunk_chars: int = 32_768, overlap_chars: int = 256):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.chunk, self.overlap = chunk_chars, overlap_chars
        #: The last pre-token and an unfinished special string end at most this far from a chunk's end, besides one whole pre-token.
        self.guard = max([len(x.content) for x in self.t.get_added_tokens_decoder().values()], default=1) + 1
        self.widened = 0
        own = json.loads(self.t.to_str())
        cuts = own["pre_tokenizer"] or {}
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.by_units = own["normalizer"] is None and own["model"]["type"] == "BPE" and not own["model"].get("dropout") and cuts.get("type") == "ByteLevel" and not cuts["add_prefix_space"] and cuts.get("use_regex", True)
        #: Tokens of parts that follow a blank or begin with a line end, and of units as they are.
        self.parts: dict[str, int] = {}
        self.units: dict[str, int] = {}
        self.cached = 0

    def encoded(self, texts: list[str]) -> list[int]:
        """Tokens of each text by the library."""
        out: list[int] = []
        for part in by_size(texts, lambda x: len(x) + 50, 1 << 20):
            out += [len(e.ids) for e in self.t.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def known(self, cache: dict[str, int], each: list[list[str]], blank: str) -> None:
        """Adds to the cache what of each isn't in it."""
        new = set()
        for x in each:
            new.update(x)
        new = sorted(new.difference(cache))
        sure = [x for x in new if not blank or not UNSURE.match(x)]
        cache.update(dict.fromkeys(new, NEVER))
        cache.update(zip(sure, self.encoded([x if x[:1] == "\n" else blank + x for x in sure])))
        self.cached += sum(map(len, new)) + 100 * len(new)

    def in_units(self, texts: list[str]) -> list[int]:
        """Tokens of each text, as the sum over its units."""
        if self.cached > CACHE_CHARS:
            self.parts, self.units, self.cached = {}, {}, 0
        # cuts at blanks and before line ends are quick and right where no white space meets another, but for one empty line
        plain = [i for i, x in enumerate(texts) if x and not ("\n\n\n" in x or "\n\n " in x or x.endswith("\n\n"))]
        each = [texts[i].replace("\n", " \n").split(" ") for i in plain]
        out: list[int] = [NEVER] * len(texts)
        self.known(self.parts, [x[1:] for x in each], " ")
        self.known(self.units, [x[:1] for x in each], "")
        get = self.parts.__getitem__
        for i, x in zip(plain, each):
            out[i] = (NEVER if UNSURE.match(x[0]) or x[0] == "\n" else self.units[x[0]]) + sum(map(get, x[1:]))
        rest = [i for i, n in enumerate(out) if n >= NEVER]
        rare = {i for i in rest if RARE.search(texts[i])}
        rest = [i for i in rest if i not in rare]
        each = [UNITS.findall(texts[i]) for i in rest]
        self.known(self.units, each, "")
        for i, x in zip(rest, each):
            out[i] = sum(map(self.units.__getitem__, x))
        for i, n in zip(sorted(rare), self.encoded([texts[i] for i in sorted(rare)])):
            out[i] = n
        return out

    def counts(self, texts: list[str]) -> list[int]:
        out = [-1] * len(texts)
        short = [i for i, x in enumerate(texts) if len(x) <= self.chunk]
        whole = [i for i in short if not self.by_units or any(s in texts[i] for s in self.special)]
        for i, n in zip(whole, self.encoded([texts[i] for i in whole])):
            out[i] = n
        for part in by_size([i for i in short if out[i] < 0], lambda i: len(texts[i]) + 50, 1 << 22):
            for i, n in zip(part, self.in_units([texts[i] for i in part])):
                out[i] = n
        return [self.spliced(x) if n < 0 else n for x, n in zip(texts, out)]

    def cuts(self, text: str, start: int, end: int) -> tuple[dict[int, int], int]:
        """Position in the text of each cut between pre-tokens -> tokens of the chunk before it; the tokens of the chunk."""
        e = self.t.encode(text[start:end], add_special_tokens=False)
        words, spans = e.word_ids, e.offsets
        found, last = {}, None
        for k, (w, span) in enumerate(zip(words, spans)):
            if w != last or w is None:
                found[start + span[0]] = k
            last = w
        return found, len(words)

    def spliced(self, text: str) -> int:
        total, start = 0, 0
        n = len(text)
        left, size = self.cuts(text, 0, min(n, self.chunk))
        end = min(n, self.chunk)
        since = 0  # tokens of the left chunk that are counted already
        while end < n:
            overlap = self.overlap
            while True:
                begin = max(start, end - overlap)
                stop = min(n, begin + self.chunk)
                if stop <= end:
                    stop = min(n, end + self.chunk)
                right, right_size = self.cuts(text, begin, stop)
                proven = sorted(left)[:-1]  # the last pre-token may go on
                common = [p for p in proven if begin < p <= end - self.guard and p in right and left[p] >= since]
                if common:
                    p = common[-1]
                    total += left[p] - since
                    left, size, since, start, end = right, right_size, right[p], begin, stop
                    break
                self.widened += 1
                if begin == start:  # no common cut in the whole chunk: encode it again together with what follows
                    end = min(n, end + max(self.chunk, end - start))
                    left, size = self.cuts(text, start, end)
                    if end >= n:
                        break
                    overlap = self.overlap
                else:
                    overlap *= 2
        return total + size - since


@lru_cache(maxsize=2)
def counter_of(path: str, chunk_chars: int, overlap_chars: int) -> Counter:
    """One for all tasks of a Python worker."""
    return Counter(path, chunk_chars, overlap_chars)


def token_counts(docs: DataFrame, path: str, *, limit: int = LIMIT, chunk_chars: int = 32_768, overlap_chars: int = 256) -> DataFrame:
    """One row for each document; one pass, no shuffle. path: the tokenizer's file, found on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, "text"):
            counter = counter_of(path, chunk_chars, overlap_chars)
            texts = [x or "" for x in b.column("text").to_pylist()]
            n = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return in_parts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
