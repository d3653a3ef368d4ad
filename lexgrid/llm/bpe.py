"""Byte-level BPE as a streaming transducer with bounded lookahead.

The vocabulary's merge list has a sufficient lookahead: what stands farther right than that cannot change a token any
more (chains of overlapping merges of rising priority, times the longest token). Text is fed in blocks; a pre-token is
final once its end lies before the last few characters of the buffer, and in a pre-token longer than the lookahead the
tokens before the lookahead are final. So memory is bounded by the block and the lookahead, however long a text or a
word is. Decoding feeds the tokens' bytes to an incremental byte-to-text state machine.

Defined results: null and empty texts give an empty list; all other characters count, white space and unpaired signs too;
a lone surrogate is encoded as U+FFFD. Special tokens are never produced: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import codecs
import functools
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import spread

#: Fixed value: the pre-token pattern that byte_bpe_50k was built with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters at the end of the buffer that may still change the pre-token before them.
GUARD = 4
CACHE = 200_000
#: Characters fed at a time.
BLOCK = 512


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.lru_cache(2)
def load(path: str) -> BytePairs:
    with open(path, "rb") as f:
        return BytePairs({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes of right context that settle a token: the longest chain of merges, each of higher priority than the one before it and
    beginning inside it and ending behind it, times the longest token."""
    best: dict[bytes, int] = {}  # by proper prefix: the longest chain that begins with a token having it
    longest = 0
    for token, _ in sorted((x for x in ranks.items() if len(x[0]) > 1), key=lambda x: x[1]):
        chain = 1 + max(best.get(token[i:], 0) for i in range(len(token)))
        longest = max(longest, chain)
        for i in range(1, len(token)):
            if best.get(token[:i], 0) < chain:
                best[token[:i]] = chain
    return longest * max(map(len, ranks))


class BytePairs:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.find = regex.compile(PATTERN)
        self.cache: dict[str, tuple[int, ...]] = {}

    @functools.cached_property
    def longest(self) -> int:
        return max(map(len, self.ranks))

    @functools.cached_property
    def lookahead(self) -> int:
        return sufficient_lookahead(self.ranks)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank merges first, the left one among equals."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        n = len(word)
        start, nxt, prev = list(range(n + 1)), list(range(1, n + 2)), list(range(-1, n))
        heap = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (r := ranks.get(word[i : nxt[j]])) is not None:
                heapq.heappush(heap, (r, i, nxt[j]))

        for i in range(n - 1):
            offer(i)
        gone = bytearray(n + 1)
        while heap:
            _, i, end = heapq.heappop(heap)
            if gone[i] or (j := nxt[i]) >= n or nxt[j] != end:
                continue
            gone[j] = 1
            nxt[i] = end
            if end <= n:
                prev[end] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : nxt[i]]])
            i = nxt[i]
        return out

    def word(self, text: str) -> tuple[int, ...]:
        ids = self.cache.get(text)
        if ids is None:
            ids = tuple(self.merge(text.encode()))
            if len(text) <= 64:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[text] = ids
        return ids

    def stream(self, text: str | None, block: int = BLOCK) -> Iterator[list[int]]:
        """Ids of a text, fed block by block: lists of ids as they are settled."""
        if text:
            t = Transducer(self)
            for i in range(0, len(text), block):
                yield t.feed(text[i : i + block])
            yield t.finish()

    def encode(self, text: str | None, block: int = BLOCK) -> list[int]:
        """All ids of a text."""
        return [i for ids in self.stream(text, block) for i in ids]

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text pieces as soon as they are settled; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if piece := machine.decode(self.bytes_of[i]):
                yield piece
        if piece := machine.decode(b"", final=True):
            yield piece


class Transducer:
    """feed() returns the ids that are settled so far, finish() the rest. `held` is all it keeps of the text."""

    def __init__(self, pairs: BytePairs):
        self.pairs, self.held, self.half = pairs, "", ""

    def feed(self, text: str) -> list[int]:
        text = self.half + text
        self.half = text[-1:] if "\ud800" <= text[-1:] <= "\udbff" else ""  # its other half may be still to come
        return self._run(text[: len(text) - len(self.half)], False)

    def finish(self) -> list[int]:
        text, self.half = self.half, ""
        return self._run(text, True)

    def _run(self, text: str, final: bool) -> list[int]:
        try:
            text.encode()
        except UnicodeEncodeError:  # unpaired surrogates
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        pieces, open_, waiting = self.pairs.find.findall(self.held + text), [], 0  # the pattern leaves out no sign
        while pieces and not final and waiting < GUARD:
            open_.append(pieces.pop())
            waiting += len(open_[-1])
        self.held = "".join(reversed(open_))
        out: list[int] = []
        get, word = self.pairs.cache.get, self.pairs.word
        for piece in pieces:
            out += get(piece) or word(piece)
        if len(self.held) > 2 * self.pairs.longest and len(self.held) > 2 * self.pairs.lookahead + GUARD:
            out += self._inside()
        return out

    def _inside(self) -> list[int]:
        """The buffer is one unfinished pre-token: its tokens before the lookahead are settled."""
        raw = self.held[:-GUARD].encode()
        settled, at, ids, cut = len(raw) - self.pairs.lookahead, 0, [], (0, 0)
        for i in self.pairs.merge(raw):
            at += len(self.pairs.bytes_of[i])
            if at > settled:
                break
            ids.append(i)
            if at == len(raw) or raw[at] & 0xC0 != 0x80:  # a cut inside a character could not be fed again
                cut = (at, len(ids))
        if cut[0]:
            self.held = raw[cut[0] :].decode() + self.held[-GUARD:]
        return ids[: cut[1]]


def encode_column(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>) for every row of df. Of a text only the ids themselves grow with its length, four bytes each."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(path)
        for b in batches:
            values, ends = array("i"), array("i", [0])
            for row in b.column(1):
                for ids in pairs.stream(row.as_py()):
                    values.extend(ids)
                ends.append(len(values))
            lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(values, np.int32) if values else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def count_column(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, tokens BIGINT) for every row of df; no ids are kept."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(path)
        for b in batches:
            sizes = [sum(map(len, pairs.stream(row.as_py()))) for row in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=[key, "tokens"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, tokens bigint")


def decode_column(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(key, text) for every row of df; null ids give an empty text."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = load(path)
        for pdf in batches:
            yield pd.DataFrame({key: pdf.iloc[:, 0], "text": ["".join(pairs.decode(() if x is None else x)) for x in pdf.iloc[:, 1]]})

    return df.select(key, ids).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
