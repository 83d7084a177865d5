"""Encoding and decoding with a public byte-level BPE vocabulary, as streaming transducers.

A text is fed in pieces. Pre-tokens are final once three characters after them are known, and are
merged by rank. Of a pre-token that has not ended yet only a bounded tail is kept: the merge list
determines how far unseen bytes can reach back, so tokens farther from the end than this lookahead
are stable and leave at once. Decoding turns token bytes into text as soon as characters are complete.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_FILE = "/opt/tokenizers/byte_bpe_50k.json"
#: How a text is split before merging; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEEN = 3  # characters after a pre-token that settle it
CHUNK = 1 << 16


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes: bytes that print stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, merge ranks and the lookahead they imply."""

    def __init__(self, data: bytes) -> None:
        letters = _byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        model = json.loads(data)["model"]
        ids = model["vocab"]
        self.tokens: dict[int, bytes] = {i: raw(t) for t, i in ids.items() if all(c in letters for c in t)}
        self.byte_id = [0] * 256
        for i, t in self.tokens.items():
            if len(t) == 1:
                self.byte_id[t[0]] = i
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes before the end that unseen bytes can still change.

        A change reaches left across a boundary only by a merge (t, s) over it, and then again only by a
        later merge whose right part begins with t. So the longest chain of left parts over rules of
        rising rank, where each right part has the previous left part on its left spine, bounds the reach.
        """
        spine: dict[int, list[int]] = {i: [i] for i in self.byte_id}
        reach: dict[int, int] = {}
        for (t, s), (_, whole) in self.merges.items():  # in order of rank
            best = max((reach.get(u, 0) for u in spine[s]), default=0)
            reach[t] = max(reach.get(t, 0), len(self.tokens[t]) + best)
            spine.setdefault(whole, [*spine[t], whole])
        return max(reach.values(), default=0) + 1

    def encode_piece(self, piece: bytes) -> list[int]:
        """Merge one pre-token: always the lowest rank, of equal ones the leftmost."""
        sym = [self.byte_id[b] for b in piece]
        n = len(sym)
        if n < 2:
            return sym
        merges = self.merges
        nxt, prev, alive = list(range(1, n)) + [-1], list(range(-1, n - 1)), [True] * n
        heap = [(r[0], i, sym[i], sym[i + 1], r[1]) for i in range(n - 1) if (r := merges.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j] = new, False
            k = nxt[i] = nxt[j]
            if k >= 0:
                prev[k] = i
                if r := merges.get((new, sym[k])):
                    heapq.heappush(heap, (r[0], i, new, sym[k], r[1]))
            h = prev[i]
            if h >= 0 and (r := merges.get((sym[h], new))):
                heapq.heappush(heap, (r[0], h, sym[h], new, r[1]))
        return [s for s, x in zip(sym, alive) if x]


class Encoder:
    """feed() returns the ids that no further text can change, finish() the rest."""

    def __init__(self, vocabulary: Vocabulary, cache: dict[str, list[int]] | None = None, max_cache: int = 200_000) -> None:
        self.v, self.cache, self.max_cache = vocabulary, {} if cache is None else cache, max_cache
        self.pattern = regex.compile(PATTERN)
        self.rest = ""

    def _piece(self, piece: str, out: list[int]) -> None:
        ids = self.cache.get(piece)
        if ids is None:
            ids = self.v.encode_piece(piece.encode("utf-8"))
            if len(piece) <= 64:
                if len(self.cache) >= self.max_cache:
                    self.cache.clear()
                self.cache[piece] = ids
        out.extend(ids)

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        text, end, last = self.rest + text, 0, len(self.rest) + len(text) - SEEN
        for m in self.pattern.finditer(text):
            if m.end() > last:
                break
            self._piece(m.group(), out)
            end = m.end()
        self.rest = text[end:]
        if len(self.rest) > 4 * self.v.lookahead:
            self._settle_long(out)
        return out

    def _settle_long(self, out: list[int]) -> None:
        """Emit the stable tokens of a pre-token without an end yet."""
        m = self.pattern.match(self.rest)
        run = m.group()[:-SEEN]
        data = run.encode("utf-8")
        ids = self.v.encode_piece(data)
        limit, at, good, cut = len(data) - self.v.lookahead, 0, 0, 0
        for n, i in enumerate(ids, 1):
            at += len(self.v.tokens[i])
            if at > limit:
                break
            # a cut is made between characters; what follows it belongs to the pre-token, so that an apostrophe
            # behind the cut is followed by a mark and can't start a contraction
            if data[at] & 0xC0 != 0x80:
                good, cut = n, at
        if good:
            out.extend(ids[:good])
            self.rest = self.rest[len(data[:cut].decode("utf-8")) :]

    def finish(self) -> list[int]:
        out: list[int] = []
        for m in self.pattern.finditer(self.rest):
            self._piece(m.group(), out)
        self.rest = ""
        return out

    def encode(self, text: str, chunk: int = CHUNK) -> list[int]:
        out: list[int] = []
        for i in range(0, len(text), chunk):
            out += self.feed(text[i : i + chunk])
        return out + self.finish()


class Decoder:
    """feed() returns the characters that are complete; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.machine = vocabulary, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(self.v.tokens.get(int(i), b"") for i in ids))

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


_LOADED: dict[int, tuple[Vocabulary, dict[str, list[int]]]] = {}


def _loaded(data: bytes) -> tuple[Vocabulary, dict[str, list[int]]]:
    """One vocabulary a Python worker, with the cache of its pre-tokens."""
    key = hash(data)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(data), {}
    return _LOADED[key]


def encode_column(df: DataFrame, key: str, text: str, file: str = DEFAULT_FILE, ids: str = "ids") -> DataFrame:
    """(key, ids): the ids of each text, without special tokens; their strings in a text are plain text.

    Null and empty texts have the empty list. Rows are kept as they are, repeated keys and null keys
    too; other columns are ignored. The vocabulary file is read on the driver and broadcast (1.6 MB).
    """
    with open(file, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, cache = _loaded(data.value)
        enc = Encoder(v, cache)
        for b in batches:
            lists = [enc.encode(t) if t else [] for t in b.column(1).to_pylist()]
            sizes = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(sizes[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], names=[key, ids])

    return df.select(key, F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{ids}` array<int>")


def decode_column(df: DataFrame, key: str, ids: str, file: str = DEFAULT_FILE, text: str = "text") -> DataFrame:
    """(key, text) of lists of ids; null and empty lists have the empty text, unknown ids no text."""
    with open(file, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, _ = _loaded(data.value)
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                d = Decoder(v)
                out.append(d.feed(i for i in x or [] if i is not None) + d.finish())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, text])

    return df.select(key, F.col(ids).alias("_ids")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{text}` string")
