"""Passages of test items in a corpus.

Seeds are rare n-grams of the items: of every window of ``least`` words the n-gram found least often in
the whole corpus, and every other one below a share of it. A document that holds a window holds its seed,
so no exact copy is missed, and edited copies keep some of the others. The corpus is read once: a bitmap
of the items' n-grams, of bounded size, picks the stretches that may hold one; seeds and stretches are
then joined. Around seeds, Smith-Waterman alignment scores exact, edited and paraphrased copies; of the
alignments that score enough, the longest run of equal words tells the exact ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.llm.words import WORD, plain, words
from sieveloom.runtime import broadcast_if_small, materialize

N = 5
LEAST = 10
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the bitmap of item n-grams: at least, at most (32 MB).
BITS = 1 << 20, 1 << 28


class Numbers(dict):
    """64-bit numbers of words, remembered for the most recent ones."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        n = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        return n


NUMBERS = Numbers()


def numbers(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(NUMBERS.__getitem__, ws), dtype=np.int64, count=len(ws))


def grams(tok: np.ndarray) -> np.ndarray:
    """A 64-bit number of each run of N tokens."""
    n = max(0, len(tok) - N + 1)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(N):
            h = (h ^ tok[j : j + n].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _row_id(counter: int) -> int:
    return (TaskContext.get().partitionId() << 33) | counter


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens of each item, the number of the item's white-space word each belongs to, and its n-grams."""
    at = 0
    for b in batches:
        rows = []
        for item, text in zip(b["item"], b["text"]):
            split = [t for w in plain(text or "").split() if (t := WORD.findall(w))]
            tok = numbers([t for w in split for t in w])
            word = np.array([i for i, w in enumerate(split) for _ in w], dtype=np.int32)
            rows.append((_row_id(at), item, len(tok), tok.tobytes(), word.tobytes(), grams(tok)))
            at += 1
        yield pd.DataFrame(rows, columns=["iid", "item", "length", "tok", "word", "grams"])


def bitmap(gram: DataFrame) -> np.ndarray:
    """Two bits an n-gram of the column ``gram``, out of a number of bits bounded by BITS."""
    n = gram.count()
    size = BITS[0]
    while size < min(BITS[1], 64 * n):
        size *= 2
    at = F.explode(F.array(F.col("gram").bitwiseAND(F.lit(size - 1).cast("long")), F.shiftrightunsigned("gram", 32).bitwiseAND(F.lit(size - 1).cast("long"))))
    bit = gram.select(at.alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    out = np.zeros(size // 64, dtype=np.uint64)
    rows = bit.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most size / 64 rows
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def maybe(bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Places of n-grams that may be in the bitmap."""
    g, mask = gram.view(np.uint64), np.uint64(len(bits) * 64 - 1)
    out = np.arange(len(g))
    for shift in (0, 32):
        p = (g[out] >> np.uint64(shift)) & mask
        out = out[(bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
    return out


def _stretches(shared, pad: int, longest_text: int):
    """Stretches of a document around possible item n-grams: the n-grams, their places, and the tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, at = shared.value, 0
        for b in batches:
            rows = []
            for doc, text in zip(b["doc"], b["text"]):
                tok = numbers(words(text))
                g = grams(tok)
                hits = maybe(bits, g)
                # cut where hits are too far apart for one item, or a stretch gets too long
                while len(hits):
                    start = max(0, int(hits[0]) - pad)
                    ends = np.flatnonzero((np.diff(hits) > N + 2 * pad) | (hits[1:] - start >= longest_text))
                    n = int(ends[0]) + 1 if len(ends) else len(hits)
                    part, hits = hits[:n], hits[n:]
                    stop = min(len(tok), int(part[-1]) + N + pad)
                    rows.append((_row_id(at), doc, g[part], (part - start).astype(np.int32), tok[start:stop].tobytes()))
                    at += 1
            yield pd.DataFrame(rows, columns=["sid", "doc", "grams", "places", "tokens"])

    return run


def _seeds(least: int, rare: float):
    """Of each window of ``least`` words the rarest n-gram, and all n-grams found no more than ``rare`` times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for iid, word, found in b[["iid", "word", "found"]].itertuples(index=False, name=None):
                word = np.frombuffer(word, dtype=np.int32)
                found = sorted((r["pos"], r["gram"], r["n"]) for r in found)
                n = [x[2] for x in found]
                keep = {i for i, x in enumerate(n) if x <= rare}
                for w in range(int(word[-1]) - least + 2 if len(word) else 0):
                    a, z = np.searchsorted(word, w), np.searchsorted(word, w + least)
                    if z - a >= N:
                        keep.add(min(range(a, z - N + 1), key=lambda i: (n[i], found[i][1], i)))
                rows += [(iid, found[i][1], found[i][0]) for i in sorted(keep)]
            yield pd.DataFrame(rows, columns=["iid", "gram", "pos"])

    return run


def smith_waterman(a: np.ndarray, windows: list[np.ndarray], cells: int = 1 << 19) -> np.ndarray:
    """Best local alignment score of a with each window, linear gaps; one vectorised step a token of a for as
    many windows as ``cells`` allows. What fills shorter windows up matches nothing."""
    best = np.zeros(len(windows), dtype=np.int64)
    filler = np.int64(0)
    while (a == filler).any():
        filler += 1
    order = np.argsort([len(w) for w in windows], kind="stable")
    at = 0
    while at < len(order) and len(a):
        n = 1
        while at + n < len(order) and (n + 1) * (len(windows[order[at + n]]) + 1) <= cells:
            n += 1
        mine, at = order[at : at + n], at + n
        width = len(windows[mine[-1]])
        if not width:
            continue
        text = np.full((n, width), filler, dtype=np.int64)
        for i, k in enumerate(mine):
            text[i, : len(windows[k])] = windows[k]
        slope = (np.arange(1, width + 1) * -GAP).astype(np.int32)
        h, top = np.zeros((n, width + 1), dtype=np.int32), np.zeros(n, dtype=np.int32)
        for x in a:
            t = np.where(text == x, np.int32(MATCH), np.int32(MISMATCH))
            t += h[:, :-1]
            np.maximum(t, h[:, 1:] + np.int32(GAP), out=t)
            np.maximum(t, 0, out=t)
            t += slope
            np.maximum.accumulate(t, axis=1, out=t)
            t -= slope
            h[:, 1:] = t
            np.maximum(top, t.max(axis=1), out=top)
        best[mine] = top
    return best


def equal_run(doc: np.ndarray, item: np.ndarray, word: np.ndarray, shift: int) -> int:
    """Whole words of the item in the longest run of equal tokens, item[q] beside doc[q + shift]."""
    a, z = max(0, -shift), min(len(item), len(doc) - shift)
    if z <= a:
        return 0
    same = np.r_[False, item[a:z] == doc[a + shift : z + shift], False]
    edge = np.flatnonzero(same[1:] != same[:-1])
    left, right = a + edge[::2], a + edge[1::2]
    if not len(left):
        return 0
    first = word[left] + ((left > 0) & (word[np.maximum(left - 1, 0)] == word[left]))
    last = word[right - 1] - ((right < len(word)) & (word[np.minimum(right, len(word) - 1)] == word[right - 1]))
    return int(max(0, (last - first + 1).max()))


def _align(least: int, share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for _, g in b.groupby("iid", sort=False):
                item, word = np.frombuffer(g["tok"].iloc[0], dtype=np.int64), np.frombuffer(g["word"].iloc[0], dtype=np.int32)
                windows, of, texts = [], [], [np.frombuffer(t, dtype=np.int64) for t in g["tokens"]]
                anchors = [np.asarray(x, dtype=np.int64) for x in g["anchors"]]
                for i, x in enumerate(anchors):
                    places = np.unique(x >> 32)
                    for p in np.split(places, np.flatnonzero(np.diff(places) > 2 * len(item)) + 1):  # anchors farther apart belong to different copies
                        windows.append(texts[i][max(0, int(p[0]) - len(item)) : int(p[-1]) + N + len(item)])
                        of.append(i)
                scores = np.zeros(len(texts), dtype=np.int64)
                np.maximum.at(scores, of, smith_waterman(item, windows))
                # equal words score a match each at least; what scores less than ``least`` of them holds no such run
                for i in np.flatnonzero(scores >= MATCH * min(least, share * len(item))):
                    shifts = np.unique((anchors[i] >> 32) - (anchors[i] & 0xFFFFFFFF))
                    run_ = max(equal_run(texts[i], item, word, int(d)) for d in shifts)
                    part = float(scores[i]) / (MATCH * len(item))
                    if run_ >= least or part >= share:
                        rows.append((g["doc"].iloc[i], g["item"].iloc[i], run_, int(scores[i]), part))
            yield pd.DataFrame(rows, columns=["doc", "item", "words", "score", "share"])

    return run


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least: int = LEAST, share: float = 0.5, rare: float = 0.001, rare_least: int = 20, longest_text: int = 20_000) -> DataFrame:
    """(doc_id, item_id, words, score, share): documents with a passage of an item, exact or edited.

    words: the longest run of consecutive words of the item; score: of the local alignment; share: of
    the score of a whole copy. A pair comes out with ``least`` equal words in a row or this ``share`` of
    the score. rare, rare_least: n-grams in no more than this share of the corpus, or so many
    documents, are all seeds, others only where a window has no rarer one. Documents are read whole and once; a document is looked through in stretches
    of at most longest_text tokens around matches, overlapping by more than an item. Words are compared
    by 64-bit numbers.

    Null, empty and blank texts have no passages, items of fewer than ``least`` words no seeds of
    windows; rows with a null id are left out, rows of one id count as one document or item; other
    columns are ignored; empty tables give no rows.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    items = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text")).where("item is not null")
    items = materialize(items.mapInPandas(_items, "iid long, item long, length int, tok binary, word binary, grams array<long>")).where(F.size("grams") > 0)
    of_items = items.select("iid", F.posexplode("grams").alias("pos", "gram"))
    pad = items.agg(F.max("length")).first()[0] or 0
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(of_items.select("gram")))
    found = materialize(docs.mapInPandas(_stretches(shared, pad, longest_text), "sid long, doc long, grams array<long>, places array<int>, tokens binary"))
    total = docs.count()
    counts = found.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    per = of_items.join(counts, "gram", "left").groupBy("iid").agg(F.collect_list(F.struct("pos", "gram", F.coalesce("n", F.lit(0)).alias("n"))).alias("found"))
    seeds = items.select("iid", "word").join(per, "iid").mapInPandas(_seeds(least, max(rare_least, rare * total)), "iid long, gram long, pos int")
    seeds = broadcast_if_small(materialize(seeds))
    hits = found.select("sid", F.explode(F.arrays_zip("grams", "places")).alias("h")).select("sid", F.col("h.grams").alias("gram"), F.col("h.places").alias("place"))
    near = hits.join(seeds, "gram").groupBy("sid", "iid").agg(F.collect_list(F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))).alias("anchors"))
    pairs = near.join(found.select("sid", "doc", "tokens"), "sid").join(items.select("iid", "item", "tok", "word"), "iid")
    # few bytes but much work: as many tasks as the session shuffles into, an item of many pairs in several
    pairs = pairs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "iid", F.pmod("sid", F.lit(64)))
    got = pairs.mapInPandas(_align(least, share), "doc long, item long, words int, score int, share double")
    got = got.groupBy("doc", "item").agg(*[F.max(c).alias(c) for c in ("words", "score", "share")])
    return got.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "words", "score", "share")
