"""Languages of documents and of the passages in them, by nearest centroid.

Sentences become TF-IDF vectors of character n-grams. Each language has several centroids, found by
spherical k-means over its sample sentences; a sentence takes the language of the nearest centroid by
cosine and is rejected when even that is too far: nearer to what sentences of other languages reach than
to what held-out sentences of its own do. Passages are runs of sentences of one language.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveloom.llm.words import INVISIBLE

BITS = 16
ORDERS = (1, 2, 3, 4)
#: Exponent with which cosines are compared: the share of the nearest language is the confidence.
SHARPNESS = 10.0
#: Where between foreign sentences (0) and held-out sentences of a language (1) its bound of rejection lies, in logarithms.
LEAN = 0.37
#: A sentence in a script of which the samples have next to nothing is rejected whatever its cosine.
FAMILIAR = 0.2

#: Names of the languages in other notations; fixed values.
NOTATIONS = {
    "en": ["eng", "english"],
    "ko": ["kor", "korean", "한국어"],
    "de": ["deu", "ger", "german", "deutsch"],
    "fr": ["fra", "fre", "french", "français", "francais"],
    "es": ["spa", "spanish", "español", "espanol", "castilian"],
    "pt": ["por", "portuguese", "português", "portugues"],
    "it": ["ita", "italian", "italiano"],
    "nl": ["nld", "dut", "dutch", "nederlands"],
    "ja": ["jpn", "japanese", "日本語"],
    "zh": ["zho", "chi", "cmn", "chinese", "mandarin", "中文"],
}

#: Ends of sentences: a mark between a letter and a capital or digit, a mark before white space or the end, a wide mark anywhere, an empty line,
#: or a line that begins like an entry of a list, log or table; other line breaks may fall within a sentence.
#: Runs are taken whole and from their start only, here and below, so that no text costs more than its length.
END = re.compile(
    "(?<=[^\\W\\d_])[.!?…]++(?=[A-ZÀ-Þ0-9])"
    "|(?<![.!?…])[.!?…]++[\"'»”’)\\]*_]*+(?=\\s|$|[\\u2e80-\\ud7ff])"
    "|(?:[。！？]|．(?!\\d))++[」』”）)]*+"
    "|(?<![\\r\\u2028\\u2029\\x0b\\x0c])(?:[\\r\\u2028\\u2029\\x0b\\x0c]*+\\n[ \\t]*+){2,}"
    "|(?<![\\r\\n\\u2028\\u2029\\x0b\\x0c])[\\r\\n\\u2028\\u2029\\x0b\\x0c]++[ \\t]*+(?=[-*+•#|{\\[$`\"«“]|\\d+[.)]\\s)"
)
_FIRST = r"(?<![^\s`$>}])"  # at the start of a token, or after one of the spans before it in the list
CODE = re.compile(r"`[^`\n]*`|\$\$.*?\$\$|\$[^$\n]*\$|https?://\S+|" + _FIRST + r"@*[^\s@]++@\S+|</?[a-zA-Z][^<>]*>|<[|/]?\w+[|]?>|\{[^{}\n]*\}|" + _FIRST + r"[^\s/\\_=<>{}#]*+[/\\_=<>{}#]\S*")
NOT_WORD = re.compile(r"(?<![A-Za-z])[A-Za-z]++(?:[.,:]*+\d)++[A-Za-z\d]*|(?<![A-Za-z.,:])(?:[.,:]*+\d)++[A-Za-z\d]*")
GLUE = re.compile(r"[^\w'’]+|_+")
WIDE = re.compile("[぀-ヿ㐀-鿿가-힯]")


def label_code(c: Column, langs: Sequence[str] = tuple(NOTATIONS)) -> Column:
    """The code out of ``langs`` a label names, region and script aside; null when it names none of them.

    A language without an entry in NOTATIONS is known by its code alone."""
    s = F.element_at(F.split(F.lower(F.trim(c)), "[-_ (]"), 1)
    out = F.lit(None).cast("string")
    for code in langs:
        out = F.when(s.isin(code.lower(), *NOTATIONS.get(code, [])), code).otherwise(out)
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in END.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def letters_only(s: str) -> str:
    """What tells the language: words without digits, markup, code and marks, in folded case."""
    if not s.isascii():
        s = unicodedata.normalize("NFKC", INVISIBLE.sub("", s))
    s = CODE.sub(" ", s)
    return GLUE.sub(" ", NOT_WORD.sub(" ", s).casefold()).strip()


def unaccented(s: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if not "\u0300" <= c <= "\u036f"))


def is_sentence(s: str) -> bool:
    """Single terms, names and codes are no sentence: at least four words, or eight wide characters."""
    wide = len(WIDE.findall(s))
    if wide * 2 > len(s.replace(" ", "")):
        return wide >= 8
    return len(s.split()) >= 4 and sum(map(str.isalpha, s)) >= 15


#: A whole sentence ends with a mark, whatever closes, tags or emphasises after it.
MARK = re.compile(r"</?[|]?[a-zA-Z][^<>]*>|<[|/]?\w+[|]?>")
MARKS = frozenset(".!?。！？．…")


def is_whole(s: str) -> bool:
    for c in reversed(s):
        if c in MARKS or c.isalnum():
            return c in MARKS
    return False


def candidates(text: str) -> list[tuple[tuple[int, int], str]]:
    """Place and letters of each whole sentence of a text."""
    out = []
    for a, b in sentences(text):
        if is_whole(MARK.sub(" ", text[a:b])) and is_sentence(c := letters_only(text[a:b])):
            out.append(((a, b), c))
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashed n-gram, count), sorted by text."""
    framed = [f" {t} " for t in texts]
    code = np.frombuffer("".join(framed).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sid = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in framed])
    keys = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(code) < n:
                continue
            h = np.full(len(code) - n + 1, n, dtype=np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + code[j : len(code) - n + 1 + j]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h = (h >> np.uint64(64 - BITS)).astype(np.int64)
            inside = sid[: len(h)] == sid[n - 1 :]
            keys.append((sid[: len(h)][inside] << BITS) | h[inside])
    key, count = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return key >> BITS, key & ((1 << BITS) - 1), count


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # hashed n-grams by centroids
    lang_of: np.ndarray
    nearest: np.ndarray  # least cosine accepted for each language
    seen: np.ndarray  # whether a character occurs in the samples

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sid, h, n = grams(texts)
        w = (1 + np.log(n)) * self.idf[h]
        norm = np.sqrt(np.bincount(sid, w * w, minlength=len(texts)))
        return sid, h, (w / np.maximum(norm[sid], 1e-12)).astype(np.float32)

    def familiar(self, texts: list[str]) -> np.ndarray:
        """Share of each text's letters that occur in the samples."""
        code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        sid = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        letter = code != 32
        n = np.bincount(sid[letter], minlength=len(texts))
        return np.bincount(sid[letter], self.seen[code[letter]], minlength=len(texts)) / np.maximum(n, 1)

    def cosines(self, texts: list[str], most: int = 256, letters: int = 40_000) -> np.ndarray:
        """The nearest centroid's cosine of every language, texts by languages: products of the texts of a step
        with the rows of all centroids for the n-grams that occur in it. Texts alike should follow each other."""
        cuts, size = [0], 0
        for i, t in enumerate(texts):
            if i > cuts[-1] and (i - cuts[-1] >= most or size + len(t) > letters):
                cuts.append(i)
                size = 0
            size += len(t)
        first = np.flatnonzero(np.r_[True, self.lang_of[1:] != self.lang_of[:-1]])  # centroids are sorted by language
        out = [np.zeros((0, len(self.langs)), dtype=np.float32)]
        for i, j in zip(cuts, [*cuts[1:], len(texts)]):
            if i == j:
                continue
            sid, h, w = self.vectors(texts[i:j])
            used, at = np.unique(h, return_inverse=True)
            x = np.zeros((j - i, len(used)), dtype=np.float32)
            x[sid, at] = w
            out.append(np.maximum.reduceat(x @ self.centroids[used], first, axis=1))
        return np.concatenate(out)

    def classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language number (-1: rejected) and confidence of each text; all centroids are compared."""
        order = np.array(sorted(range(len(texts)), key=texts.__getitem__), dtype=int)
        per = np.empty((len(texts), len(self.langs)), dtype=np.float32)
        per[order] = self.cosines([texts[i] for i in order])
        best = per.argmax(axis=1) if len(per) else np.zeros(0, int)
        own = np.take_along_axis(per, best[:, None], axis=1)
        conf = 1 / ((np.maximum(per, 0) / np.maximum(own, 1e-9)) ** SHARPNESS).sum(axis=1).clip(1e-9)
        ok = (own[:, 0] >= self.nearest[best]) & (self.familiar(texts) >= FAMILIAR)
        return np.where(ok, best, -1), np.where(ok, np.minimum(conf, 1.0), 0.0)


Pairs = list[tuple[str, str]]


def pairs_of(samples: Pairs) -> Pairs:
    """(language, letters) of the sample sentences; texts also come without their accents."""
    found = {(lang, s) for lang, text in samples if lang and text for _, s in candidates(text)}
    return sorted(found | {(lang, unaccented(s)) for lang, s in found})


def centroids(pairs: Pairs, clusters: int, rounds: int, seed: int) -> Model:
    langs = sorted({lang for lang, _ in pairs})
    sid, h, _ = grams([s for _, s in pairs])
    df = np.bincount(h, minlength=1 << BITS)
    model = Model(langs, np.log((1 + len(pairs)) / (1 + df)) + 0.1, np.zeros((1 << BITS, 0), np.float32), np.zeros(0, int), np.zeros(0), np.zeros(0x110000, bool))
    model.seen[[ord(c) for c in {c for _, s in pairs for c in s}]] = True
    rng = np.random.default_rng(seed)
    cents, owner = [], []
    for k, lang in enumerate(langs):
        texts = [s for x, s in pairs if x == lang]
        sid, h, w = model.vectors(texts)
        used, at = np.unique(h, return_inverse=True)
        x = np.zeros((len(texts), len(used)), dtype=np.float32)
        x[sid, at] = w
        pick = [int(rng.integers(len(texts)))]
        while len(pick) < min(clusters, len(texts)):  # each next start is the one farthest from the others
            pick.append(int((x @ x[pick].T).max(axis=1).argmin()))
        c = x[pick]
        for _ in range(rounds):
            a = (x @ c.T).argmax(axis=1)
            c = np.stack([x[a == j].sum(axis=0) if (a == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        wide = np.zeros((len(c), 1 << BITS), dtype=np.float32)
        wide[:, used] = c
        cents.append(wide)
        owner += [k] * len(c)
    model.centroids = np.ascontiguousarray(np.concatenate(cents).T)
    model.lang_of, model.nearest = np.array(owner), np.zeros(len(langs))
    return model


def fit(samples: Pairs, *, clusters: int = 12, rounds: int = 12, seed: int = 2, lean: float = LEAN, folds: int = 3) -> Model:
    """Centroids from (language, text) pairs, whose number is bounded by the caller, and bounds of rejection.

    A language's bound lies between two cosines, ``lean`` of the way in logarithms from the first to the
    second: what sentences of another language reach with its centroids (their median, and of these the
    median over the other languages), and what its own sentences reach when held out of the fit (their
    first percentile over the folds)."""
    pairs = pairs_of(samples)
    if not pairs:
        raise ValueError("no sample sentence")
    model = centroids(pairs, clusters, rounds, seed)
    number = {x: k for k, x in enumerate(model.langs)}
    lang = np.array([number[x] for x, _ in pairs])
    across = model.cosines([s for _, s in pairs])
    held = np.full(len(pairs), np.nan)
    fold = np.array([zlib.crc32(unaccented(s).encode()) % folds for _, s in pairs])  # both forms of a sentence in one
    for f in range(folds):
        rest = [p for p, x in zip(pairs, fold) if x != f]
        if {x for x, _ in rest} == set(model.langs) and (fold == f).any():
            mine = np.flatnonzero(fold == f)
            part = centroids(rest, clusters, rounds, seed).cosines([pairs[i][1] for i in mine])
            held[mine] = part[np.arange(len(mine)), lang[mine]]
    for k in range(len(model.langs)):
        own, others = held[(lang == k) & ~np.isnan(held)], [np.median(across[lang == j, k]) for j in range(len(model.langs)) if j != k]
        if len(own) and others:
            low, high = max(float(np.median(others)), 1e-3), max(float(np.quantile(own, 0.01)), 1e-3)
            model.nearest[k] = min(high, low ** (1 - lean) * high**lean)
    return model


#: A sentence that stands out against its document must be this sure; a less sure one goes with the document.
SURE = 0.6
RESULT = "doc long, label string, lang string, confidence double, langs array<string>, passages array<struct<start:int,end:int,lang:string,confidence:double,sentences:int>>"


def document(text: str, spans: list[tuple[int, int]], lang: np.ndarray, conf: np.ndarray, size: np.ndarray, model: Model) -> tuple:
    """Language, confidence, languages and passages of one document from its sentences."""
    votes: dict[int, float] = {}
    for k, c, n in zip(lang.tolist(), conf.tolist(), size.tolist()):
        if k >= 0:
            votes[k] = votes.get(k, 0.0) + c * n
    if not votes:
        return None, 0.0, [], []
    main = max(votes, key=lambda k: (votes[k], -k))
    passages: list[list] = []
    for (a, b), k, c in zip(spans, lang.tolist(), conf.tolist()):
        if k < 0:
            continue
        if k != main and c < SURE:
            k, c = main, 1 - c
        if passages and passages[-1][2] == k:
            p = passages[-1]
            p[1], p[3], p[4] = b, p[3] + c, p[4] + 1
        else:
            passages.append([a, b, k, c, 1])
    out = [{"start": a, "end": b, "lang": model.langs[k], "confidence": c / n, "sentences": n} for a, b, k, c, n in passages]
    sure = sum(p[3] for p in passages if p[2] == main) / sum(p[4] for p in passages if p[2] == main)
    return model.langs[main], sure, sorted({p["lang"] for p in out}), out


def known(samples: DataFrame, most: int = 1_000) -> list[str]:
    """The languages of the samples, at most ``most`` of them (checked)."""
    rows = samples.select("lang").where("lang is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} languages")
    return sorted(r["lang"] for r in rows)


def detect(docs: DataFrame, samples: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "lang", max_samples: int = 20_000) -> DataFrame:
    """(doc_id, label, lang, confidence, langs, passages): one row a document.

    The classifier is fitted on samples (lang, text), of which at most max_samples rows are taken, and
    broadcast (2^16 n-grams by twelve centroids a language). Documents are read whole. Null, empty and
    blank texts and texts without a sentence have a null language, confidence 0 and empty lists; rows
    with a null id stay; other columns are ignored.
    """
    rows = samples.select("lang", "text").orderBy("lang", "text").limit(max_samples).collect()
    shared = docs.sparkSession.sparkContext.broadcast(fit([(r["lang"], r["text"]) for r in rows]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.iloc[at : at + 1000]
                spans, texts, first = [], [], [0]
                for t in b["text"]:
                    for s, c in candidates(t) if t else []:
                        spans.append(s)
                        texts.append(c)
                    first.append(len(spans))
                distinct = {c: i for i, c in enumerate(dict.fromkeys(texts))}  # boilerplate is classified once
                which = np.array([distinct[c] for c in texts], dtype=int)
                lang, conf = (x[which] for x in model.classify(list(distinct)))
                size = np.array([len(t) for t in texts])
                out = [document(t, spans[i:j], lang[i:j], conf[i:j], size[i:j], model) for t, i, j in zip(b["text"], first, first[1:])]
                yield pd.DataFrame([(d, x, *r) for d, x, r in zip(b["doc"], b["label"], out)], columns=["doc", "label", "lang", "confidence", "langs", "passages"])

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(label).alias("label"), F.col(text).alias("text")).mapInPandas(run, RESULT).withColumnRenamed("doc", doc_id)
