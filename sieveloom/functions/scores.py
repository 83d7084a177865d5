"""Scores, bins, labels and prompts as columns."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveloom.functions.parse import col

#: Fit of defect subtypes and background types; fixed values.
BACKGROUNDS = ["smooth", "directional", "periodic", "organic", "complex"]
MATCHING = {
    "linear_scratch": [0.5, 1.0, 0.7, 0.3, 0.3],
    "elongated": [0.6, 0.9, 0.7, 0.4, 0.4],
    "compact_blob": [0.9, 0.4, 0.7, 0.6, 0.5],
    "irregular": [0.5, 0.4, 0.5, 0.8, 0.9],
    "general": [0.7, 0.7, 0.7, 0.7, 0.7],
}
#: Words for the three bins of each context feature; fixed values.
CONTEXT_FEATURES = ["local_variance", "edge_density", "texture_entropy", "frequency_energy", "orientation_consistency"]
CONTEXT_WORDS = [
    ["uniform", "varied", "highly varied"],
    ["smooth", "moderate edge", "sharp edge"],
    ["uniform texture", "mixed texture", "complex texture"],
    ["low frequency", "mid frequency", "high frequency"],
    ["random grain", "semi-directional", "directional"],
]


def lit(v: float) -> Column:
    return F.lit(float(v))


def clamp01(c: Column | str) -> Column:
    """To the unit interval; null, NaN and infinities count as 0."""
    c = col(c)
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == lit("inf"))
    return F.when(bad, lit(0)).otherwise(F.greatest(lit(0), F.least(lit(1), c)))


def minmax_scalar(c: Column | str, low: float, high: float) -> Column:
    """Share of the span, clamped; a span of zero gives 0."""
    return clamp01((col(c) - lit(low)) / lit(high - low)) if high > low else lit(0)


def logistic_z(c: Column | str, mean: Column, std: Column) -> Column:
    """z-score through the logistic function; a vanishing spread gives 0.5's z of 0."""
    z = F.when(std < 1e-9, lit(0)).otherwise((col(c) - mean) / std)
    return clamp01(lit(1) / (lit(1) + F.exp(-z)))


def subtype(lin: Column, sol: Column, ar: Column, sol_cuts: tuple, ar_cuts: tuple, lin_cuts: tuple = (0.6, 0.85)) -> Column:
    """Ordered shape classes; any missing measure gives general."""
    missing = lin.isNull() | sol.isNull() | ar.isNull()
    c = [x if isinstance(x, Column) else lit(x) for x in (*sol_cuts, *ar_cuts, *lin_cuts)]
    s0, s1, a0, a1, l0, l1 = c
    return F.when(missing, "general").when((lin > l1) & (ar > a1), "linear_scratch").when((ar > a1) & (lin > l0), "elongated").when((ar < a0) & (sol > s1), "compact_blob").when(sol < s0, "irregular").otherwise("general")


def subtype_fixed(lin: Column, sol: Column, ar: Column) -> Column:
    return subtype(lin, sol, ar, (0.7, 0.9), (2.0, 5.0))


def cluster_label(lin: Column, sol: Column, ar: Column) -> Column:
    return F.when((lin > 0.7) & (ar > 5), "linear_scratch").when(ar > 4, "elongated").when((ar < 2) & (sol > 0.85), "compact_blob").when(sol < 0.65, "irregular").otherwise("general")


def match_score(kind: Column, background: Column) -> Column:
    """The fit of the table; an unknown subtype counts as general, an unknown background as 0.5."""
    out = lit(0.5)
    for j, b in enumerate(BACKGROUNDS):
        row = lit(MATCHING["general"][j])
        for k, v in MATCHING.items():
            row = F.when(kind == k, lit(v[j])).otherwise(row)
        out = F.when(background == b, row).otherwise(out)
    return out


def suitability(match: Column, continuity: Column, stability: Column, gram: Column) -> Column:
    return clamp01(lit(0.4) * match + lit(0.3) * continuity + lit(0.2) * stability + lit(0.1) * gram)


def suitability_batch(kind: Column, background: Column, continuity: Column, stability: Column) -> Column:
    """The batch variant: a score of 0 or none counts as 0.5, an unknown background as smooth, no texture term."""
    filled = lambda c: F.when(c.isNull() | (c == 0), lit(0.5)).otherwise(c)
    known = F.when(background.isin(BACKGROUNDS), background).otherwise("smooth")
    return suitability(match_score(kind, known), filled(continuity), filled(stability), lit(0))


def roi_score(morph: Column, ctx: Column, third: Column, weights: Sequence[float] = (0.4, 0.4, 0.2)) -> Column:
    """Weighted sum of clamped inputs: deficit as the third (legacy) or quality (realism, 0.3, 0.5, 0.2)."""
    return lit(weights[0]) * clamp01(morph) + lit(weights[1]) * clamp01(ctx) + lit(weights[2]) * clamp01(third)


def moderated_score(morph: Column, ctx: Column, deficit: Column, temperature: float) -> Column:
    """roi_score with the deficit raised to a temperature; 1 leaves it."""
    d = clamp01(deficit)
    return roi_score(morph, ctx, d if temperature == 1 else F.pow(d, lit(temperature)))


def compat_score(ctx: Column, morph: Column) -> Column:
    return lit(0.6) * ctx + lit(0.4) * morph


def quality_gate_value(c: Column | str) -> Column:
    """Missing passes as 1, NaN fails as 0."""
    c = col(c)
    return F.when(c.isNull(), lit(1)).when(F.isnan(c), lit(0)).otherwise(c)


def quality_mix(artifact: Column, blur: Column, w_artifact: float = 0.5, w_blur: float = 0.5) -> Column:
    if abs(w_artifact + w_blur - 1) > 1e-6:
        raise ValueError("the weights must add up to 1")
    return F.round(lit(w_artifact) * artifact + lit(w_blur) * blur, 4)


def bin3(v: Column, e0: Column, e1: Column) -> Column:
    """0, 1 or 2 by two edges; equal or reversed edges give 0, NaN gives 2."""
    return F.when(e1 <= e0, 0).otherwise((v >= e0).cast("int") + (v >= e1).cast("int"))


def bin_count(v: Column, edges: Sequence[Column]) -> Column:
    """Edges not above the value, counted from the lowest on while they hold; NaN gives 0."""
    out, still = F.lit(0), F.lit(True)
    for e in edges:
        still = still & (v >= e) & ~F.isnan(v)
        out = out + F.when(still, 1).otherwise(0)
    return out


def cell_key(values: Sequence[Column], edges: Sequence[tuple[Column, Column]]) -> Column:
    """The bins of all features joined by ``_``; missing values count as 0."""
    return F.concat_ws("_", *[bin3(F.coalesce(v, lit(0)), a, b).cast("string") for v, (a, b) in zip(values, edges)])


def cell_bins(c: Column | str, size: int = 5) -> Column:
    """Bins of a cell key; a part that is no number makes all 0, a wrong length is padded with 1 or cut."""
    p = F.transform(F.split(col(c), "_"), lambda x: x.try_cast("int"))
    bad = F.exists(p, lambda x: x.isNull())
    padded = F.slice(F.concat(p, F.array_repeat(F.lit(1), size)), 1, size)
    return F.when(bad, F.array_repeat(F.lit(0), size)).otherwise(padded)


def background_type(variance: Column, edge: Column, texture: Column, orient: Column) -> Column:
    return F.when(orient == 2, "directional").when((texture == 2) | (variance == 2), "complex_pattern").when((edge == 0) & (variance == 0), "smooth").otherwise("complex_pattern")


def morphology_words(lin: Column, sol: Column, ar: Column) -> Column:
    a = F.when(ar > 3.0, "highly elongated").when(ar > 1.5, "elongated").otherwise("compact")
    b = F.when(lin > 0.65, "linear").when(lin > 0.30, "irregular").otherwise("scattered")
    s = F.when(sol > 0.80, "solid").when(sol > 0.50, "semi-solid").otherwise("fragmented")
    return F.concat(a, F.lit(" "), b, F.lit(" defect with "), s, F.lit(" boundary"))


def context_words(c: Column | str) -> Column:
    """Words of the two highest bins, the earlier feature first on ties."""
    bins = cell_bins(c)
    words = F.array(*[F.array(*[F.lit(w) for w in ws]) for ws in CONTEXT_WORDS])
    ranked = F.array_sort(F.transform(bins, lambda b, i: F.struct((-b).alias("n"), i.alias("i"))))
    word = lambda k: F.element_at(F.element_at(words, ranked[k]["i"] + 1), F.greatest(F.lit(1), F.least(F.lit(3), 1 - ranked[k]["n"])))
    return F.concat(word(0), F.lit(" "), word(1), F.lit(" surface background"))


def prior_words(p: Column) -> Column:
    how = F.when(p >= 0.40, "predominantly occurring").when(p >= 0.20, "commonly found").otherwise("rarely observed")
    return F.concat(how, F.lit(" on this surface type"))


def content_seed(key: Column) -> Column:
    """The first 60 bits of the SHA-1 of a key."""
    return F.conv(F.substring(F.sha1(key), 1, 15), 16, 10).cast("long")


def unit_hash(key: Column) -> Column:
    """A number in [0, 1) from the MD5 of a key, the same in any engine."""
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") / lit(2**48)


def jitter(path: Column, box: Column, cell: Column) -> Column:
    """Tie-break below 1e-7 from the 64-bit BLAKE2b of the three, which Spark has no function for."""

    @F.pandas_udf("double")
    def run(k: pd.Series) -> pd.Series:
        return k.map(lambda s: int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big") / 2**64 * 1e-7)

    return run(F.concat(F.coalesce(path, F.lit("")), F.lit("\x1f"), F.coalesce(box, F.lit("")), F.lit("\x1f"), F.coalesce(cell, F.lit(""))))


def type_from_seed(seed: Column | str) -> Column:
    """What stands before the last ``_number``, else the whole."""
    m = F.regexp_extract(col(seed), "^(.+)_[0-9]+$", 1)
    return F.when(m != "", m).otherwise(col(seed))


def class_number(c: Column | str) -> Column:
    """N of ``classN``, else 1."""
    return F.coalesce(F.regexp_extract(F.lower(col(c)), "^class\\s*([0-9]{1,9})\\s*$", 1).try_cast("int"), F.lit(1))


def tile_group(stem: Column | str) -> Column:
    return F.substring_index(col(stem), "__tile_", 1)


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(F.substring_index(F.regexp_replace(col(path), "\\\\", "/"), "/", -1), "\\.[A-Za-z0-9]+$", "")
