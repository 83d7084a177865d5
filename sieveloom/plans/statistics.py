"""Aggregations over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveloom.functions import scores as S
from sieveloom.operators import ordered as O
from sieveloom.operators import stats as A
from sieveloom.plans.base import CONTEXT, CTE, MORPH, cand, morph, op, patch
from sieveloom.plans.scalar import _BOX, boxed, keep_or_all
from sieveloom.runtime import materialize, read

_EDGE = ", ".join(f"CASE WHEN count({f}) < 3 THEN {i} ELSE round(quantile_cont({f}, {p}), 9) END AS e_{f}_{i}" for f in CONTEXT for i, p in enumerate((0.3333, 0.6667)))
CTE["edges"] = f"SELECT {_EDGE} FROM patch"


def _key(coalesced: bool = True) -> str:
    v = lambda f: f"coalesce({f}, 0)" if coalesced else f
    return "concat_ws('_', " + ", ".join(f"CASE WHEN e_{f}_1 <= e_{f}_0 THEN 0 ELSE CAST({v(f)} >= e_{f}_0 AS INT) + CAST({v(f)} >= e_{f}_1 AS INT) END" for f in CONTEXT) + ")"


CTE["celled"] = f"SELECT image_id, patch_xy, kind, local_variance, edge_density, {_key()} AS cell_key FROM patch, edges"
_MEAN = ", ".join(f"round(avg({f}), 9) AS {f}" for f in CONTEXT)
CTE["means"] = f"SELECT * FROM (SELECT image_id, {_MEAN} FROM patch WHERE kind = 'defect' GROUP BY image_id) WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in CONTEXT)
# images fall into equal-frequency clusters by their mean variance: the assignment of the profiling step
CTE["cuts"] = "SELECT round(quantile_cont(local_variance, 0.3333), 9) AS c0, round(quantile_cont(local_variance, 0.6667), 9) AS c1 FROM means"
CTE["assign"] = "SELECT image_id, CAST(local_variance >= c0 AS INT) + CAST(local_variance >= c1 AS INT) AS cluster_id FROM means, cuts"
CTE["pairs"] = f"SELECT cluster_id, cell_key, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY cluster_id) AS p FROM (SELECT image_id, {_key(False)} AS cell_key FROM means, edges) JOIN assign USING (image_id) GROUP BY cluster_id, cell_key"
CTE["globe"] = f"SELECT cell_key, count(*) / sum(count(*)) OVER () AS p FROM (SELECT image_id, {_key(False)} AS cell_key FROM means, edges) GROUP BY cell_key"
CTE["clean"] = "SELECT cell_key, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM celled WHERE kind = 'good' GROUP BY cell_key"
CTE["defpatch"] = "SELECT cluster_id, cell_key, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY cluster_id) AS p FROM celled JOIN assign USING (image_id) WHERE kind = 'defect' GROUP BY cluster_id, cell_key"
CTE["symm"] = "SELECT cluster_id, cell_key, raw / max(raw) OVER (PARTITION BY cluster_id) AS sym FROM (SELECT d.cluster_id, d.cell_key, sqrt((d.p + 0.001::DOUBLE) * (coalesce(c.p, 0) + 0.001::DOUBLE)) AS raw FROM defpatch d LEFT JOIN clean c USING (cell_key))"
_BASE = "patch edges celled means cuts assign"


def patches(s, d):
    """The patches, parsed and deduplicated once for all that a query makes of them."""
    return materialize(patch(s, d))


def edges(s, d, p=None):
    return A.bin_edges(p if p is not None else patch(s, d), CONTEXT)


def celled(s, d, p=None):
    p = p if p is not None else patches(s, d)
    return A.with_cells(p, edges(s, d, p), CONTEXT)


def means(s, d, p=None):
    return A.image_means((p if p is not None else patch(s, d)).where("kind = 'defect'"), CONTEXT)


def assign(s, d, p=None):
    m = materialize(means(s, d, p))
    cut = m.agg(F.percentile("local_variance", F.array(F.lit(0.3333), F.lit(0.6667))).alias("c"))
    m = m.crossJoin(F.broadcast(cut))
    at = lambda i: (F.col("local_variance") >= F.round(F.element_at("c", i), 9)).cast("int")
    return m.select("image_id", (at(1) + at(2)).alias("cluster_id"))


def mean_cells(s, d, p=None):
    p = p if p is not None else patches(s, d)
    return materialize(A.with_cells(means(s, d, p), edges(s, d, p), CONTEXT).join(assign(s, d, p), "image_id"))


def pairs(s, d):
    return A.share(mean_cells(s, d), ["cluster_id", "cell_key"], ["cluster_id"])


def clean(s, d, p=None):
    return A.share(celled(s, d, p).where("kind = 'good'"), ["cell_key"])


def defect_patches(s, d, p=None):
    p = p if p is not None else patches(s, d)
    return A.share(celled(s, d, p).where("kind = 'defect'").join(assign(s, d, p), "image_id"), ["cluster_id", "cell_key"], ["cluster_id"])


def symmetric(s, d):
    p = patches(s, d)
    return A.symmetric(defect_patches(s, d, p), clean(s, d, p))


@op("agg_bin_edges", "patch edges", "SELECT " + ", ".join(f"round(e_{f}_{i}, 6) AS e_{f}_{i}" for f in CONTEXT for i in (0, 1)) + " FROM edges")
def _(s, d):
    return edges(s, d).select(*[F.round(f"e_{f}_{i}", 6).alias(f"e_{f}_{i}") for f in CONTEXT for i in (0, 1)])


@op("agg_tertiles", "morph", "SELECT " + ", ".join(f"CASE WHEN sd = 0 OR ({f}66 - {f}33) / sd{f} < 0.15 THEN {fb[0]} ELSE round({f}33, 6) END AS {f}_low, CASE WHEN sd{f} = 0 OR ({f}66 - {f}33) / sd{f} < 0.15 THEN {fb[1]} ELSE round({f}66, 6) END AS {f}_high".replace("sd = 0", f"sd{f} = 0") for f, fb in (("aspect_ratio", (2.0, 5.0)), ("solidity", (0.7, 0.9)))) + " FROM (SELECT " + ", ".join(f"quantile_cont({f}, 0.33) AS {f}33, quantile_cont({f}, 0.66) AS {f}66, stddev_pop({f}) AS sd{f}" for f in ("aspect_ratio", "solidity")) + " FROM morph)")
def _(s, d):
    return tertiles(morph(s, d)).select(*[F.round(c, 6).alias(c) for c in ("aspect_ratio_low", "aspect_ratio_high", "solidity_low", "solidity_high")])


def tertiles(m):
    """P33 and P66 of aspect ratio and solidity; a middle tertile narrower than 0.15 spreads falls back to the fixed cuts."""
    out = []
    for f, fixed in (("aspect_ratio", (2.0, 5.0)), ("solidity", (0.7, 0.9))):
        q = F.percentile(f, F.array(F.lit(0.33), F.lit(0.66)))
        lo, hi, sd = F.element_at(q, 1), F.element_at(q, 2), F.stddev_pop(f)
        flat = (sd == 0) | ((hi - lo) / sd < 0.15)
        out += [F.when(flat, S.lit(fixed[0])).otherwise(lo).alias(f"{f}_low"), F.when(flat, S.lit(fixed[1])).otherwise(hi).alias(f"{f}_high")]
    return m.agg(*out)


@op("prj_subtype_pct", "morph", "SELECT morph_id, CASE WHEN linearity IS NULL OR solidity IS NULL OR aspect_ratio IS NULL THEN 'general' WHEN linearity > 0.85 AND aspect_ratio > a1 THEN 'linear_scratch' WHEN aspect_ratio > a1 AND linearity > 0.6 THEN 'elongated' WHEN aspect_ratio < a0 AND solidity > s1 THEN 'compact_blob' WHEN solidity < s0 THEN 'irregular' ELSE 'general' END AS subtype FROM morph, (SELECT CASE WHEN (quantile_cont(aspect_ratio, 0.66) - quantile_cont(aspect_ratio, 0.33)) / stddev_pop(aspect_ratio) < 0.15 THEN 2.0 ELSE quantile_cont(aspect_ratio, 0.33) END AS a0, CASE WHEN (quantile_cont(aspect_ratio, 0.66) - quantile_cont(aspect_ratio, 0.33)) / stddev_pop(aspect_ratio) < 0.15 THEN 5.0 ELSE quantile_cont(aspect_ratio, 0.66) END AS a1, CASE WHEN (quantile_cont(solidity, 0.66) - quantile_cont(solidity, 0.33)) / stddev_pop(solidity) < 0.15 THEN 0.7 ELSE quantile_cont(solidity, 0.33) END AS s0, CASE WHEN (quantile_cont(solidity, 0.66) - quantile_cont(solidity, 0.33)) / stddev_pop(solidity) < 0.15 THEN 0.9 ELSE quantile_cont(solidity, 0.66) END AS s1 FROM morph)")
def _(s, d):
    m = morph(s, d)
    j = m.crossJoin(F.broadcast(tertiles(m)))
    c = F.col
    return j.select("morph_id", S.subtype(c("linearity"), c("solidity"), c("aspect_ratio"), (c("solidity_low"), c("solidity_high")), (c("aspect_ratio_low"), c("aspect_ratio_high"))).alias("subtype"))


_P = [0.1, 0.25, 0.5, 0.75, 0.9]


@op("agg_profile_pcts", "morph", "SELECT defect_type, " + ", ".join(f"round(quantile_cont(solidity, {p}), 6) AS p{i}" for i, p in enumerate(_P)) + " FROM morph WHERE solidity IS NOT NULL GROUP BY defect_type")
def _(s, d):
    return O.percentiles(morph(s, d), "solidity", _P, ["defect_type"]).select("defect_type", *[F.round(f"p{i}", 6).alias(f"p{i}") for i in range(5)])


@op("agg_profile_pcts_ranged", "patch", "SELECT CAST(i AS INT) AS i, round(v, 6) AS value FROM (SELECT unnest([0, 1, 2, 3, 4]) AS i, unnest(quantile_cont(local_variance, [0.1, 0.25, 0.5, 0.75, 0.9])) AS v FROM patch)")
def _(s, d):
    return O.percentiles_ranged(patch(s, d), "local_variance", _P).select("i", F.round("value", 6).alias("value"))


@op("agg_image_mean", "patch means", "SELECT image_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in CONTEXT) + " FROM means")
def _(s, d):
    return means(s, d).select("image_id", *[F.round(f, 6).alias(f) for f in CONTEXT])


@op("agg_image_mean_partial", "patch", "SELECT image_id, " + ", ".join(f"round(avg({f}) + 1e-10::DOUBLE, 6) AS {f}" for f in CONTEXT) + " FROM patch GROUP BY image_id")
def _(s, d):
    m = A.image_means(patch(s, d), CONTEXT, complete=False, digits=12)
    return m.select("image_id", *[F.round(F.col(f) + 1e-10, 6).alias(f) for f in CONTEXT])


@op("agg_global_mean", "patch", "SELECT " + ", ".join(f"round(avg({f}), 4) AS {f}" for f in CONTEXT) + " FROM patch")
def _(s, d):
    return patch(s, d).agg(*[F.round(F.avg(f), 4).alias(f) for f in CONTEXT])


@op("agg_compat_matrix", _BASE + " pairs", "SELECT cluster_id, cell_key, n, round(p, 6) AS p FROM pairs")
def _(s, d):
    return pairs(s, d).select("cluster_id", "cell_key", "n", F.round("p", 6).alias("p"))


@op("agg_clean_dist", _BASE + " clean", "SELECT cell_key, n, round(p, 6) AS p FROM clean")
def _(s, d):
    return clean(s, d).select("cell_key", "n", F.round("p", 6).alias("p"))


@op("agg_def_patch", _BASE + " defpatch", "SELECT cluster_id, cell_key, n, round(p, 6) AS p FROM defpatch")
def _(s, d):
    return defect_patches(s, d).select("cluster_id", "cell_key", "n", F.round("p", 6).alias("p"))


@op("agg_symmetric", _BASE + " clean defpatch symm", "SELECT cluster_id, cell_key, round(sym, 6) AS sym FROM symm")
def _(s, d):
    return symmetric(s, d).select("cluster_id", "cell_key", F.round("sym", 6).alias("sym"))


@op("agg_target_dist", _BASE + " clean defpatch symm", "SELECT cluster_id, cell_key, round(sym / sum(sym) OVER (PARTITION BY cluster_id), 6) AS target FROM symm")
def _(s, d):
    sym = symmetric(s, d)
    return sym.select("cluster_id", "cell_key", F.round(F.col("sym") / F.sum("sym").over(Window.partitionBy("cluster_id")), 6).alias("target"))


@op("agg_deficit", _BASE + " pairs globe", "SELECT cluster_id, cell_key, round(deficit, 6) AS deficit, round(CASE WHEN t > 0 THEN deficit / t ELSE 1.0 / k END, 6) AS target FROM (SELECT *, sum(deficit) OVER (PARTITION BY cluster_id) AS t, count(*) OVER (PARTITION BY cluster_id) AS k FROM (SELECT c.cluster_id, g.cell_key, greatest(0, g.p - coalesce(p.p, 0)) AS deficit FROM (SELECT DISTINCT cluster_id FROM assign) c CROSS JOIN globe g LEFT JOIN pairs p ON p.cluster_id = c.cluster_id AND p.cell_key = g.cell_key))")
def _(s, d):
    mc = mean_cells(s, d)
    out = A.deficits(A.share(mc, ["cluster_id", "cell_key"], ["cluster_id"]), A.share(mc, ["cell_key"]), mc)
    return out.select("cluster_id", "cell_key", F.round("deficit", 6).alias("deficit"), F.round("target", 6).alias("target"))


@op("agg_cluster_prior", "cand", "SELECT cluster_id, round(count(*) / (sum(count(*)) OVER () + 1e-10::DOUBLE), 6) AS prior FROM cand WHERE cluster_id IS NOT NULL GROUP BY cluster_id")
def _(s, d):
    return A.share(cand(s, d).where("cluster_id is not null"), ["cluster_id"]).select("cluster_id", F.round("p", 6).alias("prior"))


@op("agg_centroid", "morph", "SELECT defect_type, count(*) AS n, " + ", ".join(f"round(avg({f}) + 1e-10::DOUBLE, 5) AS {f}" for f in MORPH) + " FROM morph GROUP BY defect_type")
def _(s, d):
    return morph(s, d).groupBy("defect_type").agg(F.count("*").alias("n"), *[F.round(F.avg(f) + 1e-10, 5).alias(f) for f in MORPH])


CTE["types"] = "SELECT coalesce(defect_type, 'unknown') AS t, count(*) / sum(count(*)) OVER () AS p FROM morph GROUP BY 1"


@op("agg_label_entropy", "morph types", "SELECT round(-sum(p * log2(p + 1e-12::DOUBLE)), 6) AS entropy FROM types")
def _(s, d):
    return A.entropy(morph(s, d), ["defect_type"]).select(F.round("entropy", 6).alias("entropy"))


@op("agg_neff", "morph types", "SELECT round(exp(-sum(p * ln(p))), 6) AS neff FROM types")
def _(s, d):
    e = A.entropy(morph(s, d), ["defect_type"], base=F.lit("e"))
    return e.select(F.round(F.exp("entropy"), 6).alias("neff"))


@op("agg_normalize_cols", "cand", "SELECT row_id, round(CASE WHEN sd < 1e-9 THEN 0 ELSE (roi_score - m) / sd END, 6) AS z, round(CASE WHEN hi - lo > 0 THEN (roi_score - lo) / (hi - lo) ELSE 0 END, 6) AS minmax FROM cand, (SELECT avg(roi_score) AS m, stddev_pop(roi_score) AS sd, min(roi_score) AS lo, max(roi_score) AS hi FROM cand)")
def _(s, d):
    df = cand(s, d).select("row_id", "roi_score")
    one = df.agg(F.avg("roi_score").alias("m"), F.stddev_pop("roi_score").alias("sd"), F.min("roi_score").alias("lo"), F.max("roi_score").alias("hi"))
    x = df.crossJoin(F.broadcast(one))
    z = F.when(F.col("sd") < 1e-9, S.lit(0)).otherwise((F.col("roi_score") - F.col("m")) / F.col("sd"))
    mm = F.when(F.col("hi") > F.col("lo"), (F.col("roi_score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(S.lit(0))
    return x.select("row_id", F.round(z, 6).alias("z"), F.round(mm, 6).alias("minmax"))


@op("agg_minmax_cluster_in", "morph", "SELECT morph_id, round((linearity - lo) / (hi - lo + 1e-6::DOUBLE), 6) AS v FROM morph, (SELECT min(linearity) AS lo, max(linearity) AS hi FROM morph) WHERE linearity IS NOT NULL")
def _(s, d):
    m = morph(s, d).where("linearity is not null").select("morph_id", "linearity")
    one = m.agg(F.min("linearity").alias("lo"), F.max("linearity").alias("hi"))
    return m.crossJoin(F.broadcast(one)).select("morph_id", F.round((F.col("linearity") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-6), 6).alias("v"))


_QS = "CASE WHEN quality_score IS NULL OR isnan(quality_score) THEN NULL ELSE quality_score END"


@op("agg_quality_stats", "cand", f"SELECT defect_subtype, count(q) AS n, round(avg(q), 4) AS mean, round(stddev_pop(q), 4) AS std, round(min(q), 4) AS min, round(max(q), 4) AS max, round(quantile_cont(q, 0.25), 4) AS p25, round(quantile_cont(q, 0.5), 4) AS p50, round(quantile_cont(q, 0.75), 4) AS p75, round(quantile_cont(q, 0.9), 4) AS p90 FROM (SELECT defect_subtype, {_QS} AS q FROM cand) GROUP BY defect_subtype")
def _(s, d):
    df = cand(s, d).select("defect_subtype", F.when(~F.isnan("quality_score"), F.col("quality_score")).alias("q"))
    p = F.percentile("q", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9)]))
    g = df.groupBy("defect_subtype").agg(F.count("q").alias("n"), F.avg("q").alias("mean"), F.stddev_pop("q").alias("std"), F.min("q").alias("min"), F.max("q").alias("max"), p.alias("p"))
    return g.select("defect_subtype", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")], *[F.round(F.element_at("p", i + 1), 4).alias(n) for i, n in enumerate(("p25", "p50", "p75", "p90"))])


CTE["floors"] = "SELECT round(quantile_cont(local_variance, 0.15), 9) AS fv, round(quantile_cont(edge_density, 0.15), 9) AS fe FROM patch WHERE kind = 'good'"
CTE["voided"] = "SELECT *, coalesce(local_variance, 0) <= fv AND coalesce(edge_density, 0) <= fe AS void FROM celled, floors"


def floors(s, d, p=None):
    q = lambda c: F.round(F.percentile(c, F.lit(0.15)), 9)
    return (p if p is not None else patch(s, d)).where("kind = 'good'").agg(q("local_variance").alias("fv"), q("edge_density").alias("fe"))


def voided(s, d, p=None):
    p = p if p is not None else patches(s, d)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return celled(s, d, p).crossJoin(F.broadcast(floors(s, d, p))).withColumn("void", (z("local_variance") <= F.col("fv")) & (z("edge_density") <= F.col("fe")))


@op("agg_void_floor", "patch floors", "SELECT round(fv, 6) AS fv, round(fe, 6) AS fe FROM floors")
def _(s, d):
    return floors(s, d).select(F.round("fv", 6).alias("fv"), F.round("fe", 6).alias("fe"))


CTE["validbg"] = "SELECT image_id, share FROM (SELECT image_id, avg(CASE WHEN void THEN 1.0::DOUBLE ELSE 0 END) AS share FROM voided WHERE kind = 'good' GROUP BY image_id) WHERE share <= 0.5 OR (SELECT count(*) FROM (SELECT image_id FROM voided WHERE kind = 'good' GROUP BY image_id HAVING avg(CASE WHEN void THEN 1.0::DOUBLE ELSE 0 END) <= 0.5)) = 0"


def valid_backgrounds(s, d):
    v = voided(s, d).where("kind = 'good'").groupBy("image_id").agg(F.avg(F.when(F.col("void"), 1.0).otherwise(0.0)).alias("share"))
    return keep_or_all(v, F.col("share") <= 0.5)


@op("agg_void_frac", "patch edges celled floors voided validbg", "SELECT image_id, round(share, 6) AS share FROM validbg")
def _(s, d):
    return valid_backgrounds(s, d).select("image_id", F.round("share", 6).alias("share"))


CTE["hist"] = "SELECT image_id, cell_key, count(*) / sum(count(*)) OVER (PARTITION BY image_id) AS p FROM voided WHERE NOT void AND kind = 'good' GROUP BY image_id, cell_key"


def image_hist(s, d, kind="good", v=None):
    v = v if v is not None else voided(s, d)
    return A.share(v.where((~F.col("void")) & (F.col("kind") == kind)), ["image_id", "cell_key"], ["image_id"])


@op("agg_image_hist", "patch edges celled floors voided hist", "SELECT image_id, cell_key, round(p, 6) AS p FROM hist")
def _(s, d):
    return image_hist(s, d).select("image_id", "cell_key", F.round("p", 6).alias("p"))


CTE["classed"] = "SELECT image_id, defect_type FROM (SELECT image_id, defect_type, row_number() OVER (PARTITION BY image_id ORDER BY morph_id DESC) AS r FROM morph WHERE image_id IS NOT NULL) WHERE r = 1"
# the defect images of the two tables have ids of their own kind: classes by the word after the prefix
CTE["classhist"] = "SELECT split_part(image_id, '_', 2) AS class, cell_key, count(*) / sum(count(*)) OVER (PARTITION BY split_part(image_id, '_', 2)) AS p FROM voided WHERE NOT void GROUP BY 1, 2"


@op("agg_class_hist", "patch edges celled floors voided classhist", "SELECT class, cell_key, round(p, 6) AS p FROM classhist")
def _(s, d):
    v = voided(s, d).where(~F.col("void")).withColumn("class", F.coalesce(F.try_element_at(F.split("image_id", "_"), F.lit(2)), F.lit("")))
    return A.share(v, ["class", "cell_key"], ["class"]).select("class", "cell_key", F.round("p", 6).alias("p"))


@op("agg_edge_prior", "morph boxed", "SELECT coalesce(defect_type, '*') AS class, round(avg(CASE WHEN w >= 800 OR h >= 720 OR x <= 72 OR y <= 72 OR 1000 - (x + w) <= 72 OR 900 - (y + h) <= 72 THEN 1.0::DOUBLE ELSE 0 END), 6) AS edge FROM boxed WHERE b IS NOT NULL GROUP BY GROUPING SETS ((defect_type), ())")
def _(s, d):
    from sieveloom.functions.boxes import edge_surface

    e = boxed(s, d).where("b is not null").withColumn("e", F.when(edge_surface("b", F.lit(1000), F.lit(900)) == "surface", 0.0).otherwise(1.0))
    g = e.groupingSets([["defect_type"], []], "defect_type").agg(F.avg("e").alias("edge"))
    return g.select(F.coalesce("defect_type", F.lit("*")).alias("class"), F.round("edge", 6).alias("edge"))


@op("agg_image_dim", "patch", "SELECT image_id, coalesce(max(CASE WHEN image_w > 0 THEN image_w END), max(TRY_CAST(split_part(patch_xy, '_', 1) AS INT)) + 64) AS w, coalesce(max(CASE WHEN image_h > 0 THEN image_h END), max(TRY_CAST(split_part(patch_xy, '_', 2) AS INT)) + 64) AS h FROM patch GROUP BY image_id")
def _(s, d):
    xy = F.split("patch_xy", "_")
    at = lambda i: F.max(F.try_element_at(xy, F.lit(i)).try_cast("int")) + 64
    explicit = lambda c: F.max(F.when(F.col(c) > 0, F.col(c)))
    return patch(s, d).groupBy("image_id").agg(F.coalesce(explicit("image_w"), at(1)).alias("w"), F.coalesce(explicit("image_h"), at(2)).alias("h"))


@op("agg_image_compat", "patch edges celled floors voided", "SELECT image_id, round(coalesce(avg(CASE WHEN NOT void THEN coalesce(p, 0.5) END), -1) + 1e-9::DOUBLE, 6) AS compat FROM voided v LEFT JOIN (SELECT cell_key AS ck, p FROM compatibility WHERE cluster_id = 0) c ON c.ck = v.cell_key WHERE kind = 'good' GROUP BY image_id")
def _(s, d):
    comp = read(s, d, "compatibility").where("cluster_id = 0").select("cell_key", "p")
    v = voided(s, d).where("kind = 'good'").join(comp, "cell_key", "left")
    return v.groupBy("image_id").agg(F.round(F.coalesce(F.avg(F.when(~F.col("void"), F.coalesce("p", F.lit(0.5)))), F.lit(-1.0)) + 1e-9, 6).alias("compat"))  # a mean between two digits, whatever the order of its sum, is rounded up


_SEL = "quality_score >= 0.8"


@op("agg_coverage", "cand", f"SELECT round(count(DISTINCT CASE WHEN {_SEL} THEN cluster_id END) / count(DISTINCT cluster_id), 6) AS clusters, round(count(DISTINCT CASE WHEN {_SEL} THEN cell_key END) / count(DISTINCT cell_key), 6) AS cells FROM cand WHERE NOT isnan(coalesce(quality_score, 1))")
def _(s, d):
    df = cand(s, d).where(~F.isnan(F.coalesce("quality_score", F.lit(1.0))))
    sel = F.expr(_SEL)
    r = lambda c: F.round(F.count_distinct(F.when(sel, F.col(c))) / F.count_distinct(c), 6)
    return df.agg(r("cluster_id").alias("clusters"), r("cell_key").alias("cells"))


@op("agg_rare_pair", "cand", f"WITH c AS (SELECT DISTINCT cluster_id, cell_key FROM cand WHERE deficit > 0), x AS (SELECT DISTINCT cluster_id, cell_key FROM cand WHERE deficit > 0 AND quality_score >= 0.95 AND NOT isnan(quality_score)) SELECT round(coalesce((SELECT count(*) FROM x) / nullif((SELECT count(*) FROM c), 0), 1), 6) AS rare".replace("WITH c AS", "SELECT rare FROM (WITH c AS", 1) + ")")
def _(s, d):
    df = cand(s, d).where("deficit > 0")
    hit = F.max((F.col("quality_score") >= 0.95) & ~F.isnan("quality_score"))
    g = df.groupBy("cluster_id", "cell_key").agg(F.coalesce(hit, F.lit(False)).alias("hit"))
    return g.agg(F.round(F.coalesce(F.try_divide(F.count(F.when(F.col("hit"), 1)), F.count("*")), F.lit(1.0)), 6).alias("rare"))


@op("agg_entropy_norm", "cand", "SELECT round(CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(p * ln(p)) / ln(count(*)) END, 6) AS entropy FROM (SELECT cluster_id, count(*) / sum(count(*)) OVER () AS p FROM cand WHERE cluster_id IS NOT NULL GROUP BY cluster_id)")
def _(s, d):
    e = A.entropy(cand(s, d).where("cluster_id is not null"), ["cluster_id"], base=F.lit("e"))
    return e.select(F.round(F.when(F.col("k") <= 1, S.lit(0)).otherwise(F.col("entropy") / F.ln("k")), 6).alias("entropy"))


CTE["perimage"] = "SELECT image_id, count(*) AS n FROM cand GROUP BY image_id"


@op("agg_gini", "cand perimage", "SELECT round(2 * sum(r * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini FROM (SELECT n, row_number() OVER (ORDER BY n, image_id) AS r FROM perimage)")
def _(s, d):
    n = cand(s, d).groupBy("image_id").agg(F.count("*").alias("n"))
    r = O.row_numbers(n, [F.col("n"), F.col("image_id")], "r")
    k, total = F.count("*").cast("double"), F.sum("n")
    return r.agg(F.round(2 * F.sum(F.col("r") * F.col("n")) / (k * total) - (k + 1) / k, 6).alias("gini"))


@op("win_sort_rank", "cand perimage", "SELECT image_id, n, row_number() OVER (ORDER BY n, image_id) AS r FROM perimage")
def _(s, d):
    n = cand(s, d).groupBy("image_id").agg(F.count("*").alias("n"))
    return O.row_numbers(n, [F.col("n"), F.col("image_id")], "r")


@op("agg_diversity", "cand", "SELECT count(DISTINCT coalesce(image_path, '') || '|' || coalesce(array_to_string(defect_bbox, ','), '')) AS sources, count(DISTINCT image_id) AS images, (SELECT max(n) FROM (SELECT count(*) AS n FROM cand GROUP BY image_id)) AS most FROM cand")
def _(s, d):
    df = cand(s, d).select("image_id", F.concat_ws("|", F.coalesce("image_path", F.lit("")), F.coalesce(F.concat_ws(",", F.col("defect_bbox").cast("array<string>")), F.lit(""))).alias("source"))
    most = df.groupBy("image_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    return df.agg(F.count_distinct("source").alias("sources"), F.count_distinct("image_id").alias("images")).crossJoin(most)


#: The t value of a 95 % interval by number of values; fixed values. Beyond them it follows from the normal one by an expansion in 1 / (n - 1).
_T = {2: 12.706, 3: 4.303, 4: 3.182, 5: 2.776, 6: 2.571, 7: 2.447, 8: 2.365, 9: 2.306, 10: 2.262}
_Z = 1.959963984540054
_EXPANSION = [_Z, (_Z**3 + _Z) / 4, (5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96, (3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384]
_TQ = "CASE n " + " ".join(f"WHEN {k} THEN {v}" for k, v in _T.items()) + f" ELSE {' + '.join(f'{c!r}::DOUBLE / (n - 1) ** {i}' for i, c in enumerate(_EXPANSION))} END"


@op("agg_seed_stats", "", f"SELECT user_id, event_type, n, round(m, 8) AS mean, round(sd, 5) AS std, round(CASE WHEN n < 2 THEN m ELSE m - {_TQ} * sd / sqrt(n) END, 4) AS lo, round(CASE WHEN n < 2 THEN m ELSE m + {_TQ} * sd / sqrt(n) END, 4) AS hi FROM (SELECT user_id, event_type, count(value) AS n, avg(value) AS m, coalesce(stddev_samp(value), 0) AS sd FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type)")
def _(s, d):
    g = read(s, d, "events").where("value is not null").groupBy("user_id", "event_type").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    t = sum((F.lit(c) / F.pow(F.col("n") - 1, F.lit(float(i))) for i, c in enumerate(_EXPANSION)), F.lit(0.0))
    for k, v in _T.items():
        t = F.when(F.col("n") == k, v).otherwise(t)
    half = F.when(F.col("n") < 2, S.lit(0)).otherwise(t * F.col("sd") / F.sqrt("n"))
    return g.select("user_id", "event_type", "n", F.round("m", 8).alias("mean"), F.round("sd", 5).alias("std"), F.round(F.col("m") - half, 4).alias("lo"), F.round(F.col("m") + half, 4).alias("hi"))


CTE["cube"] = "SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY user_id, event_type"


@op("agg_improvement", "cube", "SELECT round(avg((a.v - b.v) / (b.v + 1e-9::DOUBLE) * 100), 5) AS gain, count(*) AS n FROM cube a JOIN cube b USING (user_id) WHERE a.event_type = (SELECT max(event_type) FROM events) AND b.event_type = (SELECT min(event_type) FROM events)")
def _(s, d):
    ev = read(s, d, "events")
    cube = ev.groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    ends = ev.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    x = cube.crossJoin(F.broadcast(ends))
    a, b = x.where("event_type = hi").select("user_id", F.col("v").alias("a")), x.where("event_type = lo").select("user_id", F.col("v").alias("b"))
    return a.join(b, "user_id").agg(F.round(F.avg((F.col("a") - F.col("b")) / (F.col("b") + 1e-9) * 100), 5).alias("gain"), F.count("*").alias("n"))


_TYPES = ["click", "purchase", "search", "view", "signup"]


@op("agg_pivot_results", "cube", "SELECT user_id, " + ", ".join(f"round(max(CASE WHEN event_type = '{t}' THEN v END), 6) AS {t}" for t in _TYPES) + " FROM cube GROUP BY user_id")
def _(s, d):
    p = read(s, d, "events").groupBy("user_id").pivot("event_type", _TYPES).agg(F.avg("value"))
    return p.select("user_id", *[F.round(t, 6).alias(t) for t in _TYPES])


@op("agg_collision", "morph", "SELECT regexp_replace(image_id, '^' || defect_type || '_', '') AS stem, count(DISTINCT defect_type) AS kinds FROM morph WHERE image_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT defect_type) > 1")
def _(s, d):
    m = morph(s, d).where("image_id is not null")
    stem = F.when(F.startswith("image_id", F.concat("defect_type", F.lit("_"))), F.substring(F.col("image_id"), F.length("defect_type") + 2, F.lit(10_000))).otherwise(F.col("image_id"))
    return m.groupBy(stem.alias("stem")).agg(F.count_distinct("defect_type").alias("kinds")).where("kinds > 1")


# scores against labels: good and bad patches by their variance
CTE["scored"] = "SELECT CAST(kind = 'defect' AS INT) AS y, round(local_variance, 1) AS score FROM patch WHERE kind IS NOT NULL AND local_variance IS NOT NULL"


def scored(s, d):
    df = patch(s, d).where("kind is not null and local_variance is not null")
    return df.select((F.col("kind") == "defect").cast("int").alias("y"), F.round("local_variance", 1).alias("score"))


@op("agg_auroc", "patch scored", "SELECT round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 6) AS auroc FROM (SELECT score, pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM scored GROUP BY score))")
def _(s, d):
    g = scored(s, d).groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    c = O.running(g, [F.col("score")], {"cum": F.col("neg")})
    area = F.sum(F.col("pos") * (F.col("cum") - F.col("neg") / 2.0)) / (F.sum("pos").cast("double") * F.sum("neg"))
    return c.agg(F.round(area, 6).alias("auroc"))


@op("agg_f1_fixed", "patch scored", "SELECT round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (SELECT count(*) FILTER (WHERE y = 1 AND score > 300) AS tp, count(*) FILTER (WHERE y = 0 AND score > 300) AS fp, count(*) FILTER (WHERE y = 1 AND NOT score > 300) AS fn FROM scored)")
def _(s, d):
    hit = F.col("score") > 300
    n = lambda c: F.count(F.when(c, 1))
    g = scored(s, d).agg(n((F.col("y") == 1) & hit).alias("tp"), n((F.col("y") == 0) & hit).alias("fp"), n((F.col("y") == 1) & ~hit).alias("fn"))
    return g.select(F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 6).alias("f1"))


CTE["pr"] = "SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k, sum(pos) OVER () AS all_pos FROM (SELECT score, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM scored GROUP BY score)"


def cumulative_pr(s, d):
    g = scored(s, d).groupBy("score").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    total = g.agg(F.sum("pos").alias("all_pos"))
    return O.running(g, [F.col("score").desc()], {"tp": F.col("pos"), "k": F.col("n")}).crossJoin(F.broadcast(total))


@op("agg_best_f1", "patch scored pr", "SELECT round(max(2 * (tp / k) * (tp / all_pos) / (tp / k + tp / all_pos + 1e-8::DOUBLE)), 6) AS f1 FROM pr")
def _(s, d):
    p, r = F.col("tp") / F.col("k"), F.col("tp") / F.col("all_pos")
    return cumulative_pr(s, d).agg(F.round(F.max(2 * p * r / (p + r + 1e-8)), 6).alias("f1"))


@op("win_cum_pr", "patch scored pr", "SELECT score, round(tp / k, 9) AS prec, round(tp / all_pos, 9) AS recall FROM pr")
def _(s, d):
    return cumulative_pr(s, d).select("score", F.round(F.col("tp") / F.col("k"), 9).alias("prec"), F.round(F.col("tp") / F.col("all_pos"), 9).alias("recall"))


@op("agg_manifest_counts", "cand", "SELECT coalesce(min_class, 'none') AS primary_class, count(*) AS images FROM (SELECT image_id, min(lower(trim(class_key))) AS min_class FROM cand GROUP BY image_id) GROUP BY 1")
def _(s, d):
    first = cand(s, d).groupBy("image_id").agg(F.min(F.lower(F.trim("class_key"))).alias("c"))
    return first.groupBy(F.coalesce("c", F.lit("none")).alias("primary_class")).agg(F.count("*").alias("images"))


@op("agg_build_report", "cand", "SELECT coalesce(class_key, '_') AS class, count(*) AS n, count(*) FILTER (WHERE roi_score >= 0.2) AS kept, count(DISTINCT image_id) AS images, 0.2::DOUBLE AS threshold FROM cand GROUP BY 1")
def _(s, d):
    g = cand(s, d).groupBy(F.coalesce("class_key", F.lit("_")).alias("class"))
    return g.agg(F.count("*").alias("n"), F.count(F.when(F.col("roi_score") >= 0.2, 1)).alias("kept"), F.count_distinct("image_id").alias("images")).withColumn("threshold", F.lit(0.2))


@op("agg_rle_area", "", "SELECT event_id, list_sum([CAST(event_id % 7 + 1 AS BIGINT), CAST(user_id % 5 + 1 AS BIGINT)])::BIGINT AS area FROM events")
def _(s, d):
    from sieveloom.operators.kernels import rle_area

    rle = F.format_string("%d %d %d %d", F.lit(1), F.col("event_id") % 7 + 1, F.lit(40), F.col("user_id") % 5 + 1)
    return read(s, d, "events").select("event_id", rle_area(rle).alias("area"))
