"""Embeddings, profiles, allocation, resampling and kernels over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveloom.functions import scores as S
from sieveloom.operators import allocation as L
from sieveloom.operators import drawing as D
from sieveloom.operators import kernels as K
from sieveloom.operators import profiling as P
from sieveloom.operators import resampling as R
from sieveloom.operators import similarity as V
from sieveloom.operators import tiles as G
from sieveloom.operators.selection import hashed, top_per_group
from sieveloom.operators.stats import share
from sieveloom.plans import statistics as T
from sieveloom.plans.base import CONTEXT, CTE, MORPH, cand, morph, op, patch
from sieveloom.runtime import broadcast_if_small, materialize, read

# ---- embeddings: the three arms are vec_id modulo 3 ---------------------------------------------

CTE["emb"] = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label, vec_id % 3 AS arm FROM embeddings"
CTE["nn"] = "SELECT id, arm, d FROM (SELECT a.id, b.arm, min(round(1 - list_cosine_similarity(a.vec, b.vec), 9)) AS d FROM emb a JOIN emb b ON a.arm = 0 AND b.arm <> 0 GROUP BY a.id, b.arm)"


def emb(s, d, arm=None):
    e = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label", (F.col("vec_id") % 3).alias("arm"))
    return e if arm is None else e.where(F.col("arm") == arm)


def nn(s, d):
    """Distance of each real row to its nearest in either arm."""
    one = lambda arm: V.nearest(emb(s, d, 0), emb(s, d, arm)).select("id", F.lit(arm).cast("long").alias("arm"), F.round("distance", 9).alias("d"))
    return one(1).unionByName(one(2))


@op("jn_knn", "emb", "SELECT id, neighbour, rank FROM (SELECT a.id, b.id AS neighbour, CAST(row_number() OVER (PARTITION BY a.id ORDER BY round(1 - list_cosine_similarity(a.vec, b.vec), 9), b.id) AS INT) AS rank FROM emb a JOIN emb b ON a.id % 50 = 0 AND a.id <> b.id) WHERE rank <= 3")
def _(s, d):
    """A search: the rows with an id divisible by 50 against all other rows."""
    e = emb(s, d)
    return V.nearest(e.where("id % 50 = 0"), e, k=3, others=True).select("id", "neighbour", "rank")


@op("emb_min_dist", "emb nn", "SELECT id, arm, round(d, 6) AS d FROM nn")
def _(s, d):
    return nn(s, d).select("id", "arm", F.round("d", 6).alias("d"))


@op("emb_coverage_auc", "emb nn", "SELECT arm, round(avg(CASE WHEN d <= r THEN 1.0::DOUBLE ELSE 0 END), 6) AS auc FROM nn, (SELECT round(unnest(quantile_cont(d, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])), 9) AS r FROM nn WHERE arm = 2) GROUP BY arm")
def _(s, d):
    x = materialize(nn(s, d))
    grid = x.where("arm = 2").agg(F.explode(F.percentile("d", F.array(*[F.lit(i / 10) for i in range(1, 10)]))).alias("r"))
    hit = F.when(F.col("d") <= F.round("r", 9), 1.0).otherwise(0.0)
    return x.crossJoin(F.broadcast(grid)).groupBy("arm").agg(F.round(F.avg(hit), 6).alias("auc"))  # nine radii


@op("jn_radius", "emb", "SELECT a.id, count(*) FILTER (WHERE sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) < 1.3) AS hits FROM emb a JOIN emb b ON a.id % 50 = 0 AND a.id <> b.id GROUP BY a.id")
def _(s, d):
    """A search, as jn_knn."""
    e = emb(s, d)
    return V.within(e.where("id % 50 = 0"), e.withColumn("r", F.lit(1.3)), others=True)


@op("emb_diversity", "emb", "SELECT a.arm, round(avg(1 - list_cosine_similarity(a.vec, b.vec)), 6) AS mean_distance FROM emb a JOIN emb b ON a.arm = b.arm AND a.id < b.id GROUP BY a.arm")
def _(s, d):
    """Mean pairwise cosine distance without pairs: from the sum of the unit vectors."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    u = emb(s, d).withColumn("u", F.transform("vec", lambda x: x / norm))
    n = u.groupBy("arm").agg(F.count("*").cast("double").alias("n"))
    sums = u.select("arm", F.posexplode("u").alias("i", "x")).groupBy("arm", "i").agg(F.sum("x").alias("x")).groupBy("arm").agg(F.sum(F.col("x") * F.col("x")).alias("q"))
    return sums.join(n, "arm").select("arm", F.round(1 - (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_distance"))


_E = "sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
CTE["rad"] = f"SELECT id, arm, vec, r FROM (SELECT a.id, a.arm, any_value(a.vec) AS vec, list_sort(list({_E}))[6] AS r FROM emb a JOIN emb b ON a.arm = b.arm AND a.arm IN (0, 1) GROUP BY a.id, a.arm)"
CTE["cross_d"] = f"SELECT a.id AS real, b.id AS fake, {_E} AS dist, a.r AS rr, b.r AS rf FROM rad a JOIN rad b ON a.arm = 0 AND b.arm = 1"


@op("emb_prdc", "emb rad cross_d", "SELECT round((SELECT avg(CAST(h AS INT)) FROM (SELECT max(dist < rr - 1e-9) AS h FROM cross_d GROUP BY fake)), 6) AS precision, round((SELECT avg(CAST(h AS INT)) FROM (SELECT max(dist < rf - 1e-9) AS h FROM cross_d GROUP BY real)), 6) AS recall, round((SELECT avg(n) / 5 FROM (SELECT count(*) FILTER (WHERE dist < rr - 1e-9) AS n FROM cross_d GROUP BY fake)), 6) AS density, round((SELECT avg(CAST(h AS INT)) FROM (SELECT min(dist) < any_value(rr) - 1e-9 AS h FROM cross_d GROUP BY real)), 6) AS coverage")
def _(s, d):
    k = 5
    sets = {}
    for arm in (0, 1):
        e = emb(s, d, arm)
        r = V.nearest(e, e, k=k + 1, metric="euclid").where(F.col("rank") == k + 1).select("id", F.col("distance").alias("r"))
        sets[arm] = materialize(e.join(r, "id").select("id", "vec", "r"))
    fakes = V.within(sets[1], sets[0]).agg(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)).alias("precision"), (F.avg("hits") / k).alias("density"))
    reals = V.within(sets[0], sets[1]).agg(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)).alias("recall"))
    near = V.nearest(sets[0], sets[1], metric="euclid").join(sets[0].select("id", "r"), "id")
    cover = near.agg(F.avg(F.when(F.col("distance") < F.col("r") - 1e-9, 1.0).otherwise(0.0)).alias("coverage"))
    return fakes.crossJoin(reals).crossJoin(cover).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "density", "coverage")])


@op("emb_fid_kid_lpips")
def _(s, d):
    """The Frechet distance of either arm from the real rows, on the embeddings given; the other two need images and a network."""
    return s.createDataFrame([(arm, V.frechet(emb(s, d, 0), emb(s, d, arm))) for arm in (1, 2)], "arm int, frechet double")


@op("emb_rare_modes", "emb", "SELECT label, n FROM (SELECT label, count(*) AS n FROM emb WHERE arm = 0 GROUP BY label) WHERE n <= (SELECT quantile_cont(n, 0.4) FROM (SELECT count(*) AS n FROM emb WHERE arm = 0 GROUP BY label)) AND label IN (SELECT label FROM emb WHERE arm = 1)")
def _(s, d):
    n = emb(s, d, 0).groupBy("label").agg(F.count("*").alias("n"))
    cut = n.agg(F.percentile("n", F.lit(0.4)).alias("cut"))
    return n.join(F.broadcast(cut), F.col("n") <= F.col("cut")).join(emb(s, d, 1).select("label"), "label", "left_semi").select("label", "n")


@op("emb_anomaly_score", "emb", "SELECT e.id, round(1 - list_cosine_similarity(e.vec, m.v), 6) AS score FROM emb e, (SELECT list(x ORDER BY i) AS v FROM (SELECT i, avg(vec[i]) AS x FROM emb, (SELECT unnest(range(1, 65)) AS i) WHERE arm = 0 GROUP BY i)) m WHERE e.arm <> 0")
def _(s, d):
    m = V.mean_vector(emb(s, d, 0))
    e = emb(s, d).where("arm <> 0").crossJoin(F.broadcast(m))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    return e.select("id", F.round(1 - dot("vec", "mean") / F.sqrt(dot("vec", "vec") * dot("mean", "mean")), 6).alias("score"))


@op("ml_prototypes", "emb", f"SELECT label, id FROM (SELECT e.label, e.id, row_number() OVER (PARTITION BY e.label ORDER BY round({_E.replace('a.vec', 'e.u').replace('b.vec', 'm.v')}, 9), e.id) AS r FROM (SELECT id, label, list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y)))) AS u FROM emb) e JOIN (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(u[i]) AS x FROM (SELECT label, list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y)))) AS u FROM emb), (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i) GROUP BY label) m ON m.label = e.label) WHERE r = 1")
def _(s, d):
    """The medoid of each cluster: the row nearest to the mean of its unit vectors; clusters are the labels given."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    u = emb(s, d).withColumn("u", F.transform("vec", lambda x: x / norm))
    m = u.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("c"))
    dist = F.sqrt(F.aggregate(F.zip_with("u", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v))
    j = u.join(broadcast_if_small(m), "label").withColumn("dist", F.round(dist, 9))
    return top_per_group(j, ["label"], [F.col("dist"), F.col("id")], 1).select("label", "id")


# ---- resampling with hashed draws ---------------------------------------------------------------

_R = 40
CTE["delta"] = "SELECT id, max(d) FILTER (WHERE arm = 2) - max(d) FILTER (WHERE arm = 1) AS x FROM nn GROUP BY id"
CTE["groups"] = "SELECT label, sum(x) AS s, count(*) AS m, row_number() OVER (ORDER BY label) - 1 AS k, count(*) OVER () AS n FROM delta JOIN emb USING (id) GROUP BY label"
_DRAWS = f"SELECT r, sum(s) / sum(m) AS b FROM (SELECT r, CAST('0x' || substr(md5(r || ':' || j), 1, 12) AS BIGINT) % (SELECT max(n) FROM groups) AS k FROM (SELECT unnest(range({R.BOOTSTRAP})) AS r), (SELECT unnest(range((SELECT max(n) FROM groups))) AS j)) JOIN groups USING (k) GROUP BY r"


@op("smp_bootstrap", "emb nn delta groups", f"SELECT round((SELECT sum(s) / sum(m) FROM groups), 6) AS delta, round(quantile_cont(b, 0.025), 6) AS ci_low, round(quantile_cont(b, 0.975), 6) AS ci_high, round((count(*) FILTER (WHERE b <= 0) + 1) / ({R.BOOTSTRAP} + 1), 6) AS p FROM ({_DRAWS})")
def _(s, d):
    """The table has no image ids, so the clusters drawn are the labels of the real rows."""
    x = nn(s, d).groupBy("id").agg((F.max(F.when(F.col("arm") == 2, F.col("d"))) - F.max(F.when(F.col("arm") == 1, F.col("d")))).alias("x"))
    b = R.cluster_bootstrap(x.join(emb(s, d, 0).select("id", "label"), "id"), "x", "label")
    return b.select(*[F.round(c, 6).alias(c) for c in ("delta", "ci_low", "ci_high", "p")])


@op("smp_permutation")
def _(s, d):
    """The pooled arms are relabelled a thousand times by a generator SQL hasn't; tested against brute force."""
    pool = emb(s, d).where("arm <> 0").select("id", "vec", (F.col("arm") == 2).alias("second"))
    return R.nearest_permutation(emb(s, d, 0), pool).select(F.round("p", 6).alias("p"))


@op("smp_null_hits", "emb", f"SELECT r, round(avg(CASE WHEN label <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hits FROM (SELECT r, label, row_number() OVER (PARTITION BY r ORDER BY md5(r || ':' || id), id) AS q FROM emb, (SELECT unnest(range({_R})) AS r)) WHERE q <= 50 GROUP BY r")
def _(s, d):
    e = emb(s, d).select("id", "label").crossJoin(F.broadcast(s.range(_R).withColumnRenamed("id", "r")))
    t = top_per_group(e, ["r"], [F.md5(F.concat_ws(":", "r", "id")), F.col("id")], 50)
    return t.groupBy("r").agg(F.round(F.avg(F.when(F.col("label") <= 1, 1.0).otherwise(0.0)), 6).alias("hits"))


# ---- profiles and policies ----------------------------------------------------------------------


def all_valleys(s, d):
    m = materialize(morph(s, d).select(*MORPH))
    rows = [(f, *P.valleys(m, f, f in ("extent", "eccentricity", "circularity"))) for f in MORPH]
    return s.createDataFrame(rows, "feature string, n_valleys int, places array<double>")


@op("ml_valleys")
def _(s, d):
    return all_valleys(s, d)


@op("ml_policy")
def _(s, d):
    return all_valleys(s, d).select("feature", "n_valleys", P.policy(F.col("n_valleys")).alias("policy"))


@op("agg_valley_total")
def _(s, d):
    return all_valleys(s, d).agg(F.sum("n_valleys").alias("total"))


@op("ml_otsu1d", "morph", "SELECT round(lo + g / 255.0::DOUBLE * (hi - lo), 6) AS threshold FROM (SELECT g, lo, hi, row_number() OVER (ORDER BY round(w0 * (w - w0) * (m0 / w0 - (m - m0) / nullif(w - w0, 0)) * (m0 / w0 - (m - m0) / nullif(w - w0, 0)), 6) DESC NULLS LAST, g) AS r FROM (SELECT g, lo, hi, sum(n) OVER (ORDER BY g)::DOUBLE AS w0, sum(n * g) OVER (ORDER BY g)::DOUBLE AS m0, sum(n) OVER ()::DOUBLE AS w, sum(n * g) OVER ()::DOUBLE AS m FROM (SELECT least(floor((solidity - lo) / (hi - lo) * 255), 255) AS g, lo, hi, count(*) AS n FROM morph, (SELECT min(solidity) AS lo, max(solidity) AS hi FROM morph) WHERE solidity IS NOT NULL GROUP BY 1, 2, 3))) WHERE r = 1")
def _(s, d):
    return P.otsu_threshold(morph(s, d), "solidity").select(F.round("threshold", 6).alias("threshold"))


@op("ml_pct_cluster", "morph", "SELECT morph_id, CAST(aspect_ratio >= a AS INT) + CAST(aspect_ratio >= b AS INT) AS cluster FROM morph, (SELECT round(quantile_cont(aspect_ratio, 0.3333), 9) AS a, round(quantile_cont(aspect_ratio, 0.6667), 9) AS b FROM morph)")
def _(s, d):
    return P.percentile_cluster(morph(s, d).select("morph_id", "aspect_ratio"), "aspect_ratio").select("morph_id", "cluster")


@op("ml_apply_policy", "morph", "SELECT morph_id, CAST(aspect_ratio >= (SELECT round(quantile_cont(aspect_ratio, 0.5), 9) FROM morph) AS INT) AS cluster FROM morph WHERE aspect_ratio IS NOT NULL")
def _(s, d):
    return P.median_cluster(morph(s, d).where("aspect_ratio is not null").select("morph_id", "aspect_ratio"), "aspect_ratio").select("morph_id", "cluster")


def _labelled(s, d, how):
    m = morph(s, d).dropna(subset=MORPH).where("aspect_ratio < 99").withColumn("id", F.col("morph_id"))
    c = P.percentile_cluster(m, "aspect_ratio") if how == "percentile" else P.median_cluster(m, "aspect_ratio")
    one = c.agg(*[F.avg(f).alias(f"m_{f}") for f in MORPH], *[F.stddev_pop(f).alias(f"s_{f}") for f in MORPH])
    z = lambda f: F.when(F.col(f"s_{f}") < 1e-9, S.lit(0)).otherwise((F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}"))
    return c.crossJoin(F.broadcast(one)).select("id", "cluster", *[z(f).alias(f) for f in MORPH])


_Z = ", ".join(f"CASE WHEN s_{f} < 1e-9 THEN 0 ELSE ({f} - m_{f}) / s_{f} END AS {f}" for f in MORPH)
CTE["shapes"] = f"SELECT morph_id AS id, {', '.join(MORPH)} FROM morph WHERE {' AND '.join(f'{f} IS NOT NULL' for f in MORPH)} AND aspect_ratio < 99"
CTE["thirds"] = "SELECT id, CAST(aspect_ratio >= a AS INT) + CAST(aspect_ratio >= b AS INT) AS cluster FROM shapes, (SELECT round(quantile_cont(aspect_ratio, 0.3333), 9) AS a, round(quantile_cont(aspect_ratio, 0.6667), 9) AS b FROM shapes)"
CTE["scaled"] = f"SELECT id, cluster, {_Z} FROM shapes JOIN thirds USING (id), (SELECT {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}' for f in MORPH)} FROM shapes)"
_APART = " + ".join(f"(x.{f} - y.{f}) * (x.{f} - y.{f})" for f in MORPH)


@op("agg_silhouette", "morph shapes thirds scaled", f"SELECT round(avg(coalesce((b - a) / greatest(a, b, 1e-12), 0)), 6) AS silhouette FROM (SELECT id, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM (SELECT x.id, x.cluster AS own, y.cluster AS other, sum(sqrt({_APART})) AS s, count(*) AS n FROM scaled x, scaled y GROUP BY 1, 2, 3) GROUP BY id)")
def _(s, d):
    return P.silhouette(_labelled(s, d, "percentile"), MORPH, "cluster").select(F.round("silhouette", 6).alias("silhouette"))


@op("ml_select_policy")
def _(s, d):
    """Policies by silhouette; a lead below 0.05 is decided by the mean over five samples of 5,000 rows, as in the original."""
    out = None
    for how in ("percentile", "otsu"):
        x = materialize(_labelled(s, d, how))
        one = P.silhouette(x, MORPH, "cluster")
        stable = None
        for seed in range(5):
            y = P.silhouette(x, MORPH, "cluster", limit=5_000, seed=seed)
            stable = y if stable is None else stable.unionByName(y)
        row = one.crossJoin(stable.agg(F.avg("silhouette").alias("stability"))).select(F.lit(how).alias("policy"), "silhouette", "stability")
        out = row if out is None else out.unionByName(row)
    top = Window.partitionBy()  # two rows
    lead = F.max("silhouette").over(top) - F.min("silhouette").over(top)
    key = F.when(lead < 0.05, F.col("stability")).otherwise(F.col("silhouette"))
    return out.withColumn("key", key).withColumn("rank", F.rank().over(Window.orderBy(F.col("key").desc(), "policy"))).select("policy", F.round("silhouette", 6).alias("silhouette"), F.round("stability", 6).alias("stability"), "rank")


@op("ml_policy_candidates")
def _(s, d):
    total = all_valleys(s, d).agg(F.sum("n_valleys")).first()[0]
    return s.createDataFrame([(i, p) for i, p in enumerate(P.candidates(int(total), 0.5))], "ord int, policy string")


@op("ml_gmm_bic")
def _(s, d):
    m = morph(s, d).where("aspect_ratio < 99").select("morph_id", *MORPH)
    model, k, x = P.gmm_bic(m, ["linearity", "solidity", "eccentricity"], max_k=4)
    got = model.transform(x) if model else x.withColumn("prediction", F.lit(0))
    return got.groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n")).withColumn("k", F.lit(k))


@op("ml_context_cluster")
def _(s, d):
    p = patch(s, d).select(*CONTEXT).where("local_variance >= 0 and texture_entropy < 4").withColumn("local_variance", F.log1p("local_variance"))
    model, k, x = P.gmm_bic(p, ["local_variance", "texture_entropy"], max_k=3)
    got = model.transform(x) if model else x.withColumn("prediction", F.lit(0))
    return got.groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n")).withColumn("k", F.lit(k))


@op("agg_cci", "patch", "SELECT round(avg(texture_entropy), 4) AS entropy, round(var_pop(frequency_energy), 5) AS var_freq, round(var_pop(orientation_consistency), 5) AS var_orient FROM patch WHERE texture_entropy < 4 AND frequency_energy < 2 AND orientation_consistency < 5")
def _(s, d):
    p = patch(s, d).where("texture_entropy < 4 and frequency_energy < 2 and orientation_consistency < 5")
    return p.agg(F.round(F.avg("texture_entropy"), 4).alias("entropy"), F.round(F.var_pop("frequency_energy"), 5).alias("var_freq"), F.round(F.var_pop("orientation_consistency"), 5).alias("var_orient"))


@op("agg_mci")
def _(s, d):
    from sieveloom.operators.stats import entropy

    e = entropy(morph(s, d), ["defect_type"]).select(F.col("entropy").alias("e"))
    n = entropy(morph(s, d), ["defect_type"], base=F.lit("e")).select(F.exp("entropy").alias("neff"))
    v = all_valleys(s, d).agg(F.sum("n_valleys").cast("double").alias("v"))
    sil = P.silhouette(_labelled(s, d, "percentile"), MORPH, "cluster")
    one = e.crossJoin(n).crossJoin(v).crossJoin(sil)
    c = F.col
    return one.select("e", "neff", "v", "silhouette", P.mci(c("e"), c("v"), c("neff"), c("silhouette")).alias("mci"))


# ---- allocation ---------------------------------------------------------------------------------


def sources(s, d):
    src = F.concat_ws("|", F.coalesce("image_path", F.col("image_id")), F.coalesce(F.concat_ws(",", F.col("defect_bbox").cast("array<string>")), F.lit("")))
    return cand(s, d).select("row_id", "class_key", "cluster_id", "cell_key", src.alias("source"), F.col("roi_score").alias("score"), "deficit")


@op("alc_pair_aware")
def _(s, d):
    return L.allocate(sources(s, d), 1500, "pair_aware", pair_cap=3)


CTE["rival"] = "SELECT row_id, coalesce(class_key, '_') AS cls, concat_ws('_', coalesce(CAST(cluster_id AS VARCHAR), '-'), cell_key) AS pair, coalesce(image_path, image_id) || '|' || coalesce(array_to_string(defect_bbox, ','), '') AS source, round(roi_score, 9) AS score, deficit FROM cand"


@op("alc_pair_small", "cand rival", """SELECT row_id, cls, pair, CAST(0 AS INT) AS seats_round FROM rival WHERE row_id IN (SELECT unnest(taken) FROM (
  WITH RECURSIVE need AS (SELECT pair, row_number() OVER (ORDER BY round(avg(deficit), 9) DESC, count(*) DESC, min(row_id)) AS no FROM rival GROUP BY pair),
  best AS (SELECT no, row_id, source, row_number() OVER (PARTITION BY no ORDER BY score DESC, row_id) AS r FROM rival JOIN need USING (pair)),
  lists AS (SELECT no, list({'r': r, 'row_id': row_id, 'source': source} ORDER BY r) AS rows FROM best WHERE r <= 101 GROUP BY no),
  walk AS (
    SELECT CAST(0 AS BIGINT) AS no, CAST([] AS BIGINT[]) AS taken, CAST([] AS VARCHAR[]) AS used
    UNION ALL
    SELECT l.no, CASE WHEN hit IS NULL THEN taken ELSE list_append(taken, hit.row_id) END, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit.source) END
    FROM (SELECT w.taken, w.used, l.no, list_filter(l.rows, lambda x: NOT list_contains(w.used, x.source))[1] AS hit FROM walk w JOIN lists l ON l.no = w.no + 1 WHERE len(w.taken) < 100) l)
  SELECT taken FROM walk ORDER BY no DESC LIMIT 1))""")
def _(s, d):
    return L.allocate(sources(s, d), 100, "pair_aware")


@op("alc_stratified")
def _(s, d):
    return L.allocate(sources(s, d), 400, "stratified", pair_cap=4)


@op("alc_stratified_compat", "cand", """SELECT row_id, cls, pair, CAST(0 AS INT) AS seats_round FROM (
  SELECT *, row_number() OVER (ORDER BY r > seats, score DESC, row_id) AS no FROM (
    SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, row_id) AS r, (SELECT 400 // count(DISTINCT coalesce(class_key, '_')) FROM cand) AS seats FROM (
      SELECT row_id, coalesce(class_key, '_') AS cls, concat_ws('_', coalesce(CAST(cluster_id AS VARCHAR), '-'), cell_key) AS pair, COMPAT AS score FROM cand))) WHERE no <= 400""".replace("COMPAT", "round(0.6::DOUBLE * ctx_prior + 0.4::DOUBLE * morph_prior, 9)"))
def _(s, d):
    c = cand(s, d).select("row_id", F.round(S.compat_score(F.col("ctx_prior"), F.col("morph_prior")), 9).alias("score"))
    return L.allocate(sources(s, d).drop("score").join(c, "row_id"), 400, "stratified_floor", source_cap=None)


@op("alc_dispatch")
def _(s, d):
    out = None
    for k in sorted(L.STRATEGIES):
        x = L.allocate(sources(s, d), 200, k).groupBy().agg(F.count("*").alias("n"), F.count_distinct("pair").alias("pairs")).withColumn("strategy", F.lit(k))
        out = x if out is None else out.unionByName(x)
    return out


# ---- grids of tiles -----------------------------------------------------------------------------

_GRID = "CAST(split_part(patch_xy, '_', 1) AS INT) // 64 AS gx, CAST(split_part(patch_xy, '_', 2) AS INT) // 64 AS gy"
CTE["tiles"] = f"SELECT image_id, {_GRID}, cell_key, void FROM voided WHERE kind = 'good'"
CTE["ringed"] = "SELECT a.image_id, a.gx, a.gy, t.cell_key, t.void, o.ox BETWEEN 0 AND 1 AND o.oy BETWEEN 0 AND 1 AS foot FROM tiles a, (SELECT x.ox, y.oy FROM (SELECT unnest([-1, 0, 1, 2]) AS ox) x, (SELECT unnest([-1, 0, 1, 2]) AS oy) y) o JOIN tiles t ON t.image_id = a.image_id AND t.gx = a.gx + o.ox AND t.gy = a.gy + o.oy"


def _grid(df):
    xy = F.split("patch_xy", "_")
    at = lambda i: F.floor(F.element_at(xy, i).cast("int") / F.lit(64.0)).cast("int")
    return df.withColumn("gx", at(1)).withColumn("gy", at(2))


@op("img_ring_site", "patch edges celled floors voided clean tiles ringed", """SELECT image_id, gx, gy, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(score, 9) DESC, gy, gx) AS r FROM (
  SELECT h.image_id, h.gx, h.gy, sum(least(h.share, coalesce(c.p, 0))) AS score FROM (SELECT image_id, gx, gy, cell_key, count(*) / sum(count(*)) OVER (PARTITION BY image_id, gx, gy) AS share FROM ringed WHERE NOT foot GROUP BY 1, 2, 3, 4) h
  JOIN (SELECT image_id, gx, gy FROM ringed WHERE foot AND NOT void GROUP BY 1, 2, 3 HAVING count(*) = 4) f USING (image_id, gx, gy) LEFT JOIN clean c USING (cell_key) GROUP BY 1, 2, 3)) WHERE r = 1""")
def _(s, d):
    """The best 2 by 2 site of each background: whole and not void, its ring like the target distribution."""
    t = materialize(T.voided(s, d).where("kind = 'good'").select("image_id", "patch_xy", "cell_key", "void"))
    target = share(t, ["cell_key"]).select("cell_key", "p")
    t = _grid(t).select("image_id", "gx", "gy", "cell_key", "void").join(broadcast_if_small(target), "cell_key", "left")
    return G.ring_sites(t).select("image_id", "gx", "gy", F.round("score", 6).alias("score"))


CTE["coretiles"] = f"SELECT DISTINCT image_id, {_GRID} FROM patch WHERE local_variance > 3000"


@op("img_tile_mask", "patch coretiles", f"SELECT p.image_id, p.gx, p.gy, CASE WHEN max(CAST(c.gx = p.gx AND c.gy = p.gy AS INT)) = 1 THEN 'core' ELSE 'adjacent' END AS kind FROM (SELECT DISTINCT image_id, {_GRID} FROM patch) p JOIN coretiles c ON c.image_id = p.image_id AND abs(c.gx - p.gx) <= 1 AND abs(c.gy - p.gy) <= 1 GROUP BY 1, 2, 3")
def _(s, d):
    """Tiles with a defect and those next to them, by exploding each core tile to its neighbourhood."""
    p = _grid(patch(s, d))
    reach = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    core = p.where("local_variance > 3000").select("image_id", "gx", "gy").distinct()
    near = core.withColumn("ox", F.explode(reach)).withColumn("oy", F.explode(reach)).select("image_id", (F.col("gx") + F.col("ox")).alias("gx"), (F.col("gy") + F.col("oy")).alias("gy"), ((F.col("ox") == 0) & (F.col("oy") == 0)).alias("is_core"))
    near = near.groupBy("image_id", "gx", "gy").agg(F.max("is_core").alias("is_core"))
    return p.select("image_id", "gx", "gy").distinct().join(near, ["image_id", "gx", "gy"]).select("image_id", "gx", "gy", F.when(F.col("is_core"), "core").otherwise("adjacent").alias("kind"))


@op("img_continuity", "patch edges celled", f"SELECT image_id, round(0.6::DOUBLE * max(n) / sum(n) + 0.4::DOUBLE * sum(e) / sum(n), 6) AS continuity FROM (SELECT image_id, split_part(cell_key, '_', 1) AS kind, count(*) AS n, sum(least(1, coalesce(edge_density, 0) / 100)) AS e FROM celled GROUP BY 1, 2) GROUP BY image_id")
def _(s, d):
    """Over all cells of an image."""
    g = T.celled(s, d).groupBy("image_id", F.element_at(F.split("cell_key", "_"), 1).alias("k")).agg(F.count("*").alias("n"), F.sum(F.least(F.lit(1.0), F.coalesce("edge_density", F.lit(0.0)) / 100)).alias("e"))
    return g.groupBy("image_id").agg(F.round(F.lit(0.6) * F.max("n") / F.sum("n") + F.lit(0.4) * F.sum("e") / F.sum("n"), 6).alias("continuity"))


@op("img_location_lookup", "patch edges celled", f"SELECT image_id, max(CASE WHEN gx = 3 AND gy = 2 THEN cell_key END) AS cell_key FROM (SELECT *, {_GRID} FROM celled) GROUP BY image_id")
def _(s, d):
    c = _grid(T.celled(s, d))
    return c.groupBy("image_id").agg(F.max(F.when((F.col("gx") == 3) & (F.col("gy") == 2), F.col("cell_key"))).alias("cell_key"))


@op("img_tile_cells", "patch edges celled floors voided", "SELECT image_id, patch_xy, cell_key, void FROM voided")
def _(s, d):
    return T.voided(s, d).select("image_id", "patch_xy", "cell_key", "void")


@op("img_patch_explode", "", "SELECT s_suppkey, x * 64 AS px, y * 64 AS py FROM supplier, (SELECT unnest(range(8)) AS x) a, (SELECT unnest(range(8)) AS y) b WHERE (x + 1) * 64 <= 100 + s_suppkey % 300 AND (y + 1) * 64 <= 80 + s_suppkey % 200")
def _(s, d):
    df = read(s, d, "supplier").select("s_suppkey", (F.lit(100) + F.col("s_suppkey") % 300).alias("w"), (F.lit(80) + F.col("s_suppkey") % 200).alias("h"))
    return K.explode_patches(df).select("s_suppkey", F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"))


# ---- kernels over synthetic images --------------------------------------------------------------


def images(s, d):
    """A 16 by 16 image of stripes, noise and a blob for each record, made by expressions."""
    n = int(s.conf.get("spark.sql.shuffle.partitions"))  # ids are few bytes, but their images much work
    m = read(s, d, "morphology_features").select("morph_id").repartition(n, "morph_id").distinct()
    px = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: ((i % 16 * (F.col("morph_id") % 7 + 1) * 9 + i * i * (F.col("morph_id") % 5)) % 200 + F.when((i % 16).between(4, 9) & F.floor(i / 16).between(5, 10), 55).otherwise(0)).cast("int"))
    return m.select("morph_id", F.lit(16).alias("h"), F.lit(16).alias("w"), px.alias("pixels"))


_PX = "CAST((i % 16 * (morph_id % 7 + 1) * 9 + i * i * (morph_id % 5)) % 200 + CASE WHEN i % 16 BETWEEN 4 AND 9 AND i // 16 BETWEEN 5 AND 10 THEN 55 ELSE 0 END AS INT)"
CTE["px"] = f"SELECT morph_id, CAST(i AS INT) AS i, CAST(i % 16 AS INT) AS x, CAST(i // 16 AS INT) AS y, {_PX} AS v FROM (SELECT DISTINCT morph_id FROM morphology_features), (SELECT unnest(range(256)) AS i)"
# the level with the largest variance between what is up to it and what is above, the lowest of equal ones
CTE["cut"] = "SELECT morph_id, CAST(g AS INT) AS g FROM (SELECT *, row_number() OVER (PARTITION BY morph_id ORDER BY round(w0 * (256 - w0) * (m0 / w0 - (m - m0) / (256 - w0)) * (m0 / w0 - (m - m0) / (256 - w0)), 4) DESC, g) AS r FROM (SELECT morph_id, v AS g, CAST(sum(n) OVER w AS DOUBLE) AS w0, CAST(sum(n * v) OVER w AS DOUBLE) AS m0, CAST(sum(n * v) OVER (PARTITION BY morph_id) AS DOUBLE) AS m FROM (SELECT morph_id, v, count(*) AS n FROM px GROUP BY 1, 2) WINDOW w AS (PARTITION BY morph_id ORDER BY v)) WHERE w0 < 256) WHERE r = 1"
_KERNELS = {
    "img_context_feats": ("context", None),
    "img_region_props": ("props", None),
    "img_background_class": ("background", None),
    "img_bg_quality": ("quality", None),
    "img_otsu_mask": ("otsu", ("px cut", "SELECT morph_id, any_value(g) AS threshold, list(CAST(v > g AS INT) ORDER BY i) AS mask FROM px JOIN cut USING (morph_id) GROUP BY morph_id")),
    "img_components": ("boxes", None),
    "img_resize": ("half", ("px", "SELECT morph_id, CAST(8 AS INT) AS side, list(CAST(round_even(v, 0) AS INT) ORDER BY y, x) AS small FROM (SELECT morph_id, x // 2 AS x, y // 2 AS y, avg(v) AS v FROM px GROUP BY ALL) GROUP BY morph_id")),
    "img_quality": ("scores", None),
    "img_gram": ("gram", None),
    "img_mask_bbox": ("mask_box", ("px", "SELECT morph_id, min(x) FILTER (WHERE v > 150) AS x, min(y) FILTER (WHERE v > 150) AS y, max(x) FILTER (WHERE v > 150) - min(x) FILTER (WHERE v > 150) + 1 AS w, max(y) FILTER (WHERE v > 150) - min(y) FILTER (WHERE v > 150) + 1 AS h FROM px GROUP BY morph_id")),
    "img_grid": ("grid", None),
    "img_seed_mask": ("seed_mask", ("px cut", "SELECT morph_id, list(CAST(v <= g AS INT) ORDER BY i) AS mask FROM px JOIN cut USING (morph_id) GROUP BY morph_id")),
    "img_roi_meta": ("roi_meta", None),
}
for _name, (_kernel, _sql) in _KERNELS.items():

    def _run(s, d, kernel=_kernel):
        df = images(s, d)
        if kernel == "props":
            df = df.withColumn("pixels", F.transform("pixels", lambda p: F.when(p > 150, p).otherwise(0)))
        return K.map_images(df, "morph_id", kernel)

    op(_name, *(_sql or ()))(_run)


# ---- drawing on the same images: the patch is the blob of each, moved ----------------------------


def _drawn(f):
    def run(s, d):
        schema, kernel = f()
        return K.map_arrays(images(s, d), "morph_id", schema, kernel)

    return run


def _blob(g):
    return g[5:11, 4:10]


def _flat(x):
    return x.astype(int).ravel()


@op("img_paste", "px", "SELECT a.morph_id, list(CASE WHEN a.x BETWEEN 9 AND 14 AND a.y BETWEEN 1 AND 6 THEN b.v ELSE a.v END ORDER BY a.i) AS image, list(CASE WHEN a.x BETWEEN 9 AND 14 AND a.y BETWEEN 1 AND 6 THEN 255 ELSE 0 END ORDER BY a.i) AS mask, [CAST(0.75 AS DOUBLE), 0.25, 0.375, 0.375] AS label FROM px a LEFT JOIN px b ON b.morph_id = a.morph_id AND b.x = a.x - 5 AND b.y = a.y + 4 GROUP BY a.morph_id")
@_drawn
def _():
    """The blob covers another place, asked for beyond the border; mask and label of where it came to lie."""

    def f(g):
        out, mask = D.paste(g, _blob(g), 30, -4)
        return {"image": _flat(out), "mask": _flat(mask), "label": D.yolo(mask)}

    return "image array<int>, mask array<int>, label array<double>", f


@op("img_blend")
@_drawn
def _():
    return "image array<int>, mask array<int>", lambda g: dict(zip(("image", "mask"), map(_flat, D.blend(g, _blob(g), 9, 1))))


@op("img_variants")
@_drawn
def _():
    return "variants array<array<int>>", lambda g: {"variants": [_flat(D.variant(g, i, k)) for i, k in enumerate(D.WARPS)]}


@op("img_foreground")
@_drawn
def _():
    return "mask array<int>", lambda g: None if (m := D.foreground(g)) is None else {"mask": _flat(m)}


@op("img_texture")
@_drawn
def _():
    return "texture array<double>", lambda g: {"texture": D.texture(g)}


@op("img_hint")
@_drawn
def _():
    return "hint array<int>", lambda g: {"hint": _flat(D.hint(g, g > 150, 0.5, 0.5, K.background_class(g), 0.5))}


@op("img_bbox_extract")
@_drawn
def _():
    return "boxes array<array<int>>", lambda g: {"boxes": D.changed_boxes(D.paste(g, 255 - _blob(g), 9, 1)[0], g, 20)}


@op("img_place", "px", """SELECT morph_id, list([px, py] ORDER BY fit DESC, py, px) AS corners, max(fit) AS fit FROM (
  SELECT *, row_number() OVER (PARTITION BY morph_id ORDER BY fit DESC, py, px) AS r FROM (
    SELECT p.morph_id, px, py, round(avg(t.v), 6) AS fit FROM (SELECT DISTINCT morph_id FROM px) p, (SELECT CAST(unnest([0, 3, 6, 9, 10]) AS INT) AS px), (SELECT CAST(unnest([0, 3, 6, 9, 10]) AS INT) AS py)
    JOIN (SELECT morph_id, x // 4 AS tx, y // 4 AS ty, avg(v) AS v FROM px GROUP BY ALL) t ON t.morph_id = p.morph_id AND t.tx BETWEEN px // 4 AND (px + 5) // 4 AND t.ty BETWEEN py // 4 AND (py + 5) // 4 GROUP BY ALL)) WHERE r <= 8 GROUP BY morph_id""")
@_drawn
def _():
    """Corners for the blob by the mean brightness of the four by four tiles it would touch; no tile is void."""

    def f(g):
        fit = g.reshape(4, 4, 4, 4).mean(axis=(1, 3))
        corners, best, _ = D.scan_place(fit, fit < 0, g.shape, (6, 6), tile=4, stride=3)
        return {"corners": corners, "fit": round(best, 6)}

    return "corners array<array<int>>, fit double", f


@op("img_rle", "", "SELECT event_id, CAST((event_id % 90) // 10 AS INT) AS x, CAST(1 AS INT) AS w FROM events WHERE (event_id % 90) % 10 + event_id % 7 + 1 <= 10")
def _(s, d):
    """Boxes of one-run masks of height 10 that stay within their column."""
    rle = F.format_string("%d %d", F.col("event_id") % 90 + 1, F.col("event_id") % 7 + 1)
    df = read(s, d, "events").where((F.col("event_id") % 90) % 10 + F.col("event_id") % 7 + 1 <= 10)
    return df.select("event_id", K.rle_box(rle, 10).alias("b")).select("event_id", "b.x", "b.w")


@op("img_tiling", "", "SELECT s_suppkey, CAST(least(x * 96, greatest(0, n - 128)) AS INT) AS start FROM (SELECT s_suppkey, 100 + s_suppkey % 300 AS n FROM supplier), (SELECT unnest(range(6)) AS x) WHERE (x = 0 OR (x - 1) * 96 < n - 128) GROUP BY 1, 2")
def _(s, d):
    n = F.lit(100) + F.col("s_suppkey") % 300
    return read(s, d, "supplier").select("s_suppkey", F.explode(K.tile_origins(n, 128, 96)).alias("start"))


@op("img_crop_pair", "", "SELECT r_regionkey, [17, 18, 33, 34] AS pixels FROM region")
def _(s, d):
    px = F.sequence(F.lit(0), F.lit(255))
    return read(s, d, "region").select("r_regionkey", K.crop(px, F.lit(16), F.lit(1), F.lit(1), F.lit(2), F.lit(2)).alias("pixels"))


@op("img_composite", "", "SELECT r_regionkey, [CAST(round(200 * 0.25::DOUBLE + r_regionkey * 0.75::DOUBLE) AS INT), CAST(100 AS INT)] AS pixels FROM region")
def _(s, d):
    k = F.col("r_regionkey")
    return read(s, d, "region").select("r_regionkey", K.composite(F.array(F.lit(200), F.lit(7)), F.array(k, F.lit(100)), F.array(F.lit(0.25), F.lit(0.0))).alias("pixels"))
