"""Projections and filters over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveloom.functions import boxes as B
from sieveloom.functions import scores as S
from sieveloom.plans.base import CONTEXT, CTE, MORPH, cand, morph, op, patch
from sieveloom.runtime import read

_BOX = "CASE WHEN regexp_full_match(trim(defect_bbox), '[+-]?[0-9]+,[+-]?[0-9]+,[+-]?[0-9]+,[+-]?[0-9]+') THEN list_transform(string_split(trim(defect_bbox), ','), lambda v: CAST(v AS INT)) END"
CTE["boxed"] = f"SELECT *, b[1] AS x, b[2] AS y, b[3] AS w, b[4] AS h FROM (SELECT *, {_BOX} AS b FROM morph)"


def boxed(spark, d):
    return morph(spark, d).withColumn("b", B.parse_xywh("defect_bbox"))


@op("prj_parse_float", "morph", f"SELECT morph_id, {', '.join(MORPH)}, area FROM morph")
def _(s, d):
    return morph(s, d).select("morph_id", *MORPH, "area")


@op("prj_parse_bbox", "morph boxed", "SELECT morph_id, x, y, w, h FROM boxed")
def _(s, d):
    return boxed(s, d).select("morph_id", "b.x", "b.y", "b.w", "b.h")


@op("prj_bbox_convert", "morph boxed", "SELECT morph_id, '(' || x || ', ' || y || ', ' || (x + w) || ', ' || (y + h) || ')' AS xyxy, round(x + w / 2.0::DOUBLE, 6) AS cx, coalesce(x || ',' || y || ',' || w || ',' || h, '') AS box_key FROM boxed")
def _(s, d):
    df = boxed(s, d)
    cx = F.split(F.regexp_replace(B.centroid_text("b"), "[()]", ""), ", ")[0].try_cast("double")
    return df.select("morph_id", B.xyxy_text("b").alias("xyxy"), F.round(cx, 6).alias("cx"), B.key_text("b").alias("box_key"))


@op("prj_bbox_rebase", "morph boxed", """SELECT morph_id, CASE WHEN ok THEN nx END AS nx, CASE WHEN ok THEN ny END AS ny, CASE WHEN ok THEN nw END AS nw, CASE WHEN ok THEN nh END AS nh FROM (
  SELECT *, nw > 0 AND nh > 0 AS ok FROM (
  SELECT morph_id, greatest(x - 100, 0) AS nx, greatest(y - 100, 0) AS ny, least(w + least(x - 100, 0), 512 - greatest(x - 100, 0)) AS nw, least(h + least(y - 100, 0), 512 - greatest(y - 100, 0)) AS nh
  FROM boxed WHERE b IS NOT NULL))""")
def _(s, d):
    df = boxed(s, d).where("b is not null")
    r = B.rebase("b", F.lit(100), F.lit(100), F.lit(512), F.lit(512))
    return df.select("morph_id", r.alias("r")).select("morph_id", *[F.col(f"r.{c}").alias(f"n{c}") for c in "xywh"])


@op("prj_bbox_yolo", "morph boxed", "SELECT morph_id, round(least((x + w / 2.0::DOUBLE) / 1024, 1), 6) AS cx, round(least((y + h / 2.0::DOUBLE) / 1024, 1), 6) AS cy, round(least(w / 1024.0::DOUBLE, 1), 6) AS bw, round(least(h / 1024.0::DOUBLE, 1), 6) AS bh FROM boxed WHERE w > 0 AND h > 0")
def _(s, d):
    y = B.yolo("b", F.lit(1024.0), F.lit(1024.0))
    df = boxed(s, d).select("morph_id", y.alias("y")).where("y is not null")
    return df.select("morph_id", *[F.round(F.col(f"y.{a}"), 6).alias(b) for a, b in (("cx", "cx"), ("cy", "cy"), ("w", "bw"), ("h", "bh"))])


def _subtype_sql(s0, s1, a0, a1):
    return f"CASE WHEN linearity IS NULL OR solidity IS NULL OR aspect_ratio IS NULL THEN 'general' WHEN linearity > 0.85 AND aspect_ratio > {a1} THEN 'linear_scratch' WHEN aspect_ratio > {a1} AND linearity > 0.6 THEN 'elongated' WHEN aspect_ratio < {a0} AND solidity > {s1} THEN 'compact_blob' WHEN solidity < {s0} THEN 'irregular' ELSE 'general' END"


@op("prj_subtype_fixed", "morph", f"SELECT morph_id, {_subtype_sql(0.7, 0.9, 2, 5)} AS subtype FROM morph")
def _(s, d):
    return morph(s, d).select("morph_id", S.subtype_fixed(F.col("linearity"), F.col("solidity"), F.col("aspect_ratio")).alias("subtype"))


@op("prj_cluster_label", "morph", "SELECT morph_id, CASE WHEN linearity > 0.7 AND aspect_ratio > 5 THEN 'linear_scratch' WHEN aspect_ratio > 4 THEN 'elongated' WHEN aspect_ratio < 2 AND solidity > 0.85 THEN 'compact_blob' WHEN solidity < 0.65 THEN 'irregular' ELSE 'general' END AS label FROM morph")
def _(s, d):
    return morph(s, d).select("morph_id", S.cluster_label(F.col("linearity"), F.col("solidity"), F.col("aspect_ratio")).alias("label"))


_MATCH = "CASE background " + " ".join(f"WHEN '{b}' THEN CASE kind " + " ".join(f"WHEN '{k}' THEN {v[j]}::DOUBLE" for k, v in S.MATCHING.items()) + f" ELSE {S.MATCHING['general'][j]}::DOUBLE END" for j, b in enumerate(S.BACKGROUNDS)) + " ELSE 0.5::DOUBLE END"
_BG = S.BACKGROUNDS + ["unheard"]
CTE["pairing"] = "SELECT row_id, defect_subtype AS kind, list_value(" + ", ".join(f"'{b}'" for b in _BG) + ")[1 + row_id % 6] AS background, coalesce(morph_prior, 0) AS continuity, coalesce(ctx_prior, 0) AS stability FROM cand"


def pairing(s, d):
    bg = F.element_at(F.array(*[F.lit(b) for b in _BG]), (1 + F.col("row_id") % 6).cast("int"))
    return cand(s, d).select("row_id", F.col("defect_subtype").alias("kind"), bg.alias("background"), F.coalesce("morph_prior", F.lit(0.0)).alias("continuity"), F.coalesce("ctx_prior", F.lit(0.0)).alias("stability"))


@op("prj_match_score", "cand pairing", f"SELECT row_id, {_MATCH} AS match FROM pairing")
def _(s, d):
    return pairing(s, d).select("row_id", S.match_score(F.col("kind"), F.col("background")).alias("match"))


@op("prj_suitability", "cand pairing", f"SELECT row_id, round(greatest(0, least(1, 0.4::DOUBLE * {_MATCH} + 0.3::DOUBLE * continuity + 0.2::DOUBLE * stability)), 8) AS suitability FROM pairing")
def _(s, d):
    c = F.col
    return pairing(s, d).select("row_id", F.round(S.suitability(S.match_score(c("kind"), c("background")), c("continuity"), c("stability"), S.lit(0)), 8).alias("suitability"))


@op("prj_suitability_batch", "cand pairing", f"SELECT row_id, round(greatest(0, least(1, 0.4::DOUBLE * {_MATCH} + 0.3::DOUBLE * (CASE WHEN continuity = 0 THEN 0.5 ELSE continuity END) + 0.2::DOUBLE * (CASE WHEN stability = 0 THEN 0.5 ELSE stability END))), 8) AS suitability FROM (SELECT * REPLACE (CASE WHEN background = 'unheard' THEN 'smooth' ELSE background END AS background) FROM pairing)")
def _(s, d):
    c = F.col
    return pairing(s, d).select("row_id", F.round(S.suitability_batch(c("kind"), c("background"), c("continuity"), c("stability")), 8).alias("suitability"))


_C01 = lambda c: f"CASE WHEN {c} IS NULL OR NOT isfinite({c}) THEN 0 ELSE greatest(0, least(1, {c})) END"


@op("prj_roi_score", "cand", f"SELECT row_id, round(0.4::DOUBLE * {_C01('morph_prior')} + 0.4::DOUBLE * {_C01('ctx_prior')} + 0.2::DOUBLE * {_C01('deficit')}, 6) AS legacy, round(0.3::DOUBLE * {_C01('morph_prior')} + 0.5::DOUBLE * {_C01('ctx_prior')} + 0.2::DOUBLE * {_C01('quality_score')}, 6) AS realism FROM cand")
def _(s, d):
    c = F.col
    legacy = S.roi_score(c("morph_prior"), c("ctx_prior"), c("deficit"))
    realism = S.roi_score(c("morph_prior"), c("ctx_prior"), c("quality_score"), (0.3, 0.5, 0.2))
    return cand(s, d).select("row_id", F.round(legacy, 6).alias("legacy"), F.round(realism, 6).alias("realism"))


@op("prj_moderated", "cand", f"SELECT row_id, round(0.4::DOUBLE * {_C01('morph_prior')} + 0.4::DOUBLE * {_C01('ctx_prior')} + 0.2::DOUBLE * pow({_C01('deficit')}, 0.5), 6) AS score FROM cand")
def _(s, d):
    c = F.col
    return cand(s, d).select("row_id", F.round(S.moderated_score(c("morph_prior"), c("ctx_prior"), c("deficit"), 0.5), 6).alias("score"))


@op("prj_compat_score", "cand", "SELECT row_id, round(0.6::DOUBLE * ctx_prior + 0.4::DOUBLE * morph_prior, 6) AS score FROM cand")
def _(s, d):
    return cand(s, d).select("row_id", F.round(S.compat_score(F.col("ctx_prior"), F.col("morph_prior")), 6).alias("score"))


@op("prj_jitter")
def _(s, d):
    return cand(s, d).select("row_id", S.jitter(F.col("image_path"), F.concat_ws(",", "defect_bbox"), F.col("cell_key")).alias("jitter"))


@op("prj_content_seed", "cand", "SELECT row_id, CAST('0x' || substr(sha1(image_id || '|' || cell_key), 1, 15) AS BIGINT) AS seed FROM cand")
def _(s, d):
    return cand(s, d).select("row_id", S.content_seed(F.concat_ws("|", "image_id", "cell_key")).alias("seed"))


@op("prj_source_key", "cand", "SELECT row_id, coalesce(image_path, '') || '|' || coalesce(array_to_string(defect_bbox, ','), '') AS source FROM cand")
def _(s, d):
    return cand(s, d).select("row_id", F.concat(F.coalesce("image_path", F.lit("")), F.lit("|"), F.coalesce(F.concat_ws(",", F.col("defect_bbox").cast("array<string>")), F.lit(""))).alias("source"))


_EDGES = [("local_variance", 90.0, 320.0), ("edge_density", 15.0, 40.0), ("texture_entropy", 1.8, 2.2), ("frequency_energy", 0.4, 0.6), ("orientation_consistency", 2.5, 2.5)]


@op("prj_cell_key", "patch", "SELECT image_id, patch_xy, concat_ws('_', " + ", ".join("0" if b <= a else f"(CASE WHEN coalesce({c}, 0) >= {a} THEN 1 ELSE 0 END + CASE WHEN coalesce({c}, 0) >= {b} THEN 1 ELSE 0 END)" for c, a, b in _EDGES) + ") AS cell_key FROM patch")
def _(s, d):
    key = S.cell_key([F.col(c) for c, _, _ in _EDGES], [(S.lit(a), S.lit(b)) for _, a, b in _EDGES])
    return patch(s, d).select("image_id", "patch_xy", key.alias("cell_key"))


@op("prj_bin_value", "patch", "SELECT image_id, patch_xy, CASE WHEN local_variance >= 90 THEN CASE WHEN local_variance >= 320 THEN 2 ELSE 1 END ELSE 0 END AS bin FROM patch")
def _(s, d):
    return patch(s, d).select("image_id", "patch_xy", S.bin_count(F.col("local_variance"), [S.lit(90), S.lit(320)]).alias("bin"))


@op("prj_cell_parse", "cand", "SELECT row_id, CASE WHEN list_bool_or(list_transform(p, lambda v: TRY_CAST(v AS INT) IS NULL)) THEN '0,0,0,0,0' ELSE array_to_string(list_concat(p, ['1', '1', '1', '1', '1'])[1:5], ',') END AS bins FROM (SELECT row_id, string_split(cell_key, '_') AS p FROM cand)")
def _(s, d):
    return cand(s, d).select("row_id", F.concat_ws(",", S.cell_bins("cell_key").cast("array<string>")).alias("bins"))


@op("prj_background_type", "cand", "SELECT row_id, CASE WHEN o = 2 THEN 'directional' WHEN t = 2 OR v = 2 THEN 'complex_pattern' WHEN e = 0 AND v = 0 THEN 'smooth' ELSE 'complex_pattern' END AS background FROM (SELECT row_id, TRY_CAST(split_part(cell_key, '_', 1) AS INT) AS v, TRY_CAST(split_part(cell_key, '_', 2) AS INT) AS e, TRY_CAST(split_part(cell_key, '_', 3) AS INT) AS t, TRY_CAST(split_part(cell_key, '_', 5) AS INT) AS o FROM cand WHERE cell_key <> 'none')")
def _(s, d):
    df = cand(s, d).where("cell_key <> 'none'").withColumn("b", S.cell_bins("cell_key"))
    at = lambda i: F.element_at("b", i)
    return df.select("row_id", S.background_type(at(1), at(2), at(3), at(5)).alias("background"))


_WORDS = "[" + ", ".join("[" + ", ".join(f"'{w}'" for w in ws) + "]" for ws in S.CONTEXT_WORDS) + "]"


@op("prj_prompt_parts", "morph", "SELECT morph_id, CASE WHEN aspect_ratio > 3 THEN 'highly elongated' WHEN aspect_ratio > 1.5 THEN 'elongated' ELSE 'compact' END || ' ' || CASE WHEN linearity > 0.65 THEN 'linear' WHEN linearity > 0.30 THEN 'irregular' ELSE 'scattered' END || ' defect with ' || CASE WHEN solidity > 0.80 THEN 'solid' WHEN solidity > 0.50 THEN 'semi-solid' ELSE 'fragmented' END || ' boundary' AS words FROM morph")
def _(s, d):
    return morph(s, d).select("morph_id", S.morphology_words(F.col("linearity"), F.col("solidity"), F.col("aspect_ratio")).alias("words"))


@op("prj_context_words", "", f"""SELECT cluster_id, cell_key, {_WORDS}[f1][b1 + 1] || ' ' || {_WORDS}[f2][b2 + 1] || ' surface background' AS words, CASE WHEN p >= 0.40 THEN 'predominantly occurring' WHEN p >= 0.20 THEN 'commonly found' ELSE 'rarely observed' END || ' on this surface type' AS prior FROM (
  SELECT cluster_id, cell_key, p, max(CASE WHEN r = 1 THEN f END) AS f1, max(CASE WHEN r = 1 THEN b END) AS b1, max(CASE WHEN r = 2 THEN f END) AS f2, max(CASE WHEN r = 2 THEN b END) AS b2 FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster_id, cell_key ORDER BY b DESC, f) AS r FROM (
      SELECT cluster_id, cell_key, p, CAST(split_part(cell_key, '_', f) AS INT) AS b, f FROM compatibility, (SELECT unnest([1, 2, 3, 4, 5]) AS f) WHERE regexp_full_match(cell_key, '[0-9](_[0-9]){{4}}')))
  GROUP BY cluster_id, cell_key, p)""")
def _(s, d):
    df = read(s, d, "compatibility").where(F.col("cell_key").rlike("^[0-9](_[0-9]){4}$"))
    return df.select("cluster_id", "cell_key", S.context_words("cell_key").alias("words"), S.prior_words(F.col("p")).alias("prior"))


_HOW = ["faint", "clear", "strong", "subtle"]


@op("prj_prompt_style", "cand", "SELECT row_id, 'a ' || coalesce(defect_subtype, 'general') || ' defect' AS simple, 'a ' || list_value(" + ", ".join(f"'{w}'" for w in _HOW) + ")[1 + CAST('0x' || substr(md5(CAST(row_id AS VARCHAR)), 1, 12) AS BIGINT) % 4] || ' ' || coalesce(defect_subtype, 'general') || ' defect' AS detailed FROM cand")
def _(s, d):
    pick = F.conv(F.substring(F.md5(F.col("row_id").cast("string")), 1, 12), 16, 10).cast("long") % 4
    kind = F.coalesce("defect_subtype", F.lit("general"))
    word = F.element_at(F.array(*[F.lit(w) for w in _HOW]), (pick + 1).cast("int"))
    return cand(s, d).select("row_id", F.concat(F.lit("a "), kind, F.lit(" defect")).alias("simple"), F.concat(F.lit("a "), word, F.lit(" "), kind, F.lit(" defect")).alias("detailed"))


@op("prj_normalize_scalar", "cand", f"SELECT row_id, round({_C01('(roi_score - 0.1::DOUBLE) / 0.5::DOUBLE')}, 6) AS minmax, round(1 / (1 + exp(-(roi_score - 0.2::DOUBLE) / 0.1::DOUBLE)), 6) AS zscore FROM cand")
def _(s, d):
    return cand(s, d).select("row_id", F.round(S.minmax_scalar("roi_score", 0.1, 0.6), 6).alias("minmax"), F.round(S.logistic_z("roi_score", S.lit(0.2), S.lit(0.1)), 6).alias("zscore"))


@op("prj_clamp01", "patch", f"SELECT image_id, patch_xy, {_C01('texture_entropy')} AS v FROM patch")
def _(s, d):
    return patch(s, d).select("image_id", "patch_xy", S.clamp01("texture_entropy").alias("v"))


@op("prj_type_from_seed", "morph", "SELECT morph_id, CASE WHEN regexp_full_match(image_id, '.+_[0-9]+') THEN regexp_replace(image_id, '_[0-9]+$', '') ELSE image_id END AS kind FROM morph WHERE image_id IS NOT NULL")
def _(s, d):
    return morph(s, d).where("image_id is not null").select("morph_id", S.type_from_seed("image_id").alias("kind"))


@op("prj_class_id", "cand", """SELECT row_id, CASE WHEN regexp_matches(key, '^class[0-9]+$') THEN CAST(substr(key, 6) AS INT) ELSE 1 END AS by_key,
  coalesce(TRY_CAST(nullif(regexp_extract(name, '_class([0-9]+)', 1), '') AS INT), 1) AS by_name, nullif(regexp_extract(image_path, '/test/([^/]+)/', 1), '') AS by_path
  FROM (SELECT row_id, image_path, CASE WHEN cluster_id % 2 = 0 THEN 'class' || cluster_id ELSE class_key END AS key, image_id || CASE WHEN cluster_id % 3 > 0 THEN '_class' || cluster_id || '_' || row_id ELSE '' END AS name FROM cand)""")
def _(s, d):
    """The number of a class by its key, by the name of a file and, as a word, by the path; without one the first class."""
    c, k = cand(s, d), F.col("cluster_id")
    key = F.when(k % 2 == 0, F.concat(F.lit("class"), k.cast("string"))).otherwise(F.col("class_key"))
    name = F.concat("image_id", F.when(k % 3 > 0, F.concat(F.lit("_class"), k.cast("string"), F.lit("_"), F.col("row_id").cast("string"))).otherwise(F.lit("")))
    kind = F.regexp_extract("image_path", "/test/([^/]+)/", 1)
    return c.select("row_id", F.coalesce(S.class_number(key), F.lit(1)).alias("by_key"), F.coalesce(F.regexp_extract(name, "_class([0-9]+)", 1).try_cast("int"), F.lit(1)).alias("by_name"), F.when(kind != "", kind).alias("by_path"))


@op("prj_path_remap", "morph", "SELECT morph_id, regexp_replace(image_path, '^/mnt/vault/img/', '/data/') AS path FROM morph")
def _(s, d):
    return morph(s, d).select("morph_id", F.regexp_replace("image_path", "^/mnt/vault/img/", "/data/").alias("path"))


@op("prj_tile_group", "morph", "SELECT morph_id, split_part(image_id, '__tile_', 1) AS tile_group FROM morph")
def _(s, d):
    return morph(s, d).select("morph_id", S.tile_group("image_id").alias("tile_group"))


@op("prj_defect_code", "morph", "SELECT morph_id, TRY_CAST(split_part(image_id, '_', 2) AS INT) AS code FROM morph WHERE regexp_full_match(split_part(image_id, '_', 2), '[0-9]{1,8}')")
def _(s, d):
    df = morph(s, d).withColumn("p", F.try_element_at(F.split("image_id", "_"), F.lit(2)))
    return df.where(F.col("p").rlike("^[0-9]{1,8}$")).select("morph_id", F.col("p").cast("int").alias("code"))


@op("prj_edge_surface", "morph boxed", "SELECT morph_id, CASE WHEN w >= 0.8 * 1000 OR h >= 0.8 * 900 THEN 'span' WHEN x <= 72 OR y <= 72 OR 1000 - (x + w) <= 72 OR 900 - (y + h) <= 72 THEN 'edge' ELSE 'surface' END AS place FROM boxed WHERE b IS NOT NULL")
def _(s, d):
    return boxed(s, d).where("b is not null").select("morph_id", B.edge_surface("b", F.lit(1000), F.lit(900)).alias("place"))


@op("prj_scale_fit", "morph boxed", "SELECT morph_id, round(k, 6) AS scale, CASE WHEN k >= 1 THEN w ELSE greatest(1, CAST(floor(w * k) AS INT)) END AS ew, CASE WHEN k >= 1 THEN h ELSE greatest(1, CAST(floor(h * k) AS INT)) END AS eh FROM (SELECT *, CASE WHEN w <= 0 OR h <= 0 OR (w <= 64 AND h <= 48) THEN 1.0::DOUBLE ELSE least(64.0::DOUBLE / w, 48.0::DOUBLE / h) * 0.95::DOUBLE END AS k FROM boxed WHERE b IS NOT NULL)")
def _(s, d):
    df = boxed(s, d).where("b is not null").select("morph_id", "b.w", "b.h")
    df = df.withColumn("k", B.scale_to_fit(F.col("w"), F.col("h"), F.lit(64), F.lit(48)))
    ew, eh = B.effective_size(F.col("w"), F.col("h"), F.col("k"))
    return df.select("morph_id", F.round("k", 6).alias("scale"), ew.alias("ew"), eh.alias("eh"))


@op("prj_place_xy", "morph boxed", """SELECT morph_id, CASE WHEN edge THEN CASE side WHEN 0 THEN 0 WHEN 2 THEN xm ELSE least(xm, CAST(floor(u * xm) AS INT)) END ELSE greatest(0, least(xm, CAST(floor(xm / 2) AS INT) + CAST(trunc((u - 0.5) * 0.4 * xm) AS INT))) END AS px,
  CASE WHEN edge THEN CASE side WHEN 1 THEN 0 WHEN 3 THEN ym ELSE least(ym, CAST(floor(u * ym) AS INT)) END ELSE greatest(0, least(ym, CAST(floor(ym / 2) AS INT) + CAST(trunc((u - 0.5) * 0.4 * ym) AS INT))) END AS py
  FROM (SELECT morph_id, morph_id % 2 = 0 AS edge, 512 - w AS xm, 512 - h AS ym, u, CAST(floor(u * 4) AS INT) % 4 AS side FROM (SELECT *, CAST('0x' || substr(md5(CAST(morph_id AS VARCHAR)), 1, 12) AS BIGINT) / pow(2::DOUBLE, 48) AS u FROM boxed WHERE w > 0 AND h > 0 AND w <= 512 AND h <= 512))""")
def _(s, d):
    df = boxed(s, d).select("morph_id", "b.w", "b.h").withColumn("u", S.unit_hash(F.col("morph_id").cast("string")))
    p = B.place(F.col("w"), F.col("h"), F.lit(512), F.lit(512), F.col("morph_id") % 2 == 0, F.col("u"))
    return df.select("morph_id", p.alias("p")).where("p is not null").select("morph_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@op("prj_void", "patch", "SELECT image_id, patch_xy, coalesce(local_variance, 0) <= 20 AND coalesce(edge_density, 0) <= 8 AS void FROM patch")
def _(s, d):
    return patch(s, d).select("image_id", "patch_xy", ((F.coalesce("local_variance", S.lit(0)) <= 20) & (F.coalesce("edge_density", S.lit(0)) <= 8)).alias("void"))


@op("prj_placement_xy", "morph boxed", "SELECT morph_id, x + w // 4 AS px, y + h // 4 AS py FROM boxed WHERE b IS NOT NULL")
def _(s, d):
    q = lambda c: F.floor(F.col(f"b.{c}") / F.lit(4.0)).cast("int")
    return boxed(s, d).where("b is not null").select("morph_id", (F.col("b.x") + q("w")).alias("px"), (F.col("b.y") + q("h")).alias("py"))


@op("prj_quality_mix", "cand", "SELECT row_id, round(0.5::DOUBLE * morph_prior + 0.5::DOUBLE * ctx_prior, 4) AS quality FROM cand")
def _(s, d):
    return cand(s, d).select("row_id", S.quality_mix(F.col("morph_prior"), F.col("ctx_prior")).alias("quality"))


_Q = "CASE WHEN quality_score IS NULL THEN 1 WHEN isnan(quality_score) THEN 0 ELSE quality_score END"


@op("flt_quality_gate", "cand", f"SELECT row_id FROM cand WHERE {_Q} >= 0.5")
def _(s, d):
    return cand(s, d).where(S.quality_gate_value("quality_score") >= 0.5).select("row_id")


@op("agg_class_report", "cand", f"SELECT coalesce(class_key, '_') AS class, count(*) AS total, count(*) FILTER (WHERE {_Q} >= 0.9) AS passing, count(*) FILTER (WHERE {_Q} >= 0.9) = 0 AS none_passes FROM cand GROUP BY 1")
def _(s, d):
    ok = S.quality_gate_value("quality_score") >= 0.9
    g = cand(s, d).groupBy(F.coalesce("class_key", F.lit("_")).alias("class")).agg(F.count("*").alias("total"), F.count(F.when(ok, 1)).alias("passing"))
    return g.withColumn("none_passes", F.col("passing") == 0)


@op("flt_suitability_cap", "cand", "SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY class_key ORDER BY row_id) AS r FROM cand WHERE roi_score >= 0.15) WHERE r <= 40")
def _(s, d):
    w = Window.partitionBy("class_key").orderBy("row_id")
    return cand(s, d).where("roi_score >= 0.15").withColumn("r", F.row_number().over(w)).where("r <= 40").select("row_id")


@op("flt_not_dry_run", "cand morph", "SELECT row_id FROM cand WHERE row_id % 7 <> 0 AND defect_mask_path IN (SELECT defect_mask_path FROM morph) OR (row_id % 7 <> 0 AND image_path IN (SELECT image_path FROM morph))")
def _(s, d):
    df = cand(s, d).where("row_id % 7 <> 0")
    m = morph(s, d)
    a = df.join(m.select("defect_mask_path").distinct(), "defect_mask_path", "left_semi").select("row_id")
    b = df.join(m.select("image_path").distinct(), "image_path", "left_semi").select("row_id")
    return a.union(b).distinct()


@op("flt_min_area", "morph boxed", "SELECT morph_id, w * h AS box_area FROM boxed WHERE w * h >= 2000")
def _(s, d):
    a = (F.col("b.w") * F.col("b.h")).alias("box_area")
    return boxed(s, d).select("morph_id", a).where("box_area >= 2000")


@op("flt_good", "patch", "SELECT image_id, patch_xy FROM patch WHERE kind = 'good' OR (SELECT count(*) FROM patch WHERE kind = 'good') = 0")
def _(s, d):
    df = patch(s, d)
    return keep_or_all(df, F.col("kind") == "good").select("image_id", "patch_xy")


def keep_or_all(df, condition):
    """The rows that hold, or all rows when none does: a branch on a one-row aggregate."""
    some = df.agg(F.coalesce(F.max(condition), F.lit(False)).alias("_some"))
    return df.crossJoin(F.broadcast(some)).where(condition | ~F.col("_some")).drop("_some")


@op("flt_mask_overlap", "patch", "SELECT image_id, avg(CASE WHEN local_variance <= 60 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM patch WHERE local_variance IS NOT NULL GROUP BY image_id HAVING avg(CASE WHEN local_variance <= 60 THEN 1.0::DOUBLE ELSE 0 END) <= 0.5")
def _(s, d):
    g = patch(s, d).where("local_variance is not null").groupBy("image_id").agg(F.avg(F.when(F.col("local_variance") <= 60, 1.0).otherwise(0.0)).alias("share"))
    return g.where("share <= 0.5")
