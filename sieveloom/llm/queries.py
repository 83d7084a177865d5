"""The pN_ queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveloom.functions.parse import number
from sieveloom.llm import capping, clusters, contamination, encode, graph, language, quantiles, splits, topn
from sieveloom.llm import records as R
from sieveloom.llm.sampling import BalancedSample, balanced_sample
from sieveloom.plans.base import DEFECT, GOOD
from sieveloom.runtime import materialize, read

Query = Callable[[SparkSession, str], DataFrame]


def _p1(spark: SparkSession, d: str) -> BalancedSample:
    valid = R.roi_records(spark, d, {"class_key": R.canonical_class("class_key"), "cluster_id": F.col("cluster_id")})
    targets = read(spark, d, "sample_targets")
    return balanced_sample(valid, targets, ["class_key", "cluster_id"], "row_id", fraction=0.2, canonical={"class_key": R.canonical_class})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).report.where("unmet_share or unmet_min").select("class_key", "cluster_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).report


def p1_margins(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).margins


def p1_quotas(spark: SparkSession, d: str) -> DataFrame:
    r = _p1(spark, d).quotas
    return r.select("class_key", "cluster_id", "available", F.round("wanted", 6).alias("wanted"), F.round("allotted", 6).alias("allotted"))


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).decided.where("selected").select(F.col("id").alias("row_id"), "class_key", "cluster_id")


METRICS = ["local_variance", "texture_entropy"]
PERCENTILES = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
#: A local binary pattern histogram has ten bins; an entropy above log2(10) is impossible.
MAX_ENTROPY = 3.3219281


#: Height in pixels of the bands by which one image's patches are spread; a patch of no readable place has a band by its hash.
BAND = 4096


def patches(spark: SparkSession, d: str) -> DataFrame:
    """One row a patch, however often delivered, with the meaning of image_type and valid values only.

    Deliveries meet by image and band of rows, so an image's patches come together, and those of a scan
    without an end are spread over its bands. ``day`` counts from 1970.
    """
    t = F.lower(F.trim("image_type"))
    kind = F.when(t.isin(GOOD), 0).when(t.isin(DEFECT), 1).otherwise(2)
    v, e = number("local_variance"), number("texture_entropy")
    row = F.element_at(F.split("patch_xy", "_"), -1).try_cast("long")
    band = F.coalesce(F.floor(row / BAND), F.pmod(F.xxhash64("patch_xy"), F.lit(64)))
    df = read(spark, d, "context_features").select("image_id", "patch_xy", band.alias("band"), F.unix_date(F.to_date("profiled_at")).alias("day"), kind.alias("kind"), F.when(v >= 0, v).alias("local_variance"), F.when((e >= 0) & (e <= MAX_ENTROPY + 1e-4), e).alias("texture_entropy"))
    one = df.repartition("image_id", "band").groupBy("image_id", "band", "patch_xy").agg(*[F.max(c).alias(c) for c in ("day", "kind", *METRICS)])
    return one.select(F.element_at(F.array(F.lit("good"), F.lit("defect"), F.lit("unknown")), F.col("kind") + 1).alias("image_kind"), "day", "image_id", *METRICS)


SETS = {"day": ["image_kind", "day"], "image": ["image_kind", "image_id"]}
BY = ["level", "image_kind", "day", "image_id", "metric"]


def p2_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of single days and of single images, which can be put together with others of their kind."""
    return quantiles.merge_tree(quantiles.sketch(patches(spark, d), ["image_kind", "day", "image_id"], METRICS, sets=SETS), BY)


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each image, of each day and, put together from the days, of all."""
    parts = p2_sketches(spark, d)
    whole = parts.where("level = 'day'").withColumns({"level": F.lit("all"), "day": F.lit(None).cast("int")})
    x = quantiles.percentiles(parts.select(*BY, *quantiles.FIELDS).unionByName(quantiles.merge(whole, BY)), BY, PERCENTILES)
    return x.withColumn("day", F.date_from_unix_date("day"))


def p2_daily(spark: SparkSession, d: str) -> DataFrame:
    return p2_percentiles(spark, d).where("level = 'day'").drop("level", "image_id")


def p2_images(spark: SparkSession, d: str) -> DataFrame:
    """Images small enough to have been sketched without a compaction."""
    return p2_percentiles(spark, d).where("level = 'image' and rank_error = 0").select("image_kind", "image_id", "metric", "n", "p", "value")


CAPS = capping.Caps("image", ["cluster_id", "cell_key"], "row_id", "quality", inner=3, outer=25)
BATCHES = 3


def _p3(spark: SparkSession, d: str) -> capping.State:
    """The deliveries in batches by loaded_at, as they come: later ones may bring known records again."""
    df = read(spark, d, "roi_candidates")
    span = df.agg(F.unix_micros(F.min(F.to_utc_timestamp("loaded_at", "UTC"))).alias("a"), F.unix_micros(F.max(F.to_utc_timestamp("loaded_at", "UTC"))).alias("b")).first()
    a, b = span["a"] or 0, span["b"] or 0
    cuts = [F.timestamp_micros(F.lit(a + (b - a) * i // BATCHES)) for i in range(1, BATCHES)]
    at = F.to_utc_timestamp("loaded_at", "UTC")
    body = {"image": R.canonical_id("image_id"), "cluster_id": F.col("cluster_id"), "cell_key": F.col("cell_key"), "quality": R.quality()}
    df = df.select("row_id", "loaded_at", at.alias("at"), *[e.alias(c) for c, e in body.items()])
    batches = []
    for i in range(BATCHES):
        mine = F.lit(True) if i == 0 else F.col("at") >= cuts[i - 1]
        if i < BATCHES - 1:
            mine = mine & (F.col("at") < cuts[i])
        if i == 0:
            mine = mine | F.col("at").isNull()
        batches.append(materialize(R.latest(df.where(mine), "row_id", list(body))))
    return capping.cap_in_batches(CAPS, batches)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _p3(spark, d).log.select("row_id")


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    return _p3(spark, d).kept.select(*CAPS.columns)


def p4_top(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "clean_bg_selected").select("roi_idx", F.explode(topn.best_of_array("cand", "normal_id", "score", 5)).alias("x"))
    df = df.select("roi_idx", F.col("x.item").alias("normal_id"), (-F.col("x.neg")).alias("score"))
    return topn.top_n(df, "roi_idx", "normal_id", "score", 5)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_top(spark, d).select("roi_idx", "normal_id")


FEATURES = ["linearity", "solidity", "eccentricity", "aspect"]
#: Interval widths: three features of the unit interval, and the logarithm of the aspect ratio.
GRID = clusters.Grid([0.15, 0.15, 0.15, 0.4], shifts=5)


def _p5(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "morphology_features")
    unit = lambda c: F.when(number(c).between(0, 1), number(c))
    ar = number("aspect_ratio")
    # below 1 an aspect ratio is impossible, 99 and more stand for a vanishing minor axis
    m = m.select("morph_id", "loaded_at", *[unit(c).alias(c) for c in FEATURES[:3]], F.when((ar >= 1) & (ar < 99), F.ln(ar)).alias("aspect"))
    return materialize(clusters.cluster(R.latest(m, "morph_id", FEATURES), "morph_id", FEATURES, GRID))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = graph.consecutive(_p5(spark, d), "cluster", "id")
    return pairs.select(F.col("a").alias("morph_id_a"), F.col("b").alias("morph_id_b"))


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.describe(_p5(spark, d)).withColumnRenamed("id", "morph_id")


def _p6(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "morphology_features").select("morph_id", "loaded_at", "image_id", "image_path", "defect_type")
    m = R.latest(m, "morph_id", ["image_id", "image_path", "defect_type"])
    return materialize(splits.related(m, "morph_id", splits.photo_keys("image_id", "image_path", "defect_type"), ["defect_type"]))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = graph.consecutive(_p6(spark, d), "component", "id")
    return pairs.select(F.col("a").alias("morph_id_a"), F.col("b").alias("morph_id_b"))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = _p6(spark, d)
    shares = splits.split_shares(read(spark, d, "split_targets"))
    done = splits.grouped_splits(rows, "component", "defect_type", shares)
    return rows.join(done, "component").select(F.col("id").alias("morph_id"), F.col("component").alias("photograph"), "split")


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = _p6(spark, d)
    shares = splits.split_shares(read(spark, d, "split_targets"))
    done = splits.grouped_splits(rows, "component", "defect_type", shares)
    n = rows.join(done, "component").groupBy("defect_type", "split").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("defect_type")))


def p6_endings(spark: SparkSession, d: str) -> DataFrame:
    """Endings of capture names that no pattern took off, with the number of photographs that have them."""
    m = read(spark, d, "morphology_features")
    by_path, _ = splits.photo_keys("image_id", "image_path", "defect_type")
    return m.select(by_path.alias("name")).distinct().select(splits.unknown_endings(F.col("name")).alias("ending")).where("ending is not null").groupBy("ending").agg(F.count("*").alias("photographs"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_column(read(spark, d, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encode.decode_column(p7_ids(spark, d), "doc_id", "ids")


def p8_alignments(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(read(spark, d, "documents"), read(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_alignments(spark, d).where(F.col("words") >= contamination.LEAST).select("doc_id", "item_id")


def _p9(spark: SparkSession, d: str) -> DataFrame:
    return language.detect(read(spark, d, "documents"), read(spark, d, "language_samples"))


def _code(spark: SparkSession, d: str):
    return language.label_code(F.col("label"), language.known(read(spark, d, "language_samples")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    code = _code(spark, d)
    wrong = (F.size("langs") > 1) | ((F.size("langs") == 1) & ~F.element_at("langs", 1).eqNullSafe(code))
    return _p9(spark, d).where(F.col("doc_id").isNotNull() & wrong).select("doc_id", F.explode("langs").alias("lang"))


def p9_labels(spark: SparkSession, d: str) -> DataFrame:
    code = _code(spark, d)
    status = F.when(F.col("lang").isNull(), "no sentence").when(code.isNull(), "missing").when(code == F.col("lang"), "right").otherwise("wrong")
    return _p9(spark, d).select("doc_id", "label", "lang", "confidence", (F.size("langs") > 1).alias("mixed"), status.alias("status"))


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    x = _p9(spark, d).select("doc_id", "lang", F.explode("passages").alias("p"))
    return x.where(F.col("p.lang") != F.col("lang")).select("doc_id", F.col("p.start").alias("start"), F.col("p.end").alias("stop"), F.col("p.lang").alias("lang"), F.col("p.confidence").alias("confidence"), F.col("p.sentences").alias("sentences"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p1_margins": p1_margins,
    "p1_sample": p1_sample,
    "p1_quotas": p1_quotas,
    "p2_percentiles": p2_percentiles,
    "p2_daily": p2_daily,
    "p2_images": p2_images,
    "p3_found": p3_found,
    "p3_kept": p3_kept,
    "p4_found": p4_found,
    "p4_top": p4_top,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p6_found": p6_found,
    "p6_splits": p6_splits,
    "p6_shares": p6_shares,
    "p6_endings": p6_endings,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_found": p8_found,
    "p8_alignments": p8_alignments,
    "p9_found": p9_found,
    "p9_labels": p9_labels,
    "p9_passages": p9_passages,
}
