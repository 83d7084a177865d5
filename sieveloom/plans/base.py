"""Logical relations over the test tables, in Spark and as SQL, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.functions.parse import number
from sieveloom.runtime import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MORPH = ["linearity", "solidity", "extent", "aspect_ratio", "eccentricity", "circularity"]
CONTEXT = ["local_variance", "edge_density", "texture_entropy", "frequency_energy", "orientation_consistency"]
_NUM = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"


#: Spellings of image_type by meaning, without case and blanks around; fixed values.
GOOD = ["good", "ok", "normal", "pass"]
DEFECT = ["defect", "ng", "bad", "anomaly", "fail"]


def latest(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The delivery of each key loaded last."""
    body = F.struct(F.col("loaded_at"), F.struct(*columns).alias("b"))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(body).alias("m")).select(key, *[F.col(f"m.b.{c}").alias(c) for c in columns])


def morph(spark: SparkSession, d: str) -> DataFrame:
    text = ["image_id", "image_path", "defect_type", "domain", "mask_source", "defect_bbox", "defect_mask_path"]
    df = read(spark, d, "morphology_features").select("morph_id", "loaded_at", *text, *[number(c).alias(c) for c in [*MORPH, "area"]])
    return latest(df, "morph_id", [*text, *MORPH, "area"])


def patch(spark: SparkSession, d: str) -> DataFrame:
    """One row a patch; redeliveries carry the same values, should they differ the largest counts."""
    kind = F.when(F.lower(F.trim("image_type")).isin(GOOD), "good").when(F.lower(F.trim("image_type")).isin(DEFECT), "defect")
    df = read(spark, d, "context_features").select("image_id", "patch_xy", kind.alias("kind"), *[number(c).alias(c) for c in CONTEXT], "image_w", "image_h")
    return df.groupBy("image_id", "patch_xy").agg(*[F.max(c).alias(c) for c in ["kind", *CONTEXT, "image_w", "image_h"]])


CAND = ["image_id", "image_path", "cluster_id", "cell_key", "class_key", "defect_subtype", "quality_score", "roi_score", "morph_prior", "ctx_prior", "deficit", "defect_bbox", "defect_mask_path"]


def cand(spark: SparkSession, d: str) -> DataFrame:
    return latest(read(spark, d, "roi_candidates"), "row_id", CAND)


def num(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '{_NUM}') AND isfinite(TRY_CAST(trim({c}) AS DOUBLE)) THEN TRY_CAST(trim({c}) AS DOUBLE) END"


CTE = {
    "morph": "SELECT morph_id, image_id, image_path, defect_type, domain, mask_source, defect_bbox, defect_mask_path, " + ", ".join(f"{num(c)} AS {c}" for c in [*MORPH, "area"]) + " FROM (SELECT *, row_number() OVER (PARTITION BY morph_id ORDER BY loaded_at DESC) AS rn FROM morphology_features WHERE morph_id IS NOT NULL) WHERE rn = 1",
    "patch": "SELECT image_id, patch_xy, max(CASE WHEN lower(trim(image_type)) IN " + str(tuple(GOOD)) + " THEN 'good' WHEN lower(trim(image_type)) IN " + str(tuple(DEFECT)) + " THEN 'defect' END) AS kind, " + ", ".join(f"max({num(c)}) AS {c}" for c in CONTEXT) + ", max(image_w) AS image_w, max(image_h) AS image_h FROM context_features GROUP BY image_id, patch_xy",
    "cand": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC) AS rn FROM roi_candidates WHERE row_id IS NOT NULL) WHERE rn = 1",
}


def with_(names: str, body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in names.split()) + "\n" + body if names else body


def op(name: str, ctes: str = "", sql: str | None = None):
    """Register a query and, if SQL can express it, the statement with the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = with_(ctes, sql)
        return f

    return register
