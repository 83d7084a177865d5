"""Sources and sinks, each as a round trip through files in the shared folder."""

from __future__ import annotations

import base64
import json
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sieveloom.functions.boxes import yolo, yolo_line
from sieveloom.operators import kernels as K
from sieveloom.plans.base import cand, morph, op
from sieveloom.plans.scalar import boxed
from sieveloom.runtime import read, shared_dir
from sieveloom.sources import readers as R
from sieveloom.sources import writers as W


def spot(s) -> str:
    return f"{shared_dir(s)}/sieveloom-io-{uuid.uuid4().hex}"


_NATION = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(NULL AS VARCHAR) AS note FROM nation"


@op("src_csv", "", _NATION)
def _(s, d):
    p = spot(s)
    read(s, d, "nation").select("n_nationkey", F.col("n_name").alias("N_NAME"), "n_regionkey").write.csv(p, header=True)
    return R.csv(s, p, ["n_nationkey", "n_name", "note"])


@op("snk_csv", "", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def _(s, d):
    p = spot(s)
    W.csv(read(s, d, "nation"), p, ["n_nationkey", "n_name"])
    return s.read.csv(p, header=True)


@op("src_json", "", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    p = spot(s)
    read(s, d, "nation").write.json(p)
    whole = s.read.text(p, wholetext=True).select(F.concat(F.lit("["), F.concat_ws(",", F.split(F.regexp_replace("value", "\\s+$", ""), "\n")), F.lit("]")).alias("value"))
    whole.write.text(p + "-document")
    return R.json_document(s, p + "-document", "n_nationkey int, n_name string")


@op("src_jsonl", "", "SELECT event_id, event_type FROM events")
def _(s, d):
    p = spot(s)
    read(s, d, "events").select("event_id", "event_type").write.json(p)
    return R.json_lines(s, p, "event_id long, event_type string")


@op("snk_json", "", "SELECT s_suppkey, s_name FROM supplier")
def _(s, d):
    p = spot(s)
    W.json_lines(read(s, d, "supplier").select("s_suppkey", "s_name"), p)
    return R.json_lines(s, p, "s_suppkey long, s_name string")


@op("snk_jsonl", "cand", "SELECT row_id, image_id FROM cand")
def _(s, d):
    from sieveloom.plans.base import latest

    p = spot(s)
    W.json_lines(latest(read(s, d, "roi_candidates"), "row_id", ["image_id", "prompt"]), p)
    return R.json_lines(s, p, "row_id long, image_id string")


@op("src_json_lenient", "", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(s, d):
    props = F.col("props")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), props, F.lit("]"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"items": ['), props, F.lit("]}"))).otherwise(F.concat(F.lit('{"data": ['), props, F.lit("]}")))
    return read(s, d, "events").select("event_id", F.explode(R.lenient_items(text, "struct<k: bigint>")).alias("x")).select("event_id", F.col("x.k").alias("k"))


@op("src_md_table", "", "SELECT r_name AS name, CAST(r_regionkey AS DOUBLE) - 2 AS score_num FROM region")
def _(s, d):
    score = F.col("r_regionkey") - 2
    text = F.when(score < 0, F.concat(F.lit("−"), F.abs(score).cast("string"))).otherwise(F.concat(F.lit("+"), score.cast("string")))
    row = F.concat(F.lit("| "), "r_name", F.lit(" | "), text, F.lit(" |"))
    body = read(s, d, "region").agg(F.concat_ws("\n", F.array_sort(F.collect_list(row))).alias("b"))  # five regions
    doc = body.select(F.concat(F.lit("# Report\n\nTable 1: scores\n\n| name | score |\n|---|---|\n"), "b", F.lit("\n\nNext part\n| x | y |\n")).alias("value"))
    p = spot(s)
    doc.coalesce(1).write.text(p)
    return R.markdown_table(R.text_lines(s, p), "Table 1", ["name", "score"]).select("name", "score_num")


_FILES = [("train", "good", "a1.png"), ("train", "good", "a2.png"), ("test", "good", "b1.png"), ("test", "scratch", "c1.png"), ("test", "scratch", "c2.png"), ("test", "dent", "e1.JPG"), ("test", "dent", "note.txt")]
_VALUES = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _FILES) + ") t(split, kind, file)"


def files(s, contents: dict[str, bytes]) -> str:
    """A folder with these files, written through the cluster's file system."""
    p, jvm, conf = spot(s), s.sparkContext._jvm, s.sparkContext._jsc.hadoopConfiguration()
    for name, data in contents.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{p}/{name}")
        out = at.getFileSystem(conf).create(at)
        out.write(bytearray(data))
        out.close()
    return p


def tree(s) -> str:
    return files(s, {f"{a}/{b}/{c}": c.encode() for a, b, c in _FILES})


@op("src_listing", "", f"SELECT file, length(file) AS bytes FROM {_VALUES} WHERE file LIKE '%.png' OR file LIKE '%.JPG'")
def _(s, d):
    return R.listing(s, tree(s), "*.{png,JPG}").select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes")


@op("src_labelled_tree", "", f"SELECT file, kind, CASE WHEN kind = 'good' THEN 0 ELSE 1 END AS label FROM {_VALUES} WHERE split = 'test' AND file LIKE '%.png'")
def _(s, d):
    return R.labelled(R.listing(s, tree(s) + "/test", "*.png")).select(F.element_at(F.split("path", "/"), -1).alias("file"), "kind", "label")


@op("src_splits", "", f"SELECT split, kind, count(*) AS n FROM {_VALUES} WHERE file LIKE '%.png' GROUP BY 1, 2")
def _(s, d):
    x = R.labelled(R.listing(s, tree(s), "*.png")).withColumn("split", F.element_at(F.split("path", "/"), -3))
    return x.groupBy("split", "kind").agg(F.count("*").alias("n"))


_ARM = "CASE WHEN n_nationkey % 2 = 0 THEN 'baseline' ELSE 'full' END"


@op("src_results_tree", "", f"SELECT r_name AS category, n_name AS model, {_ARM} AS arm, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey / 100 END AS image_auroc, n_nationkey * 10 AS n_train FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(s, d):
    """One result file a nation, some without the score, beside files that are none."""
    n = read(s, d, "nation").join(read(s, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).collect()
    out = {}
    for r in n:
        k, at = r["n_nationkey"], f"{r['r_name']}/{r['n_name']}/{'full' if r['n_nationkey'] % 2 else 'baseline'}"
        out[f"{at}/experiment_meta.json"] = json.dumps({"n_train": k * 10} | ({"image_auroc": k / 100} if k % 5 else {}), indent=1).encode()
        out[f"{at}/log.txt"] = b"none"
    return R.results_tree(s, files(s, out), "image_auroc double, n_train int")


@op("src_discover", "morph", "SELECT morph_id FROM (SELECT morph_id, row_number() OVER (PARTITION BY regexp_replace(image_path, '/[^/]*$', '') ORDER BY image_path, morph_id) AS r FROM morph WHERE image_path <> '') WHERE r <= 5")
def _(s, d):
    from sieveloom.operators.selection import top_per_group

    x = R.discover(morph(s, d).where("image_path <> ''"), "image_path")
    return top_per_group(x, ["dir"], [F.col("image_path"), F.col("morph_id")], 5).select("morph_id")


@op("src_mask_lookup", "morph", "SELECT path, CASE WHEN a IN (SELECT defect_mask_path FROM morph) THEN a WHEN b IN (SELECT defect_mask_path FROM morph) THEN b END AS mask FROM (SELECT image_path AS path, min('/masks/' || domain || '/' || image_id || '.png') AS a, min('/masks/' || domain || '/' || defect_type || '.png') AS b FROM morph WHERE image_path <> '' AND image_id IS NOT NULL GROUP BY 1)")
def _(s, d):
    m = morph(s, d).where("image_path <> '' and image_id is not null")
    rule = lambda c: F.min(F.concat(F.lit("/masks/"), "domain", F.lit("/"), c, F.lit(".png")))
    images = m.groupBy(F.col("image_path").alias("path")).agg(rule("image_id").alias("a"), rule("defect_type").alias("b"))
    files = morph(s, d).where("defect_mask_path <> ''").select(F.col("defect_mask_path").alias("path")).distinct()
    return R.mask_lookup(images, files, [F.col("a"), F.col("b")])


@op("src_mask_fallback_chain", "morph", "SELECT morph_id, CASE WHEN defect_mask_path <> '' THEN 'recorded' WHEN n = 1 THEN 'by type' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS how FROM morph LEFT JOIN (SELECT image_path AS k, count(DISTINCT defect_mask_path) AS n FROM morph WHERE defect_mask_path <> '' AND image_path <> '' GROUP BY 1) x ON x.k = morph.image_path")
def _(s, d):
    m = morph(s, d)
    n = m.where("defect_mask_path <> '' and image_path <> ''").groupBy("image_path").agg(F.count_distinct("defect_mask_path").alias("n"))
    how = F.when(F.col("defect_mask_path") != "", "recorded").when(F.col("n") == 1, "by type").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return m.join(n, "image_path", "left").select("morph_id", how.alias("how"))


@op("src_split_csv", "morph", "SELECT domain, split, label, count(*) AS n FROM (SELECT domain, CASE WHEN morph_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN defect_type = 'scratch' THEN 'good' ELSE 'defect' END AS label FROM morph WHERE image_path <> '') GROUP BY 1, 2, 3")
def _(s, d):
    p = spot(s)
    m = morph(s, d).where("image_path <> ''")
    m.select(F.col("domain").alias("object"), F.when(F.col("morph_id") % 4 == 0, "test").otherwise("train").alias("split"), F.when(F.col("defect_type") == "scratch", "normal").otherwise("anomaly").alias("label"), F.col("image_path").alias("image"), F.col("defect_mask_path").alias("mask")).write.csv(p, header=True)
    x = R.csv(s, p, ["object", "split", "label", "image"])
    label = F.when(F.col("label") == "normal", "good").when(F.col("label") == "anomaly", "defect")
    return x.where(F.col("split").isin("train", "test") & F.col("image").isNotNull()).groupBy(F.col("object").alias("domain"), "split", label.alias("label")).agg(F.count("*").alias("n"))


@op("src_rle_csv", "", "SELECT user_id AS image, count(*) AS runs, CAST(sum(event_id % 7 + 1) AS BIGINT) AS area FROM events WHERE user_id % 6 BETWEEN 1 AND 4 GROUP BY user_id")
def _(s, d):
    p = spot(s)
    read(s, d, "events").select(F.col("user_id").alias("IMAGEID"), (F.col("user_id") % 6).alias("ClassId"), F.format_string("%d %d", F.col("event_id") % 90 + 1, F.col("event_id") % 7 + 1).alias("EncodedPixels")).write.csv(p, header=True)
    x = R.csv(s, p, ["ImageId", "ClassId", "EncodedPixels"])
    x = x.where(F.col("ClassId").try_cast("int").between(1, 4) & (F.col("EncodedPixels") != ""))
    return x.groupBy(F.col("ImageId").cast("long").alias("image")).agg(F.count("*").alias("runs"), F.sum(K.rle_area("EncodedPixels")).alias("area"))


@op("src_item_folders", "", "SELECT 'item' || n_nationkey AS item, CASE n_nationkey % 4 WHEN 0 THEN 'skipped' WHEN 1 THEN 'good' WHEN 2 THEN 'defect' ELSE 'defect' END AS status FROM nation")
def _(s, d):
    """A folder a nation: without a mask, with an empty one, with one of either name, with an unreadable one before a good one."""
    blank, spot_ = np.zeros((4, 5), np.uint8), np.eye(4, 5, dtype=np.uint8) * 255
    out = {}
    for r in read(s, d, "nation").select("n_nationkey").collect():
        k = r[0]
        masks = {0: {"label.txt": b""}, 1: {"Part0_label.png": K.as_png(blank)}, 2: {"Part0_mask.png": K.as_png(spot_)}, 3: {"Part0_label.png": b"broken", "Part0_mask.png": K.as_png(spot_)}}[k % 4]
        out |= {f"item{k}/{name}": x for name, x in ({"Part0.jpg": b"jpg"} | masks).items()}
    x = s.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,jpg}").load(files(s, out))
    return R.item_folders(x.select("path", "content"), ["_label.png", "_mask.png"]).select("item", "status")


@op("src_bitmap_json", "px", "SELECT morph_id, CASE WHEN morph_id % 10 > 0 THEN 16 END AS h, CASE WHEN morph_id % 10 > 0 THEN count(*) FILTER (WHERE v > 0) END AS area FROM px GROUP BY morph_id")
def _(s, d):
    """Annotations of every record as JSON with a PNG bitmap, a tenth of them broken, written as lines and read again."""
    from sieveloom.plans.analytics import images

    @F.pandas_udf("string")
    def packed(px: pd.Series) -> pd.Series:
        return px.map(lambda x: base64.b64encode(zlib.compress(K.as_png(np.asarray(x).reshape(16, 16)))).decode())

    p = spot(s)
    data = F.when(F.col("morph_id") % 10 == 0, "broken").otherwise(packed("pixels"))
    images(s, d).select("morph_id", F.array(F.struct(F.struct(data.alias("data"), F.array(F.lit(3), F.lit(4)).alias("origin")).alias("bitmap"))).alias("objects")).write.json(p)
    x = R.json_lines(s, p, "morph_id long, objects array<struct<bitmap: struct<data: string, origin: array<int>>>>")
    x = x.select("morph_id", F.explode("objects.bitmap").alias("b"))
    return x.select("morph_id", K.bitmap_mask("b.data")["h"].alias("h"), K.bitmap_area("b.data").alias("area"))


@op("src_complexity_glob", "", "SELECT r_name AS dataset, 'mci' AS component, CAST(r_regionkey AS DOUBLE) / 10 AS value FROM region UNION ALL SELECT r_name, 'cci', CAST(r_regionkey AS DOUBLE) / 5 FROM region")
def _(s, d):
    p = spot(s)
    r = read(s, d, "region").select(F.col("r_name").alias("dataset"), F.struct((F.col("r_regionkey").cast("double") / 10).alias("mci"), (F.col("r_regionkey").cast("double") / 5).alias("cci")).alias("parts"))
    r.write.json(p)
    return R.json_lines(s, p, "dataset string, parts map<string, double>").select("dataset", F.explode("parts").alias("component", "value"))


@op("snk_upsert", "", "SELECT user_id, event_type, round(max(value), 6) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2 UNION ALL SELECT user_id, event_type, round(max(value), 6) FROM events e WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events f WHERE f.event_id % 2 = 1 AND f.user_id = e.user_id AND f.event_type = e.event_type) GROUP BY 1, 2")
def _(s, d):
    e = read(s, d, "events")
    part = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.round(F.max("value"), 6).alias("v"))
    return W.upsert(part(0), part(1), ["user_id", "event_type"])


@op("snk_delete_key", "", "SELECT event_id FROM events WHERE event_type <> 'view'")
def _(s, d):
    return W.without_key(read(s, d, "events"), "event_type", "view").select("event_id")


@op("snk_idempotent", "", "SELECT DISTINCT user_id FROM events WHERE user_id % 3 <> 0")
def _(s, d):
    e = read(s, d, "events").select("user_id").distinct()
    done = e.where(F.col("user_id") % 3 == 0).withColumn("fingerprint", F.lit(W.fingerprint({"seed": 1})))
    return W.pending(e, done, ["user_id"], {"seed": 1}).select("user_id")


@op("snk_labels", "morph boxed", "SELECT image_id, count(*) FILTER (WHERE w > 0 AND h > 0) AS lines FROM boxed WHERE image_id IS NOT NULL GROUP BY image_id")
def _(s, d):
    b = boxed(s, d).where("image_id is not null")
    x = W.labels(b, "image_id", "morph_id", yolo_line(F.lit(0), yolo("b", F.lit(1024.0), F.lit(1024.0))))
    return x.select("image_id", F.when(F.col("labels") == "", 0).otherwise(F.size(F.split("labels", "\n"))).cast("long").alias("lines"))


@op("snk_tree", "cand", "SELECT subtype_mode AS split, class_key AS label, count(*) AS n FROM cand WHERE class_key IS NOT NULL AND regexp_full_match(class_key, '[a-z_]+') GROUP BY 1, 2")
def _(s, d):
    from sieveloom.plans.base import latest

    p = spot(s)
    x = latest(read(s, d, "roi_candidates"), "row_id", ["subtype_mode", "class_key"]).where(F.col("class_key").rlike("^[a-z_]+$"))
    W.manifest(x.select("row_id", F.lit("full").alias("group"), F.col("subtype_mode").alias("split"), F.col("class_key").alias("label")), p)
    return s.read.parquet(p).groupBy(F.col("split").cast("string").alias("split"), "label").agg(F.count("*").alias("n"))


@op("snk_report_md", "", "SELECT row_number() OVER (ORDER BY k) - 1 AS line, text FROM (SELECT -2 AS k, '| r_regionkey | r_name |' AS text UNION ALL SELECT -1, '| --- | --- |' UNION ALL SELECT r_regionkey, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region)")
def _(s, d):
    text = W.markdown(read(s, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    p = files(s, {"report.md": text.encode()})
    return R.text_lines(s, p).select("line", "text")


@op("src_yaml", "", "SELECT r_name AS region, r_regionkey AS key, CASE WHEN r_regionkey % 2 = 0 THEN 'slow' ELSE 'fast' END AS mode, list(n_name ORDER BY n_nationkey) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def _(s, d):
    """A document of settings by region, read back over defaults that half of the regions keep."""
    n = read(s, d, "nation").join(read(s, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).orderBy("n_nationkey").collect()
    by: dict = {}
    for r in n:
        by.setdefault((r["r_name"], r["r_regionkey"]), []).append(r["n_name"])
    text = "# settings\nregions:\n" + "".join(f"  {k}:  # one\n    key: {i}\n" + ("    mode: 'slow'\n" if i % 2 == 0 else "") + "    nations:\n" + "".join(f'    - "{x}"\n' for x in xs) for (k, i), xs in by.items())
    lines = R.text_lines(s, files(s, {"config.yaml": text.encode()})).orderBy("line").collect()
    found = R.yaml("\n".join(r["text"] for r in lines))["regions"]
    full = R.with_defaults(found, {k: {"key": -1, "mode": "fast", "nations": []} for k in found})
    return s.createDataFrame([(k, v["key"], v["mode"], v["nations"]) for k, v in full.items()], "region string, key int, mode string, nations array<string>")


@op("val_config", "", "SELECT r_name AS domain, CASE WHEN r_regionkey % 2 = 1 THEN 'image_dir' ELSE '' END AS missing, r_regionkey >= 3 AS unknown FROM region")
def _(s, d):
    """An entry a region: half lack a required setting, the last ones are of no known domain."""
    rows = read(s, d, "region").orderBy("r_regionkey").collect()
    known = {r["r_name"] for r in rows if r["r_regionkey"] < 3}
    out = []
    for r in rows:
        entry = {"domain": r["r_name"], "seed_dirs": ["/s"]} | ({"image_dir": "/i"} if r["r_regionkey"] % 2 == 0 else {})
        out.append((r["r_name"], ",".join(R.require(entry, ["domain", "image_dir", "seed_dir"])), entry["domain"] not in known))
    return s.createDataFrame(out, "domain string, missing string, unknown boolean")


@op("val_path", "", "SELECT n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'folder' ELSE 'missing' END AS kind FROM nation")
def _(s, d):
    rows = read(s, d, "nation").collect()
    p = files(s, {f"{r['n_name']}" if r["n_nationkey"] % 3 == 0 else f"{r['n_name']}/x": b"x" for r in rows if r["n_nationkey"] % 3 < 2})
    return s.createDataFrame([(r["n_name"], R.kind_of_path(s, f"{p}/{r['n_name']}")) for r in rows], "name string, kind string")


@op("emb_cache", "", "SELECT vec_id, label FROM embeddings")
def _(s, d):
    """Twice from one folder: the second reads what the first wrote, although its plan would fail."""
    p, e = spot(s), read(s, d, "embeddings").select("vec_id", "label")
    W.cached(e, p, {"model": "given", "rows": "embeddings"})
    return W.cached(e.where(F.raise_error(F.lit("computed again")).isNull()), p, {"rows": "embeddings", "model": "given"})


@op("ext_stream_upsert", "cand", "SELECT row_id, image_id FROM cand")
def _(s, d):
    """Extension: the deliveries of roi_candidates taken in as a stream of files and merged by key."""
    from sieveloom.streaming.ingest import ingest, snapshot

    p = spot(s)
    src = read(s, d, "roi_candidates").where("row_id is not null").select("row_id", "image_id", "loaded_at")
    src.repartition(3).write.parquet(f"{p}/in")
    # one trigger for all files: a row's deliveries are compared by their stamp within a batch
    ingest(s, f"{p}/in", src.schema, f"{p}/table", ["row_id"], f"{p}/checkpoint")
    return snapshot(s, f"{p}/table").select("row_id", "image_id")


@op("ext_stream_windows", "", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    from sieveloom.streaming.ingest import windowed_counts

    return windowed_counts(read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")


@op("src_image", "", "SELECT n_name AS name, CASE WHEN n_nationkey % 4 < 3 THEN 6 END AS h, CASE WHEN n_nationkey % 4 < 3 THEN n_nationkey + 1 END AS w, CASE WHEN n_nationkey % 4 < 3 THEN (SELECT sum(i * (n_nationkey + 3) % 251) FROM (SELECT unnest(range(6 * (n_nationkey + 1))) AS i)) END AS total FROM nation")
def _(s, d):
    """An image file a nation: PNG, PGM, PPM of three equal channels, or broken."""
    out = {}
    for r in read(s, d, "nation").collect():
        k = r["n_nationkey"]
        g = (np.arange(6 * (k + 1)) * (k + 3) % 251).astype(np.uint8).reshape(6, k + 1)
        out[f"{r['n_name']}.img"] = [K.as_png(g), b"P5\n# made here\n%d 6\n255\n" % (k + 1) + g.tobytes(), b"P6 %d 6 255\n" % (k + 1) + np.repeat(g, 3).tobytes(), b"\x89PNG broken"][k % 4]
    x = K.read_images(s.read.format("binaryFile").load(files(s, out)))
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v)
    return x.select(F.regexp_extract("path", "([^/]+)[.]img$", 1).alias("name"), "h", "w", total.alias("total"))
