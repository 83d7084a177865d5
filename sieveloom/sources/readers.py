"""Tables, documents, listings and trees as DataFrames, with the schema stated."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveloom.operators.kernels import read_images
from sieveloom.operators.selection import top_per_group


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p))


def csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with a header, every cell as text; columns are found by name whatever their case, absent ones
    are null, others dropped; a missing file is an empty table."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=False, escape='"')
    have = {c.strip().lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None).cast("string")).alias(c) for c in columns])


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; lines that can't be read come out as nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def lenient_items(text: Column, item: str, wrappers: Sequence[str] = ("annotations", "items", "data")) -> Column:
    """The items of a JSON text: a list, or an object that holds the list under one of the names; else none."""
    plain = F.from_json(text, f"array<{item}>")
    wrapped = F.from_json(text, "struct<" + ", ".join(f"{w}: array<{item}>" for w in wrappers) + ">")
    return F.when(F.ltrim(text).startswith("["), plain).otherwise(F.coalesce(*[wrapped[w] for w in wrappers]))


def markdown_table(lines: DataFrame, caption: str, columns: Sequence[str]) -> DataFrame:
    """The pipe table after a caption in (file, line, text) rows; numbers may have a plus or a typographic minus.

    Cells become text columns and, where they read as numbers, ``<column>_num``."""
    start = lines.where(F.col("text").contains(caption)).groupBy("file").agg(F.min("line").alias("_c"))
    after = lines.join(start, "file").where(F.col("line") > F.col("_c"))
    body = after.where(F.trim("text").startswith("|"))
    end = after.where(~F.trim("text").startswith("|") & (F.trim("text") != "")).groupBy("file").agg(F.min("line").alias("_e"))
    body = body.join(end, "file", "left").where(F.col("_e").isNull() | (F.col("line") < F.col("_e")))
    cells = F.transform(F.split(F.regexp_replace(F.trim("text"), "^\\||\\|$", ""), "\\|"), lambda c: F.trim(c))
    first = body.groupBy("file").agg(F.min("line").alias("_h"))
    rows = body.join(first, "file").where((F.col("line") > F.col("_h")) & ~F.col("text").rlike("^[\\s|:-]+$")).withColumn("_x", cells)
    cell = lambda i: F.try_element_at("_x", F.lit(i + 1))
    num = lambda c: F.regexp_replace(F.regexp_replace(c, "−", "-"), "^\\+", "").try_cast("double")
    return rows.select("file", "line", *[cell(i).alias(c) for i, c in enumerate(columns)], *[num(cell(i)).alias(f"{c}_num") for i, c in enumerate(columns)])


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of text files; each file is read whole, as its lines are numbered."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return df


def listing(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg,bmp,tif,tiff}", recursive: bool = True) -> DataFrame:
    """(path, bytes, modified) of files by extension, without reading their content."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return df.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def labelled(df: DataFrame, path: str = "path") -> DataFrame:
    """df with ``kind``, the parent directory, and ``label``: 0 for good, else 1."""
    kind = F.element_at(F.split(F.regexp_replace(F.col(path), "\\\\", "/"), "/"), -2)
    return df.withColumn("kind", kind).withColumn("label", F.when(F.col("kind") == "good", 0).otherwise(1))


def discover(df: DataFrame, path: str = "path", most: int | None = None) -> DataFrame:
    """The files of each directory in order of their names, at most ``most`` of each."""
    df = df.withColumn("dir", F.regexp_replace(F.col(path), "/[^/]*$", ""))
    return df if most is None else top_per_group(df, ["dir"], [F.col(path)], most)


def mask_lookup(images: DataFrame, files: DataFrame, rules: Sequence[Column]) -> DataFrame:
    """(path, mask): the first existing of the candidate paths that the rules give for an image, else null."""
    c = images.select("path", F.posexplode(F.array(*rules)).alias("_p", "mask"))
    hit = c.join(files.select(F.col("path").alias("mask")), "mask").groupBy("path").agg(F.min_by("mask", "_p").alias("mask"))
    return images.select("path").join(hit, "path", "left")


def with_defaults(config: dict, defaults: dict) -> dict:
    """Nested settings over defaults; neither is changed."""
    out = dict(defaults)
    for k, v in config.items():
        out[k] = with_defaults(v, out[k]) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def require(config: dict, fields: Sequence[str]) -> list[str]:
    """Names of required settings that are missing; seed_dir and seed_dirs stand for each other."""
    either = {"seed_dir": "seed_dirs", "seed_dirs": "seed_dir"}
    return [f for f in fields if config.get(f) in (None, "") and config.get(either.get(f, f)) in (None, "", [])]


def kind_of_path(spark: SparkSession, path: str | None) -> str:
    """``folder``, ``file`` or ``missing``."""
    if not path:
        return "missing"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return "missing" if not fs.exists(p) else "folder" if fs.getFileStatus(p).isDirectory() else "file"


def yaml(text: str) -> dict:
    """Settings of a YAML document: nested mappings and lists by indentation, plain and quoted scalars, lists and
    mappings in brackets of scalars, comments. Anchors, tags and folded texts are none of it and raise ValueError."""
    lines = []
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#(?=([^\"']*(\"[^\"]*\"|'[^']*'))*[^\"']*$).*", "", raw).rstrip()
        if line.strip() and line.strip() != "---":
            lines.append((len(line) - len(line.lstrip(" ")), line.strip()))

    def scalar(t: str):
        if t and t[0] in "[{" and t[-1] in "]}":
            parts = [x.strip() for x in re.findall(r"(?:[^,\"']|\"[^\"]*\"|'[^']*')+", t[1:-1]) if x.strip()]
            return [scalar(x) for x in parts] if t[0] == "[" else {str(scalar(k.strip())): scalar(v.strip()) for k, v in (x.split(":", 1) for x in parts)}
        if t and t[0] in "&*!|>":
            raise ValueError(f"not read: {t}")
        if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
            return t[1:-1]
        words = {"": None, "~": None, "null": None, "true": True, "false": False}
        if t.lower() in words:
            return words[t.lower()]
        for kind in (int, float):
            try:
                return kind(t)
            except ValueError:
                pass
        return t

    def block(i: int, indent: int):
        """The mapping or list of the lines from i on that are indented so, and the line after it."""
        out: dict | list | None = None
        while i < len(lines) and lines[i][0] == indent:
            t = lines[i][1]
            entry = t == "-" or t.startswith("- ")
            if out is not None and entry != isinstance(out, list):  # a list may stand at its key's own indentation
                break
            if entry:
                out = [] if out is None else out
                if t == "-":
                    v, i = block(i + 1, lines[i + 1][0])
                elif re.match(r"- [^\"'\[{][^:]*:( |$)", t):
                    lines[i] = (indent + 2, t[2:].strip())
                    v, i = block(i, indent + 2)
                else:
                    v, i = scalar(t[2:].strip()), i + 1
                out.append(v)
            else:
                k, colon, v = t.partition(":")
                if not colon:
                    raise ValueError(f"not read: {t}")
                out = {} if out is None else out
                deeper = i + 1 < len(lines) and (lines[i + 1][0] > indent or lines[i + 1][0] == indent and lines[i + 1][1].startswith("-"))
                if not v.strip() and deeper:
                    out[str(scalar(k.strip()))], i = block(i + 1, lines[i + 1][0])
                else:
                    out[str(scalar(k.strip()))], i = scalar(v.strip()), i + 1
        return out, i

    if not lines:
        return {}
    out, end = block(0, lines[0][0])
    if end < len(lines):
        raise ValueError(f"not read: {lines[end][1]}")
    return out


def results_tree(spark: SparkSession, path: str, schema: str, file: str = "experiment_meta.json") -> DataFrame:
    """(category, model, arm, columns of schema): the JSON files of a tree category/model/arm; absent fields are null."""
    df = spark.read.schema(schema).option("multiLine", True).json(f"{path}/*/*/*/{file}").select("*", F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/").alias("_at"))
    at = lambda i: F.element_at("_at", i)
    return df.select(at(-4).alias("category"), at(-3).alias("model"), at(-2).alias("arm"), *[c for c in df.columns if c != "_at"])


def item_folders(files: DataFrame, masks: Sequence[str]) -> DataFrame:
    """(item, image, mask, status) of files (path, content) in one folder an item: an image and its mask.

    masks: endings of mask names in order of preference, as ``_label.png``. An item whose mask has no set
    pixel is ``good``, else ``defect``; without a mask that can be read it is ``skipped``.
    """
    parts = F.split("path", "/")
    name, stem = F.element_at(parts, -1), F.regexp_replace(F.element_at(parts, -1), "[.][^.]*$", "")
    rank, base = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, m in reversed(list(enumerate(masks))):
        rank, base = F.when(name.endswith(m), i).otherwise(rank), F.when(name.endswith(m), F.substring(name, F.lit(1), F.length(name) - len(m))).otherwise(base)
    x = files.select("path", "content", F.element_at(parts, -2).alias("item"), rank.alias("_rank"), F.coalesce(base, stem).alias("stem"))
    read = read_images(x.where("_rank is not null").select("path", "content")).select("path", F.exists("pixels", lambda v: v > 0).alias("set"))
    found = x.where("_rank is not null").join(read, "path").where("set is not null").groupBy("item", "stem").agg(F.min_by(F.struct("path", "set"), "_rank").alias("m"))
    images = x.where("_rank is null").select("item", "stem", F.col("path").alias("image"))
    status = F.when(F.col("m").isNull(), "skipped").when(F.col("m.set"), "defect").otherwise("good")
    return images.join(found, ["item", "stem"], "left").select("item", "image", F.col("m.path").alias("mask"), status.alias("status"))
