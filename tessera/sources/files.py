"""Sources and sinks: media files, JSON datasets, video outputs, vector indexes with a manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.exif import with_capture

# MIME types by file extension.
MIME_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "heic": "image/heic", "heif": "image/heif", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff",
    "mp4": "video/mp4", "mov": "video/quicktime", "m4v": "video/x-m4v", "avi": "video/x-msvideo", "mkv": "video/x-matroska", "webm": "video/webm",
    "mp3": "audio/mpeg", "wav": "audio/wav", "m4a": "audio/mp4", "aac": "audio/aac", "flac": "audio/flac", "ogg": "audio/ogg",
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "json": "application/json", "zip": "application/zip",
    "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "html": "text/html",
}


def mime_type(path: Column) -> Column:
    """The MIME type by extension; null if it isn't known."""
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def media_type(path: Column, content_type: Column | None = None) -> Column:
    """image, video, audio, text or application: by the content type of an upload, if that says one of the first four, else by the
    file's extension; what isn't known is text."""
    by_name = F.coalesce(F.split_part(mime_type(path), F.lit("/"), F.lit(1)), F.lit("text"))
    if content_type is None:
        return by_name
    said = F.lower(F.trim(F.split_part(F.split_part(content_type, F.lit(";"), F.lit(1)), F.lit("/"), F.lit(1))))
    return F.when(said.isin("image", "video", "audio", "text"), said).otherwise(by_name)


def ingest(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """asset_id, path, media_type, mime_type, size_bytes, modified, content_sha256, captured_at, device and gps of every file below a folder (but empty ones)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.concat(F.lit("asset_"), F.substring(F.sha2(F.col("path"), 256), 1, 12)).alias("asset_id")
    rows = with_capture(files.select("path", "length", "modificationTime", "content"))
    return rows.select(name, "path", media_type(F.col("path")).alias("media_type"), mime_type(F.col("path")).alias("mime_type"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("content_sha256"), "captured_at", "device", "gps")


def import_folder(spark: SparkSession, folder: str, allowed: tuple[str, ...], glob: str = "*") -> DataFrame:
    """ingest() of a folder, if it lies under one of the allowed roots (as written: no `..` may lead out of them)."""
    parts = folder.rstrip("/").split("/")
    if ".." in parts or not any(folder.rstrip("/") == root.rstrip("/") or folder.startswith(root.rstrip("/") + "/") for root in allowed):
        raise ValueError(f"{folder} lies under none of the allowed roots")
    return ingest(spark, folder, glob)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines dataset by a given schema; lines that don't parse are kept in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


VIDEO = "video_id string, scenes array<struct<scene_id:string,start_s:double,end_s:double,keyframes:array<struct<frame_id:string,t:double,score:double>>>>"


def video_keyframes(spark: SparkSession, path: str, each: int | None = None) -> DataFrame:
    """video_id, scene_id, frame_id, t and score of video outputs (one multi-line JSON file each); the best `each` of every scene."""
    outputs = spark.read.schema(VIDEO).option("multiLine", "true").json(path)
    scenes = outputs.select("video_id", F.explode("scenes").alias("s")).select("video_id", "s.scene_id", F.explode("s.keyframes").alias("k"))
    rows = scenes.select("video_id", "scene_id", "k.frame_id", "k.t", "k.score")
    if each is None:
        return rows
    best = F.row_number().over(W.partitionBy("video_id", "scene_id").orderBy(F.desc("score"), "t", "frame_id"))
    return rows.withColumn("__n", best).filter(F.col("__n") <= each).drop("__n")


def save_index(vectors: DataFrame, path: str, space: str, model: str) -> None:
    """Vectors of a space as Parquet under a version of their own, then the manifest that names the version.

    A reader goes by the manifest, which is written last: a crash before leaves the old manifest with its old vectors.
    """
    version = f"v-{uuid.uuid4().hex}"
    vectors.write.parquet(f"{path}/{space}/{version}")
    spark = vectors.sparkSession
    facts = spark.read.parquet(f"{path}/{space}/{version}").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim"), F.substring(F.sha2(F.concat_ws(",", F.sort_array(F.collect_set(F.substring(F.sha2(F.col("asset_id").cast("string"), 256), 1, 2)))), 256), 1, 16).alias("checksum"))
    manifest = facts.withColumn("space", F.lit(space)).withColumn("model_name", F.lit(model)).withColumn("version", F.lit(version)).withColumn("written", F.current_timestamp())
    manifest.coalesce(1).write.mode("append").json(f"{path}/{space}/manifest")


def load_index(spark: SparkSession, path: str, space: str, model: str, dim: int) -> DataFrame:
    """The vectors that the last manifest of a space names; refused if it names another model or dimension."""
    rows = spark.read.schema("n long, dim int, checksum string, space string, model_name string, version string, written timestamp").json(f"{path}/{space}/manifest")
    m = rows.orderBy(F.desc("written"), F.desc("version")).first()
    if (m["model_name"], m["dim"], m["space"]) != (model, dim, space):
        raise ValueError(f"index of {m['model_name']} ({m['dim']}) in {m['space']}; wanted {model} ({dim}) in {space}")
    return spark.read.parquet(f"{path}/{space}/{m['version']}")


def integrity(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path and problem: files that are missing, unlisted, or of another size or content. Both: path, size_bytes, content_sha256."""
    f = files.select("path", F.col("size_bytes").alias("__size"), F.col("content_sha256").alias("__sha"))
    both = manifest.join(f, "path", "full_outer")
    problem = F.when(F.col("__sha").isNull(), "missing").when(F.col("content_sha256").isNull(), "unlisted").when(F.col("__size") != F.col("size_bytes"), "size").when(F.col("__sha") != F.col("content_sha256"), "content")
    return both.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def resolve_paths(wanted: DataFrame, assets: DataFrame) -> DataFrame:
    """wanted (path) with asset_id: by whole path, else by file name where that is unique among the assets."""
    base = lambda p: F.element_at(F.split(p, "/"), -1)
    names = assets.groupBy(base(F.col("path")).alias("__base")).agg(F.count(F.lit(1)).alias("n"), F.min("asset_id").alias("__by_name")).filter("n = 1").drop("n")
    exact = assets.select("path", F.col("asset_id").alias("__by_path"))
    rows = wanted.join(exact, "path", "left").withColumn("__base", base(F.col("path"))).join(names, "__base", "left")
    return rows.withColumn("asset_id", F.coalesce("__by_path", "__by_name")).drop("__base", "__by_path", "__by_name")
