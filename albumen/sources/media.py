"""Listings of media files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values
IMAGE = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "tiff", "tif", "heic", "heif", "avif", "tga", "ico", "pnm", "pbm", "pgm", "ppm", "dds", "qoi")
RAW = ("cr2", "cr3", "nef", "arw", "dng", "srf", "sr2", "orf", "rw2", "raf", "pef", "raw")
VIDEO = ("mp4", "mov", "avi", "mkv", "wmv", "flv", "webm", "m4v", "3gp", "mts", "m2ts")
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def extension(path: str = "path") -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def filename(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def classify_media(path: str = "path") -> Column:
    e = extension(path)
    return F.when(e.isin(*VIDEO), "video").when(e.isin(*RAW), "raw").otherwise("image")


def only_media(files: DataFrame) -> DataFrame:
    """files(path, ..) of a media extension and with a file name."""
    return files.filter(extension().isin(*IMAGE, *RAW, *VIDEO) & F.coalesce(filename() != "", F.lit(False)))


def list_media(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """(path, length, modificationTime, media_type[, content]) of all media files below a folder; content is not read unless asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    cols = ["path", "length", "modificationTime"] + ["content"] * with_content
    return only_media(files.select(*cols)).withColumn("media_type", classify_media())


def content_hash(content: str = "content") -> Column:
    return F.concat(F.lit("sha2:"), F.sha2(content, 256))
