"""Recordings from folders and URLs, in batch and as a stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions.text import is_audio, is_audio_url
from murmur.schemas import BINARY_FILE


def recordings(spark: SparkSession, *paths: str) -> DataFrame:
    """Audio files below the paths, on any file system that Spark reads. Names are filtered before contents are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return found.filter(is_audio(F.col("path"))).withColumn("rec_id", F.xxhash64("path"))


def watched(spark: SparkSession, folder: str, delete_after: bool = False, archive: str | None = None) -> DataFrame:
    """A stream of the audio files that appear below a folder; files that were read can be deleted or archived."""
    stream = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
    if delete_after:
        stream = stream.option("cleanSource", "delete")
    elif archive:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return stream.load(folder).filter(is_audio(F.col("path"))).withColumn("rec_id", F.xxhash64("path"))


def audio_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL names an audio file."""
    return urls.filter(is_audio_url(F.col(url)))


def catalog(listing: DataFrame, column: str = "json") -> DataFrame:
    """(name, size_mb) of the ``.onnx`` files in JSON lists [{"Key", "Size"}], by name."""
    entries = listing.select(F.explode(F.from_json(column, "array<struct<Key string, Size long>>")).alias("e"))
    models = entries.filter(F.col("e.Key").endswith(".onnx"))
    return models.select(F.substring_index("e.Key", ".", 1).alias("name"), F.floor(F.col("e.Size") / 1048576).cast("long").alias("size_mb")).orderBy("name")


def model_named(listing: DataFrame, key: str, column: str = "json") -> DataFrame:
    """(name, size_mb) of the first entry with that key in JSON lists [{"Key", "Size"}], whatever its ending, or no row."""
    entries = listing.select(F.explode(F.from_json(column, "array<struct<Key string, Size long>>")).alias("e")).filter(F.col("e.Key") == key)
    return entries.orderBy("e.Size").limit(1).select(F.substring_index("e.Key", ".", 1).alias("name"), F.floor(F.col("e.Size") / 1048576).cast("long").alias("size_mb"))
