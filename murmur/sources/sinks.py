"""Results as JSON, as readable text, and as messages."""

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.text import with_suffix
from murmur.sources.scratch import qualified


def envelopes(sentences: DataFrame) -> DataFrame:
    """A JSON envelope per recording: success and its sentences by start, channel and number."""
    rows = F.array_sort(F.collect_list(F.struct("start_ms", "channel", "sentence_no", "end_ms", "text")))
    listed = F.transform(rows, lambda r: F.struct(r["start_ms"].alias("start"), r["end_ms"].alias("end"), r["text"].alias("text"), r["channel"].alias("speaker")))
    body = F.struct(F.lit(True).alias("success"), F.struct(F.struct(listed.alias("list_of_sentenced_recognitions")).alias("raw_data")).alias("result"))
    return sentences.groupBy("rec_id").agg(F.to_json(body).alias("json"))


def readable_lines(sentences: DataFrame) -> DataFrame:
    """Lines of a readable protocol: speaker and text where a recording has several channels, else the text."""
    n = sentences.groupBy("rec_id").agg(F.countDistinct("channel").alias("_n"))
    line = F.when(F.col("_n") > 1, F.concat(F.lit("Спикер_"), "channel", F.lit(": "), F.trim("text"))).otherwise(F.trim("text"))
    return sentences.join(n, "rec_id").select("rec_id", "channel", "sentence_no", "start_ms", line.alias("line"))


def message(channel: Column, text: Column, silence: Column, last: Column, error: Column | None = None, dialogue: Column | None = None) -> Column:
    """The JSON message of a stream's partial or last result."""
    null = F.lit(None).cast("string")
    return F.to_json(F.struct(channel.alias("channel_name"), silence.alias("silence"), text.alias("data"), (null if error is None else error).alias("error"), last.alias("last_message"), (null if dialogue is None else dialogue).alias("sentenced_data")))


def result_path(path: Column, source: str, target: str, extension: str) -> Column:
    """Where a file's result goes: the same relative path under ``target``, with another extension."""
    prefix = source.rstrip("/") + "/"
    relative = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(F.substring_index(path, "/", -1))
    return F.concat(F.lit(target.rstrip("/") + "/"), with_suffix(relative, extension))


def write_mirrored(results: DataFrame, folder: str, source: str, readable: bool = False) -> DataFrame:
    """Write one text file per row of results (path, body) to ``folder``, at the path it has below ``source``, as .md or
    .json; a file with a name of its own first, so that a lost task leaves none half written. Returns (path, result).

    A body that is null gives an empty file; rows of one path overwrite one another. The folder is on the file system
    that its scheme names, or on Spark's default one.
    """
    found = results.select("path", "body", result_path(F.col("path"), source, qualified(results.sparkSession, folder), ".md" if readable else ".json").alias("result"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for body, result in zip(part["body"], part["result"]):
                fs, at = FileSystem.from_uri(result)
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                own = f"{at}.{uuid.uuid4().hex}"
                with fs.open_output_stream(own, compression=None) as f:
                    f.write((body or "").encode())
                fs.move(own, at)
            yield part[["path", "result"]]

    return found.mapInPandas(run, "path string, result string")


def protocol(lines: DataFrame, at: Column | None = None) -> DataFrame:
    """(rec_id, body): a readable protocol per recording, its lines by start, channel and number under a header with
    the date and time ``at`` (now, if not given)."""
    header = F.concat(F.lit("**Дата:** "), F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd HH:mm:ss"), F.lit("\n\n"))
    rows = F.array_sort(F.collect_list(F.struct("start_ms", "channel", "sentence_no", "line")))
    body = F.concat(header, F.array_join(F.transform(rows, lambda r: F.concat(r["line"], F.lit("\n"))), ""))
    return lines.groupBy("rec_id").agg(body.alias("body"))


def send_each(results: DataFrame, send, **options):
    """Start a stream that hands every micro-batch's messages, as JSON, to ``send`` on the executors, which gets an
    iterator of texts for each partition. ``options`` are those of the stream's writer."""

    def batch(found: DataFrame, _: int) -> None:
        found.select(message(F.col("session_id"), F.col("text"), F.col("silence"), F.col("last_message"), F.col("error"), F.col("dialogue"))).foreachPartition(lambda rows: send(r[0] for r in rows))

    writer = results.writeStream.foreachBatch(batch)
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer


def write_json(envelopes_: DataFrame, folder: str) -> None:
    envelopes_.select("json").write.mode("overwrite").text(folder)
