"""Streams with a memory of what they did: results written once, sources deleted when theirs is there, and a table of progress."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from murmur.sources.scratch import qualified
from murmur.sources.sinks import write_mirrored

LEDGER = "path string, result string, error string"
STATUS = "query string, name string, run string, batch long, at timestamp, rows long, duration_ms long, open_sessions long, state_bytes long, error string, ended boolean"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, path, result, error) of all files that a stream of ``write_results`` has worked on."""
    return spark.read.schema(f"{LEDGER}, batch long").option("basePath", folder).parquet(f"{folder}/batch=*") if _there(spark, folder) else spark.createDataFrame([], f"{LEDGER}, batch long")


def delete_sources(done: DataFrame) -> None:
    """Delete the files of rows (path) in the tasks; files that are gone already are no error."""
    spark = done.sparkSession
    scheme = qualified(spark, "/").rstrip("/")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                fs, at = FileSystem.from_uri(path if ":" in path.split("/")[0] else scheme + path)
                try:
                    fs.delete_file(at)
                except FileNotFoundError:
                    pass
            yield part

    done.select("path").mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()


def write_results(files: DataFrame, of: Callable[[DataFrame], DataFrame], folder: str, source: str, notes: str, readable: bool = False, delete: bool = False, **options) -> StreamingQuery:
    """Start a stream that works on files (path, content, ...) as ``of`` says, which gives (path, body, error), and writes each body to
    ``folder`` as ``write_mirrored`` does. Rows with an error or without a body write nothing.

    A batch's paths, results and errors are noted in ``notes`` by its number once all results are there. A batch that
    runs again, after a restart, is known by its note and isn't worked on again; one that was lost before its note writes the
    same files over. With ``delete``, the sources of results are deleted after the note, so a file that failed stays, and a
    deletion that was lost is made up for. A file that ``of`` gives no row for is noted with an error. ``options`` are those
    of the stream's writer, which needs a checkpointLocation of its own.
    """

    def batch(found: DataFrame, number: int) -> None:
        spark, note = found.sparkSession, f"{notes}/batch={number}"
        if not _there(spark, f"{note}/_SUCCESS"):
            rows = of(found)
            good = rows.filter("error IS NULL AND body IS NOT NULL")
            written = write_mirrored(good, folder, source, readable).select(F.col("path").alias("_path"), "result")
            seen = found.select("path").distinct().join(written, F.col("path") == F.col("_path"), "left").drop("_path")
            errors = rows.filter("error IS NOT NULL OR body IS NULL").groupBy(F.col("path").alias("_path")).agg(F.coalesce(F.max("error"), F.lit("no result")).alias("error"))
            noted = seen.join(errors, F.col("path") == F.col("_path"), "left").select("path", "result", F.when(F.col("result").isNull(), F.coalesce("error", F.lit("no result"))).alias("error"))
            noted.write.mode("overwrite").parquet(note)
        if delete:
            delete_sources(spark.read.schema(LEDGER).parquet(note).filter("result IS NOT NULL"))

    writer = files.writeStream.foreachBatch(batch)
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer.start()


class Progress(StreamingQueryListener):
    """Notes the progress of the session's streams below a folder, a small file a batch; ``status`` reads them. Add it with
    ``spark.streams.addListener``. What a listener can't write is left out: a stream never fails for its notes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = qualified(spark, folder)

    def _note(self, name: str, row: dict) -> None:
        try:
            fs, at = FileSystem.from_uri(self.folder)
            fs.create_dir(at, recursive=True)
            with fs.open_output_stream(f"{at}/{name}.json") as f:
                f.write((json.dumps(row) + "\n").encode())
        except OSError:
            return

    def onQueryStarted(self, event) -> None:
        self._note(f"{event.runId}-begun", {"query": str(event.id), "name": event.name, "run": str(event.runId), "batch": -1, "at": event.timestamp, "ended": False})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = p.stateOperators
        self._note(f"{p.runId}-{p.batchId}", {
            "query": str(p.id), "name": p.name, "run": str(p.runId), "batch": p.batchId, "at": p.timestamp, "rows": p.numInputRows, "duration_ms": p.durationMs.get("triggerExecution"),
            "open_sessions": sum(s.numRowsTotal for s in state), "state_bytes": sum(s.memoryUsedBytes for s in state), "ended": False,
        })

    def onQueryIdle(self, event) -> None:
        return

    def onQueryTerminated(self, event) -> None:
        self._note(f"{event.runId}-ended", {"query": str(event.id), "run": str(event.runId), "batch": 1 << 62, "error": event.exception, "ended": True})


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """The notes of ``Progress``: a row a batch, and one for the start (batch -1) and the end of each run."""
    return spark.read.schema(STATUS).json(folder)


def status(spark: SparkSession, folder: str) -> DataFrame:
    """(query, name, run, state, batches, rows, last_at, last_duration_ms, open_sessions, error): how each query's latest run
    stands: ``failed`` or ``ended``, ``in_work`` while its last batch had rows, else ``idle``. No notes give no rows."""
    notes = progress(spark, folder)
    real = (F.col("batch") >= 0) & ~F.col("ended")
    runs = notes.groupBy("query", "run").agg(
        F.max("name").alias("name"), F.min("at").alias("_began"), F.count_if(real).alias("batches"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.max("at").alias("last_at"),
        F.max_by(F.struct("duration_ms", "open_sessions", "rows"), F.when(real, F.col("batch"))).alias("_last"), F.max("error").alias("error"), F.max("ended").alias("_ended"),
    )
    state = F.when(F.col("error").isNotNull(), "failed").when(F.col("_ended"), "ended").when(F.col("_last.rows") > 0, "in_work").otherwise("idle")
    latest = runs.withColumn("_nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("_began"), "run"))).filter("_nth = 1")
    return latest.select("query", "name", "run", state.alias("state"), "batches", "rows", "last_at", F.col("_last.duration_ms").alias("last_duration_ms"), F.coalesce("_last.open_sessions", F.lit(0)).alias("open_sessions"), "error")
