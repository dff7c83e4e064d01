"""From audio files to words: decode, chunk at pauses, recognise, and place the words in time."""

import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions import audio
from murmur.functions.labels import surface
from murmur.functions.models import FRAME, Models, cut_point, frame_probabilities, recognise, word_labels
from murmur.operators.tokens import words_by_gap
from murmur.options import PipelineOptions

TOKENS = "path string, channel string, msg_no long, pos long, token string, ts_ms long, ok boolean"


def by_file(files: DataFrame, of, schema: str, mono: bool = False, rate: int = audio.RATE) -> DataFrame:
    """The rows (path, then what ``of`` yields for the samples of the file's channels) of WAV files (path, content).
    A file is decoded and worked on in one task, so no samples are exchanged; files that can't be read give no rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                try:
                    found = audio.channels(content, mono, rate)
                except (wave.Error, EOFError, ValueError):
                    continue
                yield pd.DataFrame([(path, *row) for row in of(found)], columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def tokens(files: DataFrame, options: PipelineOptions, models: Models = Models(), rate: int = audio.RATE) -> DataFrame:
    """Tokens of WAV files (path, content), in milliseconds from a file's start.

    A file is a task's unit, as a multiplier that one chunk asks for holds in all later ones and channels. Chunks
    are ``max_chunk_ms`` long and cut at the last pause; what lies behind the cut goes before the next. A chunk
    that can't be recognised is one row without a token and doesn't move the time on.
    """
    size = options.max_chunk_ms * rate // 1000

    def of(found: list[np.ndarray]) -> Iterator[tuple]:
        model, voice, multiplier = models.built("recogniser"), models.built("voice"), options.speed_multiplier
        for n, left in enumerate(found, 1):
            chunk_no, offset = 0, 0
            while len(left):
                cut = len(left) if len(left) <= size else max(FRAME, cut_point(left[:size], rate, voice))
                chunk, left = left[:cut], left[cut:]
                try:
                    result, multiplier = recognise(model, chunk, rate, multiplier, options.do_speed_correction)
                    yield from ((f"channel_{n}", chunk_no, k, t, offset + round(s * 1000), True) for k, (t, s) in enumerate(zip(result["tokens"], result["timestamps"])))
                    offset += cut * 1000 // rate
                except Exception:  # a model's errors are of any kind
                    yield f"channel_{n}", chunk_no, None, None, None, False
                chunk_no += 1

    return by_file(files, of, TOKENS, options.make_mono, rate)


def words(files: DataFrame, options: PipelineOptions, models: Models = Models(), rate: int = audio.RATE) -> DataFrame:
    """Words (rec_id, channel, msg_no, pos, word, start_ms, end_ms) of WAV files; rec_id is the path's hash."""
    found = tokens(files, options, models, rate).filter("ok").withColumn("rec_id", F.xxhash64("path"))
    out = words_by_gap(found.select("rec_id", "channel", "msg_no", "pos", "token", "ts_ms"))
    return out.withColumnRenamed("word_no", "pos").select("rec_id", "channel", "msg_no", "pos", "word", "start_ms", "end_ms")


def successes(files: DataFrame, options: PipelineOptions, models: Models = Models()) -> DataFrame:
    """Whether at least one chunk of a file was recognised."""
    return tokens(files, options, models).groupBy("path").agg(F.max("ok").alias("success"))


def speech(files: DataFrame, models: Models = Models(), rate: int = audio.RATE) -> DataFrame:
    """Frames (rec_id, channel, frame_no, prob in hundredths) of WAV files, each channel in its order."""

    def of(found: list[np.ndarray]) -> Iterator[tuple]:
        for n, samples in enumerate(found, 1):
            prob = frame_probabilities(models, samples)
            yield from ((f"channel_{n}", k, p) for k, p in enumerate(np.floor(prob * 100).astype(int).tolist()))

    found = by_file(files, of, "path string, channel string, frame_no long, prob long", rate=rate)
    return found.select(F.xxhash64("path", "channel").alias("rec_id"), "channel", "frame_no", "prob")


def punctuated(sentences: DataFrame, models: Models = Models()) -> DataFrame:
    """Sentences with case and marks from the punctuation model; a sentence without words stays as it is."""
    parts = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    labelled = sentences.withColumn("_words", parts).withColumn("_labels", word_labels(models, F.col("_words")))
    marked = F.transform(F.arrays_zip("_words", "_labels"), lambda x: surface(x["_words"], x["_labels"]))
    return labelled.withColumn("text", F.when(F.size("_words") > 0, F.array_join(marked, " ")).otherwise(F.col("text"))).drop("_words", "_labels")
