"""From audio files to speaker segments: voice, windows, features, vectors, clusters, and segments merged again."""

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions import audio
from murmur.functions.models import Models, batches
from murmur.operators import diarize, embeddings, vad
from murmur.options import PipelineOptions
from murmur.plans import recordings
from murmur.sources.scratch import materialise

FRAME_MS, WINDOW = 10, 150
VECTORS = "rec_id long, vec_id long, start_ms long, end_ms long, embedding array<double>"


def speech_windows(files: DataFrame, models: Models = Models(), rate: int = audio.RATE) -> DataFrame:
    """(rec_id, seg_ord, start_ms, end_ms, first_frame, n_real, ...): sliding windows over the speech of WAV files."""
    segments = vad.padded(vad.segments(recordings.speech(files, models, rate)))
    in_ms = segments.select("rec_id", F.col("seg_no").alias("seg_ord"), *(F.floor(F.col(c) * 1000 / rate).cast("long").alias(f"{c}_ms") for c in ("start", "end")))
    return diarize.subsegments(diarize.long_enough(in_ms), WINDOW, frame_ms=FRAME_MS)


def speaker_vectors(files: DataFrame, models: Models = Models(), rate: int = audio.RATE) -> DataFrame:
    """A vector for each window of speech of WAV files with one channel; what a window lacks it repeats from its
    start. A file's windows, no more than its length allows, go to the file, and its audio is cut in one task, which gathers
    the windows of its files into batches of the model (see ``batches``)."""
    windows = speech_windows(files, models, rate).select("rec_id", (F.col("start_ms") + F.col("first_frame") * FRAME_MS).alias("start_ms"), (F.col("n_real") * FRAME_MS).alias("length"))
    wanted = windows.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "length"))).alias("windows"))
    single = files.select(F.xxhash64("path", F.lit("channel_1")).alias("rec_id"), "content").join(wanted, "rec_id")

    size = WINDOW * FRAME_MS * rate // 1000

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, np.ndarray | None]]:
        for part in parts:
            for rec_id, content, cuts in part[["rec_id", "content", "windows"]].itertuples(index=False):
                found = audio.channels(content, rate=rate)
                if len(found) != 1:
                    continue
                voice = audio.high_pass(found[0], rate=rate)
                for k, c in enumerate(cuts):
                    x = voice[c["start_ms"] * rate // 1000 :][: max(1, c["length"] * rate // 1000)]
                    yield (rec_id, k, c["start_ms"], c["start_ms"] + c["length"]), audio.fbank(np.resize(x, size), rate) if len(x) else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = ((*name, v) for name, v in batches(models, features(parts)) if v is not None)
        while rows := list(islice(made, 1024)):
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in VECTORS.split(", ")])

    return single.mapInPandas(run, VECTORS)


def speaker_segments(files: DataFrame, options: PipelineOptions = PipelineOptions(), models: Models = Models(), rate: int = audio.RATE, gap_ms: int = 1000) -> DataFrame:
    """(rec_id, seg_ord, start_ms, end_ms, speaker) of WAV files with one channel; rec_id is that of ``speech``.

    The windows' vectors are clustered by recording, into ``num_speakers`` where the options name at least two. A
    window speaks for the time up to the start of the next one that overlaps it; neighbours of one speaker are
    merged. Files that can't be read, have several channels or no speech give no segments.
    """
    found = materialise(speaker_vectors(files, models, rate), "vectors")
    labels = embeddings.cluster_speakers(found, "rec_id", num_speakers=options.num_speakers).select("rec_id", "vec_id", F.col("speaker").cast("string").alias("speaker"))
    placed = found.drop("embedding").join(labels, ["rec_id", "vec_id"]).withColumnRenamed("vec_id", "seg_ord")
    merged = diarize.merge_segments(diarize.without_overlap(placed), gap_ms)
    return merged.select("rec_id", F.col("merged_no").alias("seg_ord"), "start_ms", "end_ms", "speaker")
