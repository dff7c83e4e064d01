"""Confidence from repeated recognition: each chunk of audio is recognised several times, apart, and the trials vote on its tokens."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions import audio
from murmur.functions.models import FRAME, Models, cut_point
from murmur.options import PipelineOptions
from murmur.plans.recordings import by_file

CHUNK = ["path", "channel", "msg_no"]


def chunks(files: DataFrame, options: PipelineOptions = PipelineOptions(), models: Models = Models(), rate: int = audio.RATE) -> DataFrame:
    """(path, channel, msg_no, offset_ms, payload): the channels of audio files in chunks of ``max_chunk_ms``, cut at the last pause,
    as 16-bit samples. Files that can't be read give none."""
    size = options.max_chunk_ms * rate // 1000

    def of(found: list[np.ndarray]) -> Iterator[tuple]:
        voice = models.built("voice")
        for n, left in enumerate(found, 1):
            number, begun = 0, 0
            while len(left):
                cut = len(left) if len(left) <= size else max(FRAME, cut_point(left[:size], rate, voice))
                yield f"channel_{n}", number, begun * 1000 // rate, audio.to_pcm16(left[:cut])
                left, number, begun = left[cut:], number + 1, begun + cut

    return by_file(files, of, "path string, channel string, msg_no long, offset_ms long, payload binary", options.make_mono, rate)


def trial_tokens(found: DataFrame, n_trials: int, models: Models = Models(), rate: int = audio.RATE) -> DataFrame:
    """(path, channel, msg_no, offset_ms, trial, pos, token, ts_ms) of ``n_trials`` recognitions of each chunk, from trial 1; ts_ms
    counts from the chunk's start.

    Every (chunk, trial) is a row of its own and goes to a task by its hash, so trials of one chunk run apart. A recogniser
    that draws has a method ``trial`` (samples, rate, number) and draws from the number, so a task that runs again gives the same
    tokens. A trial that fails is one row without a token.
    """
    dealt = found.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(n_trials)))).repartition(*CHUNK, "trial")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = models.built("recogniser")
        for part in parts:
            rows = []
            for row in part.itertuples(index=False):
                samples, name = audio.to_float(bytes(row.payload), 2), (row.path, row.channel, row.msg_no, row.offset_ms, row.trial)
                try:
                    result = model.trial(samples, rate, row.trial) if hasattr(model, "trial") else model(samples, rate)
                    rows += [(*name, k, t, round(s * 1000)) for k, (t, s) in enumerate(zip(result["tokens"], result["timestamps"]))]
                except Exception:  # a model's errors are of any kind
                    rows.append((*name, None, None, None))
            yield pd.DataFrame(rows, columns=[*CHUNK, "offset_ms", "trial", "pos", "token", "ts_ms"]).astype({"pos": "Int64", "ts_ms": "Int64"})

    return dealt.mapInPandas(run, "path string, channel string, msg_no long, offset_ms long, trial int, pos long, token string, ts_ms long")


def confident_tokens(files: DataFrame, n_trials: int = 3, tolerance_ms: int = 500, options: PipelineOptions = PipelineOptions(), models: Models = Models(), rate: int = audio.RATE) -> DataFrame:
    """(path, channel, msg_no, token, ts_ms, votes, conf): the tokens of audio files and the share of trials that heard them.

    A token's place is its time in its chunk, rounded half to even to ``tolerance_ms``; ts_ms adds the chunk's start. conf is
    votes over ``n_trials``, to four places: trials without tokens, and those that failed, count against. One plan: chunks,
    trials and votes; a chunk without tokens gives no row.
    """
    heard = trial_tokens(chunks(files, options, models, rate), n_trials, models, rate).filter("token IS NOT NULL")
    place = (F.bround(F.col("ts_ms") / tolerance_ms) * tolerance_ms).cast("long")
    votes = heard.groupBy(*CHUNK, "offset_ms", "token", place.alias("place")).agg(F.count("*").alias("votes"))
    return votes.select(*CHUNK, "token", (F.col("offset_ms") + F.col("place")).alias("ts_ms"), "votes", F.round(F.col("votes") / n_trials, 4).alias("conf"))
