"""The transcript pipeline: words of a recording to its dialogue, as the options ask."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.models import Models
from murmur.operators import diarize, echo, sentences
from murmur.options import PipelineOptions
from murmur.plans.recordings import punctuated
from murmur.sources.scratch import materialise


def transcribe(words: DataFrame, options: PipelineOptions, segments: DataFrame | None = None, models: Models = Models()) -> dict[str, DataFrame]:
    """DataFrames by name: raw (unless dropped), diarized and sentences, where asked for.

    Stages that are not asked for are not in the plan; what several stages read is written once. Only recordings of
    one channel are diarized, the others keep their channels. Diarized words take the speaker's place as channel.
    Sentences get case and marks from the punctuation model if the options say so.
    """
    out: dict[str, DataFrame] = {}
    if options.do_echo_clearing:
        words = materialise(echo.without_echo_greedy(words, options.echo_delta_ms, options.echo_similarity), "words")
    spoken = words
    if options.do_diarization and segments is not None:
        guard = diarize.channel_guard(words).select(F.col("rec_id").alias("_rec"), "can_diarize")
        placed = words.join(guard, F.col("rec_id").eqNullSafe(F.col("_rec")), "left").drop("_rec")
        single = placed.filter("can_diarize").drop("can_diarize")
        assigned = materialise(diarize.fill_nearest(diarize.assign_speakers(single, segments, options.min_overlap)), "assigned")
        out["diarized"] = diarize.replicas(assigned, options.max_pause_ms)
        renamed = assigned.na.fill("unknown", ["speaker"]).drop("channel").withColumnRenamed("speaker", "channel")
        spoken = renamed.unionByName(placed.filter("can_diarize IS NULL OR NOT can_diarize").drop("can_diarize"))
    if options.do_dialogue:
        out["sentences"] = sentences.sentences(spoken, options.between_words_percentile, options.compat)
        if options.do_punctuation:
            out["sentences"] = punctuated(out["sentences"], models)
    if options.keep_raw or not options.do_dialogue:
        out["raw"] = words
    return out
