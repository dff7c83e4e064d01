"""Nulls, repeated rows and empty tables in the transcript operators: no error, and the results that their texts state."""

from pyspark.sql import functions as F

from murmur.operators import diarize, sentences, timeline, tokens, vad

WORDS = "rec_id long, channel string, msg_no long, pos long, word string, start_ms long, end_ms long, speaker string"
ROWS = [
    (1, "a", 0, 0, "x", 0, 100, "s"), (1, "a", 0, 0, "x", 0, 100, "s"), (1, "a", 0, 1, None, 200, 300, None), (1, "a", 0, 2, "z", None, None, "t"), (1, "a", None, None, "y", 5, 9, "s"),
    (None, None, None, None, None, None, None, None), (None, "b", 1, 0, "w", 50, 40, None),
]


def test_words_with_nulls_and_repeats(spark):
    df = spark.createDataFrame(ROWS, WORDS)
    assert diarize.fill_nearest(df).count() == len(ROWS)
    assert diarize.speaker_runs(df).agg(F.sum("n_words")).first()[0] == sum(r[7] is not None for r in ROWS)
    assert diarize.replicas(df).agg(F.sum("n_words")).first()[0] == len(ROWS)
    assert diarize.word_groups(df).agg(F.sum("n_words")).first()[0] == len(ROWS)
    assert timeline.tumbling_chunks(df).agg(F.sum("n_words")).first()[0] == len(ROWS)
    cut = sentences.sentences(df)
    assert cut.agg(F.sum("n_words")).first()[0] == len(ROWS) and sentences.dialogue(cut).count() == 2
    segments = df.select("rec_id", F.col("pos").alias("seg_ord"), "start_ms", "end_ms", "speaker")
    assert diarize.merge_segments(segments).agg(F.sum("n_segments")).first()[0] == len(ROWS)
    assert diarize.without_overlap(segments).count() == len(ROWS) and diarize.long_enough(segments, 0).count() == 4
    assert diarize.subsegments(segments).count() == 3  # one is shorter than a frame


def test_tokens_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([r[:4] + (r[4], r[5]) for r in ROWS], "rec_id long, channel string, msg_no long, pos long, token string, ts_ms long")
    for of in (tokens.words_by_leading_space, tokens.words_by_gap, tokens.speech_rate, tokens.token_confidence, tokens.best_tokens):
        assert of(df).count() > 0 and of(df.limit(0)).count() == 0
    frames = spark.createDataFrame([(1, 0, 90), (1, 0, 90), (1, 1, None), (1, None, 5), (None, 0, 80), (None, 1, 1)], "rec_id long, frame_no long, prob long")
    for of in (vad.segments, vad.cut_points):
        assert of(frames).count() <= 2 and of(frames.limit(0)).count() == 0
    assert vad.padded(vad.segments(frames)).count() == vad.segments(frames).count()


def test_operators_over_empty_tables(spark):
    df = spark.createDataFrame([], WORDS)
    segments = df.select("rec_id", F.col("pos").alias("seg_ord"), "start_ms", "end_ms", "speaker")
    for out in (diarize.fill_nearest(df), diarize.speaker_runs(df), diarize.replicas(df), timeline.tumbling_chunks(df), sentences.dialogue(sentences.sentences(df)), diarize.merge_segments(segments), diarize.subsegments(segments)):
        assert out.count() == 0
