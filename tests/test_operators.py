"""Operators against small restatements of their rules."""

import io
import json
import random
import wave
from collections import Counter
from datetime import datetime
from difflib import SequenceMatcher

import numpy as np
import pytest

from murmur.functions import audio, labels, models, text
from murmur.operators import diarize, echo, embeddings, sentences, tokens, vad
from murmur.options import FOLDER, UPLOAD, URL, PipelineOptions, from_environment
from murmur.sources import files, sinks
from murmur.streaming import session
from pyspark.sql import functions as F

WORDS = "rec_id long, channel string, msg_no long, pos long, word string, start_ms long, end_ms long"


def words_df(spark, rows):
    return spark.createDataFrame(rows, WORDS)


def test_vad_segments_follow_the_state_machine(spark):
    r, rows, expected = random.Random(3), [], []
    for rec in range(40):
        probs, p = [], 0
        while len(probs) < 300:
            p = r.choice([10, 20, 40, 60, 90, 36])
            probs += [p] * r.choice([1, 2, 5, 20, 40])
        rows += [(rec, k, p) for k, p in enumerate(probs)]
        start = stop = None
        found = []
        for k, p in enumerate(probs):
            at = k * 512
            if p >= 50 and stop is not None:
                stop = None
            if p >= 50 and start is None:
                start = at
                continue
            if p < 35 and start is not None:
                stop = at if stop is None else stop
                if at - stop >= 16000:
                    if stop - start > 2400:
                        found.append((rec, start, stop))
                    start = stop = None
        if start is not None and len(probs) * 512 - start > 2400:
            found.append((rec, start, len(probs) * 512))
        expected += found
    got = vad.segments(spark.createDataFrame(rows, "rec_id long, frame_no long, prob long"))
    assert sorted((x["rec_id"], x["start"], x["end"]) for x in got.collect()) == sorted(expected)


def test_cut_point_scans_backwards(spark):
    r, rows, expected = random.Random(5), [], {}
    for rec in range(30):
        probs = []
        while len(probs) < 200:
            probs += [r.choice([10, 90])] * r.choice([3, 10, 14, 15, 16])
        rows += [(rec, k, p) for k, p in enumerate(probs)]
        silent, cut = 0, len(probs) // 3
        for k in range(len(probs) - 1, len(probs) // 3 - 1, -1):
            silent = silent + 1 if probs[k] < 50 else 0
            if silent == 15:
                cut = k
                break
        expected[rec] = cut
    got = vad.cut_points(spark.createDataFrame(rows, "rec_id long, frame_no long, prob long"))
    assert {x["rec_id"]: x["cut_frame"] for x in got.collect()} == expected


def greedy(spark, spoken):
    """What is left of words (channel, msg_no, word, end_ms), each in its channel's order."""
    rows = [(1, channel, msg_no, pos, word, end - 100, end) for pos, (channel, msg_no, word, end) in enumerate(spoken)]
    return sorted((x["channel"], x["end_ms"]) for x in echo.without_echo_greedy(words_df(spark, rows)).collect())


@pytest.mark.parametrize(
    "spoken, left",
    [
        # equal ends leave both
        ([("a", 0, "yes", 500), ("b", 0, "yes", 500)], [("a", 500), ("b", 500)]),
        # a chain: the first channel's later word has lost what it echoed, so it stays
        ([("a", 0, "yes", 100), ("a", 0, "yes", 1300), ("b", 0, "yes", 600)], [("a", 100), ("a", 1300)]),
        # the later one of a pair goes, from whichever channel
        ([("a", 0, "hello", 900), ("b", 0, "helo", 100)], [("b", 100)]),
        # too far apart, or too different
        ([("a", 0, "hello", 100), ("b", 0, "hello", 1001)], [("a", 100), ("b", 1001)]),
        ([("a", 0, "hello", 100), ("b", 0, "other", 500)], [("a", 100), ("b", 500)]),
        # the word behind a removed one is passed over, and as likeness depends on the order it may stay in its own turn
        ([("a", 0, "tide", 100), ("b", 0, "tide", 300), ("b", 0, "tide", 500)], [("a", 100)]),
        ([("a", 0, "abcabcab", 100), ("b", 0, "abcabcab", 300), ("b", 1, "abcabcab", 500)], [("a", 100)]),
    ],
)
def test_greedy_echo_by_hand(spark, spoken, left):
    assert greedy(spark, spoken) == left


def test_greedy_echo_drops_only_echoes(spark):
    r, rows = random.Random(7), []
    for rec in range(20):
        for ch in "abc":
            t = 0
            for pos in range(30):
                t += r.choice([200, 400, 1500])
                rows.append((rec, ch, pos // 7, pos, r.choice(["hello", "helo", "yes", "no", "maybe"]), t - 100, t))
    rows += [(3, "a", 9, 99, None, 0, 10), (3, "b", 9, 99, "yes", None, None), (4, "a", 9, 99, "twice", 0, 10), (4, "a", 9, 99, "twice", 0, 10)]
    got = [tuple(x) for x in echo.without_echo_greedy(words_df(spark, rows)).collect()]
    gone = Counter(rows) - Counter(got)
    assert not Counter(got) - Counter(rows) and 20 < sum(gone.values()) < len(rows) / 2
    for rec, ch, _, _, word, _, end in gone:  # what fell was alike to an earlier word of another channel
        assert any(o[0] == rec and o[1] != ch and o[6] is not None and 0 < end - o[6] <= 900 and max(SequenceMatcher(None, word, o[4]).ratio(), SequenceMatcher(None, o[4], word).ratio()) >= 0.8 for o in rows)
    assert all(x in got for x in rows if None in x or x[4] == "twice")


def test_similar_echo_uses_the_ratio(spark):
    rows = [(1, "a", 0, 0, "hello", 0, 500), (1, "b", 0, 0, "hallo", 400, 900), (1, "b", 0, 1, "other", 900, 1200), (1, "c", 0, 0, "hello", 1300, 1401)]
    got = echo.without_echo(words_df(spark, rows), similarity=0.8)
    assert sorted((x["channel"], x["word"]) for x in got.collect()) == [("a", "hello"), ("b", "other")]


def test_leading_space_tokens(spark):
    rows = [(1, "a", 0, k, t, ts) for k, (t, ts) in enumerate(zip(["да", " ", " ", "нет", " "], [640, 800, 900, 1000, 1100]))]
    df = spark.createDataFrame(rows, "rec_id long, channel string, msg_no long, pos long, token string, ts_ms long")
    compat = sorted((x["word_no"], x["word"], x["start_ms"], x["end_ms"]) for x in tokens.words_by_leading_space(df, compat=True).collect())
    assert compat == [(0, "да", 0, 640), (1, "", 800, 800), (2, "нет", 900, 1000), (3, "", 1100, 1100)]
    assert sorted(x["word"] for x in tokens.words_by_leading_space(df).collect()) == ["да", "нет"]


def test_sentence_start_at_zero(spark):
    rows = [(1, "a", 0, k, w, s, e) for k, (w, s, e) in enumerate([("a", 0, 400), ("b", 500, 900), ("c", 1000, 1200), ("d", 9000, 9200)])]
    plain = sorted((x["start_ms"], x["end_ms"], x["text"]) for x in sentences.sentences(words_df(spark, rows)).collect())
    assert plain == [(0, 1200, "a b c"), (9000, 9200, "d")]
    compat = sorted((x["start_ms"], x["text"]) for x in sentences.sentences(words_df(spark, rows), compat=True).collect())
    assert compat == [(500, "a b c"), (9000, "d")]


def test_single_word_is_a_sentence(spark):
    got = sentences.sentences(words_df(spark, [(1, "a", 0, 0, "x", 5, 9)])).collect()
    assert [(x["text"], x["n_words"]) for x in got] == [("x", 1)]


def test_replicas_at_exactly_the_pause(spark):
    rows = [(1, "a", 0, 0, "x", 0, 100, "s"), (1, "a", 0, 1, "y", 2100, 2200, "s"), (1, "a", 0, 2, "z", 4201, 4300, "s")]
    df = spark.createDataFrame(rows, WORDS + ", speaker string")
    assert sorted(x["text"] for x in diarize.replicas(df).collect()) == ["x y", "z"]


def test_nearest_fill_tie_takes_the_next_run(spark):
    rows = [(1, "a", 0, 0, "x", 0, 100, "s1"), (1, "a", 0, 1, "y", 200, 300, None), (1, "a", 0, 2, "z", 400, 500, "s2")]
    df = spark.createDataFrame(rows, WORDS + ", speaker string")
    assert {x["word"]: x["speaker"] for x in diarize.fill_nearest(df).collect()}["y"] == "s2"


def test_zero_length_words_lie_in_half_open_segments(spark):
    words = words_df(spark, [(1, "a", 0, 0, "x", 100, 100), (1, "a", 0, 1, "y", 200, 200)])
    segments = spark.createDataFrame([(1, 0, 100, 200, "s1")], "rec_id long, seg_ord long, start_ms long, end_ms long, speaker string")
    assert {x["word"]: x["speaker"] for x in diarize.assign_speakers(words, segments).collect()} == {"x": "s1", "y": None}


def test_words_across_stretches_count_once(spark):
    words = words_df(spark, [(1, "a", 0, 0, "x", 29_900, 60_100)])
    segments = spark.createDataFrame([(1, 0, 0, 70_000, "s1"), (1, 1, 29_900, 60_100, "s2")], "rec_id long, seg_ord long, start_ms long, end_ms long, speaker string")
    assert [x["speaker"] for x in diarize.assign_speakers(words, segments).collect()] == ["s1"]


def test_every_word_stays_when_speakers_are_assigned(spark):
    words = words_df(spark, [(1, "a", 0, 0, "x", 0, 100), (1, "a", 0, 0, "x", 0, 100), (1, "a", 0, 1, "y", None, None), (None, "a", 0, 2, "z", 0, 10), (2, "a", 0, 0, "no segments", 0, 10)])
    segments = spark.createDataFrame([(1, 0, 0, 200, "s1"), (1, 1, None, 5, "s2"), (1, 2, 0, 200, "s3")], "rec_id long, seg_ord long, start_ms long, end_ms long, speaker string")
    got = diarize.assign_speakers(words, segments)
    assert Counter((x["word"], x["speaker"]) for x in got.collect()) == {("x", "s1"): 2, ("y", None): 1, ("z", None): 1, ("no segments", None): 1}
    assert diarize.fill_nearest(got).count() == 5
    assert diarize.assign_speakers(words, segments.limit(0)).filter("speaker IS NULL").count() == 5 and diarize.assign_speakers(words.limit(0), segments).count() == 0


def test_speakers_of_intervals_of_any_length(spark):
    r = random.Random(9)
    far = lambda: r.choice([5, 300, 40_000, 200_000, 10**7, 10**13])
    words = [(r.randrange(3), "a", 0, k, f"w{k}", a := r.randrange(-50_000, 300_000), a + r.choice([0, 1, far(), r.randrange(60_000)])) for k in range(300)]
    segments = [(r.randrange(3), k, a := r.randrange(-50_000, 300_000), a + r.choice([0, far(), r.randrange(90_000)]), f"s{k % 4}") for k in range(120)]
    got = {x["word"]: x["speaker"] for x in diarize.assign_speakers(words_df(spark, words).withColumns({"rec": F.lit(1), "w_start": F.lit(2), "speaker": F.lit("old")}), spark.createDataFrame(segments, "rec_id long, seg_ord long, start_ms long, end_ms long, speaker string")).collect()}
    for rec, _, _, _, word, a, b in words:
        found = []
        for other, k, c, d, speaker in segments:
            shared = min(b, d) - max(a, c) if a < b else int(c <= a < d)
            if other == rec and shared > 0 and (a == b or shared / (b - a) >= 0.5):
                found.append((-shared, c, k, speaker))
        assert got[word] == (min(found)[3] if found else None)


def test_chained_merges_are_those_of_the_nearest_pairs():
    r = np.random.default_rng(6)
    for n, k in ((2, 1), (7, 3), (40, 5), (40, 1)):
        x = r.normal(0, 1, (n, 6))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        groups = [[i] for i in range(n)]
        while len(groups) > k:
            far = {(a, b): np.mean([1 - unit[i] @ unit[j] for i in groups[a] for j in groups[b]]) for b in range(len(groups)) for a in range(b)}
            a, b = min(far, key=far.get)
            groups[a] += groups.pop(b)
        labels = embeddings.average_linkage(x, k)
        assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(labels == v).tolist()) for v in set(labels.tolist())}


def test_cyclic_repeats_short_windows(spark):
    got = spark.range(1).select(diarize.cyclic(F.array(F.lit(1), F.lit(2)), 5).alias("v")).first()["v"]
    assert got == [1, 2, 1, 2, 1]


def test_clusters_of_clear_speakers(spark):
    r = np.random.default_rng(1)
    base = np.eye(3, 8)
    rows = [(1, k, (base[k % 3] + r.normal(0, 0.05, 8)).tolist()) for k in range(30)] + [(2, 100 + k, base[k].tolist()) for k in range(2)]
    got = embeddings.cluster_speakers(spark.createDataFrame(rows, "rec long, vec_id long, embedding array<double>"), "rec", num_speakers=3).collect()
    of = {x["vec_id"]: x["speaker"] for x in got if x["rec"] == 1}
    assert len(set(of.values())) == 3 and all(of[k] == of[k % 3] for k in range(30))
    assert {x["speaker"] for x in got if x["rec"] == 2} == {0}


def test_labels(spark):
    got = spark.createDataFrame([("иван", k) for k in (-100, 0, 1, 2, 5, 8, 9, 12, 13)], "w string, k int").select("k", labels.surface(F.col("w"), F.col("k")).alias("s"), labels.label_name(F.col("k")).alias("n")).collect()
    assert {x["k"]: x["s"] for x in got} == {-100: "иван", 0: "иван", 1: "иван", 2: "иван.", 5: "Иван", 8: "Иван?", 9: "ИВАН", 12: "ИВАН?", 13: "иван"}
    assert {x["k"]: x["n"] for x in got}[12] == "UPPER_TOTAL_QUESTION"


def test_sizes_and_paths(spark):
    df = spark.createDataFrame([("/in/a/b.c.mp3", 1536), ("/in/x", 3)], "p string, n long")
    got = df.select(text.suffix(F.col("p")).alias("s"), text.size_text(F.col("n")).alias("t"), sinks.result_path(F.col("p"), "/in", "/out", ".json").alias("r")).collect()
    assert [tuple(x) for x in got] == [(".mp3", "1.50 KB", "/out/a/b.c.json"), ("", "3.00 B", "/out/x.json")]


def tone(seconds, rate=16000, level=0.5):
    return (level * np.sin(np.arange(int(seconds * rate)) * 0.05)).astype(np.float32)


def test_wav_files_are_decoded_by_channel(spark, tmp_path):
    (tmp_path / "in").mkdir()
    left, right = tone(6), tone(6, level=0.1)
    (tmp_path / "in/a.wav").write_bytes(audio.write_wav([left, right]))
    (tmp_path / "in/b.wav").write_bytes(b"RIFFnothing")
    (tmp_path / "in/c.txt").write_bytes(b"no audio")
    found = files.recordings(spark, str(tmp_path / "in"))
    header = found.filter("path LIKE '%a.wav'").select(*(c.alias(k) for k, c in audio.wav_header().items())).first()
    assert (header["is_wav"], header["n_channels"], header["sample_rate"], header["bits"]) == (True, 2, 16000, 16)
    got = audio.decode(found).collect()
    assert sorted(str(x["channel"]) for x in got) == ["None", "channel_1", "channel_2"]
    samples = {x["channel"]: np.array(x["samples"]) for x in got if x["channel"]}
    assert np.abs(samples["channel_1"] - left).max() < 1e-3
    mono = [x for x in audio.decode(found, mono=True).collect() if x["channel"]]
    assert np.abs(np.array(mono[0]["samples"]) - (left + right) / 2).max() < 1e-3


def test_sample_kernels():
    x = tone(1)
    assert np.abs(audio.to_float(audio.to_pcm16(x), 2) - x).max() < 1e-4
    assert len(audio.resample(x, 16000, 8000)) == 8000 and len(audio.stretch(x, 0.8)) == 20000
    sine = lambda hz, n, rate=16000: (0.5 * np.sin(2 * np.pi * hz * np.arange(n) / rate)).astype(np.float32)
    for to in (8000, 22_050, 44_100):
        y = audio.resample(sine(3000, 16_000), 16_000, to)
        assert len(y) == to and np.abs(y - sine(3000, to, to))[300:-300].max() < 1e-3
    assert np.abs(audio.resample(sine(7000, 16_000), 16_000, 8000))[300:-300].max() < 1e-3  # nothing folds back
    assert np.abs(audio.stretch(sine(440, 16_000), 0.8) - sine(440, 20_000, 16_000 * 19_999 / 15_999)).max() < 1e-2
    level = {hz: np.abs(audio.high_pass(sine(hz, 48_000))[24_000:]).max() / 0.5 for hz in (10, 50, 440)}
    assert level[10] < 1e-3 and abs(level[50] - 0.5**0.5) < 1e-2 and abs(level[440] - 1) < 1e-3
    assert np.abs(audio.high_pass(np.eye(1, 4000, 1000, dtype=np.float32)[0])[:1000]).max() < 1e-6  # nothing before its cause
    assert all(len(f(np.zeros(0, np.float32))) == 0 for f in (lambda v: audio.resample(v, 8000), lambda v: audio.stretch(v, 0.5), audio.high_pass))
    assert audio.fbank(x).shape == (98, 80)
    with pytest.raises(ValueError):
        audio.to_float(b"abc", 3)
    with pytest.raises(ValueError):
        audio.to_pcm16(np.array([np.nan]))
    with pytest.raises(ValueError):
        audio.stretch(x, 1.5)


def test_options():
    assert URL.do_echo_clearing and not UPLOAD.do_speed_correction and FOLDER.do_dialogue
    assert PipelineOptions().using(compat=True).compat
    with pytest.raises(ValueError):
        PipelineOptions(speed_multiplier=2)
    assert from_environment({"MURMUR_DO_DIALOGUE": "1", "MURMUR_NUM_SPEAKERS": "3", "MURMUR_ECHO_SIMILARITY": "0.9", "OTHER": "x"}) == PipelineOptions(do_dialogue=True, num_speakers=3, echo_similarity=0.9)
    with pytest.raises(ValueError):
        from_environment({"MURMUR_NUM_SPEAKERS": "many"})


def stream_rows():
    rate = 800
    rows = []
    for s in ("x", "y"):
        rows.append((s, 0, "config", json.dumps({"config": {"sample_rate": rate}}).encode()))
        for k in range(1, 25):
            level = 0.4 if k % 3 else 0.0
            rows.append((s, k, "bytes", audio.to_pcm16(np.full(2 * rate, level))))
        rows.append((s, 99, "eof", None))
    return rows


def test_stream_gives_the_batch_results(spark, finished, tmp_path):
    schema = "session_id string, seq long, kind string, payload binary"
    rows = spark.createDataFrame(stream_rows(), schema)
    expected = session.batch_sessions(rows).collect()
    rows.repartition(3, "seq").write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = session.sessions(stream).writeStream.format("memory").queryName("results").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    finished(query, len(stream_rows()))
    assert sorted(map(tuple, spark.table("results").collect()), key=str) == sorted(map(tuple, expected), key=str)
    assert sum(x["last_message"] for x in expected) == 2 and sum(x["duration_ms"] for x in expected) == 2 * 48_000


def rows_of(options, pieces, session_id="s"):
    rows = [(session_id, 0, "config", json.dumps({"config": options}).encode())]
    return [*rows, *((session_id, k, "bytes", p) for k, p in enumerate(pieces, 1)), (session_id, 99, "eof", None)]


def run_session(rows, **options):
    s = session.Session(session.SessionOptions(**options))
    return [dict(zip(session._COLUMNS[1:], r)) for _, _, kind, payload in rows for r in s.take(kind, payload)]


def failing():
    def model(samples, rate):
        if np.abs(samples).max() > 0.9:
            raise RuntimeError("too loud")
        return {"tokens": list("hi you"), "timestamps": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]}

    return model


def test_a_session_with_models_ends_with_its_dialogue():
    quiet, loud = (audio.to_pcm16(np.full(800, x)) for x in (0.2, 0.95))
    rows = rows_of({"sample_rate": 800, "do_dialogue": True, "do_punctuation": True, "channelName": "guest"}, [quiet, loud, quiet])
    got = run_session(rows, max_ms=1000, models=models.Models(recogniser=failing))
    errors = [x for x in got if x["error"]]
    assert errors and all("too loud" in x["error"] and not x["text"] for x in errors)
    assert sum(x["last_message"] for x in got) == 1 and got[-1]["dialogue"].startswith("guest: Hi") and got[-1]["dialogue"].strip().endswith(".")
    assert [x["dialogue"] for x in got[:-1]] == [None] * (len(got) - 1)


def test_a_session_at_another_rate_is_resampled():
    tone_ = audio.to_pcm16(np.full(8000, 0.3))
    got = run_session(rows_of({"sample_rate": 8000, "wait_null_answers": True}, [tone_] * 3), rate=16_000)
    assert sum(x["duration_ms"] for x in got) == 3000 and got[-1]["last_message"]
    wide = np.full(8000, 0.3 * 2**31).astype("<i4").tobytes()
    assert run_session(rows_of({"sample_rate": 8000, "audio_format": "pcm32"}, [wide] * 3))[-1]["text"] == run_session(rows_of({"sample_rate": 8000}, [tone_] * 3))[-1]["text"]


def test_odd_messages_of_a_session():
    s = session.Session()
    assert [r[6] for r in s.take("config", b"[1")] and [r[6] for r in s.take("config", b'{"sample_rate": "x"}')] and [r[6] for r in s.take("config", b'{"audio_format": "mp3"}')]
    assert list(s.take("other", b"x")) == [] and len(list(s.take("eof", None))) == 1
    assert list(s.take("bytes", audio.to_pcm16(tone(40)))) == list(s.take("eof", None)) == []  # late rows give nothing


def test_messages_of_a_stream_are_sent(spark, finished, tmp_path):
    schema = "session_id string, seq long, kind string, payload binary"
    spark.createDataFrame(stream_rows(), schema).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = str(tmp_path)

    def send(texts):
        for text in texts:
            with open(f"{folder}/sent-{abs(hash(text))}", "w") as f:
                f.write(text)

    results = session.sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = sinks.send_each(results, send, checkpointLocation=str(tmp_path / "cp")).start()
    finished(query, len(stream_rows()))
    sent = [json.loads(p.read_text()) for p in tmp_path.glob("sent-*")]
    assert {x["channel_name"] for x in sent if x["last_message"]} == {"x", "y"}


def test_results_are_written_beside_their_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/in/a/b.mp3", "text é"), (f"{tmp_path}/in/c.wav", None), ("/elsewhere/d.ogg", "x")], "path string, body string")
    written = {x["path"].rsplit("/", 1)[1]: x["result"] for x in sinks.write_mirrored(rows, f"{tmp_path}/out", str(tmp_path / "in"), readable=True).collect()}
    assert written["b.mp3"].endswith("/out/a/b.md")
    assert (tmp_path / "out/a/b.md").read_text() == "text é" and (tmp_path / "out/c.md").read_text() == "" and (tmp_path / "out/d.md").read_text() == "x"
    assert len(list(tmp_path.glob("out/**/*.*"))) == 3


def test_protocols_have_a_date(spark):
    lines = spark.createDataFrame([(1, "a", 0, 0, "first"), (1, "b", 0, 5, "second")], "rec_id long, channel string, sentence_no long, start_ms long, line string")
    assert sinks.protocol(lines, F.lit(datetime(2024, 5, 6, 7, 8, 9))).first()["body"] == "**Дата:** 2024-05-06 07:08:09\n\nfirst\nsecond\n"


def test_watched_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(16000), f.writeframes(b"\0\0" * 10)
    (tmp_path / "in/a.wav").write_bytes(buffer.getvalue())
    (tmp_path / "in/b.doc").write_bytes(b"x")
    query = files.watched(spark, str(tmp_path / "in")).select("path", "length").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [x["path"].rsplit("/", 1)[1] for x in spark.table("seen").collect()] == ["a.wav"]
