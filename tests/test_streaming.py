"""Streams against whole files: packets of any size and order give the same samples, probabilities and results."""

import json
import random

import numpy as np
import pandas as pd
import pytest

from murmur.functions import audio, models
from murmur.plans import recordings
from murmur.streaming import session, voice

SCHEMA = "session_id string, seq long, kind string, payload binary"


def wave_of(seed, n):
    r = np.random.default_rng(seed)
    loud = np.repeat(r.choice([0.0, 0.02, 0.3], n // 4000 + 1), 4000)[:n]
    return (loud * np.sin(np.arange(n) * 0.2) + r.normal(0, 0.002, n)).astype(np.float32)


@pytest.mark.parametrize("rate,to", [(44_100, 16_000), (8_000, 16_000), (16_000, 8_000), (11_025, 16_000), (16_000, 16_000)])
@pytest.mark.parametrize("size", [1, 3, 100, 441])
def test_resampling_in_pieces(rate, to, size):
    x = wave_of(1, {1: 500, 3: 1500}.get(size, 12_345))
    resampler, out = audio.Resampler(rate, to), []
    for k in range(0, len(x), size):
        out.append(resampler.push(x[k : k + size]))
        resampler = audio.Resampler(rate, to, json.loads(json.dumps(resampler.state)))
    out.append(resampler.finish())
    assert np.array_equal(np.concatenate(out), audio.resample(x, rate, to))
    assert len(resampler.push(x)) and len(audio.Resampler(rate, to).finish()) == 0
    with pytest.raises(ValueError):
        audio.Resampler(0, to)


def packets(payload, sizes, seed=3):
    r, out, at = random.Random(seed), [], 0
    while at < len(payload):
        n = r.choice(sizes)
        out.append(payload[at : at + n])
        at += n
    return out


def rows_of(config, pieces, name="s"):
    return [(name, 0, "config", json.dumps({"config": config}).encode()), *((name, k, "bytes", p) for k, p in enumerate(pieces, 1)), (name, len(pieces) + 1, "eof", None)]


def run(rows, **options):
    s = session.Session(session.SessionOptions(**options))
    out = []
    for _, _, kind, payload in rows:
        out += list(s.take(kind, payload))
        s = session.Session(s.options, json.loads(json.dumps(s.state.__dict__)), s.buffer, s.words)
    return out


@pytest.mark.parametrize("sizes", [[1], [3], [100], [441, 7, 1000], [64_000]])
@pytest.mark.parametrize("form", ["pcm16", "pcm32"])
def test_packets_of_any_size_give_one_result(sizes, form):
    x = wave_of(5, {1: 800, 3: 2500}.get(sizes[0], 30_000))
    payload = audio.to_pcm16(x) if form == "pcm16" else (x * 2**31).astype("<i4").tobytes()
    config = {"sample_rate": 8000, "audio_format": form, "wait_null_answers": True}
    for rate in (None, 16_000):
        whole = run(rows_of(config, [payload]), rate=rate, max_ms=1500)
        got = run(rows_of(config, packets(payload, sizes)), rate=rate, max_ms=1500)
        assert sum(r[2] for r in got) == sum(r[2] for r in whole) == len(x) * 1000 // 8000
        if rate and form == "pcm16":  # the same samples, so the same words wherever the buffer is cut
            assert got[-1][5] and whole[-1][5]


class Counting:
    """A recurrent model that says how many frames it has heard."""

    def __call__(self, frame, state):
        n = 0.0 if state is None else float(state[0])
        return (n % 10) / 10 + min(0.05, float(np.abs(frame).mean())), np.array([n + 1])


@pytest.mark.parametrize("sizes", [[999], [64, 4096, 1], [1 << 20]])
def test_a_recurrent_model_hears_a_stream_as_a_file(sizes):
    x = wave_of(6, 20_000)
    pcm = audio.to_pcm16(x)
    for slots in ({"recurrent_voice": Counting}, {"recurrent_voice": lambda: models.leaky_loudness}, {}):
        m = models.Models(**slots)
        listener, got = voice.Listener(session.SessionOptions(models=m)), []
        for _, _, kind, payload in rows_of({"sample_rate": 16_000}, packets(pcm, sizes)):
            got += list(listener.take(kind, payload))
            listener = voice.Listener(listener.options, json.loads(json.dumps(listener.state.__dict__)), listener.buffer)
        want = models.frame_probabilities(m, audio.to_float(pcm, 2))
        assert [k for k, _ in got] == list(range(len(want))) and np.allclose([p for _, p in got], want)
        assert list(listener.take("bytes", pcm)) == []  # behind the end


def test_a_channel_begins_without_a_state():
    m = models.Models(recurrent_voice=Counting)
    pcm = audio.to_pcm16(np.zeros(512 * 3))
    listener = voice.Listener(session.SessionOptions(models=m))
    rows = [("config", b'{"channelName": "a"}'), ("bytes", pcm), ("config", b'{"channelName": "b"}'), ("bytes", pcm), ("config", b"[broken"), ("bytes", pcm[:7]), ("eof", None)]
    got = [f for kind, payload in rows for f in listener.take(kind, payload)]
    assert [round(p, 3) for _, p in got] == [0.0, 0.1, 0.2, 0.0, 0.1, 0.2, 0.3]


def test_sessions_are_cut_by_a_recurrent_model():
    x = np.concatenate([np.full(16_000, 0.4), np.zeros(12_000), np.full(16_000, 0.4)] * 3)
    m = models.Models(recurrent_voice=lambda: models.leaky_loudness)
    results = [run(rows_of({"sample_rate": 16_000, "wait_null_answers": True}, packets(audio.to_pcm16(x), sizes)), max_ms=2500, models=m) for sizes in ([1024], [333], [40_000])]
    assert all(sum(r[2] for r in found) == len(x) * 1000 // 16_000 for found in results)
    cuts = {tuple(r[1] for r in found) for found in results[:2]}
    assert len(cuts.pop()) >= 3


def test_files_in_a_stream():
    x = wave_of(8, 16_000)
    files = [audio.write_wav([x[:8000], x[:8000]], 16_000), b"no file", audio.write_wav([x[8000:]], 16_000)]
    got = run(rows_of({"sample_rate": 8000, "audio_format": "file", "wait_null_answers": True}, files), rate=8_000)
    assert sum(r[2] for r in got) == 1000 and sum("audio:" in (r[6] or "") for r in got) == 1


def start(spark, finished, rows, path, of, parts, seed=0):
    """A stream of the rows in shuffled files, one a micro-batch; the results that it gave."""
    r = random.Random(seed)
    rows = rows[:]
    r.shuffle(rows)
    (path / "in").mkdir(parents=True)
    for k in range(parts):
        pd.DataFrame(rows[k::parts], columns=["session_id", "seq", "kind", "payload"]).to_parquet(path / f"in/{k}.parquet")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    name = f"r{abs(hash(str(path)))}"
    query = of(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path / "cp")).start()
    finished(query, len(rows))
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def test_rows_of_later_batches_wait_for_earlier_ones(spark, finished, tmp_path):
    x = wave_of(9, 24_000)
    rows = [row for name in ("p", "q") for row in rows_of({"sample_rate": 8000, "wait_null_answers": True}, packets(audio.to_pcm16(x), [5000, 3001]), name)]
    rows.append(rows[1])  # a number that comes again
    options = session.SessionOptions(max_ms=1000, hold_ms=600_000)
    got = start(spark, finished, rows, tmp_path / "a", lambda s: session.sessions(s, options), 4)
    expected = session.batch_sessions(spark.createDataFrame(rows[:-1], SCHEMA), options).collect()
    assert got == sorted(map(tuple, expected), key=str) and sum(r[6] for r in got) == 2


class Waiting(dict):
    """A map state in memory."""

    def exists(self):
        return bool(self)

    def containsKey(self, key):
        return key in self

    getValue, removeKey, updateValue = dict.__getitem__, dict.__delitem__, dict.__setitem__


def test_a_gap_is_passed_over_when_its_time_is_up():
    held, options, state = session.InOrder(), session.SessionOptions(hold_ms=5), session.State()
    held.waiting = Waiting()
    frame = lambda *seqs: iter([pd.DataFrame([(s, "bytes", f"{s}".encode()) for s in seqs], columns=["seq", "kind", "payload"])])
    taken = lambda rows: [int(p) for _, p in rows]
    assert taken(held.rows_in_order(frame(2, 0), state, options)) == [0]
    assert held.again(100, options) == 105
    assert taken(held.rows_in_order(frame(5, 0, 4, 3), state, options)) == []
    assert taken(held.after_the_gap(state)) == [2, 3, 4, 5] and taken(held.after_the_gap(state)) == []
    assert held.again(100, options) == 100 + options.idle_ms
    assert taken(held.rows_in_order(frame(1, 6), state, options)) == [6]  # what was passed over comes too late


def test_voices_of_a_stream_and_of_its_file(spark, finished, tmp_path):
    x = wave_of(10, 16_000)
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.wav").write_bytes(audio.write_wav([x]))
    (tmp_path / "f/b.wav").write_bytes(audio.write_wav([x[::-1]]))
    m = models.Models(recurrent_voice=lambda: models.leaky_loudness)
    rows = [row for name, y in (("a", x), ("b", x[::-1])) for row in rows_of({"sample_rate": 16_000}, packets(audio.to_pcm16(np.append(y, np.zeros(80_000))), [7001, 20_000]), name)]
    options = session.SessionOptions(models=m, hold_ms=600_000)
    got = start(spark, finished, rows, tmp_path / "b", lambda s: voice.voices(s, options), 3, seed=1)
    assert got == sorted(map(tuple, voice.batch_voices(spark.createDataFrame(rows, SCHEMA), options).collect()), key=str)
    whole = recordings.speech(spark.read.format("binaryFile").load(str(tmp_path / "f")), m).groupBy("rec_id").agg({"prob": "sum", "frame_no": "count"}).collect()
    streamed = {name: (sum(int(np.floor(p * 100)) for n, _, p in got if n == name), sum(n == name for n, *_ in got)) for name in "ab"}
    assert sorted((r["sum(prob)"], r["count(frame_no)"]) for r in whole) == sorted(streamed.values())


def test_models_of_one_function_are_told_apart():
    def factory(k):
        def made():
            return lambda samples: np.full(len(samples) // models.FRAME, k)

        return made

    import functools
    import pickle

    from pyspark import cloudpickle

    x = np.zeros(models.FRAME, np.float32)
    for k in (1.0, 2.0, 3.0):
        for m in (models.Models(voice=factory(k)), models.Models(voice=functools.partial(lambda n: lambda s: np.full(len(s) // models.FRAME, n), k))):
            for again in (m, pickle.loads(cloudpickle.dumps(m)), pickle.loads(cloudpickle.dumps(pickle.loads(cloudpickle.dumps(m))))):
                assert again.built("voice")(x)[0] == k and again.built("voice") is again.built("voice")
    for k in range(40):
        models.Models(voice=factory(k)).built("voice")
    assert len(models._built) <= models.HELD


def test_vectors_in_batches():
    calls = []

    def batch():
        def run(features):
            calls.append(features.shape)
            if np.abs(features).max() > 9:
                raise OSError("a window is broken")
            return models.hashed_vectors(features)

        return run

    r = np.random.default_rng(4)
    windows = [(k, None if k % 7 == 3 else r.normal(0, 1, (20, 80))) for k in range(50)]
    m = models.Models(speaker_batch=batch, batch_size=8)
    got = list(models.batches(m, windows))
    one = list(models.batches(models.Models(), windows))
    assert [k for k, _ in got] == list(range(50)) and [v is None for _, v in got] == [x is None for _, x in windows]
    assert all(np.allclose(a, b, atol=1e-6) for (_, a), (_, b) in zip(got, one) if a is not None)
    real = sum(x is not None for _, x in windows)
    assert len(calls) == -(-real // 8) and set(calls) == {(8, 20, 80)}
    broken = [(k, np.full((20, 80), 10.0) if k == 2 else np.ones((20 + (k > 4), 80))) for k in range(8)]
    assert [v is None for _, v in models.batches(m, broken)] == [k == 2 for k in range(8)]
    assert list(models.batches(m, [])) == [] and list(models.batches(m, [(1, None)])) == [(1, None)]
