"""Ledgers, deletion after success, notes of progress, and trials of recognition."""

import json
import time
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from murmur.functions import audio, models
from murmur.options import PipelineOptions
from murmur.plans import trials
from murmur.sources import files
from murmur.streaming import watch


def of(found):
    """Two words a file; a file named bad fails, one named none gives no row, one named null has no body."""
    rows = found.filter("path NOT LIKE '%none%'")
    bad = F.col("path").contains("bad")
    return rows.select("path", F.when(~bad & ~F.col("path").contains("null"), F.concat(F.lit("heard "), F.length("content").cast("string"))).alias("body"), F.when(bad, "broken").alias("error"))


def run(spark, tmp_path, finished, rows, delete=True, gone=None):
    folder = str(tmp_path / "in")
    query = watch.write_results(files.watched(spark, folder), of, str(tmp_path / "out"), folder, str(tmp_path / "notes"), delete=delete, checkpointLocation=str(tmp_path / "cp"))
    until = time.time() + 60
    while gone and gone.exists() and time.time() < until:  # a batch that is known reads no rows
        time.sleep(0.2)
    finished(query, rows)


def test_sources_go_when_their_results_are_there(spark, finished, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "bad", "none", "null"):
        (tmp_path / f"in/{name}.wav").write_bytes(b"x" * 5)
    run(spark, tmp_path, finished, 4)
    assert sorted(p.name for p in (tmp_path / "in").iterdir()) == ["bad.wav", "none.wav", "null.wav"]
    assert (tmp_path / "out/a.json").read_text() == "heard 5" and [p.name for p in (tmp_path / "out").iterdir()] == ["a.json"]
    notes = {Path(r["path"]).name: (r["batch"], r["result"] is None, r["error"]) for r in watch.ledger(spark, str(tmp_path / "notes")).collect()}
    assert notes == {"a.wav": (0, False, None), "bad.wav": (0, True, "broken"), "none.wav": (0, True, "no result"), "null.wav": (0, True, "no result")}

    # a restarted query repeats nothing, and takes up what is new
    (tmp_path / "out/a.json").write_text("kept")
    (tmp_path / "in/b.wav").write_bytes(b"x" * 7)
    run(spark, tmp_path, finished, 1)
    assert (tmp_path / "out/a.json").read_text() == "kept" and (tmp_path / "out/b.json").read_text() == "heard 7"
    assert watch.ledger(spark, str(tmp_path / "notes")).count() == 5


def test_a_batch_that_runs_again_is_known(spark, finished, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.wav").write_bytes(b"x" * 5)
    run(spark, tmp_path, finished, 1, delete=False)
    assert (tmp_path / "in/a.wav").exists()
    for p in (tmp_path / "cp/commits").iterdir():  # as if it had been lost behind its note
        p.unlink()
    (tmp_path / "out/a.json").write_text("kept")
    run(spark, tmp_path, finished, 0, gone=tmp_path / "in/a.wav")
    assert (tmp_path / "out/a.json").read_text() == "kept" and not (tmp_path / "in/a.wav").exists()


def test_no_notes_yet(spark, tmp_path):
    assert watch.ledger(spark, str(tmp_path / "x")).count() == 0


def test_progress_of_streams(spark, finished, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("".join(json.dumps({"k": n % 3}) + "\n" for n in range(30)))
    listener = watch.Progress(spark, str(tmp_path / "notes"))
    spark.streams.addListener(listener)
    try:
        counts = spark.readStream.schema("k int").json(str(tmp_path / "in")).groupBy("k").count()
        query = counts.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
        finished(query, 30)
        until = time.time() + 30
        while not list((tmp_path / "notes").glob("*-ended.json")) and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    rows = watch.status(spark, str(tmp_path / "notes")).collect()
    assert [(r["name"], r["state"], r["rows"], r["open_sessions"], r["error"]) for r in rows] == [("counted", "ended", 30, 3, None)]
    assert watch.progress(spark, str(tmp_path / "notes")).filter("batch >= 0 AND NOT ended AND rows = 30").first()["duration_ms"] > 0


def drawing():
    def noisy():
        """A recogniser that leaves out letters and moves others, drawn from the trial and the samples' length."""

        class Noisy:
            def trial(self, samples, rate, number):
                draw = np.random.default_rng([number, len(samples)])
                if number == 4:
                    raise OSError("no luck")
                tokens, times = [], []
                for k, token in enumerate("abcdefgh"[: 1 + len(samples) // rate]):
                    if draw.random() > 0.3:
                        tokens.append(token)
                        times.append(k * 0.9 + draw.normal(0, 0.2))
                return {"tokens": tokens, "timestamps": times}

        return Noisy()

    return noisy


def test_trials_vote_on_tokens(spark, tmp_path):
    rate = 16_000
    (tmp_path / "a.wav").write_bytes(audio.write_wav([np.full(6 * rate, 0.3, np.float32), np.full(6 * rate, 0.2, np.float32)]))
    (tmp_path / "b.wav").write_bytes(audio.write_wav([np.full(9 * rate, 0.3, np.float32)]))
    (tmp_path / "c.wav").write_bytes(b"no wav")
    noisy = drawing()  # not a function of this module, which tasks don't have
    m, options = models.Models(recogniser=noisy), PipelineOptions(max_chunk_ms=7000)
    found = files.recordings(spark, str(tmp_path))
    got = Counter(tuple(r) for r in trials.confident_tokens(found, 5, options=options, models=m).collect())
    expected = Counter()
    for c in trials.chunks(found, options, m).collect():
        votes = Counter()
        for number in range(1, 6):
            if number != 4:
                result = noisy().trial(audio.to_float(bytes(c["payload"]), 2), rate, number)
                votes.update((t, round(round(s * 1000) / 500) * 500) for t, s in zip(result["tokens"], result["timestamps"]))
        expected.update({(c["path"], c["channel"], c["msg_no"], t, c["offset_ms"] + at, n, round(n / 5, 4)): 1 for (t, at), n in votes.items()})
    assert got == expected and {r[6] for r in got} > {0.2, 0.4}
    assert len({r[:3] for r in got}) >= 4
