"""Scans over ranges against windows: one key with all rows, many keys, nulls, ties and an empty table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.operators import diarize, scan, sentences, timeline, tokens, vad

WORDS = "rec_id long, channel string, msg_no long, pos long, word string, start_ms long, end_ms long"


def both(of, df):
    """The rows of an operator over windows and over ranges."""
    found = [of(df, x) for x in (False, True)]
    return [sorted(map(tuple, f.select(sorted(f.columns)).collect()), key=str) for f in found]


def words(spark, one):
    r, rows = random.Random(4), []
    for rec in [1] if one else [1, 2, 3, None]:
        at = 0
        for k in range(900 if one else r.randrange(1, 150)):
            at += r.choice([0, 20, 300, 300, 2500])
            end = at + r.randrange(400)
            rows.append((rec, r.choice("ab") if not one else "a", k // 40, k % 40, f"w{k}", at if r.random() > 0.02 else None, end))
            at = end
    r.shuffle(rows)
    return spark.createDataFrame(rows, WORDS).repartition(5)


@pytest.mark.parametrize("one", [True, False])
def test_operators_over_ranges_and_windows(spark, one):
    df = words(spark, one)
    for of in (
        lambda d, s: sentences.sentences(d, spread=s), lambda d, s: sentences.sentences(d, 37.0, True, spread=s), lambda d, s: diarize.word_groups(d, spread=s),
        lambda d, s: tokens.words_by_gap(d.select("rec_id", "channel", "msg_no", "pos", F.when(F.col("pos") % 7 == 0, " ").otherwise(F.col("word")).alias("token"), F.col("start_ms").alias("ts_ms")), spread=s),
        lambda d, s: timeline.chunk_offsets(d.select("rec_id", "channel", (F.col("msg_no") * 40 + F.col("pos")).alias("msg_no"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), (F.col("pos") % 5 > 0).alias("ok")), s),
        lambda d, s: timeline.sticky_multiplier(d.select("rec_id", "channel", (F.col("msg_no") * 40 + F.col("pos")).alias("msg_no"), F.when(F.col("pos") == 30, F.col("end_ms") % 40).alias("rate")), spread=s),
        lambda d, s: vad.segments(d.select("rec_id", (F.col("msg_no") * 40 + F.col("pos")).alias("frame_no"), F.when(F.col("end_ms") % 11 > 1, (F.col("end_ms") / 700).cast("long") % 4 * 30).alias("prob")).dropDuplicates(["rec_id", "frame_no"]), spread=s),
    ):
        a, b = both(of, df)
        assert a == b and a
        assert one or both(of, df.limit(0)) == [[], []]


def test_one_key_is_many_even_ranges(spark):
    df = spark.range(40_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 40_009).alias("n"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    found = scan.Scan(df, ["k"], ["n"], True)
    sizes = [r["count"] for r in found.rows.groupBy("_piece").count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 2 * np.median(sizes)
    rows = found.before(b=F.col("v")).totals(s=F.coalesce("v", F.lit(0))).latest(last=F.col("v")).earliest(first=F.col("v")).facts(spark.createDataFrame([(1, "x")], "k int, fact string")).done().orderBy("n").collect()
    total, last, first, before = 0, None, None, None
    for r in rows:
        total, last, first = total + (r["v"] or 0), r["v"] if r["v"] is not None else last, first if first is not None else r["v"]
        assert (r["b"], r["s"], r["last"], r["first"], r["fact"]) == (before, total, last, first, "x")
        before = r["v"]


def test_no_window_over_a_whole_channel(spark):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        sentences.sentences(words(spark, True), spread=True).explain("formatted")
    windows = [x for x in out.getvalue().split("\n") if x.startswith("Arguments: [") and "windowspecdefinition(" in x]
    whole = [w for w in windows if "windowspecdefinition(rec_id" in w and "_piece" not in w.split("windowspecdefinition(")[1].split(" ASC")[0]]
    assert windows and all("_in_" in w for w in whole)  # only over the ends of ranges


def test_percentiles_by_brute_force(spark):
    r = random.Random(8)
    rows = [(k, r.choice([r.randrange(-5, 5), r.randrange(10**6), r.randrange(-(10**12), 10**12), None])) for k in [1] * 700 + [2] * 41 + [3] + [None] * 9 for _ in range(2)] + [(4, None)]
    df = spark.createDataFrame(rows, "k long, v long")
    for share in (0.0, 0.37, 0.5, 0.8, 1.0):
        got = {x["k"]: (x["n"], x["percentile"]) for x in scan.exact_percentiles(df, ["k"], "v", share).collect()}
        for k in (1, 2, 3, None):
            own = [v for key, v in rows if key == k and v is not None]
            assert got[k][0] == len(own) and got[k][1] == pytest.approx(np.percentile(own, share * 100), rel=1e-12)
        assert len(got) == 4
    assert scan.exact_percentiles(df.limit(0), ["k"], "v", 0.5).count() == 0
