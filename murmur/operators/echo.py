"""Words that two channels of a recording share because one hears the other."""

from bisect import bisect_left, bisect_right
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["rec_id", "channel", "msg_no", "pos"]


@lru_cache(maxsize=200_000)
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio(a: str, b: str) -> Column:
    """Ratcliff-Obershelp similarity of two columns of words."""
    return F.pandas_udf(_ratios, "double")(a, b)


def echo_pairs(words: DataFrame, delta_ms: int = 900) -> DataFrame:
    """Pairs of words of different channels of one recording that end within ``delta_ms``, the earlier one as heard.

    The join is on the recording and a bucket of the end, the earlier words standing in two buckets, so a long
    recording is many small groups.
    """
    bucket = F.floor(F.col("end_ms") / (delta_ms + 1))
    late = words.select(*(F.col(c).alias(f"late_{c}") if c != "rec_id" else F.col(c) for c in (*KEYS, "word", "end_ms")), bucket.alias("_bucket"))
    early = words.select(*(F.col(c).alias(f"early_{c}") if c != "rec_id" else F.col(c) for c in (*KEYS, "word", "end_ms")), F.explode(F.array(bucket, bucket + 1)).alias("_bucket"))
    near = (F.col("late_channel") != F.col("early_channel")) & (F.col("early_end_ms") < F.col("late_end_ms")) & (F.col("late_end_ms") - F.col("early_end_ms") <= delta_ms)
    return late.join(early, ["rec_id", "_bucket"]).filter(near).drop("_bucket")


def without_echo(words: DataFrame, delta_ms: int = 900, similarity: float | None = None) -> DataFrame:
    """Words without those that another channel said up to ``delta_ms`` before: the same word, or with
    ``similarity`` one at least so similar. All words are judged on the input."""
    if similarity is None:
        bucket = F.floor(F.col("end_ms") / (delta_ms + 1))
        late = words.withColumn("_bucket", bucket)
        early = words.select(F.col("rec_id").alias("_rec"), F.col("word").alias("_word"), F.col("channel").alias("_channel"), F.col("end_ms").alias("_end"), F.explode(F.array(bucket, bucket + 1)).alias("_near"))
        same = (F.col("rec_id") == F.col("_rec")) & (F.col("word") == F.col("_word")) & (F.col("_bucket") == F.col("_near"))
        near = (F.col("channel") != F.col("_channel")) & (F.col("_end") < F.col("end_ms")) & (F.col("end_ms") - F.col("_end") <= delta_ms)
        return late.join(early, same & near, "left_anti").drop("_bucket")
    heard = echo_pairs(words, delta_ms).filter(ratio("late_word", "early_word") >= similarity)
    heard = heard.select("rec_id", *(F.col(f"late_{c}").alias(c) for c in KEYS[1:])).distinct()
    return words.join(heard, KEYS, "left_anti")


#: Pairs of words that a worker has compared, by similarity asked for; so many at most before it starts anew.
_compared: dict[float, dict[tuple[str, str], bool]] = {}
_REMEMBERED = 500_000


def _alike(similarity: float):
    """Whether two words are at least so similar, each pair of words compared once in a worker."""
    known = _compared.setdefault(similarity, {})

    def of(a: str, b: str) -> bool:
        found = known.get((a, b))
        if found is None:
            if len(known) >= _REMEMBERED:
                known.clear()
            near = a == b or 2 * min(len(a), len(b)) >= similarity * (len(a) + len(b))
            found = known[a, b] = near and SequenceMatcher(None, a, b).ratio() >= similarity
        return found

    return of


def surviving(channel: list, message: list, word: list[str], end: list[int], delta_ms: int, alike) -> list[bool]:
    """Which words stay, given in the order of channels, messages and places.

    Words are events: each in its turn looks at the standing words of other channels that end within ``delta_ms``
    of it, found in its channel's order of time. A similar one that ended before makes the word an echo, which
    falls and looks no further; a similar one that ends later falls itself, and then the word does not look at the
    next one standing in that message. Equal ends leave both.
    """
    stands = [True] * len(word)
    in_time: dict = {}
    for k in sorted(range(len(word)), key=end.__getitem__):
        in_time.setdefault(channel[k], []).append(k)
    ends = {c: [end[k] for k in own] for c, own in in_time.items()}
    for k in range(len(word)):
        if not stands[k]:
            continue
        near: list[int] = []
        for c, own in in_time.items():
            if c != channel[k]:
                near += own[bisect_left(ends[c], end[k] - delta_ms) : bisect_right(ends[c], end[k] + delta_ms)]
        passed = -1
        for o in sorted(near):
            if not stands[o] or o == passed or not alike(word[k], word[o]):
                continue
            if end[o] < end[k]:
                stands[k] = False
                break
            if end[o] > end[k]:
                stands[o] = False
                rest = range(o + 1, len(word))
                passed = next((n for n in rest if stands[n] or (channel[n], message[n]) != (channel[o], message[o])), -1)
    return stands


def without_echo_greedy(words: DataFrame, delta_ms: int = 900, similarity: float = 0.8) -> DataFrame:
    """The order-dependent form: channels in order, a word dropped early no longer drops others (see ``surviving``).

    Only pauses separate what can influence one another: words that end more than ``delta_ms`` apart never meet,
    so each stretch of a recording between such pauses is judged by itself, and one with a single channel stays as it is.
    Words without text or an end are nobody's echo and stay. Repeated rows are judged each in its turn. An empty table
    gives none.
    """
    whole = F.col("word").isNotNull() & F.col("end_ms").isNotNull() & F.col("channel").isNotNull()
    odd, words = words.filter(~whole), words.filter(whole)
    in_time = Window.partitionBy("rec_id").orderBy("end_ms", "channel", "msg_no", "pos")
    apart = F.coalesce(F.col("end_ms") - F.lag("end_ms").over(in_time) > delta_ms, F.lit(False)).cast("int")
    stretch = Window.partitionBy("rec_id", "_stretch")
    grouped = words.withColumn("_stretch", F.sum(apart).over(in_time)).withColumn("_alone", F.min("channel").over(stretch) == F.max("channel").over(stretch))
    columns = words.columns

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values(["channel", "msg_no", "pos"])  # stretches lie too far apart to meet
        return rows[surviving(*(rows[c].tolist() for c in ("channel", "msg_no", "word", "end_ms")), delta_ms, _alike(similarity))][columns]

    shared = grouped.filter("NOT _alone").withColumn("_block", F.floor(F.col("_stretch") / 64))
    return shared.groupBy("rec_id", "_block").applyInPandas(run, words.schema).union(grouped.filter("_alone").select(*columns)).union(odd)
