"""From recogniser tokens to words, and rates and votes over tokens."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.scan import Scan

MESSAGE = ["rec_id", "channel", "msg_no"]


def joined(text: str, *order: str, sep: str = "") -> F.Column:
    """An aggregate: ``text`` of the group's rows in the order of ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return F.array_join(F.transform(rows, lambda r: r["_text"]), sep)


def words_by_leading_space(tokens: DataFrame, shift_ms: int = 0, compat: bool = False) -> DataFrame:
    """Words of messages whose tokens mark a word's start by a leading space.

    tokens: rec_id, channel, msg_no, pos, token, ts_ms. A word starts at its first and ends at its last token.
    ``compat`` starts a message's first word at 0 if its token has no space, and keeps words that are empty. Null tokens add
    nothing to a word; repeated tokens count each; an empty table gives none.
    """
    in_order = Window.partitionBy(*MESSAGE).orderBy("pos")
    starts = F.col("token").startswith(" ").cast("int")
    numbered = tokens.withColumn("word_no", F.sum(starts).over(in_order).cast("long"))
    out = numbered.groupBy(*MESSAGE, "word_no").agg(F.trim(joined("token", "pos")).alias("word"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"))
    if compat:
        out = out.withColumn("start_ms", F.when(F.col("word_no") == 0, 0).otherwise(F.col("start_ms")).cast("long"))
    else:
        out = out.filter("word <> ''")
    return out.withColumns({"start_ms": F.col("start_ms") + shift_ms, "end_ms": F.col("end_ms") + shift_ms})


def words_by_gap(tokens: DataFrame, gap_ms: int = 2000, spread: bool = False) -> DataFrame:
    """Words of messages whose tokens are letters and spaces: a space ends a word, and so does a pause of more
    than ``gap_ms`` between two of its letters. Null tokens are left out, null times make no pause. ``spread`` is for messages with very
    many tokens, see ``Scan``; it gives the same rows."""
    marked = Scan(tokens.select(*MESSAGE, "pos", "token", "ts_ms"), MESSAGE, ["pos"], spread).before(_before=F.col("token"), _at=F.col("ts_ms"))
    breaks = (F.col("_before") == " ") | (F.col("ts_ms") - F.col("_at") > gap_ms)
    numbered = marked.totals(word_no=F.coalesce(breaks & (F.col("token") != " "), F.lit(False)).cast("int")).done().filter("token <> ' '")
    return numbered.withColumn("word_no", F.col("word_no").cast("long")).groupBy(*MESSAGE, "word_no").agg(joined("token", "pos").alias("word"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"))


def speech_rate(tokens: DataFrame) -> DataFrame:
    """Letters a second of each message, without the time that spaces take; and how far to slow it down: 17 / rate,
    0.8 at least, above a rate of 18. Time counts from 0, not from the first token. Null tokens are no letters; a message without
    times has a rate of 0."""
    pause = F.when(F.col("token") == " ", F.lead("ts_ms").over(Window.partitionBy(*MESSAGE).orderBy("pos")) - F.col("ts_ms"))
    by_message = tokens.withColumn("_pause", pause).groupBy(*MESSAGE).agg(
        F.sum((F.col("token") != " ").cast("long")).alias("n_letters"), (F.max_by("ts_ms", "pos") - F.coalesce(F.sum("_pause"), F.lit(0))).alias("spoken_ms")
    )
    rate = F.when((F.col("n_letters") > 0) & (F.col("spoken_ms") > 0), F.floor(F.col("n_letters") * 1000 / F.col("spoken_ms"))).otherwise(0).cast("long")
    slow = F.when(F.col("rate") > 18, F.round(F.greatest(17 / F.col("rate"), F.lit(0.8)), 6)).otherwise(1.0)
    return by_message.withColumn("rate", rate).withColumn("slow_down", slow)


def token_confidence(tokens: DataFrame, trials: str = "msg_no", tolerance_ms: int = 500) -> DataFrame:
    """Votes over a recording's trials: tokens of one place, rounded half to even to ``tolerance_ms``, and the
    share of trials that have them, in the order they were first seen. Null tokens and times are a token and a place like any; rows
    without a recording are left out; an empty table gives none."""
    place = (F.bround(F.col("ts_ms") / tolerance_ms) * tolerance_ms).cast("long")
    counts = tokens.groupBy("rec_id", "token", place.alias("ts_ms")).agg(F.count("*").alias("votes"), F.min(F.struct(trials, "pos")).alias("_first"))
    n = tokens.groupBy("rec_id").agg(F.countDistinct(trials).alias("_trials"))
    out = counts.join(n, "rec_id").withColumn("conf", F.round(F.col("votes") / F.col("_trials"), 4))
    return out.select("rec_id", "token", "ts_ms", "votes", "conf", F.col(f"_first.{trials}").alias("first_trial"), F.col("_first.pos").alias("first_pos"))


def best_tokens(tokens: DataFrame, trials: str = "msg_no", tolerance_ms: int = 500) -> DataFrame:
    """The token of each place of a recording that most trials have, the one seen first on a tie, and its votes."""
    votes = token_confidence(tokens, trials, tolerance_ms)
    first = F.max_by(F.struct("token", "votes", "conf"), F.struct("votes", -F.col("first_trial"), -F.col("first_pos")))
    return votes.groupBy("rec_id", "ts_ms").agg(first.alias("_best")).select("rec_id", "ts_ms", "_best.token", "_best.votes", "_best.conf")
