"""Sentences by pauses, dialogues and full texts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.scan import Scan, exact_percentiles
from murmur.operators.tokens import joined

CHANNEL = ["rec_id", "channel"]


def sentences(words: DataFrame, percentile: float = 80.0, compat: bool = False, spread: bool = False) -> DataFrame:
    """Cut a channel's words where a pause reaches the channel's own threshold.

    The threshold is the exact percentile of the differences between the ends of neighbouring words; the pause
    is a word's start minus the end before. One word, or none before, is one sentence. ``compat``: a start of
    0 ms counts as unset, so such a sentence starts at its second word.

    ``spread`` gives the same rows without a window over a whole channel, for channels with very many words: see ``Scan`` and
    ``exact_percentiles``. Null times make no cut; words without a recording or channel are those of a channel of their own. Repeated
    words count each; an empty table gives none. Columns of words that begin with an underscore may be replaced.
    """
    marked = Scan(words.select(*CHANNEL, "msg_no", "pos", "word", "start_ms", "end_ms"), CHANNEL, ["msg_no", "pos"], spread).before(_end=F.col("end_ms"))
    since = F.col("end_ms") - F.col("_end")
    if spread:
        marked.facts(exact_percentiles(marked.rows.withColumn("_since", since), CHANNEL, "_since", percentile / 100).select(*CHANNEL, F.round("percentile", 6).alias("_limit")))
    else:
        marked.rows = marked.rows.withColumn("_limit", F.round(F.percentile(since, F.lit(percentile / 100)).over(Window.partitionBy(*CHANNEL)), 6))
    cut = F.coalesce((F.col("start_ms") - F.col("_end")) >= F.col("_limit"), F.lit(False)).cast("int")
    numbered = marked.totals(sentence_no=cut).done().withColumn("sentence_no", F.col("sentence_no").cast("long"))
    start = F.min_by("start_ms", F.struct("msg_no", "pos"))
    if compat:
        start = F.coalesce(F.min_by(F.when(F.col("start_ms") != 0, F.col("start_ms")), F.when(F.col("start_ms") != 0, F.struct("msg_no", "pos"))), start)
    return numbered.groupBy(*CHANNEL, "sentence_no").agg(start.alias("start_ms"), F.max_by("end_ms", F.struct("msg_no", "pos")).alias("end_ms"), joined("word", "msg_no", "pos", sep=" ").alias("text"), F.count("*").alias("n_words"))


def dialogue(sentences_: DataFrame) -> DataFrame:
    """A text per recording: its sentences as lines, by start, channel and number. A sentence without a channel or a text counts but
    adds no line; rows without a recording are one of their own."""
    line = F.concat("channel", F.lit(": "), "text", F.lit("\n"))
    return sentences_.withColumn("_line", line).groupBy("rec_id").agg(joined("_line", "start_ms", "channel", "sentence_no").alias("dialogue"), F.count("*").alias("n_sentences"))


def full_texts(messages: DataFrame) -> DataFrame:
    """A text per channel: its messages, each with a space behind."""
    return messages.filter("text IS NOT NULL").withColumn("_text", F.concat("text", F.lit(" "))).groupBy(*CHANNEL).agg(joined("_text", "msg_no").alias("full_text"), F.count("*").alias("n_messages"))


def error_states(channels: DataFrame, words: DataFrame) -> DataFrame:
    """An error state for each channel without words, else null."""
    n = words.groupBy(*CHANNEL).agg(F.count("*").alias("n_words"))
    return channels.join(n, CHANNEL, "left").select(*CHANNEL, F.when(F.col("n_words").isNull(), F.concat(F.lit("Err_No_words in "), "channel")).alias("err_state"))
