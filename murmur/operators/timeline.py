"""Tumbling chunks, running offsets, frames, and state of work."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.scan import Scan


def tumbling_chunks(words: DataFrame, chunk_ms: int = 30_000) -> DataFrame:
    """Words of a channel by chunk of its time, with a flag on the last chunk. Words without a start are a chunk without a
    number, the first; repeated words count each; an empty table gives none."""
    chunk = F.floor(F.col("start_ms") / chunk_ms).cast("long")
    counts = words.groupBy("rec_id", "channel", chunk.alias("chunk_no")).agg(F.count("*").alias("n_words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    last = F.lead("chunk_no").over(Window.partitionBy("rec_id", "channel").orderBy("chunk_no")).isNull()
    return counts.withColumn("is_last", last)


def chunk_offsets(chunks: DataFrame, spread: bool = False) -> DataFrame:
    """Chunks (rec_id, channel, msg_no, duration_ms, ok) and the time at which each begins: the durations of
    those before it, failed ones and null durations not counted. A null ``ok`` is a failure. ``spread`` is for channels with very many
    chunks, see ``Scan``; it gives the same rows. A column offset_ms is replaced."""
    own = F.coalesce(F.when(F.col("ok"), F.col("duration_ms")), F.lit(0)).cast("long")
    return Scan(chunks, ["rec_id", "channel"], ["msg_no"], spread).totals(offset_ms=own).done().withColumn("offset_ms", F.col("offset_ms") - own)


def sticky_multiplier(rates: DataFrame, fast: int = 18, target: float = 17.0, least: float = 0.8, spread: bool = False) -> DataFrame:
    """The speed multiplier that holds for each message of a recording: 1 up to the first one spoken faster than
    ``fast``, from then on what that one asked for, in all later messages and channels. Null rates ask for nothing. ``spread`` is for
    recordings with very many messages, see ``Scan``; it gives the same rows. A column multiplier is replaced."""
    asked = F.when(F.col("rate") > fast, F.round(F.greatest(F.lit(target) / F.col("rate"), F.lit(least)), 6))
    found = Scan(rates, ["rec_id"], ["channel", "msg_no"], spread).earliest(multiplier=asked).done()
    return found.withColumn("multiplier", F.coalesce("multiplier", F.lit(1.0)))


def framed(samples: Column, size: int = 512, pad: bool = True) -> Column:
    """An array of frames of ``size`` samples; the rest is filled with zeros, or left out without ``pad``."""
    n = F.ceil(F.size(samples) / size) if pad else F.floor(F.size(samples) / size)
    frames = F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.slice(samples, i * size + 1, size)))
    filled = F.transform(frames, lambda f: F.concat(f, F.array_repeat(F.lit(0.0), size - F.size(f))))
    return F.coalesce(filled, F.array().cast("array<array<double>>"))


def message_index(messages: DataFrame) -> DataFrame:
    """messages with their running number in the recording, by message number and channel, from 1."""
    return messages.withColumn("running", F.row_number().over(Window.partitionBy("rec_id").orderBy("msg_no", "channel")).cast("long"))


def last_messages(messages: DataFrame) -> DataFrame:
    """The last message of each recording and its channel; of several with one number that of the last channel."""
    last = F.max_by(F.struct("channel", "msg_no", "text"), F.struct("msg_no", "channel"))
    return messages.groupBy("rec_id").agg(last.alias("_last")).select("rec_id", "_last.channel", "_last.msg_no", "_last.text")


def task_states(messages: DataFrame) -> DataFrame:
    """Open tasks of each recording, those without a text, and the service's state over them."""
    n = messages.groupBy("rec_id").agg(F.count(F.when(F.trim(F.coalesce("text", F.lit(""))) == "", 1)).alias("tasks"))
    return n.withColumn("state", F.when(F.col("tasks") == 0, "idle").otherwise("in_work"))
