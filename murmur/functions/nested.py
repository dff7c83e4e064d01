"""Transcripts as nested values, a map from channel to messages, and as rows of words."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.schemas import RAW_DATA


def words_of_raw(raw: DataFrame, column: str = "raw_data") -> DataFrame:
    """(rec_id, channel, msg_no, pos, word, start_ms, end_ms) of rows (rec_id, raw_data). Messages without words are
    skipped and keep their number; times are seconds there and whole milliseconds here."""
    messages = raw.select("rec_id", F.explode(column).alias("channel", "messages")).select("rec_id", "channel", F.posexplode("messages").alias("msg_no", "message"))
    spoken = messages.filter(F.col("message.data.result").isNotNull())
    found = spoken.select("rec_id", "channel", F.col("msg_no").cast("long").alias("msg_no"), F.posexplode("message.data.result").alias("pos", "w"))
    in_ms = [F.round(F.col(f"w.{c}") * 1000).cast("long").alias(f"{c}_ms") for c in ("start", "end")]
    return found.select("rec_id", "channel", "msg_no", F.col("pos").cast("long").alias("pos"), F.col("w.word").alias("word"), *in_ms)


def raw_of_words(words: DataFrame) -> DataFrame:
    """(rec_id, raw_data) of words, with an empty message for each number that a channel lacks."""
    word = F.struct(F.lit(1.0).alias("conf"), *((F.col(f"{c}_ms") / 1000).alias(c) for c in ("start", "end")), "word")
    rows = F.array_sort(F.collect_list(F.struct("pos", word.alias("w"))))
    messages = words.groupBy("rec_id", "channel", "msg_no").agg(F.transform(rows, lambda r: r["w"]).alias("result"))
    by_no = messages.groupBy("rec_id", "channel").agg(F.map_from_entries(F.collect_list(F.struct("msg_no", "result"))).alias("by_no"), F.max("msg_no").alias("last"))

    def message(k: Column) -> Column:
        found = F.element_at("by_no", k)
        text = F.array_join(F.transform(found, lambda w: w["word"]), " ")
        return F.struct(F.struct(found.alias("result"), text.alias("text")).alias("data"), found.isNull().alias("silence"))

    listed = by_no.select("rec_id", "channel", F.transform(F.sequence(F.lit(0).cast("long"), "last"), message).alias("messages"))
    return listed.groupBy("rec_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", "messages"))).cast(RAW_DATA).alias("raw_data"))
