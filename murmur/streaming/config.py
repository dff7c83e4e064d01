"""Options that a session's messages set, as columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPTIONS = "sample_rate int, audio_format string, wait_null_answers boolean, do_dialogue boolean, do_punctuation boolean, channelName string"
_NAMES = [c.split()[0] for c in OPTIONS.split(", ")]


def parsed(payload: Column, schema: str = OPTIONS) -> Column:
    """The options of a config message, under \"config\" or at the top; null where it is no JSON object."""
    text = payload.cast("string")
    inner = F.from_json(text, f"config struct<{', '.join(':'.join(c.split()) for c in schema.split(', '))}>")
    return F.coalesce(inner["config"], F.from_json(text, schema))


def in_force(rows: DataFrame) -> DataFrame:
    """The options that hold at a session's end: of each the last that a config message, by seq, gives; null if none does."""
    found = rows.filter("kind = 'config'").select("session_id", "seq", parsed(F.col("payload")).alias("c")).select("session_id", "seq", "c.*")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in _NAMES]
    return found.groupBy("session_id").agg(*last)
