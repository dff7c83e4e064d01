"""Transcript relations derived from the star-schema tables, since those hold no audio.

Times are whole milliseconds, so that every engine computes the same values.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, channel, msg_no, text): a conversation is a recording, a role a channel, a turn a message."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("role").alias("channel"), F.col("turn").alias("msg_no"), "text")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, channel, msg_no, pos, word, start_ms, end_ms): a word every 350 ms, a longer pause after ten."""
    split = messages(spark, sf_dir).select("rec_id", "channel", "msg_no", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("pos", "word"))
    start = F.col("msg_no") * 30000 + F.col("pos") * 350 + F.floor(F.col("pos") / 10) * 1200
    return split.withColumn("pos", F.col("pos").cast("long")).withColumn("start_ms", start.cast("long")).withColumn("end_ms", (F.col("start_ms") + 30 * F.least(F.length("word"), F.lit(10))).cast("long"))


def chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, channel, msg_no, pos, token, ts_ms): a token per character, 40 ms apart, with a long pause after every 25."""
    split = messages(spark, sf_dir).select("rec_id", "channel", "msg_no", F.posexplode(F.split("text", "")).alias("pos", "token"))
    return split.filter("token <> ''").select("rec_id", "channel", "msg_no", F.col("pos").cast("long").alias("pos"), "token", (F.col("pos") * 40 + F.floor(F.col("pos") / 25) * 2500).cast("long").alias("ts_ms"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``chars``, but a character behind a space takes the space as a prefix, and the space itself goes."""
    before = F.lag("token").over(Window.partitionBy("rec_id", "channel", "msg_no").orderBy("pos"))
    marked = chars(spark, sf_dir).withColumn("before", before)
    return marked.filter("token <> ' '").withColumn("token", F.when(F.col("before") == " ", F.concat(F.lit(" "), "token")).otherwise(F.col("token"))).drop("before")


def frames(spark: SparkSession, sf_dir: str, repeat: int = 20) -> DataFrame:
    """(rec_id, frame_no, prob): a user's events in time order, each held for ``repeat`` frames; prob in hundredths."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), "ts", "event_id", F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(100)).alias("prob"))
    held = events.withColumn("n", F.row_number().over(Window.partitionBy("rec_id").orderBy("ts", "event_id")) - 1)
    return held.select("rec_id", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))).alias("k"), "n", "prob").select("rec_id", (F.col("n") * repeat + F.col("k")).cast("long").alias("frame_no"), "prob")


def segments(spark: SparkSession, sf_dir: str, speakers: int = 3) -> DataFrame:
    """(rec_id, seg_ord, start_ms, end_ms, speaker): diarization segments of the recordings, from events.

    An event belongs to recording event_id % recordings; it starts at event_id % 200 seconds and lasts ten
    milliseconds per hundredth of its value.
    """
    recordings = (table(spark, sf_dir, "conversations").agg(F.max("conv_id")).first()[0] or 0) + 1
    events = table(spark, sf_dir, "events").filter("event_id IS NOT NULL")
    start = F.pmod(F.col("event_id") * 7919, F.lit(200000)).cast("long")
    return events.select(
        F.pmod(F.col("event_id"), F.lit(recordings)).alias("rec_id"), F.col("event_id").alias("seg_ord"), start.alias("start_ms"),
        (start + F.round(F.col("value") * 100).cast("long")).alias("end_ms"), F.concat(F.lit("s"), F.pmod("user_id", F.lit(speakers)).cast("string")).alias("speaker"),
    )


# The same relations in DuckDB SQL, as common table expressions.
SQL = {
    "words": r"""words AS (SELECT rec_id, channel, msg_no, pos, word, start_ms, start_ms + 30 * least(length(word), 10) AS end_ms FROM (
        SELECT rec_id, channel, msg_no, pos, ws[pos + 1] AS word, msg_no * 30000 + pos * 350 + (pos // 10) * 1200 AS start_ms FROM (
            SELECT conv_id AS rec_id, role AS channel, turn AS msg_no, ws, unnest(range(len(ws))) AS pos FROM (
                SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM conversations))))""",
    "chars": """chars AS (SELECT rec_id, channel, msg_no, pos, cs[pos + 1] AS token, pos * 40 + (pos // 25) * 2500 AS ts_ms FROM (
        SELECT conv_id AS rec_id, role AS channel, turn AS msg_no, cs, unnest(range(len(cs))) AS pos FROM (
            SELECT *, string_split(text, '') AS cs FROM conversations WHERE text <> '')))""",
    "pieces": """pieces AS (SELECT rec_id, channel, msg_no, pos, CASE WHEN before = ' ' THEN ' ' || token ELSE token END AS token, ts_ms FROM (
        SELECT *, lag(token) OVER (PARTITION BY rec_id, channel, msg_no ORDER BY pos) AS before FROM chars) WHERE token <> ' ')""",
    "frames": """frames AS (SELECT rec_id, n * 20 + k AS frame_no, prob FROM (
        SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CAST(round(value * 100) AS BIGINT) % 100 AS prob FROM events), range(20) AS r(k))""",
    "segments": """segments AS (SELECT event_id % n AS rec_id, event_id AS seg_ord, (event_id * 7919) % 200000 AS start_ms,
        (event_id * 7919) % 200000 + CAST(round(value * 100) AS BIGINT) AS end_ms, 's' || CAST(user_id % 3 AS VARCHAR) AS speaker
        FROM events, (SELECT max(conv_id) + 1 AS n FROM conversations))""",
}
