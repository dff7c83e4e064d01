"""Speech segments and cut points from frame probabilities.

frames: rec_id, frame_no, prob, where prob is in hundredths. A frame is 512 samples at 16 kHz, 32 ms.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.scan import Scan

FRAME, RATE = 512, 16_000
#: Thresholds of the sensitivity modes, in hundredths, and that of any other mode.
MODES, OTHER_MODE = {1: 70, 2: 60, 3: 50, 4: 30, 5: 15}, 50


def threshold(mode: Column) -> Column:
    """The threshold of a sensitivity mode."""
    out = F.lit(OTHER_MODE)
    for k, v in MODES.items():
        out = F.when(mode == k, v).otherwise(out)
    return out


def segments(frames: DataFrame, high: int = 50, below: int = 15, least_ms: int = 150, silence_ms: int = 1000, spread: bool = False) -> DataFrame:
    """Segments (rec_id, seg_no, start, end, n_samples) in samples, with hysteresis.

    Speech begins at a frame of at least ``high``. It ends at the first frame under ``high - below`` if one at
    least ``silence_ms`` behind is too and none between reaches ``high``; else with the recording. Segments
    must be longer than ``least_ms``. Low frames are summed up between neighbouring high ones, which decides
    every end by itself; no state passes from frame to frame.

    Frames without a probability are neither high nor low; repeated frames change nothing. ``spread`` is for recordings with very
    many frames, see ``Scan``; it gives the same rows. An empty table gives none.
    """
    key = ["rec_id"]
    is_high = F.when(F.col("prob") >= high, F.col("frame_no"))
    since = Scan(frames.select("rec_id", "frame_no", "prob"), key, ["frame_no"], spread).latest(_high=is_high).done()
    low = F.when(F.col("prob") < high - below, F.col("frame_no"))
    tops = frames.groupBy("rec_id").agg((F.max("frame_no") + 1).alias("_n"))
    highs = since.filter("_high IS NOT NULL").groupBy("rec_id", "_high").agg(F.min(low).alias("_low"), F.max(low).alias("_last_low"))
    silent = F.coalesce((F.col("_last_low") - F.col("_low")) * FRAME * 1000 >= silence_ms * RATE, F.lit(False))
    marked = Scan(highs.withColumn("_silent", silent), key, ["_high"], spread).facts(tops).before(_cut=F.col("_silent"))
    marked = marked.totals(_seg=F.coalesce("_cut", F.lit(False)).cast("int")).done()
    found = marked.groupBy("rec_id", "_seg").agg(
        F.min("_high").alias("_from"), F.max_by(F.when(F.col("_silent"), F.col("_low")).otherwise(F.col("_n")), "_high").alias("_to"), F.first("_n").alias("_n")
    )
    out = found.select("rec_id", (F.col("_from") * FRAME).alias("start"), (F.col("_to") * FRAME).alias("end"), (F.col("_n") * FRAME).alias("n_samples"))
    out = out.filter((F.col("end") - F.col("start")) * 1000 > least_ms * RATE)
    return Scan(out, key, ["start"], spread).totals(seg_no=F.lit(1).cast("long")).done()


def padded(segments_: DataFrame, pad_ms: int = 30) -> DataFrame:
    """Segments with ``pad_ms`` on either side; a shorter pause between two is split in halves."""
    pad = pad_ms * RATE // 1000
    in_order = Window.partitionBy("rec_id").orderBy("start")
    before, behind = F.col("start") - F.lag("end").over(in_order), F.lead("start").over(in_order) - F.col("end")

    def room(pause: Column) -> Column:
        return F.when(pause < 2 * pad, F.floor(pause / 2)).otherwise(pad)

    start = F.greatest(F.lit(0), F.col("start") - F.coalesce(room(before), F.lit(pad)))
    end = F.when(behind < 2 * pad, F.col("end") + F.floor(behind / 2)).otherwise(F.least("n_samples", F.col("end") + pad))
    return segments_.withColumns({"start": start.cast("long"), "end": end.cast("long")})


def cut_points(frames: DataFrame, high: int = 50, silence_ms: int = 500) -> DataFrame:
    """Where to cut each recording: from its end back to a third of it, the first frame that completes
    ``silence_ms`` of frames under ``high``; a third of it where there is none."""
    need = silence_ms * RATE // (1000 * FRAME)
    back = Window.partitionBy("rec_id").orderBy(F.desc("frame_no"))
    silent = F.col("prob") < high
    marked = frames.withColumns({"n_frames": F.first("frame_no").over(back) + 1, "_loud": F.last(F.when(~silent, F.col("frame_no")), True).over(back)})
    late = marked.withColumn("first_frame", F.floor(F.col("n_frames") / 3)).filter("frame_no >= first_frame")
    completes = silent & (F.coalesce("_loud", "n_frames") - F.col("frame_no") == need)
    out = late.groupBy("rec_id").agg(F.first("n_frames").alias("n_frames"), F.first("first_frame").alias("_first"), F.max(F.when(completes, F.col("frame_no"))).alias("_cut"))
    return out.select("rec_id", "n_frames", F.coalesce("_cut", "_first").cast("long").alias("cut_frame"), F.col("_cut").isNotNull().alias("in_silence"))
