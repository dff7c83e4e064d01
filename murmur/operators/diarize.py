"""Words and speaker segments: overlaps, runs, nearest fills, replicas and merges."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.scan import Scan
from murmur.operators.tokens import joined

WORD = ["rec_id", "channel", "msg_no", "pos"]
MESSAGE = ["rec_id", "channel", "msg_no"]
#: Length of the shortest stretches by which words and segments meet; fixes the size of a join's groups.
STRETCH_MS = 30_000


def _level(length: Column) -> Column:
    """The least level whose stretches, STRETCH_MS * 4 ** level long, are as long as an interval: it touches two of them at most."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1)) / STRETCH_MS) / 2)).cast("int")


def _placed(intervals: DataFrame, levels: list[int], mark: str) -> DataFrame:
    """Intervals (start, end, level) in every stretch that they touch, of their own and of each longer level, with the first
    of that level."""
    wide = intervals.withColumn("at", F.explode(F.filter(F.array(*(F.lit(x) for x in levels)), lambda x: x >= F.col(f"{mark}level"))))
    size = F.lit(STRETCH_MS).cast("long") * F.pow(F.lit(4), F.col("at")).cast("long")
    ends = wide.withColumns({f"{mark}first": F.floor(F.col(f"{mark}start") / size), "_last": F.floor(F.col(f"{mark}end") / size)})
    return ends.withColumn("stretch", F.explode(F.sequence(f"{mark}first", "_last"))).drop("_last")


def assign_speakers(words: DataFrame, segments: DataFrame, min_overlap: float = 0.5) -> DataFrame:
    """words and a column speaker: that of the segment with the largest overlap of at least ``min_overlap`` of the
    word, the earlier segment on a tie, null without one. A word without length lies in [start, end) or not.

    Words' times, each once, and segments meet by recording and stretch of time. An interval lies in stretches of its own
    length or longer, two of a level at most, and two intervals meet in the longer one's level, where the later one begins;
    so one wrong end, however late, costs one row. The driver sees the levels in use, of which there are 25 or so at most.

    Every row of words stays, repeated rows and words with null times too, which get no speaker. Segments with null
    times or an end before their start count for nothing. Either table may be empty; a column speaker of words is replaced.
    """
    times = words.filter("start_ms <= end_ms AND rec_id IS NOT NULL").groupBy(F.col("rec_id").alias("rec"), F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end")).agg(F.lit(1).alias("one")).drop("one")
    held = segments.filter("start_ms <= end_ms").select(F.col("rec_id").alias("s_rec"), F.col("start_ms").alias("s_start"), F.col("end_ms").alias("s_end"), "seg_ord", F.col("speaker").alias("s_speaker"))
    times, held = times.withColumn("w_level", _level(F.col("w_end") - F.col("w_start"))), held.withColumn("s_level", _level(F.col("s_end") - F.col("s_start")))
    levels = sorted(r[0] for r in times.select("w_level").union(held.select("s_level")).distinct().collect())
    if not levels:
        levels = [0]
    wide, held = _placed(times, levels, "w_"), _placed(held, levels, "s_").withColumnsRenamed({"at": "s_at", "stretch": "s_stretch"})
    met = wide.join(held, (F.col("rec") == F.col("s_rec")) & (F.col("at") == F.col("s_at")) & (F.col("stretch") == F.col("s_stretch")))
    met = met.filter("at = greatest(w_level, s_level) AND stretch = greatest(w_first, s_first)")
    shared = F.least("w_end", "s_end") - F.greatest("w_start", "s_start")
    length = F.col("w_end") - F.col("w_start")
    overlap = F.when(length == 0, ((F.col("s_start") <= F.col("w_start")) & (F.col("w_start") < F.col("s_end"))).cast("long")).otherwise(shared)
    counted = met.withColumn("overlap", overlap).filter((F.col("overlap") > 0) & ((length == 0) | (F.col("overlap") / length >= min_overlap)))
    best = counted.groupBy(F.col("rec").alias("_rec"), F.col("w_start").alias("_start"), F.col("w_end").alias("_end")).agg(F.max(F.struct("overlap", -F.col("s_start"), -F.col("seg_ord"), "s_speaker")).alias("_best"))
    kept = [c for c in words.columns if c != "speaker"]
    out = words.select(*kept).join(best, (F.col("rec_id") == F.col("_rec")) & (F.col("start_ms") == F.col("_start")) & (F.col("end_ms") == F.col("_end")), "left")
    return out.select(*kept, F.col("_best.s_speaker").alias("speaker"))


def speaker_runs(assigned: DataFrame) -> DataFrame:
    """Runs of words of one speaker in a message; unassigned words break a run and make none. Repeated words count each; words
    without a place come first in their message, and null keys are a message of their own. An empty table gives none."""
    in_order = Window.partitionBy(*MESSAGE).orderBy("pos")
    change = ((F.row_number().over(in_order) == 1) | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(in_order))).cast("int")
    numbered = assigned.withColumn("_change", change).withColumn("run_no", F.sum("_change").over(in_order).cast("long"))
    runs = numbered.filter("speaker IS NOT NULL").groupBy(*MESSAGE, "run_no")
    return runs.agg(F.first("speaker").alias("speaker"), F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"), F.count("*").alias("n_words"))


def fill_nearest(assigned: DataFrame) -> DataFrame:
    """Give each unassigned word the speaker of the nearer of two runs of its message: the last that ended by its
    start and the first that starts by its end or later, the latter on a tie.

    Words of a message come in time order, so the runs around a word are those of its neighbours; one ordered
    pass in each direction finds them. Every row stays, repeated ones too; a word without times stays
    without a speaker, and a run without times offers none. Columns _run, _run_start, _run_end, _prev and _next are taken for this.
    """
    in_order = Window.partitionBy(*MESSAGE).orderBy("pos")
    run_change = (~F.col("speaker").eqNullSafe(F.lag("speaker").over(in_order))).cast("int")
    numbered = assigned.withColumn("_run", F.sum(run_change).over(in_order))
    run = Window.partitionBy(*MESSAGE, "_run")
    marked = numbered.withColumns({"_run_start": F.min("start_ms").over(run), "_run_end": F.max("end_ms").over(run)})
    known = F.when(F.col("speaker").isNotNull(), F.struct("speaker", "_run_start", "_run_end"))
    before, behind = in_order.rowsBetween(Window.unboundedPreceding, -1), in_order.rowsBetween(1, Window.unboundedFollowing)
    placed = marked.withColumns({"_prev": F.last(known, True).over(before), "_next": F.first(known, True).over(behind)})
    prev = F.when(F.col("_prev._run_end") <= F.col("start_ms"), F.col("_prev"))
    next_ = F.when(F.col("_next._run_start") >= F.col("end_ms"), F.col("_next"))
    nearer = F.when((F.col("start_ms") - prev["_run_end"]) < (next_["_run_start"] - F.col("end_ms")), prev["speaker"]).otherwise(next_["speaker"])
    filled = F.coalesce("speaker", F.when(prev.isNotNull() & next_.isNotNull(), nearer), prev["speaker"], next_["speaker"])
    return placed.withColumn("speaker", filled).drop("_run", "_run_start", "_run_end", "_prev", "_next")


def _islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str) -> DataFrame:
    in_order = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(in_order).cast("long"))


def replicas(assigned: DataFrame, max_pause_ms: int = 2000) -> DataFrame:
    """A speaker's words in a message, cut where the pause is longer than ``max_pause_ms``; words without a
    speaker are those of ``unknown``. group_start_ms and group_end_ms span all of the speaker's replicas there. Repeated words
    count each, words without times make no pause, null words add nothing to the text. An empty table gives none."""
    keys = [*MESSAGE, "speaker"]
    named = assigned.withColumn("speaker", F.coalesce("speaker", F.lit("unknown")))
    since = F.col("start_ms") - F.lag("end_ms").over(Window.partitionBy(*keys).orderBy("start_ms", "pos"))
    cut = _islands(named, keys, ["start_ms", "pos"], since > max_pause_ms, "replica_no")
    out = cut.groupBy(*keys, "replica_no").agg(joined("word", "start_ms", "pos", sep=" ").alias("text"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", F.struct("start_ms", "pos")).alias("end_ms"), F.count("*").alias("n_words"))
    whole = Window.partitionBy(*keys)
    return out.withColumns({"group_start_ms": F.min("start_ms").over(whole), "group_end_ms": F.max_by("end_ms", "replica_no").over(whole)})


def with_metadata(found: DataFrame, messages: DataFrame, but: tuple[str, ...] = ("text",)) -> DataFrame:
    """Rows of messages, such as replicas, with what else is known of their message: the other columns of ``messages``,
    one row a message, other than ``but`` and those that the rows have. Rows of an unknown message get nulls."""
    more = [c for c in messages.columns if c not in but and c not in found.columns]
    known = messages.select(*MESSAGE, *more)
    return found.join(known, MESSAGE, "left").select(*found.columns, *more)


def word_groups(words: DataFrame, gap_ms: int = 500, spread: bool = False) -> DataFrame:
    """Words of a channel, in time order, cut where a word starts more than ``gap_ms`` behind the one before; null times make no
    cut. ``spread`` is for channels with very many words, see ``Scan``; it gives the same rows."""
    keys, order = ["rec_id", "channel"], ["start_ms", "msg_no", "pos"]
    marked = Scan(words.select(*keys, *order, "end_ms"), keys, order, spread).before(_end=F.col("end_ms"))
    cut = marked.totals(group_no=F.coalesce(F.col("start_ms") - F.col("_end") > gap_ms, F.lit(False)).cast("long")).done()
    return cut.groupBy(*keys, "group_no").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"))


def long_enough(segments: DataFrame, least_ms: int = 150) -> DataFrame:
    """Segments of at least ``least_ms``."""
    return segments.filter(F.col("end_ms") - F.col("start_ms") >= least_ms)


def merge_segments(segments: DataFrame, gap_ms: int = 1000, order: list[str] | None = None, merge: bool = True) -> DataFrame:
    """Neighbouring segments of a recording with one speaker become one if the pause is at most ``gap_ms``; without
    ``merge`` they are only numbered in their order, as some callers have always seen them. A null speaker or time parts no
    neighbours by itself; repeated segments count each; an empty table gives none."""
    order = order or ["start_ms", "seg_ord"]
    in_order = Window.partitionBy("rec_id").orderBy(*order)
    other = F.row_number().over(in_order) > 1 if not merge else (F.col("speaker") != F.lag("speaker").over(in_order)) | (F.col("start_ms") - F.lag("end_ms").over(in_order) > gap_ms)
    cut = _islands(segments, ["rec_id"], order, other, "merged_no")
    place = F.struct(*order)
    return cut.groupBy("rec_id", "merged_no").agg(F.first("speaker").alias("speaker"), F.min_by("start_ms", place).alias("start_ms"), F.max_by("end_ms", place).alias("end_ms"), F.count("*").alias("n_segments"))


def without_overlap(segments: DataFrame) -> DataFrame:
    """Segments of a recording that end at the latest where the next one starts."""
    following = F.lead("start_ms").over(Window.partitionBy("rec_id").orderBy("start_ms", "seg_ord"))
    return segments.withColumn("end_ms", F.least("end_ms", F.coalesce(following, "end_ms")))


def subsegments(segments: DataFrame, window: int = 150, step: int = 75, frame_ms: int = 10) -> DataFrame:
    """Sliding windows of ``window`` frames over each segment's frames, every ``step`` frames; what a window
    lacks at the end it repeats from its own start (n_real frames are real). Segments with null times or of no whole frame give
    none."""
    n = F.floor((F.col("end_ms") - F.col("start_ms")) / frame_ms).cast("long")
    last = F.greatest(F.col("n_frames") - window + step - 1, F.lit(0))
    starts = F.sequence(F.lit(0).cast("long"), F.when(F.col("n_frames") <= window, F.lit(0).cast("long")).otherwise(last), F.lit(step).cast("long"))
    out = segments.withColumn("n_frames", n).filter("n_frames > 0").withColumn("first_frame", F.explode(starts))
    return out.withColumn("n_real", F.least(F.lit(window).cast("long"), F.col("n_frames") - F.col("first_frame")))


def cyclic(values: Column, length: int) -> Column:
    """An array of ``length`` items, repeated from its start where it is shorter."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.element_at(values, (i % F.size(values) + 1).cast("int")))


def channel_guard(recordings: DataFrame) -> DataFrame:
    """Recordings of exactly one channel, those that diarization takes."""
    return recordings.groupBy("rec_id").agg(F.countDistinct("channel").alias("n_channels")).withColumn("can_diarize", F.col("n_channels") == 1)
