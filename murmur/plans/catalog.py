"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from murmur.functions import audio, labels, models, nested, text
from murmur.operators import density, diarize, echo, embeddings, layout, sentences, timeline, tokens, vad
from murmur.options import PipelineOptions
from murmur.plans.transcript import transcribe
from murmur.sources import derived as d
from murmur.sources import files, sinks
from murmur.sources.scratch import materialise
from murmur.streaming import config, session, voice

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, *relations: str):
    """Register a query; ``relations`` are the derived relations that its SQL stands on, in order."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (f"WITH {', '.join(d.SQL[r] for r in relations)}, {sql.strip().removeprefix('WITH ')}" if sql.strip().startswith("WITH ") else f"WITH {', '.join(d.SQL[r] for r in relations)} {sql}") if relations else sql
        return f

    return register


# Sentences and dialogues.

_SENTENCES = """
    ends AS (SELECT *, lag(end_ms) OVER (PARTITION BY rec_id, channel ORDER BY msg_no, pos) AS prev FROM words),
    limits AS (SELECT rec_id, channel, round(quantile_cont(end_ms - prev, {p}), 6) AS lim FROM ends GROUP BY rec_id, channel),
    cut AS (SELECT ends.*, sum(CASE WHEN start_ms - prev >= lim THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, channel ORDER BY msg_no, pos) AS s
            FROM ends JOIN limits USING (rec_id, channel)),
    sentences AS (SELECT rec_id, channel, CAST(s AS BIGINT) AS sentence_no, first(start_ms ORDER BY msg_no, pos) AS start_ms, last(end_ms ORDER BY msg_no, pos) AS end_ms,
                  string_agg(word, ' ' ORDER BY msg_no, pos) AS text, count(*) AS n_words FROM cut GROUP BY rec_id, channel, s)"""
_S80 = _SENTENCES.format(p=0.8)


@query("dialogue_sentences", f"WITH {_S80} SELECT * FROM sentences", "words")
def dialogue_sentences(spark, sf_dir):
    return sentences.sentences(d.words(spark, sf_dir))


@query("dialogue_sentences_spread", f"WITH {_S80} SELECT * FROM sentences", "words")
def dialogue_sentences_spread(spark, sf_dir):
    """As ``dialogue_sentences``, for channels of any length."""
    return sentences.sentences(d.words(spark, sf_dir), spread=True)


@query("dialogue_sentences_p90", f"WITH {_SENTENCES.format(p=0.9)} SELECT * FROM sentences", "words")
def dialogue_sentences_p90(spark, sf_dir):
    return sentences.sentences(d.words(spark, sf_dir), 90)


@query("dialogue_sentences_compat", f"""WITH {_S80}
    SELECT rec_id, channel, CAST(s AS BIGINT) AS sentence_no, coalesce(first(start_ms ORDER BY msg_no, pos) FILTER (start_ms <> 0), min(start_ms)) AS start_ms,
           last(end_ms ORDER BY msg_no, pos) AS end_ms, string_agg(word, ' ' ORDER BY msg_no, pos) AS text, count(*) AS n_words FROM cut GROUP BY rec_id, channel, s""", "words")
def dialogue_sentences_compat(spark, sf_dir):
    return sentences.sentences(d.words(spark, sf_dir), compat=True)


@query("dialogue_text", rf"""WITH {_S80} SELECT rec_id, string_agg(channel || ': ' || text || chr(10), '' ORDER BY start_ms, channel, sentence_no) AS dialogue, count(*) AS n_sentences
    FROM sentences GROUP BY rec_id""", "words")
def dialogue_text(spark, sf_dir):
    return sentences.dialogue(sentences.sentences(d.words(spark, sf_dir)))


@query("readable_lines", f"""WITH {_S80} SELECT rec_id, channel, sentence_no, start_ms,
    CASE WHEN count(DISTINCT channel) OVER (PARTITION BY rec_id) > 1 THEN 'Спикер_' || channel || ': ' || trim(text) ELSE trim(text) END AS line FROM sentences""", "words")
def readable_lines(spark, sf_dir):
    return sinks.readable_lines(sentences.sentences(d.words(spark, sf_dir)))


_JSON = """to_json(list(json_object('start', start_ms, 'end', end_ms, 'text', text, 'speaker', channel) ORDER BY start_ms, channel, sentence_no))"""


@query("response_envelopes", f"""WITH {_S80} SELECT rec_id, CAST(json_object('success', true, 'result', json_object('raw_data', json_object('list_of_sentenced_recognitions', {_JSON}))) AS VARCHAR) AS json
    FROM sentences GROUP BY rec_id""", "words")
def response_envelopes(spark, sf_dir):
    return sinks.envelopes(sentences.sentences(d.words(spark, sf_dir)))


@query("channel_full_text", """SELECT conv_id AS rec_id, role AS channel, string_agg(text || ' ', '' ORDER BY turn) AS full_text, count(*) AS n_messages
    FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, role""")
def channel_full_text(spark, sf_dir):
    return sentences.full_texts(d.messages(spark, sf_dir))


@query("error_states", """, SELECT DISTINCT conv_id AS rec_id, role AS channel,
    CASE WHEN NOT EXISTS (SELECT 1 FROM words w WHERE w.rec_id = conv_id AND w.channel = role) THEN 'Err_No_words in ' || role END AS err_state FROM conversations""".lstrip(", "), "words")
def error_states(spark, sf_dir):
    return sentences.error_states(d.messages(spark, sf_dir).select("rec_id", "channel").distinct(), d.words(spark, sf_dir))


# Tokens.


@query("token_words_leading_space", """WITH numbered AS (SELECT *, sum(CASE WHEN starts_with(token, ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, channel, msg_no ORDER BY pos) AS n FROM pieces),
    found AS (SELECT rec_id, channel, msg_no, CAST(n AS BIGINT) AS word_no, trim(string_agg(token, '' ORDER BY pos), ' ') AS word, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms
              FROM numbered GROUP BY rec_id, channel, msg_no, n)
    SELECT * FROM found WHERE word <> ''""", "chars", "pieces")
def token_words_leading_space(spark, sf_dir):
    return tokens.words_by_leading_space(d.pieces(spark, sf_dir))


@query("token_words_compat", """WITH numbered AS (SELECT *, sum(CASE WHEN starts_with(token, ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, channel, msg_no ORDER BY pos) AS n FROM pieces)
    SELECT rec_id, channel, msg_no, CAST(n AS BIGINT) AS word_no, trim(string_agg(token, '' ORDER BY pos), ' ') AS word, 1500 + CASE WHEN n = 0 THEN 0 ELSE min(ts_ms) END AS start_ms, 1500 + max(ts_ms) AS end_ms
    FROM numbered GROUP BY rec_id, channel, msg_no, n""", "chars", "pieces")
def token_words_compat(spark, sf_dir):
    return tokens.words_by_leading_space(d.pieces(spark, sf_dir), shift_ms=1500, compat=True)


@query("token_words_gap", """WITH marked AS (SELECT *, lag(token) OVER w AS before, ts_ms - lag(ts_ms) OVER w AS since FROM chars WINDOW w AS (PARTITION BY rec_id, channel, msg_no ORDER BY pos)),
    numbered AS (SELECT *, sum(CASE WHEN before = ' ' OR since > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, channel, msg_no ORDER BY pos) AS n FROM marked WHERE token <> ' ')
    SELECT rec_id, channel, msg_no, CAST(n AS BIGINT) AS word_no, string_agg(token, '' ORDER BY pos) AS word, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms FROM numbered GROUP BY rec_id, channel, msg_no, n""", "chars")
def token_words_gap(spark, sf_dir):
    return tokens.words_by_gap(d.chars(spark, sf_dir))


_RATES = """pauses AS (SELECT *, CASE WHEN token = ' ' THEN lead(ts_ms) OVER (PARTITION BY rec_id, channel, msg_no ORDER BY pos) - ts_ms END AS pause FROM chars),
    spoken AS (SELECT rec_id, channel, msg_no, CAST(sum(CASE WHEN token <> ' ' THEN 1 ELSE 0 END) AS BIGINT) AS n_letters, CAST(last(ts_ms ORDER BY pos) - coalesce(sum(pause), 0) AS BIGINT) AS spoken_ms
               FROM pauses GROUP BY rec_id, channel, msg_no),
    rates AS (SELECT *, CAST(CASE WHEN n_letters > 0 AND spoken_ms > 0 THEN n_letters * 1000 // spoken_ms ELSE 0 END AS BIGINT) AS rate FROM spoken)"""


@query("speech_rate", f"WITH {_RATES} SELECT *, CASE WHEN rate > 18 THEN round(greatest(17.0::DOUBLE / rate, 0.8::DOUBLE), 6) ELSE 1.0::DOUBLE END AS slow_down FROM rates", "chars")
def speech_rate(spark, sf_dir):
    return tokens.speech_rate(d.chars(spark, sf_dir))


@query("sticky_multiplier", f"""WITH {_RATES} SELECT rec_id, channel, msg_no, rate, coalesce(first_value(CASE WHEN rate > 9 THEN round(greatest(8.0::DOUBLE / rate, 0.8::DOUBLE), 6) END IGNORE NULLS)
    OVER (PARTITION BY rec_id ORDER BY channel, msg_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0::DOUBLE) AS multiplier FROM rates""", "chars")
def sticky_multiplier(spark, sf_dir):
    rates = tokens.speech_rate(d.chars(spark, sf_dir)).select("rec_id", "channel", "msg_no", "rate")
    return timeline.sticky_multiplier(rates, fast=9, target=8.0)


@query("token_confidence", """WITH placed AS (SELECT rec_id, word AS token, CAST(round_even(pos * 350 / 500.0::DOUBLE, 0) * 500 AS BIGINT) AS ts_ms, msg_no, pos FROM words),
    n AS (SELECT rec_id, count(DISTINCT msg_no) AS trials FROM placed GROUP BY rec_id)
    SELECT rec_id, token, ts_ms, count(*) AS votes, round(count(*)::DOUBLE / any_value(trials), 4) AS conf, first(msg_no ORDER BY msg_no, pos) AS first_trial, first(pos ORDER BY msg_no, pos) AS first_pos
    FROM placed JOIN n USING (rec_id) GROUP BY rec_id, token, ts_ms""", "words")
def token_confidence(spark, sf_dir):
    w = d.words(spark, sf_dir)
    return tokens.token_confidence(w.select("rec_id", F.col("word").alias("token"), (F.col("pos") * 350).alias("ts_ms"), "msg_no", "pos"))


# Time.


@query("tumbling_chunks", """WITH counts AS (SELECT rec_id, channel, start_ms // 30000 AS chunk_no, count(*) AS n_words, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM words GROUP BY ALL)
    SELECT *, lead(chunk_no) OVER (PARTITION BY rec_id, channel ORDER BY chunk_no) IS NULL AS is_last FROM counts""".replace("start_ms // 30000 AS chunk_no, count(*)", "words.start_ms // 30000 AS chunk_no, count(*)").replace("GROUP BY ALL", "GROUP BY rec_id, channel, words.start_ms // 30000"), "words")
def tumbling_chunks(spark, sf_dir):
    return timeline.tumbling_chunks(d.words(spark, sf_dir))


@query("chunk_offsets", """SELECT conv_id AS rec_id, role AS channel, turn AS msg_no, duration_ms, ok,
    CAST(coalesce(sum(CASE WHEN ok THEN duration_ms ELSE 0 END) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms
    FROM (SELECT *, 1000 + 50 * length(text) AS duration_ms, length(text) % 5 <> 0 AS ok FROM conversations)""")
def chunk_offsets(spark, sf_dir):
    chunks = d.messages(spark, sf_dir).select("rec_id", "channel", "msg_no", (1000 + 50 * F.length("text")).cast("long").alias("duration_ms"), (F.length("text") % 5 != 0).alias("ok"))
    return timeline.chunk_offsets(chunks)


@query("task_states", """SELECT rec_id, tasks, CASE WHEN tasks = 0 THEN 'idle' ELSE 'in_work' END AS state FROM (
    SELECT conv_id AS rec_id, count(*) FILTER (length(text) % 7 = 0) AS tasks FROM conversations GROUP BY conv_id)""")
def task_states(spark, sf_dir):
    done = F.when(F.length("text") % 7 != 0, F.col("text"))
    return timeline.task_states(d.messages(spark, sf_dir).withColumn("text", done))


@query("message_order", "SELECT conv_id AS rec_id, role AS channel, turn AS msg_no, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS running FROM conversations")
def message_order(spark, sf_dir):
    return timeline.message_index(d.messages(spark, sf_dir)).drop("text")


# Voice activity.

_VAD = """since AS (SELECT *, last_value(CASE WHEN prob >= 50 THEN frame_no END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY frame_no) AS high FROM frames),
    highs AS (SELECT rec_id, high, min(CASE WHEN prob < 35 THEN frame_no END) AS low, max(CASE WHEN prob < 35 THEN frame_no END) AS last_low FROM since WHERE high IS NOT NULL GROUP BY rec_id, high),
    sizes AS (SELECT rec_id, max(frame_no) + 1 AS n FROM frames GROUP BY rec_id),
    marked AS (SELECT *, coalesce((last_low - low) * 512 * 1000 >= 1000 * 16000, false) AS silent FROM highs JOIN sizes USING (rec_id)),
    cuts AS (SELECT *, coalesce(lag(silent) OVER (PARTITION BY rec_id ORDER BY high), false) AS cut FROM marked),
    numbered AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY high) AS seg FROM cuts),
    found AS (SELECT rec_id, min(high) * 512 AS "start", last(CASE WHEN silent THEN low ELSE n END ORDER BY high) * 512 AS "end", any_value(n) * 512 AS n_samples FROM numbered GROUP BY rec_id, seg),
    kept AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY "start") AS seg_no FROM found WHERE ("end" - "start") * 1000 > 150 * 16000)"""


@query("vad_segments", f"WITH {_VAD} SELECT * FROM kept", "frames")
def vad_segments(spark, sf_dir):
    return vad.segments(d.frames(spark, sf_dir))


@query("vad_padded", f"""WITH {_VAD}, near AS (SELECT *, "start" - lag("end") OVER w AS before, lead("start") OVER w - "end" AS behind FROM kept WINDOW w AS (PARTITION BY rec_id ORDER BY "start"))
    SELECT rec_id, n_samples, seg_no, greatest(0, "start" - CASE WHEN before < 960 THEN before // 2 ELSE 480 END) AS "start",
           CASE WHEN behind < 960 THEN "end" + behind // 2 ELSE least(n_samples, "end" + 480) END AS "end" FROM near""", "frames")
def vad_padded(spark, sf_dir):
    return vad.padded(vad.segments(d.frames(spark, sf_dir)))


@query("vad_cut_points", """WITH sizes AS (SELECT rec_id, max(frame_no) + 1 AS n_frames FROM frames GROUP BY rec_id),
    late AS (SELECT *, n_frames // 3 AS first_frame FROM frames JOIN sizes USING (rec_id) WHERE frame_no >= n_frames // 3),
    runs AS (SELECT *, CASE WHEN prob < 50 THEN sum(CASE WHEN prob < 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY frame_no ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) END AS silent FROM late),
    found AS (SELECT rec_id, max(frame_no) AS cut FROM runs WHERE silent = 15 GROUP BY rec_id)
    SELECT DISTINCT rec_id, n_frames, coalesce(cut, first_frame) AS cut_frame, cut IS NOT NULL AS in_silence FROM late LEFT JOIN found USING (rec_id)""", "frames")
def vad_cut_points(spark, sf_dir):
    return vad.cut_points(d.frames(spark, sf_dir))


@query("vad_thresholds", """SELECT user_id AS rec_id, event_id, mode, CASE mode WHEN 1 THEN 70 WHEN 2 THEN 60 WHEN 3 THEN 50 WHEN 4 THEN 30 WHEN 5 THEN 15 ELSE 50 END AS threshold
    FROM (SELECT *, event_id % 7 AS mode FROM events)""")
def vad_thresholds(spark, sf_dir):
    mode = F.pmod("event_id", F.lit(7))
    return d.table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), "event_id", mode.alias("mode"), vad.threshold(mode).alias("threshold"))


@query("framed_samples", """WITH held AS (SELECT rec_id, list(CAST(prob AS DOUBLE) ORDER BY frame_no) AS v FROM frames WHERE frame_no % 20 = 0 GROUP BY rec_id)
    SELECT rec_id, k AS frame, CAST(list_sum(v[k * 16 + 1 : k * 16 + 16]) AS DOUBLE) AS level, CAST(16 AS INTEGER) AS size FROM (SELECT rec_id, v, unnest(range((len(v) + 15) // 16)) AS k FROM held)""".replace("k AS frame", "CAST(k AS INTEGER) AS frame"), "frames")
def framed_samples(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("frame_no", F.col("prob").cast("double").alias("prob"))))
    held = d.frames(spark, sf_dir, repeat=1).groupBy("rec_id").agg(F.transform(ordered, lambda r: r["prob"]).alias("v"))
    out = held.select("rec_id", F.posexplode(timeline.framed(F.col("v"), 16)).alias("frame", "samples"))
    return out.select("rec_id", "frame", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("level"), F.size("samples").alias("size"))


# Speakers.

_ASSIGNED = """met AS (SELECT w.rec_id, w.channel, w.msg_no, w.pos, s.speaker, s.start_ms AS f, s.seg_ord,
        CASE WHEN w.end_ms = w.start_ms THEN CASE WHEN s.start_ms <= w.start_ms AND w.start_ms < s.end_ms THEN 1.0 ELSE 0.0 END ELSE greatest(0, least(w.end_ms, s.end_ms) - greatest(w.start_ms, s.start_ms)) END AS overlap,
        w.end_ms - w.start_ms AS len FROM words w JOIN segments s ON w.rec_id = s.rec_id AND s.start_ms <= w.end_ms AND s.end_ms >= w.start_ms),
    best AS (SELECT rec_id, channel, msg_no, pos, first(speaker ORDER BY overlap DESC, f, seg_ord) AS speaker FROM met
             WHERE overlap > 0 AND (len = 0 OR overlap / len >= 0.5) GROUP BY rec_id, channel, msg_no, pos),
    assigned AS (SELECT words.*, speaker FROM words LEFT JOIN best USING (rec_id, channel, msg_no, pos))"""
_RUNS = """changes AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER w THEN 1 ELSE 0 END AS change FROM assigned WINDOW w AS (PARTITION BY rec_id, channel, msg_no ORDER BY pos)),
    runs AS (SELECT *, sum(change) OVER (PARTITION BY rec_id, channel, msg_no ORDER BY pos) AS run FROM changes)"""
_FILLED = """spans AS (SELECT rec_id, channel, msg_no, run, speaker AS run_speaker, first(start_ms ORDER BY pos) AS rs, last(end_ms ORDER BY pos) AS re FROM runs WHERE speaker IS NOT NULL GROUP BY rec_id, channel, msg_no, run, speaker),
    before AS (SELECT r.rec_id, r.channel, r.msg_no, r.pos, max_by(s.run_speaker, s.re) AS sp, max(s.re) AS re FROM runs r JOIN spans s USING (rec_id, channel, msg_no) WHERE r.speaker IS NULL AND s.re <= r.start_ms GROUP BY ALL),
    behind AS (SELECT r.rec_id, r.channel, r.msg_no, r.pos, min_by(s.run_speaker, s.rs) AS sn, min(s.rs) AS rs FROM runs r JOIN spans s USING (rec_id, channel, msg_no) WHERE r.speaker IS NULL AND s.rs >= r.end_ms AND s.re > r.start_ms GROUP BY ALL),
    filled AS (SELECT r.rec_id, r.channel, r.msg_no, r.pos, r.word, r.start_ms, r.end_ms,
        coalesce(r.speaker, CASE WHEN sp IS NOT NULL AND sn IS NOT NULL THEN CASE WHEN r.start_ms - b.re < h.rs - r.end_ms THEN sp ELSE sn END END, sp, sn) AS speaker
        FROM runs r LEFT JOIN before b USING (rec_id, channel, msg_no, pos) LEFT JOIN behind h USING (rec_id, channel, msg_no, pos))"""


def _assigned(spark, sf_dir):
    return diarize.assign_speakers(d.words(spark, sf_dir), d.segments(spark, sf_dir))


@query("word_speakers", f"WITH {_ASSIGNED} SELECT * FROM assigned", "words", "segments")
def word_speakers(spark, sf_dir):
    return _assigned(spark, sf_dir)


@query("speaker_runs", f"""WITH {_ASSIGNED}, {_RUNS} SELECT rec_id, channel, msg_no, CAST(run AS BIGINT) AS run_no, any_value(speaker) AS speaker, first(start_ms ORDER BY pos) AS start_ms, last(end_ms ORDER BY pos) AS end_ms, count(*) AS n_words
    FROM runs WHERE speaker IS NOT NULL GROUP BY rec_id, channel, msg_no, run""", "words", "segments")
def speaker_runs(spark, sf_dir):
    return diarize.speaker_runs(_assigned(spark, sf_dir))


@query("nearest_fill", f"WITH {_ASSIGNED}, {_RUNS}, {_FILLED} SELECT * FROM filled", "words", "segments")
def nearest_fill(spark, sf_dir):
    return diarize.fill_nearest(_assigned(spark, sf_dir))


@query("replicas", f"""WITH {_ASSIGNED}, {_RUNS}, {_FILLED}, named AS (SELECT * REPLACE (coalesce(speaker, 'unknown') AS speaker) FROM filled),
    gaps AS (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY rec_id, channel, msg_no, speaker ORDER BY start_ms, pos) AS since FROM named),
    cut AS (SELECT *, sum(CASE WHEN since > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, channel, msg_no, speaker ORDER BY start_ms, pos) AS n FROM gaps),
    found AS (SELECT rec_id, channel, msg_no, speaker, CAST(n AS BIGINT) AS replica_no, string_agg(word, ' ' ORDER BY start_ms, pos) AS text, min(start_ms) AS start_ms, last(end_ms ORDER BY start_ms, pos) AS end_ms, count(*) AS n_words
              FROM cut GROUP BY rec_id, channel, msg_no, speaker, n)
    SELECT *, min(start_ms) OVER w AS group_start_ms, max_by(end_ms, replica_no) OVER w AS group_end_ms FROM found WINDOW w AS (PARTITION BY rec_id, channel, msg_no, speaker)""", "words", "segments")
def replicas(spark, sf_dir):
    return diarize.replicas(diarize.fill_nearest(_assigned(spark, sf_dir)))


@query("word_groups", """WITH gaps AS (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY rec_id, channel ORDER BY start_ms, msg_no, pos) AS since FROM words),
    cut AS (SELECT *, sum(CASE WHEN since > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, channel ORDER BY start_ms, msg_no, pos) AS n FROM gaps)
    SELECT rec_id, channel, CAST(n AS BIGINT) AS group_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words FROM cut GROUP BY rec_id, channel, n""", "words")
def word_groups(spark, sf_dir):
    return diarize.word_groups(d.words(spark, sf_dir))


@query("merged_segments", """WITH kept AS (SELECT * FROM segments WHERE end_ms - start_ms >= 150),
    near AS (SELECT *, speaker <> lag(speaker) OVER w OR start_ms - lag(end_ms) OVER w > 1000 AS other FROM kept WINDOW w AS (PARTITION BY rec_id ORDER BY start_ms, seg_ord)),
    cut AS (SELECT *, sum(CASE WHEN other THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY start_ms, seg_ord) AS n FROM near)
    SELECT rec_id, CAST(n AS BIGINT) AS merged_no, any_value(speaker) AS speaker, first(start_ms ORDER BY start_ms, seg_ord) AS start_ms, last(end_ms ORDER BY start_ms, seg_ord) AS end_ms, count(*) AS n_segments FROM cut GROUP BY rec_id, n""", "segments")
def merged_segments(spark, sf_dir):
    return diarize.merge_segments(diarize.long_enough(d.segments(spark, sf_dir)))


@query("sliding_subsegments", """WITH sized AS (SELECT *, (end_ms - start_ms) // 10 AS n_frames FROM segments WHERE (end_ms - start_ms) // 10 > 0),
    starts AS (SELECT *, unnest(CASE WHEN n_frames <= 150 THEN [0] ELSE range(0, n_frames - 75, 75) END) AS first_frame FROM sized)
    SELECT *, least(150, n_frames - first_frame) AS n_real FROM starts""", "segments")
def sliding_subsegments(spark, sf_dir):
    return diarize.subsegments(d.segments(spark, sf_dir))


@query("channel_guard", "SELECT conv_id AS rec_id, count(DISTINCT role) AS n_channels, count(DISTINCT role) = 1 AS can_diarize FROM conversations GROUP BY conv_id")
def channel_guard(spark, sf_dir):
    return diarize.channel_guard(d.messages(spark, sf_dir))


# Echo.

_QUICK = "heard AS (SELECT * REPLACE (pos * 350 + msg_no * 1000 AS start_ms, pos * 350 + msg_no * 1000 + 30 * least(length(word), 10) AS end_ms) FROM words)"


def _heard(spark, sf_dir):
    """Words of turns that overlap, so that channels share stretches of time."""
    start = F.col("pos") * 350 + F.col("msg_no") * 1000
    return d.words(spark, sf_dir).withColumns({"start_ms": start, "end_ms": (start + 30 * F.least(F.length("word"), F.lit(10))).cast("long")})


@query("echo_removed", f"""WITH {_QUICK} SELECT * FROM heard w WHERE NOT EXISTS (SELECT 1 FROM heard o WHERE o.rec_id = w.rec_id AND o.word = w.word AND o.channel <> w.channel
    AND o.end_ms < w.end_ms AND w.end_ms - o.end_ms <= 900)""", "words")
def echo_removed(spark, sf_dir):
    return echo.without_echo(_heard(spark, sf_dir))


@query("echo_removed_similar")
def echo_removed_similar(spark, sf_dir):
    return echo.without_echo(_heard(spark, sf_dir), similarity=0.8)


@query("echo_removed_greedy")
def echo_removed_greedy(spark, sf_dir):
    return echo.without_echo_greedy(_heard(spark, sf_dir))


# Vectors.


@query("normalised_vectors", """SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS length,
    round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-8)) ** 2)), 5) AS square,
    round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE - list_sum(list_transform(embedding, lambda y: y::DOUBLE)) / len(embedding)))), 5) AS spread FROM embeddings""")
def normalised_vectors(spark, sf_dir):
    v = F.col("embedding")
    unit = embeddings.normalised(v)
    spread = F.aggregate(F.transform(embeddings.centred(v), lambda x: F.abs(x)), F.lit(0.0), lambda a, x: a + x)
    return d.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(embeddings.norm(v), 5).alias("length"), F.round(embeddings.dot(unit, unit), 5).alias("square"), F.round(spread, 5).alias("spread"))


@query("cosine_to_centroid", """WITH places AS (SELECT label, k, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(range(len(embedding))) AS k, unnest(embedding) AS x FROM embeddings) GROUP BY label, k),
    mean AS (SELECT label, list(x ORDER BY k) AS c FROM places GROUP BY label)
    SELECT vec_id, label, round(list_sum(list_transform(list_zip(embedding, c), lambda p: p[1]::DOUBLE * p[2])) /
        (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(c, lambda x: x * x))) + 1e-8), 6) AS cosine FROM embeddings JOIN mean USING (label)""")
def cosine_to_centroid(spark, sf_dir):
    return embeddings.cosine_to_centroid(d.table(spark, sf_dir, "embeddings")).select("vec_id", "label", "cosine")


@query("speaker_clusters")
def speaker_clusters(spark, sf_dir):
    calls = d.table(spark, sf_dir, "embeddings").withColumn("rec_id", F.floor(F.col("vec_id") / 50))
    return embeddings.cluster_speakers(calls, "rec_id", num_speakers=4)


_NEAR = """v AS (SELECT vec_id // 500 AS rec_id, vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings),
    near AS (SELECT a.rec_id, a.vec_id, b.vec_id AS other, greatest(1 - list_dot_product(a.e, b.e), 0) AS distance, row_number() OVER (PARTITION BY a.rec_id, a.vec_id ORDER BY 1 - list_dot_product(a.e, b.e), b.vec_id) AS place
             FROM v a JOIN v b ON a.rec_id = b.rec_id AND a.vec_id <> b.vec_id)"""


def _long_calls(spark, sf_dir):
    """Vectors in calls of 500."""
    return d.table(spark, sf_dir, "embeddings").withColumn("rec_id", F.floor(F.col("vec_id") / 500))


@query("nearest_vectors", f"WITH {_NEAR} SELECT rec_id, vec_id, place, other, round(round(distance, 9), 6) AS distance FROM near WHERE place <= 4")
def nearest_vectors(spark, sf_dir):
    """The four nearest other vectors of each vector of a call."""
    near = density.nearest(_long_calls(spark, sf_dir), "rec_id", 4)
    return near.select(F.col("rec").alias("rec_id"), F.col("id").alias("vec_id"), F.col("place").cast("long").alias("place"), "other", F.round("distance", 6).alias("distance"))


@query("core_distances", f"WITH {_NEAR} SELECT rec_id, vec_id, round(round(max(distance), 9), 6) AS core FROM near WHERE place <= 3 GROUP BY rec_id, vec_id")
def core_distances(spark, sf_dir):
    cores = density.core_distances(_long_calls(spark, sf_dir), "rec_id")
    return cores.select(F.col("rec").alias("rec_id"), F.col("id").alias("vec_id"), F.round("core", 6).alias("core"))


@query("dense_clusters")
def dense_clusters(spark, sf_dir):
    """Density clusters of each call's vectors as they are, by cosine."""
    return density.density_clusters(_long_calls(spark, sf_dir), "rec_id").select(F.col("rec").alias("rec_id"), F.col("id").alias("vec_id"), "label")


@query("dense_speakers")
def dense_speakers(spark, sf_dir):
    """Speakers of calls whose number isn't known: layout, density clusters, silhouette."""
    return embeddings.dense_speakers(_long_calls(spark, sf_dir), "rec_id")


@query("layout_neighbours")
def layout_neighbours(spark, sf_dir):
    """How many neighbours the layout of each call keeps."""
    calls = _long_calls(spark, sf_dir)
    return layout.kept_neighbours(calls, materialise(layout.layout(calls, "rec_id"), "places"), "rec_id").withColumnRenamed("rec", "rec_id")


# Texts.

_WORD_LABEL = "(pos * 7 + length(word)) % 14"


@query("punctuated_words", f"""WITH marked AS (SELECT *, CAST({_WORD_LABEL} AS INTEGER) AS label FROM words),
    parts AS (SELECT * REPLACE (CASE WHEN label BETWEEN 5 AND 12 THEN replace(word, 'ß', 'ss') ELSE word END AS word), word AS whole, (label - 1) // 4 AS c, (label - 1) % 4 AS m FROM marked)
    SELECT rec_id, channel, msg_no, pos, label, CASE WHEN label BETWEEN 1 AND 12 THEN
        CASE c WHEN 1 THEN upper(replace(substring(whole, 1, 1), 'ß', 'ss')) || lower(substring(whole, 2)) WHEN 2 THEN upper(word) ELSE word END || CASE m WHEN 1 THEN '.' WHEN 2 THEN ',' WHEN 3 THEN '?' ELSE '' END ELSE word END AS surface,
        CASE WHEN label BETWEEN 1 AND 12 THEN ['LOWER', 'UPPER', 'UPPER_TOTAL'][c + 1] || '_' || ['O', 'PERIOD', 'COMMA', 'QUESTION'][m + 1] ELSE 'O' END AS label_name FROM parts""", "words")
def punctuated_words(spark, sf_dir):
    label = F.expr(_WORD_LABEL).cast("int")
    return d.words(spark, sf_dir).select("rec_id", "channel", "msg_no", "pos", label.alias("label"), labels.surface(F.col("word"), label).alias("surface"), labels.label_name(label).alias("label_name"))


@query("best_labels", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def best_labels(spark, sf_dir):
    return d.table(spark, sf_dir, "embeddings").select("vec_id", labels.best_label(F.col("embedding")).cast("long").alias("best"))


@query("silence_filter", "SELECT conv_id AS rec_id, role AS channel, turn AS msg_no, trim(coalesce(text, ''), ' ') = '' AS silence FROM conversations WHERE trim(coalesce(text, ''), ' ') <> '' OR turn % 2 = 0")
def silence_filter(spark, sf_dir):
    m = d.messages(spark, sf_dir)
    silent = text.is_silent(F.col("text"))
    return m.filter(~silent | (F.col("msg_no") % 2 == 0)).select("rec_id", "channel", "msg_no", silent.alias("silence"))


_PATH = "'/calls/' || source || '/' || CAST(doc_id AS VARCHAR) || ['.mp3', '.WAV', '.ogg', '.txt', '', '.opus'][doc_id % 6 + 1]"


@query("audio_files", f"""SELECT doc_id, path, regexp_extract(path, '[^./](\\.[^./]+)$', 1) AS suffix, regexp_replace(path, '([^./])\\.[^./]+$', '\\1') || '.json' AS result FROM (SELECT doc_id, {_PATH} AS path FROM documents)
    WHERE regexp_extract(path, '[^./](\\.[^./]+)$', 1) IN ('.mp3', '.ogg', '.opus')""")
def audio_files(spark, sf_dir):
    endings = F.array(*(F.lit(e) for e in (".mp3", ".WAV", ".ogg", ".txt", "", ".opus")))
    path = F.concat(F.lit("/calls/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.get(endings, F.pmod("doc_id", F.lit(6)).cast("int")))
    found = d.table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).filter(text.is_audio(F.col("path")))
    return found.select("doc_id", "path", text.suffix(F.col("path")).alias("suffix"), text.with_suffix(F.col("path"), ".json").alias("result"))


@query("audio_urls", """SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)?', 1) AS url_path FROM (
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '(://[^?#]*).*$', '\\1') || '.mp3?from=' || page_id ELSE url END AS url FROM pages)
    WHERE regexp_extract(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)?', 1), '([^/]*)$', 1), '([^.]*)$', 1) IN ('mp3', 'wav', 'ogg')""")
def audio_urls(spark, sf_dir):
    call = F.concat(F.regexp_replace("url", r"(://[^?#]*).*$", "$1"), F.lit(".mp3?from="), F.col("page_id").cast("string"))
    urls = d.table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, call).otherwise(F.col("url")).alias("url"))
    return files.audio_urls(urls).select("page_id", "url", F.parse_url("url", F.lit("PATH")).alias("url_path"))


@query("model_catalog", """SELECT DISTINCT p_name || '_' || CAST(p_partkey AS VARCHAR) AS name, p_partkey * 333333 // 1048576 AS size_mb FROM part WHERE p_size % 2 = 0 AND position('.' IN p_name) = 0""")
def model_catalog(spark, sf_dir):
    key = F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, ".onnx").otherwise(".bin"))
    listing = d.table(spark, sf_dir, "part").filter(~F.contains(F.col("p_name"), F.lit("."))).select(F.to_json(F.array(F.struct(key.alias("Key"), (F.col("p_partkey") * 333333).alias("Size")))).alias("json"))
    return files.catalog(listing)


@query("config_messages", """SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND CAST(json_extract(props, '$.k') AS BIGINT) > 10""")
def config_messages(spark, sf_dir):
    parsed = config.parsed(F.col("props"), "k long")
    return d.table(spark, sf_dir, "events").select("event_id", "event_type", parsed["k"].alias("k")).filter("k > 10")


_CONFIG = """CASE event_id % 4 WHEN 0 THEN '{"config": {"sample_rate": ' || (8000 + event_id % 5 * 1000) || ', "do_dialogue": ' || CASE WHEN event_id % 8 = 0 THEN 'true' ELSE 'false' END || '}}'
    WHEN 1 THEN '{"audio_format": "pcm' || (event_id % 3 * 16) || '", "wait_null_answers": true}' WHEN 2 THEN 'no json' END"""


@query("session_options", f"""WITH rows AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, event_id % 4 AS kind FROM events)
    SELECT session_id, arg_max(CAST(8000 + seq % 5 * 1000 AS INTEGER), seq) FILTER (kind = 0) AS sample_rate, arg_max('pcm' || (seq % 3 * 16), seq) FILTER (kind = 1) AS audio_format,
        arg_max(true, seq) FILTER (kind = 1) AS wait_null_answers, arg_max(seq % 8 = 0, seq) FILTER (kind = 0) AS do_dialogue, CAST(NULL AS BOOLEAN) AS do_punctuation, CAST(NULL AS VARCHAR) AS "channelName"
    FROM rows WHERE kind < 3 GROUP BY session_id""")
def session_options(spark, sf_dir):
    rows = d.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.lit("config").alias("kind"), F.expr(_CONFIG).cast("binary").alias("payload"))
    return config.in_force(rows.filter("payload IS NOT NULL"))


@query("model_by_key", """SELECT p_name || '_' || CAST(p_partkey AS VARCHAR) AS name, p_partkey * 333333 // 1048576 AS size_mb FROM part WHERE p_partkey = (SELECT max(p_partkey) FROM part WHERE position('.' IN p_name) = 0)""")
def model_by_key(spark, sf_dir):
    parts = d.table(spark, sf_dir, "part").filter(~F.contains(F.col("p_name"), F.lit(".")))
    key = F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".bin"))
    wanted = parts.agg(F.max_by(key, "p_partkey")).first()[0] or ""
    listing = parts.select(F.to_json(F.array(F.struct(key.alias("Key"), (F.col("p_partkey") * 333333).alias("Size")))).alias("json"))
    return files.model_named(listing, wanted)


@query("stream_messages", """SELECT conv_id AS rec_id, role AS channel, turn AS msg_no, CAST(json_object('channel_name', role, 'silence', trim(coalesce(text, ''), ' ') = '', 'data', text, 'last_message', turn = max(turn) OVER (PARTITION BY conv_id)) AS VARCHAR) AS json FROM conversations WHERE text IS NOT NULL""")
def stream_messages(spark, sf_dir):
    last = F.col("msg_no") == F.max("msg_no").over(Window.partitionBy("rec_id"))
    found = d.messages(spark, sf_dir).withColumn("last", last).filter("text IS NOT NULL")
    return found.select("rec_id", "channel", "msg_no", sinks.message(F.col("channel"), F.col("text"), text.is_silent(F.col("text")), F.col("last")).alias("json"))


@query("readable_protocols", rf"""WITH {_S80}, lines AS (SELECT *, CASE WHEN count(DISTINCT channel) OVER (PARTITION BY rec_id) > 1 THEN 'Спикер_' || channel || ': ' || trim(text) ELSE trim(text) END AS line FROM sentences),
    dates AS (SELECT event_id AS rec_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS said_at FROM events)
    SELECT rec_id, '**Дата:** ' || any_value(said_at) || chr(10) || chr(10) || string_agg(line || chr(10), '' ORDER BY start_ms, channel, sentence_no) AS body FROM lines JOIN dates USING (rec_id) GROUP BY rec_id""", "words")
def readable_protocols(spark, sf_dir):
    dates = d.table(spark, sf_dir, "events").select(F.col("event_id").alias("rec_id"), "ts")
    return sinks.protocol(sinks.readable_lines(sentences.sentences(d.words(spark, sf_dir))).join(dates, "rec_id"), F.first("ts"))


@query("last_messages", """SELECT conv_id AS rec_id, last(role ORDER BY turn, role) AS channel, max(turn) AS msg_no, last(text ORDER BY turn, role) AS text FROM conversations GROUP BY conv_id""")
def last_messages(spark, sf_dir):
    return timeline.last_messages(d.messages(spark, sf_dir))


@query("best_tokens", """WITH placed AS (SELECT rec_id, word AS token, CAST(round_even(pos * 350 / 500.0::DOUBLE, 0) * 500 AS BIGINT) AS ts_ms, msg_no, pos FROM words),
    n AS (SELECT rec_id, count(DISTINCT msg_no) AS trials FROM placed GROUP BY rec_id),
    votes AS (SELECT rec_id, token, ts_ms, count(*) AS votes, round(count(*)::DOUBLE / any_value(trials), 4) AS conf, min((msg_no, pos)) AS seen FROM placed JOIN n USING (rec_id) GROUP BY rec_id, token, ts_ms)
    SELECT rec_id, ts_ms, first(token ORDER BY votes DESC, seen) AS token, max(votes) AS votes, first(conf ORDER BY votes DESC, seen) AS conf FROM votes GROUP BY rec_id, ts_ms""", "words")
def best_tokens(spark, sf_dir):
    w = d.words(spark, sf_dir)
    return tokens.best_tokens(w.select("rec_id", F.col("word").alias("token"), (F.col("pos") * 350).alias("ts_ms"), "msg_no", "pos"))


@query("numbered_segments", """SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, seg_ord) - 1 AS merged_no, speaker, start_ms, end_ms, CAST(1 AS BIGINT) AS n_segments FROM segments WHERE end_ms - start_ms >= 150""", "segments")
def numbered_segments(spark, sf_dir):
    return diarize.merge_segments(diarize.long_enough(d.segments(spark, sf_dir)), merge=False)


@query("replica_metadata", f"""WITH {_ASSIGNED}, {_RUNS}, {_FILLED}, named AS (SELECT * REPLACE (coalesce(speaker, 'unknown') AS speaker) FROM filled),
    counts AS (SELECT rec_id, channel, msg_no, speaker, count(*) AS n_words FROM named GROUP BY rec_id, channel, msg_no, speaker)
    SELECT c.*, length(text) AS n_chars, turn % 2 = 0 AS is_even FROM counts c JOIN conversations ON conv_id = c.rec_id AND role = channel AND turn = msg_no""", "words", "segments")
def replica_metadata(spark, sf_dir):
    known = d.messages(spark, sf_dir).withColumns({"n_chars": F.length("text").cast("long"), "is_even": F.col("msg_no") % 2 == 0})
    found = diarize.replicas(diarize.fill_nearest(_assigned(spark, sf_dir)), max_pause_ms=1 << 40)
    return diarize.with_metadata(found.select("rec_id", "channel", "msg_no", "speaker", "n_words"), known)


@query("nested_words", "SELECT * FROM words", "words")
def nested_words(spark, sf_dir):
    """Words put into nested values, a map of channels, and taken out again."""
    return nested.words_of_raw(nested.raw_of_words(d.words(spark, sf_dir)))


@query("wav_headers", """SELECT event_id, true AS is_wav, event_id % 7 + 1 AS n_channels, 8000 * (event_id % 6 + 1) AS sample_rate, CASE WHEN event_id % 2 = 0 THEN 16 ELSE 32 END AS bits FROM events""")
def wav_headers(spark, sf_dir):
    """Headers written in their fixed places, little end first, and read again."""

    def little(value, n):
        digits = F.lpad(F.hex(value.cast("long")), 2 * n, "0")
        return F.concat(*(F.substring(digits, 2 * (n - k) - 1, 2) for k in range(n)))

    of = F.col("event_id")
    body = F.concat(F.lit("52494646" + "00" * 18), little(of % 7 + 1, 2), little((of % 6 + 1) * 8000, 4), F.lit("00" * 6), little(F.when(of % 2 == 0, 16).otherwise(32), 2), F.lit("00" * 8))
    return d.table(spark, sf_dir, "events").select("event_id", F.unhex(body).alias("content")).select("event_id", *(c.alias(k) for k, c in audio.wav_header().items()))


_SOUNDS = """WITH e AS (SELECT event_id, event_id % 10 = 9 AS broken, CAST(round(value * 100) AS BIGINT) % 20000 AS level FROM events WHERE value IS NOT NULL)"""


def _sounds(spark, sf_dir):
    """(path, content): a WAV file of 16 kHz per event with eight frames of two channels; one in ten ends in its header."""

    def frame(k):
        pair = (F.col("level") + 100 * k, 50 * k - F.floor(F.col("level") / 2))
        digits = [F.lpad(F.hex(F.pmod(x, F.lit(65536)).cast("long")), 4, "0") for x in pair]
        return F.concat(*(F.concat(F.substring(x, 3, 2), F.substring(x, 1, 2)) for x in digits))

    header = "524946464400000057415645666d74201000000001000200803e000000fa0000040010006461746120000000"
    levels = d.table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_id", F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(20000)).alias("level"))
    whole = F.concat(F.lit(header), *(frame(k) for k in range(8)))
    return levels.select(F.col("event_id").cast("string").alias("path"), F.unhex(F.when(F.col("event_id") % 10 == 9, F.lit(header[:40])).otherwise(whole)).alias("content"))


def _decoded(files, scale, **how):
    """What ``audio.decode`` gives: the number of samples, and their sum weighted by place in steps of 1 / ``scale``."""
    weighted = F.transform("samples", lambda x, i: F.rint(x.cast("double") * scale) * (i + 1))
    total = F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x).cast("long")
    return audio.decode(files, **how).select(F.col("path").cast("long").alias("event_id"), "channel", F.when(F.col("error").isNull(), F.size("samples").cast("long")).alias("n_samples"), total.alias("weighted"), F.isnotnull("error").alias("failed"))


@query("decoded_channels", _SOUNDS + """ SELECT event_id, CASE WHEN NOT broken THEN 'channel_' || c END AS channel, CASE WHEN NOT broken THEN CAST(88 AS BIGINT) END AS n_samples,
    CASE WHEN NOT broken THEN CAST(list_sum(list_transform(range(8), lambda k: (k + 1) * CASE c WHEN 1 THEN level + 100 * k ELSE 50 * k - level // 2 END)) AS BIGINT) END AS weighted, broken AS failed
    FROM e, (VALUES (1), (2)) AS v(c) WHERE NOT broken OR c = 1""")
def decoded_channels(spark, sf_dir):
    """Files of two channels, each channel by itself, with five milliseconds behind short ones; broken files have no channel."""
    return _decoded(_sounds(spark, sf_dir), 32768, pad_ms=5)


@query("decoded_mono", _SOUNDS + """ SELECT event_id, CASE WHEN NOT broken THEN 'channel_1' END AS channel, CASE WHEN NOT broken THEN CAST(88 AS BIGINT) END AS n_samples,
    CASE WHEN NOT broken THEN CAST(list_sum(list_transform(range(8), lambda k: (k + 1) * (level - level // 2 + 150 * k))) AS BIGINT) END AS weighted, broken AS failed FROM e""")
def decoded_mono(spark, sf_dir):
    """The mean of both channels."""
    return _decoded(_sounds(spark, sf_dir), 65536, mono=True, pad_ms=5)


@query("pcm_numbers", """SELECT event_id, CAST(x AS INTEGER) AS whole, CAST(x // 65536 AS INTEGER) AS upper FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) % 20000 AS x FROM events WHERE value IS NOT NULL)
    UNION ALL SELECT event_id, CAST(-x - 1 AS INTEGER), CAST(floor((-x - 1) * 997 / 65536.0::DOUBLE) AS INTEGER) FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) % 20000 AS x FROM events WHERE value IS NOT NULL)""")
def pcm_numbers(spark, sf_dir):
    """Two samples per event, above and below zero, as 16-bit numbers from bytes of 2 and of 4 a sample."""

    def little(x, n):
        digits = F.lpad(F.hex(F.pmod(x, F.lit(1 << 8 * n)).cast("long")), 2 * n, "0")
        return F.concat(*(F.substring(digits, 2 * (n - k) - 1, 2) for k in range(n)))

    x = F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(20000))
    two, four = F.unhex(F.concat(little(x, 2), little(-x - 1, 2))), F.unhex(F.concat(little(x, 4), little((-x - 1) * 997, 4)))
    found = d.table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_id", audio.pcm_numbers(two).alias("a"), audio.pcm_numbers(four, 4).alias("b"))
    return found.select("event_id", F.explode(F.arrays_zip("a", "b")).alias("x")).select("event_id", F.col("x.a").alias("whole"), F.col("x.b").alias("upper"))


@query("chunk_tokens", """SELECT user_id AS rec_id, event_id AS chunk_no, CASE WHEN level < 328 THEN '' ELSE ['w0', 'w0 w1', 'w0 w1 w2'][event_id % 3 + 1] END AS text
    FROM (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) % 20000 AS level FROM events WHERE value IS NOT NULL)""")
def chunk_tokens(spark, sf_dir):
    """A tone of one to three seconds per event, four of them recognised at once; quiet ones hold no word."""
    level = F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(20000))
    samples = F.array_repeat((level / 32768).cast("float"), ((F.col("event_id") % 3 + 1) * 10).cast("int"))
    chunks = d.table(spark, sf_dir, "events").filter("value IS NOT NULL").select(F.col("user_id").alias("rec_id"), F.col("event_id").alias("chunk_no"), samples.alias("samples"))
    batch = models.Models(recogniser_batch=lambda: lambda part, rate: [models.spelled(x, rate) for x in part])
    return models.chunk_tokens(chunks, batch, rate=10).select("rec_id", "chunk_no", F.array_join("tokens", "").alias("text"))


@query("model_sizes", """WITH b AS (SELECT p_partkey, p_partkey * p_partkey * 333 AS n FROM part), u AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END AS p FROM b)
    SELECT p_partkey, printf('%.2f', round(n / 1024.0::DOUBLE ** p, 2)) || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][p + 1] AS size FROM u""")
def model_sizes(spark, sf_dir):
    """Sizes from bytes to terabytes, in the largest unit that fits."""
    return d.table(spark, sf_dir, "part").select("p_partkey", text.size_text(F.col("p_partkey").cast("long") * F.col("p_partkey") * 333).alias("size"))


@query("guarded_samples", """SELECT vec_id, true AS finite, round(list_sum(list_transform(embedding, lambda x: least(greatest(x::DOUBLE, -0.1), 0.1))), 5) AS level,
    CAST(list_sum(list_transform(embedding, lambda x: CAST(round_even(x::DOUBLE * 32767, 0) AS INTEGER))) AS BIGINT) AS pcm FROM embeddings WHERE list_max(list_transform(embedding, lambda x: abs(x))) <= 1""")
def guarded_samples(spark, sf_dir):
    v = F.col("embedding")
    quiet = d.table(spark, sf_dir, "embeddings").filter(F.array_max(F.transform(v, lambda x: F.abs(x))) <= 1)
    level = F.aggregate(audio.clipped(v, -0.1, 0.1), F.lit(0.0), lambda a, x: a + x)
    pcm = F.aggregate(audio.pcm16_values(v), F.lit(0).cast("long"), lambda a, x: a + x)
    return quiet.select("vec_id", audio.finite(v).alias("finite"), F.round(level, 5).alias("level"), pcm.alias("pcm"))


@query("label_silhouettes", """WITH v AS (SELECT vec_id // 50 AS rec_id, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-8)) AS e FROM embeddings),
    d AS (SELECT a.rec_id, a.vec_id, a.label, b.label AS other, avg(CASE WHEN a.vec_id <> b.vec_id THEN 1 - list_dot_product(a.e, b.e) END) AS d FROM v a JOIN v b USING (rec_id) GROUP BY a.rec_id, a.vec_id, a.label, b.label),
    s AS (SELECT rec_id, vec_id, max(d) FILTER (label = other) AS own, min(d) FILTER (label <> other) AS near FROM d GROUP BY rec_id, vec_id),
    n AS (SELECT rec_id, count(*) AS n, count(DISTINCT label) AS k FROM v GROUP BY rec_id)
    SELECT rec_id, n, CASE WHEN k >= 2 AND k < n THEN round(avg(CASE WHEN own IS NULL THEN 0 ELSE (near - own) / greatest(near, own) END), 5) ELSE 0.0::DOUBLE END AS silhouette FROM s JOIN n USING (rec_id) GROUP BY rec_id, n, k""")
def label_silhouettes(spark, sf_dir):
    calls = d.table(spark, sf_dir, "embeddings").withColumn("rec_id", F.floor(F.col("vec_id") / 50))
    return embeddings.silhouettes(calls, "rec_id").withColumn("silhouette", F.round("silhouette", 5))


@query("kept_raw_words", "SELECT * FROM words", "words")
def kept_raw_words(spark, sf_dir):
    """Without a dialogue the words are kept, whatever the options say of them."""
    return transcribe(d.words(spark, sf_dir), PipelineOptions(keep_raw=False))["raw"]


# Whole runs.


@query("diarized_sentences", f"""WITH {_ASSIGNED}, {_RUNS}, {_FILLED}, guard AS (SELECT rec_id FROM words GROUP BY rec_id HAVING count(DISTINCT channel) = 1),
    spoken AS (SELECT * REPLACE (coalesce(speaker, 'unknown') AS channel) FROM filled SEMI JOIN guard USING (rec_id) UNION ALL BY NAME SELECT * FROM words ANTI JOIN guard USING (rec_id)),
    {_S80.replace("FROM words)", "FROM spoken)")} SELECT * FROM sentences""", "words", "segments")
def diarized_sentences(spark, sf_dir):
    """Sentences by speaker in recordings of one channel, by channel in the others."""
    w = d.words(spark, sf_dir)
    return transcribe(w, PipelineOptions(do_diarization=True, do_dialogue=True), d.segments(spark, sf_dir))["sentences"]


@query("session_durations", """SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(2000 * count(*) AS BIGINT) AS duration_ms, CAST(1 AS BIGINT) AS n_last, CAST(0 AS BIGINT) AS n_errors FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def session_durations(spark, sf_dir):
    """What all messages of a session add up to: all its audio, one last message and no error."""
    results = session.batch_sessions(_session_rows(spark, sf_dir, '{"config": {"sample_rate": 800, "wait_null_answers": true}}'))
    return results.groupBy("session_id").agg(F.sum("duration_ms").alias("duration_ms"), F.count_if("last_message").alias("n_last"), F.count("error").alias("n_errors"))


def _session_rows(spark, sf_dir, options: str = '{"config": {"sample_rate": 800}}'):
    """Sessions by user at 800 Hz: two seconds of tone per event, as loud as its value, and an end."""
    level = F.format_string("%04x", F.least(F.round(F.col("value") * 20).cast("int"), F.lit(30000)))
    tone = F.unhex(F.repeat(F.concat(F.substring(level, 3, 2), F.substring(level, 1, 2)), 1600))
    events = d.table(spark, sf_dir, "events").filter("value IS NOT NULL")
    sound = events.select(F.col("user_id").cast("string").alias("session_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"), F.lit("bytes").alias("kind"), tone.alias("payload"))
    starts = sound.select("session_id").distinct().select("session_id", F.lit(0).cast("long").alias("seq"), F.lit("config").alias("kind"), F.lit(options).cast("binary").alias("payload"))
    ends = events.select(F.col("user_id").cast("string").alias("session_id")).distinct().select("session_id", F.lit((1 << 62)).alias("seq"), F.lit("eof").alias("kind"), F.lit(None).cast("binary").alias("payload"))
    return starts.union(sound).union(ends)


@query("stream_voices", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, least(CAST(round(value * 20) AS BIGINT), 30000) AS level, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events WHERE value IS NOT NULL),
    f AS (SELECT *, unnest(range(n * 1600 // 512, (n * 1600 + 1599) // 512 + 1)) AS frame_no FROM e)
    SELECT session_id, CAST(frame_no AS BIGINT) AS frame_no, least(1.0::DOUBLE, (sum(level * (least((frame_no + 1) * 512, (n + 1) * 1600) - greatest(frame_no * 512, n * 1600))) * 20)::DOUBLE / 16777216.0::DOUBLE) AS prob FROM f GROUP BY session_id, frame_no""")
def stream_voices(spark, sf_dir):
    """A probability for each frame of each session, as far as its rows complete it; the last one is filled up."""
    return voice.batch_voices(_session_rows(spark, sf_dir))


@query("stream_sessions")
def stream_sessions(spark, sf_dir):
    return session.batch_sessions(_session_rows(spark, sf_dir))


@query("diarized_dialogue")
def diarized_dialogue(spark, sf_dir):
    options = PipelineOptions(do_echo_clearing=True, do_diarization=True, do_dialogue=True)
    return transcribe(d.words(spark, sf_dir), options, d.segments(spark, sf_dir))["sentences"]
