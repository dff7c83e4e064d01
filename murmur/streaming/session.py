"""Streaming sessions: audio is buffered per session and flushed by length, and the rest at the end.

Rows are (session_id, seq, kind, payload, ts). A ``config`` row holds JSON options, the last of which win; a
``bytes`` row holds PCM; an ``eof`` row ends its session. A flush happens once the buffer holds ``max_ms`` of audio;
it is cut at the last pause found from its end back to a third of its length, and what lies behind the cut is
carried over. The last message may hold the dialogue of all that the session said.

What of a row can't be used yet is carried to the next one: bytes of a sample that isn't complete, the neighbours that
resampling needs, and the state of a recurrent voice model. So packets of any size give the same results.
"""

from __future__ import annotations

import base64
import json
import wave
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from murmur.functions.audio import Resampler, read_audio, to_float, to_pcm16
from murmur.functions.labels import surface_text
from murmur.functions.models import FRAME, Models, cut_point, heard_words, recognise, silent_frame

SCHEMA = "session_id string, chunk_no long, offset_ms long, duration_ms long, text string, silence boolean, last_message boolean, error string, dialogue string"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Bytes of a sample by the names of audio formats; 0 where each row is a file of its own.
FORMATS = {"raw": 2, "pcm16": 2, "pcm32": 4, "file": 0}
#: Silence behind the last audio, which a recogniser needs to hear the last word, if there is less than so much of it.
PAD_MS, PAD_BELOW_MS = 1000, 2000


@dataclass(frozen=True)
class SessionOptions:
    """How sessions are heard: audio of a flush, the rate that models expect (that of the stream, if not given), and
    how long an abandoned session waits before it is flushed, or an ended one is remembered.

    Rows of one micro-batch are taken in the order of ``seq``. With ``hold_ms``, so are rows of several: they must be numbered
    from ``first_seq`` without gaps, and rows behind a missing one wait so long for it before it is passed over. Rows that
    come later than that, and numbers that come again, give nothing."""

    max_ms: int = 30_000
    rate: int | None = None
    idle_ms: int = 600_000
    percentile: float = 80.0
    hold_ms: int | None = None
    first_seq: int = 0
    models: Models = field(default_factory=Models)


@dataclass
class State:
    """What a session remembers besides its audio and words."""

    sample_rate: int = 16_000
    audio_format: str = "pcm16"
    channel: str = "channel_1"
    wait_null_answers: bool = False
    do_dialogue: bool = False
    do_punctuation: bool = False
    chunk_no: int = 0
    begun_ms: int = 0
    samples: int = 0
    multiplier: float = 1.0
    ended: bool = False
    next_seq: int | None = None
    rest: str = ""
    resampler: dict | None = None
    voice: dict | None = None
    probabilities: list = field(default_factory=list)

    def configure(self, found: dict) -> None:
        """Take the known options of a message; a wrong one raises and changes nothing."""
        new = {
            "sample_rate": int(found.get("sample_rate") or self.sample_rate), "audio_format": str(found.get("audio_format", self.audio_format)), "channel": str(found.get("channelName", self.channel)),
            **{k: bool(found.get(k, getattr(self, k))) for k in ("wait_null_answers", "do_dialogue", "do_punctuation")},
        }
        if new["sample_rate"] <= 0 or new["audio_format"] not in FORMATS:
            raise ValueError(f"sample rate {new['sample_rate']}, audio format {new['audio_format']}")
        self.__dict__.update(new)


def _text(x: np.ndarray | None) -> dict | None:
    """An array as plain text and numbers."""
    return None if x is None else {"type": str(x.dtype), "shape": list(x.shape), "data": base64.b64encode(np.ascontiguousarray(x).tobytes()).decode()}


def _array(x: dict | None) -> np.ndarray | None:
    return None if x is None else np.frombuffer(base64.b64decode(x["data"]), x["type"]).reshape(x["shape"])


def taken(state: State, payload: bytes, rate: int) -> bytes:
    """A row's audio as 16-bit samples at ``rate``, as far as it is complete; the rest stays in the state."""
    width, own = FORMATS[state.audio_format], state.sample_rate
    if width:
        payload = base64.b64decode(state.rest) + payload
        cut = len(payload) // width * width
        payload, state.rest = payload[:cut], base64.b64encode(payload[cut:]).decode()
        if own == rate and width == 2:
            return payload
        samples = to_float(payload, width)
    else:
        own, found = read_audio(payload)
        samples = np.mean(found, 0)
    ahead = drained(state, rate) if state.resampler and state.resampler["rate"] != own else b""
    resampler = Resampler(own, rate, (state.resampler or {}).get("state"))
    out = to_pcm16(resampler.push(samples))
    state.resampler = {"rate": own, "state": resampler.state}
    return ahead + out


def drained(state: State, rate: int) -> bytes:
    """What resampling still holds back, at the end of audio of one rate and format; an incomplete sample goes."""
    out = to_pcm16(Resampler(state.resampler["rate"], rate, state.resampler["state"]).finish()) if state.resampler else b""
    state.rest, state.resampler = "", None
    return out


def sentences_of(words: list[tuple[str, int, int]], percentile: float) -> list[list[str]]:
    """A session's words cut where a pause reaches the percentile of the differences between neighbouring ends."""
    if len(words) < 2:
        return [[w for w, *_ in words]] if words else []
    starts, ends = (np.array([w[k] for w in words], float) for k in (1, 2))
    cuts = np.flatnonzero(starts[1:] - ends[:-1] >= round(float(np.percentile(np.diff(ends), percentile)), 6)) + 1
    return [list(part) for part in np.split(np.array([w for w, *_ in words], object), cuts)]


class Session:
    """One session and what it does with rows in their order."""

    def __init__(self, options: SessionOptions = SessionOptions(), state: dict | None = None, buffer: bytes = b"", words: list | None = None):
        self.options, self.state, self.buffer = options, State(**(state or {})), buffer
        self.words: list[tuple[str, int, int]] = words or []

    def _row(self, text: str, duration: int = 0, last: bool = False, error: str | None = None, dialogue: str | None = None) -> tuple:
        return self.state.chunk_no, self._now(), duration, text, not text, last, error, dialogue

    def _rate(self) -> int:
        return self.options.rate or self.state.sample_rate

    def _now(self, more: int = 0) -> int:
        """The time, in whole milliseconds, behind all samples so far and ``more``, so that durations add up."""
        return self.state.begun_ms + (self.state.samples + more) * 1000 // self._rate()

    def _flush(self, samples: np.ndarray, last: bool) -> Iterator[tuple]:
        """Recognise samples. A chunk that fails is a row with its error and doesn't move the time on."""
        s, rate, error = self.state, self._rate(), None
        begin, text, said = self._now(), "", []
        length = self._now(len(samples)) - begin
        short = 0 < len(samples) * 1000 < PAD_BELOW_MS * rate
        heard = np.append(samples, np.zeros(PAD_MS * rate // 1000, np.float32)) if last and short else samples
        try:
            if len(heard):
                result, s.multiplier = recognise(self.options.models.built("recogniser"), heard, rate, s.multiplier)
                said = heard_words(result["tokens"], result["timestamps"])
                text = " ".join(w for w, *_ in said)
        except Exception as e:  # a model's errors are of any kind
            error = f"chunk: {e}"
        if s.do_dialogue:
            self.words += [(w, begin + a, begin + b) for w, a, b in said]
        if text or last or error or s.wait_null_answers:
            yield self._row(text, length, last, error, self._dialogue() if last and s.do_dialogue else None)
        s.chunk_no += 1
        s.samples += 0 if error else len(samples)

    def _dialogue(self) -> str:
        """A line for each sentence of all that was said, with case and marks if asked for."""
        lines = []
        for part in sentences_of(self.words, self.options.percentile):
            labels = self.options.models.built("punctuation")(part) if self.state.do_punctuation else [1] * len(part)
            lines.append(f"{self.state.channel}: {' '.join(map(surface_text, part, labels))}\n")
        return "".join(lines)

    def take(self, kind: str, payload: bytes | None) -> Iterator[tuple]:
        """The result rows, without the session's id, of one row. Rows behind the end and of other kinds give none."""
        payload, s = bytes(payload or b""), self.state
        if s.ended:
            return
        if kind == "config":
            try:
                found = json.loads(payload)
                found = found.get("config", found)
                new = State(**self.state.__dict__)
                new.configure(found)
                if (new.sample_rate, new.audio_format) != (s.sample_rate, s.audio_format):
                    self.buffer += drained(s, self._rate())
                    if new.sample_rate != s.sample_rate and not self.options.rate:
                        if self.buffer:
                            yield from self._flush(to_float(self.buffer, 2), False)
                        self.buffer, s.begun_ms, s.samples, s.voice, s.probabilities = b"", self._now(), 0, None, []
                if new.channel != s.channel:
                    s.voice = None
                s.configure(found)
            except (ValueError, AttributeError, TypeError) as e:
                yield self._row("", error=f"config: {e}")
        elif kind == "bytes":
            try:
                self.buffer += taken(s, payload, self._rate())
            except (ValueError, EOFError, wave.Error) as e:  # a file that can't be read
                yield self._row("", error=f"audio: {e}")
            rate = self._rate()
            self._listen()
            while len(self.buffer) // 2 * 1000 >= self.options.max_ms * rate:
                samples = to_float(self.buffer, 2)
                cut = self._cut(samples)
                self.buffer = self.buffer[cut * 2 :]
                yield from self._flush(samples[:cut], False)
        elif kind == "eof":
            self.buffer += drained(s, self._rate())
            yield from self._flush(to_float(self.buffer, 2), True)
            self.buffer, self.words, s.ended, s.voice, s.probabilities = b"", [], True, None, []

    def _listen(self) -> None:
        """Ask a recurrent voice model about the frames that have come."""
        s, known = self.state, len(self.state.probabilities)
        if self.options.models.recurrent_voice is not None and (n := len(self.buffer) // 2 // FRAME) > known:
            prob, state = self.options.models.heard(to_float(self.buffer[2 * known * FRAME : 2 * n * FRAME], 2), _array(s.voice))
            s.probabilities, s.voice = s.probabilities + prob.tolist(), _text(state)

    def _cut(self, samples: np.ndarray) -> int:
        """Where a full buffer is cut: at a frame that a recurrent model has heard, or where the voice model finds a pause."""
        s = self.state
        if self.options.models.recurrent_voice is None:
            return max(FRAME, cut_point(samples, self._rate(), self.options.models.built("voice")))
        first = len(s.probabilities) // 3
        frame = max(1, first + silent_frame(np.array(s.probabilities[first:]), self._rate()))
        s.probabilities = s.probabilities[frame:]
        return frame * FRAME


class InOrder:
    """Rows of a session in the order of ``seq``, for a processor whose ``waiting`` holds rows that came too early."""

    def rows_in_order(self, rows: Iterator[pd.DataFrame], state: State, options: SessionOptions) -> Iterator[tuple[str, bytes | None]]:
        found = pd.concat(list(rows)).sort_values("seq")
        if options.hold_ms is None:
            yield from found[["kind", "payload"]].itertuples(index=False, name=None)
            return
        state.next_seq = options.first_seq if state.next_seq is None else state.next_seq
        for row in found.itertuples():
            if row.seq >= state.next_seq:
                self.waiting.updateValue((int(row.seq),), (row.kind, None if row.payload is None else bytes(row.payload)))
        yield from self.complete(state)

    def complete(self, state: State) -> Iterator[tuple[str, bytes | None]]:
        """The rows that follow on what was taken."""
        while self.waiting.containsKey((state.next_seq,)):
            row = self.waiting.getValue((state.next_seq,))
            self.waiting.removeKey((state.next_seq,))
            state.next_seq += 1
            yield tuple(row)

    def after_the_gap(self, state: State) -> Iterator[tuple[str, bytes | None]]:
        """The rows that follow on those that are missing; none if no row waits."""
        if self.waiting.exists():
            state.next_seq = min((int(k[0]) for k in self.waiting.keys()), default=state.next_seq)
            yield from self.complete(state)

    def again(self, now: int, options: SessionOptions) -> int:
        """When to look again."""
        return now + (options.hold_ms if options.hold_ms is not None and self.waiting.exists() else options.idle_ms)

    def one_timer(self, at: int) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(at)


class SessionProcessor(InOrder, StatefulProcessor):
    """Sessions as a stateful operator. A timer passes over rows that don't come, or flushes an abandoned session; an ended one
    is remembered for as long, so that late rows give nothing."""

    def __init__(self, options: SessionOptions):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("session", "state string, buffer binary")
        self.said = handle.getListState("said", "word string, start_ms long, end_ms long")
        self.waiting = handle.getMapState("waiting", "seq long", "kind string, payload binary")

    def _load(self) -> Session:
        if not self.kept.exists():
            return Session(self.options)
        state, buffer = self.kept.get()
        return Session(self.options, json.loads(state), bytes(buffer), [tuple(w) for w in self.said.get()] if self.said.exists() else [])

    def _save(self, session: Session, known: int) -> None:
        self.kept.update((json.dumps(session.state.__dict__), session.buffer))
        if session.state.ended:
            self.said.clear()
        elif len(session.words) > known:
            self.said.appendList(session.words[known:])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        session = self._load()
        out, known = [], len(session.words)
        for kind, payload in self.rows_in_order(rows, session.state, self.options):
            out += [(key[0], *r) for r in session.take(kind, payload)]
        self._save(session, known)
        self.one_timer(self.again(timerValues.getCurrentProcessingTimeInMs(), self.options))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        session = self._load()
        out, known = [], len(session.words)
        if rows := list(self.after_the_gap(session.state)):
            for kind, payload in rows:
                out += [(key[0], *r) for r in session.take(kind, payload)]
            self._save(session, known)
            self.one_timer(self.again(timerValues.getCurrentProcessingTimeInMs(), self.options))
        else:
            out = [(key[0], *r) for r in session.take("eof", None)]
            self.kept.clear()
            self.said.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def sessions(stream: DataFrame, options: SessionOptions = SessionOptions()) -> DataFrame:
    """Results of a stream of session rows. Needs the RocksDB state store."""
    return stream.groupBy("session_id").transformWithStateInPandas(SessionProcessor(options), SCHEMA, "append", "processingTime")


def batch_sessions(rows: DataFrame, options: SessionOptions = SessionOptions()) -> DataFrame:
    """The results that the stream gives, from a finished table of rows.

    Sessions are sorted in their partitions and read through in order, one row after the other, so that only the
    state of one session is held, however long it is. Null ids are one session. An empty table gives none.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, of = None, None
        for part in parts:
            out = []
            for row in part.itertuples():
                if session is None or row.session_id != of:
                    session, of = Session(options), row.session_id
                out += [(of, *r) for r in session.take(row.kind, row.payload)]
            yield pd.DataFrame(out, columns=_COLUMNS)

    ordered = rows.select("session_id", "seq", "kind", "payload").repartition("session_id").sortWithinPartitions("session_id", "seq")
    return ordered.mapInPandas(run, SCHEMA)
