"""Voice frame by frame in a stream: a probability for every frame of a session, as soon as it is complete."""

from __future__ import annotations

import json
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from murmur.functions.audio import to_float
from murmur.functions.models import FRAME
from murmur.streaming.session import InOrder, SessionOptions, State, _array, _text, drained, taken

SCHEMA = "session_id string, frame_no long, prob double"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class Listener:
    """One session's frames. The model's state, the start of the next frame and what resampling needs are carried from row to
    row; a row that names another channel, rate or format begins anew."""

    def __init__(self, options: SessionOptions, state: dict | None = None, buffer: bytes = b""):
        self.options, self.state, self.buffer = options, State(**(state or {})), buffer

    def _rate(self) -> int:
        return self.options.rate or self.state.sample_rate

    def _frames(self, last: bool = False) -> Iterator[tuple[int, float]]:
        s = self.state
        if last:
            self.buffer += drained(s, self._rate())
            self.buffer += bytes(-len(self.buffer) % (2 * FRAME))
        whole = len(self.buffer) // (2 * FRAME) * 2 * FRAME
        if whole:
            prob, state = self.options.models.heard(to_float(self.buffer[:whole], 2), _array(s.voice))
            self.buffer, s.voice = self.buffer[whole:], _text(state)
            yield from zip(range(s.chunk_no, s.chunk_no + len(prob)), np.asarray(prob, float).tolist())
            s.chunk_no += len(prob)
        if last:
            s.voice = None

    def take(self, kind: str, payload: bytes | None) -> Iterator[tuple[int, float]]:
        """(frame, probability) of the frames that a row completes. Files and options that can't be read give none."""
        payload, s = bytes(payload or b""), self.state
        if s.ended:
            return
        try:
            if kind == "config":
                found = json.loads(payload)
                found = found.get("config", found)
                new = State(**s.__dict__)
                new.configure(found)
                if (new.sample_rate, new.audio_format, new.channel) != (s.sample_rate, s.audio_format, s.channel):
                    yield from self._frames(last=True)
                s.configure(found)
            elif kind == "bytes":
                self.buffer += taken(s, payload, self._rate())
                yield from self._frames()
        except (ValueError, AttributeError, TypeError, EOFError, wave.Error):
            return
        if kind == "eof":
            yield from self._frames(last=True)
            s.ended = True


class VoiceProcessor(InOrder, StatefulProcessor):
    """``Listener`` as a stateful operator, with rows held as in ``SessionOptions``; an idle session ends."""

    def __init__(self, options: SessionOptions):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("voice", "state string, buffer binary")
        self.waiting = handle.getMapState("waiting", "seq long", "kind string, payload binary")

    def _load(self) -> Listener:
        if not self.kept.exists():
            return Listener(self.options)
        state, buffer = self.kept.get()
        return Listener(self.options, json.loads(state), bytes(buffer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        listener = self._load()
        out = [(key[0], *f) for kind, payload in self.rows_in_order(rows, listener.state, self.options) for f in listener.take(kind, payload)]
        self.kept.update((json.dumps(listener.state.__dict__), listener.buffer))
        self.one_timer(self.again(timerValues.getCurrentProcessingTimeInMs(), self.options))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        listener = self._load()
        if rows := list(self.after_the_gap(listener.state)):
            out = [(key[0], *f) for kind, payload in rows for f in listener.take(kind, payload)]
            self.kept.update((json.dumps(listener.state.__dict__), listener.buffer))
            self.one_timer(self.again(timerValues.getCurrentProcessingTimeInMs(), self.options))
        else:
            out = [(key[0], *f) for f in listener.take("eof", None)]
            self.kept.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def voices(stream: DataFrame, options: SessionOptions = SessionOptions()) -> DataFrame:
    """(session_id, frame_no, prob) of a stream of session rows. Needs the RocksDB state store."""
    return stream.groupBy("session_id").transformWithStateInPandas(VoiceProcessor(options), SCHEMA, "append", "processingTime")


def batch_voices(rows: DataFrame, options: SessionOptions = SessionOptions()) -> DataFrame:
    """What ``voices`` gives, from a finished table of rows: sessions are read in order in sorted partitions, so only the state of one is
    held. Null ids are one session; an empty table gives none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listener, of = None, None
        for part in parts:
            out = []
            for row in part.itertuples():
                if listener is None or row.session_id != of:
                    listener, of = Listener(options), row.session_id
                out += [(of, *f) for f in listener.take(row.kind, row.payload)]
            yield pd.DataFrame(out, columns=_COLUMNS)

    ordered = rows.select("session_id", "seq", "kind", "payload").repartition("session_id").sortWithinPartitions("session_id", "seq")
    return ordered.mapInPandas(run, SCHEMA)
