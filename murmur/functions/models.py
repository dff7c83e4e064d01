"""Slots for models: what goes in and out, with deterministic stand-ins where no model is given.

A model is a Python callable that a worker builds once, by the factory it is given; its work runs on Arrow batches.
"""

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, fields
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.audio import fbank, stretch

#: Samples of a frame that a voice model looks at.
FRAME = 512
#: Models that a worker holds at most.
HELD = 16
_built: dict[tuple[str, str], Callable] = {}


def loudness(samples: np.ndarray) -> np.ndarray:
    """A stand-in for a voice model: a probability per frame from its mean level."""
    frames = samples[: len(samples) // FRAME * FRAME].reshape(-1, FRAME)
    return np.minimum(1, np.abs(frames).mean(1, dtype=float) * 20) if len(frames) else np.zeros(0)


def leaky_loudness(frame: np.ndarray, state: np.ndarray | None) -> tuple[float, np.ndarray]:
    """A stand-in for a recurrent voice model: a probability from a mean level that falls off over the frames before."""
    level = np.abs(frame).mean()
    state = np.array([level if state is None else 0.7 * state[0] + 0.3 * level], np.float32)
    return min(1.0, float(state[0]) * 20), state


def describe(samples: np.ndarray, rate: int) -> str:
    """What the stand-in for a recogniser hears: a word per second of audible audio."""
    seconds = np.array_split(samples, max(1, len(samples) // rate))
    return " ".join(f"w{k}" for k, s in enumerate(seconds) if len(s) and np.abs(s).mean() > 0.01)


def cut_point(samples: np.ndarray, rate: int, voice: Callable = loudness, silence_s: float = 0.5) -> int:
    """The sample to cut at: where, going back from the end to a third, ``silence_s`` of silence is complete."""
    first = len(samples) // 3
    return first + FRAME * silent_frame(voice(samples[first:]), rate, silence_s)


def silent_frame(prob: np.ndarray, rate: int, silence_s: float = 0.5) -> int:
    """The first frame, going back from the end, that completes ``silence_s`` of silence; 0 if there is none."""
    need, run = int(silence_s / (FRAME / rate)), 0
    for k in range(len(prob) - 1, -1, -1):
        run = run + 1 if prob[k] < 0.5 else 0
        if run >= need:
            return k
    return 0


def spelled(samples: np.ndarray, rate: int) -> dict:
    """A stand-in for a recogniser: its words letter by letter, 40 ms apart, from where their second begins."""
    tokens, times = [], []
    for word in describe(samples, rate).split():
        second = int(word[1:])
        if tokens:
            tokens.append(" ")
            times.append(second - 0.04)
        for k, letter in enumerate(word):
            tokens.append(letter)
            times.append(second + 0.04 * k)
    return {"tokens": tokens, "timestamps": times}


def hashed_vector(features: np.ndarray, size: int = 64) -> np.ndarray:
    """A stand-in for a speaker model: how far features spread over time, put on ``size`` places and normalised."""
    spread = np.resize(features.std(0), size) if len(features) else np.zeros(size)
    return (spread / (np.linalg.norm(spread) + 1e-8)).astype(np.float32)


def hashed_vectors(batch: np.ndarray, size: int = 64) -> np.ndarray:
    """As ``hashed_vector`` for a batch of features of one shape."""
    spread = np.stack([np.resize(x, size) for x in batch.std(1)])
    return (spread / (np.linalg.norm(spread, axis=1, keepdims=True) + 1e-8)).astype(np.float32)


def hashed_labels(words: list[str]) -> list[int]:
    """A stand-in for a punctuation model: a capital on the first word, a full stop on the last, commas by hash."""
    last = len(words) - 1
    return [(6 if k == last else 5) if k == 0 else 2 if k == last else 3 if zlib.crc32(w.encode()) % 7 == 0 else 1 for k, w in enumerate(words)]


@dataclass(frozen=True)
class Models:
    """Factories of the models. ``recogniser``: (samples, rate) to tokens and timestamps; ``voice``: samples of one
    channel in order to a probability per frame; ``speaker``: features to a vector; ``punctuation``: words to labels.

    Three slots stand in for others if they are given: ``recogniser_batch``, ([samples], rate) to as many results; ``recurrent_voice``, (frame, state or None) to (probability, state), is asked
    frame by frame, with no state at a channel's start; ``speaker_batch`` takes ``batch_size`` windows' features at once to as many vectors.

    A worker makes a model once for each factory and keeps the HELD latest. Factories are told apart by what they pickle to, so
    two closures of one function are two models.
    """

    recogniser: Callable = field(default=lambda: spelled)
    voice: Callable = field(default=lambda: loudness)
    speaker: Callable = field(default=lambda: hashed_vector)
    punctuation: Callable = field(default=lambda: hashed_labels)
    recogniser_batch: Callable | None = None
    recurrent_voice: Callable | None = None
    speaker_batch: Callable | None = None
    batch_size: int = 8

    def _key(self, name: str) -> tuple[str, str]:
        keys = self.__dict__.setdefault("_keys", {})
        if name not in keys:
            keys[name] = hashlib.sha256(cloudpickle.dumps(getattr(self, name))).hexdigest()
        return name, keys[name]

    def __getstate__(self) -> dict:
        for f in fields(self):  # named where they are made: pickled again, a factory may look different
            if callable(getattr(self, f.name)):
                self._key(f.name)
        return dict(self.__dict__)

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def built(self, name: str) -> Callable:
        """The model of a slot, made at most once in a worker."""
        key = self._key(name)
        model = _built.pop(key, None) or getattr(self, name)()
        _built[key] = model
        while len(_built) > HELD:
            del _built[next(iter(_built))]
        return model

    def heard(self, samples: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """(a probability per whole frame, the state behind the last one) of samples that follow on a state."""
        if self.recurrent_voice is None:
            return np.asarray(self.built("voice")(samples)), None
        model, out = self.built("recurrent_voice"), []
        for k in range(len(samples) // FRAME):
            prob, state = model(samples[k * FRAME : (k + 1) * FRAME], state)
            out.append(prob)
        return np.array(out, float), state


def rate_of(result: dict) -> float:
    """Letters a second, without the time of spaces."""
    tokens, times = result["tokens"], result["timestamps"]
    letters = sum(t != " " for t in tokens)
    spoken = times[-1] - sum(times[k + 1] - times[k] for k, t in enumerate(tokens[:-1]) if t == " ") if tokens else 0
    return letters // spoken if letters and spoken > 0 else 0


def recognise(model: Callable, samples: np.ndarray, rate: int, multiplier: float = 1.0, correct: bool = True, fast: int = 18, target: float = 17.0, least: float = 0.8) -> tuple[dict, float]:
    """(result, multiplier): speech slowed down by the multiplier; if it is faster than ``fast`` at a multiplier of
    1, once more at the speed that brings it to ``target``."""
    result = model(stretch(samples, multiplier) if multiplier < 1 else samples, rate)
    if correct and multiplier == 1 and (speed := rate_of(result)) > fast:
        multiplier = max(target / speed, least)
        result = model(stretch(samples, multiplier), rate)
    return result, multiplier


def recognised(models: Models, chunks: Iterable[tuple[object, np.ndarray]], rate: int, size: int = 4) -> Iterator[tuple[object, dict | None]]:
    """(name, result) for each (name, samples of a chunk), in order; null where the model fails. A model of batches gets
    ``size`` chunks at once, whatever recording they are of; if a batch fails, its chunks are tried one by one."""

    def run(part: list[np.ndarray]) -> list[dict | None]:
        try:
            found = [models.built("recogniser")(part[0], rate)] if models.recogniser_batch is None else list(models.built("recogniser_batch")(part, rate))
            if len(found) != len(part):
                raise ValueError(f"{len(found)} results for {len(part)} chunks")
            return found
        except Exception:  # a model's errors are of any kind
            return [None] if len(part) == 1 else [run([x])[0] for x in part]

    chunks = iter(chunks)
    while held := list(islice(chunks, 1 if models.recogniser_batch is None else size)):
        yield from zip([name for name, _ in held], run([x for _, x in held]))


def chunk_tokens(chunks: DataFrame, models: Models, rate: int = 16_000, size: int = 4) -> DataFrame:
    """(rec_id, chunk_no, tokens, timestamps) for chunks (rec_id, chunk_no, samples), recognised ``size`` at once.

    Chunks without samples (null) and those on which the model fails give no row; empty ones are asked like any other, and
    repeated rows each give theirs. Other columns are not read. An empty table gives none. A task holds a batch at a time.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (((r, n), np.asarray(x, np.float32)) for part in parts for r, n, x in zip(part["rec_id"], part["chunk_no"], part["samples"]))
        found = ((*name, list(x["tokens"]), [float(t) for t in x["timestamps"]]) for name, x in recognised(models, rows, rate, size) if x is not None)
        while held := list(islice(found, 1000)):
            yield pd.DataFrame(held, columns=["rec_id", "chunk_no", "tokens", "timestamps"])

    keys = chunks.select("rec_id", "chunk_no", "samples").filter("samples IS NOT NULL")
    types = dict(keys.dtypes)
    return keys.mapInPandas(run, f"rec_id {types['rec_id']}, chunk_no {types['chunk_no']}, tokens array<string>, timestamps array<double>")


def heard_words(tokens: list[str], times: list[float], gap_s: float = 2.0) -> list[tuple[str, int, int]]:
    """(word, start, end) in milliseconds of a recogniser's letters: a space ends a word, and so does a pause of more
    than ``gap_s`` between two letters."""
    out: list[list] = []
    before = None
    for token, at in zip(tokens, times):
        if token != " ":
            if before is None or at - before > gap_s:
                out.append(["", at, at])
            out[-1][0] += token
            out[-1][2] = at
        before = None if token == " " else at
    return [(word, round(a * 1000), round(b * 1000)) for word, a, b in out]


def batches(models: Models, features: Iterable[tuple[object, np.ndarray | None]]) -> Iterator[tuple[object, list[float] | None]]:
    """(name, vector) for each (name, features of a window), in order; null for a window without features, or on which the model fails.

    Windows of one shape are gathered, whatever file they are of, until ``batch_size`` are there; the last batch is filled up with
    zeros, and what comes of these is left out. If a batch fails, its windows are tried one by one.
    """
    size = models.batch_size if models.speaker_batch is not None else 1

    def run(windows: list[np.ndarray]) -> list[list[float] | None]:
        try:
            if models.speaker_batch is None:
                return [np.asarray(models.built("speaker")(windows[0]), float).tolist()]
            filled = np.stack([*windows, *[np.zeros_like(windows[0])] * (size - len(windows))])
            return np.asarray(models.built("speaker_batch")(filled), float)[: len(windows)].tolist()
        except Exception:  # a model's errors are of any kind
            return [None] if len(windows) == 1 else [run([w])[0] for w in windows]

    held: list[tuple[object, np.ndarray | None]] = []
    n = 0

    def flush() -> Iterator[tuple[object, list[float] | None]]:
        real = [x for _, x in held if x is not None]
        made = iter(run(real) if real else [])
        yield from [(name, None if x is None else next(made)) for name, x in held]
        held.clear()

    for name, x in features:
        first = next((y for _, y in held if y is not None), None)
        if x is not None and first is not None and x.shape != first.shape:
            yield from flush()
            n = 0
        held.append((name, x))
        n += x is not None
        if n == size or len(held) >= 64 * size:
            yield from flush()
            n = 0
    if held:
        yield from flush()


def speaker_vector(models: Models, samples: str | Column, rate: int = 16_000) -> Column:
    """A vector per array of samples; null where there is none or the model fails on it."""

    def run(column: pd.Series) -> pd.Series:
        features = ((k, None if x is None else fbank(np.asarray(x, np.float32), rate)) for k, x in enumerate(column))
        return pd.Series([v for _, v in batches(models, features)], dtype=object)

    return F.pandas_udf(run, "array<double>")(samples)


def word_labels(models: Models, words: str | Column, longest: int = 512) -> Column:
    """A label per word of an array; lists of more than ``longest`` words are halved until they fit."""

    def labels(model: Callable, part: list[str]) -> list[int]:
        if len(part) <= longest:
            return list(model(part))
        return labels(model, part[: len(part) // 2]) + labels(model, part[len(part) // 2 :])

    def run(column: pd.Series) -> pd.Series:
        model = models.built("punctuation")
        return pd.Series([None if x is None else labels(model, list(x)) for x in column])

    return F.pandas_udf(run, "array<int>")(words)


def frame_probabilities(models: Models, samples: np.ndarray) -> np.ndarray:
    """A probability per frame of one channel from its start, the last frame filled with zeros."""
    rest = -len(samples) % FRAME
    return models.heard(np.append(samples, np.zeros(rest, np.float32)) if rest else samples)[0]
