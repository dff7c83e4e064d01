"""Samples, rates and features of audio, as numpy kernels inside pandas UDFs."""

import base64
import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import codecs

RATE = 16_000
#: What one is in each supported sample width.
FULL_SCALE = {2: 32768.0, 4: 2147483648.0}
_TYPES = {2: "<i2", 4: "<i4"}


def to_float(payload: bytes, width: int) -> np.ndarray:
    """PCM bytes as float32 from -1 to 1; widths of 2 and 4 bytes."""
    if width not in _TYPES:
        raise ValueError(f"sample width {width}: 2 or 4 bytes are supported")
    return np.clip(np.frombuffer(payload[: len(payload) // width * width], _TYPES[width]).astype(np.float32) / FULL_SCALE[width], -1, 1)


def to_pcm16(samples: np.ndarray) -> bytes:
    """Samples as 16-bit PCM, clipped; not-a-number is an error."""
    samples = np.asarray(samples, np.float64)
    if not np.isfinite(samples).all():
        raise ValueError("samples must be finite")
    return np.clip(np.round(samples * 32767), -32768, 32767).astype("<i2").tobytes()


def _low_pass(up: int, down: int, zeros: int = 16) -> np.ndarray:
    """A windowed sinc at ``up`` times the rate, cut at the lower of both rates: one row of taps a phase."""
    wide = max(up, down)
    at = np.arange(-zeros * wide, zeros * wide + 1)
    taps = np.sinc(at / wide) * np.kaiser(len(at), 8.6) * up / wide
    taps = np.append(taps, np.zeros(-len(taps) % up))
    return taps.reshape(-1, up).T[:, ::-1].astype(np.float32)


def resample(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Samples at another rate, band-limited: each sample is a windowed sinc over its neighbours."""
    if rate <= 0 or to <= 0:
        raise ValueError("rates must be positive")
    samples = np.asarray(samples, np.float32)
    if rate == to or not len(samples):
        return samples
    shared = np.gcd(rate, to)
    up, down = to // shared, rate // shared
    phases = _low_pass(up, down)
    width = phases.shape[1]
    centre = 16 * max(up, down)  # the filter's middle, in steps of the fine rate
    padded = np.concatenate([np.zeros(width, np.float32), samples, np.zeros(width + 1, np.float32)])
    out = np.empty(int(len(samples) * to / rate), np.float32)
    near = np.lib.stride_tricks.sliding_window_view(padded, width)
    for k in range(0, len(out), 1 << 15):
        fine = np.arange(k, min(k + (1 << 15), len(out))) * down + centre
        last = np.minimum(fine // up + width, len(padded) - 1)  # in padded, the newest sample that counts
        out[k : k + (1 << 15)] = np.einsum("nk,nk->n", near[last - width + 1], phases[fine % up])
    return np.clip(out, -1, 1)


class Resampler:
    """``resample`` for samples that come in pieces: the neighbours that later samples still need and how far it has come
    are kept, so any pieces give the samples of one call. ``state`` is plain text and numbers, to be kept between batches.
    """

    def __init__(self, rate: int, to: int, state: dict | None = None):
        if rate <= 0 or to <= 0:
            raise ValueError("rates must be positive")
        self.rate, self.to = rate, to
        shared = np.gcd(rate, to)
        self.up, self.down = int(to // shared), int(rate // shared)
        self.phases = _low_pass(self.up, self.down) if rate != to else None
        width = self.phases.shape[1] if rate != to else 0
        state = state or {"kept": "", "seen": 0, "made": 0}
        self.kept = np.frombuffer(base64.b64decode(state["kept"]), np.float32) if state["kept"] else np.zeros(width, np.float32)
        self.seen, self.made = state["seen"], state["made"]  # samples taken in and given out

    @property
    def state(self) -> dict:
        return {"kept": base64.b64encode(self.kept.tobytes()).decode(), "seen": self.seen, "made": self.made}

    def _newest(self, k) -> int:
        """The newest sample that sample k of the new rate is made from."""
        return (k * self.down + 16 * max(self.up, self.down)) // self.up

    def _make(self, upto: int) -> np.ndarray:
        width, out = self.phases.shape[1], np.empty(max(0, upto - self.made), np.float32)
        first = self.seen - len(self.kept)  # the sample that kept[0] is
        near = np.lib.stride_tricks.sliding_window_view(self.kept, width)
        for k in range(0, len(out), 1 << 15):
            at = np.arange(self.made + k, min(self.made + k + (1 << 15), upto), dtype=np.int64)
            fine = at * self.down + 16 * max(self.up, self.down)
            out[k : k + (1 << 15)] = np.einsum("nk,nk->n", near[fine // self.up - first - width + 1], self.phases[fine % self.up])
        self.made = max(self.made, upto)
        oldest = self._newest(self.made) - width + 1
        self.kept = self.kept[max(0, min(oldest - first, len(self.kept) - width)) :]
        return np.clip(out, -1, 1)

    def push(self, samples: np.ndarray) -> np.ndarray:
        """What the samples so far make up beyond what was given out."""
        samples = np.asarray(samples, np.float32)
        self.seen += len(samples)
        if self.phases is None:
            self.made += len(samples)
            return samples
        self.kept = np.concatenate([self.kept, samples])
        ready = (self.seen * self.up - 16 * max(self.up, self.down) - 1) // self.down + 1  # whose newest sample is there
        return self._make(max(self.made, ready))

    def finish(self) -> np.ndarray:
        """The rest, with silence behind the last sample; then it begins anew."""
        total, rest = int(self.seen * self.to / self.rate), np.zeros(0, np.float32)
        if self.phases is not None and total > self.made:
            missing = max(0, self._newest(total - 1) + 1 - self.seen)
            self.kept, self.seen = np.concatenate([self.kept, np.zeros(missing, np.float32)]), self.seen + missing
            rest = self._make(total)
        self.__init__(self.rate, self.to)
        return rest


def stretch(samples: np.ndarray, rate: float) -> np.ndarray:
    """Samples slowed down to ``rate`` of their speed, in (0, 1], by cubic pieces through neighbouring samples."""
    if not 0 < rate <= 1:
        raise ValueError("rate lies in (0, 1]")
    samples = np.asarray(samples, np.float32)
    if len(samples) < 2:
        return samples
    x = np.linspace(0, len(samples) - 1, int(len(samples) / rate))
    k = np.minimum(x.astype(np.int64), len(samples) - 2)
    t = (x - k).astype(np.float32)
    before, a, b, behind = (samples[np.clip(k + d, 0, len(samples) - 1)] for d in (-1, 0, 1, 2))
    m, n = (b - before) / 2, (behind - a) / 2  # slopes at a and b
    out = a + t * (m + t * (3 * (b - a) - 2 * m - n + t * (2 * (a - b) + m + n)))
    return np.clip(out, -1, 1).astype(np.float32)


def high_pass(samples: np.ndarray, cutoff: float = 50.0, rate: int = RATE, order: int = 10) -> np.ndarray:
    """A causal Butterworth high pass of that order: the response of its bilinear transform, applied to the spectrum of
    the samples and as much silence behind them, so that nothing comes round from the end."""
    if not len(samples):
        return np.asarray(samples, np.float32)
    n = 2 * len(samples)
    tangent = np.tan(np.pi * np.fft.rfftfreq(n))  # where the transform puts each frequency
    edge = np.tan(np.pi * cutoff / rate)
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.prod([1 / (edge / (1j * tangent) - p) for p in poles], 0)
    gain[0] = 0
    return np.fft.irfft(np.fft.rfft(samples, n) * gain, n)[: len(samples)].astype(np.float32)


def fbank(samples: np.ndarray, rate: int = RATE, bins: int = 80, n_fft: int = 512, window_ms: int = 25, step_ms: int = 10) -> np.ndarray:
    """Log mel energies, frames x bins, without their mean over time."""
    size, step = rate * window_ms // 1000, rate * step_ms // 1000
    n = max(0, (len(samples) - size) // step + 1)
    if not n:
        return np.zeros((0, bins), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, size)[::step][:n] * np.hamming(size)
    power = np.abs(np.fft.rfft(frames, n_fft)) ** 2
    mel = lambda hz: 1127 * np.log1p(hz / 700)
    edges = np.linspace(mel(20), mel(rate / 2), bins + 2)
    at = mel(np.fft.rfftfreq(n_fft, 1 / rate))
    up, down = (at[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - at[:, None]) / (edges[2:] - edges[1:-1])
    energies = np.log(np.maximum(power @ np.maximum(0, np.minimum(up, down)), 1e-8))
    return (energies - energies.mean(0)).astype(np.float32)


def read_wav(content: bytes) -> tuple[int, list[np.ndarray]]:
    """(rate, samples of each channel) of a WAV file."""
    with wave.open(io.BytesIO(content)) as f:
        samples = to_float(f.readframes(f.getnframes()), f.getsampwidth()).reshape(-1, f.getnchannels())
        return f.getframerate(), [samples[:, c] for c in range(f.getnchannels())]


def read_audio(content: bytes) -> tuple[int, list[np.ndarray]]:
    """(rate, samples of each channel) of a WAV, AIFF, AU or FLAC file."""
    return codecs.read(content)


def write_wav(channels: list[np.ndarray], rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(len(channels))
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(to_pcm16(np.stack(channels, 1).ravel()))
    return out.getvalue()


def channels(content: bytes, mono: bool = False, rate: int = RATE, pad_ms: int = 5000) -> list[np.ndarray]:
    """The samples of an audio file's channels, or of their mean, at ``rate``; less than five seconds are followed by
    ``pad_ms`` of silence."""
    own, found = read_audio(content)
    out = [resample(c, own, rate) for c in ([np.mean(found, 0)] if mono else found)]
    return [np.append(x, np.zeros(pad_ms * rate // 1000, np.float32)) if len(x) < 5 * rate else x for x in out]


def decode(files: DataFrame, mono: bool = False, rate: int = RATE, pad_ms: int = 5000) -> DataFrame:
    """Rows (path, channel, samples) of WAV files (path, content), one per channel as of ``channels``. Files that
    can't be read have a null channel and an error. Plans that go on to models work on a file in its own task
    instead and exchange no samples."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"]):
                try:
                    rows += [(path, f"channel_{k}", x, None) for k, x in enumerate(channels(content, mono, rate, pad_ms), 1)]
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "channel", "samples", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, channel string, samples array<float>, error string")


def _samples(payload: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else to_float(bytes(p), 2).astype(float).tolist() for p in payload])


def pcm16_samples(payload: str) -> Column:
    """A column of 16-bit PCM bytes as samples from -1 to 1."""
    return F.pandas_udf(_samples, "array<double>")(payload)


def pcm_numbers(payload: str | Column, width: int = 2) -> Column:
    """A column of PCM bytes as 16-bit numbers; of samples of 4 bytes the upper half. What is over of an incomplete sample
    goes, null bytes give null."""
    if width not in _TYPES:
        raise ValueError(f"sample width {width}: 2 or 4 bytes are supported")

    def run(column: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else (np.frombuffer(p[: len(p) // width * width], _TYPES[width]) >> 8 * (width - 2)).astype(np.int32).tolist() for p in map(lambda x: None if x is None else bytes(x), column)], dtype=object)

    return F.pandas_udf(run, "array<int>")(payload)


def finite(samples: Column) -> Column:
    """Whether an array holds numbers alone."""
    return ~F.exists(samples, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def clipped(samples: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """An array of samples between two bounds."""
    return F.transform(samples, lambda x: F.least(F.greatest(x.cast("double"), F.lit(low)), F.lit(high)))


def pcm16_values(samples: Column, scale: int = 32767) -> Column:
    """An array of samples as 16-bit numbers, rounded half to even: at 32767 what stretched audio is written at, at
    32768 what resampled audio is."""
    return F.transform(samples, lambda x: F.least(F.greatest(F.rint(x.cast("double") * scale), F.lit(-32768.0)), F.lit(32767.0)).cast("int"))


def wav_header(content: str = "content") -> dict:
    """Columns of a WAV header: whether it is one, channels, rate and bits, from its fixed places."""

    def number(at: int, n: int):
        digits = F.concat(*(F.hex(F.substring(content, at + n - k, 1)) for k in range(n)))
        return F.conv(digits, 16, 10).cast("long")

    return {"is_wav": F.hex(F.substring(content, 1, 4)) == "52494646", "n_channels": number(22, 2), "sample_rate": number(24, 4), "bits": number(34, 2)}
