"""Samples of audio files of several formats: WAV, AIFF, AU and FLAC, told apart by how they begin."""

from __future__ import annotations

from bisect import bisect_left
from operator import mul

import numpy as np

#: Fixed values of the formats: codes of sample types in WAV and AU headers, block sizes and rates of FLAC frames.
PCM, FLOAT, A_LAW, MU_LAW, EXTENSIBLE = 1, 3, 6, 7, 0xFFFE
AU_TYPES = {1: (MU_LAW, 8), 2: (PCM, 8), 3: (PCM, 16), 4: (PCM, 24), 5: (PCM, 32), 6: (FLOAT, 32), 7: (FLOAT, 64), 27: (A_LAW, 8)}
FLAC_RATES = {1: 88_200, 2: 176_400, 3: 192_000, 4: 8_000, 5: 16_000, 6: 22_050, 7: 24_000, 8: 32_000, 9: 44_100, 10: 48_000, 11: 96_000}
FLAC_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
#: Weights of the samples before in FLAC's fixed predictors, the newest first.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def companded(codes: np.ndarray, law: int) -> np.ndarray:
    """The samples from -1 to 1 of 8-bit logarithmic codes."""
    codes = codes.astype(np.int32)
    if law == MU_LAW:
        codes = ~codes & 0xFF
        size = ((((codes & 15) << 3) + 132) << (codes >> 4 & 7)) - 132
        return np.where(codes & 0x80, -size, size).astype(np.float32) / 32_768
    codes ^= 0x55
    part, step = codes >> 4 & 7, codes & 15
    size = np.where(part == 0, (step << 4) + 8, ((step << 4) + 264) << np.maximum(part - 1, 0))
    return np.where(codes & 0x80, size, -size).astype(np.float32) / 32_768


def linear(data: bytes, kind: int, bits: int, big: bool = False, unsigned: bool = False) -> np.ndarray:
    """Samples from -1 to 1 of raw bytes; what is over of an incomplete sample goes."""
    width = bits // 8
    if kind in (A_LAW, MU_LAW):
        return companded(np.frombuffer(data, np.uint8), kind)
    if width not in ((4, 8) if kind == FLOAT else (1, 2, 3, 4)) or bits % 8 or kind not in (PCM, FLOAT):
        raise ValueError(f"samples of kind {kind} with {bits} bits")
    data = data[: len(data) // width * width]
    if kind == FLOAT:
        return np.clip(np.nan_to_num(np.frombuffer(data, f"{'>' if big else '<'}f{width}")), -1, 1).astype(np.float32)
    if width == 3:
        three = np.frombuffer(data, np.uint8).reshape(-1, 3)[:, :: 1 if big else -1].astype(np.int32)
        return (((three[:, 0] << 24 | three[:, 1] << 16 | three[:, 2] << 8) >> 8) / 8_388_608).astype(np.float32)
    if width == 1:
        return ((np.frombuffer(data, np.uint8).astype(np.float32) - 128) if unsigned else np.frombuffer(data, np.int8).astype(np.float32)) / 128
    return (np.frombuffer(data, f"{'>' if big else '<'}i{width}") / 2 ** (bits - 1)).astype(np.float32)


def _chunks(data: bytes, big: bool) -> dict[bytes, bytes]:
    """The first chunk of each name in a RIFF or FORM file; one that is cut off ends with the file."""
    out, at = {}, 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "big" if big else "little")
        out.setdefault(data[at : at + 4], data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def _split(samples: np.ndarray, channels: int) -> list[np.ndarray]:
    if channels < 1:
        raise ValueError("no channels")
    samples = samples[: len(samples) // channels * channels].reshape(-1, channels)
    return [np.ascontiguousarray(samples[:, k]) for k in range(channels)]


def _wav(data: bytes) -> tuple[int, list[np.ndarray]]:
    found = _chunks(data, False)
    head = found.get(b"fmt ", b"")
    if len(head) < 16:
        raise ValueError("a WAV file without a format")
    number = lambda a, n: int.from_bytes(head[a : a + n], "little")
    kind = number(24, 2) if number(0, 2) == EXTENSIBLE and len(head) >= 26 else number(0, 2)
    return number(4, 4), _split(linear(found.get(b"data", b""), kind, number(14, 2), unsigned=True), number(2, 2))


def _aiff(data: bytes) -> tuple[int, list[np.ndarray]]:
    found = _chunks(data, True)
    head, body = found.get(b"COMM", b""), found.get(b"SSND", b"")
    if len(head) < 18:
        raise ValueError("an AIFF file without a format")
    exponent, size = int.from_bytes(head[8:10], "big") & 0x7FFF, int.from_bytes(head[10:18], "big")
    form = head[18:22] if data[8:12] == b"AIFC" else b"NONE"
    kind = {b"NONE": PCM, b"twos": PCM, b"sowt": PCM, b"fl32": FLOAT, b"FL32": FLOAT, b"ulaw": MU_LAW, b"ULAW": MU_LAW, b"alaw": A_LAW, b"ALAW": A_LAW}.get(form, 0)
    bits = -(-int.from_bytes(head[6:8], "big") // 8) * 8
    return round(size * 2.0 ** (exponent - 16_446)), _split(linear(body[8 + int.from_bytes(body[:4], "big") :], kind, bits, form != b"sowt"), int.from_bytes(head[:2], "big"))


def _au(data: bytes) -> tuple[int, list[np.ndarray]]:
    begin, size, code, rate, channels = (int.from_bytes(data[k : k + 4], "big") for k in range(4, 24, 4))
    kind, bits = AU_TYPES.get(code, (0, 0))
    return rate, _split(linear(data[begin : len(data) if size == 0xFFFFFFFF else begin + size], kind, bits, True), channels)


class Bits:
    """Numbers of any width from a file's bits."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, 8 * at
        self.ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))).tolist()
        self.one = 0

    def take(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise EOFError("the file ends within a number")
        found = int.from_bytes(self.data[self.at >> 3 : (end + 7) >> 3], "big") >> (-end & 7) & ((1 << n) - 1)
        self.at = end
        return found

    def signed(self, n: int) -> int:
        found = self.take(n) if n else 0
        return found - (1 << n) if n and found >> (n - 1) else found

    def zeros(self) -> int:
        """How many zeros come before the next one, which is passed over."""
        self.one = bisect_left(self.ones, self.at, self.one)
        if self.one == len(self.ones):
            raise EOFError("the file ends within a number")
        n, self.at = self.ones[self.one] - self.at, self.ones[self.one] + 1
        return n


def _residuals(bits: Bits, n: int, order: int) -> list[int]:
    """Rice codes in partitions: an odd code is a negative number."""
    wide = bits.take(2)
    if wide > 1:
        raise ValueError("an unknown coding of residuals")
    parts, out = 1 << bits.take(4), []
    for k in range(parts):
        count, low = n // parts - (order if k == 0 else 0), bits.take(4 + wide)
        if low == (31 if wide else 15):  # as they are
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(count)]
            continue
        for _ in range(count):
            code = bits.zeros() << low | (bits.take(low) if low else 0)
            out.append(code >> 1 ^ -(code & 1))
    return out


def _subframe(bits: Bits, n: int, size: int) -> list[int]:
    """One channel's samples in a frame."""
    bits.take(1)
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.zeros() + 1
    size -= wasted
    if kind == 0:
        out = [bits.signed(size)] * n
    elif kind == 1:
        out = [bits.signed(size) for _ in range(n)]
    elif kind >= 32 or 8 <= kind <= 12:
        order = kind - 31 if kind >= 32 else kind - 8
        out = [bits.signed(size) for _ in range(order)]
        weights, shift = FIXED[order] if kind < 32 else [], 0
        if kind >= 32:
            width = bits.take(4) + 1
            shift = bits.signed(5)
            weights = [bits.signed(width) for _ in range(order)]
        weights = weights[::-1]
        for x in _residuals(bits, n, order):
            out.append(x + (sum(map(mul, weights, out[-order:])) >> shift if order else 0))
    else:
        raise ValueError("an unknown kind of subframe")
    return [x << wasted for x in out] if wasted else out


def _flac(data: bytes) -> tuple[int, list[np.ndarray]]:
    at, last, rate, size, total = 4, False, 0, 0, 0
    while not last:
        last, kind, length = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            packed = int.from_bytes(data[at + 14 : at + 22], "big")
            rate, size, total = packed >> 44, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
        at += 4 + length
    bits, frames = Bits(data, at), []
    while bits.at + 48 <= 8 * len(data) and not (total and sum(f.shape[1] for f in frames) >= total):
        if bits.take(14) != 0x3FFE:
            raise ValueError("a FLAC frame doesn't begin where the one before ends")
        bits.take(2)
        blocks, rates, channels, width = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        bits.take(1)
        first = bits.take(8)
        for _ in range(max(0, 8 - (first ^ 0xFF).bit_length() - 1)):
            bits.take(8)
        n = 192 if blocks == 1 else 576 << blocks - 2 if blocks < 6 else bits.take(8) + 1 if blocks == 6 else bits.take(16) + 1 if blocks == 7 else 256 << blocks - 8
        own = FLAC_RATES.get(rates, 0) or (bits.take(8) * 1000 if rates == 12 else bits.take(16) * (10 if rates == 14 else 1) if rates in (13, 14) else rate)
        bits.take(8)
        rate, width = rate or own, FLAC_BITS.get(width, size)
        side = {8: 1, 9: 0, 10: 1}.get(channels)  # which channel is a difference, of one bit more
        rows = [np.array(_subframe(bits, n, width + (k == side)), np.int64) for k in range(channels + 1 if side is None else 2)]
        if channels == 8:
            rows[1] = rows[0] - rows[1]
        elif channels == 9:
            rows[0] = rows[0] + rows[1]
        elif channels == 10:
            middle = rows[0] * 2 + (rows[1] & 1)
            rows = [(middle + rows[1]) >> 1, (middle - rows[1]) >> 1]
        frames.append(np.stack(rows) / 2.0 ** (width - 1))
        bits.at = -(-bits.at // 8) * 8 + 16
    if not frames:
        raise ValueError("a FLAC file without frames")
    return rate, list(np.concatenate(frames, 1).astype(np.float32))


def read(content: bytes) -> tuple[int, list[np.ndarray]]:
    """(rate, samples of each channel from -1 to 1) of a file. A format that isn't known, or a file that breaks off within its
    header or a FLAC frame, is a ValueError or an EOFError; other files give what is there."""
    of = {b"RIFF": _wav, b"FORM": _aiff, b".snd": _au, b"fLaC": _flac}.get(bytes(content[:4]))
    if of is None:
        raise ValueError("an unknown format of audio")
    try:
        rate, found = of(bytes(content))
    except IndexError:
        raise EOFError("the file ends within its header") from None
    if rate <= 0:
        raise ValueError("a file without a rate")
    return rate, found
