"""Audio formats by round trips: each encoder here is written from the format's description."""

import struct

import numpy as np
import pytest

from murmur.functions import audio, codecs


def samples(n=3000, channels=2, seed=1):
    r = np.random.default_rng(seed)
    t = np.arange(n)
    return [np.clip(0.6 * np.sin(t * 0.05 * (k + 1)) + r.normal(0, 0.02, n), -0.99, 0.99) for k in range(channels)]


def ints(x, bits):
    return np.round(np.stack(x, 1).ravel() * (2 ** (bits - 1) - 1)).astype(np.int64)


def packed(values, bits, order):
    return b"".join(int(v).to_bytes(bits // 8, order, signed=True) for v in values)


def chunk(name, body, order):
    return name + len(body).to_bytes(4, order) + body + b"\0" * (len(body) % 2)


def wav(body, kind, channels, rate, bits):
    head = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    inner = b"WAVE" + chunk(b"LIST", b"odd", "little") + chunk(b"fmt ", head, "little") + chunk(b"data", body, "little")
    return b"RIFF" + len(inner).to_bytes(4, "little") + inner


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_linear_formats(bits):
    x = samples()
    v = ints(x, bits)
    body = bytes((v + 128).astype(np.uint8)) if bits == 8 else packed(v, bits, "little")
    rate80 = (16_383 + 13).to_bytes(2, "big") + (16_000 << 50).to_bytes(8, "big")
    comm = struct.pack(">hIh", 2, len(x[0]), bits) + rate80
    aiff = b"AIFF" + chunk(b"COMM", comm, "big") + chunk(b"SSND", bytes(8) + packed(v, bits, "big"), "big")
    au = b".snd" + struct.pack(">IIIII", 24, 0xFFFFFFFF, {8: 2, 16: 3, 24: 4, 32: 5}[bits], 16_000, 2) + packed(v, bits, "big")
    for content in (wav(body, 1, 2, 16_000, bits), b"FORM" + len(aiff).to_bytes(4, "big") + aiff, au):
        rate, got = codecs.read(content)
        assert rate == 16_000 and len(got) == 2 and all(np.abs(g - y).max() < 1.2 / 2 ** (bits - 1) + 1e-6 for g, y in zip(got, x))
    rate, got = codecs.read(wav(np.stack(x, 1).astype("<f4").tobytes(), 3, 2, 8_000, 32))
    assert rate == 8_000 and np.abs(got[1] - x[1]).max() < 1e-6


def law_code(value, table):
    return int(np.abs(table - value).argmin())


@pytest.mark.parametrize("law", [codecs.A_LAW, codecs.MU_LAW])
def test_companded_formats(law):
    table = codecs.companded(np.arange(256, dtype=np.uint8), law)
    assert len(np.unique(table)) >= 255 and abs(np.abs(table).max() - 0.98) < 0.03
    size = np.sort(table[table > 0])
    assert (np.diff(size) > 0).all() and np.diff(size)[-1] / np.diff(size)[0] >= 64  # steps grow with the level
    x = samples(400, 1)
    body = bytes(law_code(v, table) for v in x[0])
    au = b".snd" + struct.pack(">IIIII", 24, len(body), 27 if law == codecs.A_LAW else 1, 8_000, 1) + body
    for content in (wav(body, law, 1, 8_000, 8), au):
        rate, got = codecs.read(content)
        assert rate == 8_000 and np.abs(got[0] - x[0]).max() < 0.02


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)] if n else []

    def rice(self, value, low):
        code = 2 * value if value >= 0 else -2 * value - 1
        self.bits += [0] * (code >> low) + [1]
        self.put(code & ((1 << low) - 1), low)

    def bytes(self):
        return np.packbits(self.bits).tobytes()


def subframe(w, x, kind, size):
    """constant, verbatim, fixed of order 0 to 4, lpc, wasted (verbatim without its low bits), escape."""
    w.put(0, 1)
    if kind == "constant":
        w.put(0, 6), w.put(0, 1), w.put(x[0] & ((1 << size) - 1), size)
        return
    if kind in ("verbatim", "wasted"):
        w.put(1, 6), w.put(kind == "wasted", 1)
        if kind == "wasted":
            w.put(0b01, 2)  # two bits: one zero, then a one
        for v in x:
            v, n = (v >> 2, size - 2) if kind == "wasted" else (v, size)
            w.put(v & ((1 << n) - 1), n)
        return
    order = kind if isinstance(kind, int) else 3
    if isinstance(kind, int):
        weights, shift = codecs.FIXED[order], 0
        w.put(8 + order, 6), w.put(0, 1)
    else:
        weights, shift = [29, -17, 3], 4
        w.put(32 + order - 1, 6), w.put(0, 1)
    for v in x[:order]:
        w.put(v & ((1 << size) - 1), size)
    if not isinstance(kind, int):
        w.put(7 - 1, 4), w.put(shift, 5)
        for c in weights:
            w.put(c & 127, 7)
    rest = [x[k] - (sum(c * x[k - 1 - j] for j, c in enumerate(weights)) >> shift) for k in range(order, len(x))]
    parts = 2 if len(x) % 4 == 0 else 0
    w.put(0 if kind != "lpc" else 1, 2), w.put(parts, 4)
    ends = [len(x) // (1 << parts) * (k + 1) - order for k in range(1 << parts)]
    begin = 0
    for n, end in enumerate(ends):
        part = rest[begin:end]
        begin = end
        if kind == "escape" or (n == 1 and kind == 2):
            wide = max(1, max((abs(v) for v in part), default=1).bit_length() + 1)
            w.put(15 if kind != "lpc" else 31, 4 if kind != "lpc" else 5), w.put(wide, 5)
            for v in part:
                w.put(v & ((1 << wide) - 1), wide)
        else:
            low = max(0, int(np.mean(np.abs(part)) + 1).bit_length() - 1) if part else 0
            w.put(low, 4 if kind != "lpc" else 5)
            for v in part:
                w.rice(v, low)


def flac(channels, kinds, rate=16_000, size=16, block=1024, stereo=None):
    n = len(channels[0])
    info = struct.pack(">HH", block, block) + bytes(6) + (rate << 44 | (len(channels) - 1) << 41 | (size - 1) << 36 | n).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x84]) + (3).to_bytes(3, "big") + b"pad"
    for number, at in enumerate(range(0, n, block)):
        own = [c[at : at + block] for c in channels]
        w = Writer()
        w.put(0x3FFE, 14), w.put(0, 2), w.put(7, 4), w.put(5, 4), w.put({None: len(channels) - 1, "left": 8, "right": 9, "middle": 10}[stereo], 4), w.put(4, 3), w.put(0, 1)
        w.put(number if number < 128 else 0xC0 | number >> 6, 8)
        if number >= 128:
            w.put(0x80 | number & 63, 8)
        w.put(len(own[0]) - 1, 16), w.put(0, 8)
        sizes = [size] * len(own)
        if stereo:
            a, b = own
            side = [x - y for x, y in zip(a, b)]
            own, sizes = {"left": ([a, side], [size, size + 1]), "right": ([side, b], [size + 1, size]), "middle": ([[(x + y) >> 1 for x, y in zip(a, b)], side], [size, size + 1])}[stereo]
        for x, k, s in zip(own, kinds, sizes):
            subframe(w, x, k, s)
        out += w.bytes() + bytes(2)
    return out


@pytest.mark.parametrize("kinds", [(0, 1), (2, 3), (4, "lpc"), ("verbatim", "escape"), ("wasted", "constant")])
def test_flac_round_trips(kinds):
    x = [ints([c], 16).tolist() for c in samples(2600)]
    if kinds[0] == "wasted":
        x = [[v & ~3 for v in x[0]], [1234] * len(x[1])]
    rate, got = codecs.read(flac(x, kinds))
    assert rate == 16_000 and all(np.array_equal(np.round(g * 32_768).astype(int), c) for g, c in zip(got, x))


@pytest.mark.parametrize("stereo", ["left", "right", "middle"])
def test_flac_differences(stereo):
    x = [ints([c], 16).tolist() for c in samples(700, seed=3)]
    _, got = codecs.read(flac(x, (2, 2), stereo=stereo))
    assert all(np.array_equal(np.round(g * 32_768).astype(int), c) for g, c in zip(got, x))
    many = [x[0][:300]]
    _, got = codecs.read(flac(many, (1,), block=2))
    assert np.array_equal(np.round(got[0] * 32_768).astype(int), many[0])  # more than 127 frames


def test_broken_files():
    whole = flac([ints([c], 16).tolist() for c in samples(300)], (2, 2))
    for content in (b"", b"RIFF", b"RIFFxxxxWAVE", b"fLaC", whole[:60], whole[:200], b"FORM" + bytes(40), b".snd" + bytes(30), wav(b"", 2, 1, 8000, 4), wav(b"ab", 1, 0, 8000, 16), wav(b"ab", 1, 1, 0, 16), b"ID3 something"):
        with pytest.raises((ValueError, EOFError)):
            codecs.read(content)
    assert [len(c) for c in codecs.read(wav(b"abc", 1, 1, 8000, 16))[1]] == [1]


def test_files_of_all_formats_are_decoded(spark):
    x = samples(2000, 1)
    files = [("a.wav", audio.write_wav(x)), ("b.flac", flac([ints(x, 16).tolist()], (2,))), ("c.xyz", b"no audio")]
    got = {r["path"]: (r["channel"], r["samples"], r["error"]) for r in audio.decode(spark.createDataFrame(files, "path string, content binary"), pad_ms=0).collect()}
    assert np.abs(np.array(got["a.wav"][1]) - np.array(got["b.flac"][1])).max() < 1e-4 and got["c.xyz"][0] is None and got["c.xyz"][2]
