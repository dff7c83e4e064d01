"""Token ids of whole batches of texts, with each distinct pre-token encoded once per worker."""

from __future__ import annotations

import json
import os
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers

from murmur.llm._words import Words, distinct

#: Pre-tokens that a worker remembers at most before it starts anew.
REMEMBERED = 500_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?|*$%&#")] = True
_HIGH = np.zeros(256, bool)  # second bytes of the letters U+00C0 to U+00FF
_HIGH[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


#: What a vocabulary file says if its words can be encoded by themselves, in small letters: text is lowered, and
#: what is encoded are runs of letters, of marks and single digits, without the white space between.
_LOWERED = ["NFC", "Replace", "Lowercase"]
_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@cache
def words_apart(path: str) -> bool:
    """Whether the words of a text can be encoded one by one with a vocabulary file, as ``pre_tokens`` cuts them."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    lowered = [n.get("type") for n in (found.get("normalizer") or {}).get("normalizers", [])]
    split = next(iter((found.get("pre_tokenizer") or {}).get("pretokenizers", [])), {})
    return lowered == _LOWERED and split.get("pattern") == {"Regex": _RUNS} and split.get("behavior") == "Removed" and split.get("invert") is True


def pre_tokens(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first pre-token of each text): the words, cut before closing marks that follow a letter.

    The vocabulary drops white space and never merges a letter with a mark, so ids of these parts, on end, are
    the ids of the text.
    """
    cut = words.ends.copy()
    going = np.ones(len(cut), bool)
    for _ in range(8):
        at = np.maximum(cut - 1, words.starts)
        going &= _TAIL[data[at]] & (at > words.starts) if len(cut) else going
        if not going.any():
            break
        cut[going] -= 1
    if len(cut):
        last, before = data[cut - 1], data[np.maximum(cut - 2, words.starts)]
        letter = _LETTER[last] | (_HIGH[last] & (before == 0xC3) & (cut - 2 >= words.starts))
        cut = np.where(letter & ~going, cut, words.ends)
    more = cut < words.ends
    at = np.arange(len(cut)) + np.r_[0, np.cumsum(more)[:-1]] if len(cut) else np.arange(0)
    n = len(cut) + int(more.sum())
    starts, ends = np.empty(n, np.int64), np.empty(n, np.int64)
    starts[at], ends[at] = words.starts, cut
    starts[at[more] + 1], ends[at[more] + 1] = cut[more], words.ends[more]
    first = np.r_[at, n][words.first]
    return starts, ends, first


class Encoder:
    """A tokenizer with the ids of pre-tokens seen before, in one flat array."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder per worker process and vocabulary file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _forget(self) -> None:
        self._index: dict[bytes, int] = {}
        self._offset, self._length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self._ids, self._used = np.zeros(1 << 14, np.uint32), 0

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, parts: list[bytes]) -> None:
        for k in range(0, len(parts), 4096):
            some = parts[k : k + 4096]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            n, total = len(self._index), int(lengths.sum())
            if n + len(some) > len(self._offset):
                self._offset, self._length = (np.resize(x, 2 * (n + len(some))) for x in (self._offset, self._length))
            if self._used + total > len(self._ids):
                self._ids = np.resize(self._ids, 2 * (self._used + total))
            self._ids[self._used : self._used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
            self._offset[n : n + len(some)] = self._used + np.cumsum(lengths) - lengths
            self._length[n : n + len(some)] = lengths
            self._used += total
            self._index.update(zip(some, range(n, n + len(some))))

    def _look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each pre-token among those remembered; capitals are learned as small letters, as the
        vocabulary has none, unless a special token might come of it."""
        buffer = data.tobytes()
        if b"<|" not in buffer:
            data = _SMALL[data]
            buffer = data.tobytes()
        one, which = distinct(data, starts, ends)
        if len(self._index) + len(one) > REMEMBERED:
            self._forget()
        parts = [buffer[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())]
        index = self._index
        if new := [p for p in dict.fromkeys(parts) if p not in index]:
            self._learn(new)
        return np.fromiter(map(index.__getitem__, parts), np.int64, len(parts))[which]

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of ids of each pre-token."""
        at = self._look_up(data, starts, ends)
        return self._length[at].astype(np.int64)

    def whole(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """As ``ids``, with every text encoded as it is, for vocabularies whose words don't stand by themselves."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        upto = np.r_[0, np.cumsum([len(x) for x in ids], dtype=np.int64)]
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(upto[-1])), upto

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and where each text's begin (n + 1 entries)."""
        at = self._look_up(data, starts, ends)
        lengths = self._length[at].astype(np.int64)
        upto = np.r_[0, np.cumsum(lengths)]
        return self._ids[np.repeat(self._offset[at] - upto[:-1], lengths) + np.arange(upto[-1])], upto[first]
