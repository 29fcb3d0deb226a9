"""Words of many texts at once, as 64-bit hashes in arrays.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return; A-Z
count as a-z. Hashes are polynomials over the bytes, taken from a running sum and moved to a common place,
so no Python code runs per word. Texts of a batch are joined by line feeds and worked on in blocks.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np

BLOCK = 1 << 20     # bytes worked on together; a longer word makes a longer block

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_MARKS = _WHITE.copy()      # with ASCII punctuation, for words without the marks around them
_MARKS[[ord(c) for c in string.punctuation]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown when needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            both = []
            for b in (self.base, self.inverse):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                both.append(np.multiply.accumulate(x))
            self.up, self.down = both
        return self.up, self.down


    def forget(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)


_BYTES, _WORDS = _Powers(_BASE), _Powers(_STEP)


def forget() -> None:
    """Drop the tables of powers; they are grown again when needed."""
    _BYTES.forget()
    _WORDS.forget()


@dataclass
class Words:
    """All words of a batch in order; ``first[d]`` to ``first[d + 1]`` are those of text d."""

    data: np.ndarray
    texts: np.ndarray       # where each text begins in data
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def runs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the word runs a to b - 1; equal runs of words have equal hashes, wherever they stand."""
        up, down = _WORDS.reach(len(self.hashes) + 1)
        total = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(self.hashes * up[:len(self.hashes)], out=total[1:])
        return mix64((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words inside a text (a shorter text's words make one), and the text of each."""
        n = np.diff(self.first)
        count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        text = np.repeat(np.arange(len(n)), count)
        at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + self.first[text]
        return self.runs(at, np.minimum(at + width, self.first[text + 1])), text


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where characters of scripts written without blanks begin (Han, Kana, Thai, Lao, Tibetan, Burmese, Khmer), and all their bytes."""
    lead, next_ = data[:-1], data[1:]
    three = (lead == 0xE0) & (next_ >= 0xB8) | (lead == 0xE1) & np.isin(next_, (0x80, 0x81, 0x9E, 0x9F)) | (lead >= 0xE3) & (lead <= 0xE9)
    three |= (lead == 0xEF) & np.isin(next_, (*range(0xA4, 0xAC), 0xBC, 0xBD))
    four = (lead == 0xF0) & (next_ >= 0xA0) & (next_ <= 0xB3)
    begins = np.append(three | four, False)
    inside = begins.copy()
    for i in (1, 2, 3):
        inside[i:] |= np.append(four if i == 3 else three | four, False)[:len(data) - i]
    return begins, inside


def split(texts: list[bytes | None], bare: bool = False, characters: bool = False, gaps: np.ndarray | None = None) -> Words:
    """The words of each text (none of a null); ``bare`` words end at ASCII punctuation as well, and with
    ``characters`` each character of a script without blanks is a word. ``gaps`` tells of each byte whether it
    ends words, instead of white space; a line feed must."""
    joined = b"\n".join(t or b"" for t in texts)
    data = np.frombuffer(joined, np.uint8)
    length = np.array([len(t or b"") + 1 for t in texts], np.int64)
    at = np.cumsum(length) - length
    edges = np.flatnonzero(np.diff(np.concatenate([[True], (_MARKS if bare else _WHITE if gaps is None else gaps)[data], [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if characters and len(data) > 1:
        begins, inside = unspaced(data)
        if begins.any():
            cut = begins.copy()
            cut[1:] |= inside[:-1] & ~inside[1:]
            cut = np.flatnonzero(cut & ~_WHITE[data])
            starts, ends = np.union1d(starts, cut), np.union1d(ends, np.setdiff1d(cut, starts))
    hashes, done = np.zeros(len(starts), np.uint64), 0
    while done < len(starts):
        begin = starts[done]
        stop = max(done + 1, int(np.searchsorted(ends, begin + BLOCK, side="right")))
        a, b = starts[done:stop] - begin, ends[done:stop] - begin
        size = int(b[-1])
        up, down = _BYTES.reach(size + 1)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_LOWER[data[begin:begin + size]] * up[:size], out=total[1:])
        hashes[done:stop] = mix64((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        done = stop
    first = np.searchsorted(starts, np.append(at, len(data) + 1))
    return Words(data, at, starts, ends, hashes, first.astype(np.int64))


def portions(texts: list[bytes | None], size: int = BLOCK):
    """Ranges of a batch whose texts have about ``size`` bytes together, so that arrays stay small."""
    a, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if total and total + n > size:
            yield a, i
            a, total = i, 0
        total += n + 1
    if a < len(texts):
        yield a, len(texts)
