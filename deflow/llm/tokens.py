"""Encoding with a public tokenizer file, word by word through a bounded memory of words seen before."""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer

# White space other than blank and line feed, as regular expressions of tokenizers see it (and a little more).
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x00]")
_RUNS = ("  ", " \n", "\n ", "\n\n")
_JOINED = re.compile(r"[.,](?<=[\W_][.,])(?=\s|\Z)")   # a stop that belongs to a run of other marks
_BREAK = re.compile(r"(?<=\S)(?= \S)")
_WORD = re.compile(r" ?[^\W\d_]+").fullmatch
REMEMBERED = 300_000    # words kept by one worker (about 200 bytes each); beyond that only short ones stay,
SHORT = 8               # which are those that come again; half as many of them at most

_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class _Known(dict):
    """Piece -> its ids as bytes; encodes a piece when it is first asked for."""

    def __init__(self, tokenizer: Tokenizer, code: str):
        super().__init__({"": b""})
        self.whole, self.word, self.code = tokenizer.encode, tokenizer.model.tokenize, code

    def __missing__(self, piece: str) -> bytes:
        if _WORD(piece):    # one pre-token, so the model may have it as it is
            ids = [t.id for t in self.word(piece.encode().decode("latin-1").translate(_SHOWN))]
        else:
            ids = self.whole(piece, add_special_tokens=False).ids
        out = self[piece] = array(self.code, ids).tobytes()
        return out


class WordEncoder:
    """``encode`` gives the ids of whole texts as little-endian bytes.

    A byte-level BPE with the usual pre-tokens begins a new one at a single blank between visible characters, on
    either side of a single line feed, and at a full stop or comma between a letter or digit and white space.
    Texts are cut there, and every different piece is encoded by the tokenizer once.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.known = _Known(self.tokenizer, "H" if self.dtype.itemsize == 2 else "I")

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            short = {p: ids for p, ids in self.known.items() if len(p) <= SHORT}
            self.known = _Known(self.tokenizer, self.known.code)
            if len(short) <= REMEMBERED // 2:
                self.known.update(short)
        known = self.known.__getitem__
        return [b"".join(map(known, pieces(x))) for x in texts]


def pieces(text: str) -> list[str]:
    """``text`` cut where a pre-token begins in any case."""
    if any(r in text for r in _RUNS) or _OTHER_SPACE.search(text):
        return _BREAK.split(text)
    cut = text.replace("\n", "\x00\n\x00")
    if not _JOINED.search(text):
        for stop in ".,":
            cut = cut.replace(stop + " ", "\x00" + stop + " ").replace(stop + "\x00", "\x00" + stop + "\x00")
    return cut.replace(" ", "\x00 ").split("\x00")


_HELD: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    """One encoder for each file and process, so that a worker's later tasks know the words of earlier ones."""
    if (path, special_as_text) not in _HELD:
        _HELD[path, special_as_text] = WordEncoder(path, special_as_text)
    return _HELD[path, special_as_text]


def byte_table(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes each id of a byte-level vocabulary stands for."""
    back = {c: b for b, c in _SHOWN.items()}
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out
