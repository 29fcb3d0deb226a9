"""Compressed sizes of texts against raw-content Zstandard dictionaries.

A text is compressed in pieces, so that the dictionary, and not the text's own beginning, is what later
parts are matched against; the sizes of all pieces are summed and the whole text counts.
"""

from __future__ import annotations

import numpy as np
import zstandard

PIECE = 1024    # bytes compressed at a time
LEVEL = 3


def dictionary(parts: list[bytes], limit: int) -> bytes:
    """Raw dictionary content: the parts joined, those after ``limit`` bytes left out (they are a sample already)."""
    out, size = [], 0
    for p in parts:
        if size + len(p) + 1 > limit:
            break
        out.append(p)
        size += len(p) + 1
    return b"\n".join(out)


class Sizer:
    """Sizes under each of several dictionaries; built once per task from their bytes."""

    def __init__(self, contents: list[bytes], level: int = LEVEL, piece: int = PIECE):
        self.piece = piece
        self.tools = []
        for c in contents:
            d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level)
            params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0)
            self.tools.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, data: bytes) -> np.ndarray:
        parts = [data[i:i + self.piece] for i in range(0, len(data), self.piece)]
        return np.array([sum(len(t.compress(p)) for p in parts) for t in self.tools], np.float64)
