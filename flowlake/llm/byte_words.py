"""Cutting whole batches of texts into words, on their UTF-8 bytes.

Both word classes of this package separate by ASCII characters only, so no byte of a longer character is a separator.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa


class Words(NamedTuple):
    """``codes`` number the entries of ``distinct``; text i has the words from ``first[i]`` up to ``first[i + 1]``."""

    codes: np.ndarray
    distinct: list[bytes]
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def separators(pattern: str) -> np.ndarray:
    """A table of 256 that is true where the byte separates words; ``pattern`` lists ranges such as ``09-0D``."""
    out = np.zeros(256, bool)
    for part in pattern.split():
        low, _, high = part.partition("-")
        out[int(low, 16) : int(high or low, 16) + 1] = True
    return out


#: Everything in ASCII but digits and letters.
NOT_ALPHANUMERIC = separators("00-2F 3A-40 5B-60 7B-7F")
WHITE_SPACE = separators("20 09-0D")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def cut_words(texts: Sequence[str | None], separates: np.ndarray, lower: bool = False) -> Words:
    encoded = [(text or "").encode() for text in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    inside = ~separates[data]
    begins = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1)))
    first = np.searchsorted(begins, at)
    kept = data[inside]
    if lower:
        kept = LOWER[kept]
    offsets = np.concatenate(([0], np.cumsum(ends - begins)))
    if len(kept) < 2**31:
        kind, width = pa.binary(), np.int32
    else:
        kind, width = pa.large_binary(), np.int64
    words = pa.Array.from_buffers(kind, len(begins), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(kept)])
    coded = words.dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), first, kept, offsets)
