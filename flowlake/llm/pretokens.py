"""Splitting texts by the pre-token pattern, with a fast first cut.

No match of the pattern crosses a space that follows a non-space, or precedes one: white space joins only the space just before
a word. Texts are therefore cut before every space, words with their punctuation repeat, and the pattern itself runs once per
different cut. A text with a space between white space on both sides goes through the pattern whole.

``parts`` does the same for a whole Arrow column: the parts are a view of its bytes, cut at the places of the spaces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_CUT = "\ufdd0"  # a code point that is no character
_ODD = re.compile(rf"\s (?:\s|\Z)|{_CUT}")
#: The same for Arrow, whose ``\s`` is ASCII only.
_WHITE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_ODD_COLUMN = f"{_WHITE} (?:{_WHITE}|\\z)|{_CUT}"


class Pretokens:
    def __init__(self, pattern: str):
        self.split = regex.compile(pattern).findall

    def cuts(self, text: str) -> list[str]:
        """Parts that concatenate to the text and that the pattern splits independently."""
        if _ODD.search(text):
            return self.split(text)
        parts = text.replace(" ", _CUT + " ").split(_CUT)
        return parts if parts[0] else parts[1:]

    def parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The cuts of all texts (large strings without nulls), and where each text's begin, with the end of the last."""
        odd = pc.match_substring_regex(texts, _ODD_COLUMN)
        if pc.any(odd).as_py():
            return self._listed(texts, odd.to_pylist())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
        begins = np.zeros(at[-1] - at[0] + 1, bool)
        begins[:-1] = np.frombuffer(data, np.uint8)[at[0] : at[-1]] == 0x20 if data else False
        begins[at - at[0]] = True
        cuts = np.flatnonzero(begins) + at[0]
        return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), data), np.searchsorted(cuts, at)

    def _listed(self, texts: pa.Array, odd: list[bool]) -> tuple[pa.Array, np.ndarray]:
        found, sizes = [], [0]
        for k, whole in enumerate(odd):
            if whole:
                found.append(pa.array(self.split(texts[k].as_py()), pa.large_string()))
                sizes += [len(found[-1])]
            else:
                part, ends = self.parts(texts.slice(k, 1))
                found.append(part)
                sizes += [len(part)]
        return pa.concat_arrays(found), np.cumsum(sizes)
