"""Hashes of all words of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Bytes that are part of a word, by their value: all but blanks; or letters, digits and non-ASCII.
NOT_BLANK = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])
LETTERS = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def mixed(hashes: np.ndarray) -> np.ndarray:
    return (hashes ^ hashes >> np.uint64(29)) * FACTORS[0] ^ hashes >> np.uint64(32)


class Words:
    """The words of ``texts``: starts and sizes in ``chars``, text of each, and a 64-bit hash of each.

    A hash covers the first and last eight bytes, the bytes between them in the middle, and
    the length; it serves as a feature's number, not as an identity.
    """

    def __init__(self, texts: list[str | None], kept: np.ndarray, lower: bool = False):
        raw = [(text or "").encode() for text in texts]
        data = b" ".join([*raw, b" " * 32])
        data = data.lower() if lower else data
        self.chars = np.frombuffer(data, np.uint8)
        edges = np.diff(kept[self.chars].astype(np.int8), prepend=0)
        self.starts = np.flatnonzero(edges == 1)
        self.sizes = np.flatnonzero(edges == -1) - self.starts
        ends = np.cumsum([len(x) + 1 for x in raw])
        self.text = np.searchsorted(ends, self.starts, side="right")
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        head = words[self.starts] & MASKS[np.minimum(self.sizes, 8)]
        middle = words[self.starts + self.sizes // 2] & MASKS[np.clip(self.sizes - self.sizes // 2, 0, 8)]
        tail = words[self.starts + np.maximum(self.sizes - 8, 0)] & MASKS[np.minimum(self.sizes, 8)]
        hashes = head * FACTORS[0] ^ mixed(middle * FACTORS[1]) ^ (tail + self.sizes.astype(np.uint64)) * FACTORS[2]
        self.hashes = mixed(hashes)
