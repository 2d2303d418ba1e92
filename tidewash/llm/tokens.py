"""Token ids of whole texts by the ``tokenizers`` library, each common word encoded once a task.

The word tokenizer drops white space and never joins characters across it, so a text is
encoded blank by blank. Chunks of printable ASCII and Latin-1 letters are cut into letter
runs, digits and other runs as the tokenizer's own split does, and each run is given to the
library's model; any other chunk goes through the whole tokenizer. What a chunk gave is kept
in a table of fixed size, which numpy searches for many chunks at once: the whole chunk is
the key, so a hit is exact. Tests hold the ids against encoding the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Slots of the table of chunks (a power of two), and the ids it may refer to.
SLOTS = 1 << 20
KEPT_IDS = 1 << 23
PROBES = 4
#: Letter runs and long chunks that a task keeps.
MAX_RUNS = 400_000
MAX_LONG = 50_000
#: Longest chunk of the table in bytes: three 64-bit words, the top byte of the last is the length.
KEY_BYTES = 23

# Printable ASCII without apostrophe (contractions) and "<" (special tokens), and Latin-1 letters.
SIMPLE = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
EDGE = re.compile(rb"[ \n]")
RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

#: Texts are worked on in slices of at most so many rows and about so many bytes; a longer text in portions.
SLICE_ROWS = 256
SLICE_BYTES = 4 << 20

MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
ALPHANUMERIC = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        self.byte_chars = str.maketrans({x: to_bytes.pre_tokenize_str(x)[0][0] for x in letters})
        self.runs: dict[str, list[int]] = {}
        self._forget(KEPT_IDS)

    def _forget(self, room: int) -> None:
        self.keys = np.zeros((3, SLOTS), np.uint64)
        self.first = np.zeros(SLOTS, np.int64)
        self.count = np.zeros(SLOTS, np.int64)
        self.ids = np.zeros(room, np.uint32)
        self.used = 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def _run(self, run: str) -> list[int]:
        ids = self.runs.get(run)
        if ids is None:
            if len(self.runs) >= MAX_RUNS:
                self.runs.clear()
            ids = self.runs[run] = [token.id for token in self.model.tokenize(run.translate(self.byte_chars))]
        return ids

    def _chunk(self, raw: bytes) -> tuple[int, int]:
        """Encodes a chunk; where its ids begin in ``self.ids``, and their number."""
        chunk = raw.decode()
        if raw.isalpha():  # ASCII letters: one run, which the table of chunks keeps
            ids = [token.id for token in self.model.tokenize(chunk.lower())]
        elif SIMPLE.fullmatch(chunk):
            ids = [x for run in RUNS.findall(chunk.lower()) for x in self._run(run)]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        first = self.used
        self.used += len(ids)
        self.ids[first : self.used] = ids
        return first, len(ids)

    def _find(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk of ``data``: where its ids begin in ``self.ids``, and their number."""
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        key = [words[starts + 8 * k] & MASKS[np.clip(sizes - 8 * k, 0, 8 if k < 2 else 7)] for k in range(3)]
        key[2] |= sizes.astype(np.uint64) << np.uint64(56)
        mixed = key[0] * FACTORS[0] ^ key[1] * FACTORS[1] ^ key[2] * FACTORS[2]
        home = ((mixed ^ mixed >> np.uint64(29)) * FACTORS[0] >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        first, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        left = np.flatnonzero((sizes > 0) & (sizes <= KEY_BYTES))
        for probe in range(PROBES):
            slot = (home[left] + probe) & (SLOTS - 1)
            hit = (self.keys[0][slot] == key[0][left]) & (self.keys[1][slot] == key[1][left]) & (self.keys[2][slot] == key[2][left])
            first[left[hit]], count[left[hit]] = self.first[slot[hit]], self.count[slot[hit]]
            left = left[~hit]
        if len(left):
            seen: dict[bytes, tuple[int, int]] = {}
            found = []
            for a, n in zip(starts[left].tolist(), sizes[left].tolist()):
                raw = data[a : a + n]
                at = seen.get(raw)
                if at is None:
                    at = seen[raw] = self._chunk(raw)
                found.append(at)
            new = np.array(found, np.int64)
            first[left], count[left] = new[:, 0], new[:, 1]
            slot = home[left]
            for probe in range(1, PROBES):  # the first free place, else the last is overwritten
                slot = np.where(self.keys[2][slot] == 0, slot, (home[left] + probe) & (SLOTS - 1))
            for k in range(3):
                self.keys[k][slot] = key[k][left]
            self.first[slot], self.count[slot] = first[left], count[left]
        for at in np.flatnonzero(sizes > KEY_BYTES).tolist():
            raw = data[starts[at] : starts[at] + sizes[at]]
            at_long = self.long.get(raw)
            if at_long is None:
                at_long = self._chunk(raw)
                if len(self.long) < MAX_LONG:
                    self.long[raw] = at_long
            first[at], count[at] = at_long
        return first, count

    def encode_all(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        """Ids of each text without special tokens, then ``end``; null is the empty text."""
        raw = [(text or "").encode() for text in texts]
        if max(map(len, raw), default=0) > 2 * SLICE_BYTES:
            return [self._in_portions(text, end) for text in raw]
        return self._encode(raw, end)

    def _encode(self, raw: list[bytes], end: int) -> list[np.ndarray]:
        data = b"\n".join([*raw, b" " * 32])
        if self.used + 3 * len(data) > len(self.ids):  # a byte gives one id, normalisation at most three bytes
            self._forget(max(KEPT_IDS, 6 * len(data)))
        if b"<|" not in data:  # special tokens are found before texts are lower-cased
            data = data.lower()
        chars = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero((chars == 32) | (chars == 10))
        starts = np.concatenate([[0], ends[:-1] + 1])
        # A last full stop or comma behind a letter or digit is a run of its own: one chunk less to keep.
        marks = ends[ends > 1] - 1
        marks = marks[(chars[marks] == 46) | (chars[marks] == 44)]
        before = chars[marks - 1]
        latin = (chars[np.maximum(marks - 2, 0)] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        marks = marks[ALPHANUMERIC[before] | latin]
        starts, ends = (np.sort(np.concatenate([x, marks]), kind="stable") for x in (starts, ends))
        text_ends = np.cumsum([len(x) + 1 for x in raw]) - 1
        chunks = np.searchsorted(ends, text_ends) + 1  # chunks up to the end of each text
        n = int(chunks[-1]) if raw else 0
        first, count = self._find(data, starts[:n], ends[:n] - starts[:n])
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(first - total[:-1], count) + np.arange(total[-1])]
        cuts = np.concatenate([[0], total[chunks]]).tolist()
        tail = np.array([end], np.uint32)
        return [np.concatenate([ids[a:b], tail]) for a, b in zip(cuts, cuts[1:])]

    def _in_portions(self, raw: bytes, end: int) -> np.ndarray:
        """The ids of one text, encoded portion by portion, cut at blanks: no id reaches across one."""
        parts, at = [], 0
        while at < len(raw):
            blank = EDGE.search(raw, at + SLICE_BYTES)
            to = blank.start() if blank else len(raw)
            parts.append(self._encode([raw[at:to]], end)[0][:-1])
            at = to
        return np.concatenate([*parts, np.array([end], np.uint32)])

    def encode(self, text: str | None, end: int) -> np.ndarray:
        return self.encode_all([text], end)[0]


def encoder(path: str) -> WordEncoder:
    """One for each task: what a worker kept over its tasks would take memory from all later ones."""
    return WordEncoder(path)


def id_type(vocabulary: int) -> type:
    """The narrowest type of ids kept between jobs."""
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def slices(batches: Iterable, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator:
    """Arrow batches in short slices, by rows and bytes, so that only a few texts at a time are Python objects."""
    for batch in batches:
        open_ = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while open_:
            part = open_.pop()
            half = part.num_rows // 2
            if half and part.nbytes > size:
                open_ += [part.slice(half), part.slice(0, half)]
            else:
                yield part
