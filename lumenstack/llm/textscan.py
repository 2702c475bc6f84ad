"""Array views of many texts at once: joined bytes, trigram buckets, words.

All texts of a chunk are joined with a zero byte around each, so that one pass
of array operations serves them together; nothing loops over characters.
"""

from __future__ import annotations

import numpy as np

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes of a word for language work: ASCII letters and every non-ASCII byte.
_LETTER = _ASCII_LETTER.copy()
_LETTER[128:] = True


def join(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a zero before, between and after the texts; the place of
    each text's first byte, and one more entry as if another text followed."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\0" + b"\0".join(parts) + b"\0", np.uint8)
    starts = np.cumsum([1, *(len(p) + 1 for p in parts)])
    return data, starts


def buckets(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A bucket for each trigram of bytes."""
    key = (a.astype(np.uint32) << np.uint32(16)) | (b.astype(np.uint32) << np.uint32(8)) | c
    return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums over [start, end) along the first axis; empty segments give 0."""
    out = np.zeros((len(starts), *values.shape[1:]), values.dtype)
    full = ends > starts
    if full.any():
        bounds = np.stack([starts[full], ends[full]], 1).ravel()
        # a trailing zero row lets the last end point one past the values
        padded = np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)])
        out[full] = np.add.reduceat(padded, bounds, axis=0)[::2]
    return out


class LetterWords:
    """Words of letters of lower-cased texts, with their centred trigrams."""

    def __init__(self, texts: list[str]):
        data, starts = join([t.lower() for t in texts])
        letter = _LETTER[data]
        shown = np.where(letter, data, np.uint8(0))
        self.at = np.flatnonzero(letter)
        self.bucket = buckets(shown[self.at - 1], shown[self.at], shown[self.at + 1])
        first = ~letter[self.at - 1]
        #: index into ``at`` of each word's first letter
        self.word = np.flatnonzero(first)
        place = self.at[self.word]
        self.place, self.data, self.starts = place, data, starts
        #: words of text i are first_word[i] : first_word[i + 1]
        self.first_word = np.searchsorted(place, starts)
        self.size = np.diff(np.append(self.word, len(self.at)))


#: Script classes by the Unicode ranges that a word's first character may be in.
SCRIPTS = [
    ("latin", [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)]),
    ("greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("armenian", [(0x530, 0x58F)]),
    ("hebrew", [(0x590, 0x5FF)]),
    ("arabic", [(0x600, 0x77F), (0x8A0, 0x8FF)]),
    ("indic", [(0x900, 0xDFF)]),
    ("thai", [(0xE00, 0xEFF)]),
    ("georgian", [(0x10A0, 0x10FF)]),
    ("hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("kana", [(0x3040, 0x30FF)]),
    ("han", [(0x3400, 0x9FFF)]),
]
OTHER = len(SCRIPTS)


def _by_lead() -> np.ndarray:
    """The script by the first two UTF-8 bytes of a character."""
    out = np.full(1 << 16, OTHER, np.uint8)
    for c in [*range(65, 91), *range(97, 123)]:
        out[c << 8 : (c + 1) << 8] = 0
    for script, (_, ranges) in enumerate(SCRIPTS):
        for lo, hi in ranges:
            for point in range(max(lo, 0x80), hi + 1):
                if point == 0xD7 or point == 0xF7:
                    continue
                lead = chr(point).encode()
                out[lead[0] << 8 | lead[1]] = script
    return out


SCRIPT_BY_LEAD = _by_lead()
