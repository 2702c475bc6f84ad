"""Byte-level BPE through the tokenizers library, with the ids of recurring
words kept in each Python worker.

A byte-level pre-tokenizer always starts a new piece at a space that precedes
a character which is no white space. So a text that is cut there encodes to
the ids of its parts, one after another, and parts that recur are merged once
or twice. Texts for which this doesn't hold (runs of white space, the library's
added tokens) go to the library whole.

A part is kept when it comes a second time, so that those that never come back,
most of a large table's distinct words, don't take the room. What is kept only
decides about time, never about ids.
"""

from __future__ import annotations

from array import array

import numpy as np
import regex

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct parts that a worker keeps; others are merged anew each time. A dict's
#: table doubles beyond 2/3 of a power of two, here of 2^20.
CACHED_PARTS = 699_050
#: Distinct ends of parts after their first piece (punctuation, line ends) that a worker keeps.
CACHED_TAILS = 43_690
#: Marks, by hash, of parts that came once; forgotten when half of them are set.
MARKS = 1 << 22


class _Irregular(Exception):
    pass


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class _Parts(dict):
    """Part without its leading space → packed ids; fills itself."""

    def __init__(self, owner: ByteLevelBpe):
        super().__init__()
        self.owner = owner
        self.tails: dict[str, bytes] = {}
        self.marks, self.marked = bytearray(MARKS), 0

    def __missing__(self, part: str) -> bytes:
        if part.isalpha():
            ids = self.owner.merge(" " + part)
        elif not part or part[0].isspace():
            raise _Irregular
        elif (m := self.owner.letters.match(part)) and m.end() < len(part):
            ids = self[m[0]] + self.tail(part[m.end() :])
        else:
            first, *rest = self.owner.pattern.findall(" " + part)
            ids = self.owner.merge(first) + b"".join(map(self.tail, rest))
        if len(self) < self.owner.cached and self.again(part):
            self[part] = ids
        return ids

    def again(self, part: str) -> bool:
        """Whether the part's mark is set already; sets it."""
        at = hash(part) % MARKS
        if self.marks[at]:
            return True
        if self.marked >= MARKS // 2:
            self.marks, self.marked = bytearray(MARKS), 0
        self.marks[at] = 1
        self.marked += 1
        return False

    def tail(self, rest: str) -> bytes:
        """The ids of what follows a part's first piece; the pattern looks at
        nothing before a piece, so they don't depend on that."""
        ids = self.tails.get(rest)
        if ids is None:
            ids = b"".join(map(self.owner.merge, self.owner.pattern.findall(rest)))
            if len(self.tails) < CACHED_TAILS:
                self.tails[rest] = ids
        return ids


class ByteLevelBpe:
    """Encodes to packed little-endian ids: 16 bits where the vocabulary fits, else 32."""

    def __init__(self, path: str, cached: int = CACHED_PARTS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self.pattern = regex.compile(PATTERN)
        self.letters = regex.compile(r"\p{L}+")
        self._chars = str.maketrans({chr(b): c for b, c in enumerate(_byte_chars())})
        self.cached = cached
        self._parts = _Parts(self)

    def pack(self, ids: list[int]) -> bytes:
        return array(self._code, ids).tobytes()

    def merge(self, piece: str) -> bytes:
        shown = "Ġ" + piece[1:] if piece[0] == " " and piece.isascii() and piece[1:].isalpha() else piece.encode().decode("latin-1").translate(self._chars)
        return self.pack([t.id for t in self.model.tokenize(shown)])

    def encode(self, text: str) -> bytes:
        """The ids that the library gives without special tokens."""
        if not text:
            return b""
        head, *parts = text.split(" ")
        try:
            if not head or any(a in text for a in self.added):
                raise _Irregular
            return b"".join([*map(self.merge, self.pattern.findall(head)), *map(self._parts.__getitem__, parts)])
        except _Irregular:
            return self.pack(self.library.encode(text, add_special_tokens=False).ids)


_encoders: dict[tuple[str, int], ByteLevelBpe] = {}


def encoder(path: str, cached: int = CACHED_PARTS) -> ByteLevelBpe:
    """One encoder for each file and bound in a Python worker, kept from task to task."""
    if (path, cached) not in _encoders:
        _encoders[path, cached] = ByteLevelBpe(path, cached)
    return _encoders[path, cached]
