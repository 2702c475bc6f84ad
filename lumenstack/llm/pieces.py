"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The model's normalisation must be the identity, as in the public file; a text is
cut into marked words: a run of word marks with what follows it. The
distinct words of a chunk are sorted, which lays them out as a trie in
depth-first order; the forward table of one word is kept up to the prefix that
it shares with the next, so a common prefix is scored once.

Unigram models: forward[i] is the best sum of piece scores over a prefix, and
the piece that ends it. BPE models (such as the public 32k vocabulary) don't
segment by sums of scores; a sum-of-scores Viterbi gives other ids than the
library. There forward[i] holds, for each prefix, the last piece of its one
valid segmentation: piece p may follow the segmentation of the shorter prefix
if merging "last piece + p" by rank gives these two again, and exactly one p
does. Both are the same depth-first pass with another step.

Characters outside the vocabulary become byte pieces (or the unknown piece
where the model has none). Decoding puts pieces and bytes together, turns marks
into spaces and drops the mark that encoding put in front.

Null or empty text: no ids; decoded again as the empty string. Very long texts
are encoded whole; a word keeps a table of its own length. Ties between equal
scores: the leftmost, as in the library. Repeated rows and empty tables need no
rule. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

MARK = "▁"
#: Distinct words that a worker keeps; others are segmented anew.
CACHED_WORDS = 900_000
#: Pairs of pieces that a worker keeps a verdict on.
CACHED_PAIRS = 600_000
ENCODED = "doc_id long, n_pieces int, ids array<int>, ids_crc32 long, decoded_chars long, round_trip boolean"
_WORD = re.compile(f"{MARK}*[^{MARK}]*")
_BPE, _UNIGRAM = "bpe", "unigram"


class PieceModel:
    """The pieces of a model file; encodes and decodes."""

    def __init__(self, path: str, kind: str = _BPE):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        self.kind = kind
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = sp.is_byte(self.byte_id[0])
        self.unknown = sp.unk_id()
        self.byte_of = {i: b for b, i in enumerate(self.byte_id)} if self.has_bytes else {}
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        self.endings = {p[k:] for p in self.id_of for k in range(1, len(p))}
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("pieces that go on after a word mark need whole texts as words")
        self.unknown_score = min(self.score.values(), default=0.0) - 10.0
        self._words: dict[str, bytes] = {}
        self._pairs: dict[tuple[str, str], bool] = {}

    # one word

    def merged(self, text: str) -> list[str]:
        """Merging by rank, leftmost first: what BPE defines, for short strings."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, last: str, piece: str) -> bool:
        key = (last, piece)
        known = self._pairs.get(key)
        if known is None:
            known = self.merged(last + piece) == [last, piece]
            if len(self._pairs) < CACHED_PAIRS:
                self._pairs[key] = known
        return known

    def _step(self, word: str, i: int, forward: list) -> tuple[str, float]:
        """The last piece of the best segmentation of word[:i], and its score.
        Goes on to longer pieces only while some piece ends like this."""
        score, endings, best = self.score, self.endings, None
        bpe = self.kind == _BPE
        for j in range(i - 1, -1, -1):
            piece = word[j:i]
            s = score.get(piece)
            if s is not None or j == i - 1:
                if bpe:
                    if j:
                        fits = self._pairs.get((forward[j][0], piece))
                        if fits is None:
                            fits = self._may_follow(forward[j][0], piece)
                    else:
                        fits = i == 1 or self.merged(piece) == [piece]
                    if fits:
                        return piece, 0.0
                else:
                    s = (self.unknown_score if s is None else s) + forward[j][1]
                    if best is None or s >= best[1]:  # of equal scores the longer piece
                        best = (piece, s)
            if piece not in endings:
                break
        if best is None:
            raise AssertionError("every prefix has a segmentation")
        return best

    def _ids(self, word: str, forward: list) -> bytes:
        out, i = [], len(word)
        while i:
            piece = forward[i][0]
            known = self.id_of.get(piece)
            if known is not None:
                out.append(known)
            elif self.has_bytes:
                out.extend(self.byte_id[b] for b in reversed(piece.encode("utf-8", "replace")))
            else:
                out.append(self.unknown)
            i -= len(piece)
        out.reverse()
        return array("i", out).tobytes()

    def segment(self, words: list[str]) -> dict[str, bytes]:
        """The packed ids of distinct words, by depth-first traversal of their trie."""
        out = {}
        forward: list = [("", 0.0)]
        prior = ""
        for word in sorted(words):
            common = 0
            for a, b in zip(prior, word):
                if a != b:
                    break
                common += 1
            del forward[common + 1 :]
            for i in range(common + 1, len(word) + 1):
                forward.append(self._step(word, i, forward))
            out[word] = self._ids(word, forward)
            prior = word
        return out

    # texts

    def words(self, text: str) -> list[str]:
        """Marked words of a normalised text; joined, they are the marked text."""
        parts = text.split(" ")
        if "" in parts or MARK in text:
            return [w for w in _WORD.findall(MARK + text.replace(" ", MARK)) if w]
        return [MARK + p for p in parts]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) if t else [] for t in texts]
        cache = self._words
        new = {w for ws in split for w in ws if w not in cache}
        fresh = self.segment(list(new))
        if len(cache) + len(fresh) <= CACHED_WORDS:
            cache.update(fresh)
            fresh = cache
        out = []
        for ws in split:
            if fresh is cache:
                out.append(b"".join(map(cache.__getitem__, ws)))
            else:
                out.append(b"".join([fresh[w] if w in fresh else cache[w] for w in ws]))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        if not self.byte_of:
            text = "".join(self.shown[i] for i in ids)
        else:
            try:
                text = "".join(map(self._plain.__getitem__, ids))
            except KeyError:
                out, held = [], bytearray()
                for i in ids:
                    b = self.byte_of.get(i)
                    if b is not None:
                        held.append(b)
                        continue
                    if held:
                        out.append(held.decode("utf-8", "replace"))
                        held = bytearray()
                    out.append(self.shown[i])
                out.append(held.decode("utf-8", "replace"))
                text = "".join(out)
        return text[1:] if text.startswith(" ") else text

    @property
    def _plain(self) -> dict[int, str]:
        """Pieces that stand for themselves, and single ASCII bytes."""
        if not hasattr(self, "_plain_"):
            self._plain_ = {i: s for i, s in enumerate(self.shown) if i not in self.byte_of} | {i: chr(b) for i, b in self.byte_of.items() if b < 128}
        return self._plain_


_models: dict[tuple[str, str], PieceModel] = {}


def model(path: str, kind: str = _BPE) -> PieceModel:
    """One model for each file in a Python worker, kept from task to task."""
    if (path, kind) not in _models:
        _models[path, kind] = PieceModel(path, kind)
    return _models[path, kind]


def encode(docs: DataFrame, path: str, kind: str = _BPE) -> DataFrame:
    """doc_id, n_pieces, ids, their crc32 (as little-endian 32-bit integers), the
    length of the text that decoding gives, and whether that is the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, kind)
        for batch, texts in chunks(batches):
            packed = m.encode_all(texts)
            ids = [array("i", b) for b in packed]
            back = [m.decode(x) for x in ids]
            values = pa.Array.from_buffers(pa.int32(), sum(map(len, ids)), [None, pa.py_buffer(b"".join(packed))])
            offsets = [0]
            for x in ids:
                offsets.append(offsets[-1] + len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in ids], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
                    pa.array([zlib.crc32(b) for b in packed], pa.int64()),
                    pa.array([len(t) for t in back], pa.int64()),
                    pa.array([a == b for a, b in zip(texts, back)]),
                ],
                names=["doc_id", "n_pieces", "ids", "ids_crc32", "decoded_chars", "round_trip"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key and text of a column of id arrays; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else m.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["key", "text"])

    return df.select(F.col(key).cast("long").alias("key"), ids).mapInArrow(run, "key long, text string").withColumnRenamed("key", key)
