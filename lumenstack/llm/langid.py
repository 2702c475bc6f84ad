"""Language identification with spans for mixed text.

A word's script (by Unicode ranges) narrows the languages to those that are
written in it. Each candidate scores the word by the log probabilities of its
centred byte trigrams. Viterbi over the words, with a penalty for switching,
labels them; runs of equal labels are spans. A document's language is the one
with most letters on the path, and its score their share.

The model is fit on the text and language of at most ``PER_LANGUAGE`` learnable
rows of each language (all text of them), picked by a hash of the id.

Null text, or text without a letter: ``und`` with score 0 and no spans. Very
long texts are labelled whole. Rows don't affect each other, so ties, repeated
rows and empty tables need no rule. Without any row to learn from, everything
is ``und``. Columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, chunks, held_out, learnable
from .textscan import BUCKETS, OTHER, SCRIPT_BY_LEAD, LetterWords, segment_sums

#: Bound on the rows that the model is fit on, for each language.
PER_LANGUAGE = 4000
#: Log-probability price of a change of language between two words.
SWITCH = 10.0
#: A script is a language's own if this share of its words is in it.
SCRIPT_SHARE = 0.01
UNDETERMINED = "und"
SPANS = "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, log probabilities
    scripts: np.ndarray  # languages x scripts, whether the language uses it


def _scripts(w: LetterWords) -> np.ndarray:
    nxt = np.append(w.data, 0)[w.place + 1]
    return SCRIPT_BY_LEAD[w.data[w.place].astype(np.int64) << 8 | nxt]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Counts trigrams and scripts for each language on the executors; the
    driver receives the two tables, whose size doesn't depend on the rows."""
    known = docs.select("doc_id", "text", "lang").filter(learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = bounded_sample(known, "doc_id", "lang", per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch, texts in chunks(batches):
            langs = batch.column(0).to_pylist()
            for lang in set(langs):
                w = LetterWords([t for t, x in zip(texts, langs) if x == lang])
                seen = np.concatenate([np.bincount(w.bucket, minlength=BUCKETS), np.bincount(_scripts(w), minlength=OTHER + 1)])
                totals[lang] = totals[lang] + seen if lang in totals else seen
        for lang, seen in totals.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(seen[at].astype(np.int64))], names=["lang", "at", "n"])

    found = sample.mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique().tolist())
    counts = np.zeros((len(languages), BUCKETS + OTHER + 1))
    counts[np.searchsorted(languages, found["lang"].to_numpy().astype(str)) if languages else [], found["at"].to_numpy(np.int64)] = found["n"]
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    weights = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS)).T.astype(np.float32)
    return LanguageModel(languages, np.ascontiguousarray(weights), scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True)))


def _constant(scores: np.ndarray, first: np.ndarray, best: np.ndarray, switch: float) -> np.ndarray:
    """Texts whose best path certainly never switches: over no run of words does
    another language gain more on the text's best one than half a switch costs.
    A path that leaves the best language for m >= 2 runs switches m - 1 times at
    least, as runs may adjoin, and so gains no more than it pays."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    gain = np.cumsum(scores - scores[np.arange(len(scores)), best[text]][:, None], axis=0, dtype=np.float64)
    before = np.concatenate([np.zeros((1, scores.shape[1])), gain[:-1]])
    span = gain.max() - gain.min() + 1 if len(gain) else 1
    lowered = before - (text * span)[:, None]  # each text starts a lower level, so its running minimum starts anew
    rise = gain - (text * span)[:, None] - np.minimum.accumulate(lowered, axis=0)
    out = np.ones(len(n), bool)
    out[text[(rise > switch / 2).any(1)]] = False
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word. ``first[i] : first[i + 1]`` are the words of
    text i. All texts advance together, a word at a time."""
    n = np.diff(first)
    totals = segment_sums(scores.astype(np.float64), first[:-1], first[1:])
    best = totals.argmax(1)
    path = np.repeat(best, n)
    hard = np.flatnonzero(~_constant(scores, first, best, switch) & (n > 1))
    hard = hard[np.argsort(-n[hard], kind="stable")]
    if not len(hard):
        return path
    at, length = first[hard], n[hard]
    index = np.min_scalar_type(scores.shape[1])  # wide enough for every label
    value = scores[at].astype(np.float64)
    back = []
    for t in range(1, int(length[0])):
        live = np.searchsorted(-length, -t, side="left")
        v = value[:live]
        top = v.argmax(1)
        price = v[np.arange(live), top] - switch
        stay = v >= price[:, None]
        back.append(np.where(stay, np.arange(v.shape[1], dtype=index), top[:, None].astype(index)))
        value[:live] = np.where(stay, v, price[:, None]) + scores[at[:live] + t]
    label = value.argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        live = np.searchsorted(-length, -t, side="left") if t else len(hard)
        path[at[:live] + t] = label[:live]
        if t:
            label[:live] = back[t - 1][np.arange(live), label[:live]]
    return path


def word_scores(w: LetterWords, model: LanguageModel) -> np.ndarray:
    ends = np.append(w.word[1:], len(w.at))
    scores = segment_sums(model.weights[w.bucket], w.word, ends)
    allowed = model.scripts.T[_scripts(w)]
    allowed |= ~allowed.any(1, keepdims=True)  # a script that no language has narrows nothing
    return np.where(allowed, scores, scores.min(initial=0) - 1000)


def label_texts(texts: list[str], model: LanguageModel, with_spans: bool = False) -> tuple[list[str], np.ndarray, list]:
    """For each text its language, the share of its letters, and its spans as
    character offsets."""
    k = len(model.languages)
    w = LetterWords(texts)
    if not k:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
    path = viterbi(word_scores(w, model), w.first_word) if len(w.word) else np.zeros(0, np.int64)
    votes = np.zeros((len(path), k))
    votes[np.arange(len(path)), path] = w.size
    votes = segment_sums(votes, w.first_word[:-1], w.first_word[1:])
    top = votes.argmax(1)
    total = votes.sum(1)
    letters = np.array([n > 0 and any(map(str.isalpha, t)) for n, t in zip(total, texts)], bool)
    names = [model.languages[i] if ok else UNDETERMINED for i, ok in zip(top.tolist(), letters.tolist())]
    score = np.where(letters, votes.max(1) / np.maximum(total, 1), 0.0)
    spans: list = [[] for _ in texts]
    if with_spans and len(path):
        # characters before each byte: all bytes but those that continue one
        chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        for i in np.flatnonzero(letters).tolist():
            lo, hi = w.first_word[i], w.first_word[i + 1]
            cuts = np.concatenate([[lo], lo + 1 + np.flatnonzero(np.diff(path[lo:hi]))])
            at = chars[np.append(w.place[cuts], w.starts[i + 1] - 1)] - chars[w.starts[i]]
            spans[i] = [{"start": a, "end": b, "lang": model.languages[k]} for a, b, k in zip(at[:-1].tolist(), at[1:].tolist(), path[cuts].tolist())]
    return names, score, spans


def predict(docs: DataFrame, model: LanguageModel, with_spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and, if asked for, spans (offsets into the
    lower-cased text) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of a float a language

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            names, score, spans = label_texts(texts, shared.value, with_spans)
            cols = [batch.column(0), pa.array(names, pa.string()), pa.array(score)]
            fields = ["doc_id", "lang_pred", "score"]
            if with_spans:
                cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                fields.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names=fields)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(label, SPANS if with_spans else SPANS.rpartition(", spans")[0])


def identified(docs: DataFrame, model: LanguageModel, least: float = 0.4) -> DataFrame:
    """The rows, all columns as they are, whose language is determined with a
    share of at least ``least`` of their letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            names, score, _ = label_texts(texts, shared.value)
            yield batch.filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(names, score)]))

    return docs.mapInArrow(keep, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every row."""
    out = predict(docs, fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")
