"""Toxicity: a learned lexicon, matched with misspellings, scored in context.

Terms: words whose contexts (the word before them) are significantly often in
rows labelled toxic. Contexts rather than rows are counted, so that copies of
one toxic text don't turn its ordinary words into terms.

Match: the Levenshtein automaton of a word runs against the trie of the terms
(an adjacent swap counts as one edit); it is followed only where some row entry is
still within the largest tolerance: none below 4 letters, 1 below 12 (for terms
of 4 letters if the first one is right), else 2. A term within k edits keeps one
of its k + 1 parts whole, unless a swap falls on a border between them; with the
parts of terms so swapped most words pass without a walk. Near words that good
text of the sample has as often as toxic text are no misspellings.

Context: each hit gets the probability that it is quotation, from a window of
words around it: a sum of weights of the window's words, of quotation marks on both
sides, and of a base. Weights are log odds between hits in rows labelled good and
hits in rows labelled toxic, drawn towards ``PRIOR_CONTEXT`` (reporting verbs and
quotation marks for, direct address against) by ``CONTEXT_PULL`` pseudo-hits, so that
they hold where the sample has no quotation. The probability divides a hit's
exposure into quoted and plain; plain exposure to exact and misspelt terms and
quoted exposure give the score by logistic regression.

Fit on at most ``PER_LABEL`` learnable rows of each label, whole texts, picked
by a hash of the id. Lexicon and context weights are bounded by that sample alone.

Null or empty text: the score of a text without hits. Very long texts and words
are read whole. Without learnable rows of both labels the score is the share of label 1
(0 without any). Ties, repeated rows and empty tables need no rule. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, chunks, held_out, learnable, staged

PER_LABEL = 4000
#: Log-likelihood ratio from which a word is a term, and its least contexts.
LEAST_RATIO, LEAST_CONTEXTS = 15.0, 5
TOXIC = 0.3
WINDOW = 5
#: Words of a worker whose verdict is kept.
CACHED_WORDS = 1_000_000
SCORES = "doc_id long, score double, hits array<struct<term:string,word:string,distance:int,quoted:double>>"

_WORD = re.compile(r"[^\W_]+")
_QUOTES = re.compile("[\"“”„«»‹›]|(?<!\\w)'|'(?!\\w)")
QUOTE_MARKS = '"'
#: Log odds of quotation that hold without evidence, by feature of the window.
PRIOR_CONTEXT = {QUOTE_MARKS: 3.5}
PRIOR_CONTEXT |= dict.fromkeys("said says say called calls quote quoted quotes word words wrote writes term terms reported comment comments slur insult dit écrit mot mots citation sagte sagt wort wörter zitat schrieb dijo dice palabra palabras cita escribió".split(), 3.0)
PRIOR_CONTEXT |= dict.fromkeys("you your youre du dich dein ihr tu te vous ton votre usted eres tú vosotros".split(), -4.0)
#: The base: one hit in ten is quotation unless the sample has more.
BASE = math.log(1 / 9)
#: Pseudo-hits by which a context weight is drawn towards its prior; least hits for one without.
CONTEXT_PULL, LEAST_HITS = 20.0, 10


def tolerance(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 12 else 2


def _near_enough(term: str, word: str, distance: int) -> bool:
    return distance <= tolerance(term) and (distance == 0 or len(term) > 4 or term[0] == word[:1])


class Lexicon:
    """Terms with weights, as a trie that Levenshtein automata run against."""

    def __init__(self, weights: dict[str, float], ordinary: frozenset[str] = frozenset()):
        self.weights, self.ordinary = weights, ordinary
        self.root: dict = {}
        self.most = max(map(tolerance, weights), default=0)
        self.longest = max(map(len, weights), default=0) + self.most
        # parts → the lengths of words that may hold them, as bits
        self.prefixes: dict[str, int] = {}
        self.suffixes: dict[str, int] = {}
        self.middles: dict[str, int] = {}
        self.swapped: set[str] = set()
        for term in weights:
            node = self.root
            for ch in term:
                node = node.setdefault(ch, {})
            node[""] = term
            if k := tolerance(term):
                lengths = sum(1 << n for n in range(len(term) - k, len(term) + k + 1))
                self._guard(term, k, lengths)
        self.spans = [sorted({len(p) for p in s}) for s in (self.prefixes, self.suffixes, self.middles)]
        self._seen: set[str] = set()
        self._hits: dict[str, tuple[str, int]] = {}

    def _guard(self, term: str, k: int, lengths: int) -> None:
        """Notes the parts of which one stays whole within k edits. A swap on a
        border breaks two parts; what it makes is guarded for the k - 1 others."""
        if not k:
            self.swapped.add(term)
            return
        cuts = [len(term) * i // (k + 1) for i in range(k + 2)]
        for parts, part in ((self.prefixes, term[: cuts[1]]), (self.suffixes, term[cuts[-2] :]), *((self.middles, term[a:b]) for a, b in zip(cuts[1:-2], cuts[2:-1]))):
            parts[part] = parts.get(part, 0) | lengths
        for b in cuts[1:-1]:
            self._guard(term[: b - 1] + term[b] + term[b - 1] + term[b + 1 :], k - 1, lengths)

    def may_match(self, word: str) -> bool:
        """False only if no term can be near."""
        p, s, m = self.spans
        size = len(word)
        return (
            word in self.swapped
            or any(self.prefixes.get(word[:n], 0) >> size & 1 for n in p)
            or any(self.suffixes.get(word[-n:], 0) >> size & 1 for n in s)
            or any(self.middles.get(word[i : i + n], 0) >> size & 1 for n in m for i in range(1, size - n))
        )

    def match(self, word: str) -> tuple[str, int] | None:
        """The term with the fewest edits, within its tolerance; of equals the first in order."""
        if word in self.weights:
            return word, 0
        if not 3 <= len(word) <= self.longest or word in self.ordinary or not self.may_match(word):
            return None
        best: tuple[int, str] | None = None
        stack = [(self.root, list(range(len(word) + 1)), None, "")]
        while stack:
            node, row, before, last = stack.pop()
            for ch, child in node.items():
                if ch == "":
                    if _near_enough(child, word, row[-1]) and (best is None or (row[-1], child) < best):
                        best = (row[-1], child)
                    continue
                new = [row[0] + 1]
                for j, w in enumerate(word):
                    v = row[j] if w == ch else 1 + min(row[j], row[j + 1], new[j])
                    if before is not None and j and w == last and word[j - 1] == ch:
                        v = min(v, before[j - 1] + 1)  # an adjacent swap
                    new.append(v)
                # a swap may still come back from the row before
                if min(new) <= self.most or min(row) < self.most:
                    stack.append((child, new, row, ch))
        return (best[1], best[0]) if best else None

    def hits(self, words: set[str]) -> dict[str, tuple[str, int]]:
        """The matches of all of ``words`` that match."""
        new = words - self._seen
        if len(self._seen) + len(new) > CACHED_WORDS:
            self._seen, self._hits, new = set(), {}, words
        for w in new:
            if (m := self.match(w)) is not None:
                self._hits[w] = m
        self._seen |= new
        return {w: self._hits[w] for w in self._hits.keys() & words} if len(self._hits) < len(words) else {w: self._hits[w] for w in words if w in self._hits}


@dataclass
class ToxicityModel:
    terms: dict[str, float] = field(default_factory=dict)
    ordinary: frozenset[str] = frozenset()
    context: dict[str, float] = field(default_factory=lambda: dict(PRIOR_CONTEXT))
    base: float = BASE
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    bias: float = -5.0
    version: str = field(default_factory=lambda: uuid.uuid4().hex)

    def lexicon(self) -> Lexicon:
        return Lexicon(self.terms, self.ordinary)


def window(text: str, spans: list[tuple[int, int]], words: list[str], i: int) -> set[str]:
    """The features around word i: the words, and quotation marks on both sides."""
    lo, hi = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
    out = {*words[lo:i], *words[i + 1 : hi]}
    before, after = text[spans[lo][0] : spans[i][0]], text[spans[i][1] : spans[hi - 1][1] + 1]
    if lo:
        before = text[spans[lo - 1][1] : spans[lo][0]] + before
    elif spans[0][0]:
        before = text[max(0, spans[0][0] - 1) : spans[0][0]] + before
    if _QUOTES.search(before) and _QUOTES.search(after):
        out.add(QUOTE_MARKS)
    return out


def quotation(features: set[str], context: dict[str, float], base: float) -> float:
    """The probability that a hit in such a window is quotation."""
    x = base + math.fsum(sorted(context[f] for f in features if f in context))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def found_in(texts: list[str], lexicon: Lexicon) -> Iterator[tuple[int, str, str, int, set[str]]]:
    """For each hit: the text's number, the word, its term, the edits, its window."""
    lowered = [t.lower() for t in texts]
    split = [_WORD.findall(t) for t in lowered]
    kinds = [set(ws) for ws in split]
    known = lexicon.hits(set().union(*kinds))
    for n, (text, words, kind) in enumerate(zip(lowered, split, kinds)):
        if known and not known.keys().isdisjoint(kind):
            spans = [m.span() for m in _WORD.finditer(text)]
            for i, w in enumerate(words):
                if w in known:
                    yield n, w, *known[w], window(text, spans, words, i)


def exposures(texts: list[str], lexicon: Lexicon, model: ToxicityModel | None = None) -> tuple[np.ndarray, list[list[dict]]]:
    """For each text the logarithms of its exact, misspelt and quoted exposure; its hits.
    Without a model the prior tells quotation, and a hit is wholly quoted or not."""
    context, base = (model.context, model.base) if model else (PRIOR_CONTEXT, BASE)
    out, every = np.zeros((len(texts), 3)), [[] for _ in texts]
    for n, word, term, distance, features in found_in(texts, lexicon):
        quoted = quotation(features, context, base)
        if model is None:
            quoted = float(quoted > 0.5)
        weight = lexicon.weights[term] / (1 + distance)
        out[n, 1 if distance else 0] += weight * (1 - quoted)
        out[n, 2] += weight * quoted
        every[n].append({"term": term, "word": word, "distance": distance, "quoted": quoted})
    return np.log1p(out), every


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = PER_LABEL) -> ToxicityModel:
    """The lexicon and context weights by counts on the executors; three weights on the driver."""
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(learnable() & F.col("y").isin(0, 1))
    sample = bounded_sample(rated, "doc_id", "y", per_label)
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("y", "text"), "labelled")  # bounded by per_label

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            seen = {(y, w, p) for y, t in zip(batch.column(0).to_pylist(), texts) for ws in [_WORD.findall(t.lower())] for p, w in zip(["", *ws], ws)}
            ys, ws, ps = zip(*seen) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(ws, pa.string()), pa.array(ps, pa.string())], names=["y", "word", "prior"])

    pairs = rows.mapInArrow(contexts, "y int, word string, prior string").distinct()
    counts = staged(pairs.groupBy("word").agg(F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("good")), "contexts")
    total = counts.agg(F.sum("bad"), F.sum("good")).first()
    n_bad, n_good = total[0] or 0, total[1] or 0
    share = [r for r in rows.groupBy("y").count().collect()]
    by_label = {r[0]: r[1] for r in share}
    if not n_bad or not n_good:
        p = by_label.get(1, 0) / max(1, sum(by_label.values()))
        return ToxicityModel(bias=float(np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))))
    rate = n_bad / (n_bad + n_good)
    n = F.col("bad") + F.col("good")
    ratio = F.col("bad") * F.log(F.col("bad") / (n * rate)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - rate)))).otherwise(0.0)
    odds = F.log((F.col("bad") + 0.5) / rate) - F.log((F.col("good") + 0.5) / (1 - rate))
    chosen = counts.filter((F.col("bad") >= LEAST_CONTEXTS) & (F.col("bad") > 4 * F.col("good")) & (ratio >= LEAST_RATIO)).select("word", F.least(odds, F.lit(6.0)).alias("weight"))
    terms = {r[0]: r[1] for r in chosen.orderBy("word").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # bounded by the sample

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for batch in batches:
            words = [w for w in batch.column(0).to_pylist() if w not in lexicon.weights and lexicon.match(w)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])

    # words near a term that good text has about as often as toxic text; the sample bounds them
    common = counts.filter((F.col("good") > 0) & (odds <= math.log(2)))
    ordinary = frozenset(r[0] for r in common.select("word").mapInArrow(near, "word string").collect())
    model = ToxicityModel(terms, ordinary)
    model.context, model.base = _context(rows, model)
    seen = rows.mapInArrow(_exposure_rows(docs, model), "y int, a double, b double, c double").toPandas()
    model.weights, model.bias = _logistic(seen[["a", "b", "c"]].to_numpy(), seen["y"].to_numpy())
    return model


def _context(rows: DataFrame, model: ToxicityModel) -> tuple[dict[str, float], float]:
    """Weights of the windows' features and the base. A window counts once for
    each label, however many copies of a text have it."""
    shared = rows.sparkSession.sparkContext.broadcast((model.terms, model.ordinary))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*shared.value)
        for batch, texts in chunks(batches):
            ys = batch.column(0).to_pylist()
            seen = {(ys[n], term, tuple(sorted(features))) for n, _, term, _, features in found_in(texts, lexicon)}
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in seen], pa.int32()), pa.array([s[1] for s in seen], pa.string()), pa.array([list(s[2]) for s in seen], pa.list_(pa.string()))], names=["y", "term", "features"])

    hits = staged(rows.mapInArrow(windows, "y int, term string, features array<string>").distinct(), "windows")
    good, bad = (hits.filter(F.col("y") == y).count() for y in (0, 1))
    each = hits.select("y", F.explode("features").alias("feature")).groupBy("feature").agg(F.count_if(F.col("y") == 0).alias("good"), F.count_if(F.col("y") == 1).alias("bad"))
    counted = {r[0]: (r[1], r[2]) for r in each.filter((F.col("good") + F.col("bad") >= LEAST_HITS) | F.col("feature").isin(*PRIOR_CONTEXT)).collect()}
    return context_weights(counted, good, bad)


def context_weights(counted: dict[str, tuple[int, int]], good: int, bad: int) -> tuple[dict[str, float], float]:
    """Log odds of a feature between good and bad hits, drawn to the prior's."""
    out = dict(PRIOR_CONTEXT)
    for f, (g, b) in counted.items():
        share = (g + b) / (good + bad)
        learned = math.log((g + CONTEXT_PULL * share) / (good + CONTEXT_PULL)) - math.log((b + CONTEXT_PULL * share) / (bad + CONTEXT_PULL))
        weight = learned + PRIOR_CONTEXT.get(f, 0.0) * CONTEXT_PULL / (CONTEXT_PULL + min(g + b, good))
        if weight:
            out[f] = weight
    return out, min(0.0, max(BASE, math.log((good + 1) / (bad + 1))))


def _exposure_rows(docs: DataFrame, model: ToxicityModel):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value.lexicon()
        for batch, texts in chunks(batches):
            x, _ = exposures(texts, lexicon, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(3))], names=["y", "a", "b", "c"])

    return run


#: What misspelt and quoted exposure count against exact exposure where the
#: sample says nothing else.
PRIOR = np.array([1.0, 0.8, 0.1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[tuple[float, ...], float]:
    """Newton's method. The weights of misspelt and quoted exposure are drawn
    towards their share of the exact one's, so that a sample without such hits
    doesn't set them to nothing; none is negative."""
    order = np.lexsort((*x.T, y))
    x, y = np.column_stack([x @ PRIOR, x[:, 1:], np.ones(len(x))])[order], y[order]
    w = np.zeros(4)
    keep = np.array([ridge, ridge, ridge, 1e-4]) * len(x) / 100
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + keep * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
        w = w - np.linalg.solve(h, g)
        w[0] = max(w[0], 0)
    each = np.maximum(w[0] * PRIOR + np.array([0.0, w[1], w[2]]), 0)
    return tuple(each.tolist()), float(w[3])


def probability(x: np.ndarray, model: ToxicityModel) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights) + model.bias, -30, 30)))


_lexicons: dict[str, Lexicon] = {}


def score(docs: DataFrame, model: ToxicityModel, with_hits: bool = True) -> DataFrame:
    """doc_id, score and, if asked for, the hits of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m.version not in _lexicons:  # one model at a time in a worker
            _lexicons.clear()
            _lexicons[m.version] = m.lexicon()
        for batch, texts in chunks(batches):
            x, hits = exposures(texts, _lexicons[m.version], m)
            cols, names = [batch.column(0), pa.array(probability(x, m))], ["doc_id", "score"]
            if with_hits:
                cols.append(pa.array(hits, pa.list_(pa.struct([("term", pa.string()), ("word", pa.string()), ("distance", pa.int32()), ("quoted", pa.float64())]))))
                names.append("hits")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES if with_hits else SCORES.rpartition(", hits")[0])


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score(docs, fit(docs, labels), with_hits=False)
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"))
