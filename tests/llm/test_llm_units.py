"""Parts of the corpus operators without Spark: codecs, signatures, models."""

import re
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenstack.llm import bpe, jpeg, langid, licenses, minhash, pieces, quality, toxicity
from lumenstack.llm.common import tokenizer_file
from lumenstack.llm.media import feature, payload

ODD = ["", " ", "a", " a", "a  b", "a\n b", "x <|endoftext|> y", "héé’s it's 12a", "a  b", "漢字 é 😀", "\x1c a \x1cb", "don't 'll", "a\r\nb \r\n c", "w" * 5000]


def test_byte_level_encoder_equals_the_library():
    enc = bpe.ByteLevelBpe(tokenizer_file("byte_bpe_50k.json"))

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet=st.sampled_from("ab  '\n\t1é漢. "), max_size=30))
    def same(text):
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == enc.library.encode(text, add_special_tokens=False).ids

    same()
    for text in ODD:
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == enc.library.encode(text, add_special_tokens=False).ids


def test_parts_that_come_once_take_no_room(monkeypatch):
    enc = bpe.ByteLevelBpe(tokenizer_file("byte_bpe_50k.json"), 3)
    once = "x " + " ".join(f"{a}{b}q" for a in "abcde" for b in "fghij")
    often = "x " + " ".join(["often", "words,***", "often.\nThe", "12,***"] * 50)
    want = [enc.library.encode(t, add_special_tokens=False).ids for t in (once, often)]
    merged, merge = [], enc.merge
    monkeypatch.setattr(enc, "merge", lambda piece: merged.append(piece) or merge(piece))
    assert [np.frombuffer(enc.encode(t), enc.dtype).tolist() for t in (once, often)] == want
    assert len(enc._parts) == 3
    assert merged.count(" often") <= 2 and merged.count(",***") == 1


def test_ends_of_parts_and_new_letters_equal_the_library():
    enc = bpe.ByteLevelBpe(tokenizer_file("byte_bpe_50k.json"))
    unlike = [c for c in map(chr, range(0x110000)) if not c.isalpha() and enc.letters.match(c)]  # newer than Python's letters
    words = ["it's'll", "'sit", "e\u0301a", "a1b2", "½x", "x½", "x\n\ny", "x\u00a0", "x\u3000\u3000y", "x\u200by.\t", "_a_", "naïve!?'re", "x<|endoftext|>"]
    for text in [f"a {w} {w} {w} b" for w in words] + words + [f"a {c} {c}{c}. x{c}y" for c in unlike[:20]]:
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == enc.library.encode(text, add_special_tokens=False).ids


def test_pieces_equal_the_library():
    m = pieces.PieceModel(tokenizer_file("piece_bpe_32k.model"))
    texts = [*ODD, "▁ ▁a", "a▁b", "    code\n    more", "Shared prefixes: share shared sharing"]
    for text, packed in zip(texts, m.encode_all(texts)):
        ids = list(array("i", packed))
        assert ids == m.library.encode(text)
        assert m.decode(ids) == m.library.decode(ids)

    @settings(max_examples=100, deadline=None)
    @given(st.text(alphabet=st.sampled_from("abtheing é漢\n"), max_size=25))
    def same(text):
        assert list(array("i", m.encode_all([text])[0])) == m.library.encode(text)

    same()


def test_unigram_pieces_are_the_best_sum():
    m = pieces.PieceModel(tokenizer_file("piece_bpe_32k.model"), "unigram")
    for word in ["▁thing", "▁sharing", "▁té", "▁xyzzy"]:
        best = {0: 0.0}
        for i in range(1, len(word) + 1):
            best[i] = max(best[j] + m.score.get(word[j:i], m.unknown_score) for j in range(i) if word[j:i] in m.score or i - j == 1)
        ids = list(array("i", m.segment([word])[word]))
        shown = m.decode(ids)
        assert shown == word[1:]
        known = [m.pieces[i] for i in ids if i not in m.byte_of]
        if len(known) == len(ids):
            assert sum(m.score[p] for p in known) == pytest.approx(best[len(word)])


def test_jpeg_round_trip():
    rng = np.random.default_rng(1)
    sparse = (rng.random(64 * 60) < 0.03).astype(np.uint8)
    files = [bytes(64), bytes(range(256)), rng.integers(0, 256, 3200, dtype=np.uint8).tobytes(), b"a" * 64, sparse.tobytes(), (sparse * 255).tobytes(), b"\x80" * 640]
    for batch in (files, *([f] for f in files)):
        images = jpeg.decode_coefficients(jpeg.encode(batch))
        for data, img in zip(batch, images):
            assert img.error is None
            assert img.coefficients.astype(np.int8).tobytes()[: len(data)] == data
    rgb = [feature(x) for x in jpeg.rgb_tensors(jpeg.decode_coefficients(jpeg.encode(files)))]
    alone = [feature(jpeg.rgb_tensors(jpeg.decode_coefficients(jpeg.encode([f])))[0]) for f in files]
    assert rgb == alone


def test_jpeg_inverse_and_colour():
    blocks = np.zeros((2, 64), np.int64)
    blocks[0, 0], blocks[1, 1] = 80, 40
    x = np.arange(8)
    want = 128 + 40 / 4 / np.sqrt(2) * np.cos((2 * x + 1) * np.pi / 16)
    got = jpeg.samples(blocks).reshape(2, 8, 8)
    assert (got[0] == 138).all() and np.abs(got[1, 0] - want).max() <= 0.51
    rgb = jpeg.to_rgb(np.full((2, 2), 100, np.uint8), np.full((1, 1), 128, np.uint8), np.full((1, 1), 200, np.uint8), 2, 2)
    assert rgb.shape == (2, 2, 3) and rgb[0, 0].tolist() == [201, 49, 100]


def test_jpeg_errors_are_reported():
    good = jpeg.encode([payload("some text " * 50)])[0]
    images = jpeg.decode_coefficients([b"", b"\xff\xd8", good[:60], good, b"GIF89a", good.replace(b"\xff\xc2", b"\xff\xc0")])
    assert [i.error is None for i in images] == [False, False, False, True, False, False]


def brute_sets(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_shingle_sets():
    texts = ["", " \n", "One two", "one TWO", "a b c d e", "a b c d e f", "x\0y z", "É É É É É É", "q " * 50, "ab c d e f g h " * 3]
    sets = minhash.shingle_sets(texts)
    brute = [brute_sets(t) for t in texts]
    assert [len(s) for s in sets] == [len(b) for b in brute]
    for i, a in enumerate(brute):
        for j, b in enumerate(brute):
            assert len(a & b) == len(np.intersect1d(sets[i], sets[j]))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    s = minhash.signatures([np.sort(base[:1000]), np.sort(base[80:1080])], 512)
    assert abs((s[0] == s[1]).mean() - 920 / 1080) < 0.06


def test_similarity_sets_bands_and_bits():
    op6, near = minhash.similarity(0.85), minhash.similarity(0.8)
    assert (op6.bands, op6.most_apart) == (20, 36)
    for least, link in ((0.85, op6), (0.8, near)):
        assert link.numerator / link.denominator == least
        assert (1 - least**minhash.ROWS) ** link.bands <= minhash.MISSED
    assert near.bands > op6.bands and near.most_apart > op6.most_apart
    with pytest.raises(ValueError):
        minhash.similarity(0.2)


def test_language_spans():
    docs = {"en": "the cat and the house with the garden " * 20, "fr": "le chat et la maison avec les jardins " * 20}
    counts = np.zeros((2, langid.BUCKETS))
    for k, text in enumerate(docs.values()):
        counts[k] = np.bincount(langid.LetterWords([text]).bucket, minlength=langid.BUCKETS)
    scripts = np.zeros((2, langid.OTHER + 1), bool)
    scripts[:, 0] = True
    m = langid.LanguageModel(list(docs), np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * langid.BUCKETS)).T.astype(np.float32), scripts)
    mixed = "the cat and the house with the garden le chat et la maison avec les jardins"
    names, score, spans = langid.label_texts(["", "12 !?", mixed, "the house", "дом"], m, True)
    assert names[:2] == ["und", "und"] and names[3] == "en" and names[4] in docs
    assert [s["lang"] for s in spans[2]] == ["en", "fr"] and mixed[spans[2][1]["start"] :].startswith("le chat")
    assert score[0] == 0 and 0.4 < score[2] < 0.7


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(2)
    n = [0, 1, 5, 40, 7]
    scores = rng.normal(0, 6, (sum(n), 3)).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(n)])
    path = langid.viterbi(scores, first, 9.0)
    for lo, hi in zip(first, first[1:]):
        v, total = None, None
        for row in scores[lo:hi].astype(float):
            v = row if v is None else row + np.maximum(v, v.max() - 9.0)
            total = v.max()
        if hi > lo:
            p = path[lo:hi]
            mine = scores[np.arange(lo, hi), p].astype(float).sum() - 9.0 * (np.diff(p) != 0).sum()
            assert mine == pytest.approx(total)


def test_viterbi_takes_two_runs_at_the_price_of_one_switch():
    scores = np.array([[0, -30, -8], [-30, 0, -8]], np.float32)
    assert langid.viterbi(scores, np.array([0, 2]), 10.0).tolist() == [0, 1]
    rng = np.random.default_rng(4)
    n = np.full(400, 4)
    first = np.concatenate([[0], np.cumsum(n)])
    scores = rng.normal(0, 6, (int(n.sum()), 3)).astype(np.float32)
    path = langid.viterbi(scores, first, 9.0)
    for lo, hi in zip(first, first[1:]):
        v = np.zeros(3)
        for row in scores[lo:hi].astype(float):
            v = row + np.maximum(v, v.max() - 9.0)
        p = path[lo:hi]
        assert scores[np.arange(lo, hi), p].astype(float).sum() - 9.0 * (np.diff(p) != 0).sum() == pytest.approx(v.max())


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(0)
    y = np.repeat([0, 1, 2], 60)
    at = [np.array([g, 5 + k % 3], np.int64) for k, g in enumerate(y)]
    share = [np.array([3.0, rng.random()]) for _ in y]
    m = quality._fit_rows(y, at, share, [1, 3, 7], 200)
    assert (np.diff(m.thresholds) > 0).all() and m.weights[0] < m.weights[1] < m.weights[2]
    grade, tail = quality.score_texts(["", "text"], m)
    assert ((grade >= 1) & (grade <= 7)).all() and ((tail >= 0) & (tail <= 1)).all()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeg", min_size=3, max_size=14))
def test_lexicon_equals_brute_force(word):
    terms = ["abc", "abcde", "edcba", "gabbage", "abcdeabcdeab", "deadbeeg"]
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 1.0))
    near = sorted((levenshtein(word, t), t) for t in terms if levenshtein(word, t) <= toxicity.tolerance(t) and (len(word) >= 4 or word == t))
    want = (near[0][1], near[0][0]) if near else None
    assert lexicon.match(word) == want


def test_context_tells_quotation():
    lexicon = toxicity.Lexicon({"moron": 4.0})
    x, hits = toxicity.exposures(["you are a moron", 'the word "moron" was said', "what a m0ron", "fine"], lexicon)
    assert x[0, 0] > 0 and x[1, 2] > 0 and x[1, 0] == 0 and x[2, 1] > 0 and not x[3].any()
    assert hits[1][0]["quoted"] and hits[2][0]["distance"] == 1


def test_context_without_a_model_is_the_prior():
    lexicon = toxicity.Lexicon({"moron": 4.0})
    texts = ["you moron", "moron", 'he called them "moron" in a comment']
    x, hits = toxicity.exposures(texts, lexicon)
    assert [h[0]["quoted"] for h in hits] == [0.0, 0.0, 1.0]
    fitted, soft = toxicity.exposures(texts, lexicon, toxicity.ToxicityModel({"moron": 4.0}))
    assert [h[0]["quoted"] > 0.5 for h in soft] == [False, False, True] and 0 < soft[2][0]["quoted"] < 1
    assert x[2, 0] == 0 < fitted[2, 0]


def test_licence_bounds_lose_nothing():
    for n in range(1, 60):
        lo, hi = licenses._bounds(n, licenses.LEAST)
        for m in range(1, 120):
            if 2 * min(n, m) / (n + m) >= licenses.LEAST:
                assert lo <= m <= hi


def test_licence_anchors_lose_nothing():
    for text in (licenses.TEMPLATES | licenses.FULL_TEXTS).values():
        grams = sorted(licenses.bigrams(text))
        for need in range(1, len(grams) + 1):
            words = licenses.anchors(grams, need)
            assert sum(words.isdisjoint(g.split()) for g in grams) < need


def test_licence_anchor_sets_lose_nothing():
    for text in (licenses.TEMPLATES | licenses.FULL_TEXTS).values():
        grams = sorted(licenses.bigrams(text))
        for need in range(1, len(grams) + 1):
            sets = licenses.anchor_sets(grams, need)
            assert sets and sum(map(len, sets)) == len(set().union(*sets))
            for words in sets:
                assert sum(words.isdisjoint(g.split()) for g in grams) < need
