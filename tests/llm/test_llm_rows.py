"""Which rows stay, and exact versions of what the operators find by shortcuts."""

import collections
import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenstack.llm import bloom, common, exact_dedup, langid, licenses, minhash, toxicity
from lumenstack.sources import scratch

DIR = "/root/testdata/sf0.01"


def words(r, n):
    return ["".join(r.choices("abcdefghij", k=6)) for _ in range(n)]


def test_rows_that_repeat_an_id_are_judged_by_their_text(spark):
    r = random.Random(3)
    a, b = words(r, 100), words(r, 100)
    near = [*a[:-1], "other"]
    rows = [(1, " ".join(a), "x"), (2, " ".join(near), "drop"), (2, " ".join(b), "stay"), (2, " ".join(b), "stay"), (None, " ".join(a), "none"), (None, " ".join(a), "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string").withColumn("__in", F.lit(1))
    got = collections.Counter((x.doc_id, x["__key"]) for x in minhash.first_of_each(docs, 0.8).collect())
    assert got == {(1, "x"): 1, (2, "stay"): 1, (None, "none"): 2}
    assert minhash.first_of_each(docs).columns == docs.columns
    kept = collections.Counter((x.doc_id, x.kept) for x in minhash.near_duplicates(docs, 0.8).collect())
    assert kept == {(1, True): 1, (2, False): 1, (2, True): 2, (None, True): 2}
    assert minhash.first_of_each(docs.filter("false")).count() == 0


def test_exact_dedup_keeps_columns_of_any_name(spark):
    names = ["__id", "__sha", "__keep", "__candidate", "__key", "__in", "__block", "__bits", "__k0", "__k0r", "kept", "times"]
    rows = [(i, f"text {i % 3}", *(f"{n}{i}" for n in names)) for i in range(6)] + [(5, "text 2", *(f"{n}9" for n in names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = sorted(map(tuple, exact_dedup.without_copies(docs).collect()))
    assert got[:2] == sorted(map(tuple, rows[3:5])) and len(got) == 3 and got[2] in map(tuple, rows[5:])


def test_exact_dedup_of_equal_lengths_and_prefixes(spark):
    long = "x" * 600
    rows = [(1, long + "a"), (2, long + "b"), (3, long + "a"), (4, None), (5, ""), (None, long + "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in exact_dedup.without_copies(docs).collect()) == [2, 3, 5]
    assert sorted((x.doc_id or 0, x.keep_id, x.kept) for x in exact_dedup.digest(docs).collect()) == [(0, 2, False), (1, 3, False), (2, 2, True), (3, 3, True), (4, 5, False), (5, 5, True)]


@pytest.mark.parametrize(("blocks", "levels"), [(1 << 15, 6), (1, 2), (1, 1)])
def test_removal_is_exact_even_where_filters_are_full(spark, monkeypatch, blocks, levels):
    monkeypatch.setattr(bloom, "MOST_BLOCKS", blocks)
    monkeypatch.setattr(bloom, "LEVELS", levels)
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).union(spark.range(3).select("id", F.lit("t")))
    decided = common.staged(docs.groupBy(F.col("doc_id").alias("k0")).agg(F.bool_and(F.col("doc_id") % 3 != 1).alias("kept"), F.count("*").alias("times")), "decided")
    got = [x.doc_id for x in bloom.without(docs, lambda df: [F.col("doc_id")], decided).collect()]
    assert sorted(got) == [i for i in range(30_000) if i % 3 != 1]


def test_filters_miss_no_key(spark):
    keys = common.staged(spark.range(0, 40_000, 2).select(F.xxhash64("id").alias("h")), "keys")
    held = bloom.Bloom.of(keys, F.col("h")).flagged(spark.range(40_000), F.xxhash64("id"), "held")
    n = {x.even: x.n for x in held.filter("held").groupBy((F.col("id") % 2 == 0).alias("even")).agg(F.count("*").alias("n")).collect()}
    assert n[True] == 20_000 and n.get(False, 0) < 200
    assert bloom.Bloom.of(keys.filter("false"), F.col("h")).flagged(spark.range(5), F.col("id"), "held").filter("held").count() == 0


def test_open_buckets_are_compared_whole(spark, monkeypatch):
    """Families whose members share a passage but aren't near, and pairs inside them that are."""
    from test_llm_units import brute_sets

    monkeypatch.setattr(minhash, "GROUP", 4)
    r = random.Random(12)
    rows = []
    for family in range(3):
        shared = words(r, 80)
        for member in range(25):
            own = words(r, 18)
            rows.append((len(rows), " ".join(shared + own)))
            if member % 8 == 0:
                rows.append((len(rows), " ".join([*shared, *own[:-1], "z"])))
    sets = {i: brute_sets(t) for i, t in rows}
    home = {i: i for i in sets}
    for i, j in itertools.combinations(sets, 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((home[i], home[j]))
            home = {k: a if v == b else v for k, v in home.items()}
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == home and 60 < len(set(home.values())) < len(rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")
def test_recall_of_near_duplicates_on_the_tables(spark):
    """Every row whose id is divisible by 50 against all rows."""
    docs = common.table(spark, DIR, "documents")
    texts = {x.doc_id: x.text or "" for x in docs.select("doc_id", "text").collect()}
    sets = dict(zip(texts, minhash.shingle_sets(list(texts.values()))))
    home = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs).collect()}
    links = found = 0
    for i in (i for i in sets if i % 50 == 0 and len(sets[i])):
        for j in sets:
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True)) if i != j and len(sets[j]) else 0
            if shared and 100 * shared >= 85 * (len(sets[i]) + len(sets[j]) - shared):
                links += 1
                found += home[i] == home[j]
    assert links > 0 and found == links


def test_two_permutations():
    x = np.random.default_rng(0).integers(0, 1 << 32, 100_000, dtype=np.uint32)
    for p in (minhash._scatter, minhash._rank):
        assert len(np.unique(p(np.arange(1 << 16, dtype=np.uint32)))) == 1 << 16
    a, b = minhash._scatter(x.copy()), minhash._rank(x.copy())
    assert (a != b).all() or (a != b).mean() > 0.999
    assert abs(np.corrcoef(a.astype(float), b.astype(float))[0, 1]) < 0.02


def test_marks_reject_few_links():
    rng = np.random.default_rng(7)
    link = minhash.similarity(0.85)
    base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for k in range(40):
        a, b = np.sort(base[k : k + 920]), np.sort(base[k + 75 : k + 995])  # 845 / 995
        m = minhash.four_bits(minhash.signatures([a, b], minhash.FINE_COORDINATES)).view(np.uint64)
        assert minhash._fours_apart(m[:1] ^ m[1:])[0] <= link.marks_apart
    assert minhash.similarity(0.8).marks_apart > link.marks_apart


def test_chunks_are_bounded():
    texts = ["a" * 10, None, "", "é" * 30, "b" * 500, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"])
    got = list(common.chunks(iter([batch.slice(0, 0), batch, batch.slice(3)]), "text", 64))
    assert [t for _, part in got for t in part] == [t or "" for t in [*texts, *texts[3:]]]
    assert all(b.num_rows == len(t) for b, t in got) and [len(t) for _, t in got] == [4, 1, 1, 2, 1]


def test_scratch_is_cleared(spark, monkeypatch):
    df = scratch.staged(spark.range(3), "gone")
    path = scratch._written[-1][1]
    folder = path.removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(folder)
    monkeypatch.setattr(scratch, "_written", [x for x in scratch._written if x[1] == path])
    assert scratch.clear_scratch(spark) == 1 and not os.path.isdir(folder)


# language


def brute_path(scores, switch):
    value, back = scores[0].astype(float), []
    for row in scores[1:]:
        top = value.argmax()
        stay = value >= value[top] - switch
        back.append(np.where(stay, np.arange(len(value)), top))
        value = np.where(stay, value, value[top] - switch) + row
    label = value.argmax()
    out = [label]
    for b in reversed(back):
        label = b[label]
        out.append(label)
    return out[::-1]


@pytest.mark.parametrize("languages", [2, 127, 128, 200, 300])
def test_viterbi_of_many_languages(languages):
    scores = (np.random.default_rng(languages).normal(size=(300, languages)) * 8).astype(np.float32)
    first = np.array([0, 120, 120, 121, 300])
    path = langid.viterbi(scores, first).tolist()
    assert path == [*brute_path(scores[:120], langid.SWITCH), *brute_path(scores[120:121], langid.SWITCH), *brute_path(scores[121:], langid.SWITCH)]


def test_spans_are_character_offsets():
    scripts = np.zeros((2, 13), bool)
    scripts[0, 0] = scripts[1, 2] = True
    model = langid.LanguageModel(["aa", "bb"], np.zeros((langid.BUCKETS, 2), np.float32), scripts)
    texts = ["hello wörld привет мир", "", "12 3", "«é» a"]
    names, score, spans = langid.label_texts(texts, model, True)
    assert names[1:] == ["und", "und", "aa"]
    assert [(texts[0][s["start"] : s["end"]], s["lang"]) for s in spans[0]] == [("hello wörld ", "aa"), ("привет мир", "bb")]
    assert spans[1] == spans[2] == [] and spans[3][-1]["end"] == len(texts[3]) and score[1] == 0


# toxicity


def edits(a, b):
    """Edits, with adjacent swaps as one."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def brute_match(word, terms, ordinary=()):
    if word in terms:
        return word, 0
    if word in ordinary:
        return None
    near = [(n, t) for t in terms if toxicity.tolerance(t) and (n := edits(t, word)) <= toxicity.tolerance(t) and (len(t) > 4 or t[0] == word[:1])]
    return (min(near)[1], min(near)[0]) if near else None


def test_lexicon_equals_brute_force():
    r = random.Random(6)
    terms = {"scum", "idiot", "stupid", "blockhead", "disgustingly", "abcdefghijklmnop", "abcd", "aabb", "no", "x" * 70}
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 1.0), frozenset({"stupor"}))
    tried = {"idoit", "stuipd", "scmu", "scam", "cum", "scums", "csum", "ono", "x" * 69, "x" * 71, "x" * 72, "x" * 73, "stupor", "", "a" * 300}
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(r.randint(1, 3)):
                i = r.randrange(len(w) + 1)
                kind = r.randrange(4)
                if kind == 0:
                    w.insert(i, r.choice("abxsu"))
                elif kind == 1 and w:
                    del w[min(i, len(w) - 1)]
                elif kind == 2 and w:
                    w[min(i, len(w) - 1)] = r.choice("abxsu")
                elif i + 1 < len(w):
                    w[i], w[i + 1] = w[i + 1], w[i]
            tried.add("".join(w))
    for w in sorted(tried):
        assert lexicon.match(w) == brute_match(w, terms, {"stupor"}), w
    assert lexicon.match("idoit") == ("idiot", 1) and lexicon.match("stuipd") == ("stupid", 1) and lexicon.match("scam") == ("scum", 1)


def test_scores_equal_brute_force(spark):
    model = toxicity.ToxicityModel({"scum": 2.0, "idiot": 3.0}, frozenset({"scam"}), weights=(2.0, 1.5, 0.2), bias=-3.0)
    texts = [None, "", "you idiot", 'she said "idiot" there', "an idoit and scum and scam", "clean words", "idiot " * 50, "z" * 50_000 + " scum"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(rows, model).collect()}
    for i, t in enumerate(texts):
        ws = toxicity._WORD.findall((t or "").lower())
        x = [0.0, 0.0, 0.0]
        for k, w in enumerate(ws):
            hit = brute_match(w, model.terms, model.ordinary)
            if hit:
                around = set(ws[max(0, k - 5) : k] + ws[k + 1 : k + 6]) | ({'"'} if '"idiot"' in (t or "") else set())
                q = 1 / (1 + np.exp(-(model.base + sum(model.context.get(f, 0.0) for f in around))))
                x[1 if hit[1] else 0] += model.terms[hit[0]] / (1 + hit[1]) * (1 - q)
                x[2] += model.terms[hit[0]] / (1 + hit[1]) * q
        want = 1 / (1 + np.exp(-(np.dot(np.log1p(x), model.weights) + model.bias)))
        assert got[i].score == pytest.approx(want, abs=1e-9), t
    assert got[2].score > got[3].score > got[5].score == got[0].score


def test_context_weights():
    weights, base = toxicity.context_weights({"fable": (40, 10), "you": (5, 300), "wrote": (0, 3)}, 100, 1000)
    assert weights["fable"] > 1 and weights["you"] < -1 and weights["wrote"] > 0 and toxicity.BASE <= base <= 0
    assert toxicity.context_weights({}, 0, 0) == (toxicity.PRIOR_CONTEXT, 0.0)
    assert toxicity.quotation({'"'}, weights, base) > 0.5 > toxicity.quotation({"you", '"'}, weights, base)


def test_words_of_good_text_are_ordinary_by_rate(spark):
    r = random.Random(9)
    common_ = [a + b + c for a in ("ral", "ben", "gat", "dev") for b in ("oma", "eta", "iru", "usa") for c in ("k", "l", "p", "v", "y")]
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        ws = [r.choice(common_) for _ in range(20)]
        if bad:
            ws[5] = "nitwit"
        if bad and i % 2 == 0 or i == 1:
            ws[9] = "nitwid"  # a misspelling, once in good text
        if i % 4 == 1:
            ws[12] = "nitwig"  # as often in either
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "nitwit" in model.terms and "nitwig" in model.ordinary and "nitwid" not in model.ordinary


# licences


def test_license_ties_and_long_texts(spark):
    known = {"B": "one two three four five", "A": "one two three four six"}
    rows = [(1, "one two three four seven"), (2, "x " * 60_000 + "\n one two three four five"), (3, None), (4, ""), (5, "one")]
    got = {(r.doc_id, r.unit): (r.license_id, r.dice) for r in licenses.matches(spark.createDataFrame(rows, "doc_id long, text string"), known, 0.7).collect()}
    assert got[1, 1] == ("A", 0.75) and got[2, 2] == ("B", 1.0) and {d for d, _ in got} == {1, 2}


def test_licence_texts_left_before_normalisation(spark):
    every = licenses.TEMPLATES | licenses.FULL_TEXTS
    forms = [str, str.upper, str.title, lambda t: t.replace(" ", "\n"), lambda t: f"\u0130\u0131\u212a {t}\U0001f600", lambda t: t.replace("i", "I").replace(" ", "\u00e9")]
    found = [f(t) for t in every.values() for f in forms]
    left = ["", "the mit, under the sun", "a license of 2 years", "transmitted under the lens", "free and into the open", "all rights"]
    rows = spark.createDataFrame([(t, True) for t in found] + [(t, False) for t in left], "text string, want boolean")
    rows = rows.withColumn("low", F.lower("text"))
    got = rows.select("text", "want", licenses._may_match("low", every, licenses.LEAST).alias("got")).collect()
    assert [r.text for r in got if r.want != r.got] == []
    texts = rows.select(F.monotonically_increasing_id().alias("doc_id"), "text")
    assert licenses.matches(texts).select("doc_id").distinct().count() == len(found)


def test_license_normalisation(spark):
    odd = ["é A--B\n\nC\0d", "😀x😀😀Y", "a\tb\r\nc", "ÀZ１2", "", "  a  b "]
    rows = spark.createDataFrame([(t,) for t in odd], "text string")
    want = F.regexp_replace(F.translate("text", licenses.UPPER, licenses.LOWER), "[^a-z0-9\n]+", " ")
    assert all(a == b for a, b in rows.select(licenses._plain("text"), want).collect())


# the pipeline


@pytest.fixture
def tables(spark, tmp_path):
    def write(docs, labels):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_of_an_empty_table(spark, tables):
    import corpus_pipeline as p

    folder = tables(spark.createDataFrame([], KINDS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert p.run(spark, folder).count() == 0


def test_pipeline_end_to_end(spark, tables):
    import corpus_pipeline as p
    from test_llm_spark import labelled

    d, labels = labelled(spark)
    rows = [(r.doc_id, r.text, r.lang, "s", len(r.text)) for r in d.collect()]
    good = next(r for r in rows if r[0] % 5)
    near = good[1].rsplit(" ", 1)[0] + " ending"
    rows += [(1000, good[1], "en", "s", 1), (1001, None, None, None, None), (1002, "12 34", "en", "s", 5), (1003, near, "en", "s", 5)]
    folder = tables(spark.createDataFrame(rows, KINDS), labels)
    out = p.run(spark, folder).collect()
    stay = {r.doc_id for r in out}
    assert {1001, 1002, good[0]}.isdisjoint(stay) and 1000 in stay
    bad = {r.doc_id for r in labels.collect() if r.quality == 0}
    assert bad.isdisjoint(stay) and len(stay) > 250
    by = collections.defaultdict(int)
    for r in out:
        assert len(r.ids) == r.length
        by[r.doc_id] += r.length
    assert all(by[r.doc_id] == r.doc_tokens for r in out)
