"""Text kernels, quality, toxicity and languages."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ferrograph.llm import grams, languages, linear, quality, toxicity


def chunk(texts):
    return grams.text_bytes(pa.array(texts, pa.large_string()))


@pytest.fixture(scope="module")
def corpus(spark):
    """Three hundred short texts in two made-up languages, some of them shouted, some abusive."""
    rng = random.Random(5)
    a, b = ([x + y for x in s.split() for y in "ab er in on us el it an".split()] for s in ("the house green tree walks over old stones with", "der baum grün läuft über alte steine mit haus"))
    docs, labels = [], []
    for k in range(300):
        words = [rng.choice(a if k % 2 else b) for _ in range(rng.randint(12, 60))]
        bad, toxic = k % 5 == 0, k % 7 == 0
        if toxic:
            words.insert(3, rng.choice(["idiot", "moron", "scum"]))
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)
        docs.append((k, text, "en" if k % 2 else "de"))
        labels.append((k, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


ODD = [(1, None, "en"), (2, "", "en"), (3, "x" * 300_000 + " end", "en"), (4, "  \n ", None), (None, "the house", "en"), (5, "the house", "en"), (5, "the house", "en")]


def odd(spark):
    rows = [(*r, "kept", 1.5) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, Quality_Keep string, toxic double")


def test_words_are_those_of_a_simple_scan():
    texts = ["Ein Haus, ÉTÉ 2x!", "", "a", "Zwei\nZeilen"]
    h, doc = grams.words(*chunk(texts))
    assert doc.tolist() == [0, 0, 0, 0, 2, 3, 3]
    same, _ = grams.words(*chunk(["zeilen été"]))
    assert h[6] == same[0] and h[2] == same[1]


def test_hashes_do_not_depend_on_the_place():
    one, _ = grams.words(*chunk(["tree stone tree"]))
    two, _ = grams.words(*chunk(["x" * 5000 + " tree"]))
    assert one[0] == one[2] == two[1] != one[1]


def test_word_grams_stay_within_documents():
    h, doc = grams.words(*chunk(["a b c", "c d"]))
    assert grams.word_grams(h, doc, 2)[1].tolist() == [0, 0, 1]


def test_chunks_cover_all_rows():
    column = pa.array(["x" * n for n in (10, 0, 3_000_000, 5, 700)])
    spans = [(lo, hi) for lo, hi, *_ in grams.chunks(column)]
    assert spans[0][0] == 0 and spans[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_fit_separates():
    x = linear.Rows(np.array([0, 1, 2, 3, 4]), np.array([0, 1, 0, 1]), np.ones(4, np.float32))
    w, b = linear.fit(x, np.array([1, 0, 1, 0.0]), np.ones(4), 2)
    assert w[0] + b > 0 > w[1] + b


def test_quality_on_rows_not_fitted(spark, corpus):
    docs, labels = corpus
    model = quality.train(docs.filter("doc_id < 200"), labels)
    got = quality.rate(docs.filter("doc_id >= 200"), model).join(labels, "doc_id").select("quality", "quality_keep").collect()
    assert np.mean([r[0] == r[1] for r in got]) >= 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 200 < kept.count() < 260


def test_quality_of_odd_rows(spark, corpus):
    model = quality.train(*corpus)
    got = quality.rate(odd(spark), model)
    assert got.columns[-1] == "quality_keep_" and got.count() == len(ODD)
    assert {r.doc_id: r.quality_probability for r in got.collect() if r.doc_id in (1, 2)} == {1: 0.0, 2: 0.0}
    same = [r.quality_probability for r in got.filter("doc_id = 5").collect()]
    assert len(set(same)) == 1


def test_quality_without_labels_keeps_what_is_not_empty(spark, corpus):
    none = corpus[1].filter("false")
    assert quality.train(corpus[0], none) is None
    assert quality.keep_good(odd(spark), None).count() == len(ODD) - 2
    assert quality.rate(corpus[0].filter("false"), None).count() == 0


def test_toxicity_on_held_out_labels(spark, corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels.filter("doc_id < 150"))
    got = toxicity.rate(docs, model).select("doc_id", "toxic").collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    hit = [r.toxic for r in got if truth[r.doc_id]]
    false = [r.toxic for r in got if not truth[r.doc_id]]
    assert np.mean(hit) > 0.9 and np.mean(false) < 0.03


def test_label_model_finds_the_good_voter():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.95, y, ~y)
    fair = np.where(rng.random(4000) < 0.8, y, ~y)
    copy = fair.copy()
    v = np.where(np.stack([good, fair, copy, np.where(rng.random(4000) < 0.75, y, ~y)], 1), 2, 1)
    model = toxicity.fit_label_model(v, np.ones(4000), steps=60)
    assert model.parent[2] == 1 or model.parent[1] == 2  # the copy is told apart from a second opinion
    majority = (v == 2).sum(1) > 2
    assert np.mean((model.posterior(v) > 0.5) == y) > max(0.85, np.mean(majority == y))


def test_posteriors_are_those_of_a_plain_product():
    rng = np.random.default_rng(6)
    parent = [-1, 0, 1, 0, -1]
    table = rng.random((5, 2, 3, 3)) + 0.05
    model = toxicity.LabelModel(np.array([0.7, 0.3]), parent, list(range(5)), table / table.sum(3, keepdims=True))
    v = list(itertools.product(range(3), repeat=5))
    want = []
    for votes in v:
        p = list(model.prior)
        for c in range(2):
            for j, vote in enumerate(votes):
                if vote:  # who doesn't vote says nothing
                    p[c] *= model.table[j, c, votes[parent[j]] if parent[j] >= 0 else 0, vote]
        want.append(p[1] / sum(p))
    assert np.allclose(model.posterior(np.array(v)), want)


def test_a_labelled_sample_says_which_class_is_which():
    rng = np.random.default_rng(4)
    y = rng.random(5000) < 0.1
    loud = rng.random(5000) < 0.3  # says nothing about the class, but three voters hear it
    hears = lambda: np.where(loud & (rng.random(5000) < 0.95), 2, 0)
    knows = lambda: np.where(np.where(rng.random(5000) < 0.9, y, False), 2, 0)
    v = np.stack([hears(), hears(), hears(), knows(), knows()], 1)
    model = toxicity.fit_label_model(v, np.ones(5000), seed=(v[:200], y[:200]))
    found = model.posterior(v) > 0.5
    assert np.mean(found[y]) > 0.95 and np.mean(found[~y]) < 0.02


def test_toxicity_against_a_plain_version(spark, corpus):
    """Votes by scans of words, posteriors and scores by loops over documents."""
    docs, labels = corpus
    model = toxicity.train(docs, labels)
    names = model.voters.names
    rows = docs.collect()
    for r in rows[:60]:
        words = re.findall("[0-9a-zA-Z\x80-\U0010ffff]+", r.text)
        yes, no = model.voters.votes(*chunk([r.text]))
        for name, terms in toxicity.ABUSE.items():
            assert bool(int(yes[0]) >> names.index(name) & 1) == any(w.lower() in terms.split() for w in words), name
        letters = "".join(words)
        assert bool(int(yes[0]) >> names.index("shouting") & 1) == (len(letters.encode()) >= 40 and sum(c.isascii() and c.isupper() for c in letters) > 0.6 * len(letters.encode()))
        seen = set()
        for w in words:
            for part in [w.lower().encode()] + [w.lower().encode()[:n] for n in toxicity.HEADS if len(w.encode()) > n]:
                h = grams.span_hash(grams.prefix_sums(np.frombuffer(part, np.uint8)), np.array([0]), np.array([len(part)]))[0]
                seen.add(int((h if part == w.lower().encode() else h ^ np.uint64(len(part))) >> np.uint64(64 - toxicity.BITS)))
        total = model.bias + sum(float(model.weights[f]) for f in seen)
        got = model.scores(*chunk([r.text]))[0]
        assert np.isclose(got, 1 / (1 + np.exp(-total)), atol=1e-5)


def test_quality_against_a_plain_version(corpus):
    """Scores by loops over words, pairs and runs of bytes."""
    texts = [r.text for r in corpus[0].limit(40).collect()] + ["Ünder the the house", "ab", "x"]
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=3 << quality.BITS).astype(np.float32), 0.1, 1.3, -0.2)
    shift = 64 - quality.BITS
    got = quality.scorer(model, 0.35, 0.9)(*chunk(texts))
    for text, p, keep in zip(texts, got[0], got[2]):
        h = [int(x) for x in grams.words(*chunk([text]))[0]]
        parts = [[x >> shift for x in h], [], []]
        for a, b in zip(h, h[1:]):
            pair = int(quality.SAME_PAIR) if a == b else int(grams.mix(np.array([a * grams.BASE + b & 2**64 - 1], np.uint64))[0])
            parts[1].append((pair >> shift) + (1 << quality.BITS))
        raw = text.encode()
        for k in range(len(raw) - quality.CHAR_N + 1):
            g = int(grams.mix(np.array([int.from_bytes(raw[k : k + quality.CHAR_N], "little")], np.uint64))[0])
            parts[2].append((g >> shift) + (2 << quality.BITS))
        total = model.bias + sum(sum(float(model.weights[f]) for f in part) / max(1, len(part)) for part in parts)
        want = 1 / (1 + np.exp(-(model.a * total + model.b)))
        assert np.isclose(p, want, atol=1e-5) and keep == (p >= 0.35 - 1e-6)


def test_label_model_ranks_voters_and_joins_dependent_ones():
    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.2
    wrong = lambda share: np.where(rng.random(20000) < share, ~y, y)
    good, fair, poor, other, last = (wrong(x) for x in (0.05, 0.15, 0.25, 0.1, 0.12))
    copy = np.where(rng.random(20000) < 0.9, poor, wrong(0.25))
    v = np.where(np.stack([good, fair, poor, other, last, copy], 1), 2, 1)
    model = toxicity.fit_label_model(v, np.ones(20000))
    assert model.parent[5] == 2 or model.parent[2] == 5
    assert np.mean((model.posterior(v) > 0.5) == y) > 0.95
    alone = toxicity.tables(v, np.ones(20000), model.posterior(v), [-1] * 6)
    right = toxicity.LabelModel(*alone[:1], [-1] * 6, list(range(6)), alone[1]).accuracy()
    assert right[0] > right[3] > right[1] > right[2]


def test_toxicity_of_odd_rows(spark, corpus):
    model = toxicity.train(*corpus)
    got = toxicity.rate(odd(spark), model)
    assert got.columns[-1] == "toxic_" and got.count() == len(ODD)
    assert [r.toxic_ for r in got.filter("doc_id < 3").collect()] == [False, False]
    assert toxicity.rate(corpus[0].filter("false"), toxicity.train(corpus[0].filter("false"), corpus[1].filter("false"))).count() == 0


def test_disguised_words_count():
    own = toxicity.voters([])
    yes, _ = own.votes(*chunk(["such an 1d10t there", "a nice 10 day"]))
    bit = 1 << own.names.index("disguised")
    assert yes[0] & bit and not yes[1] & bit


def test_languages_and_mixtures(spark, corpus):
    docs, _ = corpus
    names, table = languages.train(docs)
    assert names == ["de", "en"]
    en, de = "theab greener housein walkson overus oldel stonesit withan theer treeab " * 12, "derab alteer baumin läufton überus steineel mitit hausan derer baumab " * 4
    rows = spark.createDataFrame([(1, en), (2, de), (3, en + de), (4, None), (5, "?!"), (6, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in languages.identify(rows, names, table).collect()}
    assert (got[1].languages, got[2].language) == (["en"], "de")
    assert got[3].languages == ["en", "de"] and abs(got[3].shares[0] - 0.75) < 0.06
    assert got[4].languages == got[5].languages == got[6].languages == [] and got[4].language is None


def test_mixture_against_plain_loops():
    rng = np.random.default_rng(2)
    like = rng.normal(-20, 4, (30, 3))
    first, chosen = np.array([0, 12, 30]), np.array([[True, True, False], [True, True, True]])
    share, total = languages.mixture(like, first, chosen)
    for d in range(2):
        p, s = np.exp(like[first[d] : first[d + 1]]), chosen[d] / chosen[d].sum()
        for _ in range(languages.STEPS):
            r = p * s
            s = (r / r.sum(1, keepdims=True)).mean(0)
        assert np.allclose(s, share[d]) and np.isclose(np.log((p * s).sum(1)).sum(), total[d])


def test_languages_of_odd_rows(spark, corpus):
    names, table = languages.train(corpus[0])
    rows = odd(spark).withColumnRenamed("Quality_Keep", "LANGUAGE")
    got = languages.identify(rows, names, table)
    assert got.columns[-4:] == ["language_", "languages", "shares", "segments"] and got.count() == len(ODD)
    assert {r.doc_id: r.languages for r in got.collect() if r.doc_id in (1, 2, 4)} == {1: [], 2: [], 4: []}
    assert languages.identify(rows.filter("false"), *languages.train(corpus[0].filter("false"))).count() == 0


def test_languages_without_labels(spark):
    rows = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert languages.identify(rows, *languages.train(rows)).collect()[0].languages == []
