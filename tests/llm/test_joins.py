"""Line dedup, the Jaccard join, decontamination and mixing, each against a plain version."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrograph.llm import decontaminate, grams, jaccard, linededup, mixing

WORDS = [a + b for a in "ka lo mi ne pu ra si to vu ze".split() for b in "ba do fi gu ha je ki le mo nu pa ri so ta ve wo xi ya zu".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


def word_sets(text, n):
    w = re.findall(r"[0-9a-z]+", (text or "").lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def all_pairs(docs, n, t):
    sets = {}
    for k, text in docs:
        if k is not None:
            sets.setdefault(k, []).append(word_sets(text, n))
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        best = max((len(x & y) / len(x | y) for x in sets[a] for y in sets[b] if x and y), default=0)
        if best >= t - 1e-9:
            out[a, b] = round(best, 6)
    return out


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(3)
    docs = []
    for k in range(60):
        base = prose(rng, rng.choice([1, 2, 3, 6, 20, 64, 130, 400]))
        docs.append(base)
        docs += [edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06, 0.1, 0.3])) for _ in range(rng.choice([0, 1, 4, 12]))]
        if k % 6 == 0:
            docs.append(base + " " + prose(rng, len(base.split()) // 4))
    docs += [None, "", "...", docs[0], docs[5]]
    rng.shuffle(docs)
    return list(enumerate(docs)) + [(None, docs[0]), (7, docs[3]), (7, docs[3])]


@pytest.mark.parametrize("n,t", [(2, 0.75), (1, 0.5), (3, 0.9), (2, 1.0)])
def test_join_is_exact(spark, copies, n, t):
    got = jaccard.similar_pairs(spark.createDataFrame(copies, "doc_id long, text string"), n=n, t=t).collect()
    assert {(r.doc_a, r.doc_b): r.jaccard for r in got} == all_pairs(copies, n, t) and len(got) == len({r[:2] for r in got})


def test_large_regions_are_divided_exactly(spark):
    rng = random.Random(9)
    bases = [prose(rng, 80) for _ in range(3)]
    docs = [(k, edited(rng, bases[k % 3], rng.choice([0.01, 0.05, 0.2]))) for k in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard.similar_pairs(df, t=0.7, max_region=12).collect()
    assert {(r.doc_a, r.doc_b): r.jaccard for r in got} == all_pairs(docs, 2, 0.7)


def test_recursion_in_a_region_is_exact():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = rng.choice(10_000, 90, replace=False).astype(np.uint64)
        sets += [np.unique(np.concatenate([rng.permutation(base)[: 90 - k], rng.choice(10_000, k).astype(np.uint64)])) for k in rng.integers(0, 30, 25)]
    own = jaccard.Region(np.arange(len(sets)), sets)
    x, y, _ = own.pairs(0.8)
    got = set(zip(x.tolist(), y.tolist()))
    plain = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9}
    assert got == plain and len(plain) > 100


def test_one_of_each_group_stays(spark, copies):
    df = spark.createDataFrame([(*r, "x") for r in copies], "doc_id long, text string, gone string")
    pairs, up = all_pairs(copies, 2, jaccard.THRESHOLD), {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(k for k, _ in copies if k is not None and find(k) == k)
    assert kept.filter("doc_id IS NULL").count() == 1


def test_pipeline_takes_one_of_near_copies_below_the_join(spark):
    import corpus_pipeline

    rng = random.Random(5)
    docs = []
    for k in range(12):
        words = prose(rng, 250).split()
        docs.append((k, " ".join(words)))
        for at in range(5, 245, 12):  # 20 edits in 250 words
            words[at] = "changed"
        docs.append((100 + k, " ".join(words)))
    near = all_pairs(docs, 2, 0.6)
    assert len(near) == 12 and max(near.values()) < 0.75
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == set(range(12))


def test_unlike_documents_are_no_candidates():
    """Documents that only share common words meet others in fewer elements than similar ones do, also where there are many."""
    rng = np.random.default_rng(6)
    names = np.array([f"w{k}" for k in range(20_000)])
    texts = [" ".join(names[np.where(rng.random(150) < 0.5, rng.integers(0, 40, 150), rng.integers(40, 20_000, 150))]) for _ in range(12_000)]
    data, off = grams.text_bytes(pa.array(texts))
    own = jaccard.Sets(data, off)
    counts = np.bincount((own.flat >> np.uint64(64 - jaccard.RANK_BITS)).astype(np.int64), minlength=1 << jaccard.RANK_BITS)
    rank = np.round(1000 * np.log2(1 + counts)).astype(np.uint64)
    e, doc = jaccard.elements(own, np.arange(len(texts)), rank, 0.6)
    _, at, times = np.unique(e, return_inverse=True, return_counts=True)
    met = np.bincount(doc[times[at] > 1], minlength=len(texts))
    assert (met >= jaccard.least_needed(jaccard.scaled(own.size), 0.6)).mean() < 0.05


def test_pipeline_forms_no_regions_of_unlike_documents(spark):
    import corpus_pipeline

    rng = np.random.default_rng(7)
    names = np.array([f"w{k}" for k in range(20_000)])
    texts = [" ".join(names[np.where(rng.random(150) < 0.5, rng.integers(0, 40, 150), rng.integers(40, 20_000, 150))]) for _ in range(6_000)]
    own = jaccard.Sets(*grams.text_bytes(pa.array(texts)))
    counts = np.bincount((own.flat >> np.uint64(64 - jaccard.RANK_BITS)).astype(np.int64), minlength=1 << jaccard.RANK_BITS)
    rank, t = np.round(1000 * np.log2(1 + counts)).astype(np.uint64), corpus_pipeline.NEAR
    docs = spark.createDataFrame([(x,) for x in texts], "text string")
    found = jaccard.regions(jaccard.star_rows(jaccard.bucket_rows(docs, rank, 4, 2, t), 4, t), 4, t)
    assert found.count() < 0.05 * len(texts)


def test_many_unlike_documents_form_no_regions(spark):
    """Documents that share many elements with others, but few with the same one, as those of large tables do."""
    rng = np.random.default_rng(11)
    names = np.array([f"w{k}" for k in range(5_000)])
    texts = [" ".join(names[np.where(rng.random(150) < 0.7, rng.integers(0, 6, 150), rng.integers(6, 5_000, 150))]) for _ in range(4_000)]
    texts += [text.replace(" w3 ", " three ", 2) for text in texts[:20]]
    own = jaccard.Sets(*grams.text_bytes(pa.array(texts)))
    counts = np.bincount((own.flat >> np.uint64(64 - jaccard.RANK_BITS)).astype(np.int64), minlength=1 << jaccard.RANK_BITS)
    rank = np.round(1000 * np.log2(1 + counts)).astype(np.uint64)
    e, doc = jaccard.elements(own, np.arange(len(texts)), rank, 0.6)
    _, at, times = np.unique(e, return_inverse=True, return_counts=True)
    met = np.bincount(doc[times[at] > 1], minlength=len(texts))
    assert (met >= jaccard.least_needed(jaccard.scaled(own.size), 0.6)).mean() > 0.9
    docs = spark.createDataFrame([(x,) for x in texts], "text string")
    found = jaccard.regions(jaccard.star_rows(jaccard.bucket_rows(docs, rank, 4, 2, 0.6), 4, 0.6), 4, 0.6)
    several = found.distinct().groupBy("region").agg(F.collect_set("short").alias("of")).filter(F.size("of") > 1).collect()
    short = jaccard.shorts(own.keys).tolist()
    changed = [(a, b) for a, b in zip(short[:20], short[4_000:], strict=True) if a != b]
    assert len(changed) > 10 and all(any({a, b} <= set(r["of"]) for r in several) for a, b in changed)
    assert found.count() < 0.05 * len(texts)


@pytest.mark.parametrize("t", [0.55, 0.6, 0.75])
def test_similar_documents_are_in_a_region_together(spark, t):
    """Also where some of their elements are in buckets of few, some in buckets of many, and third documents hold both kinds."""
    rng = random.Random(13)
    texts = []
    for size in (2, 3, 7, 8, 9, 10, 20):
        for n in (8, 20, 27, 60, 150):
            base, other = prose(rng, n), prose(rng, n)
            for _ in range(size):
                at = rng.randint(0, n)  # a run from the other one, and an end that may be cut
                words = base.split()[:at] + other.split()[at : at + n // 6] + base.split()[at + n // 6 :]
                texts.append(edited(rng, " ".join(words[: rng.randint(int(0.85 * n), n)]), rng.choice([0, 0.02, 0.08])))
    own = jaccard.Sets(*grams.text_bytes(pa.array(texts)))
    counts = np.bincount((own.flat >> np.uint64(64 - jaccard.RANK_BITS)).astype(np.int64), minlength=1 << jaccard.RANK_BITS)
    rank = np.round(1000 * np.log2(1 + counts)).astype(np.uint64)
    docs = spark.createDataFrame([(x,) for x in texts], "text string")
    found = jaccard.regions(jaccard.star_rows(jaccard.bucket_rows(docs, rank, 8, 2, t), 8, t), 8, t).collect()
    of = {}
    for r in found:
        of.setdefault(r["short"], set()).add(r["region"])
    short, similar = jaccard.shorts(own.keys).tolist(), all_pairs(list(enumerate(texts)), 2, t)
    apart = [(a, b) for a, b in similar if short[a] != short[b] and not of.get(short[a], set()) & of.get(short[b], set())]
    assert len(similar) > 50 and not apart


@pytest.mark.parametrize("t", [0.55, 0.6, 0.75, 1.0])
def test_sets_of_any_two_sizes_meet_as_often_as_said(t):
    rng = np.random.default_rng(8)
    rank = rng.integers(0, 50, 1 << jaccard.RANK_BITS).astype(np.uint64)
    for n in [*range(1, 90), 255, 256, 700]:
        for _ in range(4):
            base = rng.integers(1, 2**63, 2 * n + 4, dtype=np.uint64) * np.uint64(2)
            both = int(rng.integers(int(np.ceil(t * n)), n + 1))
            more = rng.integers(0, max(0, int(both / t - 1e-9) - n) + 1)
            x, y = np.unique(base[:n]), np.unique(np.concatenate([base[:both], base[n : n + more]]))
            if len(np.intersect1d(x, y)) < t * len(np.union1d(x, y)) - 1e-9:
                continue
            own = jaccard.Sets(np.zeros(0, np.uint8), np.zeros(1, np.int64))
            own.flat, own.ptr = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
            own.size = np.diff(own.ptr)
            e, doc = jaccard.elements(own, np.array([0, 1]), rank, t)
            assert len(np.intersect1d(e[doc == 0], e[doc == 1])) >= jaccard.least_needed(jaccard.scaled(own.size), t).max()


@pytest.mark.parametrize("t", [0.55, 0.6, 0.75, 0.9, 1.0])
def test_similar_sets_meet_often_enough(t):
    """However similar sets of any sizes differ, their prefixes share as many elements as needed, whatever the ranks."""
    rng = np.random.default_rng(2)
    rank = rng.integers(0, 50, 1 << jaccard.RANK_BITS).astype(np.uint64)
    met = 0
    for n in [*range(1, 40), 130, 255, 256, 700]:
        for _ in range(4):
            base = rng.integers(1, 2**63, 2 * n + 4, dtype=np.uint64) * np.uint64(2)
            both = rng.integers(int(np.ceil(t * n)), n + 1)
            more = int(both / t - 1e-9) - n
            x, y = np.unique(base[:n]), np.unique(np.concatenate([base[:both], base[n : n + max(0, more)]]))
            if len(np.intersect1d(x, y)) < t * len(np.union1d(x, y)) - 1e-9:
                continue
            met += 1
            own = jaccard.Sets(np.zeros(0, np.uint8), np.zeros(1, np.int64))
            own.flat, own.ptr = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
            own.size = np.diff(own.ptr)
            e, doc = jaccard.elements(own, np.array([0, 1]), rank, t)
            assert len(np.intersect1d(e[doc == 0], e[doc == 1])) >= jaccard.needed(np.array([min(len(x), len(y))]), t)[0]
    assert met > 100


def test_classes_against_all_pairs(spark, copies):
    docs = [d for d in copies if d[0] != 7]
    sets = {k: frozenset(word_sets(text, 2)) for k, text in docs if k is not None}
    near = {(a, b) for a, b in all_pairs(docs, 2, 0.6)}
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string").withColumn("KEY", F.lit(1))).collect()
    want = set()
    for k, own in sets.items():
        other = {sets[b if a == k else a] for a, b in near if k in (a, b)} - {own}
        want.add((k, find(k), sum(x == own for x in sets.values()) - 1 if own else 0, len(other)))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_regions_that_cannot_be_divided_are_compared_in_blocks(spark):
    rng = random.Random(19)
    base = prose(rng, 60)
    docs = [(k, edited(rng, base, 0.03)) for k in range(60)]
    got = jaccard.similar_pairs(spark.createDataFrame(docs, "doc_id long, text string"), t=0.6, max_region=10).collect()
    assert {(r.doc_a, r.doc_b): r.jaccard for r in got} == all_pairs(docs, 2, 0.6)


def test_one_very_long_text(spark):
    rng = random.Random(23)
    base, other = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000)) for _ in range(2))
    docs = [(1, base), (2, edited(rng, base, 0.05)), (3, other), (4, prose(rng, 50))]
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}


def test_join_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar_pairs(none).count() == 0 and jaccard.keep_one(none).count() == 0


def plain_templates(lines, lead, similar):
    """Each line against all templates so far."""
    out, pattern = [], []
    for line in sorted(lines, key=lambda x: (-lines[x], x)):
        rest, best, most = line[lead:], -1, -1
        for k, p in enumerate(pattern):
            equal = sum(a == b and b != "<*>" for a, b in zip(rest, p))
            if (equal >= similar * len(rest) - 1e-9 or rest == tuple(p) == ()) and equal > most:
                best, most = k, equal
        if best < 0:
            out.append([line])
            pattern.append(list(rest))
        else:
            out[best].append(line)
            pattern[best] = [a if a == b else "<*>" for a, b in zip(rest, pattern[best])]
    return out


def test_templates_against_plain_matching():
    rng = random.Random(1)
    for n in (4, 7, 12, 30):
        base = [[rng.choice("abcdefgh") for _ in range(n)] for _ in range(6)]
        lines = {}
        for _ in range(120):
            line = list(rng.choice(base))
            for k in range(3, n):
                if rng.random() < 0.12:
                    line[k] = rng.choice(["x", "y", "<*>"])
            line[:3] = ["p", "q", "r"]
            lines[tuple(line)] = lines.get(tuple(line), 0) + 1
        assert linededup.templates(lines, 3, 0.75) == plain_templates(lines, 3, 0.75)


def test_recurring_lines_go_and_one_stays(spark):
    rng = random.Random(2)
    docs = []
    for k in range(30):
        lines = [prose(rng, 14) for _ in range(4)]
        lines.insert(rng.randrange(4), f"Page {k} of 99 printed by the office on day {k}")
        if k % 2:
            lines.append("All rights reserved")
        docs.append((k, "\n".join(lines), "x"))
    docs += [(100 + k, docs[0][1], "copy") for k in range(20)]  # copies of a document are no boilerplate
    docs += [(200, None, "x"), (201, "", "x"), (202, " \n", "x"), (None, "All rights reserved\n" + prose(rng, 9), "x"), (203, "All rights reserved", "x"), (204, "w " * 100_000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, dropped_lines string")
    got = linededup.drop_lines(df).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert by[0].text == docs[0][1] and by[100].text == docs[0][1]
    assert "Page" not in by[3].text and by[3].dropped_lines_ == 2 and "reserved" in by[1].text
    assert by[200].text is None and by[201].text == "" and by[202].text == " \n" and by[203].text == "" and by[204].text == docs[-1][1]
    kept = linededup.drop_lines_and_blank(df)
    assert kept.columns == df.columns and {203}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() == len(docs) - 1
    assert linededup.drop_lines(df.filter("false")).count() == 0


def test_rare_lines_stay(spark):
    rng = random.Random(8)
    docs = [(k, "\n".join([prose(rng, 12), "shared by few of them all"])) for k in range(linededup.MIN_DOCS - 1)]
    assert linededup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).filter("dropped_lines > 0").count() == 0


@pytest.mark.parametrize("n,whole,passage,times", [(10, 120, 60, 1), (10, 150, 100, 1), (20, 130, 100, 1), (12, 150, 60, 2)])
def test_a_passage_does_not_make_its_documents_copies(spark, n, whole, passage, times):
    rng = random.Random(n + passage)
    for _ in range(3):
        shared = prose(rng, passage)
        docs = [(k, "\n".join([prose(rng, whole - passage)] + [shared] * times)) for k in range(n)]
        got = linededup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert sum(shared in r.text for r in got) == 1


def test_edited_copies_are_no_recurrence(spark):
    rng = random.Random(21)
    base = "\n".join(prose(rng, m) for m in (60, 15, 45, 20))
    docs = [(k, "\n".join(edited(rng, line, 0.05) for line in base.split("\n"))) for k in range(40)]
    assert linededup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).filter("dropped_lines > 0").count() == 0


@pytest.mark.parametrize("tokens,n,goes", [(60, 2, True), (40, 2, True), (30, 3, True), (30, 2, False), (20, 4, True), (20, 3, False), (10, 7, False), (10, 8, True)])
def test_long_lines_recur_in_few_documents(spark, tokens, n, goes):
    rng = random.Random(tokens + n)
    shared = prose(rng, tokens)
    docs = [(k, "\n".join([prose(rng, 30), shared, prose(rng, 30)])) for k in range(n)]
    docs += [(100 + k, docs[0][1] + " " + prose(rng, 2)) for k in range(9)]  # near copies add nothing
    got = linededup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(shared in r.text for r in got if r.doc_id < 100) == (1 if goes else n)


def test_lines_are_summed_up_alike_however_they_lie(spark):
    rng = random.Random(33)
    passages = [prose(rng, n) for n in (4, 6, 14, 50)]
    docs = []
    for k in range(400):
        lines = [prose(rng, rng.randint(4, 20)) for _ in range(rng.randint(1, 4))]
        lines += [p for n, p in enumerate(passages) if k % (n + 1) == 0]
        lines.append(f"Item {k} of the list in {prose(rng, 1)} order number {k}")
        rng.shuffle(lines)
        docs.append((k if k % 50 else None, "\n".join(lines)))
    docs += [(1000 + k, docs[1][1]) for k in range(150)] + [(2000 + k, edited(rng, docs[2][1], 0.03)) for k in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one, many = ({(r.doc_id, r.text, r.dropped_lines) for r in linededup.drop_lines(df.repartition(n)).collect()} for n in (1, 13))
    assert one == many
    for p in passages:  # the first copy stays, in the document and its copies
        first = min(k for k, t in docs if k is not None and p in t.split("\n"))
        assert all(k is None or k in (first, *range(1000, 1150)) for k, t, _ in one if p in t.split("\n"))


def distance_within(item, text):
    """Least edits from the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def plain_text(text):
    return re.sub(r"[^0-9a-z]+", " ", (text or "").lower()).strip()


def test_items_are_found_as_by_full_alignment(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, rng.randint(3, 40)).capitalize() + ".") for k in range(25)] + [(90, None), (91, "short"), (92, "")]
    docs = []
    for k in range(120):
        text = prose(rng, rng.randint(1, 80))
        if k % 2:
            own = list(rng.choice(items[:25])[1])
            for _ in range(rng.choice([0, 1, 2, 5, 9, 14])):
                at = rng.randrange(len(own))
                own[at : at + rng.choice([0, 1])] = rng.choice(["", "q", "zz"])
            text = f"{text}, {''.join(own)} - {prose(rng, 5)}"
        docs.append((k, text))
    docs += [(500, None), (501, ""), (502, "!?"), (3, docs[3][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, text in docs:
        for i, item in items:
            x = plain_text(item)
            k = int(decontaminate.EDIT_RATE * len(x) + 1e-9) if len(x) >= decontaminate.EDIT_FROM else 0
            if len(x) >= decontaminate.MIN_ITEM and distance_within(x, plain_text(text)) <= k:
                want.add((d, i))
    got = decontaminate.find_items(df, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 25
    several = decontaminate.find_items(df, bench, max_index_bytes=300)
    assert sorted(several.collect()) == sorted(got.collect())
    clean = decontaminate.drop_contaminated(df, bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d not in {x for x, _ in want})


def test_spans_are_of_the_text_itself():
    text = "Zuvor Ä steht: The QUICK brown fox, jumps over the lazy dog! Danach."
    finder = decontaminate.Finder(decontaminate.index(["the quick brown fox jumps over the lazy dog"]))
    (_, _, a, b, edits), = finder.found(*grams.text_bytes(pa.array([text])))
    assert edits == 0 and text.encode()[a:b].decode() == "The QUICK brown fox, jumps over the lazy dog"


def test_no_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "some text that is here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(docs, none).count() == 0 and decontaminate.drop_contaminated(docs, none).count() == 1
    assert decontaminate.find_items(docs.filter("false"), none).count() == 0


def sources(spark, rng):
    rows = []
    for k in range(400):
        s = rng.choice("aaaaaabbc")
        rows.append((k, prose(rng, int(rng.lognormvariate(3, 1)) + 1), s, rng.choice(["x", "y"] if s != "b" else ["x"]), "old"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, rate string")


def test_rates_meet_the_targets_and_are_the_nearest(spark):
    df = sources(spark, random.Random(4))
    got = mixing.mix(df, {"a": 1, "b": 2, "c": 3}).toPandas()
    assert list(got.columns[:5]) == df.columns and "rate_" in got
    share = (got["rate_"] * got["n_tokens"]).groupby(got["source"]).sum() / got["n_tokens"].sum()
    assert np.allclose(share[["a", "b", "c"]], [1 / 6, 2 / 6, 3 / 6], atol=1e-4)
    lang = (got["rate_"] * got["n_tokens"]).groupby(got["lang"]).sum() / got["n_tokens"].sum()
    assert np.allclose(lang, got["n_tokens"].groupby(got["lang"]).sum() / got["n_tokens"].sum(), atol=1e-4)
    # The nearest: log rates lie in the span of the constraints.
    z = np.log1p(got["n_tokens"])
    design = np.column_stack([got["source"] == s for s in "abc"] + [got["lang"] == "y", z]).astype(float)
    rest = np.log(got["rate_"]) - design @ np.linalg.lstsq(design, np.log(got["rate_"]), rcond=None)[0]
    assert abs(rest).max() < 1e-6
    assert ((got["copies"] - got["rate_"]).abs() < 1).all()
    assert abs((got["copies"] * got["n_tokens"]).sum() / got["n_tokens"].sum() - 1) < 0.1


def test_mixing_of_odd_rows(spark):
    rows = [(1, None, "a", "x"), (2, "", None, None), (3, "w " * 50_000, "a", "x"), (4, "w w", "b", None), (4, "w w", "b", None), (None, "w", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 for r in got)
    twice = [r.copies for r in got if r.doc_id == 4]
    assert twice[0] == twice[1]
    assert all(r.copies > 0 for r in mixing.mix(df, all_rows=False).collect())
    assert mixing.mix(df.filter("false")).count() == 0
    assert all(r.rate == 0 for r in mixing.mix(df, {"a": 1.0}).filter("source = 'b'").collect())
