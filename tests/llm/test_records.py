"""Captures, token counts, preferences, and the pipeline."""

import random

import pytest

from ferrograph.llm import captures, jaccard, preferences, tokencount

WORDS = "the of house 12 don't  été\n\n, x.y ?! a@b.de".split(" ")


def test_every_capture_is_found_again(spark):
    rng = random.Random(1)
    rows = [(k, f"http{'s' * (k % 2)}://{rng.choice(['www', 'A', 'b'])}.ex{k % 5}.org{rng.choice(['', ':80'])}/p{k % 40}?q={k % 3}#f", f"<p>{k} é</p>" * (k % 4)) for k in range(300)]
    rows += [(900, None, "lost"), (901, "http://same.org/", None), (902, "http://same.org/", ""), (902, "http://same.org/", ""), (903, "http://big.org/", "x" * 2_000_000), (None, "odd url", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = captures.build(pages, block=7)  # the same.org captures and others go over block ends
    keyed = pages.select("*", captures.url_key(pages["url"]).alias("key"))
    got = captures.lookup(index, keyed)
    want = keyed.filter("key IS NOT NULL").select("key", "page_id", "url", "html")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert captures.lookup(index, spark.createDataFrame([("zz)/none",), ("",), (None,)], "key string")).count() == 0


def test_many_captures_of_one_key(spark):
    pages = spark.createDataFrame([(k, "http://a.b/c", f"v{k}") for k in range(50)], "page_id long, url string, html string")
    index = captures.build(pages, block=8)
    assert captures.lookup(index, spark.createDataFrame([("b,a)/c",)], "key string")).count() == 50


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert captures.lookup(captures.build(none), spark.createDataFrame([("x",)], "key string")).count() == 0


def test_keys(spark):
    rows = spark.createDataFrame([("https://WWW.Ex.org:8080/a?b=c#d",), ("plain",), ("http://x.y",)], "url string")
    assert [r[0] for r in rows.select(captures.url_key(rows["url"])).collect()] == ["org,ex,www):8080/a?b=c", "plain)", "y,x)"]


def test_counts_after_edits_are_those_of_the_new_text():
    count = lambda piece: 1 + len(piece) // 3
    rng = random.Random(7)
    for _ in range(400):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))
        tree = tokencount.tree(text, count)
        for _ in range(5):
            a = rng.randint(0, len(text) + 2)
            b = a + rng.choice([0, 1, 2, 9])
            new = rng.choice(["", " ", "'", "re", "\n", "xyz 5", "  "])
            text, _ = tree.edit(text, a, b, new, count)
            whole = tokencount.tree(text, count)
            assert (tree.total, tree.length) == (whole.total, len(text))
        back = tokencount.Tree.from_bytes(tree.to_bytes())
        assert (back.total, back.length) == (tree.total, tree.length)


def test_an_edit_encodes_little_again():
    count = lambda piece: 1
    text = "word " * 5000
    tree = tokencount.tree(text, count)
    _, again = tree.edit(text, 12_000, 12_004, "other", count)
    assert again <= 5 and tree.total == len(tokencount.CUT.findall(text[:12_000] + "other" + text[12_004:]))


def test_edit_tables_and_real_tokens(spark):
    tiktoken = pytest.importorskip("tiktoken")
    count = tokencount.counter(tokencount.VOCABULARY)
    docs = spark.createDataFrame([(1, "Call me at +49 170 1234567 or a.b@c.org.", "k"), (2, None, "k"), (3, "", "k"), (4, "x" * 200_000, "k")], "doc_id long, text string, edits string")
    got = {r.doc_id: r for r in tokencount.count_redacted(docs).collect()}
    full = lambda t: sum(map(count, tokencount.CUT.findall(t)))
    assert got[1].edits_ == 2 and got[1].tokens_after == full("Call me at <phone> or <email>.") and got[1].tokens_before == full("Call me at +49 170 1234567 or a.b@c.org.")
    assert (got[2].tokens_before, got[3].tokens_after) == (0, 0)
    edits = spark.createDataFrame([(1, 2, 0, 4, "Ring"), (1, 1, 5, 7, "us"), (2, 1, 0, 0, "new text"), (9, 1, 0, 1, "")], "doc_id long, step int, start int, end int, replacement string")
    got = {r.doc_id: r for r in tokencount.count_edited(docs, edits).collect()}
    assert got[1].tokens_after == full("Ring us at +49 170 1234567 or a.b@c.org.") and got[2].tokens_after == full("new text") and len(got) == 4
    assert tiktoken and tokencount.with_trees(docs).count() == 4 and tokencount.count_redacted(docs.filter("false")).count() == 0


def test_edits_of_stored_trees_encode_little(spark, tmp_path):
    count = tokencount.counter(tokencount.VOCABULARY)
    full = lambda t: sum(map(count, tokencount.CUT.findall(t or "")))
    rng = random.Random(8)
    docs = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 400))), "x") for k in range(60)] + [(100, None, "x"), (101, "", "x"), (102, "w " * 60_000, "x"), (None, "no id", "x"), (5, "again", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, ENCODED_AGAIN string")
    tokencount.with_trees(df).write.parquet(f"{tmp_path}/trees")
    kept = spark.read.parquet(f"{tmp_path}/trees")
    edits = [(k, step, rng.randint(0, 300), rng.randint(0, 320), rng.choice(["", "new words", "'s", None])) for k in [*range(0, 60, 3), 5, 100, 101, 102, 999] for step in range(3)] + [(None, 1, 0, 3, "")]
    got = tokencount.apply_edits(kept, spark.createDataFrame(edits, "doc_id long, step int, start int, end int, replacement string"))
    assert got.columns == [*kept.columns, "encoded_again_"]
    rows = got.collect()
    want = []
    for k, text, _ in docs:
        for _, _, a, b, new in sorted((e for e in edits if e[0] is not None and e[0] == k), key=lambda e: (e[1], e[2], e[3], e[4] or "")):
            text = text or ""
            a = min(a, len(text))
            text = text[:a] + (new or "") + text[max(a, b) :]
        want.append((str(k), text or "", full(text)))
    assert sorted((str(r.doc_id), r.text or "", r.token_count) for r in rows) == sorted(want)
    assert all(tokencount.Tree.from_bytes(r.token_tree).total == r.token_count for r in rows)
    by = {r.doc_id: r[-1] for r in rows}
    assert 0 < by[102] <= 40 and by[1] == 0


def test_redaction_of_long_unbroken_texts_is_quick():
    import time

    import pyarrow as pa

    count = tokencount.counter(tokencount.VOCABULARY)
    for text in ("x" * 1_000_000, "a.b" * 300_000, "1 " * 400_000, "x@" * 300_000, "f" * 20 + "-0" * 300_000):
        began = time.time()
        assert tokencount.may_be_personal(pa.array([text])) and len(tokencount.personal(text)) < 200_000
        assert time.time() - began < 5
    began = time.time()
    assert tokencount.tree("x" * 1_000_000, count).total > 0 and time.time() - began < 5


def test_what_may_be_personal_holds_all_that_is():
    import pyarrow as pa

    rng = random.Random(31)
    parts = ["a@b.de", "é@x.org", "10.0.0.1", "+49 170 1234567", "sk-abcdefghijkl1", "AKIA0123456789AB", "0123456789abcdef" * 2, "٣٤٥٦٧٨٩٠١٢", "1.2", "word", "@", "12"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 3))) for _ in range(500)]
    for text, may in zip(texts, tokencount.may_be_personal(pa.array(texts))):
        assert may or not tokencount.personal(text)


def test_captures_with_ids_of_other_types(spark):
    import datetime
    from decimal import Decimal

    for value, kind in (("a b", "string"), (Decimal("1.50"), "decimal(10,2)"), (datetime.date(2020, 2, 3), "date")):
        pages = spark.createDataFrame([(value, "http://a.b/c", "v", 1), (None, "http://a.b/d", "w", 2)], f"page_id {kind}, url string, html string, KEY int")
        got = captures.lookup(captures.build(pages), spark.createDataFrame([("b,a)/c",), ("b,a)/d",)], "key string")).collect()
        assert {(r.page_id, r.html) for r in got} == {(value, "v"), (None, "w")}


def by_hand(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    show = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)

    def mask(turns):
        at, out = 0, []
        for r, t in turns:
            begin = at + len(f"<|{r}|>\n")
            if r == "assistant":
                out.append(f"{begin}-{begin + len(t) + 7}")
            at = begin + len(t) + 8
        return ",".join(out)

    return n, show(chosen[:n]), show(chosen[n:]), show(rejected[n:]), mask(chosen[n:]), mask(rejected[n:])


def test_pairs_against_plain_rendering(spark):
    rng = random.Random(3)
    turn = lambda: (rng.choice(["user", "assistant", "system"]), rng.choice(["hé", "", "a\nb"]))
    pairs = []
    for k in range(80):
        shared = [turn() for _ in range(rng.randint(0, 4))]
        pairs.append((k, k + 1, shared + [turn() for _ in range(rng.randint(0, 3))], shared + [turn() for _ in range(rng.randint(0, 3))]))
    pairs.append((99, 99, [], []))
    kind = "array<struct<role:string,text:string>>"
    got = preferences.format_pairs(spark.createDataFrame(pairs, f"chosen_id long, rejected_id long, chosen {kind}, rejected {kind}")).collect()
    for r, (a, _, chosen, rejected) in zip(sorted(got), pairs, strict=True):
        assert (r.prompt_turns, r.prompt, r.chosen, r.rejected, r.chosen_mask, r.rejected_mask) == by_hand(chosen, rejected) and r.chosen_id == a
        assert r.usable == bool(r.chosen_mask and r.rejected_mask)


def test_conversations_with_odd_turns(spark):
    rows = [(1, 1, "assistant", "yes", 0), (1, 0, "user", "hi", 0), (1, 0, "user", "hi", 0), (2, 0, None, None, 0), (2, 1, "assistant", "", 0), (None, 0, "assistant", "x", 0), (3, 0, "user", "alone", 0), (4, None, "assistant", "z" * 100_000, 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv int")
    convs = preferences.conversations(turns)
    got = {r.chosen_id: r for r in preferences.format_pairs(preferences.lent_pairs(convs)).collect()}
    assert set(got) == {1, 2, 4} and got[1].rejected_id == 2 and got[4].rejected_id == 1 and got[1].prompt_turns == 2
    assert preferences.format_pairs(preferences.lent_pairs(preferences.conversations(turns.filter("false")))).count() == 0


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    import corpus_pipeline
    from test_joins import all_pairs, edited, plain_text, prose

    rng = random.Random(12)
    docs, labels, leaked = [], [], prose(rng, 30)
    for k in range(60):
        text = "\n".join(prose(rng, 25) for _ in range(4))
        if k % 3 == 0:
            text += "\nbrought to you by the friendly people of the site"
        docs.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, 1, 0))
    docs += [(100 + k, edited(rng, docs[k][1].replace("\n", " "), 0.02), "en", "s1", 1) for k in range(6)] + [(200, docs[7][1], "en", "s0", 1), (201, docs[9][1] + "\n" + leaked, "en", "s0", 1)]
    docs += [(300 + k, " ".join(w.upper() + "$$$" for w in prose(rng, 40).split()), "en", "s2", 1) for k in range(20)] + [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    labels += [(300 + k, 0, 0) for k in range(15)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, leaked)], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now, kept = before, []
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now = spark.createDataFrame(now.collect(), now.schema)
        kept.append({r.doc_id: r.text for r in now.collect()})
    good, lines, single, clean, mixed = kept
    assert set(good) == {d[0] for d in docs} - set(range(300, 320)) - {400, 401}
    assert set(lines) == set(good) and sum("brought to you" in t for t in lines.values()) == 1
    lost = {b for _, b in all_pairs(sorted(lines.items()), 2, jaccard.THRESHOLD)}
    assert set(single) == set(lines) - lost and lost >= {100, 101, 102, 103, 104, 105, 200}
    assert set(clean) == {d for d, t in single.items() if plain_text(leaked) not in plain_text(t)} and 201 not in clean
    assert set(mixed) <= set(clean) and now.columns == [*before.columns, "n_tokens", "rate", "copies"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(mixed)
