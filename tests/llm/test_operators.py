"""Small cases of the training-data operators: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns, and brute-force twins."""

import base64
import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ohmflow.llm import (arrays, chat_format, classifier, decontam, html_diff, lm, minhash, packing,
                         pii, quality_rules, warc)

DOCS = "doc_id long, text string, kept string, text2 string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def words(text, n=60, salt="w"):
    return " ".join(f"{salt}{text}{k}" for k in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, [(1, words("a")), (2, words("a")), (2, words("a")), (3, None), (4, ""),
                           (None, words("a")), (5, words("a", 59) + " other"),
                           (6, "one two"), (7, "One TWO"), (8, "long " * 30_000), (9, words("b"))])


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_near_duplicates(spark, odd, none):
    got = {(r.doc_id, r.n_shingles): r for r in minhash.near_duplicates(odd).collect()}
    assert minhash.near_duplicates(odd).count() == 11
    assert got[(2, 56)].component_id == 1 and not got[(2, 56)].kept
    assert got[(5, 56)].component_id == 1
    assert got[(3, 0)].kept and got[(4, 0)].component_id == 4
    assert got[(7, 1)].component_id == 6
    assert got[(None, 56)].component_id is None and got[(None, 56)].kept
    assert got[(8, 1)].kept and got[(9, 56)].kept
    assert minhash.near_duplicates(none).collect() == []


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [f"v{k}" for k in range(150)]
    rows = []
    for i in range(120):
        t = list(base) if i % 2 else [f"u{i // 20}-{k}" for k in range(120)]
        for k in rng.integers(0, len(t), rng.integers(0, 9)):
            t[k] = f"e{i}-{k}"
        rows.append((i, " ".join(t)))
    sets = {i: frozenset(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {i: root(i) for i in sets}


def test_quality_rules(spark, odd, none):
    lab = labels(spark, [(1, 1, 0), (9, 1, 0), (2, 0, 0), (None, 1, 0), (77, 1, 0)])
    rows = quality_rules.quality_rules(odd, lab).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 11 and by[3].n_words == 0 and by[3].base_failed and not by[3].kept
    assert by[8].n_words == 30_000 == by[8].n_repeat_words and by[8].base_failed
    assert not by[1].base_failed and by[1].word_chars == sum(map(len, words("a").split()))
    assert quality_rules.quality_rules(none, lab).collect() == []
    assert all(r.llr == 0 for r in quality_rules.quality_rules(odd, lab.limit(0)).collect())
    kept = quality_rules.keep_documents(odd, lab)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {
        r.doc_id for r in rows if r.kept}


def test_base_counts_equal_brute_force():
    texts = ["a b c a b c\n \na b c\r\nx # é", "é é é é", "", "one", "p q\np q\n\np q\n"]
    got = quality_rules.base_counts(quality_rules.words(pa.array(texts), quality_rules.SPACED))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        n = Counter(tri)
        cover = {k + d for k, g in enumerate(tri) if n[g] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert [int(v[i]) for v in got.values()] == [
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)),
            len(lines) - len(set(lines)), len(cover)]


def test_junk_scores_below_clean(spark):
    rows = [(i, " ".join(f"good{(i * 7 + k) % 90}" for k in range(80))) for i in range(40)]
    rows += [(100 + i, " ".join(f"JUNK{(i + k) % 90}!!" for k in range(80))) for i in range(6)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(
        docs_of(spark, rows), labels(spark, [(i, 1, 0) for i in range(20)]), buckets=256).collect()}
    assert all(got[i] for i in range(40)) and not any(got[100 + i] for i in range(6))


def test_junk_and_hidden_labels_at_production_parameters(spark):
    rows = [(i, " ".join(f"good{(i * 7 + k * (1, 7, 11)[i % 3]) % 90}" for k in range(80))
             + " " + words(f"own{i}", 60)) for i in range(60)]
    rows += [(100 + i, " ".join(f"JUNK{(i * 7 + k) % 90}!!" for k in range(80))) for i in range(6)]
    for shown in (60, 20):      # of 60 good documents
        lab = labels(spark, [(i, 1, 0) for i in range(shown)] + [(100, 0, 0)])
        got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs_of(spark, rows), lab).collect()}
        assert all(got[i] for i in range(60)) and not any(got[100 + i] for i in range(6))


@pytest.mark.parametrize("shown", [1, 10])
def test_unlabelled_documents_are_judged_like_labelled_ones(spark, shown):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where(f"doc_id % {shown} = 0")
    got = quality_rules.quality_rules(docs, lab).where("not base_failed")
    marked = lab.where("quality = 1").select("doc_id")
    for part in (got.join(marked, "doc_id"), got.join(marked, "doc_id", "left_anti")):
        # 8 percent of the documents that pass the base rules are junk
        assert part.where("not kept").count() <= 0.1 * part.count()


def test_decontaminate(spark, odd, none):
    bench = spark.createDataFrame(
        [(1, "One two"), (2, words("a", 12)), (3, None), (4, "..."), (None, "one two"),
         (5, words("a", 12))], "item_id long, text string")
    rows = decontam.decontaminate(odd, bench).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 11 and by[6].item_ids == [1] and by[6].n_hit == 2 == by[7].n_hit
    assert by[1].item_ids == [2, 5] and by[1].n_hit == 12 and by[3].n_words == 0
    assert by[8].n_hit == 0 and by[None].item_ids == [2, 5]
    assert decontam.decontaminate(none, bench).collect() == []
    assert all(r.n_hit == 0 for r in decontam.decontaminate(odd, bench.limit(0)).collect())
    blocks = decontam.search(decontam.build_index(odd), decontam.item_windows(bench), block_terms=5)
    assert {tuple(r.item_ids) for r in blocks.collect()} <= {(1,), (2,) * 3, (5,) * 3, (2, 5) * 3}


def test_proximity(spark):
    docs = docs_of(spark, [(1, "x a q q b y"), (2, "a q q q q q q b"), (3, "b a")])
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    near = decontam.decontaminate(docs, bench, slop=3).collect()
    assert {r.doc_id for r in near if r.n_hit} == {1, 3}


def test_packing(spark, odd, none):
    rows = packing.pack(odd, sizes=(64, 256, 1024)).collect()
    spans, used = {}, Counter()
    for r in rows:
        used[r.bin_id] += r.n_tokens
        spans.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    assert sum(n for _, n in spans[8]) == 30_001 and spans[3] == [(0, 1)]
    assert all(used[r.bin_id] == r.bin_used <= r.bin_size for r in rows)
    assert all(r.bin_size == min(s for s in (64, 256, 1024) if s >= r.bin_used) for r in rows)
    assert packing.pack(none).collect() == []
    lengths = sorted(np.random.default_rng(1).integers(1, 900, 3000).tolist(), reverse=True)
    bins, final = packing.pack_shard(lengths, (512, 1024, 2048))
    assert sum(lengths) / sum(final) > 0.97 and len(bins) == 3000


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/é\r\n", "<p>x</p>", "q"), (2, None, "<p>x</p>", "q"), (2, None, "<p>x</p>", "q"),
         (3, "http://b/", None, "q"), (4, "", "", "q"), (None, "http://c/", "<p>x</p>", "q"),
         (5, "http://d/", "ä\r\n\r\nWARC/1.1\r\n" * 40_000, "q")],
        "page_id long, url string, html string, payload string")
    rows = warc.archive_pages(pages, archive_bytes=1000).collect()
    assert len(rows) == 7
    for r in rows:
        want = {1: "<p>x</p>", 2: "<p>x</p>", None: "<p>x</p>", 5: "ä\r\n\r\nWARC/1.1\r\n" * 40_000
                }.get(r.page_id, "").encode()
        assert r.payload_bytes == len(want)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(want).digest()).decode()
        assert r.payload in (None, want)
    kind = {r.page_id: (r.record_type, r.refers_to) for r in rows}
    assert kind[1] == ("revisit", 2) and kind[2] == ("response", None) == kind[4]
    assert kind[3] == ("revisit", 4) and kind[None] == ("response", None)
    assert warc.archive_pages(pages.limit(0)).collect() == []


def test_pii(spark, none):
    rows = [(1, "card 4111111111111111 and 4111 1111 1111 1111."), (2, "4111111111111111, 4111111111111112"),
            (3, None), (4, ""), (5, "on 2024-02-30 or 2024-02-29 from 10.0.0.256 and 10.0.0.25."),
            (6, "call +1 (017) 555-7713 or mail a.b@mail7.example.com now"), (7, "x" * 100_000)]
    out = pii.pseudonymise(docs_of(spark, rows), "k")
    by = {r.doc_id: r for r in out.collect()}
    assert by[3].text is None and by[4].text == "" and by[7].text == "x" * 100_000
    a, b = re.findall(r"\d{16}", by[2].text)
    assert b == "4111111111111112" and a != "4111111111111111" and a in by[1].text
    assert " ".join(a[k:k + 4] for k in range(0, 16, 4)) + "." in by[1].text and by[1].pii_card == 2
    assert "2024-02-30" in by[5].text and "10.0.0.256" in by[5].text and by[5].pii_date == 1
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or mail u\w{12}@mail7.example.com now", by[6].text)
    assert by[6].kept == "x" and pii.pseudonymise(none, "k").collect() == []


def test_feistel_is_a_permutation(spark):
    n = spark.range(1000).selectExpr("id", "lpad(cast(id as string), 3, '0') as d")
    f = pii.F
    got = n.select(pii.permuted_digits(f.col("d"), "k", f.lit("t")).alias("p"))
    assert got.distinct().count() == 1000 and got.where("length(p) = 3").count() == 1000


def test_html_lines():
    page = ('<header><p>Site</p></header><div class="cookie-notice">c</div><article><h1>T &amp; U</h1>'
            "<p>One <b>two</b>\n three<p>Four<br>five<ul><li>a<li>b</ul><form>f</form>"
            "<script>if(a<b){'</p>'}</script><aside>s</aside></article><p>open</p><footer>z")
    assert html_diff.lines_of(page) == [
        ("T & U", False), ("One two three", False), ("Four five", False), ("a", False), ("b", False),
        ("open", True)]
    assert html_diff.lines_of("") == []


def test_html_differencing(spark):
    def page(k, body):
        return f"<body><div><p>Menu here</p></div><p>{body}</p><p>Call us</p></body>"
    pages = spark.createDataFrame(
        [(1, "http://h/a/1", page(1, "first")), (2, "http://h/a/2?x", page(2, "second")),
         (3, "http://h/a/2#y", page(2, "second")), (4, "http://lone/", page(4, "alone")),
         (5, None, page(5, "nowhere")), (6, "http://h/z", None)],
        "page_id long, url string, html string").selectExpr("*", "'t' as text")
    got = {r.page_id: r.text for r in html_diff.extract(pages).collect()}
    assert got[1] == "first" and got[2] == "second" == got[3]
    assert got[4] == "Menu here\nalone\nCall us" and got[5] == "Menu here\nnowhere\nCall us"
    assert got[6] == "" and html_diff.extract(pages.limit(0)).collect() == []


def test_common_lines_is_a_longest_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(0, 12)).tolist() for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        kept = sorted(html_diff.common_lines(a, b))
        rest = iter(b)
        assert len(kept) == best[-1, -1] and all(any(a[k] == y for y in rest) for k in kept)


def test_language_model(spark, odd, none):
    f = lm.F
    rows = lm.score_texts(odd, f.col("doc_id") == 9).collect()
    tok = [(r.doc_id, r.n_tokens) for r in rows]
    assert len(rows) == 11 and (3, 1) in tok and (8, 30_001) in tok
    texts = {i: [w.lower() for w in (t or "").split()] + [None] for i, t, _, _ in odd.collect()}
    every = [(i, [w.lower() for w in (t or "").split()] + [None]) for i, t, _, _ in odd.collect()]
    n = Counter(w for i, t in every if i != 9 for w in t)
    total, types = sum(n.values()), len(n)
    for r in rows:
        t = texts[r.doc_id]
        assert r.train_tokens == total and r.n_known == sum(n[w] > 0 for w in t)
        assert abs(r.base_score - sum(np.log10((n[w] + 1) / (total + types + 1)) for w in t)) < 1e-6 * len(t)
        assert r.held_out == (r.doc_id == 9)
    assert lm.score_texts(none, f.col("doc_id") == 9).collect() == []
    untaught = lm.score_texts(odd, f.lit(True)).collect()
    assert all(r.score == r.base_score or r.doc_id is None for r in untaught)


def test_model_sums_to_one(spark):
    f = lm.F
    rows = docs_of(spark, [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 40))) for i in range(1, 30)])
    docs = rows.select("doc_id", "text").withColumn("held_out", f.lit(False))
    counts = lm.token_counts(docs)
    model, _ = lm.fit(counts, lambda a, b: lm.encode(docs, a, b), classes=4)
    c = model.class_of[model.units]
    emitted = np.maximum(model.counts - model.discount, 0) / 10 ** model.log_mass[c]
    for k in range(4):
        known = (10 ** model.log_next[k][c] * emitted).sum()
        if 10 ** model.log_unknown[k] > 1e-200 and model.counts.sum() == model.total:
            assert abs(known + 10 ** model.log_unknown[k] - 1) < 1e-9


def test_text_ends_have_a_unit_whatever_their_count(spark):
    f = lm.F
    docs = docs_of(spark, [(1, " ".join(f"x{k % 900}" for k in range(1800)))]).select(
        "doc_id", "text", f.lit(False).alias("held_out"))
    model, _ = lm.fit(lm.token_counts(docs), lambda a, b: lm.encode(docs, a, b), classes=4)
    at = np.searchsorted(model.frequent, lm.END)
    assert model.frequent[at] == lm.END and model.counts[at] == 1


def test_exchange_separates_two_word_kinds():
    pairs = np.zeros((6, 6))
    pairs[:3, 3:] = 10      # a word of one kind always follows one of the other
    pairs[3:, :3] = 10
    cls = lm.exchange(pairs, classes=2)
    assert len(set(cls[:3])) == 1 == len(set(cls[3:])) and cls[0] != cls[3]
    # no single move raises the likelihood
    pairs = np.random.default_rng(0).integers(0, 30, (12, 12)).astype(float)

    def likelihood(c):
        grid = np.eye(3)[c].T @ pairs @ np.eye(3)[c]
        return lm._f(grid).sum() - lm._f(grid.sum(1)).sum() - lm._f(grid.sum(0)).sum()
    cls = lm.exchange(pairs, classes=3)
    for u in range(12):
        for k in range(3):
            assert likelihood(np.array([*cls[:u], k, *cls[u + 1:]])) <= likelihood(cls) + 1e-6


def test_best_classes_raise_the_likelihood_most():
    rng = np.random.default_rng(3)
    grid = rng.integers(2000, 9000, (4, 4)).astype(float)
    left, right = (rng.multinomial(6, [0.25] * 4, 5).astype(float) for _ in range(2))
    home = rng.integers(0, 4, 5)

    def likelihood(word, b):
        g = grid.copy()
        for c, sign in ((home[word], -1), (b, 1)):
            g[c] += sign * right[word]
            g[:, c] += sign * left[word]
        return lm._f(g).sum() - lm._f(g.sum(1)).sum() - lm._f(g.sum(0)).sum()
    best = lm.best_classes(grid, home, left, right)
    for word, b in enumerate(best):
        assert likelihood(word, b) >= max(likelihood(word, k) for k in range(4)) - 0.01


def test_words_beyond_the_frequent_ones_get_their_own_class(spark):
    rng = np.random.default_rng(0)
    # kinds alternate, all words end alike, and each is about as frequent as any other
    rows = [(i, " ".join(f"{'ab'[k % 2]}{rng.integers(1200)}zzz" for k in range(200))) for i in range(1, 140)]
    f = lm.F
    got = lm.score_texts(docs_of(spark, rows), f.col("doc_id") > 130).where("held_out").agg(
        (f.sum("score") / f.sum("n_tokens")).alias("s")).first()
    assert got.s > -3.3     # the unigram base: -3.40


def test_classifier(spark, odd, none):
    lab = labels(spark, [])
    assert {round(r.score, 6) for r in classifier.classify(odd, lab).collect()} == {0.5}
    rows = [(i, " ".join(f"g{(i * k + k) % 50}" for k in range(60))) for i in range(160)]
    rows += [(1000 + i, " ".join([f"r{i % 9}"] * 60)) for i in range(80)]
    lab = labels(spark, [(i, int(i < 1000), 0) for i, _ in rows] + [(None, 1, 0), (1, None, 0)])
    got = classifier.classify(docs_of(spark, rows), lab).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == (r.doc_id < 1000) for r in held]) > 0.95
    assert classifier.classify(none, lab).collect() == []


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [("c", "3", 5, "f", '{"b":1,"a":"é"}', "2"), ("c", "2", 3, "f", "{", "1"), ("c", "1", 1, "f", None, None),
         ("c", "1", 1, "f", None, None), ("c", "x", 7, "g", "{}", "y"), ("c", "y", 8, "f", '{"b":true}', "x"),
         (None, "1", 1, "f", "{}", None)],
        "conv_id string, call_id string, seq long, name string, arguments string, parent string")
    results = spark.createDataFrame([("c", "1", 2, None), ("c", "9", 4, "late"), ("c", "3", 5, "r")],
                                    "conv_id string, call_id string, seq long, content string")
    schema = {"f": {"type": "object", "properties": {"b": {"type": "integer"}}}}
    by = {r.call_id: r for r in chat_format.link_calls(calls, results, schema).collect()}
    assert [by[k].depth for k in ("1", "2", "3", "x", "y")] == [0, 1, 2, None, None]
    assert [by[k].position for k in ("1", "2", "3")] == [0, 1, 2]
    assert by["9"].status == "no_call" and by["3"].status == "early_result" and by["3"].valid
    assert by["1"].errors == ["repeated"] and by["2"].errors == ["arguments are not JSON"]
    assert "cycle" in by["x"].errors and "$.b: not of type integer" in by["y"].errors
    assert by["3"].record == ('{"arguments":{"a":"é","b":1},"id":"3","name":"f","result":"r",'
                              '"status":"early_result"}')
    assert json.loads(by["2"].record)["result"] is None
    assert chat_format.link_calls(calls.limit(0), results.limit(0), schema).collect() == []


def test_word_hashes_need_little_memory_and_keep_none():
    """Blocks do not change a hash, whatever its place; no table as long as the text stays."""
    import tracemalloc
    size = 6 << 20
    text = pa.array(["alpha beta gamma " * (size // 17)])
    tracemalloc.start()
    w = arrays.words(text, arrays.SPACED)
    peak = tracemalloc.get_traced_memory()[1]
    assert len(set(w.hash.tolist())) == 3
    assert w.hash[:3].tolist() == arrays.words(pa.array(["", "alpha beta gamma"]),
                                               arrays.SPACED).hash.tolist()
    del w
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert peak < 26 * size and kept < size // 4
