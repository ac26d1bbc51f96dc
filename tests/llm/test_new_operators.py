"""Conversation repair, token counts and the Merkle manifest: brute-force twins
and odd rows."""

import hashlib
import random
import zlib
from itertools import product

import pytest

from ohmflow.llm import merkle, repair, token_counts

TALK = "conv_id long, turn long, role string, text string, key string, part string"


# ---- conversation repair ----------------------------------------------------

def cheapest(rows):
    """(cost, audit, kept roles) of the least repair, by trying every edit in every
    state breadth-first over (rows done, state)."""
    best = {(0, 0): (0, "", ())}
    done = {}
    todo = [(0, 0)]
    while todo:
        at, state = todo.pop(0)
        cost, audit, out = best[at, state]
        steps = []
        if at < len(rows):
            initial, fault = rows[at]
            steps.append((at + 1, state, 2, "D", None))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for role, then in (("s", 1), ("u", 2), ("a", 3)):
                    if (role == "s" and state == 0) or (role == "u" and state != 2) or (role == "a" and state == 2):
                        if initial == role:
                            steps.append((at + 1, then, more, "K", role))
                        if role != "s":
                            steps.append((at + 1, then, 1 + more, "R", role))
        steps.append((at, 3 if state == 2 else 2, 5, "I", "a" if state == 2 else "u"))
        for to_at, to, price, edit, role in steps:
            new = (cost + price, audit + edit, out + ((role,) if role else ()))
            if new[0] <= 5 * len(rows) + 10 and ((to_at, to) not in best or new < best[to_at, to]):
                best[to_at, to] = new
                todo.append((to_at, to))
    done = [best[len(rows), s] for s in (0, 3) if (len(rows), s) in best]
    return min(done)


def spelled(rows, edits):
    cost, out = 0, []
    for (initial, fault), (marks, asks) in zip([*rows, ("-", "")], edits):
        for m, ask in zip(marks, asks):
            cost += {"K": 0, "R": 1, "D": 2, "I": 5}[m]
            if m in "KR" and fault == "truncated":
                cost += 5
            if m != "D":
                out.append(initial if m == "K" else ask)
    return cost, "".join(m for m, _ in edits), tuple(out)


KINDS = list(product("sua-", ("", "blank", "truncated", "duplicate")))


def test_repair_equals_brute_force():
    rng = random.Random(5)
    cases = [[], *[[k] for k in KINDS], *[list(p) for p in product(KINDS, repeat=2)]]
    cases += [[rng.choice(KINDS) for _ in range(rng.randint(3, 14))] for _ in range(400)]
    cases += [[(rng.choice("sua-"), "") for _ in range(rng.randint(3, 10))] for _ in range(300)]
    for rows in cases:
        assert spelled(rows, repair.repair_rows(rows)) == cheapest(rows), rows


def test_merged_runs_lead_to_the_same_repair():
    rng = random.Random(6)
    for _ in range(150):
        rows = [rng.choice(KINDS) for _ in range(rng.randint(2, 40))]
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(3))})
        parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        runs = [repair.merged([repair.row_run(*r) for r in p]) for p in parts]
        states = [0, *repair.crossings(runs, 0, None)]
        edits = []
        for k, p in enumerate(parts):
            last = k == len(parts) - 1
            found = repair.repair_rows(p, states[k], None if last else states[k + 1])
            edits += found if last else found[:-1]
        assert spelled(rows, edits) == spelled(rows, repair.repair_rows(rows))


def plain_report(rows):
    """The contract, conversation by conversation in Python."""
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        talks[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, got in talks.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for turn, role, text in got:
            rest = text.rstrip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not rest else "duplicate" if (role, text) in seen
                     else "" if rest[-1] in ".!?" else "truncated")
            seen.add((role, text))
            marked.append((role[:1], fault))
        turns = [t for t, _, _ in got if t is not None]
        cost, audit, roles = cheapest([(i if i and i in "sua" else "-", f) for i, f in marked])
        lines, k, name = [], 0, iter(roles)
        for m in audit:
            now = None if m == "D" else next(name)
            full = {"u": "user", "a": "assistant"}.get(now, now)
            if m == "I":
                lines.append(full + ":")
                continue
            _, role, text = got[k]
            k += 1
            if m != "D":
                lines.append((role if m == "K" else full) + ":" + text)
        pairs = [a + b for (a, _), (b, _) in zip(marked, marked[1:])]
        n = [f for _, f in marked]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n.count("blank"),
                     n.count("duplicate"), n.count("truncated"),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talk_rows():
    rng = random.Random(7)
    rows = []
    for conv in [None, *range(12)]:
        for turn in range(rng.randint(0, 9)):
            rows.append((conv, turn if rng.random() < 0.9 else None,
                         rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
                         rng.choice(["Hello there.", "No end", " ", "", None, "Why? ", "é" * 50 + "!"])))
    rows += [(50, t, "assistant" if t % 2 else "user", f"Line {t % 90}.") for t in range(300)]
    rows += [(51, None, "user", "x" * 200_000 + "."), (52, 3, "user", "Hi."), (52, 3, "user", "Hi.")]
    return rows


@pytest.mark.parametrize("chunk,fan", [(16, 2), (repair.CHUNK, repair.FAN)])
def test_report_equals_the_contract_in_plain_python(spark, chunk, fan):
    rows = talk_rows()
    talks = spark.createDataFrame([(*r, "x", "y") for r in rows], TALK)
    got = repair.report(talks, repair.damage(talks), chunk, fan).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain_report(rows) and len(got) == len({r[0] for r in rows})


def test_repaired_rows_are_valid_and_an_empty_table_gives_none(spark):
    talks = spark.createDataFrame([(*r, "x", "y") for r in talk_rows()], TALK)
    edits, rows = repair.repair(talks)
    assert rows.count() == talks.count()
    for key, got in edits.toPandas().sort_values(["key", "at", "step"]).groupby("key"):
        initials = "".join(r[0] for r in got["role"].dropna())
        body = initials[1:] if initials[:1] == "s" else initials
        assert body == "ua" * (len(body) // 2) and (initials[:1] != "s" or body)
    empty = talks.limit(0)
    assert repair.report(empty, repair.damage(empty)).collect() == []
    assert [d.count() for d in repair.repair(empty)] == [0, 0]


# ---- token counts -----------------------------------------------------------

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_token_counts_of_split_texts_equal_whole_ones():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        whole, split = token_counts._counter("x.json", f.read())
    assert split
    units = token_counts._Units(whole, 1000)
    rng = random.Random(2)
    bits = [*"ab1 \n\t'.!é中", "<|endoftext|>", "'s", "'ll", "  ", " ", "　", "\r\n", "\x1c", "word", " the"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    texts += ["", "a" * 50_000, " " * 5000, "no-space" * 3000, "some words and more of them. " * 5000]
    assert token_counts.count_texts(texts, units, True, 4000, 7) == whole(texts)
    assert token_counts.count_texts(texts, units, True) == whole(texts)
    assert all("".join(token_counts.pieces(t, 7)) == t for t in texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_table(spark, name):
    rows = [(1, "Two words"), (1, "Two words"), (2, None), (3, ""), (None, "x <|endoftext|> y"), (4, "long text " * 40_000)]
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in rows],
                                 "doc_id long, text string, n_tokens int, extra string")
    path = public_tokenizers.path(name)
    out = token_counts.token_counts(docs, path, batch_bytes=5000, piece=100)
    assert out.columns == ["doc_id", "extra", "n_bytes", "n_tokens", "over_limit"]
    with open(path, "rb") as f:
        whole, _ = token_counts._counter(name, f.read())
    want = sorted((str(i), len((t or "").encode()), whole([t or ""])[0], whole([t or ""])[0] > 512) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == want
    assert token_counts.token_counts(docs.limit(0), path).collect() == []


def test_other_tokeniser_files_are_refused():
    with pytest.raises(ValueError):
        token_counts._counter("vocabulary.txt", b"")


# ---- Merkle manifest --------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, siblings of each leaf level by level) by the definition."""
    level, own, width = list(leaves), [[] for _ in leaves], 1
    while len(level) > 1:
        up = []
        for lo in range(0, len(level), 8):
            run = level[lo:lo + 8]
            for k in range(len(run)):
                for i in range((lo + k) * width, min((lo + k + 1) * width, len(leaves))):
                    own[i] += run[:k] + run[k + 1:]
            up.append(h(*run))
        level, width = up, width * 8
    return level[0], own


def plain_manifest(rows):
    def leaf(r):
        doc, source, lang, n, text = r
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        keyed = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = (keyed, *plain_tree([leaf(r) for r in keyed]))
    root, above = plain_tree([trees[g][1] for g in order])
    return sorted((str(r[0]), leaf(r), trees[g][1], root, h(*trees[g][2][k], *above[i]))
                  for i, g in enumerate(order) for k, r in enumerate(trees[g][0]))


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int"


def manifest_rows(sizes):
    rows = []
    for lang, n in sizes:
        rows += [(i, None if i % 7 == 0 else "s", lang, i, None if i % 11 == 0 else f"Tèxt {i}") for i in range(n)]
    return [*rows, (3, "s", sizes[0][0], 3, "other"), (3, "s", sizes[0][0], 3, "other"), (None, None, None, None, None)]


@pytest.mark.parametrize("levels", [1, 2, merkle.BLOCK_LEVELS])
def test_manifest_equals_brute_force(spark, levels):
    from pyspark.sql import functions as F
    # 8 ** 3 and its neighbours, single leaves, short last parts at several levels, many groups
    sizes = [("en", 700), ("fr", 513), ("de", 512), ("", 9), ("x", 1), ("é", 75)] + [(f"g{k}", 2) for k in range(9)]
    rows = manifest_rows(sizes)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], MANIFEST)
    got = merkle.manifest(docs, levels=levels).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("p"),
        merkle.fold(F.col("leaf"), F.col("proof")).alias("folded")).collect()
    assert all(r.folded == r.root for r in got)
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.p) for r in got) == plain_manifest(rows)


def test_manifest_finds_tampering_and_takes_empty_and_single_tables(spark):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(5, "s", "en", 4, "long " * 100_000, "x", 1)], MANIFEST)
    one = merkle.manifest(docs).first()
    assert one.root == one.leaf == one.subroot and one.proof == []
    assert merkle.manifest(docs.limit(0)).collect() == []
    two = docs.unionByName(docs.withColumn("doc_id", F.lit(6).cast("long")))
    bad = merkle.manifest(two, also={"other": F.sha2(F.lit("x"), 256)}).select(
        "root", merkle.fold(F.col("other"), F.col("proof")).alias("folded")).collect()
    assert len(bad) == 2 and all(r.root != r.folded for r in bad)


# ---- language model ---------------------------------------------------------

def plain_scores(train, texts, class_of, discount, prior):
    """log10 probability of each text by the formulas, class by class in Python."""
    from collections import Counter
    from math import log10
    n = Counter(w for t in train for w in [*t, None])
    mass, kinds, grid, out = Counter(), Counter(), Counter(), Counter()
    for w, k in n.items():
        mass[class_of(w)] += k
        kinds[class_of(w)] += 1
    for t in train:
        for a, b in zip([None, *t], [*t, None]):
            grid[class_of(a), class_of(b)] += 1
            out[class_of(a)] += 1
    total = sum(mass.values())

    def follows(a, c):
        return (grid[a, c] + prior * mass[c] / total) / (out[a] + prior)
    scores = []
    for t in texts:
        s = 0.0
        for a, w in zip([None, *t], [*t, None]):
            a, c = class_of(a), class_of(w)
            if n[w]:
                s += log10(follows(a, c) * (n[w] - discount) / mass[c])
            else:
                s += log10(sum(follows(a, k) * discount * kinds[k] / mass[k] for k in mass))
        scores.append(s)
    return scores


@pytest.mark.parametrize("frequent", [None, 12])
def test_language_model_scores_equal_brute_force(spark, monkeypatch, frequent):
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from ohmflow.llm import lm
    if frequent:        # most words are rare ones, which take their classes by request
        monkeypatch.setattr(lm, "WORDS", frequent)
    rng = random.Random(8)
    texts = {i: [f"{rng.choice('abc')}{rng.randint(0, 14)}" for _ in range(rng.randint(0, 40))] for i in range(60)}
    texts[60] = ["never", "seen", "a1", "b2", "words"]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    held = F.col("doc_id") >= 55
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    model, encoded = lm.fit(lm.token_counts(rows.where("not held_out")), lambda f, u: lm.encode(rows, f, u), classes=4)
    every = sorted({w for t in texts.values() for w in t})
    tokens, _ = lm._tokens(lm.words(pa.array([" ".join(every)]), lm.SPACED, lower=True))
    place = lm._lookup(model.frequent, tokens)
    known = {w: int(lm.word_class(model)[p]) for w, p in zip([*every, None], place) if p >= 0}
    by_ending = {w: int(model.class_of[lm.FREQUENT + e]) for w, e in zip(every, lm._ending(tokens))}
    rare = {}
    terms = {r["slice"]: np.frombuffer(r["terms"], np.uint64) for r in encoded.where("kind = 'text'").collect()}
    name = dict(zip(tokens.tolist(), every))
    for r in lm.rare_words(encoded, model, 4).collect():
        rare[name[int(terms[r.part][r.number])]] = r["class"]
    assert bool(rare) and (frequent is None or len(rare) > 20)
    got = {r.doc_id: r.score for r in lm.score_texts(docs, held, classes=4).collect()}
    want = plain_scores([t for i, t in texts.items() if i < 55], texts.values(),
                        lambda w: known[w] if w in known else rare.get(w, by_ending.get(w)),
                        model.discount, lm.PRIOR)
    assert all(abs(got[i] - s) < 1e-6 * max(1, len(texts[i])) for i, s in zip(texts, want))


# ---- repairs of earlier operators ------------------------------------------

def test_tool_arguments_that_are_no_json_are_errors_of_their_row(spark):
    from ohmflow.llm import chat_format
    schemas = {"f": {"type": ["object", "null"], "properties": {"n": {"type": ["integer", "null"]}}}}
    texts = ['{"n": null}', "null", '{"n": true}', '{"n": NaN}', '{"n": 1e400}', "[" * 100_000, '{"n": 3}', None, "3"]
    calls = spark.createDataFrame([(1, f"c{k}", k, "f", t, None) for k, t in enumerate(texts)],
                                  "conv_id long, call_id string, seq long, name string, arguments string, parent string")
    results = spark.createDataFrame([], "conv_id long, call_id string, seq long, content string")
    got = {r.call_id: r for r in chat_format.link_calls(calls, results, schemas).collect()}
    assert [got[f"c{k}"].valid for k in range(9)] == [True, True, False, False, False, False, True, True, False]
    assert got["c3"].errors == ["arguments are not JSON"] == got["c4"].errors == got["c5"].errors
    assert got["c8"].errors == ["$: not of type object or null"]
    with pytest.raises(ValueError):
        chat_format.link_calls(calls, results, {"f": {"properties": {"x": {"items": {"type": "text"}}}}})


def test_long_secrets_are_taken_whole(spark):
    from ohmflow.llm import pii
    docs = spark.createDataFrame([(1, "key " + "0a" * 64 + " end"), (2, "key " + "0a" * 65 + " end"),
                                  (3, "key " + "AF0" * 3000 + " end")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.pseudonymise(docs, "k").collect()}
    assert "0a0a0a0a" not in out[1] and "0a0a0a0a" not in out[2] and "AF0AF0AF0" not in out[3]
    assert [len(out[k]) for k in (1, 2, 3)] == [8 + 128, 8 + 130, 8 + 9000]
    assert all(t.startswith("key ") and t.endswith(" end") for t in out.values())
