"""Quality rules: base counts of every text, and a hashed n-gram log-likelihood
ratio between a trusted target and the raw corpus.

Words and word pairs (case kept) are hashed into ``buckets`` bins. Texts fall
into ``FOLDS`` folds by their hash, so exact copies share one. Two multinomials
are counted per fold: the target over documents that ``labels.quality`` marks 1,
the raw one over every document. A document's verdict is the mean of
log(target / raw) over its n-grams, counted over all other folds: no text is
held against counts that it or its copies fed. The cut is the far-out fence of
all documents' means; nothing is sampled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACED, Words, slices, span_hash, windows, words
from .store import stored

BUCKETS = 1 << 16
FOLDS = 8
#: counts an n-gram has at the corpus rate before any are seen: unseen ones say nothing
PRIOR = 1.0
#: the cut lies so many interquartile ranges (a least distance) below the lower quartile
FENCE = 3.0
LEAST = 0.02
#: steps of the mean ratio to one, in which its distribution is counted
STEPS = 1000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _bins(w: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each word and each pair inside a text."""
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    pair = windows(w.hash, 2)
    inside = text[:-1] == text[1:] if len(text) else np.zeros(0, bool)
    h = np.concatenate([w.hash, pair[inside]])
    return (h % np.uint64(buckets)).astype(np.int64), np.concatenate([text, text[:-1][inside]])


def _folds(w: Words) -> np.ndarray:
    """Fold of each text, by the hash of its bytes."""
    return (span_hash(w.sums, w.off[:-1], w.off[1:]) % np.uint64(FOLDS)).astype(np.int64)


def ngram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n0, n1 ..) over all texts, one count per fold; a task sends at
    most one row per bucket."""
    cols = [f"n{k}" for k in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(FOLDS * buckets, np.int64)
        for batch in batches:
            text = batch.column(0)
            for lo, hi in slices(text):
                w = words(text.slice(lo, hi - lo), SPACED)
                bins, of = _bins(w, buckets)
                total += np.bincount(_folds(w)[of] * buckets + bins, minlength=FOLDS * buckets)
        total = total.reshape(FOLDS, buckets)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), *[pa.array(total[k, some]) for k in range(FOLDS)]], ["bucket", *cols])

    return (docs.select("text").mapInArrow(
        run, "bucket long, " + ", ".join(f"{c} long" for c in cols))
        .groupBy("bucket").agg(*[F.sum(c).alias(c) for c in cols]))


def log_ratios(target: DataFrame, raw: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(target / raw) per fold and bucket, over the counts of all other folds:
    ``FOLDS`` x ``buckets`` numbers, a size the parameters fix. The target count is
    held against what the corpus rate lets expect, both with ``PRIOR`` more, so
    an n-gram that no other fold has is neutral. Without any target text all ratios
    are 0 and no document is rejected by them."""
    t, r = np.zeros((FOLDS, buckets)), np.zeros((FOLDS, buckets))
    for v, df in ((t, target), (r, raw)):
        rows = df.toPandas()
        at = rows["bucket"].to_numpy(np.int64)
        for k in range(FOLDS):
            v[k, at] = rows[f"n{k}"].to_numpy(np.float64)
        v[:] = v.sum(axis=0) - v
    size = t.sum(axis=1, keepdims=True)
    expected = r * (size / np.maximum(r.sum(axis=1, keepdims=True), 1))
    return np.where(size > 0, np.log((t + PRIOR) / (expected + PRIOR)), 0.0)


def _repeats(h: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(h) < 4:
        return 0
    _, inverse, n = np.unique(windows(h, 3), return_inverse=True, return_counts=True)
    hit = np.flatnonzero(n[inverse] > 1)
    cover = np.zeros(len(h), bool)
    for k in range(3):
        cover[hit + k] = True
    return int(cover.sum())


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words per text."""
    def total(flags):
        s = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return s
    lead = total((w.data & 0xC0) != 0x80)
    in_words = np.concatenate([[0], np.cumsum(lead[w.end] - lead[w.start])]).astype(np.int64)
    sym = total(_SYMBOLS[w.data])
    dup = np.zeros(len(w.off) - 1, np.int64)
    rep = np.zeros(len(w.off) - 1, np.int64)
    breaks = np.flatnonzero(w.data == 10)
    at = np.searchsorted(breaks, w.off)
    for i in range(len(dup)):
        a, b = w.first[i], w.first[i + 1]
        if a == b:
            continue
        rep[i] = _repeats(w.hash[a:b])
        cuts = breaks[at[i]:at[i + 1]]
        if len(cuts):
            start = np.concatenate([[w.off[i]], cuts + 1])
            end = np.concatenate([cuts, [w.off[i + 1]]])
            has = np.searchsorted(w.start[a:b], end) > np.searchsorted(w.start[a:b], start)
            line = span_hash(w.sums, start[has], end[has])
            dup[i] = len(line) - len(np.unique(line))
    return {"n_words": np.diff(w.first), "word_chars": np.diff(in_words[w.first]),
            "n_symbols": sym[w.off[1:]] - sym[w.off[:-1]], "n_dup_lines": dup,
            "n_repeat_words": rep}


def _verdicts(text: pa.Array, ratios: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts, base_failed and llr of each text of a slice."""
    w = words(text, SPACED)
    c = base_counts(w)
    bins, of = _bins(w, ratios.shape[1])
    n = np.bincount(of, minlength=len(text))
    llr = np.bincount(of, ratios[_folds(w)[of], bins], minlength=len(text)) / np.maximum(n, 1)
    failed = (c["n_words"] < MIN_WORDS) | (
        100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    return {**{k: v.astype(np.int64) for k, v in c.items()}, "base_failed": failed, "llr": llr}


def _ratios(docs: DataFrame, labels: DataFrame, buckets: int) -> np.ndarray:
    docs = docs.select("doc_id", "text")
    good = labels.where("quality = 1").select("doc_id").distinct()
    # one strategy at every size: labels grow with the corpus
    target = ngram_counts(docs.join(good.hint("merge"), "doc_id", "left_semi"), buckets)
    return log_ratios(target, ngram_counts(docs, buckets), buckets)


def _cut(steps: DataFrame) -> float:
    """The lower quartile of all documents' means less ``FENCE`` interquartile
    ranges, from (step, n): how many documents have which mean. Holds while fewer
    than a quarter of the documents that pass the base rules are junk."""
    rows = steps.groupBy("step").agg(F.sum("n").alias("n")).toPandas().sort_values("step")
    if not len(rows):
        return 0.0
    below = rows["n"].to_numpy(np.int64).cumsum()
    step = rows["step"].to_numpy(np.int64)
    low, high = (step[np.searchsorted(below, p * below[-1])] / STEPS for p in (0.25, 0.75))
    return low - max(FENCE * (high - low), LEAST)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float | None = None,
                  buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, kept
    and llr. ``threshold`` is the least llr that is kept; without it, it comes
    from the llr of all documents that pass the base rules.

    A null or wordless text has zero counts, llr 0 and fails the base rules.
    Repeated rows are judged alike, each on its own row; a null doc_id is
    judged but is never part of the target. Labels that are null, repeated or
    name no document change nothing else. Empty tables give an empty result;
    columns other than doc_id and text are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(_ratios(docs, labels, buckets))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            for lo, hi in slices(text):
                v = _verdicts(text.slice(lo, hi - lo), model.value)
                yield pa.RecordBatch.from_arrays(
                    [key.slice(lo, hi - lo), *map(pa.array, v.values())], ["doc_id", *v])

    out = stored(docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
             "n_repeat_words long, base_failed boolean, llr double"), "quality")
    if threshold is None:
        threshold = _cut(out.where("not base_failed").groupBy(
            F.floor(F.col("llr") * STEPS).alias("step")).agg(F.count("*").alias("n")))
    return out.select(*out.columns[:-1],
                      (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), "llr")


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float | None = None,
                   buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns,
    without a shuffle: one pass counts the llr, one filters. Cases as there."""
    model = docs.sparkSession.sparkContext.broadcast(_ratios(docs, labels, buckets))
    at = docs.columns.index("text")

    def count(batches: Iterator[pa.RecordBatch]):
        seen: Counter = Counter()
        for batch in batches:
            text = batch.column(0)
            for lo, hi in slices(text):
                v = _verdicts(text.slice(lo, hi - lo), model.value)
                seen.update(np.floor(v["llr"] * STEPS).astype(np.int64)[~v["base_failed"]].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()),
                                          pa.array(list(seen.values()), pa.int64())], ["step", "n"])

    if threshold is None:
        threshold = _cut(docs.select("text").mapInArrow(count, "step long, n long"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo, hi in slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                v = _verdicts(part.column(at), model.value)
                yield part.filter(pa.array(~v["base_failed"] & (v["llr"] >= threshold)))

    return docs.mapInArrow(run, docs.schema)
