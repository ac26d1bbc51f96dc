"""Document quality classifier on random-indexing word vectors.

Each word has a sparse ternary index vector drawn from its hash; a word's
vector is the sum of the index vectors of its neighbours within ``REACH`` over
the whole corpus, scaled by log frequency and normalised. Words share
``BUCKETS`` hash rows, which bounds the vector table. A document is the pooled
(mean and spread) vectors of its words, with the likeness of neighbouring words
and its length. A two-layer numpy network is fitted on labelled documents and
its logits are calibrated by one temperature on a part held back from the fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACED, mix, numbered, slices, words
from .store import stored

BUCKETS = 1 << 15
DIMS = 32
NONZERO = 4
REACH = 2
#: bound on labelled rows used for the fit (chosen by hash of doc_id)
MAX_LABELLED = 20_000
HIDDEN = 32
EPOCHS = 60
CUT = 0.3
SEED = 5


def _index_vectors(buckets: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every bucket's index vector."""
    r = numbered(SEED, buckets * NONZERO).reshape(buckets, NONZERO)
    return (r % np.uint64(dims)).astype(np.int64), np.where(mix(r) & np.uint64(1), 1.0, -1.0)


def context_sums(docs: DataFrame, buckets: int = BUCKETS, dims: int = DIMS) -> DataFrame:
    """(bucket, n, v0..): occurrences and summed index vectors of neighbours over
    all texts. A task sends at most one row per bucket; sums are integers, so
    they do not depend on the order of tasks."""
    cols = [f"v{k}" for k in range(dims)]

    def run(batches: Iterator[pa.RecordBatch]):
        place, sign = _index_vectors(buckets, dims)
        total = np.zeros(buckets * dims)
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            text = batch.column(0)
            for lo, hi in slices(text, 1 << 20):
                w = words(text.slice(lo, hi - lo), SPACED)
                b = (w.hash % np.uint64(buckets)).astype(np.int64)
                of = np.repeat(np.arange(hi - lo), np.diff(w.first))
                seen += np.bincount(b, minlength=buckets)
                for step in range(1, REACH + 1):
                    same = of[step:] == of[:-step]
                    x, y = b[:-step][same], b[step:][same]
                    for me, other in ((x, y), (y, x)):
                        for k in range(NONZERO):
                            total += np.bincount(me * dims + place[other, k], sign[other, k],
                                                 minlength=buckets * dims)
        some = np.flatnonzero(seen)
        v = np.rint(total.reshape(buckets, dims)[some]).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(seen[some]), *[pa.array(v[:, k]) for k in range(dims)]],
            ["bucket", "n", *cols])

    return (docs.select("text").mapInArrow(
        run, "bucket long, n long, " + ", ".join(f"{c} long" for c in cols))
        .groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ["n", *cols]]))


def word_vectors(sums: DataFrame, buckets: int = BUCKETS, dims: int = DIMS) -> np.ndarray:
    """Normalised float32 table of ``buckets`` rows: a size the parameters fix."""
    rows = sums.toPandas()
    out = np.zeros((buckets, dims), np.float32)
    if len(rows):
        v = rows[[f"v{k}" for k in range(dims)]].to_numpy(np.float64)
        n = rows["n"].to_numpy(np.float64)
        v = v / n[:, None]
        v -= np.average(v, axis=0, weights=n)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        out[rows["bucket"].to_numpy(np.int64)] = v / np.maximum(norm, 1e-9)
    return out


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, x): pooled vectors of every whole text, in one pass."""
    table = docs.sparkSession.sparkContext.broadcast(vectors)
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets, dims = vectors.shape

    def run(batches: Iterator[pa.RecordBatch]):
        t = table.value
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            for lo, hi in slices(text, 1 << 20):
                w = words(text.slice(lo, hi - lo), SPACED)
                b = (w.hash % np.uint64(buckets)).astype(np.int64)
                x = np.zeros((hi - lo, 2 * dims + 4), np.float32)
                v = t[b]
                for i in range(hi - lo):
                    a, e = w.first[i], w.first[i + 1]
                    if a == e:
                        continue
                    d = v[a:e]
                    x[i, :dims] = d.mean(axis=0)
                    x[i, dims:2 * dims] = d.std(axis=0)
                    if e - a > 1:
                        x[i, -4] = np.einsum("ij,ij->i", d[1:], d[:-1]).mean()
                        x[i, -3] = (b[a + 1:e] == b[a:e - 1]).mean()
                    x[i, -2] = np.log1p(e - a)
                    x[i, -1] = np.log1p((w.end[a:e] - w.start[a:e]).mean())
                flat = pa.array(x.ravel(), pa.float32())
                off = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [key.slice(lo, hi - lo), pa.ListArray.from_arrays(off, flat)], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<float>")


class Network:
    """Standardised inputs, one ReLU layer, one logit, one temperature."""

    def __init__(self, base: float = 0.5):
        self.layers = None
        self.base = base
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        h = np.maximum(((x - mean) / scale) @ w1 + b1, 0)
        return h @ w2 + b2

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.base)
        z = np.clip(self.logits(x) / self.temperature, -40, 40)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS) -> Network:
    """Adam on cross-entropy over four fifths of the rows, temperature by the
    likelihood of the rest. Rows come in a fixed order; nothing is drawn at
    random but the seeded start. With one class only, the score is its rate."""
    net = Network(float(y.mean()) if len(y) else 0.5)
    if len(np.unique(y)) < 2 or len(y) < 10:
        return net
    x, y = x.astype(np.float64), y.astype(np.float64)
    back = np.arange(len(y)) % 5 == 0
    fx, fy = x[~back], y[~back]
    mean, scale = fx.mean(axis=0), fx.std(axis=0) + 1e-6
    rng = np.random.default_rng(SEED)
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z, step = (fx - mean) / scale, 0
    for _ in range(epochs):
        order = rng.permutation(len(fy))
        for lo in range(0, len(fy), 256):
            i = order[lo:lo + 256]
            h = np.maximum(z[i] @ p[0] + p[1], 0)
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - fy[i]) / len(i)
            back_h = np.outer(g, p[2]) * (h > 0)
            grads = [z[i].T @ back_h + 1e-4 * p[0], back_h.sum(0), h.T @ g + 1e-4 * p[2],
                     np.array([g.sum()])]
            step += 1
            for k, gr in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr * gr
                p[k] -= 0.003 * (m[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    net.layers = (mean, scale, *p)
    held, truth = net.logits(x[back]), y[back]

    def loss(t):
        return np.logaddexp(0, np.where(truth == 1, -1, 1) * held / t).mean()
    net.temperature = min(np.geomspace(0.25, 16, 97), key=loss)
    return net


def _taught(x: DataFrame, labels: DataFrame, max_labelled: int) -> Network:
    """Network fitted on the labelled rows, or on those whose hash of doc_id is
    below a cut that leaves about ``max_labelled`` (and never more)."""
    known = stored(x.where("not held_out").join(
        labels.where("quality in (0, 1)").select("doc_id", "quality"), "doc_id"), "labelled")
    known = known.withColumn("h", F.xxhash64("doc_id"))
    share = min(1.0, 0.97 * max_labelled / max(known.count(), 1))
    some = known.where(F.pmod("h", F.lit(1_000_000_007)) < int(share * 1_000_000_007) + 1)
    rows = some.select("h", "doc_id", "quality", "x").toPandas()
    rows = rows.sort_values(["h", "doc_id", "quality"], kind="stable")[:max_labelled]
    return fit(np.array(rows["x"].tolist()), rows["quality"].to_numpy(np.float64))


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
             cut: float = CUT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Labels teach only from rows with crc32(doc_id as text) mod 5 other than 0,
    and only where quality is 0 or 1; vectors are learned from all texts. A null
    or wordless text has zero features and still a score. A null doc_id is
    scored and not held out. Repeated rows score alike; of repeated labels
    conflicting ones both teach. Without two labelled classes every score is the
    one class's rate (0.5 without labels). Empty tables give an empty result;
    other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    vectors = word_vectors(context_sums(docs))
    x = stored(features(docs, vectors), "features").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
    net = _taught(x, labels, max_labelled)
    model = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = batch.column("x")
            wide = rows.values.to_numpy(zero_copy_only=False)[
                rows.offsets[0].as_py():rows.offsets[-1].as_py()]
            s = model.value.predict(wide.reshape(len(rows), -1).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s),
                 pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return x.select("doc_id", "held_out", "x").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")
