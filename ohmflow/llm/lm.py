"""Brown class-based bigram language model.

Counts cover every training token. Exchange clustering runs in two steps. First
the ``FREQUENT`` - 1 most counted words, the end of a text and ``ENDINGS`` groups of all
other words by ending (a hash of the last three bytes) are units that move between
classes one by one as long as the likelihood of the class bigrams grows. From these
classes on, the ``WORDS`` - 1 most counted words move for themselves: each pass over the
texts sums, for the words whose turn it is, the classes before and after them, and
each of these takes the class that fits best; the classes with the highest likelihood of
all passes stay. Every other word with ``OWN`` occurrences or more then takes its best class
once, by the same rule from all its neighbours; only rarer ones keep that of their
ending. A text's probability is the product of class transitions, smoothed towards
the class unigram, and word emissions

    P(w | class) = (count(w) - d) / N(class),    d = n1 / (n1 + 2 n2)

with the discounted mass of all classes left to the one unknown word. Sums over
all known words and the unknown one are 1 after any context.

The table of the ``WORDS`` most counted words has a fixed size and is sent to all tasks.
Exact counts and classes of all others stay distributed: each slice of texts sends
its distinct rare words, with sums of the classes around them, to one place per word
and gets back their counts and classes, from which class bigrams are counted anew.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACED, Words, mix, slices, words
from .store import scratch, stored

FREQUENT = 768
ENDINGS = 256
WORDS = 65_536
CLASSES = 64
OWN = 3
SWEEPS = 12
PASSES = 4
PRIOR = 20.0
END = np.uint64(0x0E0D0E0D0E0D0E0D)
SLICE = 1 << 20
CELLS = 200_000     # rows a task sends at once


class Model(NamedTuple):
    """Everything of fixed size: hashes of the most counted words (sorted, with
    counts, units and classes) and per-class tables."""
    frequent: np.ndarray
    counts: np.ndarray
    units: np.ndarray           # of each word: its place in class_of
    class_of: np.ndarray        # of each unit; FREQUENT and on: by ending; then of words
    log_next: np.ndarray        # log10 P(class | previous class)
    log_mass: np.ndarray        # log10 N(class)
    log_unknown: np.ndarray     # log10 P(unknown word | previous class)
    grid: np.ndarray            # class x next class in training texts
    discount: float
    total: int
    types: int


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Terms with END after each text, and text bounds. A term is a word's hash
    with the hash of its ending in the top byte."""
    texts = len(w.first) - 1
    bounds = w.first + np.arange(texts + 1)
    at = np.arange(len(w.hash)) + np.repeat(np.arange(texts), np.diff(w.first))
    tail = np.zeros(len(w.hash), np.uint64)
    for k in range(1, 4):
        inside = w.end - k >= w.start
        byte = np.where(inside, w.data[np.maximum(w.end - k, 0)], 0) if len(w.data) else tail
        tail = tail * np.uint64(256) + byte.astype(np.uint64)
    h = np.full(len(w.hash) + texts, END, np.uint64)
    top = mix(tail + np.uint64(1)) % np.uint64(ENDINGS) << np.uint64(56)
    h[at] = w.hash & np.uint64((1 << 56) - 1) | top
    return h, bounds


def _ending(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(56)).astype(np.int64)


def _slices(batches, *more: str):
    for batch in batches:
        text = batch.column("text")
        for lo, hi in slices(text, SLICE):
            w = words(text.slice(lo, hi - lo), SPACED, lower=True)
            tokens = _tokens(w)
            del w       # its sums are the largest arrays of a slice
            yield (lo, hi, *tokens, *[batch.column(c).slice(lo, hi - lo) for c in more])


def token_counts(train: DataFrame) -> DataFrame:
    """(term, n) of every token of the training texts."""
    def run(batches: Iterator[pa.RecordBatch]):
        for _, _, h, _ in _slices(batches):
            terms, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)],
                                             ["term", "n"])

    return (train.select("text").mapInArrow(run, "term long, n long")
            .groupBy("term").agg(F.sum("n").alias("n")))


def _lookup(frequent: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each token among the most counted words, -1 for others."""
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    return np.where(frequent[at] == h, at, -1)


def encode(docs: DataFrame, frequent: np.ndarray, units: np.ndarray) -> DataFrame:
    """Texts as codes, stored once. Rows of two kinds: ``text`` (one per slice: ids,
    held_out and number of tokens of its texts, their codes: place of a frequent
    word as -1 - place, else the number of a rare word in its slice, and the terms of
    the rare words in the order of their numbers) and ``pair`` (one per task: codes, the
    unit x next unit counts over its training texts, END leading in each)."""
    model = docs.sparkSession.sparkContext.broadcast((frequent, units))
    size = FREQUENT + ENDINGS
    types = {"kind": pa.string(), "slice": pa.int64(), "ids": pa.list_(pa.int64()),
             "held_out": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64()), "codes": pa.binary(),
             "terms": pa.binary()}
    names = list(types)
    schema = ("kind string, slice long, ids array<long>, held_out array<boolean>, sizes array<long>, "
              "codes binary, terms binary")

    def rows(size_: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [cols[c].cast(types[c]) if c in cols else pa.nulls(size_, types[c]) for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]):
        pairs = np.zeros(size * size, np.int32)
        freq, unit_of = model.value
        lead = unit_of[np.searchsorted(freq, END)]
        name = TaskContext.get().partitionId() << 32        # the same in a repeated task
        for lo, hi, h, bounds, ids, held in _slices(batches, "doc_id", "held_out"):
            place = _lookup(freq, h)
            rare = place < 0
            unit = np.where(rare, FREQUENT + _ending(h), unit_of[place])
            terms, number = np.unique(h[rare], return_inverse=True)
            code = -1 - place
            code[rare] = number
            whole = pa.array([0, hi - lo], pa.int32())
            yield rows(1, kind=pa.array(["text"]), slice=pa.array([name]),
                       ids=pa.ListArray.from_arrays(whole, ids.cast(pa.int64())),
                       held_out=pa.ListArray.from_arrays(whole, held),
                       sizes=pa.ListArray.from_arrays(whole, pa.array(np.diff(bounds))),
                       codes=pa.array([_squeeze(code)]), terms=pa.array([terms.tobytes()], pa.binary()))
            name += 1
            learn = np.repeat(~np.asarray(held), np.diff(bounds))
            np.add.at(pairs, (_shifted(unit, bounds[:-1], lead) * size + unit)[learn], 1)
        yield rows(1, kind=pa.array(["pair"]), codes=pa.array([_squeeze(pairs)]))

    path = scratch(docs.sparkSession, "codes")
    docs.select("doc_id", "held_out", "text").mapInArrow(run, schema).write.option(
        "compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _shifted(x: np.ndarray, start: np.ndarray, lead: int) -> np.ndarray:
    """What stands before each token, ``lead`` at the start of each text."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[start] = lead
    return before


def _squeeze(codes: np.ndarray) -> bytes:
    """int32 codes, one byte plane after the other, deflated."""
    planes = codes.astype("<i4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unsqueeze(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit. ``pairs`` is the units x units bigram count matrix, of
    a size the parameters fix. Each unit in turn (most counted first) moves to
    the class where sum f(N(c, c')) - sum f(N(c)) - sum f(N'(c)), f(x) = x log x,
    grows most; sweeps end when nothing moves. Starts from a round-robin over
    counts, ties go to the lower class."""
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight, kind="stable")
    used = order[weight[order] > 0]
    cls = np.zeros(len(pairs), np.int64)
    cls[order] = np.arange(len(order)) % classes
    one = np.eye(classes)[cls]
    right, left = pairs @ one, (one.T @ pairs).T      # unit x class: next, previous
    grid = one.T @ right
    for _ in range(sweeps):
        moved = 0
        for u in used:
            a, own = cls[u], pairs[u, u]
            r, l = right[u].copy(), left[u].copy()
            r[a] -= own
            l[a] -= own
            grid[a] -= r
            grid[:, a] -= l
            grid[a, a] -= own
            out, into = grid.sum(1) + l, grid.sum(0) + r    # others as with u in any class
            ru, lu = r.sum() + own, l.sum() + own
            gain = (_f(grid + r) - _f(grid)).sum(1) + (_f(grid.T + l) - _f(grid.T)).sum(1)
            d = np.diag(grid)
            gain += _f(d + r + l + own) - _f(d + r) - _f(d + l) + _f(d)
            gain -= _f(out + ru) - _f(out) + _f(into + lu) - _f(into)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            grid[b] += r
            grid[:, b] += l
            grid[b, b] += own
            if b != a:
                moved += 1
                cls[u] = b
                right[:, a] -= pairs[:, u]
                right[:, b] += pairs[:, u]
                left[:, a] -= pairs[u]
                left[:, b] += pairs[u]
        if not moved:
            break
    return cls


def _safe_log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def fit(counts: DataFrame, codes_of, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """Model and encoded texts. ``codes_of(frequent, units)`` encodes the texts."""
    known = counts.agg(F.sum("n").alias("total"), F.count("*").alias("types"),
                       F.sum((F.col("n") == 1).cast("long")).alias("n1"),
                       F.sum((F.col("n") == 2).cast("long")).alias("n2"),
                       F.sum(F.when(F.col("term") == int(END), F.col("n"))).alias("ends")).first()
    total, types, n1, n2, ends = (int(v or 0) for v in known)
    discount = min(max(n1 / (n1 + 2 * n2), 0.05), 0.95) if n1 else 0.5
    top = (counts.where(F.col("term") != int(END)).orderBy(F.desc("n"), "term")
           .limit(WORDS - 1).toArrow())
    h = np.append(END, top.column("term").to_numpy().view(np.uint64))
    sort = np.argsort(h)
    frequent, freq_n = h[sort], np.append(ends, top.column("n").to_numpy())[sort]
    # END's unit is 0 whatever its count, a word's its rank by count, then its ending
    units = np.where(sort < FREQUENT, sort, FREQUENT + _ending(frequent))
    encoded = codes_of(frequent, units)
    size = FREQUENT + ENDINGS
    pairs = np.zeros((size, size))
    got = _summed(encoded.where("kind = 'pair'").select("codes"), size * size, _unsqueeze)
    pairs.flat[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    del got
    cls = exchange(pairs, classes)
    # from here on each word has a unit of its own behind the others
    model = Model(frequent, freq_n, size + np.arange(len(frequent)), np.concatenate([cls, cls[units]]),
                  None, None, None, np.zeros((classes, classes)), discount, total, types)
    model = improved(model, encoded, classes, sort < FREQUENT)
    spark = counts.sparkSession
    marked = spark.createDataFrame(pa.table({"term": pa.array(frequent.view(np.int64))}))
    rest = (counts.join(F.broadcast(marked), "term", "left_anti")        # WORDS rows
            .groupBy(F.shiftrightunsigned("term", 56).alias("ending"))
            .agg(F.sum("n").alias("n"), F.count("*").alias("types")).toPandas())
    at = model.class_of[FREQUENT + rest["ending"].to_numpy(np.int64)]
    mass, kinds = _frequent_masses(model, classes)
    np.add.at(mass, at, rest["n"].to_numpy(np.float64))
    np.add.at(kinds, at, rest["types"].to_numpy(np.float64))
    return _smoothed(model, model.grid, mass, kinds), encoded


def word_class(model: Model) -> np.ndarray:
    return model.class_of[model.units]


def _frequent_masses(model: Model, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """N(class) and the number of types over the frequent words."""
    mass, kinds = np.zeros(classes), np.zeros(classes)
    np.add.at(mass, word_class(model), model.counts)
    np.add.at(kinds, word_class(model), model.counts > 0)
    return mass, kinds


def likelihood(grid: np.ndarray) -> float:
    """The part of the bigram likelihood that depends on the classes."""
    return float(_f(grid).sum() - _f(grid.sum(1)).sum() - _f(grid.sum(0)).sum())


def _token_classes(model: Model, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice's training tokens: codes, classes, and the classes before and after.
    Rare words count by ending; what follows a text's last token is END's lead."""
    codes = _unsqueeze(row["codes"])
    terms = np.frombuffer(row["terms"], np.uint64)
    of_rare = model.class_of[FREQUENT + _ending(terms)]
    # one table for both signs of a code: rare words first, frequent ones from the end
    c = np.concatenate([of_rare, word_class(model)[::-1]])[codes]
    sizes = np.asarray(row["sizes"], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
    before = _before(model, c, start)
    after = np.append(c[1:], c[:1])
    learn = np.repeat(~np.asarray(row["held_out"], bool), sizes)
    return codes[learn], c[learn], before[learn], after[learn]


_TEXT = ("slice", "ids", "held_out", "sizes", "codes", "terms")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def class_cells(encoded: DataFrame, model: Model, classes: int, movers: np.ndarray) -> DataFrame:
    """(cell, n): for each frequent word whose place is in ``movers`` the classes before
    (cell = place * 2 * classes + class) and after it (classes more), an END having
    none after it; and the class bigrams (cell = -1 - (class * classes + next))."""
    share = encoded.sparkSession.sparkContext.broadcast((model, movers))

    def run(batches: Iterator[pa.RecordBatch]):
        m, who = share.value
        width = 2 * classes
        cells = np.zeros(len(who) * width, np.int32)
        row_of = np.full(len(m.frequent), -1)
        row_of[who] = np.arange(len(who))
        grid = np.zeros(classes * classes, np.int64)
        last = int(np.searchsorted(m.frequent, END))
        for row in _rows_of(batches):
            code, c, before, after = _token_classes(m, row)
            grid += np.bincount(before * classes + c, minlength=classes * classes)
            place = -1 - code
            line = np.where(place >= 0, row_of[np.maximum(place, 0)], -1)
            mine = line >= 0
            np.add.at(cells, line[mine] * width + before[mine], 1)
            mine &= place != last
            np.add.at(cells, line[mine] * width + classes + after[mine], 1)
        some = np.flatnonzero(cells)
        for lo in range(0, len(some), CELLS):
            at = some[lo:lo + CELLS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(who[at // width] * width + at % width), pa.array(cells[at], pa.int64())], ["cell", "n"])
        at = np.flatnonzero(grid)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - at), pa.array(grid[at])], ["cell", "n"])
    return (encoded.where("kind = 'text'").select("held_out", "sizes", "codes", "terms")
            .mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")))


def _grid(cells: DataFrame, classes: int) -> np.ndarray:
    got = cells.where("cell < 0").toArrow()      # classes x classes rows
    grid = np.zeros(classes * classes)
    grid[-1 - got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return grid.reshape(classes, classes)


def improved(model: Model, encoded: DataFrame, classes: int, single: np.ndarray,
             passes: int = PASSES) -> Model:
    """The model after exchange passes over the frequent words: first those that so
    far went by their ending, then every second word in turn; the others' classes
    stand still in a pass. Words that move together may do so for the same gap, so
    a pass can lower the likelihood; of all passes the classes with the highest one
    are taken. ``grid`` is that of these classes."""
    best = None
    place = np.arange(len(model.frequent))
    turns = [place[~single], *(place[place % 2 == k % 2] for k in range(passes - 1)), place[:0]]
    for k, movers in enumerate(turns):
        cells = stored(class_cells(encoded, model, classes, movers), "cells")
        model = model._replace(grid=_grid(cells, classes))
        if best is None or likelihood(model.grid) > likelihood(best.grid):
            best = model
        if k == passes:
            break
        share = encoded.sparkSession.sparkContext.broadcast((word_class(model), model.grid))

        def decide(rows: pa.Table) -> pa.Table:
            home, grid = share.value
            cell = rows.column("cell").to_numpy()
            words_, at = np.unique(cell // (2 * classes), return_inverse=True)
            near = np.zeros((len(words_), 2 * classes))
            near[at, cell % (2 * classes)] = rows.column("n").to_numpy()
            new = best_classes(grid, home[words_], near[:, :classes], near[:, classes:])
            moved = new != home[words_]
            return pa.table({"word": pa.array(words_[moved], pa.int32()), "class": pa.array(new[moved], pa.int32())})
        moves = (cells.where("cell >= 0").groupBy(F.floor(F.col("cell") / (512 * 2 * classes))).applyInArrow(
            decide, "word int, class int").toArrow())               # at most WORDS rows
        class_of = model.class_of.copy()
        class_of[model.units[moves.column("word").to_numpy()]] = moves.column("class").to_numpy()
        model = model._replace(class_of=class_of)
    return best


def _smoothed(model: Model, grid: np.ndarray, mass: np.ndarray, kinds: np.ndarray) -> Model:
    """The model with class tables from bigram counts, N(class) and its word types."""
    share = mass / max(mass.sum(), 1)
    trans = (grid + PRIOR * share) / (grid.sum(1, keepdims=True) + PRIOR)
    unknown = trans @ (model.discount * kinds / np.maximum(mass, 1))
    return model._replace(grid=grid, log_next=_safe_log(trans), log_mass=_safe_log(mass),
                          log_unknown=_safe_log(unknown))


def best_classes(grid: np.ndarray, home: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Class of each word: where the bigram likelihood (as in ``exchange``) is
    highest, given the word x class counts of classes before and after it. ``grid``
    holds the word in its class ``home``; other words stay where they are."""
    out = np.empty(len(home), np.int64)
    classes = len(grid)
    ends = grid.sum(1), grid.sum(0)
    for lo in range(0, len(home), 200):
        own = home[lo:lo + 200]
        row = np.arange(len(own))
        n = right[lo:lo + 200].sum(1)[:, None]
        gain = np.zeros((len(own), classes))
        for near, table, total in ((right, grid.T, ends[0]), (left, grid, ends[1])):
            near = near[lo:lo + 200]
            word, c = np.nonzero(near)
            k = near[word, c][:, None]
            base = table[c].copy()              # neighbour's class x candidate class
            base[np.arange(len(c)), own[word]] -= k[:, 0]
            base = np.maximum(base, 0)
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]][:len(word)])
            if len(start):
                gain[word[start]] += np.add.reduceat(_f(base + k) - _f(base), start)
            t = np.tile(total, (len(own), 1))
            t[row, own] -= n[:, 0]
            t = np.maximum(t, 0)
            gain -= _f(t + n) - _f(t)
        best = gain.argmax(1)
        out[lo:lo + 200] = np.where(gain[row, best] > gain[row, own] + 1e-9, best, own)
    return out


def rare_requests(encoded: DataFrame, model: Model, classes: int) -> DataFrame:
    """(slice, term, number, n, near) of the rare words of all slices: n occurrences in
    its training texts, near: cells (as in ``class_cells``) and their counts, two bytes
    and four, of the classes around them."""
    share = encoded.sparkSession.sparkContext.broadcast(model)
    width = 2 * classes

    def run(batches: Iterator[pa.RecordBatch]):
        m = share.value
        for row in _rows_of(batches):
            terms = np.frombuffer(row["terms"], np.int64)
            code, _, before, after = _token_classes(m, row)
            rare = code >= 0
            at, n = np.unique(np.concatenate([code[rare] * width + before[rare],
                                              code[rare] * width + classes + after[rare]]), return_counts=True)
            near = np.zeros(len(at), _CELL)
            near["cell"], near["n"] = at % width, n
            ends = np.zeros(len(terms) + 1, np.int32)
            ends[1:] = np.cumsum(np.bincount(at // width, minlength=len(terms))) * _CELL.itemsize
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(terms), row["slice"])), pa.array(terms), pa.array(np.arange(len(terms)), pa.int32()),
                 pa.array(np.bincount(code[rare], minlength=len(terms)), pa.int32()),
                 pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(ends), pa.py_buffer(near.tobytes())])],
                ["slice", "term", "number", "n", "near"])
    return encoded.where("kind = 'text'").select("slice", "held_out", "sizes", "codes", "terms").mapInArrow(
        run, "slice long, term long, number int, n int, near binary")


_CELL = np.dtype([("cell", "<u2"), ("n", "<u4")])


def rare_words(encoded: DataFrame, model: Model, classes: int, own: int = OWN) -> DataFrame:
    """(slice, number, n, class, head) of the rare words of all slices, stored;
    ``head`` marks one row of each word. Each word is decided once, from its
    neighbours in all training texts."""
    share = encoded.sparkSession.sparkContext.broadcast((model.class_of, model.grid))
    width = 2 * classes

    def decided(rows: pa.Table) -> pa.RecordBatch:
        cls, table = share.value
        term = rows.column("term").to_numpy()
        start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(term))))
        total = np.add.reduceat(rows.column("n").to_numpy().astype(np.int64), start)
        c = cls[FREQUENT + _ending(term[start].view(np.uint64))]
        sure = np.flatnonzero(total >= own)
        place = np.full(len(start), -1)
        place[sure] = np.arange(len(sure))
        blobs = rows.column("near").combine_chunks()
        ends = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset:blobs.offset + len(blobs) + 1]
        near = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]].view(_CELL)
        of = place[np.repeat(group, np.diff(ends) // _CELL.itemsize)]
        near, of = near[of >= 0], of[of >= 0]
        for lo in range(0, len(sure), 2000):
            some = (of >= lo) & (of < lo + 2000)
            k = min(2000, len(sure) - lo)
            around = np.bincount((of[some] - lo) * width + near["cell"][some], near["n"][some],
                                 minlength=k * width).reshape(k, width)
            who = sure[lo:lo + k]
            c[who] = best_classes(table, c[who], around[:, :classes], around[:, classes:])
        head = np.zeros(len(term), bool)
        head[start] = True
        return pa.RecordBatch.from_arrays(
            [rows.column("slice").combine_chunks(), rows.column("number").combine_chunks(),
             pa.array(total[group]), pa.array(c[group].astype(np.int16)), pa.array(head)],
            ["part", "number", "n", "class", "head"])

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []     # rows of words that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            term = batch.column("term").to_numpy()
            last = int(np.searchsorted(term, term[-1]))
            if last or (held and held[-1].column("term")[-1].as_py() != term[-1]):
                done = [*held, batch.slice(0, last)] if last else held
                yield decided(pa.Table.from_batches(done).combine_chunks())
                held = []
            held.append(batch.slice(last))
        if held:
            yield decided(pa.Table.from_batches(held).combine_chunks())

    return stored(rare_requests(encoded, model, classes).repartition("term").sortWithinPartitions("term")
                  .mapInArrow(run, "part long, number int, n long, class short, head boolean"), "words")


def _summed(blobs: DataFrame, size: int, read) -> pa.Table:
    """(cell, n) sums over the count tables of a binary column; a task sends at most one
    row per cell, and there are at most ``size`` in all."""
    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += read(raw)
        some = np.flatnonzero(total)
        for lo in range(0, len(some), CELLS):
            at = some[lo:lo + CELLS]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])
    return blobs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()


def _pairs(texts: DataFrame, size: int) -> np.ndarray:
    """Class bigrams of all training texts."""
    got = _summed(texts.select("pairs"), size * size, lambda raw: np.frombuffer(zlib.decompress(raw), "<i8"))
    out = np.zeros(size * size)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(size, size)


def _masses(rare: DataFrame, model: Model, size: int) -> tuple[np.ndarray, np.ndarray]:
    """N(class) and the number of word types of each class."""
    rest = (rare.where("head and n > 0").groupBy("class")
            .agg(F.sum("n").alias("n"), F.count("*").alias("types")).toPandas())
    mass, kinds = _frequent_masses(model, size)
    at = rest["class"].to_numpy(np.int64)
    mass[at] += rest["n"].to_numpy(np.float64)
    kinds[at] += rest["types"].to_numpy(np.float64)
    return mass, kinds


def _classed(model: Model, codes: np.ndarray, rare_n: np.ndarray,
             rare_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and class of each token of a slice."""
    rare = codes >= 0
    n = np.empty(len(codes), np.float64)
    c = np.empty(len(codes), np.int64)
    n[rare], c[rare] = rare_n[codes[rare]], rare_class[codes[rare]]
    at = -1 - codes[~rare]
    n[~rare], c[~rare] = model.counts[at], word_class(model)[at]
    return n, c


def _before(model: Model, c: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Class before each token, END leading in each text."""
    return _shifted(c, start, word_class(model)[np.searchsorted(model.frequent, END)])


def score_texts(docs: DataFrame, held_out, classes: int = CLASSES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10 probability) and perplexity.

    The model learns from rows where the column ``held_out`` is false; a null
    doc_id is never held out. A null or wordless text is one end token. Repeated
    rows all count and score alike. Without training tokens score equals
    base_score. Empty tables give an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = stored(token_counts(docs.where("not held_out")), "counts")
    model, encoded = fit(counts, lambda f, u: encode(docs, f, u), classes)
    spark = docs.sparkSession
    size = classes
    rare = rare_words(encoded, model, classes)
    core = spark.sparkContext.broadcast(model)
    texts = encoded.where("kind = 'text'").select("slice", "ids", "held_out", "sizes", "codes")

    def classed(text: pa.Table, words_: pa.Table) -> pa.Table:
        m = core.value
        number = words_.column("number").to_numpy()
        n_of, class_of = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        n_of[number] = words_.column("n").to_numpy()
        class_of[number] = words_.column("class").to_numpy()
        k = text.column("sizes").combine_chunks().values.to_numpy()
        start = np.concatenate([[0], np.cumsum(k)])[:-1].astype(np.int64)
        n, c = _classed(m, _unsqueeze(text.column("codes")[0].as_py()), n_of, class_of)
        learn = np.repeat(~np.asarray(text.column("held_out").combine_chunks().values), k)
        pairs = np.bincount((_before(m, c, start) * size + c)[learn], minlength=size * size)
        base = np.log10((n + 1) / (m.total + m.types + 1))
        emitted = np.where(n > 0, np.log10(np.maximum(n - m.discount, 1e-9)), 0)
        parts = [np.add.reduceat(x, start) for x in ((n > 0).astype(np.int64), base, emitted)]
        one = pa.array([0, len(k)], pa.int32())
        return pa.table({
            "ids": text.column("ids"), "held_out": text.column("held_out"),
            "sizes": text.column("sizes"),
            **{name: pa.ListArray.from_arrays(one, pa.array(x))
               for name, x in zip(("known", "base", "emitted"), parts)},
            "classes": pa.array([_squeeze(np.where(n == 0, -1 - c, c))]),
            "pairs": pa.array([zlib.compress(pairs.astype("<i8").tobytes(), 1)], pa.binary())})

    texts = stored(texts.groupBy("slice").cogroup(rare.groupBy("part")).applyInArrow(
        classed, "ids array<long>, held_out array<boolean>, sizes array<long>, known array<long>, "
                 "base array<double>, emitted array<double>, classes binary, pairs binary"), "classed")
    share = spark.sparkContext.broadcast(
        _smoothed(model, _pairs(texts, size), *_masses(rare, model, size)))

    def run(batches: Iterator[pa.RecordBatch]):
        m = share.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, held, k, known, base, emitted = (
                    row.column(x).flatten() for x in ("ids", "held_out", "sizes", "known", "base", "emitted"))
                k, score = k.to_numpy(), base.to_numpy()
                start = np.concatenate([[0], np.cumsum(k)])[:-1].astype(np.int64)
                c = _unsqueeze(row.column("classes")[0].as_py())
                new, c = c < 0, np.where(c < 0, -1 - c, c)
                if m.total:
                    before = _before(m, c, start)
                    p = np.where(new, m.log_unknown[before], m.log_next[before, c] - m.log_mass[c])
                    score = np.add.reduceat(p, start) + emitted.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [ids, held, pa.array(k), known, pa.array(np.full(len(k), m.total)), base,
                     pa.array(score), pa.array(10 ** np.minimum(-score / k, 300))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                     "score", "perplexity"])

    return texts.mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
             "base_score double, score double, perplexity double")
