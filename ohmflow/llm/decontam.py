"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` cuts the training texts into shards of about a slice of text
and stores one posting list per (shard, term): the ordinals at which the term
stands in its shard. The words of a shard are numbered on end with a gap after
each document, so one number holds document and position, and a phrase is an
intersection of lists shifted by their offsets.

A search reads only the lists of test terms, brings a shard's lists together
(bounded by the shard) and intersects them per window from the rarest term on.
Test items are taken in blocks of at most ``BLOCK_TERMS`` terms, which bounds
what is sent to the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrays import ALNUM, slices, words
from .store import scratch

WINDOW = 10
GAP = 64
SHARD_BYTES = 4 << 20
BLOCK_TERMS = 1_000_000
_INDEX = ("shard long, term long, n long, ordinals binary, ids array<long>, "
          "starts array<long>, counts array<long>")


class Index(NamedTuple):
    """``postings(shard, term, n, ordinals)`` and ``texts(shard, ids, starts,
    counts)``: the row keys of a shard in order, the ordinal of each one's first
    word and its number of words."""
    postings: DataFrame
    texts: DataFrame


def _packed(lists: np.ndarray, first: np.ndarray) -> pa.Array:
    """Sorted runs as little-endian differences, one binary value per run."""
    d = np.diff(lists, prepend=0)
    d[first[:-1]] = lists[first[:-1]]
    raw = d.astype("<u4").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [
        None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(raw)])


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u4"), dtype=np.int64)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shard_bytes: int = SHARD_BYTES) -> Index:
    """Tokenise whole texts (A-Z lower-cased, runs of letters, digits and
    non-ASCII bytes) and store the index in the shared folder. ``id_col`` holds
    longs; null and repeated ones are told apart by their place in a shard."""
    names = ["shard", "term", "n", "ordinals", "ids", "starts", "counts"]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            for lo, hi in slices(text, shard_bytes):
                w = words(text.slice(lo, hi - lo), ALNUM, lower=True)
                hashes, bounds = w.hash, w.first
                del w       # its sums are the largest arrays of a slice
                texts = np.arange(hi - lo)
                starts, counts = bounds[:-1] + texts * GAP, np.diff(bounds)
                order = np.argsort(hashes, kind="stable")
                terms = hashes[order]
                first = np.append(np.flatnonzero(np.diff(terms, prepend=~terms[:1])), len(order))
                terms = terms[first[:-1]]
                at = order + np.repeat(texts, counts)[order] * GAP
                shard = uuid.uuid4().int >> 65
                k = len(terms)
                none = pa.nulls(k, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, shard)), pa.array(terms.view(np.int64)),
                     pa.array(np.diff(first)), _packed(at, first), none, none, none], names)
                rows = pa.array([0, hi - lo], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.nulls(1, pa.int64()), pa.array([len(hashes)]),
                     pa.nulls(1, pa.binary()),
                     pa.ListArray.from_arrays(rows, key.slice(lo, hi - lo).cast(pa.int64())),
                     pa.ListArray.from_arrays(rows, pa.array(starts)),
                     pa.ListArray.from_arrays(rows, pa.array(counts))], names)

    path = scratch(docs.sparkSession, "postings")
    docs.select(id_col, text_col).mapInArrow(run, _INDEX).write.option(
        "compression", "zstd").parquet(path)
    back = docs.sparkSession.read.schema(_INDEX).parquet(path)
    return Index(back.where("term is not null").select("shard", "term", "n", "ordinals"),
                 back.where("term is null").select("shard", "ids", "starts", "counts"))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 size: int = WINDOW) -> DataFrame:
    """(item_id, terms): the windows of each test item, ``size`` consecutive
    words or all of a shorter item."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            for lo, hi in slices(text):
                w = words(text.slice(lo, hi - lo), ALNUM, lower=True)
                ids, out = [], []
                for i in range(hi - lo):
                    h = w.hash[w.first[i]:w.first[i + 1]].view(np.int64)
                    n = min(size, len(h))
                    for k in range(len(h) - n + 1 if n else 0):
                        ids.append(lo + i)
                        out.append(h[k:k + n])
                if ids:
                    yield pa.RecordBatch.from_arrays(
                        [key.take(pa.array(ids)), pa.array(out, pa.list_(pa.int64()))],
                        ["item_id", "terms"])

    return items.select(id_col, text_col).mapInArrow(run, f"item_id {kind}, terms array<long>")


def _phrase(lists: list[np.ndarray], rarest: list[int]) -> np.ndarray:
    """Start ordinals of a phrase: shifted lists intersected, rarest first."""
    at = lists[rarest[0]] - rarest[0]
    for k in rarest[1:]:
        if not len(at):
            break
        have, want = lists[k], at + k
        at = at[have[np.minimum(np.searchsorted(have, want), len(have) - 1)] == want]
    return at


def _near(lists: list[np.ndarray], rarest: list[int], slop: int) -> np.ndarray:
    """Ordinals of the rarest term with every other term within ``slop``."""
    at = lists[rarest[0]]
    for k in rarest[1:]:
        if not len(at):
            break
        have = lists[k]
        i = np.searchsorted(have, at)
        after = np.abs(have[np.minimum(i, len(have) - 1)] - at)
        before = np.abs(at - have[np.maximum(i - 1, 0)])
        at = at[np.minimum(after, before) <= slop]
    return at


def _blocks(wins: DataFrame, block_terms: int) -> Iterator[list]:
    """Windows in blocks of items, each of about ``block_terms`` terms."""
    total = wins.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = total // block_terms + 1
    for b in range(n):
        part = wins.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) if n > 1 else wins
        rows = [(r.item_id, tuple(r.terms)) for r in part.collect()]
        if rows:
            yield rows


def search(index: Index, wins: DataFrame, slop: int | None = None,
           block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Matches per text with any: (shard, text, item_ids, starts, lengths), one
    entry per occurrence; text is the place in the shard. ``slop`` None asks for
    exact phrases; else for all words of a window within ``slop`` words of its
    rarest one (below GAP, so that no match reaches the next text), where start
    is the place of that word and length 1. A text appears once per item block."""
    if slop is not None and not 0 <= slop < GAP:
        raise ValueError(f"slop must be below {GAP}")
    spark = wins.sparkSession
    kind = wins.schema["item_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"shard long, text int, item_ids array<{kind}>, "
                                  "starts array<long>, lengths array<long>")
    arrow = to_arrow_schema(schema)
    out = spark.createDataFrame([], schema)
    for rows in _blocks(wins, block_terms):
        distinct: dict[tuple, set] = {}
        for item, terms in rows:
            if item is not None:
                distinct.setdefault(terms, set()).add(item)
        vocab = pa.table({"term": pa.array({t for terms in distinct for t in terms}, pa.int64())})
        plan = spark.sparkContext.broadcast([(t, sorted(i)) for t, i in distinct.items()])
        # at most block_terms numbers of eight bytes
        lists = index.postings.join(F.broadcast(spark.createDataFrame(vocab)), "term", "left_semi")
        shards = lists.select("shard", "term", "ordinals").unionByName(
            index.texts.select("shard", "starts"), allowMissingColumns=True)
        found = shards.groupBy("shard").applyInArrow(_searcher(plan, slop, arrow), schema)
        out = out.unionByName(found)
    return out


def _searcher(plan, slop: int | None, arrow: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        head = pc.is_null(table.column("term"))
        firsts = table.filter(head).column("starts").combine_chunks()
        table = table.filter(pc.invert(head))
        terms = table.column("term").to_pylist()
        raw = dict(zip(terms, table.column("ordinals")))
        first = firsts.values.to_numpy() if len(firsts) else np.zeros(0, np.int64)
        open_: dict[int, np.ndarray] = {}
        by: dict[int, list] = {}
        for window, items in plan.value:
            if not all(t in raw for t in window):
                continue
            for t in window:
                if t not in open_:
                    open_[t] = unpack(raw[t].as_buffer())
            mine = [open_[t] for t in window]
            rarest = sorted(range(len(window)), key=lambda k: (len(mine[k]), k))
            at = _phrase(mine, rarest) if slop is None else _near(mine, rarest, slop)
            size = len(window) if slop is None else 1
            text = np.searchsorted(first, at, "right") - 1
            for d, a in zip(text.tolist(), at.tolist()):
                by.setdefault(d, []).extend((a - int(first[d]), size, i) for i in items)
        cols: list[list] = [[], [], [], [], []]
        for d, hits in by.items():
            hits.sort()
            for c, v in zip(cols, (shard, d, [h[2] for h in hits], [h[0] for h in hits],
                                   [h[1] for h in hits])):
                c.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(cols, arrow.types)], schema=arrow)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
                  slop: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside any
    match), item_ids (distinct, sorted), starts and lengths of the matches in
    words.

    A null or wordless text has no words and no match; items without words, or
    with a null id, match nothing; equal windows of several items count for
    each item. Repeated rows are searched each on its own; a null doc_id is
    kept. Empty tables give empty matches. Other columns are ignored.
    """
    index = build_index(docs)
    hits = search(index, item_windows(benchmark, size=size), slop)
    hits = hits.groupBy("shard", "text").agg(
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("item_ids", "starts", "lengths")])
    texts = index.texts.select("shard", F.posexplode(F.arrays_zip("ids", "counts"))
                               .alias("text", "t"))
    spans = F.array_distinct(F.arrays_zip("starts", "lengths"))
    covered = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(
        s["starts"], s["starts"] + s["lengths"] - 1))))
    return texts.join(hits, ["shard", "text"], "left").select(
        F.col("t.ids").alias("doc_id"), F.col("t.counts").alias("n_words"),
        F.when(F.col("starts").isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_hit"),
        F.coalesce(F.array_sort(F.array_distinct("item_ids")),
                   F.array().cast(hits.schema["item_ids"].dataType)).alias("item_ids"),
        "starts", "lengths")
