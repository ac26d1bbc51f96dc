"""Variable-capacity best-fit packing of documents into training sequences.

Texts are measured in words plus one end token. A text longer than the largest
permitted length is cut into pieces of that length and a rest. Pieces are dealt
by hash into shards of about ``SHARD_PIECES``, so no task grows with the input.

Inside a shard pieces are placed longest first, each into the open bin it fills
best. Where none fits, a bin of the least-cost permitted size is opened. Several
opening rules are tried (least cost per token that the bin can still get, and
"at least size s" for each permitted s); the cheapest result counts, after each
bin is downsized to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACED, slices
from .store import stored

SIZES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 16.0
KNEE = 65_536.0
SHARD_PIECES = 20_000


def default_cost(size: int) -> float:
    """A sequence costs a fixed part, its length, and attention over it."""
    return OVERHEAD + size + size * size / KNEE


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): words of the whole text plus one end token."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            key, text = batch.column(0), batch.column(1).fill_null("").cast(pa.large_string())
            for lo, hi in slices(text):
                part = text.slice(lo, hi - lo)
                off = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + hi - lo + 1]
                raw = part.buffers()[2]
                data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if off[-1] > off[0] \
                    else np.zeros(0, np.uint8)
                inside = np.concatenate([[False], SPACED[data]])
                edge = np.zeros(len(data) + 1, bool)
                edge[off - off[0]] = True
                starts = np.concatenate([[0], np.cumsum(inside[1:] & (~inside[:-1] | edge[:-1]))])
                n = np.diff(starts[off - off[0]]) + 1
                yield pa.RecordBatch.from_arrays([key.slice(lo, hi - lo), pa.array(n, pa.int64())],
                                                 ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")


def _fill(sizes: Sequence[int], lengths: Sequence[int], cost, floor: int | None):
    """One opening rule over pieces in falling length: bin of each piece, use of
    each bin and total cost after downsizing."""
    left = sum(lengths)
    room: list[tuple[int, int]] = []    # (free, bin) of open bins, sorted
    used: list[int] = []
    bins = []
    for n in lengths:
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            able = [s for s in sizes if s >= n]
            if floor is None:
                size = min(able, key=lambda s: (cost(s) / min(s, left), s))
            else:
                size = next((s for s in able if s >= floor), able[-1])
            free, b = size, len(used)
            used.append(0)
        used[b] += n
        left -= n
        if free > n:
            insort(room, (free - n, b))
        bins.append(b)
    final = [next(s for s in sizes if s >= u) for u in used]
    return bins, final, sum(map(cost, final))


def pack_shard(lengths: Sequence[int], sizes: Sequence[int] = SIZES, cost=default_cost):
    """(bin of each piece, final size of each bin) for lengths in falling order."""
    best = None
    for floor in (None, *sizes):
        got = _fill(sizes, lengths, cost, floor)
        if best is None or got[2] < best[2]:
            best = got
    return best[0], best[1]


def pack(docs: DataFrame, sizes: Sequence[int] = SIZES, cost=default_cost,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start and n_tokens (span in the
    document's tokens), bin_id, bin_offset, bin_used, bin_size.

    Pieces of a document tile its tokens; bin_used <= bin_size, and bin_size is
    the smallest permitted length that holds the bin. A null or wordless text is
    one end token. Repeated rows and null doc_ids are packed like others. An
    empty table gives an empty result; other columns are ignored.
    """
    sizes = sorted(sizes)
    top = sizes[-1]
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = stored(token_counts(docs), "lengths").withColumn(
        "row", F.monotonically_increasing_id())    # fixed by the stored files
    pieces = counts.withColumn("piece", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("n_tokens") - 1) / top).cast("int"))))
    pieces = pieces.select("row", "doc_id", "piece", (F.col("piece").cast("long") * top).alias("start"),
                           F.least(F.lit(top), F.col("n_tokens") - F.col("piece").cast("long") * top)
                           .cast("long").alias("n_tokens"))
    shards = pieces.count() // shard_pieces + 1
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "row", "piece"], ascending=[False, True, True],
                              kind="stable")
        bins, final = pack_shard(pdf["n_tokens"].tolist(), sizes, cost)
        b = np.asarray(bins)
        pdf["bin_id"] = int(key[0]) * (1 << 32) + b
        pdf["bin_offset"] = pdf.groupby("bin_id")["n_tokens"].cumsum() - pdf["n_tokens"]
        pdf["bin_used"] = pdf.groupby("bin_id")["n_tokens"].transform("sum")
        pdf["bin_size"] = np.asarray(final)[b]
        return pdf.drop(columns=["row", "shard"])

    return dealt.groupBy("shard").applyInPandas(
        run, f"doc_id {kind}, piece int, start long, n_tokens long, bin_id long, "
             "bin_offset long, bin_used long, bin_size long")
