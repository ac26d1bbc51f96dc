"""MinHash near-duplicate detection with tensored banding.

Two families of m small hash collections (``half`` minhashes each) are computed
per document: 2 * m * half minhashes. Table key (i, j) joins collection i of
the first family with collection j of the second, so m * m tables of 2 * half
minhashes each cost only the square root of the usual hashing. Keys are formed
only from collections whose value another document shares (a key cannot
collide otherwise), and every candidate is confirmed on full shingle sets.

Equal sets fold into one class first. Candidates whose own shingles alone break
the threshold are left out. Each other member of a bucket is compared with one
leader, the document of its buckets with the fewest shingles of its own; where a
bucket still spans several components, its members outside the largest one are
compared with all others that the shared counts and the distances to a common
leader allow. So every colliding pair is confirmed, ruled out by a bound, or
already connected, without emitting the pairs of a large group of copies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import SPACED, mix, numbered, slices, windows, words
from .links import components
from .store import stored

SHINGLE = 5
HALF = 3
MISS = 5e-4
SALTS = 256
CELLS = 64


def collections_for(percent: int, half: int = HALF, miss: float = MISS) -> int:
    """Collections per family so that a pair at the threshold is missed with a
    probability of at most ``miss`` over both families."""
    return math.ceil(math.log(miss / 2) / math.log(1 - (percent / 100) ** half))


def shingle_set(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    if len(h) == 0:
        return h
    return np.unique(windows(h, size) if len(h) >= size else windows(h, len(h)))


def _as_long(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _sets(batches, id_col: str, text_col: str):
    for batch in batches:
        ids, text = batch.column(id_col), batch.column(text_col)
        for lo, hi in slices(text):
            w = words(text.slice(lo, hi - lo), SPACED, lower=True)
            yield ids.slice(lo, hi - lo), [shingle_set(w.hash[a:b])
                                           for a, b in zip(w.first[:-1], w.first[1:])]


def signatures(docs: DataFrame, m: int, half: int = HALF, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, f1, f2, a, b): set size, 128-bit set fingerprint and
    the two families of collection hashes (empty for a document without words)."""
    mult = (numbered(11, 2 * m * half) | np.uint64(1))[:, None]
    add = numbered(12, 2 * m * half)[:, None]
    salt = numbered(13, 2 * m)

    def run(batches):
        for ids, sets in _sets(batches, id_col, text_col):
            n = np.array([len(s) for s in sets], np.int64)
            f1 = _as_long([s.sum(dtype=np.uint64) for s in sets])
            f2 = _as_long([mix(s + salt[0]).sum(dtype=np.uint64) for s in sets])
            fam = np.zeros((len(sets), 2 * m), np.uint64)
            for r, s in enumerate(sets):
                if len(s):
                    low = np.full(2 * m * half, np.iinfo(np.uint64).max, np.uint64)
                    for k in range(0, len(s), 4096):
                        np.minimum(low, mix(s[None, k:k + 4096] * mult + add).min(axis=1), out=low)
                    acc = salt.copy()
                    for c in range(half):
                        acc = mix(acc * np.uint64(31) + low[c::half])
                    fam[r] = acc
            has = (n > 0)[:, None]
            off = np.concatenate([[0], np.cumsum(np.where(n > 0, m, 0))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(
                _as_long(np.ascontiguousarray(f)[has[:, 0]].ravel()))) for f in (fam[:, :m], fam[:, m:])]
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(n), pa.array(f1), pa.array(f2), *lists],
                ["doc_id", "n_shingles", "f1", "f2", "a", "b"])

    return docs.select(id_col, text_col).mapInArrow(
        run, "doc_id long, n_shingles long, f1 long, f2 long, a array<long>, b array<long>")


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, grams): the full set of each document."""
    def run(batches):
        for ids, sets in _sets(batches, id_col, text_col):
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = _as_long(np.concatenate(sets) if sets else np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))],
                ["doc_id", "grams"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, grams array<long>")


def _collisions(reps: DataFrame) -> DataFrame:
    """(key, i, j, doc_id) of table buckets with two documents or more."""
    def tagged(side):
        return F.transform(side, lambda v, i: F.struct(F.lit(side).alias("s"), i.alias("i"),
                                                       v.alias("v")))
    halves = reps.select("doc_id", F.explode(F.concat(tagged("a"), tagged("b"))).alias("h")
                         ).select("doc_id", "h.*")
    shared = halves.groupBy("s", "i", "v").count().where("count > 1").drop("count")
    mine = (halves.join(shared, ["s", "i", "v"]).groupBy("doc_id")
            .agg(F.collect_list(F.struct("s", "i", "v")).alias("h")))    # at most 2 m entries

    def side(s):
        return F.explode(F.filter("h", lambda x: x["s"] == s))
    keys = (mine.withColumn("x", side("a")).withColumn("y", side("b"))
            .select(F.xxhash64("x.i", "y.i", "x.v", "y.v").alias("key"),
                    F.col("x.i").alias("i"), F.col("y.i").alias("j"), "doc_id"))
    keys = stored(keys, "keys")
    several = keys.groupBy("key").count().where("count > 1").drop("count")
    return stored(keys.join(several, "key"), "buckets")


def _linkable(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, s, cells): set size, how many of its shingles any other
    candidate has, and those by cell of the hash space. A document whose own
    shingles alone break the threshold has no link and is left out:
    J(x, y) <= s(x) / n(x)."""
    grams = sets.select("doc_id", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    common = grams.groupBy("g").count().where("count > 1").drop("count")
    cells = (grams.join(common, "g").groupBy("doc_id", "n", F.pmod("g", F.lit(CELLS)).alias("k"))
             .agg(F.count("*").cast("int").alias("c")))
    by = F.map_from_entries(F.collect_list(F.struct("k", "c")))     # at most CELLS entries
    return (cells.groupBy("doc_id", "n").agg(F.sum("c").alias("s"), by.alias("by"))
            .where(F.col("s") * 100 >= F.col("n") * percent)
            .select("doc_id", "n", "s", F.transform(
                F.sequence(F.lit(0), F.lit(CELLS - 1)),
                lambda k: F.coalesce(F.try_element_at("by", k.cast("long")), F.lit(0))).alias("cells")))


def _reachable(percent: int) -> Column:
    """Whether two rows (n, s, cells) and (n2, s2, cells2) can reach the threshold:
    their intersection is at most the smaller count of each cell, in sum."""
    most = F.aggregate(F.zip_with("cells", "cells2", lambda x, y: F.least(x, y)), F.lit(0),
                       lambda t, x: t + x)
    least = F.least("s", "s2")

    def enough(k):
        return k * 100 >= (F.col("n") + F.col("n2") - k) * percent
    return F.when(enough(least), enough(most)).otherwise(F.lit(False))


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` with their Jaccard distance d over full sets, and linked.
    Side a is copied to salted keys, so a document that is in very many pairs is
    spread over up to SALTS tasks; a copy is made only where a pair uses it."""
    p = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    left = (p.select("a", "salt").distinct()
            .join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), "a"))
    both = (p.join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb")), "b")
            .join(left, ["a", "salt"])
            .select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("both"),
                    (F.size("ga") + F.size("gb")).alias("sum")))
    union = F.col("sum") - F.col("both")
    return both.select("a", "b", (1 - F.col("both") / union).alias("d"),
                       (F.col("both") * 100 >= union * percent).alias("linked"))


def near_duplicates(docs: DataFrame, percent: int = 85, half: int = HALF,
                    miss: float = MISS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents with 100 * |intersection| >= percent * |union| of their distinct
    5-word shingle sets (A-Z lower-cased) are linked; component_id is the
    smallest doc_id reachable. Fewer than five words form one shingle. Null or
    wordless texts are linked with nothing. Rows that repeat a doc_id are
    judged each by its own text. A null doc_id is kept, unlinked, with a null
    component. An empty table gives an empty result;
    other columns of ``docs`` are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sig = stored(signatures(docs, collections_for(percent, half, miss), half), "signatures")
    full = sig.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("f1", "f2", "n_shingles")
                     .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = (full.join(classes.select(F.col("rep").alias("doc_id"), "f1", "f2", "n_shingles"),
                      ["doc_id", "f1", "f2", "n_shingles"], "left_semi")
            .dropDuplicates(["doc_id", "f1", "f2"]))
    buckets = _collisions(reps)
    wanted = buckets.select("doc_id").distinct()
    sets = stored(shingle_sets(docs.join(wanted, "doc_id", "left_semi")).distinct(), "sets")
    facts = stored(_linkable(sets, percent), "facts")
    members = stored(buckets.join(facts.drop("cells"), "doc_id"), "members")

    # first each member with one leader: of its buckets, the document least of
    # whose shingles are its own
    rank = F.struct((F.col("s") * 1_000_000 / F.col("n")).cast("long"), -F.col("doc_id"))
    lead = members.groupBy("key").agg(F.max_by("doc_id", rank).alias("lead"),
                                      F.max(rank).alias("r"), F.count("*").alias("c"))
    led = (members.join(lead.where("c > 1"), "key").groupBy(F.col("doc_id").alias("b"))
           .agg(F.max_by("lead", "r").alias("a")).where("a <> b"))
    tested = stored(compare(led.select("a", "b"), sets, percent), "tested")
    edges = tested.where("linked").select("a", "b")
    comp = stored(components(edges), "components")

    # then what is left in buckets that still span several components
    placed = members.join(comp, F.col("doc_id") == F.col("node"), "left").withColumn(
        "comp", F.coalesce("component", "doc_id")).drop("node", "component")
    placed = placed.join(tested.select(F.col("b").alias("doc_id"), F.col("a").alias("pivot"), "d"),
                         "doc_id", "left").withColumn("pivot", F.coalesce("pivot", "doc_id")
                                                      ).withColumn("d", F.coalesce("d", F.lit(0.0)))
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = parts.groupBy("key").agg(F.max_by("comp", F.struct(F.col("c"), -F.col("comp")))
                                     .alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
    inside = stored(placed.join(mixed, "key").join(reps.select("doc_id", "a", "b"), "doc_id")
                    .join(facts.select("doc_id", "cells"), "doc_id"), "mixed")
    other = inside.select("key", F.col("doc_id").alias("doc2"), F.col("n").alias("n2"),
                          F.col("s").alias("s2"), F.col("comp").alias("comp2"),
                          F.col("cells").alias("cells2"),
                          F.col("pivot").alias("pivot2"), F.col("d").alias("d2"),
                          F.col("a").alias("a2"), F.col("b").alias("b2"))
    # Jaccard distance is a metric: two documents whose distances to one leader
    # differ by more than the threshold allows cannot be linked
    apart = (F.col("pivot") == F.col("pivot2")) & (
        F.abs(F.col("d") - F.col("d2")) > 1 - percent / 100 + 1e-9)
    # a pair counts only in the first bucket that it shares
    once = ("array_position(zip_with(a, a2, (x, y) -> x = y), true) = i + 1 and "
            "array_position(zip_with(b, b2, (x, y) -> x = y), true) = j + 1")
    rest = (inside.where("comp <> main").join(other, "key")
            .where("comp <> comp2 and (comp2 = main or doc_id < doc2)")
            .where(~apart).where(once).where(_reachable(percent))
            .select(F.least("doc_id", "doc2").alias("a"), F.greatest("doc_id", "doc2").alias("b"))
            .distinct())
    more = stored(compare(rest, sets, percent).where("linked").select("a", "b"), "links")
    if not more.isEmpty():
        comp = stored(components(edges.unionByName(more)), "components")

    rep_of = classes.where("copies > 1").select("f1", "f2", "n_shingles", "rep")
    out = (sig.select("doc_id", "n_shingles", "f1", "f2")
           .join(rep_of, ["f1", "f2", "n_shingles"], "left")
           .withColumn("rep", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(),
                                     F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
           .join(comp, F.col("rep") == F.col("node"), "left")
           .withColumn("component_id", F.coalesce("component", "rep")))
    return out.select("doc_id", "n_shingles", "component_id",
                      (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))
