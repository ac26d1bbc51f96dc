"""Merkle manifest of a dataset by butterfly exchange.

Every row is a leaf: H (lowercase hex sha256 over the concatenated inputs) of its
fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value. Leaves
of a group are ordered; while more than one node remains, every ``FANOUT``
consecutive ones (the last run may be shorter) become the H of their digests. The
groups' roots, ordered by group, become the dataset's root in the same way.

The leaves of a group are cut into aligned blocks of ``FANOUT ** BLOCK_LEVELS``,
however large the group is. A block hashes its own subtree. Then aligned groups of
``FANOUT`` blocks (next: of blocks at a distance of ``FANOUT``, and so on) swap the
roots of what they hold: in each round a block sends its digest to the blocks of
the same lane in the other parts of its group, and every receiver hashes the same
ancestor for itself and keeps the digests it met as its upper proof. After
log(blocks) rounds each block holds its whole way to the group's root; nothing is
handed down. Where the last part of a group has fewer blocks than lanes, its
blocks take turns to serve the lanes that it lacks. A round moves at most
``FANOUT`` digests a block and is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import attach_row
from ..operators.sequence import with_ordinal
from .store import stored

FANOUT = 8
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: one proof step: digests before and after the own one in its run
STEP = "struct<before:string,after:string>"


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """A value as it enters the hash: ``-`` or byte count, ``:``, value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def local_proofs(leaves: Sequence[str], levels: int, whole: bool, fanout: int = FANOUT):
    """Root of a block and, for every leaf, its proof steps inside the block. A
    block that is its whole tree stops where one node remains; any other block
    is one of several and has all ``levels``."""
    level = list(leaves)
    own: list[list[tuple[str, str]]] = [[] for _ in leaves]
    width = 1
    for _ in range(levels):
        if whole and len(level) == 1:
            break
        up = []
        for lo in range(0, len(level), fanout):
            run = level[lo:lo + fanout]
            for k in range(len(run)):
                step = ("".join(run[:k]), "".join(run[k + 1:]))
                first = (lo + k) * width
                for i in range(first, min(first + width, len(leaves))):
                    own[i].append(step)
            up.append(digest(run))
        level = up
        width *= fanout
    return level[0], own


def _swap(state: DataFrame, stride: int, fanout: int) -> DataFrame:
    """One butterfly round over ``(gid, blk, blocks, node, upper)``: parts of
    ``stride`` blocks, ``fanout`` parts a group. Trees with one node left rest."""
    block, n = F.col("blk"), F.col("blocks")
    part = F.floor(block / stride).cast("long")
    lane = F.pmod(block, F.lit(stride))
    group = F.floor(part / fanout).cast("long")
    width = F.least(F.lit(stride), n - part * stride)          # blocks of the own part
    parts = F.least(F.lit(fanout), F.ceil(n / stride).cast("long") - group * fanout)
    to = (state.where(n > stride)
          .select("gid", "blk", "node", "blocks", part.alias("_part"), group.alias("_group"),
                  lane.alias("_lane"), width.alias("_width"), parts.alias("_parts"))
          .withColumn("_to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
          # the own lane and, in a short part, the lanes it lacks: lane, lane + width, ...
          .withColumn("_lane2", F.explode(F.sequence(
              F.col("_lane"), F.lit(stride - 1).cast("long"), F.col("_width"))))
          .withColumn("target", (F.col("_group") * fanout + F.col("_to")) * stride + F.col("_lane2"))
          .where(F.col("target") < F.col("blocks")))
    got = to.groupBy("gid", F.col("target").alias("blk")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_part").alias("p"), "node"))).alias("_met"))
    mine = F.floor(F.col("blk") / stride).cast("long")
    joined = state.join(got, ["gid", "blk"], "left")
    met = F.col("_met")

    def side(keep):
        return F.array_join(F.transform(F.filter(met, keep), lambda x: x["node"]), "")
    step = F.struct(side(lambda x: x["p"] < mine).alias("before"),
                    side(lambda x: x["p"] > mine).alias("after"))
    return joined.select(
        "gid", "blk", "blocks",
        F.when(met.isNull(), F.col("node")).otherwise(
            F.sha2(F.array_join(F.transform(met, lambda x: x["node"]), ""), 256)).alias("node"),
        F.when(met.isNull(), F.col("upper")).otherwise(
            F.concat("upper", F.array(step))).alias("upper"))


def exchange(leaves: DataFrame, levels: int = BLOCK_LEVELS, fanout: int = FANOUT) -> DataFrame:
    """``leaves(gid, pos, n, leaf)`` -> blocks ``(gid, blk, blocks, node, upper)``:
    gid is a non-null tree number, pos counts from 0 in each tree of n leaves,
    node is the tree's root and upper the steps from the block to it."""
    size = fanout ** levels

    def roots(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        gid, n = table["gid"][0].as_py(), table["n"][0].as_py()
        root, _ = local_proofs(table["leaf"].to_pylist(), levels, n <= size, fanout)
        return pa.table({"gid": pa.array([gid], pa.int64()), "blk": table["blk"].slice(0, 1),
                         "blocks": pa.array([-(-n // size)], pa.int64()), "node": [root]})
    blocks = _in_blocks(leaves, size).select("gid", "blk", "pos", "n", "leaf").groupBy("gid", "blk") \
        .applyInArrow(roots, "gid long, blk long, blocks long, node string")
    state = stored(blocks.withColumn("upper", F.array().cast(f"array<{STEP}>")), "merkle-blocks")
    stride, most = 1, state.agg(F.max("blocks")).first()[0] or 0
    while stride < most:
        state = stored(_swap(state, stride, fanout), "merkle-round")
        stride *= fanout
    return state


def _in_blocks(leaves: DataFrame, size: int) -> DataFrame:
    return leaves.withColumn("blk", F.floor(F.col("pos") / size).cast("long"))


def prove(leaves: DataFrame, blocks: DataFrame, carry: Sequence[str] = (),
          levels: int = BLOCK_LEVELS, fanout: int = FANOUT) -> DataFrame:
    """The columns of ``leaves``, the block's string columns ``carry`` and proof:
    the steps inside the leaf's block, then those of ``blocks(gid, blk, upper)``.
    They meet block by block, so proofs, the widest column, are never shuffled."""
    size = fanout ** levels
    schema = T.StructType(list(leaves.schema.fields))
    for c in carry:
        schema = schema.add(c, "string")
    schema = schema.add(
        "proof", T.ArrayType(T.StructType().add("before", "string").add("after", "string")))
    names = leaves.columns

    def run(table: pa.Table, block: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        _, own = local_proofs(table["leaf"].to_pylist(), levels, table["n"][0].as_py() <= size, fanout)
        upper = [(u["before"], u["after"]) for u in block["upper"][0].as_py()]
        steps = [step for steps in own for step in (*steps, *upper)]
        bounds = np.concatenate([[0], np.cumsum([len(steps) + len(upper) for steps in own])])
        proof = pa.ListArray.from_arrays(
            pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(
                [pa.array([a for a, _ in steps], pa.string()),
                 pa.array([b for _, b in steps], pa.string())], ["before", "after"]))
        out = table.select(names)
        for c in carry:
            out = out.append_column(c, pa.array([block[c][0].as_py()] * len(out), pa.string()))
        return out.append_column("proof", proof)
    return _in_blocks(leaves, size).groupBy("gid", "blk").cogroup(
        blocks.select("gid", "blk", "upper", *carry).groupBy("gid", "blk")).applyInArrow(run, schema)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof in order, as one string."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(rows: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang",
             order: str = "doc_id", also: dict[str, Column] | None = None,
             levels: int = BLOCK_LEVELS, fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``rows``: ``order``, ``group``, pos (in the group),
    leaf, subroot, root and proof (steps from the leaf over the group's root to
    the dataset's), plus the columns of ``also``, computed from the rows.

    Rows are ordered by ``order`` inside a group and by their digest where that
    is equal, so repeated rows and null keys are leaves like others (nulls
    first); groups are ordered by name, null first, bytewise. Null and empty
    values give different leaves. An empty table gives an empty manifest; further
    columns are ignored.
    """
    also = also or {}
    # the text is hashed in one pass over the table; all else works on digests
    base = stored(rows.select(F.col(order).alias("_key"), F.col(group).alias("_group"),
                              leaf_hash([F.col(c) for c in fields]).alias("leaf"),
                              *[c.alias(f"_also_{k}") for k, c in also.items()]), "merkle-leaves")
    placed = with_ordinal(base, ["_group", "_key", "leaf"], "_at")
    groups = placed.groupBy("_group").agg(F.min("_at").alias("gid"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups, "merkle-groups")          # the first place is the tree's number
    g = groups.withColumnRenamed("_group", "_g")
    leaves = placed.join(g, F.col("_group").eqNullSafe(F.col("_g"))).select(
        "gid", (F.col("_at") - F.col("gid")).alias("pos"), "n", "leaf", "_key",
        F.col("_g").alias("_group"), *[f"_also_{k}" for k in also])
    leaves = stored(leaves, "merkle-placed")
    blocks = exchange(leaves, levels, fanout)
    # the groups' roots are the leaves of one more tree, in the groups' order
    top = with_ordinal(blocks.where("blk = 0").select(F.col("gid").alias("tree"), "node"), ["tree"], "pos")
    top = stored(top.select(F.lit(0).cast("long").alias("gid"), "pos", F.lit(groups.count()).cast("long").alias("n"),
                            F.col("node").alias("leaf"), "tree"), "merkle-roots")
    above = exchange(top, levels, fanout)
    root = above.where("blk = 0").select(F.col("node").alias("root"))    # one row: one tree
    tops = prove(top, above, (), levels, fanout).select(
        F.col("tree").alias("gid"), F.col("leaf").alias("subroot"), F.col("proof").alias("_top"))
    whole = stored(attach_row(blocks.join(tops, "gid").select(
        "gid", "blk", "subroot", F.concat("upper", "_top").alias("upper")), root), "merkle-proofs")
    out = prove(leaves, whole, ("subroot", "root"), levels, fanout)
    return out.select(F.col("_key").alias(order), F.col("_group").alias(group), "pos", "leaf",
                      "subroot", "root", "proof", *[F.col(f"_also_{k}").alias(k) for k in also])
