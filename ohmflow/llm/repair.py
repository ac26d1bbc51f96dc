"""Least-cost repair of conversations by Hirschberg's divide and conquer.

A valid conversation reads ``(s?(ua)+)?`` in role initials: nothing, or an optional
system row and then user and assistant in turn. Four states tell what may follow:
0 nothing yet, 1 after system, 2 after user, 3 after assistant; 0 and 3 may end.
Rows are kept (0), given the role the state asks for (1) or deleted (2: a must for
blank and repeated rows); an empty row may be inserted anywhere (5); a truncated
row that stays costs 5 more. The audit is the initials of the edits, K, R, D and
I; of the cheapest repairs the one with the ASCII-least audit is taken.

A run of rows is known by a 4 x 4 table of costs from state to state and, for each
start, the order of the four audits. A piece of a repair ends with a row's own
edit, never with an insertion, so no audit of a run is a prefix of another of the
same run, and least parts make least wholes. Cost vectors that run forward from the
start and backward from the end meet in the middle; of the states with the least
sum the one with the least audit so far is crossed, and both halves are solved in
the same way: only vectors and the crossed states are held.

Rows are numbered over the whole table by (conversation, turn, role, text) and
cut into chunks of ``CHUNK`` rows, so a conversation of any length is many tasks.
Each chunk gives one table per conversation in it. Those of long conversations are
merged ``FAN`` at a time, level by level, and the same divide and conquer hands the
crossed states down again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequence import with_blocks, with_ordinal
from .store import stored

CHUNK = 4096
FAN = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NO = 1 << 60                                        # no way
BLANK = " \t\n\x0b\x0c\r"
STATES = range(4)
#: state -> (initial it asks for, state after it); state 0 also takes s
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
ROLES = {"u": "user", "a": "assistant"}
#: insertions that lead from a state to an end
CLOSING = ("", "II", "I", "")


class Run(NamedTuple):
    """A run of rows: least costs from state to state and, per start, the place of
    each end's audit among the four."""
    cost: tuple
    order: tuple


@lru_cache(maxsize=None)
def row_edits(initial: str, fault: str) -> dict:
    """{(from, to): (cost, edits)} for one row: insertions before it and its edit."""
    best: dict = {}
    for a in STATES:
        state, before, paid = a, "", 0
        for _ in range(3):
            tries = [("D", state, DELETE)]
            if fault not in ("blank", "duplicate"):
                extra = TRUNCATED if fault == "truncated" else 0
                ask, then = NEXT[state]
                if initial == ask:
                    tries.append(("K", then, KEEP + extra))
                elif initial == "s" and state == 0:
                    tries.append(("K", 1, KEEP + extra))
                tries.append(("R", then, REROLE + extra))
            for edit, b, cost in tries:
                found = (paid + cost, before + edit)
                if (a, b) not in best or found < best[a, b]:
                    best[a, b] = found
            state, before, paid = NEXT[state][1], before + "I", paid + INSERT
    return best


@lru_cache(maxsize=None)
def row_run(initial: str, fault: str) -> Run:
    best = row_edits(initial, fault)
    cost = tuple(tuple(best[a, b][0] if (a, b) in best else NO for b in STATES) for a in STATES)
    order = []
    for a in STATES:
        audits = sorted((best[a, b][1], b) for b in STATES if (a, b) in best)
        place = {b: i for i, (_, b) in enumerate(audits)}
        order.append(tuple(place.get(b, 4) for b in STATES))
    return Run(cost, tuple(order))


@lru_cache(maxsize=200_000)
def _forward(costs: tuple, places: tuple, run: Run) -> tuple[tuple, tuple, int]:
    """One step of the forward vector: costs from 0 on and the order of the audits;
    the third value is to be added to the costs."""
    out, source = [NO] * 4, [(9, 9)] * 4
    for b in STATES:
        found = min((costs[a] + run.cost[a][b], places[a], run.order[a][b]) for a in STATES)
        if found[0] < NO:
            out[b], source[b] = found[0], found[1:]
    low = min(out)
    ranked = sorted(source)
    return (tuple(min(c - low, NO) if c < NO else NO for c in out),
            tuple(ranked.index(s) if out[b] < NO else 4 for b, s in enumerate(source)), low)


@lru_cache(maxsize=200_000)
def _backward(costs: tuple, run: Run) -> tuple:
    """One step of the backward vector, its least value taken off."""
    out = [min(run.cost[a][b] + costs[b] for b in STATES) for a in STATES]
    low = min(out)
    return tuple(c - low if c < NO else NO for c in out)


def _start(state: int) -> tuple[tuple, tuple]:
    return (tuple(0 if s == state else NO for s in STATES), tuple(0 if s == state else 4 for s in STATES))


def ending(state: int | None) -> tuple:
    """Cost vector at the end of a run: of closing a conversation, or of a given state."""
    if state is None:
        return tuple(len(x) * INSERT if s in (0, 3) or x else NO for s, x in enumerate(CLOSING))
    return _start(state)[0]


def merged(runs: Sequence[Run]) -> Run:
    """The table of several runs in a row."""
    cost, order = [], []
    for a in STATES:
        costs, places = _start(a)
        total = 0
        for run in runs:
            costs, places, low = _forward(costs, places, run)
            total += low
        cost.append(tuple(c + total if c < NO else NO for c in costs))
        order.append(places)
    return Run(tuple(cost), tuple(order))


def crossings(runs: Sequence[Run], start: int, end: int | None) -> list[int]:
    """The state after each run on the audit-least of the cheapest ways from
    ``start`` to ``end`` (None: a closed conversation), in linear space."""
    out = [0] * len(runs)
    todo = [(0, len(runs), start, ending(end))]
    while todo:
        lo, hi, a, last = todo.pop()
        if lo == hi:
            continue
        mid = (lo + hi + 1) // 2
        costs, places = _start(a)
        for run in runs[lo:mid]:
            costs, places, _ = _forward(costs, places, run)
        rest = last
        for run in reversed(runs[mid:hi]):
            rest = _backward(rest, run)
        state = min(STATES, key=lambda s: (costs[s] + rest[s], places[s]))
        out[mid - 1] = state
        if hi - lo > 1:
            todo.append((mid, hi, state, last))
            if mid - lo > 1:
                # the row at mid - 1 is solved by its half's own crossing
                todo.append((lo, mid - 1, a, _backward(_start(state)[0], runs[mid - 1])))
    return out


def roles_of(edits: str, state: int) -> str:
    """The role initial that each inserted or renamed row takes, else ``-``; edits
    are those of one row, from the state before it."""
    out = []
    for edit in edits:
        ask, then = NEXT[state]
        out.append(ask if edit in "IR" else "-")
        if edit == "I":
            state = then
    return "".join(out)


def repair_rows(rows: Sequence[tuple[str, str]], start: int = 0, end: int | None = None) -> list[tuple[str, str]]:
    """(edits, roles) of each (initial, fault) row: the insertions before it and its
    own edit; one more entry holds the insertions after the last row."""
    states = [start, *crossings([row_run(*r) for r in rows], start, end)]
    out = [row_edits(*r)[a, b][1] for r, a, b in zip(rows, states, states[1:])]
    if end is None:
        out.append(CLOSING[states[-1]])
    else:
        out.append("")
    return [(e, roles_of(e, a)) for e, a in zip(out, states)]


def damage(conversations: DataFrame) -> DataFrame:
    """Rows after a damage that ``crc32("conv_id:turn") % 20`` decides (nulls are
    one space): 0 drops a row, 1 empties its text, 2 takes its ``.!?`` out, 3
    repeats it, 4 makes it a user row. A null role or text becomes one space."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))

    def part(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    return (conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind"))
            .where("_kind <> 0")
            .select("conv_id", "turn",
                    F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1)))
                              .otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy"))


def conversation_key(c: Column) -> Column:
    """A conversation's id as a string that is never null."""
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), c.cast("string")))


def numbered_rows(conversations: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The rows with their place in the table (conversations one after the other),
    key, initial and fault; and the same rows without role and text, but with their
    chunk (part) and ``illegal``: whether the row may not follow the one before it."""
    rows = conversations.select(conversation_key(F.col("conv_id")).alias("key"), "conv_id", "turn",
                                F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"))
    placed = with_ordinal(rows, ["key", "turn", "role", "text"], "at")
    # the first of equal rows; all are found by partial aggregates, however many
    first = placed.groupBy("key", "role", F.sha2("text", 256).alias("_h")).agg(F.min("at").alias("at")) \
        .select("at", F.lit(True).alias("_first"))
    rest = F.rtrim(F.col("text"), F.lit(BLANK))
    marked = placed.join(first, "at", "left").select(
        "at", "key", "conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"),
        F.when(rest == "", "blank").when(F.col("_first").isNull(), "duplicate")
        .when(~F.substring(rest, -1, 1).isin(".", "!", "?"), "truncated").otherwise("").alias("fault"))
    marked = stored(marked, "repair-rows")
    near = Window.partitionBy("_blk").orderBy("at")
    pair = F.concat(F.lag("initial").over(near), F.col("initial"))
    follows = F.lag("key").over(near) == F.col("key")
    halo = with_blocks(marked.drop("role", "text"), "at", chunk, 1, 0)
    codes = halo.withColumn("illegal", F.coalesce(follows & ~pair.isin("su", "ua", "au"), F.lit(False)))
    return marked, stored(codes.where("_halo = 0").drop("_halo").withColumnRenamed("_blk", "part"), "repair-codes")


_RUN = "cost array<long>, ranks array<int>"


def _flat(run: Run) -> tuple[list, list]:
    return [c for row in run.cost for c in row], [c for row in run.order for c in row]


def _unflat(cost, ranks) -> Run:
    return Run(tuple(tuple(int(x) for x in cost[k:k + 4]) for k in range(0, 16, 4)),
               tuple(tuple(int(x) for x in ranks[k:k + 4]) for k in range(0, 16, 4)))


def _summary(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "part", "cost", "ranks"])


def _by_key(pdf: pd.DataFrame) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(key, [(initial, fault), ...]) of each conversation of a chunk, in order."""
    rows = zip(pdf["key"], pdf["initial"], pdf["fault"])
    for key, group in groupby(rows, key=lambda r: r[0]):
        yield key, [(i, f) for _, i, f in group]


def _chunk_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("at", kind="stable")
    return _summary([(key, pdf["part"].iloc[0], *_flat(merged([row_run(*r) for r in rows])))
                     for key, rows in _by_key(pdf)])


def _merge_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("part", kind="stable")
    runs = [_unflat(c, r) for c, r in zip(pdf["cost"], pdf["ranks"])]
    return _summary([(pdf["key"].iloc[0], pdf["_up"].iloc[0], *_flat(merged(runs)))])


def _hand_down(runs: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """Start and end state of every part of one merged run (end -1: closed)."""
    runs = runs.sort_values("part", kind="stable")
    a, z = int(above["start"].iloc[0]), int(above["end"].iloc[0])
    states = crossings([_unflat(c, r) for c, r in zip(runs["cost"], runs["ranks"])], a, None if z < 0 else z)
    ends = states[:-1] + [z if z >= 0 else -1]
    return pd.DataFrame({"key": runs["key"], "part": runs["part"], "start": [a, *states[:-1]], "end": ends})


def _chunk_edits(rows: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
    """Edits and roles of the rows of a chunk; insertions that close a conversation
    stand after the edit of its last row."""
    rows = rows.sort_values("at", kind="stable")
    way = {k: (int(a), int(z)) for k, a, z in zip(ways["key"], ways["start"], ways["end"])}
    edits, roles = [], []
    for key, group in _by_key(rows):
        a, z = way.get(key, (0, -1))
        *found, (more, more_roles) = repair_rows(group, a, None if z < 0 else z)
        edits += [e for e, _ in found]
        roles += [r for _, r in found]
        edits[-1] += more
        roles[-1] += more_roles
    return pd.DataFrame({"at": rows["at"], "edits": edits, "roles": roles})


def _ways(codes: DataFrame, fan: int) -> DataFrame:
    """(key, part, start, end) for every part of the conversations that lie in more
    than one chunk; all others run from 0 to a close inside their chunk."""
    spread = codes.groupBy("key").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi")) \
        .where("_lo < _hi").select("key")
    level = stored(codes.join(spread, "key", "left_semi").groupBy("part").applyInPandas(
        _chunk_runs, f"key string, part long, {_RUN}"), "repair-runs")
    levels = [level]
    up = F.floor(F.col("part") / fan).cast("long")
    while not level.groupBy("key").count().where("count > 1").isEmpty():
        level = stored(level.withColumn("_up", up).groupBy("key", "_up").applyInPandas(
            _merge_runs, f"key string, part long, {_RUN}"), "repair-runs")
        levels.append(level)
    ways = levels[-1].select("key", "part", F.lit(0).alias("start"), F.lit(-1).alias("end"))
    for level in reversed(levels[:-1]):
        ways = stored(level.withColumn("_up", up).groupBy("key", "_up").cogroup(
            ways.withColumnRenamed("part", "_up").groupBy("key", "_up")).applyInPandas(
            _hand_down, "key string, part long, start int, end int"), "repair-ways")
    return ways


def repair(conversations: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(edits, rows) of ``conversations(conv_id, turn, role, text)``.

    ``edits``, one row an edit: key, conv_id, at and step (the order: of rows, then
    inside one), edit (K, R, D or I), fault, cost, and role and text of the row as
    it stands after the edit (null where deleted). ``rows``, one row an input row:
    at, key, conv_id, turn, initial, fault, illegal.

    Rows of a conversation go by turn, nulls first, then by role and text, so equal
    turns have a defined order and repeated rows stand together. A null conv_id is
    a conversation; a null role or text is one space. A conversation of one long
    text or of very many rows is repaired like others. An empty table gives empty
    results; other columns are ignored.
    """
    marked, codes = numbered_rows(conversations, chunk)
    ways = _ways(codes, fan)
    found = codes.select("part", "at", "key", "initial", "fault").groupBy("part").cogroup(
        ways.groupBy("part")).applyInPandas(_chunk_edits, "at long, edits string, roles string")
    each = marked.join(found, "at").select(
        "key", "conv_id", "at", F.posexplode(F.arrays_zip(
            F.regexp_extract_all("edits", F.lit("."), F.lit(0)).alias("edit"),
            F.regexp_extract_all("roles", F.lit("."), F.lit(0)).alias("ask"))).alias("step", "e"),
        F.col("role").alias("_role"), F.col("text").alias("_text"), F.col("fault").alias("_fault"))
    edit, ask = F.col("e.edit"), F.col("e.ask")
    own = edit != "I"
    asked = F.when(ask == "u", F.lit(ROLES["u"])).when(ask == "a", F.lit(ROLES["a"]))
    price = F.when(edit == "K", KEEP).when(edit == "R", REROLE).when(edit == "D", DELETE).otherwise(INSERT)
    extra = F.when(own & (edit != "D") & (F.col("_fault") == "truncated"), TRUNCATED).otherwise(0)
    edits = each.select(
        "key", "conv_id", "at", "step", edit.alias("edit"), F.when(own, F.col("_fault")).alias("fault"),
        (price + extra).cast("long").alias("cost"),
        F.when(edit == "K", F.col("_role")).otherwise(asked).alias("role"),
        F.when(edit.isin("K", "R"), F.col("_text")).when(edit == "I", F.lit("")).alias("text"))
    return edits, codes.drop("part")


def digests(edits: DataFrame) -> DataFrame:
    """(key, cost, audit, repaired_sha256) of each conversation. A digest of a whole
    conversation can only be taken row after row: the sorted rows are streamed, so
    a long conversation takes time in one task, not memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"key": now, "cost": cost, "audit": bytes(audit).decode(),
                                                "repaired_sha256": sha.hexdigest()}], schema=schema)
        schema = pa.schema([("key", pa.string()), ("cost", pa.int64()), ("audit", pa.string()),
                            ("repaired_sha256", pa.string())])
        for batch in batches:
            ended = []
            for key, price, edit, line in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if key != now:
                    if now is not None:
                        ended.append(done())
                    now, cost, audit, sha, first = key, 0, bytearray(), hashlib.sha256(), True
                cost += price
                audit += edit.encode()
                if line is not None:
                    sha.update((line if first else "\n" + line).encode())
                    first = False
            if ended:
                yield pa.Table.from_batches(ended).combine_chunks().to_batches()[0]
        if now is not None:
            yield done()
    line = F.concat("role", F.lit(":"), "text")
    return (edits.repartition("key").sortWithinPartitions("key", "at", "step")
            .select("key", "cost", "edit", line.alias("line"))
            .mapInArrow(run, "key string, cost long, audit string, repaired_sha256 string"))


def report(original: DataFrame, conversations: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """One row per conv_id of ``original``: gaps, blank, duplicate, truncated and
    illegal of the rows in ``conversations``, and cost, audit and repaired_sha256 of
    their repair. A conversation without rows has zeros and an empty repair."""
    edits, rows = repair(conversations, chunk, fan)

    def faults(name):
        return F.count_if(F.col("fault") == name).alias(name)
    turn = F.col("turn").cast("long")
    counts = rows.groupBy("key").agg(
        (F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)).alias("gaps"), faults("blank"),
        faults("duplicate"), faults("truncated"), F.count_if("illegal").alias("illegal"))
    every = original.select(conversation_key(F.col("conv_id")).alias("key"), "conv_id").distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(counts, "key", "left").join(digests(edits), "key", "left").select(
        "conv_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
