"""Tool-call linking: calls and results joined by identifier, put in dependency
order, checked against argument schemas and written as canonical JSON.

``calls(conv_id, call_id, seq, name, arguments, parent)``: arguments is JSON
text; parent names the call of the same conversation whose result this call
uses, or is null. ``results(conv_id, call_id, seq, content)``. Everything is
keyed by (conv_id, call_id), so one very long conversation is many rows of many
tasks; depth in the parent chain is found by pointer doubling, in rounds that
grow with the logarithm of the longest chain.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import with_ordinal
from .store import stored

KEY = ["conv_id", "call_id"]
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool,
          "object": dict, "array": list, "null": type(None)}


def canonical(value) -> str:
    """JSON text with sorted keys, no white space and no escapes but the needed."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _finite(text: str) -> float:
    x = float(text)
    if x in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return x


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def read_json(text: str):
    """The value of a JSON text; ValueError for what is none: NaN and infinities,
    numbers out of range, and nesting beyond what can be read and written."""
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_no_constant)
        canonical(value)
        return value
    except RecursionError:
        raise ValueError("nested too deeply") from None


def check_schema(schema: dict) -> None:
    """ValueError for a schema with a type that JSON does not have."""
    want = schema.get("type", [])
    for t in [want] if isinstance(want, str) else want:
        if t not in _TYPES:
            raise ValueError(f"unknown type in a schema: {t}")
    for part in [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else [])]:
        check_schema(part)


def _is_a(value, name: str) -> bool:
    return isinstance(value, _TYPES[name]) and not (isinstance(value, bool) and name in ("integer", "number"))


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON schema (type, one or a list, enum, bounds, lengths, items, properties,
    required, additionalProperties) a value breaks, in a fixed order."""
    want = schema.get("type")
    names = [want] if isinstance(want, str) else list(want or ())
    if names and not any(_is_a(value, t) for t in names):
        return [f"{at}: not of type {' or '.join(names)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not an allowed value")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: below minimum"] * (value < schema.get("minimum", value))
        out += [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0))
        out += [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", ())) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
    return out


def _hashed(df: DataFrame) -> DataFrame:
    """The build side of a hash join: a key has one row, so no partition is much
    larger than its share of the keys."""
    return df.hint("shuffle_hash")


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): parents above each call; a parent that is not
    there counts as none; null on a cycle and below one."""
    ids = calls.select("conv_id", F.col("call_id").alias("parent")).withColumn("there", F.lit(True))
    state = stored(calls.select(*KEY, "parent").join(_hashed(ids), ["conv_id", "parent"], "left").select(
        *KEY, F.when(F.col("there"), F.col("parent")).alias("up"),
        F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth")), "depths")
    total, open_ = state.count(), state.where("up is not null").count()
    reach = 1
    while open_ and reach <= total:
        # identifiers may recur in other conversations
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"),
                             F.col("depth").alias("d2"))
        climbing = state.where("up is not null").join(_hashed(above), ["conv_id", "up"]).select(
            *KEY, F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"))
        state = stored(state.where("up is null").unionByName(climbing), "depths")
        open_ = state.where("up is not null").count()
        reach *= 2
    return state.select(*KEY, F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def _firsts(df: DataFrame, prefix: str) -> DataFrame:
    """The earliest row of each key (ties by all fields) and how many there are."""
    rest = [c for c in df.columns if c not in KEY]
    row = F.struct(*rest)
    return df.groupBy(*KEY).agg(F.min(row).alias("_r"), F.count("*").alias(f"{prefix}n")).select(
        *KEY, *[F.col(f"_r.{c}").alias(f"{prefix}{c}") for c in rest], f"{prefix}n")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per (conv_id, call_id) of either side: position (dependency order
    in the conversation: depth, then seq, then call_id), depth, status, valid,
    errors and record.

    status: linked, no_result, no_call, or early_result (the result's seq is not
    after the call's). record is canonical JSON of id, name, arguments, result
    and status. valid is true for a call whose name has a schema that its
    arguments meet; unknown names, arguments that are no JSON (NaN, infinities and
    bottomless nesting too; they stay text) and cycles are errors of their row. A
    schema with an unknown type raises here, before anything runs.
    Of repeated identifiers the earliest row counts and "repeated" is an error.
    Null conv_id or call_id match nothing and are left out; null seq sorts
    first; null arguments are an empty object; null content is JSON null. Empty
    tables give an empty result; other columns are ignored.
    """
    for schema in schemas.values():
        check_schema(schema)
    calls = calls.select(*KEY, "seq", "name", "arguments", "parent").dropna(subset=KEY)
    results = results.select(*KEY, "seq", "content").dropna(subset=KEY)
    c, r = stored(_firsts(calls, "c_"), "calls"), _firsts(results, "r_")
    depth = depths(c.withColumnRenamed("c_parent", "parent"))
    both = (c.join(_hashed(r), KEY, "full_outer").join(_hashed(depth), KEY, "left")
            .withColumn("status", F.when(F.col("c_n").isNull(), "no_call")
                        .when(F.col("r_n").isNull(), "no_result")
                        .when(F.col("r_seq") <= F.col("c_seq"), "early_result").otherwise("linked"))
            .withColumn("seq", F.coalesce("c_seq", "r_seq")))
    # calls on a cycle have no depth and come last
    placed = with_ordinal(both.withColumn("_d", F.coalesce("depth", F.lit(2 ** 62))),
                          ["conv_id", "_d", "seq", "call_id"])
    first = placed.groupBy("conv_id").agg(F.min("_ord").alias("_first"))
    rows = placed.join(_hashed(first), "conv_id").withColumn("position", F.col("_ord") - F.col("_first"))

    def run(frames: Iterator[pd.DataFrame]):
        for pdf in frames:
            valid, errors, records = [], [], []
            for x in pdf.itertuples(index=False):
                bad, arguments, name = [], None, None
                if x.status != "no_call":
                    name = x.c_name
                    try:
                        arguments = read_json(x.c_arguments) if x.c_arguments is not None else {}
                        if name in schemas:
                            bad += violations(arguments, schemas[name])
                        else:
                            bad.append("no schema for this name")
                    except ValueError:
                        arguments = x.c_arguments
                        bad.append("arguments are not JSON")
                    if pd.isna(x.depth):
                        bad.append("cycle")
                if (x.c_n or 0) > 1 or (x.r_n or 0) > 1:
                    bad.append("repeated")
                valid.append(x.status != "no_call" and not bad)
                errors.append(bad)
                records.append(canonical({"id": x.call_id, "name": name, "arguments": arguments,
                                          "result": x.r_content, "status": x.status}))
            yield pdf[["conv_id", "call_id", "position", "depth", "status"]].assign(
                valid=valid, errors=errors, record=records)

    kind = calls.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "call_id", "position", "depth", "status", "c_name", "c_arguments",
                       "c_n", "r_n", "r_content").mapInPandas(
        run, f"conv_id {kind}, call_id string, position long, depth long, status string, "
             "valid boolean, errors array<string>, record string")
