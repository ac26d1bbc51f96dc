"""Token counts of whole texts, without token ids, offsets or strings.

Arrow functions encode texts in batches and return lengths only. A batch is closed
by its bytes, not by its rows, so memory inside a task is bounded by the batch and
by the longest text.

Texts are split where the sum of the parts' counts is the count of the whole. For
a byte-level BPE that is before a space or line feed that follows a character
which is never white space: its pre-tokeniser joins nothing across that place,
looks ahead only from inside white space, and added tokens hold no white space.
A long text is first cut into pieces there, then every piece into units (about a
word each); a unit that a task has met before is not encoded again. Text without
such places is one unit. All other tokenisers (lower-casing, sentence pieces,
prefix spaces, added tokens with white space or stripping) get whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 256 << 10
PIECE_BYTES = 64 << 10
LIMIT = 512

#: units that a task remembers, and the longest one it does
CACHE_UNITS = 400_000
CACHE_CHARS = 64

_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")
#: characters that some Unicode version counts as white space, but for space and line feed
_BLANK = "\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_UNITS = re.compile(f"[ \\n]*[^ \\n]+(?:(?<=[{_BLANK}])[ \\n]+[^ \\n]*)*|[ \\n]+")


def splits_exactly(spec: dict) -> bool:
    """Whether a tokeniser file describes a byte-level BPE that may be split."""
    pre = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and spec["model"]["type"] == "BPE"
            and spec["model"].get("dropout") is None
            and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                        for t in spec.get("added_tokens", [])))


def pieces(text: str, size: int = PIECE_BYTES) -> Iterator[str]:
    """The text in parts of at least ``size`` characters, cut at safe boundaries
    alone; their concatenation is the text."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def _counter(name: str, content: bytes) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(batch -> counts, whether texts may be split) of a tokeniser file."""
    if name.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        tok = Tokenizer.from_buffer(content)
        tok.no_truncation()
        tok.no_padding()
        encode = getattr(tok, "encode_batch_fast", tok.encode_batch)

        def count(batch: list[str]) -> list[int]:
            return [len(e) for e in encode(batch, add_special_tokens=False)]
        return count, splits_exactly(json.loads(content))
    if name.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda batch: [len(ids) for ids in sp.encode(batch, num_threads=1)], False
    raise ValueError(f"not a tokeniser file (.json or .model): {name}")


class _Units:
    """Counts of texts as sums over their units; new units are encoded together."""

    def __init__(self, count: Callable[[list[str]], list[int]], batch_bytes: int):
        self.count, self.batch_bytes = count, batch_bytes
        self.known: dict[str, int] = {}

    def __call__(self, batch: list[str]) -> list[int]:
        if len(self.known) > CACHE_UNITS:
            self.known.clear()
        parts = [_UNITS.findall(text) for text in batch]
        new = list(set().union(*parts).difference(self.known))
        once = {}
        for lo, hi in _by_bytes(new, self.batch_bytes):
            for unit, n in zip(new[lo:hi], self.count(new[lo:hi])):
                (self.known if len(unit) <= CACHE_CHARS else once)[unit] = n
        if not once:
            return [sum(map(self.known.__getitem__, units)) for units in parts]
        both = {**self.known, **once}
        return [sum(map(both.__getitem__, units)) for units in parts]


_held: dict[tuple, tuple] = {}


def _worker_counter(name: str, content: bytes, batch_bytes: int):
    """The counter that a Python worker keeps for its later tasks: one file at a
    time, with the units met so far."""
    key = (name, hashlib.sha256(content).digest(), batch_bytes)
    if key not in _held:
        count, split = _counter(name, content)
        _held.clear()
        _held[key] = (_Units(count, batch_bytes) if split else count, split)
    return _held[key]


def _by_bytes(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` characters."""
    lo = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def count_texts(texts: Iterable[str], count: Callable[[list[str]], list[int]], split: bool,
                batch_bytes: int = BATCH_BYTES, piece: int = PIECE_BYTES) -> list[int]:
    """Counts of all texts, taken in batches of about ``batch_bytes``."""
    out: list[int] = []
    batch: list[str] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        for i, n in zip(owner, count(batch)):
            out[i] += n
        batch.clear()
        owner.clear()
    for i, text in enumerate(texts):
        out.append(0)
        for part in pieces(text, piece) if split else (text,):
            batch.append(part)
            owner.append(i)
            size += len(part)
            if size >= batch_bytes:
                flush()
                size = 0
    if batch:
        flush()
    return out


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT,
                 batch_bytes: int = BATCH_BYTES, piece: int = PIECE_BYTES) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) to
    every row in place of the text; the other columns stay, those of the same
    names are replaced.

    ``tokenizer`` is the path of a .json or .model file, read on the driver and
    sent once to the executors. No begin, end or other special tokens are added;
    their strings inside texts count as the library reads them by default. A null
    text is empty: 0 bytes, and the tokens of the empty text (0 for the
    byte-level BPE). Repeated rows are counted each; an empty table gives none.
    """
    with open(tokenizer, "rb") as f:
        content = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(content)     # one file of a few MB
    name = os.path.basename(tokenizer)
    added = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in docs.columns if c not in (*added, text)]
    schema = docs.select(*keep).withColumns(
        {"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, split = _worker_counter(name, sent.value, batch_bytes)
        for rows in batches:
            texts = rows.column(len(keep)).fill_null("").cast(pa.large_string())
            n = count_texts((t.as_py() for t in texts), count, split, batch_bytes, piece)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:len(keep)], pc.binary_length(texts).cast(pa.int64()),
                 pa.array(n, pa.int64())], [*keep, "n_bytes", "n_tokens"])

    counted = docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
