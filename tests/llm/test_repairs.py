"""Pages, archives, tool calls and dates that once took too long, too much memory
or one another's place."""

import io
import random
import re
import time
import zlib
from datetime import date, timedelta

import pytest

from ohmflow.llm import chat_format, html_diff, pii, warc

PARTS = ["<a '", "<a ", "<a'", "<a<", "<a \"'", "<div>", "</b>", "<li><div><span>", "<li></li>", "<!--", "<hr>"]


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("end", ["", ">", "</b>" * 100_000])
def test_long_pages_of_open_markup_are_read_in_linear_time(part, end):
    times = []
    for size in (100_000, 400_000):
        t0 = time.process_time()
        html_diff.lines_of(part * (size // len(part)) + end)
        times.append(time.process_time() - t0)
    assert times[1] < 10 * max(times[0], 0.1)


def plain_tag_end(page, at):
    """The ``>`` that ends a tag, by the plain rule, -1 if there is none."""
    while at < len(page):
        if page[at] == ">":
            return at
        if page[at] in "\"'":
            at = page.find(page[at], at + 1)
            if at < 0:
                return -1
        at += 1
    return -1


def test_tags_equal_the_plain_rule():
    r = random.Random(7)
    for _ in range(5000):
        page = "".join(r.choice(["<a", "<b ", "</c", ">", "'", '"', " ", "x", "<", "/"]) for _ in range(25))
        tags, at, got, want = html_diff._Tags(page), 0, [], []
        while tag := tags.after(at):
            got.append(tag[:2])
            at = tag[1]
        at = 0
        while m := re.compile(r"</?[a-zA-Z][^\s/>]*").search(page, at):
            # a name may start inside what looked like another one's
            start, end = m.start(), plain_tag_end(page, m.end())
            if end >= 0:
                want.append((start, end + 1))
            at = end + 1 if end >= 0 else start + 1
        assert got == want, page


def test_inflating_is_bounded_and_whole():
    parts = [b"x" * 50_000_000, b"", bytes(random.Random(1).randbytes(3_000_000)), b"y" * warc.CHUNK]
    for members in (parts, [b"".join(parts)], [b""]):
        packed = b"".join(zlib.compress(p, 6, 31) for p in members)
        pieces = list(warc._inflate(io.BytesIO(packed)))
        assert b"".join(pieces) == b"".join(members)
        assert max(map(len, pieces), default=0) <= warc.CHUNK
    with pytest.raises(ValueError):
        list(warc._inflate(io.BytesIO(zlib.compress(b"z" * 9_000_000, 6, 31)[:-20])))


def test_sidecars_open_every_member(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k % 7}</p>" * (k + 1)) for k in range(60)],
                                  "page_id long, url string, html string")
    raw = warc.write_archives(warc.mark_revisits(pages, 0), str(tmp_path), 4000)
    paths = {r.path for r in warc.normalise(raw.persist(), str(tmp_path)).collect()}
    seen = []
    for path in paths:
        data = open(path.removeprefix("file:"), "rb").read()
        at = 0
        for line in open(path.removeprefix("file:") + ".idx"):
            offset, length, rid = line.rstrip("\n").split("\t")
            assert int(offset) == at
            at += int(length)
            fields, _ = warc.headers(zlib.decompress(data[int(offset):at], 31))
            assert fields["warc-record-id"].strip("<>") == rid
            seen.append(int(fields["x-page-id"]))
        assert at == len(data)
    assert sorted(seen) == list(range(60))


def test_call_identifiers_may_recur_in_other_conversations(spark):
    rows = [(f"c{c}", f"call_{k}", k, "f", "{}", f"call_{k - 1}" if k else None)
            for c in range(40) for k in range(12)]
    calls = spark.createDataFrame(rows, "conv_id string, call_id string, seq int, name string, "
                                        "arguments string, parent string")
    results = spark.createDataFrame([], "conv_id string, call_id string, seq int, content string")
    linked = chat_format.link_calls(calls, results, {"f": {}})
    got = {(r.conv_id, r.call_id): (r.depth, r.position) for r in linked.collect()}
    assert got == {(f"c{c}", f"call_{k}"): (k, k) for c in range(40) for k in range(12)}
    plan = linked._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_slash_dates_stay_apart(spark):
    days = [date(1800, 1, 1) + timedelta(k) for k in range(146_097)]
    late = [f"{d:%d/%m/}{d.year}" for d in days if d.day > 12]
    early = [f"{d:%m/%d/}{d.year}" for d in days[:146_000:5]]
    df = spark.createDataFrame([(t,) for t in late + early], "m string")
    out = df.select("m", pii._date(pii.F.col("m"), "k").alias("p"),
                    pii.kind_of(pii.F.col("m")).alias("k")).collect()
    assert {r.k for r in out} == {"date"}
    assert len({r.p for r in out}) == len(out)
    assert {r.p for r in out if int(r.m[:2]) > 12} == set(late)
    assert all(r.p.startswith("29/02/") for r in out if r.m.startswith("29/02/"))
    real = {f"{d:%m/%d/}{d.year}" for d in days} | set(late)
    assert {r.p for r in out} <= real
