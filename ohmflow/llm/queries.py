"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame,
and DuckDB twins where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import (chat_format, classifier, decontam, html_diff, lm, merkle, minhash, packing, pii,
               quality_rules, repair, token_counts, warc)

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLE[name] = sql
        return fn
    return deco


@query("op7_minhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "labels"))


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          f"'abcdefghijklmnopqrstuvwxyz'), '{_ALNUM}')")


@query("op5_benchmark_decontamination", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[k:k + least(10, len(w)) - 1] AS g, least(10, len(w)) AS n
        FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, k, s.n, w[k:k + s.n - 1] AS g
          FROM d, sizes s, unnest(range(1, len(w) - s.n + 2)) AS u(k)),
hit AS (SELECT doc_id, item_id, k, win.n FROM grams JOIN win USING (g)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM hit, unnest(range(k, k + n)) AS u(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
          string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
          FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"),
                                   table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit",
                        F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_warc_normaliser", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h,
        max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(
         h, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) AS INTEGER) + 1, 1)
         FOR k IN range(32)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: the key of the registered query and the pipeline; a real run brings its own
PII_KEY = "ohmflow-demo-key"


@query("op10_pii_pseudonyms")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_lm_scoring")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    return lm.score_texts(table(spark, sf_dir, "documents"), fold == 2)


@query("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "lines_deleted")


#: argument schemas of the derived tools
TOOL_SCHEMAS = {
    "reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
              "properties": {"prompt": {"type": "string", "minLength": 20},
                             "turn": {"type": "integer", "minimum": 0}}},
    "configure": {"type": "object", "required": ["prompt", "turn"],
                  "properties": {"prompt": {"type": "string", "minLength": 1},
                                 "turn": {"type": "integer", "maximum": 0}}},
}


def tool_traffic(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read out of plain conversations: a user turn calls
    ``reply``, a system turn ``configure``, an assistant turn is the result of
    the call one turn before; a user turn builds on the call two turns before."""
    turn = F.col("turn").cast("long")

    def name(t):
        return F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    asks = conversations.where("role in ('user', 'system')")
    calls = asks.select(
        "conv_id", name(turn).alias("call_id"), turn.alias("seq"),
        F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), turn.alias("turn"))).alias("arguments"),
        F.when(F.col("role") == "user", name(turn - 2)).alias("parent"))
    results = conversations.where("role = 'assistant'").select(
        "conv_id", name(turn - 1).alias("call_id"), turn.alias("seq"), F.col("text").alias("content"))
    return calls, results


@query("op2_tool_call_linking", """
WITH c AS (SELECT conv_id, 'c' || conv_id || '-' || turn AS call_id, turn AS seq,
             CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name, text, turn,
             CASE role WHEN 'user' THEN 'c' || conv_id || '-' || (turn - 2) END AS parent
           FROM conversations WHERE role IN ('user', 'system')),
r AS (SELECT conv_id, 'c' || conv_id || '-' || (turn - 1) AS call_id, turn AS seq, text AS content
      FROM conversations WHERE role = 'assistant'),
chain AS (SELECT conv_id, turn, turn - 2 * row_number() OVER (
            PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island
          FROM c WHERE name = 'reply'),
-- a parent may also be a system call, which has no parent itself
d AS (SELECT a.conv_id, a.turn, row_number() OVER (PARTITION BY a.conv_id, a.turn % 2, a.island
          ORDER BY a.turn) - 1 + max(CASE WHEN s.turn IS NULL THEN 0 ELSE 1 END) OVER (
          PARTITION BY a.conv_id, a.turn % 2, a.island) AS depth
      FROM chain a LEFT JOIN c s ON s.conv_id = a.conv_id AND s.name = 'configure'
        AND s.turn = a.turn - 2 ),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
        c.name, c.text, c.turn, r.content, coalesce(c.seq, r.seq) AS seq,
        CASE WHEN c.call_id IS NULL THEN 'no_call' WHEN r.call_id IS NULL THEN 'no_result'
             ELSE 'linked' END AS status,
        CASE WHEN c.call_id IS NOT NULL THEN coalesce(d.depth, 0) END AS depth
      FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
      LEFT JOIN d ON d.conv_id = c.conv_id AND d.turn = c.turn AND c.name = 'reply'),
e AS (SELECT *, CASE WHEN status = 'no_call' THEN CAST([] AS VARCHAR[]) ELSE [x FOR x IN [
        CASE WHEN text IS NULL THEN '$.prompt: missing' END,
        CASE WHEN name = 'reply' AND length(text) < 20 OR length(text) < 1 THEN '$.prompt: too short' END,
        CASE WHEN name = 'reply' AND turn < 0 THEN '$.turn: below minimum' END,
        CASE WHEN name = 'configure' AND turn > 0 THEN '$.turn: above maximum' END]
        IF x IS NOT NULL] END AS errors FROM j)
SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id ORDER BY
         coalesce(depth, 4611686018427387904), seq, call_id) - 1 AS position,
       CAST(depth AS BIGINT) AS depth, status, status <> 'no_call' AND len(errors) = 0 AS valid,
       array_to_string(errors, '; ') AS errors, '{"arguments":' || CASE WHEN status = 'no_call' THEN 'null' ELSE
         '{"prompt":' || to_json(text) || ',"turn":' || turn || '}' END || ',"id":' || to_json(call_id)
         || ',"name":' || CASE WHEN name IS NULL THEN 'null' ELSE to_json(name) END || ',"result":'
         || CASE WHEN content IS NULL THEN 'null' ELSE to_json(content) END || ',"status":"' || status
         || '"}' AS record
FROM e
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_traffic(table(spark, sf_dir, "conversations"))
    return chat_format.link_calls(calls, results, TOOL_SCHEMAS).withColumn(
        "errors", F.array_join("errors", "; "))


#: vocabulary file of the token counts; a real run names its own
TOKENIZER = "byte_bpe_50k.json"


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                     public_tokenizers.path(TOKENIZER))


def _crc32(expr: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of an ASCII string expression: bytes are
    folded in, eight shifts (-1) after each."""
    steps = (f"flatten(list_transform(string_split({expr}, ''), "
             "lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))")
    fold = ("list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), lambda c, x: CASE WHEN x >= 0 "
            "THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)")
    return f"xor({fold.format(steps=steps)}, CAST(4294967295 AS BIGINT))"


def _merkle_levels(name: str, source: str, group: str, levels: int) -> tuple[str, str]:
    """CTEs ``name0 ..``: nodes ``(group, pos, n, h)`` level by level with the digests
    beside each node (``a`` before, ``b`` after); a single node stays as it is."""
    run = f"OVER (PARTITION BY {group}, pos // 8 ORDER BY pos ROWS BETWEEN"
    beside = (f"string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, "
              f"string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b")
    ctes = [f"{name}0 AS (SELECT *, {beside} FROM ({source}))"]
    for k in range(1, levels + 1):
        ctes.append(f"{name}{k} AS (SELECT *, {beside} FROM (SELECT {group}, pos // 8 AS pos, (n + 7) // 8 AS n, "
                    f"CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h "
                    f"FROM {name}{k - 1} GROUP BY {group}, pos // 8, n))")
    return ",\n".join(ctes), f"{name}{levels}"


def _merkle_sql(levels: int = 8, tops: int = 3) -> str:
    def h(text: str) -> str:
        parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
                 for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    low, last = _merkle_levels("lv", "SELECT g, pos, n, leaf AS h FROM leaf", "g", levels)
    high, top = _merkle_levels("tp", f"SELECT 0 AS z, g AS pos, (SELECT count(*) FROM {last}) AS n, h "
                                     f"FROM {last}", "z", tops)
    steps = [(f"lv{k}", f"v{k}.g = t.g AND v{k}.pos = t.pos // {8 ** k}") for k in range(levels)]
    steps += [(f"tp{k}", f"v{levels + k}.pos = t.g // {8 ** k}") for k in range(tops)]
    stages = []
    for k, (cte, on) in enumerate(steps):
        stages.append(f"f{k} AS (SELECT t.* EXCLUDE (acc, proof), CASE WHEN v{k}.n = 1 THEN acc ELSE "
                      f"sha256(coalesce(a, '') || acc || coalesce(b, '')) END AS acc, CASE WHEN v{k}.n = 1 "
                      f"THEN proof ELSE proof || coalesce(a, '') || coalesce(b, '') END AS proof "
                      f"FROM {'start' if k == 0 else f'f{k - 1}'} t JOIN {cte} v{k} ON {on})")
    end = f"f{len(steps) - 1}"
    return f"""
WITH base AS (SELECT doc_id, lang, {h('text')} AS leaf,
    CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {h(lower)} ELSE {h('text')} END AS tampered
  FROM documents),
leaf AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n FROM base),
{low},
{high},
start AS (SELECT doc_id, g, pos, leaf, tampered, tampered AS acc, '' AS proof FROM leaf),
{(',' + chr(10)).join(stages)}
SELECT t.doc_id, t.leaf, s.h AS subroot, r.h AS root, sha256(t.proof) AS proof_sha256,
       t.acc AS folded_root, t.acc = r.h AS verified
FROM {end} t JOIN {last} s ON s.g = t.g CROSS JOIN {top} r
"""


@query("op13_merkle_manifest", _merkle_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    fields = [F.when(hit, lower).otherwise(text) if c == "text" else F.col(c) for c in merkle.FIELDS]
    rows = merkle.manifest(table(spark, sf_dir, "documents"), also={"tampered": merkle.leaf_hash(fields)})
    folded = merkle.fold(F.col("tampered"), F.col("proof"))
    return rows.select("doc_id", "leaf", "subroot", "root",
                       F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
                       folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def _edit_table() -> str:
    """Every edit of every kind of row as SQL values: initial, whether it must go,
    whether it is truncated, state before and after, cost, edits, the text inserted
    before, own edit and the role it takes."""
    rows = []
    for initial in ("s", "u", "a", "-"):
        for fault in ("", "blank", "truncated"):
            for (a, b), (cost, edits) in repair.row_edits(initial, fault).items():
                asks = repair.roles_of(edits, a)
                before = "".join(repair.ROLES[x] + ":\n" for x in asks[:-1])
                rows.append(f"('{initial}', '{fault}', {a}, {b}, {cost}, '{edits}', '{before}', "
                            f"'{edits[-1]}', '{repair.ROLES.get(asks[-1], '')}')")
    return ",\n  ".join(rows)


@query("op11_conversation_repair", f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN ''
    WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM raw, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) WHERE kind <> 0),
placed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), '-') AS c, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS rest FROM hurt),
marked AS (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS i,
    lag(left(role, 1)) OVER (PARTITION BY c ORDER BY pos) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal,
    CASE WHEN rest = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1
      THEN 'duplicate' WHEN right(rest, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
edit(i, f, a, b, price, marks, before, own, ask) AS (VALUES
  {_edit_table()}),
walk AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS pos, 0 AS state,
    {{'cost': CAST(0 AS BIGINT), 'audit': '', 'out': ''}} AS best FROM marked
  UNION ALL
  SELECT w.c, m.pos, e.b, min({{'cost': w.best.cost + e.price, 'audit': w.best.audit || e.marks,
    'out': w.best.out || e.before || CASE e.own WHEN 'K' THEN m.role || ':' || m.text || chr(10)
      WHEN 'R' THEN e.ask || ':' || m.text || chr(10) ELSE '' END}})
  FROM walk w JOIN marked m ON m.c = w.c AND m.pos = w.pos + 1 JOIN edit e ON e.a = w.state AND e.i = m.i
    AND e.f = CASE m.fault WHEN 'duplicate' THEN 'blank' ELSE m.fault END
  GROUP BY w.c, m.pos, e.b),
sums AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, max(pos) AS n
  FROM marked GROUP BY c),
ends AS (SELECT c, min({{'cost': best.cost + s.price, 'audit': best.audit || s.marks, 'out': best.out || s.extra}}) AS best
  FROM walk JOIN sums USING (c) JOIN (VALUES (0, 0, '', ''), (1, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
    (2, 5, 'I', 'assistant:' || chr(10)), (3, 0, '', '')) s(state, price, marks, extra) USING (state)
  WHERE pos = n GROUP BY c)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(left(best.out, CAST(greatest(length(best.out) - 1, 0) AS BIGINT)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '-') AS c FROM conversations) o
LEFT JOIN sums USING (c) LEFT JOIN ends USING (c)
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return repair.report(talks, repair.damage(talks))
