"""The pipeline over odd rows and over the smallest tables, and SQL twins."""

import duckdb
import pytest

import corpus_pipeline
from ohmflow.llm.queries import LLM_ORACLE, LLM_QUERIES
from ohmflow.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_stages_keep_schema_and_handle_odd_rows(spark):
    text = " ".join(f"word{k}" for k in range(70))
    rows = [(1, text, "en", "s", 3, "x"), (1, text, "en", "s", 3, "x"), (2, text + " more", None, None, None, None),
            (None, text, "en", "s", 3, "x"), (3, None, "en", "s", 3, "x"), (4, "", "en", "s", 0, "x"),
            (5, text.replace("word", "term") + " 4111111111111111", "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                       "n_chars long, n_words string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "5", "None"]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "bin_id", "bin_size"} <= set(out.columns) and out.count() > 50


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = LLM_QUERIES[name](spark, SF)
    cur = con.execute(LLM_ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted(tuple(repr(r[i]) for i in at) for r in cur.fetchall())
    assert sorted(tuple(repr(r[c]) for c in cols) for r in df.collect()) == want
