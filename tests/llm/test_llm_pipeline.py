"""The registered queries and the corpus pipeline on the small tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__
import corpus_pipeline
from kinetrack.llm.queries import oracle_sql, queries
from kinetrack.llm.storage import table, written

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, seen = table(spark, DATA, "documents"), []
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), name.replace(" ", "-"))
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= before and (name == "mixing" or docs.columns == corpus_pipeline.COLUMNS)
        seen.append(len(now))
        before = now
    assert seen[0] > 0 and seen == sorted(seen, reverse=True)
    assert docs.where("copies < 1 OR rate < 0").count() == 0


def test_near_duplicates_keep_one_row_of_each_group(spark):
    words = [[f"{k}w{i}" for i in range(60)] for k in "abcd"]
    a, b, c, d = (" ".join(x) for x in words)
    # a: repeated rows; b: with a null id besides; c: null ids only; d: its first id is also that of a row of a's group
    rows = [(5, a), (5, a), (2, a), (2, a), (None, b), (7, b), (None, c), (None, c), (2, d), (9, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()]
    assert sorted(got, key=str) == sorted([(2, a), (7, b), (None, c), (2, d)], key=str)
    repeated = [(5, a), (5, b), (1, b)]  # 5 is the first of a's group, not of b's
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in repeated], docs.schema)
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()) == [(1, b), (5, a)]


def test_all_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = queries()[name](spark, DATA).toArrow().to_pandas(integer_object_nulls=True)
    want = c.sql(oracle_sql()[name]).to_arrow_table().to_pandas(integer_object_nulls=True)
    key = lambda df: sorted(tuple("" if x is None or x is pd.NA else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert key(got) == key(want)


def test_held_out_scores(spark):
    found = queries()["op5_lm_trie"](spark, DATA).where("held_out").toPandas()
    assert found.score.sum() > found.base_score.sum()
    langs = {r["doc_id"]: r["lang"] for r in table(spark, DATA, "documents").collect()}
    held = queries()["op3_language_id"](spark, DATA).where("held_out").collect()
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)
