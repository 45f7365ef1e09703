"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import datetime
import math
import os
import re
import time

import duckdb
import pytest

from srcatlas.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_words_of_documents_are_read_once(spark, tmp_path):
    texts = ["", "12 -", "One", "  Héllo,\n wörld x", "a1b2c", "\U00010400\U00010401 -\U00010400", "_x_", "end two\n", "-- only.", None, "x" * 200_000, "-" * 200_000 + "y z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "http://a/b")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    began = time.monotonic()
    index = catalog.corpus_index(spark, str(tmp_path))
    words = {i: re.findall(r"[^\W\d_]+", t or "") for i, t in enumerate(texts)}
    assert {r["symbol_id"]: r["name"] for r in index.symbols.collect()} == {i: (w or [None])[0] for i, w in words.items()}
    assert {r["caller_id"]: r["callee_name"] for r in index.edges.collect()} == {i: (*w, None, None)[1] for i, w in words.items()}
    assert time.monotonic() - began < 60
    for df in (index.symbols, index.edges):
        assert "regexp_extract" not in df._jdf.queryExecution().optimizedPlan().toString()
