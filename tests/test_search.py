"""Symbol, text, route and vector search on small literal tables."""

import random

import pytest
from pyspark.sql import functions as F

from srcatlas.operators import search, stats, upsert

SYMBOLS = [(1, "repo1", "a.py", "validate_email", "function", 0, 100), (2, "repo1", "a.py", "validate_phone", "function", 101, 200), (3, "repo1", "b.py", "UserModel", "class", 0, 500), (4, "repo2", "c.py", "parse_csv", "function", 0, 150)]
SCHEMA = "symbol_id long, repo string, file string, name string, kind string, start_byte long, end_byte long"


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame(SYMBOLS, SCHEMA)


def names(df):
    return [r["name"] for r in df.collect()]


def test_symbols(symbols):
    assert names(search.search_symbols(symbols, "validate", "repo1")) == ["validate_email", "validate_phone"]
    assert names(search.search_symbols(symbols, "USERMODEL", "repo1")) == ["UserModel"]
    assert names(search.search_symbols(symbols, "validate", "repo1", kind="class")) == []
    assert names(search.search_symbols(symbols, "parse_csv")) == ["parse_csv"]
    assert names(search.search_symbols(symbols, "phone")) == ["validate_phone"]  # contained, as none starts so
    assert names(search.search_symbols(symbols, "validate%il")) == ["validate_email"]
    assert names(search.search_symbols(symbols, "validate%il", exact=True)) == []
    assert names(search.search_symbols(symbols, "it's ^ \\")) == []
    assert names(search.search_symbols_by_repo(symbols, "e", limit=1).orderBy("repo")) == ["validate_email", "parse_csv"]
    assert names(search.symbols_named(symbols, ["UserModel", "parse"])) == ["UserModel"]
    assert names(search.file_outline(symbols, "repo1", "a.py")) == ["validate_email", "validate_phone"]


def test_text(spark):
    files = [("r", f"f{i:02d}.py", "\n".join(["Hit  "] * 6)) for i in range(30)] + [("r", "util.txt", "a\r\nÄHit\rb\u2028hit"), ("q", "f00.py", "hit")]
    df = spark.createDataFrame(files, "repo string, path string, content string")
    found = search.search_text(df, "hit", "r").collect()
    assert len(found) == 100 and {r["text"] for r in found} == {"Hit"} and max(r["line"] for r in found) == 5
    assert [(r["line"], r["text"]) for r in search.search_text(df, "ähit", "r", "*.txt").collect()] == [(2, "ÄHit")]
    assert [(r["line"], r["text"]) for r in search.search_text(df, "b\u2028h", "r").collect()] == [(3, "b\u2028hit")]
    assert search.search_text(df, "nothing").count() == 0
    uneven = [("r", "a", "h\n" * 4)] + [("r", f"b{i:02d}", "h\n" * 5) for i in range(19)] + [("r", "c", "h\n" * 9), ("r", "d", "h")]
    df = spark.createDataFrame(uneven, "repo string, path string, content string")
    assert search.search_text(df, "h").count() == 104  # 99 before the file that ends it


def test_routes_and_vectors(spark):
    routes = spark.createDataFrame([("r", "b.py", "GET", "/users", "h", 5, 9), ("r", "a.py", "GET", "/users/1", "g", 1, 2), ("r", "a.py", "POST", "/items", "", 0, 1)], "repo string, file string, method string, path string, handler string, start_byte long, end_byte long")
    assert [r["path"] for r in search.search_routes(routes, "r", "get", "user").collect()] == ["/users/1", "/users"]
    assert search.search_routes(routes, "q").count() == 0
    unit = [1.0] + [0.0] * 383
    vectors = spark.createDataFrame([(1, "r", unit), (2, "r", None), (3, "r", [0.0, 1.0] + [0.0] * 382), (0, "r", unit)], "symbol_id long, repo string, embedding array<float>")
    assert [(r["symbol_id"], r["score"]) for r in search.search_vectors(vectors, unit, "r", 2).collect()] == [(0, 1.0), (1, 1.0)]
    assert search.search_vectors(vectors, unit).count() == 3


def test_byte_ranges(spark):
    df = spark.createDataFrame([(bytearray("äbc".encode() + b"\xff"), 0, 3), (bytearray(b"abc"), 0, 0), (None, 0, 2)], "c binary, a long, b long")
    assert [r[0] for r in df.select(search.byte_range(F.col("c"), F.col("a"), F.col("b"))).collect()] == ["äb", "", None]
    assert [r[0] for r in df.select(search.byte_range(F.col("c"), F.col("a"), F.col("b"), 2)).collect()] == ["ä", "ab", None]


def test_stats_and_upserts(spark, symbols):
    files = spark.createDataFrame([("repo1", "a.py", "h1"), ("repo1", "z.py", "h2")], "repo string, path string, hash string")
    edges = spark.createDataFrame([(1, "repo1", "a.py", "f", "g", None), (1, "repo1", "a.py", "f", "h", "b.py")], "caller_id long, repo string, caller_file string, caller_name string, callee_name string, callee_file string")
    assert [r["path"] for r in stats.orphans(files, symbols, edges).collect()] == ["z.py"]
    assert [tuple(r) for r in stats.fan_in(edges).collect()] == [("b.py", 1)]
    scan = spark.createDataFrame([("repo1", "a.py", "h1"), ("repo1", "n.py", "h3")], "repo string, path string, hash string")
    assert [r["path"] for r in upsert.changed_files(scan, files).collect()] == ["n.py"]
    assert [r["path"] for r in upsert.vanished_files(scan, files).collect()] == ["z.py"]
    assert [r["path"] for r in upsert.unchanged_files(scan, files).collect()] == ["a.py"]
    twice = spark.createDataFrame([("r", "f", "x", 1), ("r", "f", "x", 2)], "repo string, file string, name string, seq int")
    assert [r["seq"] for r in upsert.last_wins(twice, ["repo", "file", "name"], ["seq"]).collect()] == [2]


def test_text_of_several_terms_splits_only_files_that_count(spark):
    r = random.Random(4)
    words = ["on", "ON", "on\ron", "licensed", "off\r\non", "\n", "é", "Σ", ""]
    rows = [("r", f"{i:03}.txt", " \n".join(r.choice(words) for _ in range(r.randrange(9)))) for i in range(60)] + [("r", None, "on"), ("q", "000.txt", "licensed on "), ("q", "none", None)]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    for enough in (7, 1000):
        found = search.text_by_term(files, ["licensed", "on", "nowhere"], 2, enough)
        got = sorted((tuple(x) for x in found.collect()), key=repr)
        each = [(i, *x) for i, t in enumerate(["licensed", "on"]) for x in search.search_text(files, t, per_file=2, enough=enough).collect()]
        assert got == sorted(each, key=repr) and got
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    ranked = plan[plan.index("Join"):]
    assert "split(" in plan and "split(" not in ranked[ranked.index("\n"):]
