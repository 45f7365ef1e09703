"""Column functions against plain Python."""

import random

from pyspark.sql import functions as F

from srcatlas.functions import text as fn


def loc(text):
    n, inside = 0, False
    for line in text.splitlines():
        s = line.strip()
        if not s:
            continue
        if inside:
            inside = not ("*/" in s or s.endswith("'''") or s.endswith('"""'))
        elif s.startswith(("#", "//", "--")):
            continue
        elif s.startswith(("/*", "<!--", '"""', "'''")):
            inside = not s.endswith(("*/", "-->", '"""', "'''"))
        else:
            n += 1
    return n


def test_lines_of_code(spark):
    r = random.Random(1)
    bits = ["x = 1", "# c", "// c", "-- c", "/*", "*/", "a */ b", '"""', "'''", '"""doc"""', "<!--", "-->", "  ", "\t", "\r\n", "\n", "\u2028", "\x0b", "\x85", "\x1c", "\xa0y", "/* a */"]
    texts = ["".join(r.choice(bits) + r.choice(["\n", "", "\r", "\n"]) for _ in range(r.randrange(12))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", fn.lines_of_code(F.col("t")).alias("n")).collect()
    for row in rows:
        assert row["n"] == loc(texts[row["i"]]), repr(texts[row["i"]])
    assert spark.range(1).select(fn.lines_of_code(F.lit(None).cast("string")).alias("n")).first()["n"] == 0


def test_tokens_and_paths(spark):
    row = spark.range(1).select(*[fn.token_estimate(F.lit(t)).alias(k) for k, t in {"a": "", "b": "x", "c": "äöüßx"}.items()]).first()
    assert tuple(row) == (0, 1, 2)
    kinds = {"tests/a.py": "test", "src/tests/b.py": "test", "x/test_a.js": "test", "a_test.py": "test", "docs/a.py": "doc", "a/b.MD": "doc", "a/docs/b.py": "text", "a.txt": "text"}
    df = spark.createDataFrame(list(kinds.items()), "p string, k string")
    assert all(r["k"] == r["got"] for r in df.select("k", fn.path_kind(F.col("p")).alias("got")).collect())
    made = {"web/dist/app.js": True, "pkg/foo.pb.go": True, "src/app.py": False, "a/Vendor/b.c": True, "x.designer.cs": True}
    df = spark.createDataFrame(list(made.items()), "p string, k boolean")
    assert all(r["k"] == r["got"] for r in df.select("k", fn.is_generated(F.col("p")).alias("got")).collect())
    langs = {"a.py": "python", "a/b.SCSS": "css", "x.R": "other", "noext": "other", ".bashrc": "other", "a.b.ts": "typescript"}
    df = spark.createDataFrame(list(langs.items()), "p string, k string")
    assert all(r["k"] == r["got"] for r in df.select("k", fn.stats_language(F.col("p")).alias("got")).collect())


def test_quality(spark):
    q = spark.range(1).select(fn.quality("semantic", F.lit("a.py"), score=F.lit(2.0)).alias("a"), fn.quality("route", F.lit("dist/x.mts"), handler=F.lit("")).alias("b"), fn.quality("symbol", F.lit("a.md")).alias("c"), fn.quality("odd", F.lit(None).cast("string")).alias("d")).first()
    assert q["a"]["confidence"] == 1.0 and q["a"]["parser_mode"] == "grammar"
    assert q["b"]["confidence"] == q["b"]["route_confidence"] == 0.65 and q["b"]["is_generated"] and q["b"]["language_surface"] == "unknown"
    assert q["c"]["confidence"] == 0.92 and q["c"]["parser_mode"] == "native_markdown"
    assert q["d"]["confidence"] == 0.5 and q["d"]["language_surface"] == "unknown"


def test_terms_and_globs():
    import fnmatch
    import re

    assert fn.query_terms("Get a user/by-id, get 42 x") == ["get", "user/by-id"]
    assert fn.query_terms(" 4 ") == ["4"]
    for pattern in ("*.py", "a?c", "[ab]*", "[!a]x", "a[", "src/*_test.py"):
        for name in ("x.py", "a/b.py", "abc", "bx", "ax", "a[", "src/q/r_test.py"):
            assert bool(re.match(fn.glob_regex(pattern), name)) == fnmatch.fnmatchcase(name, pattern), (pattern, name)
