import math
from collections import Counter

from pyspark.sql import functions as F

from srcatlas.llm import urlfilter as u
from srcatlas.llm.catalog import URL_RULES


def test_parts_and_rules(spark):
    cases = {
        "http://WWW.Example.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "x://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://a.com": ("a.com", "", None, None),
        "http://a.com?x://y/z": ("a.com", "", None, None),
        "//a.com/": ("", "", None, None),
        "http://b.net/es/1": ("b.net", "/es/1", "net/es/", "block"),
        "http://b.net/ES/1": ("b.net", "/ES/1", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    host, path = u.host_path(F.col("url"))
    df = df.withColumn("host", host).withColumn("path", path)
    rule, action = u.rule_of(F.col("host"), F.col("path"), URL_RULES)
    for r in df.select("*", rule.alias("r"), action.alias("a")).collect():
        assert (r.host, r.path, r.r, r.a) == cases[r.url], r.url


def brute_ratio(texts, order, least):
    """Witten-Bell by counting; texts are (symbols, class)."""
    counts = {c: Counter() for c in "ab"}
    for s, c in texts:
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[c][s[i - k : i], s[i]] += 1

    def p(c, context, x):
        below = 1 / u.SYMBOLS if not context and context is not None else None
        value = 1 / u.SYMBOLS
        for k in range(order + 1):
            h = context[order - k :]
            n = sum(v for (g, _), v in counts[c].items() if g == h)
            t = sum(1 for (g, _), v in counts[c].items() if g == h and v)
            if n >= least:
                value = (counts[c][h, x] + t * value) / (n + t)
        return value if below is None else value

    return lambda context, x: math.log(p("a", context, x)) - math.log(p("b", context, x))


def test_model_against_counting(spark):
    good, bad = [f"http://good{i % 4}.com/a/{i}" for i in range(30)], [f"http://spam-{i % 3}.net/x?{i}" for i in range(30)]
    pages = spark.createDataFrame([(x, "allow") for x in good] + [(x, "block") for x in bad] + [("http://new.org", None)], "url string, label string")
    model = u.train(pages, order=2)
    held = {r.url for r in pages.where(F.pmod(F.xxhash64("url"), F.lit(5)) == 0).collect()}
    sym = {r.url: r.s for r in pages.select("url", u.symbols(F.col("url"), 2).alias("s")).collect()}
    ratio = brute_ratio([(sym[x], "a") for x in good if x not in held] + [(sym[x], "b") for x in bad if x not in held], 2, 2)
    for r in model.grams.collect():
        assert abs(r.ratio - ratio(r.gram[:2], r.gram[2]) * u.UNIT) <= 1, r


def test_judge(spark):
    rows = [(i, f"http://shop{i % 7}.com/de/{i}", "c") for i in range(60)] + [(100 + i, f"http://spam{i % 5}.net/es/{i}", "c") for i in range(60)]
    rows += [(200, "http://shop3.org/de/9", "c"), (201, "http://spam4.org/es/8", "c"), (202, None, "c"), (203, "no url", "c"), (200, "http://shop3.org/de/9", "c"), (None, "http://q.org/" + "x" * 5000, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, score string")
    got = u.judge(pages, URL_RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[200].verdict == "allow" and by[201].verdict == "block" and by[200].rule is None
    assert all(by[i].verdict == "allow" for i in range(60)) and all(by[i].verdict == "block" for i in range(100, 160))
    assert by[202].verdict in ("allow", "block") and by[202].host == ""
    assert u.judge(pages.where("false"), URL_RULES).count() == 0


def test_names_that_clash(spark):
    """Columns with inner names neither multiply rows nor clash."""
    names = ["gram", "ratio", "label", "key", "bin", "a", "b", "__symbols", "__row", "context", "score", "rule"]
    docs = spark.createDataFrame([(i, f"http://x{i % 3}.org/{i}", *["c"] * len(names)) for i in range(20)] * 2, ", ".join(["page_id long", "url string", *(f"{n} string" for n in names)]))
    got = u.judge(docs, URL_RULES)
    assert got.count() == 40 and set(names) <= set(got.columns)


def test_threshold_parts_the_held_out_fold(spark):
    """The threshold lies between the scores of both classes where they can be parted."""
    rows = [(f"http://good{i % 4}.org/a/{i}", "allow") for i in range(80)] + [(f"https://spam-{i % 3}.biz/x?{i}", "block") for i in range(80)]
    pages = spark.createDataFrame(rows, "url string, label string")
    model = u.train(pages)
    held = u.score(pages, model).where(F.pmod(F.xxhash64("url"), F.lit(5)) == 0).collect()
    assert max(r.score for r in held if r.label == "block") < model.threshold < min(r.score for r in held if r.label == "allow")
