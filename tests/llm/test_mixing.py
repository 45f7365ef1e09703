import math
import random
import re

from pyspark.sql import functions as F

from srcatlas.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing excesses again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, left = {}, dict.fromkeys(order)
    while left:
        rest = sum(sizes.values()) - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = most * sizes[s]
            del left[s]
    return capped


def test_mix(spark, monkeypatch):
    r = random.Random(7)
    for rows_a_part in (7,):
        monkeypatch.setattr(mixing, "NUMBERED", rows_a_part)
        rows = [(i, " ".join("x" * r.randint(1, 4) for _ in range(int(r.paretovariate(0.8)) % 900)), r.choice(["hot", "hot", "hot", "b", "é", "z", None]), 1) for i in range(300)]
        rows += [(1000, None, "b", 1), (1001, "", "b", 1), (None, "a b", "tiny", 1), (5, "a  b\tc\u00a0d", "tiny", 1)] + [(7, "same copy", "z", 1)] * 40
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
        got = mixing.mix(docs).collect()
        assert len(got) == len(rows)
        sizes = {}
        for _, t, s, _ in rows:
            sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        want, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
        for x in got:
            assert x.source_size == sizes[x.source] and math.isclose(x.target, want[x.source], rel_tol=1e-9)
            assert x.taken == x.copies * x.size and 0 <= x.copies <= 3
            taken[x.source] += x.taken
        for s in sizes:
            assert abs(taken[s] - want[s]) <= max(5, 0.02 * want[s]), s
        again = mixing.mix(docs.repartition(3)).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(docs.where("false")).count() == 0


def test_balance_of_two_margins(spark):
    cells = [("a", "x", 100.0, 150.0, 120.0), ("a", "y", 50.0, 150.0, 130.0), ("b", "x", 60.0, 100.0, 120.0), ("b", "y", 40.0, 100.0, 130.0)]
    df = spark.createDataFrame(cells, "s string, l string, mass double, t1 double, t2 double")
    got = mixing.balance(df, [(["s"], "t1"), (["l"], "t2")], "mass", 10.0, tolerance=1e-6).collect()
    for key, want in (("s", {"a": 150, "b": 100}), ("l", {"x": 120, "y": 130})):
        for k, t in want.items():
            assert math.isclose(sum(r.mass * r.rate for r in got if r[key] == k), t, rel_tol=1e-3)
    rate = {(r.s, r.l): r.rate for r in got}  # tilted: the log rates have no interaction
    assert math.isclose(rate["a", "x"] * rate["b", "y"], rate["a", "y"] * rate["b", "x"], rel_tol=1e-6)


def test_words(spark):
    df = spark.createDataFrame([("a b",), (" a\n\x0bb\u2003c ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [2, 2, 0, 0]


def test_two_margins_against_brute_force(spark):
    """Sources meet their targets, languages come as near to their shares as a plain balancing gets them."""
    r = random.Random(12)
    langs = {"a": "en en en de fr -", "b": "en de de fr -", "c": "de fr fr fr en -", None: "- - en de fr"}
    pairs = [(s, None if l == "-" else l) for s, ls in langs.items() for l in ls.split()]
    rows = [(i, " ".join(["w"] * r.randrange(1, 40)), *r.choice(pairs)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mix(docs, cell="lang").collect()
    mass, taken = {}, {}
    for x in got:
        mass[x.source, x.lang] = mass.get((x.source, x.lang), 0) + x.size
        taken[x.source, x.lang] = taken.get((x.source, x.lang), 0) + x.taken
    total = sum(mass.values())
    sizes = {s: sum(m for (a, _), m in mass.items() if a == s) for s, _ in mass}
    want = plain_targets(sizes)
    shares = {l: sum(m for (_, b), m in mass.items() if b == l) for _, l in mass}
    log = dict.fromkeys(mass, 0.0)
    rate = lambda k: min(3.0, math.exp(log[k]))
    for _ in range(3000):  # proportional fitting with the cap, sources last
        for i, goal in ((1, shares), (0, want)):
            for key, t in goal.items():
                own = [k for k in mass if k[i] == key]
                have = sum(mass[k] * rate(k) for k in own)
                step = 0.3 * math.log(t / have) if have and t else 0.0
                for k in own:
                    log[k] += step
    for s, t in want.items():
        assert abs(sum(v for (a, _), v in taken.items() if a == s) - t) <= max(5, 0.01 * t), s
    for k, m in mass.items():
        assert abs(taken[k] - m * rate(k)) <= 0.05 * total / len(mass), (k, taken[k], m * rate(k))
    plain = {k: m * want[k[0]] / sizes[k[0]] for k, m in mass.items()}
    miss = lambda t: sum(abs(sum(v for (_, b), v in t.items() if b == l) - x) for l, x in shares.items())
    assert miss(taken) < 0.7 * miss(plain)


def test_numbered(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NUMBERED", 7)
    df = spark.createDataFrame([(f"s{i * 37 % 101}",) for i in range(101)], "s string")
    got = {r.s: r.n for r in mixing.numbered(df, ["s"], "n").collect()}
    assert got == {s: i + 1 for i, s in enumerate(sorted(got))}
