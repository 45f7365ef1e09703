"""Graph operators against brute force on random graphs."""

import random
import time
from itertools import permutations

from srcatlas.operators import graph


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "src string, dst string")


def brute_cycles(edges, limit=20):
    nodes = sorted({x for e in edges for x in e})
    found = []
    for n in range(1, len(nodes) + 1):
        for path in permutations(nodes, n):
            if path[0] == min(path) and all((path[i], path[(i + 1) % n]) in edges for i in range(n)):
                found.append([*path, path[0]])
    return sorted(found, key=lambda c: (len(c), c))[:limit]


def test_cycles(spark):
    assert graph.cycles(frame(spark, {("a", "b"), ("b", "c")})).count() == 0
    ring = {("a.py", "b.py"), ("b.py", "c.py"), ("c.py", "a.py"), ("c.py", "c.py"), ("c.py", "d.py")}
    assert [r["cycle"] for r in graph.cycles(frame(spark, ring)).collect()] == [["c.py", "c.py"], ["a.py", "b.py", "c.py", "a.py"]]
    r = random.Random(3)
    for size in (5, 6):
        edges = {(r.choice("abcdef"[:size]), r.choice("abcdef"[:size])) for _ in range(14)}
        got = [x["cycle"] for x in graph.cycles(frame(spark, edges)).orderBy("length", "cycle").collect()]
        assert got == brute_cycles(edges)


def test_neighbourhood(spark):
    edges = {("a", "b"), ("b", "c"), ("c", "d"), ("e", "a"), ("x", "y")}
    got = {tuple(r) for r in graph.neighbourhood(frame(spark, edges), "a", 2).collect()}
    assert got == {("a", "b"), ("b", "c"), ("e", "a")}
    assert graph.neighbourhood(frame(spark, edges), "nowhere", 2).count() == 0


def edge_rows(spark, pairs):
    return spark.createDataFrame([(1, "r", a, "f", "g", b) for a, b in pairs], "caller_id long, repo string, caller_file string, caller_name string, callee_name string, callee_file string")


def test_diagram(spark):
    assert graph.diagram(edge_rows(spark, [("a", None)]).where("false")) == {"diagram": "graph LR", "node_count": 0, "edge_count": 0, "truncated": False}
    d = graph.diagram(edge_rows(spark, [("x/a.py", "b.js"), ("b.js", "x/a.py"), ("b.js", "c.zig"), ("b.js", "c.zig")]), "TD")
    assert (d["node_count"], d["edge_count"], d["truncated"]) == (3, 3, False)
    assert d["diagram"].splitlines() == ["graph TD", '    n0["b.js"]', '    n1["c.zig"]', '    n2["a.py"]', "    n0 --> n1", "    n0 -->|cycle| n2", "    n2 -->|cycle| n0", "    linkStyle 1 stroke:red", "    linkStyle 2 stroke:red", "    style n0 fill:#f1e05a", "    style n1 fill:#cccccc", "    style n2 fill:#3572A5"]
    ring = graph.diagram(edge_rows(spark, [(f"{i}", f"{(i + 1) % 10}") for i in range(10)]), max_nodes=5)
    assert ring["truncated"] and ring["node_count"] == 5


def test_resolution_and_hops(spark):
    symbols = spark.createDataFrame([(1, "r", "b.py", "f"), (2, "r", "a.py", "f"), (3, "r", "c.py", "g")], "symbol_id long, repo string, file string, name string")
    calls = spark.createDataFrame([(3, "r", "c.py", "g", "f"), (3, "r", "c.py", "g", "f"), (3, "r", "c.py", "g", "ext"), (1, "r", "b.py", "f", "f")], "symbol_id long, repo string, file string, caller_name string, callee_name string")
    edges = graph.resolve_calls(calls, symbols)
    assert {(r["caller_id"], r["callee_name"], r["callee_file"]) for r in edges.collect()} == {(3, "f", "a.py"), (3, "ext", None), (1, "f", "a.py")}
    own = graph.resolve_calls(calls, symbols, prefer_same_file=True)
    assert {(r["caller_id"], r["callee_file"]) for r in own.where("callee_name = 'f'").collect()} == {(3, "a.py"), (1, "b.py")}
    assert {r["name"] for r in graph.callers(edges, symbols, "f", "r").collect()} == {"g", "f"}
    assert {tuple(r) for r in graph.callees(edges, "g", "r").collect()} == {("f", "a.py"), ("ext", None)}
    placed = spark.createDataFrame([("r", "x", 5, "h"), ("r", "x", 50, "k"), ("r", "y", 5, "h")], "repo string, file string, pos long, callee_name string")
    spans = spark.createDataFrame([(1, "r", "x", "outer", 0, 40), (2, "r", "x", "inner", 5, 10)], "symbol_id long, repo string, file string, name string, start_byte long, end_byte long")
    assert {(r["pos"], r["caller_name"]) for r in graph.calls_in_symbols(placed, spans).collect()} == {(5, "outer"), (5, "inner")}


def test_calls_in_spans_of_all_lengths(spark):
    r = random.Random(5)
    spans = [(i, "r", r.choice("xy"), f"s{i}", at, at + r.choice([-3, 0, 1, 2, 3, 4, 5, 16, 17, 64, 65, 300, 10**6, 2**40])) for i, at in ((i, r.randrange(-50, 400)) for i in range(300))] + [(300, "r", "x", "none", None, 5)]
    calls = [("r", r.choice("xyz"), r.choice([r.randrange(-60, 500), 10**6, 2**40]), f"c{i}") for i in range(300)] + [("r", "x", None, "none")]
    found = graph.calls_in_symbols(spark.createDataFrame(calls, "repo string, file string, pos long, callee_name string"), spark.createDataFrame(spans, "symbol_id long, repo string, file string, name string, start_byte long, end_byte long"))
    assert found.columns == ["repo", "file", "pos", "callee_name", "symbol_id", "caller_name"]
    brute = [(c, s) for _, f, p, c in calls for s, _, g, _, a, b in spans if f == g and None not in (p, a) and a <= p < b]
    assert sorted((x["callee_name"], x["symbol_id"]) for x in found.collect()) == sorted(brute)


def test_calls_and_spans_of_a_long_file_are_not_paired(spark):
    n = 3000
    calls = spark.range(n).selectExpr("'r' AS repo", "'x' AS file", "id AS pos", "'c' AS callee_name")
    spans = spark.range(n).selectExpr("id AS symbol_id", "'r' AS repo", "'x' AS file", "'s' AS name", "id AS start_byte", "id + 2 AS end_byte")
    found = graph.calls_in_symbols(calls, spans)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and "pos" in x]
    assert len(joins) == 1 and "__cell" in joins[0] and found.count() == 2 * n - 1


def test_tree(spark):
    files = spark.createDataFrame([("src/a/b.py",), ("src/c.py",), ("z.md",)], "path string")
    assert graph.render_tree(files, 2) == "├── src/\n│   ├── a/\n│   └── c.py\n└── z.md"


def test_long_rings_are_cycles(spark):
    ring = [f"{i:02}.py" for i in range(14)]
    edges = {(a, b) for a, b in zip(ring, ring[1:] + ring[:1])}
    assert [(r["cycle"], r["length"]) for r in graph.cycles(frame(spark, edges)).collect()] == [([*ring, ring[0]], 14)]


def test_rings_and_chains_of_any_length(spark):
    for n in (14, 300):
        ring = {(f"{i:03}", f"{(i + 1) % n:03}") for i in range(n)} | {(f"x{i}", f"x{i + 1}") for i in range(n)} | {("005", "x0")}
        found = graph.cycles(frame(spark, ring)).collect()
        assert [(r["cycle"], r["length"]) for r in found] == [([*(f"{i:03}" for i in range(n)), "000"], n)]
    chain = {(f"{i:03}", f"{i + 1:03}") for i in range(500)}
    assert graph.cyclic_core(frame(spark, chain)).count() == 0 and graph.cycles(frame(spark, chain)).count() == 0


def plain_reach(edges):
    nodes = {x for e in edges for x in e}
    to = {n: {b for a, b in edges if a == n} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in to[n]:
                to[n] |= to[k]
    return to


def test_parts_and_core_in_one_task_and_side_by_side(spark, monkeypatch):
    r = random.Random(6)
    for most, size in ((graph.ONE_TASK, 12), (3, 12), (3, 9)):
        monkeypatch.setattr(graph, "ONE_TASK", most)
        names = "abcdefghijkl"[:size]
        edges = {(r.choice(names), r.choice(names)) for _ in range(16)}
        to = plain_reach(edges)
        own = {n: min(m for m in to if m == n or (n in to[m] and m in to[n])) for n in to}
        parts = {tuple(x) for x in graph.strong_components(frame(spark, edges)).collect()}
        assert parts == {(a, b, own[a]) for a, b in edges if own[a] == own[b] and (a in to[b])}
        ringed = {n for n in to if n in to[n]}
        core = {(a, b) for a, b in edges if (a in ringed or any(a in to[c] for c in ringed)) and (b in ringed or any(c in to[b] for c in ringed))}
        assert {tuple(x) for x in graph.cyclic_core(frame(spark, edges)).collect()} == core
        got = [x["cycle"] for x in graph.cycles(frame(spark, edges), limit=6).collect()]
        assert got == all_cycles(edges)[:6]


def all_cycles(edges):
    found = []

    def walk(path):
        for a, b in sorted(edges):
            if a == path[-1]:
                if b == path[0]:
                    found.append([*path, b])
                elif b > path[0] and b not in path:
                    walk([*path, b])

    for n in sorted({x for e in edges for x in e}):
        walk([n])
    return sorted(found, key=lambda c: (len(c), c))


def test_first_cycles_against_all():
    r = random.Random(7)
    for _ in range(300):
        n = r.randrange(2, 8)
        edges = {(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(1, 14))}
        for part in {p for *_, p in graph._components(sorted(edges))}:
            own = [(a, b) for a, b, p in graph._components(sorted(edges)) if p == part]
            assert graph.first_cycles(own, 5) == all_cycles(own)[:5]
            assert graph.first_cycles(own, 50, 3) == [c for c in all_cycles(own) if len(c) <= 4][:50]


def test_short_cycles_need_no_parts(spark, monkeypatch):
    edges = {(a, b) for i in range(20) for a, b in ((f"{i:02}", f"{i + 50}"), (f"{i + 50}", f"{i:02}"))} | {("03", "03"), ("50", "01"), ("01", "07"), ("07", "00")}
    first = [x["cycle"] for x in graph.cycles(frame(spark, edges), 22).collect()]
    assert first == all_cycles(edges)[:22] and len(first[-1]) > 3
    monkeypatch.setattr(graph, "strong_components", None)
    assert [x["cycle"] for x in graph.cycles(frame(spark, edges)).collect()] == first[:20]


def test_first_cycles_of_long_rings_in_linear_time():
    began = time.monotonic()
    n = 30_000
    ring = [((i + 1) % n, i) for i in range(n)]
    assert graph.first_cycles(ring, 20) == [[0, *range(n - 1, -1, -1)]]
    assert time.monotonic() - began < 20
    r = random.Random(8)
    for _ in range(40):
        edges = {(i, (i + 1) % 9) for i in range(9) if i != 8} | {(8, r.randrange(3)), (r.randrange(9), r.randrange(9)), (r.randrange(5), r.randrange(5, 9))}
        own = [(a, b) for a, b, p in graph._components(sorted(edges)) if p == min(q for *_, q in graph._components(sorted(edges)))]
        for limit in (1, 3, 20):
            assert graph.first_cycles(own, limit) == all_cycles(own)[:limit]
