"""Call edges: one hop, neighbourhoods, cycles and diagrams."""

from __future__ import annotations

import posixpath
from collections import deque
from collections.abc import Iterator
from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas import languages
from srcatlas.lineage import cut

#: Edges of a graph, or of a strongly connected part, that one task works on; they are counted first. More are worked on side by side.
ONE_TASK = 1_000_000


def resolve_calls(calls: DataFrame, symbols: DataFrame, prefer_same_file: bool = False) -> DataFrame:
    """Edges from calls: the callee's file is the smallest one of the repository that defines the name, or null."""
    where = symbols.groupBy("repo", F.col("name").alias("callee_name")).agg(F.min("file").alias("callee_file"))
    found = calls.join(where, ["repo", "callee_name"], "left")
    if prefer_same_file:
        own = symbols.select("repo", F.col("file"), F.col("name").alias("callee_name")).distinct().withColumn("__own", F.col("file"))
        found = found.join(own, ["repo", "file", "callee_name"], "left").withColumn("callee_file", F.coalesce("__own", "callee_file"))
    return found.select(F.col("symbol_id").alias("caller_id"), "repo", F.col("file").alias("caller_file"), "caller_name", "callee_name", "callee_file").dropDuplicates(["caller_id", "callee_name", "callee_file"])


def callers(edges: DataFrame, symbols: DataFrame, name: str, repo: str | None = None) -> DataFrame:
    """The symbols that call a name."""
    hits = edges.where(F.col("callee_name") == name)
    hits = hits if repo is None else hits.where(F.col("repo") == repo)
    return symbols.join(hits.select(F.col("caller_id").alias("symbol_id")), "symbol_id")


def callees(edges: DataFrame, name: str, repo: str | None = None) -> DataFrame:
    """The names that symbols of a name call, with their files."""
    hits = edges.where(F.col("caller_name") == name)
    hits = hits if repo is None else hits.where(F.col("repo") == repo)
    return hits.select("callee_name", "callee_file")


def calls_in_symbols(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (repo, file, pos, callee_name) with each symbol of their file whose span holds the position.

    Files are laid out in cells, on a level for spans of each order of length: cells are
    powers of 4, at least as long as their spans and four times as long at most, so a
    span lies in one or two. Calls look into their cell on each level that spans have
    (32 at most). A span so meets only calls within eight times its length, however long
    its file is.
    """
    level = (F.ceil(F.length(F.bin(F.expr("end_byte - start_byte - 1"))) / 2) * 2).cast("int")
    s = symbols.select("repo", "file", "symbol_id", F.col("name").alias("caller_name"), "start_byte", "end_byte").where("end_byte > start_byte").withColumn("__level", level)
    cells = F.expr("sequence(shiftright(CAST(start_byte AS BIGINT), __level), shiftright(CAST(end_byte - 1 AS BIGINT), __level))")
    levels = F.broadcast(s.select("__level").distinct())
    placed = calls.crossJoin(levels).withColumn("__cell", F.expr("shiftright(CAST(pos AS BIGINT), __level)"))
    found = placed.join(s.withColumn("__cell", F.explode(cells)), ["repo", "file", "__level", "__cell"])
    return found.where("pos >= start_byte AND pos < end_byte").drop("start_byte", "end_byte", "__level", "__cell")


def file_graph(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) files of resolved edges."""
    return edges.where("callee_file IS NOT NULL AND caller_file IS NOT NULL").select(F.col("caller_file").alias("src"), F.col("callee_file").alias("dst")).distinct()


def neighbourhood(graph: DataFrame, focus, depth: int = 2) -> DataFrame:
    """Edges (src, dst) whose ends are both within ``depth`` hops of the focus, directions ignored."""
    both = graph.select("src", "dst").union(graph.select("dst", "src")).toDF("a", "b")
    reached = frontier = graph.sparkSession.range(1).select(F.lit(focus).alias("node"))
    for _ in range(depth):
        frontier = both.join(frontier, both.a == frontier.node, "left_semi").select(F.col("b").alias("node")).distinct().join(reached, "node", "left_anti")
        frontier = cut(frontier)
        reached = reached.union(frontier)
    kept = cut(reached.distinct())
    return graph.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def _trimmed(edges: list[tuple]) -> list[tuple]:
    """The edges left when nodes without predecessors or successors are taken away, again and again."""
    after: dict = {}
    before: dict = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        before.setdefault(b, set()).add(a)
    todo = [n for n in after.keys() | before.keys() if not (after.get(n) and before.get(n))]
    while todo:
        n = todo.pop()
        for m in after.pop(n, ()):
            before.get(m, set()).discard(n)
            if not before.get(m) and after.get(m):
                todo.append(m)
        for m in before.pop(n, ()):
            after.get(m, set()).discard(n)
            if not after.get(m) and before.get(m):
                todo.append(m)
    return [(a, b) for a, out in after.items() for b in out]


def _components(edges: list[tuple]) -> list[tuple]:
    """(src, dst, part) of the edges inside strongly connected parts; part is the least node."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    at: dict = {}
    low: dict = {}
    part: dict = {}
    held: list = []
    for root in after:
        if root in at:
            continue
        stack = [(root, iter(after[root]))]
        at[root] = low[root] = len(at)
        held.append(root)
        while stack:
            node, rest = stack[-1]
            for m in rest:
                if m not in at:
                    at[m] = low[m] = len(at)
                    held.append(m)
                    stack.append((m, iter(after.get(m, ()))))
                    break
                if m not in part:
                    low[node] = min(low[node], at[m])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[node])
                if low[node] == at[node]:
                    own = [held.pop()]
                    while own[-1] != node:
                        own.append(held.pop())
                    least = min(own)
                    part.update(dict.fromkeys(own, least))
    return [(a, b, part[a]) for a, b in edges if part[a] == part[b]]


def _in_one_task(edges: DataFrame, work, ddl: str) -> DataFrame:
    """``work`` on the list of all (src, dst): only for edges that were counted."""
    columns = [c.strip().split(" ")[0] for c in ddl.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [pair for batch in batches for pair in zip(batch["src"].tolist(), batch["dst"].tolist(), strict=True)]
        yield pd.DataFrame(work(rows), columns=columns)

    return edges.select("src", "dst").repartition(1).mapInPandas(run, ddl)


def cyclic_core(graph: DataFrame) -> DataFrame:
    """Edges that remain when nodes without predecessors or successors are taken away, again and again.

    While there are more than ONE_TASK edges, each round takes one layer off on all
    sides; the rest is done at once. Either way it goes on until nothing more falls away.
    """
    now = cut(graph.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    n = now.count()
    while n > ONE_TASK:
        sources, targets = now.select(F.col("src").alias("dst")).distinct(), now.select(F.col("dst").alias("src")).distinct()
        now = cut(now.join(targets, "src", "left_semi").join(sources, "dst", "left_semi").select("src", "dst"))
        left = now.count()
        if left == n:
            return now
        n = left
    kind = now.schema["src"].dataType.simpleString()
    return cut(_in_one_task(now, _trimmed, f"src {kind}, dst {kind}"))


def strong_components(graph: DataFrame) -> DataFrame:
    """(src, dst, part) of the edges inside strongly connected parts, self-loops included; part is the least node.

    While there are more than ONE_TASK edges, the least node that reaches a node is
    handed on until nothing changes; what reaches that node again, among those that got
    the same, is its part. The parts found are taken away, and the rest goes another
    round. What is left is done at once.
    """
    now = cyclic_core(graph)
    kind = now.schema["src"].dataType.simpleString()
    found = []
    while now.count() > ONE_TASK:
        color = cut(now.select(F.col("src").alias("n")).union(now.select("dst")).distinct().withColumn("c", F.col("n")))
        while True:
            least = cut(now.join(color, F.col("src") == F.col("n")).groupBy("dst").agg(F.min("c").alias("m")))
            new = cut(color.join(least, F.col("n") == F.col("dst"), "left").select("n", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved")))
            color = new.select("n", "c")
            if new.where("moved").isEmpty():
                break
        same = now.join(color.toDF("src", "a"), "src").join(color.toDF("dst", "b"), "dst").where("a = b").select("src", "dst", "a")
        same = cut(same)
        reach = step = cut(color.where("n = c").select("n", "c"))
        while not step.isEmpty():
            back = same.join(step, (F.col("dst") == F.col("n")) & (F.col("a") == F.col("c"))).select(F.col("src").alias("n"), "c").distinct()
            step = cut(back.join(reach, ["n", "c"], "left_anti"))
            reach = cut(reach.union(step))
        inside = reach.select(F.col("n").alias("src"), F.col("c").alias("part"))
        own = cut(now.join(inside, "src").join(inside.toDF("dst", "other"), "dst").where("part = other").select("src", "dst", "part"))
        found.append(own)
        gone = reach.select("n")
        now = cyclic_core(now.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti"))
    found.append(_in_one_task(now, _components, f"src {kind}, dst {kind}, part {kind}"))
    return cut(reduce(DataFrame.union, found))


def first_cycles(edges: list[tuple], limit: int, most_length: int | None = None) -> list[list]:
    """The first elementary cycles of a strongly connected part by length, then lexicographically, each from its least node.

    For each length in turn, paths from each node go through larger ones only, in order,
    and only where enough steps are left to come back. Where a length, from 4 on, has no
    cycle, the next to be tried is that of the shortest ones there are; looking for it
    from a node ends at the length that others have.
    """
    after: dict = {}
    before: dict = {}
    for a, b in sorted(set(edges)):
        after.setdefault(a, []).append(b)
        before.setdefault(b, []).append(a)
    found: list[list] = []

    def least_ones() -> list:
        """The nodes that may be the least of a cycle: smaller ones, and what ends without them, are taken away before each."""
        ways = [{n: len(x) for n, x in after.items()}, {n: len(x) for n, x in before.items()}]
        gone, kept = set(), []

        def take(todo: list) -> None:
            while todo:
                n = todo.pop()
                if n not in gone:
                    gone.add(n)
                    for left, others in zip(ways, (before, after), strict=True):
                        for m in others.get(n, ()):
                            left[m] -= 1
                            if not left[m]:
                                todo.append(m)

        take(list(after.keys() ^ before.keys()))
        for n in sorted(after):
            if n not in gone:
                kept.append(n)
                take([n])
        return kept

    def back(start, most: int | None) -> tuple[dict, bool]:
        """Steps needed to come to ``start`` from nodes behind it, up to ``most``; and whether that is all."""
        steps, todo = {start: 0}, deque([start])
        while todo:
            n = todo.popleft()
            if most is not None and steps[n] >= most:
                return steps, False
            for m in before.get(n, ()):
                if m >= start and m not in steps:
                    steps[m] = steps[n] + 1
                    todo.append(m)
        return steps, True

    def shortest(start, most: int | None) -> int | None:
        """Length of the shortest cycle of ``start`` and larger nodes, if there is one; of one longer than ``most`` only ``most`` + 1."""
        # both ways at once, each time from the side that has fewer nodes to go on from
        seen, ends, ways, steps = ({start}, {start}), [[start], [start]], (after, before), 0
        while all(ends):
            if most is not None and steps >= most:
                return most + 1
            i = int(len(ends[0]) > len(ends[1]))
            reached = []
            for n in ends[i]:
                for m in ways[i].get(n, ()):
                    if m in seen[1 - i]:
                        return steps + 1
                    if m > start and m not in seen[i]:
                        seen[i].add(m)
                        reached.append(m)
            ends[i] = reached
            steps += 1
        return None

    live = least_ones()
    floor: dict = {}  # no cycle from a node is shorter
    length = 1
    while live and len(found) < limit and (most_length is None or length <= most_length):
        n, still = len(found), []
        for start in live:
            if floor.get(start, 0) > length:
                still.append(start)
                continue
            steps, whole = back(start, length - 1)
            if not whole or any(m in steps for m in after[start]):
                still.append(start)
            if not any(steps.get(m, length) <= length - 1 for m in after[start]):
                continue
            path, on, stack = [start], {start}, [iter(after[start])]
            while stack and len(found) < limit:
                m = next(stack[-1], None)
                if m is None:
                    stack.pop()
                    on.discard(path.pop())
                elif len(path) == length:
                    if m == start:
                        found.append([*path, start])
                elif m not in on and steps.get(m, length) <= length - len(path) and m != start:
                    path.append(m)
                    on.add(m)
                    stack.append(iter(after[m]))
            if len(found) == limit:
                return found
        live = still
        ahead = length + 1
        if len(found) == n and length >= 4:
            # nodes that no cycle of larger ones leads back to are done with
            still, best = [], None
            for start in live:
                known = shortest(start, best)
                if known is not None:
                    floor[start] = known
                    still.append(start)
                    best = known if best is None else min(best, known)
            live = still
            ahead = max(ahead, best or ahead)
        length = ahead if length < len(after) else len(after) + 1
        if length > len(after):
            break
    return found


def cycles(graph: DataFrame, limit: int = 20, most_length: int | None = None) -> DataFrame:
    """(cycle, length): the first elementary cycles by length, then lexicographically, each from its smallest node and closed.

    Self-loops are cycles of length 1, and cycles may be of any length, unless
    ``most_length`` is given. Those of length 1 and 2 are edges to be found by one join;
    if they are ``limit``, that is all. Else cycles lie inside strongly connected parts,
    each of which is searched on its own for its first ``limit``; a part of more than
    ONE_TASK edges by paths that grow side by side.
    """
    graph = cut(graph.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    one = F.lit(1).cast("long")
    short = graph.where("src = dst").select(F.array("src", "dst").alias("cycle"), one.alias("length"))
    if most_length is None or most_length > 1:
        back = graph.where("src > dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        pairs = graph.where("src < dst").join(back, ["src", "dst"], "left_semi")
        short = short.union(pairs.select(F.array("src", "dst", "src").alias("cycle"), (one + one).alias("length")))
    short = cut(short.orderBy("length", "cycle").limit(limit))
    if short.count() >= limit or (most_length is not None and most_length <= 2):
        return short.orderBy("length", "cycle")
    inside = strong_components(graph)
    kind = inside.schema["src"].dataType.simpleString()
    ddl = f"cycle array<{kind}>, length long"
    sizes = cut(inside.groupBy("part").agg(F.count("*").alias("n")))

    def search(part: pd.DataFrame) -> pd.DataFrame:
        rows = first_cycles(list(zip(part["src"].tolist(), part["dst"].tolist(), strict=True)), limit, most_length)
        return pd.DataFrame({"cycle": rows, "length": [len(c) - 1 for c in rows]})

    small = inside.join(sizes.where(f"n <= {ONE_TASK}").select("part"), "part", "left_semi")
    found = [small.groupBy("part").applyInPandas(search, ddl)]
    if not sizes.where(f"n > {ONE_TASK}").isEmpty():
        found.append(_grown(cut(inside.join(sizes.where(f"n > {ONE_TASK}").select("part"), "part", "left_semi")), limit, most_length))
    return reduce(DataFrame.union, found).orderBy("length", "cycle").limit(limit)


def _grown(core: DataFrame, limit: int, most_length: int | None) -> DataFrame:
    """Cycles by paths that grow from their smallest node through larger ones; no more lengths are tried once ``limit`` are found."""
    paths = core.where("src <= dst").select(F.array("src").alias("path"), F.col("dst").alias("next"))
    found, n = None, 0
    for length in count(1) if most_length is None else range(1, most_length + 1):
        closed = paths.where("next = path[0]").select(F.concat("path", F.array("next")).alias("cycle"), F.lit(length).cast("long").alias("length"))
        closed = cut(closed.orderBy("cycle").limit(limit - n))
        found = closed if found is None else found.union(closed)
        n += closed.count()
        if n >= limit:
            break
        grown = paths.where("next > path[0]").select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("src"))
        step = grown.join(core.select("src", "dst"), "src").where("dst >= path[0] AND (dst = path[0] OR NOT array_contains(path, dst))")
        paths = cut(step.select("path", F.col("dst").alias("next")))
        if paths.isEmpty():
            break
    return found


def node_frequency(graph: DataFrame, limit: int = 50) -> DataFrame:
    """The nodes that most edges touch; an edge to itself counts twice."""
    ends = graph.select(F.col("src").alias("node")).union(graph.select("dst"))
    return ends.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(limit)


def diagram(edges: DataFrame, direction: str = "LR", max_nodes: int = 50) -> dict:
    """A Mermaid graph of files; of many the most frequent, as far as ``max_nodes``.

    Only edges among the kept files come to the driver. An edge is drawn as one of a
    cycle if its target reaches its source.
    """
    pairs = edges.select(F.col("caller_file").alias("src"), F.col("callee_file").alias("dst"))
    top = node_frequency(pairs, max_nodes + 1).select("node").collect()
    if not top:
        return {"diagram": f"graph {direction}", "node_count": 0, "edge_count": 0, "truncated": False}
    nodes = sorted(r["node"] for r in top[:max_nodes])
    kept = pairs.where(F.col("src").isin(nodes) & F.col("dst").isin(nodes) & (F.col("src") != F.col("dst"))).distinct().orderBy("src", "dst").collect()
    links = [(r["src"], r["dst"]) for r in kept]
    after: dict[str, set[str]] = {}
    for a, b in links:
        after.setdefault(a, set()).add(b)

    def reaches(a: str, b: str) -> bool:
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            if x == b:
                return True
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        return False

    alias = {f: f"n{i}" for i, f in enumerate(nodes)}
    red = [reaches(b, a) for a, b in links]
    out = [f"graph {direction}", *(f'    {alias[f]}["{posixpath.basename(f)}"]' for f in nodes)]
    out += [f"    {alias[a]} {'-->|cycle|' if r else '-->'} {alias[b]}" for (a, b), r in zip(links, red, strict=True)]
    out += [f"    linkStyle {i} stroke:red" for i, r in enumerate(red) if r]
    out += [f"    style {alias[f]} fill:{languages.COLORS.get(posixpath.splitext(f)[1].lower(), languages.NO_COLOR)}" for f in nodes]
    return {"diagram": "\n".join(out), "node_count": len(nodes), "edge_count": len(links), "truncated": len(top) > max_nodes}


def file_tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """(parent, name, level, is_dir) of every path's ancestors down to ``depth`` levels."""
    parts = F.split("path", "/")
    levels = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth)))
    rows = files.select(parts.alias("p"), F.explode(levels).alias("level"))
    joined = F.array_join(F.slice("p", 1, F.col("level") - 1), "/")
    return rows.select(joined.alias("parent"), F.element_at("p", F.col("level")).alias("name"), F.col("level").cast("long").alias("level"), (F.size("p") > F.col("level")).alias("is_dir")).distinct()


def render_tree(files: DataFrame, depth: int = 3) -> str:
    """The tree as text, children by name."""
    under: dict[str, list] = {}
    for r in file_tree(files, depth).orderBy("name").collect():
        under.setdefault(r["parent"], []).append(r)

    def lines(parent: str, head: str) -> list[str]:
        out, own = [], under.get(parent, [])
        for i, r in enumerate(own):
            last = i == len(own) - 1
            out.append(f"{head}{'└── ' if last else '├── '}{r['name']}{'/' if r['is_dir'] else ''}")
            if r["is_dir"]:
                out += lines(f"{parent}/{r['name']}".lstrip("/"), head + ("    " if last else "│   "))
        return out

    return "\n".join(lines("", ""))
