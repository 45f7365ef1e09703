"""The context pack: evidence of five kinds for a query, ranked, and chosen greedily under a token budget."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from srcatlas.functions import text as fn
from srcatlas.lineage import cut
from srcatlas.operators import search

# The filter that each candidate type answers to, and the limits of the gathering.
FILTERS = {"symbol": "symbols", "text": "text", "route": "routes", "semantic": "semantic", "graph_neighbor": "graph", "doc": "docs", "test": "tests"}
SOURCE_BYTES = 3000
SYMBOLS_A_TERM, ROUTES_A_TERM, SEMANTIC, NEIGHBOUR_NAMES = 8, 20, 8, 5
RANKS = {"symbol": 100.0, "text": 90.0, "doc": 60.0, "test": 60.0, "route": 85.0, "semantic": 75.0, "graph_neighbor": 65.0}


@dataclass
class Index:
    """The tables of one or more repositories; files have their content."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    routes: DataFrame


COLUMNS = ["type", "repo", "file", "start_byte", "end_byte", "line", "title", "key_title", "text", "rank_score", "ord"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def filters(include: list[str] | str | None, exclude: list[str] | str | None) -> tuple[list[str], list[str]]:
    """The types wanted, and warnings on filters that nobody knows."""
    warnings: list[str] = []

    def known(raw, label: str) -> set[str]:
        values = {v.strip().lower() for v in (raw.split(",") if isinstance(raw, str) else raw or []) if v and v.strip()}
        warnings.extend(f"unknown {label} filter ignored: {v}" for v in sorted(values - set(FILTERS.values())))
        return values & set(FILTERS.values())

    wanted, unwanted = known(include, "include"), known(exclude, "exclude")
    return [t for t, f in FILTERS.items() if (not wanted or f in wanted) and f not in unwanted], warnings


def candidates(index: Index, query: str, repo: str | None = None, vector: list[float] | None = None) -> DataFrame:
    """All evidence for the query, without sources. A term's limits hold for each term on its own; each table is scanned once for all."""
    scoped = lambda df: df if repo is None else df.where(F.col("repo") == repo)
    terms, parts = fn.query_terms(query), []
    symbols = cut(search.symbols_by_term(scoped(index.symbols), terms, SYMBOLS_A_TERM).select("symbol_id", "repo", "file", "name", "start_byte", "end_byte", "ord"))
    typed = lambda kind: [F.lit(kind).alias("type"), F.lit(RANKS[kind]).alias("rank_score")]
    parts.append(symbols.select(*typed("symbol"), "repo", "file", "start_byte", "end_byte", F.col("name").alias("title"), F.col("name").alias("key_title"), "ord"))
    kind = fn.path_kind(F.col("file"))
    rank = F.when(kind == "text", RANKS["text"]).otherwise(RANKS["doc"])
    found = search.text_by_term(scoped(index.files), terms)
    parts.append(found.select(kind.alias("type"), rank.alias("rank_score"), "repo", "file", "line", F.col("file").alias("title"), F.substring("text", 1, 24).alias("key_title"), "text", "ord"))
    routes = search.routes_by_term(scoped(index.routes), terms, ROUTES_A_TERM)
    label = F.concat_ws(" ", "method", "path")
    parts.append(routes.select(*typed("route"), "repo", "file", "start_byte", "end_byte", label.alias("title"), F.coalesce(F.nullif("handler", F.lit("")), "path").alias("key_title"), "ord"))
    if vector is not None:
        near = search.search_vectors(scoped(index.symbols), vector, limit=SEMANTIC)
        rank = F.round(F.lit(RANKS["semantic"]) + F.col("score"), 4)
        parts.append(near.select(F.lit("semantic").alias("type"), rank.alias("rank_score"), "repo", "file", "start_byte", "end_byte", F.col("name").alias("title"), F.col("name").alias("key_title"), F.lit(0).alias("ord")))
    names = symbols.groupBy("name").agg(F.min(F.struct("ord", "file", "start_byte")).alias("first")).orderBy("first", "name").limit(NEIGHBOUR_NAMES).select(F.col("name").alias("of"))
    names = F.broadcast(names)  # NEIGHBOUR_NAMES rows
    edges = scoped(index.edges)
    callers = edges.join(names, F.col("callee_name") == F.col("of")).select(F.col("caller_id").alias("symbol_id"), "of").distinct()
    callers = scoped(index.symbols).join(callers, "symbol_id").select("repo", "file", "start_byte", "end_byte", F.concat(F.lit("caller of "), "of").alias("title"), F.col("name").alias("key_title"))
    zero = F.lit(0).cast("long")
    callees = edges.where("callee_file IS NOT NULL").join(names, F.col("caller_name") == F.col("of")).select("repo", F.col("callee_file").alias("file"), zero.alias("start_byte"), zero.alias("end_byte"), F.concat(F.lit("callee of "), "of").alias("title"), F.col("callee_name").alias("key_title"))
    parts.append(callers.unionByName(callees).distinct().select(*typed("graph_neighbor"), "*", F.lit(0).alias("ord")))
    return _union(parts)


def best_of(found: DataFrame) -> DataFrame:
    """One candidate an id, the best; ids say type, file, place and title."""
    at = F.coalesce(F.col("start_byte").cast("string"), F.col("line").cast("string"), F.lit(""))
    ident = F.concat_ws(":", "type", F.coalesce("file", F.lit("")), at, F.coalesce(F.col("end_byte").cast("string"), F.lit("")), F.coalesce("key_title", F.lit("")))
    w = Window.partitionBy("repo", "id").orderBy(F.desc("rank_score"), "ord", F.coalesce("title", F.lit("")))
    return found.withColumn("id", ident).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


#: Candidates up to so many are broadcast to the files, after they are counted. Names that are called from everywhere have more.
BROADCAST_ROWS = 1_000_000


def with_sources(found: DataFrame, files: DataFrame) -> DataFrame:
    """Stored candidates, with __i, and their source and token estimate.

    Files are read where they lie: pieces of at most SOURCE_BYTES leave them, no content.
    """
    spans = found.where("text IS NULL").select("__i", "repo", "file", "start_byte", "end_byte")
    spans = F.broadcast(spans) if found.count() <= BROADCAST_ROWS else spans
    content = files.select("repo", F.col("path").alias("file"), F.col("content").cast("binary").alias("__content"))
    read = search.byte_range(F.col("__content"), F.col("start_byte"), F.col("end_byte"), SOURCE_BYTES)
    pieces = content.join(spans, ["repo", "file"]).select("__i", read.alias("__read"))
    joined = found.join(pieces, "__i", "left")
    return joined.withColumn("source", F.coalesce("text", "__read", F.lit(""))).withColumn("tokens", fn.token_estimate(F.col("source"))).drop("__read")


def choose(items: DataFrame, budget: int) -> DataFrame:
    """``items`` (n, tokens, outline_tokens and what else) with state selected, outlined or omitted, and what each takes.

    In order of n an item is taken if it fits what is left. One that doesn't fit while
    none is taken is taken as its outline; others are omitted, and later smaller ones
    may still fit. That goes from one to the next, so the numbers pass through one task
    in order, which holds nothing but what is used.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, first = 0, True
        for batch in batches:
            out = []
            for tokens, outline in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if tokens <= budget - used:
                    out.append((tokens, "selected"))
                elif first:
                    out.append((min(outline, budget), "outlined"))
                else:
                    out.append((0, "omitted"))
                    continue
                used, first = used + out[-1][0], False
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in out], pa.int64()), pa.array([s for _, s in out], pa.string())], names=["n", "took", "state"])

    narrow = items.select(F.col("n").cast("long"), F.col("tokens").cast("long"), F.col("outline_tokens").cast("long"))
    walked = narrow.repartition(1).sortWithinPartitions("n").mapInArrow(walk, "n long, took long, state string")
    return items.join(walked, "n")


def limits(budget: int | None) -> tuple[int, int, int]:
    """Budget, reserve and what is available."""
    whole = max(1, int(budget or 6000))
    reserve = max(1, whole // 10)
    return whole, reserve, max(1, whole - reserve)


def context_pack(index: Index, query: str, token_budget: int | None = None, include: list[str] | str | None = None, exclude: list[str] | str | None = None, repo: str | None = None, vector: list[float] | None = None) -> DataFrame:
    """The pack, a row a candidate: its place, type, id, source, tokens used, state, bucket and quality."""
    if not query or not query.strip():
        raise ValueError("the query is empty")
    _, _, available = limits(token_budget)
    wanted, _ = filters(include, exclude)
    found = best_of(candidates(index, query, repo, vector)).where(F.col("type").isin(wanted))
    found = cut(found.withColumn("__i", F.monotonically_increasing_id()))
    zero = lambda c: F.coalesce(c, F.lit(0))
    order = Window.partitionBy().orderBy(F.desc("rank_score"), F.coalesce("file", F.lit("")), zero(F.col("start_byte")), zero(F.col("line")), F.coalesce("title", F.lit("")), "repo", "id")
    placed = found.select("__i", "rank_score", "file", "start_byte", "line", "title", "repo", "id").select("__i", F.row_number().over(order).cast("long").alias("n"))
    outline = F.concat_ws(" ", "type", F.concat(F.coalesce("title", F.lit("")), F.lit(" in "), F.coalesce("file", F.lit(""))))
    kept = with_sources(found, index.files).join(placed, "__i").withColumn("outline", outline).withColumn("outline_tokens", fn.token_estimate(F.col("outline")))
    chosen = choose(cut(kept.drop("__i")), available)
    bucket = F.when(F.col("state") == "omitted", F.lit(None)).when(F.col("type").isin("symbol", "semantic"), "symbols").when(F.col("type") == "route", "routes").when(F.col("type") == "graph_neighbor", "graph_neighbors").when(F.col("type") == "doc", "docs").when(F.col("type") == "test", "tests")
    kind = {"symbol": "symbol", "graph_neighbor": "symbol", "semantic": "semantic", "route": "route"}
    by_type = F.when(F.lit(False), fn.quality("text", F.col("file")))
    for t in FILTERS:
        by_type = by_type.when(F.col("type") == t, fn.quality(kind.get(t, "text"), F.col("file"), handler=F.col("key_title"), score=F.col("rank_score") - RANKS["semantic"]))
    shown = F.when(F.col("state") == "outlined", F.col("outline")).otherwise(F.col("source"))
    return chosen.select("n", "type", "id", "repo", "file", "title", "rank_score", F.col("tokens").alias("estimated_tokens"), F.col("took").alias("used_tokens"), "state", bucket.alias("bucket"), shown.alias("source"), by_type.alias("quality"))


def header(pack: DataFrame, repo: str, query: str, token_budget: int | None, warnings: list[str], has_embeddings: bool, stale: bool | None) -> dict:
    """What stands above a pack: budget, quality summary, warnings and a hint. One row of sums comes to the driver."""
    whole, reserve, available = limits(token_budget)
    taken = F.col("state") != "omitted"
    confidence = F.when(taken, F.col("quality.confidence"))
    row = pack.agg(F.count_if(taken).alias("n"), F.count_if(~taken).alias("omitted"), F.coalesce(F.sum("used_tokens"), F.lit(0)).alias("used"), F.max(confidence).alias("hi"), F.min(confidence).alias("lo")).first()
    return {
        "repo": repo,
        "query": query,
        "budget": {"requested_tokens": whole, "reserved_tokens": reserve, "available_tokens": available, "estimated_tokens": min(row["used"], available), "tokenizer": "estimate", "approximate": True},
        "quality_summary": {"item_count": row["n"], "highest_confidence": row["hi"], "lowest_confidence": row["lo"], "index_fresh": None if stale is None else not stale, "has_embeddings": has_embeddings, "warnings": list(warnings)},
        "warnings": list(warnings),
        "agent_hint": "Use the selected evidence first; omitted candidates exceeded the budget." if row["omitted"] else "Use the selected evidence as source-backed context for this query.",
    }
