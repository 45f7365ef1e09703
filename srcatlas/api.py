"""The index as one object: a method for each tool, with typed errors."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from srcatlas.functions import text as fn
from srcatlas.functions.embed import Embedder, for_query
from srcatlas.operators import graph, search, stats, upsert
from srcatlas.plans import pack
from srcatlas.sources import scan
from srcatlas.sources.snapshot import Store, derive_repo_name, git_branch, refresh
from srcatlas.streaming import watch as streaming


class AtlasError(Exception):
    """code is 400, 404 or 500; key says what is wrong."""

    def __init__(self, code: int, key: str, message: str):
        super().__init__(message)
        self.code, self.key, self.message = code, key, message

    def as_dict(self) -> dict:
        return {"error": {"code": self.code, "key": self.key, "message": self.message}}


class Atlas:
    """Indexes trees and answers queries; results are DataFrames, but for text and dicts where said."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, fresh_seconds: float = 60, workspace: str | None = None):
        """Results' freshness is looked up anew if the index changed, or after ``fresh_seconds``: it takes a listing of the tree."""
        self.spark, self.store, self.embedder, self.fresh_seconds = spark, Store(spark, root, workspace), embedder, fresh_seconds
        self._status: dict[str, tuple[int, float, Row]] = {}

    # ---- maintenance

    def index_folder(self, path: str, name: str | None = None, prune_missing: bool = False, embed: bool = False) -> dict:
        if not self.store.exists(path):
            raise AtlasError(400, "invalid_request", f"no such folder: {path}")
        return refresh(self.store, path, derive_repo_name(path, name, git_branch(path)), prune_missing, self.embedder if embed else None)

    index_repo = index_folder

    def invalidate_cache(self, repo: str, file: str | None = None, keep_routes: bool = False) -> int:
        """Takes a repository's rows out, or those of one file; how many files that were."""
        repo = self._known(repo)
        tables = self.store.tables(repo)
        n = tables["files"].where(F.lit(True) if file is None else F.col("path") == file).count()
        left = upsert.invalidate(tables, repo, file, keep_routes)
        gone = F.col("repo") == repo if file is None else (F.col("repo") == repo) & (F.col("file") == file)
        left["calls"] = tables["calls"].where(~gone)
        left["edges"] = graph.resolve_calls(left["calls"], left["symbols"])
        self.store.commit(repo, left)
        return n

    def remove_repo(self, repo: str) -> None:
        self.store.remove(self._known(repo))

    def gc_stale_indexes(self) -> list[str]:
        """Removes repositories whose tree is gone, and snapshots that are no longer current."""
        gone = [name for name in sorted(self.store.manifest()) if not self.store.exists(self.store.root_path(name))]
        for name in gone:
            self.remove_repo(name)
        self.store.gc()
        return gone

    def watch(self, path: str, checkpoint: str, name: str | None = None, interval: str = "5 seconds", idle_seconds: float = 1800, embed: bool = False):
        return streaming.watch(self.store, path, derive_repo_name(path, name, git_branch(path)), checkpoint, interval, idle_seconds, self.embedder if embed else None)

    # ---- lookups

    def list_repos(self) -> DataFrame:
        return self.store.table("repos").orderBy("name")

    def _known(self, repo: str) -> str:
        repo = repo.lower()
        if repo not in self.store.manifest():
            raise AtlasError(404, "repo_not_indexed", f"not indexed: {repo}")
        return repo

    def _root(self, repo: str) -> str:
        return self.store.root_path(repo)

    def sources(self, repo: str) -> DataFrame:
        """The repository's files with their content of now."""
        indexed = self.store.table("files", repo).select("repo", "path")
        return scan.read_files(scan.list_tree(self.spark, self._root(repo), repo).join(indexed, ["repo", "path"], "left_semi"))

    def _table(self, name: str, repo: str) -> DataFrame:
        return self.store.table(name, repo)

    def search_symbols(self, query: str, repo: str | None = None, kind: str | None = None, limit: int = 20) -> DataFrame:
        if not query or not query.strip():
            raise AtlasError(400, "invalid_request", "the query is empty")
        if repo is None:
            return search.search_symbols_by_repo(self.store.table("symbols"), query, kind, limit)
        repo = self._known(repo)
        found = search.search_symbols(self._table("symbols", repo), query, kind=kind, limit=limit)
        return self._rated(found, "symbol", repo)

    def _rated(self, found: DataFrame, kind: str, repo: str, score: Column | None = None) -> DataFrame:
        n, known = self.store.current(), self._status.get(repo)
        if known is None or known[0] != n or time.monotonic() - known[1] > self.fresh_seconds:
            self._status[repo] = known = (n, time.monotonic(), self.get_index_status(repo).first())
        status = known[2]
        path = F.col("file") if "file" in found.columns else F.col("path")
        handler = F.col("handler") if kind == "route" else None
        return found.withColumn("quality", fn.quality(kind, path, handler=handler, score=score, stale=F.lit(status["stale"]), last_indexed=F.lit(status["last_indexed"]), has_embeddings=F.lit(status["has_embeddings"])))

    def find(self, name: str, repo: str) -> DataFrame:
        """The first symbol that the name finds."""
        return self.search_symbols(name, repo, limit=1)

    def get_symbol(self, repo: str, file: str, start_byte: int, end_byte: int) -> DataFrame:
        if end_byte <= start_byte:
            raise AtlasError(400, "invalid_request", "the end must be behind the start")
        repo = self._known(repo)
        own = scan.read_files(scan.list_tree(self.spark, self._root(repo), repo).where(F.col("path") == file))
        if own.isEmpty():
            raise AtlasError(404, "file_not_found", f"no such file: {file}")
        piece = own.select("repo", search.byte_range(F.col("content"), F.lit(start_byte), F.lit(end_byte)).alias("source"))
        named = self._table("symbols", repo).where((F.col("file") == file) & (F.col("start_byte") == start_byte) & (F.col("end_byte") == end_byte)).drop("source")
        # a span that is no symbol's is read all the same
        return piece.join(named, "repo", "left").fillna({"name": "", "kind": ""})

    def get_symbols(self, names: list[str], repo: str) -> DataFrame:
        return search.symbols_named(self._table("symbols", self._known(repo)), names)

    def get_file_outline(self, repo: str, file: str) -> DataFrame:
        repo = self._known(repo)
        found = search.file_outline(self._table("symbols", repo), repo, file)
        if found.isEmpty():
            raise AtlasError(404, "file_not_found", f"no symbols of {file}")
        return self._rated(found, "outline", repo)

    def get_repo_outline(self, repo: str) -> dict:
        """The tree to three levels, and the counts of get_repo_stats' summary."""
        repo = self._known(repo)
        row = stats.repo_summary(*[self._table(t, repo) for t in ("files", "symbols", "routes")]).first()
        known = row.asDict() if row is not None else {}
        return {"repo": repo, "tree": self.get_file_tree(repo, 3), "stats": known | {"files": known.get("file_count", 0), "symbols": known.get("symbol_count", 0)}}

    def search_text(self, query: str, repo: str, file_pattern: str | None = None) -> DataFrame:
        if not query:
            raise AtlasError(400, "invalid_request", "the query is empty")
        repo = self._known(repo)
        return self._rated(search.search_text(self.sources(repo), query, pattern=file_pattern), "text", repo)

    def savings(self, results: DataFrame, repo: str) -> dict:
        """Tokens saved by result rows with a file and a text."""
        row = stats.search_savings(results, self.sources(self._known(repo))).first().asDict()
        return row | {"summary": stats.savings_text(row), "hint": stats.savings_hint(row)}

    def get_file_tree(self, repo: str, depth: int = 3) -> str:
        return graph.render_tree(self._table("files", self._known(repo)), depth)

    def semantic_search(self, query: str, repo: str, limit: int = 10) -> DataFrame:
        repo = self._known(repo)
        if self.embedder is None:
            raise AtlasError(500, "embedding_error", "no embedder is set")
        found = search.search_vectors(self._table("symbols", repo), for_query(self.embedder, query), limit=limit)
        return self._rated(found, "semantic", repo, F.col("score"))

    def get_callers(self, name: str, repo: str) -> DataFrame:
        repo = self._symbol(name, repo)
        return graph.callers(self._table("edges", repo), self._table("symbols", repo), name)

    def get_callees(self, name: str, repo: str) -> DataFrame:
        repo = self._symbol(name, repo)
        return graph.callees(self._table("edges", repo), name)

    def _symbol(self, name: str, repo: str) -> str:
        repo = self._known(repo)
        if self._table("symbols", repo).where(F.col("name") == name).isEmpty():
            raise AtlasError(404, "symbol_not_found", f"no symbol {name}")
        return repo

    def search_routes(self, repo: str, method: str | None = None, path_contains: str | None = None, limit: int = 50) -> DataFrame:
        repo = self._known(repo)
        return self._rated(search.search_routes(self._table("routes", repo), method=method, path_contains=path_contains, limit=limit), "route", repo)

    def build_context_pack(self, repo: str, query: str, token_budget: int | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
        repo = self._known(repo)
        if not query or not query.strip():
            raise AtlasError(400, "invalid_request", "the query is empty")
        return self._pack(repo, query, token_budget, include, exclude)[0]

    def context_pack_header(self, repo: str, query: str, token_budget: int | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> dict:
        """Budget, quality summary, warnings and hint of the pack with the same arguments."""
        repo = self._known(repo)
        rows, warnings, embedded = self._pack(repo, query, token_budget, include, exclude)
        return pack.header(rows, repo, query, token_budget, warnings, embedded, self.get_index_status(repo).first()["stale"])

    def _pack(self, repo: str, query: str, token_budget, include, exclude) -> tuple[DataFrame, list[str], bool]:
        index = pack.Index(self.sources(repo), *[self._table(t, repo) for t in ("symbols", "edges", "routes")])
        wanted, warnings = pack.filters(include, exclude)
        embedded, vector = not self._table("symbols", repo).where("embedding IS NOT NULL").isEmpty(), None
        if embedded and self.embedder is not None:
            try:
                vector = for_query(self.embedder, query)
            except Exception as e:  # noqa: BLE001  whatever an embedder raises, the pack goes without it
                warnings.append(f"semantic search failed: {e}")
        elif "semantic" in wanted:
            warnings.append("semantic search skipped: " + ("no embedder is set" if embedded else "repo has no embeddings"))
        return pack.context_pack(index, query, token_budget, include, exclude, vector=vector), warnings, embedded

    # ---- statistics

    def get_index_status(self, repo: str, now: Column | None = None) -> DataFrame:
        repo = self._known(repo)
        files = self._table("files", repo)
        listing = scan.list_tree(self.spark, self._root(repo), repo).select("repo", "path", "mtime")
        status = stats.index_status(files, listing, now if now is not None else F.current_timestamp())
        counts = files.groupBy("repo").agg(F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines_of_code"))
        vectors = search.has_embeddings(self._table("symbols", repo), ["repo"])
        number = self._table("symbols", repo).groupBy("repo").agg(F.count("*").alias("symbol_count"))
        out = status.join(counts, "repo", "left").join(vectors, "repo", "left").join(number, "repo", "left")
        out = out.withColumn("has_embeddings", F.coalesce("has_embeddings", F.lit(False))).withColumn("symbol_count", F.coalesce("symbol_count", F.lit(0))).withColumn("watcher_active", F.lit(self.store.watched(repo)))
        return out.withColumn("quality", fn.status_quality(F.col("stale"), F.col("last_indexed"), F.col("has_embeddings")))

    def get_repo_stats(self, repo: str) -> dict:
        repo = self._known(repo)
        files, symbols, edges, routes = (self._table(t, repo) for t in ("files", "symbols", "edges", "routes"))
        out = stats.repo_summary(files, symbols, routes).first().asDict()
        out["languages"] = {r["language"]: r["n"] for r in stats.language_distribution(files).orderBy("language").collect()}
        out["fan_in"] = [(r["file"], r["n"]) for r in stats.fan_in(edges).collect()]
        out["fan_out"] = [(r["file"], r["n"]) for r in stats.fan_out(edges).collect()]
        out["orphan_files"] = stats.orphans(files, symbols, edges).count()
        out["edge_count"] = edges.count()
        out["circular_dep_count"] = graph.cycles(graph.file_graph(edges)).count()
        return out

    def get_graph_diagram(self, repo: str, focus_file: str | None = None, depth: int = 2, direction: str = "LR", max_nodes: int = 50) -> dict:
        edges = self._table("edges", self._known(repo)).where("callee_file IS NOT NULL")
        if focus_file is not None:
            near = graph.neighbourhood(graph.file_graph(edges), focus_file, depth)
            edges = near.select(F.col("src").alias("caller_file"), F.col("dst").alias("callee_file"))
        return graph.diagram(edges, direction, max_nodes)

    def find_circular_deps(self, repo: str) -> DataFrame:
        return graph.cycles(graph.file_graph(self._table("edges", self._known(repo))))
