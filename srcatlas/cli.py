"""python -m srcatlas.cli ROOT COMMAND ...: the same queries from a shell, as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from srcatlas.api import Atlas, AtlasError
from srcatlas.functions.embed import HashingEmbedder


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="srcatlas")
    top.add_argument("root", help="folder of the index")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, /, *positional: str, **options) -> None:
        p = sub.add_parser(name)
        for x in positional:
            p.add_argument(x)
        for x, kind in options.items():
            flag = f"--{x.replace('_', '-')}"
            p.add_argument(flag, action="store_true") if kind is bool else p.add_argument(flag, type=kind)

    for name in ("index", "index-folder", "index-repo"):
        command(name, "path", name=str, embed=bool, prune=bool)
    command("watch", "path", "checkpoint", name=str, embed=bool)
    command("search", "query", repo=str, kind=str, limit=int)
    command("find", "name", "repo")
    command("outline", "repo", "file")
    command("text", "query", "repo", pattern=str)
    command("semantic", "query", "repo", limit=int)
    command("pack", "repo", "query", budget=int)
    command("callers", "name", "repo")
    command("callees", "name", "repo")
    for name in ("repos", "list-repos"):
        command(name)
    command("status", "repo")
    command("tree", "repo", depth=int)
    command("routes", "repo", method=str, path=str)
    command("invalidate", "repo", file=str)
    command("stats", "repo")
    command("cycles", "repo")
    command("gc")
    return top


def run(atlas: Atlas, a: argparse.Namespace):
    given = lambda **kw: {k: v for k, v in kw.items() if v is not None}
    commands = {
        "index": lambda: atlas.index_folder(a.path, a.name, prune_missing=a.prune, embed=a.embed),
        "watch": lambda: atlas.watch(a.path, a.checkpoint, a.name, embed=a.embed).awaitTermination(),
        "search": lambda: atlas.search_symbols(a.query, a.repo, a.kind, **given(limit=a.limit)),
        "find": lambda: atlas.find(a.name, a.repo),
        "outline": lambda: atlas.get_file_outline(a.repo, a.file),
        "text": lambda: atlas.search_text(a.query, a.repo, a.pattern),
        "semantic": lambda: atlas.semantic_search(a.query, a.repo, **given(limit=a.limit)),
        "pack": lambda: atlas.build_context_pack(a.repo, a.query, a.budget),
        "callers": lambda: atlas.get_callers(a.name, a.repo),
        "callees": lambda: atlas.get_callees(a.name, a.repo),
        "repos": lambda: atlas.list_repos(),
        "routes": lambda: atlas.search_routes(a.repo, a.method, a.path),
        "invalidate": lambda: {"files": atlas.invalidate_cache(a.repo, a.file)},
        "stats": lambda: atlas.get_repo_stats(a.repo),
        "cycles": lambda: atlas.find_circular_deps(a.repo),
        "gc": lambda: {"removed": atlas.gc_stale_indexes()},
        "status": lambda: atlas.get_index_status(a.repo),
        "tree": lambda: {"tree": atlas.get_file_tree(a.repo, **given(depth=a.depth))},
    }
    aliases = {"index-folder": "index", "index-repo": "index", "list-repos": "repos"}
    return commands[aliases.get(a.command, a.command)]()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    atlas = Atlas(spark or SparkSession.builder.appName("srcatlas").getOrCreate(), a.root, HashingEmbedder())
    try:
        out = run(atlas, a)
    except AtlasError as e:
        print(json.dumps(e.as_dict()))
        return 1
    for row in out.drop("embedding", "content").toJSON().toLocalIterator() if isinstance(out, DataFrame) else [json.dumps(out, default=str)]:
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
