"""Replacing parts of the index: pure functions from old and new rows to the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that comes last."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def changed_files(scan: DataFrame, files: DataFrame) -> DataFrame:
    """Scanned files that the index doesn't have with the same hash."""
    return scan.join(files.select("repo", "path", "hash"), ["repo", "path", "hash"], "left_anti")


def unchanged_files(scan: DataFrame, files: DataFrame) -> DataFrame:
    return scan.join(files.select("repo", "path", "hash"), ["repo", "path", "hash"], "left_semi")


def vanished_files(scan: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed files that a scan of their repository no longer has."""
    return files.join(scan.select("repo", "path"), ["repo", "path"], "left_anti")


def replace_rows(old: DataFrame, new: DataFrame, gone: DataFrame, file: str) -> DataFrame:
    """``old`` without the rows of the (repo, path) in ``gone``, and ``new``."""
    keys = gone.select("repo", F.col("path").alias(file)).distinct()
    return old.join(keys, ["repo", file], "left_anti").unionByName(new, allowMissingColumns=True)


def invalidate(tables: dict[str, DataFrame], repo: str, path: str | None = None, keep_routes: bool = False) -> dict[str, DataFrame]:
    """All tables without a repository's rows, or those of one of its files."""
    names = {"files": "path", "symbols": "file", "edges": "caller_file", "routes": "file"}
    out = dict(tables)
    for name, column in names.items():
        if not (name == "routes" and keep_routes):
            hit = F.col("repo") == repo
            out[name] = tables[name].where(~(hit if path is None else hit & (F.col(column) == path)))
    return out


def with_embeddings(symbols: DataFrame, vectors: DataFrame) -> DataFrame:
    """``symbols`` with the new (symbol_id, embedding) put in."""
    new = vectors.select("symbol_id", F.col("embedding").alias("__new"))
    return symbols.join(new, "symbol_id", "left").withColumn("embedding", F.coalesce("__new", "embedding")).drop("__new").select(*symbols.columns)


def upsert_repos(repos: DataFrame, new: DataFrame) -> DataFrame:
    """Repositories by lower-cased name, the latest row of each."""
    both = repos.unionByName(new).withColumn("name", F.lower("name"))
    return last_wins(both, ["name"], ["last_indexed", "root_path", "db_path"])
