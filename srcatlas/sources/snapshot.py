"""An index on a file system: immutable versions of each repository, and numbered manifests."""

from __future__ import annotations

import json
import os
import re
import time
from hashlib import sha256
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas import schemas
from srcatlas.functions.embed import Embedder, embed, embedding_text
from srcatlas.lineage import cut
from srcatlas.operators import graph, upsert
from srcatlas.sources import routes, scan, symbols

TABLES = {**schemas.TABLES, "calls": schemas.CALLS, "repos": schemas.REPOS}


def slug(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9._-]+", "-", name).strip("-").lower() or "repo"


def derive_repo_name(path: str, name: str | None = None, branch: str | None = None) -> str:
    """The given name as a slug; else folder, branch and eight digits of the path's hash."""
    if name:
        return slug(name)
    whole = os.path.abspath(path)
    parts = [slug(os.path.basename(whole))]
    if branch:
        parts.append(slug(re.sub(r"[/\\@\s]+", "-", branch)))
    return "-".join([*parts, sha256(whole.encode()).hexdigest()[:8]])


def git_branch(path: str) -> str | None:
    """The checked-out branch of a local work tree, read from its HEAD; None if there is none."""
    at = os.path.join(os.path.abspath(path), ".git")
    try:
        if os.path.isfile(at):  # a linked work tree names its folder
            with open(at) as f:
                at = os.path.join(os.path.abspath(path), f.read().split(":", 1)[1].strip())
        with open(os.path.join(at, "HEAD")) as f:
            found = re.fullmatch(r"ref: refs/heads/(.+)", f.read().strip())
    except (OSError, IndexError):
        return None
    return (re.sub(r"[/\\@\s]+", "-", found[1]).lower().strip("-") or None) if found else None


def to_registry(path: str, workspace: str | None = None) -> str:
    """How the registry writes a path: relative to the workspace if there is one."""
    whole = os.path.abspath(path)
    if workspace is None:
        return whole
    relative = os.path.relpath(whole, workspace).replace("\\", "/")
    return relative if relative == "." or relative.startswith("..") else f"./{relative}"


def from_registry(path: str, workspace: str | None = None) -> str:
    if os.path.isabs(path) or workspace is None:
        return os.path.normpath(path)
    return os.path.normpath(os.path.join(workspace, path))


#: How each table's files are ordered, so that scans skip what they don't need.
ORDER = {"files": ["path"], "symbols": ["name"], "edges": ["callee_name"], "routes": ["file"], "calls": ["file"]}


class Store:
    """Tables by repository and version, and numbered manifests that say which version counts.

    A commit writes one repository's tables to a new folder and then the next manifest,
    aside and renamed; other repositories' files stay as they are. The highest manifest
    is the index: there is one at any time, so a reader never meets an empty index in
    between, and a lost writer leaves no trace but its folder, which ``gc`` removes. Each
    commit is put on the manifest that is there when it is published, so writers of
    different repositories don't undo one another. One writer a repository is expected.
    """

    def __init__(self, spark: SparkSession, root: str, workspace: str | None = None):
        """With a ``workspace`` the registry's paths are relative to it, so that both can be moved together."""
        self.spark, self.root, self.workspace = spark, root.rstrip("/"), workspace

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _names(self, folder: str) -> list[str]:
        fs, base = self._fs(folder)
        return [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []

    def current(self) -> int:
        """The number of the manifest that counts; 0 if there is none yet."""
        return max((int(n[:-5]) for n in self._names(f"{self.root}/manifests") if re.fullmatch(r"[0-9]+\.json", n)), default=0)

    def manifest(self) -> dict[str, dict]:
        """By repository: root_path, db_path, last_indexed (seconds), version."""
        for _ in range(5):
            n = self.current()
            if not n:
                return {}
            fs, path = self._fs(f"{self.root}/manifests/{n:012}.json")
            if fs.exists(path):  # else it was just removed, after a later one came
                stream = fs.open(path)
                try:
                    return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        raise RuntimeError("no manifest holds still")

    def _write(self, path: str, text: str, replace: bool) -> bool:
        """Whole or not at all: written aside, then renamed; False if the name is taken."""
        fs, aside = self._fs(f"{path}.{uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, target = self._fs(path)
        if replace and fs.exists(target):
            fs.delete(target, False)
        done = not fs.exists(target) and fs.rename(aside, target)
        if not done:
            fs.delete(aside, False)
        return done

    def _publish(self, change) -> int:
        while True:
            n, now = self.current() + 1, change(self.manifest())
            if self._write(f"{self.root}/manifests/{n:012}.json", json.dumps(now, sort_keys=True, indent=1), False):
                # for readers without Spark; nothing here depends on it
                self._write(f"{self.root}/repos.json", json.dumps([{"name": k, **v} for k, v in sorted(now.items())], indent=1), True)
                return n

    def table(self, name: str, repo: str | None = None) -> DataFrame:
        """A table of one repository, whose files alone are read, or of all."""
        known = self.manifest()
        if name == "repos":
            rows = [(k, v["root_path"], v["db_path"], v["last_indexed"]) for k, v in sorted(known.items()) if repo in (None, k)]
            found = self.spark.createDataFrame(rows, "name string, root_path string, db_path string, s double")
            return found.select("name", "root_path", "db_path", F.timestamp_seconds("s").alias("last_indexed"))
        paths = [f"{self.root}/data/{k}/{v['version']}/{name}" for k, v in sorted(known.items()) if repo in (None, k)]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def tables(self, repo: str | None = None) -> dict[str, DataFrame]:
        return {name: self.table(name, repo) for name in TABLES}

    def views(self, prefix: str = "") -> None:
        """The tables as temporary views, for SQL."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)

    def commit(self, repo: str, new: dict[str, DataFrame], root_path: str | None = None, stamp: float | None = None) -> int:
        """All tables of one repository as its next version; the number of the manifest."""
        version = uuid4().hex
        for name, columns in ORDER.items():
            rows = new[name].select([F.col(f.name).cast(f.dataType) for f in TABLES[name].fields])
            rows.sortWithinPartitions(*columns).write.parquet(f"{self.root}/data/{repo}/{version}/{name}")

        if root_path is not None and self.workspace is not None:
            root_path = to_registry(root_path, self.workspace)

        def change(known: dict) -> dict:
            old = known.get(repo, {})
            return known | {repo: {"root_path": root_path or old.get("root_path"), "db_path": self.root, "last_indexed": stamp or old.get("last_indexed"), "version": version}}

        return self._publish(change)

    def root_path(self, repo: str) -> str:
        found = self.manifest()[repo]["root_path"]
        return found if self.workspace is None else from_registry(found, self.workspace)

    def remove(self, repo: str) -> int:
        return self._publish(lambda known: {k: v for k, v in known.items() if k != repo})

    def gc(self) -> int:
        """Deletes versions and manifests that don't count any more; how many versions."""
        n, known = self.current(), self.manifest()
        for name in self._names(f"{self.root}/manifests"):
            if name != f"{n:012}.json":
                fs, path = self._fs(f"{self.root}/manifests/{name}")
                fs.delete(path, False)
        gone = [f"{self.root}/data/{repo}/{v}" for repo in self._names(f"{self.root}/data") for v in self._names(f"{self.root}/data/{repo}") if known.get(repo, {}).get("version") != v]
        for folder in gone:
            fs, path = self._fs(folder)
            fs.delete(path, True)
        return len(gone)

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    # ---- one watcher a repository

    def _claim(self, repo: str) -> str:
        return f"{self.root}/watchers/{repo}.json"

    def claim(self, repo: str, stale_seconds: float) -> None:
        """Marks the repository as watched; raises if another watcher gave a sign within ``stale_seconds``."""
        fs, path = self._fs(self._claim(repo))
        if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > stale_seconds:
            fs.delete(path, False)
        if not self._write(self._claim(repo), json.dumps({"repo": repo, "since": time.time()}), False):
            raise RuntimeError(f"{repo} is watched already")

    def beat(self, repo: str) -> None:
        fs, path = self._fs(self._claim(repo))
        if fs.exists(path):
            fs.setTimes(path, int(time.time() * 1000), -1)

    def release(self, repo: str) -> None:
        fs, path = self._fs(self._claim(repo))
        fs.delete(path, False)

    def watched(self, repo: str) -> bool:
        return self.exists(self._claim(repo))


def refresh(store: Store, root: str, repo: str, prune_missing: bool = False, embedder: Embedder | None = None, quick: bool = False) -> dict:
    """Brings the index of a tree up to date; only files of new or other content are parsed.

    Returns counts of indexed, skipped and removed files. ``prune_missing`` takes files
    out that are no longer there. With an ``embedder`` symbols without a vector get one,
    those of unchanged files too. ``quick`` reads only files whose time or size differs
    from the index; else all are read and compared by hash. Other repositories are
    neither read nor written.
    """
    repo = repo.lower()
    listed = cut(scan.list_tree(store.spark, root, repo))
    old = store.tables(repo)
    mine = old["files"]
    asked = listed
    if quick:
        same = mine.select("path", F.date_trunc("second", "mtime").alias("__at"), F.col("size").alias("__size"))
        asked = listed.withColumn("__at", F.date_trunc("second", "mtime")).withColumn("__size", F.col("size")).join(same, ["path", "__at", "__size"], "left_anti").select(listed.columns)
    scanned = scan.measured(scan.read_files(asked))
    changed = cut(upsert.changed_files(scanned, mine))
    total, indexed, gone_count = listed.count(), changed.count(), upsert.vanished_files(listed, mine).count()
    removed = gone_count if prune_missing else 0
    missing = embedder is not None and not old["symbols"].where(F.col("embedding").isNull()).isEmpty()
    if indexed or removed or missing or repo not in store.manifest():
        gone = changed.select("repo", "path")
        if prune_missing:
            gone = gone.unionByName(upsert.vanished_files(listed, mine).select("repo", "path"))
        found, calls = symbols.extract(changed)
        new = {
            "files": upsert.replace_rows(old["files"], changed.select([f.name for f in schemas.FILES.fields]), gone, "path"),
            "symbols": upsert.replace_rows(old["symbols"], found, gone, "file"),
            "calls": upsert.replace_rows(old["calls"], calls, gone, "file"),
            "routes": upsert.replace_rows(old["routes"], routes.extract_routes(changed), gone, "file"),
        }
        if embedder is not None:
            text = embedding_text(F.col("signature"), F.col("docstring"), F.col("name"))
            bare = new["symbols"].where(F.col("embedding").isNull())
            new["symbols"] = upsert.with_embeddings(new["symbols"], embed(bare.drop("embedding"), text, embedder).select("symbol_id", "embedding"))
        new["edges"] = graph.resolve_calls(new["calls"], new["symbols"])
        store.commit(repo, new, root, float(int(time.time())))
    return {"repo": repo, "indexed": indexed, "skipped": total - indexed, "removed": removed}
