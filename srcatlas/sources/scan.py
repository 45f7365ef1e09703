"""Reading source trees: which files count, their hashes and lines, and ignore rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.functions import text as fn
from srcatlas.lineage import cut

# Directories and extensions that are never read, and patterns that are always ignored.
SKIP_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", ".tox", "dist", "build", ".mypy_cache", ".pytest_cache"]
SKIP_EXTENSIONS = [".pyc", ".pyo", ".so", ".dylib", ".dll", ".exe", ".bin", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".pdf", ".zip", ".tar", ".gz", ".whl", ".egg", ".db", ".sqlite", ".sqlite3", ".lock"]
DEFAULT_IGNORES = [
    "__pycache__/", "*.pyc", ".venv/", "venv/", "node_modules/", "dist/", "build/", ".next/", ".nuxt/", "coverage/", ".coverage",
    "*.min.js", "*.min.css", "*.map", "*.egg-info/", ".git/", ".pytest_cache/", ".mypy_cache/", ".ruff_cache/", ".worktrees/", ".srcatlas/",
]
IGNORE_FILES = [".gitignore", ".srcatlasignore"]


def ignore_rule(line: str) -> tuple[str, bool] | None:
    """(regular expression over relative paths, whether it ignores) of one line of an ignore file."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    keep = line.startswith("!")
    line = line[1:] if keep or line.startswith(("\\#", "\\!")) else line
    folder, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1 + (line[i : i + 2] == "**")
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            inside = line[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            out, i = out + re.escape(line[i]), i + 1
    return ("^" + ("" if anchored else "(?:.*/)?") + out + ("/.*" if folder else "(?:/.*)?") + "$", not keep)


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the last rule that matches ignores the path."""
    rules = [r for r in map(ignore_rule, lines) if r]
    return reduce(lambda below, r: F.when(path.rlike(r[0]), F.lit(r[1])).otherwise(below), rules, F.lit(False))


def _root(spark: SparkSession, root: str) -> str:
    """The root as Spark's file listing writes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.makeQualified(path).toString().rstrip("/")


_SCHEME = r"^[a-z][a-z0-9+.-]*:/*"
#: So many files at most are named one by one to Spark; of more, their folders are.
NAMED = 5_000
#: Bytes of hidden files that the driver holds at once.
HELD = 64 << 20


def _hidden(spark: SparkSession, base: str) -> tuple[list[str], list[tuple[str, int, int]]]:
    """What Spark's listing leaves out as its name starts with . or _: folders, and files with their time and size."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    folders, rows, level = [], [], base
    while len(fs.globStatus(jvm.org.apache.hadoop.fs.Path(level + "/*")) or ()):
        for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(level + "/[._]*")) or ():
            name = s.getPath().toString()
            if any(part in SKIP_DIRS for part in name[len(base) :].split("/")):
                continue
            if s.isDirectory():
                folders.append(name)
            else:
                rows.append((name, s.getModificationTime(), s.getLen()))
        level += "/*"
    return folders, rows


def _binary(spark: SparkSession, paths: list[str], recursive: bool) -> DataFrame:
    """Files as Spark reads them; names are taken as they are."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("__globPaths__", "false").load(paths)


def list_tree(spark: SparkSession, root: str, repo: str, ignores: list[str] | None = None) -> DataFrame:
    """(repo, path, mtime, size, uri, hidden) of a tree's files that are neither skipped nor ignored. No content is read.

    Ignore files at the root are the exception: their lines come to the driver.
    """
    base = _root(spark, root)
    folders, hidden = _hidden(spark, base)
    files = _binary(spark, [base, *folders], True).select(F.col("path").alias("uri"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.lit(False).alias("hidden"))
    if hidden:
        rows = spark.createDataFrame(hidden, "uri string, ms long, size long")
        files = files.unionByName(rows.select("uri", F.timestamp_millis("ms").alias("mtime"), "size", F.lit(True).alias("hidden")))
    start = len(re.sub(_SCHEME, "/", base)) + 2
    bare = F.regexp_replace("uri", _SCHEME, "/")
    found = files.select(F.lit(repo).alias("repo"), F.substr(bare, F.lit(start)).alias("path"), "mtime", "size", "uri", "hidden")
    if ignores is None:
        rules = {name: uri for uri, *_ in hidden if (name := uri[len(base) + 1 :]) in IGNORE_FILES}
        ignores = [line for name in IGNORE_FILES if name in rules for line in _bytes(spark, rules[name]).decode("utf-8", "replace").splitlines()]
    return keep_sources(found, DEFAULT_IGNORES + ignores)


def _bytes(spark: SparkSession, uri: str) -> bytes:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    stream = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(path)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_files(listed: DataFrame) -> DataFrame:
    """(repo, path, mtime, size, content) of listed files; nothing else of the tree is read.

    Names come to the driver, as they do for any listing of Spark's. Spark refuses files
    whose name starts with . or _ even where they are named, so these are read on the
    driver, HELD bytes at a time, and stored: package markers and settings, as a rule.
    """
    spark = listed.sparkSession
    listed = cut(listed)
    columns = ["repo", "path", "mtime", "size", "content"]
    plain = [r["uri"] for r in listed.where("NOT hidden").select("uri").collect()]
    if len(plain) > NAMED:
        plain = sorted({uri.rpartition("/")[0] for uri in plain})
    out = []
    if plain:
        content = _binary(spark, plain, False).select(F.col("path").alias("uri"), "content")
        out.append(content.join(listed.where("NOT hidden"), "uri").select(columns))
    held, size = [], 0
    for r in [*listed.where("hidden").select("uri", "size").toLocalIterator(), None]:
        if held and (r is None or size + r["size"] > HELD):
            got = spark.createDataFrame(held, "uri string, content binary")
            out.append(cut(got).join(listed, "uri").select(columns))
            held, size = [], 0
        if r is not None:
            held.append((r["uri"], bytearray(_bytes(spark, r["uri"]))))
            size += r["size"]
    if not out:
        return spark.createDataFrame([], "repo string, path string, mtime timestamp, size long, content binary")
    return reduce(DataFrame.unionByName, out)


def scan_tree(spark: SparkSession, root: str, repo: str, ignores: list[str] | None = None) -> DataFrame:
    """(repo, path, mtime, size, content) of a tree's files that are neither skipped nor ignored: listed first, then read."""
    return read_files(list_tree(spark, root, repo, ignores))


def keep_sources(files: DataFrame, lines: list[str]) -> DataFrame:
    """``files`` without those below skipped directories, of skipped extensions, or ignored."""
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    skipped = F.arrays_overlap(folders, F.array(*map(F.lit, SKIP_DIRS))) | F.lower(fn.extension(F.col("path"))).isin(SKIP_EXTENSIONS)
    return files.where(~skipped & ~ignored(F.col("path"), lines))


def measured(files: DataFrame, now: Column | None = None) -> DataFrame:
    """Files with hash, lines of code and the time of indexing."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    stamped = F.date_trunc("second", now if now is not None else F.current_timestamp())
    return files.withColumn("hash", F.sha2("content", 256)).withColumn("line_count", fn.lines_of_code(text)).withColumn("indexed_at", stamped)
