"""Queries of the engine's first half: what is read from source files, with SQL that finds it by other means.

The files are made from the documents' ids: one small source a document in each
language, behind a comment of the id's length, so that positions differ from file to
file. The SQL looks up the same pieces of text with strpos and knows what they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.operators import graph, upsert
from srcatlas.sources import routes, scan, symbols
from srcatlas.plans.catalog import query, table


@dataclass
class Source:
    """A file: # stands for the document's id. Facts are (name, kind, first and last piece of the span)."""

    path: str
    text: str
    symbols: list[tuple[str, str, str, str]] = field(default_factory=list)
    routes: list[tuple[str, str, str, str, str]] = field(default_factory=list)  # method, path, handler, first and last piece
    calls: list[tuple[str, str]] = field(default_factory=list)  # caller, callee


SOURCES = {
    "python": Source(
        "m#.py",
        '"""é #"""\nimport os\n\n\n@cached\ndef load#(path):\n    """Reads #."""\n    return os.path.join(path, tidy#(path))\n\n\nclass Store#:\n    def get#(self):\n        return load#(self)\n',
        [("load#", "function", "def load#", "tidy#(path))"), ("Store#", "class", "class Store#", "load#(self)"), ("get#", "method", "def get#", "load#(self)")],
        calls=[("load#", "join"), ("load#", "tidy#"), ("get#", "load#")],
    ),
    "javascript": Source(
        "m#.js",
        "// é #\nclass Cart# {\n  total#(tax) { return sum#(tax); }\n}\nfunction pay#(cart) { return cart.total#(1); }\nconst ship# = async (x) => x;\n",
        [("Cart#", "class", "class Cart#", "}\n}"), ("total#", "method", "total#(tax)", "sum#(tax); }"), ("pay#", "function", "function pay#", "total#(1); }"), ("ship#", "function", "async (x)", "=> x")],
        calls=[("total#", "sum#"), ("pay#", "total#")],
    ),
    "typescript": Source(
        "m#.ts",
        "/* é # */\ninterface Shape# { side: number; }\nenum Hue# { Red, Blue }\ntype Key# = string;\nexport abstract class Box# {\n  private open#(lid: number): void { lift#(lid); }\n}\n",
        [("Shape#", "class", "interface Shape#", "number; }"), ("Hue#", "enum", "enum Hue#", "Blue }"), ("Key#", "type", "type Key#", "string;"), ("Box#", "class", "export abstract class Box#", "}\n}"), ("open#", "method", "private open#", "lift#(lid); }")],
        calls=[("open#", "lift#")],
    ),
    "go": Source(
        "m#.go",
        "// é #\npackage p\n\ntype Node# struct {\n\tN int\n}\n\nfunc (n *Node#) Walk#() int { return step#(n) }\nfunc Root#() int { return 1 }\n",
        [("Node#", "class", "type Node#", "int\n}"), ("Walk#", "method", "func (n *Node#) Walk#", "step#(n) }"), ("Root#", "function", "func Root#", "return 1 }")],
        calls=[("Walk#", "step#")],
    ),
    "rust": Source(
        "m#.rs",
        "// é #\npub struct Pair# { a: i32 }\ntrait Near# { fn gap#(&self); }\nfn top#() { near#(1); }\n",
        [("Pair#", "class", "pub struct Pair#", "i32 }"), ("Near#", "class", "trait Near#", "(&self); }"), ("gap#", "method", "fn gap#", "(&self);"), ("top#", "function", "fn top#", "near#(1); }")],
        calls=[("top#", "near#")],
    ),
    "java": Source(
        "M#.java",
        "/* é # */\npublic interface Pay# { void run#(); }\npublic class Till# {\n  public void open#() { ring#(); }\n}\n",
        [("Pay#", "class", "public interface Pay#", "run#(); }"), ("run#", "method", "void run#", "run#();"), ("Till#", "class", "public class Till#", "}\n}"), ("open#", "method", "public void open#", "ring#(); }")],
        calls=[("open#", "ring#")],
    ),
    "c_sharp": Source("M#.cs", "/* é # */\npublic class Bill# {\n  public void Send#() { }\n}\n", [("Bill#", "class", "public class Bill#", "}\n}"), ("Send#", "method", "public void Send#", "{ }")]),
    "php": Source("m#.php", "<?php /* é # */\nclass Page# { public function show#() {} }\nfunction draw#() {}\n", [("Page#", "class", "class Page#", "{} }"), ("show#", "method", "public function show#", "show#() {}"), ("draw#", "function", "function draw#", "draw#() {}")]),
    "c": Source("m#.c", "/* é # */\nstruct Cell# { int a; };\nint area#(int x) { return x; }\n", [("Cell#", "class", "struct Cell#", "int a; }"), ("area#", "function", "int area#", "return x; }")]),
    "cpp": Source("m#.cpp", "/* é # */\nclass Grid# {\npublic:\n  int size#() { return 1; }\n};\nint fill#() { return 2; }\n", [("Grid#", "class", "class Grid#", "1; }\n}"), ("size#", "method", "int size#", "return 1; }"), ("fill#", "function", "int fill#", "return 2; }")]),
    "kotlin": Source("m#.kt", "// é #\nenum class Role# { A }\nclass User# {\n    fun name#() { ask#() }\n}\n", [("Role#", "enum", "enum class Role#", "A }"), ("User#", "class", "class User#", "}\n}"), ("name#", "method", "fun name#", "ask#() }")], calls=[("name#", "ask#")]),
    "dart": Source("m#.dart", "// é #\nclass Wheel# {\n  void turn#() {\n    spin#();\n  }\n}\nenum Gear# { low }\n", [("Wheel#", "class", "class Wheel#", "  }\n}"), ("turn#", "method", "void turn#", "spin#();\n  }"), ("Gear#", "enum", "enum Gear#", "low }")], calls=[("turn#", "spin#")]),
    "swift": Source("m#.swift", "// é #\nenum Mood# { case a }\nclass Cat# {\n    func purr#() { hum#() }\n}\n", [("Mood#", "enum", "enum Mood#", "case a }"), ("Cat#", "class", "class Cat#", "}\n}"), ("purr#", "method", "func purr#", "hum#() }")], calls=[("purr#", "hum#")]),
    "ruby": Source("m#.rb", "\x00 é #\nclass Song#\n  def play#\n    if x\n      1\n    end\n  end\nend\n\ndef stop#\n  2\nend\n", [("Song#", "class", "class Song#", "  end\nend"), ("play#", "method", "def play#", "    end\n  end"), ("stop#", "function", "def stop#", "2\nend")]),
    "elixir": Source("m#.ex", "\x00 é #\ndefmodule App.Repo# do\n  def fetch#(x) do\n    x\n  end\nend\n", [("App.Repo#", "class", "defmodule App.Repo#", "  end\nend"), ("fetch#", "function", "def fetch#", "x\n  end")]),
    "bash": Source("m#.sh", "\x00 é #\ngreet#() {\n  echo hi\n}\n", [("greet#", "function", "greet#()", "hi\n}")]),
    "css": Source("m#.css", "/* é # */\n.btn# { color: red; }\n", [("/* é # */\n.btn#", "selector", "/* é #", "red; }")]),
    "html": Source("m#.html", "<!-- é # -->\n<main id='a#'>x</main>\n", [("main", "element", "<main id", "'a#'>")]),
    "r": Source("m#.R", "\x00 é #\nadd# <- function(a, b) {\n  mul#(a, b)\n}\nlimit# <- 5\n", [("add#", "function", "add# <-", "b)\n}"), ("limit#", "variable", "limit# <-", "<- 5")], calls=[("add#", "mul#")]),
    "vue": Source("m#.vue", '<template><a>é #</a></template>\n<script lang="ts">\nfunction tap#(): void { go#(); }\n</script>\n', [("tap#", "function", "function tap#", "go#(); }")]),
    "markdown": Source("m#.md", "é intro\n\x00 Guide #\nsome text\n```python\ndef demo#():\n    pass\n```\n\x00\x00 Part #\nend", [("Guide #", "section", "\x00 Guide #", "pass\n```\n"), ("demo#", "function", "def demo#", "    pass"), ("Part #", "section", "\x00\x00 Part #", "\nend")]),
}
ROUTES = {
    "python": Source("r#.py", '\x00 é #\n@app.route("/u#", methods=["GET", "POST"])\ndef users#():\n    pass\n@bp.delete(\'/x#\')\nasync def drop#(): pass\nurls = [path("p#/", views.page#)]\n', routes=[("GET", "/u#", "users#", "@app.route", "def users#"), ("POST", "/u#", "users#", "@app.route", "def users#"), ("DELETE", "/x#", "drop#", "@bp.delete", "async def drop#"), ("ANY", "p#/", "views.page#", 'path("p#', "views.page#")]),
    "javascript": Source("r#.js", "// é #\napp.get('/a#', list#);\napp.post(\"/b#\", async (q, r) => {});\nr.route('/c#').put(one#).get(function () {});\n", routes=[("GET", "/a#", "list#", "app.get", "list#"), ("POST", "/b#", "<inline>", "app.post", ") =>"), ("PUT", "/c#", "one#", "r.route", "() {})"), ("GET", "/c#", "<inline>", "r.route", "() {})")]),
    "php": Source("r#.php", "<?php // é #\nRoute::get('/a#', 'C@index#');\nRoute::match(['put', 'patch'], '/b#', 'C@up#');\n", routes=[("GET", "/a#", "'C@index#'", "Route::get", "index#')"), ("PUT", "/b#", "'C@up#'", "Route::match", "up#')"), ("PATCH", "/b#", "'C@up#'", "Route::match", "up#')")]),
    "go": Source("r#.go", '// é #\nr.GET("/a#", h.List#)\nhttp.HandleFunc("/b#", serve#)\n', routes=[("GET", "/a#", "h.List#", "r.GET", "h.List#"), ("ANY", "/b#", "serve#", "http.HandleFunc", "serve#")]),
    "java": Source("R#.java", '// é #\n@GetMapping("/a#")\npublic List<U> all#() {}\n@RequestMapping(value = "/b#", method = RequestMethod.POST)\npublic U add#() {}\n', routes=[("GET", "/a#", "all#", "@GetMapping", "all#("), ("POST", "/b#", "add#", "@RequestMapping", "add#(")]),
    "csharp": Source("R#.cs", '// é #\n[HttpGet("a#")]\npublic IActionResult Show#() {}\n', routes=[("GET", "a#", "Show#", "[HttpGet", "Show#(")]),
    "ruby": Source("r#.rb", "\x00 é #\nget '/a#', to: 'u#i'\npost '/b#' => 'u#c'\n", routes=[("GET", "/a#", "u#i", "get '/a", "'u#i'"), ("POST", "/b#", "u#c", "post '/b", "'u#c'")]),
    "elixir": Source("r#.ex", '\x00 é #\nput "/a#", PageController, :save#\n', routes=[("PUT", "/a#", "PageController.save#", "put ", ":save#")]),
    "rust": Source("r#.rs", '// é #\n#[get("/a#")]\npub async fn show#() {}\n'.replace("#[get", "\x00[get"), routes=[("GET", "/a#", "show#", "\x00[get", "fn show#")]),
}


def _files(spark: SparkSession, sf_dir: str, source: Source) -> DataFrame:
    """A file a document; the repository is the document's source. A # that is meant stands as NUL."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("-")).alias("repo"))
    put = lambda t: F.replace(F.replace(F.lit(t), F.lit("#"), F.col("doc_id").cast("string")), F.lit("\x00"), F.lit("#"))
    return d.select("repo", put(source.path).alias("path"), put(source.text).cast("binary").alias("content"))


def _put(text: str) -> str:
    """SQL for a text of a source with the id in its place."""
    parts = ["'" + t.replace("'", "''") + "'" for t in text.split("\n")]
    return f"replace(replace({' || chr(10) || '.join(parts)}, '#', CAST(doc_id AS VARCHAR)), chr(1), '#')".replace("\x00", "' || chr(1) || '")


def _span(text: str, first: str, last: str) -> str:
    """SQL for the byte span from the first place of a piece to the end of the next place of another."""
    before = f"substr(t, 1, strpos(t, {_put(first)}) - 1)"
    rest = f"substr(t, strpos(t, {_put(first)}))"
    return f"CAST(strlen({before}) AS BIGINT) AS start_byte, CAST(strlen({before}) + strlen(substr({rest}, 1, strpos({rest}, {_put(last)}) - 1)) + strlen({_put(last)}) AS BIGINT) AS end_byte"


def _sql(source: Source, facts: list[str]) -> str:
    d = f"(SELECT doc_id, coalesce(source, '-') AS repo, {_put(source.path)} AS file, {_put(source.text)} AS t FROM documents)"
    return " UNION ALL ".join(f"SELECT repo, file, {fact} FROM {d}" for fact in facts)


def _register() -> None:
    for lang, source in SOURCES.items():

        def found(spark: SparkSession, sf_dir: str, source=source) -> DataFrame:
            return symbols.extract(_files(spark, sf_dir, source))[0].select("repo", "file", "name", "kind", "start_byte", "end_byte")

        found.__name__ = f"symbols_{lang}"
        query(_sql(source, [f"{_put(name)} AS name, '{kind}' AS kind, {_span(source.text, a, b)}" for name, kind, a, b in source.symbols]))(found)
        if source.calls:

            def called(spark: SparkSession, sf_dir: str, source=source) -> DataFrame:
                return symbols.extract(_files(spark, sf_dir, source))[1].select("repo", "file", "caller_name", "callee_name")

            called.__name__ = f"calls_{lang}"
            query(_sql(source, [f"{_put(a)} AS caller_name, {_put(b)} AS callee_name" for a, b in source.calls]))(called)
    for lang, source in ROUTES.items():

        def routed(spark: SparkSession, sf_dir: str, source=source, lang=lang) -> DataFrame:
            return routes.extract_routes(_files(spark, sf_dir, source), langs=(lang,))

        routed.__name__ = f"routes_{lang}"
        query(_sql(source, [f"'{m}' AS method, {_put(p)} AS path, {_put(h)} AS handler, {_span(source.text, a, b)}" for m, p, h, a, b in source.routes]))(routed)


_register()

_PY = SOURCES["python"]


@query(_sql(_PY, ["'def load' || doc_id || '(path):' AS signature, 'Reads ' || doc_id || '.' AS docstring", "'class Store' || doc_id || ':' AS signature, NULL AS docstring", "'def get' || doc_id || '(self):' AS signature, NULL AS docstring"]))
def signatures_and_docstrings(spark, sf_dir):
    return symbols.extract(_files(spark, sf_dir, _PY))[0].select("repo", "file", "signature", "docstring")


@query(_sql(_PY, [f"{_put(a)} AS caller_name, {_put(b)} AS callee_name, {_put(c) if c else 'NULL'} AS callee_file" for a, b, c in (("load#", "join", ""), ("load#", "tidy#", ""), ("get#", "load#", "m#.py"))]).replace("SELECT repo, file,", "SELECT DISTINCT repo, file AS caller_file,"))
def calls_to_edges(spark, sf_dir):
    """Extraction and resolution of calls in a row."""
    found, calls = symbols.extract(_files(spark, sf_dir, _PY))
    return graph.resolve_calls(calls, found).select("repo", "caller_file", "caller_name", "callee_name", "callee_file")


# ---- which files count

_IGNORES = ["# comment", "*.tmp", "/top#.py", "logs/", "!keep#.tmp", "docs/*.txt", "**/deep/x"]
#: Path by the remainder of the id by ten, and whether it counts.
_PATHS = [("src/a#.py", True), ("node_modules/a#.js", False), ("q/__pycache__/a#.py", False), ("a#.PNG", False), ("x/a#.tmp", False), ("keep.tmp", True), ("logs/a#.py", False), ("docs/a#.txt", False), ("docs/b/a#.txt", True), ("p/q/deep/x", False)]


@query("SELECT doc_id, path FROM (SELECT doc_id, CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN replace('{p}', '#', CAST(doc_id AS VARCHAR))" for i, (p, _) in enumerate(_PATHS)) + " END AS path, doc_id % 10 AS k FROM documents) WHERE k IN (" + ", ".join(str(i) for i, (_, keep) in enumerate(_PATHS) if keep) + ")")
def files_that_count(spark, sf_dir):
    """Skipped folders and extensions, and ignore rules."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    path = F.element_at(F.array(*[F.lit(p) for p, _ in _PATHS]), (F.col("doc_id") % 10 + 1).cast("int"))
    files = d.select("doc_id", F.replace(path, F.lit("#"), F.col("doc_id").cast("string")).alias("path"))
    return scan.keep_sources(files, [line.replace("#", "") if line.startswith("!") else line for line in _IGNORES])


@query("SELECT doc_id, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL")
def hashed_files(spark, sf_dir):
    """Hashes of files' bytes."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("content"))
    return scan.measured(d).select("doc_id", "hash", F.length("content").cast("long").alias("bytes"))


@query("SELECT coalesce(source, '-') AS repo, CAST(sum(strlen(t) + 1) AS BIGINT) AS bytes, bool_and(true) AS hashed FROM (SELECT source, replace(coalesce(text, ''), chr(10), ' ') AS t FROM documents) GROUP BY 1")
def tree_scan(spark, sf_dir):
    """Documents written to a tree, a folder a source and a line each, listed and read back."""
    from uuid import uuid4

    from srcatlas.lineage import shared_folder

    root = f"{shared_folder(spark)}/tree-{uuid4().hex}"
    d = table(spark, sf_dir, "documents")
    d.select(F.coalesce("source", F.lit("-")).alias("repo"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("value")).write.partitionBy("repo").option("compression", "none").text(root)
    found = scan.scan_tree(spark, root, "all").where("path LIKE '%.txt'")
    folder = F.regexp_extract("path", "^repo=([^/]*)/", 1)
    return scan.measured(found).groupBy(folder.alias("repo")).agg(F.sum("size").alias("bytes"), F.bool_and((F.length("hash") == 64) & (F.length("content") == F.col("size"))).alias("hashed"))


# ---- the store


@query("SELECT 'r' || (doc_id % 3) AS repo, doc_id || '.txt' AS path FROM documents WHERE doc_id % 3 <> 2 AND doc_id <> (SELECT min(doc_id) FROM documents WHERE doc_id % 3 = 0)")
def store_after_changes(spark, sf_dir):
    """Three repositories committed; of the first one a file is invalidated, the last is removed; all are read back."""
    from uuid import uuid4

    from srcatlas.lineage import shared_folder
    from srcatlas.sources.snapshot import TABLES, Store

    store = Store(spark, f"{shared_folder(spark)}/store-{uuid4().hex}")
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), (F.col("doc_id") % 3).cast("string")).alias("repo"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "doc_id")
    repos = ["r0", "r1", "r2"]
    empty = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items() if name not in ("files", "repos")}
    for repo in repos:
        mine = d.where(F.col("repo") == repo)
        files = mine.select("repo", "path", F.lit("h").alias("hash"), *[F.lit(0).cast("long").alias(c) for c in ("line_count", "size")], *[F.lit(0).cast("timestamp").alias(c) for c in ("mtime", "indexed_at")])
        store.commit(repo, empty | {"files": files}, f"/{repo}", 1.0)
    first = d.where(F.col("repo") == repos[0]).orderBy("doc_id").first()["path"]
    store.commit(repos[0], upsert.invalidate(store.tables(repos[0]), repos[0], first))
    store.remove(repos[-1])
    return store.table("files").select("repo", "path")
