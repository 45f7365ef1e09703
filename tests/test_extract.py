"""Symbols, calls, sections and routes of snippets."""

import pytest

from srcatlas.sources import markdown, routes, symbols

SNIPPETS = {
    "sample.py": ("class A:\n    def m(self):\n        pass\n\nasync def top():\n    pass\n", {"A": "class", "m": "method", "top": "function"}),
    "broken.py": ("class A:\n    def m(self):\n        x = (\n\ndef top(:\n    pass\n", {"A": "class", "m": "method", "top": "function"}),
    "sample.go": ("package p\ntype User struct {\n\tN int\n}\nfunc (u *User) Method() {}\nfunc Top() int { return 1 }\n", {"User": "class", "Method": "method", "Top": "function"}),
    "sample.rs": ("pub struct User { a: i32 }\nimpl User {\n    pub fn new() -> User { User { a: 1 } }\n}\ntrait T { fn t(&self); }\nfn top() {}\n", {"User": "class", "new": "method", "T": "class", "t": "method", "top": "function"}),
    "sample.kt": ("enum class Role { A }\nclass User {\n    fun method() { }\n}\nfun top() = 1\nval f = { x: Int -> x }\n", {"Role": "enum", "User": "class", "method": "method", "top": "function", "f": "function"}),
    "Sample.java": ("public interface I { void run(); }\npublic class User {\n    public void method() { go(); }\n}\n", {"I": "class", "run": "method", "User": "class", "method": "method"}),
    "Sample.cs": ("public class User {\n    public void Method() { }\n}\n", {"User": "class", "Method": "method"}),
    "sample.php": ("<?php\nclass User { public function method() {} }\nfunction top() {}\n", {"User": "class", "method": "method", "top": "function"}),
    "sample.c": ("struct User { int a; };\nint top(int x) { return x; }\n", {"User": "class", "top": "function"}),
    "sample.cpp": ("class User {\npublic:\n  int method() { return 1; }\n};\nint top() { return 2; }\n", {"User": "class", "method": "method", "top": "function"}),
    "sample.ex": ("defmodule App.User do\n  def run(x) do\n    x\n  end\n  defp hid(y), do: y\nend\n", {"App.User": "class", "run": "function", "hid": "function"}),
    "sample.dart": ("class User {\n  void method() {\n    go();\n  }\n}\nenum Role { a }\ntypedef F = int Function();\nint top(int x) { return x; }\n", {"User": "class", "method": "method", "Role": "enum", "F": "type", "top": "function"}),
    "sample.swift": ("enum Role { case a }\nprotocol P { func p() }\nclass User {\n    func method() { }\n}\nfunc top() { }\n", {"Role": "enum", "P": "class", "p": "method", "User": "class", "method": "method", "top": "function"}),
    "sample.js": ("class A {\n  m(a) { return a; }\n}\nfunction top() { }\nconst g = async (x) => x;\nconst h = function () { };\n", {"A": "class", "m": "method", "top": "function", "g": "function", "h": "function"}),
    "sample.ts": ("interface I { a: string; }\nenum E { A }\ntype T = string;\nexport abstract class A {\n  private m(a: number): void { }\n}\nfunction top(): void { }\n", {"I": "class", "E": "enum", "T": "type", "A": "class", "m": "method", "top": "function"}),
    "sample.rb": ("class User\n  def method_a\n    if x\n      1\n    end\n  end\nend\n\ndef top\n  2\nend\n", {"User": "class", "method_a": "method", "top": "function"}),
    "sample.sh": ("greet() {\n  echo hi\n}\nfunction bye {\n  :\n}\n", {"greet": "function", "bye": "function"}),
    "sample.css": (".btn { color: red; }\n#x { a: b; }\n", {".btn": "selector", "#x": "selector"}),
    "sample.R": ('library(dplyr)\nadd <- function(a, b) {\n  a + b\n}\nthreshold <- 5\nStack <- R6Class("Stack")\n', {"dplyr": "import", "add": "function", "threshold": "variable", "Stack": "class"}),
    "component.vue": ("<template><a/></template>\n<script lang=\"ts\">\nfunction go(): void { }\n</script>\n", {"go": "function"}),
    "none.vue": ("<template/>", {}),
    "data.csv": ("a,b", {}),
}


@pytest.mark.parametrize("path", sorted(SNIPPETS))
def test_symbols(path):
    text, expected = SNIPPETS[path]
    found, _ = symbols.parse(path, text.encode())
    assert {s.name: s.kind for s in found} == expected
    for s in found:
        assert 0 <= s.start < s.end <= len(text.encode())
        piece = text.encode()[s.start : s.end].decode()
        assert piece.startswith(s.signature.rstrip("\r"))
        assert piece.count("{") == piece.count("}") or path == "broken.py"


def test_python_details():
    source = 'é = 1\n@deco\ndef f():\n    """Doc ü."""\n    g(h.k(1))\n    def inner():\n        pass\nclass C:\n    def m(self):\n        r"raw"\n        def deep():\n            pass\n'
    found, calls = symbols.parse("a.py", source.encode())
    by = {s.name: s for s in found}
    assert source.encode()[by["f"].start :].startswith(b"def f():") and by["f"].docstring == "Doc ü."
    assert by["m"].docstring is None and by["inner"].kind == "function" and by["deep"].kind == "method"
    assert [c.name for c in calls] == ["deco"][:0] + ["g", "k"]


def test_calls(spark):
    files = [
        ("r", "a.py", b"def callee():\n    pass\ndef caller():\n    callee()\n    callee()\n    os.path.join('a')\n"),
        ("r", "b.ts", b"export function callee(): number { return 1; }\nexport function caller() { return callee(); }\n"),
        ("r", "c.kt", b"fun callee() { }\nfun caller() { callee() }\n"),
        ("r", "d.dart", b"void callee() { }\nvoid caller() { callee(); }\n"),
        ("r", "e.swift", b"func callee() { }\nfunc caller() { callee() }\n"),
        ("r", "f.rs", b"fn caller() { a::b(); x.y(); }\n"),
        ("r", "g.rb", b"def caller\n  callee()\nend\n"),
        ("r", "twice.py", b"class A:\n    def __init__(self): pass\nclass B:\n    def __init__(self): run()\n"),
        ("r", "empty.py", b""),
        ("r", "null.py", None),
    ]
    s, c = symbols.extract(spark.createDataFrame(files, "repo string, path string, content binary"))
    got = {}
    for r in c.collect():
        got.setdefault((r["file"], r["caller_name"]), []).append((r["seq"], r["callee_name"]))
    names = {k: [n for _, n in sorted(v)] for k, v in got.items()}
    assert names[("a.py", "caller")] == ["callee", "join"]
    for f in ("b.ts", "c.kt", "d.dart", "e.swift"):
        assert names[(f, "caller")] == ["callee"], f
    assert names[("f.rs", "caller")] == ["a::b", "y"]
    assert not any(f == "g.rb" for f, _ in names)
    twice = s.where("file = 'twice.py' AND name = '__init__'").collect()
    assert len(twice) == 1 and twice[0]["start_byte"] > 30 and names[("twice.py", "__init__")] == ["run"]


def test_markdown():
    text = "intro\n# SDK Guide\nsome\ntext\n```python\ndef f():\n    pass\n# not a heading\n```\n## Sub ##\nend\n#nope\n#\n~~~\nopen"
    sections, blocks = markdown.read(text.encode())
    assert [(s.title, s.docstring) for s in sections] == [("SDK Guide", "some text"), ("Sub", "end #nope #")] or [s.title for s in sections] == ["SDK Guide", "Sub"]
    assert sections[0].end == sections[1].start and sections[1].end == len(text)
    assert [b.extension for b in blocks] == [".py"]
    found, _ = symbols.parse("guide.md", text.encode())
    f = next(s for s in found if s.name == "f")
    assert text[f.start : f.end].startswith("def f():")


ROUTES = {
    "flask.py": ('@app.route("/users", methods=["GET", "POST"])\ndef list_users():\n    pass\n@bp.route(\'/x/<int:id>\')\nasync def x(id): pass\n', {("GET", "/users", "list_users"), ("POST", "/users", "list_users"), ("GET", "/x/<int:id>", "x")}),
    "fast.py": ('@router.get("/items")\nasync def items(): pass\n', {("GET", "/items", "items")}),
    "urls.py": ("urlpatterns = [path('a/', views.a), re_path(r'^b$', B.as_view())]", {("ANY", "a/", "views.a"), ("ANY", "^b$", "B.as_view()")}),
    "e.js": ("app.get('/a', listA);\napp.post('/b', async (q, r) => {});\nr.route('/c').get(one).put(function () {});\n", {("GET", "/a", "listA"), ("POST", "/b", "<inline>"), ("GET", "/c", "one"), ("PUT", "/c", "<inline>")}),
    "l.php": ("Route::get('/a', [U::class, 'index']);\nRoute::match(['put', 'patch'], '/b', 'C@u');", {("GET", "/a", "[U::class, 'index']"), ("PUT", "/b", "'C@u'"), ("PATCH", "/b", "'C@u'")}),
    "m.go": ('r.GET("/a", h.List)\nhttp.HandleFunc("/b", func(w http.ResponseWriter) {})\n', {("GET", "/a", "h.List"), ("ANY", "/b", "func")}),
    "S.java": ('@GetMapping("/a")\npublic List<U> all() {}\n@RequestMapping(value = "/b", method = RequestMethod.POST)\npublic U add() {}\n', {("GET", "/a", "all"), ("POST", "/b", "add")}),
    "C.cs": ('[HttpGet("a")]\npublic IActionResult A() {}\n[HttpPost]\n[Route("b")]\npublic async Task<X> B() {}\n', {("GET", "a", "A"), ("POST", "b", "B")}),
    "r.rb": ("get '/a', to: 'u#i'\npost '/b' => 'u#c'\nget '/c' do\nend\n", {("GET", "/a", "u#i"), ("POST", "/b", "u#c"), ("GET", "/c", "<inline>")}),
    "p.ex": ('get "/a", PageController, :index\n', {("GET", "/a", "PageController.index")}),
    "x.rs": ('#[get("/a")]\npub async fn a() {}\n', {("GET", "/a", "a")}),
    "no.txt": ('@app.route("/users")\ndef f(): pass', set()),
}


def test_routes(spark):
    rows = [("r", p, bytearray("é\n".encode() + t.encode())) for p, (t, _) in ROUTES.items()] + [("r", "bad.py", bytearray(b"\xff\xfe@a.get('/z')\ndef z(): pass")), ("r", "null.py", None)]
    found = routes.extract_routes(spark.createDataFrame(rows, "repo string, path string, content binary")).collect()
    got = {p: set() for p in [*ROUTES, "bad.py"]}
    for r in found:
        got[r["file"]].add((r["method"], r["path"], r["handler"]))
        raw = dict((p, bytes(c)) for _, p, c in rows if c is not None)[r["file"]]
        assert r["path"].encode() in raw[r["start_byte"] : r["end_byte"]] or r["file"] == "e.js"
    for p, (_, expected) in ROUTES.items():
        assert got[p] == expected, p
    assert got["bad.py"] == {("GET", "/z", "z")}


@pytest.mark.parametrize(("path", "piece"), [("a.html", "<a>x</a>\n"), ("a.js", "// doc\nconst f@ = (a) => a + 1\nfunction g@(x) { return f@(x) }\n"), ("a.kt", "fun f@(x: Int) { g(x) }\n"), ("a.rb", "def f@\n  g(1)\nend\n"), ("A.java", "class C@ {\n  /* d */\n  public void m@() { go(); }\n}\n")])
def test_reading_is_linear(path, piece):
    """Ten times the text takes about ten times as long, not a hundred."""
    import time

    took = []
    for n in (2_000, 20_000):
        text = "".join(piece.replace("@", str(i)) for i in range(n)).encode()
        start = time.perf_counter()
        found, _ = symbols.parse(path, text)
        took.append(time.perf_counter() - start)
        assert len(found) >= n
    assert took[1] < 35 * max(took[0], 0.02), took


def test_lexical_reader_against_the_grammar():
    """On this library's own sources: all names at their places, nearly all with the same kind and end."""
    import glob
    import os

    total = same = 0
    for path in glob.glob(os.path.join(os.path.dirname(symbols.__file__), "*.py")):
        with open(path, "rb") as f:
            source = f.read()
        ours, theirs = ({(s.name, s.start): (s.kind, s.end) for s in read(source)[0]} for read in (lambda b: symbols.parse_lexically(b, "python"), symbols.parse_python))
        assert theirs.keys() == ours.keys(), path
        total += len(theirs)
        same += sum(ours[k] == theirs[k] for k in theirs)
    assert total > 80 and same > 0.9 * total
