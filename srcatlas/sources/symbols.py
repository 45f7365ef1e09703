"""Symbols and calls of source files, one pass over the content.

Python is read by its own grammar. Other languages are read lexically: comments and
strings are blanked out, definition heads are found by expressions, and their bodies by
balanced braces or by ``end``. A parser for a language can be put in at ``PARSERS``.
"""

from __future__ import annotations

import ast
import posixpath
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas import languages
from srcatlas.sources import markdown

SIGNATURE_CHARS = 200


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    signature: str
    docstring: str | None = None


@dataclass
class Call:
    pos: int
    name: str


Parsed = tuple[list[Symbol], list[Call]]


def _signature(source: bytes, start: int, end: int) -> str:
    """The first line of a span."""
    stop = source.find(b"\n", start, end)
    return source[start : stop if stop >= 0 else end].rstrip(b"\r").decode("utf-8", "replace")[:SIGNATURE_CHARS]


# ---- Python


def parse_python(source: bytes) -> Parsed:
    """Functions, methods and classes; a file that doesn't parse is read lexically."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return parse_lexically(source, "python")
    lines = [0]
    for raw in source.splitlines(keepends=True):
        lines.append(lines[-1] + len(raw))
    at = lambda line, col: lines[line - 1] + col
    symbols: list[Symbol] = []
    calls: list[Call] = []
    # the four nodes above a definition, bodies included, decide whether it is a method
    stack: list[tuple[ast.AST, tuple[str, ...]]] = [(tree, ())]
    while stack:
        node, above = stack.pop()
        inner = above
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            start, end = at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)
            is_class = isinstance(node, ast.ClassDef)
            kind = "class" if is_class else "method" if "class" in above[-4:] else "function"
            symbols.append(Symbol(node.name, kind, start, end, _signature(source, start, end), _docstring(node, source, at)))
            decorated = ("decorated",) if node.decorator_list else ()
            inner = (*above, *decorated, "class" if is_class else "function", "block")
        elif isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                calls.append(Call(at(node.lineno, node.col_offset), name))
        elif isinstance(node, ast.stmt) and hasattr(node, "body"):
            inner = (*above, "statement", "block")
        stack += [(child, inner) for child in reversed(list(ast.iter_child_nodes(node)))]
    symbols.sort(key=lambda s: (s.start, -s.end))
    calls.sort(key=lambda c: c.pos)
    return symbols, calls


def _docstring(node, source: bytes, at) -> str | None:
    """The first statement's text if it is a string without a prefix, quotes taken off."""
    first = node.body[0] if node.body else None
    if not (isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)):
        return None
    raw = source[at(first.lineno, first.col_offset) : at(first.end_lineno, first.end_col_offset)].decode("utf-8", "replace")
    for mark in ('"""', "'''", '"', "'"):
        if raw.startswith(mark):
            return raw.removeprefix(mark).removesuffix(mark).strip()
    return None


# ---- other languages

_I = r"[A-Za-z_$][\w$]*"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|sealed|async|open|data|suspend|inline|export|default|pub(?:\([^)]*\))?|unsafe|extern|const|readonly|partial|mutating|fileprivate|lazy|external|late|inner|operator|infix|tailrec|synchronized|native|explicit|constexpr|friend|declare|get|set)\s+)*"
_TYPED = rf"[\w$:<>\[\]?*&,. ]*[\w>\]?*&]\s+[*&]*({_I}(?:::~?{_I})?)\s*\([^;{{}}]*?\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?:throws\s+[\w., ]+)?(?:async\*?\s*)?(?=[{{]|=>)"

#: By language: (kind, expression whose first filled group is the name), first at a place wins.
HEADS: dict[str, list[tuple[str, str]]] = {
    "python": [("class", rf"^[ \t]*class\s+({_I})"), ("function", rf"^[ \t]*(?:async\s+)?def\s+({_I})")],
    "javascript": [
        ("class", rf"^[ \t]*{_MODS}class\s+({_I})"),
        ("function", rf"^[ \t]*{_MODS}function\s*\*?\s*({_I})"),
        ("function", rf"(?:^|[;{{}}])[ \t]*{_MODS}(?:const|let|var)\s+({_I})\s*(?::[^=\n]+)?=\s*(?=(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=\n]+)?=>|{_I}\s*=>))"),
        ("method", rf"^[ \t]*{_MODS}(?:\*\s*)?(#?{_I})\s*\([^;{{}}]*?\)\s*(?::[^{{}};=\n]+)?(?={{)"),
        ("method", rf"(?<=[{{;}}])[ \t]*{_MODS}({_I})\s*\([^;{{}}()]*\)\s*(?={{)"),
    ],
    "go": [("method", rf"^func\s*\([^)]*\)\s*({_I})"), ("function", rf"^func\s+({_I})"), ("class", rf"^type\s+({_I})\s")],
    "rust": [("class", rf"^[ \t]*{_MODS}(?:struct|trait)\s+({_I})"), ("class", rf"^[ \t]*{_MODS}impl(?:<[^>{{]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?({_I})"), ("function", rf"\b{_MODS}fn\s+({_I})")],
    "java": [("class", rf"\b{_MODS}(?:class|interface)\s+({_I})"), ("method", rf"(?:^|(?<=[{{;}}]))[ \t]*{_MODS}{_TYPED}"), ("method", rf"(?:^|(?<=[{{;}}]))[ \t]*{_MODS}[\w<>\[\], .?]+\s({_I})\s*\([^;{{}}()]*\)\s*(?=;)")],
    "php": [("class", rf"\b{_MODS}(?:class)\s+({_I})"), ("function", rf"\b{_MODS}function\s+&?({_I})")],
    "c": [("class", rf"\bstruct\s+({_I})\s*(?={{)"), ("function", rf"^[ \t]*{_MODS}{_TYPED}")],
    "kotlin": [
        ("enum", rf"\b{_MODS}enum\s+class\s+({_I})"),
        ("class", rf"\b{_MODS}(?:class|interface|object)\s+({_I})"),
        ("type", rf"\btypealias\s+({_I})"),
        ("function", rf"\b{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?({_I})"),
        ("function", rf"\b{_MODS}va[lr]\s+({_I})\s*(?::[^=\n]+)?=\s*(?={{)"),
    ],
    "dart": [("class", rf"\b{_MODS}(?:class|mixin)\s+({_I})"), ("enum", rf"\benum\s+({_I})"), ("type", rf"\btypedef\s+({_I})"), ("function", rf"(?:^|(?<=[{{;}}]))[ \t]*{_MODS}{_TYPED}")],
    "swift": [("enum", rf"\b{_MODS}enum\s+({_I})"), ("class", rf"\b{_MODS}(?:class|struct|protocol|extension|actor)\s+(?!func\b|var\b)({_I})"), ("function", rf"\b{_MODS}func\s+({_I})"), ("function", rf"\b{_MODS}(?:let|var)\s+({_I})\s*(?::[^=\n]+)?=\s*(?={{)")],
    "ruby": [("class", rf"^[ \t]*(?:class|module)\s+(?:{_I}::)*({_I})"), ("method", rf"^[ \t]*def\s+(?:self\.)?({_I}[?!=]?)")],
    "elixir": [("class", r"^[ \t]*defmodule\s+([\w.]+)"), ("function", rf"^[ \t]*defp?\s+({_I}[?!]?)")],
    "bash": [("function", rf"^[ \t]*(?:function\s+)?({_I})\s*\(\)\s*(?={{)"), ("function", rf"^[ \t]*function\s+({_I})\s*(?={{)")],
    "css": [("selector", r"(?:^|(?<=[{};]))\s*([^{}@;\s][^{};]*?)\s*(?={)")],
    "html": [("element", r"<([A-Za-z][\w-]*)(?=[\s>/])")],
    "r": [("function", r"^[ \t]*([\w.]+)\s*(?:<-|<<-|=|:=)\s*(?=function\b)"), ("class", r"""^[ \t]*([\w.]+)\s*(?:<-|<<-|=|:=)\s*(?=(?:R6Class|setRefClass|setClass)\s*\()"""), ("import", r"^[ \t]*(?:library|require)\s*\(\s*([\w.]+)"), ("variable", r"^([\w.]+)\s*(?:<-|<<-|=|:=)\s*(?=\S)")],
}
HEADS["typescript"] = [
    ("class", rf"^[ \t]*{_MODS}interface\s+({_I})"),
    ("enum", rf"^[ \t]*{_MODS}(?:const\s+)?enum\s+({_I})"),
    ("type", rf"^[ \t]*{_MODS}type\s+({_I})\s*(?:<[^=]*>)?\s*(?==)"),
    *HEADS["javascript"],
    ("method", rf"^[ \t]*{_MODS}({_I})\s*\([^;{{}}]*?\)\s*:[^{{}};=\n]+(?=;)"),
]
HEADS["c_sharp"] = HEADS["java"]
HEADS["cpp"] = [("class", rf"\b(?:class|struct)\s+({_I})(?=[^;()=]*{{)"), *HEADS["c"][1:]]
HEADS["scss"] = HEADS["css"]
_HEADS = {lang: [(kind, re.compile(p, re.M)) for kind, p in rules] for lang, rules in HEADS.items()}

_HASH = {"python", "ruby", "elixir", "bash", "r"}
_BY_END = {"ruby", "elixir"}
_TO_METHOD = {"rust", "cpp", "kotlin", "dart", "swift", "php", "python"}
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "else", "do", "new", "throw", "await", "function", "sizeof", "super", "in", "when", "using", "lock", "foreach", "elif", "match", "synchronized", "try", "async", "func", "fun", "fn", "def"}
#: Languages in which a definition shows no keyword, so control flow looks like one.
_TYPED_LANGS = {"c", "cpp", "java", "c_sharp", "dart", "javascript", "typescript"}
_CALL = re.compile(r"([A-Za-z_][\w]*(?:(?:\?\.|\.|::)[A-Za-z_]\w*)*)(?:<[\w, ]*>)?\s*\(")
_SLASHES = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_HASHES = re.compile(r'''\#[^\n]*|""".*?(?:"""|\Z)|\'\'\'.*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*\'''', re.S)
_OPENS = re.compile(r"\s*\{")
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_BLOCK_WORDS = re.compile(r"\b(?:do|fn|end)\b|^[ \t]*(?:class|module|def|if|unless|case|while|until|begin|for)\b", re.M)


def _blank(text: str, lang: str) -> str:
    """The text with comments and strings as spaces."""
    pattern = _HASHES if lang in _HASH else _MARKUP if lang == "html" else _SLASHES
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


class _Text:
    """A text without comments and strings, with what is looked for in it again and again found once."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang = text, lang
        self.places = {c: [m.start() for m in re.finditer(re.escape(c), text)] for c in "{};"} if lang not in _BY_END | {"python"} else {}
        #: Of an opening brace or word, where what closes it ends.
        self.closed: dict[int, int] = {}
        self.opened: list[int] = []
        stack: list[int] = []
        if lang in _BY_END:
            for m in _BLOCK_WORDS.finditer(text):
                word = m.group().strip()
                if lang == "elixir" and word not in ("do", "fn", "end"):
                    continue
                if lang == "ruby" and word == "do" and re.search(r"^[ \t]*(?:while|until|for)\b", text[text.rfind("\n", 0, m.start()) + 1 : m.start()]):
                    continue
                if word != "end":
                    stack.append(m.end() - len(word))
                    self.opened.append(m.end() - len(word))
                elif stack:
                    self.closed[stack.pop()] = m.end()
        else:
            for at in sorted(self.places.get("{", []) + self.places.get("}", [])):
                if text[at] == "{":
                    stack.append(at)
                elif stack:
                    self.closed[stack.pop()] = at + 1

    def next(self, c: str, at: int) -> int:
        """The first place of a character from ``at`` on, or -1."""
        i = bisect_left(self.places[c], at)
        return self.places[c][i] if i < len(self.places[c]) else -1

    def close(self, at: int) -> int:
        """Behind what closes the brace or word at ``at``; the end if nothing does."""
        return self.closed.get(at, len(self.text))

    def line_end(self, at: int) -> int:
        end = self.text.find("\n", at)
        return len(self.text) if end < 0 else end


def _body_end(whole: _Text, start: int, head: int, kind: str) -> int:
    text, lang = whole.text, whole.lang
    line_end = whole.line_end(head)
    if lang in _BY_END:
        if lang == "elixir" and not re.search(r"\bdo\b(?!:)", text[head:line_end]):
            return line_end
        i = bisect_left(whole.opened, start)
        return whole.close(whole.opened[i]) if i < len(whole.opened) else len(text)
    if lang == "python":
        indent = start - text.rfind("\n", 0, start) - 1
        end = line_end
        for m in re.compile(r"[^\n]*\n?").finditer(text, line_end + 1):
            if m.group().strip():
                if len(m.group()) - len(m.group().lstrip()) <= indent:
                    break
                end = m.end() - m.group().endswith("\n")
        return end
    if kind in ("element", "import", "type"):
        closer = ">" if kind == "element" else ";"
        stop = text.find(closer, head)
        return stop + 1 if 0 <= stop and (kind == "element" or stop <= line_end) else line_end
    brace, stop = whole.next("{", head), whole.next(";", head)
    if lang == "r" or lang == "go" and kind == "class" or lang == "kotlin":
        stop = line_end  # a body opens on the head's line
    if brace < 0 or 0 <= stop < brace:
        return line_end if lang in ("r", "kotlin", "go") else (stop + 1 if stop >= 0 else line_end)
    outer = whole.next("}", head)
    return min(outer, line_end) if 0 <= outer < brace else whole.close(brace)


def parse_lexically(source: bytes, lang: str) -> Parsed:
    """Definitions and calls by expressions over the text without comments and strings."""
    text = source.decode("latin-1")  # offsets are bytes
    bare = text if lang == "css" else _blank(text, lang)
    whole = _Text(bare, lang)
    found: dict[int, Symbol] = {}
    names: set[int] = set()
    for kind, pattern in _HEADS.get(lang, []):
        for m in pattern.finditer(bare):
            g = next((i for i in range(1, (m.lastindex or 0) + 1) if m.group(i)), 0)
            name = m.group(g)
            if m.start(g) in names or (name in _NOT_NAMES and lang in _TYPED_LANGS):
                continue
            start = m.start() + len(m.group()) - len(m.group().lstrip(" \t\r\n{};"))
            if start in found:
                continue
            names.add(m.start(g))
            head = m.end()
            if lang == "javascript" or lang == "typescript":
                if "=" in m.group() and kind == "function":
                    start = head  # the span is that of the bound value
            end = _body_end(whole, start, head, kind)
            if lang in ("javascript", "typescript") and start == head and (arrow := bare.find("=>", head, whole.line_end(head)) + 2) > 1:
                if not _OPENS.match(bare, arrow):
                    end = min(whole.line_end(arrow), stop if (stop := whole.next(";", arrow)) >= 0 else len(bare))
            raw = name.encode("latin-1").decode("utf-8", "replace")
            found[start] = Symbol(raw.split("::")[-1], kind, start, end, _signature(source, start, end), _comment_above(text, start, lang))
    symbols = sorted(found.values(), key=lambda s: (s.start, -s.end))
    for s, inside in zip(symbols, _inside(symbols, ("class", "enum")), strict=True):
        if s.kind == "function" and inside and lang in _TO_METHOD:
            s.kind = "method"
        elif s.kind == "method" and not inside and lang == "ruby":
            s.kind = "function"
    if lang in ("javascript", "typescript", "java", "c_sharp"):
        symbols = [s for s, inside in zip(symbols, _inside(symbols, ("class",)), strict=True) if s.kind != "method" or inside]
    calls = []
    for m in _CALL.finditer(bare):
        last = m.end(1) - len(re.split(r"\?\.|\.|::", m.group(1))[-1])
        name = m.group(1).rsplit(".", 1)[-1]
        if last not in names and m.start(1) not in names and name not in _NOT_NAMES:
            calls.append(Call(m.start(1), name.encode("latin-1").decode("utf-8", "replace")))
    return symbols, calls


def _inside(symbols: list[Symbol], kinds: tuple[str, ...]) -> list[bool]:
    """Of symbols in order of start, whether one of the kinds begins before and holds each."""
    out, reach, at, coming = [], -1, -1, -1
    for s in symbols:
        if s.start > at:
            at, reach = s.start, max(reach, coming)
        out.append(s.end <= reach)
        if s.kind in kinds:
            coming = max(coming, s.end)
    return out


def _comment_above(text: str, start: int, lang: str) -> str | None:
    """The comment that directly precedes, as it stands."""
    at = start
    while at and text[at - 1] in " \t":
        at -= 1
    if not at or text[at - 1] != "\n":
        return None
    at -= 1
    while at and text[at - 1].isspace():
        at -= 1
    if text.endswith("*/", 0, at) and (opened := text.rfind("/*", 0, at)) >= 0:
        return text[opened:at].encode("latin-1").decode("utf-8", "replace")
    line = text[text.rfind("\n", 0, at) + 1 : at].strip()
    if line.startswith("#" if lang in _HASH else "//"):
        return line.encode("latin-1").decode("utf-8", "replace")
    return None


_SCRIPT = re.compile(rb"<script\b([^>]*)>(.*?)</script>", re.S | re.I)

#: A parser of its own for a language: source to symbols and calls.
PARSERS: dict[str, Callable[[bytes], Parsed]] = {"python": parse_python}


def parse(path: str, source: bytes) -> Parsed:
    """Symbols in order of emission, and calls; nothing for unknown extensions."""
    suffix = posixpath.splitext(path)[1]
    lang = languages.PARSER.get(suffix) or languages.PARSER.get(suffix.lower())
    if lang is None:
        return [], []
    if lang == "markdown":
        sections, blocks = markdown.read(source)
        symbols = [Symbol(s.title, "section", s.start, s.end, s.signature, s.docstring) for s in sections]
        for b in blocks:
            for s in parse("block" + b.extension, b.code)[0]:
                symbols.append(Symbol(s.name, s.kind, s.start + b.start, s.end + b.start, s.signature, s.docstring))
        return sorted(symbols, key=lambda s: s.start), []
    if lang in ("vue", "svelte"):
        script = _SCRIPT.search(source)
        if script is None:
            return [], []
        inner = "typescript" if re.search(rb"""lang\s*=\s*["']tsx?["']""", script[1], re.I) else "javascript"
        symbols, calls = parse_lexically(script[2], inner)
        at = script.start(2)
        return [Symbol(s.name, s.kind, s.start + at, s.end + at, s.signature, s.docstring) for s in symbols], [Call(c.pos + at, c.name) for c in calls]
    return PARSERS[lang](source) if lang in PARSERS else parse_lexically(source, lang)



_FIELDS = ["row", "repo", "file", "name", "kind", "start_byte", "end_byte", "signature", "docstring", "seq", "callee_name"]
_TYPES = pa.schema([(f, pa.int64() if f.endswith("byte") else pa.int32() if f == "seq" else pa.string()) for f in _FIELDS])


def extract(files: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(symbols, calls) of the files, read once each.

    Of symbols of one name in a file the last counts. A call belongs to every function or
    method whose span holds it, once for a name, in order of first appearance.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                try:
                    symbols, calls = parse(path, raw.as_py() or b"")
                except (RecursionError, ValueError):
                    continue  # a file that can't be read has no symbols
                for i, s in enumerate(symbols):
                    rows.append(("symbol", repo, path, s.name, s.kind, s.start, s.end, s.signature, s.docstring, i, None))
                if posixpath.splitext(path)[1] in languages.CALLS:
                    places = [c.pos for c in calls]
                    for s in {s.name: s for s in symbols}.values():
                        if s.kind in ("function", "method"):
                            own = calls[bisect_left(places, s.start) : bisect_left(places, s.end)]
                            for j, name in enumerate(dict.fromkeys(c.name for c in own)):
                                rows.append(("call", repo, path, s.name, s.kind, s.start, s.end, None, None, j, name))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TYPES, strict=True)], schema=_TYPES)

    ddl = ", ".join(f"{f} {'long' if f.endswith('byte') else 'int' if f == 'seq' else 'string'}" for f in _FIELDS)
    raw = files.select("repo", "path", F.col(content).cast("binary")).mapInArrow(work, ddl).withColumn("symbol_id", F.xxhash64("repo", "file", "name"))
    from srcatlas.operators.upsert import last_wins

    symbols = last_wins(raw.where("row = 'symbol'"), ["repo", "file", "name"], ["seq"])
    calls = raw.where("row = 'call'").select("symbol_id", "repo", "file", F.col("name").alias("caller_name"), "callee_name", "seq")
    return symbols.select("symbol_id", "repo", "file", "name", "kind", "start_byte", "end_byte", "signature", "docstring", F.lit(None).cast("array<float>").alias("embedding"), "seq"), calls
