"""Column functions on text, paths and results; all JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcatlas import languages

LINE_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
_SPACE = r"[\s\x1c-\x1f]"


def literal(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U){_SPACE}+$", "")


def like(column: str, query: str, contains: bool, exact: bool = False) -> Column:
    """Whether a column starts with (or contains) the query, whatever the case.

    % and _ in the query are wildcards, unless ``exact``.
    """
    q = query.replace("^", "^^")
    if exact:
        q = q.replace("%", "^%").replace("_", "^_")
    return F.expr(f"{column} ILIKE {literal(('%' if contains else '') + q + '%')} ESCAPE '^'")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a file name pattern: * also crosses /, [!x] negates."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            inside = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&\\&").replace("^", "\\^")
            out += "[" + ("^" + inside[1:] if inside[:1] == "!" else inside) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def lines_of_code(text: Column) -> Column:
    """Lines that are neither blank nor comment, by a fold over the lines.

    A line that starts a block comment opens a block, unless it also ends one (so a
    triple quote alone does neither); a block lasts to a line that contains */ or ends
    with a triple quote. Lines that start with #, // or -- don't count.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_BREAKS), strip)
    ends = lambda s, marks: _any([s.endswith(m) for m in marks])
    starts = lambda s, marks: _any([s.startswith(m) for m in marks])
    quotes = ["'''", '"""']

    def step(state: Column, s: Column) -> Column:
        n, inside = state["n"], state["inside"]
        made = lambda a, b: F.struct(a.alias("n"), b.alias("inside"))
        return (
            F.when(s == "", made(n, inside))
            .when(inside, made(n, ~(s.contains("*/") | ends(s, quotes))))
            .when(starts(s, ["#", "//", "--"]), made(n, F.lit(False)))
            .when(starts(s, ["/*", "<!--", *quotes]), made(n, ~ends(s, ["*/", "-->", *quotes])))
            .otherwise(made(n + 1, F.lit(False)))
        )

    return F.aggregate(lines, F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("inside")), step)["n"]


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded up; 0 for empty."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.ceil(n / 4).cast("long")


def extension(path: Column) -> Column:
    """The last suffix of the file name, as written; empty if it has none."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    """A fixed table as a map literal."""
    entries = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), default)


def stats_language(path: Column) -> Column:
    return lookup(F.lower(extension(path)), languages.STATS, F.lit("other"))


def language_surface(path: Column) -> Column:
    suffix = F.lower(extension(F.replace(path, F.lit("\\"), F.lit("/"))))
    return F.when(F.coalesce(path, F.lit("")) == "", "unknown").otherwise(lookup(suffix, languages.SURFACE, F.lit("unknown")))


def parser_mode(path: Column, kind: str) -> Column:
    if kind in ("text", "route"):
        return F.lit({"text": "fallback_text", "route": "regex_route"}[kind])
    surface = language_surface(path)
    # the readers that are used here: Python by its grammar, others lexically
    return F.when(surface == "markdown", "native_markdown").when(surface == "unknown", "unknown").when(surface == "python", "grammar").otherwise("lexical")


# What makes a path one of generated code.
GENERATED_PARTS = ["dist", "build", "coverage", "node_modules", "vendor", ".next", "__pycache__"]
GENERATED_SUFFIXES = [".generated.py", ".generated.ts", ".pb.go", ".g.dart", ".designer.cs"]


def is_generated(path: Column) -> Column:
    p = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    return F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, GENERATED_PARTS))) | _any([p.endswith(s) for s in GENERATED_SUFFIXES])


def path_kind(path: Column) -> Column:
    """test, doc or text, by the path; the test rule first."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.regexp_extract(p, r"[^/]*$", 0)
    test = F.concat(F.lit("/"), p).contains("/tests/") | name.startswith("test_") | name.endswith("_test.py")
    doc = p.startswith("docs/") | p.rlike(r"[^/]\.(md|markdown|mdx|rst)$")
    return F.when(test, "test").when(doc, "doc").otherwise("text")


def query_terms(query: str) -> list[str]:
    """The distinct lower-case words of a query, in order; the whole query if it has none."""
    words = [w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_/-]*", query)]
    return list(dict.fromkeys(w for w in words if len(w) > 1)) or [query.strip().lower()]


def quality(kind: str, path: Column, handler: Column | None = None, score: Column | None = None, stale: Column | None = None, last_indexed: Column | None = None, has_embeddings: Column | None = None) -> Column:
    """The quality struct of a result. Confidences are fixed by kind, but for semantic hits and routes."""
    # Confidence and its reason by kind.
    known = {"text": (0.70, "indexed file text match"), "outline": (0.90, "file outline from indexed symbols"), "symbol": (0.92, "exact symbol match from parser")}
    none = F.lit(None)
    route = none.cast("double")
    if kind == "semantic":
        confidence, reason = F.coalesce(score, F.lit(0.0)), F.lit("semantic embedding similarity")
    elif kind == "route":
        has = F.coalesce(handler, F.lit("")) != ""
        confidence = route = F.when(has, 0.85).otherwise(0.65)
        reason = F.when(has, "route extracted with handler").otherwise("route extracted without handler")
    else:
        value, why = known.get(kind, (0.50, "quality unknown"))
        confidence, reason = F.lit(value), F.lit(why)
    return F.struct(
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence.cast("double"))), 4).alias("confidence"),
        reason.alias("confidence_reason"),
        (~stale if stale is not None else none.cast("boolean")).alias("index_fresh"),
        (last_indexed if last_indexed is not None else none.cast("timestamp")).alias("last_indexed"),
        parser_mode(path, kind).alias("parser_mode"),
        language_surface(path).alias("language_surface"),
        is_generated(path).alias("is_generated"),
        F.lit(False).alias("is_ignored"),
        none.cast("string").alias("ignored_reason"),
        (has_embeddings if has_embeddings is not None else none.cast("boolean")).alias("has_embeddings"),
        route.alias("route_confidence"),
    )


def status_quality(stale: Column, last_indexed: Column, has_embeddings: Column) -> Column:
    """The quality struct of an index's status. Confidence and reason are fixed values."""
    return F.struct(F.lit(0.90).alias("confidence"), F.lit("index status from registry and files table").alias("confidence_reason"), (~stale).alias("index_fresh"), last_indexed.alias("last_indexed"), has_embeddings.alias("has_embeddings"))
