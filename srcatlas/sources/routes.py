"""HTTP routes in source bytes, found with regular expressions on the JVM."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas import languages
from srcatlas.functions import text as fn


def latin1(content: Column) -> Column:
    """Bytes as text of as many characters, so that offsets count bytes and any byte matches."""
    return F.decode(content, "ISO-8859-1")


def utf8(text: Column) -> Column:
    """What latin1 text says as UTF-8; bytes that aren't are replaced."""
    return F.make_valid_utf8(F.encode(text, "ISO-8859-1").cast("string"))


def spans(text: Column, pattern: str, groups: int) -> Column:
    """All matches of a pattern: array of (start, end, groups).

    Starts are the lengths of all gaps and matches before, which split and
    regexp_extract_all give for the same pattern.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    each = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        lo = s["at"] + F.length(x["gap"])
        hi = lo + F.length(x["hit"])
        return F.struct(hi.alias("at"), F.concat(s["done"], F.array(F.struct(lo.alias("start"), hi.alias("end")))).alias("done"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    ranges = F.aggregate(pairs, start, step)["done"]
    return F.transform(ranges, lambda r, i: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.array(*[F.get(c, i) for c in each]).alias("groups")))


@dataclass
class Rule:
    """A pattern, how many groups it has, and what a match gives: methods, path and handler from its groups."""

    langs: tuple[str, ...]
    pattern: str
    groups: int
    methods: Callable[[Column], Column]
    path: Callable[[Column], Column]
    handler: Callable[[Column], Column]


def _g(i: int) -> Callable[[Column], Column]:
    return lambda g: F.get(g, F.lit(i - 1))


def _one(i: int) -> Callable[[Column], Column]:
    return lambda g: F.array(F.get(g, F.lit(i - 1)))


def _const(value: str) -> Callable[[Column], Column]:
    return lambda g: F.lit(value)


def _or_inline(i: int) -> Callable[[Column], Column]:
    return lambda g: F.when(F.get(g, F.lit(i - 1)) == "", "<inline>").otherwise(F.get(g, F.lit(i - 1)))


def _listed(i: int) -> Callable[[Column], Column]:
    """Methods of a list like "GET", 'POST'; GET if there is none."""

    def methods(g: Column) -> Column:
        raw = F.get(g, F.lit(i - 1))
        names = F.transform(F.split(raw, ","), lambda m: F.regexp_replace(m, r"""["'\s]""", ""))
        return F.when(F.trim(raw) == "", F.array(F.lit("GET"))).otherwise(F.filter(names, lambda m: m != ""))

    return methods


def _tidy(i: int) -> Callable[[Column], Column]:
    return lambda g: F.regexp_replace(F.get(g, F.lit(i - 1)), r"^\s+|[\s,]+$", "")


def _annotated(i: int) -> Callable[[Column], Column]:
    return lambda g: F.regexp_extract(F.get(g, F.lit(i - 1)), r"""(?i)(?:\b(?:value|path)\s*=\s*)?["'`]([^"'`]+)["'`]""", 1)


def _request_methods(i: int) -> Callable[[Column], Column]:
    def methods(g: Column) -> Column:
        found = F.regexp_extract_all(F.get(g, F.lit(i - 1)), F.lit(r"(?i)RequestMethod\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)"), F.lit(1))
        return F.when(F.size(found) == 0, F.array(F.lit("ANY"))).otherwise(found)

    return methods


_CS_HTTP = r"""(?i)Http(Get|Post|Put|Delete|Patch|Head|Options)(?:\(\s*["']?([^"'\)]*)["']?\s*\))?"""


def _cs_path(g: Column) -> Column:
    attributes = F.get(g, F.lit(0))
    own = F.regexp_extract(attributes, _CS_HTTP, 2)
    return F.when(own != "", own).otherwise(F.regexp_extract(attributes, r"""(?i)Route\(\s*["']([^"']+)["']\s*\)""", 1))


def _cs_method(g: Column) -> Column:
    name = F.regexp_extract(F.get(g, F.lit(0)), _CS_HTTP, 1)
    return F.filter(F.array(name), lambda m: m != "")


_VERBS = "get|post|put|delete|patch|head|options"
_WORD = r"(?<![A-Za-z0-9_])"  # a word's start among bytes
_JS = ("javascript", "typescript")
_JVM = ("java", "kotlin")

# The shapes that count as routes, in order.
RULES = [
    Rule(("python",), r"""(?s)@\w+\.(?:route|api_route)\(\s*["']([^"']+)["']\s*(?:,\s*methods\s*=\s*\[([^\]]*)\])?\s*\)\s*\n\s*(?:async\s+)?def\s+(\w+)""", 3, _listed(2), _g(1), _g(3)),
    Rule(("python",), rf"""(?s)@\w+\.({_VERBS})\(\s*["']([^"']+)["']\s*\)\s*\n\s*(?:async\s+)?def\s+(\w+)""", 3, _one(1), _g(2), _g(3)),
    Rule(("python",), r"""(?:re_path|path)\(\s*r?["']([^"']+)["']\s*,\s*([\w.]+(?:\([^)]*\))?)""", 2, lambda g: F.array(F.lit("ANY")), _g(1), _g(2)),
    Rule(_JS, rf"""(?i){_WORD}\w+\.({_VERBS}|all)\(\s*["'`]([^"'`]+)["'`]\s*,\s*(?!async(?![A-Za-z0-9_]))([\w.$]+)""", 3, _one(1), _g(2), _g(3)),
    Rule(_JS, rf"""(?i){_WORD}\w+\.({_VERBS}|all)\(\s*["'`]([^"'`]+)["'`]\s*,\s*(?:async\s+)?(?:function(?![A-Za-z0-9_])|\([^)]*\)\s*=>)""", 2, _one(1), _g(2), _const("<inline>")),
    Rule(("php",), rf"""(?i){_WORD}Route::({_VERBS}|any)\(\s*["']([^"']+)["']\s*,\s*([^)]+)\)""", 3, _one(1), _g(2), _tidy(3)),
    Rule(("php",), rf"""(?i){_WORD}Route::match\(\s*\[([^\]]+)\]\s*,\s*["']([^"']+)["']\s*,\s*([^)]+)\)""", 3, _listed(1), _g(2), _tidy(3)),
    Rule(("go",), rf"""(?i){_WORD}\w+\.({_VERBS}|any|handle|handlefunc)\(\s*["'`]([^"'`]+)["'`]\s*,\s*(?:([\w.]+)|func(?![A-Za-z0-9_]))""", 3, _one(1), _g(2), _or_inline(3)),
    Rule(_JVM, r"""(?is)@(Get|Post|Put|Delete|Patch)Mapping\(\s*([^)]*?)\)\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:public|protected|private)?[^{;=\n]*?\s+(\w+)\s*\(""", 3, _one(1), _annotated(2), _g(3)),
    Rule(_JVM, r"""(?is)@RequestMapping\(\s*([^)]*?)\)\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:public|protected|private)?[^{;=\n]*?\s+(\w+)\s*\(""", 2, _request_methods(1), _annotated(1), _g(2)),
    Rule(("csharp",), r"""(?is)((?:\[[^\]]+\]\s*)+)(?:public|protected|private|internal)\s+[^{;=\n]*?\s+(\w+)\s*\(""", 2, _cs_method, _cs_path, _g(2)),
    Rule(("ruby",), rf"""(?i){_WORD}({_VERBS})\s+["']([^"']+)["']\s*,\s*to:\s*["']([^"']+)["']""", 3, _one(1), _g(2), _g(3)),
    Rule(("ruby",), rf"""(?i){_WORD}({_VERBS})\s+["']([^"']+)["']\s*=>\s*["']([^"']+)["']""", 3, _one(1), _g(2), _g(3)),
    Rule(("ruby",), rf"""(?i){_WORD}({_VERBS})\s+["']([^"']+)["']\s+do(?![A-Za-z0-9_])""", 2, _one(1), _g(2), _const("<inline>")),
    Rule(("elixir",), rf"""(?i){_WORD}({_VERBS})\s+["']([^"']+)["']\s*,\s*([\w.]+)\s*,\s*:(\w+)""", 4, _one(1), _g(2), lambda g: F.concat_ws(".", F.get(g, F.lit(2)), F.get(g, F.lit(3)))),
    Rule(("rust",), rf"""(?is)#\[({_VERBS})\(\s*["']([^"']+)["']\s*\)\]\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)""", 3, _one(1), _g(2), _g(3)),
]
_CHAIN = rf"""(?i){_WORD}\w+\.route\(\s*["'`]([^"'`]+)["'`]\s*\)"""
_CHAIN_CALL = rf"""(?i)\.\s*({_VERBS}|all)\(\s*(?:async\s+)?(?:(function(?![A-Za-z0-9_]))|(\([^)]*\)\s*=>)|([\w.$]+))"""


def _method(name: Column) -> Column:
    m = F.upper(F.trim(name))
    return F.when(m.isin("ALL", "ANY", "HANDLE", "HANDLEFUNC"), "ANY").otherwise(m)


def extract_routes(files: DataFrame, content: str = "content", langs: tuple[str, ...] | None = None) -> DataFrame:
    """(repo, file, method, path, handler, start_byte, end_byte) of all files whose extension has rules.

    ``langs`` names the only languages to look at; the plan then has their rules alone.
    """
    lang = fn.lookup(F.lower(fn.extension(F.col("path"))), languages.ROUTES, F.lit(None).cast("string"))
    known = files.select("repo", F.col("path").alias("file"), lang.alias("lang"), latin1(F.col(content)).alias("t")).where("lang IS NOT NULL AND t IS NOT NULL")
    rules = RULES if langs is None else [r for r in RULES if set(r.langs) & set(langs)]
    known = known if langs is None else known.where(F.col("lang").isin(*langs))
    route = "struct<method: string, path: string, handler: string, start_byte: bigint, end_byte: bigint>"
    nothing = F.array().cast(f"array<{route}>")
    made = lambda m, p, h, lo, hi: F.struct(_method(m).alias("method"), p.alias("path"), h.alias("handler"), lo.alias("start_byte"), hi.alias("end_byte"))
    found = []
    for rule in rules:
        hits = _rows(F.col("t"), rule, made)
        found.append(F.when(F.col("lang").isin(*rule.langs), F.flatten(hits)).otherwise(nothing))
    if langs is None or set(_JS) & set(langs):
        found.append(F.when(F.col("lang").isin(*_JS), F.flatten(_chains(F.col("t"), made))).otherwise(nothing))
    rows = known.select("repo", "file", F.explode(F.concat(*found)).alias("r")).select("repo", "file", "r.*")
    text = [utf8(F.col(c)).alias(c) for c in ("path", "handler")]
    return rows.where("path != ''").select("repo", "file", "method", *text, "start_byte", "end_byte").distinct()


def _rows(text: Column, rule: Rule, made) -> Column:
    def one(m: Column) -> Column:
        return F.transform(rule.methods(m["groups"]), lambda name: made(name, rule.path(m["groups"]), rule.handler(m["groups"]), m["start"], m["end"]))

    return F.transform(spans(text, rule.pattern, rule.groups), one)


def _chains(text: Column, made) -> Column:
    """Calls chained to .route(path), each up to the next semicolon."""

    def one(m: Column) -> Column:
        semicolon = F.instr(F.substr(text, (m["end"] + 1).cast("int")), ";")
        end = F.when(semicolon > 0, m["end"] + semicolon - 1).otherwise(F.length(text).cast("long"))
        chain = F.substr(text, (m["end"] + 1).cast("int"), (end - m["end"]).cast("int"))
        verbs = F.regexp_extract_all(chain, F.lit(_CHAIN_CALL), F.lit(1))
        names = F.regexp_extract_all(chain, F.lit(_CHAIN_CALL), F.lit(4))
        pairs = F.zip_with(verbs, names, lambda v, n: F.struct(v.alias("v"), F.when(n == "", "<inline>").otherwise(n).alias("n")))
        return F.transform(pairs, lambda p: made(p["v"], F.get(m["groups"], F.lit(0)), p["n"], m["start"], end))

    return F.transform(spans(text, _CHAIN, 1), one)

