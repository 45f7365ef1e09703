"""Searches over symbols, text, routes and vectors. Every limit has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from srcatlas.functions import text as fn

SYMBOL_ORDER = ["repo", "file", "start_byte", "name", "symbol_id"]


def search_symbols(symbols: DataFrame, query: str, repo: str | None = None, kind: str | None = None, limit: int = 20, exact: bool = False) -> DataFrame:
    """Symbols whose name starts with the query or, only if there are none, contains it.

    Both kinds are ranked in one pass: the first ``limit`` rows by rank hold a prefix
    match if there is any, so what is left of them at their smallest rank is the answer.
    """
    found = _ranked(symbols, query, exact)
    if repo is not None:
        found = found.where(F.col("repo") == repo)
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    top = found.orderBy("__rank", *SYMBOL_ORDER).limit(limit)
    least = F.min("__rank").over(Window.partitionBy())
    return top.withColumn("__least", least).where("__rank = __least").drop("__rank", "__least")


def search_symbols_by_repo(symbols: DataFrame, query: str, kind: str | None = None, limit: int = 20, exact: bool = False) -> DataFrame:
    """search_symbols for every repository on its own: ``limit`` rows for each."""
    found = _ranked(symbols, query, exact)
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    order = Window.partitionBy("repo").orderBy("__rank", "file", "start_byte", "name", "symbol_id")
    top = found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit)
    least = F.min("__rank").over(Window.partitionBy("repo"))
    once = Window.partitionBy("repo", "file", "name").orderBy("start_byte", "symbol_id")
    best = top.withColumn("__least", least).where("__rank = __least").withColumn("__once", F.row_number().over(once))
    return best.where("__once = 1").drop("__rank", "__least", "__n", "__once")


def _ranked(symbols: DataFrame, query: str, exact: bool) -> DataFrame:
    rank = F.when(fn.like("name", query, False, exact), 0).when(fn.like("name", query, True, exact), 1)
    return symbols.withColumn("__rank", rank).where("__rank IS NOT NULL")


def symbols_named(symbols: DataFrame, names: list[str], repo: str | None = None) -> DataFrame:
    """Symbols with exactly one of the given names."""
    found = symbols.where(F.col("name").isin(list(names)))
    return found if repo is None else found.where(F.col("repo") == repo)


def file_outline(symbols: DataFrame, repo: str, file: str) -> DataFrame:
    return symbols.where((F.col("repo") == repo) & (F.col("file") == file)).orderBy("start_byte", "name")


def symbol_at(symbols: DataFrame, files: DataFrame, repo: str, file: str, start: int, end: int) -> DataFrame:
    """The symbol of exactly that span, with its source."""
    if end <= start:
        raise ValueError("the end must be behind the start")
    found = symbols.where((F.col("repo") == repo) & (F.col("file") == file) & (F.col("start_byte") == start) & (F.col("end_byte") == end))
    content = files.where((F.col("repo") == repo) & (F.col("path") == file)).select("content")
    return found.join(content).withColumn("source", byte_range(F.col("content"), F.col("start_byte"), F.col("end_byte"))).drop("content")


def byte_range(content: Column, start: Column, end: Column, most: int | None = None) -> Column:
    """The bytes [start, end) as text; with ``most``, so many at most, and the head of an empty or missing range."""
    n = end - start
    if most is None:
        piece = F.substr(content, (start + 1).cast("int"), n.cast("int"))
    else:
        whole = F.coalesce(n > 0, F.lit(False))
        piece = F.when(whole, F.substr(content, (start + 1).cast("int"), F.least(n, F.lit(most)).cast("int"))).otherwise(F.substr(content, F.lit(1), F.lit(most)))
    return F.make_valid_utf8(piece.cast("string"))


def hits_by_file(files: DataFrame, query: str, per_file: int = 5, text: str = "content") -> DataFrame:
    """``files`` with an array of (line, text): the first lines that contain the query, whatever the case."""
    lines = F.transform(F.split(F.col(text).cast("string"), "\r\n|\r|\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line"), x.alias("text")))
    hits = F.filter(lines, lambda s: F.lower(s["text"]).contains(query.lower()))
    trimmed = F.transform(F.slice(hits, 1, per_file), lambda s: F.struct(s["line"].alias("line"), fn.rstrip(s["text"]).alias("text")))
    # a cheap test on the whole text spares splitting most files
    return files.where(F.lower(F.col(text).cast("string")).contains(query.lower())).withColumn("hits", trimmed).where(F.size("hits") > 0)


def search_text(files: DataFrame, query: str, repo: str | None = None, pattern: str | None = None, per_file: int = 5, enough: int = 100, text: str = "content") -> DataFrame:
    """(repo, file, line, text) of literal matches, in order of path.

    Files give up to ``per_file`` lines each; the last file is the one that brings the
    total to ``enough``. As each file gives one at least, the first ``enough`` files with
    matches are all that the running total needs to see, so nothing is shuffled but them.
    """
    found = files if repo is None else files.where(F.col("repo") == repo)
    if pattern is not None:
        found = found.where(F.col("path").rlike(fn.glob_regex(pattern)))
    first = hits_by_file(found, query, per_file, text).select("repo", F.col("path").alias("file"), "hits").orderBy("file", "repo").limit(enough)
    before = F.sum(F.size("hits")).over(Window.partitionBy().orderBy("file", "repo").rowsBetween(Window.unboundedPreceding, -1))
    kept = first.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") < enough)
    return kept.select("repo", "file", F.explode("hits").alias("h")).select("repo", "file", "h.line", "h.text")


def search_routes(routes: DataFrame, repo: str | None = None, method: str | None = None, path_contains: str | None = None, limit: int = 50, exact: bool = False) -> DataFrame:
    """Routes by method and part of the path, in order of file and position."""
    found = routes if repo is None else routes.where(F.col("repo") == repo)
    if method is not None:
        found = found.where(F.col("method") == method.upper())
    if path_contains is not None:
        found = found.where(fn.like("path", path_contains, True, exact))
    return found.orderBy("file", "start_byte", "method", "path", "handler").limit(limit)


def _first_by_term(found: DataFrame, order: list, limit: int) -> DataFrame:
    """Of each term's rows (column ord) the first ``limit`` by a total order."""
    w = Window.partitionBy("ord").orderBy(*order)
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit)


def symbols_by_term(symbols: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """search_symbols for several terms in one scan; ``ord`` is the term's place."""
    rank = lambda t: F.when(fn.like("name", t, False), 0).when(fn.like("name", t, True), 1)
    each = F.array(*[F.struct(F.lit(i).alias("ord"), rank(t).alias("__rank")) for i, t in enumerate(terms)])
    found = symbols.withColumn("__t", F.explode(F.filter(each, lambda x: x["__rank"].isNotNull()))).select(*symbols.columns, "__t.*")
    top = _first_by_term(found, ["__rank", *SYMBOL_ORDER], limit)
    least = F.min("__rank").over(Window.partitionBy("ord"))
    return top.withColumn("__least", least).where("__rank = __least").drop("__rank", "__least", "__n")


def text_by_term(files: DataFrame, terms: list[str], per_file: int = 5, enough: int = 100, text: str = "content") -> DataFrame:
    """search_text for several terms at once.

    One scan looks which texts have a term, and only names are sorted; as each file gives
    one line at least, each term's first ``enough`` files are all that is read again and
    split into lines.
    """
    lower = files.select("repo", F.col("path").alias("file"), F.lower(F.col(text).cast("string")).alias("__lower"))
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.col("__lower").contains(t.lower()).alias("in")) for i, t in enumerate(terms)])
    some = lower.select("repo", "file", F.explode(each).alias("t")).where("t.in").select("repo", "file", "t.ord")
    chosen = _first_by_term(some, ["file", "repo"], enough).select(F.col("repo").alias("__repo"), "file", "ord").distinct()
    chosen = F.broadcast(chosen)  # ``enough`` rows a term
    found = files.join(chosen, F.col("repo").eqNullSafe(F.col("__repo")) & F.col("path").eqNullSafe(F.col("file")))
    term = F.element_at(F.array(*[F.lit(t.lower()) for t in terms]), F.col("ord") + 1)
    lines = F.transform(F.split(F.col(text).cast("string"), "\r\n|\r|\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line"), x.alias("text")))
    hits = F.slice(F.filter(lines, lambda s: F.contains(F.lower(s["text"]), term)), 1, per_file)
    hits = F.transform(hits, lambda s: F.struct(s["line"].alias("line"), fn.rstrip(s["text"]).alias("text")))
    found = found.select("repo", "file", "ord", hits.alias("hits")).where(F.size("hits") > 0)
    before = F.sum(F.size("hits")).over(Window.partitionBy("ord").orderBy("file", "repo").rowsBetween(Window.unboundedPreceding, -1))
    some = found.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") < enough)
    return some.select("ord", "repo", "file", F.explode("hits").alias("h")).select("ord", "repo", "file", "h.line", "h.text")


def routes_by_term(routes: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """search_routes by path for several terms in one scan."""
    each = F.array(*[F.when(fn.like("path", t, True), F.lit(i)) for i, t in enumerate(terms)])
    found = routes.withColumn("ord", F.explode(F.filter(each, lambda x: x.isNotNull())))
    return _first_by_term(found, ["file", "start_byte", "method", "path", "handler"], limit).drop("__n")


def dot(vector: Column, query: list[float]) -> Column:
    """The inner product in double precision."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, literal, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def search_vectors(symbols: DataFrame, query: list[float], repo: str | None = None, limit: int = 10, key: str = "symbol_id", vector: str = "embedding") -> DataFrame:
    """The rows of the largest inner product, rounded to 4 places, ties by key. Rows without a vector take no part."""
    found = symbols if repo is None else symbols.where(F.col("repo") == repo)
    scored = found.where(F.col(vector).isNotNull()).withColumn("score", F.round(dot(F.col(vector), query), 4))
    return scored.orderBy(F.desc("score"), key).limit(limit)


def has_embeddings(symbols: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Whether any, and whether all, rows of a group have a vector."""
    return symbols.groupBy(*by).agg(F.bool_or(F.col(vector).isNotNull()).alias("has_embeddings"), F.bool_or(F.col(vector).isNull()).alias("missing_embeddings"))
