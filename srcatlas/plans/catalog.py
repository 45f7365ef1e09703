"""Queries over the driver's tables, one for each operator, with their SQL.

The tables stand in for an index: parts are symbols (a brand is a repository), documents
are files, pages are routes, and order lines are calls from suppliers to parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.functions import text as fn
from srcatlas.lineage import cut
from srcatlas.operators import graph, search, stats, upsert
from srcatlas.plans import pack

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function by its name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- the tables as an index


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("repo"), F.concat_ws("/", "p_brand", "p_type").alias("file"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").cast("long").alias("start_byte"), (F.col("p_size") + 100).cast("long").alias("end_byte"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.lit("corpus").alias("repo"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"), "doc_id")


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    method = F.element_at(F.array(*map(F.lit, ["GET", "POST", "PUT"])), (F.col("page_id") % 3 + 1).cast("int"))
    return p.select(F.lit("web").alias("repo"), host.alias("file"), method.alias("method"), path.alias("path"), F.lit("").alias("handler"), F.col("page_id").alias("start_byte"), (F.col("page_id") + F.length("url")).alias("end_byte"))


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))
    s, p = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return li.join(s, "s_suppkey").join(p, "p_partkey").select(F.col("s_suppkey").alias("caller_id"), F.lit("orders").alias("repo"), F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("caller_file"), F.col("s_name").alias("caller_name"), F.col("p_name").alias("callee_name"), F.concat(F.lit("part/"), "p_brand").alias("callee_file"))


def user_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from a user to the user of the next event of the same hour."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", "ts")
    nxt = F.lead("user_id").over(Window.partitionBy(hour).orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("src"), nxt.alias("dst")).where("dst IS NOT NULL")


_PART = "(SELECT p_partkey AS symbol_id, p_brand AS repo, p_brand || '/' || p_type AS file, p_name AS name, p_type AS kind, CAST(p_size AS BIGINT) AS start_byte, CAST(p_size + 100 AS BIGINT) AS end_byte FROM part)"
_FILES = "(SELECT 'corpus' AS repo, source || '/' || doc_id || '.txt' AS path, text AS content, doc_id FROM documents)"
_ROUTES = "(SELECT 'web' AS repo, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS file, ['GET', 'POST', 'PUT'][page_id % 3 + 1] AS method, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, '' AS handler, page_id AS start_byte, page_id + length(url) AS end_byte FROM pages)"
_EDGES = "(SELECT s_suppkey AS caller_id, 'orders' AS repo, 'supplier/' || s_suppkey AS caller_file, s_name AS caller_name, p_name AS callee_name, 'part/' || p_brand AS callee_file FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"
_GRAPH = "(SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"
_LINES = r"regexp_split_to_array(content, '\r\n|\r|\n')"

SYMBOL_COLUMNS = ["symbol_id", "repo", "file", "name", "kind", "start_byte", "end_byte"]

# ---- searches


def _search_sql(q: str, where: str = "true", limit: int = 20) -> str:
    return f"""WITH r AS (SELECT *, CASE WHEN name ILIKE '{q}%' THEN 0 WHEN name ILIKE '%{q}%' THEN 1 END AS k FROM {_PART} WHERE {where})
SELECT symbol_id, repo, file, name, kind, start_byte, end_byte FROM r WHERE k = (SELECT min(k) FROM r) ORDER BY repo, file, start_byte, name, symbol_id LIMIT {limit}"""


@query(_search_sql("blu"))
def symbol_search_prefix(spark, sf_dir):
    return search.search_symbols(part_symbols(spark, sf_dir), "blu").select(SYMBOL_COLUMNS)


@query(_search_sql("e_r"))
def symbol_search_contains(spark, sf_dir):
    return search.search_symbols(part_symbols(spark, sf_dir), "e_r").select(SYMBOL_COLUMNS)


@query(_search_sql("blu", "kind = (SELECT min(p_type) FROM part)"))
def symbol_search_kind(spark, sf_dir):
    s = part_symbols(spark, sf_dir)
    kind = s.agg(F.min("kind").alias("kind")).first()["kind"]
    return search.search_symbols(s, "blu", kind=kind).select(SYMBOL_COLUMNS)


@query(f"""WITH r AS (SELECT *, CASE WHEN name ILIKE 'blu%' THEN 0 WHEN name ILIKE '%blu%' THEN 1 END AS k FROM {_PART}),
m AS (SELECT *, min(k) OVER (PARTITION BY repo) AS best FROM r WHERE k IS NOT NULL)
SELECT symbol_id, repo, file, name, kind, start_byte, end_byte FROM (SELECT * FROM m WHERE k = best QUALIFY row_number() OVER (PARTITION BY repo ORDER BY file, start_byte, name, symbol_id) <= 20) QUALIFY row_number() OVER (PARTITION BY repo, file, name ORDER BY start_byte, symbol_id) = 1""")
def symbol_search_per_repo_topk(spark, sf_dir):
    return search.search_symbols_by_repo(part_symbols(spark, sf_dir), "blu").select(SYMBOL_COLUMNS)


@query(f"SELECT * FROM {_PART} WHERE name IN (SELECT p_name FROM part WHERE p_partkey IN (1, 5, 77))")
def symbols_exact(spark, sf_dir):
    s = part_symbols(spark, sf_dir)
    names = [r["name"] for r in s.where(F.col("symbol_id").isin(1, 5, 77)).select("name").collect()]
    return search.symbols_named(s, names).select(SYMBOL_COLUMNS)


@query(f"SELECT * FROM {_PART} WHERE repo = (SELECT min(p_brand) FROM part) AND file = (SELECT min(p_brand || '/' || p_type) FROM part)")
def file_outline(spark, sf_dir):
    s = part_symbols(spark, sf_dir)
    first = s.agg(F.min("repo").alias("r"), F.min("file").alias("f")).first()
    return search.file_outline(s, first["r"], first["f"]).select(SYMBOL_COLUMNS)


@query(f"""WITH l AS (SELECT repo, path AS file, unnest({_LINES}) AS text, unnest(range(1, len({_LINES}) + 1)) AS line FROM {_FILES}),
h AS (SELECT * FROM l WHERE contains(lower(text), 'licensed') QUALIFY row_number() OVER (PARTITION BY file ORDER BY line) <= 5),
f AS (SELECT file, count(*) AS n FROM h GROUP BY file),
k AS (SELECT file FROM f QUALIFY coalesce(sum(n) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 100)
SELECT repo, file, line, rtrim(text) AS text FROM h JOIN k USING (file)""")
def text_search_capped(spark, sf_dir):
    return search.search_text(document_files(spark, sf_dir), "licensed")


@query(f"""WITH l AS (SELECT repo, path AS file, unnest({_LINES}) AS text, unnest(range(1, len({_LINES}) + 1)) AS line FROM {_FILES} WHERE path GLOB 'src1*/*[!02468].txt'),
h AS (SELECT * FROM l WHERE contains(lower(text), 'the') QUALIFY row_number() OVER (PARTITION BY file ORDER BY line) <= 5),
f AS (SELECT file, count(*) AS n FROM h GROUP BY file),
k AS (SELECT file FROM f QUALIFY coalesce(sum(n) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 100)
SELECT repo, file, line, rtrim(text) AS text FROM h JOIN k USING (file)""")
def text_search_glob(spark, sf_dir):
    return search.search_text(document_files(spark, sf_dir), "the", pattern="src1*/*[!02468].txt")


@query(f"SELECT * FROM {_ROUTES} WHERE method = 'POST' AND path ILIKE '%/en/%' ORDER BY file, start_byte LIMIT 50")
def route_search(spark, sf_dir):
    return search.search_routes(page_routes(spark, sf_dir), method="post", path_contains="/en/")


@query("""WITH m AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">') AS hits, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS paths, regexp_split_to_array(html, '<a href="[^"]*">') AS gaps FROM pages),
x AS (SELECT page_id, unnest(hits) AS hit, unnest(paths) AS path, unnest(range(1, len(hits) + 1)) AS i, gaps, hits FROM m)
SELECT page_id, path, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS start_at,
CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(hits[1:i], lambda h: length(h))) AS BIGINT) AS end_at FROM x""")
def route_extract_spans(spark, sf_dir):
    from srcatlas.sources.routes import spans

    p = table(spark, sf_dir, "pages")
    found = spans(F.col("html"), '<a href="([^"]*)">', 1)
    return p.select("page_id", F.explode(found).alias("m")).select("page_id", F.col("m.groups")[0].alias("path"), F.col("m.start").alias("start_at"), F.col("m.end").alias("end_at"))


@query("""WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, qe), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 4) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""")
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    vector = e.where("vec_id = 0").select("embedding").first()["embedding"]
    return search.search_vectors(e, vector, key="vec_id").select("vec_id", "score")


@query("SELECT label, bool_or(embedding IS NOT NULL) AS has_embeddings, bool_or(embedding IS NULL) AS missing_embeddings FROM embeddings GROUP BY label")
def vector_exists(spark, sf_dir):
    return search.has_embeddings(table(spark, sf_dir, "embeddings"), ["label"])


# ---- the call graph


@query(f"SELECT s_suppkey AS symbol_id, s_name AS name FROM supplier JOIN {_EDGES} e ON s_suppkey = caller_id WHERE callee_name = (SELECT p_name FROM part WHERE p_partkey = 7)")
def callers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol_id"), F.col("s_name").alias("name"))
    name = table(spark, sf_dir, "part").where("p_partkey = 7").first()["p_name"]
    return graph.callers(line_edges(spark, sf_dir), s, name)


@query(f"SELECT callee_name, callee_file FROM {_EDGES} WHERE caller_name = (SELECT s_name FROM supplier WHERE s_suppkey = 3)")
def callees(spark, sf_dir):
    name = table(spark, sf_dir, "supplier").where("s_suppkey = 3").first()["s_name"]
    return graph.callees(line_edges(spark, sf_dir), name)


@query(f"SELECT DISTINCT caller_file AS src, callee_file AS dst FROM {_EDGES}")
def file_graph(spark, sf_dir):
    return graph.file_graph(line_edges(spark, sf_dir))


@query("""SELECT DISTINCT l_suppkey AS symbol_id, 'orders' AS repo, callee_file, p_name AS callee_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT p_name, min(p_brand) AS callee_file FROM part GROUP BY p_name) USING (p_name)""")
def callee_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol_id"), F.lit("orders").alias("repo"), F.col("l_partkey").alias("p_partkey"))
    calls = li.join(p.select("p_partkey", F.col("p_name").alias("callee_name")), "p_partkey").select("symbol_id", "repo", F.lit("f").alias("file"), F.lit("c").alias("caller_name"), "callee_name")
    symbols = p.select(F.lit("orders").alias("repo"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"))
    return graph.resolve_calls(calls, symbols).select(F.col("caller_id").alias("symbol_id"), "repo", "callee_file", "callee_name")


@query("""SELECT a.o_orderkey AS pos, c_custkey AS symbol_id FROM orders a JOIN customer ON c_nationkey = a.o_custkey % 25 WHERE a.o_orderkey >= c_custkey AND a.o_orderkey < c_custkey + 10""")
def calls_in_symbols(spark, sf_dir):
    calls = table(spark, sf_dir, "orders").select(F.lit("r").alias("repo"), (F.col("o_custkey") % 25).cast("string").alias("file"), F.col("o_orderkey").alias("pos"))
    symbols = table(spark, sf_dir, "customer").select(F.lit("r").alias("repo"), F.col("c_nationkey").cast("string").alias("file"), F.col("c_custkey").alias("symbol_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("start_byte"), (F.col("c_custkey") + 10).alias("end_byte"))
    return graph.calls_in_symbols(calls, symbols).select("pos", "symbol_id")


_REACH = f"""und AS (SELECT src AS a, dst AS b FROM {_GRAPH} UNION SELECT dst, src FROM {_GRAPH}),
f0 AS (SELECT min(src) AS node FROM {_GRAPH}), f1 AS (SELECT node FROM f0 UNION SELECT b FROM und JOIN f0 ON a = node), f2 AS (SELECT node FROM f1 UNION SELECT b FROM und JOIN f1 ON a = node)"""


@query(f"WITH {_REACH} SELECT src, dst FROM {_GRAPH} WHERE src IN (SELECT node FROM f2) AND dst IN (SELECT node FROM f2)")
def bfs_neighbourhood(spark, sf_dir):
    g = user_graph(spark, sf_dir)
    focus = g.agg(F.min("src").alias("s")).first()["s"]
    return graph.neighbourhood(g, focus, 2)


@query(f"WITH g AS (SELECT DISTINCT src, dst FROM {_GRAPH}) SELECT [src, dst] AS cycle, CAST(1 AS BIGINT) AS length FROM g WHERE src = dst ORDER BY cycle LIMIT 20")
def cycle_self_loops(spark, sf_dir):
    return graph.cycles(user_graph(spark, sf_dir).where("src = dst"))


@query(f"""WITH RECURSIVE g AS (SELECT DISTINCT src, dst FROM {_GRAPH} WHERE src <> dst),
p(path, nxt, n) AS (SELECT [src], dst, 1 FROM g WHERE src < dst
  UNION ALL SELECT list_append(path, nxt), dst, n + 1 FROM p JOIN g ON src = nxt WHERE n < 3 AND nxt > path[1] AND dst >= path[1] AND (dst = path[1] OR NOT list_contains(list_append(path, nxt), dst)))
SELECT list_append(path, nxt) AS cycle, CAST(n AS BIGINT) AS length FROM p WHERE nxt = path[1] ORDER BY n, cycle LIMIT 20""")
def cycles_capped(spark, sf_dir):
    """The first 20 cycles of any length; the tables hold so many of length 2 and 3, beyond which the SQL need not look."""
    return graph.cycles(user_graph(spark, sf_dir).where("src <> dst"))


@query("""WITH RECURSIVE g AS (SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst FROM nation UNION ALL SELECT n_nationkey, n_nationkey + 100 FROM nation),
p(path, nxt) AS (SELECT [src], dst FROM g UNION ALL SELECT list_append(path, nxt), dst FROM p JOIN g ON src = nxt WHERE nxt > path[1] AND dst >= path[1] AND (dst = path[1] OR NOT list_contains(list_append(path, nxt), dst)))
SELECT list_append(path, nxt) AS cycle, CAST(len(path) AS BIGINT) AS length FROM p WHERE nxt = path[1]""")
def cycle_of_25(spark, sf_dir):
    """One ring of all nations, each with an edge out of it."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"))
    return graph.cycles(n.withColumn("dst", (F.col("src") + 1) % 25).unionByName(n.withColumn("dst", F.col("src") + 100)))


#: Every node with every node it reaches.
_CLOSURE = f"g AS MATERIALIZED (SELECT DISTINCT src, dst FROM {_GRAPH} WHERE src % 3 = 0 OR dst % 7 = 0), r(a, b) AS (SELECT src, dst FROM g UNION SELECT a, dst FROM r JOIN g ON b = src)"


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_graph without most edges between nodes that neither 3 nor 7 divides, so that not all is one part."""
    return user_graph(spark, sf_dir).where("src % 3 = 0 OR dst % 7 = 0")


@query(f"SELECT node, count(*) AS n FROM (SELECT src AS node FROM {_GRAPH} UNION ALL SELECT dst FROM {_GRAPH}) GROUP BY node ORDER BY n DESC, node LIMIT 50")
def node_frequency_top50(spark, sf_dir):
    return graph.node_frequency(user_graph(spark, sf_dir))


@query(f"""WITH RECURSIVE {_CLOSURE}, c AS (SELECT DISTINCT a AS n FROM r WHERE a = b),
f AS (SELECT n FROM c UNION SELECT b FROM r JOIN c ON a = n), t AS (SELECT n FROM c UNION SELECT a FROM r JOIN c ON b = n)
SELECT src, dst FROM g WHERE src IN (SELECT n FROM f) AND dst IN (SELECT n FROM t)""")
def cycle_core(spark, sf_dir):
    return graph.cyclic_core(part_graph(spark, sf_dir))


@query(f"""WITH RECURSIVE {_CLOSURE}, m AS (SELECT x.a AS node, least(x.a, min(x.b)) AS part FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a)
SELECT src, dst, p.part FROM g JOIN m p ON src = p.node JOIN m q ON dst = q.node WHERE p.part = q.part""")
def strong_components(spark, sf_dir):
    return graph.strong_components(part_graph(spark, sf_dir))


@query(f"""WITH s AS (SELECT string_split(path, '/') AS p FROM {_FILES}), x AS (SELECT p, unnest(range(1, least(len(p), 3) + 1)) AS level FROM s)
SELECT DISTINCT array_to_string(p[1:level - 1], '/') AS parent, p[level] AS name, level, len(p) > level AS is_dir FROM x""")
def directory_tree(spark, sf_dir):
    return graph.file_tree(document_files(spark, sf_dir))


def _diagram_sql(edges: str, color: str, cyclic: bool) -> str:
    arrow, style = ("-->|cycle|", " || coalesce((SELECT string_agg(chr(10) || '    linkStyle ' || k || ' stroke:red', '' ORDER BY k) FROM l), '')") if cyclic else ("-->", "")
    return f"""WITH e AS {edges}, f AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) WHERE node IS NOT NULL GROUP BY node ORDER BY n DESC, node LIMIT 51),
k AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT * FROM f ORDER BY n DESC, node LIMIT 50)),
l AS (SELECT x, y, row_number() OVER (ORDER BY src, dst) - 1 AS k FROM (SELECT DISTINCT src, dst, a.i AS x, b.i AS y FROM e JOIN k a ON src = a.node JOIN k b ON dst = b.node WHERE src <> dst))
SELECT 'graph LR' || (SELECT string_agg(chr(10) || '    n' || i || '["' || regexp_extract(node, '[^/]*$') || '"]', '' ORDER BY i) FROM k)
 || coalesce((SELECT string_agg(chr(10) || '    n' || x || ' {arrow} n' || y, '' ORDER BY k) FROM l), ''){style}
 || (SELECT string_agg(chr(10) || '    style n' || i || ' fill:{color}', '' ORDER BY i) FROM k) AS diagram,
(SELECT count(*) FROM k) AS node_count, (SELECT count(*) FROM l) AS edge_count, (SELECT count(*) FROM f) > 50 AS truncated"""


def _diagram(spark: SparkSession, edges: DataFrame) -> DataFrame:
    found = graph.diagram(edges)
    return spark.createDataFrame([(found["diagram"], found["node_count"], found["edge_count"], found["truncated"])], "diagram string, node_count long, edge_count long, truncated boolean")


@query(_diagram_sql(f"(SELECT caller_file AS src, callee_file AS dst FROM {_EDGES})", "#cccccc", False))
def graph_diagram(spark, sf_dir):
    return _diagram(spark, line_edges(spark, sf_dir))


@query(_diagram_sql("(SELECT 'n/' || n_name || '.py' AS src, (SELECT 'n/' || m.n_name || '.py' FROM nation m WHERE m.n_nationkey = (n.n_nationkey + 1) % 25) AS dst FROM nation n)", "#3572A5", True))
def graph_diagram_cycle(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    file = lambda c: F.concat(F.lit("n/"), c, F.lit(".py"))
    after = n.select(((F.col("n_nationkey") + 24) % 25).alias("k"), file(F.col("n_name")).alias("callee_file"))
    return _diagram(spark, n.join(after, F.col("n_nationkey") == F.col("k")).select(file(F.col("n_name")).alias("caller_file"), "callee_file"))


# ---- statistics


@query(f"SELECT callee_file AS file, count(*) AS n FROM {_EDGES} GROUP BY 1 ORDER BY n DESC, file LIMIT 5")
def fan_in_top5(spark, sf_dir):
    return stats.fan_in(line_edges(spark, sf_dir))


@query(f"SELECT caller_file AS file, count(*) AS n FROM {_EDGES} GROUP BY 1 ORDER BY n DESC, file LIMIT 5")
def fan_out_top5(spark, sf_dir):
    return stats.fan_out(line_edges(spark, sf_dir))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = d.doc_id)")
def orphans(spark, sf_dir):
    """Labels stand for the files' symbols, conversations for the edges to them."""
    files = table(spark, sf_dir, "documents").select(F.lit("r").alias("repo"), F.col("doc_id").cast("string").alias("path"), "doc_id")
    symbols = table(spark, sf_dir, "labels").select(F.lit("r").alias("repo"), F.col("doc_id").cast("string").alias("file"))
    edges = table(spark, sf_dir, "conversations").select(F.lit("r").alias("repo"), F.col("conv_id").cast("string").alias("callee_file"))
    return stats.orphans(files, symbols, edges).select("doc_id")


@query(f"SELECT 'orders' AS repo, count(*) AS edge_count FROM {_EDGES} WHERE caller_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def edge_count(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("symbol_id"), F.lit("orders").alias("repo"))
    return stats.edge_count(line_edges(spark, sf_dir), s)


@query("""SELECT source AS repo, count(DISTINCT doc_id) AS file_count, coalesce(CAST(sum(n_chars) AS BIGINT), 0) AS lines_of_code, count(*) AS symbol_count, count(*) FILTER (lang = 'en') AS functions, count(*) FILTER (lang = 'fr') AS classes, count(*) FILTER (lang = 'de') AS methods, 0 AS constants, 0 AS variables, (SELECT count(*) FROM labels l JOIN documents o USING (doc_id) WHERE o.source = d.source) AS route_count FROM documents d GROUP BY source""")
def repo_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("source", "repo")
    kind = F.when(F.col("lang") == "en", "function").when(F.col("lang") == "fr", "class").when(F.col("lang") == "de", "method")
    return stats.repo_summary(d.select("repo", F.col("doc_id").alias("path"), F.col("n_chars").alias("line_count")), d.select("repo", kind.alias("kind")), table(spark, sf_dir, "labels").join(d, "doc_id").select("repo"))


@query("SELECT p_type AS kind, count(*) AS n FROM part GROUP BY 1")
def kind_counts(spark, sf_dir):
    return stats.kind_counts(part_symbols(spark, sf_dir))


@query("""SELECT CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'css' WHEN 3 THEN 'markdown' ELSE 'other' END AS language, count(*) AS n FROM documents GROUP BY 1""")
def language_distribution(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    suffix = F.element_at(F.array(*map(F.lit, [".py", ".go", ".SCSS", ".md", ".xyz"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return stats.language_distribution(d.select(F.concat(F.col("doc_id").cast("string"), suffix).alias("path")))


@query("""WITH f AS (SELECT event_type AS repo, user_id AS path, ts AS indexed_at FROM events WHERE event_id % 2 = 0), l AS (SELECT event_type AS repo, user_id AS path, max(ts) AS mtime FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2),
s AS (SELECT repo, count(DISTINCT path) AS file_count, max(indexed_at) AS last_indexed FROM f GROUP BY repo),
n AS (SELECT f.repo, max(mtime) AS newest, bool_or(mtime IS NULL) AS gone FROM (SELECT DISTINCT repo, path FROM f) f LEFT JOIN l USING (repo, path) GROUP BY f.repo)
SELECT repo, file_count, last_indexed, CAST(epoch(TIMESTAMP '2030-01-01 00:00:00') - floor(epoch(last_indexed)) AS DOUBLE) AS age_seconds, coalesce(gone OR newest > last_indexed, false) AS stale FROM s JOIN n USING (repo)""")
def index_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("repo"), F.col("user_id").alias("path"), F.col("ts"), "event_id")
    files = e.where("event_id % 2 = 0").withColumnRenamed("ts", "indexed_at")
    listing = e.where("event_id % 2 = 1").groupBy("repo", "path").agg(F.max("ts").alias("mtime"))
    return stats.index_status(files, listing, F.lit("2030-01-01 00:00:00").cast("timestamp"))


_ENDS = "(ends_with(x.s, repeat(chr(34), 3)) OR ends_with(x.s, repeat(chr(39), 3)))"
_STARTS = "(starts_with(x.s, '/*') OR starts_with(x.s, '<!--') OR starts_with(x.s, repeat(chr(34), 3)) OR starts_with(x.s, repeat(chr(39), 3)))"
_LOC = rf"""list_reduce(list_prepend({{'n': 0, 'b': false, 's': ''}}, list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]'), lambda x: {{'n': 0, 'b': false, 's': trim(x)}})), lambda a, x: CASE
WHEN x.s = '' THEN a WHEN a.b THEN {{'n': a.n, 'b': NOT (contains(x.s, '*/') OR {_ENDS}), 's': ''}}
WHEN starts_with(x.s, '#') OR starts_with(x.s, '//') OR starts_with(x.s, '--') THEN a
WHEN {_STARTS} THEN {{'n': a.n, 'b': NOT (ends_with(x.s, '*/') OR ends_with(x.s, '-->') OR {_ENDS}), 's': ''}}
ELSE {{'n': a.n + 1, 'b': false, 's': ''}} END).n"""


@query(f"SELECT doc_id, CAST({_LOC} AS BIGINT) AS line_count FROM documents")
def lines_of_code(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.lines_of_code(F.col("text")).alias("line_count"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.token_estimate(F.col("text")).alias("tokens"))


@query(f"""WITH l AS (SELECT doc_id, unnest({_LINES}) AS text, unnest(range(1, len({_LINES}) + 1)) AS line FROM {_FILES}),
h AS (SELECT doc_id, rtrim(text) AS text FROM (SELECT * FROM l WHERE contains(lower(text), 'licensed') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line) <= 5)),
r AS (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM h)), a AS (SELECT count(*) AS files_searched, CAST(sum({_LOC}) AS BIGINT) AS lines_searched, CAST(ceil((sum(length(text)) + count(*) - 1) / 4) AS BIGINT) AS tokens_without FROM r),
b AS (SELECT CAST(ceil((sum(length(text)) + count(*) - 1) / 4) AS BIGINT) AS tokens_with FROM h)
SELECT *, greatest(0, tokens_without - tokens_with) AS tokens_saved, true AS approximate FROM a, b""")
def search_roi(spark, sf_dir):
    """What the lines with a word take, against reading their files."""
    files = document_files(spark, sf_dir)
    found = search.hits_by_file(files, "licensed").select("repo", F.col("path").alias("file"), F.explode("hits").alias("h")).select("repo", "file", "h.text")
    return stats.search_savings(found, files)


_WEBPATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(f"""SELECT page_id, CASE WHEN contains(lower({_WEBPATH}), '/tests/') THEN 'test' WHEN regexp_matches(lower({_WEBPATH}), '[^/]\\.(md|markdown|mdx|rst)$') THEN 'doc' ELSE 'text' END AS path_kind,
list_has_any(string_split(lower({_WEBPATH}), '/'), ['dist', 'build', 'coverage', 'node_modules', 'vendor', '.next', '__pycache__']) AS is_generated,
CASE WHEN regexp_matches(lower({_WEBPATH}), '[^/]\\.html?$') THEN 'html' ELSE 'unknown' END AS language_surface, CAST(0.7 AS DOUBLE) AS confidence FROM pages""")
def path_quality(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    q = fn.quality("text", F.col("path"))
    return p.withColumn("q", q).select("page_id", fn.path_kind(F.col("path")).alias("path_kind"), "q.is_generated", "q.language_surface", "q.confidence")


# ---- maintenance


@query("SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def content_hash_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("SELECT source AS repo, sha256(text) AS hash FROM documents d WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 2 = 0 AND o.source = d.source AND sha256(o.text) = sha256(d.text))")
def incremental_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.lit("p").alias("path"), F.sha2("text", 256).alias("hash"), "doc_id")
    return upsert.changed_files(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0")).select("repo", "hash")


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1")
def last_wins_upsert(spark, sf_dir):
    return upsert.last_wins(table(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn"])


@query("""SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 6 <> 0 UNION ALL SELECT doc_id, source, n_chars + 1 FROM documents WHERE doc_id % 6 = 0""")
def snapshot_replace(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.lit("r").alias("repo"), F.col("doc_id").alias("path"))
    new = d.where("doc_id % 6 = 0").withColumn("n_chars", F.col("n_chars") + 1)
    return upsert.replace_rows(d, new, new.select("repo", "path"), "path").select("doc_id", "source", "n_chars")


# ---- the pack


@query("""WITH c AS (SELECT doc_id AS n, CAST(ceil(length(text) / 4) AS BIGINT) AS t FROM documents),
f AS (SELECT list_reduce(list_prepend({'u': CAST(0 AS BIGINT), 'k': [CAST(-1 AS BIGINT)], 'n': CAST(0 AS BIGINT), 't': CAST(0 AS BIGINT)}, list({'u': CAST(0 AS BIGINT), 'k': [CAST(-1 AS BIGINT)], 'n': n, 't': t} ORDER BY n)),
 lambda a, x: CASE WHEN a.u + x.t <= 900 THEN {'u': a.u + x.t, 'k': list_append(a.k, x.n), 'n': CAST(0 AS BIGINT), 't': CAST(0 AS BIGINT)}
  WHEN len(a.k) = 1 THEN {'u': a.u + 5, 'k': list_append(a.k, x.n), 'n': CAST(0 AS BIGINT), 't': CAST(0 AS BIGINT)} ELSE a END).k AS k FROM c)
SELECT n, t AS tokens, list_contains(k, n) AS kept FROM c, f""")
def context_pack_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), fn.token_estimate(F.col("text")).alias("tokens"), F.lit(5).cast("long").alias("outline_tokens"))
    return pack.choose(d, 900).select("n", "tokens", (F.col("state") != "omitted").alias("kept"))


def corpus_index(spark: SparkSession, sf_dir: str) -> pack.Index:
    """Documents as files with their first word as a symbol that calls their second; pages as routes. A symbol's span is the first line, 40 characters at most.

    The texts are read once for both: symbols and calls are stored, as they are in an index.
    """
    files = document_files(spark, sf_dir)
    # matching ends at the word, not at the end of the text; a text without it is passed once
    word = lambda pattern, i: F.nullif(F.regexp_extract("content", pattern, i), F.lit(""))
    first, second = word(r"\p{L}++", 0), word(r"^[^\p{L}]*+\p{L}++[^\p{L}]++(\p{L}++)", 1)
    head = F.octet_length(F.substring(F.substring_index("content", "\n", 1), 1, 40)).cast("long")
    found = cut(files.select(F.col("doc_id").alias("symbol_id"), "repo", F.col("path").alias("file"), first.alias("name"), second.alias("callee_name"), head.alias("end_byte")))
    symbols = found.select("symbol_id", "repo", "file", "name", F.lit("function").alias("kind"), F.lit(0).cast("long").alias("start_byte"), "end_byte")
    calls = found.select("symbol_id", "repo", "file", F.col("name").alias("caller_name"), "callee_name")
    return pack.Index(files, symbols, graph.resolve_calls(calls, symbols), page_routes(spark, sf_dir))


_TERMS = "(VALUES (0, 'licensed'), (1, 'on'))"
_CUT = "CASE WHEN strlen(content) <= 3000 THEN content ELSE coalesce(TRY(decode(encode(content)[1:3000])), TRY(decode(encode(content)[1:2999]) || chr(65533)), decode(encode(content)[1:2998]) || chr(65533)) END"


@query(rf"""WITH t(ord, term) AS {_TERMS}, fi AS (SELECT * FROM {_FILES}), w AS (SELECT *, regexp_extract_all(content, '\p{{L}}+') AS w FROM fi),
sy AS (SELECT doc_id AS symbol_id, repo, path AS file, w[1] AS name, 0 AS s, strlen(substr(split_part(content, chr(10), 1), 1, 40)) AS e, substr(split_part(content, chr(10), 1), 1, 40) AS head FROM w),
de AS (SELECT name, min(file) AS callee_file FROM sy GROUP BY name),
ed AS (SELECT DISTINCT doc_id AS caller_id, w[1] AS caller_name, w[2] AS callee_name, callee_file FROM w LEFT JOIN de ON de.name = w[2]),
sr AS (SELECT ord, sy.*, CASE WHEN name ILIKE term || '%' THEN 0 WHEN name ILIKE '%' || term || '%' THEN 1 END AS k FROM sy, t),
st AS (SELECT * FROM sr WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ord ORDER BY k, repo, file, s, name, symbol_id) <= 8),
sh AS (SELECT * FROM st QUALIFY k = min(k) OVER (PARTITION BY ord)),
li AS (SELECT repo, path AS file, unnest({_LINES}) AS text, unnest(range(1, len({_LINES}) + 1)) AS line FROM fi),
th AS (SELECT ord, repo, file, line, rtrim(text) AS text FROM li, t WHERE contains(lower(text), term) QUALIFY row_number() OVER (PARTITION BY ord, file ORDER BY line) <= 5),
tn AS (SELECT ord, file, coalesce(sum(n) OVER (PARTITION BY ord ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT ord, file, count(*) AS n FROM th GROUP BY ord, file)),
tk AS (SELECT th.* FROM th JOIN tn USING (ord, file) WHERE b < 100),
ro AS (SELECT ord, r.* FROM {_ROUTES} r, t WHERE path ILIKE '%' || term || '%' QUALIFY row_number() OVER (PARTITION BY ord ORDER BY file, start_byte, method, path, handler) <= 20),
nm AS (SELECT name FROM sh GROUP BY name ORDER BY min((ord, file, s)), name LIMIT 5),
ne AS (SELECT DISTINCT sy.repo, sy.file, sy.s, sy.e, 'caller of ' || callee_name AS title, sy.name AS key, sy.head AS src FROM ed JOIN nm ON callee_name = nm.name JOIN sy ON symbol_id = caller_id
  UNION SELECT 'corpus', callee_file, 0, 0, 'callee of ' || caller_name, callee_name, {_CUT} FROM ed JOIN nm ON caller_name = nm.name JOIN fi ON path = callee_file),
ca AS (SELECT 'symbol' AS type, 100.0::DOUBLE AS rank, repo, file, s, e, NULL::BIGINT AS line, name AS title, name AS key, head AS src, ord FROM sh
  UNION ALL SELECT CASE WHEN starts_with(file, 'docs/') THEN 'doc' ELSE 'text' END, CASE WHEN starts_with(file, 'docs/') THEN 60.0 ELSE 90.0 END, repo, file, NULL, NULL, line, file, substr(text, 1, 24), text, ord FROM tk
  UNION ALL SELECT 'route', 85.0, repo, file, start_byte, end_byte, NULL, method || ' ' || path, path, '', ord FROM ro
  UNION ALL SELECT 'graph_neighbor', 65.0, repo, file, s, e, NULL, title, key, src, 0 FROM ne),
ii AS (SELECT *, type || ':' || file || ':' || coalesce(CAST(s AS VARCHAR), CAST(line AS VARCHAR), '') || ':' || coalesce(CAST(e AS VARCHAR), '') || ':' || key AS id, CAST(ceil(length(src) / 4) AS BIGINT) AS tok, type || ' ' || title || ' in ' || file AS outline FROM ca),
dd AS (SELECT * FROM ii QUALIFY row_number() OVER (PARTITION BY repo, id ORDER BY rank DESC, ord, title) = 1),
nn AS (SELECT *, row_number() OVER (ORDER BY rank DESC, file, coalesce(s, 0), coalesce(line, 0), title, repo, id) AS n, CAST(ceil(length(outline) / 4) AS BIGINT) AS ot FROM dd),
fo AS (SELECT list_reduce(list_prepend({{'u': 0::BIGINT, 'k': [-1::BIGINT], 'o': -1::BIGINT, 'n': 0::BIGINT, 't': 0::BIGINT, 'ot': 0::BIGINT}}, list({{'u': 0::BIGINT, 'k': [-1::BIGINT], 'o': -1::BIGINT, 'n': n, 't': tok, 'ot': ot}} ORDER BY n)),
  lambda a, x: CASE WHEN a.u + x.t <= 1800 THEN {{'u': a.u + x.t, 'k': list_append(a.k, x.n), 'o': a.o, 'n': 0::BIGINT, 't': 0::BIGINT, 'ot': 0::BIGINT}}
   WHEN len(a.k) = 1 THEN {{'u': a.u + least(x.ot, 1800), 'k': list_append(a.k, x.n), 'o': x.n, 'n': 0::BIGINT, 't': 0::BIGINT, 'ot': 0::BIGINT}} ELSE a END) AS f FROM nn)
SELECT n, type, id, repo, file, title, rank AS rank_score, tok AS estimated_tokens, CASE WHEN n = f.o THEN least(ot, 1800) WHEN list_contains(f.k, n) THEN tok ELSE 0 END AS used_tokens,
CASE WHEN n = f.o THEN 'outlined' WHEN list_contains(f.k, n) THEN 'selected' ELSE 'omitted' END AS state,
CASE WHEN list_contains(f.k, n) THEN CASE type WHEN 'symbol' THEN 'symbols' WHEN 'route' THEN 'routes' WHEN 'graph_neighbor' THEN 'graph_neighbors' WHEN 'doc' THEN 'docs' END END AS bucket,
CASE WHEN n = f.o THEN outline ELSE src END AS source FROM nn, fo""")
def context_pack(spark, sf_dir):
    return pack.context_pack(corpus_index(spark, sf_dir), "licensed on", token_budget=2000).drop("quality")


from srcatlas.plans import extraction  # noqa: E402, F401  registers its queries here
