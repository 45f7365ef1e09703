"""The corpus operators' queries with production parameters, and SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.llm import chat, decontaminate, langid, licenses, mixing, pii, simhash, toxicity, urlfilter, vptree
from srcatlas.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and grade of every document.

    Grades 1 to 3 part the documents that are labelled toxic.
    """
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    grades = labels.select("doc_id", F.col("toxic").alias("grade"))
    return toxicity.rate(docs, toxicity.train(docs, grades)).select("doc_id", "toxicity.*")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, as a file source/language/last digit of the id/id.txt."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    path = F.concat_ws("/", part("source"), part("lang"), F.coalesce(F.pmod(F.col("doc_id"), F.lit(10)).cast("string"), F.lit("_")), F.concat(part("doc_id"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    return licenses.resolve(files).select("doc_id", "path", F.col("own.license").alias("own_license"), F.round("own.cosine", 9).alias("cosine"), "license", "license_from")


#: Action, host and path, as the contract of op4 fixes them.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and benchmark items of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("match.n_words").alias("n_words"),
        decontaminate.hit_words(F.col("match")).alias("n_hit"),
        F.size("match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("match.items", ","), 256).alias("items_sha256"),
        (F.size("match.items") >= 2).alias("contaminated"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document; languages keep their shares as far as the sources' targets allow."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs, cell="lang").select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the strict patterns, and all spans."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    counts = map(count, pii.KINDS)
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(langid.in_training()).select("text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    listed = F.array_join(F.transform("language.languages", lambda x: F.concat_ws(":", x["lang"], F.round(x["share"], 3).cast("string"))), ",")
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), listed.alias("languages"))


def op9_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors for every fiftieth."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vptree.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    done = chat.format_chats(rows.unionByName(extra))
    turns, masked = chat.parse(F.col("formatted")), F.array_join(chat.under_mask(F.col("formatted"), F.col("mask")), "")
    read = done.select("conv_id", "formatted", turns.alias("turns"), masked.alias("masked"), "identical")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_licenses": op3_licenses,
    "op4_urlfilter": op4_urlfilter,
    "op5_decontaminate": op5_decontaminate,
    "op6_mixing": op6_mixing,
    "op7_pii": op7_pii,
    "op8_langid": op8_langid,
    "op9_vptree": op9_vptree,
    "op10_chat": op10_chat,
}

_WORDS5 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    # escaped is any conversation in which a text holds a control string: its texts grow by a backslash each
    "op10_chat": """
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (SELECT *, len(regexp_extract_all(text, '\\\\|\\[/?INST\\]|<</?SYS>>|<<ROLE|<</ROLE>>|</?s>|<s esc>')) AS marks, text SIMILAR TO '(?s).*(\\[/?INST\\]|<</?SYS>>|<<ROLE|<</ROLE>>|</s>).*' AS odd FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(CASE WHEN bool_or(odd) THEN 7 + sum(length(text) + marks) ELSE 3 + sum(length(text)) END
    + sum(CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 19 WHEN 'assistant' THEN 5 ELSE 19 + length(role) END) AS BIGINT) AS formatted_chars,
  true AS identical
FROM marked GROUP BY conv_id
""",
    "op5_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS5} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS5} AS w FROM benchmark),
iw AS (SELECT item, w, least(8, len(w)) AS m, unnest(range(len(w) - least(8, len(w)) + 1)) AS p FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[p + 1 : p + m], ' ') AS s FROM iw),
dw AS (SELECT r, m, w, unnest(range(len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
hit AS (SELECT r, p, win.m, item FROM (SELECT r, p, m, array_to_string(w[p + 1 : p + m], ' ') AS s FROM dw) x JOIN win USING (m, s)),
ha AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN ha USING (r) LEFT JOIN its USING (r)
""",
}
