"""URL filtering: host and path rules, and the ratio of two character language models. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from srcatlas.llm.common import LOWER, UPPER, ascii_lower, cut, few

#: What characters the models tell apart: letters, any digit (0), these marks, any other (*); and ^ before, $ behind.
MARKS = "-._/?=&#%~+:@"
SYMBOLS = len(LOWER) + len(MARKS) + 4
#: Scores are sums of whole millionths of a nat, so their order doesn't matter.
UNIT = 1_000_000


def rest(url: Column) -> Column:
    """What follows the first ://, or empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null and where there is no ://."""
    r = F.coalesce(rest(url), F.lit(""))
    return ascii_lower(F.regexp_extract(r, r"^[^/?#]*", 0)), F.regexp_extract(r, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of the (action, host, path) rules that fits, as 'hostpath', and its action; null if none does.

    Rules are a configuration, compiled into one expression.
    """
    name = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def symbols(url: Column, order: int) -> Column:
    """The url's text behind :// in the models' alphabet, padded."""
    plain = F.translate(F.coalesce(rest(url), F.lit("")), UPPER + "123456789", LOWER + "0" * 9)
    plain = F.regexp_replace(plain, "(?s)[^a-z0" + "".join("\\" + c for c in MARKS) + "]", "*")
    return F.concat(F.lit("^" * order), plain, F.lit("$"))


def _grams(df: DataFrame, order: int) -> DataFrame:
    """A row for each symbol with its ``order`` predecessors."""
    text = F.col("__symbols")
    return df.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.length(text) - order), lambda i: F.substr(text, i, F.lit(order + 1)))))


@dataclass
class Model:
    """grams: (gram, ratio) for every gram of the pages; threshold in nats a symbol."""

    grams: DataFrame
    threshold: float
    order: int


def train(pages: DataFrame, url: str = "url", label: str = "label", order: int = 3, least: int = 2, folds: int = 5) -> Model:
    """Two models from ``pages``, where ``label`` is allow, block or null, and a calibrated threshold.

    A model's probability of a symbol interpolates the orders 0 to ``order`` by
    Witten-Bell: a context's own share grows with its count and falls with the number of
    different followers. Contexts seen fewer than ``least`` times are passed over for the
    shorter one, so the order varies with the evidence. One fold of the labelled urls, by
    the hash of the url, is left out of the counts, and the threshold is the score that
    splits that fold best (largest mean of both classes' shares of right verdicts, the
    lowest of equals, halfway down to the next score below). Without labelled urls on both sides the threshold is 0.

    There are at most ``SYMBOLS`` ** (order + 1) different grams, so the tables of the
    models are bounded whatever the number of pages: 3.7 million rows for order 3.
    """
    marked = pages.select(F.col(url).alias("url"), F.col(label).alias("label"), symbols(F.col(url), order).alias("__symbols"))
    held = F.pmod(F.xxhash64("url"), F.lit(folds)) == 0
    fit = lambda act: F.sum(F.when((F.col("label") == act) & ~held, 1).otherwise(0))
    counts = cut(_grams(marked, order).groupBy("gram").agg(fit("allow").alias("a"), fit("block").alias("b")))
    scored = counts.withColumn("pa", F.lit(1 / SYMBOLS)).withColumn("pb", F.lit(1 / SYMBOLS))
    for k in range(order + 1):
        key, context = F.substring("gram", order + 1 - k, k + 1), F.substring("key", 1, k)
        own = counts.groupBy(key.alias("key")).agg(F.sum("a").alias("na"), F.sum("b").alias("nb")).withColumn("context", context)
        around = own.groupBy("context").agg(F.sum("na").alias("ca"), F.sum("nb").alias("cb"), F.count_if(F.col("na") > 0).alias("ta"), F.count_if(F.col("nb") > 0).alias("tb"))
        own = own.join(around, "context").drop("context")
        mix = lambda p, n, c, t: F.when(F.col(c) >= least, (F.col(n) + F.col(t) * F.col(p)) / (F.col(c) + F.col(t))).otherwise(F.col(p))
        scored = scored.withColumn("key", key).join(own, "key").withColumn("pa", mix("pa", "na", "ca", "ta")).withColumn("pb", mix("pb", "nb", "cb", "tb")).select("gram", "pa", "pb")
    ratio = F.round((F.log("pa") - F.log("pb")) * UNIT).cast("long")
    grams = cut(scored.select("gram", ratio.alias("ratio")))
    tried = score(marked.where(F.col("label").isNotNull() & held).select("url", "label"), Model(grams, 0.0, order), "url")
    bins = tried.groupBy(F.round("score", 2).alias("bin")).agg(F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("b"))
    upto = Window.orderBy("bin")  # at most a few thousand bins: a symbol's ratio is bounded by the smoothing
    swept = bins.select("bin", F.lag("bin").over(upto).alias("below"), (F.sum("a").over(upto) - F.col("a")).alias("missed"), (F.sum("b").over(upto) - F.col("b")).alias("caught"), F.sum("a").over(Window.partitionBy()).alias("all_a"), F.sum("b").over(Window.partitionBy()).alias("all_b"))
    best = swept.where("all_a > 0 and all_b > 0").withColumn("gain", F.round(F.expr("(all_a - missed) / all_a + caught / all_b"), 9)).orderBy(F.desc("gain"), "bin").first()
    return Model(grams, 0.0 if best is None else best["bin"] - 0.005 if best["below"] is None else (best["bin"] + best["below"]) / 2, order)


def score(pages: DataFrame, model: Model, url: str = "url", name: str = "score") -> DataFrame:
    """``pages`` with the log-likelihood difference of both models for each symbol of the url, in nats.

    Distinct texts alone are scored: their grams find their ratios by a join with the
    table of all grams, and sums by text are added up before anything moves. Rows then
    join their text's score, whatever other columns they have; a text of very many rows
    can be split there, as both sides are plain shuffles.
    """
    key = "__url_symbols"
    marked = pages.withColumn(key, symbols(F.col(url), model.order))
    texts = marked.select(F.col(key).alias("__symbols")).distinct()
    found = _grams(texts, model.order).join(few(model.grams), "gram", "left")
    mean = F.sum(F.coalesce("ratio", F.lit(0))) / F.count("*") / UNIT
    scores = cut(found.groupBy("__symbols").agg(mean.alias("__url_score")))
    return marked.join(scores.withColumnRenamed("__symbols", key), key).withColumn(name, F.col("__url_score")).drop(key, "__url_score")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", **options) -> DataFrame:
    """``pages``' columns with host, path, rule, score and verdict.

    A rule's action is the verdict where one fits; rule-labelled urls train the two
    models, whose length-normalised ratio against the threshold decides all others.
    Null urls and those without :// have empty host and path, and are judged by the
    method as the empty text. Columns of the results' names are replaced, others pass through
    (names that begin with __url_ are taken). Every row gets a verdict; repeated rows stay.
    """
    pages = pages.drop("host", "path", "rule", "score", "verdict")
    host, path = host_path(F.col(url))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    marked = pages.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("__url_action", action)
    model = train(marked.select(F.col(url).alias("url"), F.col("__url_action").alias("label")), **options)
    judged = score(marked, model, url)
    learned = F.when(F.col("score") >= model.threshold, "allow").otherwise("block")
    return judged.withColumn("verdict", F.coalesce("__url_action", learned)).drop("__url_action")
