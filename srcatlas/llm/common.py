"""What several corpus operators share: checkpoints, name-safe columns, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.lineage import cut, shared_folder  # noqa: F401

#: What separates words in operators that keep punctuation: space, and tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column):
    """A-Z to a-z, and nothing else."""
    return F.translate(column, UPPER, LOWER)


#: A side of a join is broadcast up to so many rows of a few numbers each, which are counted first; more are shuffled.
BROADCAST_ROWS = 1_000_000


#: So many narrow rows go to one partition of a stored frame.
ROWS_A_PART = 50_000


#: So many shuffled partitions at most go to one partition: each holds some memory of its task to its end.
MERGED = 16


def parts_for(spark: SparkSession, rows: int, per: int = ROWS_A_PART) -> int:
    return max(1, -(-rows // per), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // MERGED))


def cut_to(df: DataFrame, rows: int, per: int = ROWS_A_PART) -> DataFrame:
    """cut, in about as many partitions as up to ``rows`` narrow rows take.

    In loops over small frames the files of empty partitions, and of the shuffles that
    read them, would take more time and disk than the rows. Not for plans that sort.
    """
    return cut(df.coalesce(parts_for(df.sparkSession, rows, per)))


def few(df: DataFrame) -> DataFrame:
    """``df``, stored, and to be broadcast if it has at most BROADCAST_ROWS rows; only for narrow rows."""
    stored = cut(df)
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has two columns of one ordered type. Returns (node, label): label is the
    smallest node reachable, for every node that has an edge to another. Each round takes
    the least neighbour of every node, by an aggregation that adds up before it shuffles,
    and joins the edges with these stored minima: both sides are plain shuffles, so the
    edges of a hub can be split among tasks. Nothing but one row of counts comes to the
    driver. ``rows`` may say how many edges there are at most. The rounds needed grow with the logarithm of the longest path; running out
    of ``most_rounds`` raises.
    """

    def sketch(e: DataFrame):
        row = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        return row["n"], int(row["h"])

    # u is the larger end, v the smaller
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = cut(now) if rows is None else cut_to(now, rows)
    before = sketch(now)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        most = 2 * before[0]
        both = now.union(now.select("v", "u")).toDF("x", "y").coalesce(parts_for(edges.sparkSession, most))
        least = cut_to(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), most)
        large = cut_to(both.where("y > x").join(least, "x").where("y != m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), most)
        least = cut_to(large.groupBy("u").agg(F.min("v").alias("m")), most)
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        now = cut_to(small, most)
        after = sketch(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def named_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a column __row of 128 bits that name a row by its content."""
    content = [*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"`{c}`").isNull() for c in docs.columns]]
    return docs.withColumn("__row", F.struct(F.xxhash64(*content).alias("a"), F.xxhash64(F.lit(1), *content).alias("b")))


def first_of_each(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The first row of each label by doc_id (null last), then content; of rows that are equal throughout, one.

    ``docs`` has the __row of named_rows, and ``labelled`` has (__row, doc_id, label) for
    each of its rows. Only ids are shuffled, as long as those of the rows that go are few
    enough to be broadcast, which is counted.
    """
    key = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__row")
    copies = cut(labelled.groupBy("label", "__row").agg(F.min(key).alias("k"), F.count("*").alias("n")))
    firsts = cut(copies.groupBy("label").agg(F.min("k").alias("k")))
    marked = cut(copies.join(firsts.select("label", F.col("k.__row").alias("first")), "label").select("__row", (F.col("__row") == F.col("first")).alias("kept"), "n"))
    going = few(marked.where("NOT kept OR n > 1").select("__row"))
    one = docs.join(going, "__row", "left_anti")
    several = docs.join(few(marked.where("kept AND n > 1").select("__row")), "__row", "left_semi").dropDuplicates(["__row"])
    return one.unionByName(several).drop("__row")
