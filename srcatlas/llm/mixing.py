"""Mixing sources to target weights by entropy balancing. DataFrame functions only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from srcatlas.llm.common import WORD_PATTERN, cut

#: So many rows at most are numbered together, on average.
NUMBERED = 20_000
#: Margins beside the sources are met to this part of theirs, in so many rounds.
TOLERANCE, ROUNDS = 1e-3, 25


def word_count(text: Column) -> Column:
    """Runs of what is neither a space nor \\t to \\r; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place, from 1, in a total order: ranges of it are numbered side by side."""
    parts = max(1, ceil(rows.count() / NUMBERED))
    ranged = cut(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    # one row a range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__own", own).join(F.broadcast(offsets), "__range").withColumn(name, F.col("__before") + F.col("__own")).drop("__range", "__own", "__before")


def targets(sources: DataFrame, weights: list[int], most: float) -> DataFrame:
    """(__null, __source, source_size) with each source's weight and target.

    Sources take the ``weights`` in turn, by code point, null last, and share the sum of
    all sizes by weight. No target exceeds ``most`` times its source's size; the excess
    is shared again by weight among the others, until none is above. Each round is one
    aggregation over the sources, which gives the level that those below their limit
    share; there are as many rounds as the level rises, and few as sources differ by
    much. No task has all sources.
    """
    place = F.pmod(F.col("__place") - 1, F.lit(len(weights))).cast("int") + 1
    listed = F.array(*map(F.lit, weights))
    weighed = numbered(sources, ["__null", "__source"], "__place").withColumn("weight", F.element_at(listed, place).cast("double"))
    weighed = cut(weighed.drop("__place").withColumn("limit", F.col("source_size") * F.lit(float(most))))
    total = float(weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level = 0.0
    while True:
        above = F.col("limit") < F.col("weight") * level
        row = weighed.agg(F.sum(F.when(above, F.col("limit")).otherwise(0.0)).alias("held"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        new = (total - (row["held"] or 0.0)) / row["free"] if row["free"] else level
        if new <= level:
            break
        level = new
    target = F.least("limit", F.lit(level) * F.col("weight"))
    return weighed.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0)).select("__null", "__source", "source_size", "weight", "target")


def balance(cells: DataFrame, margins: list[tuple[list[str], str]], mass: str, most: float, tolerance: float = 1e-9, most_rounds: int = 80, start: str | None = None) -> DataFrame:
    """``cells`` with the rate that meets the margins' targets at the least relative entropy.

    Each margin has key columns and a target column (the same value in all cells of a
    key). The least of sum mass x (rate log rate - rate), over rates of at most ``most``
    and subject to sum mass x rate = target for every key, is dual to an unconstrained
    convex problem with a multiplier for each key; its rates are exponentially tilted:
    the product of the multipliers' exponentials, cut at ``most``. Newton's steps on the
    dual take one margin in turn: a margin's keys part the cells, so the Hessian is
    diagonal, and gradient and Hessian are sums over cells, made by one aggregation on
    the executors. Only the largest step comes to the driver. Steps are cut at 1, which
    keeps them from overshooting. Ends when the steps are within ``tolerance`` or, where
    targets can't all be met, when they don't shrink any more, or after ``most_rounds``.
    ``start`` names a column of logarithms to begin with; the column __log has the last.
    """
    now = cut(cells.withColumn("__log", F.lit(0.0) if start is None else F.col(start)))
    least, stalled = 1.0, 0
    for _ in range(most_rounds):
        worst = 0.0
        for keys, target in margins:
            rate = F.least(F.lit(float(most)), F.exp("__log"))
            free = F.when(F.exp("__log") < most, F.col(mass) * rate).otherwise(0.0)
            sums = now.groupBy(*keys).agg(F.sum(F.col(mass) * rate).alias("__got"), F.sum(free).alias("__free"), F.max(target).alias("__want"))
            gap = F.col("__want") - F.col("__got")
            # what is at its most can't be raised, but lowered
            step = F.when(F.col("__want") <= 0, 0.0).when((gap > 0) & (F.col("__free") > 0), F.least(F.lit(1.0), gap / F.col("__free"))).when((gap < 0) & (F.col("__got") > 0), F.greatest(F.lit(-1.0), gap / F.col("__got"))).otherwise(0.0)
            same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
            joined = now.alias("c").join(sums.withColumn("__step", step).alias("s"), same)
            now = cut(joined.select("c.*", "s.__step").withColumn("__log", F.col("__log") + F.col("__step")))
            moved = now.agg(F.max(F.abs("__step")).alias("m")).first()["m"]
            now = now.drop("__step")
            worst = max(worst, moved or 0.0)
        stalled = 0 if worst < 0.98 * least or worst >= 1.0 else stalled + 1
        least = min(least, worst)
        if worst <= tolerance or stalled == 4:
            break
    rate = F.least(F.lit(float(most)), F.exp("__log"))
    for _, target in margins:
        rate = F.when(F.col(target) > 0, rate).otherwise(F.lit(0.0))
    return now.withColumn("rate", rate)


def copies_by_size(sizes: DataFrame, most: int) -> DataFrame:
    """Whole copies for each (source, cell, size): ``sizes`` has n documents of a size, and their rate.

    From large to small, sums of n x rate are rounded in each cell, so that no size is off
    by a copy and a cell's tokens are off by less than its largest document. Then a
    source's smallest
    documents, in ascending order, take back or add what is left, within 0 and ``most``
    copies each, the last of them to the nearest. That is done again with the little
    that remains, for which smaller documents have room.
    """
    source = ["__null", "__source"]
    down = Window.partitionBy(*source, "__cell").orderBy(F.desc("size"))
    up = Window.partitionBy(*source).orderBy("size", "__cell").rowsBetween(Window.unboundedPreceding, -1)
    # a sum that is whole but for the last bits counts as whole
    whole = lambda c: F.floor(c + 0.5 + 1e-9)
    now = sizes.withColumn("__upto", F.sum(F.col("n") * F.col("rate")).over(down))
    first = whole(F.col("__upto")) - whole(F.coalesce(F.lag("__upto").over(down), F.lit(0.0)))
    now = now.withColumn("k", F.least(F.greatest(first, F.lit(0)), F.col("n") * most).cast("long"))
    for _ in range(3):
        now = now.withColumn("__over", F.round(F.sum(F.col("k") * F.col("size")).over(Window.partitionBy(*source)) - F.col("target")).cast("long"))
        now = now.withColumn("__room", F.when(F.col("size") == 0, 0).when(F.col("__over") > 0, F.col("k")).otherwise(F.col("n") * most - F.col("k")))
        left = F.abs("__over") - F.coalesce(F.sum(F.col("__room") * F.col("size")).over(up), F.lit(0))
        move = F.when(F.col("size") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.col("__room"), F.round(left / F.col("size"))))).cast("long")
        now = now.withColumn("k", F.col("k") - F.signum("__over").cast("long") * move)
    return now.select(*source, "__cell", "size", "n", "k", "source_size", "target", "rate")


def rates_of(cells: DataFrame, most: float) -> DataFrame:
    """``cells`` (__null, __source, __cell, mass, source_size, target) with the rate of each.

    Sources have their targets. A cell keeps the share of all mass that it has, as far as
    the sources' targets and ``most`` allow: where the weights ask for more of a source
    that is all of one cell, the others' documents of the other cells are tilted up. The
    sources' margin is balanced last, on its own, so that it is met in any case.
    """
    shares = cells.groupBy("__cell").agg(F.sum("mass").alias("__share"))
    sums = cells.groupBy("__null", "__source").agg(F.max("target").alias("t")).agg(F.sum("t").alias("t")).first()["t"] or 0.0
    total = float(cells.agg(F.coalesce(F.sum("mass"), F.lit(0))).first()[0])
    wanted = cells.join(shares, "__cell").withColumn("__share", F.col("__share") * F.lit(sums / total if total else 0.0))
    by_source = (["__null", "__source"], "target")
    both = balance(wanted, [(["__cell"], "__share"), by_source], "mass", most, TOLERANCE, ROUNDS)
    return balance(both.drop("rate"), [by_source], "mass", most, start="__log").drop("__share", "__log")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cell: str | None = None, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies and taken (copies x size).

    Sizes are words. Documents of one source and one ``cell`` (a language, say; one cell
    if none is named) share a rate, as every word counts alike, so the dual has one row
    for each pair of these (see rates_of). Rates become whole copies by size
    (see copies_by_size), and a size's copies are dealt to its documents in order of
    doc_id: sizes and sources of which one has most rows are dealt in parts by the
    doc_id's hash, so no task numbers them all. Reruns agree, up to exact repeats of a
    row. Columns of the results' names are replaced. Documents without words take nothing and have no copies; a null source is a
    source of its own, a null cell a cell of its own; an empty table gives no rows.
    """
    docs = docs.drop("size", "source_size", "target", "rate", "copies", "taken")
    words = word_count(F.col(text))
    named = F.lit("") if cell is None else F.coalesce(F.concat(F.lit("="), F.col(cell).cast("string")), F.lit(""))
    keyed = docs.withColumn("size", words).withColumn("__null", F.col(source).isNull()).withColumn("__source", F.coalesce(F.col(source).cast("string"), F.lit(""))).withColumn("__cell", named)
    narrow = cut(keyed.select(F.col(doc_id).alias("__id"), "__null", "__source", "__cell", "size"))
    key = ["__null", "__source", "__cell", "size"]
    counts = cut(narrow.groupBy(*key).agg(F.count("*").alias("n")))
    masses = cut(counts.groupBy("__null", "__source", "__cell").agg(F.sum(F.col("size") * F.col("n")).alias("mass"), F.sum("n").alias("docs")))
    sources = masses.groupBy("__null", "__source").agg(F.sum("mass").alias("source_size"))
    wanted = cut(targets(sources, list(weights), float(most)))
    rates = rates_of(cut(masses.join(wanted, ["__null", "__source"])), float(most))
    sized = copies_by_size(counts.join(rates.select("__null", "__source", "__cell", "source_size", "target", "rate"), ["__null", "__source", "__cell"]), most)
    rows = masses.agg(F.sum("docs").alias("n")).first()["n"] or 0
    parts = max(1, ceil(rows / NUMBERED))
    part = F.pmod(F.xxhash64("__id"), F.lit(parts))
    numbered_docs = keyed.withColumn("__part", F.pmod(F.xxhash64(F.col(doc_id)), F.lit(parts)))
    dealt = narrow.groupBy(*key, part.alias("__part")).agg(F.count("*").alias("m"))
    along = Window.partitionBy(*key).orderBy("__part")
    share = dealt.join(sized, key).withColumn("__base", F.expr("k div greatest(n, 1)")).withColumn("__rest", F.col("k") - F.col("__base") * F.col("n"))
    upto = share.withColumn("__upto", F.sum("m").over(along))
    extra = F.expr("__upto * __rest div n") - F.expr("(__upto - m) * __rest div n")
    share = upto.withColumn("__extra", extra).select(*key, "__part", "__base", "__extra", "source_size", "target", "rate")
    number = F.row_number().over(Window.partitionBy(*key, "__part").orderBy(F.col(doc_id)))
    out = numbered_docs.withColumn("__number", number).join(share, [*key, "__part"])
    out = out.withColumn("copies", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("__base") + (F.col("__number") <= F.col("__extra")).cast("long")).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).select(*docs.columns, "size", "source_size", "target", "rate", "copies", "taken")
