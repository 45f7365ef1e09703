"""Near-duplicates by the Jaccard similarity of word shingles.

SimHash fingerprints are too coarse for this: texts whose shingles are similar by 0.8
differ in 9.7 of 64 bits on average, and in up to 17, for which no blocks are long
enough to be keys. So SimHash finds the closest texts, which are most of those in large
groups, and bands of minimum hashes propose the others. Among sets of crowded bands
hashes that are rare there propose them instead. The exact similarity decides on all.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.common import BROADCAST_ROWS, components, cut, cut_to, few, first_of_each, named_rows
from srcatlas.llm.simhash import BITS, bits_set, links, majority, shingle_hashes

#: Bands of so many minimum hashes each. Two sets of similarity s share no band with probability (1 - s ** ROWS) ** BANDS: 3e-6 at 0.8, 2e-13 at 0.9.
BANDS, ROWS = 32, 5
_ODD = np.random.default_rng(20_240_101).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles_of(text: bytes | None, shingle: int = 5, seed: int = 42) -> tuple[np.ndarray, int]:
    """The sorted distinct hashes of a text's shingles, and its fingerprint; words are those of SimHash."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype="<u8"), 0
    ones, parts = np.zeros(BITS, dtype=np.int64), []
    for hashes in shingle_hashes(words, shingle, seed):
        ones += bits_set(hashes)
        parts.append(np.unique(hashes))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)), majority(ones, max(1, len(words) - shingle + 1))


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """One key a band, of the minima of ROWS permutations of a set's hashes; none for the empty set."""
    if not len(hashes):
        return np.empty(0, dtype="<u8")
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[None, at : at + 1024] * _ODD[:, None]).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * _MIX
        key ^= key >> np.uint64(29)
    return key


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Sets:
    """The distinct texts of ``docs`` (with __row), and the exact similarity of pairs of them."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, at_least: Fraction, shingle: int, seed: int):
        self.docs, self.text, self.at_least, self.shingle, self.seed = docs, text, at_least, shingle, seed

        @F.arrow_udf("struct<sid: bigint, size: bigint, fp: bigint, bands: array<bigint>>")
        def marks(texts: pa.Array) -> pa.Array:
            ids, sizes, fps, bands = [], [], [], []
            for t in texts:
                hashes, fp = shingles_of(t.as_py(), shingle, seed)
                ids.append(_signed(xxhash.xxh64_intdigest(hashes.tobytes(), seed)))
                sizes.append(len(hashes))
                fps.append(fp)
                bands.append(bands_of(hashes).view("<i8"))
            return pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["sid", "size", "fp", "bands"])

        found = docs.select("__row", F.col(doc_id).alias("doc_id"), marks(F.col(text).cast("binary")).alias("m"))
        self.marked = cut(found.select("__row", "doc_id", "m.*"))
        self.sets = cut(self.marked.groupBy("sid").agg(F.min("__row").alias("__row"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
        self.n = self.sets.count()

    def hashes(self, sids: DataFrame) -> DataFrame:
        """(sid, s) of the distinct ``sids``; s has the bytes of the set's sorted hashes."""
        shingle, seed = self.shingle, self.seed

        @F.arrow_udf("binary")
        def hashed(texts: pa.Array) -> pa.Array:
            return pa.array([shingles_of(t.as_py(), shingle, seed)[0].tobytes() for t in texts], pa.binary())

        needed = sids.join(self.sets.select("sid", "__row"), "sid")
        texts = self.docs.select("__row", F.col(self.text).cast("binary").alias("t")).join(few(needed), "__row").dropDuplicates(["sid"])
        return cut(texts.select("sid", hashed("t").alias("s")))

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The (x, y) of ``pairs`` (stored) whose exact similarity is large enough."""
        at_least = self.at_least

        @F.arrow_udf("boolean")
        def close(a: pa.Array, b: pa.Array) -> pa.Array:
            out = []
            for p, q in zip(a, b, strict=True):
                p, q = np.frombuffer(p.as_py(), "<u8"), np.frombuffer(q.as_py(), "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(both * at_least.denominator >= (len(p) + len(q) - both) * at_least.numerator)
            return pa.array(out, pa.bool_())

        known = self.hashes(pairs.select(F.col("x").alias("sid")).union(pairs.select("y")).distinct())
        joined = pairs.join(known.toDF("x", "a"), "x").join(known.toDF("y", "b"), "y")
        return cut(joined.where(close("a", "b")).select("x", "y"))

    def fitting(self, a: str, b: str) -> str:
        """A condition that sizes of sets similar enough meet."""
        return f"least({a}, {b}) * {self.at_least.denominator} >= greatest({a}, {b}) * {self.at_least.numerator}"


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle: int = 5, seed: int = 42, distance: int = 4, dense: int = 8) -> DataFrame:
    """(__row, doc_id, label) by component, for ``docs`` with the __row of named_rows.

    Texts are linked if the Jaccard similarity of their sets of shingles is ``similarity``
    at least; texts of the same set, those without words too, are one node. First SimHash
    components of ``distance`` bits are verified: a set as similar to the least of its
    component gets that one's label, which settles large groups in proportion to their
    size. Then sets of different labels that share a band are compared, if at most
    ``dense`` sets share it. The sets of fuller bands go to ``crowd_links``.
    """
    sets = _Sets(docs, doc_id, text, Fraction(str(similarity)), shingle, seed)
    # 1: SimHash
    near = components(links(sets.sets, distance, whole=False), "x", "y").withColumnRenamed("node", "fp")
    grouped = sets.sets.select("sid", "size", "fp").join(near, "fp", "left").select("sid", "size", F.coalesce("label", "fp").alias("g"))
    grouped = cut_to(grouped, sets.n)
    heads = cut(grouped.groupBy("g").agg(F.min(F.struct("sid", "size")).alias("h"), F.count("*").alias("n")).where("n > 1"))
    spokes = grouped.join(heads.select("g", F.col("h.sid").alias("x"), F.col("h.size").alias("m")), "g").where(f"sid != x AND {sets.fitting('size', 'm')}")
    linked = sets.similar(cut_to(spokes.select("x", F.col("sid").alias("y")), sets.n))
    # 2: bands of sets that are not connected yet
    label = F.coalesce("x", "sid").alias("label")
    labelled = cut_to(sets.sets.join(linked.withColumnRenamed("y", "sid"), "sid", "left").select("sid", "size", label, "bands"), sets.n)
    keys = labelled.select("sid", "size", "label", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key", "n")
    some = cut_to(keys.join(cut_to(shared, sets.n), "key"), BANDS * sets.n)
    pairs = [_across(some.where(f"n <= {dense}"), sets)]
    crowd = cut(some.where(f"n > {dense}").select("sid", "label").distinct())
    stars, more = crowd_links(sets, crowd, dense)
    linked = cut(reduce(DataFrame.union, [linked, *stars, sets.similar(cut(reduce(DataFrame.union, [*pairs, *more]).distinct()))]))
    found = components(linked, "x", "y")
    done = sets.marked.select("__row", "doc_id", "sid").join(found.withColumnRenamed("node", "sid"), "sid", "left")
    return done.select("__row", "doc_id", F.coalesce("label", "sid").alias("label"))


def _across(members: DataFrame, sets: _Sets) -> DataFrame:
    """Pairs (x, y), x < y, of sets of fitting sizes that share a key but not the label."""
    one, two = (members.select("key", F.col("sid").alias(x), F.col("size").alias(n), F.col("label").alias(c)) for x, n, c in (("x", "m", "a"), ("y", "n", "b")))
    return one.join(two, "key").where(f"x < y AND a != b AND {sets.fitting('m', 'n')}").select("x", "y")


def crowd_links(sets: _Sets, crowd: DataFrame, dense: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links (x, y) of similar sets, and pairs (x, y) to be verified: together they connect all similar sets of ``crowd``.

    ``crowd`` is stored and has (sid, label); pairs of one label are left out. With J >= p / q
    two sets x, y differ in at most (|x| + |y|) * a / b hashes, a = q - p, b = q + p. To
    take all hashes of a set M out of x where x has them, and in where it hasn't, gives a
    D(x) such that D(x) and D(y) differ just as x and y do. With v(x) = b |D(x)| - a |x|,
    similar sets thus share at least c = (v(x) + v(y)) / 2b hashes of their Ds. Where that
    is 0 or less both are similar to the set of least v, and one link each is enough.
    Otherwise the first hash they share is among the first |D| - c + 1 of either, in any
    order; from the rarest on, these are few, and shared by few. M is empty at first; the
    sets that share any such hash are parted into groups, and in each M is what over half
    of its sets have: copies of one text keep what each has changed. Hashes that over ``dense``
    sets share even then make smaller groups in turn. What doesn't get smaller is paired.
    """
    a, b = sets.at_least.denominator - sets.at_least.numerator, sets.at_least.denominator + sets.at_least.numerator
    p, q = sets.at_least.numerator, sets.at_least.denominator
    stars, pairs = [], []
    if crowd.isEmpty():
        return stars, pairs
    known = sets.hashes(crowd.select("sid")).join(crowd, "sid")
    known = cut(known.select("sid", "label", _longs("s").alias("s")).where("size(s) > 0"))
    now, first = known.withColumns({"g": F.lit(0).cast("long"), "n": F.lit(0).cast("long"), "flips": F.array().cast("array<bigint>")}), True
    while True:
        # each set without what most of its group have, and with what it lacks of that
        other = F.array_union(F.array_except("s", "flips"), F.array_except("flips", "s"))
        held = now.select("g", "n", "sid", "label", F.size("s").alias("size"), F.size("flips").alias("m"), (F.col("s") if first else other).alias("d"))
        held = cut(held.withColumn("k", F.size("d")).withColumn("v", F.expr(f"k * {b}L - size * {a}L")))
        heads = few(held.groupBy("g").agg(F.min(F.struct("v", "sid")).alias("h")).select("g", F.col("h.v").alias("v0"), F.col("h.sid").alias("head")))
        stars.append(cut(held.join(heads, "g").where("v + v0 <= 0 AND sid != head").select(F.col("head").alias("x"), F.col("sid").alias("y"))))
        # groups with sets that aren't linked to the head; free is the least v of those
        free = few(held.join(heads, "g").where("v + v0 > 0").groupBy("g", "v0").agg(F.min("v").alias("free")))
        held = held.join(free, "g")
        # what a set shares at least with any that has a larger v, as low, and with any that has a smaller one, as high
        fits = f"ceil(size * {p}L / {q}D)"
        bound = F.expr(f"greatest(v0, CASE WHEN {fits} >= m THEN {fits} * {b - a}L - m * {b}L ELSE -m * {a}L END)")
        low = F.expr(f"greatest(1L, CASE WHEN v < free THEN ceil((v + free) / {2 * b}D) ELSE ceil(v / {b}D) END)")
        high = F.expr(f"CASE WHEN v < free THEN k + 1L ELSE greatest(1L, ceil((v + bound) / {2 * b}D)) END")
        marks = held.withColumn("bound", bound).select("g", "n", "sid", "label", "size", "k", "v", low.alias("low"), high.alias("high"))
        tokens = held.select("g", "sid", F.explode("d").alias("t"))
        shared = tokens.groupBy("g", "t").agg(F.count("*").alias("c")).where("c > 1")
        rare = tokens.join(shared, ["g", "t"]).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("ts"))
        # hashes of one set alone come first in the order, and make no keys
        keys = rare.join(marks, "sid").withColumn("own", F.expr("k - size(ts)"))
        keys = keys.withColumn("ts", F.expr("slice(ts, 1, int(greatest(0L, k - least(low, high) + 1 - own)))"))
        keys = keys.select("g", "n", "sid", "label", "size", "k", "v", "low", "high", "own", F.posexplode("ts").alias("at", "e"))
        keys = cut(keys.select("g", "n", "sid", "label", "size", "k", "v", (F.col("own") + F.col("at")).alias("at"), F.col("e.t").alias("t"), F.expr("own + at + low <= k").alias("lower"), F.expr("own + at + high <= k").alias("upper")))
        counts = keys.groupBy("g", "t").agg(F.least(F.count_if("lower"), F.count_if("upper")).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("sid").alias("x")).where("c > 0 AND lo < hi")
        keys = cut(keys.join(counts.select("g", "t", "c", "x"), ["g", "t"]))
        full = keys.where(f"c > {0 if first else dense}")
        if not first:
            pairs.append(_meeting(keys.where(f"c <= {dense}"), sets, b))
        edges = cut(full.select("x", "sid").distinct())
        if edges.isEmpty():
            return stars, pairs
        # smaller groups
        group = F.coalesce("label", "sid").alias("to")
        inside = cut(edges.select("sid").distinct().join(components(edges, "x", "sid").toDF("sid", "label"), "sid", "left").select("sid", group))
        sizes = inside.groupBy("to").agg(F.count("*").alias("more"))
        moved = full.groupBy("sid").agg(F.first("n").alias("n")).join(inside, "sid").join(few(sizes), "to")
        moved = cut(moved.select("sid", "to", "more", (F.lit(first) | F.expr("more * 10 <= n * 9")).alias("smaller")))
        if not first:
            pairs.append(_meeting(full.join(moved.where("NOT smaller").select("sid"), "sid", "left_semi"), sets, b))
        now = cut(known.join(moved.where("smaller").select("sid", F.col("to").alias("g"), F.col("more").alias("n")), "sid"))
        most = now.select("g", "n", F.explode("s").alias("t")).groupBy("g", "n", "t").agg(F.count("*").alias("c")).where("c * 2 > n")
        most = cut(most.groupBy("g").agg(F.collect_list("t").alias("flips"), F.count("*").alias("c")))
        # as many hashes are broadcast as rows of one number would be
        if (most.agg(F.sum("c")).first()[0] or 0) <= BROADCAST_ROWS:
            most = F.broadcast(most)
        now = now.join(most.drop("c"), "g", "left").withColumn("flips", F.coalesce("flips", F.array().cast("array<bigint>")))
        first = False


def _longs(column: str):
    """The numbers whose bytes, the least first, a binary column holds."""

    @F.arrow_udf("array<bigint>")
    def read(found: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x.as_py(), "<i8") for x in found], pa.list_(pa.int64()))

    return read(column)


def _meeting(keys: DataFrame, sets: _Sets, b: int) -> DataFrame:
    """Pairs (x, y) of sets of a group that share a hash where the first one that they share can be."""
    one = keys.where("lower").select("g", "t", *[F.col(c).alias(f"{c}1") for c in ("sid", "label", "size", "k", "v", "at")])
    two = keys.where("upper").select("g", "t", *[F.col(c).alias(f"{c}2") for c in ("sid", "label", "size", "k", "v", "at")])
    shared = f"greatest(1L, ceil((v1 + v2) / {2 * b}D))"
    met = one.join(two, ["g", "t"]).where(f"label1 != label2 AND v1 <= v2 AND {sets.fitting('size1', 'size2')} AND at1 + {shared} <= k1 AND at2 + {shared} <= k2")
    return cut(met.select(F.least("sid1", "sid2").alias("x"), F.greatest("sid1", "sid2").alias("y")).distinct())


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the near-duplicates: of each component the row with the smallest doc_id stays.

    A null doc_id comes after all others; of rows with the same one the smallest by the
    hash of its content stays, and of rows that are equal throughout any one.
    """
    named = named_rows(docs)
    return first_of_each(named, near_copies(named, doc_id, text, **options))
