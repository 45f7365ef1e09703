"""Near-duplicates by SimHash: pigeonhole blocks, a join on blocks, then the Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.common import components, cut, cut_to, first_of_each, named_rows

BITS = 64
#: So many shingles are hashed at once, whatever the length of the text.
CHUNK = 1 << 15


def shingle_hashes(words: list[bytes], shingle: int, seed: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles in order, repeats included, in chunks; fewer words than a shingle are one."""
    n = max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n if words else 0, CHUNK):
        yield np.fromiter((digest(join(words[i : i + shingle]), seed) for i in range(at, min(at + CHUNK, n))), dtype="<u8")


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """By bit how many of the hashes have it."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint, as a signed 64-bit integer, of ``n`` hashes with these bits."""
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_of(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of one UTF-8 text."""
    words = text.lower().split() if text else []  # on bytes both know ASCII only
    ones = np.zeros(BITS, dtype=np.int64)
    for hashes in shingle_hashes(words, shingle, seed):
        ones += bits_set(hashes)
    return majority(ones, max(1, len(words) - shingle + 1)) if words else 0


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, seed: int = 42, name: str = "fp") -> DataFrame:
    """``docs`` with a column of signed 64-bit SimHash fingerprints.

    A-Z is lower-cased; words are runs of what is neither a space nor \\t to \\r. Every
    shingle counts as often as it occurs; a bit is set if over half of the hashes have
    it. Fewer words than a shingle: the whole sequence is the shingle. No words, an
    empty text or null: zero. Texts come as Arrow batches of bounded bytes and are
    hashed in chunks, so memory doesn't grow with the length of a text.
    """

    @F.arrow_udf("long")
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t.as_py(), shingle, seed) for t in texts], pa.int64())

    return docs.withColumn(name, udf(F.col(text).cast("binary")))


def blocks_for(distance: int, blocks: int | None = None, rows: int = 0) -> list[tuple[tuple[int, int], ...]]:
    """The (shift, width) lists whose bits make the keys of each block choice.

    ``distance`` differing bits touch at most so many of ``blocks`` blocks, so two close
    fingerprints agree on all of the others, for one choice at least. More blocks make
    longer keys and more choices. Where their number isn't given it is the least at which
    a key has three bits more than it takes to number the ``rows`` fingerprints, so that
    few share a key by chance however many they are.
    """
    if blocks is None:
        blocks = distance + 3
        while blocks < 2 * distance + 4 and BITS * (blocks - distance) // blocks < max(rows, 1).bit_length() + 3:
            blocks += 1
    if blocks <= distance:
        raise ValueError("more blocks than differing bits are needed")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    spans = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return list(combinations(spans, blocks - distance))


def _keys(fps: DataFrame, choices) -> DataFrame:
    """A row (choice, key, fp) for each fingerprint and choice of blocks."""
    masks = []
    for spans in choices:
        mask = sum(((1 << width) - 1) << shift for shift, width in spans)
        masks.append(mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask)
    masked = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])
    return fps.select("fp", F.posexplode(masked).alias("choice", "key"))


def _close(distance: int):
    return F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance


def links(fps: DataFrame, distance: int = 4, blocks: int | None = None, dense: int = 24, whole: bool = True) -> DataFrame:
    """Pairs (x, y), x < y, that connect all distinct ``fp`` within ``distance`` bits.

    Fingerprints that share a key of the pigeonhole blocks are joined and verified, for
    keys that at most ``dense`` fingerprints share. That bounds the candidates to a
    multiple of the rows. Fingerprints that share a fuller key are linked another exact
    way, without pairing the whole key: two at up to d bits have a midpoint at most
    ceil(d / 2) bits from both, so each lists all points of that radius around it, and
    those that list the same point (they are all within d of one another) are linked to
    the least of them. That is linear in the size of the group too, and links the same
    components as all pairs would. Without ``whole``, for callers that find the rest by
    other means, fingerprints of a fuller key are only compared with the least of it.
    """
    fps = cut(fps.select("fp").distinct())
    n = fps.count()
    choices = blocks_for(distance, blocks, n)
    most = n * len(choices)
    keys = _keys(fps, choices)
    counts = cut_to(keys.groupBy("choice", "key").agg(F.count("*").alias("n"), F.min("fp").alias("x"), F.max("fp").alias("y")).where("n > 1"), most)
    twos = counts.where("n = 2").select("x", "y").where(_close(distance))
    some = keys.join(counts.where(f"n > 2 and n <= {dense}").select("choice", "key"), ["choice", "key"])
    some = cut_to(some, most)
    left, right = some.withColumnRenamed("fp", "x"), some.withColumnRenamed("fp", "y")
    pairs = left.join(right, (left.choice == right.choice) & (left.key == right.key) & (F.col("x") < F.col("y")) & _close(distance)).select("x", "y")
    full = counts.where(f"n > {dense}")
    if not whole:
        star = keys.join(full.select("choice", "key", "x"), ["choice", "key"]).select("x", F.col("fp").alias("y"))
        return twos.union(pairs).union(star.where((F.col("x") != F.col("y")) & _close(distance))).distinct()
    crowded = cut(keys.join(full.select("choice", "key"), ["choice", "key"]).select("fp").distinct())
    return twos.union(pairs).union(_by_midpoint(crowded, distance)).distinct()


def _by_midpoint(fps: DataFrame, distance: int) -> DataFrame:
    """Links by shared points at up to half the distance: at most sum C(64, i) rows for each fingerprint."""
    from pyspark.sql.window import Window

    radius = (distance + 1) // 2
    bit = lambda i: (1 << i) - (1 << BITS) * (i == BITS - 1)
    flips = [0]
    for size in range(1, radius + 1):
        for some in combinations(range(BITS), size):
            value = 0
            for i in some:
                value ^= bit(i)
            flips.append(value)
    assert len(flips) == sum(comb(BITS, i) for i in range(radius + 1))
    listed = ", ".join(f"{f}L" if f != -(1 << 63) else "(-9223372036854775807L - 1L)" for f in flips)
    # every task is to make about a million points
    fps = fps.repartition(max(1, fps.count() * len(flips) >> 20), "fp")
    points = fps.select("fp", F.explode(F.expr(f"array({listed})")).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    # at most len(flips) fingerprints are so near one point, however large the group
    least = points.select("fp", F.min("fp").over(Window.partitionBy("point")).alias("least"))
    close = least.where("least < fp").distinct().select(F.col("least").alias("x"), F.col("fp").alias("y"))
    return close.where(_close(distance))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42, distance: int = 4, blocks: int | None = None, dense: int = 24) -> DataFrame:
    """One row a document: (doc_id, fp, component_id, component_size).

    component_id is the smallest doc_id that chains of links reach, the document itself
    included. Exact copies share a fingerprint and are never paired: the join works on
    distinct fingerprints, and documents come back by one join on the fingerprint, in
    which Spark splits hot values. Documents without words have fingerprint zero and are
    linked like any other. A null doc_id keeps its row; its component takes the smallest
    id that isn't null, or null if it has none. Repeated rows stay. An empty table gives
    no rows.
    """
    marked = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), "__text", shingle, seed).select("doc_id", "fp"))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = components(links(fps, distance, blocks, dense), "x", "y")
    label = F.coalesce("label", "fp")
    labelled = cut(fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", label.alias("label"), "least", "n"))
    # stored, so that the join's sides are plain shuffles and a label of very many fingerprints can be split
    groups = cut(labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size")))
    ids = cut(labelled.select("fp", "label").join(groups, "label").select("fp", "component_id", "component_size"))
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id", "component_size")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42, distance: int = 4, blocks: int | None = None, dense: int = 24) -> DataFrame:
    """``docs`` without the near-duplicates: of each component the row with the smallest doc_id stays.

    A null doc_id comes after all others; of rows with the same one the smallest by the
    hash of its content stays, and of rows that are equal throughout any one. Texts that
    are no near-duplicates all stay, whatever their ids.
    """
    named = named_rows(docs)
    marked = cut(fingerprints(named.select("__row", F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), "__text", shingle, seed).select("__row", "doc_id", "fp"))
    found = components(links(marked, distance, blocks, dense), "x", "y")
    labelled = marked.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    return first_of_each(named, labelled.select("__row", "doc_id", F.coalesce("label", "fp").alias("label")))
