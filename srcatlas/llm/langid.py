"""Language identification: expectation-maximisation over a mixture of n-gram language models."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: So many code points are counted at once.
CHUNK = 1 << 20
ORDER = 3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: the lower-case letter's code, or 0 for what is no letter."""
    codes = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            codes[i] = ord(c.lower()[0])
    return codes


def grams(text: str, buckets: int) -> np.ndarray | None:
    """Counts of hashed letter trigrams, words padded by a gap; None if no letter is there."""
    total, tail = None, np.zeros(1, dtype=np.uint32)
    for at in range(0, len(text), CHUNK):
        codes = _letters()[np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        codes = np.concatenate([tail, codes, [0]] if at + CHUNK >= len(text) else [tail, codes]).astype(np.uint64)
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]  # gaps are one
        if len(codes) >= ORDER:
            mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            counts = np.bincount((mixed >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets)
            total = counts if total is None else total + counts
        tail = codes[-2:].astype(np.uint32)
    return total


@dataclass
class Model:
    """Smoothed n-gram probabilities by language."""

    langs: list[str]
    p: np.ndarray  # languages x buckets

    @property
    def buckets(self) -> int:
        return self.p.shape[1]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = 1 << 14, smoothing: float = 0.05) -> Model:
    """N-gram counts of all ``docs`` with a text and a language, by language.

    Each task adds up its own rows and yields at most buckets x languages sums, which
    Spark adds; the driver gets that many numbers, whatever the size of the corpus. The
    label set is taken as it is.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = grams((t.as_py() or b"").decode("utf-8", "replace"), buckets)
                if found is not None:
                    if name not in sums:
                        sums[name] = np.zeros(buckets, dtype=np.int64)
                    sums[name] += found
        for name, total in sums.items():
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"])

    known = docs.select(F.col(text).cast("binary").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = rows.column("lang").to_pylist()
    langs = sorted(set(names))
    row = {name: i for i, name in enumerate(langs)}
    counts = np.zeros((len(langs), buckets))
    counts[[row[x] for x in names], rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    counts += smoothing
    return Model(langs, (counts / counts.sum(axis=1, keepdims=True)).astype(np.float64))


def mixture(model: Model, counts: np.ndarray, rounds: int = 30, penalty: float = 3.0, least_share: float = 0.02) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The language set of one document, the proportions within it, and those over all languages.

    Expectation-maximisation over all languages orders them; then the sets of the 1, 2,
    ... largest are compared by log-likelihood less ``penalty`` x size x log(grams), as
    far as languages hold ``least_share`` of the document.
    """
    at = np.nonzero(counts)[0]
    n, p = counts[at].astype(np.float64), model.p[:, at]

    def em(chosen: np.ndarray) -> tuple[np.ndarray, float]:
        q = p[chosen]
        share = np.full(len(chosen), 1 / len(chosen))
        for _ in range(rounds if len(chosen) > 1 else 0):
            weighted = q * share[:, None]
            new = (weighted * (n / weighted.sum(axis=0))).sum(axis=1) / n.sum()
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float((n * np.log(share @ q)).sum())

    overall, _ = em(np.arange(len(model.langs)))
    order = np.argsort(-overall, kind="stable")
    cost, best = penalty * log(n.sum() + 1), None
    for size in range(1, max(1, int((overall >= least_share).sum())) + 1):
        chosen = np.sort(order[:size])
        share, fit = em(chosen)
        if best is None or fit - size * cost > best[0]:
            best = (fit - size * cost, chosen, share)
    return [int(i) for i in best[1]], best[2], overall


_ANSWER = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])


def identify(docs: DataFrame, model: Model, text: str = "text", name: str = "language", **options) -> DataFrame:
    """``docs`` with a struct: lang (the largest of the document's set), score and the set with proportions.

    score is the language's estimated share of the whole text, among all languages that
    the model knows. A null text, or one without a letter, is ``und`` with score 0 and
    an empty set, and so is every text if the model knows no language. Only the text is
    looked at; whole texts are counted, in chunks. The model that goes to the executors
    has languages x buckets numbers, and doesn't grow with the documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double, languages: array<struct<lang: string, share: double>>>")
    def udf(texts: pa.Array) -> pa.Array:
        known, out = shared.value, []
        for t in texts:
            counts = grams((t.as_py() or b"").decode("utf-8", "replace"), known.buckets) if known.langs else None
            if counts is None:
                out.append({"lang": UNKNOWN, "score": 0.0, "languages": []})
                continue
            chosen, share, overall = mixture(known, counts, **options)
            top = chosen[int(share.argmax())]
            out.append({"lang": known.langs[top], "score": min(1.0, max(0.0, float(overall[top]))), "languages": [{"lang": known.langs[i], "share": float(s)} for i, s in sorted(zip(chosen, share, strict=True), key=lambda x: -x[1])]})
        return pa.array(out, _ANSWER)

    # else Spark would run it again for a filter on its result
    return docs.withColumn(name, udf.asNondeterministic()(F.col(text).cast("binary")))


def in_training(doc_id: str = "doc_id"):
    """Documents to learn from: the checksum of their id leaves no remainder 2 by 4; a null id is not learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))
