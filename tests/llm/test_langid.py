import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcatlas.llm import langid
from srcatlas.llm.catalog import op8_langid

DATA = "/root/testdata/sf0.001"


def test_grams(monkeypatch):
    assert langid.grams("", 64) is None and langid.grams("12 ...", 64) is None
    assert np.array_equal(langid.grams("Ab  cd!", 64), langid.grams("ab 3 CD", 64))
    text = "Straße und Äpfel, 12 Bäume; " * 5
    whole = langid.grams(text, 256)
    assert whole.sum() == 5 * sum(len(w) for w in ("straße", "und", "äpfel", "bäume")) + 5 * 4 - 1
    monkeypatch.setattr(langid, "CHUNK", 3)
    assert np.array_equal(langid.grams(text, 256), whole)


def test_mixture():
    p = np.full((3, 30), 0.001)
    for i in range(3):
        p[i, i * 10 : i * 10 + 10] = 0.1
    model = langid.Model(["a", "b", "c"], p / p.sum(axis=1, keepdims=True))
    counts = np.zeros(30)
    counts[:10], counts[10:20] = 30, 10
    chosen, share, overall = langid.mixture(model, counts)
    assert chosen == [0, 1] and abs(share[0] - 0.75) < 0.02 and abs(overall.sum() - 1) < 1e-6
    counts[10:20] = 0
    assert langid.mixture(model, counts)[0] == [0]


def plain_em(p, counts, chosen, rounds):
    """Proportions and log-likelihood, gram by gram."""
    share = [1 / len(chosen)] * len(chosen)
    for _ in range(rounds):
        new = [0.0] * len(chosen)
        for g, n in enumerate(counts):
            if n:
                whole = sum(s * p[i][g] for s, i in zip(share, chosen, strict=True))
                for k, i in enumerate(chosen):
                    new[k] += n * share[k] * p[i][g] / whole
        new = [x / sum(counts) for x in new]
        done = max(abs(a - b) for a, b in zip(new, share, strict=True)) < 1e-4
        share = new
        if done:
            break
    return share, sum(n * math.log(sum(s * p[i][g] for s, i in zip(share, chosen, strict=True))) for g, n in enumerate(counts) if n)


def test_mixture_against_plain_em():
    """Proportions, order and set are those of a plain expectation-maximisation over every prefix of languages."""
    r = np.random.default_rng(3)
    sizes = set()
    for _ in range(40):
        langs, buckets = int(r.integers(1, 6)), 40
        p = r.dirichlet(np.full(buckets, 0.3), langs) + 1e-4
        p /= p.sum(axis=1, keepdims=True)
        parts = r.dirichlet(np.full(langs, 0.7))
        counts = r.multinomial(int(r.integers(5, 3000)), parts @ p)
        chosen, share, overall = langid.mixture(langid.Model([str(i) for i in range(langs)], p), counts)
        want, _ = plain_em(p, counts, list(range(langs)), 30 if langs > 1 else 0)
        assert np.allclose(overall, want, atol=1e-9)
        order = sorted(range(langs), key=lambda i: -want[i])
        sets = []
        for size in range(1, max(1, sum(x >= 0.02 for x in want)) + 1):
            some = sorted(order[:size])
            s, fit = plain_em(p, counts, some, 30 if size > 1 else 0)
            sets.append((fit - size * 3.0 * math.log(counts.sum() + 1), -size, some, s))
        best = max(sets)
        assert chosen == best[2] and np.allclose(share, best[3], atol=1e-9)
        sizes.add(len(chosen))
    assert {1, 2, 3, 4} <= sizes  # texts of four languages get all four


def test_edges(spark):
    docs = spark.createDataFrame([(1, "der die das und nicht", "de"), (2, "the and of with", "en"), (3, None, "en"), (4, "123", "en"), (5, "the of", None), (None, "und die", "de"), (1, "der die das und nicht", "de")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["de", "en"]
    got = [(r.doc_id, r.language.lang, r.language.score) for r in langid.identify(docs.withColumn("score", F.lit("clash")), model).collect()]
    assert len(got) == 7 and {(d, x) for d, x, _ in got} == {(1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "en"), (None, "de")}
    assert all(0 <= s <= 1 for *_, s in got)
    empty = langid.train(docs.where("false"))
    assert {r.language.lang for r in langid.identify(docs, empty).collect()} == {"und"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_held_out_accuracy(spark):
    got = op8_langid(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.97
