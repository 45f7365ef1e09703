import random

import numpy as np
import pytest

from srcatlas.llm import jaccard


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    """The least index of each text's component, over all pairs."""
    sets, label = [plain_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both * 5 >= either * 4 and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return label


def changed(r, words, n):
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"n{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("dense", [24, 2])
def test_pairs_of_similarity_stay_no_longer(spark, dense):
    r = random.Random(5)
    texts = ["", "one", "One", "a b c", "a b c d"]
    for _ in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([60, 120, 200]))]
        texts += [" ".join(base), changed(r, base, 1), changed(r, base, 2)]
    crowd = [f"c{i}" for i in range(150)]
    texts += [changed(r, crowd, r.randrange(1, 6)) for _ in range(60)]
    texts += [" ".join(crowd[:60]) + " " + " ".join(f"t{r.randrange(10**6)}" for _ in range(10)) for _ in range(40)]
    want = brute_components(texts)
    assert len(set(want)) < len(texts) - 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = jaccard.keep_one(docs, dense=dense)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want))
    assert jaccard.keep_one(docs.where("false")).collect() == []


def test_pipeline_stage_goes_by_similarity(spark):
    import corpus_pipeline

    r = random.Random(6)
    bases = [[f"w{r.randrange(3000)}" for _ in range(60)] for _ in range(50)]
    rows = [(2 * i + k, " ".join(b) if k == 0 else " ".join([*b[:30], "new", *b[31:]]), "en", "web", 1) for i, b in enumerate(bases) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [2 * i for i in range(50)]


def test_one_row_of_each_component_whatever_its_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (None, a), (None, b), (None, b), (1, c), (1, a)], "doc_id long, text string")
    got = sorted((str(x.doc_id), x.text) for x in jaccard.keep_one(docs).collect())
    assert got == [("1", a), ("1", c), ("None", b)]


def test_bands_find_pairs_at_the_threshold():
    """Of pairs that are similar by just 0.8 all but a few in a million share a band; by 0.4 hardly any do."""
    r = np.random.default_rng(1)
    met = {0.8: 0, 0.4: 0}
    for s in met:
        for _ in range(300):
            x = r.integers(0, 1 << 63, 900, dtype=np.uint64)
            both = round(600 * s)
            a, b = np.concatenate([x[:both], x[both : both + (600 - both) // 2]]), np.concatenate([x[:both], x[both + (600 - both) // 2 : 600]])
            assert abs(len(np.intersect1d(a, b)) / len(np.union1d(a, b)) - s) < 1e-9
            met[s] += bool((jaccard.bands_of(a) == jaccard.bands_of(b)).any())
    assert met[0.8] == 300 and met[0.4] < 150


def test_simhash_cannot_reach_the_threshold():
    """Why bands are needed: fingerprints of pairs similar by 0.8 differ in about 10 bits, hardly ever in 4 or fewer."""
    r = np.random.default_rng(2)
    bits = []
    for _ in range(200):
        x = r.integers(0, 1 << 63, 600, dtype=np.uint64)
        a, b = (jaccard.majority(jaccard.bits_set(s), len(s)) for s in (x[:540], x[60:]))
        bits.append(((a ^ b) & (1 << 64) - 1).bit_count())
    assert 8 < np.mean(bits) < 12 and np.mean(np.array(bits) <= 4) < 0.1


def test_crowds_of_distant_copies_are_not_paired(spark, monkeypatch):
    """Copies of one text, most too far apart for the threshold, under crowded bands: few candidates, and all links."""
    r = random.Random(7)
    crowd = [f"c{i}" for i in range(150)]
    texts = [changed(r, crowd, r.randrange(3, 6)) for _ in range(300)]
    want = brute_components(texts)
    assert len(set(want)) > 100
    seen = []
    similar = jaccard._Sets.similar
    monkeypatch.setattr(jaccard._Sets, "similar", lambda self, pairs: seen.append(pairs.count()) or similar(self, pairs))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in jaccard.keep_one(docs).collect()) == sorted(set(want))
    print("candidates", seen)
    assert sum(seen) < 10 * len(texts)
