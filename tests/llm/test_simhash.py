import random

import numpy as np
import pytest
import xxhash

from srcatlas.llm import simhash
from srcatlas.llm.common import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def brute_components(ids, fps, distance=4):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprints(monkeypatch):
    r = random.Random(1)
    texts = [None, "", " \t\n", "One", "a b c", "A b\x0bc d", "a\u00a0b c d e", "é É ß x y z"] + [" ".join(r.choice("abcdef") * r.randint(1, 3) for _ in range(r.randrange(60))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint_of(t and t.encode()) == plain_fingerprint(t)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    for t in texts:
        assert simhash.fingerprint_of(t and t.encode()) == plain_fingerprint(t)


def near_words(r, base, n):
    words = base.split()
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(["x", "y", "zz"])
    return " ".join(words)


@pytest.mark.parametrize("dense", [24, 2])
def test_components(spark, dense):
    r = random.Random(2)
    base = " ".join(f"w{r.randrange(1000)}" for _ in range(200))
    texts = [None, "", base, base.upper(), *(near_words(r, base, r.randrange(4)) for _ in range(60)), *(" ".join(f"v{r.randrange(50)}" for _ in range(r.randrange(1, 40))) for _ in range(40))]
    rows = [(i * 3 % 211, t, "extra", 1) for i, t in enumerate(texts)] + [(None, base, "extra", 1), (3, "", "extra", 2), (3, "", "extra", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs, dense=dense).collect()
    fps = [plain_fingerprint(t) for _, t, _, _ in rows]
    want = brute_components([d for d, *_ in rows], fps)
    assert sorted((str(a.doc_id), a.fp, str(a.component_id)) for a in got) == sorted((str(d), f, str(c)) for (d, *_), f, c in zip(rows, fps, want, strict=True))
    kept = simhash.keep_one(docs, dense=dense).collect()
    assert sorted(str(k.doc_id) for k in kept) == sorted({str(c) for c in want})
    assert simhash.near_duplicates(docs.where("false")).collect() == []


@pytest.mark.parametrize("dense", [1000, 1])
def test_links_are_exact(spark, dense):
    """Both ways of linking give the components of all pairs, also in a crowded ball."""
    r = random.Random(4)
    centre = r.getrandbits(64)
    values = {centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(7))) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)}
    fps = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), dense=dense)
    labels = {x.node: x.label for x in components(found, "x", "y").collect()}
    want = brute_components(fps, fps)
    assert [labels.get(f, f) for f in fps] == want


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 105), (105, 103), (7, 7)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {105: 100, 103: 100}


def test_blocks():
    for distance, blocks in ((4, None), (3, 6), (4, 9)):
        choices = simhash.blocks_for(distance, blocks)
        r = np.random.default_rng(0)
        for _ in range(200):
            bits = set(r.choice(64, distance, replace=False))
            assert any(all(not bits & set(range(s, s + w)) for s, w in c) for c in choices)


def test_keys_grow_with_the_rows():
    widths = [sum(w for _, w in simhash.blocks_for(4, rows=n)[0]) for n in (0, 10**5, 10**7, 10**9, 5 * 10**10)]
    assert widths == sorted(widths) and all(w >= min(38, n.bit_length() + 2) for w, n in zip(widths, (0, 10**5, 10**7, 10**9, 5 * 10**10), strict=True))


def test_keep_one_loses_no_text(spark):
    """Other texts of the same id stay, columns of inner names too."""
    rows = [(1, "alpha beta gamma delta eps", 5), (1, "quite other words stand here now", 6), (2, "alpha beta gamma delta eps", 7), (None, "third text with its own words", 8), (None, "third text with its own words", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __kept int")
    got = sorted((str(x.doc_id), x["__kept"]) for x in simhash.keep_one(docs).collect())
    assert got == [("1", 5), ("1", 6), ("None", 8)]
