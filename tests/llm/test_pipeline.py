"""The pipeline, stage by stage, on a small corpus of edge cases."""

import os
import random

import pytest

from srcatlas.llm import decontaminate, pii
from test_jaccard import brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the house stands on a hill and the people who live there look at the sea when they have time for it".split()
DE = "das haus steht auf einem berg und die leute die dort wohnen sehen das meer wenn sie zeit dafür haben".split()
ITEM = "which of these seven planets has the largest number of known moons in our own solar system today"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    say = lambda words, n: " ".join(r.choice(words) + r.choice(["", "", "s", f"{r.randrange(99)}"]) for _ in range(n))
    out = [(i, say(EN if i % 3 else DE, r.randrange(40, 120)), "en" if i % 3 else "de", r.choice(["web", "web", "web", "book", None])) for i in range(120)]
    base = out[5][1].split()
    out += [(200, out[5][1], "en", "web"), (201, " ".join([*base[:20], "changed", *base[21:]]), "en", "book"), (202, out[5][1].upper(), "en", "web"), (None, out[5][1], "en", "web")]
    out += [(210, None, "en", "web"), (211, "", "en", "web"), (212, "123 456 !!", "de", "web"), (213, " \n\t", None, None), (214, "the", "en", "web")]
    out += [(220, say(EN, 60) + " " + ITEM + " " + say(EN, 60), "en", "web"), (221, ITEM, "en", "web"), (222, say(EN, 50) + " mail x.y@example.org now", "en", "web"), (223, say(EN, 30) + " phone (030) 555-1234 " + say(EN, 5), None, "web")]
    out += [(230, say(EN, 20_000), "en", "long"), (7, say(DE, 50), "de", "other"), out[9], out[9]]
    return [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in out]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (None, "short one"), (3, None), (4, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def words(text):
    return (text or "").split()


def test_stages(spark, rows, folder):
    import corpus_pipeline as p

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "777")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(p.STAGES)
    assert list(stage) == ["language", "near_duplicates", "decontamination", "pii", "mixing"]

    def through(name, docs):
        at = f"{folder}/{name}"
        stage[name](spark, docs, folder).write.parquet(at)
        return spark.read.parquet(at)

    one = through("language", docs)
    assert one.columns == p.COLUMNS
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert sorted(map(str, one.collect())) == sorted(str(x) for x in docs.collect() if letters(x.text))

    two = through("near_duplicates", one)
    before = one.collect()
    label = brute_components([x.text for x in before])
    kept = two.collect()
    assert len(kept) == len(set(label)) and two.columns == p.COLUMNS
    groups = {}
    for x, l in zip(before, label, strict=True):
        groups.setdefault(l, []).append(x)
    texts = {(x.doc_id, x.text) for x in kept}
    for group in groups.values():
        least = min((x.doc_id for x in group if x.doc_id is not None), default=None)
        assert len({(x.doc_id, x.text) for x in group} & texts) == 1 and any(x.doc_id == least and (x.doc_id, x.text) in texts for x in group)

    three = through("decontamination", two)
    got = {(x.doc_id, x.source): x for x in three.collect()}
    item = decontaminate.words_of(ITEM.encode())
    for x in kept:
        w = decontaminate.words_of(x.text.encode())
        hits = sum(w[i : i + len(item)] == item for i in range(len(w)))
        if not hits:
            assert got[x.doc_id, x.source].text == x.text
        elif len(item) * hits > len(w) / 2:
            assert (x.doc_id, x.source) not in got
        else:
            y = got[x.doc_id, x.source]
            assert ITEM not in y.text and y.n_chars == len(y.text) and len(words(y.text)) == len(words(x.text)) - len(item)
    assert (221, "web") not in got and (220, "web") in got

    four = through("pii", three)
    trees, limits = pii.model()
    for x in four.collect():
        was = got[x.doc_id, x.source].text
        base, added = pii.all_spans([was], trees, limits)[0]
        spans = sorted((a, b, k) for found in (base, added) for k in found for a, b in found[k])
        want, at = "", 0
        for a, b, k in spans:
            want, at = want + was[at:a] + f"[{k.upper()}]", b
        assert x.text == want + was[at:] and x.n_chars == len(x.text)
    assert any("[EMAIL]" in x.text for x in four.collect()) and any("[PHONE]" in x.text for x in four.collect())

    five = through("mixing", four).collect()
    known = {(x.doc_id, x.text) for x in four.collect()}
    taken, sizes = {}, {}
    for x in four.collect():
        sizes[x.source] = sizes.get(x.source, 0) + len(words(x.text))
    for x in five:
        assert (x.doc_id, x.text) in known and 1 <= x.copies <= 3 and x.taken == x.copies * len(words(x.text)) and x.source_size == sizes[x.source]
        taken[x.source] = taken.get(x.source, 0) + x.taken
    for x in {x.source: x for x in five}.values():
        # copies are whole: a source of one long document can't come nearer than half of it
        least = min(len(words(y.text)) for y in four.collect() if y.source == x.source)
        assert abs(taken[x.source] - x.target) <= max(20, 0.02 * x.target, least / 2)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_run(spark, rows, folder):
    import corpus_pipeline as p

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "777")
    out = p.run(spark, folder)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "777"
    assert out.count() > 50 and set(p.COLUMNS) <= set(out.columns)
    home = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    assert [os.listdir(f"{home}/{d}") for d in os.listdir(home) if d.startswith("pipeline-")] == [["4-mixing"]]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
