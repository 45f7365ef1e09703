import random

from srcatlas.llm import decontaminate as d


def brute(words, items, window=8):
    hit, found = set(), set()
    for item, ws in items:
        n = min(window, len(ws))
        if not n:
            continue
        windows = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                found.add(item)
                hit.update(range(i, i + n))
    return hit, found


def test_automaton_against_brute_force():
    r = random.Random(5)
    for _ in range(800):
        k, window = r.choice([1, 2, 3]), r.choice([2, 3, 8])
        items = [(str(j), [b"%d" % r.randrange(k) for _ in range(r.randrange(14))]) for j in range(r.randrange(1, 7))]
        a = d.Automaton(items, window)
        words = [b"%d" % r.randrange(k + 1) for _ in range(r.randrange(40))]
        starts, ends, found = a.match(words)
        hit, want = brute(words, items, window)
        assert {i for s, e in zip(starts, ends, strict=True) for i in range(s, e)} == hit and found == want


def test_words():
    assert d.words_of("Ab-9 Éx_y\u00a0z\n".encode()) == [b"ab", b"9", "Éx".encode(), "y\u00a0z".encode()]
    assert d.words_of(None) == d.words_of(b"") == []


def frames(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(words[:12])), (2, " ".join(words[5:20])), (3, "short one"), (None, " ".join(words[20:29])), (4, None), (5, "..."), (1, "again, twice")]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(20))) + " " + " ".join(words[a : a + r.randrange(5, 16)]) + "!", "x") for i, a in enumerate(r.randrange(20) for _ in range(60))]
    docs += [(90, None, "x"), (91, "", "x"), (92, "a SHORT, one b", "x"), (92, "a SHORT, one b", "x"), (None, " ".join(words[:12]), "x"), (93, "x " * 50_000 + " ".join(words[:12]), "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_matches(spark):
    docs, items, rows, listed = frames(spark)
    parsed = [(None if i is None else str(i), d.words_of((t or "").encode())) for i, t in listed]
    want = []
    for i, t, _ in rows:
        words = d.words_of((t or "").encode())
        hit, found = brute(words, parsed)
        want.append((str(i), len(words), len(hit), sorted(x for x in found if x)))
    for most in (8_000_000, 60):  # one automaton, and several
        got = d.matches(docs, items, most_chars=most).select("doc_id", "match.*", d.hit_words(d.F.col("match")).alias("n_hit")).collect()
        assert sorted((str(g.doc_id), g.n_words, g.n_hit, g["items"]) for g in got) == sorted(want), most
    assert d.matches(docs.where("false"), items).count() == 0
    assert all(g.match["items"] == [] for g in d.matches(docs, items.where("false")).collect())


def test_clean(spark):
    docs, items, rows, _ = frames(spark)
    passage = " ".join(f"w{i}" for i in range(12))
    few = spark.createDataFrame([(1, f"keep all this, please. {passage}! And much of the rest, as it is clean.", "q"), (2, passage, "q"), (3, None, "q"), (4, "clean", "q"), (5, "", "q")], "doc_id long, text string, item_id string")
    got = {r.doc_id: r.text for r in d.clean(few, items).collect()}
    assert got == {1: "keep all this, please. ! And much of the rest, as it is clean.", 3: None, 4: "clean", 5: ""}
    left = d.matches(d.clean(docs, items), items).select("match.*").collect()
    assert all(e - s < 8 for r in left for s, e in zip(r.starts, r.ends, strict=True)) or len(left) < len(rows)


def test_clean_cuts_whole_short_items_and_items_without_an_id(spark):
    items = spark.createDataFrame([(1, "what is the capital of Peru"), (None, "name all nine of the known planets in order of size")], "item_id long, text string")
    text = "Some talk before. What is the capital of Peru? And some more talk that goes on behind it for a while"
    other = "As they say: name all nine of the known planets in order of size, and then they go on with many other words of their own"
    docs = spark.createDataFrame([(1, text), (2, other), (3, "what is the capital of France and who lives there")], "doc_id long, text string")
    for most in (2_000_000, 40):
        got = {r.doc_id: r.text for r in d.clean(docs, items, most_chars=most).collect()}
        assert got == {1: text.replace("What is the capital of Peru", ""), 2: other.replace("name all nine of the known planets in order of size", ""), 3: "what is the capital of France and who lives there"}, most
