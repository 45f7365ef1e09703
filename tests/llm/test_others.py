"""Toxicity, licences and vector search."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcatlas.llm import licenses, toxicity, vptree


def test_toxicity(spark):
    r = random.Random(9)
    words, bad = [f"w{i}" for i in range(200)], ["scum", "idiot", "trash", "loser"]
    rows = []
    for i in range(900):
        toxic = i % 6 == 0
        text = [r.choice(words) for _ in range(30)] + ([w.upper() + "!" for w in r.sample(bad, r.randint(1, 4))] if toxic else [])
        r.shuffle(text)
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(2000, None), (2001, ""), (2002, "you idiot scum " + "w1 " * 20_000), (0, rows[0][1])], "doc_id long, text string")
    grades = spark.createDataFrame([(i, g) for i, _, g in rows if i < 600] + [(None, 1), (3000, 1), (5, None)], "doc_id long, grade int")
    model = toxicity.train(docs, grades)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 3
    got = {x.doc_id: x.toxicity for x in toxicity.rate(docs, model).collect()}
    held = [(g, got[i].toxic) for i, _, g in rows if i >= 600]
    assert sum(a == b for a, b in held) / len(held) > 0.97 and not any(b and not a for a, b in held)
    assert not got[2000].toxic and got[2000].severity == got[2001].severity and got[2002].toxic
    one, all_four = (toxicity.rate(spark.createDataFrame([(t,)], "text string"), model).first().toxicity for t in ("scum", "scum idiot trash loser"))
    assert one.severity < all_four.severity and all_four.grade > one.grade
    none = toxicity.train(docs, grades.where("false"))
    assert not any(x.toxicity.toxic for x in toxicity.rate(docs, none).collect())


def test_ordinal_fit_is_the_optimum():
    """At the fit the gradient vanishes, thresholds are ordered, and plain gradient descent comes to the same loss."""
    g = np.random.default_rng(5)
    for top in (1, 2, 3):
        x = (g.random((400, 6)) < 0.3).astype(float)
        z = x @ g.normal(size=6) * 2 + g.logistic(size=400)
        y = np.searchsorted(np.quantile(z, np.arange(1, top + 1) / (top + 1.5)), z)
        w, theta = toxicity.fit_ordinal(x, y, top, 0.1, 200)
        assert (np.diff(theta) > 0).all()
        at = np.concatenate([w, theta])
        loss = lambda v, x=x, y=y: toxicity.ordinal_loss(x, y, v[:6], v[6:], 0.1)
        slope = lambda v: np.array([(loss(v + e) - loss(v - e)) / 2e-5 for e in np.eye(len(v)) * 1e-5])  # noqa: E731, B023
        assert np.abs(slope(at)).max() < 0.05
        v = np.concatenate([np.zeros(6), np.linspace(-1, 1, top) if top > 1 else [0.0]])
        rate = 0.01
        for _ in range(1500):
            new = v - rate * slope(v)
            if (np.diff(new[6:]) > 0).all() and loss(new) <= loss(v):
                v, rate = new, rate * 1.1
            else:
                rate /= 2
        assert abs(loss(v) - loss(at)) < 1e-3 * loss(at) and np.abs(v - at).max() < 0.05


def test_graded_labels_are_taken_as_they_are(spark):
    rows = [(i, " ".join(["plain", "words", *["mild"] * (i % 4 == 1), *["gross"] * (i % 4 == 2), f"w{i}"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 4 % 3).cast("int").alias("grade")), distinct=1.0)
    got = {t: toxicity.rate(spark.createDataFrame([(t,)], "text string"), model).first().toxicity for t in ("plain words", "plain mild", "plain gross")}
    assert [x.grade for x in got.values()] == [0, 1, 2] and got["plain words"].severity < got["plain mild"].severity < got["plain gross"].severity
    assert toxicity.rate(docs.where("false"), model).count() == 0


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License,\n# Version 2.0."
    files = [
        ("p/LICENSE", mit), ("p/a/b/x.py", "code here\nmore code"), ("p/a/LICENSE", "# " + apache), ("p/a/b/own.py", "/* This work is licensed under the GNU General Public License, version 3. */\n" + "code " * 500),
        ("p/y.py", "code"), ("q/z.py", "code"), ("q/z.py", "code"), (None, mit), ("p/empty.py", ""), ("p/null.py", None), ("top.py", "x"),
    ]
    got = {r.path: r for r in licenses.resolve(spark.createDataFrame([(p, t, "clash") for p, t in files], "path string, text string, license string")).collect()}
    assert got["p/LICENSE"].own.license == "MIT" and got["p/a/LICENSE"].own.license == "Apache-2.0"
    assert (got["p/a/b/x.py"].license, got["p/a/b/x.py"].license_from) == ("Apache-2.0", "p/a/LICENSE")
    assert (got["p/a/b/own.py"].license, got["p/a/b/own.py"].license_from) == ("GPL-3.0", "p/a/b/own.py")
    assert got["p/y.py"].license == got["p/empty.py"].license == got["p/null.py"].license == "MIT"
    assert got["q/z.py"].license is None and got["top.py"].license is None and got[None].license == "MIT"
    assert licenses.resolve(spark.createDataFrame([], "path string, text string")).count() == 0


def test_best_window_against_all_windows():
    r = random.Random(10)
    words = "licensed under the mit apache license version foo bar baz".split()
    m = licenses.Matcher([("A", "licensed under the apache license version"), ("B", "under the mit license")], 100, {b"the": 90})
    for _ in range(60):
        lines = [" ".join(r.choice(words) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 7))]
        cosine, _, _ = m.best("\n".join(lines).encode())
        best = 0.0
        for i in range(len(lines)):
            if m.idf.keys().isdisjoint(lines[i].encode().split()):
                continue
            for j in range(i + 1, len(lines) + 1):
                if j > i + 1 and sum(len(x.split()) for x in lines[i:j]) > m.longest:
                    break
                tf = licenses.Counter(licenses.words_of(" ".join(lines[i:j]).encode()))
                v = {w: n * m.idf.get(w, m.other) for w, n in tf.items()}
                size = sum(x * x for x in v.values()) ** 0.5
                best = max([best, *(sum(x * v.get(w, 0) for w, x in t.items()) / size for *_, t in m.templates)])
        assert abs(cosine - best) < 1e-9


def test_real_licences():
    """Tags, notices wrapped in comments, and whole licence texts as they are shipped."""
    m = licenses.Matcher(licenses.TEMPLATES, 10_000, {b"the": 9000, b"of": 9000, b"and": 9000, b"to": 9000, b"a": 9000, b"this": 5000, b"is": 8000}, 0.85)
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY.\nimport os\n"
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and "restriction" in t)
    wrapped = "Copyright (c) 2020 Someone\n\n" + "\n".join(" ".join(mit.split()[i : i + 4]) for i in range(0, len(mit.split()), 4))
    for text, want in (("// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("# SPDX-License-Identifier: GPL-3.0-or-later\n", "GPL-3.0"), ("# SPDX-License-Identifier: BSD-4-Clause\n", None), ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), (gpl, "GPL-3.0"), (gpl.replace("GNU General", "GNU Affero General"), "AGPL-3.0"), (wrapped, "MIT"), ("plain words of the public", None)):
        assert m.best(text.encode())[1] == want, text
    for name, want in {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}.items():
        at = f"/usr/share/common-licenses/{name}"
        if os.path.exists(at):
            with open(at, "rb") as f:
                assert m.best(f.read())[1] == want, name


def test_inheritance_against_brute_force(spark):
    r = random.Random(13)
    names = ["a", "b", "c"]
    files = {}
    for i in range(150):
        at = "/".join(r.choice(names) for _ in range(r.randrange(6)))
        kind = r.choice(["LICENSE", "COPYING.txt", f"f{i}.py", f"g{i}.py", f"h{i}.py"])
        text = r.choice([t for _, t in licenses.TEMPLATES[:1] + licenses.TEMPLATES[4:5] + licenses.TEMPLATES[11:12]]) if "." not in kind or kind.startswith(("COPY", "f")) and r.random() < 0.3 else "code only"
        files[f"{at}/{kind}".lstrip("/")] = text + ("\n" + "code more words here " * 30 if r.random() < 0.5 else "")
    df = spark.createDataFrame([(p, t, "x", 1) for p, t in files.items()], "path string, text string, __dir string, d int")
    got = {x.path: x for x in licenses.resolve(df).collect()}
    assert got.keys() == files.keys() and next(iter(got.values()))["__dir"] == "x"
    law = {}
    for p, x in got.items():
        name = p.rsplit("/", 1)[-1]
        if x.own.license and (x.own.coverage >= 0.5 or name in ("LICENSE", "COPYING.txt")):
            law.setdefault(p.rpartition("/")[0], []).append((-x.own.cosine, p, x.own.license))
    inherited = 0
    for p, x in got.items():
        at, want = p.rpartition("/")[0], (x.own.license, p if x.own.license else None)
        while want[0] is None:
            if at in law:
                want = min(law[at])[:0:-1]
                inherited += 1
            if not at:
                break
            at = at.rpartition("/")[0]
        assert (x.license, x.license_from) == tuple(want), p
    assert inherited > 10


@pytest.mark.parametrize("factor", [1.0, 1.15])
def test_nearest(spark, factor, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 8)
    g = np.random.default_rng(11)
    centres = g.normal(size=(8, 16))
    x = (centres[g.integers(0, 8, 400)] + 0.4 * g.normal(size=(400, 16))).astype(np.float32)
    x[50:150] = x[50]  # copies
    x[200] = x[200] * 7
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(1000, None, "c"), (1050, [0.0] * 16, "c"), (1100, [float("nan")] * 16, "c"), (1150, [1.0, None] * 8, "c"), (None, x[0].tolist(), "c"), (1200, [float("inf")] * 16, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in vptree.search(df, df.where("vec_id % 50 = 0"), factor=factor, shards=3, query_rows=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    d = x.astype(float)
    n = np.sqrt((d * d).sum(1))
    hit = 0
    for q in range(0, 400, 50):
        s = (d * d[q]).sum(1) / (n * n[q])
        want = [i for i in sorted(range(400), key=lambda i: (-round(s[i], 12), i)) if i != q][:5]
        hit += len({i for i, _ in got[q]} & set(want))
        if factor == 1.0:
            assert [i for i, _ in got[q]] == want and np.allclose([v for _, v in got[q]], s[want], atol=1e-15)
    assert hit >= 0.9 * 40 and set(got) == set(range(0, 400, 50))
    few = df.where("vec_id < 3")
    assert vptree.search(few, few.where("vec_id = 0")).count() == 2
    assert vptree.search(df.where("false"), df.where("false")).count() == 0


def test_shards_depend_on_the_rows_alone():
    assert [vptree.shards_for(n) for n in (0, 1, 4_001, 10**6, 10**7, 10**9)] == [1, 1, 2, 64, 100, 10_000]


def test_rows_of_one_id(spark):
    """Of rows of one id the first by components counts; vectors of other lengths are searched on their own."""
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [-1.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for some in (df, df.orderBy("vec_id", F.desc("embedding"))):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vptree.search(some, some.where("vec_id IN (0, 3)"), factor=1.0, shards=4).collect()}
        assert {key: i for key, (i, _) in got.items()} == {(0, 1): 2, (0, 2): 1, (3, 1): 4} and got[0, 2][1] == -1.0


def test_recall_on_the_table(spark):
    """The production factor finds at least nine of ten true neighbours."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    asked = e.where("vec_id % 50 = 0")
    near, exact = (set(map(tuple, vptree.search(e, asked, factor=f).select("query_id", "vec_id").collect())) for f in (1.15, 1.0))
    d = np.array([r.embedding for r in e.orderBy("vec_id").collect()], dtype=float)
    n = np.sqrt((d * d).sum(1))
    want = {(q, i) for q in range(0, len(d), 50) for i in [i for i in np.argsort(-(d @ d[q]) / (n * n[q]), kind="stable") if i != q][:5]}
    assert exact == want and len(near & want) >= 0.9 * len(want)
