"""Licences of files: sparse TF-IDF cosine to templates, and inheritance from the nearest directory."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.common import cut
from srcatlas.llm.decontaminate import words_of

# Statements by which files and licence files name their licence; a licence may have several. The wording is the licences' own.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-Proprietary", "All rights reserved."),
]
#: What an identifier's tag starts with; of such a template every word must stand in the window, as identifiers differ by little.
TAG = "SPDX-License-Identifier:"
TEMPLATES += [(name, f"{TAG} {tag}") for name in dict.fromkeys(n for n, _ in TEMPLATES) for tag in ((f"{name}-only", f"{name}-or-later", name) if "GPL" in name else (name,))]
_LINE = re.compile(rb"[^\n]+")
#: A file of such a name is a licence file however much of it the statement is.
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|unlicense)([._-].*)?$"


def frequencies(files: DataFrame, vocabulary: set[bytes], text: str = "text") -> tuple[int, dict[bytes, int]]:
    """The number of files, and in how many each word of the (bounded) vocabulary occurs. All files count."""

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                found.update(vocabulary.intersection(words_of(t.as_py())))
                found[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    sums = {bytes(r["word"]): r["n"] for r in files.select(F.col(text).cast("binary")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return sums.pop(b"", 0), sums


class Matcher:
    """Unit TF-IDF vectors of the templates, and the best window of lines of a text."""

    def __init__(self, templates: list[tuple[str, str]], files: int, df: dict[bytes, int], threshold: float = 0.0):
        counts = [(name, text.startswith(TAG), Counter(words_of(text.encode()))) for name, text in templates]
        self.threshold = threshold
        self.idf = {w: math.log((1 + files) / (1 + df.get(w, 0))) + 1 for *_, c in counts for w in c}
        #: Of words that no template has.
        self.other = sum(self.idf.values()) / max(1, len(self.idf))
        self.templates = []
        for name, whole, c in counts:
            v = {w: n * self.idf[w] for w, n in c.items()}
            size = math.sqrt(sum(x * x for x in v.values()))
            self.templates.append((name, whole, {w: x / size for w, x in v.items()}))
        #: By word its inner product with each template, and the share of each template's squared length.
        self.weights = {w: np.array([v.get(w, 0.0) * self.idf[w] for *_, v in self.templates]) for w in self.idf}
        self.shares = {w: np.array([v.get(w, 0.0) ** 2 for *_, v in self.templates]) for w in self.idf}
        #: No window of more words than that is nearer to a template than a part of it.
        self.longest = 2 * max((c.total() for *_, c in counts), default=0)

    def best(self, text: bytes | None) -> tuple[float, str | None, float]:
        """Cosine, licence and share of the text's words of the best window; 0 if none can reach the threshold.

        A text whose words hold too little of every template's length can't reach it, which
        settles most texts. Inner products with the templates add up over a window's lines,
        and its squared length is at least the sum of theirs, so their quotient bounds its
        cosines. Windows are looked at from the largest bound down, until no bound exceeds
        the best cosine; so none is missed. A window begins with a line that has a word of
        a template, and ends before it has more words than twice the longest template, its
        first line apart. Of equals the first met counts.
        """
        none: tuple[float, str | None, float] = (0.0, None, 0.0)
        words = words_of(text)
        present = self.idf.keys() & set(words)
        if not present:
            return none
        able = np.nonzero(sum(self.shares[w] for w in present) >= self.threshold**2 - 1e-9)[0]
        if not len(able):
            return none
        found, n_words = none, len(words)
        lines = [words_of(m.group()) for m in _LINE.finditer(text)]
        dots, squares, known_on = np.zeros((len(lines) + 1, len(able))), np.zeros(len(lines) + 1), np.zeros(len(lines), dtype=bool)
        for i, line in enumerate(lines):
            tf = Counter(line)
            known = [w for w in tf if w in self.idf]
            known_on[i] = bool(known)
            for w in known:
                dots[i + 1] += tf[w] * self.weights[w][able]
            of_known = sum(tf[w] ** 2 for w in known)
            squares[i + 1] = sum((tf[w] * self.idf[w]) ** 2 for w in known) + (sum(n * n for n in tf.values()) - of_known) * self.other**2
        dots, squares = dots.cumsum(axis=0), squares.cumsum()
        upto = np.concatenate([[0], np.cumsum([len(line) for line in lines])])
        tried = []
        for size in range(1, len(lines) + 1):
            start = np.nonzero(known_on[: len(lines) + 1 - size] & ((upto[size:] - upto[:-size] <= self.longest) | (size == 1)))[0]
            if not len(start):
                if (upto[size:] - upto[:-size] > self.longest).all():
                    break
                continue
            bound = (dots[start + size] - dots[start]).max(axis=1) / np.sqrt(np.maximum(squares[start + size] - squares[start], 1e-12))
            tried += [(-b, size, i) for b, i in zip(bound.tolist(), start.tolist(), strict=True) if b >= self.threshold - 1e-9]
        heapq.heapify(tried)
        while tried and -tried[0][0] > found[0] + 1e-9:
            _, size, i = heapq.heappop(tried)
            found = self._better(Counter(w for line in lines[i : i + size] for w in line), n_words, able, found)
        return found

    def _better(self, tf: Counter, n_words: int, able: np.ndarray, found: tuple[float, str | None, float]) -> tuple[float, str | None, float]:
        """The larger of ``found`` and the best template for a window's words."""
        v = {w: n * self.idf[w] for w, n in tf.items() if w in self.idf}
        size = math.sqrt(sum(x * x for x in v.values()) + sum(n * n for w, n in tf.items() if w not in self.idf) * self.other**2)
        for name, whole, t in (self.templates[k] for k in able):
            cosine = sum(x * v[w] for w, x in t.items() if w in v) / size
            if cosine > found[0] + 1e-12 and (not whole or t.keys() <= v.keys()):
                found = (cosine, name, tf.total() / n_words)
        return found


def scan(files: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.85, name: str = "own") -> DataFrame:
    """``files`` with a struct: the best template's licence (null below ``threshold``), cosine (see Matcher.best), and coverage of the text."""
    vocabulary = {w for _, t in templates for w in words_of(t.encode())}
    matcher = Matcher(templates, *frequencies(files, vocabulary, text), threshold)

    @F.arrow_udf("struct<license: string, cosine: double, coverage: double>")
    def udf(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            cosine, license_, coverage = matcher.best(t.as_py())
            out.append({"license": license_ if cosine >= threshold else None, "cosine": min(1.0, cosine), "coverage": coverage})
        return pa.array(out, pa.struct([("license", pa.string()), ("cosine", pa.float64()), ("coverage", pa.float64())]))

    return files.withColumn(name, udf(F.col(text).cast("binary")))


def resolve(files: DataFrame, path: str = "path", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.85, coverage: float = 0.5) -> DataFrame:
    """``files`` without their text, with own (see scan), license and license_from.

    A file with a statement of its own has that licence. Others inherit from the nearest
    directory above (their own directory first) that has a licence file: one by its name
    (LICENSE_FILE), or one of whose words the statement is ``coverage`` at least; of
    several the one of largest cosine, then smallest path. license_from is the path that
    the licence comes from; both are null if there is none. Columns of these names are
    replaced; names that begin with __lic_ are taken. A file whose path is null has its
    own statement only.

    Inheritance is resolved on distinct directories, level by level from the top: a
    directory joins its own licence file and, if it has none, its parent's answer. So no
    directory is a key for all that lie below it. Files then join their directory's
    answer, both sides as plain shuffles, so a directory of very many files can be split.
    """
    files = files.drop("own", "license", "license_from")
    keep = [c for c in files.columns if c != text]
    folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    scanned = cut(scan(files, text, templates, threshold, "own").select(*keep, "own").withColumn("__lic_dir", folder(F.col(path))))
    named = F.regexp_extract(F.col(path), r"[^/]*$", 0).rlike(LICENSE_FILE)
    lawful = scanned.where((F.col("own.license").isNotNull()) & ((F.col("own.coverage") >= coverage) | named) & F.col(path).isNotNull())
    best = F.min(F.struct((-F.col("own.cosine")).alias("c"), F.col(path).alias("p"), F.col("own.license").alias("l"))).alias("b")
    roots = cut(lawful.groupBy(F.col("__lic_dir").alias("d")).agg(best).select("d", F.struct(F.col("b.l").alias("l"), F.col("b.p").alias("p")).alias("near")))
    level = F.when(F.col("d") == "", 0).otherwise(F.size(F.split("d", "/")))
    # every directory and all above it, each once
    dirs = new = cut(scanned.where(F.col("__lic_dir").isNotNull()).select(F.col("__lic_dir").alias("d")).distinct())
    while not new.where("d != ''").isEmpty():
        new = cut(new.where("d != ''").select(folder(F.col("d")).alias("d")).distinct().join(dirs, "d", "left_anti"))
        dirs = dirs.union(new)
    dirs = cut(dirs.withColumn("level", level).join(roots, "d", "left"))
    done = above = cut(dirs.where("level = 0").select("d", "near"))
    for k in range(1, (dirs.agg(F.max("level").alias("m")).first()["m"] or 0) + 1):
        here = dirs.where(F.col("level") == k).withColumn("up", folder(F.col("d")))
        above = cut(here.join(above.select(F.col("d").alias("up"), F.col("near").alias("far")), "up", "left").select("d", F.coalesce("near", "far").alias("near")))
        done = done.union(above)
    answers = cut(done.where("near IS NOT NULL")).select(F.col("d").alias("__lic_dir"), F.col("near").alias("__lic_near"))
    out = scanned.join(answers, "__lic_dir", "left")
    own = F.col("own.license").isNotNull()
    return out.withColumn("license", F.coalesce("own.license", "__lic_near.l")).withColumn("license_from", F.when(own, F.col(path)).otherwise(F.col("__lic_near.p"))).select(*keep, "own", "license", "license_from")
