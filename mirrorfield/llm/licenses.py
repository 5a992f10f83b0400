"""License scan: a trained paragraph classifier, confirmed by templates. DataFrame expressions only.

A paragraph is a line, or the lines up to REACH before and after one as far as no blank line parts them, so that a notice
that is wrapped over lines, in comment signs or not, is one paragraph. Its sparse features are those word one-, two-
and three-grams that templates have; a multinomial logistic regression over the families and "unknown" gives each family
a logit, calibrated by a temperature that is fitted on templates which the fit before it has not seen. What the model
calls a family with enough probability is compared with the templates: the paragraph must have enough of the two-grams
of one of that family's, and of no other family's template more.

The unknown class is a bounded sample of the documents' own lines, broken-off pieces of templates, and notices of names
that are no license. Only lines with a telling word are looked at: any paragraph with enough of a template has one.
"""

from __future__ import annotations

import random
import re
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from mirrorfield.llm.common import KEY, checkpointed, keyed, table

# Names and notices of public licenses.
NAMES = {
    "MIT": ("MIT License", "Expat License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3 license"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2 license"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3"),
    "LGPL": ("GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU LGPL v3"),
    "BSD": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "New BSD License"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0"),
    "ISC": ("ISC License",),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v. 2.0"),
    "CC-BY": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0": ("CC0 1.0 Universal", "Creative Commons Zero 1.0 Universal"),
}
FRAMES = ("licensed under {}", "released under {}", "distributed under {}", "this project is licensed under the terms of {}", "this work is licensed under {}", "this software is made available under {}", "use of this source code is governed by {}")
TEXTS = {
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "GPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
}
UNKNOWN = "unknown"
#: At most so many documents, those with the lowest hash of their id, and lines of each, stand for the unknown class.
SAMPLE_DOCS, SAMPLE_LINES = 300, 10
PROBABILITY, SIMILARITY = 0.5, 0.6
#: Lines before and after a line with a telling word that belong to its paragraph.
REACH = 7
_SPLIT = r"[^a-z0-9.]+|\.(?![0-9])"
#: Words that tell no license.
_PLAIN = frozenset("a all an and any are as at be by can copy following for form free from if in is it its law made may new not of on one or other out person purpose that the this to under use used version with without work you 1.0 2 2.0 2.1 3 4.0".split())


def words_of(line: str) -> list[str]:
    return [w for w in re.split(_SPLIT, line.lower()) if w]


def grams(words: list[str], most: int = 3) -> list[str]:
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def two_grams(words: list[str]) -> set[str]:
    return {g for g in grams(words, 2) if " " in g}


def templates() -> list[tuple[str, list[str], bool]]:
    """(family, words, title): notices in every frame, texts, and names, which count as titles only if they are a whole line."""
    out = []
    for family, names in NAMES.items():
        for name in names:
            named = name if name.startswith("CC ") else "the " + name
            out += [(family, words_of(frame.format(named)), False) for frame in FRAMES]
            if len(words_of(name)) > 1:
                out.append((family, words_of(name), True))
        out += [(family, words_of(text), False) for text in TEXTS.get(family, ())]
    return out


def telling_words(most: float = SIMILARITY) -> list[str]:
    """Words of which any paragraph with a share most of a template's two-grams has one: the fewest, by greedy choice."""
    open_ = [(two_grams(words), words, 1.0 if title else most) for _, words, title in templates()]
    out: list[str] = []
    while True:
        left = [(g, words) for g, words, share in open_ if sum(not set(x.split(" ")) & set(out) for x in g) >= share * len(g)]
        if not left:
            return sorted(out)
        count = {w: sum(w in words for _, words in left) for w in {w for _, words in left for w in words} - _PLAIN - set(out)}
        out.append(max(sorted(count), key=count.get))


class Classifier:
    """Features, their weights by family, biases and the temperature."""

    def __init__(self, background: list[str], seed: int = 5):
        rng = random.Random(seed)
        self.families = [UNKNOWN, *NAMES]
        every = templates()
        self.features = sorted({g for _, words, _ in every for g in grams(words)})
        number = {g: i for i, g in enumerate(self.features)}
        plain = [words_of(line) for line in background]
        plain = [w for w in plain if all(len(two_grams(w) & two_grams(t)) < 0.4 * len(two_grams(t)) for _, t, _ in every)]
        names = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(40)]
        rows: list[tuple[int, int, list[str]]] = [(0, i % 4, w) for i, w in enumerate(plain)]
        for i in range(400):
            _, words, _ = rng.choice(every)
            size = max(1, int(0.35 * len(words)))
            at = rng.randrange(len(words) - size + 1)
            odd = words_of(rng.choice(FRAMES).format(rng.choice(["the {} license", "the {} agreement", "{} license version 2.0", "the terms of {}"]).format(rng.choice(names))))
            piece = words[at : at + size]
            rows.append((0, i % 4, piece if i % 2 and not any(t and set(grams(w, 9)) & set(grams(piece, 9)) >= {" ".join(w)} for _, w, t in every) else odd))
        for i, (family, words, title) in enumerate(every):
            k = self.families.index(family)
            for copy in range(6):
                some = [w for w in words if title or copy == 0 or rng.random() > 0.08]
                around = rng.choice(plain) if plain and copy > 2 and not title else []
                rows.append((k, i % 4, some + around[:12] if copy % 2 else around[:12] + some))
        x = np.zeros((len(rows), len(number)), np.float32)
        for i, (_, _, words) in enumerate(rows):
            x[i, [number[g] for g in grams(words) if g in number]] = 1
        y, fold = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        logits = np.zeros((len(rows), len(self.families)))
        for k in range(4):
            w, b = self._fit(x[fold != k], y[fold != k])
            logits[fold == k] = x[fold == k] @ w + b

        def loss(t: float) -> float:
            z = logits / t
            z = z - z.max(1, keepdims=True)
            return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).sum())

        self.temperature = min((0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0), key=loss)
        self.weights, self.bias = self._fit(x, y)

    def _fit(self, x: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.3, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
        truth = np.eye(len(self.families), dtype=np.float32)[y]
        w, b = np.zeros((x.shape[1], truth.shape[1]), np.float32), np.zeros(truth.shape[1], np.float32)
        s_w, s_b = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
        for _ in range(steps):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            error = p / p.sum(1, keepdims=True) - truth
            d_w, d_b = x.T @ error / len(y) + l2 * w / 100, error.mean(0)
            s_w += d_w**2
            s_b += d_b**2
            w -= rate * d_w / np.sqrt(s_w)
            b -= rate * d_b / np.sqrt(s_b)
        return w, b


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES) -> Classifier:
    """The unknown class is what lines of sampled documents say; lines with 0.4 of a template's two-grams are left out."""
    # a share that holds about four times sample_docs of the lowest hashes, so that tasks don't each send sample_docs texts
    share = 4.0 * sample_docs / max(1, docs.count())
    if share < 1:
        docs = docs.where(F.coalesce(F.xxhash64("doc_id"), F.lit(0)) < int((2 * share - 1) * (1 << 63)))
    rows = docs.select("doc_id", F.slice(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), 1, lines).alias("lines"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "lines").limit(sample_docs)
    return Classifier([line for r in rows.collect() for line in r.lines])


def _grams(words: Column, most: int = 3) -> Column:
    def sized(n: int) -> Column:
        listed = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]))
        return F.when(F.size(words) >= n, listed).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[sized(n) for n in range(1, most + 1)]))


def _paragraphs(texts: DataFrame, telling: list[str]) -> DataFrame:
    """(*KEY, line, words): each line with a telling word, and the paragraph around it if that is longer."""
    lines = F.transform(F.split("lower", "\n"), lambda x: F.filter(F.split(x, _SPLIT), lambda w: w != ""))
    split = texts.select(*KEY, lines.alias("lines"))
    told = F.transform("lines", lambda ws, i: F.when(F.arrays_overlap(ws, F.array(*map(F.lit, telling))), i))
    none = F.array().cast("array<string>")

    def side(near: Column, join) -> Column:
        """The words of the lines, the nearest first, up to a blank one."""
        start = F.struct(F.lit(True).alias("go"), none.alias("words"))
        step = lambda a, x: F.struct((a["go"] & (F.size(x) > 0)).alias("go"), F.when(a["go"] & (F.size(x) > 0), join(a["words"], x)).otherwise(a["words"]).alias("words"))
        return F.aggregate(near, start, step)["words"]

    def paragraph(i: Column) -> Column:
        first = F.greatest(i - REACH, F.lit(0))
        before = side(F.reverse(F.slice("lines", first + 1, i - first)), lambda a, x: F.concat(x, a))
        return F.concat(before, F.get("lines", i), side(F.slice("lines", i + 2, REACH), lambda a, x: F.concat(a, x)))

    both = F.transform(F.filter(told, lambda i: i.isNotNull()), lambda i: F.struct(i.alias("line"), F.array_distinct(F.array(F.get("lines", i), paragraph(i))).alias("w")))
    each = split.select(*KEY, F.explode_outer(both).alias("p")).where("p is not null").select(*KEY, "p.line", F.explode("p.w").alias("words"))
    return each.withColumn("_row", F.monotonically_increasing_id())


def notices(docs: DataFrame, model: Classifier, probability: float = PROBABILITY, similarity: float = SIMILARITY) -> DataFrame:
    """(*KEY, line, family, probability, similarity) of each paragraph that the model and a template call a license's; line is one with a telling word."""
    telling = telling_words(similarity)
    # as a string anywhere: a text without has no telling word
    near = reduce(lambda a, b: a | b, [F.contains("lower", F.lit(w)) for w in _stems(telling)], F.lit(False))
    texts = keyed(docs).select(*KEY, F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("lower")).where(near)
    words = _paragraphs(texts, telling)
    every, n = templates(), len(model.families)
    of: dict[str, list[int]] = {}
    for t, (_, w, _) in enumerate(every):
        for g in two_grams(w):
            of.setdefault(g, []).append(t)
    # a few thousand rows of templates' n-grams, whatever the documents
    weights = docs.sparkSession.createDataFrame([(g, [float(x) for x in w], of.get(g, [])) for g, w in zip(model.features, model.weights)], "gram string, w array<double>, of array<int>")
    featured = words.select("_row", *KEY, "line", F.size("words").alias("n"), F.explode_outer(_grams(F.col("words"))).alias("gram"))
    sums = featured.join(F.broadcast(weights), "gram").groupBy("_row", *KEY, "line", "n").agg(F.array(*[F.sum(F.get("w", F.lit(c))) for c in range(n)]).alias("logits"), F.flatten(F.collect_list("of")).alias("hits"))
    scaled = sums.withColumn("z", F.zip_with("logits", F.array(*[F.lit(float(b)) for b in model.bias]), lambda a, b: (a + b) / float(model.temperature)))
    exps = scaled.withColumn("e", F.transform("z", lambda z: F.exp(z - F.array_max("z")))).withColumn("all", F.aggregate("e", F.lit(0.0), lambda a, b: a + b))
    best = F.array_max(F.zip_with("e", F.array(*[F.lit(f) for f in model.families]), lambda p, f: F.struct((p / F.col("all")).alias("probability"), f.alias("family"))))
    judged = exps.select(*KEY, "line", "n", "hits", best.alias("best")).where((F.col("best.family") != UNKNOWN) & (F.col("best.probability") >= probability))

    def share(t: int) -> Column:
        _, w, title = every[t]
        part = F.size(F.filter("hits", lambda h: h == t)) / F.lit(float(len(two_grams(w))))
        return F.when((F.col("n") == len(w)) & (part >= 1), part).otherwise(0.0) if title else part

    by_family = [F.greatest(F.lit(0.0), *[share(t) for t, (f, _, _) in enumerate(every) if f == family]).alias(family) for family in NAMES]
    judged = judged.withColumn("shares", F.struct(*by_family))
    own = reduce(lambda a, f: F.when(F.col("best.family") == f, F.col(f"shares.`{f}`")).otherwise(a), NAMES, F.lit(0.0))
    judged = judged.withColumn("similarity", own).where((F.col("similarity") >= similarity) & (F.col("similarity") >= F.greatest(*[F.col(f"shares.`{f}`") for f in NAMES])))
    return judged.select(*KEY, "line", "best.family", F.round("best.probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"))


def scan(docs: DataFrame, model: Classifier, **options) -> DataFrame:
    """(doc_id, licenses, notices) for each row: the families found, ascending, and the number of notices.

    Lines of a family of which each is within REACH of the next are one notice. Null and empty texts have none. Rows that share an id are
    judged apart; a null doc_id is an id like others. Other columns are ignored; no rows give no rows.
    """
    found = checkpointed(notices(docs, model, **options).select(*KEY, "family", "line").distinct())
    apart = F.col("line") - F.lag("line").over(Window.partitionBy(*KEY, "family").orderBy("line")) <= REACH
    found = found.withColumn("new", F.when(apart, 0).otherwise(1)).groupBy(*KEY).agg(F.sort_array(F.collect_set("family")).alias("licenses"), F.sum("new").alias("notices"))
    rows = keyed(docs).select("doc_id", *KEY).join(found, [*KEY], "left")
    return rows.select("doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("notices", F.lit(0)).alias("notices"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))


def _stems(words: list[str]) -> list[str]:
    """Strings of which every word holds one: a text without any of them has none of the words."""
    out: list[str] = []
    for w in sorted(words, key=len):
        if not any(s in w for s in out):
            out.append(w)
    return out
