"""Licence scans: a trained classifier of paragraphs.

Paragraphs are lines of the text, and blocks of lines between blank lines, joined by spaces, for notices
that are wrapped.  A block gives a row, with the number of its first line, if its family is confirmed and
none of its lines alone confirms that family; its lines then give no ``unknown`` rows.

Features are words and word pairs of a paragraph, each counted once.  A
softmax regression with sparse weights, fitted on the driver from the notices below and fixed
variations of them, gives each paragraph a family or ``other`` (it is no licence notice).  Its
temperature and the probability below which a notice is ``unknown`` are calibrated on variations
that the fit has not seen and on notices of families it does not know.  A family is confirmed only
if the paragraph holds enough of the word pairs of one of its notices; else it is ``unknown``.

A paragraph can be a notice if it holds one of ANCHORS, or enough of the word pairs of any notice to confirm
its family.  Before pairs are counted, texts are sorted out that cannot: of each notice so many words
(stems) and pairs (_reachable) are looked for that a text without them has too few left.  Texts are read once.  Equal paragraphs are
classified once and the result joined back, so common notices cost little.  The main path is DataFrame
functions only; weights are a small fixed table.

Cases: null and empty texts have no paragraphs; repeated rows each get their results; paragraphs
of any length are read whole; of families that are equally likely the first in the order of NOTICES
counts; other columns, whatever their names, are left out; empty tables give empty results.
"""

from __future__ import annotations

import functools
import json
import random
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import table
from .scratch import stored

#: Notices by family.
NOTICES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the Apache License, Version 2.0.",
        "This work is made available under the terms of the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GPL v2 or later license.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Distributed under the LGPL license.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": (
        "This service is licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL license.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions of the copyright holders are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the MPL 2.0 license.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "Dedicated to the public domain under the CC0 license.",
        "To the extent possible under law, the authors waive all copyright and related rights to this work under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
        "This work is made available under CC0 1.0.",
    ),
    "proprietary": (
        "Copyright by the publisher. All rights reserved.",
        "All rights reserved.",
        "No part of this publication may be copied without the written permission of the copyright holder.",
    ),
}
#: Text with the anchors' words that is no notice.
OTHERS = (
    "He lost his driving licence after the accident and now takes the bus to work.",
    "You need a fishing license to cast a line in this river during the season.",
    "The poet takes some license with the history of the town.",
    "The restaurant applied for a license to sell beer and wine on its terrace.",
    "A marriage license costs forty dollars at the county office.",
    "The pilot renewed her license last spring after a medical check.",
    "Doctors must be licensed by the state before they may treat patients.",
    "The court heard a long dispute about copyright between two novelists.",
    "Copyright law has changed a good deal since the printing press.",
    "The old house fell into the public domain of village gossip.",
    "We asked for permission to cross the field and the farmer agreed.",
    "License plates in that year were green with white letters.",
    "The agency licensed three new taxi firms in the harbour district.",
    "She was given a licence fee refund by the television office.",
    "The morning was cold and the market opened late because of the snow.",
    "They walked along the coast and talked about the coming harvest.",
    "Please read the manual before you switch on the machine.",
    "The committee will meet again on Thursday to discuss the budget.",
)
#: Notices of families that are not learned, to calibrate what is unknown.
STRANGERS = (
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the Eclipse Public License, v 2.0.",
    "This file is licensed under the Common Development and Distribution License.",
    "Released under the zlib license.",
    "Covered by the Artistic License 2.0 of the Perl community.",
    "Licensed under the European Union Public Licence.",
    "Published under the Open Data Commons Database License.",
    "Font licensed under the SIL Open Font License.",
    "Do what you want under this unusual license of ours.",
    "Use is subject to the end user license agreement of the vendor.",
)
_BEFORE = ("", "Notice: ", "Copyright (c) 2021 the contributors. ", "For reuse please note. ", "Footer of the page. ")
_AFTER = ("", " See the file for details.", " Please keep this line.", " Questions go to the editors.", " Last updated in May.")

#: A paragraph with one of these, whatever its case, is judged even if it is like no notice below.
ANCHORS = ("licens", "licenc", "copyright", "public domain", "permission is hereby", "free software", "redistribut", "rights reserved", "no part of this publication", "gnu", "gpl", "affero", "apache", "mozilla", "spdx", "cc0", "creative commons", "cc by", "cc-by")
#: Stands for a blank line; in texts it is a space.
MARK, BLANK = "\x01", "^[ \\t\\r\\f]*$"
#: Share of a notice's word pairs that confirms its family.
CONFIRMED = 0.6


def words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def features(text: str) -> set[str]:
    w = words(text)
    return {*w, *map(" ".join, zip(w, w[1:]))}


class LicenceModel:
    """Weights by feature and class (the last is ``other``), temperature and threshold."""

    def __init__(self, weights: dict[str, list[float]], bias: list[float], classes: list[str], temperature: float, threshold: float):
        self.weights, self.bias, self.classes, self.temperature, self.threshold = weights, bias, classes, temperature, threshold

    def scores(self, text: str) -> np.ndarray:
        out = np.array(self.bias)
        for f in features(text):
            if f in self.weights:
                out += self.weights[f]
        return out

    def probabilities(self, text: str) -> np.ndarray:
        z = self.scores(text) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _variations(text: str, rng: random.Random, count: int) -> list[str]:
    out = [text]
    for _ in range(count - 1):
        kept = " ".join(w for w in text.split() if rng.random() > 0.08)
        out.append(rng.choice(_BEFORE) + kept + rng.choice(_AFTER))
    return out


@functools.cache
def trained(seed: int = 1, variations: int = 24, steps: int = 400, rate: float = 2.0, sparsity: float = 2e-4, decay: float = 1e-4) -> LicenceModel:
    """Fits on len(notices) * variations texts (under two thousand); the same arguments give the same model."""
    rng = random.Random(seed)
    classes = [*NOTICES, "other"]
    fit: list[tuple[str, int]] = []
    hold: list[tuple[str, int]] = []
    for c, texts in enumerate([*NOTICES.values(), OTHERS]):
        for text in texts:
            made = _variations(text, rng, variations if c < len(NOTICES) else 6)
            cut = max(1, len(made) * 3 // 4)
            fit += [(t, c) for t in made[:cut]]
            hold += [(t, c) for t in made[cut:]]
    vocabulary = sorted({f for t, _ in fit for f in features(t)})
    index = {f: n for n, f in enumerate(vocabulary)}

    def matrix(rows: list[tuple[str, int]]) -> np.ndarray:
        x = np.zeros((len(rows), len(vocabulary)))
        for n, (t, _) in enumerate(rows):
            x[n, [index[f] for f in features(t) if f in index]] = 1
        return x

    x, y = matrix(fit), np.eye(len(classes))[[c for _, c in fit]]
    balance = (1 / y.sum(axis=0))[y.argmax(axis=1)][:, None]
    balance *= len(y) / balance.sum()
    w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - y) * balance / len(y)
        w -= rate * (x.T @ g + decay * w)
        b -= rate * g.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparsity, 0)  # proximal step of the L1 norm
    w, b = w.round(6), b.round(6)
    weights = {f: w[n].tolist() for f, n in index.items() if w[n].any()}
    model = LicenceModel(weights, b.tolist(), classes, 1.0, 0.0)
    z, truth = np.array([model.scores(t) for t, _ in hold]), np.array([c for _, c in hold])

    def loss(t: float) -> float:
        s = z / t
        return float((np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(s)), truth]).mean())

    model.temperature = min((round(0.1 * k, 1) for k in range(2, 41)), key=loss)
    sure = np.sort([model.probabilities(t)[c] for t, c in hold if c < len(NOTICES)])
    odd = np.sort([model.probabilities(t)[:-1].max() for s in STRANGERS for t in _variations(s, rng, 6)])
    model.threshold = round(max((round(0.02 * k, 2) for k in range(10, 48)), key=lambda t: (sure >= t).mean() + (odd < t).mean()), 2)
    return model


def similarity(text: str, family: str) -> float:
    """Largest share of a notice's word pairs that the text holds."""
    own = features(text)
    return max((len(p & own) / len(p) for n in NOTICES[family] if (p := {f for f in features(n) if " " in f})), default=0.0)


def classify(text: str, model: LicenceModel) -> tuple[str, float, float, bool] | None:
    """(family or ``unknown``, probability, similarity, confirmed) of one paragraph, or None: the same in plain Python."""
    if not any(a in text.lower() for a in ANCHORS) and max(similarity(text, f) for f in NOTICES) < CONFIRMED:
        return None
    p = model.probabilities(text)
    best = int(p.argmax())
    if model.classes[best] == "other":
        return None
    like = similarity(text, model.classes[best])
    sure = p[best] >= model.threshold and like >= CONFIRMED
    return model.classes[best] if sure else "unknown", float(p[best]), like, bool(sure)


def _anchored(text: Column) -> Column:
    low = F.lower(text)
    hit = low.contains(ANCHORS[0])
    for a in ANCHORS[1:]:
        hit = hit | low.contains(a)
    return hit


def required(notice: str) -> list[str]:
    """Pairs of a notice such that any text without them, and without ANCHORS, holds less than CONFIRMED of its pairs.

    Pairs with a long word are chosen, for they are rare in other texts.
    """
    anchored = lambda f: any(a in f for a in ANCHORS if " " not in a)
    pairs = sorted({f for f in features(notice) if " " in f}, key=lambda f: (not anchored(f), -max(map(len, f.split())), f))
    least = next(k for k in range(len(pairs) + 1) if k / len(pairs) >= CONFIRMED)
    return [f for f in pairs[: len(pairs) - least + 1] if not anchored(f)]


def _required() -> list[str]:
    return sorted({f for ns in NOTICES.values() for n in ns for f in required(n)})


def _reachable(text: Column) -> Column:
    """Whether a text can hold a paragraph that is judged."""
    # pairs are tried at starts of words only
    heads = _by_letter(f.replace(" ", "[^a-z0-9]+") for f in _required())
    return _anchored(text) | F.lower(text).rlike(f"(?<![a-z0-9])(?:{heads})")


@functools.cache
def stems() -> tuple[str, ...]:
    """Words, or pairs of short ones with one space, such that a text without them and without ANCHORS holds less
    than CONFIRMED of any notice's pairs.

    Each notice needs so many of its pairs to have such a word that too few are left.
    """
    taken: set[str] = set()
    covers = lambda x, f: x in f.split() if " " not in x else x == f
    for notice in sorted((n for ns in NOTICES.values() for n in ns), key=len):
        pairs = {f for f in features(notice) if " " in f}
        least = next(k for k in range(len(pairs) + 1) if k / len(pairs) >= CONFIRMED)
        left = {f for f in pairs if not any(a in f for a in ANCHORS) and not any(covers(x, f) for x in taken)}
        while len(left) >= least:
            most = lambda x: (len(x) > 6 and " " not in x, sum(covers(x, f) for f in left), len(x), x)
            taken.add(max({x for f in left for x in (f, *f.split()) if len(x) > 6 or " " in x}, key=most))
            left = {f for f in left if not any(covers(x, f) for x in taken)}
    return tuple(sorted(taken))


def _by_letter(words_: Iterable[str]) -> str:
    """A pattern for any of some words, tried by their first letters."""
    known = sorted(set(words_))
    return "|".join(f"{c}(?:{'|'.join(w[1:] for w in known if w[0] == c)})" for c in sorted({w[0] for w in known}))


def _likely(low: Column) -> Column:
    """A quick necessary test of a text in lower case."""
    return low.rlike(_by_letter((*ANCHORS, *stems())))


def _rows(spark: SparkSession, values: list, kind: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(values)), f"array<struct<{kind}>>")))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: LicenceModel | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed, notice): a row for each licence notice."""
    model, spark = model or trained(), df.sparkSession
    # a blank line becomes a mark and its number, so that blocks keep their places
    lines = F.transform(F.split(F.regexp_replace("text", MARK, " "), "\n"), lambda x, k: F.when(x.rlike(BLANK), F.concat(F.lit(MARK), k.cast("string"))).otherwise(x))
    # as a generated column the text in lower case is made once, not once for each test
    texts = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.explode(F.array(F.lower(text))).alias("low"))
    pieces = texts.where(_likely(F.col("low"))).select("doc_id", F.posexplode(F.split(F.concat(F.lit("-1\n"), F.array_join(lines, "\n")), MARK)).alias("k", "piece"))
    blocks = pieces.select("doc_id", (F.substring_index("piece", "\n", 1).cast("int") + 1).alias("start"), F.regexp_replace("piece", "^-?[0-9]+\n?|\n$", "").alias("block"))
    # the texts are read once; what is left of them is small
    low = F.explode(F.array(F.lower("block"))).alias("low")
    blocks = stored(blocks.select("*", low).where(_likely(F.col("low"))).where(_reachable(F.col("block"))).drop("low"), "licence-blocks")
    parts = blocks.select("block").distinct()
    whole = F.array(F.struct(F.lit(-1).alias("at"), F.regexp_replace(F.trim("block"), "\\s*\n\\s*", " ").alias("notice")))
    single = F.transform(F.split("block", "\n"), lambda x, k: F.struct(k.cast("int").alias("at"), x.alias("notice")))
    both = F.when(F.col("block").contains("\n"), F.concat(whole, single)).otherwise(single)
    found = parts.select("block", F.inline(both)).where(_reachable(F.col("notice")))
    w = F.filter(F.split(F.regexp_replace(F.lower("notice"), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    # zipped as wholes: an access by place inside transform would split the paragraph anew for each word
    rest = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), rest), F.slice("w", F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b))
    each = found.select("notice").distinct().withColumn("w", w).select("notice", F.array_distinct(F.concat("w", pairs)).alias("features"))
    count = len(model.classes)
    weights = F.broadcast(_rows(spark, [{"f": f, "v": v} for f, v in model.weights.items()], "f:string,v:array<double>"))
    notices = [(fam, n, sorted(f for f in features(t) if " " in f)) for fam, texts in NOTICES.items() for n, t in enumerate(texts)]
    spread = each.select("notice", F.explode("features").alias("f"))
    known = spread.join(weights, "f").groupBy("notice").agg(*(F.sum(F.element_at("v", k + 1)).alias(f"s{k}") for k in range(count)))
    scored = each.select("notice", "features").join(known, "notice", "left")
    z = F.array(*((F.coalesce(F.col(f"s{k}"), F.lit(0.0)) + model.bias[k]) / model.temperature for k in range(count)))
    scored = scored.select("notice", "features", z.alias("z")).withColumn("top", F.array_max("z"))
    scored = scored.withColumns({"best": F.array_position("z", F.col("top")).cast("int"), "probability": 1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))})
    family = F.element_at(F.array(*map(F.lit, model.classes)), F.col("best"))
    likes = F.array(*(F.struct(F.lit(fam).alias("fam"), (F.size(F.array_intersect("features", F.array(*map(F.lit, p)))) / F.lit(len(p))).alias("like")) for fam, _, p in notices))
    scored = scored.withColumn("family", family).where("family <> 'other'")
    scored = scored.where(_anchored(F.col("notice")) | F.exists(likes, lambda x: x["like"] >= CONFIRMED))
    like = F.array_max(F.transform(F.filter(likes, lambda x: x["fam"] == F.col("family")), lambda x: x["like"]))
    judged = scored.withColumn("similarity", like).withColumn("confirmed", (F.col("probability") >= model.threshold) & (F.col("similarity") >= CONFIRMED))
    named = judged.select("notice", F.when(F.col("confirmed"), F.col("family")).otherwise("unknown").alias("family"), "probability", "similarity", "confirmed")
    # tables of their own here and below, so that a notice or block in a large part of the rows can be split in the joins
    named = stored(named, "licence-named")
    fields = ("at", "family", "probability", "similarity", "confirmed", "notice")
    rows = found.join(named, "notice").groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("rows"))
    rows = rows.withColumn("whole", F.filter("rows", lambda x: (x["at"] < 0) & x["confirmed"]))
    alone = F.filter("rows", lambda x: (x["at"] >= 0) & x["confirmed"])
    known = F.transform(alone, lambda x: x["family"])
    new = F.exists("whole", lambda x: ~F.array_contains(known, x["family"]))
    rows = rows.select("block", F.when(new, F.concat("whole", alone)).otherwise(F.filter("rows", lambda x: x["at"] >= 0)).alias("rows"))
    rows = stored(rows, "licence-rows")
    out = blocks.join(rows, "block").select("doc_id", "start", F.inline("rows"))
    return out.select("doc_id", (F.col("start") + F.greatest("at", F.lit(0))).alias("paragraph"), *fields[1:])


def classify_text(text: str | None, model: LicenceModel) -> list[tuple]:
    """(paragraph, family, probability, similarity, confirmed, notice) of scan() for one text in plain Python."""
    out, lines = [], (text or "").split("\n")
    edges = [-1, *(k for k, line in enumerate(lines) if re.fullmatch(BLANK[1:-1], line)), len(lines)]
    for a, b in zip(edges, edges[1:]):
        block = lines[a + 1 : b]
        rows = [(k, *c, line) for k, line in enumerate(block, a + 1) if (c := classify(line, model))]
        joined = re.sub("\\s*\n\\s*", " ", "\n".join(block).strip(" "))
        c = classify(joined, model) if len(block) > 1 else None
        if c and c[3] and not any(r[4] and r[1] == c[0] for r in rows):
            rows = [(a + 1, *c, joined), *(r for r in rows if r[4])]
        out += rows
    return out


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumns({"probability": F.round("probability", 6), "similarity": F.round("similarity", 6)})


def oracle() -> str:
    """The same scan as SQL for DuckDB, with the fitted weights written out."""
    model = trained()
    text = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(xs) + "]"
    count = len(model.classes)
    weights = ", ".join(f"({text(f)}, {listed(map(repr, v))})" for f, v in model.weights.items())
    notices = ", ".join(f"({text(fam)}, {listed(text(f) for f in sorted(features(t)) if ' ' in f)})" for fam, ts in NOTICES.items() for t in ts)
    anchored = " OR ".join(f"contains(lower(notice), {text(a)})" for a in ANCHORS)
    z = listed(f"(coalesce(sum(v[{k + 1}]), 0) + {model.bias[k]!r}) / {model.temperature!r}" for k in range(count))
    return f"""
WITH weights(f, v) AS (VALUES {weights}), notices(fam, p) AS (VALUES {notices}),
lines AS (
  SELECT doc_id, generate_subscripts(s, 1) - 1 AS paragraph, unnest(s) AS notice
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)
), found AS (SELECT * FROM lines WHERE {anchored}),
each AS (
  SELECT notice, list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS features
  FROM (SELECT notice, list_filter(string_split(regexp_replace(lower(notice), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
        FROM (SELECT DISTINCT notice FROM found))
), sums AS (
  SELECT notice, any_value(features) AS features, {z} AS z
  FROM (SELECT notice, features, unnest(CASE WHEN len(features) = 0 THEN [''] ELSE features END) AS f FROM each) LEFT JOIN weights USING (f) GROUP BY notice
), best AS (
  SELECT notice, features, {listed(map(text, model.classes))}[list_position(z, list_max(z))] AS fam,
         1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS probability
  FROM sums
), judged AS (
  SELECT b.notice, b.fam, b.probability, max(len(list_intersect(b.features, n.p)) / len(n.p)) AS similarity
  FROM best b JOIN notices n USING (fam) GROUP BY b.notice, b.fam, b.probability
)
SELECT doc_id, CAST(paragraph AS INTEGER) AS paragraph,
       CASE WHEN probability >= {model.threshold!r} AND similarity >= {CONFIRMED!r} THEN fam ELSE 'unknown' END AS family,
       round(probability, 6) AS probability, round(similarity, 6) AS similarity,
       probability >= {model.threshold!r} AND similarity >= {CONFIRMED!r} AS confirmed, notice
FROM found JOIN judged USING (notice)
"""


QUERIES = {"op1_licenses": op1_licenses}
ORACLE_SQL = {"op1_licenses": oracle}
