"""The native scan equals the model in plain Python; families, unknown notices and prose are told apart."""

from tesseraql.llm import licenses as L

#: Wordings that the model has not seen, prose with the words of licences, and notices of families it does not know.
UNSEEN = [
    ("mit", "The code in this directory is available under the MIT License."),
    ("mit", "Distributed under the MIT license, see LICENSE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in it without restriction."),
    ("mit", "// SPDX-License-Identifier: MIT"),
    ("apache", "Code licensed under the Apache License, Version 2.0 (the License);"),
    ("apache", "you may not use this file except in compliance with the License. Apache License, Version 2.0"),
    ("apache", "# SPDX-License-Identifier: Apache-2.0"),
    ("apache", "This project is released under the Apache 2.0 license."),
    ("gpl", "You may copy it under the terms of the GNU General Public License, version 3 or later."),
    ("gpl", "This module is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License."),
    ("gpl", "Released under the GPL v2 or later."),
    ("gpl", "/* SPDX-License-Identifier: GPL-2.0-only */"),
    ("lgpl", "The library is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl", "Distributed under the LGPL."),
    ("agpl", "This server is licensed under the GNU Affero General Public License, version 3 or later."),
    ("agpl", "Released under the AGPL."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions of source code must retain the above copyright notice."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("mpl", "This file is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "Code released under the MPL 2.0."),
    ("cc-by", "Text is available under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Photos licensed under CC BY 4.0 by their authors."),
    ("cc-by-sa", "Content is licensed under CC BY-SA 4.0 unless noted."),
    ("cc-by-sa", "Available under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Images are licensed under CC BY-NC 4.0."),
    ("cc0", "This data set is made available under CC0 1.0."),
    ("cc0", "Placed in the public domain under the CC0 license."),
    ("proprietary", "Copyright 2011 Example Press. All rights reserved."),
    ("proprietary", "No part of this book may be copied without the written permission of the publisher."),
]
PROSE = [
    "The club renewed its licence to play music in the square.",
    "He drove without a license for years and nobody noticed.",
    "Her thesis deals with copyright in the nineteenth century.",
    "The song is now in the public domain and anyone may sing it.",
    "They asked permission to dig in the field behind the church.",
    "The bar lost its liquor license in the spring.",
    "A hunting licence is needed in the northern woods.",
    "The court held that the copyright had expired.",
    "All rights of way across the estate are kept open.",
    "Free software was handed out at the fair.",
    "The MIT students built a boat.",
    "Apache helicopters flew over the valley.",
    "The foundation published the report in May.",
    "He was granted a license to practice medicine.",
]
FOREIGN = [
    "This program is made available under the Eclipse Public License 2.0.",
    "Licensed under the Open Software License version 3.0.",
    "Distributed under the terms of the Boost license.",
    "This font is licensed under the Open Font License.",
    "Licensed under the Server Side Public License.",
    "Released under the ISC license.",
    "Use of the data requires a license from the agency.",
    "Covered by the Academic Free License.",
]


def test_families_unknown_and_prose():
    model = L.trained()
    for family, notices in L.NOTICES.items():
        for n in notices:
            assert L.classify(n, model)[0] == family
    for n in L.STRANGERS:
        assert (L.classify(n, model) or ("unknown",))[0] == "unknown"
    assert not any(L.classify(t, model) for t in L.OTHERS)
    assert L.classify("Copyright (c) 2019 A. Body. Released under the MIT License. See the file.", model)[0] == "mit"
    assert (L.classify("She said the driver had no license at all and laughed.", model) or ("unknown",))[0] == "unknown"


def test_scan(spark):
    model = L.trained()
    texts = ["word\nReleased under the MIT License.\n\nmore", "Licensed under CC BY-NC 4.0.", "no notice", None, "", "Licensed under the Eclipse Public License, v 2.0.", "RELEASED UNDER THE MIT LICENSE.", "license", "x " * 40_000 + "Released under the MIT License.", "He lost his driving licence\nAll rights reserved."]
    rows = [(n, t) for n, t in enumerate(texts)] + [(1, texts[1]), (None, texts[0])]
    df = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, family string").repartition(3)
    got = sorted(((r.doc_id, r.paragraph, r.family, r.confirmed, round(r.probability, 9), round(r.similarity, 9)) for r in L.scan(df).collect()), key=str)
    want = [(i, p, c[0], c[3], round(c[1], 9), round(c[2], 9)) for i, t in rows for p, line in enumerate((t or "").split("\n")) if (c := L.classify(line, model))]
    assert got == sorted(want, key=str) and len(got) >= 7
    assert L.scan(df.limit(0)).count() == 0


def test_held_out_variations():
    import random

    model, rng = L.trained(), random.Random(99)
    cases = [(v, f) for f, ns in L.NOTICES.items() for n in ns for v in L._variations(n, rng, 8)]
    right = sum((L.classify(v, model) or ("",))[0] == f for v, f in cases)
    wrong = sum((L.classify(v, model) or ("unknown",))[0] not in (f, "unknown") for v, f in cases)
    assert right / len(cases) > 0.85 and wrong / len(cases) < 0.05


def test_notices_without_an_anchor(spark):
    model = L.trained()
    texts = ["Released under the AGPL.", "Distributed under the LGPL.", "Released under the GPL v2 or later.", "word\nreleased  UNDER the agpl\nmore", "They were released under the bridge."]
    got = sorted((r.doc_id, r.paragraph, r.family, r.confirmed) for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model=model).collect())
    assert [(i, p) for i, p, _, _ in got] == [(0, 0), (1, 0), (2, 0), (3, 1)]
    assert got == [(i, p, *(L.classify(texts[i].split("\n")[p], model)[k] for k in (0, 3))) for i, p, _, _ in got]
    assert [f for _, _, f, _ in got] == ["agpl", "lgpl", "gpl", "agpl"]
    # a text without the pairs that the prefilter asks for cannot be confirmed
    for n in (n for ns in L.NOTICES.values() for n in ns):
        pairs = {f for f in L.features(n) if " " in f}
        free = [f for f in pairs if f not in L.required(n) and not any(a in f for a in L.ANCHORS)]
        assert len(free) / len(pairs) < L.CONFIRMED


def test_wrapped_notices(spark):
    model = L.trained()
    gpl = "# This program is free software: you can redistribute it and or modify\n# it under the terms of the GNU General Public License as published\n# by the Free Software Foundation."
    mit = "Permission is hereby granted, free of charge, to any person obtaining\r\na copy of this software and associated documentation files, to deal\r\nin the Software without restriction."
    texts = [gpl, f"some prose\n\n\n{gpl}\n \t\ncode here\n\n{mit}\n", f"{mit}\nReleased under the MIT License.", "\n\nReleased under the\nAGPL.", "a\nb\n\nlicense\n", None, "", "\x01" + gpl, "\n"]
    rows = list(enumerate(texts)) + [(0, gpl), (None, gpl)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: str((r[0], r[1], r[2], r[4]))
    got = sorted(((r.doc_id, r.paragraph, r.family, round(r.probability, 9), r.confirmed, round(r.similarity, 9)) for r in L.scan(df).collect()), key=key)
    want = sorted(((i, p, f, round(q, 9), sure, round(like, 9)) for i, t in rows for p, f, q, like, sure, _ in L.classify_text(t, model)), key=key)
    assert got == want
    sure = sorted((i, p, f) for i, p, f, _, c, _ in got if c and i is not None)
    assert sure == [(0, 0, "gpl"), (0, 0, "gpl"), (1, 3, "gpl"), (1, 9, "mit"), (2, 3, "mit"), (3, 2, "agpl"), (7, 0, "gpl")]
    assert not any(f == "unknown" for i, _, f, _, _, _ in got if i in (0, 1))


def test_unseen_wordings(spark):
    """Recall of families by wordings that are in no notice; nothing is taken for a wrong family, and none vanishes."""
    model = L.trained()
    texts = [t for _, t in UNSEEN]
    found = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate([*texts, *PROSE, *FOREIGN])), "doc_id long, text string"), model=model).collect()}
    got = [found[n].family if n in found else "" for n in range(len(texts))]
    right = sum(f == g for (f, _), g in zip(UNSEEN, got))
    assert right / len(UNSEEN) > 0.8
    assert all(g in (f, "unknown") for (f, _), g in zip(UNSEEN, got))
    assert not any(r.confirmed for n, r in found.items() if n >= len(texts))


def test_stems_lose_nothing():
    """A text that a family's notice confirms holds an anchor or a stem, whichever of its pairs it holds."""
    for notice in (n for ns in L.NOTICES.values() for n in ns):
        pairs = {f for f in L.features(notice) if " " in f}
        free = [f for f in pairs if not any(a in f for a in L.ANCHORS) and not any(w in f.split() or w == f for w in L.stems())]
        assert len(free) / len(pairs) < L.CONFIRMED
