"""Licences: each template, longer matches, notices within other text, against a plain version."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from quillrank.llm import licenses
from tests.llm.helpers import docs

PROSE = "The quick survey of the northern shore was made in the spring of that year and it is described here for the reader of this report".split()
WORDING = {(name, len(w)): w for name, w in licenses.TEMPLATES}


def scan(spark, texts, **kw):
    return [(r.license, r.dice, r.licenses) for r in licenses.scan(docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), **kw).orderBy("id").collect()]


def test_each_template(spark):
    """Alone, amid prose, and wrapped in comment signs, every template is the best match."""
    names = [n for n, _ in licenses.TEMPLATES]
    comment = lambda w: "\n".join("# " + " ".join(w.split()[i : i + 9]) for i in range(0, len(w.split()), 9))
    prose = " ".join(PROSE)
    for texts in ([w for _, w in licenses.TEMPLATES], [f"{prose} {w} {prose}\nmore" for _, w in licenses.TEMPLATES], [f"#!/bin/sh\n#\n{comment(w)}\n#\nx = 1" for _, w in licenses.TEMPLATES]):
        assert [g[0] for g in scan(spark, texts)] == names


def test_bsd3_is_not_bsd2(spark):
    three = next(w for n, w in licenses.TEMPLATES if n == "BSD-3-Clause" and len(w) > 500)
    first, clause = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", next(w for n, w in licenses.TEMPLATES if n == "BSD-3-Clause")
    assert [g[0] for g in scan(spark, [three, f"{first}\n\n{clause}"])] == ["BSD-3-Clause"] * 2


#: A notice of a licence, and the names that are right for it; no name is right where none is built in.
NOTICES = {
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": {"GPL-2.0-or-later"},
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": {"GPL-2.0-only"},
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 4 of the License, or (at your option) any later version.": {None},
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": {"LGPL-2.1-or-later"},
    'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.': {"MPL-1.1"},
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.": {None},
    "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": {"CC-BY-3.0"},
    "This work is licensed under a Creative Commons Attribution 1.0 Generic License.": {None},
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": {"CC-BY-NC-SA-4.0"},
    "Licensed under CC BY-NC-ND 2.5.": {"CC-BY-NC-ND-2.5"},
    "Licensed under the Apache License, Version 1.0.": {None},
    "// SPDX-License-Identifier: MIT": {"MIT"},
    "# SPDX-License-Identifier: GPL-2.0-or-later": {"GPL-2.0-or-later"},
    "You may use it under the GPL v3 or ask us": {"GPL-3.0"},
    "You may use it under the GPL v7 or ask us": {None},
    "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies of this license document": {"GPL-2.0"},
    "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007": {"LGPL-3.0"},
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/": {"EPL-2.0"},
}


def test_near_relatives(spark):
    """Each notice by its own name, alone and within other text, or by none."""
    four = next(w for n, w in licenses.TEMPLATES if n == "BSD-2-Clause" and len(w) > 500).replace(
        "THIS SOFTWARE IS", "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University. THIS SOFTWARE IS", 1
    )
    notices = {**NOTICES, four.replace("COPYRIGHT HOLDERS", "REGENTS"): {"BSD-4-Clause"}}
    for texts in (list(notices), [f"some words before it {t} and some behind" for t in notices]):
        assert [g[0] in right for g, right in zip(scan(spark, texts), notices.values())] == [True] * len(notices), [(t[:90], g) for t, g, r in zip(texts, scan(spark, texts), notices.values()) if g[0] not in r]


def plain(text: str) -> list[tuple[bool, float, int, str]]:
    words_of = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    pairs = lambda w: list(zip(w, w[1:]))
    whole, hits = pairs(words_of(text)), []
    units = {tuple(pairs(words_of(u))) for u in [*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text]}
    for name, wording in licenses.TEMPLATES:
        t = pairs(words_of(wording))
        n, keys, weak = len(t), licenses.key_bigrams(words_of(wording)), wording in licenses.SHARED
        starts = Counter(i - j for i, x in enumerate(whole) for j, y in enumerate(t) if x == y)
        least = max(1, -(-n // licenses.LINED_UP))
        windows = [(whole[max(0, s) : s + n], whole[max(0, s - least) : s + n + least]) for s, c in starts.items() if c >= least]
        for u, around in [*((u, u) for u in units), *windows]:
            if u and keys <= set(around) and (d := 2 * sum((Counter(u) & Counter(t)).values()) / (len(u) + n)) >= licenses.LEAST:
                hits.append((weak, -d, -n, name))
    return sorted(hits)


@pytest.mark.parametrize("seed", range(3))
def test_against_plain(spark, seed):
    """Notices with words put in, left out and changed, repeated and cut off at either end."""
    rng, texts = random.Random(seed), [None, "", "license", "\n \n"]
    for _ in range(25):
        parts = []
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 1 + len(w) // 12)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [rng.choice(PROSE)] * rng.randint(0, 2)
            w = w[rng.choice([0, 0, len(w) // 5]) : len(w) - rng.choice([0, 0, len(w) // 5])] or ["x"]
            parts += [" ".join(rng.choices(PROSE, k=rng.randint(0, 12))), rng.choice([" ", "\n", "\n\n"]), " ".join(w) + rng.choice([" ", "\n"])]
        texts.append("".join(parts))
    for text, (license_, dice, names) in zip(texts, scan(spark, texts)):
        hits = plain(text or "")
        assert (license_, names) == ((hits[0][3], ",".join(sorted({h[3] for h in hits}))) if hits else (None, ""))
        assert dice is None if not hits else abs(dice + hits[0][1]) < 1e-6


def test_own_templates_and_repeats(spark):
    long = [("Long", " ".join(f"w{i % 377}x{i % 53}" for i in range(3000)))]
    got = scan(spark, ["pre " + long[0][1] + " post", "Released under the MIT License.\n" * 5000], templates=long)
    assert [g[0] for g in got] == ["Long", None]
    assert scan(spark, ["Released under the MIT License. " * 5000])[0][0] == "MIT"
