"""Licence scans by Dice coefficient over word bigrams.

Every line of a text, every paragraph and the text itself is a unit, and so is every window of a
template's length that starts where at least a quarter of the template's bigrams line up with the
text's, so a notice is found within a line, over several lines and behind comment signs.  A unit
is normalised to lower-case words and compared with licence templates: twice the bigrams they share, repeats
counted, over the bigrams they have.  A template and a unit of a and b bigrams can't reach a
coefficient of t unless a is between b * t / (2 - t) and b * (2 - t) / t, so word counts alone
leave most units and templates out, and a text that has too few of a template's distinct bigrams has no
window for it.  A text without any telling word or phrase (at least one of which must be there if any
template is) is not taken apart at all.  Templates are a fixed short list, held as a literal, or the caller's; rows
never move.  DataFrame functions only.

A version or a name that differs vetoes a match: the bigrams of a notice that hold a number or a word of
``NAMED`` all have to be there, within a window and a quarter of its length around it.  Where several
licences share a wording (``SHARED``), it counts only if nothing else matches.

The built-in templates are notices, identifiers, the heads of long licences (GPL, LGPL, AGPL, Apache, MPL), by which
their whole texts are known, and the whole texts of short ones.  Pass further texts as ``templates``.

Defined results: a null or empty text has no licence; units that repeat count once; of equal
coefficients the longer template wins, then the name that comes first; repeated rows are scanned each; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

LEAST = 0.8
#: Part of a template's bigrams that have to line up where a window starts: one in so many.
LINED_UP = 4

#: Fixed values: (name, wording) of public licence notices, then of whole short licences.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-1.1", 'The end-user documentation included with the redistribution, if any, must include the following acknowledgment: "This product includes software developed by the Apache Software Foundation (http://www.apache.org/)."'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "under the AGPL v3"),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "under the GPL v2"),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "under the GPL v3"),
    ("GPL-3.0-only", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License."),
    ("LGPL-2.0-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "under the LGPL v2.1"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "under the LGPL v3"),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/'),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.'),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]
#: Words that tell licences of one family apart; a notice's bigrams with one of them or with a number have to be in a match.
NAMED = {"affero", "attribution", "by", "eclipse", "general", "gnu", "identifier", "lesser", "library", "mozilla", "nc", "nd", "noncommercial", "noderivatives", "noderivs", "only", "sa", "sharealike"}
#: Words up to which a template is a notice, whose numbers are versions.
NOTICE = 60
#: Wordings that other licences have too.
SHARED = {"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"}


def _creative_commons() -> list[tuple[str, str]]:
    """The two usual notices of each of the six licences in each version."""
    out = []
    for version, ported in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        parts = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives" if version == "4.0" else "NoDerivs"}
        for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
            out.append((f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}."))
            out.append((f"CC-{kind}-{version}", f"This work is licensed under a Creative Commons {'-'.join(parts[p] for p in kind.split('-'))} {version} {ported} License."))
    return out


TEMPLATES += _creative_commons()
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in TEMPLATES})]
#: Frequent words, which tell little.
COMMON = set("a an all and any are as at be but by for from has have his i if in into is it its no not of on or our that the their this to under up was we with without you your 0 1 2 3 4 about above after also before being following including express provided possible related purpose subject version published products connection contract conditions".split())
BREAK = r"[^\p{L}\p{N}]+"


def words_of_template(wording: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", wording.lower()).split()


def key_bigrams(words: list[str]) -> set[tuple[str, str]]:
    """Bigrams of a notice that have to be in every match."""
    telling = {w for w in words if w in NAMED or any(c.isdigit() for c in w)} if len(words) <= NOTICE else set()
    # An address says nothing of the version.
    return {(a, b) for a, b in zip(words, words[1:]) if (a in telling or b in telling) and not {"html", "http", "https", "org", "www"} & {a, b}}


def _bounds(n: int, least: float) -> tuple[int, int]:
    """Bigram counts that a unit may have beside a template of n bigrams."""
    return math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BREAK), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """Hashed bigrams in order; none for fewer than two words."""
    n = F.size(words)
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(words[i], words[i + 1]))).otherwise(F.array().cast("array<bigint>"))


def _pair_hash(a: str, b: str) -> int:
    """What Spark's xxhash64 of two strings is: the first one's hash seeds the second's."""
    h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
    return h - 2**64 if h >= 2**63 else h


def telling_words(templates: list[tuple[str, str]], least: float) -> list[str]:
    """Words of which every text with a unit of enough bigrams of some template has one.

    Such a unit has ``need`` of a template's distinct bigrams, so at least one of any
    ``distinct - need + 1``; the words cover so many of each template.  Each round takes the word
    that covers most in all templates, long words first and those of ``COMMON`` last.
    """
    open_ = []  # (bigrams not covered, how many of them have to be)
    for _, wording in templates:
        words = words_of_template(wording)
        own, n = set(zip(words, words[1:])), len(words) - 1
        open_.append((own, len(own) - max(1, _bounds(n, least)[0] - (n - len(own))) + 1))
    chosen = []
    while any(more > 0 for _, more in open_):
        gain = Counter()
        for own, more in open_:
            for w, n in Counter(w for pair in own for w in set(pair)).items() if more > 0 else ():
                gain[w] += min(more, n)
        word = max(gain, key=lambda w: (w not in COMMON and len(w) >= 7, w not in COMMON, gain[w] * len(w), w))
        chosen.append(word)
        open_ = [(left := {pair for pair in own if word not in pair}, more - (len(own) - len(left))) for own, more in open_]
    return chosen


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _longs(values: list[int]) -> Column:
    """An array that the optimizer folds at once; as many literals would take it minutes."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _templates(templates: list[tuple[str, str]], least: float) -> tuple[Column, Column]:
    """The templates as an array of structs that the optimizer folds into one literal, and all their bigrams."""
    rows, every = [], set()
    for name, wording in templates:
        words = words_of_template(wording)
        n = len(words) - 1
        low, high = _bounds(n, least)
        own = [_pair_hash(a, b) for a, b in zip(words, words[1:])]
        every.update(own)
        # A unit or window that reaches ``least`` shares ``low`` bigrams, so at least so many distinct ones.
        keys = [_pair_hash(a, b) for a, b in sorted(key_bigrams(words))]
        fields = {"name": name, "weak": int(wording in SHARED), "n": n, "low": low, "high": high, "need": max(1, low - (n - len(set(own)))), "start": max(1, -(-n // LINED_UP))}
        rows.append(F.struct(*[F.lit(v).alias(k) for k, v in fields.items()], _longs(own).alias("pairs"), (_longs(keys) if keys else F.array().cast("array<bigint>")).alias("keys")))
    return F.array(*rows), _longs(sorted(every))


def _dice(unit: Column, n: Column, t: Column) -> Column:
    common = F.array_intersect(unit, t["pairs"])
    times = lambda among, x: F.size(F.filter(among, lambda y: y == x))
    shared = F.aggregate(common, F.lit(0), lambda a, x: a + F.least(times(unit, x), times(t["pairs"], x)))
    return F.when(F.size(common) == 0, 0.0).otherwise(2.0 * shared / (n + t["n"]))


def _starts(pairs: Column, t: Column) -> Column:
    """Places of a text's bigrams where a window of the template starts; before 0 if its first bigrams are cut off."""
    at = F.filter(F.transform(pairs, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: F.array_contains(t["pairs"], p["x"]))
    lines = F.transform(at, lambda p: F.transform(F.filter(F.sequence(F.lit(0), t["n"] - 1), lambda j: t["pairs"][j] == p["x"]), lambda j: p["i"] - j))
    # In sorted order, equal starts stand together: one that stands often enough equals a later one.
    return _let(F.sort_array(F.flatten(lines)), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i + t["start"] - 1) == x, F.lit(False)))))


def scan(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, license, dice, licenses) for each row: the best template, and the names of all that reach ``least``."""
    templates = [t for t in templates or TEMPLATES if len(words_of_template(t[1])) > 1]
    sizes = [_bounds(len(words_of_template(w)) - 1, least) for _, w in templates]
    low, high = min(a for a, _ in sizes) + 1, max(b for _, b in sizes) + 1  # in words
    df = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    # A text without a telling word has no hit, as an empty text has none, which costs nothing.
    telling = F.array(*map(F.lit, telling_words(templates, least)))
    told = F.transform(F.array(F.struct("text", _words(F.col("text")).alias("words"))), lambda x: F.when(F.arrays_overlap(x["words"], telling), x).otherwise(F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("words"))))
    df = df.select("id", F.explode(told).alias("told")).select("id", "told.*")
    text = F.col("text")
    blocks = F.when(text.rlike(r"\n[\x20\t\r]*\n"), F.split(text, r"\n[\x20\t\r]*\n")).otherwise(F.array().cast("array<string>"))
    units = F.array_distinct(F.concat(F.split(text, "\n"), blocks, F.array(text)))
    df = df.select("id", F.filter(F.transform(units, _words), lambda w: F.size(w).between(low, high)).alias("units"), "words")
    df = df.select("id", F.transform("units", _pairs).alias("units"), _let(F.col("words"), _pairs).alias("whole"))
    known, every = _templates(templates, least)

    def hit(unit: Column, n: Column, t: Column, around: Column) -> Column:
        has_keys = F.size(F.array_except(t["keys"], around)) == 0
        return F.struct(t["weak"].alias("weak"), F.when(has_keys, -_dice(unit, n, t)).otherwise(0.0).alias("minus"), (-t["n"]).alias("size"), t["name"].alias("name"))

    def of_unit(unit: Column) -> Column:
        n = F.size(unit)
        near = F.filter(known, lambda t: n.between(t["low"], t["high"]) & F.arrays_overlap(unit, t["pairs"]))
        return F.transform(near, lambda t: hit(unit, n, t, unit))

    def of_window(pairs: Column, start: Column, t: Column) -> Column:
        # Picked one by one: slice() would read the whole array again for each window.
        window = lambda more: F.transform(F.sequence(F.greatest(start - more, F.lit(0)), F.least(start + t["n"] + more, F.size(pairs)) - 1), lambda i: pairs[i])
        return _let(window(F.lit(0)), lambda u: hit(u, F.size(u), t, window(t["start"])))

    def of_whole(pairs: Column) -> Column:
        near = lambda common: F.filter(known, lambda t: F.size(F.array_intersect(t["pairs"], common)) >= t["need"])
        return F.flatten(F.transform(_let(F.array_intersect(pairs, every), near), lambda t: F.transform(_starts(pairs, t), lambda s: of_window(pairs, s, t))))

    found = F.concat(F.flatten(F.transform("units", of_unit)), _let(F.col("whole"), of_whole))
    df = df.select("id", F.filter(found, lambda h: h["minus"] <= -least).alias("hits"))
    best = F.array_min("hits")
    return df.select("id", best["name"].alias("license"), F.round(-best["minus"], 6).alias("dice"), F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["name"]))), ",").alias("licenses"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents."""
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _oracle() -> str:
    rows, places, longest = [], [], 0
    for k, (name, wording) in enumerate(TEMPLATES):
        words = words_of_template(wording)
        n, longest, keys = len(words) - 1, max(longest, len(words)), key_bigrams(words)
        for pair, times in Counter(zip(words, words[1:])).items():
            rows.append(f"({k}, '{name}', {n}, '{pair[0]} {pair[1]}', {times}, {pair in keys}, {len(keys)}, {int(wording in SHARED)})")
        places += [f"({k}, {n}, {j}, '{a} {b}')" for j, (a, b) in enumerate(zip(words, words[1:]))]
    return f"""
WITH t(k, name, n, pair, times, key, keys, weak) AS (VALUES {", ".join(rows)}),
l(k, n, j, pair) AS (VALUES {", ".join(places)}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '\\n[\\x20\\t\\r]*\\n'), [text])) AS unit FROM d),
w AS (SELECT doc_id, unit, list_filter(string_split_regex(lower(unit), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM u),
p AS (SELECT doc_id, unit, len(w) - 1 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM w WHERE len(w) BETWEEN 2 AND {2 * longest}),
c AS (SELECT doc_id, unit, n, pair, count(*) AS times FROM p GROUP BY ALL),
s AS (SELECT doc_id, any_value(t.n) AS size, any_value(weak) AS weak, name, 2.0::DOUBLE * sum(least(c.times, t.times)) / any_value(c.n + t.n) AS dice FROM c JOIN t USING (pair) GROUP BY doc_id, unit, k, name HAVING count(*) FILTER (key) = any_value(keys)),
a AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM d),
b AS (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM a)),
g AS MATERIALIZED (SELECT b.* FROM b SEMI JOIN l ON b.pair = l.pair),
v AS (SELECT doc_id, k, l.n, pos - j AS st FROM g JOIN l USING (pair) GROUP BY doc_id, k, l.n, pos - j HAVING count(*) >= greatest(1, ceil(l.n / {LINED_UP}.0))),
x AS (SELECT doc_id, k, st, any_value(v.n) AS n, pair, count(*) AS times FROM v JOIN g USING (doc_id) WHERE pos >= st AND pos < st + v.n GROUP BY doc_id, k, st, pair),
z AS (SELECT doc_id, max(pos) + 1 AS n FROM b GROUP BY doc_id),
kk AS (SELECT DISTINCT v.doc_id, v.k, st, g.pair FROM v JOIN g USING (doc_id) JOIN t ON t.k = v.k AND t.pair = g.pair AND t.key WHERE pos >= st - greatest(1, ceil(v.n / {LINED_UP}.0)) AND pos < st + v.n + greatest(1, ceil(v.n / {LINED_UP}.0))),
ok AS (SELECT v.doc_id, v.k, v.st FROM v JOIN (SELECT k, any_value(keys) AS keys FROM t GROUP BY k) e USING (k) LEFT JOIN kk USING (doc_id, k, st) GROUP BY v.doc_id, v.k, v.st, keys HAVING count(kk.pair) = keys),
y AS (SELECT x.doc_id, any_value(t.n) AS size, any_value(weak) AS weak, name, 2.0::DOUBLE * sum(least(x.times, t.times)) / any_value(least(z.n, x.st + x.n) - greatest(x.st, 0) + t.n) AS dice
      FROM x SEMI JOIN ok ON x.doc_id = ok.doc_id AND x.k = ok.k AND x.st = ok.st JOIN t ON x.pair = t.pair AND x.k = t.k JOIN z ON x.doc_id = z.doc_id GROUP BY x.doc_id, x.k, x.st, name),
h AS (SELECT * FROM s WHERE dice >= {LEAST} UNION ALL SELECT * FROM y WHERE dice >= {LEAST}),
r AS (SELECT doc_id, arg_min(name, (weak, -dice, -size, name)) AS license, round(arg_min(dice, (weak, -dice, -size, name)), 6) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM h GROUP BY doc_id)
SELECT d.doc_id, license, dice, coalesce(licenses, '') AS licenses FROM d LEFT JOIN r USING (doc_id)
"""


ORACLE = _oracle()
