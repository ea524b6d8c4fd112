"""Licence scan: Dice coefficient over word bigrams against licence templates.

Units of a text are its lines, its paragraphs of several lines (between blank lines),
the pieces of each paragraph, cut where a sentence ends and before "licensed under" and
the like, so that a notice inside a line or in flowing text stands alone, and the text
as a whole. Units and templates (notices, paragraphs and full texts of licences) are
normalised alike: lower case, "licence" as "license", everything but a-z and 0-9 a
space. Both are bags of word bigrams; the coefficient is 2 * common / (unit +
template). A coefficient of ``THRESHOLD`` needs sizes within a factor of (2 - t) / t;
template bigrams are entered by the sizes of units they can fit, so a unit meets only
templates within these bounds. Each unit's best template counts (ties: the first by
name).

Texts and units are first searched for anchor words. Anchors are chosen from the
templates: of each template fewer bigrams lack an anchor than a unit must share with it,
so a unit without an anchor cannot reach the threshold and nothing is lost.

Scale: native DataFrame functions only. The templates' bigrams (a fixed table of some
thousand rows) are broadcast; unit bigrams meet them in a map-side join, and only hits
are shuffled. A licence line in a third of all documents costs nothing special: hits
are grouped by document and unit, not by licence.

Defined results: null and empty texts and units of one word match nothing;
repeated rows are told apart and each reported; a null doc_id is carried as null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

THRESHOLD = 0.8

#: Names in notices of one line.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "Unlicense": ["Unlicense"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal License"],
}
PHRASES = ["Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This project is licensed under the {}.", "Distributed under the {}.", "Available under the {}."]
#: Notices and key paragraphs as they stand in the public licence texts.
TEXTS = [
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_GRANT_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_NOTICE_MIT = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_WARRANTY_MIT = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_GRANT_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_WARRANTY_ISC = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_WARRANTY_BSD = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_UNLICENSE = [
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "For more information, please refer to <https://unlicense.org>",
]
#: Full texts, without title and copyright line, as they stand in the public licences.
FULL = [
    ("MIT", [_GRANT_MIT, _NOTICE_MIT, _WARRANTY_MIT]),
    ("ISC", [_GRANT_ISC, _WARRANTY_ISC]),
    ("BSD-2-Clause", [_BSD_HEAD, _BSD_SOURCE, _BSD_BINARY, _WARRANTY_BSD]),
    ("BSD-3-Clause", [_BSD_HEAD, _BSD_SOURCE, _BSD_BINARY, _BSD_NAMES, _WARRANTY_BSD]),
    ("Unlicense", _UNLICENSE),
]
#: Words before "under" that begin a notice, wherever they stand.
VERBS = ["licensed", "released", "distributed", "available", "published"]
#: Words too common to be anchors.
_COMMON = set("the of to a and or in is this that you it for with any not be by as are an on all may from use under work at no only other new see its so but have has more if was will can do we our your they their either can which who his her one out up".split())


def normal(text: str) -> list[str]:
    """Words of a template, by the rule that units are normalised with."""
    text = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).replace("licence", "license")
    return text.split()


def templates() -> list[tuple[int, str, int, dict[str, int]]]:
    """[(number, licence, bigrams, {bigram: count})], without duplicates."""
    texts = [(k, p.format(n)) for k, names in NAMES.items() for n in names for p in PHRASES] + TEXTS + [(k, " ".join(parts)) for k, parts in FULL] + [("MIT", _WARRANTY_MIT), ("BSD-3-Clause", _BSD_NAMES)]
    words = {(k, " ".join(normal(t))) for k, t in texts}
    out = []
    for k, t in sorted(words):
        ws = t.split()
        out.append((len(out), k, len(ws) - 1, dict(Counter(f"{a} {b}" for a, b in zip(ws, ws[1:])))))
    return out


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Unit sizes, in bigrams, that can reach the threshold with a template of n bigrams."""
    fits = [m for m in range(1, int(n * (2 - threshold) / threshold) + 2) if 2 * min(m, n) >= threshold * (m + n) - 1e-9]
    return fits[0], fits[-1]


def anchors(threshold: float = THRESHOLD) -> list[str]:
    """Words such that a unit that reaches the threshold with any template has one of them.

    Of a template of n bigrams, fewer than the least number to be shared lack them."""
    chosen: list[str] = []
    for _, _, n, grams in sorted(templates(), key=lambda t: (t[2], t[0])):
        need = math.ceil(threshold * (n + size_bounds(n, threshold)[0]) / 2 - 1e-9)
        pairs = [tuple(g.split()) for g, c in grams.items() for _ in range(c)]
        while len(bare := [p for p in pairs if not set(p) & set(chosen)]) >= need:
            words = Counter(w for p in bare for w in set(p))
            rare = [w for w in words if w not in _COMMON and not w.isdigit() and len(w) > 2] or list(words)
            chosen.append(max(rare, key=lambda w: (len(w) >= 6, words[w], len(w), w)))
    return sorted(chosen)


def gate(threshold: float) -> str:
    """Matches lower-cased texts with an anchor word (a run of letters and digits, as units are normalised)."""
    words = "|".join(w.replace("license", "licen[cs]e") for w in anchors(threshold))
    return f"(?<![a-z0-9])(?:{words})(?![a-z0-9])"


_SENTENCE_END = r"([.!?;])[ \t\r\n]+([A-Z\"(])"
_NOTICE = "((?:made )?(?:" + "|".join(VERBS) + ")[ \t\r\n]+under)"
_BLANK = "\n[ \t\r]*\n"


def pieces(block: Column) -> Column:
    """A paragraph cut at sentence ends and before notices."""
    marked = F.regexp_replace(block, _SENTENCE_END, "$1\x01$2")
    return F.split(F.regexp_replace(marked, f"(?i){_NOTICE}", "\x01$1"), "\x01")


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row, unit, license, dice): the best template of each unit that has one."""
    spark, known = docs.sparkSession, templates()
    bounds = [size_bounds(n, threshold) for _, _, n, _ in known]
    entries = [(i, k, n, lo, hi, near, g, c) for (i, k, n, gs), (lo, hi) in zip(known, bounds) for near in range(lo.bit_length(), hi.bit_length() + 1) for g, c in gs.items()]
    listed = spark.createDataFrame(entries, "template int, license string, size int, low int, high int, near int, gram string, times int")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.filter(F.lower("text").rlike(gate(threshold)))
    blocks = F.split("text", _BLANK)
    several = F.filter(blocks, lambda b: F.instr(b, "\n") > 0)
    cut = F.flatten(F.transform(blocks, lambda b: F.filter(pieces(b), lambda p: p != b)))
    whole = F.when(F.size(blocks) > 1, F.array("text")).otherwise(F.array().cast("array<string>"))
    units = base.select("doc_id", "row", F.posexplode(F.concat(F.split("text", "\n"), several, cut, whole)).alias("unit", "raw"))
    units = units.withColumn("raw", F.lower("raw")).filter(F.col("raw").rlike(gate(threshold)))
    plain = F.trim(F.regexp_replace("raw", "[^a-z0-9]+", " "))
    units = units.select("doc_id", "row", "unit", F.replace(plain, F.lit("licence"), F.lit("license")).alias("plain"))
    n = F.length("plain") - F.length(F.translate("plain", " ", ""))
    units = units.withColumn("n", n).filter((F.col("n") >= min(b[0] for b in bounds)) & (F.col("n") <= max(b[1] for b in bounds)))
    words = F.split("plain", " ")
    grams = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))
    exploded = units.withColumn("words", words).select("doc_id", "row", "unit", "n", F.length(F.bin("n")).alias("near"), F.explode(grams).alias("gram"))
    hits = exploded.join(F.broadcast(listed), ["gram", "near"]).filter("n between low and high")
    common = hits.groupBy("doc_id", "row", "unit", "n", "template", "license", "size", "gram", "times").agg(F.count("*").alias("here"))
    scored = common.groupBy("doc_id", "row", "unit", "n", "template", "license", "size").agg(F.sum(F.least("here", "times")).alias("common"))
    scored = scored.withColumn("dice", F.round(2.0 * F.col("common") / (F.col("n") + F.col("size")), 6)).filter(F.col("dice") >= threshold)
    best = F.max_by("license", F.struct("dice", -F.col("template")))
    return scored.groupBy("doc_id", "row", "unit").agg(best.alias("license"), F.max("dice").alias("dice"))


def licenses(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row, license, dice, n_units): licences of each document with the best coefficient."""
    return scan(docs, threshold).groupBy("doc_id", "row", "license").agg(F.max("dice").alias("dice"), F.count("*").alias("n_units"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, dice, n_units: a row for each document and licence found."""
    return licenses(table(spark, sf_dir, "documents")).drop("row")


def _values() -> str:
    rows = [(i, k, n, *size_bounds(n, THRESHOLD), g, c) for i, k, n, gs in templates() for g, c in gs.items()]
    return ", ".join(f"({i}, '{k}', {n}, {a}, {b}, '{g}', {c})" for i, k, n, a, b, g, c in rows)


SQL = f"""
with t(template, license, size, low, high, gram, times) as (values {_values()}),
d as (select doc_id, row_number() over () as row, coalesce(text, '') as text from documents),
b as (select doc_id, row, text, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') bs from d),
c as (select doc_id, row, text, bs, list_transform(bs, lambda x: regexp_replace(regexp_replace(x, '([.!?;])[ \\t\\r\\n]+([A-Z"(])', '\\1' || chr(1) || '\\2', 'g'),
    '((?:made )?(?:{"|".join(VERBS)})[ \\t\\r\\n]+under)', chr(1) || '\\1', 'gi')) ms from b),
raw as (
  select doc_id, row, unnest(string_split(text, chr(10))) raw from d
  union all select doc_id, row, x from b, unnest(bs) u(x) where contains(x, chr(10))
  union all select doc_id, row, unnest(string_split(m, chr(1))) from c, unnest(ms) u(m) where contains(m, chr(1))
  union all select doc_id, row, text from b where len(bs) > 1),
n as (select doc_id, row, row_number() over () as unit, raw from raw),
u as (select doc_id, row, unit, string_split(replace(trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')), 'licence', 'license'), ' ') ws from n),
g as (select doc_id, row, unit, len(ws) - 1 n, ws[i] || ' ' || ws[i + 1] gram from u, unnest(range(1, len(ws))) r(i) where len(ws) - 1 <= (select max(high) from t)),
e as (select doc_id, row, unit, n, template, license, size, gram, times, count(*) here from g join t using (gram) where n between low and high group by all),
s as (select doc_id, row, unit, template, license, round(2.0 * sum(least(here, times)) / (n + size), 6) dice from e group by doc_id, row, unit, n, template, license, size),
best as (select doc_id, row, unit, license, dice from s where dice >= {THRESHOLD} qualify row_number() over (partition by doc_id, row, unit order by dice desc, template) = 1)
select doc_id, license, max(dice)::double dice, count(*) n_units from best group by doc_id, row, license
"""
