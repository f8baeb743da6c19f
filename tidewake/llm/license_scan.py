"""Licence scan: Dice coefficient of word bigrams against licence templates (operator 7), in built-in functions only.

A template is looked for in every window of a text, wherever it begins and
ends: in a line of prose, over several lines, in a comment block or as the
whole text. The coefficient of a window of ``m`` bigrams that holds ``c`` of
the template's ``n`` different bigrams (each counted once) is 2c / (m + n). A
best window begins and ends with bigrams of the template, its size lies within
bounds that follow from the threshold, and it holds at least
t / (2 - t) of the template's bigrams: texts that hold fewer within any span
of the largest size are not compared. Before that, a text must hold a mark: a set of
words that together occur in more than the rest of a template's bigrams cannot
all be missing from a match.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.llm.common import table

THRESHOLD = 0.8

#: Notices and texts of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
#: Words that also fill ordinary prose, the last to be taken as marks.
PLAIN = frozenset("a above an and any anyone are as at be but by can code conditions copy copies data direct display distributed either even event files following for form forms free from general granted held hope if in included including is it its kind language later law list loss may met modify more name names no not notice of on one option or other out person persons portions possible program project provided public published purpose rights see sell services shall source specific subject terms that the this to under use used useful using version was way whether will with without work works written you your".split())


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of the normalised text (lower case, letters and digits), sorted; a lone word stands for itself."""
    w = re.findall(r"[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} or set(w))


def size_bounds(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Smallest and largest number of bigrams with which a Dice of ``threshold`` to ``n`` bigrams is possible."""
    return _least_shared(n, threshold), int(n * (2 - threshold) / threshold + 1e-9)


def _least_shared(n: int, threshold: float) -> int:
    """Bigrams that a match shares at least with a template of ``n``: it may have no others (rounding errors set aside)."""
    return max(1, math.ceil(n * threshold / (2 - threshold) - 1e-9))


def marks(templates: tuple[tuple[str, str], ...], threshold: float = THRESHOLD) -> list[str]:
    """Words of which every unit that matches some template holds at least one."""
    chosen: set[str] = set()
    for _, text in templates:
        grams = bigrams(text)
        need = len(grams) - _least_shared(len(grams), threshold) + 1

        def covered(grams: list[str] = grams) -> int:
            return sum(any(w in chosen for w in g.split()) for g in grams)

        for w in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in PLAIN or w.isdigit(), -len(w), w)):
            if covered() >= need:
                break
            chosen.add(w)
    return sorted(chosen)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Matches: doc_id, license, template, dice, first_word and end_word (of the words of letters a-z and digits, from 0).

    One row for each text and template of which some window reaches a
    coefficient of ``threshold``: its best window (of equal ones the first,
    then the shortest). Null, empty and wordless texts match nothing; repeated
    rows each give their matches; other columns are ignored; without documents
    or templates the result is empty.
    """
    spark, columns = docs.sparkSession, ("doc_id", "license", "template", "dice", "first_word", "end_word")
    rows = []
    for k, (name, text) in enumerate(templates):
        grams = bigrams(text)
        least, most = size_bounds(len(grams), threshold)
        one = [F.lit(x).alias(c) for c, x in (("license", name), ("template", k), ("n", len(grams)), ("least", least), ("most", most))]
        rows.append(F.struct(*one, F.array(*map(F.lit, grams)).alias("own")))
    if not rows:
        return docs.limit(0).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("license"), F.lit(0).alias("template"), F.lit(0.0).alias("dice"), F.lit(0).alias("first_word"), F.lit(0).alias("end_word"))
    known = spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.template", "r.n", "r.least", "r.most", F.explode("r.own").alias("gram"))
    names = F.array(*(F.lit(name) for name, _ in templates))

    marked = rf"(?<![a-z0-9])(?:{'|'.join(marks(templates, threshold))})(?![a-z0-9])"
    d = docs.where("text IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("t"))
    d = d.where(F.col("t").rlike(marked)).select("row", "doc_id", F.array_remove(F.split("t", "[^a-z0-9]+"), "").alias("w"))
    rest = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), rest), F.slice("w", F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b))
    placed = d.select("row", "doc_id", F.posexplode(pairs).alias("pos", "gram"))
    hits = placed.join(F.broadcast(known), "gram").repartition("row", "template")
    before = F.lag("pos").over(W.partitionBy("row", "template", "gram").orderBy("pos"))
    hits = hits.withColumn("before", F.coalesce(before, F.lit(-1)))
    found = hits.groupBy("row", "template", "doc_id", "n", "least", "most").agg(F.sort_array(F.collect_list(F.struct("pos", "before"))).alias("hits"))
    best = found.where(F.size("hits") >= F.col("least")).withColumn("best", _best_window()).where(F.col("best.dice") >= threshold)
    place = [(-F.col("best.first")).alias("first_word"), (2 - F.col("best.end")).alias("end_word")]
    return best.select("doc_id", F.element_at(names, F.col("template") + 1).alias("license"), "template", F.col("best.dice").alias("dice"), *place).select(*columns)


def _best_window() -> Column:
    """The best window of a template's ``hits`` (pos, before) in a text: dice, and its first and last bigram, negated so that the greatest is the first and shortest."""
    hits, n, least, most = (F.col(c) for c in ("hits", "n", "least", "most"))
    starts = F.filter(F.sequence(F.lit(0), F.size(hits) - least), lambda i: F.get(hits, i + least - 1)["pos"] - F.get(hits, i)["pos"] < most)

    def from_start(i: Column) -> Column:
        first = F.get(hits, i)["pos"]

        def step(acc: Column, hit: Column) -> Column:
            held = acc["held"] + (hit["before"] < first).cast("int")
            dice = 2.0 * held / (hit["pos"] - first + 1 + n)
            better = dice > acc["dice"]
            return F.struct(held.alias("held"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"), F.when(better, hit["pos"]).otherwise(acc["end"]).alias("end"))

        start = F.struct(F.lit(0).alias("held"), F.lit(0.0).alias("dice"), F.lit(0).alias("end"))
        return F.aggregate(F.slice(hits, i + 1, most), start, step, lambda acc: F.struct(acc["dice"].alias("dice"), (-first).alias("first"), (-acc["end"]).alias("end")))

    return F.array_max(F.transform(starts, from_start))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _op7_sql() -> str:
    rows = ", ".join(f"({k}, '{name}', {len(g)}, {size_bounds(len(g))[0]}, {size_bounds(len(g))[1]}, [{', '.join(map(repr, g))}])" for k, (name, text) in enumerate(TEMPLATES) for g in [bigrams(text)])
    return rf"""
WITH known(template, license, n, least, most, own) AS (VALUES {rows}),
grams AS (SELECT template, license, n, least, most, unnest(own) AS gram FROM known),
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT r, doc_id, unnest(range(len(w) - 1)) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w WHERE len(w) > 1),
hits AS (
  SELECT r, doc_id, template, license, n, most, pos, coalesce(lag(pos) OVER (PARTITION BY r, template, gram ORDER BY pos), -1) AS earlier
  FROM b JOIN grams USING (gram) QUALIFY count(*) OVER (PARTITION BY r, template) >= least
), windows AS (
  SELECT a.r, a.doc_id, a.template, a.license, a.pos AS head, k.pos AS tail,
         2.0 * sum(CASE WHEN k.earlier < a.pos THEN 1 ELSE 0 END) OVER (PARTITION BY a.r, a.template, a.pos ORDER BY k.pos) / CAST(k.pos - a.pos + 1 + a.n AS DOUBLE) AS dice
  FROM hits a JOIN hits k ON a.r = k.r AND a.template = k.template AND k.pos >= a.pos AND k.pos < a.pos + a.most
)
SELECT doc_id, license, template, CAST(dice AS DOUBLE) AS dice, CAST(head AS INTEGER) AS first_word, CAST(tail + 2 AS INTEGER) AS end_word
FROM windows WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY r, template ORDER BY dice DESC, head, tail) = 1
"""


OP7_SQL = _op7_sql()
