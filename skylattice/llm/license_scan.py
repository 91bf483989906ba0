"""License scan: exact phrases and an exact set-similarity join with templates, DataFrame operations only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from .words import LOWER, UPPER, by_text, words

#: Phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices and full texts of well-known licenses, as (label, text); words are cut as in documents.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. This notice may not be removed or altered from any source distribution."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details."""),
)
#: Sizes of text blocks, as (words of a block, words from one start to the next). A template is sought
#: in the least size whose overlap, block less step, has room for all its words, so that each place
#: where it stands whole lies in one block.
SIZES = ((48, 24), (512, 256), (4096, 2048))


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def size_of(n_words: int) -> int:
    """Which of SIZES; the last also for longer templates, of which a block must then hold enough."""
    return next((i for i, (block, step) in enumerate(SIZES) if n_words <= block - step), len(SIZES) - 1)


def phrase_starts(array: str, phrase: str) -> Column:
    parts = phrase.split()
    there = lambda i: F.forall(F.array(*(F.get(F.col(array), i + j) == F.lit(p) for j, p in enumerate(parts))), lambda x: x)
    n = F.size(array) - len(parts)
    return F.when(F.array_contains(array, parts[0]) & (n >= 0), F.filter(F.sequence(F.lit(0), n), there)).otherwise(F.array().cast("array<int>"))


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """Licences named in each text.

    Base: every place where the words of a phrase stand consecutively. Method: every block
    (``SIZES``) that holds at least ``threshold`` of the distinct words of a template. Template
    words are ordered by their frequency in the whole corpus, rarest first. A block can only
    reach the overlap ``need`` if it holds one of a template's ``size - need + 1`` rarest words
    (prefix filter), has ``need`` template words at all (length filter), and the words before
    and after a shared one leave room for ``need`` in both orders (positional filter); the rest
    is counted.

    The templates are a constant of the library (or a parameter), so the tables built from
    them are broadcast; the corpus never is. Null text is empty: no words, labels ''. Very long
    texts are read whole. Rows of one or no doc_id are judged each by its text, equal rows
    alike; an empty table gives no rows. Other columns are ignored.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. The score
    is 1 with a phrase, else the best containment that meets the threshold, else 0.
    """
    spark = docs.sparkSession
    cut_up = [(label, template_words(text)) for label, text in templates]
    sets = [(label, list(dict.fromkeys(ws)), size_of(len(ws))) for label, ws in cut_up]
    vocabulary = sorted({w for _, ws, _ in sets for w in ws})
    split = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("words"))

    counts = dict(split.select(F.explode("words").alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count().collect())
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    names = F.create_map(*(F.lit(x) for w in vocabulary for x in (w, rank[w])))
    match = None
    for k in sorted({size for _, _, size in sets}):
        (width, step), rows = SIZES[k], []
        for t, (label, ws, size) in enumerate(sets):
            if size == k:
                need, order = math.ceil(threshold * len(ws) - 1e-9), sorted(rank[w] for w in ws)
                rows += [(r, t, label, i, order, need) for i, r in enumerate(order[: len(order) - need + 1])]
        index = spark.createDataFrame(rows, "r int, t int, label string, i int, tokens array<int>, need int")
        own_words = F.array(*(F.lit(w) for w in vocabulary if any(rank[w] in row[4] for row in rows)))
        prefix = F.array(*(F.lit(w) for w in vocabulary if any(rank[w] == row[0] for row in rows)))
        near = split.where(F.arrays_overlap("words", prefix))
        pieces = near.select("doc_id", "th", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(step))).alias("b"))
        block = pieces.select("doc_id", "th", F.array_intersect(F.slice("words", F.col("b") + 1, width), own_words).alias("held"))
        block = block.where(F.arrays_overlap("held", prefix)).select("doc_id", "th", F.array_sort(F.transform("held", lambda w: names[w])).alias("own"))
        more = block.select("doc_id", "th", "own", F.posexplode("own").alias("j", "r")).join(F.broadcast(index), "r")
        more = more.where("size(own) >= need and least(i, j) + 1 + least(size(tokens) - i, size(own) - j) - 1 >= need")
        more = more.withColumn("both", F.size(F.array_intersect("own", "tokens"))).where("both >= need")
        more = more.select("doc_id", "th", "label", (F.col("both") / F.size("tokens")).alias("share"))
        match = more if match is None else match.unionByName(more)
    found = match.groupBy("doc_id", "th").agg(F.collect_set("label").alias("more"), F.max("share").alias("best"))

    base = split.select("doc_id", "th", F.size("words").cast("long").alias("n_words"), *(
        F.when(F.array_contains("words", "license"), phrase_starts("words", p)).otherwise(F.array().cast("array<int>")).alias(f"p{i}") for i, p in enumerate(PHRASES)))
    starts = [f"p{i}" for i in range(len(PHRASES))]
    base = base.select(
        "doc_id", "th", "n_words", F.concat(*starts).alias("all"),
        F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(F.size(p) > 0, F.lit(x)) for p, x in zip(starts, PHRASES.values(), strict=True))), lambda x: x.isNotNull()))).alias("named"),
    )
    return by_text(base, found, "left").select(
        "doc_id", "n_words", F.size("all").cast("long").alias("n_base"),
        F.array_min("all").cast("long").alias("first_word"), F.array_max("all").cast("long").alias("last_word"),
        F.array_join("named", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("named", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("all") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
