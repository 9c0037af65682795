"""License scans by diagonal voting. DataFrame functions only.

Rolling word k-grams of every text are hashed and joined to the k-grams of license
templates. A hit at word i of the text and word t of the template votes for the diagonal
i - t. Neighbouring diagonals merge (a word put in or left out moves a passage by one),
and a span is accepted when the template k-grams found in it, equal word by word, cover
enough of the template. Base phrases are found beside that by their words alone.

A k-gram's row holds its own words and nothing else of the text, so rows and time are in
proportion to a text's length. Templates may have any length: what is found of one is a
set of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import LOWER, UPPER, fixed

#: Words in a k-gram; how far diagonals of one span may lie apart; the part of a template's k-grams that has to be found.
K, SLACK, MIN_COVER = 3, 2, 0.75
#: How much longer than its template a span may be: twice the slack, or this part of the template.
LONGER = 0.1

#: What stands between words, base phrases with their labels, and notices that licenses ask to be quoted.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS "
        "AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
        "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
        "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ),
]


def folded(text: Column) -> Column:
    """A-Z lower-cased; null gives the empty text.

    lower() is fast and does the same to A-Z; other letters it may change stay word
    characters. Only U+0130 and U+212A would become ASCII letters, so such texts go
    the slow way.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike("[İK]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """The words of a folded text."""
    return F.array_remove(F.split(text, BETWEEN), "")


def gram_table(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """(label, tid, t, size, th, tw): every k-gram of every template, hash and words. It grows with the templates alone."""
    source = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "tid int, label string, text string")
    words = source.select("tid", "label", words_of(folded(F.col("text"))).alias("w")).filter(F.size("w") >= k)
    grams = words.select("tid", "label", (F.size("w") - (k - 1)).alias("size"), "w", F.posexplode(gram_hashes("w", k)).alias("t", "th"))
    return grams.select("tid", "label", "size", "t", "th", F.slice("w", F.col("t") + 1, F.lit(k)).alias("tw"))


def gram_hashes(words: str, k: int) -> Column:
    w = F.col(words)
    return F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)])
    )


def spans(docs: DataFrame, key: list[str], words: str, templates: list[tuple[str, str]] = TEMPLATES, k: int = K, slack: int = SLACK, min_cover: float = MIN_COVER) -> DataFrame:
    """(key columns, label, tid, first, last, cover): accepted spans, words first to last of the text."""
    w = F.col(words)
    starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0)))
    gram = lambda x, i: F.struct(i.alias("i"), F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]).alias("h"), F.slice(w, i + 1, F.lit(k)).alias("gw"))
    grams = docs.select(*key, F.explode(F.transform(starts, gram)).alias("g")).select(*key, "g.i", "g.h", "g.gw")
    table = F.broadcast(gram_table(docs.sparkSession, templates, k))  # a row for each word of the templates
    hits = grams.join(table, (F.col("h") == F.col("th")) & (F.col("gw") == F.col("tw")))
    diagonals = hits.groupBy(*key, "tid", "label", "size", (F.col("i") - F.col("t")).alias("diagonal")).agg(
        F.collect_set("t").alias("found"), F.min("i").alias("lo"), F.max("i").alias("hi")
    )
    order = Window.partitionBy(*key, "tid", "label", "size").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    runs = diagonals.withColumn("new", F.when(step <= slack, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    merged = runs.groupBy(*key, "tid", "label", "size", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n"), F.min("lo").alias("first"), (F.max("hi") + (k - 1)).alias("last")
    )
    cover = F.col("n") / F.col("size")
    whole = F.col("last") - F.col("first") < F.col("size") + (k - 1) + F.greatest(F.lit(2.0 * slack), F.col("size") * LONGER)
    return merged.filter((cover >= min_cover) & whole).select(*key, "label", "tid", "first", "last", cover.alias("cover"))


def base_places(words: str, text: str) -> Column:
    """Struct (phrase number, place) of every place where a base phrase's words stand."""
    w = F.col(words)
    parts = [p.split() for p in PHRASES]

    def at(i: Column, phrase: list[str]) -> Column:
        test = F.get(w, i) == phrase[0]
        for j, word in enumerate(phrase[1:], 1):
            test = test & (F.get(w, i + j) == word)
        return test

    def places(n: int, phrase: list[str]) -> Column:
        found = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: at(i, phrase))
        return F.transform(found, lambda i: F.struct(F.lit(n).alias("p"), i.alias("i")))

    lists = [places(n, phrase) for n, phrase in enumerate(parts)]
    # a text without all words of a phrase is passed over whole
    none = F.array().cast("array<struct<p:int,i:int>>")

    def there(phrase: list[str]) -> Column:
        test = F.lit(True)
        for word in phrase:
            test = test & F.contains(F.col(text), F.lit(word))
        return test

    return F.concat(*[F.when(there(p), x).otherwise(none) for p, x in zip(parts, lists, strict=True)])


def scanned(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    score: 1 with a base label, else the cover of the best span, else 0. Null and empty
    texts have no words, and empty labels. Rows repeat as given, and rows that repeat a key
    with another text keep their own findings. Very long texts are scanned whole. An empty
    table gives an empty one. Extra columns are not looked at.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(F.col(key).alias("key"), F.xxhash64(t).alias("th"), F.length(t).alias("tn"), folded(t).alias("folded"))
    cut = cut.withColumn("words", words_of(F.col("folded")))
    names = list(PHRASES.values())
    base = cut.withColumn("places", base_places("words", "folded")).select(
        "key", "th", "tn",
        F.size("words").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["i"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda x: x["i"])).cast("long").alias("last_word"),
        F.transform(F.array_distinct(F.transform("places", lambda x: x["p"])), lambda p: F.get(F.array(*[F.lit(n) for n in names]), p)).alias("named"),
    )
    base = fixed(base, "n_words", "n_base", "first_word", "last_word", "named")
    texts = cut.select(F.col("key").cast("string").alias("d_key"), F.col("th").alias("d_th"), F.col("tn").alias("d_tn"), "words")
    found = spans(texts, ["d_key", "d_th", "d_tn"], "words")
    best = found.groupBy("d_key", "d_th", "d_tn").agg(F.collect_set("label").alias("own"), F.max("cover").alias("cover"))
    joined = base.join(best, F.col("key").cast("string").eqNullSafe(F.col("d_key")) & (F.col("th") == F.col("d_th")) & (F.col("tn") == F.col("d_tn")), "left")
    empty = F.array().cast("array<string>")
    return joined.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("named"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("named", F.coalesce("own", empty))), ",").alias("labels"),
        F.when(F.size("named") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )


def oracle(table: str = "documents") -> str:
    """DuckDB SQL of scanned()."""
    quoted = [text.replace("'", "''") for _, text in TEMPLATES]
    values = ", ".join(f"({i}, '{label}', '{quoted[i]}')" for i, (label, _) in enumerate(TEMPLATES))
    cut = r"regexp_extract_all(translate({}, '" + UPPER + "', '" + LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    return f"""
with d as (select row_number() over () rid, doc_id, {cut.format("coalesce(text, '')")} w from {table}),
tt as (select tid, label, {cut.format("text")} w from (values {values}) v(tid, label, text)),
tg as (select tid, label, t, len(w) - {K - 1} size, array_to_string(w[t + 1:t + {K}], ' ') g from (select *, unnest(range(0, len(w) - {K - 1})) t from tt)),
dg as (select rid, i, array_to_string(w[i + 1:i + {K}], ' ') g from (select *, unnest(range(0, len(w) - {K - 1})) i from d where len(w) >= {K})),
di as (select rid, tid, label, size, i - t dg, list(distinct t) f, min(i) lo, max(i) hi from dg join tg using (g) group by all),
st as (select *, case when dg - lag(dg) over (partition by rid, tid order by dg) <= {SLACK} then 0 else 1 end nw from di),
ru as (select *, sum(nw) over (partition by rid, tid order by dg) run from st),
me as (select rid, tid, label, size, len(list_distinct(flatten(list(f)))) n, min(lo) a, max(hi) + {K - 1} b from ru group by rid, tid, label, size, run),
sp as (select rid, label, n::double / size cover from me where n::double / size >= {MIN_COVER} and b - a < size + {K - 1} + greatest({2 * SLACK}, size * {LONGER})),
ph as (select string_split(p, ' ') p, label from (values {phrases}) v(p, label)),
bp as (select rid, label, i from (select rid, w, unnest(range(0, len(w))) i from d) join ph on w[i + 1] = p[1] where w[i + 1:i + len(p)] = p),
ba as (select rid, count(*) n, min(i) a, max(i) b, array_to_string(list_sort(list(distinct label)), ',') l from bp group by 1),
lb as (select rid, array_to_string(list_sort(list(distinct label)), ',') l from (select rid, label from bp union all select rid, label from sp) group by 1),
sc as (select rid, max(cover) c from sp group by 1)
select doc_id, len(w)::bigint n_words, coalesce(ba.n, 0)::bigint n_base, ba.a::bigint first_word, ba.b::bigint last_word,
  coalesce(ba.l, '') base_labels, coalesce(lb.l, '') labels, case when ba.n > 0 then 1.0 else coalesce(sc.c, 0.0) end::double score
from d left join ba using (rid) left join lb using (rid) left join sc using (rid)"""
