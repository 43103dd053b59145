"""License scans by diagonal voting, in DataFrame functions alone.

A text's words are numbered, and all of its runs of three words are joined, by hash and then by the
words themselves, to the places of runs of three in license templates. The place in the text less
the place in the template is a hit's diagonal: an unbroken copy of a template puts all its votes on
one. Other diagonals of a template that lie close, in shift and in place, are merged, so a copy with a few
words added, changed or left out is still one span. A span's votes are the distinct words of the template that its
hits cover, however often they repeat. It is verified if those are all words of the template, on one diagonal, for an exact phrase; for
the others if they are ``LEAST`` of the template's words and as great a share of the span's own words. Of verified spans that
overlap in the text those that miss the fewest words (the template's not covered and the span's own) are meant.
A template of fewer than nine words can't be told any more with a word changed far from its ends.

Cases: a null text is an empty one; texts of fewer than three words have no hits; very long texts are scanned whole, a row a run; places may overlap
only as the phrase itself allows; repeated rows and ids keep a row each; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a run, the least share of a template's words for a label, and the shift and words between diagonals to merge.
K, LEAST, DRIFT, GAP = 3, 0.8, 3, 12
#: Words that one number stands for in a set of a template's words.
WIDTH = 60

#: Phrases that are license labels as they stand.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

#: Sentences and whole texts of published licenses and of usual notices, with the label of each.
TEMPLATES = [
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]
_WORD = r"[^\x00-/:-`{-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of ASCII letters, digits and all characters beyond ASCII; a null text has none.

    ``lower`` maps two characters beyond ASCII into it: one is replaced first, the other keeps a mark beyond ASCII.
    """
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))), F.lit(_WORD), F.lit(0))


def _runs(words: str) -> Column:
    """All runs of K words, in order, each joined by spaces."""
    spelled = ", ".join(f"{words}[i + {n}]" for n in range(K))
    return F.expr(f"transform(if(size({words}) >= {K}, sequence(0, size({words}) - {K}), array()), i -> concat_ws(' ', {spelled}))")


def _sets(templates: list[str]) -> int:
    """How many numbers a set of any template's words takes."""
    return max([1, *(-(-len(re.findall(_WORD, t.lower())) // WIDTH) for t in templates)])


def template_places(docs: DataFrame, phrases: dict[str, str], templates: list[tuple[str, str]]) -> DataFrame:
    """``hash``, ``run``, ``template``, ``label``, ``exact``, ``size`` (words), ``place`` and ``set_0``, ... (bits of the words that the
    run covers) of each run of each template: a table as small as the templates.
    """
    rows = [(n, label, text, True) for n, (label, text) in enumerate(phrases.items())]
    rows += [(len(rows) + n, label, text, False) for n, (label, text) in enumerate(templates)]
    table = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(exact).alias("exact")) for n, label, text, exact in rows])
    one = docs.sparkSession.range(1).select(F.explode(table).alias("t")).select("t.*").withColumn("w", words_of(F.col("text")))
    places = one.select("template", "label", "exact", F.size("w").alias("size"), F.posexplode(_runs("w")).alias("place", "run"))
    bit = lambda i, k: f"if((place + {k}) div {WIDTH} = {i}, shiftleft(1L, CAST((place + {k}) % {WIDTH} AS INT)), 0L)"
    sets = [F.expr(" + ".join(bit(i, k) for k in range(K))).alias(f"set_{i}") for i in range(_sets([t for _, _, t, _ in rows]))]
    return places.select("*", *sets).withColumn("hash", F.xxhash64("run"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, ``n_words``, ``n_base`` (places of phrases), ``first_word`` and ``last_word`` (the
    least and greatest of these), ``base_labels``, ``labels`` (with those of verified spans), ``score`` (the greatest share of a
    template's words that a span covers) and ``spans`` (label, first and last word, share of each verified span).
    """
    if any(len(re.findall(_WORD, t.lower())) < K for t in [*phrases.values(), *(t for _, t in templates)]):
        raise ValueError(f"phrases and templates need {K} words")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"), words_of(docs[text_col]).alias("w"))
    # a last element that is no run keeps a row of each text
    runs = texts.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode(F.concat(_runs("w"), F.array(F.lit("")))).alias("pos", "run"))
    sets = [f"set_{i}" for i in range(_sets([*phrases.values(), *(t for _, t in templates)]))]
    nothing = [F.lit(0).cast("long").alias(c) for c in sets]
    none = docs.sparkSession.range(1).select(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("exact"), F.lit(1).alias("size"), F.lit(0).alias("place"), F.lit("").alias("run"), *nothing, F.xxhash64(F.lit("")).alias("hash"))
    places = template_places(docs, phrases, templates).unionByName(none)
    hits = runs.withColumn("hash", F.xxhash64("run")).join(F.broadcast(places), ["hash", "run"]).withColumn("diagonal", F.col("pos") - F.col("place"))
    key = ["row", "doc_id", "n_words"]
    either = [F.bit_or(c).alias(c) for c in sets]
    votes = hits.repartition("row").groupBy(*key, "template", "label", "exact", "size", "diagonal").agg(*either, F.min("pos").alias("from"), F.max("pos").alias("to"))
    covered = sum((F.bit_count(c) for c in sets), F.lit(0))
    votes = votes.withColumn("alone", F.col("exact") | (covered == F.col("size")))  # an unbroken copy isn't merged with what stands beside it
    line = Window.partitionBy("row", "template", "alone").orderBy("diagonal")
    gap = F.greatest(F.col("from") - F.lag("to").over(line), F.lag("from").over(line) - F.col("to"))
    apart = (gap > GAP) | (F.col("diagonal") - F.lag("diagonal").over(line) > DRIFT)
    marked = votes.withColumn("span", F.sum(F.when(apart | F.col("alone"), 1).otherwise(0)).over(line))
    spans = marked.groupBy(*key, "template", "label", "exact", "size", "alone", "span").agg(*either, F.min("from").alias("from"), (F.max("to") + K).alias("to"))
    spans = spans.withColumn("covered", covered).withColumn("share", F.col("covered") / F.col("size"))
    own = F.col("to") - F.col("from")
    whole = F.when(F.col("exact"), F.col("covered") == F.col("size")).otherwise((F.col("share") >= LEAST) & (F.col("covered") >= LEAST * own))
    spans = spans.withColumn("whole", (F.col("template") >= 0) & whole).withColumn("missed", F.col("size") - F.col("covered") + F.greatest(F.lit(0), own - F.col("covered")))
    # of the verified spans of templates that overlap, those that miss least are meant, and of these those that cover most
    said = Window.partitionBy("row", "rival").orderBy("from", "to", "template")
    spans = spans.withColumn("rival", F.col("whole") & ~F.col("exact"))
    fresh = F.when(F.col("from") >= F.max("to").over(said.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    spans = spans.withColumn("fresh", fresh).withColumn("place", F.sum("fresh").over(said))
    best = F.min(F.struct("missed", -F.col("covered"))).over(Window.partitionBy("row", "rival", "place"))
    spans = spans.withColumn("found", F.col("whole") & (F.col("exact") | (F.struct("missed", -F.col("covered")) == best)))
    base = F.col("exact") & F.col("found")
    names = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return spans.groupBy(*key).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("from").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("from").cast("long"))).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("found")).alias("labels"),
        F.max(F.when(F.col("template") >= 0, F.when(F.col("exact") & ~F.col("found"), 0.0).otherwise(F.col("share"))).otherwise(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct(F.col("from").cast("long").alias("first"), (F.col("to") - 1).cast("long").alias("last"), "label", "share")))).alias("spans"),
    ).drop("row")
