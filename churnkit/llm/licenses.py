"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Everything is DataFrame expressions: no Python runs on the executors.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.llm.common import WORD, materialise, text_of

#: (licence, notice text as it is usually put in headers or opens the licence file); fixed values
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights, released under CC0 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
)
_GNU = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
#: (licence, whole text of its licence file); compared like the notices
FILE_TEMPLATES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
)
#: (licence, opening of its long licence file); compared like the notices
FILE_OPENINGS = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _GNU),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. " + _GNU),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _GNU),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _GNU),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("CC0-1.0", "CC0 1.0 Universal Statement of Purpose The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights upon the creator and subsequent owner(s) of an original work of authorship"),
) + tuple((name, f"{t} 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this {t} 4.0 International Public License")
          for name, t in (("CC-BY-4.0", "Creative Commons Attribution"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike"),
                          ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial"), ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives")))
#: a term is a run of these characters in lower-cased text
TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
#: base names of files that hold a directory's licence
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
MIN_COSINE = 0.6
FILE_SHARE = 0.5  # of a text's words that are the licence file's, in a file that states its directory's licence
LINES = 4  # lines of a run of lines; windows of words have no such bound
FILE_COSINE = 0.8  # of the opening of a licence file, if it is to tell the rest
FILE_HEAD = 20  # words that may stand before it, as a heading or the holder's name


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text in templates for w in re.findall(TERM, text.lower())})


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, licence, term, tf): sparse vectors, one row per term."""
    rows = []
    for k, (name, text) in enumerate(templates):
        words = re.findall(TERM, text.lower())
        rows += [(k, name, w, float(words.count(w))) for w in sorted(set(words))]
    return spark.createDataFrame(rows, "template int, licence string, term string, tf double")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES,
         min_cosine: float = MIN_COSINE, file_share: float = FILE_SHARE, file_templates=FILE_TEMPLATES, file_openings=FILE_OPENINGS) -> DataFrame:
    """One row per input row: path, own_licence, cosine, licence_file, licence, inherited_from.

    Compared with the templates are: lines of a text, runs of up to ``LINES`` lines
    that each hold a licence term, and, whatever the lines, windows of as many words
    as a template has and of twice as many (with that template): they begin so that
    a term without which it can't be reached has the same place in both, and are cut
    to begin and end with a word of it.  The best cosine of ``min_cosine`` or more names the file's
    own licence (ties: the earlier template).  Inverse document frequencies, of
    whatever term, come from all texts.  A file with a licence of its own is its
    directory's licence file if its base name says so, if words of one of
    ``file_templates`` (whole licence files) are ``file_share`` of its words or more,
    or if one of ``file_openings`` is met with ``FILE_COSINE`` at its beginning
    (``FILE_HEAD`` words may precede).  A notice alone, however short its file, is a
    header: it names the file's own licence and grants nothing to its neighbours.
    A file with no licence of its own takes that of the nearest directory at or
    above it which has a licence file (several: the best cosine, then the smallest
    path); inherited_from is that directory ('' for the root).  Null or empty text
    has no licence of its own; a null path is in no directory and inherits nothing;
    repeated rows come out repeatedly; an empty table gives an empty result; other
    columns are not read.
    """
    spark = files.sparkSession
    templates = (*templates, *file_templates, *file_openings)
    first_opening = len(templates) - len(file_openings)
    first_file = first_opening - len(file_templates)
    vocab = vocabulary(templates)
    base = files.select(F.col(path_col).cast("string").alias("path"), text_of(text_col).alias("text"),
                        F.xxhash64(F.coalesce(F.col(path_col).cast("string"), F.lit("")), text_of(text_col)).alias("key"))

    # document frequencies of all terms over all whole texts
    lower = F.lower("text")
    words = F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))
    seen = materialise(base.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    n_docs = base.count()

    def weighed(terms: DataFrame, name: str) -> DataFrame:
        """(term, idf) of a table of distinct terms."""
        return materialise(terms.join(seen, "term", "left").select(
            "term", (F.log(F.lit(n_docs + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0).alias("idf")), name)

    idf = weighed(spark.createDataFrame([(w,) for w in vocab], "term string"), "idf")
    vectors = template_table(spark, templates).join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    weights = vectors.collect()  # the templates' few hundred terms
    norm: dict[int, float] = {}
    for r in weights:
        norm[r.template] = norm.get(r.template, 0.0) + r.w ** 2

    # terms without which no template can be reached, rare ones first: a segment that has none of them stays below min_cosine
    anchors, anchors_of = set(), {}
    for t in norm:
        rest, mine = norm[t], sorted((r for r in weights if r.template == t), key=lambda r: -r.w / r.tf)
        for r in mine:
            if math.sqrt(rest / norm[t]) < min_cosine:
                break
            anchors_of.setdefault(t, []).append(r.term)
            rest -= r.w ** 2
        anchors.update(anchors_of[t])
    pattern = r"(?<![a-z0-9])(?:" + "|".join(sorted(map(re.escape, anchors))) + r")(?![a-z0-9])"

    # lines with an anchor, and runs of consecutive ones
    marked = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.lower(x).alias("line"))), lambda s: s["line"].rlike(pattern))
    n_words = F.regexp_count("text", F.lit(WORD))
    marks = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: F.array_contains(F.lit(sorted(anchors)), s["w"]))
    held = materialise(base.where(F.arrays_overlap(words, F.lit(sorted(anchors)))).select("key", n_words.alias("n_words"), marked.alias("lines"), words.alias("words"))
                       .dropDuplicates(["key"]).withColumn("marks", marks), "marked-lines")
    one = held.select("key", "n_words", "lines", F.explode("lines").alias("l")).withColumn(
        "run", F.filter("lines", lambda s: (s["i"] >= F.col("l.i")) & (s["i"] < F.col("l.i") + LINES)))
    joined = [F.when((F.size("run") >= k) & (F.get("run", F.lit(k - 1))["i"] == F.col("l.i") + k - 1),
                     F.concat_ws(" ", *[F.get("run", F.lit(j))["line"] for j in range(k)])) for k in range(1, LINES + 1)]
    found = one.select("key", "n_words", F.explode(F.array(*joined)).alias("segment")).where("segment is not null")

    # windows of words: where a term that a template can't do without stands in the text as it does in the template
    shapes = []
    for t in norm:
        mine, need = re.findall(TERM, templates[t][1].lower()), set(anchors_of[t])
        shapes.append((t, len(mine), [(w, q) for q, w in enumerate(mine) if w in need], sorted(set(mine)),
                       [(r.term, r.w ** 2) for r in weights if r.template == t], min_cosine ** 2 * norm[t] * (1 - 1e-9)))
    shapes = spark.createDataFrame(shapes, "template int, n int, places array<struct<term: string, q: int>>, terms array<string>, "
                                           "squares array<struct<term: string, w2: double>>, least double")
    begins = F.array_distinct(F.flatten(F.transform("marks", lambda m: F.transform(
        F.filter("places", lambda p: p["term"] == m["w"]), lambda p: F.greatest(m["i"] - p["q"], F.lit(0))))))
    starts = (held.select("key", "n_words", "words", "marks").crossJoin(F.broadcast(shapes)).withColumn("begins", begins).where(F.size("begins") > 0)
              .withColumn("s", F.explode(F.transform("begins", lambda b: F.struct(b.alias("at"), F.slice("words", b + 1, F.col("n") * 2).alias("window")))))
              .select("key", "n_words", "template", "n", "terms", "squares", "least", "s.at", F.explode(F.array(F.col("s.window"), F.slice("s.window", F.lit(1), F.col("n")))).alias("window")))
    weight = F.aggregate(F.filter("squares", lambda s: F.array_contains("window", s["term"])), F.lit(0.0), lambda a, s: a + s["w2"])
    hits = F.filter(F.transform("window", lambda w, i: F.when(F.array_contains("terms", w), i)), lambda i: i.isNotNull())
    windows = (starts.where(weight >= F.col("least")).withColumn("hits", hits).withColumn("first", F.get("hits", F.lit(0)))
               .select("key", "n_words", "template", (F.col("at") + F.col("first")).alias("at"),
                       F.array_join(F.slice("window", F.col("first") + 1, F.element_at("hits", -1) - F.col("first") + 1), " ").alias("segment")))
    windows = materialise(windows.groupBy("key", "n_words", "template", "segment").agg(F.min("at").alias("at")), "windows")

    # each distinct segment is compared once, lines with all templates and windows with theirs
    lines = materialise(found.select("segment").distinct(), "line-segments")
    pairs = materialise(windows.select("segment", "template").distinct().join(lines, "segment", "left_anti"), "window-segments")
    segments = lines.unionByName(pairs.select("segment").distinct())
    tf = materialise(segments.select("segment", F.explode(F.regexp_extract_all("segment", F.lit(TERM), F.lit(0))).alias("term"))
                     .groupBy("segment", "term").agg(F.count(F.lit(1)).cast("double").alias("tf")), "segment-terms")
    tf = tf.join(weighed(tf.select("term").distinct(), "segment-idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    tnorm = spark.createDataFrame([(t, math.sqrt(v)) for t, v in norm.items()], "template int, tnorm double")
    length = tf.groupBy("segment").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("snorm"))
    held_by = F.broadcast(vectors.select("template", "licence", "term", F.col("tf").alias("ttf"), F.col("w").alias("tw")))
    both = (tf.join(lines, "segment").join(held_by, "term")
            .unionByName(tf.join(pairs, "segment").join(held_by, ["template", "term"])))
    dots = (both.groupBy("segment", "template", "licence")
            .agg(F.sum(F.col("w") * F.col("tw")).alias("dot"), F.sum(F.least("tf", "ttf")).alias("matched")))
    cosines = (dots.join(F.broadcast(tnorm), "template").join(length, "segment")
               .select("segment", "licence", "template", "matched", F.round(F.col("dot") / (F.col("tnorm") * F.col("snorm")), 9).alias("cosine"),
                       (F.col("dot") / (F.col("tnorm") * F.col("snorm"))).alias("exact")).where(F.col("exact") >= min_cosine).drop("exact"))
    cosines = materialise(cosines, "segments")
    met = (found.select("key", "n_words", "segment", F.lit(None).cast("int").alias("at")).join(cosines, "segment")
           .unionByName(windows.join(cosines, ["segment", "template"])))
    opens = (F.col("template") >= first_opening) & (F.col("at") <= FILE_HEAD) & (F.col("cosine") >= FILE_COSINE)
    whole = F.col("template").between(first_file, first_opening - 1) & (F.col("matched") >= F.col("n_words") * F.lit(file_share))
    share = whole | F.coalesce(opens, F.lit(False))
    own = (met.withColumn("most", share).groupBy("key")
           .agg(F.max(F.struct("cosine", (-F.col("template")).alias("t"), "licence")).alias("own"), F.max("most").alias("whole")))
    own = materialise(own.select("key", "own.licence", "own.cosine", "whole"), "own")

    name = F.element_at(F.split("path", "/"), -1)
    parent = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    rows = materialise(base.select("path", "key").join(own, "key", "left").select(
        "path", F.when(F.col("path").isNotNull(), parent).alias("dir"), F.col("licence").alias("own_licence"), F.round("cosine", 6).alias("cosine"),
        (F.col("licence").isNotNull() & F.col("path").isNotNull() & (F.col("whole") | name.rlike(LICENCE_FILE))).alias("licence_file")), "files")
    grants = materialise(rows.where("licence_file").groupBy("dir")
                         .agg(F.max(F.col("cosine")).alias("c"), F.min_by("own_licence", F.struct(-F.col("cosine"), F.col("path"))).alias("granted"))
                         .select("dir", "granted"), "grants")
    # each distinct directory looks up itself and its ancestors; the deepest that grants a licence wins
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(parts))),
                     lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("at")))
    dirs = rows.where("dir is not null").select("dir").distinct().select("dir", F.explode(up).alias("u")).select("dir", "u.depth", "u.at")
    nearest = materialise(dirs.join(grants.withColumnRenamed("dir", "at"), "at").groupBy("dir")
                          .agg(F.max(F.struct("depth", "granted", "at")).alias("n")).select("dir", "n.granted", "n.at"), "nearest")
    return rows.join(nearest, "dir", "left").select(
        F.col("path").alias(path_col), "own_licence", "cosine", "licence_file",
        F.coalesce("own_licence", "granted").alias("licence"),
        F.when(F.col("own_licence").isNull(), F.col("at")).alias("inherited_from"))
