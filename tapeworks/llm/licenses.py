"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

In DataFrame operations only. A text is a stream of terms, so line breaks, comment marks and indents do not matter. A
segment is a window of as many terms as a template has, laid so that a term of the text falls on its own place in the
template; a licence file's whole text is a segment too. Terms are weighted tf * idf and compared by cosine with the
template's vector through joins on the term; the match of a whole text goes before those inside it. Inverse document frequencies come from the template set; a term in no
template has the highest one and counts in the norm.

Texts are scanned whole, with lossless filters first. For each template terms ("anchors", uncommon and heavy ones first) are chosen
so that the rest of its vector holds less than threshold**2 of its squared norm: by Cauchy-Schwarz a segment without
any anchor stays under the threshold, so only texts with an anchor go on and windows are laid at anchors alone. By the
same rule a window goes on only if its terms hold threshold**2 of the template's squared norm; only then it is exploded.

A file without a licence of its own takes that of the nearest directory above it, the root included, that has a
licensed licence file; directories are expanded to their ancestors (path depth bounds the rows) and joined by path.

Defined cases: null and empty texts have no licence of their own but inherit; a null path has no directory; a path without
a slash lies in the root; repeated rows are reported each; of equal scores the smaller identifier wins; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Notices by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Released under CC0 1.0 Universal public domain dedication"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]

#: The texts of short licences.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission. """
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
FULL = [("MIT", _MIT), ("ISC", _ISC), ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL), ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL)]

#: Words too common to anchor a template while other words will do.
COMMON = set("a an and any are as be by can do for from get in into is it may met of on or out that the this to under use v with without you".split())

LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-][\w.-]*)?$"
_TERM = r"[^\p{L}\p{N}.+-]+"


def terms(text):
    """Lower-cased terms; letters, digits and inner dots, plus or minus signs."""
    raw = F.split(F.lower(text), _TERM)
    return F.array_remove(F.transform(raw, lambda x: F.btrim(x, F.lit(".+-"))), "")


def py_terms(text: str) -> list[str]:
    out = "".join(c if c.isalnum() or c in ".+-" else " " for c in text.lower()).split()
    return [x for x in (t.strip(".+-") for t in out) if x]


class Templates:
    """Weighted vectors of the templates, idf by term and the anchors for a threshold. Its size is that of the template set.

    ``full`` texts are compared with whole licence files only, so they need no anchors; each holds a notice that has.
    """

    def __init__(self, templates=TEMPLATES, threshold: float = 0.8, full=FULL):
        self.threshold = threshold
        notices = len(templates)
        templates = [*templates, *full]
        bags = [Counter(py_terms(t)) for _, t in templates]
        n = len(bags)
        df = Counter(w for b in bags for w in b)
        self.idf = {w: math.log((1 + n) / (1 + d)) + 1 for w, d in df.items()}
        self.rest = math.log(1 + n) + 1
        self.postings: list[tuple[str, int, str, float]] = []
        self.anchors: set[str] = set()
        #: (anchor, template, licence, place of the anchor in the template, terms of the template)
        self.places: list[tuple[str, int, str, int, int]] = []
        for i, ((name, text), bag) in enumerate(zip(templates, bags)):
            weight = {w: c * self.idf[w] for w, c in bag.items()}
            norm = math.sqrt(sum(x * x for x in weight.values()))
            self.postings += [(w, i, name, x / norm) for w, x in sorted(weight.items())]
            if i >= notices:
                continue
            left = 1.0
            for w in sorted(weight, key=lambda w: (w in COMMON, -weight[w], w)):
                if left < threshold**2 - 1e-9:
                    break
                self.anchors.add(w)
                order = py_terms(text)
                self.places += [(w, i, name, at, len(order)) for at, x in enumerate(order) if x == w]
                left -= (weight[w] / norm) ** 2

    def pattern(self) -> str:
        return r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(w.replace(".", r"\.").replace("+", r"\+") for w in sorted(self.anchors)) + r")(?![\p{L}\p{N}])"


def own_licences(files: DataFrame, uid: str, templates: Templates) -> DataFrame:
    """(uid, license, score) of the best segment of each file that reaches the threshold."""
    spark = files.sparkSession
    least = templates.threshold**2 - 1e-9
    #: The template set is fixed and small: a row per distinct term, per template and term, and per anchor and place.
    idf = F.broadcast(spark.createDataFrame(sorted(templates.idf.items()), "term string, idf double"))
    postings = F.broadcast(spark.createDataFrame(templates.postings, "term string, template int, license string, weight double"))
    vectors: dict = {}
    for w, i, _, x in templates.postings:
        vectors.setdefault(i, []).append((w, x * x))
    places = spark.createDataFrame([(*p, vectors[p[1]]) for p in templates.places], "anchor string, template int, license string, place int, terms int, vector array<struct<term:string,square:double>>")

    named = files.select(F.col(uid).alias("uid"), F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE).alias("whole"), "text")
    anchors = sorted(templates.anchors)
    found = named.where(F.col("text").rlike(templates.pattern())).select("uid", terms(F.col("text")).alias("all"))
    # One look at each term; a filter on the array would have the text split again.
    at = F.filter(F.transform("all", lambda x, i: F.when(x.isin(anchors), i)), lambda i: i.isNotNull())
    laid = found.select("uid", "all", F.explode(at).alias("at")).withColumn("anchor", F.get("all", "at")).join(F.broadcast(places), "anchor")
    laid = laid.withColumn("at", F.col("at") - F.col("place"))
    start = F.greatest("at", F.lit(0))
    windows = laid.select("uid", "template", "vector", "at", F.slice("all", start + 1, F.col("at") + F.col("terms") - start).alias("window"))
    held = F.aggregate("vector", F.lit(0.0), lambda a, v: a + F.when(F.array_contains(F.col("window"), v["term"]), v["square"]).otherwise(0.0))
    windows = windows.where(held >= least).select("uid", "template", "at", "window").distinct()
    files_whole = named.where("whole").where(F.col("text").rlike(templates.pattern())).withColumn("all", terms(F.col("text"))).select("uid", F.lit(None).cast("int").alias("template"), F.lit(0).alias("at"), F.col("all").alias("window"))
    segments = windows.unionByName(files_whole)

    by = ["uid", "template", "at"]
    counted = segments.select(*by, F.explode("window").alias("term")).groupBy(*by, "term").agg(F.count("*").alias("tf"))
    weighted = counted.join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(templates.rest)))
    own = postings.select("term", F.col("template").alias("with"), "license", "weight")
    dots = weighted.join(own, "term", "left").withColumn("fits", F.coalesce(F.col("template") == F.col("with"), F.col("with").isNotNull()))
    norms = weighted.groupBy(*by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = dots.where("fits").groupBy(*by, "with", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    same = (F.col("d.uid") == F.col("n.uid")) & (F.col("d.at") == F.col("n.at")) & F.col("d.template").eqNullSafe(F.col("n.template"))
    scored = dots.alias("d").join(norms.alias("n"), same).select("d.uid", "d.license", F.col("d.template").isNotNull().alias("part"), F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= templates.threshold)
    best = scored.groupBy("uid").agg(F.min(F.struct("part", (-F.col("score")).alias("back"), "license")).alias("best"))
    return best.select("uid", "best.license", (-F.col("best.back")).alias("score"))


def scan(files: DataFrame, templates: Templates | None = None) -> DataFrame:
    """One row per file of ``files(doc_id, path, text)``: doc_id, path, license, origin, score, licence_dir."""
    templates = templates or Templates()
    uid = common.free_name(files, "uid")
    own = common.with_uid(files, uid)
    found = own_licences(own, uid, templates)
    slim = own.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long"), "path")
    known = common.save(slim.join(found, "uid", "left").withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)), "licences")

    name = F.element_at(F.split("path", "/"), -1)
    granted = known.where(F.col("license").isNotNull() & name.rlike(LICENCE_FILE)).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("back"), "license")).alias("g"))
    granted = granted.select(F.col("dir").alias("licence_dir"), F.col("g.license").alias("inherited"))
    steps = F.split("dir", "/")
    # The root is '', for relative and absolute paths alike.
    above = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))))
    dirs = known.where("dir is not null").groupBy("dir").agg(F.lit(1).alias("one")).select("dir", F.posexplode(above).alias("depth", "licence_dir"))
    nearest = dirs.join(granted, "licence_dir").groupBy("dir").agg(F.max(F.struct("depth", "licence_dir", "inherited")).alias("near"))
    # Written first, so that the join deals out the files of a very large directory itself.
    nearest = common.save(nearest.select("dir", F.col("near.licence_dir").alias("licence_dir"), F.col("near.inherited").alias("inherited")), "nearest")
    joined = known.join(nearest, "dir", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return joined.select(
        "doc_id", "path", F.coalesce("license", "inherited").alias("license"), origin.alias("origin"), "score",
        F.when(origin == "inherited", F.col("licence_dir")).alias("licence_dir"),
    )
