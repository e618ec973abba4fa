"""Licence notices in texts: a sparse word n-gram logistic regression over paragraphs.

Features are the words and word pairs of a paragraph that occur in the notice
templates, present or not.  A multinomial logistic regression tells the
families and an unknown class apart; it is trained on the templates with their
variants and, for the unknown class, on paragraphs of a bounded sample of the
corpus that share little with any template.  Every family stands whose
probability against the unknown class passes a threshold calibrated on held-back
rows and of which a template is contained in the paragraph to a set share, also
in what it has apart from the other families' contained templates.

Paragraphs are the lines and, for notices wrapped over lines, windows over the
words of the whole text; each run of WINDOW words is whole in some window.

Scoring is one narrow pass of SQL functions.  Weights are constants of the plan
(the vocabulary comes from the templates, so its size is fixed).  Anchor words
are chosen for each template so that a paragraph without any of them cannot
contain enough of it to be confirmed; rare words first.  Texts without an anchor
word are thus done after a substring search, exactly.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read, written

UNKNOWN = "unknown"
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "under the terms of the GNU Affero General Public License as published by"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Distributed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Released under the BSD 3-Clause License.", "Licensed under the BSD License.", "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2 or later.", "This program is free software under the terms of the GNU General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "under the terms of the GNU General Public License as published by", "You should have received a copy of the GNU General Public License along with this program", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only"],
    "isc": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "SPDX-License-Identifier: ISC"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License as published by", "You should have received a copy of the GNU Lesser General Public License along with this library", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "This software is available under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT"],
    "mpl": ["Licensed under the Mozilla Public License, version 2.0.", "This source code is subject to the terms of the Mozilla Public License.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright, all rights reserved.", "No part of this work may be copied without written permission."],
    "public-domain": ["This work is in the public domain.", "Dedicated to the public domain under CC0 1.0.", "No rights reserved, public domain.",
        "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: CC0-1.0", "SPDX-License-Identifier: Unlicense"],
}
#: Documents whose paragraphs train the unknown class, paragraphs of each, characters of a paragraph.
SAMPLE, PARAGRAPHS, PARAGRAPH_CHARS = 400, 20, 2000
#: Share of a template's words and pairs that a paragraph must contain.
CONTAINED = 0.7
#: Words of a wrapped notice that some window holds whole; windows start at every WINDOW-th word and are twice as long.
WINDOW = 60
_WORD = "[a-z0-9]+"


def words(paragraph: Column) -> Column:
    return F.regexp_extract_all(F.lower(paragraph), F.lit(_WORD), F.lit(0))


def grams(paragraph: Column) -> Column:
    """Distinct words and word pairs of a paragraph."""
    return grams_in(words(paragraph))


def grams_in(found: Column) -> Column:
    """Distinct words and word pairs of an array of words."""
    pairs = F.zip_with(found, F.slice(found, 2, F.size(found)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(found, F.filter(pairs, lambda p: p.contains(" "))))


def grams_of(text: str) -> list[str]:
    """What grams() gives, for the templates on the driver."""
    found = re.findall(_WORD, text.lower())
    return list(dict.fromkeys(found + [f"{a} {b}" for a, b in zip(found, found[1:])]))


def variants(template: str) -> list[str]:
    """A template, without its first and last word, and after a year and a name."""
    parts = template.split()
    out = [template, " ".join(parts[1:]), " ".join(parts[:-1]), f"Copyright 2024 the authors. {template}"]
    return [v for v in out if len(v.split()) >= min(3, len(parts))]


def _constant(value, kind: str) -> Column:
    """A constant of any shape, folded into the plan."""
    return F.from_json(F.lit(json.dumps({"x": value})), f"x {kind}")["x"]


class Model:
    """Trained weights (gram -> one weight a class), intercepts, threshold and anchor words."""

    def __init__(self, families: list[str], weights: dict[str, list[float]], intercepts: list[float], threshold: float, anchors: list[str]) -> None:
        self.families, self.weights, self.intercepts, self.threshold, self.anchors = families, weights, intercepts, threshold, anchors


def anchors_of(templates: list[list[str]], often: dict[str, int], share: float = CONTAINED) -> list[str]:
    """Words without which no template (a list of grams) is contained to the share, seldom ones preferred."""
    chosen: list[str] = []
    for grams_ in templates:
        left = [g for g in grams_ if not set(g.split()) & set(chosen)]
        while len(left) >= share * len(grams_):
            gain: dict[str, int] = {}
            for g in left:
                for w in g.split():
                    gain[w] = gain.get(w, 0) + 1
            best = min(sorted(gain), key=lambda w: ((often.get(w, 0) + 1) / gain[w], -len(w)))
            chosen.append(best)
            left = [g for g in left if best not in g.split()]
    return sorted(chosen)


def sample_of(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Column t: up to PARAGRAPHS paragraphs (by hash, of the whole text) of each of SAMPLE documents, those with the smallest hashes.

    The hash is of key and text; rows that repeat both count once, so neither
    null nor repeated keys make the sample larger.  Of a paragraph of more than
    PARAGRAPH_CHARS characters a stretch at a place by hash is taken.
    """
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    place = F.pmod(F.xxhash64(F.col(f"`{key}`"), raw), F.lit(1 << 40))
    rows = docs.select(place.alias("place"), raw.alias("t"))
    n = rows.agg(F.approx_count_distinct("place", 0.05)).first()[0] or 1

    def stretch(p: Column) -> Column:
        past = F.greatest(F.length(p) - PARAGRAPH_CHARS, F.lit(0))
        return F.substring(p, F.floor(past * (F.pmod(F.xxhash64(p), F.lit(1000)) / 1000.0)).cast("int") + 1, F.lit(PARAGRAPH_CHARS))

    every = F.filter(F.split("t", "\n"), lambda p: F.trim(p) != "")
    some = F.slice(F.array_sort(F.transform(every, lambda p: F.struct(F.xxhash64(p).alias("h"), stretch(p).alias("p")))), 1, PARAGRAPHS)
    near = rows.where(F.col("place") / float(1 << 40) < 2 * SAMPLE / n)
    chosen = near.select("place", F.transform(some, lambda x: x["p"]).alias("ps")).groupBy("place").agg(F.first("ps").alias("ps"))
    return chosen.orderBy("place").limit(SAMPLE).select(F.array_join("ps", "\n").alias("t"))


def training_rows(sampled: DataFrame) -> DataFrame:
    """(family, grams, held): template variants, repeated, and unknown paragraphs of the sample."""
    spark = sampled.sparkSession
    rows = [(f, v) for f, ts in TEMPLATES.items() for t in ts for v in variants(t)]
    known = spark.range(20).select("id", F.explode(_constant([{"f": f, "p": p} for f, p in rows], "array<struct<f:string,p:string>>")).alias("x"))
    known = known.select(F.col("x.f").alias("family"), grams(F.col("x.p")).alias("grams"), (F.col("id") % 4 == 0).alias("held"))
    paragraphs = sampled.select(F.explode(F.split("t", "\n")).alias("p")).where(F.length(F.trim("p")) > 0).select("p", grams(F.col("p")).alias("grams"))
    others = paragraphs.where(contained(F.col("grams"), None) < 0.4).select(F.lit(UNKNOWN).alias("family"), "grams", (F.pmod(F.xxhash64("p"), F.lit(4)) == 0).alias("held"))
    empty = spark.range(1).select(F.lit(UNKNOWN).alias("family"), F.array().cast("array<string>").alias("grams"), F.lit(False).alias("held"))
    return known.unionByName(others).unionByName(empty)


def contained(found: Column, family: Column | None) -> Column:
    """The largest share of a template (of the family, or of any) that the grams contain."""
    table = _constant([{"f": f, "g": grams_of(t)} for f, ts in TEMPLATES.items() for t in ts], "array<struct<f:string,g:array<string>>>")
    mine = F.filter(table, lambda x: x["f"] == family) if family is not None else table
    return F.coalesce(F.array_max(F.transform(mine, lambda x: F.size(F.array_intersect(x["g"], found)) / F.size(x["g"]))), F.lit(0.0))


def train(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Fit the regression on bounded rows; fitting stays in the JVM, the driver reads the weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, StringIndexerModel

    spark = docs.sparkSession
    families = [*TEMPLATES, UNKNOWN]
    templates = [grams_of(t) for ts in TEMPLATES.values() for t in ts]
    vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for v in variants(t) for g in grams_of(v)} - {"2024"})
    sampled = written(spark, sample_of(docs, text, key), "licence-sample")
    plain = sorted({w for g in templates for w in g if " " not in w})
    low = F.lower("t")
    often = sampled.agg(*[F.count_if(low.contains(w)).alias(w) for w in plain]).first().asDict()
    rows = written(spark, training_rows(sampled).coalesce(4), "licence-rows")
    ready = StringIndexerModel.from_labels(families, "family", "label").transform(rows.where(~F.col("held")))
    ready = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").transform(ready).select("label", "features").coalesce(1)
    fitted = LogisticRegression(family="multinomial", regParam=2e-3, elasticNetParam=0.3, maxIter=60, standardization=False).fit(ready)
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray().tolist()
    weights = {g: [round(float(w), 6) for w in matrix[:, i]] for i, g in enumerate(vocabulary) if abs(matrix[:, i]).max() > 1e-6}
    model = Model(families, weights, intercepts, 0.5, anchors_of(templates, often))
    model.threshold = calibrated(model, rows.where("held"))
    return model


def calibrated(model: Model, held: DataFrame) -> float:
    """The middle between the largest family probability of unknown rows and the 5th percentile of family rows, at least one half."""
    row = held.select("family", F.array_max(against_unknown(F.col("grams"), model)).alias("p")).agg(F.max(F.when(F.col("family") == UNKNOWN, F.col("p"))), F.percentile(F.when(F.col("family") != UNKNOWN, F.col("p")), 0.05)).first()
    return max(0.5, ((row[0] or 0.0) + (row[1] or 1.0)) / 2)


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def against_unknown(found: Column, model: Model) -> Column:
    """The probability of each family, had the paragraph it or the unknown class."""
    table = _constant(model.weights, "map<string,array<double>>")
    known = F.array_intersect(found, _constant(list(model.weights), "array<string>"))
    start = _constant(model.intercepts, "array<double>")
    logits = F.aggregate(known, start, lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b))
    return let(logits, lambda z: F.transform(F.slice(z, 1, len(model.families) - 1), lambda x: 1 / (1 + F.exp(F.element_at(z, -1) - x))))


def any_anchor(text: Column, model: Model) -> Column:
    out = F.lit(False)
    for a in model.anchors:
        out = out | text.contains(a)
    return out


def confirmed(found: Column) -> Column:
    """array<struct<family, contained>> of the families with a template that the grams contain.

    What a template has apart from a contained template of another family must
    be contained as well, so `CC BY-NC` is not `CC BY` too.
    """
    table = _constant([{"f": f, "g": grams_of(t)} for f, ts in TEMPLATES.items() for t in ts], "array<struct<f:string,g:array<string>>>")
    vocabulary = _constant(sorted({g for ts in TEMPLATES.values() for t in ts for g in grams_of(t)}), "array<string>")

    def share(g: Column, known: Column) -> Column:
        return F.size(F.array_intersect(g, known)) / F.size(g)

    def apart(known: Column):
        return lambda near: F.filter(near, lambda x: F.forall(near, lambda y: (y["f"] == x["f"]) | (F.coalesce(share(F.array_except(x["g"], y["g"]), known), F.lit(0.0)) >= CONTAINED)))

    def named(kept: Column) -> Column:
        most = lambda f: F.array_max(F.transform(F.filter(kept, lambda x: x["f"] == f), lambda x: x["c"]))
        return F.transform(F.array_distinct(F.transform(kept, lambda x: x["f"])), lambda f: F.struct(f.alias("family"), F.round(most(f), 6).alias("contained")))

    def of(known: Column) -> Column:
        near = F.filter(F.transform(table, lambda x: F.struct(x["f"].alias("f"), x["g"].alias("g"), share(x["g"], known).alias("c"))), lambda x: x["c"] >= CONTAINED)
        return let(let(near, apart(known)), named)

    return let(F.array_intersect(found, vocabulary), of)


def judged(paragraphs: Column, model: Model) -> Column:
    """array<struct<position, last, family, score, contained>> of paragraphs (position, last, grams)."""
    near = F.filter(F.transform(paragraphs, lambda x: F.struct(x["position"].alias("position"), x["last"].alias("last"), x["grams"].alias("grams"), confirmed(x["grams"]).alias("found"))), lambda x: F.size(x["found"]) > 0)
    scored = F.transform(near, lambda x: F.struct(x["position"].alias("position"), x["last"].alias("last"), x["found"].alias("found"), against_unknown(x["grams"], model).alias("p")))
    families = _constant(model.families, "array<string>")

    def each(x: Column) -> Column:
        return F.transform(
            x["found"],
            lambda n: F.struct(x["position"].alias("position"), x["last"].alias("last"), n["family"].alias("family"), F.round(F.element_at(x["p"], F.array_position(families, n["family"]).cast("int")), 6).alias("score"), n["contained"].alias("contained")),
        )

    return F.filter(F.flatten(F.transform(scored, each)), lambda n: n["score"] >= model.threshold)


def lines_of(low: Column, model: Model) -> Column:
    """The lines with an anchor word, as paragraphs."""
    lines = F.transform(F.split(low, "\n"), lambda p, i: F.struct(i.alias("position"), p.alias("p")))
    return F.transform(F.filter(lines, lambda x: any_anchor(x["p"], model)), lambda x: F.struct(x["position"].alias("position"), x["position"].alias("last"), grams(x["p"]).alias("grams")))


def windows_of(low: Column, model: Model) -> Column:
    """The windows of more than one line with an anchor word, as paragraphs."""
    every = F.flatten(F.transform(F.split(low, "\n"), lambda p, i: F.transform(words(p), lambda w: F.struct(i.alias("i"), w.alias("w")))))

    def cut(tokens: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(WINDOW))
        parts = F.filter(F.transform(starts, lambda at: F.slice(tokens, at, F.lit(2 * WINDOW))), lambda x: F.size(x) > 0)
        parts = F.filter(parts, lambda x: F.element_at(x, 1)["i"] < F.element_at(x, -1)["i"])
        parts = F.filter(parts, lambda x: F.exists(x, lambda t: t["w"].isin(*model.anchors)))
        return F.transform(parts, lambda x: F.struct(F.element_at(x, 1)["i"].alias("position"), F.element_at(x, -1)["i"].alias("last"), grams_in(F.transform(x, lambda t: t["w"])).alias("grams")))

    return let(every, cut)


def notices(low: Column, model: Model) -> Column:
    """array<struct<position, family, score, contained>> of the confirmed notices of a lower-cased text.

    The position is the line; of a notice wrapped over lines, the line where its
    window begins.  A window adds the families that no line of it and no window
    that overlaps it from before has.
    """

    def added(inline: Column, wrapped: Column) -> Column:
        fresh = F.filter(wrapped, lambda n: ~F.exists(inline, lambda x: (x["family"] == n["family"]) & x["position"].between(n["position"], n["last"])))
        first = F.filter(fresh, lambda n: ~F.exists(fresh, lambda x: (x["family"] == n["family"]) & (x["position"] < n["position"]) & (x["last"] >= n["position"])))
        return F.transform(F.array_sort(F.concat(inline, F.array_distinct(first))), lambda n: F.struct(n["position"], n["family"], n["score"], n["contained"]))

    both = F.struct(judged(lines_of(low, model), model).alias("a"), judged(windows_of(low, model), model).alias("b"))
    return let(both, lambda x: added(x["a"], x["b"]))


def scan(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, notices) of each row, in one narrow pass; a null or empty text has none.

    Rows that repeat and null keys pass through; other columns take no part.
    """
    low = docs.select(F.col(f"`{key}`").alias("key"), F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("low"))
    hit = low.select("key", F.when(any_anchor(F.col("low"), model), F.col("low")).alias("low"))
    empty = F.array().cast("array<struct<position:int,family:string,score:double,contained:double>>")
    return hit.select(F.col("key").alias(key), F.when(F.col("low").isNotNull(), notices(F.col("low"), model)).otherwise(empty).alias("notices"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence families of every document."""
    docs = read(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["family"]))), ",")
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), families.alias("licences"), F.array_max(F.transform("notices", lambda n: n["score"])).alias("best_score"))
