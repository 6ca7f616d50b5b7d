"""License scans: a paragraph classifier over word n-grams, confirmed against templates.

A paragraph is a line, without the signs that begin a comment line, and joined
with the next one where that goes on in lower case or in a bracket, or where the
line is of the length that texts are wrapped at and ends inside of a sentence. Those of its words and word pairs that templates have make a sparse vector; a
multinomial logistic regression tells the license families and ``unknown`` apart. It is
trained on written variants of the templates and on at most about
``TRAIN_PARAGRAPHS`` paragraphs of the corpus, by hash, as unknown. One
temperature calibrates the probabilities: it is set by a first model on templates
and corpus paragraphs which that model has not seen. A family other than unknown
stands only if the paragraph also shares enough telling word pairs - those that
aren't two function words - with one of its templates.

All of the main path is DataFrame functions and Spark's own feature and
regression stages. A paragraph without any word of a telling pair of any template
can't be confirmed whatever the classifier says, so only the others are scored;
that changes no result. Paragraphs with a finding are few, so only those are grouped.

Defined results: null and empty texts have no paragraphs; rows that repeat id
and text get equal results; lines without words are no paragraphs; texts, lines
and words of any length are read whole, without recursion; of families with
equal scores the first in their order is taken; an empty table gives an empty
result, with a model of the written variants alone.
"""

from __future__ import annotations

import json
import random
import re

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize

#: Families, and paragraphs of their notices and texts in the words that they are published in.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "This project is released under the Apache 2.0 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This software is distributed under the terms of the MIT License.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GPLv3.",
        "You should have received a copy of the GNU General Public License along with this program.  If not, see https://www.gnu.org/licenses/",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GPLv2.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "agpl-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "bsd-3-clause": [
        "Released under the BSD License.",
        "Licensed under the 3-clause BSD license.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "bsd-2-clause": [
        "Licensed under the 2-clause BSD license.",
        "Released under the simplified BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the terms of the ISC license.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0.",
        "Released under the Eclipse Public License.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under CC BY 3.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Content is available under CC BY-NC 3.0."],
    "cc0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "This work is dedicated to the public domain."],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without permission of the publisher.", "This software is proprietary and confidential; unauthorized copying is strictly prohibited.", "No part of this book may be reproduced or transmitted in any form without the written permission of the publisher."],
}
#: Sentences with the words of licenses that grant none.
NO_LICENSE = ["The driver lost his license in May.", "A license to fish is sold at the office.", "The restaurant is licensed to sell wine.", "They released the version in general.", "The public may use the software at the library.", "Version 2.0 of the report was released under pressure.", "The general was under attack.", "He asked for permission to copy the work.", "Creative work is common here."]
FAMILIES = [*TEMPLATES, "unknown"]
#: Function words of English.
FUNCTION_WORDS = frozenset("a all also an and any are as at be been but by can do for from has have he her his i if in into is it its may more no not of on one or other our out she so such than that the their there these they this to up was we were which will with you your".split())
TRAIN_PARAGRAPHS = 4_000
VARIANTS = 12
PROBABILITY = 0.5
#: Share of the smaller side's word pairs that paragraph and template have in common.
SIMILARITY = 0.5


def terms(text: Column) -> Column:
    """Lower-case words of letters, digits, and dots or dashes that do not end them. One class without groups: the engine takes it in a loop, however long a word is."""
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(r"[\p{L}0-9][\p{L}0-9.-]*+"), F.lit(0))
    return F.transform(found, lambda w: F.rtrim(w, F.lit(".-")))


def _terms(text: str) -> list[str]:
    """The same for the templates, which are ASCII."""
    return [w.rstrip(".-") for w in re.findall(r"[a-z0-9][a-z0-9.-]*", text.lower())]


def pairs(words: Column) -> Column:
    """Adjacent words, each two as one string."""
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    )


def _lines(text: Column) -> Column:
    """Array of the paragraphs of ``text``, those without words too."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^[ \t]*+(?:[#*;%]++|//++|--++)?+[ \t]*+", "")
    return F.split(F.regexp_replace(bare, r"\n(?=[^\n])(?:(?=[a-z(])|(?<=(?:^|\n)[^\n]{55,99}[A-Za-z0-9,)]\n))", " "), "\n", -1)


def paragraphs(docs: DataFrame, able: bool = False) -> DataFrame:
    """doc_id, content (key of the text), place and words of each paragraph that has a word; with ``able`` of those alone that a template could confirm."""
    rows = docs.select("doc_id", _content(F.col("text")).alias("content"), F.posexplode(_lines(F.col("text"))).alias("place", "line")).filter(F.col("line").rlike(r"[\p{L}0-9]"))
    if able:
        content = sorted({w for texts in _template_pairs() for t in texts for p in t for w in p.split(" ")} - FUNCTION_WORDS)
        rows = rows.filter(F.exists(terms(F.col("line")), lambda w: w.isin(*content)))
    return rows.select("doc_id", "content", "place", terms(F.col("line")).alias("words"))


def _content(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _local(spark: SparkSession, rows: list[tuple[str, int, bool]]) -> DataFrame:
    """A small table from one literal: text, label, apart."""
    written_ = json.dumps([{"text": t, "label": float(k), "apart": a} for t, k, a in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(written_), "array<struct<text:string,label:double,apart:boolean>>")))


def written(seed: int = 3) -> list[tuple[str, int, bool]]:
    """Labelled variants of the templates - with words left out, words around them, or other case - and whether their template, every third of a family, sets the temperature."""
    rng, out = random.Random(seed), []
    around = "project page see file the of and code our this text data by from more under author note".split()
    for k, family in enumerate(TEMPLATES):
        for t, text in enumerate(TEMPLATES[family]):
            apart = t % 3 == 2
            out += [(text, k, apart)] * 2
            for _ in range(VARIANTS):
                words = [w for w in text.split() if rng.random() > 0.08]
                words = rng.choices(around, k=rng.randrange(5)) + words + rng.choices(around, k=rng.randrange(5))
                out.append((" ".join(words), k, apart))
    for t, text in enumerate(NO_LICENSE):
        out += [(text, len(TEMPLATES), t % 3 == 2)] * 4
        out += [(" ".join(rng.sample(text.split(), len(text.split()))), len(TEMPLATES), t % 3 == 2) for _ in range(4)]
    return out


def fitted(docs: DataFrame) -> tuple[PipelineModel, float]:
    """The classifier and its temperature."""
    spark = docs.sparkSession
    # one paragraph of each picked document, both by hash; paragraphs that name a license are no evidence for unknown
    bound = int(min(1.0, TRAIN_PARAGRAPHS / max(1, docs.count())) * (1 << 63))
    picked = docs.filter(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(1)), 1) <= F.lit(min(bound, (1 << 63) - 1)))
    picked = picked.select("doc_id", _lines(F.col("text")).alias("lines"))
    line = F.element_at("lines", (F.pmod(F.xxhash64("doc_id"), F.size("lines")) + 1).cast("int"))
    other = picked.select(line.alias("text"), F.lit(float(len(TEMPLATES))).alias("label"), (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) == 0).alias("apart"))
    other = other.filter(~F.lower("text").rlike(r"licen[sc]e|copyright|public domain|all rights|\bcc\b|creative commons|redistribut"))
    rows = _local(spark, written()).union(other).withColumn("words", terms(F.col("text"))).filter(F.size("words") > 0)
    # a few thousand rows at any size, so two tasks are enough to train on them
    rows = materialize(rows.select(F.concat("words", pairs(F.col("words"))).alias("grams"), "label", "apart").coalesce(2))
    grams = sorted({g for texts in TEMPLATES.values() for t in texts for w in [_terms(t)] for g in [*w, *_pairs(w)]})
    counts = CountVectorizerModel.from_vocabulary(grams, inputCol="grams", outputCol="features")
    counts.setBinary(True)
    regression = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=25, tol=1e-4, probabilityCol="", predictionCol="", rawPredictionCol="raw")
    pipeline = Pipeline(stages=[counts, regression])
    first = pipeline.fit(rows.filter("not apart").select("grams", "label"))
    held = first.transform(rows.filter("apart").select("grams", "label")).select("label", vector_to_array("raw").alias("raw")).collect()
    temperature = _temperature(np.array([r["raw"] for r in held]), np.array([int(r["label"]) for r in held]))
    return pipeline.fit(rows.select("grams", "label")), temperature


def _temperature(raw: np.ndarray, label: np.ndarray) -> float:
    """The divisor of margins that makes held-out labels likeliest."""
    if not len(raw):
        return 1.0

    def loss(t: float) -> float:
        z = raw / t - (raw / t).max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(z)), label] - np.log(np.exp(z).sum(axis=1))).mean())

    return min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)


def _pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _telling(pair: str) -> bool:
    return not set(pair.split(" ")) <= FUNCTION_WORDS


def _template_pairs() -> list[list[list[str]]]:
    """Telling word pairs of each template, by family."""
    return [[sorted(filter(_telling, set(_pairs(_terms(t))))) for t in texts] for texts in TEMPLATES.values()]


def findings(rows: DataFrame, model: PipelineModel, temperature: float) -> DataFrame:
    """Paragraphs with a confirmed family: doc_id, content, place, family, probability, similarity."""
    known = _template_pairs()
    rows = rows.withColumn("pairs", pairs(F.col("words")))
    raw = vector_to_array("raw")
    scored = model.transform(rows.withColumn("grams", F.concat("words", "pairs"))).select("doc_id", "content", "place", "pairs", raw.alias("raw"))
    top = F.array_max("raw")
    best = (F.array_position("raw", top) - 1).cast("int")
    likely = F.lit(1.0) / F.aggregate("raw", F.lit(0.0), lambda s, z: s + F.exp((z - top) / temperature))
    named = scored.withColumn("k", best).filter(F.col("k") < len(TEMPLATES)).withColumn("probability", likely).filter(F.col("probability") >= PROBABILITY)
    templates = F.array(*[F.array(*[F.array(*[F.lit(p) for p in t]) for t in texts]) for texts in known])
    own = named.withColumn("pairs", F.filter(F.array_distinct("pairs"), lambda p: ~F.forall(F.split(p, " "), lambda w: w.isin(*sorted(FUNCTION_WORDS)))))
    shared = F.transform(F.element_at(templates, F.col("k") + 1), lambda t: F.size(F.array_intersect(t, "pairs")) / F.greatest(F.lit(1), F.least(F.size(t), F.size("pairs"))))
    own = own.withColumn("similarity", F.array_max(shared)).filter(F.col("similarity") >= SIMILARITY)
    return own.select("doc_id", "content", "place", F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.col("k") + 1).alias("family"), "probability", "similarity")


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licenses, families, probability, similarity, licenses for each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    # written, so that the words of a paragraph aren't taken anew for each use of them
    found = findings(materialize(paragraphs(docs, able=True)), *fitted(docs))
    # a set, as rows may repeat id and text
    each = F.array_sort(F.collect_set(F.struct("place", "family", "probability", "similarity")))
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).agg(each.alias("licenses"))
    lines = F.filter(_lines(F.col("text")), lambda x: x.rlike(r"[\p{L}0-9]"))
    rows = docs.select("doc_id", _content(F.col("text")).alias("content"), F.size(lines).cast("long").alias("n_paragraphs"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content")), "left")
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"]))), ",")
    return joined.select(
        "doc_id",
        "n_paragraphs",
        F.when(F.col("licenses").isNull(), 0).otherwise(F.size("licenses")).cast("long").alias("n_licenses"),
        F.coalesce(families, F.lit("")).alias("families"),
        F.array_max(F.transform("licenses", lambda x: x["probability"])).alias("probability"),
        F.array_max(F.transform("licenses", lambda x: x["similarity"])).alias("similarity"),
    )
