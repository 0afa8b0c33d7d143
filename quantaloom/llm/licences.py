"""Licence scans: paragraphs of texts that state a licence, by a trained classifier of word n-grams.

A paragraph is a line of a text. Its terms are its pairs and triples of words; only terms that occur in the training
paragraphs have weights. Training paragraphs are the notices below, complete and with words left out, labelled by
family; as class ``other``, notices of further licences and wording that licences share; and, as class ``none``, texts
that speak of licences without stating one, and bounded samples of paragraphs of the corpus (``background`` rows at
most of each): those that share few terms with any notice, and those that share more but have no licence wording. A multinomial logistic regression
over these sparse counts gives a weight per term and class. Scoring explodes the terms of all paragraphs, joins the
few hundred weights by broadcast, and sums by paragraph; a paragraph without such terms is no notice.

A paragraph whose class ``none`` is not the likeliest is a notice, and so is one for which ``none`` is less likely than
for every corpus paragraph that a trial fit, without these and without a third of the further licences, has not seen. Its family is accepted if its probability reaches
a threshold, calibrated as the lowest one with which no altered notice of a held-back part of the training paragraphs
is given to a wrong family, and if a notice of the family confirms it: at least half of the notice's terms or half of
the paragraph's terms that have weights belong to both. Any other notice, and all of class ``other``, is ``unknown``.

Defined results: null and empty texts have no notices; repeated rows get the same result each, and rows with the same
doc_id and different texts are told apart; very long paragraphs are read whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.llm.common import let
from quantaloom.session import cut

#: fixed values: short public notices of each licence family
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is released under the Apache License 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Distributed under the terms of the GNU General Public License version 2 or later.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the 3-Clause BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This article is distributed under the terms of the Creative Commons Attribution License",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available for non-commercial use under CC BY-NC.",
    ],
}
#: notices of licences outside these families and wording that licences share: reported as ``unknown``
OTHERS = [
    "Licensed under the Artistic License, Version 2.0.",
    "Licensed under the Academic Free License version 3.0.",
    "Licensed under the Open Software License, Version 3.0.",
    "Licensed under the CeCILL, Version 2.1",
    "Licensed under the ODbL, Version 1.0",
    "Distributed under the Zope Public License, Version 2.1.",
    "Distributed under the zlib Software License, Version 1.0. See the accompanying file LICENSE.",
    "Common Public License - v 1.0",
    "Sun Public License - v 1.0",
    "IBM Public License - v 2.0",
    "Microsoft Public License - v 2.0",
    "This program and the accompanying materials are made available under the terms of the Common Public License v1.0 which accompanies this distribution.",
    "This file is subject to the terms of the Common Development and Distribution License.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this work, in source code form or as a binary, for any purpose, commercial or non-commercial, and by any means.",
    "This work has been dedicated to the public domain by its author, who waives all copyright and related rights worldwide to the extent possible under law.",
    "This is free and unencumbered work placed in the public domain.",
    "This file is released into the public domain.",
    "This software is provided 'as-is', without any express or implied warranty.",
    "All rights reserved. No part of this work may be reproduced or distributed without the prior written permission of the copyright holder.",
    "Released under the terms of the license that comes with this software.",
    "Use of this software is governed by the license agreement.",
    "You may use, copy and distribute this software under the following license.",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: ISC",
    "SPDX-License-Identifier: OFL-1.1",
]
NO_NOTICES = [
    "A driving license must be renewed every ten years.",
    "The restaurant lost its license to sell alcohol.",
    "Readers asked under the new rules whether this work is free of charge.",
    "The university at Cambridge MIT and other schools were visited by the general public.",
    "The committee released under pressure a copy of the report.",
    "All rights to the terms of the agreement are in the hands of the foundation.",
]
BACKGROUND = 2_000
CLASS_NONE, CLASS_OTHER = "none", "other"
#: lines with these words may state a licence, so the corpus lines that teach ``none`` have none of them
LICENCE_WORDS = r"(?i)licen[cs]|copyright|warrant|public domain|permission|permitted|distribut|spdx|creative commons|free software|rights reserved|\bcc[ -]by"
WORD = r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"
FEW = 1  # background paragraphs share at most so many terms with the notices


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def terms_of(words: Column) -> Column:
    """Pairs and triples of neighbouring words."""

    def both(w: Column) -> Column:
        pairs = F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
        triples = F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))
        n = F.size(w)
        return F.concat(F.slice(pairs, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(triples, F.lit(1), F.greatest(n - 2, F.lit(0))))

    return let(words, both)


def _lines(documents: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.posexplode(F.split("text", "\n")).alias("at", "line"))


def paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, digest (md5 of the text), at (0-based line), words."""
    return _lines(documents).select("doc_id", "digest", "at", words_of(F.col("line")).alias("words"))


def _notices(spark: SparkSession) -> DataFrame:
    rows = [(family, i, text) for family, texts in NOTICES.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, notice int, text string").coalesce(1)


def _training(spark: SparkSession, documents: DataFrame, background: int) -> DataFrame:
    """label, altered (which word is left out; -1: none), group (the paragraph; negative for those of the corpus), terms."""
    plain = _notices(spark).select(F.col("family").alias("label"), F.lit(0).cast("long").alias("group"), words_of(F.col("text")).alias("words"))
    others = spark.createDataFrame([(CLASS_NONE, 0, t) for t in NO_NOTICES], "label string, group long, text string").coalesce(1)
    further = spark.createDataFrame([(CLASS_OTHER, i, t) for i, t in enumerate(OTHERS)], "label string, group long, text string").coalesce(1)
    plain = plain.union(others.union(further).select("label", "group", words_of(F.col("text"))))
    left_out = plain.select("label", "group", "words", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("altered"))
    shorter = F.filter("words", lambda _, i: i != F.col("altered"))
    rows = left_out.select("label", "altered", "group", terms_of(shorter).alias("terms"))
    vocabulary = plain.where(F.col("label") != CLASS_NONE).select(F.explode(terms_of(F.col("words"))).alias("term")).distinct()
    # paragraphs in the order of a hash: the sample is bounded, the same for any layout of the files
    lines = _lines(documents).select(F.xxhash64("digest", "at").alias("place"), "line")
    some = lines.where(F.length("line") > 20).orderBy("place").limit(2 * background)
    some = cut(some.select("place", F.col("line").rlike(LICENCE_WORDS).alias("may"), F.array_distinct(terms_of(words_of(F.col("line")))).alias("terms")))
    shared = some.select("place", F.explode("terms").alias("term")).join(F.broadcast(vocabulary), "term").groupBy("place").count()
    close = shared.where(F.col("count") > FEW).select("place")
    far = some.join(F.broadcast(close), "place", "left_anti").orderBy("place").limit(background)
    near = some.where(~F.col("may")).join(F.broadcast(close), "place", "left_semi").orderBy("place").limit(background)
    return rows.union(far.union(near).select(F.lit(CLASS_NONE), F.lit(-1), -1 - F.pmod("place", F.lit(1 << 40)), "terms"))


class Model:
    """Weights of the terms by class, and the calibrated threshold."""

    def __init__(self, classes: list[str], vocabulary: list[str], weights: list[list[float]], intercepts: list[float]) -> None:
        self.classes, self.vocabulary, self.weights, self.intercepts = classes, vocabulary, weights, intercepts
        self.threshold, self.none_below = 0.0, 0.5

    def table(self, spark: SparkSession) -> DataFrame:
        """term, w (a weight for each class), families (those with a notice that has the term)."""
        rows = [(t, [float(w[i]) for w in self.weights]) for i, t in enumerate(self.vocabulary)]
        table = spark.createDataFrame(rows, "term string, w array<double>").coalesce(1)
        held = _notices(spark).select("family", "notice", words_of(F.col("text")).alias("words"))
        held = held.select(F.concat_ws("#", "family", "notice").alias("notice"), F.explode(F.array_distinct(terms_of(F.col("words")))).alias("term"))
        held = held.groupBy("term").agg(F.collect_set("notice").alias("notices"))
        return table.join(held, "term", "left").select("term", "w", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def fit(documents: DataFrame, background: int = BACKGROUND) -> Model:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    spark = documents.sparkSession
    rows = _training(spark, documents, background).cache()
    terms = rows.where(F.col("label") != CLASS_NONE).select(F.explode("terms").alias("term")).distinct()
    vocabulary = sorted(r[0] for r in terms.collect())  # bounded by the notices
    classes = [*NOTICES, CLASS_OTHER, CLASS_NONE]
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="features")
    # a third of the further licences and of the corpus paragraphs is left out of the trial fit
    apart = F.when(F.col("label") == CLASS_OTHER, F.col("group") % 3 == 0).when(F.col("group") < 0, F.col("group") % 3 == 0).otherwise(False)
    data = counted.transform(rows.withColumn("class", number.cast("double")).withColumn("apart", apart))
    data = data.select("class", "features", "altered", "apart").coalesce(1).cache()
    held_back = (F.col("altered") >= 0) & (F.col("altered") % 4 == 3)
    learner = LogisticRegression(featuresCol="features", labelCol="class", family="multinomial", regParam=1e-3, maxIter=60)
    fitted = learner.fit(data.where(~held_back))
    model = Model(classes, vocabulary, fitted.coefficientMatrix.toArray().tolist(), list(fitted.interceptVector))
    from pyspark.ml.functions import vector_to_array

    none = len(classes) - 1
    trial = learner.fit(data.where(~F.col("apart"))).transform(data.where(F.col("apart") & (F.col("altered") == -1)))
    least = trial.select("class", F.get(vector_to_array("probability"), F.lit(none)).alias("p"))
    # no left-out corpus paragraph may be taken for a notice
    low = least.where(F.col("class") == none).agg(F.min("p")).first()[0]
    model.none_below = min(0.95, max(0.5, low or 0.0))
    tried = fitted.transform(data.where(held_back)).select("class", "prediction", F.array_max(vector_to_array("probability")).alias("p"))
    wrong = tried.where((F.col("class") != F.col("prediction")) & (F.col("prediction") < len(classes) - 2)).agg(F.max("p")).first()[0]
    model.threshold = max(0.5, min(0.99, (wrong or 0.0) + 1e-6))
    data.unpersist()
    rows.unpersist()
    return model


def notices(documents: DataFrame, model: Model) -> DataFrame:
    """Paragraphs that state a licence: doc_id, digest, at, family (or ``unknown``), probability, guess, confirmed."""
    spark = documents.sparkSession
    pars = paragraphs(documents).select("doc_id", "digest", "at", F.explode(F.array_distinct(terms_of(F.col("words")))).alias("term"))
    hits = pars.join(F.broadcast(model.table(spark)), "term")
    k = len(model.classes)
    # a paragraph has each term once, so r rows of a term come from r equal rows of the document
    known = F.size(F.collect_set("term"))
    copies = F.count("*") / known
    sums = [(F.sum(F.get("w", F.lit(i))) / copies).alias(f"s{i}") for i in range(k)]
    seen = hits.groupBy("doc_id", "digest", "at").agg(*sums, known.alias("known"), F.collect_list("notices").alias("held"), copies.alias("copies"))
    logits = F.array(*[F.col(f"s{i}") + F.lit(float(model.intercepts[i])) for i in range(k)])
    seen = seen.select("doc_id", "digest", "at", "known", "copies", F.flatten("held").alias("held"), logits.alias("z"))
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - top))
    seen = seen.select("*", (1 / total).alias("probability"), (F.array_position("z", top) - 1).cast("int").alias("class"))
    unsure = F.col("class") == k - 1  # none is the likeliest: a notice still, if none is less likely than for any prose
    seen = seen.where(~unsure | (F.col("probability") < model.none_below))
    seen = seen.withColumn("probability", F.when(unsure, 1 - F.col("probability")).otherwise(F.col("probability")))
    guess = F.get(F.array(*[F.lit(c) for c in model.classes]), F.col("class"))
    seen = seen.withColumn("guess", guess)
    # the notice of the guessed family with the most terms in common
    sizes = {f"{f}#{i}": n for f, i, n in _notice_sizes(spark)}

    def part(key: str, n: int) -> Column:
        common = F.size(F.filter("held", lambda h: h == key)) / F.col("copies")
        return F.struct(common.alias("common"), F.lit(n).alias("size"), F.lit(key.split("#")[0]).alias("family"))

    parts = [part(key, n) for key, n in sizes.items()]
    own = F.filter(F.array(*parts), lambda p: p["family"] == F.col("guess"))
    enough = F.exists(own, lambda p: (p["common"] * 2 >= p["size"]) | (p["common"] * 2 >= F.col("known")))
    seen = seen.withColumn("confirmed", enough)
    sure = (F.col("probability") >= model.threshold) & F.col("confirmed")
    return seen.select("doc_id", "digest", "at", F.when(sure, F.col("guess")).otherwise(F.lit("unknown")).alias("family"), "probability", "guess", "confirmed")


def _notice_sizes(spark: SparkSession) -> list[tuple[str, int, int]]:
    rows = _notices(spark).select("family", "notice", F.size(F.array_distinct(terms_of(words_of(F.col("text"))))).alias("n"))
    return [tuple(r) for r in rows.collect()]


def scan(documents: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, n_notices, families (sorted, with ``unknown``), best (highest probability or null)."""
    found = notices(documents, model).groupBy("doc_id", "digest").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("family")).alias("families"), F.max("probability").alias("best")
    )
    found = found.select(F.col("doc_id").alias("f_id"), F.col("digest").alias("f_digest"), "n", "families", "best")
    docs = documents.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("digest") == F.col("f_digest"))
    return docs.join(found, same, "left").select(
        "doc_id",
        F.coalesce("n", F.lit(0).cast("long")).alias("n_notices"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        "best",
    )
