"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are lines. Word one- and two-grams feed a multinomial logistic regression with an
L1 penalty, so that few of them keep a weight. It is trained on licence notices and parts of
them, on notices of no listed family, and on ordinary lines of the corpus. A held-out part sets
the probability below which a notice is called ``unknown``. A prediction is confirmed when
enough of the paragraph's word three-grams occur in one template of the family.

Training reads a bounded sample of ``sample_lines`` lines, chosen by hash, beside the templates.
Scoring reads every line: one that shares no word with any weight has the score of an empty
line, which is ordinary text, so only the others are expanded into n-grams. Columns only.

Defined results: null and empty texts have no paragraph to report. Repeated rows with equal id and text
are one document. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import regex
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inquest.llm.common import present, spool

NONE, UNKNOWN = "none", "unknown"
WORDS = r"[\p{L}\p{N}]+(?:\.[0-9]+)*"          # dots stay between digits
# Public licence notices by family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the "
        "LICENSE file.",
        "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc": [
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later"],
    "mit": [
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction", "SPDX-License-Identifier: MIT"],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0"],
    UNKNOWN: [
        "All rights reserved.", "Licensed under the terms of the license agreement.",
        "This software is proprietary and confidential; unauthorised copying is prohibited.",
        "Released under a custom license, see the LICENSE file for its terms.",
        "Licensed under the Example Vendor Software License, version 1.",
        "This work is licensed under its own terms."],
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def grams(words: Column, n: int) -> Column:
    """The ``n``-grams, space-joined."""
    last = F.size(words) - (n - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(
        F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def features(words: Column, common: list[str]) -> Column:
    """One- and two-grams of the words that are not common in ordinary text."""
    rare = F.filter(words, lambda w: ~w.isin(common)) if common else words
    return F.array_distinct(F.concat(rare, grams(rare, 2)))


def notices(spark: SparkSession) -> DataFrame:
    """``family, part, text``: the templates, and runs of their words as they are quoted."""
    rows = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            parts = text.split()
            rows.append((family, 0, text))
            for n in (4, 6, 9):
                rows += [(family, 1 + (at // 2) % 4, " ".join(parts[at:at + n]))
                         for at in range(0, len(parts) - n + 1, 2)]
    return spark.createDataFrame(rows, "family string, part int, text string")


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.xxhash64(present(F.col(text_col))).alias("h"),
                       F.posexplode(F.split(present(F.col(text_col)), "\n")).alias("line", "text"))


class Model:
    """Weights by n-gram and class, and the probabilities that a notice and a family need."""

    def __init__(self, weights: dict[str, list[float]], offset: list[float], classes: list[str],
                 common: list[str]):
        self.weights, self.offset, self.classes, self.common = weights, offset, classes, common
        self.sure, self.notice = 0.5, 0.5


def train(docs: DataFrame, sample_lines: int = 3000, id_col: str = "doc_id",
          text_col: str = "text") -> Model:
    """Fit on the notices and on a bounded sample of ordinary lines."""
    spark = docs.sparkSession
    shapes = F.array(*[F.lit(x) for x in sorted({
        " ".join(w[i:i + 2]) for t in TEMPLATES.values() for s in t
        for w in [s.lower().replace(",", "").rstrip(".").split()] for i in range(len(w) - 1)})])
    plain = (paragraphs(docs, id_col, text_col).filter(F.length("text") > 0)
             .orderBy(F.xxhash64("text", "doc_id", "line"), "doc_id", "line").limit(sample_lines)
             .filter(~F.arrays_overlap(grams(words(F.col("text")), 2), shapes))
             .select(F.lit(NONE).alias("family"),
                     F.pmod(F.xxhash64("text"), F.lit(5)).cast("int").alias("part"), "text"))
    names = sorted([*TEMPLATES, NONE])
    label = reduce(lambda c, p: c.when(F.col("family") == p[1], F.lit(float(p[0]))),
                   enumerate(names), F)
    # a bounded sample: one partition, for each step of the fit is a job
    plain = spool(plain)
    often = max(2, plain.count() // 200)
    # at most the words of the sample; those in 0.5 % of its lines say nothing about licences
    common = sorted(r["word"] for r in plain.select(F.explode(F.array_distinct(words(
        F.col("text")))).alias("word")).groupBy("word").count().filter(
            F.col("count") > often).collect())
    rows = spool(notices(spark).unionByName(plain).select(
        "family", "part", label.alias("label"),
        features(words(F.col("text")), common).alias("grams"))
        .coalesce(1))
    counter = CountVectorizer(inputCol="grams", outputCol="x", binary=True, minDF=2.0).fit(rows)
    held = F.col("part") == 4
    fit = LogisticRegression(featuresCol="x", labelCol="label",
                             family="multinomial", elasticNetParam=0.8, regParam=0.0005,
                             maxIter=60).fit(counter.transform(rows.filter(~held)))
    matrix = fit.coefficientMatrix.toArray()
    present_ = [names[i] for i in range(matrix.shape[0])]
    weights = {g: matrix[:, i].tolist() for i, g in enumerate(counter.vocabulary)
               if abs(matrix[:, i]).max() > 0}
    model = Model(weights, fit.interceptVector.toArray().tolist(), present_, common)
    # calibration: named families must be as sure as nearly all held-out notices of their own,
    # and a notice more so than nearly any held-out ordinary line
    scored = scored_grams(rows.filter(held).select(
        "family", F.monotonically_increasing_id().alias("id"), "grams"), model, ["family", "id"])
    named = F.when((F.col("family") == F.col("best"))
                   & ~F.col("family").isin(NONE, UNKNOWN), F.col("probability"))
    plain_ = F.when(F.col("family") == NONE, F.col("notice"))
    cut = scored.agg(F.percentile(named, F.lit(0.05)).alias("sure"),
                     F.percentile(plain_, F.lit(0.999)).alias("notice")).first()
    model.sure = min(0.9, cut["sure"] or 0.5)
    model.notice = min(0.95, max(0.5, cut["notice"] or 0.5))
    return model


def scored_grams(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys, best, probability, notice`` (not ordinary text) of rows with ``grams``, by summed weights."""
    spark = rows.sparkSession
    table = spark.createDataFrame(list(model.weights.items()), "gram string, w array<double>")
    n = len(model.classes)
    sums = (rows.select(*keys, F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")
            .groupBy(*keys).agg(*[F.sum(F.get("w", F.lit(i))).alias(f"c{i}") for i in range(n)]))
    score = [F.col(f"c{i}") + F.lit(model.offset[i]) for i in range(n)]
    top = F.greatest(*score)
    total = reduce(lambda a, b: a + b, [F.exp(s - top) for s in score])
    best = reduce(lambda c, p: c.when(p[1] == top, F.lit(p[0])), zip(model.classes, score), F)
    none = F.exp(score[model.classes.index(NONE)] - top) / total
    return sums.select(*keys, best.alias("best"), (1 / total).alias("probability"),
                       (1 - none).alias("notice"))


def scan(docs: DataFrame, model: Model, agree: float = 0.5, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``doc_id, line, family, probability, likeness, confirmed, text`` of each notice found."""
    used = sorted({w for g in model.weights for w in g.split(" ")})
    lines = paragraphs(docs, id_col, text_col).filter(F.length("text") > 0)
    lines = lines.withColumn("words", words(F.col("text")))
    lines = lines.filter(F.arrays_overlap("words", F.array(*[F.lit(w) for w in used])))
    keys = ["doc_id", "h", "line", "text"]
    rows = lines.select(*keys, features(F.col("words"), model.common).alias("grams")).dropDuplicates(
        ["doc_id", "h", "line"])
    found = scored_grams(rows, model, keys).filter(F.col("notice") > model.notice)
    found = found.filter(F.col("best") != NONE).withColumn("mine", grams(words(F.col("text")), 3))
    mine = F.col("mine")

    def near(family: str) -> Column:
        each = []
        for t in TEMPLATES[family]:
            w = regex.findall(WORDS, t.lower())
            each.append(F.array(*[F.lit(" ".join(w[i:i + 3])) for i in range(max(1, len(w) - 2))]))
        shared = [F.size(F.array_intersect(mine, x)) for x in each]
        return F.greatest(*shared, F.lit(0)) / F.size(mine)
    likeness = reduce(lambda c, f: c.when(F.col("best") == f, near(f)), sorted(TEMPLATES), F)
    likeness = F.when(F.size(mine) > 0, likeness).otherwise(0.0)
    family = F.when(F.col("probability") >= model.sure, F.col("best")).otherwise(UNKNOWN)
    out = found.select("doc_id", "line", family.alias("family"), "probability",
                       likeness.alias("likeness"), "text")
    return out.withColumn("confirmed", (F.col("likeness") >= agree) & (F.col("family") != UNKNOWN))
