"""Licence scans: a trained paragraph classifier, confirmed by templates. DataFrame functions and Spark ML only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sentences that state a licence, by family (fixed public wordings).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is released under the Apache License 2.0; you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is distributed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software under the terms of the GNU GPL version 3 or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License."),
    ("BSD", "Use of this source code is governed by a BSD-style license."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright; dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "This document is confidential and proprietary; no part may be reproduced without permission."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((family, f"SPDX-License-Identifier: {family}") for family in (
        "Apache-2.0", "MIT", "GPL-3.0", "GPL-2.0", "LGPL", "BSD", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "AGPL-3.0", "ISC", "EPL-2.0", "Unlicense",
    )),
]
FAMILIES = ["unknown", *dict.fromkeys(f for f, _ in TEMPLATES)]
TEMPERATURES = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]


@dataclass(frozen=True)
class LicenseConfig:
    features: int = 1 << 13
    variants: int = 24  #: training paragraphs per template, embedded in words of the corpus
    unknown_docs: int = 200  #: documents whose paragraphs teach the unknown class, at most
    unknown_lines: int = 20  #: paragraphs of each of them, at most
    reg: float = 1e-3
    probability: float = 0.5  #: below it a paragraph is unknown
    coverage: float = 0.75  #: share of a template's word triples that confirms it
    reach: int = 320  #: characters of a wrapped sentence that are read on each side of a line break; no template is longer
    wrap: int = 8  #: lines after a break over which a sentence may go on


_TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TERM), F.lit(0))


def grams(words: Column, n: int) -> Column:
    """Runs of n words; of a shorter text, the whole."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array(F.array_join(words, " ")))


def _templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "template int, family string, statement string")


def _triples(statement: str) -> list[str]:
    """grams(terms(statement), 3) of a template, each once."""
    own = re.findall(_TERM, statement.lower())
    return list(dict.fromkeys(" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))))


#: The end of a sentence: its mark follows two characters at least, so that "v. 2.0" goes on.
_END = r"(?<=\S\S)[.!?]['\")\]]*(?=\s|$)"


def _passages(lines: Column, config: LicenseConfig) -> Column:
    """The lines, and the sentences that go on over a line break, as structs (passage, joint).

    A sentence goes on where its line does not end with an end mark and
    neither this line nor the next is blank. It is read from the last end mark
    before the break to the first one after it, at most config.reach characters
    on each side and config.wrap lines on.
    """
    blank = lambda c: ~c.rlike(r"\S")
    tail = lambda c: F.substring(c, -config.reach, config.reach)
    begun = lambda c: F.element_at(F.split(tail(c), _END), -1)

    def rest(i: Column) -> Column:
        """The text after line i, up to a blank line, an end mark or the bounds."""
        after = F.array_join(F.transform(F.slice(lines, i + 2, config.wrap), lambda c: F.when(blank(c), F.lit("\n\n")).otherwise(F.substring(c, 1, config.reach))), " ")
        return F.get(F.split(F.substring(F.substring_index(after, "\n\n", 1), 1, config.reach), _END, 2), F.lit(0))

    breaks = F.when(F.size(lines) > 1, F.sequence(F.lit(0), F.size(lines) - 2)).otherwise(F.array().cast("array<int>"))
    open_ = F.filter(breaks, lambda i: ~tail(F.get(lines, i)).rlike(_END + r"\s*$") & ~blank(F.get(lines, i)) & ~blank(F.get(lines, i + 1)))
    joints = F.transform(open_, lambda i: F.struct(F.concat_ws(" ", begun(F.get(lines, i)), rest(i)).alias("passage"), F.lit(True).alias("joint")))
    return F.concat(F.transform(lines, lambda c: F.struct(c.alias("passage"), F.lit(False).alias("joint"))), joints)


def _paragraphs(docs: DataFrame, id_col: str, text_col: str, config: LicenseConfig) -> DataFrame:
    """(id, row, paragraph, joint): what is classified, with a number of its own for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("lines"))
    return rows.select("id", "row", F.explode(_passages(F.col("lines"), config)).alias("p")).select("id", "row", F.col("p.passage").alias("paragraph"), "p.joint")


def _vectors(paragraphs: DataFrame, config: LicenseConfig) -> DataFrame:
    """Hashed single words and word pairs of a paragraph, present or not."""
    words = paragraphs.withColumn("words", terms(F.col("paragraph")))
    words = words.withColumn("terms", F.array_distinct(F.concat("words", grams(F.col("words"), 2))))
    return HashingTF(binary=True, numFeatures=config.features, inputCol="terms", outputCol="features").transform(words)


def _training(docs: DataFrame, id_col: str, text_col: str, config: LicenseConfig) -> DataFrame:
    """Labelled paragraphs: templates alone and within words of the corpus, and unknown ones from a bounded sample of documents."""
    spark = docs.sparkSession
    chosen = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).orderBy(F.xxhash64("id"), "id").limit(config.unknown_docs).distinct()
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id", "left_semi")
    lines = sample.select(F.xxhash64("id").alias("order"), F.posexplode(F.slice(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), 1, config.unknown_lines)).alias("line", "paragraph"))
    known = F.array(*(F.lit(g) for g in dict.fromkeys(g for _, t in TEMPLATES for g in _triples(t))))
    # The filter is pushed below any column of words; a lambda's variable is computed once, not for every triple.
    foreign = F.transform(F.array(terms(F.col("paragraph"))), lambda w: (F.size(w) > 0) & (F.size(F.array_intersect(grams(w, 3), known)) == 0))
    unknown = lines.where(F.get(foreign, F.lit(0)))
    fillers = [r[0] for r in unknown.orderBy("order", "line", "paragraph").limit(config.variants).select(F.array_join(F.slice(terms(F.col("paragraph")), 1, 8), " ")).collect()]
    variants = _templates(spark).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(config.variants - 1))))
    own = F.get(F.array(*(F.lit(f) for f in fillers or [""])), F.pmod(F.col("v") + 7 * F.col("template"), F.lit(len(fillers) or 1)))
    text = F.when(F.col("v") % 3 == 0, F.col("statement")).when(F.col("v") % 3 == 1, F.concat_ws(" ", own, "statement")).otherwise(F.concat_ws(" ", "statement", own))
    label = F.array_position(F.array(*(F.lit(f) for f in FAMILIES)), F.col("family")) - 1
    rows = variants.select(label.cast("double").alias("label"), text.alias("paragraph"), (F.col("v") % 4 == 3).alias("held"))
    # The words of the templates out of order teach the unknown class that single words are not enough.
    shuffled = variants.where("v < 4").select(F.lit(0.0).alias("label"), F.array_join(F.transform(F.array_sort(F.transform(terms(F.col("statement")), lambda w: F.struct(F.xxhash64(w, F.col("v")).alias("k"), w.alias("w")))), lambda s: s["w"]), " ").alias("paragraph"), (F.col("v") == 3).alias("held"))
    return rows.unionByName(unknown.select(F.lit(0.0).alias("label"), "paragraph", (F.pmod(F.xxhash64("paragraph"), F.lit(4)) == 3).alias("held"))).unionByName(shuffled.where("size(split(paragraph, ' ')) > 4"))


def _softmax(raw: Column, temperature: Column) -> Column:
    scaled = F.transform(raw, lambda x: x / temperature)
    top = F.array_max(scaled)
    e = F.transform(scaled, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: LicenseConfig = LicenseConfig()) -> tuple[LogisticRegressionModel, float]:
    """The paragraph classifier, and the temperature that calibrates its probabilities on held-out training paragraphs."""
    rows = _vectors(_training(docs, id_col, text_col, config), config).select("label", "features", "held").persist()
    model = LogisticRegression(family="multinomial", maxIter=40, regParam=config.reg, elasticNetParam=0.0, standardization=False).fit(rows.where("NOT held").select("label", "features"))
    raw = vector_to_array(F.col("rawPrediction"))
    loss = [F.avg(-F.log(F.greatest(F.get(_softmax(raw, F.lit(t)), F.col("label").cast("int")), F.lit(1e-12)))).alias(str(i)) for i, t in enumerate(TEMPERATURES)]
    losses = model.transform(rows.where(F.col("held") & (F.col("label") < model.numClasses))).agg(*loss).first()
    rows.unpersist()
    best = min(range(len(TEMPERATURES)), key=lambda i: (losses[i] is None, losses[i], abs(TEMPERATURES[i] - 1)))
    return model, TEMPERATURES[best]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: LicenseConfig = LicenseConfig()) -> DataFrame:
    """The licence statements of each document.

    A multinomial logistic regression over hashed words and word pairs gives
    every paragraph (line, and sentence that goes on over line breaks) a
    licence family or the unknown class. It learns from the templates,
    embedded in words of the corpus, and from the paragraphs of
    config.unknown_docs documents. Probabilities are calibrated by a
    temperature; below config.probability a paragraph is unknown. A predicted
    family is confirmed if the paragraph holds config.coverage of the word
    triples of one of the family's templates.

    Returns one row per input row: identifier, n_paragraphs (lines),
    n_predicted and n_confirmed (lines), licenses (confirmed families, sorted,
    joined by commas), unconfirmed (families predicted for a line without a
    confirmed paragraph) and wrapped (families of licenses that only sentences
    over line breaks state; these count only where a template confirms
    them). Null text counts as empty, which is one paragraph. Repeated
    rows and identifiers, and null identifiers, stay rows of their own. Other
    columns are ignored.
    """
    model, temperature = fit(docs, id_col, text_col, config)
    scored = model.transform(_vectors(_paragraphs(docs, id_col, text_col, config), config))
    class_ = F.col("prediction").cast("int")
    likely = F.when(F.col("prediction") > 0, F.get(_softmax(vector_to_array(F.col("rawPrediction")), F.lit(temperature)), class_) >= config.probability)
    family = F.when(likely, F.get(F.array(*(F.lit(f) for f in FAMILIES)), class_))
    templates = [[_triples(t) for f, t in TEMPLATES if f == family] for family in FAMILIES]
    held = lambda own: F.size(F.array_intersect(own, F.col("triples"))) >= config.coverage * F.size(own)
    scored = scored.select("id", "row", "joint", class_.alias("class"), family.alias("family"), F.when(family.isNotNull(), grams(F.col("words"), 3)).alias("triples"))
    scored = scored.withColumn("confirmed", F.col("family").isNotNull() & F.exists(F.get(F.lit(templates), F.col("class")), held))
    line = ~F.col("joint")
    found = scored.groupBy("id", "row").agg(
        F.count_if(line).alias("n_paragraphs"),
        F.count_if(line & F.col("family").isNotNull()).alias("n_predicted"),
        F.count_if(line & F.col("confirmed")).alias("n_confirmed"),
        F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("sure"),
        F.collect_set(F.when(line & F.col("confirmed"), F.col("family"))).alias("plain"),
        F.array_sort(F.collect_set(F.when(line, F.col("family")))).alias("seen"),
    )
    rest = {"unconfirmed": F.array_except("seen", "sure"), "wrapped": F.array_except("sure", "plain")}
    return found.select(F.col("id").alias(id_col), "n_paragraphs", "n_predicted", "n_confirmed", F.array_join("sure", ",").alias("licenses"), *(F.array_join(c, ",").alias(n) for n, c in rest.items()))
