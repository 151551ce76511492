"""Licence scan: a trained paragraph classifier, confirmed by templates.

1. Paragraphs (lines, cut at sentence ends) that hold a licence word are candidates, and so are those without one that
   could be confirmed in the end: they hold one of a few 3-grams of a statement that no sufficient part of it lacks.
2. A multinomial logistic regression over hashed word 1- to 3-grams gives the probability of each family and of
   the class ``unknown``. It is trained on the template statements in several guises, on sentences that mention
   licences without granting one, and on a bounded sample of paragraphs of the corpus.
3. The unknown class is calibrated: a third of the training rows is held out, and the cutoff is the least
   probability at which at most ``max_false`` of the held-out unknown rows would be taken for a family.
4. A prediction counts if the paragraph contains enough of the word 3-grams of a statement of that family.

All steps are DataFrame and MLlib operations in the JVM; scoring is local to a row.

Defined results: a null or empty text has no paragraphs; a document without an id is scanned and reported with
a null id; repeated rows add up to one result of their id; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import whole
from tidewatch.session import materialize

# Short statements by licence family.
STATEMENTS = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "You may not use this file except in compliance with the Apache License, Version 2.0.",
                   "This project is released under the Apache 2.0 license."),
    "MIT": ("Released under the MIT License.", "This software is licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "You can redistribute it and/or modify it under the terms of the GNU General Public License version 3.",
                "Licensed under the GPLv3."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GPLv2.",
                "You can redistribute it and/or modify it under the terms of the GNU General Public License version 2."),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License.", "Licensed under the LGPL."),
    "AGPL": ("This program is licensed under the GNU Affero General Public License.", "Licensed under the AGPL."),
    "BSD": ("Released under the BSD License.", "Licensed under the 3-clause BSD license.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
                "Licensed under the Mozilla Public License 2.0."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "public-domain": ("This work has been dedicated to the public domain.", "Released under the CC0 public domain dedication.",
                      "This is free and unencumbered software released into the public domain under the Unlicense."),
    "proprietary": ("All rights reserved.", "No part of this work may be reproduced without permission."),
}
# Sentences about licences that grant none.
MENTIONS = ("She lost her driving license last week.", "The license fee was raised again by the council.",
            "He asked for permission to leave the room.", "Copyright law is discussed in the next chapter.",
            "The court decided on the patent and copyright case.", "A fishing license costs ten dollars.",
            "They renewed the television licence.", "Apache helicopters were seen near the coast.",
            "MIT published a study on sleep.", "The warranty of the car had ended.",
            "The bar lost its liquor license.", "Public domain data sets differ in quality.")
LICENCE_WORD = (r"(?i)licen[sc]e|copyright|all rights|public domain|redistribut|creative commons|permission|unlicense"
                r"|\bl?a?gplv?\d?|\bcc[ -](?:by|0)|\bcc0|warrant|\bmit\b|\bbsd\b|apache|mozilla")

# Parts of words: a paragraph with such a word holds a licence word.
LICENCE_STEM = re.compile("licen[sc]e|copyright|redistribut|permission|unlicense|warrant|apache|mozilla")


@dataclass(frozen=True)
class Settings:
    features: int = 1 << 14
    sampled_paragraphs: int = 2_000
    penalty: float = 1e-3
    max_false: float = 0.01
    containment: float = 0.6
    sample_documents: int = 1_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def _grams(words: str, n: int) -> Column:
    if n == 1:
        return F.col(words)
    tail = ", ".join(f"get({words}, i + {k})" for k in range(1, n))
    return F.expr(f"transform(slice({words}, 1, greatest(size({words}) - {n - 1}, 0)), (x, i) -> concat_ws(' ', x, {tail}))")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of all paragraphs."""
    pieces = F.split(whole(), "\\n|(?<=[.!?])[ \\t]+(?=\\p{Lu})")
    return docs.select("doc_id", F.explode(pieces).alias("text")).where(F.length(F.trim("text")) > 0)


def _table(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    cells = [F.struct(F.lit(a).alias("family"), F.lit(b).alias("text")) for a, b in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def anchors(containment: float) -> list[str]:
    """3-grams without a licence stem such that enough of any statement for ``containment`` holds one of them or a stem."""
    out = []
    for statements in STATEMENTS.values():
        for text in statements:
            words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
            grams = sorted({" ".join(words[i:i + 3]) for i in range(len(words) - 2)}, key=lambda g: (-len(g), g))
            plain = [g for g in grams if not LICENCE_STEM.search(g)]
            # A paragraph may lack this many grams and still be confirmed.
            spare = len(grams) - max(math.ceil(containment * len(grams) - 1e-9), 1)
            out += plain[:max(spare + 1 - (len(grams) - len(plain)), 0)]
    return sorted(set(out))


def candidate(text: Column, settings: Settings) -> Column:
    """Whether a text holds a licence word, or an anchor in any spelling of its gaps."""
    gap = "[^\\p{L}\\p{N}]+"
    grams = "|".join(gram.replace(" ", gap) for gram in anchors(settings.containment))
    # One expression for all anchors, which only the beginning of a word can match.
    return text.rlike(LICENCE_WORD) | F.lower(text).rlike(f"(?<![\\p{{L}}\\p{{N}}])(?:{grams})(?![\\p{{L}}\\p{{N}}])")


def templates(spark: SparkSession) -> DataFrame:
    return _table(spark, [(f, s) for f, statements in STATEMENTS.items() for s in statements])


def training(docs: DataFrame, settings: Settings) -> DataFrame:
    """(family, text, held_out)."""
    spark = docs.sparkSession
    guises = F.array(
        F.col("text"), F.lower("text"), F.upper("text"), F.concat(F.lit("Copyright (c) 2021 The Authors. "), F.col("text")),
        F.concat(F.lit("Note: "), F.col("text"), F.lit(" See the file for details.")), F.regexp_replace("text", "[.,]", ""),
        F.concat(F.lit("All of this is "), F.lower("text")), F.concat(F.col("text"), F.lit(" Some more words follow here.")))
    known = templates(spark).select("family", F.explode(guises).alias("text"))
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(settings.sample_documents)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    lines = paragraphs(sample).where(~candidate(F.col("text"), settings)).select("text").distinct()
    lines = lines.orderBy(F.xxhash64("text")).limit(settings.sampled_paragraphs)
    mentions = _table(spark, [("unknown", m) for m in MENTIONS]).select("family", F.explode(guises).alias("text"))
    every = known.unionByName(mentions).unionByName(lines.select(F.lit("unknown").alias("family"), "text"))
    return materialize(every.withColumn("held_out", F.pmod(F.xxhash64("text"), F.lit(3)) == 0))


class Classifier:
    """Scores a column ``text`` with a family and its probability."""

    def __init__(self, rows: DataFrame, settings: Settings):
        self.settings = settings
        self.hashing = HashingTF(numFeatures=settings.features, binary=True, inputCol="grams", outputCol="features")
        rows = self.featured(rows)
        index = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
        self.families = list(index.labels)
        rows = index.transform(rows)
        fit = LogisticRegression(regParam=settings.penalty, elasticNetParam=0.0, family="multinomial", maxIter=60)
        self.model: LogisticRegressionModel = fit.fit(rows.where("NOT held_out"))
        wrong = self._best(self.model.transform(rows.where("held_out AND family = 'unknown'")))
        least = wrong.agg(F.percentile("p", 1 - settings.max_false).alias("p")).first()["p"]
        self.cutoff = max(0.5, float(least or 0.0))

    def featured(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("words", _words(F.col("text")))
        return self.hashing.transform(rows.withColumn("grams", F.concat(*(_grams("words", n) for n in (1, 2, 3)))))

    def _best(self, scored: DataFrame) -> DataFrame:
        """The most probable family and its probability ``p``."""
        unknown = self.families.index("unknown")
        p = vector_to_array("probability")
        each = F.array(*(F.struct(p[i].alias("p"), F.lit(f).alias("family")) for i, f in enumerate(self.families) if i != unknown))
        best = F.array_max(each)
        return scored.withColumn("best", best).select("*", F.col("best.p").alias("p"), F.col("best.family").alias("found")).drop("best")

    def score(self, rows: DataFrame) -> DataFrame:
        scored = self._best(self.model.transform(self.featured(rows)))
        return scored.withColumn("found", F.when(F.col("p") >= self.cutoff, F.col("found")).otherwise("unknown")).drop(
            "features", "grams", "rawPrediction", "probability", "prediction")


def judged(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, text, found, p, containment, confirmed, speaks) of every candidate paragraph.

    Without a licence word only a confirmed paragraph speaks of licences. ``speaks`` is a column and no filter, as a
    filter would be pushed below the scoring and judge every paragraph twice.
    """
    classifier = Classifier(training(docs, settings), settings)
    rows = paragraphs(docs.where(candidate(F.col("text"), settings))).where(candidate(F.col("text"), settings))
    scored = classifier.score(rows)
    # All statements as one literal: for each family, the 3-grams of each statement.
    statements = templates(docs.sparkSession).withColumn("words", _words(F.col("text"))).select(
        "family", F.when(F.size("words") > 2, _grams("words", 3)).otherwise(F.array(F.array_join("words", " "))).alias("grams")).collect()
    own = F.concat(_grams("words", 3), F.array(F.array_join("words", " ")))
    shares = [F.when(F.col("found") == r["family"], F.size(F.array_intersect(F.col("own"), F.lit(r["grams"]))) / len(set(r["grams"]))).otherwise(0.0)
              for r in statements]
    scored = scored.withColumn("own", own).withColumn("containment", F.greatest(*shares).cast("double"))
    out = scored.select("doc_id", "text", "found", "p", "containment",
                        ((F.col("found") != "unknown") & (F.col("containment") >= settings.containment)).alias("confirmed"))
    return out.withColumn("speaks", F.col("confirmed") | F.col("text").rlike(LICENCE_WORD))


def paragraph_licences(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, text, found, p, containment, confirmed) of every paragraph that speaks of licences."""
    return judged(docs, settings).where("speaks").drop("speaks")


def document_licences(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, licences, n_licence_paragraphs, n_unconfirmed, probability) of every document id."""
    found = judged(docs, settings).groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("found")))), ",").alias("licences"),
        F.count_if("confirmed").alias("n"), F.count_if(F.col("speaks") & ~F.col("confirmed")).alias("m"),
        F.max(F.when(F.col("confirmed"), F.col("p"))).alias("probability"))
    ids = docs.select(F.col("doc_id").alias("id")).distinct()
    return ids.join(found, F.col("id").eqNullSafe(F.col("doc_id")), "left").select(
        F.col("id").alias("doc_id"), F.coalesce("licences", F.lit("")).alias("licences"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_licence_paragraphs"),
        F.coalesce("m", F.lit(0)).cast("long").alias("n_unconfirmed"), "probability")
