"""Licence notices: a trained paragraph classifier over sparse word n-grams, confirmed by templates.

A multinomial logistic regression learns families from the fixed notices below (whole, and with
single words missing) and the class ``unknown`` from a bounded sample of the corpus and from notices
of licences that are none of the families. A temperature, fitted on examples kept apart, calibrates
its probabilities. Notices of other licences are a class of their own while it learns, which counts as
unknown. A paragraph that is given a family is compared with that family's notices, and with all others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.workspace import materialize

UNKNOWN = "unknown"
#: Documents of the corpus that the unknown class is learned from, and their longest text.
BACKGROUND_DOCUMENTS = 400
BACKGROUND_CHARS = 20_000
LEAST_PROBABILITY = 0.5
LEAST_SIMILARITY = 0.6

# Notices of licence families.
NOTICES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is available under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License.",
        "Released under the Apache 2.0 license.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation.",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC0": (
        "Dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "reserved": (
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission.",
    ),
}
FAMILIES = (UNKNOWN, *NOTICES)
# Licences that are none of the families, and how they are named.
OTHER_LICENSES = (
    "ISC", "Zlib", "Boost Software", "Eclipse Public", "Artistic", "European Union Public",
    "Academic Free", "Open Software", "GNU Lesser General Public", "GNU Affero General Public",
    "Python Software Foundation", "PostgreSQL", "Microsoft Public", "SIL Open Font", "Open Database",
    "CeCILL", "Ruby", "PHP", "Server Side Public", "Elastic", "Business Source", "Acme", "Example",
)
OTHER_PHRASES = (
    "Released under the {} License.",
    "Licensed under the {} License.",
    "Licensed under the {} License, version 2.0.",
    "This work is licensed under the {} License, version 3.",
    "This project is available under the terms of the {} License.",
)
OTHER_NOTICES = (
    "Licensed under CC BY-SA 4.0.",
    "Licensed under CC BY-ND 4.0.",
    "Licensed under CC BY-NC-SA 4.0.",
    "Licensed under CC BY-NC-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under the GNU General Public License, version 2.",
    "Released under the GNU GPL v2.",
    "Released under the GNU AGPL v3.",
    "Released under the GNU LGPL v3.",
    "This program is licensed under the GNU Affero General Public License, version 3.",
    "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "All rights are with their owners.",
    "Some rights reserved.",
    "No rights reserved.",
)
#: The class of other licences.
OTHER = float(len(FAMILIES))
OTHERS = (*OTHER_NOTICES, *(phrase.format(name) for name in OTHER_LICENSES for phrase in OTHER_PHRASES))
_WORD = re.compile(r"[^\W_]+")
#: The same words for Spark's functions.
_GAP = r"[^\p{L}\p{N}]+"


@dataclass
class LicenseModel:
    """Vocabulary, fitted regression and temperature; without ``needed`` n-grams all is unknown."""

    vocabulary: list[str]
    needed: list[str]
    regression: LogisticRegressionModel
    temperature: float


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _GAP), lambda w: w != "")


def _with_grams(rows: DataFrame, text_col: str) -> DataFrame:
    rows = rows.withColumn("_words", word_array(F.col(text_col)))
    size = F.greatest(F.size("_words") - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice("_words", F.lit(1), size),
        F.slice("_words", F.lit(2), size),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return rows.withColumn("_grams", F.concat("_words", F.when(size > 0, pairs).otherwise(F.array())))


def own_words(family: str) -> list[set[str]]:
    """For each notice of a family, its words that no notice of another licence has."""
    rest = [n for other, ns in NOTICES.items() if other != family for n in ns]
    taken = {w for notice in (*rest, *OTHERS) for w in _words(notice)}
    return [set(_words(notice)) - taken for notice in NOTICES[family]]


def _examples(background: list[str], single: list[str]) -> list[tuple[str, float, int]]:
    """``(text, class, kept apart)``: notices, notices less a word, others, single words, background.

    A word of the notice's own is never left out, so that its absence speaks for unknown.
    """
    rows = []
    for number, family in enumerate(FAMILIES[1:], 1):
        for notice, own in zip(NOTICES[family], own_words(family), strict=True):
            words = _words(notice)
            rows.append((notice, float(number), 0))
            for k, word in enumerate(words):
                if word not in own or len(own) > 2:
                    rows.append((" ".join(words[:k] + words[k + 1 :]), float(number), int(k % 3 == 2)))
    shared = {w for ns in NOTICES.values() for n in ns for w in _words(n)}
    for number, notice in enumerate(OTHERS):
        words = _words(notice)
        rows.append((notice, OTHER, number % 4 // 3))
        for k, word in enumerate(words):
            if word in shared and set(words) - shared:
                rows.append((" ".join(words[:k] + words[k + 1 :]), OTHER, int(k % 3 == 2)))
    rows += [(word, 0.0, k % 3 // 2) for k, word in enumerate(single)]
    return rows + [(text, 0.0, k % 3 // 2) for k, text in enumerate(background)]


def fit_licenses(docs: DataFrame, text_col: str) -> LicenseModel:
    """Learn families from the notices and the unknown class from a bounded sample of ``docs``.

    Paragraphs of the sample that have most words of some notice are not taken for unknown.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    sample = (
        docs.select(text.alias("text"))
        .where(F.length("text").between(1, BACKGROUND_CHARS))
        .orderBy(F.xxhash64(F.lit(3), "text"), "text")
        .limit(BACKGROUND_DOCUMENTS)
        .select(F.explode(F.split("text", "\n")).alias("text"))
        .where(F.trim("text") != "")
        .collect()
    )
    notices = [set(_words(n)) for ns in NOTICES.values() for n in ns]
    background = sorted({r.text for r in sample})
    background = [
        t for t in background if all(len(n & set(_words(t))) < 0.6 * len(n) for n in notices)
    ]
    everything = [n for ns in (*NOTICES.values(), OTHERS) for n in ns]
    vocabulary = sorted({g for n in everything for g in _grams(_words(n))})
    single = sorted({w for n in notices for w in n})
    rows = spark.createDataFrame(
        _examples(background, single), "text string, label double, apart int"
    ).coalesce(1)
    vectors = _vectors(_with_grams(rows, "text"), vocabulary)
    known = vectors.where("apart = 0").groupBy("label").count().collect()
    share = {r.label: r["count"] for r in known}
    weight = F.lit(1.0)
    for label, count in share.items():
        weight = F.when(F.col("label") == label, F.lit(sum(share.values()) / count)).otherwise(weight)
    regression = LogisticRegression(
        featuresCol="_x", labelCol="label", weightCol="weight", regParam=1e-4, maxIter=100,
        family="multinomial", standardization=False,
    ).fit(vectors.where("apart = 0").withColumn("weight", weight))
    apart = regression.transform(vectors.where("apart = 1").select("_x", "label"))
    margins = [
        (r.margins, int(r.label))
        for r in apart.select(vector_to_array("rawPrediction").alias("margins"), "label").collect()
    ]
    common = Counter(g for text in background for g in set(_grams(_words(text))))
    needed = _needed(vocabulary, regression, common)
    return LicenseModel(vocabulary, needed, regression, _temperature(margins))


def _needed(vocabulary: list[str], regression: LogisticRegressionModel, common: Counter) -> list[str]:
    """N-grams of which every paragraph given a family has one.

    The n-grams left out are such that all of them together lift no family above unknown; the most
    common ones are left out first.
    """
    weights = regression.coefficientMatrix.toArray()
    start = regression.interceptVector.toArray()
    families = slice(1, len(FAMILIES))
    lifts = (weights[families] - weights[0]).clip(min=0.0)
    room = start[0] - start[families]
    needed = []
    for k in sorted(range(len(vocabulary)), key=lambda k: (-common[vocabulary[k]], vocabulary[k])):
        if (lifts[:, k] <= room).all():
            room = room - lifts[:, k]
        else:
            needed.append(vocabulary[k])
    # A pair of words is there only where either word is.
    words = set(needed)
    return sorted(g for g in needed if " " not in g or not words.intersection(g.split()))


def _any_of(grams: list[str]) -> str:
    """A pattern for any of the n-grams as whole words, with common beginnings written once."""

    def branch(rest: list[str]) -> str:
        by_first: dict[str, list[str]] = {}
        for gram in rest:
            by_first.setdefault(gram[:1], []).append(gram[1:])
        ends = r"(?![\p{L}\p{N}])" if "" in by_first else None
        options = [
            (_GAP if first == " " else re.escape(first)) + branch(own) for first, own in by_first.items() if first
        ]
        return "(?:" + "|".join([*options, *([ends] if ends else [])]) + ")"

    return r"(?<![\p{L}\p{N}])" + branch(sorted(set(grams)))


def _temperature(margins: list[tuple[list[float], int]]) -> float:
    """The divisor of the margins under which the examples kept apart are likeliest."""

    def loss(t: float) -> float:
        total = 0.0
        for values, label in margins:
            top = max(values) / t
            total += math.log(sum(math.exp(v / t - top) for v in values)) + top - values[label] / t
        return total

    return min((2.0 ** (k / 4) for k in range(-8, 17)), key=loss)


def _vectors(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    counted = CountVectorizerModel.from_vocabulary(
        vocabulary, inputCol="_grams", outputCol="_x", minTF=0
    )
    return counted.setBinary(True).transform(rows)


def scan_licenses(docs: DataFrame, model: LicenseModel, id_col: str, text_col: str) -> DataFrame:
    """``(id, paragraph, text, family, probability, similarity, confirmed)`` of licence paragraphs.

    Paragraphs are lines, counted from 0. Texts and lines without any n-gram that a family needs
    are unknown and are passed over; every other paragraph is scored.
    ``similarity`` is the best one with a notice of the family: the Jaccard similarity of the words, or
    the share of the notice's word pairs that the paragraph holds, if that is more. It is confirmed at
    ``LEAST_SIMILARITY``, if the paragraph has the notice's own words and is less similar to all
    notices of other licences. NULL, empty
    and blank texts give no row; NULL ids are carried; repeated rows stay; other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if not model.needed:
        rows = rows.where("false")
        any_needed = "^$"
    else:
        any_needed = _any_of(model.needed)
    lines = (
        rows.where(F.lower("text").rlike(any_needed))
        .select("id", F.posexplode(F.split("text", "\n", -1)).alias("paragraph", "text"))
        .where(F.lower("text").rlike(any_needed))
    )
    # Margins are written, so that the regression is evaluated once per line and not once per use.
    scored = margins(lines, model)
    scored = materialize(scored, "license-margins")
    top = F.array_max("margins")
    total = F.aggregate("margins", F.lit(0.0), lambda a, m: a + F.exp(m - F.array_max("margins")))
    scored = scored.withColumns(
        {"number": F.array_position("margins", top).cast("int"), "probability": F.lit(1.0) / total}
    )
    is_family = F.col("number").between(2, len(FAMILIES))
    scored = scored.where(is_family & (F.col("probability") >= LEAST_PROBABILITY))
    compared = _compared(scored)
    return compared.select(
        "id",
        "paragraph",
        "text",
        F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.col("number")).alias("family"),
        "probability",
        "similarity",
        (
            (F.col("similarity") >= LEAST_SIMILARITY) & F.col("named") & (F.col("similarity") > F.col("other"))
        ).alias("confirmed"),
    )


def margins(lines: DataFrame, model: LicenseModel) -> DataFrame:
    """``lines`` with ``margins``: calibrated, of each of ``FAMILIES`` and of other licences."""
    scored = model.regression.transform(_vectors(_with_grams(lines, "text"), model.vocabulary))
    values = F.transform(vector_to_array("rawPrediction"), lambda m: m / model.temperature)
    return scored.select(*[F.col(c) for c in lines.columns], values.alias("margins"))


def _compared(scored: DataFrame) -> DataFrame:
    """``similarity`` with the family's notices, ``other`` with all others, and whether it is ``named``.

    Named is a paragraph that has half of the words that only one of the family's notices has, for
    the notice it is most similar to; a notice without such words names its family by similarity.
    """
    rows = _with_grams(scored, "text").withColumn("_own", F.array_distinct("_words"))

    def entry(notice: str, own: set[str]) -> Column:
        words = set(_words(notice))
        pairs = set(_grams(_words(notice))) - words
        listed = [F.array(*[F.lit(w) for w in sorted(x)]).cast("array<string>") for x in (words, pairs, own)]
        return F.struct(*[x.alias(n) for x, n in zip(listed, ("words", "pairs", "own"), strict=True)])

    # Fixed values as one literal: the notices of each family, and of everything else.
    table = F.array(
        *[F.array(*[entry(n, o) for n, o in zip(ns, own_words(f), strict=True)]) for f, ns in NOTICES.items()]
    )
    others = F.array(*[entry(n, set()) for n in OTHERS])

    def likeness(x: Column) -> Column:
        jaccard = F.size(F.array_intersect("_own", x.words)) / F.size(F.array_union("_own", x.words))
        return F.greatest(jaccard, F.size(F.array_intersect("_grams", x.pairs)) / F.size(x.pairs))

    def judged(x: Column) -> Column:
        there = F.size(F.array_intersect("_own", x.own)) * 2 >= F.size(x.own)
        return F.struct(likeness(x).alias("similarity"), there.alias("named"))

    own = F.get(table, F.col("number") - 2)
    rows = rows.withColumn("_notice", F.array_max(F.transform(own, judged)))
    rival = F.transform(
        F.flatten(F.filter(table, lambda f, i: i != F.col("number") - 2)), lambda x: likeness(x)
    )
    other = F.greatest(F.array_max(rival), F.array_max(F.transform(others, likeness)))
    return rows.withColumns(
        {"similarity": F.col("_notice.similarity"), "named": F.col("_notice.named"), "other": other}
    )
