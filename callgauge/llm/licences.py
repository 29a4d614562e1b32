"""Licence scans: a trained paragraph classifier, a calibrated unknown class, and comparison with templates.

A paragraph is a line of a text, and also a run of lines between lines without words: licence texts have
hard line ends. Both are described by those of their words, pairs and triples of words that the labelled
paragraphs have, and a multinomial logistic regression, trained here on the templates, on parts of them
and on paragraphs that state no licence, gives a probability for each family. The largest one counts if it
passes the threshold below which held-out paragraphs without a licence fall; otherwise the paragraph is
unknown. What passes is compared with the templates of the family: the share of a template's words, in
pairs, that the paragraph holds confirms it. A run is reported, at its first line, where no line of it is
confirmed alone; its unconfirmed lines of that family are then part of it.

Only paragraphs that have one of the model's telling words are scored: what weights the other words have,
all together, does not lift any family over the threshold, so nothing is skipped that could pass.

All of it is DataFrame expressions and Spark's own learners. Documents are not shuffled; the tables of
templates are small, fixed and broadcast.

Defined cases: null and empty texts have no paragraphs and give no row; a paragraph stated twice gives
two rows; repeated rows give repeated rows; an empty table gives an empty result. Case and punctuation do
not matter. Paragraphs of any length are read whole.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgauge.llm.registry import query, table

CONFIRMED = 0.5
#: Families and paragraphs that state them, as published.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU General Public License", "Licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Lesser General Public License.",
        "Distributed under GPLv3", "Distributed under the GPLv2 or later", "free software under the GNU GPL v3 or later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.", "Released under the BSD license", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "Creative Commons": (
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0", "Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Available under the Creative Commons Attribution-ShareAlike License.", "Text is available under the Creative Commons Attribution-NonCommercial-NoDerivatives License",
        "CC-BY-SA 4.0", "CC-BY 4.0", "CC-BY-NC-SA 4.0",
    ),
    "Public domain": (
        "This work is dedicated to the public domain.", "Released into the public domain.", "Licensed under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all "
        "copyright and related or neighboring rights to this work (CC0).",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ),
    "Proprietary": (
        "All rights reserved.", "Copyright 2020. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited without permission.",
    ),
}
UNKNOWN = "unknown"
#: Paragraphs that sound alike and state no licence.
ALIKE = (
    "He lost his driving licence after the accident last year.", "The city council gave the bar a licence to sell drinks on Sundays.", "She asked for permission to leave the room early.",
    "The copyright of songs is a matter for the courts, says the singer.", "Fishing without a license is not allowed in this lake.", "A search warrant was signed by the judge on Monday.",
    "The warranty of the car ends after three years or so.", "Poetic license lets a writer bend the rules of grammar.", "No license is needed to ride a bicycle in this country.",
    "The government wants to redistribute wealth among the regions.", "Dogs are not permitted on the beach in summer.", "The permission slip must be signed by a parent before the trip.",
    "His license plate was found near the river.", "A licensed electrician should do this work.", "The software vendor raised its license fees again this year.",
    "Copyright law has changed a lot since the printing press was new.", "They discussed which license might be chosen for the project some day.", "The warrant officer reported to the captain.",
    "Install the software and restart the computer before you use it.", "The new version of the program is available for download.", "The source code of the game was lost in a fire.",
    "You may obtain the form at the office of the school.", "All conditions of the contract were met by the seller.", "Our terms of service and the privacy policy have changed.",
    "The general public was not admitted to the hearing.", "The MIT professor gave a talk on physics.", "Students of MIT won the contest with a small robot.", "The Apache people live in Arizona.",
    "Creative work needs time, and so does common sense.", "The commons is a park in the middle of the town.", "Human rights are a matter for all states.", "This work was hard and it took years.",
    "He is free to go, and any person may visit him.", "The book was published by a small house in 2020.", "Parts of this page were written by a friend.", "The Mozilla foundation has its office in California.",
    "A copy of the letter was sent to the authors.", "The domain of the function is the set of all numbers.", "The list of names and the notice hang on the wall.", "The public library opens at 10.0 or later.",
    "It was written in 2020 by a group of people and read by many more.", "The text here.", "And more of it.", "Note: the train leaves at noon.", "the authors", "Version 2.0 of the file is 3.0 MB.",
)


def words(text: Column | str) -> Column:
    """Lower-case words of letters, digits and inner points or dashes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"), 0)


def grams(w: Column, sizes: tuple[int, ...]) -> Column:
    """Runs of words of the given lengths, joined by blanks."""

    def of(n: int) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - n + 1, F.lit(0))), lambda _, i: F.array_join(F.slice(w, i + 1, n), " "))

    return F.concat(*[of(n) for n in sizes])


def known_grams(w: Column, vocabulary: list[str]) -> Column:
    """Those runs of one, two and three words that can be in ``vocabulary``: all their words are in it alone too.

    Most words of a text are not, and no run that has one of them is put together.
    """
    alone = [g for g in vocabulary if " " not in g]
    known = lambda step: lambda i: F.get(w, i + step).isin(*alone)
    one = F.filter(F.transform(w, lambda _, i: i), known(0))
    two = F.filter(one, known(1))
    three = F.filter(two, known(2))
    run = lambda n: lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])
    return F.concat(*[F.transform(at, run(n)) for n, at in enumerate((one, two, three), 1)])


def worded(df: DataFrame, text: str = "paragraph") -> DataFrame:
    """Add ``__words``."""
    return df.withColumn("__words", words(text))


def featured(df: DataFrame, vocabulary: CountVectorizerModel) -> DataFrame:
    """Add the sparse vector ``__features`` of ``__words``."""
    return vocabulary.transform(df.withColumn("__grams", known_grams(F.col("__words"), vocabulary.vocabulary))).drop("__grams")


def families() -> list[str]:
    return [UNKNOWN, *TEMPLATES]


def labelled(spark: SparkSession) -> DataFrame:
    """(paragraph, family, label, fold): templates and lookalikes, whole, in halves and inside other words."""
    rows = [(t, f) for f, texts in TEMPLATES.items() for t in texts] + [(t, UNKNOWN) for t in ALIKE]
    numbered = spark.createDataFrame([(t, f, float(families().index(f)), i) for i, (t, f) in enumerate(rows)], "text string, family string, label double, n int")
    w = F.split("text", " ")
    half = F.ceil(F.size(w) / 2).cast("int")
    long = F.size(w) >= 12
    around = [F.concat(F.lit(before), F.col("text"), F.lit(after)) for before, after in (("", ""), ("Note: ", ""), ("The text here. ", " And more of it."), ("(c) the authors. ", ""))]
    variants = F.array(*around, F.when(long, F.array_join(F.slice(w, 1, half), " ")), F.when(long, F.array_join(F.slice(w, half + 1, F.size(w)), " ")))
    out = numbered.select(F.posexplode(F.filter(variants, lambda v: v.isNotNull())).alias("part", "paragraph"), "family", "label", "n")
    return out.select("paragraph", "family", "label", F.pmod(F.xxhash64("n", "part"), F.lit(3)).alias("fold"))


def fit_licences(spark: SparkSession) -> tuple[CountVectorizerModel, LogisticRegressionModel, float]:
    """The words that are looked at, the classifier, and the threshold of the unknown class.

    A model learnt without one third of the paragraphs scores that third; the threshold is where those without
    a licence among them fall below, but at least one half.
    """
    # a few hundred rows: in one partition a step of the fit is one task
    wordy = worded(labelled(spark).coalesce(1)).withColumn("__grams", grams(F.col("__words"), (1, 2, 3))).persist()
    vocabulary = CountVectorizer(inputCol="__grams", outputCol="__features", binary=True, vocabSize=1 << 20).fit(wordy)
    rows = featured(wordy, vocabulary).persist()
    learner = LogisticRegression(featuresCol="__features", labelCol="label", maxIter=60, regParam=0.002, elasticNetParam=0.2, standardization=False)
    held = learner.fit(rows.filter("fold <> 0")).transform(rows.filter("fold = 0"))
    top = F.array_max(F.slice(vector_to_array("probability"), 2, len(families())))
    highest = held.filter(F.col("family") == UNKNOWN).agg(F.max(top).alias("p")).first()["p"]
    model = learner.fit(rows)
    rows.unpersist()
    wordy.unpersist()
    return vocabulary, model, min(max(0.5, (highest or 0.0) + 0.01), 0.9)


#: Common words, which are left out first. They only steer speed.
COMMON = frozenset("the of and to in a is for on that with as by at this it be are or from an was you not have your will has all its if can may any no into must use more so they their which "
                   "but one we our other new also part parts people time work after first text see time out up use used".split())


def telling_words(vocabulary: list[str], weights: np.ndarray, intercepts: np.ndarray, threshold: float) -> list[str] | None:
    """Words of which every paragraph has one that some family's probability passes ``threshold`` for; None: there may be none in it.

    A family passes only if it leads the unknown class by the log odds of the threshold. What each gram adds
    to that lead is booked on its longest word; short words, as the commonest, are left out as long as all
    that is booked on those left out does not give any family that lead.
    """
    lead = math.log(threshold / (1 - threshold)) + intercepts[0] - intercepts[1:] - 1e-6
    if (lead <= 0).any():
        return None
    booked: dict[str, np.ndarray] = {}
    for gram, gain in zip(vocabulary, np.maximum(weights[1:] - weights[0], 0).T):
        for_word = max(gram.split(" "), key=lambda w: (len(w), w))
        booked[for_word] = booked.get(for_word, 0) + gain
    left, telling = np.zeros(len(lead)), []
    for word in sorted(booked, key=lambda w: (w not in COMMON, len(w), w)):
        if ((left + booked[word])[booked[word] > 0] < lead[booked[word] > 0]).all():
            left = left + booked[word]
        else:
            telling.append(word)
    return telling


def paragraphs(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(keep..., __run, paragraph_no, __whole, __words): lines, and runs of several lines between lines without words.

    No word goes over the end of a line, so the words of a run are those of its lines: each line's words are found once.
    """
    lines = docs.select(*keep, F.split("text", "\n", -1).alias("__lines"))
    # the flags have a line without words before and after: flag i + 1 is that of line i
    flags = F.concat(F.array(F.lit(False)), F.transform("__lines", lambda t: t.rlike(r"[\p{L}\p{N}]")), F.array(F.lit(False)))
    lines = lines.withColumn("__flags", flags)
    edge = lambda step: F.filter(F.sequence(F.lit(1), F.size("__lines")), lambda i: F.get("__flags", i) & ~F.get("__flags", i + step))
    # a run travels with its own lines only
    runs = F.transform(F.arrays_zip(edge(-1).alias("a"), edge(1).alias("b")), lambda r: F.struct(r["a"].alias("a"), F.slice("__lines", r["a"], r["b"] - r["a"] + 1).alias("own")))
    run = lines.select(*keep, F.explode(runs).alias("r"))
    # the number of the run depends on its place, so what reads the words is not moved below and does not find them anew
    run = run.select(*keep, F.monotonically_increasing_id().alias("__run"), (F.col("r.a") - 1).alias("__first"), F.transform("r.own", words).alias("__own"))
    parts = F.transform("__own", lambda w, i: F.struct((F.col("__first") + i).alias("no"), F.lit(False).alias("whole"), w.alias("words")))
    whole = F.array(F.struct(F.col("__first").alias("no"), F.lit(True).alias("whole"), F.flatten("__own").alias("words")))
    out = run.select(*keep, "__run", F.explode(F.when(F.size("__own") > 1, F.concat(parts, whole)).otherwise(parts)).alias("u"))
    return out.select(*keep, "__run", F.col("u.no").alias("paragraph_no"), F.col("u.whole").alias("__whole"), F.col("u.words").alias("__words"))


def held(df: DataFrame) -> DataFrame:
    """``df`` with a column ``__held`` that depends on the row's place: a filter that reads it stays above all that is computed so far.

    Pushed below, a filter would take the columns' expressions with it and find a paragraph's words anew for every gram.
    """
    return df.withColumn("__held", F.monotonically_increasing_id())


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., paragraph_no, family, probability, similarity, confirmed) for every paragraph that states a licence."""
    spark = docs.sparkSession
    vocabulary, model, threshold = fit_licences(spark)
    telling = telling_words(vocabulary.vocabulary, model.coefficientMatrix.toArray(), model.interceptVector.toArray(), threshold)
    asked = held(paragraphs(docs, keep))
    if telling is not None:
        asked = asked.filter((F.col("__held") >= 0) & F.arrays_overlap("__words", F.array(*map(F.lit, telling))))
    p = vector_to_array("probability")
    best = F.array_max(F.slice(p, 2, len(families())))
    names = F.array(*map(F.lit, families()))
    place = (*keep, "__run", "paragraph_no", "__whole")
    judged = model.transform(featured(asked, vocabulary)).select(*place, "__words", best.alias("__p"), F.element_at(names, F.array_position(p, best).cast("int")).alias("family"))
    stated = held(judged).filter((F.col("__held") >= 0) & (F.col("__p") >= threshold)).drop("__held")
    pairs = spark.createDataFrame([(f, t) for f, texts in TEMPLATES.items() for t in texts], "family string, text string").select(
        "family", F.array_distinct(grams(words("text"), (2,))).alias("pairs")).groupBy("family").agg(F.collect_list("pairs").alias("__templates"))
    own = F.array_distinct(grams(F.col("__words"), (2,)))
    compared = stated.withColumn("__own", own).join(F.broadcast(pairs), "family")
    share = F.array_max(F.transform("__templates", lambda t: F.size(F.array_intersect(t, F.col("__own"))) / F.greatest(F.size(t), F.lit(1))))
    found = compared.select(*place, "family", "__p", share.alias("__share"))
    # only what states a licence is shuffled: the rows of a run, which tell each other what is known of it
    within = Window.partitionBy("__run", "family")
    sure, line = F.col("__share") >= CONFIRMED, ~F.col("__whole")
    any_of = lambda c: F.coalesce(F.max(c).over(within), F.lit(False))
    found = found.withColumns({"__line": any_of(line), "__sure_line": any_of(line & sure), "__sure_run": any_of(~line & sure)})
    kept = F.when(line, sure | F.col("__sure_line") | ~F.col("__sure_run")).otherwise(~F.col("__sure_line") & (sure | ~F.col("__line")))
    return found.filter(kept).select(*keep, "paragraph_no", "family", F.round("__p", 4).alias("probability"), F.round("__share", 4).alias("similarity"), sure.alias("confirmed"))


@query("op8_license_scan")
def op8_license_scan(spark, sf_dir):
    """Every paragraph of the documents that states a licence, with its family."""
    return scan(table(spark, sf_dir, "documents"))
