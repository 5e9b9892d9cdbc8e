"""Licence scans (operator 8), with DataFrame functions only.

Paragraphs (runs of lines between blank lines) are cut into overlapping windows of words, which become
sparse counts of word n-grams. A multinomial logistic regression, trained here on variations of notice
templates and on a bounded sample of the corpus, gives each window a licence family or none; its scores are
calibrated by one temperature on rows kept from training. A family is reported only if its calibrated
probability reaches ``least_probability`` and the window holds ``least_overlap`` of one of the family's
templates.

What no template could confirm is not scored. That loses nothing: who holds a share of a template's word
pairs holds one of any few of them (``gate_words``), and with it a word that the text must contain.
"""

from __future__ import annotations

import functools
import json
import math
import operator
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import removed, table, written

#: Notices by which the licences are commonly named or granted.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "MIT License",
        "MIT licensed",
        "License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache License, Version 2.0.",
        "Apache License",
        "Apache 2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Released under the GNU GPL, version 3.",
        "GPL 3.0",
        "GPLv3",
        "GPL v3",
        "GNU General Public License, version 3",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the terms of the GNU GPL, version 2.",
        "GPL 2.0",
        "GPLv2",
        "GPL v2",
        "GNU General Public License, version 2",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the GNU LGPL, version 3.",
        "LGPL 3.0",
        "LGPLv3",
        "LGPL v3",
        "GNU Lesser General Public License, version 3",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU AGPL, version 3.",
        "AGPL 3.0",
        "AGPLv3",
        "AGPL v3",
        "GNU Affero General Public License, version 3",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions of this license are met.",
        "BSD License",
        "BSD 3-Clause",
        "BSD 2-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "MPL 2.0",
        "MPLv2",
        "Mozilla Public License",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "CC BY-NC 4.0",
        "CC BY-NC 3.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "CC BY 4.0",
        "CC BY 3.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "CC BY-SA 4.0",
        "CC BY-SA 3.0",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Alle Rechte vorbehalten.",
        "Todos los derechos reservados.",
        "Tous droits réservés.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
    ],
}
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]
#: Words too common to look for while a template has others.
COMMON = {"version", "the", "by", "of", "or", "this", "is", "in", "to", "any", "a", "and", "under", "with", "that", "you", "may", "not", "use", "be", "it", "all", "are", "no", "part", "work"}
#: (words, step) of the windows that a paragraph is cut into: for short notices that stand close together, and for long ones.
WINDOWS = ((12, 4), (40, 20))
BUCKETS = 1 << 13
PROSE = [
    "You need a license to drive a car in this country.",
    "He asked for permission to leave the room and it was granted at once.",
    "The copyright law of the country was changed in that year by the parliament.",
    "She lost her driving licence and had to renew it under the new rules.",
    "The state licenses the sale of tobacco and the license must be renewed each year.",
    "With permission of the owner the house was opened to the public.",
    "The paintings are in the public domain because the painter died long ago.",
    "Read the license of each file before you use any part of it.",
]


def words_of(text: Column) -> Column:
    """Lower-case words of letters, digits and inner dots, so that version numbers stay whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.[\p{N}]+)*"), 0)


def once(value: Column) -> Column:
    """A generator of one row, so that the optimiser doesn't copy ``value`` into each place (and each step of a loop) that uses it."""
    return F.explode(F.array(value))


def grams_of(words: Column, n: int) -> Column:
    count = F.size(words) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def with_counts(df: DataFrame) -> DataFrame:
    """Adds ``features``: hashed counts of one, two and three words of ``words``."""
    grams = F.concat(F.col("words"), grams_of(F.col("words"), 2), grams_of(F.col("words"), 3))
    return HashingTF(numFeatures=BUCKETS, inputCol="grams", outputCol="features").transform(df.select("*", once(grams).alias("grams"))).drop("grams")


def words_in(text: str) -> list[str]:
    """What ``words_of`` finds, for templates."""
    return re.findall(r"[^\W_]+(?:\.[0-9]+)*", text.lower())


def pieces_in(text: str) -> list[str]:
    """The distinct word pairs of a template, or its word, if it has but one."""
    words = words_in(text)
    return list(dict.fromkeys(map(" ".join, zip(words, words[1:], strict=False)))) or words


def needed(n: int, least_overlap: float) -> int:
    return max(1, math.ceil(least_overlap * n - 1e-9))


def gate_words(least_overlap: float) -> list[str]:
    """Words of which a window must have one to hold ``least_overlap`` of any template.

    Of a template's n pieces at most n - needed(n) may be missing. Words are chosen, long ones first, until more of
    its pieces than that have one of them.
    """
    chosen: set[str] = set()
    for text in (t for texts in TEMPLATES.values() for t in texts):
        pieces = [set(p.split()) for p in pieces_in(text)]
        missing = len(pieces) - needed(len(pieces), least_overlap)
        for word in sorted(set(words_in(text)), key=lambda w: (w in COMMON, w not in chosen, -len(w), w)):
            if sum(bool(p & chosen) for p in pieces) > missing:
                break
            if any(word in p and not p & chosen for p in pieces):
                chosen.add(word)
    return sorted(chosen)


def windows_of(words: Column, scales: tuple[tuple[int, int], ...]) -> Column:
    """The (begin, words) of all windows; a paragraph that fits the first scale has one."""
    n = F.size(words)
    out = []
    for k, (size, step) in enumerate(scales):
        begins = F.when(n > size, F.sequence(F.lit(0), F.greatest(n - step - 1, F.lit(0)), F.lit(step))).otherwise(F.array(F.lit(0)))
        if k:
            begins = F.when(n > scales[0][0], begins).otherwise(F.array().cast("array<int>"))
        out.append(F.transform(begins, _window(words, size)))
    return F.concat(*out)


def _window(words: Column, size: int):
    return lambda b: F.struct(b.cast("int").alias("begin"), F.slice(words, b + 1, size).alias("words"))


def paragraphs(documents: DataFrame, gate: list[str] | None = None) -> DataFrame:
    """row (a key of the input row), doc_id, paragraph (from 0), all (its words); only those that contain a word of ``gate``, if given."""
    has = lambda c: functools.reduce(operator.or_, (F.contains(F.lower(c), F.lit(w)) for w in gate)) if gate else F.lit(True)
    texts = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(has(F.col("text")))
    parts = texts.select("row", "doc_id", F.posexplode(F.split("text", r"\n[ \t\r]*\n")).alias("paragraph", "part")).filter(has(F.col("part")))
    return parts.select("row", "doc_id", "paragraph", once(words_of(F.col("part"))).alias("all"))


def template_pieces() -> Column:
    """(family, pieces) of each template, as a constant."""
    return F.from_json(F.lit(json.dumps([{"family": f, "pieces": pieces_in(t)} for f, texts in TEMPLATES.items() for t in texts])), "array<struct<family string, pieces array<string>>>")


def pieces_of(words: Column) -> Column:
    return F.concat(words, grams_of(words, 2))


def templates(spark: SparkSession) -> DataFrame:
    """family, words of each template."""
    given = F.from_json(F.lit(json.dumps([{"family": f, "text": t} for f, texts in TEMPLATES.items() for t in texts])), "array<struct<family string, text string>>")
    return spark.range(1).select(F.explode(given).alias("x")).select("x.family", once(words_of(F.col("x.text"))).alias("words"))


def training_rows(corpus: DataFrame, variations: int, sample_rows: int, sample_windows: int, least_overlap: float) -> DataFrame:
    """label, words, kept (for calibration): variations of each template, prose that uses the terms, and
    ``sample_windows`` windows of ``sample_rows`` documents (those of the smallest hashes) that hold no template."""
    spark = corpus.sparkSession
    label = lambda family: F.array_position(F.array(*map(F.lit, FAMILIES)), family) - 1
    chance = lambda w, i, k: F.pmod(F.xxhash64(w, i, F.col(k)), F.lit(1000))
    # the first variation is the template itself; the others lose a tenth of the words (if they have five or more) and gain some around them
    varied = templates(spark).crossJoin(spark.range(variations).withColumnRenamed("id", "k"))
    filler = F.array(*[F.lit(w) for w in "project code page see also text by author in year copyright 2019 file here note end is under".split()])
    some = lambda salt: F.filter(filler, lambda w, i: chance(w, i + salt, "k") < 200)
    # every third stands among words that mean nothing, as in a window of a long paragraph
    noise = lambda salt: F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: F.substring(F.md5(F.concat_ws(":", F.col("k").cast("string"), i.cast("string"), F.array_join("words", ""), F.lit(salt)).cast("binary")), 1, 7))
    around = lambda c, salt: F.when(F.col("k") % 3 == 1, F.concat(noise(salt), c)) if salt == "a" else F.when(F.col("k") % 3 == 1, F.concat(c, noise(salt)))
    partial = F.filter("words", lambda w, i: (F.size("words") < 5) | (chance(w, i, "k") >= 100))
    framed = around(around(partial, "a"), "b")
    varied = varied.select("family", "k", once(F.when(F.col("k") == 0, F.col("words")).otherwise(F.coalesce(framed, F.concat(some(100), partial, some(200))))).alias("words"))
    good = varied.select(label(F.col("family")).alias("label"), "words", (F.col("k") % 5 == 4).alias("kept"))
    said = spark.range(1).select(F.explode(F.array(*map(F.lit, PROSE))).alias("t")).select(once(words_of(F.col("t"))).alias("words"))
    shuffled = templates(spark).select("words").filter(F.size("words") >= 6).union(said.select("words")).crossJoin(spark.range(variations).withColumnRenamed("id", "k"))
    # words of notices in another order, and prose: neither is a notice
    mixed_up = shuffled.select("k", once(F.transform(F.array_sort(F.transform("words", lambda w, i: F.struct(F.xxhash64(w, i, F.col("k")).alias("h"), w.alias("w")))), lambda x: x["w"])).alias("words"))
    plain = said.crossJoin(spark.range(variations).withColumnRenamed("id", "k")).select("k", once(F.filter("words", lambda w, i: chance(w, i, "k") >= 100)).alias("words"))
    plain = plain.unionAll(plain.select("k", noise("c")))
    chosen = corpus.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = paragraphs(corpus.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # at most sample_rows ids
    cut = sample.select(F.explode(windows_of(F.col("all"), WINDOWS)).alias("x")).select("x.words").distinct().orderBy(F.xxhash64("words"), "words").limit(sample_windows)
    share = F.transform(template_pieces(), lambda x: F.size(F.array_intersect(x["pieces"], F.col("own"))) / F.size(x["pieces"]))
    lines = cut.select("words", once(pieces_of(F.col("words"))).alias("own")).filter(F.array_max(share) < least_overlap).select(F.pmod(F.xxhash64("words"), F.lit(1000)).alias("k"), "words")
    bad = mixed_up.select("k", "words").union(plain).union(lines)
    return good.union(bad.select(F.lit(0).cast("long"), "words", F.col("k") % 5 == 4)).filter(F.size("words") > 0)


def trained(corpus: DataFrame, variations: int = 40, sample_rows: int = 300, sample_windows: int = 3000, least_overlap: float = 0.7) -> tuple[LogisticRegressionModel, float]:
    """The model, and the temperature of the least log loss on the rows kept from its training."""
    rows, path = written(with_counts(training_rows(corpus, variations, sample_rows, sample_windows, least_overlap)), "licence-training")
    model = LogisticRegression(family="multinomial", regParam=0.0005, maxIter=40, labelCol="label").fit(rows.filter("NOT kept").withColumn("label", F.col("label").cast("double")))
    kept = model.transform(rows.filter("kept")).select("label", vector_to_array("rawPrediction").alias("raw"))
    grid = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]
    loss = kept.agg(*[F.avg(-F.log(F.greatest(F.element_at(_softmax(F.col("raw"), t), F.col("label").cast("int") + 1), F.lit(1e-12)))).alias(str(k)) for k, t in enumerate(grid)]).first()
    removed(corpus.sparkSession, path)
    return model, min((loss[k] if loss[k] is not None else 9.0, t) for k, t in enumerate(grid))[1]


def _softmax(raw: Column, temperature: float) -> Column:
    top = F.array_max(raw)
    powers = F.transform(raw, lambda x: F.exp((x - top) / temperature))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def scanned(documents: DataFrame, least_probability: float = 0.5, least_overlap: float = 0.7) -> DataFrame:
    """doc_id, paragraph, family, probability, overlap, word of each licence family confirmed in a paragraph.

    Paragraphs are the runs of lines between blank lines, from 0; a notice may be wrapped over lines, and a paragraph may hold
    several families. ``word`` is where the best window of the family begins. ``overlap`` is the share of the pieces
    (word pairs; the word of a template of one) of one of the family's templates that the window holds. A
    family goes if what it matches is but a part of what another family matches in the paragraph (the
    Lesser licence's name holds most of the name of the other). What the model takes for unknown, or no template confirms,
    gives no row; nor do null, empty and blank texts. Each row is scanned by itself, also with a null or
    repeated doc_id; repeated rows are repeated in the result. Only doc_id and text are read. An empty
    table gives an empty result. A text is held whole by one task, as words.
    """
    documents = documents.select("doc_id", "text")
    model, temperature = trained(documents, least_overlap=least_overlap)
    gate = gate_words(least_overlap)
    cut = paragraphs(documents, gate).select("row", "doc_id", "paragraph", F.explode(windows_of(F.col("all"), WINDOWS)).alias("x")).select("row", "doc_id", "paragraph", "x.begin", "x.words")
    cut = cut.filter(F.arrays_overlap("words", F.split(F.lit(" ".join(gate)), " ")))
    scored = model.transform(with_counts(cut)).select("row", "doc_id", "paragraph", "begin", "words", once(vector_to_array("rawPrediction")).alias("raw"))
    scored = scored.select("row", "doc_id", "paragraph", "begin", "words", once(_softmax(F.col("raw"), temperature)).alias("p")).select("row", "doc_id", "paragraph", "begin", "words", F.array_max("p").alias("probability"), F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("p", F.array_max("p")).cast("int")).alias("family"))
    likely = scored.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= least_probability)).select("row", "doc_id", "paragraph", "begin", "family", "probability", once(pieces_of(F.col("words"))).alias("own"))
    held = F.transform(F.filter(template_pieces(), lambda x: x["family"] == F.col("family")), lambda x: F.struct(x["pieces"].alias("pieces"), F.array_intersect(x["pieces"], F.col("own")).alias("held")))
    best = F.array_max(F.transform(held, lambda x: F.struct((F.size(x["held"]) / F.size(x["pieces"])).alias("overlap"), F.size(x["held"]).alias("n"), x["held"].alias("held"))))
    confirmed = likely.select("row", "doc_id", "paragraph", "begin", "family", "probability", once(best).alias("best")).filter(F.col("best.overlap") >= least_overlap)
    one = confirmed.groupBy("row", "doc_id", "paragraph", "family").agg(F.max(F.struct("best.overlap", "best.n", "probability", (-F.col("begin")).alias("place"), "best.held")).alias("b"))
    found = one.groupBy("row", "doc_id", "paragraph").agg(F.collect_list(F.struct("family", "b")).alias("found"))  # at most one a family
    other = lambda x: F.exists("found", lambda y: (F.size(y["b"]["held"]) > F.size(x["b"]["held"])) & (F.size(F.array_except(x["b"]["held"], y["b"]["held"])) == 0))
    rows = found.select("doc_id", "paragraph", F.explode(F.filter("found", lambda x: ~other(x))).alias("x"))
    return rows.select("doc_id", "paragraph", "x.family", F.round("x.b.probability", 6).alias("probability"), F.round("x.b.overlap", 6).alias("overlap"), (-F.col("x.b.place")).alias("word"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
