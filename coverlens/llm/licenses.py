"""Licence scans: sparse TF-IDF cosines of header lines and licence files to templates, inherited by
the nearest directory above. Built-in functions only.

A unit (a line, or a whole text) is compared with a template in the space of the templates' terms and
one more dimension that counts all other words. Most units share nothing with any template, and most
of the others share too little: for each template a few of its heaviest terms are such that without
one of them the cosine stays below the threshold, and so it does with too many other words, whatever
the template. Only units that pass both tests, which each task makes by itself, are weighed at all.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coverlens.llm.common import written

THRESHOLD = 0.8
#: A text is a licence file if the unit that matches is so much of its length.
FILE_SHARE = 0.5
_WORD = r"[a-z0-9]+(?:[.][0-9]+)*"

#: Words that most English texts have.
COMMON = frozenset(
    "a an and any are as at be by can for found free from general in is it not of on or public that the this to "
    "under use version with without work you".split()
)

#: The usual notices of common licences, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License.",
    ),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def _weights(templates: tuple[tuple[str, str], ...]) -> tuple[list[dict[str, float]], dict[str, float], float]:
    """Unit vectors of the templates, idf by term, and the idf of words in no template."""
    bags = [Counter(re.findall(_WORD, text.lower())) for _, text in templates]
    n = len(bags)
    spread = Counter(term for bag in bags for term in bag)
    idf = {term: math.log((1 + n) / (1 + spread[term])) + 1 for term in spread}
    other = math.log(1 + n) + 1
    vectors = []
    for bag in bags:
        raw = {term: k * idf[term] for term, k in bag.items()}
        length = math.sqrt(sum(w * w for w in raw.values()))
        vectors.append({term: w / length for term, w in raw.items()})
    return vectors, idf, other


def key_terms(vectors: list[dict[str, float]], threshold: float) -> set[str]:
    """Terms of which a unit has at least one if its cosine with any template reaches the threshold.

    A cosine over a template's other terms is at most the length of the vector's part on them, so
    any terms that carry enough of it will do; common words come last, as they pass most lines.
    """
    keys = set()
    for vector in vectors:
        rest = 1.0
        for term, weight in sorted(vector.items(), key=lambda item: (item[0] in COMMON, -item[1], item[0])):
            if rest < threshold**2 - 1e-9:
                break
            keys.add(term)
            rest -= weight * weight
    return keys


def may_reach(words: Column, idf: dict[str, float], other: float, threshold: float) -> Column:
    """Whether the cosine of a unit of these words with any template can reach the threshold.

    It is at most the length of the unit's part on known terms by its whole length, and that part is no
    longer than the sum of its terms' weights.
    """
    if threshold <= 0:
        return F.lit(True)
    # a little more than needed, as scores are rounded
    gain = math.sqrt(max(0.0, 1 / threshold**2 - 1)) * (1 + 1e-6) + 1e-6
    levels: dict[float, list[str]] = {}
    for term in sorted(idf):
        levels.setdefault(idf[term], []).append(term)

    def weight(word: Column) -> Column:
        found = F.when(~word.isin(sorted(idf)), F.lit(-other))
        for level, terms in levels.items():
            found = found.when(word.isin(terms), F.lit(level * gain))
        return found

    # no word but those of `idf` and others, so that `weight` is never null
    return F.aggregate(words, F.lit(0.0), lambda total, word: total + weight(word)) >= F.lit(-1e-6)


def _template_table(spark: SparkSession, vectors, idf, templates) -> DataFrame:
    rows = [
        (term, float(idf[term]), number, templates[number][0], float(weight))
        for number, vector in enumerate(vectors)
        for term, weight in vector.items()
    ]
    return spark.createDataFrame(rows, "term string, idf double, template int, license string, weight double")


def _cosines(units: DataFrame, templates, threshold: float) -> DataFrame:
    """Units (row, unit, share, body) -> (row, unit, share, license, score), scores of `threshold` or more."""
    vectors, idf, other = _weights(templates)
    spark = units.sparkSession
    keys = "|".join(re.escape(k) for k in sorted(key_terms(vectors, threshold)))
    near = units.where(F.lower("body").rlike(rf"(?<![a-z0-9])(?:{keys})(?![a-z0-9])"))
    words = F.regexp_extract_all(F.lower("body"), F.lit(f"({_WORD})"), F.lit(1))
    near = near.where(may_reach(words, idf, other, threshold))
    near = near.select("row", "unit", "share", F.explode(words).alias("term"))
    counted = written(near.groupBy("row", "unit", "share", "term").agg(F.count(F.lit(1)).alias("k")), "terms")
    # A row for each term of the templates.
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    idf_of = F.coalesce("idf", F.lit(0.0))
    outside = F.sum(F.when(F.col("idf").isNull(), F.col("k")).otherwise(0))
    lengths = counted.join(known, "term", "left").groupBy("row", "unit", "share").agg(
        F.sqrt(F.sum(F.pow(F.col("k") * idf_of, 2)) + F.pow(outside * F.lit(other), 2)).alias("length")
    )
    # A row for each term of each template.
    table = F.broadcast(_template_table(spark, vectors, idf, templates))
    dots = counted.join(table, "term").groupBy("row", "unit", "template", "license")
    dots = dots.agg(F.sum(F.col("k") * F.col("idf") * F.col("weight")).alias("dot"))
    found = dots.join(lengths, ["row", "unit"])
    found = found.withColumn("score", F.round(F.col("dot") / F.col("length"), 9))
    return found.where(F.col("score") >= threshold).select("row", "unit", "share", "license", "score")


def parents(path: Column) -> Column:
    """The directories above a path, from the root ('') downward."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def scan(
    files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """(path, row_hash, license, score, via, from_path): one row per distinct (path, text).

    files: (path, text). A file has the licence of its best line ('header') or whole text ('file'), if
    that cosine reaches the threshold; ties go to the first licence by name. A text at least half of
    which, by length, is what matched is a licence file: files below its directory that have no
    licence of their own inherit that of the nearest such directory above them ('directory', with the
    licence file's path; of several files, that of the best score, then the first path). Otherwise
    license, score, via and from_path are null. Null texts are empty; a null path counts as '' and
    inherits only from the root; paths are parted by '/'. Other columns are ignored; no files give no
    rows.
    """
    path = F.coalesce(F.col("path"), F.lit("")).alias("path")
    rows = files.select(path, F.coalesce("text", F.lit("")).alias("body")).withColumn("row_hash", F.xxhash64("body"))
    # Unit 0 is the whole text, unless that is a line itself.
    parts = F.concat(F.array("body"), F.split("body", "\n"))
    units = rows.select(
        F.struct("path", "row_hash").alias("row"),
        F.length("body").alias("n"),
        F.instr("body", "\n").alias("lines"),
        F.posexplode(parts).alias("unit", "body"),
    ).where("unit > 0 or lines > 0")
    units = units.select("row", "unit", (F.length("body") / F.greatest("n", F.lit(1))).alias("share"), "body")
    found = _cosines(units, templates, threshold)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "license", F.desc("share"), "unit")
    found = found.withColumn("n", F.row_number().over(order)).where("n = 1")
    via = F.when(F.col("unit") == 0, "file").otherwise("header").alias("via")
    found = written(found.select("row.path", "row.row_hash", "license", "score", via, "share"), "licenses")

    folders = F.split("path", "/")
    directory = F.array_join(F.slice(folders, 1, F.size(folders) - 1), "/")
    order = Window.partitionBy("dir").orderBy(F.desc("score"), "path", "row_hash")
    licensed = found.where(F.col("share") >= FILE_SHARE).withColumn("dir", directory)
    licensed = licensed.withColumn("n", F.row_number().over(order)).where("n = 1")
    licensed = licensed.select("dir", "license", "score", F.col("path").alias("from_path"))

    every = rows.select("path", "row_hash").distinct()
    own = every.join(found.drop("share"), ["path", "row_hash"], "left")
    above = own.where("license is null").select("path").distinct()
    above = above.select("path", F.posexplode(parents(F.col("path"))).alias("depth", "dir"))
    # One licence meets all files below its directory; adaptive execution splits a crowded one.
    up = F.max_by(F.struct("license", "score", "from_path"), "depth").alias("up")
    nearest = above.join(licensed, "dir").groupBy("path").agg(up)
    joined = own.join(nearest, "path", "left")
    inherits = F.col("license").isNull() & F.col("up").isNotNull()
    pick = lambda name: F.when(inherits, F.col(f"up.{name}")).otherwise(F.col(name)).alias(name)
    own_path = F.when(F.col("license").isNotNull(), F.col("path"))
    return joined.select(
        "path",
        "row_hash",
        pick("license"),
        pick("score"),
        F.when(inherits, "directory").otherwise(F.col("via")).alias("via"),
        F.when(inherits, F.col("up.from_path")).otherwise(own_path).alias("from_path"),
    )
