"""Licence scans against a plain TF-IDF cosine of every line, and inheritance by paths."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from coverlens.llm import licenses


def plain_best(text):
    vectors, idf, other = licenses._weights(licenses.TEMPLATES)
    best = None
    units = text.split("\n")
    for unit in [*units, *([text] if len(units) > 1 else [])]:
        bag = Counter(re.findall(licenses._WORD, unit.lower()))
        outside = sum(k for t, k in bag.items() if t not in idf)
        length = math.sqrt(sum((k * idf[t]) ** 2 for t, k in bag.items() if t in idf) + (outside * other) ** 2)
        for (name, _), vector in zip(licenses.TEMPLATES, vectors, strict=True):
            score = round(sum(k * idf[t] * vector[t] for t, k in bag.items() if t in vector) / length, 9) if length else 0
            if score >= licenses.THRESHOLD and (best is None or (-score, name) < best):
                best = (-score, name)
    return best and (best[1], -best[0])


def test_headers_against_every_line(spark):
    rng = random.Random(2)
    words = "the of and source code license version file software free work under a to use may notice".split()
    rows = []
    for i in range(400):
        lines = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.6:
            line = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 4)):
                line[rng.randrange(len(line))] = rng.choice([*words, "xyz"])
            lines.insert(rng.randint(0, len(lines)), "# " + " ".join(line))
        rows.append((f"d{i}/f.txt", "\n".join(lines)))
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert len(got) == len(rows)
    hits = 0
    for path, text in rows:
        best, row = plain_best(text), got[path]
        if best is None:
            assert row.license is None or row.via == "directory", (text, row)
        else:
            hits += 1
            assert row.license == best[0] and abs(row.score - best[1]) < 1e-8, (text, row, best)
    assert hits > 50


def test_nearest_directory_and_cases_of_tables(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        ("LICENSE", mit, 1, "x"),
        ("a/b/COPYING", apache, 1, "x"),
        ("a/b/c/d.py", "print()", 1, "x"),
        ("a/x.py", "print()", 1, "x"),
        ("a/x.py", "print()", 1, "x"),
        ("a/b/own.py", "x\n" * 200 + mit, 1, "x"),
        (None, None, None, None),
        ("a/bb/e.py", "", 1, "x"),
    ]
    files = spark.createDataFrame(rows, "path string, text string, unit int, license string")
    got = {r.path: (r.license, r.via, r.from_path) for r in licenses.scan(files).collect()}
    assert got == {
        "LICENSE": ("MIT", "header", "LICENSE"),
        "a/b/COPYING": ("Apache-2.0", "header", "a/b/COPYING"),
        "a/b/c/d.py": ("Apache-2.0", "directory", "a/b/COPYING"),
        "a/x.py": ("MIT", "directory", "LICENSE"),
        "a/b/own.py": ("MIT", "header", "a/b/own.py"),
        "": ("MIT", "directory", "LICENSE"),
        "a/bb/e.py": ("MIT", "directory", "LICENSE"),
    }
    assert licenses.scan(files.limit(0)).collect() == []


def test_only_units_that_may_match_are_weighed(spark, monkeypatch):
    rng = random.Random(7)
    prose = "the license of this software is a public work that you may use in other versions free of any terms".split()
    rows = []
    for i in range(300):
        lines = [" ".join(rng.choices([*prose, *(f"w{k}" for k in range(30))], k=12)) for _ in range(5)]
        if i % 50 == 0:
            lines[2] = rng.choice(licenses.TEMPLATES)[1]
        rows.append((f"d{i}/f.txt", "\n".join(lines)))
    weighed, write = [], licenses.written

    def counted(table, name):
        out = write(table, name)
        if name == "terms":
            weighed.append(out.select("row", "unit").distinct().count())
        return out

    monkeypatch.setattr(licenses, "written", counted)
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for path, text in rows:
        best = plain_best(text)
        assert got[path].via == "directory" or got[path].license == (best and best[0])
    assert 6 <= weighed[0] <= 30  # of 1,800 units, most of which have a key term


def test_no_unit_at_the_threshold_is_ruled_out(spark):
    rng = random.Random(8)
    vectors, idf, other = licenses._weights(licenses.TEMPLATES)
    rows, reached = [], []
    for _ in range(600):
        words = re.findall(licenses._WORD, rng.choice(licenses.TEMPLATES)[1].lower())
        words += [rng.choice([*idf, "xyz"]) for _ in range(rng.randint(0, 3))] + ["foo"] * rng.randint(0, 4)
        best = plain_best(" ".join(words))
        rows.append((len(rows), words))
        reached.append(best is not None)
    found = spark.createDataFrame(rows, "i int, words array<string>")
    found = found.select("i", licenses.may_reach(F.col("words"), idf, other, licenses.THRESHOLD).alias("may")).collect()
    may = {r.i: r.may for r in found}
    assert sum(reached) > 100 and all(may[i] for i, at in enumerate(reached) if at)
