"""Licence scans: sparse TF-IDF cosine of every line to templates, then the nearest ancestor directory's licence.

Terms are runs of small letters and digits. A term of the templates weighs ``ln((1 + N) / (1 + df)) + 1``, the counts being
over all files; any other term weighs 1. A line is a header when its cosine to a template is at least ``COSINE``. Only
lines that hold a marker are measured: a template's markers are its heaviest terms, taken until the rest is too light to
reach the bound, so a line without one can't be a header. Words around a notice dilute its line; a longer line that misses
the bound is measured again as overlapping windows of ``WINDOWS`` terms, about twice as long as the templates, and its
best window stands for it.

A file named like a licence, or whose header terms are at least half of its terms, speaks for its directory. A file without
a header takes the licence of the nearest directory above that has one: the distinct directories are spread over their
ancestors, joined with the speaking ones, and joined back.

Templates are a fixed list, so their weights may be broadcast; nothing else is. Everything is built from DataFrame
operations. Defined results: no text is an empty one; no path is a file in the root. Ties go to the licence whose name
comes first. Repeated rows are files of their own only if path, id or text differ; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.plans import written

COSINE = 0.6
WINDOWS = (10, 14, 20, 28, 40)  # each steps by half, so a notice of half as many terms lies whole in one
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"

# What headers and the first lines of licences say.
TEMPLATES = {
    "AGPL-3.0": ["licensed under the GNU Affero General Public License version 3"],
    "Apache-2.0": ["licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004"],
    "BSD-3-Clause": ["licensed under the BSD 3-Clause License", "redistribution and use in source and binary forms, with or without modification, are permitted"],
    "CC-BY-4.0": ["licensed under CC BY 4.0", "this work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["licensed under CC BY-NC 4.0", "this work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal public domain dedication"],
    "GPL-2.0": ["this work is licensed under the GNU General Public License, version 2"],
    "GPL-3.0": ["this work is licensed under the GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007"],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License version 3"],
    "MIT": ["released under the MIT License", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "MPL-2.0": ["subject to the terms of the Mozilla Public License, v. 2.0"],
}


def _template_terms() -> dict[tuple[str, int], dict[str, int]]:
    out: dict[tuple[str, int], dict[str, int]] = {}
    for name, texts in TEMPLATES.items():
        for i, text in enumerate(texts):
            found = re.findall("[a-z0-9]+", text.lower())
            out[name, i] = {t: found.count(t) for t in dict.fromkeys(found)}
    return out


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def weights(files: DataFrame, text: str = "text") -> dict[str, float]:
    """What every term of the templates weighs, counted over all files."""
    known = sorted({t for counts in _template_terms().values() for t in counts})
    there = F.array_intersect(terms(F.col(text)), F.array(*[F.lit(t) for t in known]))
    counted = files.select(there.alias("t")).groupBy().agg(F.count(F.lit(1)).alias("n")).first()["n"]
    rows = files.select(F.explode(there).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()
    found = {r["t"]: r["n"] for r in rows}  # one row for each term of the templates at most
    return {t: math.log((1 + counted) / (1 + found.get(t, 0))) + 1 for t in known}


def markers(weight: dict[str, float], bound: float = COSINE) -> set[str]:
    """Terms of which every line whose cosine reaches the bound has one."""
    out: set[str] = set()
    for counts in _template_terms().values():
        squares = {t: (n * weight[t]) ** 2 for t, n in counts.items()}
        whole = rest = sum(squares.values())
        for t in sorted(squares, key=lambda t: (-squares[t], t)):
            if rest < bound**2 * whole * 0.999:
                break
            out.add(t)
            rest -= squares[t]
    return out


def headers(files: DataFrame) -> DataFrame:
    """``path, doc_id, text_hash, license, score, share`` of files ``path, doc_id, text`` that have a header.

    ``share`` is the part of the file's terms that stand in header lines, or in the windows that stand for them.
    """
    spark = files.sparkSession
    weight = weights(files)
    marked = "|".join(sorted(markers(weight)))
    rows, light = [], []
    for (name, i), counts in _template_terms().items():
        norm = math.sqrt(sum((n * weight[t]) ** 2 for t, n in counts.items()))
        rows += [(t, name, i, weight[t] * n * weight[t] / norm) for t, n in counts.items()]
    light = [(t, w) for t, w in weight.items()]
    table = F.broadcast(spark.createDataFrame(rows, "term string, license string, template int, product double"))
    known = F.broadcast(spark.createDataFrame(light, "term string, weight double"))
    keys = ["path", "doc_id", "text_hash"]
    hashed = files.select("path", "doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    some = hashed.where(F.col("text").rlike(f"(?i)(?<![a-z0-9])({marked})(?![a-z0-9])"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"(?i)(?<![a-z0-9])({marked})(?![a-z0-9])"))
    cut = some.select(*keys, F.size(terms(F.col("text"))).alias("all_terms"), F.posexplode(lines).alias("line", "said")).dropDuplicates([*keys, "line"])
    # The first piece of a line is the whole of it, the others are its windows that hold a marker.
    said = cut.select(*keys, "line", "all_terms", terms(F.col("said")).alias("said"))
    some_marker = F.array(*[F.lit(t) for t in sorted(markers(weight))])
    none = F.array().cast("array<array<string>>")

    def windows(width: int) -> Column:
        starts = F.sequence(F.lit(0), F.size("said") - 1, F.lit(width // 2))
        return F.when(F.size("said") > width, F.transform(starts, lambda at: F.slice("said", at + 1, width))).otherwise(none)

    near = F.filter(F.concat(*[windows(w) for w in WINDOWS]), lambda x: F.arrays_overlap(x, some_marker))
    pieces = said.select(*keys, "line", "all_terms", F.posexplode(F.concat(F.array("said"), near)).alias("piece", "said"))
    counted = pieces.select(*keys, "line", "piece", "all_terms", F.size("said").alias("line_terms"), F.explode("said").alias("term"))
    tf = counted.groupBy(*keys, "line", "piece", "all_terms", "line_terms", "term").agg(F.count(F.lit(1)).alias("n"))
    weighed = tf.join(known, "term", "left").withColumn("w", F.col("n") * F.coalesce("weight", F.lit(1.0)))
    norms = weighed.groupBy(*keys, "line", "piece", "all_terms", "line_terms").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(table, "term").groupBy(*keys, "line", "piece", "license", "template").agg(F.sum(F.col("n") * F.col("product")).alias("dot"))
    same = (F.col("line") == F.col("_line")) & (F.col("piece") == F.col("_piece"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    measured = dots.join(norms.withColumnsRenamed({k: f"_{k}" for k in [*keys, "line", "piece"]}), same)
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    best = measured.groupBy(*keys, "line", "piece", "all_terms", "line_terms").agg(F.min(F.struct((-cosine).alias("s"), "license")).alias("b"))
    found = best.where(F.col("b.s") <= -COSINE).groupBy(*keys, "line", "all_terms").agg(
        F.min(F.struct((F.col("piece") > 0).alias("cut"), "b", "line_terms")).alias("l")
    )
    return found.groupBy(*keys, "all_terms").agg(F.min("l.b").alias("b"), F.sum("l.line_terms").alias("said")).select(
        *keys, F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), (F.col("said") / F.col("all_terms")).alias("share")
    )


def directory(path: Column) -> Column:
    """The path without its last part; the root is the empty string."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), "^(.*)/[^/]*$", 1)


def scan(files: DataFrame, path: str = "path", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, path, license, score, how, from_directory`` of every file; ``how`` is header, inherited or none."""
    own = files.select(F.col(path).alias("path"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = written(headers(own), "headers")
    name = F.regexp_extract(F.coalesce("path", F.lit("")), "([^/]*)$", 1)
    speaks = found.where(name.rlike(LICENCE_FILE) | (F.col("share") >= 0.5))
    licensed = speaks.groupBy(directory(F.col("path")).alias("from_directory")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    licensed = written(licensed.select("from_directory", F.col("b.license").alias("inherited"), (-F.col("b.s")).alias("inherited_score")), "directories")

    named = own.select("path", "doc_id", F.xxhash64("text").alias("text_hash"), directory(F.col("path")).alias("dir"))
    same = F.lit(True)
    for k in ("path", "doc_id", "text_hash"):
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = named.join(found.drop("share").withColumnsRenamed({k: f"_{k}" for k in ("path", "doc_id", "text_hash")}), same, "left")

    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("up")))
    spread = named.select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.up")
    nearest = spread.join(licensed, spread.up == licensed.from_directory).groupBy("dir").agg(
        F.max(F.struct("depth", "from_directory", "inherited", "inherited_score")).alias("n")
    )
    told = joined.join(nearest.select("dir", "n.*"), "dir", "left")
    inherits = F.col("license").isNull() & F.col("inherited").isNotNull()
    return told.select(
        "doc_id",
        "path",
        F.coalesce("license", "inherited").alias("license"),
        F.coalesce("score", "inherited_score").alias("score"),
        F.when(F.col("license").isNotNull(), "header").when(inherits, "inherited").otherwise("none").alias("how"),
        F.when(inherits, F.col("from_directory")).alias("from_directory"),
    )
