"""License scans by MinHash bands over overlapping windows, with DataFrame expressions only.

Templates are grouped into length classes. A class reads windows that are as long as its longest
template plus the step, so each occurrence lies whole in some window and its Jaccard similarity
with that window has a known lower bound (at least 0.65). Four hash functions, each with its minimum and its
maximum, give eight one-row bands: an occurrence is missed with probability at most 0.35 ** 8.
A window retrieves the templates that share a band, and exact containment of the template's word
shingles in the window decides. Segments without any shingle of any template cannot pass
that check, so no windows are cut there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import small, written
from fathomline.llm.leaks import segments, words, words_sql

SHINGLE = 3
SEEDS = (11, 23, 37, 53)
CONTAINED = 0.9
SEGMENT = 4096
CLASS_GROWTH = 1.25

# Notices as licence stewards publish them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, license, words): templates with at least one shingle, numbered."""
    rows = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(n).alias("license"), F.lit(t).alias("text")) for i, (n, t) in enumerate(templates)))
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.template", "t.license", words(F.col("t.text")).alias("words")).where(f"size(words) >= {SHINGLE}")


def length_classes(sizes: list[int]) -> list[tuple[int, int, int]]:
    """(shortest, longest, step) of classes that hold all sizes; the step is a tenth, one at least."""
    out: list[tuple[int, int, int]] = []
    for n in sorted(set(sizes)):
        if out and n <= max(out[-1][0] + 1, int(out[-1][0] * CLASS_GROWTH)):
            out[-1] = (out[-1][0], n, out[-1][2])
        else:
            out.append((n, n, max(1, n // 10)))
    return out


def _shingles(column: str) -> str:
    """SQL: hashes of the word shingles of an array of at least SHINGLE words."""
    reads = ", ".join(f"{column}[i + {k}]" for k in range(SHINGLE))
    return f"transform(sequence(0, size({column}) - {SHINGLE}), i -> xxhash64({reads}))"


def _bands(column: str, key: str) -> str:
    """SQL: the band keys of an array of shingle hashes."""
    each = (f"xxhash64({key}, {seed}, '{what}', array_{what}(transform({column}, h -> xxhash64(h, {seed}))))" for seed in SEEDS for what in ("min", "max"))
    return f"array({', '.join(each)})"


def scan(docs: DataFrame, templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, license, containment, first_word, n_windows): licences found in each document.

    ``containment`` is the best share of a template's distinct shingles in a window. Null and
    empty texts have none; null ids are kept as such; repeated rows of one id count together.
    Templates of fewer than three words cannot be searched for. Empty tables give no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    known = []
    if templates:
        table = template_table(spark, templates)
        known = table.select("template", "license", "words", F.expr(_shingles("words")).alias("h")).collect()  # a parameter's size
    if not known:
        nothing = docs.select(F.col("doc_id").cast("long")).limit(0)
        return nothing.selectExpr("doc_id", "'' AS license", "0.0D AS containment", "0L AS first_word", "0L AS n_windows")
    classes = length_classes([len(r.words) for r in known])
    reach = max(c[1] + c[2] for c in classes)
    wanted = f"exists(h, x -> x IN ({', '.join(f'{h}L' for h in sorted({h for r in known for h in r.h}))}))"
    parts = docs.select(
        F.col("doc_id").cast("long"), F.explode(segments(words_sql(), SEGMENT, reach)).alias("p")
    ).where(f"size(p.words) >= {SHINGLE}")
    hashed = parts.select("doc_id", F.col("p.s").cast("long").alias("s"), F.col("p.words").alias("words"), F.expr(_shingles("p.words")).alias("h"))
    # what follows works on segments with a shingle of some template
    live = written(hashed.where(wanted), "segments")
    windows = None
    for k, (_, longest, step) in enumerate(classes):
        width = longest + step - 1
        cut = live.select("doc_id", "s", F.explode(F.expr(
            f"transform(sequence(0, greatest(0, size(words) - {width} + {step} - 1), {step}), p -> "
            f"struct(p AS p, slice(words, p + 1, {width}) AS words, slice(h, p + 1, {width - SHINGLE + 1}) AS h))"
        )).alias("w")).select("doc_id", (F.col("s") + F.col("w.p")).alias("at"), F.col("w.words").alias("words"), F.col("w.h").alias("h")).where("size(h) > 0")
        cut = cut.where(wanted)
        keyed = cut.select("doc_id", "at", "words", F.explode(F.array_distinct(F.expr(_bands("h", str(k))))).alias("band"))
        windows = keyed if windows is None else windows.unionByName(keyed)
    kinds = F.create_map(*(x for r in known for x in (F.lit(r.template), F.lit(next(k for k, c in enumerate(classes) if c[0] <= len(r.words) <= c[1])))))
    of_templates = (
        table.withColumn("kind", kinds[F.col("template")])
        .select("template", "license", F.col("words").alias("t_words"), F.col("kind"), F.expr(_shingles("words")).alias("h"))
        .select("template", "license", "t_words", F.explode(F.array_distinct(F.expr(_bands("h", "kind")))).alias("band"))
    )
    text = lambda c: f"transform(sequence(0, size({c}) - {SHINGLE}), i -> concat_ws(' ', slice({c}, i + 1, {SHINGLE})))"
    met = windows.join(small(of_templates), "band").select(
        "doc_id", "at", "license", "template", F.expr(
            f"CAST(size(array_intersect({text('t_words')}, {text('words')})) AS DOUBLE) / size(array_distinct({text('t_words')}))"
        ).alias("containment"),
    )
    return (
        met.where(F.col("containment") >= contained).select("doc_id", "license", "at", "containment").distinct()
        .groupBy("doc_id", "license")
        .agg(F.max("containment").alias("containment"), F.min("at").alias("first_word"), F.count("*").alias("n_windows"))
    )


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "license", F.round("containment", 6).alias("containment"))


def _oracle() -> str:
    """The same licences by joining shingles and sliding each class's longest template over the hits."""
    from fathomline.llm.leaks import _sql_words

    texts = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
    sizes = [sum(1 for _ in re.finditer(r"[^\W_]+", t)) for _, t in TEMPLATES]
    classes = length_classes([n for n in sizes if n >= SHINGLE])
    widths = ", ".join(f"({i}, {next(c[1] for c in classes if c[0] <= n <= c[1])})" for i, n in enumerate(sizes) if n >= SHINGLE)
    shingles = lambda source, key: f"SELECT {key}, pos, concat_ws(' ', w[pos + 1], w[pos + 2], w[pos + 3]) AS s FROM (SELECT *, unnest(range(0, len(w) - 2)) AS pos FROM {source} WHERE len(w) >= {SHINGLE})"
    return f"""
WITH t AS (SELECT template, license, {_sql_words('text')} AS w, width FROM (VALUES {texts}) v(template, license, text) JOIN (VALUES {widths}) c(template, width) USING (template)),
ts AS (SELECT DISTINCT template, s FROM ({shingles('t', 'template')})), n AS (SELECT template, count(*) AS n FROM ts GROUP BY ALL),
d AS (SELECT doc_id, {_sql_words('text')} AS w FROM documents),
hits AS (SELECT doc_id, pos, template, s FROM ({shingles('d', 'doc_id')}) JOIN ts USING (s)),
windows AS (SELECT doc_id, template, s, unnest(range(greatest(0, pos - width + {SHINGLE}), pos + 1)) AS p FROM hits JOIN t USING (template)),
found AS (SELECT doc_id, template, count(DISTINCT s) / any_value(n) AS containment FROM windows JOIN n USING (template) GROUP BY doc_id, template, p)
SELECT doc_id, license, round(max(containment), 6) AS containment FROM found JOIN t USING (template) WHERE containment >= {CONTAINED} GROUP BY ALL
"""


OP4_SQL = _oracle()
