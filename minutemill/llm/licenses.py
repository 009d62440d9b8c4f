"""License scans with built-in functions only: MinHash bands over text windows, then exact containment.

Words are runs of letters, digits and characters beyond ASCII, in lower case; shingles have three words. A
window is two neighbouring blocks of four shingles, and windows overlap by one block, so every run
of five shingles lies whole in some window. Each of 16 bands has one row: the least of (shingle
hash xor mask) in the window. A window that holds a template's five-word line, three shingles of eight, shares
a band's value with it with probability 1 - (5/8)^16 = 99.9 % or more; longer templates are cut into such runs,
of which one has to collide. Templates of one or two shingles have no such bound and are looked up by shingle. Templates found so are verified by the share of their distinct shingles that the
text has. Texts with no shingle of any template are set aside first: their windows cannot collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minutemill.llm.common import read_documents

# License notices as they are commonly written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "MIT": "Released under the MIT License",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "All rights reserved": "All rights reserved.",
    "GPL-2.0": "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "GPL-2.0 or later": "either version 2 of the License, or (at your option) any later version",
    "GPL text": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "LGPL notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "ISC grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "MIT text": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    "Apache-2.0 text": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "SPDX MIT": "SPDX-License-Identifier: MIT",
    "SPDX ISC": "SPDX-License-Identifier: ISC",
    "SPDX Unlicense": "SPDX-License-Identifier: Unlicense",
    "SPDX Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX BSD-2-Clause": "SPDX-License-Identifier: BSD-2-Clause",
    "SPDX BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX GPL-2.0": "SPDX-License-Identifier: GPL-2.0",
    "SPDX GPL-3.0": "SPDX-License-Identifier: GPL-3.0",
    "SPDX LGPL-2.1": "SPDX-License-Identifier: LGPL-2.1",
    "SPDX AGPL-3.0": "SPDX-License-Identifier: AGPL-3.0",
    "SPDX MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
    "SPDX CC0-1.0": "SPDX-License-Identifier: CC0-1.0",
}
BREAKS, SIZE, BLOCK, BANDS = r"[\x00-/:-@\[-`{-\x7F]+", 3, 4, 16
CONTAINED_PERCENT = 80


def _masks() -> list[int]:
    """One mask for each band; their first four bits differ, so that they favour different hashes."""
    return [((band << 60) ^ (0x0123456789ABCDE * (2 * band + 1) & ((1 << 60) - 1))) - ((band >> 3) << 64) for band in range(BANDS)]


def _words(text: Column) -> Column:
    # Splitting leaves empty words at the ends only.
    return F.array_remove(F.split(F.lower(text), BREAKS), "")


def _shingles(words: Column) -> Column:
    """64-bit hashes of three words each; null for texts of fewer words."""
    last = F.size(words) - SIZE
    three = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), three))


def _window_least(blocks: Column, mask: int) -> Column:
    least = F.transform(blocks, lambda block: F.array_min(F.transform(block, lambda h: h.bitwiseXOR(F.lit(mask)))))
    following = F.slice(least, 2, F.greatest(F.size(least) - 1, F.lit(0)))
    return F.zip_with(least, following, lambda a, b: F.least(a, b))


def _blocks(hashes: Column) -> Column:
    count = F.ceil(F.size(hashes) / BLOCK).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), count), lambda k: F.slice(hashes, k * BLOCK + 1, BLOCK))


def template_values(spark: SparkSession, templates: dict[str, str]) -> dict[str, tuple[list[int], list[list[int]]]]:
    """For each template its distinct shingles and, band by band, the least values of its runs."""
    rows = spark.createDataFrame(list(templates.items()), "name string, text string")
    found = {r[0]: r[1] for r in rows.select("name", _shingles(_words(F.col("text")))).collect()}
    out = {}
    for name, hashes in found.items():
        if not hashes:
            raise ValueError(f"template {name} has fewer than {SIZE} words")
        runs = [hashes[i : i + BLOCK + 1] for i in range(max(1, len(hashes) - BLOCK))]
        out[name] = sorted(set(hashes)), [sorted({min(h ^ mask for h in run) for run in runs}) for mask in _masks()]
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str], percent: int = CONTAINED_PERCENT) -> DataFrame:
    """(doc_id, license, n_shared, n_template) for each template of which a text has `percent` or more.

    A null text, an empty one and one of fewer than three words match nothing. A null doc_id stays null.
    Repeated rows give repeated rows, other columns are left behind, an empty table gives an empty one. A
    text may match several templates and then has a row for each.
    """
    values = template_values(docs.sparkSession, templates)
    names = list(values)

    def longs(numbers) -> Column:
        return F.array(*(F.lit(n).cast("long") for n in numbers))

    def table(pairs: dict[int, Column]) -> Column:
        return F.create_map(*(x for key, value in pairs.items() for x in (F.lit(key).cast("long"), value)))

    bands = [sorted({v for name in names for v in values[name][1][i]}) for i in range(BANDS)]
    owners: dict[int, list[int]] = {}
    for number, name in enumerate(names):
        for band in values[name][1]:
            for value in band:
                owners.setdefault(value, []).append(number)
    every = sorted({h for name in names for h in values[name][0]})
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words(F.col("text").cast("string")).alias("_words"))
    hashed = words.select("doc_id", _shingles(F.col("_words")).alias("_all"))
    # A text without any shingle of a template can't share a band with one, so it needs no windows.
    some = hashed.select("doc_id", F.when(F.arrays_overlap("_all", longs(every)), F.col("_all")).alias("_hashes"))
    blocks = some.select("doc_id", "_hashes", _blocks(F.col("_hashes")).alias("_blocks"))
    met = [F.array_intersect(_window_least(F.col("_blocks"), mask), longs(bands[i])) for i, mask in enumerate(_masks())]
    # One or two shingles need not be the least of any window.
    short: dict[int, list[int]] = {}
    for number, name in enumerate(names):
        for h in values[name][0] if len(values[name][0]) < SIZE else []:
            short.setdefault(h, []).append(number)
    looked_up = F.array_intersect("_hashes", longs(sorted(short))) if short else F.lit(None)
    retrieved = blocks.select("doc_id", "_hashes", F.concat(*met).alias("_met"), looked_up.alias("_short"))
    owner_table = table({value: longs(sorted(set(numbers))) for value, numbers in owners.items()})
    owned = F.flatten(F.transform("_met", lambda v: F.try_element_at(owner_table, v)))
    if short:
        short_table = table({h: longs(numbers) for h, numbers in short.items()})
        owned = F.concat(owned, F.flatten(F.transform("_short", lambda h: F.try_element_at(short_table, h))))
    candidates = F.array_distinct(owned)
    # The outer form keeps conditions on its result from being pushed below, where all would be computed twice.
    found = retrieved.select("doc_id", "_hashes", F.explode_outer(candidates).alias("_t")).filter("_t IS NOT NULL")
    own = F.try_element_at(table({i: longs(values[name][0]) for i, name in enumerate(names)}), F.col("_t"))
    label = F.try_element_at(table({i: F.lit(name) for i, name in enumerate(names)}), F.col("_t"))
    verified = found.select(
        "doc_id", label.alias("license"), F.size(F.array_intersect("_hashes", own)).cast("long").alias("n_shared"),
        F.size(own).cast("long").alias("n_template"),
    )
    return verified.filter(100 * F.col("n_shared") >= percent * F.col("n_template"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_documents(spark, sf_dir), TEMPLATES)


def _oracle() -> str:
    texts = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES.items())
    return rf"""
    WITH templates(license, text) AS (VALUES {texts}),
    texts AS (
      SELECT doc_id, NULL AS license, text FROM documents UNION ALL SELECT NULL, license, text FROM templates),
    worded AS (
      SELECT doc_id, license, list_filter(regexp_split_to_array(lower(text), '[\x00-/:-@\[-`{{-\x7F]+'), lambda x: x <> '') AS w
      FROM texts),
    shingles AS (
      SELECT DISTINCT doc_id, license, w[p] || ' ' || w[p+1] || ' ' || w[p+2] AS s
      FROM (SELECT *, unnest(range(1, len(w) - 1)) AS p FROM worded WHERE len(w) >= 3)),
    sizes AS (SELECT license, count(*) AS n_template FROM shingles WHERE license IS NOT NULL GROUP BY license),
    shared AS (
      SELECT d.doc_id, t.license, count(*) AS n_shared
      FROM shingles t JOIN shingles d USING (s) WHERE t.license IS NOT NULL AND d.license IS NULL GROUP BY 1, 2)
    SELECT doc_id, license, n_shared, n_template FROM shared JOIN sizes USING (license)
    WHERE 100 * n_shared >= {CONTAINED_PERCENT} * n_template
    """


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE = {"op5_license_scan": _oracle()}
