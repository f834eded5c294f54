"""License scans by MinHash bands over overlapping text windows.

Texts become lower-case words and five-word shingles, each hashed to 64 bits.
Windows of 4 and of 8 consecutive shingles overlap by half; each window has
``BANDS`` min-hashes (one row a band), and single shingles are windows of their
own.  Templates have the same windows at every offset.  A document window that
equals a template window collides in every band, one of Jaccard similarity s in
some band with probability 1 - (1 - s) ** BANDS (0.992 at 0.8), and a passage has
several windows.  Shared band values retrieve templates; a template matches
if at least ``CONTAINMENT`` of its shingles, compared as text, stand in the
document.

Everything is built from array functions within a row: no text is shuffled and
no Python runs.  The templates' band values reach the scan as one array; their
number is bounded by the template list, a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.llm.common import RID, ROW, let, stored_rows
from marketflow.session import materialize

SHINGLE = 5
SIZES = (4, 8)
BANDS = 3
CONTAINMENT = 0.8
MAX_TEMPLATES = 1_000

# Fixed texts: notices as their licenses ask for them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either "
                "version 2 of the License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "template int, license string, text string")


def plain_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: Column) -> Column:
    return F.transform(F.slice(words, SHINGLE, F.greatest(F.size(words) - SHINGLE + 1, F.lit(0))),
                       lambda w, i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE - 1)], w))


def shingle_texts(words: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(words, SHINGLE, F.greatest(F.size(words) - SHINGLE + 1, F.lit(0))),
                                        lambda w, i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(SHINGLE - 1)], w)))


def _mask(size: int, band: int) -> int:
    """A fixed odd constant per window size and band; xor with it reorders the hashes."""
    x = (0x9E3779B97F4A7C15 * (16 * size + band + 1)) & ((1 << 64) - 1)
    return x - (1 << 64) if x >> 63 else x


def band_values(hashes: Column, half_overlap: bool, sizes=SIZES, bands: int = BANDS) -> Column:
    """Band values of all windows: single shingles, then each size at half overlap or every offset."""
    def lows(size: int, band: int) -> Column:
        step = size // 2 if half_overlap else 1
        starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - size + 1, F.lit(1)), F.lit(step))
        mixed = F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(_mask(size, band))))
        return let(mixed, lambda x: F.transform(starts, lambda i: F.array_min(F.slice(x, i, F.lit(size)))))

    return F.concat(hashes, *[lows(size, band) for size in sizes for band in range(bands)])


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, carry: list[str] | None = None,
                  containment: float = CONTAINMENT) -> DataFrame:
    """Every row with ``__row`` (``carry`` columns, all by default) and
    ``licenses``: sorted array of (license, containment), best per license.

    ``templates`` has columns template, license, text; those of fewer than five
    words have no shingle and match nothing.  Null, empty and short texts have
    no license; repeated rows get the same result.
    """
    spark = docs.sparkSession
    templates = template_table(spark) if templates is None else templates
    known = materialize(templates.select("template", "license", plain_words(F.col("text")).alias("w")).select(
        "template", "license", shingle_texts(F.col("w")).alias("shingles"), shingle_hashes(F.col("w")).alias("h"))
        .filter("size(shingles) > 0").select("template", "license", "shingles", F.array_distinct(
            band_values(F.col("h"), half_overlap=False)).alias("bands")), "license-templates")
    if known.count() > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    values = known.agg(F.array_distinct(F.flatten(F.collect_list("bands")))).scalar()

    kept = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)])
    scanned = docs.select(kept.alias(ROW), plain_words(F.col("text")).alias("w")).select(
        ROW, "w", let(shingle_hashes(F.col("w")), lambda h: band_values(h, half_overlap=True)).alias("bands"))
    scanned = scanned.select(ROW, "w", F.array_intersect("bands", values).alias("shared"))
    rows = stored_rows(scanned.select(ROW, "shared", F.when(F.size("shared") > 0, F.col("w")).alias("w")), "license-rows")

    asked = rows.filter("size(shared) > 0").select(RID, F.explode("shared").alias("band"), "w")
    by_band = known.select("template", F.explode("bands").alias("band"))
    found = asked.select(RID, "band").join(F.broadcast(by_band), "band").select(RID, "template").distinct()
    texts = rows.filter("size(shared) > 0").select(RID, shingle_texts(F.col("w")).alias("own"))
    share = F.size(F.array_intersect("shingles", "own")) / F.size("shingles")
    matched = (found.join(texts, RID).join(F.broadcast(known.select("template", "license", "shingles")), "template")
               .select(RID, "license", share.alias("containment")).filter(F.col("containment") >= containment)
               .groupBy(RID, "license").agg(F.max("containment").alias("containment"))
               .groupBy(RID).agg(F.sort_array(F.collect_list(F.struct("license", "containment"))).alias("licenses")))
    return rows.select(ROW, RID).join(matched, RID, "left").withColumn(
        "licenses", F.coalesce("licenses", F.array().cast("array<struct<license:string,containment:double>>")))
