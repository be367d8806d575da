"""License scan: MinHash bands over overlapping windows, then exact containment.

Texts and templates are taken as words (runs of letters and digits, lower
case), their shingles as runs of five words (all words of a shorter template).
A template of m words belongs to the least power of two L >= m and is looked
for in windows of 2 L words that begin every L words, so that some window holds
any passage of L words whole.

A window's signature has 64 bands or more of one MinHash row.  The least Jaccard
similarity of a window that holds ``LEAST`` of its template follows from their
numbers of shingles: about 0.15 for long templates, 1/12 for one of five words.
Each size gets as many bands as its least similar template needs to miss them
all with a chance of at most ``MISS``.  The template's shingles in the window are
then counted exactly; a match has at least ``LEAST`` of them.

Windows without any shingle of a template are passed over before signing: with
one row to a band a collision needs a shared shingle, so none is lost.

Null and empty texts match nothing; a passage that two windows hold is one
match; repeated rows give a row each.  Further columns don't matter.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gram_hashes, mix, small_enough
from .decontamination import Seeds, words

SHINGLE = 5
BANDS = 64
LEAST = 0.75
#: Greatest chance that a window misses its template.
MISS = 4e-5
TEMPLATE_BYTES = 16 << 20

#: Notices as the licences' own texts suggest them.
TEMPLATES = [
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
]


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license_id string, text string")


def band_seeds(number: int) -> np.ndarray:
    return mix(np.arange(1, number + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def bands_for(shingles: int, window: int, least: float) -> int:
    """How many bands a template of so many shingles needs in windows of so many."""
    held = max(1, math.ceil(least * shingles))
    alike = held / (shingles + max(window, held) - held)
    return BANDS if alike >= 1 else max(BANDS, math.ceil(math.log(MISS) / math.log(1 - alike)))


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least hash of the shingles for each band."""
    return mix(shingles[:, None] ^ seeds).min(axis=0)


class Templates:
    """Templates by size, with their bands."""

    def __init__(self, rows: list[tuple[str, str]], least: float = LEAST) -> None:
        self.names, self.sets = [], []
        #: (L, shingle length) -> (band, value) -> templates
        self.bands: dict[tuple[int, int], dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        places: dict[tuple[int, int], list[int]] = defaultdict(list)
        for name, text in rows:
            own = words(text)
            if not len(own):
                continue
            n = min(SHINGLE, len(own))
            shingles = np.unique(gram_hashes(own, n))
            size = 1 << (len(own) - 1).bit_length()
            places[size, n].append(len(self.names))
            self.names.append(name)
            self.sets.append(shingles)
        #: (L, shingle length) -> seed of each band
        self.band_seeds: dict[tuple[int, int], np.ndarray] = {}
        for (size, n), listed in places.items():
            number = max(bands_for(len(self.sets[k]), 2 * size - n + 1, least) for k in listed)
            self.band_seeds[size, n] = band_seeds(number)
            for k in listed:
                for band, value in enumerate(signature(self.sets[k], self.band_seeds[size, n]).tolist()):
                    self.bands[size, n][band, value].append(k)
        self.bands = {k: dict(v) for k, v in self.bands.items()}
        every = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
        self.seeds = Seeds(every, [n for _, n in self.bands])

    def matches(self, text: str, least: float) -> list[tuple[str, float, int, int]]:
        """License, containment, first and last word of every match."""
        own = words(text)
        at, _ = self.seeds.find(own)
        if not len(at):
            return []
        found: dict[tuple[int, int, int], float] = {}
        for (size, n), table in self.bands.items():
            grams = gram_hashes(own, n)
            # the two windows that begin at or before a shingle's place
            starts = np.unique(np.concatenate([at // size, np.maximum(at // size - 1, 0)])) * size
            for start in starts.tolist():
                inside = grams[start : start + max(1, 2 * size - n + 1)]
                if not len(inside):
                    continue
                signed = signature(np.unique(inside), self.band_seeds[size, n]).tolist()
                for k in {k for band, value in enumerate(signed) for k in table.get((band, value), ())}:
                    hit = np.isin(inside, self.sets[k])
                    share = len(np.unique(inside[hit])) / len(self.sets[k])
                    if share >= least:
                        place = np.flatnonzero(hit)
                        span = k, start + int(place[0]), start + int(place[-1]) + n - 1
                        found[span] = max(share, found.get(span, 0.0))
        # of overlapping matches of a template the fullest, then the first, stays
        out: list[tuple[int, float, int, int]] = []
        for (k, a, b), share in sorted(found.items(), key=lambda x: (x[0][0], -x[1], x[0][1], x[0][2])):
            if not any(k == m and a <= d and c <= b for m, _, c, d in out):
                out.append((k, share, a, b))
        return sorted((self.names[k], share, a, b) for k, share, a, b in out)


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, *, least: float = LEAST) -> DataFrame:
    """doc_id, license_id, containment, first_word and last_word of every match.

    Templates beyond ``TEMPLATE_BYTES`` are dealt into parts, with a reading of the texts for each.
    """
    spark = docs.sparkSession
    templates = default_templates(spark) if templates is None else templates
    listed = templates.where("license_id is not null and text is not null").select(F.col("license_id").cast("string").alias("license_id"), F.col("text").cast("string").alias("text")).distinct()
    parts = 1
    while not small_enough(listed.where(F.pmod(F.xxhash64("license_id", "text"), F.lit(parts)) == 0), "text", TEMPLATE_BYTES):
        parts *= 2
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text is not null")
    out = None
    for part in range(parts):
        rows = listed.where(F.pmod(F.xxhash64("license_id", "text"), F.lit(parts)) == part).orderBy("license_id", "text").collect()
        found = _scanned(texts, spark.sparkContext.broadcast(Templates([tuple(r) for r in rows], least)), least)
        out = found if out is None else out.unionByName(found)
    return out


def _scanned(texts: DataFrame, shared, least: float) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc, *x) for x in own.matches(text, least)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "license_id", "containment", "first_word", "last_word"])

    return texts.mapInArrow(run, "doc_id long, license_id string, containment double, first_word int, last_word int")
