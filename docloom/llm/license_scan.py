"""License scans: MinHash bands over overlapping text windows, then containment.

Templates are license notices. For a template of L words the texts are read in
windows of L + L // 4 words, one beginning every L // 4 words, so any place of
the template lies whole in some window. A window that holds three quarters of
the template's shingles has a similarity to it of one half at least; one of
BANDS MinHash values then agrees but for once in a million. Such windows are
candidates, and count if they really hold that share of the shingles.

Templates are a fixed list or a table whose size is checked: their hashes go
to every task.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ALNUM_TABLE, buffers, chunks, gram_hashes, mix, word_hashes

SHINGLE = 5
CONTAINMENT = 75  # per cent
BANDS = 20
TEMPLATE_WORDS = 1 << 20  # most words of all templates

# License notices by SPDX identifier.
TEMPLATES = {
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0-or-later-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}

_SEEDS = mix(np.arange(901, 901 + BANDS, dtype=np.uint64))
_FACTORS = mix(_SEEDS) | np.uint64(1)


def shingles(words: np.ndarray) -> np.ndarray:
    return gram_hashes(words, min(SHINGLE, len(words))) if len(words) else words


class Template:
    """A template's distinct shingles, its length in words and its bands."""

    def __init__(self, name: str, text: str):
        _, _, words, _ = word_hashes(*buffers(pa.array([text])), ALNUM_TABLE)
        self.name, self.length = name, len(words)
        self.set = np.unique(shingles(words))
        self.size = min(SHINGLE, self.length)
        self.step = max(1, self.length // 4)
        self.blocks = -(-(self.length - self.size + 1 + self.step) // self.step)
        self.bands = ((self.set[:, None] ^ _SEEDS) * _FACTORS).min(axis=0) if self.length else None


def _windows(first: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, rows)`` of blocks of ``step`` shingles, counted from the start of each row."""
    grams = np.maximum(np.diff(first) - size + 1, 0)
    blocks = -(-grams // step)
    rows = np.repeat(np.arange(len(grams)), blocks)
    return first[:-1][rows] + (np.arange(len(rows)) - (np.cumsum(blocks) - blocks)[rows]) * step, rows


def _scan(batches, templates):
    layouts: dict[tuple[int, int, int], list[Template]] = {}
    for t in templates:
        if t.length:
            layouts.setdefault((t.size, t.step, t.blocks), []).append(t)
    for batch, data, offsets in chunks(batches, "text", 1 << 20):
        _, _, words, first = word_hashes(data, offsets, ALNUM_TABLE)
        hits = [[], [], [], []]
        for size in sorted({size for size, _, _ in layouts}):
            grams = gram_hashes(words, size)
            if not len(grams):
                continue
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            grams_end = np.maximum(first[1:] - size + 1, first[:-1])  # shingles must not cross rows
            crossing = np.arange(len(grams)) >= grams_end[row[: len(grams)]]
            places = {(step, blocks): _windows(first, size, step) for s, step, blocks in layouts if s == size}
            candidates = {key: set() for key in layouts if key[0] == size}
            for k in range(BANDS):
                values = (grams ^ _SEEDS[k]) * _FACTORS[k]
                values[crossing] = np.iinfo(np.uint64).max
                for key in candidates:
                    starts = places[key[1:]][0]
                    if not len(starts):
                        continue
                    blocks = np.minimum.reduceat(values, starts)
                    least = blocks.copy()
                    for more in range(1, min(key[2], len(blocks))):  # reaches into the next row at a row's end; verified later
                        np.minimum(least[:-more], blocks[more:], out=least[:-more])
                    for nth, t in enumerate(layouts[key]):
                        candidates[key].update((nth, int(w)) for w in np.flatnonzero(least == t.bands[k]))
            for key, found in candidates.items():
                starts, rows = places[key[1:]]
                for nth, w in sorted(found):
                    t, r = layouts[key][nth], int(rows[w])
                    own = np.arange(starts[w], min(starts[w] + t.blocks * t.step, grams_end[r]))
                    own = own[np.isin(grams[own], t.set)]
                    held = len(np.unique(grams[own]))
                    if 100 * held >= CONTAINMENT * len(t.set):
                        for x, y in zip(hits, (r, t.name, held / len(t.set), int(own[0] - first[r]))):
                            x.append(y)
        ids = batch.column("id").take(pa.array(hits[0], pa.int64()))
        # rows with one id stay apart: a row is named by its id and a hash of its words
        keys = np.array([int(words[first[r] : first[r + 1]].sum(dtype=np.uint64)) for r in hits[0]], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(keys.view(np.int64)), pa.array(hits[1], pa.string()), pa.array(hits[2], pa.float64()), pa.array(hits[3], pa.int64())], ["id", "text_key", "license", "containment", "word"]
        )


def scan_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, license, containment, n_places, first_word)``: a row for each row
    of ``docs`` and template found in it.

    containment: the largest share of the template's distinct five-word
    shingles in a window; n_places: different words at which matches begin;
    first_word counts from 0. Templates of fewer than five words are one
    shingle, those without words match nothing; ``templates`` may be a table
    (name, text) of at most TEMPLATE_WORDS words, else it is refused. Windows
    are counted from the start of each text.
    Null and empty texts match nothing. Rows with one id and one text are one
    row. Other columns are ignored.
    """
    if isinstance(templates, DataFrame):
        total = templates.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
        if total > TEMPLATE_WORDS:
            raise ValueError(f"templates of {total} words; scan them in parts of at most {TEMPLATE_WORDS}")
        templates = {row["name"]: row["text"] or "" for row in templates.select("name", "text").collect()}
    known = [Template(name, text) for name, text in (TEMPLATES if templates is None else templates).items()]
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = docs.mapInArrow(partial(_scan, templates=known), "id long, text_key long, license string, containment double, word long")
    out = found.groupBy("id", "text_key", "license").agg(F.max("containment").alias("containment"), F.countDistinct("word").alias("n_places"), F.min("word").alias("first_word"))
    return out.drop("text_key").withColumnRenamed("id", id_col)
