"""Licence notices by a trained paragraph classifier, confirmed against templates.

Windows of words are read over every line, over the whole text (notices may be wrapped) and wherever a template's word pairs
gather; a notice counts to the line it begins in. One logistic classifier per licence
family works on hashed word n-grams. It is trained on varied copies of the notice templates and, as the unknown class, on
windows and lines of texts that nowhere resemble a template: halves of wrapped notices would teach it the wrong thing. A prediction needs a probability above the level at which held-out
unknown paragraphs stay unknown, and a template of the family whose word pairs are mostly found in the paragraph.

Confirmation needs word pairs of a template, so paragraphs without any cannot be confirmed; they are passed over before
they are scored, which leaves the scan of clean text vectorised.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custoria.llm.common import prepare, text_column
from custoria.llm.decontamination import seeds_at, words_of
from custoria.llm.language_id import fit_logistic

# Families and the wording of their notices.
TEMPLATES = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3",
        "Released under the AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "This software is distributed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Available under the Creative Commons Attribution License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ],
    "CC0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the GPL version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Released under the GPL version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Released under the LGPL version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ],
}
UNKNOWN = "unknown"

CELLS = 1 << 12
#: Words of a window of a long paragraph, and from one window to the next.
WINDOW, STRIDE = 48, 24
#: Share of a template's word pairs that confirm a prediction, and share of held-out unknown paragraphs that may pass.
CONFIRM, FALSE_RATE = 0.75, 0.001
#: A text with a window or line that has this share of a template's word pairs is no example of the unknown class.
RESEMBLES = 0.4
#: Documents whose paragraphs are the unknown class in training, about.
TRAIN_DOCUMENTS = 400
#: Training paragraphs at most, and varied copies per template.
MOST_PARAGRAPHS, VARIANTS = 3000, 30


def pairs_of(words: np.ndarray) -> np.ndarray:
    return np.unique(seeds_at(words, 2))


def features(words: np.ndarray) -> np.ndarray:
    """Square roots of hashed counts of words, pairs and triples, scaled to length one."""
    cells = np.zeros(CELLS, "f4")
    for n in (1, 2, 3):
        if len(words) >= n:
            np.add.at(cells, (seeds_at(words, n) % np.uint64(CELLS)).astype("i8"), 1)
    cells = np.sqrt(cells)
    return cells / max(1.0, float(np.linalg.norm(cells)))


@dataclass
class Families:
    names: list[str]
    weights: np.ndarray
    level: float

    def probability(self, words: np.ndarray) -> np.ndarray:
        margin = features(words) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


class Templates:
    def __init__(self):
        self.family = [name for name, own in TEMPLATES.items() for _ in own]
        self.words = list(words_of([t.encode() for own in TEMPLATES.values() for t in own]))
        self.pairs = [pairs_of(w) for w in self.words]
        self.known = np.unique(np.concatenate(self.pairs))
        self.has = np.stack([np.isin(self.known, p) for p in self.pairs])
        self.size = self.has.sum(1)
        self.near = np.zeros(1 << 20, bool)
        self.near[self.known % np.uint64(1 << 20)] = True

    def hits(self, words: np.ndarray) -> np.ndarray:
        """Places of word pairs that some template has."""
        pairs = seeds_at(words, 2)
        at = np.flatnonzero(self.near[pairs % np.uint64(1 << 20)])
        return at[np.isin(pairs[at], self.known)] if len(at) else at

    def similarity(self, words: np.ndarray, family: str | None = None) -> float:
        """The largest share of a template's word pairs that `words` has."""
        own = pairs_of(words)
        return max(float(np.isin(p, own).mean()) for f, p in zip(self.family, self.pairs) if family in (None, f))


def windows(words: np.ndarray) -> Iterator[np.ndarray]:
    for start in range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE):
        yield words[start : start + WINDOW]


def unknown_paragraphs(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of the windows and lines of all texts that resemble no template anywhere; at most MOST_PARAGRAPHS."""
    templates = Templates()
    found: dict[bytes, np.ndarray] = {}
    for text in sorted(set(texts)):
        parts = list(words_of([text.encode(), *(line.encode() for line in text.split("\n"))]))
        own = [w for part in parts for w in windows(part) if len(w)]
        if not any(len(templates.hits(w)) and templates.similarity(w) >= RESEMBLES for w in own):
            found.update((w.tobytes(), w) for w in own)
    kept = list(found.values())
    return kept[:: max(1, -(-len(kept) // MOST_PARAGRAPHS))]


def fit(unknown: list[np.ndarray]) -> Families:
    """Classifiers and level from unknown paragraphs (word hashes); every fifth is held out for the level."""
    templates, rng = Templates(), np.random.default_rng(31)
    held, unknown = unknown[::5], [w for i, w in enumerate(unknown) if i % 5]
    names = list(TEMPLATES)
    x, label = [features(w) for w in unknown], [-1] * len(unknown)
    filler = np.concatenate(unknown) if unknown else rng.integers(1, 1 << 62, 1000).astype("u8")
    for family, words in zip(templates.family, templates.words):
        for v in range(VARIANTS):
            own = words[rng.random(len(words)) > (0.08 if v else 0)]
            at, more = int(rng.integers(0, max(1, len(filler) - 40))), int(rng.integers(0, 30)) if v else 0
            cut = int(rng.integers(0, more + 1))
            x.append(features(np.concatenate((filler[at : at + cut], own, filler[at + cut : at + more]))))
            label.append(names.index(family))
    place = np.array(label)
    y = np.where(place[:, None] == np.arange(len(names))[None, :], 1, -1).astype("f4")
    weight = np.where(place < 0, 2.0 / max(1, len(unknown)), 1.0 / max(1, (place >= 0).sum()))
    model = Families(names, fit_logistic(np.stack(x), y, weight, steps=250, decay=1e-6), 0.5)
    passed = np.sort([model.probability(w).max() for w in held]) if held else np.zeros(1)
    model.level = max(0.3, min(0.9, float(np.quantile(passed, 1 - FALSE_RATE))))
    return model


def train(documents: DataFrame, near: int = TRAIN_DOCUMENTS) -> Families:
    """Classifiers with paragraphs of about `near` documents, chosen by hash, as the unknown class; fitted in one task."""
    total = documents.count()
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < min(1.0, near / max(1, total)) * 1_000_000
    sample = documents.select(F.col("doc_id").cast("string").alias("doc_id"), text_column().alias("text")).filter(draw).select("text").limit(4 * near)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = fit(unknown_paragraphs([text for batch in batches for text in batch["text"]]))
        yield pd.DataFrame({"model": [pickle.dumps((model.names, model.weights, model.level))]})

    found = sample.coalesce(1).mapInPandas(run, "model binary").collect()
    return Families(*pickle.loads(bytes(found[0].model))) if found else fit([])


@dataclass
class Notice:
    family: str
    score: float
    similarity: float
    places: np.ndarray

    def within(self, other: Notice) -> bool:
        """Whether a likelier notice of another family has all word pairs of this one."""
        return self.family != other.family and self.score < other.score and bool(np.isin(self.places, other.places).all())


def notices(model: Families, templates: Templates, words: np.ndarray, starts: np.ndarray) -> list[Notice]:
    """Every confirmed notice of a text; `starts` are the places of the first words of its lines."""
    at = templates.hits(words)
    code = np.searchsorted(templates.known, seeds_at(words, 2)[at])
    size = templates.size

    def shares(part: np.ndarray) -> np.ndarray:
        return templates.has[:, np.unique(part)].sum(1) / size

    able = np.flatnonzero(shares(code) >= CONFIRM)  # no window holds more of a template than the text
    crops: set[tuple[int, int]] = set()
    if len(able):
        bounds = [*starts.tolist(), len(words)]
        for low, high in {(0, len(words)), *zip(bounds[:-1], bounds[1:])}:
            for start in range(low, max(low + 1, high - WINDOW + STRIDE), STRIDE):
                i, j = np.searchsorted(at, (start, min(start + WINDOW, high) - 1))
                if j > i:
                    crops.add((max(start, int(at[i]) - 6), min(start + WINDOW, high, int(at[j - 1]) + 8)))
    for t in able.tolist():
        own = at[templates.has[t][code]]
        for first in own.tolist():
            last = own[np.searchsorted(own, first + len(templates.words[t]) * 3 // 2 + 4) - 1]
            crops.add((first, int(last) + 2))
    found: list[Notice] = []
    for low, high in sorted(crops, key=lambda c: (c[1] - c[0], c)):
        i, j = np.searchsorted(at, (low, high - 1))
        share = shares(code[i:j])
        fit_ = able[share[able] >= CONFIRM]
        if not len(fit_):
            continue
        p = model.probability(words[low:high])
        for name in sorted({templates.family[t] for t in fit_}):
            score = float(p[model.names.index(name)])
            if score >= model.level:
                t = max((t for t in fit_ if templates.family[t] == name), key=lambda t: share[t])
                found.append(Notice(name, score, float(share[t]), at[i:j][templates.has[t][code[i:j]]]))
    found = [n for n in found if not any(n.within(m) for m in found)]
    # The best of overlapping ones of a family stays; of equal ones the shortest.
    kept: list[Notice] = []
    for n in sorted(found, key=lambda n: -n.similarity):
        if not any(m.family == n.family and m.places[0] <= n.places[-1] + 1 and n.places[0] <= m.places[-1] + 1 for m in kept):
            kept.append(n)
    return sorted(kept, key=lambda n: (int(n.places[0]), n.family))


def _scan(model: Families):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            rows = []
            ids, raws = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for doc, raw, words in zip(ids, raws, words_of(raws)):
                if not len(templates.hits(words)):
                    continue
                starts = np.cumsum([0, *(len(line) for line in words_of(raw.split(b"\n")))])[:-1]
                for n in notices(model, templates, words, starts):
                    rows.append((doc, int(np.searchsorted(starts, n.places[0], "right")) - 1, n.family, n.score, n.similarity))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "paragraph", "family", "score", "similarity"])

    return run


def find_licences(documents: DataFrame, near: int = TRAIN_DOCUMENTS) -> DataFrame:
    """One row per row of `documents` and confirmed notice in it: doc_id, paragraph, family, score, similarity.

    paragraph is the line, from 0, that the notice begins in; it may go on in the next. Overlapping windows of a family are
    one notice. Where all word pairs of a notice belong to a likelier one, only the latter is reported. Documents without a notice, with a null or an empty
    text give no row. Rows that repeat are reported as often as they occur.
    """
    prepare(documents.sparkSession)
    rows = documents.select("doc_id", text_column().alias("text"))
    schema = "doc_id bigint, paragraph bigint, family string, score double, similarity double"
    return rows.mapInArrow(_scan(train(documents, near)), schema)
