"""Licence families in texts: a trained paragraph classifier, confirmed by comparison with templates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Emitter, hash_words, mix, rows_of

#: Usual notices of each licence family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": ("licensed under the GNU Affero General Public License version 3", "This program is distributed under the terms of the AGPL"),
    "apache": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License", "Distributed under the BSD 2-Clause License", "Licensed under the BSD License",
    ),
    "cc0": ("Released under CC0 1.0 Universal, dedicated to the public domain", "To the extent possible under law the author has waived all copyright", "This work is in the public domain"),
    "cc-by": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC-SA 4.0", "Licensed under CC BY-NC-ND 4.0"),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3", "licensed under the GPL version 2 or later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "lgpl": ("licensed under the GNU Lesser General Public License version 2.1", "distributed under the terms of the LGPL"),
    "mit": (
        "Released under the MIT License", "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"),
    "proprietary": ("All rights reserved", "Copyright 2024 the author. All rights reserved", "No part of this publication may be reproduced without prior written permission", "Confidential and proprietary"),
}
#: Families whose texts need leave or conditions beyond naming the author.
RESTRICTED = frozenset(("agpl", "gpl", "lgpl", "mpl", "cc-by-nc", "cc-by-nd", "cc-by-sa", "proprietary"))
UNKNOWN = "unknown"
#: Hashed features; background paragraphs and labelled variants per family that the classifier is fitted on.
BINS, BACKGROUND, VARIANTS = 1 << 12, 2_000, 48
#: A line of more words is judged in windows of this many, each overlapping half of the one before.
UNIT = 40
#: A family counts if its calibrated probability is this high and it holds this share of a template's word pairs.
LEAST_PROBABILITY, LEAST_OVERLAP = 0.5, 0.6
#: Joined lines are searched in windows of twice this many words; each shares this many with the next, more than a template has.
HALF, AROUND = 40, 4

_WORD = re.compile(rb"[0-9a-z]+(?:[.'-][0-9a-z]+)*|[^\x00-\x7f]+")

#: A line that ends within a hyphened word, with the comment sign of the next one.
_BROKEN = re.compile(rb"(?<=[0-9A-Za-z]-)[ \t\r]*\n[ \t]*(?:[*#/;%]+[ \t]*)?(?=[0-9A-Za-z])")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def features(words: list[bytes]) -> np.ndarray:
    """Bins of the words and word pairs."""
    if not words:
        return np.empty(0, np.int64)
    h = hash_words(words)
    both = np.concatenate([mix(h), mix(h[:-1] * np.uint64(3) + h[1:])])
    return (both % np.uint64(BINS)).astype(np.int64)


def units(text: bytes) -> list[list[bytes]]:
    """Words of each line; long lines in overlapping windows.  Every word is in one at least."""
    out = []
    for line in text.split(b"\n"):
        words = words_of(line)
        if len(words) <= UNIT:
            if words:
                out.append(words)
        else:
            step = UNIT // 2
            out += [words[i : i + UNIT] for i in range(0, len(words) - step, step)]
    return out


def pairs_of(words: list[bytes]) -> set:
    return set(zip(words, words[1:], strict=False)) or set(zip(words, words, strict=True))


TEMPLATE_PAIRS = {family: [pairs_of(words_of(t.encode())) for t in own] for family, own in TEMPLATES.items()}


def overlap(words: list[bytes], family: str) -> float:
    """Largest share of a template's word pairs that the words hold."""
    own = pairs_of(words)
    return max(len(own & t) / len(t) for t in TEMPLATE_PAIRS[family])


#: Templates that hold a word pair, and the pairs that confirm each.
_HOLDERS: dict[tuple, list[int]] = {}
_LEAST: list[float] = []
for _own in TEMPLATE_PAIRS.values():
    for _pairs in _own:
        for _pair in _pairs:
            _HOLDERS.setdefault(_pair, []).append(len(_LEAST))
        _LEAST.append(LEAST_OVERLAP * len(_pairs))


def wrapped(text: bytes) -> list[list[bytes]]:
    """Words of each place where the joined lines of a paragraph hold enough of a template and a line ends within it.

    Paragraphs end at lines without a word.
    """
    out: list[list[bytes]] = []
    words: list[bytes] = []
    ends: set[int] = set()  # places of the last words of lines
    for line in [*text.split(b"\n"), b""]:
        own = words_of(line)
        if own:
            words += own
            ends.add(len(words) - 1)
            continue
        if len(ends) > 1:
            out += _places(words, ends)
        words, ends = [], set()
    return out


def _places(words: list[bytes], ends: set[int]) -> list[list[bytes]]:
    at = [(i, p) for i, p in enumerate(zip(words, words[1:], strict=False)) if p in _HOLDERS]
    blocks: dict[int, list] = {}
    for i, p in at:
        for block in {i // HALF, max(0, i // HALF - 1)}:
            blocks.setdefault(block, []).append((i, p))
    spans = set()
    for own in blocks.values():
        held: dict[int, dict] = {}
        for i, p in own:
            for t in _HOLDERS[p]:
                held.setdefault(t, {}).setdefault(p, []).append(i)
        for t, pairs in held.items():
            if len(pairs) >= _LEAST[t]:
                # Around the pairs that occur once, so that a usual pair far off does not widen the place.
                sure = [i[0] for i in pairs.values() if len(i) == 1] or [i for own in pairs.values() for i in own]
                first, last = min(sure), max(sure) + 1
                near = [i for own in pairs.values() for i in own if first - len(pairs) <= i <= last + len(pairs)]
                first, last = min([first, *near]), max([last, *(i + 1 for i in near)])
                if any(i in ends for i in range(first, last)):
                    spans.add((first, last))
    # With some words around: what tells similar families apart may stand next to the pairs they share.
    return [words[max(0, a - AROUND) : b + 1 + AROUND] for a, b in sorted(spans)]


def variants(family: str, background: list[list[bytes]], seed: int) -> list[list[bytes]]:
    """Labelled examples of a family: templates with words dropped, numbers changed, and other text around."""
    rng = np.random.default_rng(seed)
    out = []
    for template in TEMPLATES[family]:
        words = words_of(template.encode())
        out += [words] * 4
        for _ in range(VARIANTS):
            own = [w for w in words if rng.random() > 0.08] or words
            own = [str(rng.integers(1, 2030)).encode() if w.isdigit() and rng.random() < 0.5 else w for w in own]
            around = background[int(rng.integers(len(background)))] if background else []
            n = int(rng.integers(0, 1 + min(len(around), UNIT - min(UNIT, len(own)))))
            out.append(around[: n // 2] + own + around[n // 2 : n])
    return out


class Classifier:
    """Multinomial logistic regression on mean feature vectors, with a temperature and an unknown class."""

    def __init__(self, families: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.families, self.weights, self.bias, self.temperature = families, weights, bias, temperature

    def probabilities(self, texts: list[list[bytes]]) -> np.ndarray:
        if not texts:
            return np.empty((0, len(self.families)))
        own = [features(w) for w in texts]
        n = np.array([len(x) for x in own])
        sums = np.add.reduceat(self.weights[np.concatenate(own)], np.cumsum([0, *n[:-1]]), axis=0)
        logits = (sums / np.sqrt(n)[:, None] + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)


def fit(background: list[list[bytes]], seed: int = 11, rounds: int = 150) -> Classifier:
    """Fit on three quarters of the examples; the temperature that makes the rest most likely calibrates the output."""
    families = sorted(TEMPLATES) + [UNKNOWN]
    clean = [w for w in background if w and max(overlap(w, f) for f in TEMPLATES) < LEAST_OVERLAP / 2]
    texts, labels = [], []
    for i, family in enumerate(families[:-1]):
        own = variants(family, clean, seed + i)
        texts += own
        labels += [i] * len(own)
    notices = [words_of(t.encode()) for t in ("a driver needs a license to drive", "the public was free to use the general library", "version 2.0 of the work was released", "under the terms of the contract", "rights of the author")]
    texts += clean + notices * 10
    labels += [len(families) - 1] * (len(texts) - len(labels))
    y = np.array(labels)
    held = np.arange(len(y)) % 4 == 3
    x = np.zeros((len(y), BINS), np.float32)
    for i, words in enumerate(texts):
        own = features(words)
        np.add.at(x[i], own, 1 / np.sqrt(max(1, len(own))))
    target = np.eye(len(families), dtype=np.float32)[y]
    weights, bias = np.zeros((BINS, len(families)), np.float32), np.zeros(len(families), np.float32)
    train = x[~held], target[~held]
    share = train[1].mean(axis=0)
    balance = (1 / np.maximum(share, 1e-6))[y[~held]][:, None].astype(np.float32) / len(families)
    speed, moment = 4.0, np.zeros_like(weights)
    for _ in range(rounds):
        z = train[0] @ weights + bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        error = (p - train[1]) * balance / len(p)
        moment = 0.9 * moment + train[0].T @ error + 1e-5 * weights
        weights -= speed * moment
        bias -= speed * error.sum(axis=0)
    logits, best = x[held] @ weights + bias, (np.inf, 1.0)
    for temperature in np.geomspace(0.1, 10, 41):
        z = logits / temperature
        z -= z.max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), y[held]]).mean()) if len(z) else 0.0
        best = min(best, (loss, float(temperature)))
    return Classifier(families, weights, bias, best[1])


def train(docs: DataFrame, text_col: str = "text") -> Classifier:
    """Fit with a bounded background: one line each of the ``BACKGROUND`` distinct documents with the smallest hash."""
    text = F.col(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 20)
    line = F.get(lines, F.pmod(F.xxhash64(F.lit("line"), text), F.greatest(F.size(lines), F.lit(1))).cast("int"))
    drawn = docs.select(F.xxhash64(F.lit("background"), text).alias("_h"), F.substring(line, 1, 400).alias("line")).filter("line IS NOT NULL")
    rows = drawn.distinct().orderBy("_h", "line").limit(BACKGROUND).collect()
    return fit([words_of(r["line"].encode())[:UNIT] for r in rows])


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, families, n_paragraphs, n_licence, n_unconfirmed, confidence, restricted``.

    All lines of the whole text are classified (``n_paragraphs`` counts these units), and places where joined lines of a
    paragraph hold a template.  A family is reported if its calibrated probability passes and the unit holds enough of
    one of its templates; predictions that no template confirms are counted.  ``n_licence`` counts a wrapped notice once
    per family, if no line names that family.

    Null or empty texts have no paragraph and no family.  Rows repeat as they are; null ids are carried through.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.families, model.weights, model.bias, model.temperature))  # BINS x families numbers
    schema = pa.schema(
        [("id", pa.int64()), ("families", pa.list_(pa.string())), ("n_paragraphs", pa.int64()), ("n_licence", pa.int64())]
        + [("n_unconfirmed", pa.int64()), ("confidence", pa.float64()), ("restricted", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]):
        m, out = Classifier(*shared.value), Emitter(schema)
        for key, text in rows_of(batches, "id", "text"):
            text = _BROKEN.sub(b"", text or b"")
            own = units(text)
            found, hits, loose, sure = set(), 0, Counter(), 0.0
            for parts, alone in ((own, True), (wrapped(text), False)):
                for at in range(0, len(parts), 512):
                    part = parts[at : at + 512]
                    p = m.probabilities(part)
                    best = p.argmax(axis=1)
                    for i in np.flatnonzero((best < len(m.families) - 1) & (p.max(axis=1) >= LEAST_PROBABILITY)):
                        family = m.families[best[i]]
                        if overlap(part[i], family) < LEAST_OVERLAP:
                            loose[family] += alone
                        elif alone or family not in found:
                            found.add(family)
                            hits += 1
                            sure = max(sure, float(p[i, best[i]]))
                            if not alone:  # its lines are confirmed together
                                del loose[family]
            yield from out.add((key, sorted(found), len(own), hits, loose.total(), sure if found else None, bool(found & RESTRICTED)))
        yield from out.flush()

    names = "id long, families array<string>, n_paragraphs long, n_licence long, n_unconfirmed long, confidence double, restricted boolean"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, names)
