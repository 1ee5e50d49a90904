"""Licence scan: an exact set-similarity join of text blocks with licence templates.

A block is a run of 64 plain words, one starting at every 32nd.  A template's tokens are ordered by how
many texts hold them, rarest first; a block that holds at least ``threshold`` of a template's distinct
tokens must hold one of its first few (prefix filter), have enough tokens (length filter), and enough of
them left after the first common one (positional filter).  What passes is counted exactly.  The templates
and their vocabulary are fixed and small, so they are broadcast; blocks never move.

Cases: null and empty texts have no words and no labels; very long texts are scanned whole, block by block; repeated
rows are each scanned; tokens equally frequent (ties) are ordered by their bytes; an empty table has no rows; doc_id may
have any type; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import per_batch, text_bytes
from .text import plain_words

#: Phrases whose places are counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Sentences that public licences ask to be printed, and the label of each.  A short one has six distinct
#: tokens at most, so that THRESHOLD asks for all of them: one of seven would also match with its deciding token missing.
TEMPLATES = [
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3", "GNU General Public License, version 3"),
    ("gpl-any", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    # short declarations
    *((label, f"{verb} under the {name} License") for label, name in (("mit", "MIT"), ("bsd", "BSD"), ("isc", "ISC")) for verb in ("Released", "Licensed", "Distributed", "Available")),
    *((label, f"SPDX-License-Identifier: {name}") for label, name in (("mit", "MIT"), ("bsd", "BSD-2-Clause"), ("bsd", "BSD-3-Clause"), ("isc", "ISC"), ("apache-2.0", "Apache-2.0"), ("mpl-2.0", "MPL-2.0"))),
    ("mpl-2.0", "Mozilla Public License 2.0"),
    ("apache-2.0", "Apache License 2.0"),
    ("gpl-3", "GNU General Public License v3"),
    ("gpl-3", "GPLv3"),
    ("gpl-3", "License-Identifier: GPL-3.0"),
    ("cc-by", "Creative Commons Attribution"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    ("cc0", "CC0"),
    ("unlicense", "Unlicense"),
]
THRESHOLD, BLOCK, STEP = 0.85, 64, 32


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """In how many texts each token of the templates stands."""
    wanted = {w for _, t in templates for w in plain_words(t.encode())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(w for b in batches for t in b.column(0).to_pylist() for w in wanted.intersection(plain_words(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])

    rows = docs.select(text_bytes().alias("text")).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in wanted} | {bytes(r["w"]): r["n"] for r in rows}


class TemplateIndex:
    def __init__(self, frequency: dict[bytes, int], templates=TEMPLATES, threshold: float = THRESHOLD):
        order = {w: k for k, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
        self.order = order
        self.labels = [label for label, _ in templates]
        self.tokens = [sorted(set(plain_words(t.encode())), key=order.__getitem__) for _, t in templates]
        self.needed = [ceil(threshold * len(t) - 1e-9) for t in self.tokens]
        self.prefix: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, tokens in enumerate(self.tokens):
            for at, w in enumerate(tokens[: len(tokens) - self.needed[k] + 1]):
                self.prefix[w].append((k, at))
        self.rare = frozenset(self.prefix)

    def matches(self, words: list[bytes]) -> dict[int, float]:
        """Templates that a block of ``words`` holds, and their largest containment."""
        found: dict[int, float] = {}
        if self.rare.isdisjoint(words):
            return found
        for start in range(0, max(1, len(words) - STEP), STEP):
            block = set(words[start : start + BLOCK])
            ranked = sorted((w for w in block if w in self.order), key=self.order.__getitem__)
            tried = set()
            for i, w in enumerate(ranked):
                for k, at in self.prefix.get(w, ()):
                    need, size = self.needed[k], len(self.tokens[k])
                    if k in tried or len(ranked) < need or min(size - at, len(ranked) - i) < need:
                        continue  # the first common token comes first in either order, so nothing before it can count
                    tried.add(k)
                    common = sum(t in block for t in self.tokens[k])
                    if common >= need:
                        found[k] = max(found.get(k, 0.0), common / size)
        return found


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    out, at = [], -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if words[at : at + len(phrase)] == phrase:
            out.append(at)


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every text."""
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(frequencies(docs, templates), templates, threshold))
    phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]

    def of(text: bytes) -> tuple:
        words = plain_words(text)
        present = set(words)
        base: dict[str, list[int]] = {}
        for phrase, label in phrases:
            if present.issuperset(phrase) and (at := _places(words, phrase)):
                base[label] = at
        places = [i for at in base.values() for i in at]
        found = {} if index.value.rare.isdisjoint(present) else index.value.matches(words)
        labels = {*base, *(index.value.labels[k] for k in found)}
        score = max([1.0 if places else 0.0, *found.values()])
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score

    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [of(t) for t in batch.column(1).to_pylist()]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(per_batch(run), schema)
