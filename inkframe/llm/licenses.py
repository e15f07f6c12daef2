"""License scan by patience alignment of word sequences.

Where enough words of a template lie close together, the passage is aligned with it: words that are
unique in both are anchors, the longest increasing run of anchors stands, and the gaps between them
are aligned the same way. Coverage is the share of the template's words that are aligned.

Templates are a small parameter and go to every task; documents are read once and never move.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import text as T

MIN_COVERAGE = 0.8
#: Public notices by SPDX name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "MIT": "Released under the MIT License",
    "MIT-header": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "BSD-3-Clause-header": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "All-rights-reserved": "All rights reserved",
    "CC0-1.0": "The person who associated a work with this deed has dedicated the work to the public domain",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (patience sorting)."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal words, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        pairs = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in where]
        anchors = [pairs[k] for k in increasing([j for _, j in pairs])]
        out += anchors
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i0 + 1, i1, j0 + 1, j1) for (i0, j0), (i1, j1) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def passages(hashes: np.ndarray, template: np.ndarray, coverage: float) -> list[tuple[int, int, float]]:
    """(first word, end word, coverage) of each passage of one text that covers the template, left to right."""
    need, reach = int(np.ceil(coverage * len(template) - 1e-9)), len(template) + max(5, len(template) // 2)
    hit = np.isin(hashes, template)
    if hit.sum() < need:
        return []
    run = np.concatenate([[0], np.cumsum(hit)])
    ends = np.minimum(np.arange(len(hashes)) + reach, len(hashes))
    dense = np.flatnonzero(hit & (run[ends] - run[:-1] >= need))
    out, k = [], 0
    want = template.tolist()
    while k < len(dense):
        i = int(dense[k])
        pairs = align(hashes[i : i + reach].tolist(), want)
        if len(pairs) >= need and pairs[0][0] == 0:
            out.append((i, i + pairs[-1][0] + 1, len(pairs) / len(want)))
            k = int(np.searchsorted(dense, out[-1][1]))
        else:
            k += 1
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, n_words, licenses (name:first word:end word:coverage, comma-joined in order), best, coverage.

    One row per document, repeated ones too; null and empty texts have none. A template inside a longer
    one is reported beside it. Words compare without case and signs. An empty table gives no rows.
    """
    chosen = templates or TEMPLATES
    known = {name: T.words(pa.array([t]))[0] for name, t in chosen.items()}
    union = np.unique(np.concatenate(list(known.values())))
    fewest = min(int(np.ceil(coverage * len(t))) for t in known.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.steps(batch.column(1)):
                hashes, rows, _, _ = T.words(batch.column(1).slice(lo, hi - lo))
                edge = np.searchsorted(rows, np.arange(hi - lo + 1))
                hit = np.concatenate([[0], np.cumsum(np.isin(hashes, union))])
                found, best, share = [], [], []
                for i in range(hi - lo):
                    own = []
                    if hit[edge[i + 1]] - hit[edge[i]] >= fewest:
                        own = [(a, b, name, c) for name, t in known.items() for a, b, c in passages(hashes[edge[i] : edge[i + 1]], t, coverage)]
                    found.append(",".join(f"{name}:{a}:{b}:{c:.4f}" for a, b, name, c in sorted(own)))
                    top = max(own, key=lambda x: (x[3], x[1] - x[0], x[2]), default=None)
                    best.append(top and top[2])
                    share.append(top[3] if top else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(edge)), pa.array(found), pa.array(best, type=pa.string()), pa.array(share)],
                    names=["doc_id", "n_words", "licenses", "best", "coverage"],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_words long, licenses string, best string, coverage double")
