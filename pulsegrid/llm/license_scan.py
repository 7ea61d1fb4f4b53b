"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template of s shingles is sought in windows of 2W shingles, W being the power of two from s (4 at least), one window
starting every W shingles: an occurrence of up to W shingles lies whole in some window. If it holds the wanted share
of the template, window and template have at least a known Jaccard similarity, and the number of one-value bands is
chosen so that they collide with the guaranteed probability. Retrieved windows are then compared shingle by shingle.

Versions of a license that share most shingles are rivals: each would be found wherever the other stands. There the
shingles that only one of them has decide; versions that a text does not tell apart are all reported.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, log
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from pulsegrid.llm.decontaminate import _split_words
from pulsegrid.llm.tables import in_steps

WORDS = 5
MAX_TEMPLATES = 10_000  # their signatures travel with the tasks: about 1 kB each

# fixed values: public license notices as projects print them
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

# further sentences and headers, with the versions of each family
HEADERS = (
    *((f"GPL-{v}.0", f"This work is licensed under the GNU General Public License, version {v}.") for v in (1, 2)),
    *((f"LGPL-{v}", f"This work is licensed under the GNU Lesser General Public License, version {v}.") for v in ("2.1", "3")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    *((f"GPL-{v}.0-header", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version.") for v in (2, 3)),
    *((f"LGPL-{v}-header", f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version.") for v in ("2.1", "3")),
    ("AGPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    *((f"CC-{k}-{v}-notice", f"This work is licensed under a Creative Commons {n} {v} {w} License.")
      for k, n in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
      for v, w in (("3.0", "Unported"), ("4.0", "International")) if (k, v) != ("BY", "4.0")),
    *((f"CC-{k}-{v}", f"Licensed under CC {k} {v}.") for k in ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND") for v in ("3.0", "4.0") if (k, v) not in (("BY", "4.0"), ("BY-NC", "4.0"))),
    ("CC0-1.0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0"),
    ("EPL-1.0-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("Unlicense-notice", "This is free and unencumbered software released into the public domain."),
)


def templates() -> list[tuple[str, str]]:
    """Notices, headers and whole license texts; the texts are the files of ``license_texts``, without copyright lines."""
    texts = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return [*NOTICES, *HEADERS, *((f"{p.stem}-text", p.read_text(encoding="utf-8")) for p in texts)]


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes of all texts and the n+1 places where texts begin; fewer than five words give none."""
    coded, at = _split_words(texts)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    words = hashes[coded.indices.to_numpy()] if len(coded) else np.zeros(0, dtype=np.uint64)
    odd = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1)
    if len(words) < WORDS:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    with np.errstate(over="ignore"):
        grams = sum(words[k : len(words) - WORDS + 1 + k] * odd[k] for k in range(WORDS))
        grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        grams ^= grams >> np.uint64(28)
    sizes = np.maximum(np.diff(at) - WORDS + 1, 0)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    places = np.arange(starts[-1]) - np.repeat(starts[:-1], sizes) + np.repeat(at[:-1], sizes)
    return grams[places], starts


def bands_for(similarity: float, guarantee: float) -> int:
    """One-value bands after which two sets of this similarity have collided with the guaranteed probability."""
    return 1 if similarity >= 1 else ceil(log(1 - guarantee) / log(1 - similarity))


class Templates:
    """Signatures of the templates by window class."""

    def __init__(self, notices: Sequence[tuple[str, str]], share: float, guarantee: float):
        if len(notices) > MAX_TEMPLATES:
            raise ValueError("too many templates for one scan; pass them in blocks")
        grams, starts = _shingles(pa.array([t for _, t in notices], pa.string()))
        self.names = [n for n, _ in notices]
        self.sets = [np.unique(grams[a:b]) for a, b in zip(starts, starts[1:])]
        self.need = [ceil(share * len(s) - 1e-9) for s in self.sets]
        self.share = share
        self.rivals = self._rivals()
        self.classes: dict[int, tuple[int, np.ndarray]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                width = max(4, 1 << (len(s) - 1).bit_length())
                bands = bands_for(self.need[i] / (2 * width + len(s) - self.need[i]), guarantee)
                most, members = self.classes.get(width, (0, np.zeros(0, dtype=np.int64)))
                self.classes[width] = (max(most, bands), np.append(members, i))

    def _rivals(self) -> dict[int, list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each template those that it is found in and that are found in it, with the shingles only one has."""
        at: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            for g in s.tolist():
                at.setdefault(g, []).append(i)
        common: dict[tuple[int, int], int] = {}
        for members in at.values():
            for i in members:
                for j in members:
                    common[i, j] = common.get((i, j), 0) + 1
        out: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for (i, j), n in common.items():
            if i != j and n >= max(self.need[i], self.need[j]):
                out.setdefault(i, []).append((j, np.setdiff1d(self.sets[i], self.sets[j]), np.setdiff1d(self.sets[j], self.sets[i])))
        return out

    def _outdone(self, i: int, here: np.ndarray, found: set[int]) -> bool:
        """Whether a rival found in the same text has more of its own shingles in ``here``, the window of template i."""
        for j, mine, others in self.rivals.get(i, ()):
            if j in found:
                theirs = np.isin(others, here).mean() if len(others) else None
                own = np.isin(mine, here).mean() if len(mine) else 1 - (theirs or 0)
                if own < min(self.share, 1 - own if theirs is None else theirs):
                    return True
        return False

    @staticmethod
    def factors(n: int) -> np.ndarray:
        return np.random.default_rng(11).integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)

    def scan(self, grams: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(text, template, first shingle, containment) of the best window of every text and template found."""
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        sizes = np.diff(starts)
        short = (grams >> np.uint64(32)).astype(np.uint32)
        for width, (bands, members) in self.classes.items():
            blocks = -(-sizes // width)  # of each text
            first = np.concatenate([[0], np.cumsum(blocks)])
            text = np.repeat(np.arange(len(sizes)), blocks)
            at = starts[:-1][text] + (np.arange(first[-1]) - first[:-1][text]) * width
            if not len(at):
                continue
            last = np.zeros(len(at), dtype=bool)
            last[first[1:][blocks > 0] - 1] = True
            known = [(self.sets[i] >> np.uint64(32)).astype(np.uint32) for i in members]
            hit_block, hit_template = [], []
            for f in self.factors(bands):
                with np.errstate(over="ignore"):
                    least = np.minimum.reduceat(short * f, at)
                    wanted = np.array([(k * f).min() for k in known])
                pair = np.minimum(least, np.where(last, least, np.append(least[1:], least[-1:])))
                table = np.zeros(1 << 16, dtype=bool)
                table[wanted & np.uint32(0xFFFF)] = True
                maybe = np.flatnonzero(table[pair & np.uint32(0xFFFF)])
                for k, w in enumerate(wanted):
                    b = maybe[pair[maybe] == w]
                    hit_block.append(b)
                    hit_template.append(np.full(len(b), members[k]))
            found = np.unique(np.column_stack([np.concatenate(hit_block), np.concatenate(hit_template)]), axis=0)
            for b, i in found.tolist():
                lo, hi = int(at[b]), int(min(at[b] + 2 * width, starts[text[b] + 1]))
                inside = np.isin(grams[lo:hi], self.sets[i])
                share = len(np.unique(grams[lo:hi][inside])) / len(self.sets[i])
                if share * len(self.sets[i]) >= self.need[i] - 1e-9:
                    key, value = (int(text[b]), i), (-share, lo + int(np.argmax(inside)) - int(starts[text[b]]), lo, hi)
                    best[key] = min(best.get(key, value), value)
        found_in: dict[int, set[int]] = {}
        for t, i in best:
            found_in.setdefault(t, set()).add(i)
        return [(t, i, place, -share) for (t, i), (share, place, lo, hi) in sorted(best.items()) if not self._outdone(i, grams[lo:hi], found_in[t])]


def scan_licenses(df: DataFrame, notices: Sequence[tuple[str, str]] = NOTICES, share: float = 0.8, guarantee: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row and template found: ``id_col, license, containment, first_word``.

    ``containment`` is the share of the template's distinct five-word shingles inside the best window, ``share`` at
    least; ``first_word`` is where its first shingle stands. Templates and texts of fewer than five words hold none;
    null and empty texts give no rows, repeated rows the same rows again, and texts of any length are scanned whole. Pass more than MAX_TEMPLATES in blocks; versions
    of one license belong in the same block.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(notices, share, guarantee)
        for rows in in_steps(batches, 1, 1000):
            grams, starts = _shingles(rows.column(1))
            found = known.scan(grams, starts) if len(grams) else []
            if found:
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array([f[0] for f in found])), pa.array([known.names[f[1]] for f in found]), pa.array([f[3] for f in found]), pa.array([f[2] for f in found], pa.int64())],
                    names=[id_col, "license", "containment", "first_word"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, license string, containment double, first_word bigint")
