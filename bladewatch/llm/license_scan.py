"""License notices found by conditional compression and confirmed word by word.

A block of text is compressed alone and with each template as a raw zstandard dictionary. A template that the block
repeats makes the result much smaller, so templates are ranked by that reduction and aligned with the block word by word,
TRIED at a time, until some of them are confirmed or none is left. The wording differences decide: they tell versions and
variants apart, which share most bytes.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

# Wording of public licence notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All-rights-reserved": "All rights reserved. No part of this work may be reproduced without written permission.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."),
}
CUE = r"(?i)licen[cs]|copyright|permission|rights reserved|redistribut|free software"
TRIED = 6  # best templates by compression that are aligned at a time
MOST_DIFFERENT = 0.15  # share of a template's words that may differ
_WORD = re.compile(r"\w+(?:[.-]\w+)*")
_CUE = re.compile(CUE)


@lru_cache(maxsize=4)
def _prepared(templates: tuple) -> list:
    out = []
    for name, text in templates:
        words = _WORD.findall(text.lower())
        raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((name, words, zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False)))
    return out


def blocks_of(text: str, longest: int) -> Iterator[tuple[int, list[tuple[str, int, int]]]]:
    """Candidate blocks: windows of words around each cue, as lists of (word, start, end) in the whole text.

    Cues closer together than the longest template share a window of at most four times its length; a longer run
    is cut into windows that overlap by one template length.
    """
    words = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    cues = [i for i, (w, _, _) in enumerate(words) if _CUE.search(w) or w in ("rights", "software", "free")]
    spans: list[list[int]] = []
    for i in cues:
        low, high = max(0, i - longest), min(len(words), i + longest)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    for low, high in spans:
        step = 3 * longest
        for at in range(low, high, step):
            yield at, words[at:min(at + step + longest, high)]
            if at + step + longest >= high:
                break


def reductions(block: list[str], prepared: list) -> list[tuple[float, int]]:
    """(bytes saved by the template per byte of it, its index), best first.

    The block is compressed without any dictionary and with each template; the saving is compared with what the
    template takes by itself, so that a short notice in a long block counts as much as a long one.
    """
    data = " ".join(block).encode()
    alone = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(data))
    found = []
    for k, (_, words, compressor) in enumerate(prepared):
        saved = alone - len(compressor.compress(data))
        found.append((saved / len(" ".join(words)), k))
    return sorted(found, reverse=True)


def wording(block: list[str], template: list[str]) -> tuple[int, int, int, list[str]]:
    """(start, end, different words, differences) of the part of the block that is nearest to the template."""
    match = difflib.SequenceMatcher(None, template, block, autojunk=False)
    anchor = match.find_longest_match()
    if not anchor.size:
        return 0, 0, len(template), []
    slack = max(2, len(template) // 4)
    low = max(0, anchor.b - anchor.a - slack)
    high = min(len(block), anchor.b - anchor.a + len(template) + slack)
    codes = difflib.SequenceMatcher(None, template, block[low:high], autojunk=False).get_opcodes()
    while codes and codes[0][0] == "insert":
        codes = codes[1:]
    while codes and codes[-1][0] == "insert":
        codes = codes[:-1]
    if codes and codes[0][0] == "replace":  # words before the notice are none of its own
        tag, a, b, c, d = codes[0]
        codes[0] = tag, a, b, max(c, d - (b - a)), d
    if codes and codes[-1][0] == "replace":
        tag, a, b, c, d = codes[-1]
        codes[-1] = tag, a, b, c, min(d, c + b - a)
    different, said = 0, []
    for tag, a, b, c, d in codes:
        if tag != "equal":
            different += max(b - a, d - c)
            said.append(f"{' '.join(template[a:b])} -> {' '.join(block[low + c:low + d])}")
    return low + codes[0][3], low + codes[-1][4], different, said


def find_licenses(text: str, templates: tuple) -> list[tuple]:
    """(license, start, end, different words, differences, reduction) of the notices of one text, at their places."""
    prepared = _prepared(templates)
    longest = max(len(w) for _, w, _ in prepared)
    found = {}
    for _, block in blocks_of(text, longest):
        left = [w for w, _, _ in block]
        for _ in range(len(block)):  # a block may hold several notices; each round takes one out
            hits = []
            for n, (reduction, k) in enumerate(reductions(left, prepared)):
                if hits and n % TRIED == 0:
                    break
                name, words, _ = prepared[k]
                low, high, different, said = wording(left, words)
                if high > low and different <= MOST_DIFFERENT * len(words):
                    hits.append((different / len(words), -len(words), low, high, name, different, said, reduction))
            if not hits:
                break
            _, _, low, high, name, different, said, reduction = min(hits)
            found[(name, block[low][1])] = (name, block[low][1], block[high - 1][2], different, said, reduction)
            left[low:high] = ["\0"] * (high - low)
    return sorted(found.values(), key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per notice found: doc_id, license, start, length (characters of the whole text), n_different,
    differences, reduction.

    A null or empty text has none. Rows with equal ids are scanned each. Very long texts are scanned whole, in
    windows. Extra columns are left out; no rows give no rows.
    """
    chosen = tuple((templates or TEMPLATES).items())
    schema = "doc_id long, license string, start long, length long, n_different int, differences array<string>, " \
             "reduction double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for f in find_licenses(t, chosen)]
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in rows], pa.int64()), pa.array([f[0] for _, f in rows], pa.string()),
                pa.array([f[1] for _, f in rows], pa.int64()), pa.array([f[2] - f[1] for _, f in rows], pa.int64()),
                pa.array([f[3] for _, f in rows], pa.int32()), pa.array([f[4] for _, f in rows], pa.list_(pa.string())),
                pa.array([f[5] for _, f in rows], pa.float64())],
                ["doc_id", "license", "start", "length", "n_different", "differences", "reduction"])

    cued = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(
        F.col("text").rlike(CUE))
    return cued.mapInArrow(run, schema)
