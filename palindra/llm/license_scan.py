"""License notices in texts by conditional compression.

A text is a run of words over all of its lines. Wherever a word begins that stands in
every notice (``CUES``), each template is laid so that one of its own such words falls
there, and compared with the words it covers and as many on either side as may be
changed. A notice counts if the differences of wording are few, no word that tells
licenses apart (a version, a condition such as ``nc``) differs, and zstandard makes the
words it covers enough smaller when the template is its raw dictionary. Of notices that
overlap, the one with the larger reduction is given.

All of a text is looked at, whatever the length of its lines: a notice may be wrapped
over lines or stand anywhere in a long one. ``line`` is where its first word stands.

Null and empty texts have no blocks. Rows that repeat give their rows each; the same
notice twice in a text gives two rows. An empty table gives no rows and no other
columns are returned.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common wordings of license notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "All-Rights-Reserved": ["All rights reserved."],
}
#: The words of a cue may be on two lines, with marks of a comment between.
CUES = "licen[sc]e|licensing|permission|permitted|copyright|public[^a-z0-9]+domain|redistribut|rights[^a-z0-9]+reserved|creative[^a-z0-9]+commons"
#: Words that must stand on both sides alike, besides all words with a digit.
TELLING = frozenset(
    "apache mit gnu lesser affero bsd mozilla mpl cc cc0 by sa nc nd attribution sharealike noncommercial noderivatives isc unencumbered clause".split()
)
#: Least reduction of the notice's compressed size, and most changed words to template words.
REDUCTION, CHANGED = 0.2, 0.25

_cue = re.compile(CUES, re.IGNORECASE)
_word = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*", re.IGNORECASE | re.ASCII)


def wording(text: str) -> tuple[list[str], list[tuple[int, int]], list[int]]:
    """Words, where each stands, and which of them begin a cue."""
    spans = [m.span() for m in _word.finditer(text)]
    begins = [a for a, _ in spans]
    cues = {max(bisect.bisect_right(begins, m.start()) - 1, 0) for m in _cue.finditer(text)}
    return [text[a:b].lower() for a, b in spans], spans, sorted(cues) if spans else []


def tells(word: str) -> bool:
    return word in TELLING or any(x.isdigit() for x in word)


@dataclass(frozen=True)
class Match:
    """The license of a notice, and how its wording differs from the template's."""

    license: str
    reduction: float
    missing: int
    extra: int
    differences: tuple[str, ...]


class Scanner:
    """Templates as dictionaries."""

    def __init__(self, templates: dict[str, list[str]]):
        self.templates = []
        for name, texts in sorted(templates.items()):
            for text in texts:
                words, _, cues = wording(text)
                self.templates.append((name, text, words, cues, int(CHANGED * len(words)), {w for w in words if tells(w)}))
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.coders = []
        for _, text, *_ in self.templates:
            raw = zstandard.ZstdCompressionDict(self._bytes(text), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.coders.append(zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.reduction = lru_cache(1 << 14)(self._reduction)

    @staticmethod
    def _bytes(text: str) -> bytes:
        return " ".join(text.lower().split()).encode("utf-8", "replace")

    def _reduction(self, block: str, k: int) -> float:
        """Of the block's compressed size by a template."""
        data = self._bytes(block)
        return 1 - len(self.coders[k].compress(data)) / max(len(self.plain.compress(data)), 1)

    @staticmethod
    def differs(want: list[str], have: list[str]) -> tuple[int, int, int, int, list[str]] | None:
        """First word of the template in ``have`` and the one after its last, words missing and
        added between them; None if too many or telling ones."""
        steps = difflib.SequenceMatcher(None, want, have, autojunk=False).get_opcodes()
        while steps and steps[0][0] == "insert":
            steps = steps[1:]  # what stands before and after the notice
        while steps and steps[-1][0] == "insert":
            steps = steps[:-1]
        missing, extra, differences = 0, 0, []
        for what, a, b, c, d in steps:
            if what == "equal":
                continue
            gone, new = want[a:b], have[c:d]
            missing, extra = missing + len(gone), extra + len(new)
            if any(tells(w) for w in gone + new):
                return None
            differences.append(f"-{' '.join(gone)} +{' '.join(new)}")
        if not steps or missing + extra > CHANGED * len(want):
            return None
        return steps[0][3], steps[-1][4], missing, extra, differences

    def notices(self, text: str) -> Iterator[tuple[int, int, Match, int, str]]:
        """First word, the one after the last, match, line and text, of all that are like a template."""
        have, spans, cues = wording(text)
        for k, (name, _, want, own, slack, telling) in enumerate(self.templates):
            for begin in sorted({i - j for i in cues for j in own}):
                lo, hi = max(begin - slack, 0), begin + len(want) + slack
                near = set(have[lo:hi])
                if not telling <= near or sum(w not in near for w in want) > slack:
                    continue
                found = self.differs(want, have[lo:hi])
                if found is None or found[0] >= found[1]:
                    continue
                a, b, missing, extra, differences = found
                block = " ".join(text[spans[lo + a][0] : spans[lo + b - 1][1]].split())
                reduction = self.reduction(block, k)
                if reduction >= REDUCTION:
                    yield lo + a, lo + b, Match(name, round(reduction, 6), missing, extra, tuple(differences)), text[: spans[lo + a][0]].count("\n"), block

    def scan(self, text: str) -> Iterator[tuple[int, Match, str]]:
        """Line, match and text of each notice."""
        begins, taken = [], []
        best = sorted(self.notices(text), key=lambda x: (-x[2].reduction, x[0], -x[1]))
        for one in best:
            at = bisect.bisect_left(begins, one[0])
            if (at and taken[at - 1][1] > one[0]) or (at < len(taken) and taken[at][0] < one[1]):
                continue
            begins.insert(at, one[0])
            taken.insert(at, one)
        for _, _, found, line, block in taken:
            yield line, found, block


@lru_cache(1)
def _default_scanner() -> Scanner:
    return Scanner(TEMPLATES)


SCHEMA = "doc_id bigint, line int, license string, reduction double, missing int, extra int, differences array<string>, block string"


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every notice found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _default_scanner() if templates is None else Scanner(templates)
        for batch in batches:
            hit = pc.fill_null(pc.match_substring_regex(batch.column(1), CUES, ignore_case=True), False)
            some = batch.filter(hit)
            rows = [
                (k, line, m.license, m.reduction, m.missing, m.extra, list(m.differences), block)
                for k, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist())
                for line, m, block in scanner.scan(t)
            ]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
