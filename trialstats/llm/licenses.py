"""License scan by conditional compression.

A candidate block is the neighbourhood of licensing words, across line ends. In a block, each licensing word is laid on
the same word of each template, which gives a window of the template's length and the words that may differ. A window
is compressed alone and with its template as a zstandard raw-content dictionary, so what stands around a notice does
not matter; templates that make it smaller are confirmed on their wording: template and window are aligned word by
word; numbers and license-naming words must agree, and at most ``DIFFERENT`` of the template's words may be missing or
added. Of overlapping notices the best one stays, so a block may hold several.

Cases: a null or empty text has no block; a block that no template explains stays unconfirmed and is counted;
repeated rows are handled row by row.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.common import table

LEVEL = 19
#: a template explains a window if it saves this share of its size
LEAST_GAIN = 0.2
DIFFERENT = 0.2
#: a block reaches this many characters around a cue
NEAR = 600
_CUE = re.compile(
    r"licen[sc]|copyright|rights[\W_]+(?:(?:dnl|rem)\s+)?reserved|permission|redistribut|warrant"
    r"|public[\W_]+(?:(?:dnl|rem)\s+)?domain|spdx|©", re.I)
_WORD = re.compile(r"[0-9]+(?:\.[0-9]+)*|[^\W\d_]+")
#: words that mark a comment line; other comment signs are no words
_COMMENT = re.compile(r"^[ \t]*(?:dnl|rem)(?=[ \t])", re.I | re.M)
#: words that tell one license from another
NAMING = frozenset(
    "affero agpl apache artistic attribution boost bsd cc eclipse eupl gnu gpl isc lesser lgpl library mit mozilla mpl nc "
    "nd noncommercial noderivatives noderivs sa sharealike unlicense zlib".split())

# fixed values: public license notices by identifier
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "released into the public domain under CC0 1.0"),
    ("all-rights-reserved", "All rights reserved"),
)

_NOTICE = T.StructType([
    T.StructField("license", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("gain", T.DoubleType()),
    T.StructField("missing", T.IntegerType()), T.StructField("added", T.IntegerType()),
])
_RESULT = T.StructType([T.StructField("candidates", T.IntegerType()), T.StructField("notices", T.ArrayType(_NOTICE))])


def blocks(text: str) -> list[tuple[int, int]]:
    """Candidate blocks of a text as spans: the neighbourhoods of cues, merged where they meet."""
    out: list[tuple[int, int]] = []
    for cue in _CUE.finditer(text):
        start, end = max(0, cue.start() - NEAR), min(len(text), cue.end() + NEAR)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def word_spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of the words between start and end, without words that mark comment lines."""
    marks = {m.end() for m in _COMMENT.finditer(text, start, end)}
    return [m.span() for m in _WORD.finditer(text, start, end) if m.end() not in marks]


def cues(text: str, spans: list[tuple[int, int]], start: int, end: int) -> Iterator[tuple[str, int]]:
    """Kind of each cue and the number of the word it stands in."""
    starts = [a for a, _ in spans]
    for cue in _CUE.finditer(text, start, end):
        k = bisect.bisect_right(starts, cue.start()) - 1
        if k >= 0 and cue.start() < spans[k][1]:
            yield cue[0][:5].lower(), k


class Scanner:
    def __init__(self, templates=TEMPLATES):
        import zstandard as z

        options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.alone = z.ZstdCompressor(**options)
        self.templates = []
        #: kind of cue to template and the cue's place in it
        self.places: dict[str, list[tuple[int, int]]] = {}
        for k, (name, wording) in enumerate(templates):
            spans = word_spans(wording, 0, len(wording))
            words = [wording[a:b].lower() for a, b in spans]
            d = z.ZstdCompressionDict(" ".join(words).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
            self.templates.append((name, words, z.ZstdCompressor(dict_data=d, **options)))
            for kind, place in cues(wording, spans, 0, len(wording)):
                self.places.setdefault(kind, []).append((k, place))
        self.seen: dict[tuple[int, str], tuple | None] = {}

    def tried(self, k: int, window: list[str]) -> tuple[float, tuple[int, int, int, int]] | None:
        """Gain of a template on a window and what ``confirm`` says, if the template makes the window smaller."""
        key = k, " ".join(window)
        if key not in self.seen:
            if len(self.seen) > 10_000:
                self.seen.clear()
            data, (_, words, compressor) = key[1].encode("utf-8", "replace"), self.templates[k]
            gain = 1 - len(compressor.compress(data)) / len(self.alone.compress(data))
            got = self.confirm(words, window) if gain >= LEAST_GAIN else None
            self.seen[key] = (gain, got) if got else None
        return self.seen[key]

    def confirm(self, words: list[str], block: list[str]) -> tuple[int, int, int, int] | None:
        """First and last matched block word, template words missing, words added between them."""
        pairs = [m for m in difflib.SequenceMatcher(None, words, block, autojunk=False).get_matching_blocks() if m.size]
        best = None
        # common words beside a notice match too, so the run of matches that differs least counts
        for i in range(len(pairs)):
            same = 0
            for m in pairs[i:]:
                same += m.size
                first, last = pairs[i].b, m.b + m.size
                missing, added = len(words) - same, last - first - same
                if best is None or missing + added < best[2] + best[3]:
                    best = first, last, missing, added, pairs[i : pairs.index(m) + 1]
        if best is None or best[2] + best[3] > DIFFERENT * len(words):
            return None
        first, last, missing, added, run = best
        ours, theirs = list(words), block[first:last]
        for m in reversed(run):
            del ours[m.a : m.a + m.size], theirs[m.b - first : m.b - first + m.size]
        if any(w in NAMING or w[0].isdigit() for w in ours + theirs):
            return None
        return first, last, missing, added

    def scan(self, text: str) -> tuple[int, list[dict]]:
        found, spans_of = [], blocks(text)
        for start, end in spans_of:
            spans = word_spans(text, start, end)
            words = [text[a:b].lower() for a, b in spans]
            fits = {}
            for kind, at in cues(text, spans, start, end):
                for k, place in self.places.get(kind, ()):
                    n = len(self.templates[k][1])
                    room = int(DIFFERENT * n)
                    low = max(0, at - place - room)
                    if got := self.tried(k, words[low : max(0, at - place + n + room)]):
                        gain, (first, last, missing, added) = got
                        # of equally fitting wordings the longer one says more
                        rank = (missing + added == 0, n, -missing - added, gain)
                        fits[low + first, low + last, k] = max(fits.get((low + first, low + last, k), (rank, missing, added)), (rank, missing, added))
            taken = bytearray(len(words))
            for (first, last, k), (rank, missing, added) in sorted(fits.items(), key=lambda f: (f[1][0], -f[0][0], -f[0][2]), reverse=True):
                if not any(taken[first:last]):
                    taken[first:last] = b"\1" * (last - first)
                    found.append({"license": self.templates[k][0], "start": spans[first][0], "end": spans[last - 1][1],
                                  "gain": rank[-1], "missing": missing, "added": added})
        return len(spans_of), sorted(found, key=lambda n: n["start"])


@F.arrow_udf(_RESULT)
def license_notices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Number of candidate blocks and confirmed notices of each text."""
    scanner = Scanner()
    notice = pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("gain", pa.float64()),
                        ("missing", pa.int32()), ("added", pa.int32())])
    kind = pa.struct([("candidates", pa.int32()), ("notices", pa.list_(notice))])
    for texts in batches:
        rows = [scanner.scan(t.as_py() or "") for t in texts]
        yield pa.array([{"candidates": n, "notices": found} for n, found in rows], kind)


def scan(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """doc_id, candidates and notices of each row of ``docs``."""
    return docs.select("doc_id", license_notices(F.col("text") if text is None else text).alias("found")).select(
        "doc_id", "found.candidates", "found.notices")


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "candidates", F.size("notices").alias("n_notices"),
        F.expr("concat_ws(',', array_sort(array_distinct(notices.license)))").alias("licenses"),
        F.expr("concat_ws(',', transform(notices, n -> concat(n.license, ':', n.start, ':', n.end, ':', n.missing, ':', n.added)))").alias("spans"))
