"""Licence scans by conditional compression.

A candidate block is a part of a paragraph that shares a tell-tale word with
the templates: the words that would be a template's around it, a line, or one
of overlapping windows of several sizes, so that a notice of any length lies in
a block not much longer. A block is compressed alone and with
each template as a zstandard raw dictionary; templates are ranked by the bytes
they save, and the best are confirmed by the exact wording that differs.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping, Sequence
from difflib import SequenceMatcher
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

# Usual wordings of licence notices, by licence.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "all-rights-reserved": ["All rights reserved."],
}

#: Share of a template's words that a notice must hold in order, and of words between them that the template lacks, at most.
SHARED = 0.8
BETWEEN = 0.4

_WORD = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")
_MARKS = re.compile(r"[^\w\s]*")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _telltale(words: Sequence[str], shared: float) -> set[str]:
    """The longest words of a template, so many that any text with the share of its words in it has one of them."""
    may_lack = len(words) - ceil(shared * len(words) - 1e-9)
    out: set[str] = set()
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(w in out for w in words) > may_lack:
            break
        out.add(word)
    return out


class LicenceScanner:
    """Templates with their dictionaries; scan() gives a text's confirmed licence blocks."""

    def __init__(self, templates: Mapping[str, list[str]], shared: float = SHARED, between: float = BETWEEN):
        import ahocorasick
        import zstandard

        self.shared, self.between = shared, between
        self.templates = [(name, text, _words(text)) for name, texts in sorted(templates.items()) for text in texts]
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, _, words in self.templates]
        self.tell = ahocorasick.Automaton()
        #: Each template's tell-tale words; a block without one can't hold it.
        self.told_by = [_telltale(words, shared) for _, _, words in self.templates]
        for word in set().union(*self.told_by):
            # (words before it, words) of the templates that have it.
            self.tell.add_word(word, sorted({(at, len(words)) for _, _, words in self.templates for at, w in enumerate(words) if w == word}))
        self.tell.make_automaton()
        #: Words that a notice may span: from twice the shortest template's to more than twice the longest's.
        sizes = [len(words) for _, _, words in self.templates] or [1]
        self.reaches = [2 * min(sizes)]
        while self.reaches[-1] < 2 * max(sizes):
            self.reaches.append(2 * self.reaches[-1])
        self.kept: dict[str, dict | None] = {}

    def tells(self, text: str) -> bool:
        return next(self.tell.iter(text.lower()), None) is not None

    def judge(self, block: str) -> dict | None:
        """The licence of a block of words with its saved bytes and the words that differ; None if no template is confirmed."""
        words = block.split(" ")
        here = set(words)
        data = block.encode()
        alone = len(self.plain.compress(data))
        saved = {i: alone - len(c.compress(data)) for i, c in enumerate(self.given) if not here.isdisjoint(self.told_by[i])}
        ranked = sorted((i for i in saved if saved[i] > 0), key=lambda i: (-saved[i] / max(1, len(self.templates[i][2])) ** 0.5, i))
        best = None
        for i in ranked:
            name, _, wording = self.templates[i]
            need = self.shared * len(wording) - 1e-9
            if sum(w in here for w in wording) < need:
                continue
            matches = [m for m in SequenceMatcher(None, wording, words, autojunk=False).get_matching_blocks() if m.size]
            held = sum(m.size for m in matches)
            if held < need:
                continue
            # Words far off that match by chance are no part of the notice.
            for first, second, end in ((0, 1, 0), (-2, -1, -1)):
                while len(matches) > 1 and matches[second].b - matches[first].b - matches[first].size > 2 * matches[end].size and held - matches[end].size >= need:
                    held -= matches.pop(end).size
            missing, at = [], 0
            for m in matches:
                missing += wording[at : m.a]
                at = m.a + m.size
            missing += wording[at:]
            extra, at = [], matches[0].b
            for m in matches:
                extra += words[at : m.b]
                at = m.b + m.size
            if len(extra) > self.between * len(wording) + 1e-9:
                continue
            found = {"licence": name, "template": i, "saved": saved[i], "missing": missing, "extra": extra, "span": (matches[0].b, at), "rank": (len(missing) + len(extra) - held, -held, i)}
            if best is None or found["rank"] < best["rank"]:
                best = found
        return best

    def windows(self, n: int, hits: list[int]) -> Iterator[tuple[int, int]]:
        """(start, end) of windows over n words that hold one of hits; what spans up to one of the reaches lies in one of twice that."""
        for reach in self.reaches:
            last = -1
            for hit in hits:
                for k in range(max(last + 1, hit // reach - 1), hit // reach + 1):
                    if k * reach < n and (k == 0 or (k + 1) * reach < n):
                        yield k * reach, min(n, (k + 2) * reach)
                    last = k
            if 2 * reach >= n:
                break

    def notices(self, words: list[str], lines: Sequence[int] = ()) -> list[dict]:
        """Confirmed notices among a paragraph's words, at separate spans in order; lines are the words that begin one."""
        block = " ".join(words)
        starts = [0]
        for word in words:
            starts.append(starts[-1] + len(word) + 1)
        told = [(bisect_right(starts, end) - 1, places) for end, places in self.tell.iter(block)]
        hits = sorted({hit for hit, _ in told})
        blocks = {(hit - before, hit - before + n) for hit, places in told for before, n in places if before <= hit <= len(words) - n + before}
        for hit in hits:
            k = bisect_right(lines, hit)
            line = (lines[k - 1] if k else 0, lines[k] if k < len(lines) else len(words))
            if line[1] - line[0] <= 2 * self.reaches[-1]:
                blocks.add(line)
        found = []
        for start, end in sorted(blocks | set(self.windows(len(words), hits)), key=lambda b: (b[1] - b[0], b)):
            one = self.look(block[starts[start] : starts[end] - 1])
            if one:
                found.append(one | {"span": (start + one["span"][0], start + one["span"][1])})
        # Found in several windows: the smallest that shows it has come first.
        out: list[dict] = []
        for one in sorted(found, key=lambda f: f["rank"]):
            k = bisect_left(out, one["span"], key=lambda f: f["span"])
            if (k == 0 or out[k - 1]["span"][1] <= one["span"][0]) and (k == len(out) or one["span"][1] <= out[k]["span"][0]):
                out.insert(k, one)
        # A block gives its best notice only: the words outside of those found are looked at again.
        ends = [0, *(one["span"][1] for one in out)] if out else []
        rest = [(start, end) for start, end in zip(ends, [*(one["span"][0] for one in out), len(words)]) if start < end]
        for start, end in rest:
            for one in self.notices(words[start:end], [k - start for k in lines if start < k < end]):
                out.append(one | {"span": (start + one["span"][0], start + one["span"][1])})
        return sorted(out, key=lambda f: f["span"])

    def scan(self, text: str) -> list[tuple[int, int, dict]]:
        """(start, end, finding) of each licence notice, from its first word to its last with the marks after it."""
        out, at = [], 0
        if not self.tells(text):
            return out
        for paragraph in re.split(r"(\n[ \t]*\n)", text):
            if self.tells(paragraph):
                places = list(_WORD.finditer(paragraph))
                begins = [m.end() for m in re.finditer(r"\r\n|[\r\n]", paragraph)]
                lines = sorted({bisect_left(places, x, key=re.Match.start) for x in begins} - {0, len(places)})
                for found in self.notices([m.group().lower() for m in places], lines):
                    first, end = found["span"]
                    out.append((at + places[first].start(), at + _MARKS.match(paragraph, places[end - 1].end()).end(), found))
            at += len(paragraph)
        return out

    def look(self, block: str) -> dict | None:
        if len(block) > 2000:
            return self.judge(block)
        if block not in self.kept:
            if len(self.kept) >= 50_000:
                self.kept.clear()
            self.kept[block] = self.judge(block)
        return self.kept[block]


def scan_licences(documents: DataFrame, templates: Mapping[str, list[str]] = TEMPLATES, shared: float = SHARED, between: float = BETWEEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, licence, saved_bytes, missing, extra, exact): one row per confirmed licence notice.

    start and end are character positions of the notice; missing are the
    template's words that it lacks, extra those between its matches that the
    template lacks. A notice holds the share ``shared`` of its template's words in
    order, and of other words between them no more than ``between`` times the
    template's; notices of one line or paragraph have a row each. Whole
    texts are scanned, whatever the length of their lines;
    a notice lies in one paragraph, its words within more than twice the longest
    template's. Null and empty texts have no row; repeated rows repeat their
    notices; of templates that fit at one place the one with the most words in
    common less those that differ, then the one that holds most words, then the first counts. An empty table gives
    no rows. Other columns are not read.
    """
    key = hash((tuple((k, tuple(v)) for k, v in sorted(templates.items())), shared, between))
    templates = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = worker_cache(f"licences-{key}", lambda: LicenceScanner(templates, shared, between))
        for batch in batches:
            rows = [(i, start, end, f) for i, text in enumerate(batch.column(1)) if (t := text.as_py()) for start, end, f in scanner.scan(t)]
            columns = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
            columns += [pa.array([r[3]["licence"] for r in rows], pa.string()), pa.array([r[3]["saved"] for r in rows], pa.int32())]
            columns += [pa.array([r[3][k] for r in rows], pa.list_(pa.string())) for k in ("missing", "extra")]
            columns.append(pa.array([not r[3]["missing"] and not r[3]["extra"] for r in rows], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "end", "licence", "saved_bytes", "missing", "extra", "exact"])

    schema = f"doc_id {documents.schema[id_col].dataType.simpleString()}, start long, end long, licence string, saved_bytes int, missing array<string>, extra array<string>, exact boolean"
    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
