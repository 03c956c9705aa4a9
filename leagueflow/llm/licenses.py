"""License scan with a positional index of rare words.

Each template is a known licence text or notice. Its postings are its words of
highest IDF, with their positions; the IDF comes from the document frequencies
of all licence words over all documents. In a file, every occurrence of such a
word votes for the shifts at which the template would put the word there.
Votes of enough different words for (nearly) one shift make a candidate. A
candidate holds when every mandatory key phrase of the template stands in the
aligned stretch of the file and the stretch has enough of the template's words.

Besides that, the four base phrases are counted wherever their words stand
consecutively.

Defined results for odd input: null and empty texts have no words, no places
and no labels; repeated rows each get their row; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leagueflow.llm.common import table
from leagueflow.llm.tokens import slices, words

#: Phrases and labels that are counted everywhere.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]


#: Notices and opening clauses of public licences, with the phrases that must not be missing.
TEMPLATES = (
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
        "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license version 2",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    Template(
        "gpl-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ("terms of the gnu general public license", "any later version"),
    ),
    Template(
        "lgpl-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        ("gnu lesser general public license", "any later version"),
    ),
    Template(
        "agpl-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu affero general public license", "any later version"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
        ("redistribution and use in source and binary forms", "conditions are met"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at https://mozilla.org/MPL/2.0/.",
        ("mozilla public license v 2 0",),
    ),
    Template("cc-by-4.0", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software", "public domain"),
    ),
)

#: Words of highest IDF that make a template's postings.
RARE_WORDS = 8
#: Share of a template's rare words that must vote for one shift.
VOTES = 0.5
#: Votes whose shifts differ by no more than this are one alignment.
DRIFT = 2
#: Share of a template's words that the aligned stretch must have.
LEAST_SHARE = 0.6

#: Letters to lower case, ASCII that is neither letter nor digit to a blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else 32 for c in range(256))


def _words(text: str) -> list[str]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).decode("utf-8", "surrogatepass").split()


#: All words of the templates and phrases; the number of a word is its place.
VOCABULARY = sorted({w for t in TEMPLATES for x in (t.text, *t.phrases) for w in _words(x)} | {w for p, _ in BASE_PHRASES for w in _words(p)})
_NUMBER = {w: i for i, w in enumerate(VOCABULARY)}


def numbers(text: str) -> np.ndarray:
    return np.array([_NUMBER[w] for w in _words(text)], np.int64)


@dataclass
class Stretch:
    """Words of a column of texts: number in the vocabulary or -1, text, and place in the text."""

    word: np.ndarray
    row: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray


def file_words(column: pa.Array) -> Stretch:
    plain = [None if t is None else t.encode("utf-8", "surrogatepass").translate(_PLAIN) for t in column.to_pylist()]
    coded, dictionary, sizes = words(pa.array(plain, pa.binary()).cast(pa.string()))
    known = pc.fill_null(pc.index_in(dictionary, value_set=pa.array(VOCABULARY)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    word = known[coded] if len(coded) else np.zeros(0, np.int64)
    return Stretch(word, np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes, sizes)


def phrase_places(s: Stretch, phrase: np.ndarray) -> np.ndarray:
    """Where the words of the phrase stand consecutively in one text."""
    n = len(s.word) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(s.word[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[s.word[at + k] == phrase[k]]
    return at[s.row[at] == s.row[at + len(phrase) - 1]]


class Index:
    """Postings of the rare words of all templates."""

    def __init__(self, frequencies: dict[int, int], documents: int, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        self.words = [numbers(t.text) for t in templates]
        self.phrases = [[numbers(p) for p in t.phrases] for t in templates]
        idf = {w: math.log((documents + 1) / (frequencies.get(w, 0) + 1)) for w in range(len(VOCABULARY))}
        self.needed, word, template, place = [], [], [], []
        for k, ws in enumerate(self.words):
            rare = sorted(set(ws.tolist()), key=lambda w: (-idf[w], w))[:RARE_WORDS]
            self.needed.append(max(2, math.ceil(VOTES * len(rare))))
            for p, w in enumerate(ws.tolist()):
                if w in rare:
                    word.append(w)
                    template.append(k)
                    place.append(p)
        order = np.argsort(word, kind="stable")
        self.posting_word, self.posting_template, self.posting_place = (np.array(x, np.int64)[order] for x in (word, template, place))

    def candidates(self, s: Stretch) -> list[tuple[int, int, int, int]]:
        """Text, template, and lowest and highest shift (as a place in the stretch) of each alignment with enough votes."""
        first = np.searchsorted(self.posting_word, s.word, "left")
        count = np.where(s.word >= 0, np.searchsorted(self.posting_word, s.word, "right") - first, 0)
        at = np.repeat(np.arange(len(s.word)), count)
        if not len(at):
            return []
        posting = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + first[at]
        row, template = s.row[at], self.posting_template[posting]
        shift = at - self.posting_place[posting]
        order = np.lexsort((shift, template, row))
        row, template, shift, word = row[order], template[order], shift[order], s.word[at][order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (template[1:] != template[:-1]) | (shift[1:] - shift[:-1] > DRIFT)
        group = np.cumsum(new) - 1
        votes = np.bincount(np.unique(group * len(VOCABULARY) + word) // len(VOCABULARY))
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(row)) - 1
        use = np.flatnonzero(votes >= np.array(self.needed)[template[begins]])
        return [(int(row[begins[g]]), int(template[begins[g]]), int(shift[begins[g]]), int(shift[ends[g]])) for g in use]

    def share(self, s: Stretch, row: int, template: int, low: int, high: int) -> float:
        """Share of the template's words in the aligned stretch; 0 without a mandatory phrase."""
        begin, end = int(s.begins[row]), int(s.begins[row] + s.sizes[row])
        a, b = max(begin, low - DRIFT), min(end, high + len(self.words[template]) + DRIFT)
        part = Stretch(s.word[a:b], s.row[a:b], s.begins, s.sizes)
        if any(not len(phrase_places(part, p)) for p in self.phrases[template]):
            return 0.0
        want, have = Counter(self.words[template].tolist()), Counter(part.word.tolist())
        return sum(min(n, have[w]) for w, n in want.items()) / len(self.words[template])


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[dict[int, int], int]:
    """In how many documents each word of the vocabulary stands (over all documents), and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(VOCABULARY) + 1, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                s = file_words(part.column(0))
                known = s.word >= 0
                pairs = np.unique(s.row[known] * len(VOCABULARY) + s.word[known])
                total[:-1] += np.bincount(pairs % len(VOCABULARY), minlength=len(VOCABULARY))
                total[-1] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["word", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counted.collect()}  # one row per word of the vocabulary
    return {w: n for w, n in found.items() if w < len(VOCABULARY)}, found.get(len(VOCABULARY), 0)


SCAN_COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``docs`` without the text and with the columns of the scan, which replace columns of those names."""
    index = Index(*document_frequencies(docs, text), templates)
    base = [(numbers(p), label) for p, label in BASE_PHRASES]
    added = [c.split()[0] for c in SCAN_COLUMNS.split(", ")]
    keep = [c for c in docs.columns if c not in added and c != text]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keep)):
                s = file_words(part.column(len(keep)))
                n = len(s.sizes)
                count = np.zeros(n, np.int64)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base_labels: list[set[str]] = [set() for _ in range(n)]
                best = np.zeros(n)
                for phrase, label in base:
                    at = phrase_places(s, phrase)
                    row = s.row[at]
                    place = at - s.begins[row]
                    count += np.bincount(row, minlength=n)
                    np.minimum.at(first, row, place)
                    np.maximum.at(last, row, place)
                    for r in np.unique(row).tolist():
                        base_labels[r].add(label)
                best[count > 0] = 1.0
                labels = [set(x) for x in base_labels]
                for row, template, low, high in index.candidates(s):
                    share = index.share(s, row, template, low, high)
                    if share >= LEAST_SHARE:
                        labels[row].add(index.templates[template].label)
                        best[row] = max(best[row], share)
                none = count == 0
                columns = [pa.array(s.sizes.astype(np.int64)), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none)]
                columns += [pa.array([",".join(sorted(x)) for x in found], pa.string()) for found in (base_labels, labels)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns, pa.array(best)], [*part.schema.names[: len(keep)], *added])

    kinds = ", ".join([*(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep))), SCAN_COLUMNS])
    return rows.mapInArrow(run, kinds).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *added)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
