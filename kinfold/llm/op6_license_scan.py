"""Operator 6: licence texts found by a positional index of rare words.

The index holds, for each template's words of highest IDF (over all scanned documents), the template and the word's place in
it. Every occurrence of such a word in a file votes for (template, place in the file less place in the template); a template
is a candidate where most of its rare words agree on one relative place. A candidate counts if the template's mandatory key
phrases stand where that place puts them.

Plan. Two reads of the text without a shuffle: one counts documents for each template word (a few hundred rows to the
driver, whatever the input), one scans. The index is broadcast; its size is that of the templates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import LOWER_ALNUM, pieces, within, words_of

RARE_WORDS = 6
AGREE = 0.75


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


#: Phrases that name a licence by themselves.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Paragraphs of public licences as their texts have them.
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""
MIT_WARRANTY = """The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of
merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or
other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in
the software."""
BSD_CONDITIONS = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution."""
BSD_WARRANTY = """In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential
damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused
and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this
software, even if advised of the possibility of such damage."""
APACHE_WARRANTY = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
the License."""
APACHE_GRANT = """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge,
royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work
and such Derivative Works in Source or Object form."""
GPL_WARRANTY = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
GPL_PREAMBLE = """The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other
practical works are designed to take away your freedom to share and change the works."""
ISC_WARRANTY = """The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever
resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use
or performance of this software."""

#: Openings of public licences, usual notices and the paragraphs above, with the phrases that must stand in them.
TEMPLATES = (
    Template("mit", MIT_GRANT, ("permission is hereby granted", "without restriction")),
    Template("mit", MIT_WARRANTY, ("without warranty of any kind", "authors or copyright holders")),
    Template("bsd", BSD_CONDITIONS, ("redistributions of source code", "redistributions in binary form")),
    Template("bsd", BSD_WARRANTY, ("procurement of substitute goods", "theory of liability")),
    Template("apache", APACHE_WARRANTY, ("applicable law", "permissions and limitations under the license")),
    Template("apache", APACHE_GRANT, ("each contributor hereby grants", "derivative works")),
    Template("gpl", GPL_WARRANTY, ("without any warranty", "gnu general public license")),
    Template("gpl", GPL_PREAMBLE, ("free copyleft license",)),
    Template("isc", ISC_WARRANTY, ("author disclaims all warranties", "tortious action")),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("in compliance with the license",)),
    Template("gpl", "This work is licensed under the GNU General Public License", ("gnu general public license",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("affero general public license",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work", ("waived all copyright",)),
    Template("proprietary", "All rights reserved. No part of this publication may be reproduced", ("all rights reserved", "may be reproduced")),
)


def words(text: str) -> list[str]:
    return text.encode().translate(LOWER_ALNUM).decode().split()


class Index:
    """Codes of the template words, and the postings of the rare ones."""

    def __init__(self, templates: tuple[Template, ...], base: tuple[tuple[str, str], ...]):
        self.templates, self.base = templates, base
        self.vocabulary = sorted({w for t in templates for w in words(t.text)} | {w for t in templates for k in t.keys for w in words(k)} | {w for p, _ in base for w in words(p)})
        self.code = {w: i for i, w in enumerate(self.vocabulary)}
        self.bodies = [self._codes(t.text) for t in templates]
        self.keys = [[(self._place(t, k), self._codes(k)) for k in t.keys] for t in templates]
        self.phrases = [(self._codes(p), label) for p, label in base]
        self.rare: list[np.ndarray] = []

    def _codes(self, text: str) -> np.ndarray:
        return np.array([self.code[w] for w in words(text)], np.int32)

    def _place(self, t: Template, key: str) -> int:
        body, k = words(t.text), words(key)
        return next(i for i in range(len(body)) if body[i : i + len(k)] == k)

    def weigh(self, documents: int, with_word: np.ndarray, rare: int) -> Index:
        idf = np.log((documents + 1) / (with_word + 1))
        for body in self.bodies:
            best = sorted(set(body.tolist()), key=lambda c: (-idf[c], c))[:rare]
            self.rare.append(np.flatnonzero(np.isin(body, best)))
        return self

    def coded(self, flat: pa.Array) -> np.ndarray:
        """Each word's code; -1 for words of no template."""
        return pc.fill_null(pc.index_in(flat, value_set=pa.array(self.vocabulary, flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int32)


def _at(codes: np.ndarray, place: np.ndarray, size: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand one after another within one text."""
    n = len(phrase)
    hit = np.flatnonzero(codes == phrase[0])
    hit = hit[place[hit] + n <= size[hit]]
    for j in range(1, n):
        hit = hit[codes[hit + j] == phrase[j]]
    return hit


def _spots(codes: np.ndarray, many: int) -> list[np.ndarray]:
    """For each code the words that have it."""
    hit = np.flatnonzero(codes >= 0)
    hit = hit[np.argsort(codes[hit], kind="stable")]
    return np.split(hit, np.searchsorted(codes[hit], np.arange(1, many)))


def _matches(index: Index, k: int, codes: np.ndarray, spots: list[np.ndarray], text: np.ndarray, starts: np.ndarray, agree: float) -> tuple[np.ndarray, np.ndarray]:
    """Texts in which template k stands, and what share of its words is in place."""
    body, rare = index.bodies[k], index.rare[k]
    votes = np.concatenate([spots[body[q]] - q for q in rare])
    owner = np.concatenate([text[spots[body[q]]] for q in rare])
    if not len(votes):
        return votes, votes.astype(float)
    shift = len(body) + 1  # a template may begin before the text does, never in another text
    value, count = np.unique(owner * np.int64(len(codes) + 2 * shift) + votes + shift, return_counts=True)
    value = value[count >= agree * len(rare)]
    owner, begin = value // (len(codes) + 2 * shift), value % (len(codes) + 2 * shift) - shift
    lo, hi = starts[owner], starts[owner + 1]
    good = np.ones(len(owner), bool)
    for at, key in index.keys[k]:
        for j, c in enumerate(key):
            spot = begin + at + j
            inside = (spot >= lo) & (spot < hi)
            good &= inside & (codes[np.where(inside, spot, lo)] == c)
    owner, begin, lo, hi = owner[good], begin[good], lo[good], hi[good]
    share = np.zeros(len(owner))
    for j, c in enumerate(body):
        spot = begin + j
        inside = (spot >= lo) & (spot < hi)
        share += inside & (codes[np.where(inside, spot, lo)] == c) if len(codes) else 0
    return owner, share / len(body)


def scanned(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE, rare: int = RARE_WORDS, agree: float = AGREE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row (columns doc_id, text; others are ignored).

    Words are runs of ASCII letters, digits and non-ASCII, after A-Z are lower-cased. n_base counts the places where a base phrase's words
    stand one after another; first_word and last_word are the smallest and largest of their starts, null without any. labels has the
    templates' labels too. score is the largest share of a template's words that stand in place, at least 0.5 with a base phrase
    and 0 without any label. Null and empty texts have no words, no labels (empty strings) and score 0; repeated rows and null ids
    are rows like others.
    """
    spark, index = documents.sparkSession, Index(templates, base)
    texts = documents.select("doc_id", "text")
    many = len(index.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(many + 1, np.int64), 0
        for piece in pieces(batches, "text"):
            flat, starts = words_of(piece.column("text"), LOWER_ALNUM)
            codes = index.coded(flat)
            hit = np.flatnonzero(codes >= 0)
            text = np.searchsorted(starts, hit, side="right") - 1
            total[:many] += np.bincount(np.unique(text * np.int64(many) + codes[hit]) % many, minlength=many)
            n += piece.num_rows
        total[many] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(many + 1)), pa.array(total)], names=["i", "n"])

    with_word = np.zeros(many + 1)
    for r in texts.select("text").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        with_word[r.i] = r.n
    index.weigh(int(with_word[many]), with_word[:many], rare)
    shared = spark.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for piece in pieces(batches, "text"):
            flat, starts = words_of(piece.column("text"), LOWER_ALNUM)
            codes, n = index.coded(flat), piece.num_rows
            text, place = within(starts)
            size, spots = np.diff(starts), _spots(codes, len(index.vocabulary))
            base_labels: list[set[str]] = [set() for _ in range(n)]
            labels: list[set[str]] = [set() for _ in range(n)]
            n_base, score = np.zeros(n, np.int64), np.zeros(n)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            for phrase, label in index.phrases:
                hit = _at(codes, place, size[text], phrase)
                of = text[hit]
                n_base += np.bincount(of, minlength=n)
                np.minimum.at(first, of, place[hit])
                np.maximum.at(last, of, place[hit])
                score[of] = 0.5
                for i in set(of.tolist()):
                    base_labels[i].add(label)
            for k, t in enumerate(index.templates):
                of, share = _matches(index, k, codes, spots, text, starts, agree)
                np.maximum.at(score, of, share)
                for i in set(of.tolist()):
                    labels[i].add(t.label)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"), pa.array(size), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                    pa.array([",".join(sorted(b)) for b in base_labels], pa.string()),
                    pa.array([",".join(sorted(b | a)) for a, b in zip(labels, base_labels, strict=True)], pa.string()), pa.array(np.minimum(score, 1.0)),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return texts.mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
