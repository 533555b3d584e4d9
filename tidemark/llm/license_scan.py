"""Licence scan: a positional index of rare template words, over every whole text.

1. Words of templates and phrases form a small fixed vocabulary. Their document
   frequencies are counted over all documents (one partial count a batch).
2. Each template is anchored at its places of highest IDF, as many as any start
   with `least` of its words must hit `votes` times. So no start is lost, whatever
   else a text holds, and the most frequent words look nothing up.
3. Anchor postings (template, position) and file positions intersect by relative
   position: places that agree on one start of one template vote for it.
4. A start with enough votes stands if every mandatory key phrase of the template
   occurs, its words consecutive, within `slack` words of its relative position.
   The score is the share of template words found at their relative positions.

Base phrases are matched everywhere, apart from the index, and their labels stay.

Cases: null and empty texts have no words, no labels and score 0; repeated rows
are scanned apart; ids may be null; texts of any length are scanned whole.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import BYTE_CODES, chunks, rolling, split_words, text_buffer

# --- fixed values: phrases of the base rule ---
BASE_PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
# --- fixed values: public licence statements (label, text, mandatory key phrases) ---
TEMPLATES = [
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ["permission is hereby granted", "free of charge", "without restriction"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2"]),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["in compliance with the license", "apache org licenses"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license"]),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu general public license", "free software foundation", "version 3"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee", "hereby granted"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["attribution noncommercial"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution", "international license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ["permission is hereby granted", "merge publish distribute sublicense", "without warranty of any kind"]),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ["redistributions of source code", "redistributions in binary form"]),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ["gnu general public license", "free software foundation", "version 2"]),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu affero general public license"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ["in no event will the authors be held liable"]),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0.", ["boost software license"]),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["eclipse public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["free and unencumbered software"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["attribution sharealike"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["related or neighboring rights"]),
]
# --- end of fixed values ---

MIN_VOTES = 2
MIN_SCORE = 0.6
SLACK = 3
CHUNK_BYTES = 1 << 19

WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x41:0x5B] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words_of(text: str) -> list[str]:
    """The word rule on one short text."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends, _ = split_words(raw, np.array([0, len(raw)]), WORD_BYTES)
    low = LOWER[raw].tobytes()
    return [low[a:b].decode() for a, b in zip(starts, ends, strict=True)]


class Index:
    """Vocabulary, phrases and postings of the templates."""

    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES):
        self.labels = [x[0] for x in templates]
        self.texts = [words_of(x[1]) for x in templates]
        keys = [[words_of(p) for p in x[2]] for x in templates]
        base = {label: words_of(p) for label, p in phrases.items()}
        self.vocabulary = sorted({w for ws in [*self.texts, *(p for k in keys for p in k), *base.values()] for w in ws})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.texts = [[number[w] for w in ws] for ws in self.texts]
        self.keys = [[[number[w] for w in p] for p in k] for k in keys]
        self.base = {label: [number[w] for w in p] for label, p in base.items()}
        self.postings = defaultdict(list)
        for t, ws in enumerate(self.texts):
            for q, w in enumerate(ws):
                self.postings[w].append((t, q))
        # a key phrase stands at its first place in the template; one that isn't in it may stand anywhere around it
        self.places = [[next((q for q in range(len(ws)) if ws[q : q + len(p)] == p), None) for p in k] for ws, k in zip(self.texts, self.keys, strict=True)]
        raws = [w.encode() for w in self.vocabulary]
        blob = np.frombuffer(b"".join(raws), dtype=np.uint8)
        length = np.array([len(r) for r in raws])
        at = np.cumsum(length) - length
        codes = rolling(BYTE_CODES[blob])(at, at + length)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        self.length = length
        self.letters = np.zeros((len(raws), int(length.max())), dtype=np.uint8)
        for i, r in enumerate(raws):
            self.letters[i, : len(r)] = list(r)

    def numbers(self, raw: np.ndarray, offsets: np.ndarray):
        """(vocabulary number or -1, document) of each word; hash hits are confirmed letter by letter."""
        low = LOWER[raw]
        starts, ends, doc = split_words(raw, offsets, WORD_BYTES)
        number = np.full(len(starts), -1, dtype=np.int32)
        if not len(starts):
            return number, doc
        codes = rolling(BYTE_CODES[low])(starts, ends)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = np.flatnonzero(self.codes[at] == codes)
        word = self.order[at[hit]]
        equal = self.length[word] == (ends - starts)[hit]
        for j in range(self.letters.shape[1]):
            live = equal & (self.length[word] > j)
            equal[live] = low[starts[hit[live]] + j] == self.letters[word[live], j]
        number[hit[equal]] = word[equal]
        return number, doc


def _frequencies(index: Index):
    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column("_t"))
            held = np.zeros(len(index.vocabulary), dtype=np.int64)
            for lo, hi in chunks(offsets, CHUNK_BYTES):
                o = offsets[lo : hi + 1]
                number, doc = index.numbers(raw[o[0] : o[-1]], o - o[0])
                known = number >= 0
                held += np.bincount(np.unique(doc[known] * len(held) + number[known]) % len(held), minlength=len(held))
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(held[at], len(offsets) - 1))], names=["w", "n"])

    return run


def anchors(index: Index, idf: dict[int, float], votes: int, least: float) -> list[tuple[int, int, int]]:
    """(word, template, position) of each template's anchors: without all but `votes` - 1 of them no start reaches `least`."""
    out = []
    for t, text in enumerate(index.texts):
        needed = max(math.ceil(least * len(text) - 1e-9), 1)
        # a word that no document holds can't be found, but counts as a place
        rarest = sorted(range(len(text)), key=lambda q: (-idf.get(text[q], math.inf), text[q], q))
        out += [(text[q], t, q) for q in rarest[: len(text) - needed + min(votes, needed)]]
    return sorted(out)


def _starts(index: Index, posts: np.ndarray, cut: np.ndarray, number: np.ndarray, doc: np.ndarray, votes: int, least: float):
    """(document, template, start, score) of all starts with `votes` anchors and `least` of the words; starts are places in `number`."""
    at = np.flatnonzero(number >= 0)
    lo, n = cut[number[at]], cut[number[at] + 1] - cut[number[at]]
    which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)
    at = np.repeat(at, n)
    longest = max(map(len, index.texts), default=0)
    span, kinds = len(number) + longest, len(index.texts)
    key, found = np.unique((doc[at] * kinds + posts[which, 1]) * span + at - posts[which, 2] + longest, return_counts=True)
    owner, start = key // span, key % span - longest
    for t, text in enumerate(index.texts):
        mine = np.flatnonzero((owner % kinds == t) & (found >= min(votes, len(text))))
        equal = np.zeros(len(mine), dtype=np.int64)
        for q, w in enumerate(text):
            place = start[mine] + q
            inside = (place >= 0) & (place < len(number))
            place = np.where(inside, place, 0)
            equal += inside & (number[place] == w) & (doc[place] == owner[mine] // kinds)
        score = equal / max(len(text), 1)
        for i in np.flatnonzero(score >= least).tolist():
            yield int(owner[mine[i]] // kinds), t, int(start[mine[i]]), float(score[i])


def _verified(index: Index, own: np.ndarray, t: int, start: int, slack: int) -> bool:
    """Whether each key phrase of template t, laid at `start` of a document's word numbers, occurs near its place."""
    for phrase, q in zip(index.keys[t], index.places[t], strict=True):
        around = range(start - slack, start + len(index.texts[t]) + slack) if q is None else range(start + q - slack, start + q + slack + 1)
        if not any(p >= 0 and own[p : p + len(phrase)].tolist() == phrase for p in around):
            return False
    return True


def _scan(index: Index, idf: dict[int, float], votes: int, least: float, slack: int):
    posts = np.array(anchors(index, idf, votes, least), dtype=np.int64).reshape(-1, 3)
    cut = np.searchsorted(posts[:, 0], np.arange(len(index.vocabulary) + 1))

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column("_t"))
            n = len(offsets) - 1
            total = np.zeros(n, dtype=np.int64)
            base: dict[int, list[tuple[int, str]]] = defaultdict(list)
            labels: dict[int, dict[str, float]] = defaultdict(dict)
            for lo, hi in chunks(offsets, CHUNK_BYTES):
                o = offsets[lo : hi + 1]
                number, doc = index.numbers(raw[o[0] : o[-1]], o - o[0])
                size = np.bincount(doc, minlength=hi - lo)
                first = np.cumsum(size) - size
                total[lo:hi] = size
                for label, phrase in index.base.items():
                    if len(number) >= len(phrase):
                        last = len(number) - len(phrase) + 1
                        hit = doc[:last] == doc[len(phrase) - 1 :]
                        for j, w in enumerate(phrase):
                            hit &= number[j : last + j] == w
                        for i in np.flatnonzero(hit).tolist():
                            base[lo + int(doc[i])].append((i - int(first[doc[i]]), label))
                for d, t, start, score in _starts(index, posts, cut, number, doc, votes, least):
                    label = index.labels[t]
                    if score > labels[lo + d].get(label, 0.0) and _verified(index, number[first[d] : first[d] + size[d]], t, start - int(first[d]), slack):
                        labels[lo + d][label] = score
            cols = [[], [], [], [], [], []]
            for i in range(n):
                hits = base.get(i, ())
                own, scored = sorted({x for _, x in hits}), labels.get(i, {})
                starts = [p for p, _ in hits]
                row = (len(hits), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(sorted({*own, *scored})), max([1.0] * bool(own) + list(scored.values()), default=0.0))
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(total), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None, votes: int = MIN_VOTES, least: float = MIN_SCORE, slack: int = SLACK) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 with a base label, else the best share of a verified template, else 0.
    """
    index = index or Index()
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    # at most as many rows as the vocabulary has words
    counts = {r.w: r.n for r in rows.select("_t").mapInArrow(_frequencies(index), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    documents = counts.pop(-1, 0)
    idf = {w: math.log((1 + documents) / n) for w, n in counts.items()}
    return rows.mapInArrow(_scan(index, idf, votes, least, slack), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
