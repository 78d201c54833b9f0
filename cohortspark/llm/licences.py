"""Licence scans: an index of licence words with their places in phrases and notices, intersected by relative position."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import dropped, smaller, texts_of

#: Of a notice's words that a file has, the ones of highest IDF that are looked up; and the share of their weight that must stand in place.
RARE, LEAST_SHARE = 12, 0.6

# The phrases that count wherever they stand, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Public notices of well-known licences (label, text, phrases that must stand in it).
NOTICES = (
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms", "with or without modification")),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("redistribution and use in source and binary forms", "endorse or promote products derived from this software")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2 0", "except in compliance with the license")),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "version 2 of the license")),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3 of the license")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software released into the public domain",)),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ("alter it and redistribute it freely",)),
)

#: By byte: A-Z as a-z, and whether it belongs to a word (digits, letters, everything beyond ASCII).
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased bytes of texts that begin and end at `at`: where each word starts and ends, and the first word of each text (and the end)."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = _IN_WORD[raw]
    before = np.r_[False, inside[:-1]]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(starts, at)


def words_of(text: str) -> list[str]:
    raw = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = spans(raw, np.array([0, len(raw)]))
    return [raw[a:b].tobytes().decode() for a, b in zip(starts, ends)]


@dataclass(frozen=True)
class Licences:
    """The words of phrases and notices, and the places of each."""

    phrases: tuple[tuple[str, str], ...] = tuple(PHRASES.items())
    notices: tuple[tuple[str, str, tuple[str, ...]], ...] = NOTICES

    def __post_init__(self):
        texts = [words_of(t) for t in (*(p for p, _ in self.phrases), *(t for _, t, _ in self.notices), *(k for n in self.notices for k in n[2]))]
        vocabulary = sorted({w.encode() for t in texts for w in t})
        number = {w: k for k, w in enumerate(vocabulary)}
        ids = lambda text: np.array([number[w.encode()] for w in words_of(text)], np.int64)
        put = lambda k, v: object.__setattr__(self, k, v)
        put("vocabulary", np.array(vocabulary))
        put("width", max(map(len, vocabulary)))
        put("base", [ids(p) for p, _ in self.phrases])
        put("texts", [ids(t) for _, t, _ in self.notices])
        put("keys", [[ids(k) for k in ks] for _, _, ks in self.notices])
        looks = np.zeros((256, 256), bool)
        for w in vocabulary:
            looks[w[0], w[-1]] = True
        put("looks", looks)


class Words:
    """The words of a batch of texts: the number of each in the vocabulary or -1, and the first of each text (and the end)."""

    def __init__(self, texts: pa.Array, licences: Licences):
        texts = texts.cast(pa.large_binary())
        _, places, data = texts.buffers()
        at = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = _LOWER[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        starts, ends, self.first = spans(raw, at - at[0])
        self.ids = np.full(len(starts), -1, np.int64)
        if not len(starts):
            return
        some = np.flatnonzero((ends - starts <= licences.width) & licences.looks[raw[starts], raw[ends - 1]])
        if len(some):
            reach = np.arange(licences.width)
            cells = starts[some, None] + reach
            letters = np.where(cells < ends[some, None], raw[np.minimum(cells, len(raw) - 1)], 0).astype(np.uint8)
            keys = letters.view(f"S{licences.width}").ravel()
            found = np.minimum(np.searchsorted(licences.vocabulary, keys), len(licences.vocabulary) - 1)
            self.ids[some] = np.where(licences.vocabulary[found] == keys, found, -1)

    def stands(self, phrase: np.ndarray, anchor: int) -> np.ndarray:
        """Where a phrase stands: each of its anchor word's places gives a start by relative position, and all other words must agree."""
        starts = np.flatnonzero(self.ids == phrase[anchor]) - anchor
        starts = starts[(starts >= 0) & (starts + len(phrase) <= len(self.ids))]
        text = np.searchsorted(self.first, starts, side="right")
        starts = starts[starts + len(phrase) <= self.first[np.minimum(text, len(self.first) - 1)]]
        for j, w in enumerate(phrase):
            starts = starts[self.ids[starts + j] == w]
        return starts


def document_counts(docs: DataFrame, licences: Licences) -> tuple[np.ndarray, int]:
    """In how many documents each licence word stands, and the number of documents; a few hundred rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped()
        counts = np.zeros(len(licences.vocabulary) + 1, np.int64)
        for batch in smaller(batches, 0):
            words = Words(batch.column(0), licences)
            there = np.flatnonzero(words.ids >= 0)
            text = np.searchsorted(words.first, there, side="right") - 1
            pairs = np.unique(text * len(licences.vocabulary) + words.ids[there])
            counts += np.bincount(pairs % len(licences.vocabulary), minlength=len(counts))
            counts[-1] += batch.num_rows
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(licences.vocabulary) + 1, np.int64)
    for r in rows:
        counts[r["word"]] = r["n"]
    return counts[:-1], int(counts[-1])


class Index:
    """Postings of every licence word with its IDF: the phrases' anchors, and each notice's words from the rarest on."""

    def __init__(self, licences: Licences, counts: np.ndarray, documents: int):
        self.licences = licences
        self.idf = np.array([math.log((documents + 1) / (c + 1)) + 1 for c in counts.tolist()])
        self.base = [(label, p, self.rarest(p)) for (_, label), p in zip(licences.phrases, licences.base)]
        self.notices = []
        for (label, _, _), text, keys in zip(licences.notices, licences.texts, licences.keys):
            words = np.unique(text)
            words = words[np.lexsort((words, -self.idf[words]))]
            postings = {int(w): np.flatnonzero(text == w) for w in words}
            self.notices.append((label, len(text), words, postings, [(k, self.rarest(k)) for k in keys]))

    def rarest(self, phrase: np.ndarray) -> int:
        """The place of the phrase's word of highest IDF, the first of several."""
        return int(np.argmax(self.idf[phrase]))

    def notices_in(self, ids: np.ndarray, keys: list[np.ndarray], notice: int) -> list[tuple[int, int, float]]:
        """Where one notice stands in one text: first word, last word, share of weight in place.

        Of its words that the text has, the RARE of highest IDF are looked up. Each posting of each of their places
        gives a start of the notice; starts that lie close together speak for one place. A place counts where
        words of LEAST_SHARE of the weight agree and every key phrase stands within it.
        """
        _, size, words, postings, phrases = self.notices[notice]
        looked = [int(w) for w in words[np.isin(words, ids)][:RARE]]
        hits = [(ids == w).nonzero()[0] for w in looked]
        starts = np.concatenate([(h[:, None] - postings[w]).ravel() for h, w in zip(hits, looked)])
        which = np.concatenate([np.full(len(h) * len(postings[w]), k) for k, (h, w) in enumerate(zip(hits, looked))])
        order = np.lexsort((which, starts))
        starts, which = starts[order], which[order]
        weight = self.idf[looked]
        whole = float(np.sort(self.idf[words])[::-1][:RARE].sum())
        slack = max(1, size // 6)
        out: list[tuple[int, int, float]] = []
        # Only windows whose first start differs from the one before need a look, and those that begin beyond the last place found.
        ends = np.searchsorted(starts, starts + slack, side="right")
        a, done = 0, None
        have = np.zeros(len(looked), np.int64)
        b = 0
        for a in range(len(starts)):
            while b < ends[a]:
                have[which[b]] += 1
                b += 1
            if (done is None or starts[a] > done) and (a == 0 or starts[a] != starts[a - 1]):
                share = float(weight[have > 0].sum()) / whole
                if share >= LEAST_SHARE:
                    low, high = max(0, int(starts[a])), min(len(ids), int(starts[a]) + size + 2 * slack)
                    if all(((k >= low) & (k + len(p) <= high)).any() for k, (p, _) in zip(keys, phrases)):
                        out.append((low, high - 1, min(1.0, share)))
                        done = int(starts[a]) + slack
            have[which[a]] -= 1
        return out


FOUND = "array<struct<label:string,first_word:bigint,last_word:bigint,share:double>>"
RESULT = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found {FOUND}"


def licence_scans(docs: DataFrame, licences: Licences | None = None) -> DataFrame:
    """The licence phrases and notices of every whole text, one row per document (repeated rows each).

    n_base, first_word and last_word count all places of the phrases and give their smallest and largest start;
    found has the notices with the words they span and their share. score: 0 without any label, else half, plus
    half the best notice's share. A null or empty text has no words, empty labels and score 0; other columns play
    no part; an empty table gives no rows. Equal IDFs go by the words. The IDF of the licence vocabulary (a few
    hundred words) is counted over all documents first; memory is bounded by 4 MB of text or one text.
    """
    licences = licences or Licences()
    docs = texts_of(docs)
    counts, documents = document_counts(docs, licences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped()
        index = Index(licences, counts, documents)
        for batch in smaller(batches):
            words = Words(batch.column(1), licences)
            n = batch.num_rows
            text_of = lambda starts: np.searchsorted(words.first, starts, side="right") - 1
            n_base, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base_labels, labels = [set() for _ in range(n)], [set() for _ in range(n)]
            found: list[list] = [[] for _ in range(n)]
            for label, phrase, anchor in index.base:
                starts = words.stands(phrase, anchor)
                text = text_of(starts)
                np.add.at(n_base, text, 1)
                np.minimum.at(low, text, starts - words.first[text])
                np.maximum.at(high, text, starts - words.first[text])
                for t in np.unique(text).tolist():
                    base_labels[t].add(label)
                    labels[t].add(label)
            for k, (label, _, _, _, phrases) in enumerate(index.notices):
                places = [words.stands(p, anchor) for p, anchor in phrases]
                texts = [text_of(s) for s in places]
                candidates = np.unique(texts[0])
                for t in texts[1:]:
                    candidates = candidates[np.isin(candidates, t)]
                for t in candidates.tolist():
                    first = words.first[t]
                    for a, b, share in index.notices_in(words.ids[first : words.first[t + 1]], [s[u == t] - first for s, u in zip(places, texts)], k):
                        found[t].append({"label": label, "first_word": a, "last_word": b, "share": share})
                        labels[t].add(label)
            score = [0.0 if not labels[t] else 0.5 + 0.5 * max((f["share"] for f in found[t]), default=0.0) for t in range(n)]
            kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(words.first)), pa.array(n_base), pa.array(low, mask=n_base == 0), pa.array(high, mask=n_base == 0),
                    pa.array([",".join(sorted(s)) for s in base_labels]), pa.array([",".join(sorted(s)) for s in labels]), pa.array(score),
                    pa.array([sorted(f, key=lambda x: (x["first_word"], x["label"])) for f in found], kind),
                ],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )

    return docs.mapInArrow(run, RESULT)
