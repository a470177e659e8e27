"""License scans by an exact set-similarity join of text blocks with license templates.

A block is a line of a document, or any ``ceil(words of the template / THRESHOLD)`` consecutive words of it: a notice
wrapped over lines is found wherever the breaks are.  Block and template are sets of words
(``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z).  A block carries a template when
|block and template| >= THRESHOLD * |template| (containment).  Words have one global order: rarest in
the corpus first.  Filter, exact: of a template only the first
``|T| - need + 1`` words in that order (the prefix) can be a block's first common word.  Length and position
filters would add nothing to it and every block meets every template (they are few).  Survivors are counted exactly.

Besides, phrases whose words stand consecutively give base labels (these may cross lines).

The templates are a fixed small list; only the corpus frequency of their words is gathered.

Defined results: null text is empty; no words -> n_words 0, empty labels, score 0; every row of the
input gives one row, repeated rows too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._stage import table
from ._text import ALNUM, LOWER, pieces, prefix_hash, span_hash, word_spans

THRESHOLD = 0.8
# Phrases of the base labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notices of well-known licenses.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "apache-2": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    "all-rights-reserved": "All rights reserved",
}


def words_of(text: str) -> list[str]:
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in words]).astype(np.int64)
    return span_hash(prefix_hash(data), end - [len(w.encode()) for w in words], end)


class Scanner:
    """Templates prepared for one global word order (``freq``: blocks of the corpus that hold a word)."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str], threshold: float, freq: dict[int, int] | None = None):
        self.names = sorted(templates)
        sets = [sorted(set(words_of(templates[k]))) for k in self.names]
        vocab = sorted({w for s in sets for w in s})
        self.vocab = np.sort(_hashes(vocab)) if vocab else np.zeros(0, np.uint64)
        freq = freq or {}
        order = lambda i: (freq.get(int(self.vocab[i]), 0), int(self.vocab[i]))
        self.sets = [np.array(sorted(np.searchsorted(self.vocab, _hashes(s)), key=order), np.int64) for s in sets]
        self.need = [int(np.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.span = [int(np.ceil(len(words_of(templates[k])) / threshold - 1e-9)) for k in self.names]
        self.phrases = [(_hashes(words_of(p)), label) for p, label in phrases.items()]

    def ids(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at, -1)

    @staticmethod
    def words(data: np.ndarray, off: np.ndarray):
        """(hash, document, block) of each word and the first word of each document."""
        low = LOWER[data]
        start, end, first = word_spans(low, off, ~ALNUM)
        h = span_hash(prefix_hash(low), start, end)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        breaks = np.flatnonzero(low == 10)
        return h, doc, np.searchsorted(breaks, start) + doc, first

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        h, _, block, _ = self.words(data, off)
        i = self.ids(h)
        key = np.unique(block[i >= 0] * len(self.vocab) + i[i >= 0])
        return np.bincount(key % len(self.vocab), minlength=len(self.vocab))

    def scan(self, data: np.ndarray, off: np.ndarray):
        h, doc, block, first = self.words(data, off)
        n = len(off) - 1
        places: list[list[int]] = [[] for _ in range(n)]
        base: list[set[str]] = [set() for _ in range(n)]
        for p, label in self.phrases:
            m = len(p)
            at = np.flatnonzero(h[: max(len(h) - m + 1, 0)] == p[0])
            for j in range(1, m):
                at = at[h[at + j] == p[j]]
            at = at[doc[at] == doc[at + m - 1]]
            for x in at:
                places[doc[x]].append(int(x - first[doc[x]]))
                base[doc[x]].add(label)
        labels = [set(s) for s in base]
        score = np.array([1.0 if s else 0.0 for s in base])
        i = self.ids(h)
        b, w = block[i >= 0], i[i >= 0]
        key = np.unique(b.astype(np.int64) * len(self.vocab) + w)
        b, w = key // len(self.vocab), key % len(self.vocab)
        edge = np.concatenate(([True], b[1:] != b[:-1])) if len(b) else np.zeros(0, bool)
        group = np.cumsum(edge) - 1
        ids = b[edge]
        # a block's first and last word share its document
        where = np.searchsorted(block, ids) if len(ids) else np.zeros(0, np.int64)
        for t, (s, need) in enumerate(zip(self.sets, self.need, strict=True)):
            pos = np.full(len(self.vocab), len(s))
            pos[s] = np.arange(len(s))
            in_t = pos[w] < len(s)
            if not in_t.any():
                continue
            low = np.full(len(ids), len(s))
            np.minimum.at(low, group[in_t], pos[w[in_t]])
            # prefix filter, then the exact overlap
            alive = low <= len(s) - need
            over = np.bincount(group[in_t & alive[group]], minlength=len(ids))
            for x in np.flatnonzero(alive & (over >= need)):
                d = doc[where[x]]
                labels[d].add(self.names[t])
                score[d] = max(score[d], over[x] / len(s))
            for d, most in self.windows(t, i, doc, block):
                labels[d].add(self.names[t])
                score[d] = max(score[d], most / len(s))
        return np.diff(first), places, base, labels, score

    def windows(self, t: int, i: np.ndarray, doc: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
        """(document, common words) of each document whose windows over a line break hold enough of template ``t``; the largest of a document."""
        s, need = self.sets[t], self.need[t]
        rank = np.full(len(self.vocab) + 1, len(s))  # the last place is for words of no template
        rank[s] = np.arange(len(s))
        at = np.flatnonzero(rank[i] < len(s))
        if not len(at):
            return []
        # a window from a template word to the last one in reach; no window leaves its document
        end = np.minimum(np.searchsorted(at, at + self.span[t]), np.searchsorted(doc[at], doc[at], "right"))
        rare = np.concatenate(([0], np.cumsum(rank[i[at]] <= len(s) - need)))
        a = np.arange(len(at))
        # bounds: words with repeats, and one word of the prefix; a window inside one line is part of its block
        a = a[(end - a >= need) & (rare[end] > rare[a]) & (block[at] != block[at[end - 1]])]
        if not len(a):
            return []
        order = np.argsort(i[at], kind="stable")
        last = np.full(len(at), -1)
        same = i[at[order[1:]]] == i[at[order[:-1]]]
        last[order[1:][same]] = order[:-1][same]
        over = np.zeros(len(a), np.int64)
        for j in range(int((end[a] - a).max())):
            x = np.minimum(a + j, len(at) - 1)
            over += (a + j < end[a]) & (last[x] < a)
        best: dict[int, int] = {}
        for d, n in zip(doc[at[a]][over >= need], over[over >= need], strict=True):
            best[int(d)] = max(best.get(int(d), 0), int(n))
        return list(best.items())


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text, …) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (largest containment, 1 for a phrase)."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    docs = docs.select("doc_id", "text")
    bare = Scanner(templates, phrases, threshold)

    def count(batches):
        total = np.zeros(len(bare.vocab), np.int64)
        for batch in batches:
            for _, data, off in pieces(batch):
                total += bare.counts(data, off)
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.array(bare.vocab.view(np.int64)), pa.array(total)], ["w", "n"])

    freq = {int(np.int64(r[0]).view(np.uint64)): r[1] for r in docs.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n")).collect()}
    ready = Scanner(templates, phrases, threshold, freq)

    def run(batches):
        for batch in batches:
            for part, data, off in pieces(batch):
                n, places, base, labels, score = ready.scan(data, off)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(n.astype(np.int64)), pa.array([len(p) for p in places], pa.int64()),
                        pa.array([min(p) if p else None for p in places], pa.int64()), pa.array([max(p) if p else None for p in places], pa.int64()),
                        pa.array([",".join(sorted(s)) for s in base]), pa.array([",".join(sorted(s)) for s in labels]), pa.array(score),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    temp = ", ".join(f"({q(k)}, [{', '.join(q(w) for w in sorted(set(words_of(v))))}])" for k, v in sorted(TEMPLATES.items()))
    phr = ", ".join(f"([{', '.join(map(q, words_of(p)))}], {q(label)})" for p, label in PHRASES.items())
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
w AS (SELECT doc_id, s, regexp_extract_all(s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
p(ph, label) AS (VALUES {phr}),
t(label, ts) AS (VALUES {temp}),
b AS (SELECT w.doc_id, label, i - 1 AS i FROM w, p, unnest(generate_series(1, len(ws) - len(ph) + 1)) AS g(i)
      WHERE contains(s, ph[1]) AND ws[i] = ph[1] AND ws[i : i + len(ph) - 1] = ph),
bb AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
l AS (SELECT doc_id, regexp_extract_all(unnest(string_split(s, chr(10))), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS lw FROM d),
m AS (SELECT doc_id, label, len(list_intersect(list_distinct(lw), ts)) / len(ts) AS c, len(list_intersect(list_distinct(lw), ts)) AS o, len(ts) AS n FROM l, t WHERE len(lw) > 0),
k AS (SELECT doc_id, label, c FROM m WHERE o >= ceil({THRESHOLD} * n - 1e-9)),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS c
      FROM (SELECT doc_id, label, 1.0 AS c FROM b UNION ALL SELECT * FROM k) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(c, 0) AS DOUBLE) AS score
FROM w LEFT JOIN bb USING (doc_id) LEFT JOIN a USING (doc_id)
"""


ORACLE_SQL = oracle()
