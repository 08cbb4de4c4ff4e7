"""License scans: a generalised suffix automaton of licence words, matching statistics, chained spans."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, words_of
from .licence_texts import WHOLE

# Phrases that always count where their words stand consecutively (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Openings and whole texts of common licences; a label of its own each, found by covered spans.
TEMPLATES = {
    **WHOLE,
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "cc-by-text": "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit",
}


class SuffixAutomaton:
    """Generalised suffix automaton over the word sequences of several templates.

    States and links grow with the templates only. Each state knows in which templates, and where,
    its words end, and which whole phrases are suffixes of it.
    """

    def __init__(self, templates: list[list[bytes]]):
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for t, words in enumerate(templates):
            last = 0
            for place, word in enumerate(words):
                last = self._extend(last, self.words.setdefault(word, len(self.words)), ends)
                ends[last].add((t, place + 1))
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            ends[self.link[s]] |= ends[s]
        ends[0] = set()
        self.ends = [sorted(e) for e in ends]
        whole = {t: self._state_of(words) for t, words in enumerate(templates)}
        #: Per state the templates that are suffixes of its words, longest first: they end where the match is long enough.
        self.whole: list[list[tuple[int, int]]] = []
        for s in range(len(self.len)):
            found, v = [], s
            while v > 0:
                found += [(len(templates[t]), t) for t, w in whole.items() if w == v]
                v = self.link[v]
            self.whole.append(sorted(found, reverse=True))

    def _state_of(self, words: list[bytes]) -> int:
        s = 0
        for w in words:
            s = self.next[s][self.words[w]]
        return s

    def _new(self, length: int, link: int, to: dict[int, int], ends: list) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(to)
        ends.append(set())
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int, ends: list) -> int:
        """The state for the suffix of q that p's step on c makes; a copy of q where q holds longer words."""
        if self.len[q] == self.len[p] + 1:
            return q
        copy = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]), ends)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int, ends: list) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c, ends)
        own = self._new(self.len[last] + 1, 0, {}, ends)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = own
            p = self.link[p]
        self.link[own] = self._split(p, self.next[p][c], c, ends) if p >= 0 else 0
        return own

    def matches(self, words: list[bytes]):
        """Matching statistics: for each place with a match (place, state, length of the longest match that ends there)."""
        get, to, link, size = self.words.get, self.next, self.link, self.len
        v = n = 0
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                v = n = 0
                continue
            while v and c not in to[v]:
                v = link[v]
                n = size[v]
            v = to[v].get(c, 0)
            n = n + 1 if v else 0
            yield i, v, n


class LicenseScanner:
    """Labels texts by phrases and by chains of template spans.

    A maximal match of ``span`` words or more is a span; spans of one template in order, with at
    most ``gap`` words between, chain; a chain that covers ``cover`` of a template gives its label.
    """

    def __init__(self, phrases: dict[str, str], templates: dict[str, str], span: int = 4, gap: int = 12, cover: float = 0.5):
        self.names = [*phrases.values(), *templates]
        words = [words_of(x) for x in (*phrases, *templates.values())]
        self.sizes, self.n_phrases = [len(w) for w in words], len(phrases)
        self.automaton = SuffixAutomaton(words)
        self.span, self.gap, self.cover = span, gap, cover

    def scan(self, text: str | None) -> dict:
        """``n_words, n_base, first_word, last_word, base, labels, spans, score`` of a whole text."""
        words, a = words_of(text), self.automaton
        base: list[tuple[int, int]] = []
        spans: list[tuple[int, int, int]] = []
        before = (-2, 0, 0)
        for at in a.matches(words):
            i, v, n = at
            if before[2] >= self.span and not (i == before[0] + 1 and n == before[2] + 1):
                spans.append(before)
            before = at
            for size, t in a.whole[v]:
                if t < self.n_phrases and n >= size:
                    base.append((i - size + 1, t))
        if before[2] >= self.span:
            spans.append(before)
        chains: dict[int, list[tuple[int, int, int, int]]] = {}  # template: (covered, document end, template end, document start)
        best: dict[int, tuple[float, int, int]] = {}
        for i, v, n in spans:
            for t, end in a.ends[v]:
                if t < self.n_phrases:
                    continue
                own = i - n + 1
                fits = [(c + n, first) for c, doc_end, place, first in chains.get(t, ()) if 0 <= own - doc_end <= self.gap and place <= end - n]
                covered, start = max(fits, default=(n, own))  # of equal cover the chain that starts last
                chains.setdefault(t, []).append((covered, i + 1, end, start))
                chains[t] = [x for x in chains[t] if i + 1 - x[1] <= self.gap + self.sizes[t]]
                best[t] = max(best.get(t, (0.0, 0, 0)), (min(1.0, covered / self.sizes[t]), start, i + 1))
        own = {self.names[t]: x for t, x in best.items() if x[0] >= self.cover}
        names = sorted({self.names[t] for _, t in base})
        places = [p for p, _ in base]
        return {
            "n_words": len(words), "n_base": len(base), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base": names, "labels": sorted({*names, *own}), "spans": sorted((n, s, e, c) for n, (c, s, e) in own.items()),
            "score": 1.0 if base else max((x[0] for x in best.values()), default=0.0),
        }


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` for each row of ``docs``.

    A narrow map, no shuffle; the automaton has the size of the templates. ``n_base`` counts the
    phrases' places, ``spans`` are the chained template spans in words, ``score`` is the largest
    share of a template that a chain covers (1 where a phrase stands). A null text is empty: no
    words, null places, empty labels, score 0. Null and repeated ids pass through, a row each; an
    empty table gives no rows; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates

    def run(batches: Iterable[pa.RecordBatch]):
        scanner = LicenseScanner(phrases, templates)
        for batch in slices(batches, "t"):
            found = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            column = lambda k, t: pa.array([x[k] for x in found], t)
            numbers = [column(k, pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")]
            labels = [pa.array([",".join(x[k]) for x in found], pa.string()) for k in ("base", "labels")]
            spans = pa.array([[dict(zip(("label", "start", "end", "cover"), s, strict=True)) for s in x["spans"]] for x in found], _SPANS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *numbers, *labels, column("score", pa.float64()), spans],
                [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    own = docs.select(docs[id_col].alias("k"), docs[text_col].alias("t"))
    schema = f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,cover:double>>"
    return own.mapInArrow(run, schema)
